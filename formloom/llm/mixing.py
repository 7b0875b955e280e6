"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source whose target is ``r`` times its words gives ``floor(r)`` certain
copies of every document. The rest comes from a Pareto order sample in which
every document has a chance of its own, ``p = min(1, c * size)``; ``c`` is the
one number of its source at which the chances times the sizes add up to the
words that are still wanted (read off running sums over the source's distinct
sizes; documents at 1 are certain). A document draws ``u`` from a hash of its
id and text; its rank value is the random odds ``u / (1 - u)`` divided by its
inclusion odds ``p / (1 - p)``, 0 for certain ones. Documents are taken in rank
order until the words are filled (the last one is taken if that comes nearer).

No source is sorted as a whole: a histogram of rank values finds the bin that
holds the cut, and only that bin's documents are ordered, after equal ones were
counted. What the rest of the plan needs is one row per source.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; equal rank values are ordered by id, then size; of rows equal in
id and text, which share their draw, the cut may take a part: the first by the
other columns, of rows equal in all columns as many as fit. Documents without
words have no chance and nothing to give. An empty table gives no rows; other
columns pass through ``mixed`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import cut, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
BINS = 4096


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of a hash of id and text; the same in every run."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}:"), F.md5(text)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def source_targets(sized: DataFrame, weights=WEIGHTS, share_percent=SHARE_PERCENT, most=MOST_COPIES) -> DataFrame:
    """One row per source: words, target, certain copies and the words wanted besides.

    Targets are ``min(most * size, level * weight)``; the level at which they
    add up to the whole share is where resharing the excess ends. It is read
    off running sums over the sources in the order in which they reach their
    stops.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    sources = (
        sized.groupBy("_source").agg(F.sum("_size").alias("source_size"))
        .withColumn("_at", F.row_number().over(by_name) - 1)
        .withColumn("_w", weight)
        .withColumn("_stop", F.lit(most) * F.col("source_size"))
    )
    filled = Window.orderBy(F.col("_stop") / F.col("_w"), "_at")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (
        F.sum("source_size").over(whole) * F.lit(share_percent / 100) - F.coalesce(F.sum("_stop").over(before), F.lit(0))
    ) / F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("_level", level).withColumn("_full_at", F.col("_stop") / F.col("_w"))
    sources = sources.withColumn("_c", F.min(F.when(F.col("_full_at") >= F.col("_level"), F.struct("_full_at", "_at", "_level"))).over(whole)["_level"])
    target = F.least(F.col("_stop").cast("double"), F.coalesce(F.col("_c") * F.col("_w"), F.col("_stop").cast("double")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sources.withColumn("target", target)
        .withColumn("_copies", F.floor(ratio))
        .withColumn("_want", F.col("target") - F.col("_copies") * F.col("source_size"))
        .select("_source", "source_size", "target", "_copies", "_want")
    )


def with_chances(sources: DataFrame, sized: DataFrame) -> DataFrame:
    """``sources`` with _per_word: a document's chance by word of its size, before the bound of 1.

    From the largest size down, sizes are certain until the words that are left
    can be spread over the rest by size without any chance above 1.
    """
    sizes = _join_source(sized.filter("_size > 0").groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")), sources.select("_source", "_want"))
    # SQL decimals, for squares of sizes add up beyond a long
    sizes = sizes.withColumn("_words", (F.col("_n") * F.col("_size")).cast("decimal(38,0)")).withColumn("_square", (F.col("_words") * F.col("_size")).cast("decimal(38,0)"))
    larger = Window.partitionBy("_source").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("_want") - F.coalesce(F.sum("_words").over(larger), F.lit(0)).cast("double")
    sizes = sizes.withColumns({"_left": left, "_rest": F.sum("_square").over(smaller).cast("double")})
    fits = sizes.filter("_left * _size <= _rest").groupBy("_source").agg(F.max_by(F.col("_left") / F.col("_rest"), "_size").alias("_per_word"))
    return _join_source(sources, fits)


def _join_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    sources = sources.withColumnRenamed("_source", "_s")
    same = (F.coalesce(rows["_source"], F.lit("")) == F.coalesce(sources["_s"], F.lit(""))) & (
        rows["_source"].isNull() == sources["_s"].isNull()
    )
    return rows.join(sources, same, "left").drop("_s")


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with _q, null for those without a chance, and the bin it falls into."""
    u, p = F.col("_u"), F.col("_per_word") * F.col("_size")
    odds = F.when(p >= 1, 0.0).when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    return rows.withColumn("_q", odds).withColumn("_bin", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * BINS), F.lit(BINS - 1)).cast("int"))


PLACE = ("_q", "_id", "_size")


def sample_cuts(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """Per source: targets, chances, and the place in the rank order where its sample ends.

    ``docs`` has _id, _source, _size and _u. Places up to _last are taken; at
    _tie, the next one, there is room for _open words.
    """
    sized = cut(docs)
    sources = cut(with_chances(cut(source_targets(sized, **targets)), sized))
    ranked = _ranked(_join_source(sized, sources)).filter("_q is not null and _want > 0")
    bins = ranked.groupBy("_source", "_bin").agg(F.sum("_size").alias("_words"))
    order = Window.partitionBy("_source").orderBy("_bin")
    bins = _join_source(bins, sources).withColumn("_sum", F.sum("_words").over(order))
    edge = bins.filter((F.col("_sum") - F.col("_words") < F.col("_want")) & (F.col("_sum") >= F.col("_want"))).select(
        "_source", F.col("_bin").alias("_edge"), (F.col("_want") - F.col("_sum") + F.col("_words")).alias("_open")
    )
    edge = edge.groupBy("_source").agg(F.min("_edge").alias("_edge"), F.min_by("_open", "_edge").alias("_open"))
    at_edge = _join_source(ranked, edge).filter("_bin = _edge").groupBy("_source", "_open", *PLACE).agg(F.count(F.lit(1)).alias("_n"))
    place = F.struct(*PLACE)
    words = F.col("_n") * F.col("_size")
    run = Window.partitionBy("_source").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = at_edge.withColumn("_before", F.sum(words).over(run) - words)
    # one row of a place is taken if at least half of it fits
    taken = F.least(F.col("_n"), F.greatest(F.lit(0), F.floor((F.col("_open") - F.col("_before")) / F.col("_size") + 0.5)))
    walked = walked.withColumn("_part", taken.cast("long"))
    ends = walked.groupBy("_source").agg(
        F.max(F.when(F.col("_part") == F.col("_n"), place)).alias("_last"),
        F.min(F.when((F.col("_part") > 0) & (F.col("_part") < F.col("_n")), F.struct(place.alias("place"), F.col("_part").alias("part")))).alias("_tie"),
    )
    return cut(_join_source(_join_source(sources, edge.select("_source", "_edge")), ends))


def with_copies(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """Every document (columns c0, c1, ...) with its size, its source's size and target, and the copies the mix takes."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: o for c, o in zip(docs.columns, own, strict=True)}
    text = text_or_empty(at["text"])
    rows = docs.toDF(*own).withColumns({
        "_id": F.col(at["doc_id"]), "_source": F.col(at["source"]), "_size": word_count(at["text"]), "_u": uniform(F.col(at["doc_id"]), text, seed),
    })
    cuts = sample_cuts(rows.select("_id", "_source", "_size", "_u"), seed, **targets)
    place = F.struct(*PLACE)
    rows = _ranked(_join_source(rows, cuts)).withColumn("_place", place)
    extra = (F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & (F.col("_place") <= F.col("_last")))
    tied = F.coalesce(F.col("_place") == F.col("_tie.place"), F.lit(False))
    rows = rows.withColumn("_extra", F.coalesce(extra, F.lit(False)).cast("int"))
    if cuts.filter("_tie is not null").limit(1).count():
        rows = rows.filter(~tied).unionByName(_part_of_ties(rows.filter(tied), own))
    return rows.withColumn("_taken", F.col("_copies") + F.col("_extra"))


def _part_of_ties(rows: DataFrame, own: list[str]) -> DataFrame:
    """Rows of one place, of which only ``_tie.part`` go into the sample: the first by their columns, equal ones counted."""
    same = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_source", "_place").orderBy(*own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = same.withColumn("_open", F.col("_tie.part") - F.sum("_n").over(run) + F.col("_n"))
    each = same.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return each.withColumn("_extra", (F.col("_i") <= F.col("_open")).cast("int")).drop("_n", "_open", "_i")


def mix_report(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, and the chance of the copy beyond the certain ones."""
    return with_copies(docs, seed, **targets).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("_taken") * F.col("_size")).cast("long").alias("taken"), F.col("_taken").cast("int").alias("copies"),
        F.least(F.lit(1.0), F.coalesce(F.col("_per_word") * F.col("_size"), F.lit(0.0))).alias("chance"),
    )


def mixed(docs: DataFrame, seed: str = "mix", **targets) -> DataFrame:
    """The mix itself: each document as many times as it is taken, columns as they came."""
    rows = with_copies(docs, seed, **targets).filter("_taken > 0")
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_taken").cast("int")))).select(*own)
