"""Exact duplicates by progressive refinement: length, then a digest of the prefix, then one of the whole text.

Three passes count keys, each only over rows whose key of the pass before was
met twice: lengths; lengths with a hash of the first ``PREFIX_CHARS`` code
points; these with the SHA-256 of the whole text. Counting is an aggregate, so
every map task sends a key once, however many copies it has, and no text is
shuffled at any size. Each pass scans again, but reads a text only as far as
its key needs: content that is alone by length or by prefix is never hashed.

Keys that were met twice go to the next pass as a broadcast if they are at most
``SENT_KEYS`` rows. Beyond that they meet the rows in Spark's shuffled joins,
which can split a skewed key; the rows are ids and digests then, made before
the join, because hashing a whole text costs less than shuffling it.

Of equal texts the row with the largest id stays. Defined cases: a null text is
the empty text; a null id is below all others; of rows that share text and
largest id the one whose other columns are least (nulls first) stays, and of
rows equal in every column one stays; extra columns pass through, but those
named as a result give way; empty tables stay empty. The other columns are only
compared where rows share text and largest id; they must be of types that Spark
can order then.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import kept

PREFIX_CHARS = 128
#: Rows of keys that are broadcast; a key of the last pass takes about 150 bytes.
SENT_KEYS = 300_000
RESULTS = ("keep_id", "group_size", "kept")
KEYS = LENGTH, PREFIX, WHOLE = ["_length", "_prefix", "_whole"]


class Met(NamedTuple):
    """Keys that several rows have; ``sent``: few enough to be broadcast."""

    table: DataFrame
    keys: list[str]
    sent: bool


def _met_twice(rows: DataFrame, keys: list[str]) -> Met:
    table = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(*keys))
    return Met(table, keys, _is_sent(table))


def _is_sent(table: DataFrame) -> bool:
    return table.limit(SENT_KEYS + 1).count() <= SENT_KEYS


def _next_key(rows: DataFrame, met: Met, name: str, value: Column) -> DataFrame:
    """Add the next pass's key: null where the row's key so far is its own alone, as far as that is known without a shuffle."""
    if not met.sent:
        return rows.withColumn(name, value)
    found = F.broadcast(met.table.withColumn("_found", F.lit(True)))
    return rows.join(found, met.keys, "left").withColumn(name, F.when(F.col("_found"), value)).drop("_found")


def _of_met(rows: DataFrame, met: Met, name: str) -> DataFrame:
    """Only rows whose key so far others have too."""
    return rows.filter(F.col(name).isNotNull()) if met.sent else rows.join(met.table, met.keys, "left_semi")


def _refined(rows: DataFrame, text: Column, id_name: str) -> tuple[DataFrame, DataFrame]:
    """Groups of equal texts with _size, _keep and _ties (rows of the id that stays); all rows with their keys."""
    sized = rows.withColumn(LENGTH, F.octet_length(text))
    prefix, whole = F.xxhash64(F.substring(text, 1, PREFIX_CHARS)), F.sha2(text, 256)
    by_length = _met_twice(sized.select(LENGTH), [LENGTH])
    begun = _next_key(sized, by_length, PREFIX, prefix)
    by_prefix = _met_twice(_of_met(begun.select(LENGTH, PREFIX), by_length, PREFIX), [LENGTH, PREFIX])
    read = _next_key(begun, by_prefix, WHOLE, whole).select(F.col(id_name).alias("_id"), *KEYS)
    # copies that share their id are counted first, so that the largest id's count is known
    per_id = _of_met(read, by_prefix, WHOLE).groupBy(*KEYS, "_id").agg(F.count(F.lit(1)).alias("_n"))
    found = per_id.groupBy(*KEYS).agg(
        F.sum("_n").alias("_size"), F.max("_id").alias("_keep"), F.max_by("_n", F.struct(F.col("_id").isNotNull(), "_id")).alias("_ties")
    )
    return kept(found.filter("_size > 1")), _next_key(begun, by_prefix, WHOLE, whole)


def _one_of_ties(rows: DataFrame, own: list[str], tied: Column) -> DataFrame:
    """``rows`` with _kept true for only one of the tied rows of each text."""
    some = rows.filter(tied).groupBy(*own, *KEYS, "_size", "_keep", "_ties").agg(F.count(F.lit(1)).alias("_n"))
    least = some.groupBy(*KEYS).agg(F.min(F.struct(*own)).alias("_least"))
    each = some.join(least, KEYS).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    each = each.withColumn("_kept", (F.col("_i") == 1) & F.struct(*own).eqNullSafe(F.col("_least")))
    return rows.filter(~tied).unionByName(each.select(rows.columns))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with keep_id, group_size and kept (true for one row of each group of equal texts)."""
    names = [c for c in docs.columns if c not in RESULTS]
    own = [f"c{i}" for i in range(len(names))]
    rows = docs.select(*[docs[f"`{c}`"].alias(o) for c, o in zip(names, own, strict=True)])
    id_own, text_own = own[names.index(id_col)], own[names.index(text_col)]
    found, keyed = _refined(rows, F.coalesce(F.col(text_own).cast("string"), F.lit("")), id_own)
    grouped = keyed.join(F.broadcast(found) if _is_sent(found) else found, KEYS, "left")
    stays = F.col(id_own).eqNullSafe(F.col("_keep"))
    out = grouped.withColumn("_kept", F.col("_size").isNull() | stays)
    if found.filter("_ties > 1").limit(1).count():
        out = _one_of_ties(out, own, F.coalesce(F.col("_ties") > 1, F.lit(False)) & stays)
    return out.select(
        *[F.col(o).alias(c) for c, o in zip(names, own, strict=True)],
        F.when(F.col("_size").isNull(), F.col(id_own)).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.col("_kept").alias("kept"),
    )
