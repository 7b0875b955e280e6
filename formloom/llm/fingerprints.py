"""Document fingerprints by Order MinHash; DataFrame functions only.

Every k-mer of words is numbered by its occurrence in the text, so that
repeats count. One hash deals the numbered k-mers to ``2 ** BUCKET_BITS``
buckets; each bucket keeps its ``TUPLE`` smallest, puts them back into text
order, and hashes that tuple. Texts agree in a bucket only where they share
the same k-mers in the same order, which is what edit distance asks for;
swapping two passages changes tuples that plain MinHash would not notice.

The likeness of two fingerprints is the share of buckets, among those that
either fills, whose tuples agree.

Defined cases: null is the empty text; texts of fewer than K words are one
k-mer; texts without words have the fingerprint '' and are alike (1) to each
other, unlike (0) to others; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.llm.common import let, text_or_empty

K = 3
TUPLE = 2
BUCKET_BITS = 6
#: Packed longs: 39 bits of hash over 24 bits of word position; positions beyond 16.7 million words tie.
HASH_BITS, PLACE_BITS = 39, 24
REST_BITS = HASH_BITS - BUCKET_BITS
LEAST_ID = -(2**63)


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit(2**bits - 1).cast("long"))


def _pack(h: Column, place: Column) -> Column:
    return F.shiftleft(_low(h, HASH_BITS), PLACE_BITS).bitwiseOR(F.least(place.cast("long"), F.lit(2**PLACE_BITS - 1).cast("long")))


def _bucket(x: Column) -> Column:
    """Bucket of a packed value, or of one in ``_in_text_order``: the top bits of either."""
    return F.shiftright(x, 63 - BUCKET_BITS)


def _kmers(words: Column) -> Column:
    n = F.size(words)
    return (
        F.when(n >= K, F.transform(F.sequence(F.lit(0), n - K), lambda i: _pack(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i)))
        .when((n == 1) & (words[0] == ""), F.array().cast("array<bigint>"))
        .otherwise(F.array(_pack(F.xxhash64(F.array_join(words, " ")), F.lit(0))))
    )


def _numbered(kmers: Column) -> Column:
    """Packed values of (k-mer, occurrence) from k-mers sorted by hash, then place."""
    steps = F.array(*[F.lit(2**b) for b in range(PLACE_BITS - 1, -1, -1)])

    def number(x: Column, i: Column) -> Column:
        h = F.shiftright(x, PLACE_BITS)
        same = lambda j: F.shiftright(F.get(kmers, j), PLACE_BITS) == h
        back = F.aggregate(steps, F.lit(0), lambda d, s: F.when((i - d - s >= 0) & same(i - d - s), d + s).otherwise(d))
        seen = F.when((i > 0) & same(i - 1), back).otherwise(F.lit(0))
        return _pack(F.xxhash64(h, seen), _low(x, PLACE_BITS))

    return F.transform(kmers, number)


def _smallest(numbered: Column) -> Column:
    return F.filter(numbered, lambda x, i: (i < TUPLE) | (_bucket(F.get(numbered, i - TUPLE)) != _bucket(x)))


def _in_text_order(x: Column) -> Column:
    """bucket | place | rest of the hash"""
    top = F.shiftleft(_bucket(x), 63 - BUCKET_BITS)
    place = F.shiftleft(_low(x, PLACE_BITS), REST_BITS)
    return top.bitwiseOR(place).bitwiseOR(_low(F.shiftright(x, PLACE_BITS), REST_BITS))


def _tuples(chosen: Column) -> Column:
    def first_of_bucket(x: Column, i: Column) -> Column:
        own = F.filter(F.slice(chosen, i + 1, TUPLE), lambda y: _bucket(y) == _bucket(x))
        code = _low(F.xxhash64(F.transform(own, lambda y: _low(y, REST_BITS))), 32)
        return F.when((i == 0) | (_bucket(F.get(chosen, i - 1)) != _bucket(x)), F.shiftleft(_bucket(x), 32).bitwiseOR(code))

    return F.filter(F.transform(chosen, first_of_bucket), lambda t: t.isNotNull())


def signature(text: Column) -> Column:
    """Ascending array of ``bucket * 2**32 + tuple hash``, one for each filled bucket."""
    words = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    return let(words, lambda w: let(F.sort_array(_kmers(w)), lambda s: let(F.sort_array(_numbered(s)), lambda g: let(
        F.sort_array(F.transform(_smallest(g), _in_text_order)), _tuples))))


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda t: F.lpad(F.lower(F.hex(t)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    of = lambda s: F.transform(s, lambda t: F.shiftright(t, 32))
    filled = F.size(F.array_union(of(a), of(b)))
    return F.when(filled == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / filled)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, signature of every row."""
    text = text_or_empty(text_col)
    return docs.select(id_col, F.char_length(text).cast("long").alias("n_chars"), signature(text).alias("signature"))


def next_in_order(ids: DataFrame, parts: int | None = None) -> DataFrame:
    """For distinct ``_id`` with ``_need``: the id that it follows (descending; the first follows the last).

    Ids are dealt to ranges; order is only made inside a range, and one row per
    range closes the gaps between them.
    """
    spark = ids.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ids.repartitionByRange(parts, F.col("_id").desc()).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(F.col("_id").desc())
    rows = dealt.select("_id", "_need", "_part", F.lag("_id").over(inside).alias("_before"), F.lag("_need").over(inside).alias("_asked"))
    ends = dealt.groupBy("_part").agg(F.min("_id").alias("_end"), F.min_by("_need", "_id").alias("_end_need"))
    across = Window.orderBy("_part")
    last = F.struct("_end", "_end_need")
    ends = ends.select("_part", F.coalesce(F.lag(last).over(across), F.last(last).over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_prior"))
    return rows.join(F.broadcast(ends), "_part").select(
        F.col("_id").alias("_next"), F.coalesce("_before", "_prior._end").alias("_id"), F.coalesce("_asked", "_prior._end_need").alias("_ask")
    )


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, and how alike they are.

    The edited text is the text with its last ``floor(n_chars / 2)`` code points
    replaced by the first as many of the next document by descending id. Where
    rows share an id, the least of their texts stands for it as a next document
    (a null id orders last).
    """
    text = text_or_empty()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_id"), text.alias("_text"))
    ids = rows.groupBy("_id").agg(F.max(F.floor(F.char_length("_text") / 2)).alias("_need"), F.count(F.lit(1)).alias("_rows"))
    order = next_in_order(ids.select("_id", "_need"))
    # both uses below need the same three columns by _id, so that Spark shuffles (and signs) the texts once
    signed = rows.withColumn("_sig", signature(F.col("_text")))
    own, after = signed.alias("own"), signed.alias("after")
    if ids.filter("_rows > 1").limit(1).count():
        after = signed.groupBy("_id").agg(F.min(F.struct("_text", "_sig")).alias("_h")).select("_id", "_h.*").alias("after")
    heads = after.join(order.alias("o"), F.col("after._id") == F.col("o._next")).select(
        F.col("o._id").alias("_for"), F.substring("after._text", F.lit(1), F.col("o._ask").cast("int")).alias("_head"), F.col("after._sig").alias("_next_sig")
    )
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), F.col("_n") - half), F.substring("_head", F.lit(1), half))
    both = own.join(heads, F.col("own._id") == F.col("_for")).select("own._id", "_text", "own._sig", "_head", "_next_sig", F.char_length("_text").alias("_n"))
    both = both.withColumn("_edited", edited).withColumn("_edited_sig", signature(F.col("_edited")))
    both = both.withColumn("doc_id", F.when(F.col("_id") != LEAST_ID, F.col("_id")))
    return both.select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        as_string(F.col("_sig")).alias("fingerprint"), as_string(F.col("_edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"), likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"),
    )
