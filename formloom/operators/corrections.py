"""The dictionary of learned name corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X
from formloom.operators.ranking import latest

EXAMPLES = 5


def read_corrections(entries: DataFrame) -> DataFrame:
    """Enabled entries whose two sides may be name tokens; the later duplicate of a source wins."""
    source, replacement = X.norm_ws("source"), X.norm_ws("replacement")
    fine = F.coalesce("enabled", F.lit(True)) & X.name_token_ok(source) & X.name_token_ok(replacement) & (source != replacement)
    kept = entries.filter(fine).select(source.alias("source"), replacement.alias("replacement"), "seq")
    return latest(kept, ["source"], ["seq"]).select("source", "replacement")


def learn_corrections(changes: DataFrame) -> DataFrame:
    """Token pairs of changed names with their count, fields and latest examples.

    ``changes(record_id, field, before, after, seq)``. Every map task sends at
    most five examples of a pair: the sixth latest of a stretch of changes can't
    be among the five latest of all.
    """
    rows = changes.filter(F.col("field").isin(*K.NAME_FIELDS) & (X.norm_ws("before") != "") & (X.norm_ws("after") != "") & (X.norm_ws("before") != X.norm_ws("after")))
    pairs = rows.select("field", "before", "after", "seq", F.explode(X.token_pairs("before", "after")).alias("p")).select("p.source", "p.replacement", "field", "before", "after", "seq")
    counted = pairs.groupBy("source", "replacement").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("field")).alias("fields"))
    last = _last_examples(pairs.withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(64))), ["source", "replacement", "_part"])
    last = _last_examples(last.select("source", "replacement", F.explode("examples").alias("e")).select("source", "replacement", "e.*"), ["source", "replacement"])
    return counted.join(last, ["source", "replacement"])


def _last_examples(rows: DataFrame, keys: list[str]) -> DataFrame:
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("seq", "before", "after"))))
    return rows.groupBy(*keys).agg(F.slice(newest, 1, EXAMPLES).alias("examples"))


def merge_learned(entries: DataFrame, learned: DataFrame) -> DataFrame:
    """The dictionary after learning: counts added up, fields joined, repeated entries enabled again."""
    new = learned.select("source", "replacement", F.col("count").alias("_n"), F.col("fields").alias("_f"))
    none = F.array().cast("array<string>")
    return entries.join(new, ["source", "replacement"], "full_outer").select(
        "source", "replacement", (F.coalesce("count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("count"),
        F.array_union(F.coalesce("fields", none), F.coalesce("_f", none)).alias("fields"), F.coalesce(F.when(F.col("_n") > 0, True), "enabled", F.lit(True)).alias("enabled"),
    )


def apply_dictionary(values: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each token of a name replaced by the dictionary's word for it, by an equi join on tokens.

    ``values(record_id, field, value)``; the corrections made are kept in order.
    """
    tokens = values.select("record_id", "field", F.posexplode(F.split(X.norm_ws(F.coalesce("value", F.lit(""))), " ")).alias("i", "token"))
    hit = tokens.join(dictionary.select(F.col("source").alias("token"), "replacement"), "token", "left")
    word = F.struct("i", F.coalesce("replacement", "token").alias("w"), F.when(F.col("replacement").isNotNull(), F.concat("token", F.lit(">"), "replacement")).alias("c"))
    rows = hit.groupBy("record_id", "field").agg(F.array_sort(F.collect_list(word)).alias("t"))
    return rows.select(
        "record_id", "field", F.array_join(F.transform("t", lambda x: x["w"]), " ").alias("value"), F.array_compact(F.transform("t", lambda x: x["c"])).alias("applied"))
