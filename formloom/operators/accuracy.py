"""Accuracy against truth data and quality counts over batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import text as X
from formloom.operators.quality import eval_norm
from formloom.operators.ranking import latest


def read_truth(entries: DataFrame) -> DataFrame:
    """Truth entries (entry_id, record_id, original_filename, page_number, expected map) with a map; others are ignored."""
    return entries.filter(F.col("expected").isNotNull())


def match_truth(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Each entry with ``found_id``: by record id, else by file name and page; NULL if there is none.

    Of records with equal keys the last (by ``seq``) counts. Blank keys never meet.
    """
    filled = lambda c: F.coalesce(X.trimmed(c), F.lit("")) != ""
    by_id = latest(records.filter(filled("record_id")).select("record_id", "seq"), ["record_id"], ["seq"])
    paged = records.filter(filled("original_filename") & F.col("page_number").isNotNull())
    by_page = latest(paged.select("record_id", "original_filename", "page_number", "seq"), ["original_filename", "page_number"], ["seq"])
    hit_id = entries.filter(filled("record_id")).select("entry_id", "record_id").join(by_id, "record_id").select("entry_id", F.col("record_id").alias("_id"))
    keys = entries.filter(filled("original_filename") & F.col("page_number").isNotNull()).select("entry_id", "original_filename", "page_number")
    hit_page = keys.join(by_page, ["original_filename", "page_number"]).select("entry_id", F.col("record_id").alias("_page_id"))
    joined = entries.join(hit_id, "entry_id", "left").join(hit_page, "entry_id", "left")
    return joined.withColumn("found_id", F.coalesce("_id", "_page_id")).drop("_id", "_page_id")


def compare_fields(matched: DataFrame, values: DataFrame) -> DataFrame:
    """Entry, field, expected, actual and whether they agree once normalised; a missing value counts as blank."""
    long = matched.filter("found_id is not null").select("entry_id", F.col("found_id").alias("record_id"), F.explode("expected").alias("field", "expected"))
    joined = long.join(values.select("record_id", "field", F.col("value").alias("actual")), ["record_id", "field"], "left")
    return joined.withColumn("ok", eval_norm("field", "expected") == eval_norm("field", "actual"))


def _accuracy() -> list[Column]:
    ok = F.count_if("ok")
    return [ok.alias("correct"), F.count("*").alias("total"), F.bround(ok / F.count("*"), 4).alias("accuracy")]


def field_accuracy(compared: DataFrame) -> DataFrame:
    """Correct, total and their ratio per field."""
    return compared.groupBy("field").agg(*_accuracy())


def critical_accuracy(compared: DataFrame, fields: Sequence[str] = K.CRITICAL_FIELDS) -> DataFrame:
    """The same over the entries whose truth has every critical field; all must agree."""
    critical = F.col("field").isin(*fields)
    whole = compared.groupBy("entry_id").agg(F.count_if(critical).alias("n"), F.bool_and(F.col("ok") | ~critical).alias("ok"))
    return whole.filter(F.col("n") == len(fields)).agg(*_accuracy())


def quality_summary(records: DataFrame, values: DataFrame, issues: DataFrame, fields: Sequence[str] = K.SUMMARY_FIELDS) -> DataFrame:
    """Counts per batch of reading status, quality, missing values per field and issues per kind.

    ``values`` and ``issues`` carry the batch. A field without a row is missing,
    so missing values are the records less those that have one.
    """
    status = records.groupBy("batch_id", F.coalesce("ocr_status", F.lit("")).alias("key")).count().withColumn("kind", F.lit("ocr_status"))
    quality = records.groupBy("batch_id", F.coalesce("ocr_quality", F.lit("")).alias("key")).count().withColumn("kind", F.lit("ocr_quality"))
    sizes = records.groupBy("batch_id").agg(F.count("*").alias("n"))
    held = values.filter(F.col("field").isin(*fields) & (F.coalesce(X.trimmed("value"), F.lit("")) != "")).groupBy("batch_id", F.col("field").alias("key")).agg(
        F.count("*").alias("have"))
    every = sizes.withColumn("key", F.explode(F.array(*map(F.lit, fields))))
    missing = every.join(held, ["batch_id", "key"], "left").select(
        "batch_id", "key", (F.col("n") - F.coalesce("have", F.lit(0))).alias("count"), F.lit("missing").alias("kind")).filter("count > 0")
    kinds = issues.groupBy("batch_id", F.col("issue").alias("key")).count().withColumn("kind", F.lit("issue"))
    parts = [p.select("batch_id", "kind", "key", F.col("count").alias("n")) for p in (status, quality, missing, kinds)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
