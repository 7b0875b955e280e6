"""The document store: fingerprints, de-duplicated ingest, payload rows, unique keys, saved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from formloom import constants as K
from formloom.functions import text as X
from formloom.operators.ranking import latest
from formloom.operators.records import needs_processing

EMPTY_PAYLOAD = ("ocr_markdown", "ocr_error_message", "completed_at")


def fingerprint(content: Column) -> Column:
    """SHA-1 of a file's bytes."""
    return F.sha1(content)


def ingest_dedup(new: DataFrame, existing: DataFrame) -> DataFrame:
    """What the store holds after files were ingested, with the action taken.

    A fingerprint makes one row: of several new files the first by ``seq``
    counts. A known one takes the new category and time; it is queued again,
    its error cleared, if its category changes or it still needs processing.
    """
    first = new.groupBy("source_fingerprint").agg(F.min_by(F.struct("id", "document_category", "seen_at"), "seq").alias("n"))
    joined = existing.join(first, "source_fingerprint", "full_outer")
    known, hit = F.col("id").isNotNull(), F.col("n").isNotNull()
    category = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(K.DEFAULT_CATEGORY))
    again = hit & ((category(F.col("document_category")) != category(F.col("n.document_category"))) | F.coalesce(needs_processing(), F.lit(False)))
    action = F.when(~known, "insert").when(~hit, "keep").when(again, "requeue").otherwise("refresh")
    rows = joined.withColumn("action", action)
    fresh = F.col("action").isin("insert", "requeue")
    return rows.select(
        F.coalesce("id", "n.id").alias("id"), "source_fingerprint", F.when(hit, F.col("n.document_category")).otherwise(F.col("document_category")).alias("document_category"),
        F.when(fresh, "ocr_queued").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("n.seen_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~fresh, F.col("ocr_error_message")).alias("ocr_error_message"), F.when(F.col("action") != "insert", F.col("ocr_markdown")).alias("ocr_markdown"), "action",
    )


def write_rows(docs: DataFrame, record_type: str) -> DataFrame:
    """Store rows: key, promoted columns and the whole document as JSON; a blank key is refused.

    The key is ``_id``, else ``id``. Refused rows have ``refused`` set and are
    for the caller to keep aside.
    """
    ids = [X.blank_to_null(F.col(c).cast("string")) for c in ("_id", "id") if c in docs.columns]
    key = F.coalesce(*ids, F.lit(""))
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    flag = F.upper(F.left(F.coalesce(X.blank_to_null(X.trimmed(text("save_btn"))), F.lit("N")), F.lit(1)))
    return docs.select(
        F.lit(record_type).alias("record_type"), key.alias("record_key"), *[text(c).alias(c) for c in ("source_fingerprint", "status", "document_category", "created_at", "updated_at")],
        flag.alias("save_btn"), F.to_json(F.struct(*docs.columns)).alias("payload_json"), (key == "").alias("refused"),
    )


def read_rows(rows: DataFrame, record_type: str, schema: TY.StructType | str) -> DataFrame:
    """Documents of one record type whose payload parses to an object; others are skipped."""
    payload = F.trim("payload_json")
    mine = rows.filter((F.col("record_type") == record_type) & payload.startswith("{") & F.get_json_object(payload, "$").isNotNull())
    return mine.select("record_key", F.from_json(payload, schema).alias("doc")).select("record_key", "doc.*")


def unique_violations(rows: DataFrame) -> DataFrame:
    """Record keys, and non-empty fingerprints, that more than one row of a record type holds."""
    parts = []
    for column in ("record_key", "source_fingerprint"):
        held = rows.filter(F.coalesce(F.col(column), F.lit("")) != "") if column != "record_key" else rows
        twice = held.groupBy("record_type", F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")
        parts.append(twice.withColumn("column", F.lit(column)))
    return parts[0].unionByName(parts[1])


def save_pages(pages: DataFrame, saved: DataFrame) -> DataFrame:
    """Pages after saves: the last save of a page replaces it, and its document's processed pages are counted.

    ``pages(doc_id, page_number, markdown)``, ``saved`` has ``seq`` too.
    """
    last = latest(saved, ["doc_id", "page_number"], ["seq"]).select("doc_id", "page_number", F.col("markdown").alias("_new"), F.lit(True).alias("_hit"))
    joined = pages.join(last, ["doc_id", "page_number"], "full_outer")
    return joined.select("doc_id", "page_number", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("markdown")).alias("markdown"), F.coalesce("_hit", F.lit(False)).alias("replaced"))


def processed_pages(pages: DataFrame) -> DataFrame:
    """Pages with text, and all pages, per document."""
    done = F.coalesce(X.trimmed("markdown"), F.lit("")) != ""
    return pages.groupBy("doc_id").agg(F.count_if(done).alias("processed_pages"), F.count("*").alias("total_pages"))
