"""Sources that are folders of files: the inbox, batch manifests, the location reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.operators.store import fingerprint

#: Kinds of files that the inbox takes.
INBOX_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg")
INBOX_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in INBOX_SUFFIXES) + "}"

FILE = "file_id string, original_filename string, page_count int, status string, error_message string"
RECORD = (
    "record_id string, record_no string, batch_id string, file_id string, original_filename string, selected_document_type string, page_number int, "
    "ocr_status string, review_status string, ocr_quality string, has_watermark boolean, ocr_text string, ocr_result string, ocr_error string, "
    "assigned_to_user_id string, assigned_to_username string, assigned_at string, save_btn string"
)
MANIFEST = (
    "batch_id string, selected_document_type string, status string, created_by string, created_at string, file_count int, total_pages int, record_count int, "
    f"files array<struct<{FILE.replace(' ', ':').replace(',:', ', ')}>>, records array<struct<{RECORD.replace(' ', ':').replace(',:', ', ')}>>"
)
BROKEN = "_broken"


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def scan_inbox(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Path, name, size, modified, fingerprint of the folder's documents, by name.

    Only files of a known suffix, in either case, are opened; each one's bytes
    are digested in the task that reads it and don't travel. Spark skips files of
    no bytes, so those aren't listed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", INBOX_GLOB).option("recursiveFileLookup", str(recursive).lower()).load(path)
    found = files.select("path", _file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), fingerprint("content").alias("fingerprint"))
    return found.orderBy("name", "path")


def _json_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path and text of whole files, a byte order mark taken off."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.select("path", F.regexp_replace(text, "^﻿", "").alias("text"))


def read_manifests(spark: SparkSession, path: str, glob: str = "metadata.json") -> DataFrame:
    """Path, batch (struct) and reason of every manifest below the folder; ``reason`` says why one can't be read.

    Manifests are whole files of any layout. One that isn't UTF-8, isn't an
    object, or doesn't parse into the schema has a reason and no batch; it is
    kept, for the quarantine.
    """
    shape = T.StructType.fromDDL(MANIFEST).add(BROKEN, "string")
    files = _json_files(spark, path, glob)
    parsed = files.withColumn("batch", F.from_json("text", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}))
    kind = F.regexp_extract("text", r"^\s*(\S)", 1)
    # a string, list or number is JSON too, but no manifest
    reason = (
        F.when(F.col("text").isNull(), "not UTF-8").when(kind == "", "empty").when(kind != "{", "not an object")
        .when(F.col("batch").isNull() | F.col(f"batch.{BROKEN}").isNotNull(), "not readable")
    )
    return parsed.select("path", F.when(reason.isNull(), F.col("batch").dropFields(BROKEN)).alias("batch"), reason.alias("reason"), "text")


def batches(manifests: DataFrame) -> DataFrame:
    """Readable manifests without their lists, newest first."""
    good = manifests.filter("reason is null").select("path", "batch.*").drop("files", "records")
    return good.orderBy(F.col("created_at").desc_nulls_last(), "batch_id", "path")


def batch_files(manifests: DataFrame) -> DataFrame:
    return manifests.filter("reason is null").select(F.col("batch.batch_id").alias("batch_id"), F.posexplode("batch.files").alias("file_seq", "f")).select("batch_id", "file_seq", "f.*")


def batch_records(manifests: DataFrame) -> DataFrame:
    """Records of all manifests; a record without a batch has its manifest's."""
    rows = manifests.filter("reason is null").select(F.col("batch.batch_id").alias("_batch"), F.posexplode("batch.records").alias("record_seq", "r"))
    return rows.select("record_seq", "r.*", "_batch").withColumn("batch_id", F.coalesce("batch_id", "_batch")).drop("_batch")


def quarantine(manifests: DataFrame) -> DataFrame:
    """path, reason and text of the manifests that can't be read."""
    return manifests.filter("reason is not null").select("path", "reason", "text")


def _reference(spark: SparkSession, path: str, name: str, codes: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """Rows of a file that holds one JSON list; none if it is missing or is something else. Codes that are no numbers are 0."""
    row = "array<struct<" + ",".join(f"{c}:string" for c in [*codes, *texts]) + ">>"
    files = _json_files(spark, path, name).filter(F.col("text").rlike(r"^\s*\["))
    rows = files.select(F.posexplode(F.from_json("text", row)).alias("seq", "r"))
    number = lambda c: F.coalesce(F.trim(F.col(f"r.{c}")).try_cast("int"), F.lit(0))
    return rows.select("seq", *[number(c).alias(a) for c, a in codes.items()], *[F.col(f"r.{c}").alias(a) for c, a in texts.items()])


def read_location_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Provinces, districts and subdistricts of the reference folder, as ``location.location_dim`` takes them."""
    provinces = _reference(spark, path, "provinces.json", {"provinceCode": "province_code"}, {"provinceNameTh": "province"})
    districts = _reference(spark, path, "districts.json", {"districtCode": "district_code", "provinceCode": "province_code"}, {"districtNameTh": "district"})
    subdistricts = _reference(
        spark, path, "subdistricts.json", {"provinceCode": "province_code", "districtCode": "district_code"},
        {"subdistrictNameTh": "subdistrict", "postalCode": "postal_code"})
    return provinces.drop("seq"), districts.drop("seq"), subdistricts
