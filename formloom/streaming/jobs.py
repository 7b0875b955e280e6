"""Continuous forms of the jobs: inbox, de-duplication, live counts, state machine, learned corrections.

Every job takes a streaming DataFrame, so any source will do; the checkpoint of
the query that runs it takes the place of the reference's in-memory queue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formloom.functions import text as X
from formloom.operators.corrections import learn_corrections
from formloom.operators.store import fingerprint, ingest_dedup
from formloom.sources.files import INBOX_GLOB

# fixed values: allowed moves of a record's review status
MOVES = {("unassigned", "assigned"), ("assigned", "in_review"), ("in_review", "in_review"), ("assigned", "completed"), ("in_review", "completed")}


def inbox(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """ST1: page texts as they arrive below ``path``, a bounded number of files at a time; files seen once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def inbox_files(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    """ST1: path, size, modified and fingerprint of documents as they arrive in a folder; its first batches are the start-up scan."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.schema(shape).format("binaryFile").option("pathGlobFilter", INBOX_GLOB).option("maxFilesPerTrigger", files_a_batch).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), fingerprint("content").alias("fingerprint"))


def queue_again(stored: DataFrame, *order: str) -> DataFrame:
    """ST1: what a start-up queues anew: interrupted and waiting documents, in ``order`` (oldest first by created_at, id)."""
    waiting = stored.filter(F.col("status").isin("uploaded", "ocr_queued", "cleaning", "ocr_running"))
    return waiting.withColumn("status", F.lit("ocr_queued")).orderBy(*order) if order else waiting.withColumn("status", F.lit("ocr_queued"))


def first_of_each_text(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST2 inside a stream: the first event of a fingerprint within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["source_fingerprint"])


#: Parts of the store by fingerprint; a batch writes those that it touches.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("source_fingerprint"), F.lit(BUCKETS)).cast("int")


def read_store(spark: SparkSession, store_path: str, before: int | None = None) -> DataFrame:
    """The stored documents: each part in its last version (of those before a batch's number)."""
    rows = spark.read.parquet(store_path)
    rows = rows if before is None else rows.filter(F.col("version") < before)
    # a row for each of BUCKETS parts at most
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), ["bucket", "version"]).drop("version")


def ingest_batches(store_path: str) -> Callable[[DataFrame, int], None]:
    """ST2 across runs: a ``foreachBatch`` function that merges each batch into the stored documents.

    A batch reads and writes only the parts of the store that its fingerprints
    fall into, each as a new version under the batch's number, so that a batch
    that runs again after a failure starts from the versions before it. A known
    document keeps the version of the pipeline that read it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        none = F.lit(None).cast("string")
        new = batch.withColumn("bucket", _bucket())
        if not number:
            first = new.groupBy("source_fingerprint").agg(F.min_by(F.struct("id", "document_category", "seen_at"), "seq").alias("n"))
            done = first.select("n.id", "source_fingerprint", "n.document_category", F.lit("ocr_queued").alias("status"), F.col("n.seen_at").alias("updated_at"),
                                none.alias("ocr_error_message"), none.alias("ocr_markdown"), none.alias("ocr_pipeline_version"))
        else:
            touched = new.select("bucket").distinct()
            old = read_store(spark, store_path, number).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket")
            merged = ingest_dedup(batch, old).drop("action")
            done = merged.join(old.select("source_fingerprint", "ocr_pipeline_version"), "source_fingerprint", "left").select(*old.columns)
        parts = done.withColumn("bucket", _bucket()).withColumn("version", F.lit(number))
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(store_path)

    return merge


def status_changes(stream: DataFrame) -> DataFrame:
    """ST3: batch_id, status, change: what every event adds to and takes from the counts of records by their latest status.

    ``stream(record_id, batch_id, status, seq)``. A record counts once, under
    the status of its last event; an event that comes after a later one of its
    record changes nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get if state.exists else None
        last = pd.concat(list(batches)).sort_values("seq", ignore_index=True).iloc[-1]
        now = (last["batch_id"], last["status"], int(last["seq"]))
        if was is not None and now[2] <= was[2]:
            return
        state.update(now)
        moved = [(now[0], now[1], 1)] if was is None else [] if was[:2] == now[:2] else [(was[0], was[1], -1), (now[0], now[1], 1)]
        yield pd.DataFrame(moved, columns=["batch_id", "status", "change"])

    rows = stream.select("record_id", "batch_id", "status", "seq")
    return rows.groupBy("record_id").applyInPandasWithState(step, "batch_id string, status string, change long", "batch_id string, status string, seq long", "append", GroupStateTimeout.NoTimeout)


def keep_counts(path: str) -> Callable[[DataFrame, int], None]:
    """ST3: a ``foreachBatch`` function that adds changes to the counts, a row for each batch and status.

    Each micro-batch writes the next version beside the old one, so that one
    that runs again starts from the version before it.
    """

    def add(changes: DataFrame, number: int) -> None:
        new = changes.select("batch_id", "status", F.col("change").alias("n"))
        both = new.unionByName(changes.sparkSession.read.parquet(f"{path}/v{number - 1}")) if number else new
        both.groupBy("batch_id", "status").agg(F.sum("n").alias("n")).filter("n <> 0").write.mode("overwrite").parquet(f"{path}/v{number}")

    return add


def review_states(stream: DataFrame) -> DataFrame:
    """ST4: each event with its record's status after it, and whether the move was allowed.

    ``stream(record_id, seq, status)``: a record starts unassigned; a move that
    is not in ``MOVES`` is refused and leaves the status as it is.
    """
    schema = "record_id string, seq long, asked string, status string, accepted boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "unassigned"
        events = pd.concat(list(batches)).sort_values("seq", ignore_index=True)
        after, fine = [], []
        for asked in events["status"]:
            fine.append((now, asked) in MOVES)
            now = asked if fine[-1] else now
            after.append(now)
        state.update((now,))
        yield pd.DataFrame({"record_id": key[0], "seq": events["seq"], "asked": events["status"], "status": after, "accepted": fine})

    return stream.select("record_id", "seq", "status").groupBy("record_id").applyInPandasWithState(step, schema, "status string", "append", GroupStateTimeout.NoTimeout)


def learned_counts(stream: DataFrame) -> DataFrame:
    """ST5: how often each correction was made so far."""
    pairs = stream.select(F.explode(X.token_pairs("before", "after")).alias("p"))
    return pairs.groupBy("p.source", "p.replacement").agg(F.count("*").alias("count"))


def learned_batches(path: str) -> Callable[[DataFrame, int], None]:
    """ST5 with examples: a ``foreachBatch`` function that writes each batch's learned pairs."""
    return lambda batch, number: learn_corrections(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")


def learned_so_far(spark: SparkSession, path: str, examples: int = 5) -> DataFrame:
    """ST5: source, replacement, count, fields, examples over all batches written; the last batches' examples come first."""
    rows = spark.read.parquet(path)
    newest = F.reverse(F.array_sort(F.collect_list(F.struct("batch", "examples"))))
    return rows.groupBy("source", "replacement").agg(
        F.sum("count").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("fields"),
        F.slice(F.flatten(F.transform(newest, lambda b: b["examples"])), 1, examples).alias("examples"),
    )
