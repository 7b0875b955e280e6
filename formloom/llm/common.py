"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one Arrow slice hands to NumPy at a time.
SLICE_BYTES = 4 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    A session without ``spark.checkpoint.dir`` gets a temporary folder, but
    only where driver and executors are one process (tests).
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a table in the shared folder; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows; else left for Spark's shuffled joins."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and its neighbours need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        if not len(sizes):
            continue
        piece = np.cumsum(sizes) // most
        edges = np.flatnonzero(np.diff(piece)) + 1
        for a, b in zip([0, *edges], [*edges, len(sizes)], strict=True):
            yield batch.slice(a, b - a)
    give_back()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array, clean: Callable[[pa.Array], pa.Array] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all white-space separated words, and each text's word count.

    ``clean`` may map the words; words that end up empty are dropped.
    """
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    names = words.dictionary if clean is None else clean(words.dictionary)
    names = names.to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    full = np.fromiter(map(bool, names), bool, len(names))
    at = words.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    keep = full[at]
    return table[at[keep]], np.bincount(owner[keep], minlength=len(lists)).astype(np.int64)


def inner_positions(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of all windows of ``width`` that stay inside one text, and their number per text."""
    starts = np.cumsum(counts) - counts
    each = np.maximum(counts - width + 1, 0)
    first = np.cumsum(each) - each
    return np.arange(each.sum()) + np.repeat(starts - first, each), each
