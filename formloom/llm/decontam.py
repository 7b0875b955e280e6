"""Benchmark decontamination by spaced seeds.

Texts become words (lower case, letters and digits only). Each fixed mask picks
six of up to eight neighbouring words and ignores the rest, so that a hash of
the picked words still meets its counterpart when an ignored word was
substituted; the masks leave out every third, fourth or fifth position, or
none. Items of under ``SHORT_ITEM`` words have two more, of five words: over
all placements of substitutions that leave an overlap by the rule below, items
of 8 to 19 words always have a seed (without those two up to 6 % of some
lengths had none), longer ones in more than 999 of 1000. A hit fixes an alignment of a document with a benchmark item; along it
each maximal-scoring run of words (a match adds 1, a mismatch takes 2; disjoint
runs that no run around them outscores) is an overlap if it matches
``MIN_MATCHED`` words (or ``SHORT_SHARE`` of a shorter item) and at least
``DENSITY`` of its length. Items of fewer than ``LEAST_ITEM`` words overlap
where they stand whole and word for word.

The benchmark is read in chunks of at most ``CHUNK_WORDS`` words (by hash of
item id and text); each chunk's seed index is of bounded size and sent to all
tasks, and further chunks mean further passes, so that no document is shuffled
and the benchmark may grow.

Defined cases: null or empty texts overlap nothing; a benchmark item of one
word overlaps each document with that word; of several overlaps of a document
with an item the one with most matches counts, the first among equals;
repeated rows are reported each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm.common import inner_positions, mix64, slices, text_or_empty, word_hashes

MASKS = ("111111", "1111011", "1110111", "11011011", "11010111")
SHORT_MASKS = ("11111", "1101011")
SHORT_ITEM = 32
MIN_MATCHED = 13
SHORT_SHARE = 0.7
DENSITY = 0.7
LEAST_ITEM = 8
CHUNK_WORDS = 500_000
FILTER_BITS = 22

OVERLAP_SCHEMA = "doc_id long, item_id long, start_word long, end_word long, matched long"


def _bare(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")


def _seed_keys(hashes: np.ndarray, at: np.ndarray, mask: str) -> np.ndarray:
    key = np.zeros(len(at), np.uint64)
    for i, use in enumerate(mask):
        if use == "1":
            key = (key ^ hashes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return key


class SeedIndex:
    """All seeds of one chunk of benchmark items."""

    def __init__(self, item_ids: list, texts: list[str]):
        self.hashes, counts = word_hashes(pa.array(texts, pa.string()), _bare)
        self.item_ids, self.counts = item_ids, counts
        self.starts = np.cumsum(counts) - counts
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.seeds = []
        for mask in (*MASKS, *SHORT_MASKS):
            at, _ = inner_positions(counts, len(mask))
            size = counts[self.owner[at]]
            at = at[(size >= LEAST_ITEM) & ((size < SHORT_ITEM) | (mask in MASKS))]
            key = _seed_keys(self.hashes, at, mask)
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            likely = np.zeros(1 << FILTER_BITS, bool)
            likely[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.seeds.append((mask, key, at, likely))

        self.short = []
        for n in range(1, LEAST_ITEM):
            at = self.starts[counts == n]
            if len(at):
                key = _seed_keys(self.hashes, at, "1" * n)
                order = np.argsort(key, kind="stable")
                self.short.append((n, key[order], at[order]))

    def whole_items(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, words) of the first place of each item of under LEAST_ITEM words in each text."""
        ends = np.cumsum(counts)
        for n, keys, places in self.short:
            at, _ = inner_positions(counts, n)
            key = _seed_keys(hashes, at, "1" * n)
            low = np.searchsorted(keys, key, "left")
            many = np.searchsorted(keys, key, "right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            q = places[np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)]
            at = np.repeat(at, many)
            same = np.ones(len(at), bool)
            for i in range(n):
                same &= hashes[at + i] == self.hashes[q + i]
            at, q = at[same], q[same]
            text = np.searchsorted(ends, at, "right")
            found = np.stack([text, self.owner[q], at - (ends - counts)[text]], axis=1)
            _, first = np.unique(found[:, :2], axis=0, return_index=True)  # places rise within a text
            for t, item, x in found[first].tolist():
                yield t, item, x, n

    def alignments(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distinct (item, document position of the item's first word) pairs that some seed supports."""
        found = []
        for mask, keys, places, likely in self.seeds:
            at, _ = inner_positions(counts, len(mask))
            key = _seed_keys(hashes, at, mask)
            hit = np.flatnonzero(likely[(key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low = np.searchsorted(keys, key[hit], "left")
            many = np.searchsorted(keys, key[hit], "right") - low
            hit, low, many = hit[many > 0], low[many > 0], many[many > 0]
            q = places[np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)]
            item = self.owner[q]
            found.append(np.stack([item, np.repeat(at[hit], many) - (q - self.starts[item])], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def overlaps(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, word past the last, matches), the best of each text and item."""
        ends = np.cumsum(counts)
        begins = ends - counts
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        seen = self.alignments(hashes, counts)
        # the alignment's own seed lies in the text it started in: the last text that begins at or before its end
        for item, first in seen.tolist():
            n = int(self.counts[item])
            mine = self.hashes[self.starts[item] : self.starts[item] + n]
            low = int(np.searchsorted(ends, max(first, 0), "right"))
            while low < len(counts) and begins[low] < first + n:
                a, b = max(first, int(begins[low])), min(first + n, int(ends[low]))
                same = hashes[a:b] == mine[a - first : b - first]
                least = min(MIN_MATCHED, int(np.ceil(SHORT_SHARE * n)))
                for x, y in _best_runs(same) if np.count_nonzero(same) >= least else ():
                    matched = int(same[x:y].sum())
                    if matched >= least and matched >= DENSITY * (y - x):
                        new = (matched, a + x - int(begins[low]), a + y - int(begins[low]))
                        old = best.get((low, item))
                        if old is None or (-new[0], new[1]) < (-old[0], old[1]):
                            best[low, item] = new
                low += 1
        for text, item, x, n in self.whole_items(hashes, counts):
            best[text, item] = (n, x, x + n)
        return [(text, item, x, y, m) for (text, item), (m, x, y) in sorted(best.items())]


def _best_runs(same: np.ndarray) -> list[tuple[int, int]]:
    """All maximal-scoring runs (matches less twice the mismatches), by Ruzzo and Tompa's method."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]))).reshape(-1, 2)
    out: list[tuple[int, int, int, int]] = []  # first word, word past the last, score before and after
    total = last = 0
    for x, y in edges.tolist():
        before = total - 2 * (x - last)
        total, last = before + y - x, y
        while True:
            i = len(out) - 1
            while i >= 0 and out[i][2] >= before:
                i -= 1
            if i < 0 or out[i][3] >= total:
                break
            x, before = out[i][0], out[i][2]
            del out[i:]
        out.append((x, y, before, total))
    return [(x, y) for x, y, _, _ in out]


def benchmark_chunks(benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> Iterator[Broadcast]:
    """The benchmark's seed indexes, each of at most about ``chunk_words`` words, one after the other."""
    sc = benchmark.sparkSession.sparkContext
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    chunks = max(1, -(-total // chunk_words))
    for i in range(chunks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == i).orderBy("item_id", "text").collect()
        if rows:
            yield sc.broadcast(SeedIndex([r[0] for r in rows], [r[1] for r in rows]))


def overlaps(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row for every document and benchmark item that overlap."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = None
    for index in benchmark_chunks(benchmark, chunk_words):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                found = index.value.overlaps(*word_hashes(piece.column("text"), _bare))
                text, item, x, y, m = np.array(found, np.int64).reshape(-1, 5).T
                items = [index.value.item_ids[i] for i in item]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(text)), pa.array(items, pa.int64()), pa.array(x), pa.array(y), pa.array(m)],
                    names=["doc_id", "item_id", "start_word", "end_word", "matched"],
                )

        part = rows.mapInArrow(find, OVERLAP_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], OVERLAP_SCHEMA)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """The documents that overlap no benchmark item, all columns as they came."""
    for index in benchmark_chunks(benchmark, chunk_words):

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for piece in slices(batches):
                found = index.value.overlaps(*word_hashes(piece.column("text"), _bare))
                fine = np.ones(piece.num_rows, bool)
                fine[[f[0] for f in found]] = False
                yield piece.filter(pa.array(fine))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
