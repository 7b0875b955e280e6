"""Token ids in shards, each a wavelet matrix in a compressed Parquet row.

Documents are dealt to ranges of ``doc_id`` and sorted there (ties by text,
null ids first); each task encodes its range and cuts it into shards of about
``SHARD_TOKENS`` ids at document borders. Every document ends with ``END_ID``.
A shard's row holds its document ids, their lengths, the bit planes and their
rank directories; the files are written by Spark to a folder that all
executors share, so that a lost executor costs only its own range.

Reading back never needs the ids before a shard: one running sum over the
ranges (a row each) and one inside each range give every shard's start.

Byte-level encoders split a text before any single space that precedes a
non-space and around a lone line break, so pieces between those points encode
alike wherever they stand; distinct pieces are encoded once and kept under
128-bit hashes in two bounded tables: a piece that is met again moves to the
young one, and when that is full it becomes the old one, so that pieces met
only once go and common ones stay. Texts with other white space, or with the
text of a special token, are encoded whole.

Defined cases: a null or empty text is just the end id; rows that repeat an id
follow each other by text; an empty table gives no rows and no shards.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import mix64, shared_dir, slices, text_or_empty
from formloom.llm.wavelet import WaveletMatrix

END_ID = 0
SHARD_TOKENS = 1 << 20
#: Distinct pieces that a worker's young table takes; the old one has as many. Some 40 bytes each.
YOUNG_PIECES = 1 << 19
SLICE_BYTES = 2 << 20
SHARD_SCHEMA = (
    "part int, seq int, n_tokens long, levels int, doc_ids array<long>, lengths array<long>, "
    "planes binary, zeros array<long>, ranks binary"
)
#: White space that isn't a lone space or a lone line break between two words.
ODD_SPACE = (
    r"[ \n]{2}|[\t\r\f\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    r"|\A[ \n]|[ \n]\z"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text, eight bytes at a time for all of them; the first is never 0."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.zeros(edges[-1] - edges[0] + 8, np.uint8)
    if held is not None:
        data[:-8] = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]]
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    start, size = edges[:-1] - edges[0], np.diff(edges)
    a, b = mix64(size.astype(np.uint64) + np.uint64(0x51ED270B)), mix64(size.astype(np.uint64) + np.uint64(0xB492B66F))
    live = np.flatnonzero(size)
    at = 0
    while len(live):
        word = words[start[live] + at].view(np.uint64)[:, 0]
        left = size[live] - at
        word &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64))
        a[live] = mix64(a[live] ^ word)
        b[live] = mix64((b[live] + word) * np.uint64(0xD6E8FEB86659FD93))
        at += 8
        live = live[left > 8]
    return np.maximum(a, np.uint64(1)), b


class Pieces:
    """A hash table of pieces: where each one's ids start and how many they are. Slots are probed in turn, for all pieces at once."""

    def __init__(self, least: int):
        self.mask = (1 << max(10, (2 * least - 1).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.checks = np.zeros(self.mask + 1, np.uint64)
        self.first = np.zeros(self.mask + 1, np.int64)
        self.length = np.zeros(self.mask + 1, np.int32)
        self.flat = np.zeros(4 * least, np.uint32)
        self.count = self.used = 0

    def has_room(self, more: int) -> bool:
        return 2 * (self.count + more) <= self.mask + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 if it isn't there."""
        out = np.full(len(keys), -1, np.int64)
        live, at = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(live):
            held = self.keys[at]
            same = held == keys[live]
            out[live[same]] = at[same]
            on = ~same & (held != 0)
            live, at = live[on], (at[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Distinct new keys, whose ids follow each other in ``ids``."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), self.used), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(length) - length
        live, at = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(live):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[live[free]]
            won = free & (self.keys[at] == keys[live])  # of several for one slot the last one written
            mine, slot = live[won], at[won]
            self.checks[slot], self.first[slot], self.length[slot] = checks[mine], first[mine], length[mine]
            live, at = live[~won], (at[~won] + 1) & self.mask
        self.used += len(ids)
        self.count += len(keys)

    def ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids one after the other, and how many each has."""
        length = self.length[slots].astype(np.int64)
        return self.flat[np.arange(length.sum()) + np.repeat(self.first[slots] - (np.cumsum(length) - length), length)], length


class Encoder:
    """Ids of whole texts by the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        newline = self._whole(["\n"])[0]
        self.newline = int(newline[0])
        self.piecewise = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None and len(newline) == 1
        )
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.levels = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self._clear()

    def _clear(self, least: int = YOUNG_PIECES) -> None:
        self.young, self.old = Pieces(least), Pieces(1)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], keys: np.ndarray, checks: np.ndarray) -> None:
        """Each piece is encoded behind a line break, which is a token of its own there and marks its start."""
        bare = np.fromiter((p[0] != "\n" for p in pieces), bool, len(pieces))
        units = ["\n " + p if b else p for p, b in zip(pieces, bare, strict=True)]
        ids = np.concatenate(self._whole(["".join(units[i : i + 256]) for i in range(0, len(units), 256)]))
        at = np.flatnonzero(ids == self.newline)
        if len(at) != len(units):
            each = self._whole(units)
            ids = np.concatenate(each)
            at = np.cumsum([0, *map(len, each)])[:-1]
        length = np.diff(np.append(at, len(ids))) - bare
        own = np.ones(len(ids), bool)
        own[at[bare]] = False  # the line break put there isn't the piece's
        self.young.add(keys, checks, ids[own], length)

    def _known(self, names: pa.Array) -> np.ndarray | None:
        """The slots of all pieces in the young table, learned where need be; None if two pieces have one key."""
        keys, checks = piece_hashes(names)
        if not self.young.has_room(len(names)):
            self.old, self.young = self.young, Pieces(max(YOUNG_PIECES, 2 * len(names)))
        new = np.flatnonzero(self.young.find(keys) < 0)
        before = self.old.find(keys[new])
        again, slots = new[before >= 0], before[before >= 0]
        if (self.old.checks[slots] != checks[again]).any():
            return None
        self.young.add(keys[again], checks[again], *self.old.ids(slots))
        new = new[before < 0]
        if len(new):
            if len(np.unique(keys[new])) < len(new):
                return None
            self._learn(names.take(pa.array(new)).to_pylist(), keys[new], checks[new])
        slots = self.young.find(keys)
        return None if (self.young.checks[slots] != checks).any() else slots

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without odd white space, and each text's number of ids."""
        lines = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
        lists = pc.split_pattern(lines, " ")
        words = lists.flatten().dictionary_encode()
        slots = self._known(words.dictionary)
        if slots is None:
            self._clear()
            ids = self._whole(texts.to_pylist())
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        at = words.indices.to_numpy()
        first, length = self.young.first[slots][at], self.young.length[slots][at].astype(np.int64)
        # a text's first piece starts with the line break put there above
        opens = np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))
        opens = np.concatenate([[0], opens[:-1]])
        first[opens] += 1
        length[opens] -= 1
        before = np.cumsum(length) - length
        ids = self.young.flat[np.arange(length.sum()) + np.repeat(first - before, length)]
        return ids, np.add.reduceat(length, opens)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and their numbers with it."""
        texts = pc.fill_null(texts, "")
        full = np.asarray(pc.greater(pc.binary_length(texts), 0))
        odd = np.full(len(texts), not self.piecewise)
        if self.piecewise:
            odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE))
            for s in self.specials:
                odd = odd | np.asarray(pc.match_substring(texts, s))
        counts = np.zeros(len(texts), np.int64)
        plain, whole = np.flatnonzero(full & ~odd), np.flatnonzero(full & odd)
        ids, direct = np.zeros(0, np.uint32), []
        if len(plain):
            ids, counts[plain] = self._pieces(texts.take(pa.array(plain)))
        if len(whole):
            direct = self._whole(texts.take(pa.array(whole)).to_pylist())
            counts[whole] = [len(x) for x in direct]
        total = counts + 1
        start = np.cumsum(total) - total
        out = np.full(total.sum(), END_ID, np.uint32)
        own = counts[plain]
        out[np.arange(own.sum()) + np.repeat(start[plain] - (np.cumsum(own) - own), own)] = ids
        for i, x in zip(whole, direct, strict=True):
            out[start[i] : start[i] + len(x)] = x
        return out, total


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker; its table of pieces outlives a task."""
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, parts: int | None = None) -> None:
    """Encode every whole text into shards below ``path``, in ascending order of doc_id."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids = np.concatenate([x[2] for x in held])
            row = {"part": part, "seq": seq, **WaveletMatrix.build(ids, own.levels).to_fields()}
            row |= {"doc_ids": [d for x in held for d in x[0]], "lengths": np.concatenate([x[1] for x in held]).tolist()}
            seq += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for piece in slices(batches, most=SLICE_BYTES):
            ids, counts = own.encode(piece.column("text"))
            held.append((piece.column("doc_id").to_pylist(), counts, ids))
            if sum(len(x[2]) for x in held) >= shard_tokens:
                yield flush()
        if held:
            yield flush()

    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("levels", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())), ("planes", pa.binary()), ("zeros", pa.list_(pa.int64())), ("ranks", pa.binary()),
    ])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # the text's head is in the range key, so that rows that share an id, or have none, are dealt to several tasks
    dealt = rows.repartitionByRange(parts, F.col("doc_id"), F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    written = dealt.mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd")
    # a row holds megabytes: the writer looks at its size after each one
    for key in ("parquet.block.size.row.check.min", "parquet.block.size.row.check.max", "parquet.page.size.row.check.min"):
        written = written.option(key, "1")
    written.parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _each_shard(shards: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(batch.slice(i, 1).to_pylist()[0])

    return shards.select(*columns).mapInArrow(run, schema)


MATRIX = ["n_tokens", "levels", "planes", "zeros", "ranks"]


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq and the number of ids in all shards before it."""
    sizes = shards.select("part", "seq", "n_tokens")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(parts, "part").select("part", "seq", (F.col("_part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("shard_start"))


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    def digest(row: dict) -> Iterator[pa.RecordBatch]:
        ids = WaveletMatrix.from_fields(row).decode().astype("<u4")
        ends = np.cumsum(row["lengths"])
        starts = ends - row["lengths"]
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
        n = len(crc)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "at": pa.array(starts, pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
        })

    shards = read_shards(spark, path)
    rows = _each_shard(shards, ["part", "seq", "doc_ids", "lengths", *MATRIX], digest, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shards), ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of one id in each shard, by rank alone."""
    def count(row: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "seq": pa.array([row["seq"]], pa.int32()), "n": pa.array([WaveletMatrix.from_fields(row).count(token)], pa.int64())})

    return _each_shard(read_shards(spark, path), ["part", "seq", *MATRIX], count, "part int, seq int, n long")


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id and place in the document (from 0) of every occurrence of one id, by select."""
    def places(row: dict) -> Iterator[pa.RecordBatch]:
        at = WaveletMatrix.from_fields(row).occurrences(token)
        ends = np.cumsum(row["lengths"])
        doc = np.searchsorted(ends, at, side="right")
        ids = pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "place": pa.array(at - (ends - row["lengths"])[doc], pa.int64())})

    return _each_shard(read_shards(spark, path), ["doc_ids", "lengths", *MATRIX], places, "doc_id long, place long")


def new_shard_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
