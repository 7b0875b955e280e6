"""Fill-in-the-middle: prefix, suffix and middle of whole texts, cut at code points found by word arithmetic.

A slice of texts is one run of UTF-8 bytes, viewed as 64-bit words. A byte ends
a code point if the byte after it is no continuation byte (``10xxxxxx``); that
is marked for all eight bytes of a word at once by shifts and masks. The marks
of each word are counted (``bitwise_count``) and summed up; the k-th code point
of any text then lies in the word that a binary search of the sums finds, and
inside the word the byte is the one whose running count of marks first reaches
what is left, which one multiplication and one comparison give for all eight
bytes at once. Nothing is decoded, and no byte is visited by itself.

Form: ``plain`` (the text as it is) for empty texts, texts that hold one of the
marks, and the share of documents that stays; else ``spm`` or ``psm``, drawn
from a digest of the document's id, so that reruns agree.

Defined cases: a null text is the empty text; a null id draws as the empty
string; rows that repeat an id are cut by the same draws; extra columns pass
through, but those named as a result give way; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those that are rearranged, and of a hundred of these, those with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20

HIGH = np.uint64(0x8080808080808080)
ONES = np.uint64(0x0101010101010101)
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class CodePoints:
    """Rank and select of code-point ends over a run of UTF-8 bytes."""

    def __init__(self, data: np.ndarray):
        words = np.zeros(len(data) // 8 + 2, np.uint64)
        words.view(np.uint8)[: len(data)] = data
        held = words & HIGH & ~(words << np.uint64(1))
        starts = held ^ HIGH
        self.ends = starts >> np.uint64(8)
        self.ends[:-1] |= starts[1:] << np.uint64(56)
        self.up_to = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """Code points that end among the bytes before ``at``."""
        word, inside = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        low = self.ends[word] & ((np.uint64(1) << inside) - np.uint64(1))
        return np.where(word > 0, self.up_to[word - 1], 0) + np.bitwise_count(low)

    def after(self, k: np.ndarray) -> np.ndarray:
        """Where the first ``k`` code points end."""
        word = np.searchsorted(self.up_to, k)
        left = (k - np.where(word > 0, self.up_to[word - 1], 0)).astype(np.uint64)
        running = (self.ends[word] >> np.uint64(7)) * ONES
        reached = ((running | HIGH) - left * ONES) & HIGH
        return np.where(k > 0, 8 * word + 9 - np.bitwise_count(reached), 0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The slice's bytes, and where each text starts in them, with the end."""
    edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def rearranged(texts: pa.Array, first: np.ndarray, second: np.ndarray, stays: np.ndarray, suffix_first: np.ndarray) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of texts without nulls; the cuts are ``first`` and ``second`` modulo n + 1."""
    data, edges = _bytes_of(texts)
    points = CodePoints(data)
    rank = points.before(edges)
    n = np.diff(rank)
    a, b = first % (n + 1), second % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    plain = stays | (n == 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | np.asarray(pc.match_substring(texts, mark))
    cuts = np.empty((len(n), 3), np.int64)
    cuts[:, 0], cuts[:, 1], cuts[:, 2] = edges[:-1], points.after(rank[:-1] + low), points.after(rank[:-1] + high)
    pieces = pa.StringArray.from_buffers(3 * len(n), pa.py_buffer(np.append(cuts.ravel(), edges[-1]).astype(np.int32)), pa.py_buffer(data))
    every = np.arange(len(n)) * 3
    prefix, middle, suffix = (pieces.take(pa.array(every + i)) for i in range(3))
    psm = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    spm = _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    plain, spm_mask = pa.array(plain), pa.array(suffix_first)
    none = pa.scalar(None, pa.int64())
    return [
        pa.array(n), pc.if_else(plain, "plain", pc.if_else(spm_mask, "spm", "psm")),
        pc.if_else(plain, none, pa.array(low)), pc.if_else(plain, none, pa.array(high - low)),
        pc.if_else(plain, texts, pc.if_else(spm_mask, spm, psm)),
    ]


def draws(id_col: Column, epoch: int = 1) -> list[Column]:
    """Four 32-bit draws of a document in an epoch."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", epoch: int = 1, share: int = REARRANGED, spm_share: int = SUFFIX_FIRST
) -> DataFrame:
    """All rows with n, form, prefix_chars, middle_chars (null if plain) and output; another epoch cuts anew."""
    names = [c for c in docs.columns if c not in RESULTS]
    h = draws(F.col(id_col), epoch)
    drawn = [
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), h[0].alias("first"), h[1].alias("second"),
        (h[2] % 100 >= share).alias("stays"), (h[3] % 100 < spm_share).alias("suffix_first"),
    ]
    own = [docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)]
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)])
    schema = schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").cast(pa.string())
            made = rearranged(texts, *(part.column(c).to_numpy(zero_copy_only=False) for c in ("first", "second", "stays", "suffix_first")))
            held = [part.column(f"c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*held, *made], names=schema.names)

    return docs.select(*own, *drawn).mapInArrow(run, schema).toDF(*names, *RESULTS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    body = F.substring(output, F.lit(4), F.char_length(output))
    piece = lambda text, mark, side: F.substring_index(text, mark, side)
    psm = F.concat(piece(body, SUFFIX, 1), piece(body, MIDDLE, -1), piece(piece(body, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(piece(piece(body, PREFIX, -1), MIDDLE, 1), piece(body, MIDDLE, -1), piece(body, PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
