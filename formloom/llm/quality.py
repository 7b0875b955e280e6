"""Quality classifier from weak labels.

Eight heuristics each vote bad, good or abstain on every whole text. They
overlap and err, so expectation-maximisation estimates, without any true
label, the share of good documents and how often each heuristic votes what on
either kind. All documents count: they are summed into vote patterns, of which
there are at most 3 ** 8 whatever the corpus, and EM runs on that table. The
posterior of its pattern labels a document; a sample of about ``TRAIN_DOCS``
documents (picked by hash, the one thing here that is bounded) with these soft
labels trains a linear scorer over ``FEATURES`` hashed features: words, word
shapes, lengths and endings as shares of the text, and a few binned counts.
The scorer decides: a document is rejected if its chance of being good is
under one half.

Defined cases: null is the empty text; a text without words is rejected, has
posterior and score 0 and abstains everywhere; equal texts get equal results;
an empty table gives no rows; other columns pass through ``kept`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import give_back, slices, text_or_empty

TRAIN_DOCS = 6000
FEATURES = 2048
ROUNDS = 800
BAD, GOOD, NONE = 0, 1, 2
#: Each heuristic: statistic, bad below, good from, good up to, bad above (None: open); it abstains in between.
HEURISTICS = (
    ("symbols", None, 0.0, 0.05, 0.15),
    ("capitals", None, 0.0, 0.15, 0.30),
    ("stutter", None, 0.0, 0.04, 0.08),
    ("variety", 0.45, 0.60, 1.0, None),
    ("new_lines", 0.70, 0.90, 1.0, None),
    ("word_length", 4.5, 5.0, 7.0, 7.3),
    ("endings", 0.02, 0.04, 0.30, 0.40),
    ("no_letters", None, 0.0, 0.02, 0.10),
)


def _hash(names: list[str], kind: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x, kind) % FEATURES for x in names), np.int64, len(names))


def _hashed(words: pa.Array) -> np.ndarray:
    """Hashed features (a column each) of distinct words."""
    shape = words
    for a, b in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shape = pc.replace_substring_regex(shape, a, b)
    shape = shape.dictionary_encode()
    length = np.asarray(pc.utf8_length(words), np.int64)
    last = pc.utf8_slice_codeunits(words, -1, None).dictionary_encode()
    of = lambda d, kind: _hash(d.dictionary.to_pylist(), kind)[d.indices.to_numpy(zero_copy_only=False)]
    return np.stack([
        _hash(pc.utf8_lower(words).to_pylist(), 1), of(shape, 2), _hash([str(i) for i in range(21)], 3)[np.minimum(length, 20)], of(last, 4)
    ], axis=1)


def _per_word(words: pa.Array) -> dict[str, np.ndarray]:
    """Counts and flags of distinct words."""
    length = np.asarray(pc.utf8_length(words), np.int64)
    odd = np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"[\p{L}\p{N}.,;:'\"()\-@+=/]", "")), np.int64)
    letters = np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"\P{L}", "")), np.int64)
    big = np.asarray(pc.utf8_length(pc.replace_substring_regex(words, r"\P{Lu}", "")), np.int64)
    stops = np.asarray(pc.match_substring_regex(words, r"[.!?]$"))
    return {"length": length, "odd": odd, "letters": letters, "big": big, "stops": stops, "bare": (letters == 0).astype(np.int64)}


class Described:
    """Statistics, votes and sparse features of a slice of texts."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        texts = pc.fill_null(texts, "")
        lists = pc.utf8_split_whitespace(texts)
        flat = lists.flatten()
        full = np.asarray(pc.greater(pc.binary_length(flat), 0), bool)
        owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists), np.int64))[full]
        words = flat.filter(pa.array(full)).dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.bincount(owner, minlength=len(texts))
        self.n = n
        columns, word = _hashed(words.dictionary) if hashed else None, _per_word(words.dictionary)
        total = lambda v: np.bincount(owner, weights=v[at], minlength=len(texts))
        share = lambda a, b: np.divide(a, b, out=np.zeros(len(texts)), where=b > 0)
        same = np.zeros(len(at), bool)
        same[1:] = (at[1:] == at[:-1]) & (owner[1:] == owner[:-1])
        distinct = np.unique(owner * max(1, len(words.dictionary)) + at) // max(1, len(words.dictionary))
        lines = pc.split_pattern(texts, "\n")
        coded = lines.flatten().dictionary_encode()
        n_lines = np.asarray(pc.list_value_length(lines), np.int64)
        of_line = np.repeat(np.arange(len(texts)), n_lines) * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False)
        new_lines = np.bincount(np.unique(of_line) // max(1, len(coded.dictionary)), minlength=len(texts))
        self.stats = {
            "symbols": share(total(word["odd"]), n), "capitals": share(total(word["big"]), total(word["letters"])),
            "stutter": share(np.bincount(owner, weights=same, minlength=len(texts)), n), "variety": share(np.bincount(distinct, minlength=len(texts)), n),
            "new_lines": share(new_lines, n_lines), "word_length": share(total(word["length"]), n) + 1,
            "endings": share(total(word["stops"]), n), "no_letters": share(total(word["bare"]), n),
        }
        # long texts repeat words by chance: variety is judged against what 200 words show
        self.stats["variety"] = np.minimum(1.0, self.stats["variety"] * np.maximum(1.0, n / 200) ** 0.15)
        silent = {"new_lines": n_lines < 3, "endings": n < 30} | dict.fromkeys(("symbols", "stutter", "variety", "word_length", "no_letters"), n < 20)
        votes = []
        for name, bad_below, good_from, good_to, bad_above in HEURISTICS:
            x = self.stats[name]
            v = np.where((x >= good_from) & (x <= good_to), GOOD, NONE)
            if bad_below is not None:
                v = np.where(x < bad_below, BAD, v)
            if bad_above is not None:
                v = np.where(x > bad_above, BAD, v)
            votes.append(np.where(silent.get(name, np.zeros(len(n), bool)) | (n == 0), NONE, v))
        self.votes = np.array(votes).T
        self._owner, self._columns, self._at = owner, columns, at
        bins = []
        for name in ("stutter", "variety", "new_lines", "capitals", "symbols", "endings"):
            level = np.minimum(9, (self.stats[name] * 10)).astype(int)
            bins.append(_hash([f"{name} {i}" for i in range(10)], 5)[level])
        self._bins = np.array(bins).T

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Weights by feature, then the constant; the sum for each text."""
        each = weights[self._columns].sum(axis=1)[self._at]
        word = np.bincount(self._owner, weights=each, minlength=len(self.n))
        return np.divide(word, self.n, out=np.zeros(len(self.n)), where=self.n > 0) + weights[self._bins].sum(axis=1) + weights[FEATURES]

    def features(self, i: int) -> np.ndarray:
        """All hashed features of text i."""
        end = int(self.n[: i + 1].sum())
        mine = self._columns[self._at[end - int(self.n[i]) : end]]
        x = np.bincount(mine.ravel(), minlength=FEATURES) / max(1, self.n[i])
        np.add.at(x, self._bins[i], 1.0)
        return x


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, float, np.ndarray]:
    """EM: posterior of good per pattern, share of good, and P(vote | kind) by heuristic, kind, vote.

    It starts from distrust: whatever any heuristic votes bad. What kinds of bad
    texts have in common is little, most heuristics find nothing wrong with most
    of them, and a start from the majority would settle on that.
    """
    post = np.where((votes == BAD).any(axis=1), 0.1, 0.9)
    share, table = 0.5, np.zeros((votes.shape[1], 2, 2))
    for _ in range(rounds):
        share = float((post * counts).sum() / max(counts.sum(), 1))
        share = min(max(share, 1e-3), 1 - 1e-3)
        for h in range(votes.shape[1]):
            for kind, w in ((BAD, counts * (1 - post)), (GOOD, counts * post)):
                said = np.array([w[votes[:, h] == v].sum() for v in (BAD, GOOD)]) + 1.0
                table[h, kind] = said / said.sum()
        log = np.full(len(votes), np.log(share) - np.log(1 - share))
        for h in range(votes.shape[1]):
            ratio = np.append(np.log(table[h, GOOD]) - np.log(table[h, BAD]), 0.0)
            log += ratio[votes[:, h]]
        new = 1 / (1 + np.exp(-np.clip(log, -500, 500)))
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-9:
            break
    return post, share, table


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient steps.

    The last column of ``x`` is the constant. ``x`` is scaled in place: the
    driver holds the sample once.
    """
    square = np.einsum("ij,ij->j", x, x) / len(x)
    scale = np.maximum(np.sqrt(square), 1e-3)
    x /= scale
    w = ahead = np.zeros(x.shape[1], np.float32)
    rate = 4.0 / max(float((square / scale**2).sum()), 1e-6)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        step = ahead - rate * ((p - y) @ x / len(y) + ridge * ahead)
        ahead = step + t / (t + 3) * (step - w)
        w = step
    return (w / scale).astype(np.float64)


def _pattern(votes: np.ndarray) -> list[str]:
    return ["".join(map(str, v)) for v in votes]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[dict[str, float], np.ndarray]:
    """Posterior by vote pattern, and the scorer's weights."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            made = Described(piece.column("text"), hashed=False)
            names, n = np.unique(np.array(_pattern(made.votes))[made.n > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(n, pa.int64())], names=["votes", "n"])

    patterns = rows.mapInArrow(vote, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()
    if not patterns:
        return {}, np.zeros(FEATURES + 1)
    votes = np.array([list(map(int, r[0])) for r in patterns])
    counts = np.array([r[1] for r in patterns], float)
    post, _, _ = estimate(votes, counts)
    posterior = {r[0]: float(p) for r, p in zip(patterns, post, strict=True)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            made = Described(piece.column("text"))
            x = [made.features(i) for i in range(len(made.n))]
            used = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_pydict({
                "doc_id": piece.column("doc_id"), "votes": pa.array(_pattern(made.votes), pa.string()),
                "at": pa.array([u.astype("<u2").tobytes() for u in used], pa.binary()),
                "x": pa.array([v[u].astype("<f4").tobytes() for v, u in zip(x, used, strict=True)], pa.binary()),
            })

    chance = min(1.0, train_docs / counts.sum())
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) < int(chance * (1 << 30))
    sample = rows.filter(draw & (F.col("text") != "")).mapInArrow(featured, "doc_id long, votes string, at binary, x binary")
    rows = sorted(sample.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.votes, bytes(r["at"]), bytes(r.x)))
    rows = [r for r in rows if r.votes in posterior]
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r.x, "<f4")
    x[:, FEATURES] = 1
    y = np.array([posterior[r.votes] for r in rows], np.float32)
    del rows
    weights = train(x, y) if len(x) else np.zeros(FEATURES + 1)
    del x
    give_back()
    return posterior, weights


def judged(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, n_words, votes, posterior, score (chance of being good) and keep of every document."""
    posterior, weights = fit(docs, train_docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            made = Described(piece.column("text"))
            score = _chance(made, weights)
            votes = _pattern(made.votes)
            post = [posterior.get(v, 0.0) if n else 0.0 for v, n in zip(votes, made.n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(made.n, pa.int64()), pa.array(votes), pa.array(post, pa.float64()), pa.array(score), pa.array(score >= 0.5)],
                names=["doc_id", "n_words", "votes", "posterior", "score", "keep"],
            )

    return rows.mapInArrow(judge, "doc_id long, n_words long, votes string, posterior double, score double, keep boolean")


def _chance(made: Described, weights: np.ndarray) -> np.ndarray:
    return np.where(made.n > 0, 1 / (1 + np.exp(-np.clip(made.scores(weights), -50, 50))), 0.0)


def kept(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The documents that the classifier doesn't reject, all columns as they came."""
    _, weights = fit(docs, train_docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield piece.filter(pa.array(_chance(Described(piece.column("text")), weights) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
