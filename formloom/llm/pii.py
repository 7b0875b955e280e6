"""Personal data by a skip-chain conditional random field.

Base patterns find e-mail addresses, IPv4 addresses, card numbers and phone
numbers. The random field labels words: a word that holds a digit, an ``@`` or
a ``+`` is a variable (O or one of the four kinds); every other word is fixed
at O. A variable has hashed features of its own shape and of its neighbours;
variables whose words stand side by side share a chain potential; those whose
letters and digits are the same, however far apart, share a skip potential: two
of them directly, more of them with a hidden variable of their own (their common
label), so that evidence at one reaches all in two steps. Sum-product messages
run over all edges of a slice of documents at once until a document's messages
change by less than ``STILL``; documents are separate components and don't mix.
Messages that still swing when evidence could have crossed the whole document
are damped more and more.

The field is trained piece by piece on base labels of about ``TRAIN_DOCS``
documents picked by hash: the features by logistic regression on at most
``TRAIN_WORDS`` words, the potentials from the pair counts. A variable outside
the base spans whose chance of being one kind is ``SURE`` or more is added.

Defined cases: null and empty texts have no spans; repeated rows are labelled
each; an empty table gives no rows. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import cut, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried from its start only; where that fails, the rest of the run fails too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
NOT_DIGIT = re.compile(r"[^0-9]+")

TRAIN_DOCS = 100_000
TRAIN_WORDS = 20_000
FEATURES = 512
STILL = 1e-5
SURE = 0.97


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part reaches back as far as it may."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def shape(word: str) -> str:
    """Letters to a or A, digits to 0, runs of four and more to four."""
    s = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word)
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", re.sub(r"[0-9]", "0", s))


def _features(words: list[str], i: int) -> list[int]:
    w, s = words[i], shape(words[i])
    before, after = (shape(words[i - 1]) if i else "^"), (shape(words[i + 1]) if i + 1 < len(words) else "$")
    n = len(NOT_DIGIT.sub("", w))
    names = (
        f"s {s}", f"b {before}", f"a {after}", f"d {min(n, 20)}", f"at {'@' in w}", f"plus {w[:1] == '+'}", f"dots {min(w.count('.'), 4)}",
        f"hex {bool(re.fullmatch('[0-9a-f]{8,}', w))}", f"key {'=' in w or '=' in ''.join(words[max(0, i - 1) : i])}", f"len {min(len(w), 24)}",
    )
    return sorted({xxhash.xxh3_64_intdigest(x) % FEATURES for x in names})


@dataclass
class Graph:
    """Variables of some texts: their text, span, features; chain and skip edges between them.

    ``shared`` links variables to the hidden variable of their key; ``twins``
    are all next occurrences of a key without a chain edge (training pairs).
    """

    owner: list[int]
    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    shared: list[tuple[int, int]] = field(default_factory=list)
    twins: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, texts: list[str]) -> Graph:
        g = cls([], [], [], [], [])
        known = hubs = 0
        for t, text in enumerate(texts):
            if not DIGIT.search(text) and "@" not in text and "+" not in text:
                continue
            found = list(WORD.finditer(text))
            words = [m[0] for m in found]
            last = -2
            seen: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                if not (DIGIT.search(w) or "@" in w or "+" in w):
                    continue
                me = len(g.owner)
                g.owner.append(t)
                g.spans.append((found[i].start(), found[i].end()))
                g.features.append(_features(words, i))
                if last == i - 1:
                    g.chain.append((me - 1, me))
                key = re.sub(r"[\W_]+", "", w).lower()
                if key:
                    before = seen.setdefault(key, [])
                    if before and not (last == i - 1 and before[-1] == me - 1):
                        g.twins.append((before[-1], me))
                    before.append(me)
                last = i
            apart = {b for _, b in g.twins[known:]}
            known = len(g.twins)
            for places in seen.values():
                if apart.isdisjoint(places):
                    continue  # alone, or all side by side
                if len(places) == 2:
                    g.skip.append((places[0], places[1]))
                else:
                    g.shared.extend((v, hubs) for v in places)
                    hubs += 1
        return g


def _labels(g: Graph, base: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Each variable's label by the base spans of its text: the kind of the first span that it touches, 0 for O."""
    out, at = np.zeros(len(g.owner), np.int64), {}
    for v, (t, (a, b)) in enumerate(zip(g.owner, g.spans, strict=True)):
        i = at.get(t, 0)
        spans = base[t]
        while i < len(spans) and spans[i][1] <= a:
            i += 1
        at[t] = i
        if i < len(spans) and spans[i][0] < b:
            out[v] = KINDS.index(spans[i][2]) + 1
    return out


@dataclass
class Field:
    """Weights of the features (FEATURES + constant, by label), log potentials of the two kinds of edges, log shares of common labels."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    common: np.ndarray | None = None

    def marginals(self, g: Graph, rounds: int | None = None) -> np.ndarray:
        """Chance of each label for each variable, by loopy sum-product; ``rounds`` fixes their number."""
        k, n = self.unary.shape[1], len(g.owner)
        own = np.array([self.unary[f].sum(axis=0) for f in g.features]).reshape(-1, k) + self.unary[FEATURES]
        hubs = max((h for _, h in g.shared), default=-1) + 1
        own = np.concatenate([own, np.repeat((np.zeros(k) if self.common is None else self.common)[None], hubs, 0)])
        links = g.skip + [(v, n + h) for v, h in g.shared]
        edges = np.array(g.chain + links, np.int64).reshape(-1, 2)
        table = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(links), 0)])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([table, table.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        text = np.asarray(g.owner, np.int64)[np.concatenate([edges[:, 0], edges[:, 0]])]  # an edge's first end is never hidden
        cross = 4 * int(np.bincount(g.owner).max(initial=0)) + 100  # damped messages cross any document in half as many rounds
        said = np.zeros((len(src), k))
        belief = own.copy()
        live, done = np.arange(len(src)), 0
        while len(live) and (rounds is None or done < rounds):
            rest = belief[src[live]] - said[back[live]]
            new = _logsum(rest[:, :, None] + table[live], axis=1)
            new -= _logsum(new, axis=1)[:, None]
            step = 0.5 if rounds is not None or done < cross else 0.5 * 0.97 ** (done - cross)
            moved = step * (new - said[live])
            said[live] += moved
            np.add.at(belief, dst[live], moved)
            done += 1
            if rounds is None:
                moves = text[live][np.abs(moved).max(axis=1) >= STILL]
                live = live[np.isin(text[live], moves)]
        belief = own.copy()
        np.add.at(belief, dst, said)
        belief = belief[:n]
        return np.exp(belief - _logsum(belief, axis=1)[:, None])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _meetings(pairs: Counter, k: int) -> np.ndarray:
    """How often two labels meet, as shares, one count added everywhere."""
    n = np.ones((k, k))
    for (a, b), c in pairs.items():
        n[a, b] += c
        n[b, a] += c
    return n / n.sum()


def _potential(pairs: Counter, k: int) -> np.ndarray:
    """Log of how much oftener two labels meet than by chance."""
    n = _meetings(pairs, k)
    return np.log(n) - np.log(n.sum(axis=1)[:, None] * n.sum(axis=0)[None, :])


def fit_words(features: list[list[int]], labels: np.ndarray, weights: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Softmax regression by accelerated gradient steps."""
    k = len(KINDS) + 1
    x = np.zeros((len(features), FEATURES + 1), np.float32)
    for i, f in enumerate(features):
        x[i, f] = 1
    x[:, FEATURES] = 1
    y = np.eye(k, dtype=np.float32)[labels]
    share = (weights / weights.sum()).astype(np.float32)[:, None]
    w = ahead = np.zeros((FEATURES + 1, k), np.float32)
    rate = 4.0 / float((x**2).sum(axis=1).max())
    for t in range(rounds):
        z = x @ ahead
        p = np.exp(z - _logsum(z, axis=1)[:, None])
        step = ahead - rate * (x.T @ (share * (p - y)) + 1e-5 * ahead)
        ahead = step + t / (t + 3) * (step - w)
        w = step
    return w.astype(np.float64)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS) -> Field:
    k = len(KINDS) + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chance = min(1.0, train_docs / max(1, docs.count()))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) < int(chance * (1 << 30))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            g = Graph.of(texts)
            label = _labels(g, [base_spans(t) for t in texts])
            seen: Counter = Counter((("word", int(y), 0, tuple(f)) for y, f in zip(label, g.features, strict=True)))
            for name, edges in (("chain", g.chain), ("skip", g.twins)):
                seen.update((name, int(label[a]), int(label[b]), ()) for a, b in edges)
            what, a, b, f = zip(*seen, strict=True) if seen else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(what, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(map(list, f), pa.list_(pa.int32())), pa.array(seen.values(), pa.int64())],
                names=["what", "a", "b", "f", "n"],
            )

    found = rows.filter(draw).mapInArrow(gather, "what string, a int, b int, f array<int>, n long").groupBy("what", "a", "b", "f").agg(F.sum("n").alias("n"))
    found = cut(found)
    words = found.filter("what = 'word'").orderBy(F.xxhash64("f", "a"), "f", "a").limit(train_words).collect()
    if not words:
        return Field(np.zeros((FEATURES + 1, k)), np.zeros((k, k)), np.zeros((k, k)))
    pairs = {name: Counter({(r.a, r.b): r.n for r in found.filter(F.col("what") == name).select("a", "b", "n").collect()}) for name in ("chain", "skip")}
    unary = fit_words([list(r.f) for r in words], np.array([r.a for r in words]), np.array([r.n for r in words], float))
    # a skip edge says that equal words agree; one count a label stands for what no document has shown
    pairs["skip"].update({(i, i): 1 for i in range(k)})
    return Field(unary, _potential(pairs["chain"], k), _potential(pairs["skip"], k), np.log(_meetings(pairs["skip"], k).sum(axis=1)))


def added_spans(texts: list[str], base: list[list[tuple[int, int, str]]], field: Field) -> list[list[tuple[int, int, str]]]:
    """Spans that the field adds to each text; neighbours of one kind are joined."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    g = Graph.of(texts)
    if not g.owner:
        return out
    free = _labels(g, base) == 0
    p = field.marginals(g)
    kind = p.argmax(axis=1)
    beside = {b: a for a, b in g.chain}
    for v in np.flatnonzero(free & (kind > 0) & (p.max(axis=1) >= SURE)).tolist():
        mine, (a, b), name = out[g.owner[v]], g.spans[v], KINDS[kind[v] - 1]
        prior = beside.get(v)
        if mine and prior is not None and mine[-1][1] == g.spans[prior][1] and mine[-1][2] == name:
            a = mine.pop()[0]
        mine.append((a, b, name))
    return out


def as_string(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts by kind, base spans and all spans of every document."""
    field = field or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = {k: i for i, k in enumerate(KINDS)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, field)
            out: dict[str, list] = {f"n_{k}": [sum(x[2] == k for x in b) for b in base] for k in KINDS}
            out["n_added"] = [len(m) for m in more]
            spans = [as_string(sorted(b + m, key=lambda x: (x[0], order[x[2]]))) for b, m in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": piece.column("doc_id")} | {c: pa.array(v, pa.int64()) for c, v in out.items()} | {"base": pa.array(map(as_string, base), pa.string()), "spans": pa.array(spans, pa.string())}
            )

    return rows.mapInArrow(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base string, spans string")
