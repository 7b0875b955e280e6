"""Secret scans by grammar inference.

Base patterns find assignments, access keys and long hex runs. The credentials
that they find in about ``TRAIN_DOCS`` documents, picked by hash, are the
labelled examples (at most ``TRAIN_STRINGS`` different ones of each kind). From
the examples of a kind a prefix tree over character classes is built, and
states whose outgoing frequencies are compatible by Hoeffding's bound are
merged, red against blue in breadth-first order, into a probabilistic
automaton. Every candidate in every text (12 or more characters of the
credential alphabet with a letter and a digit) is scored by the best
automaton's log-likelihood against a class-bigram model of ordinary words; a
score of ``BITS`` a character or more is reported as a span of kind ``form``
unless a base span covers part of it.

Defined cases: null and empty texts have no spans; repeated rows are scanned
each; without any labelled credential there are no automata and no ``form``
spans. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import cut, slices, text_or_empty

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 24 and more; the same as all runs without the shorter ones.
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
DIGIT = re.compile(r"[0-9]")

TRAIN_DOCS = 100_000
TRAIN_STRINGS = 400
ALPHA = 0.05
BITS = 1.0

#: Character classes of the automata's alphabet.
CLASSES = str.maketrans({**dict.fromkeys("0123456789", "d"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "L")})
END = "$"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def examples(text: str) -> list[tuple[str, str]]:
    """(kind, credential) of the base spans; an assignment's credential is its value."""
    out = [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    return out + [(k, text[a:b]) for a, b, k in base_spans(text) if k != "assign"]


class Automaton:
    """A probabilistic deterministic automaton learned by merging prefix-tree states."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        for s in strings:
            state = 0
            for c in s.translate(CLASSES):
                self.count[state][c] += 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                state = self.next[state][c]
            self.count[state][END] += 1
        self.alpha = alpha
        self._merge_all()
        self._log_probabilities()

    def _total(self, q: int) -> int:
        return sum(self.count[q].values())

    def _compatible(self, a: int, b: int) -> bool:
        """Whether all frequencies out of both, and out of what follows, differ by no more than chance."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(self.count[a][c] / n - self.count[b][c] / m) > bound for c in self.count[a].keys() | self.count[b].keys()):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add a subtree's counts to a state, keeping the automaton deterministic."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.count[a].update(self.count[b])
            for c, q in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], q))
                else:
                    self.next[a][c] = q

    def _merge_all(self) -> None:
        red, blue = [0], deque((0, c) for c in sorted(self.next[0]))
        reds = {0}
        while blue:
            parent, c = blue.popleft()
            q = self.next[parent].get(c)
            if q is None or q in reds:
                continue
            for r in red:
                if self._compatible(r, q):
                    self.next[parent][c] = r
                    self._fold(r, q)
                    blue.extend((r, x) for x in sorted(self.next[r]) if self.next[r][x] not in reds)
                    break
            else:
                red.append(q)
                reds.add(q)
                blue.extend((q, x) for x in sorted(self.next[q]))
        self.states = red

    def _log_probabilities(self) -> None:
        """Log2 chances with half a count for every class that was not seen."""
        symbols = sorted({c for q in self.states for c in self.count[q]} | set("dhlHL"))
        self.log = {}
        for q in self.states:
            n = self._total(q) + 0.5 * len(symbols)
            self.log[q] = {c: math.log2((self.count[q][c] + 0.5) / n) for c in symbols}, math.log2(0.5 / n)
        self.step = {q: self.next[q] for q in self.states}

    def score(self, classes: str) -> float:
        """Log2-likelihood of a string of classes; leaving the automaton starts anew at its root."""
        total, q = 0.0, 0
        for c in classes:
            known, rare = self.log[q]
            total += known.get(c, rare)
            q = self.step[q].get(c, 0)
        known, rare = self.log[q]
        return total + known.get(END, rare)


class Scorer:
    """All automata and the model of ordinary words."""

    def __init__(self, by_kind: dict[str, list[str]], words: list[str]):
        self.automata = [Automaton(s) for _, s in sorted(by_kind.items()) if s]
        pairs: Counter = Counter()
        for w in words:
            w = f"^{w.translate(CLASSES)}{END}"
            pairs.update(zip(w, w[1:], strict=False))
        firsts: Counter = Counter()
        for (a, _), n in pairs.items():
            firsts[a] += n
        self.plain = {(a, b): math.log2((n + 0.5) / (firsts[a] + 8)) for (a, b), n in pairs.items()}
        self.rare = {a: math.log2(0.5 / (n + 8)) for a, n in firsts.items()}

    def bits(self, candidate: str) -> float:
        """Bits a character by which the best automaton explains it better than ordinary words do."""
        if not self.automata:
            return -math.inf
        s = candidate.translate(CLASSES)
        w = f"^{s}{END}"
        plain = sum(self.plain.get(p, self.rare.get(p[0], -4.0)) for p in zip(w, w[1:], strict=False))
        return (max(a.score(s) for a in self.automata) - plain) / len(s)

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], float | None]:
        """Spans that the automata add, and the best score of any candidate."""
        added, best, i = [], None, 0
        if not self.automata or not DIGIT.search(text):
            return added, best
        for m in CANDIDATE.finditer(text):
            if not MIXED.match(m[0]):
                continue
            score = self.bits(m[0])
            best = score if best is None else max(best, score)
            while i < len(base) and base[i][1] <= m.start():
                i += 1
            if score >= BITS and all(b[0] >= m.end() or b[1] <= m.start() for b in base[i:]):
                added.append((m.start(), m.end(), "form"))
        return added, best


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_strings: int = TRAIN_STRINGS) -> Scorer:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    chance = min(1.0, train_docs / max(1, docs.count()))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(1 << 30)) < int(chance * (1 << 30))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found: set[tuple[str, str]] = set()
            for text in piece.column("text").to_pylist():
                if DIGIT.search(text):
                    found.update(examples(text))
                found.update(("", w) for w in set(text.split()) if xxhash.xxh3_64_intdigest(w) % 64 == 0)
            kinds, values = zip(*sorted(found), strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], names=["kind", "value"])

    found = cut(rows.filter(draw).mapInArrow(gather, "kind string, value string").distinct())
    by_kind: dict[str, list[str]] = {}
    for kind in ("", *KINDS):
        few = found.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(train_strings * (10 if not kind else 1))
        by_kind[kind] = [r[0] for r in few.select("value").collect()]
    secrets = {s for k in KINDS for s in by_kind[k]}
    return Scorer({k: by_kind[k] for k in KINDS}, [w for w in by_kind[""] if not any(s in w for s in secrets)])


def as_string(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """doc_id, counts by kind, base spans, all spans, best candidate score of every document."""
    scorer = scorer or learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = {k: i for i, k in enumerate((*KINDS, "form"))}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_form", "base", "spans", "best_bits")}
            for text in piece.column("text").to_pylist():
                base = base_spans(text)
                added, best = scorer.spans(text, base)
                n = Counter(k for _, _, k in base)
                for k in KINDS:
                    out[f"n_{k}"].append(n[k])
                out["n_form"].append(len(added))
                out["base"].append(as_string(base))
                out["spans"].append(as_string(sorted(base + added, key=lambda x: (x[0], order[x[2]]))) if added else out["base"][-1])
                out["best_bits"].append(best)
            kinds = {"base": pa.string(), "spans": pa.string(), "best_bits": pa.float64()}
            yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id")} | {c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return rows.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, n_form long, base string, spans string, best_bits double")
