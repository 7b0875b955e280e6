"""Chat formatting, mixing and fingerprints against plain Python."""

import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from formloom.llm import chat, fingerprints, mixing

MASK = 2**64 - 1


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def xx(*values):
    """Spark's xxhash64 of strings and longs, one value's hash being the next one's seed."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v & MASK).to_bytes(8, "little") if not isinstance(v, tuple) else (v[0] & 0xFFFFFFFF).to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


# ---- chat ------------------------------------------------------------------
def test_escape_is_reversible(spark):
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "x", "\n", "[ROLE]", "INST]", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not re.search(r"</?s>|\[/?(INST|SYS|ROLE)\]", r.e)


def test_reply_tree_paths_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for tree in range(12):
        for node in range(rng.randint(1, 25)):
            parent = rng.randrange(node) if node and rng.random() < 0.95 else None
            rows.append((tree, node, parent, node, rng.choice(["user", "assistant", "tool", None]), f"t{node}", rng.choice([0.0, 1.0, 2.5, None])))
    rows += [(99, 0, 0, 0, "user", "own parent", 1.0), (99, 1, 2, 1, "user", "link to a later one", 1.0), (99, 2, 1, 2, None, None, None)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, place long, role string, text string, score double")
    want = {}
    for tree in {r[0] for r in rows}:
        nodes = {r[1]: r for r in rows if r[0] == tree}
        up = {n: r[2] if r[2] in nodes and nodes[r[2]][3] < r[3] else None for n, r in nodes.items()}
        paths = []
        for leaf in nodes.keys() - set(up.values()):
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            paths.append((-sum(nodes[n][6] or 0 for n in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(paths)[:2], 1):
            want[tree, rank] = path
    got = {}
    for r in chat.reply_paths(df, top=2).collect():
        got.setdefault((r.tree, r["rank"]), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    done = {(r.tree, r["rank"]): r for r in chat.format_conversations(df, top=2).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    for (tree, rank), path in want.items():
        nodes = {r[1]: r for r in rows if r[0] == tree}
        assert [(t.role, t.text) for t in done[tree, rank].turns] == [(nodes[n][4] or "", nodes[n][5] or "") for n in path]
        masked = [done[tree, rank].formatted[s.start : s.end] for s in done[tree, rank].loss_spans]
        assert masked == [nodes[n][5] for n in path if nodes[n][4] == "assistant"]


def test_control_strings_and_empty_conversations(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", "")]
    told = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(chat.turns_in_order(told, "conv_id", "turn"))
    read = {r.tree: r for r in done.select("tree", "n_turns", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert read[-7].loss == said and [x.text for x in read[-7].t] == [said, said]
    assert read[1].n_turns == 3 and [x.role for x in read[1].t] == ["", "assistant", "assistant"]
    assert chat.format_conversations(chat.turns_in_order(told.limit(0), "conv_id", "turn")).count() == 0


def test_conversation_without_id(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (None, 2, "user", "bye"), (4, 0, "user", "x")]
    told = chat.turns_in_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn")
    got = {r.tree: r for r in chat.format_conversations(told).collect()}
    assert set(got) == {None, 4} and got[None].n_turns == 3
    assert got[None].formatted == "<s>[INST] hi [/INST]</s><s>yes</s><s>[INST] bye [/INST]</s>"
    assert sorted((r.tree or 0, r.node) for r in chat.reply_paths(told).collect()) == [(0, 1), (0, 2), (0, 3), (4, 1)]


# ---- mixing ----------------------------------------------------------------
def brute_targets(sizes):
    names = sorted((n for n in sizes if n is not None), key=lambda x: x.encode()) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while open_ and left > 1e-9:
        total = sum(weight[n] for n in open_)
        give = {n: left * weight[n] / total for n in open_}
        left = 0.0
        for n in list(open_):
            target[n] += give[n]
            if target[n] >= 2 * sizes[n]:
                left += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
                open_.discard(n)
    return target


def test_targets_and_taken_words(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "Z", "ö", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted((x.doc_id, x["size"], x.source_size, x.target, x.taken, x.copies, x.chance) for x in got)


def test_mixing_odd_rows(odd_docs, no_docs):
    rows = mixing.mix_report(odd_docs).collect()
    assert len(rows) == 9 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def brute_chances(sizes, want):
    """min(1, c * size) with the c at which chances times sizes add up to ``want``, by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(1, c * s) * s for s in sizes) < want else (low, c)
    return [min(1, low * s) for s in sizes]


def test_chances_are_met(spark):
    rng = random.Random(12)
    sizes = [rng.choice([1, 3, 10, 30, 100, 400]) for _ in range(1500)] + [20_000, 0]
    docs = spark.createDataFrame([(i, "w " * n, "a") for i, n in enumerate(sizes)], "doc_id long, text string, source string").cache()
    hits, total = Counter(), sum(sizes)
    want = brute_chances(sizes, 0.5 * total)
    for seed in range(10):
        got = {r.doc_id: r for r in mixing.mix_report(docs, f"s{seed}").collect()}
        assert abs(sum(r.taken for r in got.values()) - 1.5 * total) <= 200
        for i, n in enumerate(sizes):
            assert abs(got[i].chance - want[i]) < 1e-6
            hits[n] += got[i].copies - 1
    assert hits[20_000] == 10
    for n in {1, 3, 10, 30, 100, 400}:
        p, rows = want[sizes.index(n)], 10 * sizes.count(n)
        assert abs(hits[n] / rows - p) < 4 * (p * (1 - p) / rows) ** 0.5 + 0.005, (n, hits[n] / rows, p)


def test_mixing_of_rows_without_ids_and_of_repeated_rows(spark):
    schema = "doc_id long, text string, source string, _q double, target string, _size int, _tie string, source_size long, _edge int, c0 string"
    rest = (0.5, "t", 1, "x", 2, 3, "c")
    none = spark.createDataFrame([(None, f"a b w{i}", "s", *rest) for i in range(100)], schema)
    got = mixing.mix_report(none).collect()
    assert sum(r.taken for r in got) == 450 and {r.copies for r in got} == {1, 2}
    same = spark.createDataFrame([(7, "a b", "s", *rest)] * 99 + [(8, "a b c d", "s", *rest)], schema)
    assert abs(sum(r.taken for r in mixing.mix_report(same).collect()) - 303) <= 1
    mix = mixing.mixed(same)
    assert mix.columns == same.columns and sum(len(r.text.split()) for r in mix.collect()) in (302, 304)
    assert {tuple(r)[3:] for r in mix.collect()} == {rest}
    # rows that share id and text but not the rest: a part of them, the same in every run
    part = spark.createDataFrame([(7, "a b", "s", float(i), *rest[1:]) for i in range(99)], schema)
    runs = [sorted(r._q for r in mixing.mixed(part.repartition(n)).collect()) for n in (1, 5)]
    assert runs[0] == runs[1] and len(runs[0]) in (148, 149) and len(set(runs[0])) == 99


# ---- fingerprints ----------------------------------------------------------
def brute_signature(text, k=3, size=2):
    words = re.split(r"[ \t\n\x0b\f\r]+", text.strip(" \t\n\x0b\f\r"))
    if words == [""]:
        return []
    low = lambda x, b: x & (2**b - 1)
    if len(words) >= k:
        kmers = [low(xx(*words[i : i + k]), 39) for i in range(len(words) - k + 1)]
    else:
        kmers = [low(xx(" ".join(words)), 39)]
    seen, numbered = Counter(), []
    for i, h in enumerate(kmers):
        numbered.append((low(xx(h, (seen[h],)), 39), i))
        seen[h] += 1
    out = []
    for b in range(64):
        own = sorted(x for x in numbered if x[0] >> 33 == b)[:size]
        if own:
            rest = [low(h, 33) for h, _ in sorted(own, key=lambda x: (x[1], low(x[0], 33)))]
            out.append(b << 32 | low(xx(*rest), 32))
    return out


def test_signature_by_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d e f".split(), k=rng.randint(0, 400))) for _ in range(60)] + ["", " ", "one", "one two", "Nd, " * 900]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in fingerprints.fingerprints(df).collect():
        assert list(r.signature) == brute_signature(texts[r.doc_id]), texts[r.doc_id][:80]


def test_edit_probe_by_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(6)
    texts = {i * 3: "".join(rng.choices("ab é中\U0001f600", k=rng.randint(0, 50))) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edit_probe(df).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        nxt, n = texts[order[(i + 1) % len(order)]], len(texts[d])
        edited = texts[d][: n - n // 2] + nxt[: n // 2]
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = brute_signature(texts[d]), brute_signature(edited), brute_signature(nxt)
        near = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / len({v >> 32 for v in x} | {v >> 32 for v in y})
        assert abs(got[d].near_edited - near(a, b)) < 1e-12 and abs(got[d].near_next - near(a, c)) < 1e-12
    assert fingerprints.edit_probe(odd_docs).count() == 9
    assert fingerprints.edit_probe(no_docs).count() == 0


def test_order_matters(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    parts = [words[i : i + 20] for i in range(0, 400, 20)]
    rng.shuffle(parts)
    moved = " ".join(w for p in parts for w in p)
    df = spark.createDataFrame([(0, " ".join(words)), (1, moved)], "doc_id long, text string")
    a, b = (set(r.signature) for r in fingerprints.fingerprints(df).orderBy("doc_id").collect())
    kmers = lambda t: {tuple(t.split()[i : i + 3]) for i in range(398)}
    jaccard = len(kmers(" ".join(words)) & kmers(moved)) / len(kmers(" ".join(words)) | kmers(moved))
    assert len(a & b) / 64 < 0.75 * jaccard
