"""Merkle manifest, exact duplicates and fill-in-the-middle against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formloom.llm import exact, infill, manifest, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ---- manifest --------------------------------------------------------------
def tree(nodes):
    """Levels of a tree over ``nodes`` in order."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def path(levels, at):
    out = []
    for now in levels[:-1]:
        run = at // 3 * 3
        out.append(("".join(now[run:at]), "".join(now[at + 1 : run + 3])))
        at //= 3
    return out


def brute_manifest(leaves):
    """(key, leaf) -> (subroot, root, proof digest, folded root, verified) of rows (group, key, leaf, shown)."""
    groups = {}
    for g, k, leaf, shown in leaves:
        groups.setdefault(g, []).append((k is not None, k or 0, leaf, shown))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for j, (there, k, leaf, shown) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = path(trees[g], j) + path(top, i)
            node = shown or leaf
            for left, right in way:
                node = h(left, node, right)
            out.append((k if there else None, leaf, trees[g][-1][0], top[-1][0], h(*[x + y for x, y in way]), node, node == top[-1][0]))
    return out


def order_of(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("sizes", [[1], [2], [4], [243], [244], [1, 1], [3, 700, 1], [2300, 1, 5, 250], [1] * 10, [1, 2, 3, 4] * 8])
def test_manifest_by_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    leaves = []
    for i, n in enumerate(sizes):
        for k in range(n):
            leaf = h(str(rng.random()))
            leaves.append((None if i == 1 else f"ö{i}" if i % 3 else f"s{i}", k, leaf, h(leaf) if rng.random() < 0.1 else leaf if rng.random() < 0.1 else None))
    rng.shuffle(leaves)
    got = manifest.proofs(spark.createDataFrame(leaves, "group string, key long, leaf string, shown string").repartition(5)).collect()
    want = brute_manifest(leaves)
    assert order_of(got) == order_of(want)
    assert any(r[-1] for r in want)


def test_manifest_nulls_ties_and_repeats(spark, odd_docs, no_docs):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    got = manifest.manifest(odd_docs, columns, "source", "doc_id").collect()
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = [(r.source, r.doc_id, h(*[one(r[c]) for c in columns]), None) for r in odd_docs.collect()]
    assert order_of(got) == order_of(brute_manifest(rows))
    assert all(r.verified for r in got)
    assert manifest.manifest(no_docs, columns, "source", "doc_id").count() == 0


def test_manifest_query_presents_texts_without_line_breaks(spark, tmp_path):
    rows = [(i, f"line {i}\nnext" if i % 3 else None if i % 2 else f"line {i}", "en", ["a", "b", None][i % 3], i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        touched = zlib.crc32(str(i).encode()) % 2 == 0 and text is not None and "\n" in text
        assert got[i].verified == (not touched) and (got[i].folded_root == got[i].root) == got[i].verified
    assert {r.verified for r in got.values()} == {True, False}


# ---- exact duplicates ------------------------------------------------------
def brute_groups(rows):
    by = {}
    for i, (doc, text) in enumerate(rows):
        by.setdefault(text or "", []).append((doc is not None, doc or 0, i))
    return {t: (max(x)[1] if max(x)[0] else None, len(x)) for t, x in by.items()}


def check_marked(rows, got):
    want = brute_groups(rows)
    assert len(got) == len(rows)
    stay = {}
    for r in got:
        keep, size = want[r.text or ""]
        assert (r.keep_id, r.group_size) == (keep, size)
        stay.setdefault(r.text or "", []).append(r)
    for text, some in stay.items():
        kept = [r for r in some if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == want[text][0]


@pytest.mark.parametrize("sent", [exact.SENT_KEYS, 0])
def test_exact_groups_by_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(exact, "SENT_KEYS", sent)
    rng = random.Random(4)
    long = "same first characters " * 20
    texts = [long + c for c in "abcd"] + ["x", "y", "X", "x ", "é", "é", "", None, "twelve bytes", "twelve Bytes"]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(None, "x"), (None, "alone without id"), (None, "two"), (None, "two")]
    rng.shuffle(rows)
    check_marked(rows, exact.marked(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())


def test_exact_ties_and_clashing_columns(spark, odd_docs, no_docs):
    rows = [(5, "t", 2), (5, "t", 1), (5, "t", 1), (4, "t", 0), (7, "u", 3), (7, "u", 3), (7, "u", None)]
    got = exact.marked(spark.createDataFrame(rows, "doc_id long, text string, _size long")).collect()
    assert sorted((r.doc_id, r.text, r._size) for r in got if r.kept) == [(5, "t", 1), (7, "u", None)]
    assert len(got) == 7 and {(r.text, r.keep_id, r.group_size) for r in got} == {("t", 5, 4), ("u", 7, 3)}
    names = ["_id", "_n", "_keep", "_ties", "_found", "_kept", "_length", "_prefix", "_whole", "_least", "_i", "kept", "c0", "c1", "group_size"]
    clash = odd_docs.select("*", *[F.lit(1).alias(c) for c in names])
    got = exact.marked(clash)
    assert got.columns == [c for c in clash.columns if c not in exact.RESULTS] + list(exact.RESULTS)
    check_marked([(r.doc_id, r.text) for r in odd_docs.collect()], got.collect())
    assert exact.marked(no_docs).count() == 0


# ---- fill-in-the-middle ----------------------------------------------------
def brute_infill(doc, text):
    text = text or ""
    digest = h("1:", "" if doc is None else str(doc))
    a, b, c, d = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(text), "spm" if d % 100 < 20 else "psm", low, high - low, out


def test_code_points_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices(["a", "\n", "é", "中", "\U0001f600", "\x7f", "߿"], k=rng.randint(0, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        points = infill.CodePoints(data)
        ends = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert (points.after(np.arange(len(text) + 1)) == ends).all()
        assert (points.before(np.arange(len(data) + 1)) == [sum(e <= i for e in ends[1:]) for i in range(len(data) + 1)]).all()


def test_infill_by_brute_force(spark):
    rng = random.Random(6)
    parts = ["a", "word ", "<", "<P", "S>", "<M", ">", "\n", "é", "中", "\U0001f600", "\x00", " "]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 60)))) for i in range(600)]
    rows += [(1000, "has <S> inside"), (1001, ""), (1002, None), (None, "no id"), (-5, "below zero"), (7, "again"), (7, "again"), (1003, "long 中" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((repr(r.doc_id), r.text or "", r.n, r.form, repr(r.prefix_chars), repr(r.middle_chars), r.output) for r in got) == sorted(
        (repr(d), t or "", n, f, repr(p), repr(m), o) for d, t in rows for n, f, p, m, o in [brute_infill(d, t)]
    )
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_slices_and_odd_tables(spark, odd_docs, no_docs):
    texts = pa.array(["skip", "né", "", "中文\U0001f600"]).slice(1)
    n, form, prefix, middle, output = infill.rearranged(texts, np.array([1, 5, 2]), np.array([2, 6, 0]), np.zeros(3, bool), np.array([False, False, True]))
    assert n.to_pylist() == [2, 0, 3] and form.to_pylist() == ["psm", "plain", "spm"]
    assert output.to_pylist() == ["<P>n<S><M>é", "", "<S>\U0001f600<P><M>中文"] and prefix.to_pylist() == [1, None, 0] and middle.to_pylist() == [1, None, 2]
    clash = odd_docs.select("*", *[F.lit("k").alias(c) for c in ("first", "stays", "output", "c0", "form")])
    got = infill.fill_in_middle(clash, epoch=2)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "first", "stays", "c0", *infill.RESULTS]
    assert got.count() == odd_docs.count() and {r.c0 for r in got.select("c0").collect()} == {"k"}
    assert infill.fill_in_middle(no_docs).count() == 0
