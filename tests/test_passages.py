"""Blocks, passages, edits and the export on rows written by hand."""

import random
import re

from pyspark.sql import functions as F

from formloom.operators import export as E
from formloom.operators import passages as P
from formloom.operators import review as V


def norm(t):
    return " ".join(t.split())


def brute_blocks(t):
    marker = lambda x: re.match(r"(#{1,6}\s*)?page\s+\d+\s*$", x, re.I)
    kept = lambda x: [y.strip() for y in x.split("\n") if y.strip() and not marker(y.strip())]
    t = t.replace("\r", "\n")
    ps = [p for p in (norm(" ".join(kept(p))) for p in re.split(r"\n\s*\n+", t)) if p]
    lines = kept(t)
    return ps if len(ps) > 1 else [norm(" ".join(lines[i : i + 3])) for i in range(0, len(lines), 3)]


def brute_windows(t, word, most=20, blocks=2, to_end=False):
    bs, out = brute_blocks(t), []
    for i, b in enumerate(bs):
        if word not in b:
            continue
        got = ""
        n = 0
        for j, c in enumerate(bs[i:]):
            if not to_end and n >= blocks:
                break
            c = norm(c[c.index(word) :]) if j == 0 else c
            longer = f"{got} {c}" if n else c
            if not to_end and n and len(longer) > most:
                break
            got, n = longer, n + 1
            if not to_end and len(got) >= most:
                break
        out.append(got)
    if not out:
        text, at = norm(t), norm(t).find(word)
        while at >= 0:
            out.append(text[at : None if to_end else at + len(word) + most].strip())
            at = text.find(word, at + len(word))
    return list(dict.fromkeys(out))


def test_blocks_and_windows_by_brute_force(spark):
    rng = random.Random(1)
    parts = ["ab", "key", " ", "\n", "\n\n", "\n \n\n", "Page 3\n", "## page 12\n", "x y z", "k ey", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(300)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", P.blocks("t").alias("b"), P.keyword_windows("t", "key", 20, 2).alias("w"), P.keyword_windows("t", "key", to_page_end=True).alias("e")).collect()
    for r in got:
        t = r.t or ""
        assert r.b == brute_blocks(t)
        assert r.w == brute_windows(t, "key"), t
        assert r.e == brute_windows(t, "key", to_end=True), t


def test_passages(spark):
    df = spark.createDataFrame([("intro TH E start and more END rest",), ("nothing here",), (None,)], "t string")
    got = [tuple(r) for r in df.select(P.slice_between("t", ["the"], ["en d", "e n"], ["x"]), P.trim_before_keyword("t", "and  more")).collect()]
    assert got == [("TH E start and more END", "and more END rest"), ("nothing here", "nothing here"), ("", "")]
    courts = spark.createDataFrame([("x\n# - ศ าลแพ่ง : \nศาลอื่น",), ("ศาล" + "ก" * 90,), (None,)], "t string").select(P.court_name("t")).collect()
    assert [r[0] for r in courts] == ["ศ าลแพ่ง", None, None]
    edits = spark.createDataFrame([("a\n  b \nc", 1, " new "), ("a", 5, "x"), ("a", 0, " "), (None, 0, " x ")], "p string, k int, n string")
    assert [r[0] for r in edits.select(P.apply_line_edit("p", F.col("k"), F.col("n"))).collect()] == ["a\n  new \nc", "a", "a", "x"]
    pages = spark.createDataFrame([(1, 2, "b "), (1, 1, " a"), (2, 1, " only "), (3, 1, None), (3, 2, " ")], "d int, n int, t string")
    assert {r.d: r.text for r in P.join_pages(pages, ["d"], "n", "t").collect()} == {1: "## Page 1\n\na\n\n---\n\n## Page 2\n\nb", 2: " only ", 3: None}


def test_age(spark):
    df = spark.createDataFrame([("1 มกราคม 2500", "2 มกราคม 2560", a, c) for a, c in (("๖๐", None), ("61", "60"), ("61", " "), ("", "9"), (None, None))] + [(None, "x", "5", None)], "b string, u string, a string, c string")
    got = [r[0] and (r[0].action, r[0].value) for r in df.select(V.reconcile_age(F.col("b"), F.col("u"), F.col("a"), F.col("c"))).collect()]
    assert got == [("verified", "60"), ("promoted_crop_ocr_alternative", "60"), ("flagged_mismatch_kept_ocr", "61"), ("derived_missing", "60"), ("derived_missing", "60"), None]


def test_export_writes_and_refuses(spark, tmp_path):
    rows = [("a", "personId", "1-2345-67890-12-1"), ("a", "houseCode", "1001-000037-1"), ("a", "personName", "ก"), ("a", "age", "๕"), ("a", "address", "1 หมู่ 2 จ.นคร 10110"), ("b", "personId", "#"), ("b", "personName", "ข")]
    done = E.person_export(spark.createDataFrame(rows, "record_id string, field string, value string"), "", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    done.filter("refused is null").select(*E.EXPORT_COLUMNS).write.mode("append").parquet(f"{tmp_path}/out")
    (row,) = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(row) == 31 and row.PIE == "1234567890121" and row.PAhe == 5 and row.PPstalCode == "10110" and row.UpdatedBy is None
    assert [(r.record_id, r.refused) for r in done.filter("refused is not null").collect()] == [("b", "personId,houseCode")]


def test_judgment_values(spark):
    from formloom.functions import judgment as J

    df = spark.createDataFrame([("พิพากษาให้จำเลย ชำระเงิน ๕,๐๐๐. อัตราร้อยละ 7.5 ต่อปี วันฟ้อง ( วันที่ 1 มกราคม 2565 )",), ("ยกฟ้อง",), (None,)], "t string")
    got = [tuple(r[0]) for r in df.select(J.judgment_values("t")).collect()]
    assert got == [("๕,๐๐๐", "7.5", None, "1 มกราคม 2565", None), (None,) * 5, (None,) * 5]
    heads = spark.createDataFrame([("คดีหมายเลขดำที่\nสำหรับศาล 9\n# 12/๒๕๖๗",), ("คดีดำ\nคดีแดงที่ 7/2568",), ("คดีแดง\nz\nx\ny\n5/1",), (None,)], "t string")
    assert [tuple(r[0]) for r in heads.select(J.case_header("t")).collect()] == [("12/๒๕๖๗", None), (None, "7/2568"), (None, None), (None, None)]
