"""Address validation: spellings, unread and blank addresses, no reference; the exact ratio against the standard library."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from formloom.functions import compare as C
from formloom.operators import location as L


def test_matching_ratio_is_difflibs(spark):
    rng = random.Random(5)
    letters = ["กขคงabAB ", "ก ข", "xyz", "ทองดีมาก"]
    texts = [None, "", "a"] + ["".join(rng.choices(rng.choice(letters), k=rng.randint(0, 14))) for _ in range(60)] + ["".join(rng.choices("abcก", k=300)) for _ in range(4)]
    rows = [(rng.choice(texts), rng.choice(texts)) for _ in range(700)]
    got = C.with_matching_ratio(spark.createDataFrame(rows, "a string, b string"), "a", "b", "r").collect()
    assert len(got) == 700
    for r in got:
        a, b = r.a or "", r.b or ""
        assert r.r == (0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio())


def test_validate_address(spark):
    dim = spark.createDataFrame([
        (1, 10, "นครเมฆ", "สองแคว", "บ้านสวนใหม่", "10100", 1), (1, 10, "นครเมฆ", "สองแคว", "ทุ่งใหญ่มาก", "10100", 2), (1, 11, "นครเมฆ", "ฟ้าหลวง", "โคกสูงเนิน", "10200", 3),
    ], "province_code int, district_code int, province string, district string, subdistrict string, postal_code string, seq int")
    rows = [
        (1, "1 หมู่ 2 ต.บ้านสวนใหม่ อ.สองแคว จ.นครเมฆ"), (2, "1 หมู่ 2 ต.บ้านสวนใหมๆ  อ.สองแคว จ.นครเมฆ"), (3, "12 หมู่ 3"), (4, "9 ต.ไม่รู้จัก อ.สองแคว จ.นครเมฆ"), (5, " "), (6, None),
        (7, "9 ต.บ้านสวนใหม่ อ.สองแคว จ.แดนไกล"), (8, "1 หมู่ 2 ตำบลบ้านสวนใหม่ อำเภอสองแคว จังหวัดนครเมฆ"), (1, "1 หมู่ 2 ต.บ้านสวนใหม่ อ.สองแคว จ.นครเมฆ"),
    ]
    addresses = spark.createDataFrame(rows, "k long, address string")
    got = {}
    for r in L.validate_address(addresses, dim, "k").collect():
        got.setdefault(r.k, []).append((r.issue, r.action, r.postal_code, r.value, r.review_status))
    assert set(got) == {1, 2, 3, 4, 7, 8} and len(got[1]) == 2 and got[1][0] == (None, "verified_location_reference", "10100", rows[0][1], None)
    assert got[2] == [("address_location_corrected", "corrected_location_reference", "10100", "1 หมู่ 2 ต.บ้านสวนใหม่ อ.สองแคว จ.นครเมฆ", "needs_review")]
    assert got[3][0][:3] == ("address_location_parse_failed", "flagged_location_reference", None)
    assert got[4][0][:2] == got[7][0][:2] == ("address_location_not_found", "flagged_location_reference")
    assert got[8][0][:2] == (None, "verified_location_reference")
    none = {r.k: (r.issue, r.action, r.value) for r in L.validate_address(addresses, dim.limit(0), "k").collect()}
    assert none[1] == ("address_reference_missing", None, rows[0][1]) and none[3][0] == "address_location_parse_failed"


def test_repair_address_number(spark):
    addresses = spark.createDataFrame([(1, "1 หมู่ 2 ต.ก", "p"), (2, "1 หมู่ 2 ต.ก", "p"), (3, None, "p"), (4, "12 หมู่ 2 ต.ก", None), (5, "7 หมู่ 2 ต.ก", "p")], "k long, address string, source string")
    pages = spark.createDataFrame([(1, "# ที่อยู่ 12 หมู่ 2 ต.ก\n12/34 หมู่ 2 ต.ก\n12/35 หมู่ 2 ต.ก\n99 หมู่ 2 ต.ข"), (2, "ไม่มี\n\n1 หมู่ 2 ต.ก"), (3, "1 หมู่ 2"), (4, "1 หมู่ 2 ต.ก"), (5, None)], "k long, text string")
    got = {r.k: (r.value, r.previous_value, r.source, r.review_status) for r in L.repair_address_number(addresses, pages, "k").collect()}
    assert got[1] == ("12/34 หมู่ 2 ต.ก", "1 หมู่ 2 ต.ก", "raw_ocr_address_line", "needs_review")
    assert got[2] == got[2][:1] + (None, "p", None) and got[3] == (None, None, "p", None) and got[4][0] == "12 หมู่ 2 ต.ก" and got[5][0] == "7 หมู่ 2 ต.ก"


def test_repair_address_number_sends_no_lines_around(spark):
    addresses = spark.createDataFrame([(1, "1 หมู่ 2 ต.ก", "p"), (1, "1 หมู่ 2 ต.ก", "q"), (2, "5 หมู่ 2 ต.ก", "p")], "k long, address string, source string")
    pages = spark.createDataFrame([(1, "12 หมู่ 2 ต.ก\n13 หมู่ 2 ต.ก")], "k long, text string")
    fixed = L.repair_address_number(addresses, pages, "k")
    assert "Broadcast" not in fixed._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.k, r.value, r.previous_value, r.source) for r in fixed.select("k", "value", F.coalesce("previous_value", F.lit("")).alias("previous_value"), "source").collect())
    raw = "raw_ocr_address_line"
    assert got == [(1, "12 หมู่ 2 ต.ก", "1 หมู่ 2 ต.ก", raw)] * 2 + [(2, "5 หมู่ 2 ต.ก", "", "p")]


def test_repair_address_number_of_odd_lines(spark):
    addresses = [(1, "1 หมู่ 2 ต.ก", "a"), (2, "หมู่ 2 ต.ก", "a"), (3, "9 ต.ข", "a"), (4, None, "a"), (5, "", "a"), (6, "1 ต.ค", "a"), (6, "1 ต.ค", "b"), (7, "3 ต.ง", "a")]
    pages = [(1, "x\n## ที่อยู่ : 1/5 หมู่ 2 ต.ก\n19 หมู่ 2 ต.ก"), (2, "5 หมู่ 3 ต.ก"), (3, "<td>9-11 ต.ข</td>\nไม่ 99 ต.ข"), (4, "12 ต.ค"), (5, "12 ต.ค"), (6, "&#49;2 ต.ค\n\u00a0.13 ต.ค"), (7, None)]
    got = L.repair_address_number(spark.createDataFrame(addresses, "k int, address string, source string"), spark.createDataFrame(pages, "k int, text string"), "k")
    assert sorted((r.k, r.value, r.source) for r in got.filter("k not in (4, 5)").collect()) == [
        (1, "1/5 หมู่ 2 ต.ก", "raw_ocr_address_line"), (2, "5 หมู่ 3 ต.ก", "raw_ocr_address_line"), (3, "9-11 ต.ข", "raw_ocr_address_line"), (6, "12 ต.ค", "raw_ocr_address_line"),
        (6, "12 ต.ค", "raw_ocr_address_line"), (7, "3 ต.ง", "a")]
    assert sorted((r.k, r.value, r.source) for r in got.filter("k in (4, 5)").collect()) == [(4, None, "a"), (5, "", "a")]
