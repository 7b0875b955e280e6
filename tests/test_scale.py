"""What keeps the larger queries within their limits: rows stay where their form is, and texts are looked at once."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

import formloom.plans.catalog  # noqa: F401
from formloom import constants as K
from formloom import fixtures as fx
from formloom.functions import compare as C
from formloom.functions import fields as FL
from formloom.functions import text as X
from formloom.functions import thai as T
from formloom.operators import boxes as B
from formloom.operators import build as BU
from formloom.operators import forms
from formloom.operators import location as L
from formloom.plans.registry import QUERIES
from formloom.session import joined_within

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_death_date_makes_white_space_normal_once(spark):
    plan = _plan(spark.createDataFrame([("x",)], "t string").select(T.deceased_date("t")))
    assert plan.count("trim(regexp_replace(t#") == 1


def test_death_date_of_odd_texts(spark):
    texts = ["ตาย  เมื่อ 3 \n มกราคม 2560", "ไม่ ตาย 3 มกราคม 2560", "เสียชีวิต 4 มีนาคม 2561 ตาย", None, "", "อยู่ 3 มกราคม 2560"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.deceased_date("t").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == ["3 มกราคม 2560", None, "4 มีนาคม 2561", None, None, None]


def test_segments_stay_where_their_form_is(spark):
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", _plan(QUERIES["J06_segments_in_slot"](spark, SF)))
    assert exchanges == ["o_orderkey"]


@pytest.mark.parametrize("name", ["H13_merge_crop_values", "H13_merge_vision_values", "J10_decision_map", "P21_fields_to_reread", "P21_fields_to_reread_aggressive"])
def test_review_fields_stay_where_their_record_is(spark, name):
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", _plan(QUERIES[name](spark, SF)))
    assert exchanges and all(re.fullmatch(r"record_id#\d+, \d+", e) for e in exchanges)
    assert len(re.findall("REPARTITION_BY_NUM", _plan(QUERIES[name](spark, SF)))) == len(exchanges)


@pytest.mark.parametrize(("name", "key", "times"), [("H17_apply_actions", "record_id", 2), ("W01_record_numbers", "batch_id", 1)])
def test_review_records_are_dealt_once(spark, name, key, times):
    plan = _plan(QUERIES[name](spark, SF))
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+, \d+\), REPARTITION_BY_NUM", plan) == [key] * times
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\), ENSURE", plan)
    # what is left meets orders, or is the few rows found out about a batch
    assert all(re.match(r"[lo]_orderkey#", e) or re.fullmatch(r"batch_id#\d+, \d+", e) for e in moved)


def test_runs_of_a_passage_are_made_once(spark, tmp_path):
    # 3,000 lines against their whole text: a pass over the text for every run of every line would take hours
    text = "\n".join(f"line {i} of the {i * 7919 % 1000} words" + "x" * (i % 40) for i in range(3000))
    spark.createDataFrame([(0, text), (1, text), (2, text), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["F54_line_in_passage"](spark, str(tmp_path)).groupBy("doc_id").agg({"n": "count"}).collect()
    assert {r[0]: r[1] for r in got} == {0: 3000, 1: 3000, 2: 3000}


def test_lines_belong_as_by_plain_search():
    rng = random.Random(3)
    for _ in range(3000):
        own, passage = ("".join(rng.choices("abc", k=rng.choice([0, 0, 3, 9]))) for _ in range(2))
        passage += "".join(rng.choices("abc", k=rng.choice([0, 20, 60])))
        at, n = rng.randrange(len(own + passage) + 1), rng.choice([0, 2, 5, 6, 9, 13, 20])
        line = rng.choice([(own + passage)[at : at + n], "".join(rng.choices("abcd", k=n)), (own + passage)[at : at + 5] + "dd" * n])
        w, s = own + passage, line
        parts = [s[i : i + 5] for i in range(0, len(s) - 4, 2)]
        want = bool(w and s) and (s in w or (len(s) >= 6 and (s[:14] in w or s[-12:] in w)) or (len(s) >= 10 and sum(p in w for p in parts) / len(parts) >= 0.18))
        assert C.belongs(line, passage, C.runs(passage), own) == want, (own, passage, line)


@pytest.mark.parametrize("name", ["J14_align_segments", "J18_passage_box", "J18_passage_box_unseeded"])
def test_pages_meet_as_arrays(spark, name):
    # one row a page: no window or row for each pair of a segment and a line, and nothing worked out twice
    plan = _plan(QUERIES[name](spark, SF))
    assert plan.count("MapInArrow") == 1 and "Exchange hashpartitioning(k#" not in plan or name == "J14_align_segments"
    assert not re.search(r"hashpartitioning\([^)]*(seg_no|line_no)", plan)


def test_join_within_records_loses_and_doubles_nothing(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "x", 3), ("b", "x", 4), ("c", None, 5)], "r string, f string, n int")
    side = spark.createDataFrame([("a", "x", "p"), ("a", "x", "q"), ("b", "z", "s"), ("c", None, "t"), ("d", "x", "u")], "r string, f string, v string")
    got = {tuple(r) for r in joined_within(rows, side, "r", "f").collect()}
    assert got == {tuple(r) for r in rows.join(side, ["r", "f"], "left").collect()}


def test_names_alone_ask_no_patterns_of_the_page(spark):
    pages = spark.createDataFrame([("a", "x")], "k string, text string")
    assert "{4,180}" not in _plan(forms.parse_person_text(pages, "k", fields=K.NAME_FIELDS))
    assert "{4,180}" in _plan(forms.parse_person_text(pages, "k"))


def _largest_method(df):
    spark, out = df.sparkSession, io.StringIO()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(out):
            df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())))


def test_forms_are_made_by_code_that_is_compiled(spark):
    # the JVM leaves methods of over 8,000 bytes to its interpreter
    assert _largest_method(fx.forms(spark, SF)) < 8000
    assert _largest_method(fx.forms(spark, SF, record_id=True).select("record_id", "text")) < 8000


def test_dates_and_ids_of_odd_texts(spark):
    rng = random.Random(5)
    parts = ["วันที่", "วันที่ ", "เดือน", " เดือน ", "พ.ศ.", " พ.ศ. ", "มกราคม", "มีนาคม", "3", "12", "๑๒", "123", "2560", "๒๕๖๐", "25601", " ", "\n", " ", "x", "_",
             "1-1020-30400-50-6", "๑-1020-3040-5-6", "1-1020-30400-50-61", "-", "😀"]
    texts = ["".join(rng.choices(parts, k=rng.choice([1, 6, 14]))) for _ in range(3000)]
    texts += ["วันที่" + "3 เดือน มกราคม พ.ศ. 2560" + t for t in texts[:200]] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    every = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    dates = F.array_distinct(F.transform(every(T.DATE), T.plain_date))
    ids = F.array_distinct(every(rf"{T.WORD_LEFT}{K.PERSON_ID}{T.WORD_RIGHT}"))
    got = rows.select(T.thai_dates("t").alias("a"), dates.alias("b"), T.id_values("t").alias("c"), ids.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got)
    assert sum(bool(r.a) for r in got) > 200 and sum(bool(r.c) for r in got) > 200


def test_lines_of_odd_texts(spark):
    """Trimming, usable lines and the line that stands there again and again, as by the patterns that look at every character."""
    rng = random.Random(7)
    ends = ["\n", "\n", "\r\n", "\r", "\x0b", "\x85", " ", "\n\n"]
    words = ["a", "long line here", "LONG  line here", "x y", "  ", "　", "​", "## Page 2", "<b>", "</figure", "<FIGURE x", "</Figure>", "a > b", "สำหรับเรียกดูเท่านั้น", "�", "😀😀"]
    texts = ["".join(rng.choice(words) + rng.choice(ends[: rng.choice([1, 8])]) for _ in range(rng.choice([1, 7, 15]))) for _ in range(1500)]
    texts += ["\n".join(["the same line"] * n + [f"other line {i}" for i in range(m)]) for n in (5, 6, 9) for m in (0, 4, 11, 12, 30)] + [None, "", "\n"]
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lines = F.filter(F.transform(X.lines_of(F.regexp_replace("t", K.FIGURE_BLOCK, "")), trim), lambda x: (x != "") & ~x.startswith("## Page")
                     & ~F.lower(x).startswith("</figure") & ~(x.startswith("<") & x.endswith(">")))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("lines", X.candidate_lines("t"))
    got = rows.select("t", "lines", lines.alias("want"), X.repeats_one_line(F.col("lines")).alias("again"), X.trimmed("t").alias("trimmed"), trim("t").alias("trim")).collect()
    for r in got:
        assert r.lines == r.want and r.trimmed == r.trim
        usable = [u for u in (re.sub(r"\s", "", x).lower() for x in r.lines or ()) if len(u) >= 8]
        top = max([(usable.count(u), u) for u in usable], default=(0, ""))
        stamp = any(usable.count(u) == top[0] and all(p in u for p in K.STAMP_PHRASE) for u in usable)
        if r.t is None:
            assert r.again is None
        elif not stamp:
            assert r.again == (len(r.lines) >= 6 and len(usable) >= 6 and top[0] >= 6 and top[0] / len(usable) >= 0.35), r.t
    assert 5 < sum(bool(r.again) for r in got) < len(got) - 5


def test_trimming_asks_no_pattern(spark):
    # W03 trims each line of five readings of every page
    assert "regexp" not in _plan(spark.createDataFrame([("x",)], "t string").select(X.trimmed("t")))


def test_places_are_looked_up_once(spark):
    # the addresses are read for their distinct places and for the answer, not for every step of the search
    dim = spark.createDataFrame([(1, 11, "นครเมฆ", "เมืองเหนือ", "บ้านสวน", "10110", 1)], "province_code int, district_code int, province string, district string, subdistrict string, postal_code string, seq int")
    rows = [(1, "9 หมู่ 3 ต.บ้านสวน อ.เมืองเหนือ จ.นครเมฆ"), (2, "9 หมู่ 3  ต. บ้านสวนๆ อ.เมืองเหนือ จ.นครเมฆ "), (3, "9 หมู่ 3"), (4, "อ.เมืองเหนือ ต.บ้านสวน"), (5, " "), (6, None)]
    found = L.validate_address(spark.createDataFrame(rows, "k int, address string"), dim, "k")
    assert _plan(found).count("Scan ExistingRDD[k#") == 1
    got = {r.k: (r.issue, r.value) for r in found.collect()}
    right = "9 หมู่ 3 ต.บ้านสวน อ.เมืองเหนือ จ.นครเมฆ"
    assert got == {1: (None, right), 2: ("address_location_corrected", right), 3: ("address_location_parse_failed", rows[2][1]), 4: ("address_location_parse_failed", rows[3][1])}


def test_person_text_is_read_where_its_page_is_made(spark):
    df = QUERIES["H02_person_text"](spark, SF)
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\), (\w+)", _plan(df))
    assert moved and all(how == "REPARTITION_BY_NUM" for _, how in moved)
    assert _largest_method(QUERIES["H02_person_text"](spark, SF)) < 8000


def test_names_of_several_words_in_one_line(spark):
    lines = ["นายใจดี ทุ่งเมฆ ชาย ไทย", "1-1020-30000-00-1 สมใจ  งาม\u00a0ตา - จีน", "3 มกราคม 2500 45 ก\\ ๕ข ค"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "k int, text string")
    told = forms.page_lines(df, "k").withColumn("free", F.lit(None).cast("string"))
    got = [(r.kind, r.value) for r in forms._entities(told, "k").orderBy("place").collect()]
    assert got == [("name", "นายใจดี ทุ่งเมฆ"), ("gender", "ชาย"), ("nationality", "ไทย"), ("id", "1-1020-30000-00-1"), ("name", "สมใจ งาม ตา"), ("dash", "-"), ("nationality", "จีน"),
                   ("date", "3 มกราคม 2500"), ("age", "45"), ("name", "ก\\"), ("other", "๕ข"), ("name", "ค")]


def test_clean_and_valid_of_odd_values(spark):
    rows = [("personName", "<td>นาย&nbsp;ก\u2003ข</td>", "นาย ก ข", True), ("personName", "## ชื่อ ดี", "ดี", True), ("motherName", "tD ก", "tD ก", False), ("motherName", "ดีร์อ", "ดีร่อ", True),
            ("houseCode", "1001 - 000037+1", "1001-000037-1", True), ("address", "- 1 - 2 หมู่ 3 .", "1-2 หมู่ 3", True), ("birthDate", " 3\tพวภาคม 2500", "3 พฤษภาคม 2500", True),
            ("updateDate", "Update Date 3 มกราคม 2500", "3 มกราคม 2500", True), ("age", "อายุ 131", "131", False), ("postalCode", "x 10๑10", "10110", True), ("unknown", "ID a", "ID a", True),
            ("fatherName", "ก ต.ข", "ก ต.ข", False), ("fatherName", "ก ชาย", "ก ชาย", False), ("fatherName", None, None, False), ("remark", "ก Update Date ข", "ก", True)]
    df = spark.createDataFrame([(i, f, v) for i, (f, v, _, _) in enumerate(rows)], "i int, field string, value string")
    got = FL.with_valid(FL.with_clean(df, "field", "value", "c"), "field", "c", "ok").orderBy("i").collect()
    assert [(r.c, r.ok) for r in got] == [(c, ok) for _, _, c, ok in rows]


def test_review_is_built_where_its_form_is(spark):
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#[^)]*\), (\w+)", _plan(QUERIES["H01_build_review"](spark, SF)))
    # only the few boxes move besides
    assert {k for k, how in moved if how == "REPARTITION_BY_NUM"} == {"o_orderkey"}
    assert {k for k, how in moved if how == "ENSURE_REQUIREMENTS"} <= {"parent"}


def test_slots_and_rows_in_one_pass(spark):
    segments = fx.segments(spark, SF)
    both = B.segments_in_slots_and_rows(segments, ["k"])
    for reading, one in (("slot", B.segments_in_slot), ("row", B.segments_in_parent_row)):
        want = one(segments, ["k"]).select("k", "field", "text")
        got = both.filter(F.col("reading") == reading).select("k", "field", "text")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 0


def test_build_review_of_a_form_without_a_key(spark):
    pages = spark.createDataFrame([(None, 1, "อายุ 20"), (1, 1, "อายุ 30")], "k long, page_number int, text string")
    segments = spark.createDataFrame([(None, 1, 0, "5", [0.35, 0.33, 0.4, 0.35]), (2, 1, 0, "5", [0.35, 0.33, 0.4, 0.35])], "k long, page_number int, seg_no int, text string, bbox array<double>")
    got = {(r.k, r.field): r.value for r in BU.build_review(pages, segments, "k").collect()}
    assert len(got) == 40 and got[None, "age"] is None and got[1, "age"] == "30"


@pytest.mark.parametrize("name", ["A16_name_alternatives", "H05_rows", "H12_repair_address_number"])
def test_form_queries_are_compiled(spark, name):
    assert _largest_method(QUERIES[name](spark, SF)) < 8000


def test_pages_of_one_key_are_read_as_one(spark):
    page = "นายใจดี ทุ่งเมฆ ชาย\n3 มกราคม 2500\nละมุน - ไทย\nดำรง - จีน\n9 หมู่ 1 ต.ก อ.ข จ.ค"
    got = dict(map(tuple, forms.parse_person_text(spark.createDataFrame([(1, page), (1, page)], "k int, text string"), "k").select("field", "value").collect()))
    assert got["personName"] == "นายใจดี นายใจดี ทุ่งเมฆ ทุ่งเมฆ" and got["address"] == "9 หมู่ 1 ต.ก อ.ข จ.ค"
