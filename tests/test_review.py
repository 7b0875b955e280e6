"""Review, accuracy, store, location and correction operators on rows written by hand."""

from pyspark.sql import functions as F

import formloom.plans.catalog  # noqa: F401
from formloom import constants as K
from formloom.functions import address as A
from formloom.functions import compare as C
from formloom.functions import text as X
from formloom.operators import accuracy as AC
from formloom.operators import corrections as CO
from formloom.operators import location as L
from formloom.operators import review as V
from formloom.operators import store as ST
from formloom.plans.registry import QUERIES


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_validation_issues(spark):
    values = {"personId": "1-0000-00000-00-1", "houseCode": "1001-000037-1", "personName": "นายใจดี ทุ่งเมฆ", "gender": "ชาย", "nationality": "ไทย", "birthDate": "1 มกราคม 2500",
              "age": "๖๐", "updateDate": "2 มกราคม 2560", "motherName": "ดี", "motherId": "", "fatherName": " ดี ", "fatherId": "1-0000-00000-00-1"}
    df = spark.createDataFrame([("r", f, v, "crop_ocr" if f == "fatherName" else None, "needs_review" if f == "age" else None) for f, v in values.items()],
                               "record_id string, field string, value string, source string, review_status string")
    got = {(r.field, r.issue) for r in V.validation_issues(df).collect()}
    assert {("status", "missing_or_invalid"), ("age", "needs_review"), ("motherId", "parent_id_missing"), ("personId", "suspicious_id"), ("fatherId", "suspicious_id"), ("personId", "duplicate_id"),
            ("fatherId", "duplicate_id"), ("motherName", "duplicate_parent_name"), ("fatherName", "duplicate_parent_name"), ("motherName", "short_parent_name")} <= got
    assert ("gender", "missing_or_invalid") not in got and V.validation_issues(df.limit(0)).count() == 0
    assert {r.field for r in V.duplicate_ids(df).collect()} == {"personId", "fatherId"}


def test_quality_label(spark):
    df = spark.createDataFrame([("x" * 40, 0, False, []), ("x" * 39, 0, False, []), ("x" * 50, 1, False, []), ("x" * 50, None, True, None), ("x" * 50, None, None, ["odd line"]), (None, None, None, None)],
                               "t string, n int, e boolean, r array<string>")
    got = [r[0] for r in df.select(V.quality_label(F.col("t"), F.col("n"), F.col("e"), F.col("r"))).collect()]
    assert got == ["auto_verified", "low_confidence", "needs_review", "needs_review", "needs_review", "low_confidence"]


def test_votes(spark):
    data = [("r", "personName", 1, "ก ข", "slot"), ("r", "personName", 2, "ก  ข", "field_crop"), ("r", "personName", 3, "ค", "slot"), ("r", "motherName", 1, "สมใจ", "a"), ("r", "motherName", 2, "ละมุน", "b"),
            ("s", "motherName", 1, "กรมหนึ่ง", "a"), ("s", "motherName", 2, "ละมุน", "b"), ("s", "fatherName", 1, "  ", "a")]
    got = {(r.record_id, r.field): (r.value, r.source, r.refused) for r in V.vote(spark.createDataFrame(data, "record_id string, field string, seq long, value string, source string")).collect()}
    assert got == {("r", "personName"): ("ก ข", "slot_consensus", False), ("r", "motherName"): (None, None, True), ("s", "motherName"): ("ละมุน", "b", False)}


def test_truth(spark):
    entries = spark.createDataFrame([(1, "r1", None, None, {"personId": "๑-1", "age": " 5  6 "}), (2, "gone", "f", "1", {"age": "7"}), (3, "", "f", "2", {"age": "7"}), (4, "r1", None, None, None)],
                                    "entry_id long, record_id string, original_filename string, page_number string, expected map<string,string>")
    records = spark.createDataFrame([("r1", "f", "9", 1), ("r2", "f", "1", 2), ("r3", "f", "1", 3)], "record_id string, original_filename string, page_number string, seq long")
    values = spark.createDataFrame([("r1", "personId", "11"), ("r1", "age", "5 6"), ("r3", "age", None)], "record_id string, field string, value string")
    matched = AC.match_truth(AC.read_truth(entries), records)
    assert [(r.entry_id, r.found_id) for r in matched.orderBy("entry_id").collect()] == [(1, "r1"), (2, "r3"), (3, None)]
    compared = AC.compare_fields(matched, values)
    assert rows(AC.field_accuracy(compared)) == [("age", 1, 2, 0.5), ("personId", 1, 1, 1.0)]
    assert rows(AC.critical_accuracy(compared, ("personId", "age"))) == [(1, 1, 1.0)]


def test_issues_and_alternatives(spark):
    events = spark.createDataFrame([("r", "f", "t", "m1", "a b", 1), ("r", "f", "t", "m2", "ab", 2), ("r", "f", "t", "m3", "c", 3), ("r", "f", "u", "m4", None, 4), ("r", "f", "u", "m5", "d", 5)],
                                   "record_id string, field string, type string, message string, alternative string, seq long")
    got = {r.type: (r.message, r.alternatives) for r in V.append_issues(events).collect()}
    assert got == {"t": ("m1", ["a b", "c"]), "u": ("m4", [])}
    current = spark.createDataFrame([("r", "f", "old"), ("r", "g", None)], "record_id string, field string, value string")
    alternatives = spark.createDataFrame([("r", "f", "new", 0.5, 1), ("r", "f", "late", 0.5, 2), ("r", "f", "x", None, 3)], "record_id string, field string, value string, score double, seq long")
    assert rows(V.best_scored_value(current, alternatives)) == [("r", "f", "new", True), ("r", "g", None, False)]


def test_store(spark):
    new = spark.createDataFrame([("n1", "f1", "tr", "now", 1), ("n2", "f1", "judgment", "later", 2), ("n3", "f9", None, "now", 3)], "id string, source_fingerprint string, document_category string, seen_at string, seq long")
    old = spark.createDataFrame([("o1", "f1", "tr", "checked", "t0", None, "text", "80"), ("o2", "f2", "tr", "checked", "t0", None, "text", "80")],
                                "id string, source_fingerprint string, document_category string, status string, updated_at string, ocr_error_message string, ocr_markdown string, ocr_pipeline_version string")
    got = {r.id: (r.action, r.status, r.updated_at) for r in ST.ingest_dedup(new, old).collect()}
    assert got == {"o1": ("refresh", "checked", "now"), "o2": ("keep", "checked", "t0"), "n3": ("insert", "ocr_queued", "now")}
    docs = spark.createDataFrame([("k", "x", " y"), (None, "y", None), (" ", None, "no")], "_id string, id string, save_btn string")
    stored = ST.write_rows(docs, "jobs")
    assert rows(stored.select("record_key", "save_btn", "refused")) == [("", "N", True), ("k", "Y", False), ("y", "N", False)]
    assert rows(ST.read_rows(stored.filter("not refused"), "jobs", "id string")) == [("k", "x"), ("y", "y")]
    assert ST.read_rows(stored, "imports", "id string").count() == 0


def test_location(spark):
    provinces = spark.createDataFrame([(1, "นครเมฆา"), (2, "ผาตะวัน")], "province_code int, province string")
    districts = spark.createDataFrame([(10, 1, "ท่าน้ำใส"), (20, 2, "ท่าน้ำใส")], "district_code int, province_code int, district string")
    subs = spark.createDataFrame([(1, 10, "บ้านสวนใหญ่", "10", 1), (1, 10, "ป่าไผ่", "10", 2), (2, 20, "บ้านสวนใหญ่", "20", 3), (1, 10, " ", "10", 4)], "province_code int, district_code int, subdistrict string, postal_code string, seq long")
    dim = L.location_dim(provinces, districts, subs)
    assert dim.count() == 3
    asked = spark.createDataFrame([(1, "จ.นครเมฆา", "ท่าน้ำใส", "บ้านสวนใหญ่"), (2, "นครเมฆา", "ท่าน้ำใส", "บ้านสวนใหxx"), (3, "นครเมฆา", "ท่าน้ำใส", "อื่นๆ"), (4, "ไกลมาก", "ท่าน้ำใส", "ป่าไผ่"), (5, None, "", "ป่าไผ่")], "k int, p string, d string, s string")
    got = {r.k: (r.subdistrict, r.postal_code, r.confidence) for r in L.best_location(asked, dim).collect()}
    assert got[1] == ("บ้านสวนใหญ่", "10", 1.0) and got[2] == ("บ้านสวนใหญ่", "10", 0.82) and got[3][0] is None and got[4][0] is None and got.get(5, (None,))[0] is None


def test_corrections(spark):
    changes = spark.createDataFrame([(f"r{i}", "motherName" if i % 2 else "fatherName", "ทอง ดี", "คำ ดี", i) for i in range(8)] + [("x", "age", "ทอง", "คำ", 9), ("y", "motherName", "ทอง ดี", "คำ", 10)],
                                    "record_id string, field string, before string, after string, seq long")
    learned = CO.learn_corrections(changes)
    row = learned.first()
    assert learned.count() == 1 and row["count"] == 8 and row.fields == ["fatherName", "motherName"] and [e.seq for e in row.examples] == [7, 6, 5, 4, 3]
    entries = spark.createDataFrame([("ทอง", "คำ", None, 1), ("ทอง", "เงิน", True, 2), ("ดี", "งาม", False, 3), ("ก", "ข7", True, 4)], "source string, replacement string, enabled boolean, seq long")
    dictionary = CO.read_corrections(entries)
    assert rows(dictionary) == [("ทอง", "เงิน")]
    values = spark.createDataFrame([("r", "motherName", "ทอง  ดี"), ("s", "motherName", None)], "record_id string, field string, value string")
    assert rows(CO.apply_dictionary(values, dictionary)) == [("r", "motherName", "เงิน ดี", ["ทอง>เงิน"]), ("s", "motherName", "", [])]


def test_address_overflow_is_seen(spark):
    df = spark.createDataFrame([("1 หมู่ 2 ถนน " + "ก" * 40 + " ต.บ้าน อ.เมือง จ.นคร 10110",), (None,)], "a string").transform(lambda d: A.with_split_address(d, "a", "x")).select("x.*")
    a, b = df.collect()
    assert a.overflow == "road" and len(a.road) == 30 and a.province == "นคร" and a.postal_code == "10110" and b.address1 is None and b.overflow is None


def test_rules(spark):
    one = spark.createDataFrame([("ก ข", "ก ข ค")], "a string, b string")
    plain, gated = one.select(C.accept_reader_value(F.lit("personName"), "a", "b"), C.accept_reader_value(F.lit("personName"), "a", "b", ("personName",))).first()
    assert plain and not gated
    line = spark.createDataFrame([('```\nx "y"\n```',), ("",), (None,)], "t string").select(X.single_line("t").alias("l")).collect()
    assert [r.l for r in line] == ['x "y"', "", None]
    assert len(K.REQUIRED_FIELDS) == 9


def test_edit_ratio_in_bytes(spark):
    pairs = [("éa", "ea"), ("ab", "ba"), ("กข", "คง"), ("", "a")]
    df = spark.createDataFrame(pairs, "a string, b string").select(C.edit_ratio("a", "b").alias("r"), C.edit_ratio("a", "b", in_bytes=True).alias("s"))
    assert [(r.r, r.s) for r in df.collect()] == [(0.5, 0.0), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_unwrap_of_one_very_long_line(spark):
    long = '"' + "ab {} <i> " * 40_000 + '"'
    texts = ["```json\n{\"text\": " + long + "}\n```", "```\n```", "```x\n\na\n b\n```", "```\nonly```", "{\"page\": 1 \"text\": \"a\\nb\"}", "[1]", "<FIGURE>x</FIGURE>\ny", "{\"text\": \" \", \"result\": \"r\"}"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.unwrap_response("t").alias("v")).collect()]
    fences = spark.createDataFrame([("```x\n\na\n b\n```",), ("```\n```",), ("```\na```",)], "t string").select(X.unwrap_fence("t").alias("v"))
    assert [r.v for r in fences.collect()] == ["a\n b", "", ""]
    assert got == [long[1:-1].strip(), "```\n```", "```x\n\na\n b\n```", "```\nonly```", "a\nb", "[1]", "y", "r"]


def test_unwrap_gives_back_blank_missing_and_escaped_texts(spark, tmp_path):
    texts = ["", " \n ", None, "C:\\new\\table", "a\\\\nb", 'ends "', '"starts', "}x}", 'a"} b', "x\\", "\n a \\ \n"]
    docs = [(5 * i + way, t) for i, t in enumerate(texts) for way in range(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, QUERIES["F17_unwrap_response"](spark, str(tmp_path)).collect()))
    assert got == {i: None if t is None else t.strip() for i, t in docs}
    odd = ['{"text": "", "page": 1}', '{"text": null}', 'says "text" only', '{"a": ""}']
    found = spark.createDataFrame([(t,) for t in odd], "t string").select(X.unwrap_response("t").alias("v")).collect()
    assert [r.v for r in found] == ["", "null", 'says "text" only', '{"a": ""}']
