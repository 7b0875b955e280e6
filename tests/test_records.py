"""Record operators on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from formloom.operators import records as R

RECORD = "record_id string, batch_id string, record_no string, pos_key long, ocr_status string, review_status string, assigned_to_user_id string, assigned_to_username string"


def records(spark, rows):
    return spark.createDataFrame([dict(zip([c.split()[0] for c in RECORD.split(", ")], r, strict=True)) for r in rows], RECORD)


def test_batches_with_many_empty_files(spark):
    rows = [("b", f"f{i}", i, f"x{i}.pdf", "application/pdf", "TR", 0) for i in range(150)]
    rows += [("b", f"g{i}", 200 + i, "y.pdf", None, "tr", 50) for i in range(4)] + [("c", "h", 1, "z.png", "", None, None)]
    files = spark.createDataFrame(rows, "batch_id string, file_id string, file_seq long, original_filename string, content_type string, document_type string, page_count int")
    got = {r.batch_id: r for r in R.validate_batch(files).collect()}
    assert got["b"].first_over == "g2" and got["b"].total_pages == 200 and got["b"].reasons == "too_many_files,too_many_records"
    assert got["c"].reasons == "type,not_pdf" and got["c"].total_pages == 0 and got["c"].first_over is None


def test_listing_limits_are_honoured_or_refused(spark):
    docs = spark.createDataFrame([(str(i), i, None, f"2024-{i:04d}") for i in range(700)], "id string, seq long, document_category string, updated_at string")
    assert R.list_documents(docs, None, 500).count() == 500
    with pytest.raises(ValueError):
        R.list_documents(docs, None, 501)


def test_numbers_given_and_made(spark):
    rows = [(f"r{i}", "B", no, i, "succeeded", "unassigned", None, None) for i, no in enumerate(["", "TR-B-0001", "TR-B-0002", "x", " x ", "TR-B-0009", "TR-B-0005", None], 1)]
    got = {r.record_id: r.record_no for r in R.record_numbers(records(spark, rows), ["pos_key"], F.floor(F.col("pos_key") / 3)).collect()}
    want, seen = {}, set()
    for i, (rid, _, no, *_) in enumerate(rows, 1):
        no = (no or "").strip()
        if not no or no in seen:
            no = f"TR-B-{i:04d}"
        seen.add(no)
        want[rid] = no
    assert got == want and got["r2"] == "TR-B-0002" and got["r3"] == "TR-B-0003"


@pytest.mark.parametrize("limit", [20_000, 10, 0])
def test_numbers_of_batches_that_are_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(R, "BATCH_ROWS", limit)
    # chains: number i spells i - 3, so each row depends on the third before it
    spells = lambda b, i: "" if i in (1, 12) else f"TR-{b}-{i - 3:04d}" if i % 2 and i > 3 else f" x{i % 5}" if i % 7 else None
    rows = [(f"{b}{i}", b, spells(b, i), i, "succeeded", "unassigned", None, None) for b, n in (("A", 17), ("B", 9), ("C", 1)) for i in range(1, n + 1)]
    got = {r.record_id: (r.pos, r.record_no) for r in R.record_numbers(records(spark, rows).repartition(3), ["pos_key"], F.floor(F.col("pos_key") / 4)).collect()}
    want, seen = {}, set()
    for rid, b, no, i, *_ in rows:
        no = (no or "").strip()
        no = f"TR-{b}-{i:04d}" if not no or (b, no) in seen else no
        seen.add((b, no))
        want[rid] = (i, no)
    assert got == want


def test_natural_order_of_long_digit_runs(spark):
    names = ["a9.pdf", "a10.pdf", "a010.pdf", "a" + "9" * 25 + ".pdf", "a1" + "0" * 25 + ".pdf"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "f string, p int").withColumn("key", R.natural_key("f", F.lit(1)))
    key = {r.f: r.key for r in df.collect()}
    assert key[names[0]] < key[names[1]] == key[names[2]] < key[names[3]] < key[names[4]]


def test_pages_of_a_listing(spark):
    rows = [(f"r{i:03d}", "B", "", i, "succeeded", "unassigned", None, None) for i in range(95)]
    page = lambda n: [r.record_id for r in R.page_of(records(spark, rows).repartition(5), ["pos_key"], F.floor(F.col("pos_key") / 7), n, 20).collect()]
    assert sorted(page(3)) == [f"r{i:03d}" for i in range(40, 60)] and len(page(5)) == 15 and page(6) == []


def test_assignment_refuses_batches_with_too_few(spark):
    rows = [(f"r{b}{i}", b, "", i, "succeeded", "unassigned", None, None) for b in "ab" for i in range(3)]
    rows += [("n1", "none", "", 1, "failed", "unassigned", None, None), ("n2", "none", "", 2, "succeeded", "unassigned", " x", None)]
    done = R.assign_first_n(records(spark, rows[1:]), 3, "u1", "", ["pos_key"], F.lit(0)).collect()
    assert sorted((r.batch_id, r.record_id or "", r.outcome) for r in done) == [
        ("a", "", "rejected: 2 ready"), ("b", "rb0", "assigned"), ("b", "rb1", "assigned"), ("b", "rb2", "assigned"), ("none", "", "rejected: 0 ready")]
    assert {(r.assigned_to_user_id, r.assigned_to_username) for r in done if r.outcome == "assigned"} == {("u1", "u1")}


def test_requests_are_all_or_nothing(spark):
    rows = [("r1", "b", "", 1, "succeeded", "unassigned", None, None), ("r2", "b", "", 2, "failed", "unassigned", None, None)]
    want = spark.createDataFrame([("q1", " r1 ", 1), ("q1", "r1", 2), ("q1", "", 3), ("q2", "r1", 1), ("q2", "r2", 2), ("q3", "nil", 1), ("q3", None, 2)], "request_id string, record_id string, seq long")
    got = {(r.request_id, r.record_id): (r.outcome, r.accepted) for r in R.select_records(records(spark, rows), want).collect()}
    assert got == {("q1", "r1"): ("ready", True), ("q2", "r1"): ("ready", False), ("q2", "r2"): ("blocked", False), ("q3", "nil"): ("missing", False)}


def test_own_records_by_id_or_name(spark):
    rows = [("r1", "b", "", 1, "x", "y", "ann", None), ("r2", "b", "", 2, "x", "y", None, "u1"), ("r3", "b", "", 3, "x", "y", "", ""), ("r4", "b", "", 4, "x", "y", "u1", "ann")]
    users = spark.createDataFrame([("u1", "ann"), ("", ""), ("u2", None)], "user_id string, username string")
    assert sorted((r.user_id, r.record_id) for r in R.my_records_by_table(records(spark, rows), users).collect()) == [("u1", "r1"), ("u1", "r2"), ("u1", "r4")]


def test_actions_in_order(spark):
    state = spark.createDataFrame(
        [("r1", "succeeded", "unassigned", None, None, None, "old", None, "text", "N"), ("r2", "succeeded", "assigned", None, "ann", None, None, "result", "text", None),
         ("r3", "failed", "assigned", "u1", None, None, None, None, None, None)],
        "record_id string, ocr_status string, review_status string, assigned_to_user_id string, assigned_to_username string, x string, saved_edits string, ocr_result string, ocr_text string, save_btn string").drop("x")
    acts = [("r1", 1, "save", "e", 0), ("r1", 2, "assign", None, 0), ("r1", 3, "assign", None, 0), ("r1", 4, "save", "mine", 0), ("r1", 5, "complete", None, 2), ("r1", 6, "complete", None, 0), ("r1", 7, "complete", "late", 0),
            ("r1", 8, "save", "late", 0), ("r2", 1, "complete", None, 0), ("r2", 2, "complete", None, 0), ("r3", 1, "save", "e", 0), ("r9", 1, "save", "e", 0), ("r2", 3, "erase", None, 0)]
    actions = spark.createDataFrame([(r, s, a, "u1", "ann", e, u) for r, s, a, e, u in acts], "record_id string, seq long, action string, user_id string, username string, edits string, unresolved int")
    got = {(r.record_id, r.seq): (r.reason, r.result) for r in R.apply_actions(state, actions).collect()}
    assert got == {
        ("r1", 1): ("not assigned to user", None), ("r1", 2): (None, "old"), ("r1", 3): ("not ready to assign", None), ("r1", 4): (None, "mine"), ("r1", 5): ("fields need review", None),
        ("r1", 6): (None, "mine"), ("r1", 7): ("already completed", None), ("r1", 8): ("completed records cannot be edited", None), ("r2", 1): (None, "result"), ("r2", 2): ("already completed", None),
        ("r3", 1): ("not read yet", None), ("r9", 1): ("record not found", None), ("r2", 3): ("unknown action", None)}


def test_pages_of_files_without_pages(spark):
    rows = [("b", "f1", 1, "a.pdf", 0), ("b", "f2", 2, "b.pdf", 2), ("b", "f3", 3, "c.pdf", None), ("b", "f4", 4, "", 1)]
    files = spark.createDataFrame(rows, "batch_id string, file_id string, file_seq long, original_filename string, page_count int")
    assert sorted((r.record_id, r.record_no) for r in R.page_records(files).collect()) == [("f2-1", "TR-B-0001"), ("f2-2", "TR-B-0002"), ("f4-1", "TR-B-0003")]
    assert sorted((r.file_id, r.reason) for r in R.pageless_files(files).collect()) == [("f1", "no pages"), ("f3", "unknown page count")]


def test_upsert_writes_nulls_and_replaces(spark):
    now = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, s string, n int")
    new = spark.createDataFrame([("a", None), ("c", "z")], "id string, s string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(R.upsert(now, new, "id")) == [("a", None, 1), ("b", "y", 2), ("c", "z", None)]
    assert rows(R.upsert(now, new, "id", insert=False)) == [("a", None, 1), ("b", "y", 2)]
    assert rows(R.upsert(now, new, "id", insert=False, replace=True)) == [("a", None, None), ("b", "y", 2)]


def test_assignee_by_a_name_that_many_have(spark):
    staff = spark.range(400).selectExpr("concat('u', id) AS user_id", "CASE WHEN id < 399 THEN 'same' END AS username", "1000 - id AS ord")
    requests = spark.range(300).selectExpr("id AS request_id", "CASE WHEN id = 7 THEN 'u5' WHEN id = 8 THEN 'u399' END AS req_id", "'same' AS req_name")
    assert [tuple(r) for r in R.earliest(staff.filter("username is not null"), "username").collect()] == [("u398", "same", 602)]
    got = {r.request_id: (r.user_id, r.username) for r in R.resolve_assignee(requests, staff, "boss", "boss").collect()}
    assert len(got) == 300 and got.pop(8) == ("u399", None) and set(got.values()) == {("u398", "same")}
