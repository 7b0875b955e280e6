"""Queries of the record bookkeeping operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import fixtures as fx
from formloom.functions import text as X
from formloom.operators import records as R
from formloom.plans.registry import query
from formloom.session import dealt, table

REC = f"WITH rec AS ({fx.RECORDS_SQL}) "
FIL = f"WITH fil AS ({fx.FILES_SQL}) "
DOC = f"WITH doc AS ({fx.DOCS_SQL}) "
EVT = f"WITH evt AS ({fx.EVENTS_SQL}) "
READY = ("ocr_status = 'succeeded' AND review_status = 'unassigned' AND trim(coalesce(assigned_to_user_id,'')) = ''"
         " AND trim(coalesce(assigned_to_username,'')) = ''")
FORM_CAT = "coalesce(lower(trim(document_category)) IN ('tr','tor_ror'), false)"

COUNTERS = """count(*) AS record_count,
 count(*) FILTER (ocr_status = 'pending') AS ocr_pending_count,
 count(*) FILTER (ocr_status = 'processing') AS ocr_processing_count,
 count(*) FILTER (ocr_status = 'succeeded') AS ocr_succeeded_count,
 count(*) FILTER (ocr_status = 'failed') AS ocr_failed_count,
 count(*) FILTER (ocr_status = 'succeeded' AND review_status = 'unassigned') AS ready_to_assign_count,
 count(*) FILTER (review_status = 'assigned') AS assigned_count,
 count(*) FILTER (review_status = 'unassigned') AS unassigned_count,
 count(*) FILTER (review_status = 'in_review') AS in_review_count,
 count(*) FILTER (review_status = 'completed') AS completed_count"""


@query("A01_batch_counts", REC + f"SELECT batch_id, {COUNTERS} FROM rec GROUP BY batch_id")
def a01(spark, sf):
    return R.batch_counts(fx.review_records(spark, sf))


@query("A02_batch_status", REC + f"""SELECT batch_id, CASE WHEN ocr_pending_count + ocr_processing_count > 0 THEN 'ocr_processing'
 WHEN ocr_failed_count > 0 AND ocr_succeeded_count > 0 THEN 'partially_failed' WHEN ocr_failed_count > 0 THEN 'failed'
 WHEN ocr_succeeded_count > 0 THEN 'ocr_completed' ELSE 'records_created' END AS status
 FROM (SELECT batch_id, {COUNTERS} FROM rec GROUP BY batch_id)""")
def a02(spark, sf):
    return R.batch_counts(fx.review_records(spark, sf)).select("batch_id", R.batch_status().alias("status"))


@query("A03_dashboard_totals", REC + f"""SELECT batch_id, count(DISTINCT file_id) AS file_count, {COUNTERS}
 FROM rec GROUP BY ROLLUP (batch_id)""")
def a03(spark, sf):
    return R.dashboard_totals(fx.review_records(spark, sf))


@query("A03_dashboard_summary", f"""WITH rec AS ({fx.RECORDS_SQL}), fil AS ({fx.FILES_SQL}),
 b AS (SELECT batch_id FROM rec UNION SELECT batch_id FROM fil)
 SELECT (SELECT count(*) FROM b) AS batch_count, (SELECT count(*) FROM fil) AS file_count, (SELECT sum(page_count) FROM fil)::BIGINT AS total_pages, r.*
 FROM (SELECT {COUNTERS} FROM rec) r""")
def a03s(spark, sf):
    return R.dashboard_summary(fx.review_records(spark, sf), fx.uploaded_files(spark, sf))


@query("A03_dashboard_records", REC + """SELECT record_id, record_no, batch_id, file_id, original_filename, selected_document_type, page_number,
 ocr_status, review_status, ocr_error, assigned_to_user_id, assigned_to_username, assigned_at, created_at FROM rec""")
def a03r(spark, sf):
    return R.dashboard_records(fx.review_records(spark, sf))


@query("A04_staff_stats", REC + """SELECT assigned_to_user_id, count(*) AS total,
 count(*) FILTER (review_status <> 'completed') AS in_progress, count(*) FILTER (review_status = 'completed') AS completed
 FROM rec WHERE trim(coalesce(assigned_to_user_id, '')) <> '' GROUP BY 1""")
def a04(spark, sf):
    return R.staff_stats(fx.review_records(spark, sf))


@query("A05_document_stats", DOC + """SELECT count(*) AS total,
 count(*) FILTER (status IN ('uploaded','ocr_queued','cleaning','ocr_running')) AS running,
 count(*) FILTER (status IN ('ready_for_review','review_ready')) AS review,
 count(*) FILTER (status = 'checked') AS completed, count(*) FILTER (status = 'ocr_failed') AS failed FROM doc""")
def a05(spark, sf):
    return R.document_stats(fx.import_documents(spark, sf))


@query("A14_record_errors", REC + """SELECT batch_id, record_id, file_id, original_filename, page_number, trim(ocr_error) AS error
 FROM rec WHERE trim(coalesce(ocr_error,'')) <> ''""")
def a14(spark, sf):
    return R.record_errors(fx.review_records(spark, sf))


@query("A19_stage_timings", REC + """, long AS (
 SELECT batch_id, 'read' AS stage, read_ms AS ms FROM rec UNION ALL SELECT batch_id, 'parse', parse_ms FROM rec
 UNION ALL SELECT batch_id, 'validate', validate_ms FROM rec)
 SELECT batch_id, stage, count(*) AS n, round(sum(ms), 4) AS total_ms, max(ms) AS max_ms FROM long GROUP BY 1, 2""")
def a19(spark, sf):
    from formloom.operators.quality import stage_timings

    rec = fx.review_records(spark, sf)
    stages = F.create_map(F.lit("read"), "read_ms", F.lit("parse"), "parse_ms", F.lit("validate"), "validate_ms")
    return stage_timings(rec.select("batch_id", stages.alias("stages_ms")))


@query("A19_record_timings", REC + "SELECT record_id, round(coalesce(read_ms, 0) + coalesce(parse_ms, 0) + coalesce(validate_ms, 0), 4) AS total_ms FROM rec")
def a19r(spark, sf):
    from formloom.operators.quality import record_timings

    rec = fx.review_records(spark, sf)
    stages = F.create_map(F.lit("read"), "read_ms", F.lit("parse"), "parse_ms", F.lit("validate"), "validate_ms")
    return record_timings(rec.select("record_id", stages.alias("stages_ms")))


@query("P01_match", DOC + """SELECT id, status, document_category FROM doc
 WHERE status IN ('checked','ocr_failed') AND (document_category = 'tr' OR document_category IS NULL OR document_category = '')
   AND ocr_markdown IS NOT NULL""")
def p01(spark, sf):
    cond = R.match({
        "status": {"$in": ["checked", "ocr_failed"]},
        "$or": [{"document_category": "tr"}, {"document_category": None}, {"document_category": ""}],
        "ocr_markdown": {"$exists": True},
        "total_pages": {"$gt": 1},  # unknown operator: always passes
    })
    return fx.import_documents(spark, sf).filter(cond).select("id", "status", "document_category")


@query("P02_project", DOC + "SELECT id, status, total_pages FROM doc")
def p02(spark, sf):
    return R.project(fx.import_documents(spark, sf), {"status": 1, "total_pages": 1, "text": 0}, key="id")


@query("P03_list_documents", DOC + """SELECT id, document_category, updated_at FROM doc
 WHERE coalesce(nullif(document_category, ''), 'uncategorized') = 'uncategorized' ORDER BY updated_at DESC, seq LIMIT 50""")
def p03(spark, sf):
    return R.list_documents(fx.import_documents(spark, sf), " Uncategorized", 50).select("id", "document_category", "updated_at")


@query("P04_pending_queue", DOC + """SELECT id, CASE WHEN status IN ('cleaning','ocr_running') THEN 'ocr_queued' ELSE status END AS status,
 updated_at FROM doc WHERE status IN ('uploaded','ocr_queued','cleaning','ocr_running') ORDER BY doc.updated_at, seq LIMIT 100""")
def p04(spark, sf):
    return R.pending_queue(fx.import_documents(spark, sf), 100).select("id", "status", "updated_at")


@query("P05_latest_jobs", DOC + "SELECT id, created_at FROM doc ORDER BY created_at DESC, seq LIMIT 12")
def p05(spark, sf):
    return R.latest_jobs(fx.import_documents(spark, sf), 12).select("id", "created_at")


NEEDS = f"""CASE WHEN status IN ('cleaning','ocr_running') THEN false
 WHEN status = 'checked' AND coalesce(ocr_markdown,'') <> '' AND coalesce(ocr_error_message,'') = '' THEN false
 WHEN status IN ('uploaded','ocr_queued','ocr_failed') THEN true
 WHEN coalesce(ocr_error_message,'') <> '' OR trim(coalesce(ocr_markdown,'')) = '' THEN true
 ELSE coalesce(try_cast(ocr_pipeline_version AS INT), 0) < CASE WHEN {FORM_CAT} THEN 80 ELSE 71 END END"""


@query("P06_needs_processing", DOC + f"SELECT id, {NEEDS} AS needs FROM doc")
def p06(spark, sf):
    return fx.import_documents(spark, sf).select("id", R.needs_processing().alias("needs"))


@query("P07_stale_reviews", DOC + f"""SELECT id, CASE WHEN NOT {FORM_CAT} THEN 'skip'
 WHEN coalesce(review_version, 0) >= 9 THEN 'reuse' ELSE 'rebuild' END AS action FROM doc""")
def p07(spark, sf):
    return R.stale_reviews(fx.import_documents(spark, sf)).select("id", "action")


@query("P08_validate_batch", FIL + """, base AS (SELECT *, regexp_extract(lower(original_filename), '(\\.[^./]+)$', 1) = '.pdf'
   AND lower(content_type) IN ('','application/pdf','application/x-pdf','application/octet-stream') AS is_pdf,
   upper(trim(document_type)) <> 'TR' AS wt,
   sum(coalesce(page_count, 0)) OVER (PARTITION BY batch_id ORDER BY file_seq) AS running FROM fil),
 agg AS (SELECT batch_id, count(*) AS file_count, CAST(coalesce(sum(page_count), 0) AS BIGINT) AS total_pages, max(coalesce(page_count, 0)) AS max_pages,
   bool_and(is_pdf) AS all_pdf, bool_or(wt) AS wt, min(file_seq) FILTER (running > 100) AS fo FROM base GROUP BY batch_id)
 SELECT batch_id, file_count, total_pages, max_pages, concat_ws(',', CASE WHEN wt THEN 'type' END,
   CASE WHEN file_count > 20 THEN 'too_many_files' END, CASE WHEN NOT all_pdf THEN 'not_pdf' END,
   CASE WHEN max_pages > 50 THEN 'file_too_long' END, CASE WHEN total_pages > 100 THEN 'too_many_records' END) AS reasons,
   'F' || CAST(fo AS VARCHAR) AS first_over FROM agg""")
def p08(spark, sf):
    return R.validate_batch(fx.uploaded_files(spark, sf))


@query("P09_ready_to_assign", REC + f"SELECT record_id, coalesce({READY}, false) AS ready FROM rec")
def p09(spark, sf):
    return fx.review_records(spark, sf).select("record_id", F.coalesce(R.ready_to_assign(), F.lit(False)).alias("ready"))


def _search_sql(cols: str, needle: str) -> str:
    return f"lower(concat_ws(' ', {cols})) LIKE '%{needle}%'"


P10_COLS = ("nullif(record_no,''), record_id, original_filename, 'page ' || page_number, CAST(page_number AS VARCHAR),"
            " selected_document_type, ocr_status, review_status, nullif(assigned_to_username,'')")
P11_COLS = ("nullif(record_no,''), record_id, original_filename, 'page ' || page_number, CAST(page_number AS VARCHAR),"
            " review_status, ocr_status")


@query("P10_dashboard_filter", REC + f"""SELECT record_id FROM rec WHERE review_status = 'unassigned' AND ocr_status = 'succeeded'
 AND {_search_sql(P10_COLS, 'page 2')}""")
def p10(spark, sf):
    return R.dashboard_filter(fx.review_records(spark, sf), "review", " Page 2 ").select("record_id")


@query("P11_staff_queue_filter", REC + f"SELECT record_id FROM rec WHERE review_status <> 'completed' AND {_search_sql(P11_COLS, 'form 1')}")
def p11(spark, sf):
    return R.staff_queue_filter(fx.review_records(spark, sf), "pending", "FORM 1").select("record_id")


@query("P12_document_filter", DOC + """SELECT id, status FROM doc WHERE (lower(source_filename) LIKE '%src1%'
 OR coalesce(lower(document_category) LIKE '%src1%', false)) AND status IN ('ready_for_review','review_ready')""")
def p12(spark, sf):
    return R.document_filter(fx.import_documents(spark, sf), "SRC1", "review").select("id", "status")


@query("P13_my_records", """WITH rec AS (%s), usr AS (SELECT 'u' || CAST(s_suppkey AS VARCHAR) AS user_id,
 'staff' || CAST(CASE WHEN s_suppkey %% 5 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS VARCHAR) AS username FROM supplier)
 SELECT DISTINCT user_id, record_id FROM usr JOIN rec ON user_id IN (assigned_to_user_id, assigned_to_username) OR username IN (assigned_to_user_id, assigned_to_username)""" % fx.RECORDS_SQL)
def p13(spark, sf):
    users = table(spark, sf, "supplier").selectExpr(
        "concat('u', CAST(s_suppkey AS STRING)) AS user_id",
        "concat('staff', CAST(CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey + 1 ELSE s_suppkey END AS STRING)) AS username",
    )
    return R.my_records_by_table(fx.review_records(spark, sf), users).select("user_id", "record_id")


@query("P14_select_for_rerun", REC + """SELECT record_id, page_number, CASE WHEN page_number IN (2, 3) THEN 'pending' ELSE ocr_status END AS ocr_status,
 CASE WHEN page_number IN (2, 3) THEN NULL ELSE ocr_error END AS ocr_error,
 CASE WHEN page_number IN (2, 3) THEN NULL ELSE ocr_quality END AS ocr_quality FROM rec""")
def p14(spark, sf):
    return R.select_for_rerun(fx.review_records(spark, sf), [2, 3]).select(
        "record_id", "page_number", "ocr_status", "ocr_error", "ocr_quality"
    )


@query("P15_batch_errors", f"""WITH fil AS ({fx.FILES_SQL}), rec AS ({fx.RECORDS_SQL})
 SELECT batch_id, file_id AS item, 'file' AS kind FROM fil WHERE coalesce(error_message, '') <> '' OR page_count > 50
 UNION ALL SELECT batch_id, record_id, 'record' FROM rec WHERE ocr_status = 'failed' AND coalesce(ocr_error, '') <> ''""")
def p15(spark, sf):
    files = R.batch_file_errors(fx.uploaded_files(spark, sf)).selectExpr("batch_id", "file_id AS item", "'file' AS kind")
    recs = R.batch_record_errors(fx.review_records(spark, sf)).selectExpr("batch_id", "record_id AS item", "'record' AS kind")
    return files.unionByName(recs)


# --- numbering, assignment, state ------------------------------------------------

ORDER = ["file_seq", "page_number", "part_seq", "staff_seq"]
ORDER_SQL = "file_seq, page_number, part_seq, staff_seq"


@query("W01_record_numbers", f"""WITH RECURSIVE rec AS ({fx.RECORDS_SQL}), placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY {ORDER_SQL}) AS pos,
   trim(coalesce(record_no, '')) AS given FROM rec),
 gen AS (SELECT *, 'TR-' || upper(substr(regexp_replace(batch_id, '[^A-Za-z0-9]+', '', 'g'), 1, 6)) || '-' ||
   lpad(CAST(pos AS VARCHAR), CAST(greatest(4, length(CAST(pos AS VARCHAR))) AS INT), '0') AS made FROM placed),
 walk AS (
   SELECT batch_id, record_id, pos, CASE WHEN given = '' THEN made ELSE given END AS no, [CASE WHEN given = '' THEN made ELSE given END] AS seen FROM gen WHERE pos = 1
   UNION ALL
   SELECT g.batch_id, g.record_id, g.pos, CASE WHEN given = '' OR list_contains(seen, given) THEN made ELSE given END,
     list_append(seen, CASE WHEN given = '' OR list_contains(seen, given) THEN made ELSE given END)
   FROM walk JOIN gen g ON g.batch_id = walk.batch_id AND g.pos = walk.pos + 1)
 SELECT record_id, pos, no AS record_no FROM walk""")
def w01(spark, sf):
    numbered = R.record_numbers(fx.review_records(spark, sf, by="batch_id"), ORDER, F.floor(F.col("file_seq") / 4096))
    return numbered.select("record_id", "pos", "record_no")


@query("W02_assign_first_n", REC + f""", n AS (SELECT batch_id, count(*) FILTER (coalesce({READY}, false)) AS n FROM rec GROUP BY batch_id),
 ready AS (SELECT record_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY {ORDER_SQL}) AS rn FROM rec WHERE {READY})
 SELECT ready.batch_id, record_id, 'assigned' AS outcome FROM ready JOIN n ON n.batch_id = ready.batch_id WHERE n >= 3 AND rn <= 3
 UNION ALL SELECT batch_id, CAST(NULL AS VARCHAR), 'rejected: ' || CAST(n AS VARCHAR) || ' ready' FROM n WHERE n < 3""")
def w02(spark, sf):
    done = R.assign_first_n(fx.review_records(spark, sf), 3, "u7", "staff7", ORDER, F.floor(F.col("file_seq") / 4096))
    return done.select("batch_id", "record_id", "outcome")


@query("W04_latest_state", EVT + """SELECT record_id, ts, seq, status FROM evt
 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY ts DESC, seq DESC) = 1""")
def w04(spark, sf):
    ev = fx.state_events(spark, sf).select("record_id", "ts", "seq", "status")
    return R.latest_state(ev, ["record_id"], ["ts", "seq"])


@query("W10_natural_order", REC + """SELECT record_id, concat_ws('|',
  CASE WHEN regexp_matches(original_filename, '^[0-9]{14}') THEN substr(original_filename,5,4) || substr(original_filename,3,2)
    || substr(original_filename,1,2) || substr(original_filename,9,6) ELSE '99999999999999' END,
  array_to_string(list_transform(regexp_extract_all(lower(original_filename), '([0-9]+|[^0-9]+)', 1),
    lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CAST(length(regexp_replace(r, '^0+([0-9])', '\\1')) AS VARCHAR), 6, '0') || regexp_replace(r, '^0+([0-9])', '\\1') ELSE r END), ''),
  lpad(CAST(page_number AS VARCHAR), 10, '0')) AS sort_key FROM rec""")
def w10(spark, sf):
    return fx.review_records(spark, sf).select("record_id", R.natural_key("original_filename", "page_number").alias("sort_key"))


@query("W11_page_of", REC + f"SELECT record_id, file_seq, page_number FROM rec ORDER BY {ORDER_SQL} OFFSET 40 LIMIT 20")
def w11(spark, sf):
    return R.page_of(fx.review_records(spark, sf), ORDER, F.floor(F.col("file_seq") / 4096), 3, 20).select("record_id", "file_seq", "page_number")


# --- joins and sets ------------------------------------------------------------------

# requested ids: one per part, some unknown, some padded, some repeated
WANTED_COLUMNS = [
    ("record_id", "CASE WHEN l_partkey % 11 = 0 THEN concat('missing-', CAST(l_partkey % 60 AS STRING))"
                  " ELSE concat(' R', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING),"
                  " '-', CAST(l_suppkey AS STRING)) END"),
    ("seq", "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber"),
    ("request_id", "l_orderkey * 4 + l_partkey % 4"),
]
WANTED = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in WANTED_COLUMNS) + " FROM lineitem"


def _wanted(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {a}" for a, e in WANTED_COLUMNS])


@query("J04_select_records", f"""WITH rec AS ({fx.RECORDS_SQL}), want AS ({WANTED}),
 ids AS (SELECT request_id, trim(record_id) AS record_id, min(seq) AS seq FROM want WHERE trim(record_id) <> '' GROUP BY 1, 2),
 o AS (SELECT request_id, ids.record_id, CASE WHEN rec.record_id IS NULL THEN 'missing' WHEN coalesce({READY}, false) THEN 'ready' ELSE 'blocked' END AS outcome
   FROM ids LEFT JOIN rec ON rec.record_id = ids.record_id)
 SELECT request_id, record_id, outcome, bool_and(outcome = 'ready') OVER (PARTITION BY request_id) AS accepted FROM o""")
def j04(spark, sf):
    return R.select_records(fx.review_records(spark, sf), _wanted(spark, sf)).select("request_id", "record_id", "outcome", "accepted")


STAFF_SQL = ("SELECT concat('u', CAST(s_suppkey AS STRING)) AS user_id, concat('staff', CAST(s_suppkey % 30 AS STRING)) AS username,"
             " s_suppkey AS ord FROM supplier")
REQ_SQL = ("SELECT c_custkey AS request_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('u', CAST(c_custkey % 200 AS STRING))"
           " WHEN 2 THEN 'boss' ELSE NULL END AS req_id, CASE c_custkey % 3 WHEN 0 THEN concat('staff', CAST(c_custkey % 40 AS STRING))"
           " WHEN 1 THEN '' ELSE NULL END AS req_name FROM customer")


@query("J05_resolve_assignee", f"""WITH staff AS ({STAFF_SQL}), req AS ({REQ_SQL}),
 people AS (SELECT * FROM staff UNION ALL SELECT 'boss', 'boss', 9223372036854775806),
 hits AS (SELECT request_id, user_id, username, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS rn FROM req JOIN people
   ON (coalesce(req_id,'') <> '' AND req_id = user_id) OR (coalesce(req_name,'') <> '' AND req_name = username))
 SELECT req.request_id, req_id, req_name, user_id, username FROM req LEFT JOIN hits ON hits.request_id = req.request_id AND rn = 1""")
def j05(spark, sf):
    staff = table(spark, sf, "supplier").selectExpr(
        "concat('u', CAST(s_suppkey AS STRING)) AS user_id", "concat('staff', CAST(s_suppkey % 30 AS STRING)) AS username", "s_suppkey AS ord")
    req = spark.sql(REQ_SQL.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf, "customer"))
    return R.resolve_assignee(req, staff, "boss", "boss")


@query("X01_ordered_distinct", f"WITH want AS ({WANTED}) SELECT trim(record_id) AS record_id, min(seq) AS first_seq FROM want GROUP BY 1")
def x01(spark, sf):
    return _wanted(spark, sf).groupBy(X.trimmed("record_id").alias("record_id")).agg(F.min("seq").alias("first_seq"))


@query("X02_missing_ids", f"""WITH rec AS ({fx.RECORDS_SQL}), want AS ({WANTED})
 SELECT trim(record_id) AS record_id FROM want EXCEPT SELECT record_id FROM rec""")
def x02(spark, sf):
    asked = _wanted(spark, sf).select(X.trimmed("record_id").alias("record_id")).distinct()
    return asked.join(fx.review_records(spark, sf).select("record_id"), "record_id", "left_anti")


@query("X03_assignee_overlap", REC + """SELECT record_id, coalesce(assigned_to_user_id,'') IN ('u3','staff4')
 OR coalesce(assigned_to_username,'') IN ('u3','staff4') AS mine FROM rec""")
def x03(spark, sf):
    who = F.array(F.coalesce("assigned_to_user_id", F.lit("")), F.coalesce("assigned_to_username", F.lit("")))
    return fx.review_records(spark, sf).select(
        "record_id", F.arrays_overlap(who, F.array(F.lit("u3"), F.lit("staff4"))).alias("mine")
    )


@query("F47_import_status", REC + """SELECT record_id, CASE WHEN upper(trim(coalesce(save_btn,'N'))) = 'Y' THEN 'checked'
 WHEN ocr_status = 'pending' THEN 'ocr_queued' WHEN ocr_status = 'processing' THEN 'ocr_running'
 WHEN ocr_status = 'failed' THEN 'ocr_failed' ELSE 'ready_for_review' END AS import_status,
 CASE WHEN upper(trim(coalesce(save_btn,'N'))) = 'Y' THEN 'Y' ELSE 'N' END AS flag FROM rec""")
def f47(spark, sf):
    return fx.review_records(spark, sf).select("record_id", R.import_status().alias("import_status"), R.save_flag().alias("flag"))


@query("F51_filename_parts", f"""WITH rec AS ({fx.RECORDS_SQL}), fil AS ({fx.FILES_SQL})
 SELECT original_filename, count(*) AS n, CASE WHEN regexp_matches(original_filename, '^[0-9]{{14}}') THEN CAST(substr(original_filename,5,4)
  || substr(original_filename,3,2) || substr(original_filename,1,2) || substr(original_filename,9,6) AS BIGINT) END AS stamp,
  regexp_extract(original_filename, '([^/]*)$', 1) AS base
 FROM (SELECT original_filename FROM rec UNION ALL SELECT original_filename FROM fil) GROUP BY original_filename""")
def f51(spark, sf):
    names = fx.review_records(spark, sf).select("original_filename").unionAll(fx.uploaded_files(spark, sf).select("original_filename"))
    return names.groupBy("original_filename").agg(F.count("*").alias("n")).select(
        "original_filename", "n", X.filename_timestamp("original_filename").alias("stamp"),
        X.safe_basename("original_filename").alias("base"),
    )


@query("H18_page_records", FIL + """, pre AS (SELECT *, coalesce(sum(page_count) OVER (PARTITION BY batch_id ORDER BY file_seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fil WHERE page_count >= 1),
 pg AS (SELECT *, unnest(generate_series(1, page_count)) AS p FROM pre)
 SELECT file_id || '-' || CAST(p AS VARCHAR) AS record_id, 'TR-' || upper(substr(regexp_replace(batch_id, '[^A-Za-z0-9]+', '', 'g'), 1, 6)) || '-' ||
   lpad(CAST(CAST(before + p AS BIGINT) AS VARCHAR), CAST(greatest(4, length(CAST(CAST(before + p AS BIGINT) AS VARCHAR))) AS INT), '0') AS record_no, batch_id, file_id,
   regexp_extract(original_filename, '([^/]*)$', 1) AS original_filename, CAST(p AS INT) AS page_number,
   'pending' AS ocr_status, 'unassigned' AS review_status, 'N' AS save_btn FROM pg""")
def h18(spark, sf):
    return R.page_records(fx.uploaded_files(spark, sf))


@query("H18_pageless_files", FIL + """SELECT batch_id, file_id, CASE WHEN page_count IS NULL THEN 'unknown page count' ELSE 'no pages' END AS reason
 FROM fil WHERE page_count IS NULL OR page_count < 1""")
def h18p(spark, sf):
    return R.pageless_files(fx.uploaded_files(spark, sf))


@query("S06_upsert", DOC + """, chg AS (SELECT 'D' || CAST(doc_id * 2 AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'checked' END AS status FROM documents)
 SELECT 'upsert' AS how, coalesce(doc.id, chg.id) AS id, CASE WHEN chg.id IS NOT NULL THEN chg.status ELSE doc.status END AS status, total_pages FROM doc FULL JOIN chg ON doc.id = chg.id
 UNION ALL SELECT 'patch', doc.id, CASE WHEN chg.id IS NOT NULL THEN chg.status ELSE doc.status END, total_pages FROM doc LEFT JOIN chg ON doc.id = chg.id
 UNION ALL SELECT 'replace', doc.id, CASE WHEN chg.id IS NOT NULL THEN chg.status ELSE doc.status END, CASE WHEN chg.id IS NULL THEN total_pages END FROM doc LEFT JOIN chg ON doc.id = chg.id""")
def s06(spark, sf):
    now = fx.import_documents(spark, sf).select("id", "status", "total_pages")
    changes = table(spark, sf, "documents").selectExpr("concat('D', CAST(doc_id * 2 AS STRING)) AS id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'checked' END AS status")
    forms = {"upsert": {}, "patch": {"insert": False}, "replace": {"insert": False, "replace": True}}
    parts = [R.upsert(now, changes, "id", **how).withColumn("how", F.lit(name)) for name, how in forms.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# four actions on every record, in an order that mixes owners, other users and repeats
ACT_COLUMNS = [
    ("record_id", "CASE WHEN l_partkey % 13 = 0 THEN concat('gone-', CAST(l_orderkey AS STRING)) ELSE record_id END"),
    ("seq", "l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber * 10 + step"),
    ("action", "CASE (l_linenumber + step * (1 + l_partkey % 2)) % 4 WHEN 0 THEN 'assign' WHEN 1 THEN 'save' WHEN 2 THEN 'complete' ELSE CASE WHEN l_partkey % 7 = 0 THEN 'erase' ELSE 'save' END END"),
    ("user_id", "CASE WHEN l_suppkey % 5 = 0 THEN 'u0' ELSE concat('u', CAST(l_suppkey AS STRING)) END"),
    ("username", "CASE WHEN l_suppkey % 4 = 0 THEN concat('staff', CAST(l_suppkey AS STRING)) ELSE 'nobody' END"),
    ("edits", "CASE WHEN (l_partkey + step) % 3 = 0 THEN concat('edit ', CAST(l_partkey AS STRING), '.', CAST(step AS STRING)) ELSE NULL END"),
    ("unresolved", "CASE WHEN (l_partkey + step) % 8 = 0 THEN 1 ELSE 0 END"),
]
ACT_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in ACT_COLUMNS)
LINE_ID = "concat('R', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))"
STATE_COLUMNS = [
    ("saved_edits", "CASE WHEN part_seq % 2 = 0 THEN concat('saved ', CAST(part_seq AS STRING)) ELSE NULL END"),
    ("ocr_result", "CASE WHEN part_seq % 3 = 0 THEN concat('result ', CAST(part_seq AS STRING)) ELSE NULL END"),
    ("ocr_text", "concat('text ', record_id)"),
]
STATE_ORDER = ["updated_at", "read_ms", "parse_ms", "validate_ms"]
STATE_USED = ["ocr_status", "review_status", "assigned_to_user_id", "assigned_to_username", "save_btn", "part_seq"]
STATE_EXTRA = ", ".join(f"{e} AS {a}" for a, e in STATE_COLUMNS)


@query("H17_apply_actions", f"""WITH RECURSIVE rec AS (SELECT *, {STATE_EXTRA} FROM ({fx.RECORDS_SQL}) QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY updated_at DESC, read_ms DESC, parse_ms DESC, validate_ms DESC) = 1),
 act AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq) AS n FROM (SELECT DISTINCT * FROM ({ACT_SQL} FROM (SELECT *, unnest(generate_series(1, 4)) AS step, {LINE_ID} AS record_id FROM lineitem)))),
 fold(record_id, n, ready, done, uid, uname, saved, ocr_status, fallback, seq, action, reason, result) AS (
  SELECT record_id, 0::BIGINT, coalesce({READY}, false), upper(trim(coalesce(save_btn,'N'))) = 'Y', coalesce(assigned_to_user_id, ''), coalesce(assigned_to_username, ''),
   saved_edits, ocr_status, coalesce(ocr_result, ocr_text), NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM rec
  UNION ALL
  SELECT record_id, n, ready AND NOT (ok AND action = 'assign'), done OR (ok AND action = 'complete'),
   CASE WHEN ok AND action = 'assign' THEN user_id ELSE uid END, CASE WHEN ok AND action = 'assign' THEN username ELSE uname END,
   CASE WHEN ok AND action = 'save' THEN edits ELSE saved END, ocr_status, fallback, seq, action, reason,
   CASE WHEN ok THEN CASE action WHEN 'complete' THEN coalesce(edits, saved, fallback) WHEN 'save' THEN edits ELSE saved END END
  FROM (SELECT *, reason IS NULL AS ok FROM (
   SELECT f.*  EXCLUDE (n, seq, action, reason, result), a.n, a.seq, a.action, a.user_id, a.username, a.edits,
    CASE WHEN a.action NOT IN ('assign', 'save', 'complete') THEN 'unknown action'
     WHEN a.action = 'assign' THEN CASE WHEN NOT f.ready THEN 'not ready to assign' END
     WHEN NOT ((f.uid <> '' AND f.uid IN (a.user_id, a.username)) OR (f.uname <> '' AND f.uname IN (a.user_id, a.username))) THEN 'not assigned to user'
     WHEN f.ocr_status <> 'succeeded' THEN 'not read yet'
     WHEN f.done THEN CASE a.action WHEN 'save' THEN 'completed records cannot be edited' ELSE 'already completed' END
     WHEN a.action = 'complete' AND a.unresolved > 0 THEN 'fields need review' END AS reason
   FROM fold f JOIN act a ON a.record_id = f.record_id AND a.n = f.n + 1)))
 SELECT record_id, seq, action, reason, CASE WHEN reason IS NULL THEN CASE action WHEN 'assign' THEN 'assigned' WHEN 'save' THEN 'in_review' ELSE 'completed' END END AS review_status,
  CASE WHEN reason IS NULL THEN uid END AS assigned_to_user_id, result FROM fold WHERE n > 0
 UNION ALL SELECT record_id, seq, action, 'record not found', NULL, NULL, NULL FROM act WHERE record_id NOT IN (SELECT record_id FROM rec)""")
def h17(spark, sf):
    # a record id that the tables hold twice counts in its latest state, as its actions count once
    rec = fx.review_records(spark, sf, by="record_id").select("record_id", *STATE_ORDER, *STATE_USED)
    rec = R.latest_state(rec, ["record_id"], STATE_ORDER).selectExpr("*", *[f"{e} AS {a}" for a, e in STATE_COLUMNS])
    lines = table(spark, sf, "lineitem")
    keyed = lines.selectExpr("*", f"{LINE_ID} AS record_id").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f"{ACT_COLUMNS[0][1]} AS record_id")
    steps = dealt(keyed, "record_id", fx.LINES_A_TASK, counted=lines).selectExpr("*", "explode(sequence(1, 4)) AS step")
    done = R.apply_actions(rec, steps.selectExpr("record_id", *[f"{e} AS {a}" for a, e in ACT_COLUMNS[1:]]).distinct())
    return done.withColumn("assigned_to_user_id", F.when(F.col("reason").isNull(), F.coalesce("assigned_to_user_id", F.lit(""))))
