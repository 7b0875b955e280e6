"""Inputs derived from the given tables, one expression list for both engines.

Every fixture is a projection over the supplied tables, so its size grows with
them. The expressions use only what Spark SQL and DuckDB read alike; the DuckDB
statements of the queries start from the ``*_SQL`` texts built here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from formloom import constants as K
from formloom.session import dealt, table


def _select(columns: list[tuple[str, str]], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {a}" for a, e in columns) + f" FROM {source}"


def _project(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    return df.selectExpr(*[f"{e} AS {a}" for a, e in columns])


def pick(key: str, values: list[str | None]) -> str:
    """CASE expression choosing one literal by ``key`` modulo the list length."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v + "'") for i, v in enumerate(values)
    )
    return f"CASE CAST({key} AS BIGINT) % {len(values)} {arms} END"


# --- review records: one row per order line -------------------------------

RECORD_COLUMNS: list[tuple[str, str]] = [
    ("record_id", "concat('R', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-',"
                  " CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))"),
    ("batch_id", "concat('b', CAST(o_custkey AS STRING), '-x')"),
    ("file_id", "concat('F', CAST(l_orderkey AS STRING))"),
    ("file_seq", "l_orderkey"),
    ("part_seq", "l_partkey"),
    ("staff_seq", "l_suppkey"),
    ("page_number", "l_linenumber"),
    ("original_filename",
     "CASE WHEN l_orderkey % 3 = 0 THEN concat(lpad(CAST(1 + l_orderkey % 28 AS STRING), 2, '0'), '072567',"
     " lpad(CAST(l_orderkey % 24 AS STRING), 2, '0'), '3015_form.pdf')"
     # two runs of over 20 digits that differ in the last ones
     " WHEN l_orderkey % 13 = 5 THEN concat('scan 00', repeat('9', 20), lpad(CAST(l_orderkey % 100000 AS STRING), 5, '0'), '.pdf')"
     " ELSE concat('Form ', CAST(l_orderkey AS STRING), '.pdf') END"),
    ("selected_document_type", "'TR'"),
    ("record_no",
     "CASE WHEN l_partkey % 5 = 0 THEN '' WHEN l_partkey % 7 = 0 THEN NULL"
     # spells the number that another position of the batch may be given
     " WHEN l_partkey % 11 = 3 THEN concat('TR-', upper(substr(concat('b', CAST(o_custkey AS STRING), 'x'), 1, 6)), '-',"
     " lpad(CAST(1 + l_partkey % 9 AS STRING), 4, '0'))"
     " ELSE concat('TR-OLD-', lpad(CAST(l_partkey % 50 AS STRING), 4, '0')) END"),
    ("ocr_status",
     "CASE WHEN l_returnflag = 'A' THEN 'succeeded' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'pending'"
     " WHEN l_returnflag = 'N' THEN 'succeeded' WHEN l_linestatus = 'F' THEN 'failed'"
     " WHEN l_linenumber = 1 THEN 'processing' ELSE 'succeeded' END"),
    ("review_status",
     "CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'unassigned'"
     " WHEN l_linenumber % 2 = 0 THEN 'assigned' ELSE 'in_review' END"),
    ("ocr_quality",
     "CASE WHEN l_tax < 0.03 THEN 'auto_verified' WHEN l_tax < 0.06 THEN 'needs_review'"
     " WHEN l_tax < 0.07 THEN 'low_confidence' ELSE NULL END"),
    ("ocr_error",
     "CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_partkey % 4 <> 0"
     " THEN concat('read failed on page ', CAST(l_linenumber AS STRING))"
     " WHEN l_partkey % 9 = 0 THEN '  ' ELSE NULL END"),
    ("assigned_to_user_id",
     "CASE WHEN o_orderstatus = 'O' AND l_partkey % 10 <> 1 THEN NULL"
     " WHEN o_orderstatus = 'O' THEN ' ' WHEN l_partkey % 10 = 4 THEN NULL WHEN l_partkey % 10 = 6 THEN concat('staff', CAST(l_suppkey AS STRING))"
     " ELSE concat('u', CAST(l_suppkey AS STRING)) END"),
    ("assigned_to_username",
     "CASE WHEN o_orderstatus = 'O' AND l_partkey % 12 = 1 THEN 'held'"
     " WHEN o_orderstatus = 'O' THEN NULL WHEN l_partkey % 10 = 6 THEN concat('u', CAST(l_suppkey AS STRING))"
     " ELSE concat('staff', CAST(l_suppkey AS STRING)) END"),
    ("assigned_at", "CASE WHEN o_orderstatus = 'O' THEN NULL ELSE l_shipdate END"),
    ("save_btn", "CASE WHEN o_orderstatus = 'F' THEN 'y' WHEN l_partkey % 6 = 0 THEN NULL ELSE 'N' END"),
    ("created_at", "o_orderdate"),
    ("updated_at", "l_shipdate"),
    ("read_ms", "l_quantity * 20"),
    ("parse_ms", "l_discount * 100"),
    ("validate_ms", "l_tax * 100"),
]
_RECORD_SOURCE = "lineitem JOIN orders ON l_orderkey = o_orderkey"
RECORDS_SQL = _select(RECORD_COLUMNS, _RECORD_SOURCE)


#: Order lines of one task where records are dealt by a key.
LINES_A_TASK = 200_000


def review_records(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    """Review records; dealt by their column ``by`` before the other columns are made, so that groups of it don't move them."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if by is None:
        return _project(rows, RECORD_COLUMNS)
    keyed = rows.selectExpr("*", f"{dict(RECORD_COLUMNS)[by]} AS {by}")
    return _project(dealt(keyed, by, LINES_A_TASK, counted=lines), [(a, by if a == by else e) for a, e in RECORD_COLUMNS])


# --- uploaded files: one row per order; batches are customers ---------------

FILE_COLUMNS: list[tuple[str, str]] = [
    ("batch_id", "concat('b', CAST(o_custkey AS STRING), '-x')"),
    ("file_id", "concat('F', CAST(o_orderkey AS STRING))"),
    ("file_seq", "o_orderkey"),
    ("original_filename",
     "CASE WHEN o_orderkey % 97 = 5 THEN concat('in/scan ', CAST(o_orderkey AS STRING), '.PNG')"
     " ELSE concat('in/scan ', CAST(o_orderkey AS STRING), '.Pdf') END"),
    ("content_type", "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'application/pdf'"
                     " WHEN 2 THEN 'Application/X-PDF' ELSE 'application/octet-stream' END"),
    ("document_type", "CASE WHEN o_custkey % 31 = 7 THEN 'invoice' WHEN o_custkey % 2 = 0 THEN ' tr ' ELSE 'TR' END"),
    ("page_count", "CASE WHEN o_orderkey % 89 = 4 THEN 0 WHEN o_orderkey % 83 = 5 THEN NULL ELSE CAST(1 + (o_orderkey * 7) % 53 AS INT) END"),
    ("error_message", "CASE WHEN o_orderkey % 41 = 3 THEN 'unreadable' ELSE NULL END"),
    ("created_at", "o_orderdate"),
]
FILES_SQL = _select(FILE_COLUMNS, "orders")


def uploaded_files(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "orders"), FILE_COLUMNS)


# --- import documents: one row per document ---------------------------------

DOC_COLUMNS: list[tuple[str, str]] = [
    ("id", "concat('D', CAST(doc_id AS STRING))"),
    ("seq", "doc_id"),
    ("source_filename", "concat(source, '/form_', CAST(doc_id AS STRING), '.pdf')"),
    ("document_category",
     "CASE doc_id % 7 WHEN 0 THEN 'tr' WHEN 1 THEN 'judgment' WHEN 2 THEN '' WHEN 3 THEN NULL"
     " WHEN 4 THEN 'uncategorized' WHEN 5 THEN 'tor_ror' ELSE lang END"),
    ("status", pick("doc_id", ["uploaded", "ocr_queued", "cleaning", "ocr_running", "ocr_failed",
                                "ready_for_review", "review_ready", "checked", "checked"])),
    ("created_at", "concat('2024-01-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T08:00:00+00:00')"),
    ("updated_at", "concat('2024-02-', lpad(CAST(1 + (doc_id * 5) % 28 AS STRING), 2, '0'), 'T',"
                   " lpad(CAST(doc_id % 24 AS STRING), 2, '0'), ':15:00+00:00')"),
    ("source_fingerprint", "sha1(text)"),
    ("ocr_markdown", "CASE WHEN doc_id % 11 = 0 THEN '  ' WHEN doc_id % 13 = 0 THEN NULL ELSE text END"),
    ("ocr_error_message", "CASE WHEN doc_id % 10 = 0 THEN 'timeout' ELSE NULL END"),
    ("ocr_pipeline_version", pick("doc_id", ["80", "71", "x", None, "70", "81"])),
    ("review_version", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(6 + doc_id % 5 AS INT) END"),
    ("total_pages", "CAST(1 + doc_id % 4 AS INT)"),
    ("save_btn", "CASE doc_id % 4 WHEN 0 THEN ' yes' WHEN 1 THEN NULL WHEN 2 THEN 'n' ELSE '' END"),
    ("text", "text"),
]
DOCS_SQL = _select(DOC_COLUMNS, "documents")


def import_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "documents"), DOC_COLUMNS)


# --- state events ------------------------------------------------------------

EVENT_COLUMNS: list[tuple[str, str]] = [
    ("record_id", "concat('E', CAST(user_id AS STRING))"),
    ("ts", "ts"),
    ("seq", "event_id"),
    ("status", "CASE event_type WHEN 'signup' THEN 'unassigned' WHEN 'view' THEN 'assigned'"
               " WHEN 'click' THEN 'in_review' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"),
    ("batch_id", "concat('eb', CAST(user_id % 20 AS STRING))"),
    ("value", "value"),
]
EVENTS_SQL = _select(EVENT_COLUMNS, "events")


def state_events(spark: SparkSession, sf: str) -> DataFrame:
    return _project(table(spark, sf, "events"), EVENT_COLUMNS)


# --- Thai residence forms: one page per order, invented names ------------------

GIVEN = ["ใจดี", "มีสุข", "ทองใส", "รุ่งฟ้า", "สายลม", "นาดี", "บุญมา", "เพชรใส", "แก้วตา", "ดาวเด่น", "ขวัญใจ", "ฟ้าใส"]
SURNAME = ["ทุ่งเมฆ", "สายธาร", "ดอยทอง", "ลมเย็น", "ป่างาม", "บัวบาน", "ไพรสน", "หาดทราย", "นาข้าว", "เนินแก้ว"]
MOTHER = ["สมใจ", "ละมุน", "บัวใส", "จันทร์ดี", "มะลิ", "ทองดี", "ดี", "แก้วมา"]
FATHER = ["บุญชู", "ทองสุข", "แสงดี", "สมหวัง", "ดำรง", "มั่นคง", "เพียร", "ก้าน"]
MONTHS = ["มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน",
          "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม"]
SUBDISTRICTS = ["บ้านสวน", "หนองบัว", "ทุ่งใหญ่", "โคกสูง", "ห้วยแก้ว", "ป่าไผ่", "นาเหนือ", "ดอนกลาง", "ศาลาแดง"]
DISTRICTS = ["เมืองเหนือ", "ฟ้าหลวง", "สองแคว", "ท่าน้ำ", "พรุใน"]
PROVINCES = ["นครเมฆ", "ธารทิพย์", "ผาตะวัน"]


def _check_digit(d: str) -> str:
    total = " + ".join(f"CAST(substr({d}, {i}, 1) AS INT) * {14 - i}" for i in range(1, 13))
    return f"CAST((11 - ({total}) % 11) % 10 AS STRING)"


def _shape_id(d: str) -> str:
    return (f"concat(substr({d}, 1, 1), '-', substr({d}, 2, 4), '-', substr({d}, 6, 5), '-',"
            f" substr({d}, 11, 2), '-', substr({d}, 13, 1))")


def _word(key: str, values: list[str]) -> str:
    """What ``pick`` chooses, looked up in one list: Spark's code for many long CASEs is too large to be compiled."""
    return "get(array(" + ", ".join(f"'{v}'" for v in values) + f"), CAST(CAST({key} AS BIGINT) % {len(values)} AS INT))"


def _digit(d: str) -> str:
    """``_check_digit`` by arithmetic on the number, for the same reason.

    A digit is what is left of it by 10^j, less ten times what is left by 10^(j+1); the sum of digits times 2 + j is put together by the former.
    """
    n = f"CAST({d} AS BIGINT)"
    total = f"2 * {n}" + "".join(f" - {8 + 9 * j} * ({n} div {10**j})" for j in range(1, 12))
    return f"CAST((11 - ({total}) % 11) % 10 AS STRING)"


def _shape_once(d: str) -> str:
    """``_shape_id`` of a value worked out once; a lambda also keeps the steps before and after it in code of their own, small enough to be compiled."""
    return f"get(transform(array({d}), d -> {_shape_id('d')}), 0)"


def _text_date(one_of: Callable[[str, list[str]], str], day: str, month: str, year: str) -> str:
    return f"concat(CAST({day} AS STRING), ' ', {one_of(month, MONTHS)}, ' ', CAST({year} AS STRING))"


NL = "chr(10)"


def _page_lines(parts: list[str]) -> str:
    return "concat(" + f", {NL}, ".join(parts) + ")"


def _cells(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"'<td>{label}</td><td>', {value}, '</td>'" for label, value in pairs)


_LABELLED = _page_lines([
    "'เลขประจำตัวประชาชน ', person_id", "'เลขรหัสประจำบ้าน ', house_code", "'ชื่อ ', person_name",
    "'เพศ ', gender, ' สัญชาติ ', nationality", "'เกิดเมื่อ ', birth_date", "'อายุ ', age", "'สถานภาพ ', house_status",
    "'มารดาชื่อ ', mother_name, ' ', mother_id", "'สัญชาติ ', mother_nationality",
    "'บิดาชื่อ ', father_name, ' ', father_id", "'สัญชาติ ', father_nationality", "'ที่อยู่ ', address",
    "'เข้ามาอยู่เมื่อวันที่ ', move_in_date", "'บันทึกเพิ่มเติม ', remark", "'ปรับปรุงครั้งสุดท้าย ', update_date",
])
_TABLE = (
    "concat('<table><tbody><tr>', " + _cells([("เลขประจำตัวประชาชน", "person_id"), ("เลขรหัสประจำบ้าน", "house_code")])
    + ", '</tr>', chr(10), '<tr>', " + _cells([("ชื่อ", "person_name"), ("เพศ", "concat(gender, ' สัญชาติ ', nationality)")])
    + ", '</tr><tr>', " + _cells([("เกิดเมื่อ", "concat(birth_date, ' อายุ ', age)"), ("สถานภาพ", "house_status")])
    + ", '</tr><tr>', " + _cells([("มารดาชื่อ", "concat(mother_name, ' ', mother_id)"), ("สัญชาติ", "mother_nationality")])
    + ", '</tr><tr>', " + _cells([("บิดาชื่อ", "concat(father_name, ' ', father_id)"), ("สัญชาติ", "father_nationality")])
    + ", '</tr></tbody></table>', chr(10), 'ที่อยู่ ', address, chr(10), 'เข้ามาอยู่เมื่อวันที่ ', move_in_date, chr(10),"
      " 'บันทึกเพิ่มเติม ', remark, chr(10), 'ปรับปรุงครั้งสุดท้าย ', update_date)"
)
_HORIZONTAL = _page_lines([
    "person_id, ' ', house_code", "person_name, ' ', gender, ' ', nationality", "birth_date, ' ', age, ' ', house_status",
    "mother_name, ' ', mother_id, ' ', mother_nationality", "father_name, ' ', father_id, ' ', father_nationality",
    "address", "move_in_date", "remark", "update_date",
])
_VERTICAL = _page_lines([
    "person_id", "person_name", "nationality", "birth_date", "age", "house_code", "house_status", "nationality",
    "mother_name", "mother_id", "mother_nationality", "father_name", "father_id", "father_nationality",
    "address", "move_in_date", "remark", "update_date",
])

def _form_text(one_of: Callable[[str, list[str]], str], check_digit: Callable[[str], str], shape: Callable[[str], str] = _shape_id,
               kept: str = "") -> str:
    """The forms as a statement, with the engine's way to choose one of some words, to work out a check digit and to group an
    identifier; ``kept``: columns that stay."""
    base = f"""SELECT {kept}o_orderkey AS k, o_custkey AS cust,
 CAST(110203000000 + (o_orderkey * 90001) % 799999999 AS STRING) AS p12,
 CAST(312405000000 + (o_orderkey * 70003) % 799999999 AS STRING) AS m12,
 CAST(345601000000 + (o_orderkey * 50021) % 799999999 AS STRING) AS f12,
 1 + o_orderkey % 28 AS bd, o_orderkey % 12 AS bm, 2490 + o_orderkey % 60 AS byr,
 1 + (o_orderkey * 3) % 28 AS ud, (o_orderkey * 5) % 12 AS um, 2560 + o_orderkey % 8 AS uy
 FROM {{orders}}"""
    ids = f"""SELECT *, concat(p12, {check_digit('p12')}) AS p13, concat(m12, {check_digit('m12')}) AS m13,
 concat(f12, {check_digit('f12')}) AS f13,
 uy - byr - CASE WHEN um < bm OR (um = bm AND ud < bd) THEN 1 ELSE 0 END AS true_age FROM ({base}) b"""
    fields = f"""SELECT {kept}k, cust, k % 4 AS layout, true_age,
 CASE WHEN k % 19 = 3 THEN {shape("concat(p12, CAST((CAST(substr(p13, 13, 1) AS INT) + 1) % 10 AS STRING))")}
  ELSE {shape('p13')} END AS person_id,
 concat('10', lpad(CAST(k % 97 AS STRING), 2, '0'), '-', lpad(CAST((k * 37) % 1000000 AS STRING), 6, '0'), '-', CAST(k % 10 AS STRING)) AS house_code,
 concat(CASE WHEN k % 2 = 0 THEN 'นาย' ELSE 'นางสาว' END, {one_of('k', GIVEN)}, ' ', {one_of('k', SURNAME)}) AS person_name,
 CASE WHEN k % 2 = 0 THEN 'ชาย' ELSE 'หญิง' END AS gender,
 CASE WHEN k % 29 = 0 THEN 'ลาว' ELSE 'ไทย' END AS nationality,
 {_text_date(one_of, 'bd', 'bm', 'byr')} AS birth_date, CAST(true_age + CASE WHEN k % 17 = 1 THEN 1 ELSE 0 END AS STRING) AS age,
 CASE WHEN k % 3 = 0 THEN 'เจ้าบ้าน' ELSE 'ผู้อาศัย' END AS house_status,
 {one_of('k', MOTHER)} AS mother_name,
 CASE WHEN k % 13 = 6 THEN '-' WHEN k % 31 = 7 THEN {shape('p13')} ELSE {shape('m13')} END AS mother_id,
 CASE WHEN k % 27 = 1 THEN 'จีน' ELSE 'ไทย' END AS mother_nationality,
 CASE WHEN k % 37 = 9 THEN {one_of('k', MOTHER)} ELSE {one_of('k', FATHER)} END AS father_name,
 CASE WHEN k % 11 = 4 THEN '-' ELSE {shape('f13')} END AS father_id,
 CASE WHEN k % 25 = 1 THEN 'พม่า' ELSE 'ไทย' END AS father_nationality,
 concat(CAST(1 + k % 300 AS STRING), CASE WHEN k % 3 = 1 THEN concat('/', CAST(1 + k % 20 AS STRING)) ELSE '' END, ' หมู่ ', CAST(1 + k % 12 AS STRING),
  CASE WHEN k % 6 = 2 THEN ' ถนน สายเมฆ' ELSE '' END,
  ' ต.', {one_of('k', SUBDISTRICTS)}, ' อ.', {one_of('k', DISTRICTS)}, ' จ.', {one_of('k', PROVINCES)}) AS address,
 {_text_date(one_of, '1 + (k * 11) % 28', '(k * 7)', '2550 + k % 9')} AS move_in_date,
 CASE WHEN k % 21 = 8 THEN concat('บุคคลนี้ตาย วันที่ ', {_text_date(one_of, '1 + k % 27', 'k', '2564')})
  WHEN k % 21 = 9 THEN concat('บุคคลนี้ไม่ได้ตาย ตรวจเมื่อ ', {_text_date(one_of, '1 + k % 27', 'k', '2564')})
  ELSE 'บุคคลนี้มีภูมิลำเนาอยู่ในบ้านนี้' END AS remark,
 {_text_date(one_of, 'ud', 'um', 'uy')} AS update_date FROM ({ids}) i"""
    return f"""SELECT *, CASE layout WHEN 0 THEN {_LABELLED} WHEN 1 THEN {_TABLE} WHEN 2 THEN {_HORIZONTAL} ELSE {_VERTICAL} END AS text
 FROM ({fields}) f"""


FORMS_SQL = _form_text(pick, _check_digit).replace("{orders}", "orders")
_FORMS = (_word, _digit, _shape_once)
#: The key of a form in review data.
FORM_RECORD = "concat('P', CAST(o_orderkey AS STRING))"


def forms(spark: SparkSession, sf: str, record_id: bool = False, pages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Field values and the page text rendered from them, one row per order; dealt by ``k``, or by a ``record_id`` that they then have.

    ``pages`` makes rows of the orders, with columns ``page``, by which they are dealt then, and ``flat``.
    """
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    if pages is not None:
        return spark.sql(_form_text(*_FORMS, "page, flat, "), orders=dealt(pages(orders), "page", counted=orders))
    if record_id:
        keyed = dealt(orders.selectExpr("*", f"{FORM_RECORD} AS record_id"), "record_id")
        return spark.sql(_form_text(*_FORMS, "record_id, "), orders=keyed)
    return spark.sql(_form_text(*_FORMS), orders=dealt(orders, "o_orderkey"))


# field name in the review data -> column of ``forms``
FORM_FIELDS = {
    "personId": "person_id", "houseCode": "house_code", "personName": "person_name", "gender": "gender",
    "nationality": "nationality", "birthDate": "birth_date", "age": "age", "status": "house_status",
    "motherName": "mother_name", "motherId": "mother_id", "motherNationality": "mother_nationality",
    "fatherName": "father_name", "fatherId": "father_id", "fatherNationality": "father_nationality",
    "address": "address", "moveInDate": "move_in_date", "remark": "remark", "updateDate": "update_date",
}
LONG_SQL = "SELECT k, t.field, t.value FROM frm, LATERAL (VALUES " + ", ".join(
    f"('{f}', {c})" for f, c in FORM_FIELDS.items()
) + ") t(field, value)"


def form_values(spark: SparkSession, sf: str, record_id: bool = False) -> DataFrame:
    """Long form (k, field, value) of the rendered values."""
    pairs = ", ".join(f"'{f}', {c}" for f, c in FORM_FIELDS.items())
    kept = ["record_id", "k"] if record_id else ["k"]
    return forms(spark, sf, record_id).selectExpr(*kept, f"stack({len(FORM_FIELDS)}, {pairs}) AS (field, value)")


# --- page readings: one row per document and some blank ones, with the kinds of damage readers produce ----

READING_COLUMNS: list[tuple[str, str]] = [
    ("doc_id", "doc_id"),
    ("lang", "lang"),
    ("source", "source"),
    ("raw", "CASE WHEN doc_id < 0 THEN '   ' ELSE CASE doc_id % 8 WHEN 0 THEN text WHEN 1 THEN concat('## Page 1', chr(10), chr(10), text)"
            " WHEN 2 THEN concat('<figure>', chr(10), text, chr(10), '</figure>', chr(10), text)"
            " WHEN 3 THEN concat(repeat(concat('สำหรับเรียกดูข้อมูลเท่านั้น', chr(10)), 7), text)"
            " WHEN 4 THEN concat('ภาพนี้มีรายละเอียดและลักษณะ ', text)"
            " WHEN 5 THEN concat('<b>', chr(10), text, chr(10), '<i>')"
            " WHEN 6 THEN concat('   ', text, ' ') ELSE concat(text, chr(10), chr(10), text, chr(10), '- -') END END"),
    ("corrected", "CASE WHEN doc_id < 0 OR doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' ELSE concat('Fixed: ', text) END"),
    ("selected", "CASE WHEN doc_id < 0 OR doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN text ELSE NULL END"),
    ("text", "text"),
]
# whole texts, and rows of their own for readings that came back blank
_READING_ROWS = "(SELECT doc_id, lang, source, text FROM {documents} UNION ALL SELECT -1 - doc_id, lang, source, '' FROM {documents} WHERE doc_id % 8 = 6) d"
READINGS_SQL = _select(READING_COLUMNS, _READING_ROWS.replace("{documents}", "documents"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_select(READING_COLUMNS, _READING_ROWS), documents=table(spark, sf, "documents"))


# --- page segments: the rendered values of a form in their slots, moved and cut ---------------

_SLOTS = [(f, box) for f, _, box, _ in K.FIELD_TEMPLATES if box is not None]
_SLOT_ROWS = ", ".join(f"('{f}', {i}, {', '.join(f'CAST({v} AS DOUBLE)' for v in box)})" for i, (f, box) in enumerate(_SLOTS))
_SEG_BASE = f"""SELECT v.k, v.field, v.value, t.ord, t.x1, t.y1, t.x2, t.y2,
 CAST((v.k * 7 + length(v.field)) % 13 - 6 AS DOUBLE) / 1000 AS dx, CAST((v.k * 13 + length(v.field) * 5) % 41 - 20 AS DOUBLE) / 1000 AS dy
 FROM {{values}} v JOIN (VALUES {_SLOT_ROWS}) t(field, ord, x1, y1, x2, y2) ON t.field = v.field"""
# whole values, names cut in two, a stray mark, and boxes that are upside down or missing
_SEG_PARTS = f"""SELECT k, 1 AS page_number, CAST(ord * 4 AS INT) AS seg_no, CASE WHEN k % 3 = 0 THEN split_part(value, ' ', 1) ELSE value END AS text,
  x1 + dx AS x1, y1 + dy AS y1, CASE WHEN k % 3 = 0 THEN (x1 + x2) / 2 + dx ELSE x2 + dx END AS x2, y2 + dy AS y2 FROM ({_SEG_BASE}) a
 UNION ALL SELECT k, 1, CAST(ord * 4 + 1 AS INT), split_part(value, ' ', 2), (x1 + x2) / 2 + dx, y1 + dy * CAST(0.5 AS DOUBLE), x2 + dx, y2 + dy FROM ({_SEG_BASE}) b WHERE k % 3 = 0
 UNION ALL SELECT k, CAST(1 + k % 2 AS INT), CAST(ord * 4 + 2 AS INT), CASE WHEN k % 2 = 0 THEN '-' ELSE ' ' END, x1, y2, x2, CASE WHEN k % 4 = 0 THEN y1 ELSE y2 + CAST(0.004 AS DOUBLE) END FROM ({_SEG_BASE}) c
  WHERE k % 7 = 0"""
SEGMENTS_SQL = _SEG_PARTS.replace("{values}", "lng")


# the same parts side by side, so that the values are made once and stay where their form is
_SEG_ROWS = f"""SELECT k, inline(array_compact(array(
 named_struct('page_number', 1, 'seg_no', CAST(ord * 4 AS INT), 'text', CASE WHEN k % 3 = 0 THEN split_part(value, ' ', 1) ELSE value END,
  'bbox', array(x1 + dx, y1 + dy, CASE WHEN k % 3 = 0 THEN (x1 + x2) / 2 + dx ELSE x2 + dx END, y2 + dy)),
 CASE WHEN k % 3 = 0 THEN named_struct('page_number', 1, 'seg_no', CAST(ord * 4 + 1 AS INT), 'text', split_part(value, ' ', 2),
  'bbox', array((x1 + x2) / 2 + dx, y1 + dy * CAST(0.5 AS DOUBLE), x2 + dx, y2 + dy)) END,
 CASE WHEN k % 7 = 0 THEN named_struct('page_number', CAST(1 + k % 2 AS INT), 'seg_no', CAST(ord * 4 + 2 AS INT), 'text', CASE WHEN k % 2 = 0 THEN '-' ELSE ' ' END,
  'bbox', array(x1, y2, x2, CASE WHEN k % 4 = 0 THEN y1 ELSE y2 + CAST(0.004 AS DOUBLE) END)) END))) FROM ({_SEG_BASE}) a"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """k, page_number, seg_no, text, bbox of every form's values."""
    return spark.sql(_SEG_ROWS, values=form_values(spark, sf))
