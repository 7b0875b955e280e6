"""Queries of blocks, passages, edits, ages and the typed export."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import fixtures as fx
from formloom.operators import export as E
from formloom.operators import passages as P
from formloom.operators import review as V
from formloom.plans.q_thai import FRM, PLACE, date_sql
from formloom.plans.registry import query
from formloom.session import table

# documents as one block, as paragraphs, and with page markers
LAID_OUT = "CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, '. ', concat('.', chr(10), ' ', chr(10), chr(10))) ELSE concat('## Page 3', chr(10), text, chr(10), 'page 4') END"
MARK = r"regexp_matches(l, '(?i)^(#{{1,6}}\s*)?page\s+[0-9]+\s*$')"
NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
LINES = f"list_filter(list_transform(string_split({{}}, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT {MARK})"


@query("W17_blocks", f"""WITH d AS (SELECT doc_id, {LAID_OUT} AS t FROM documents),
 p AS (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n+'), lambda p: {NORM.format("array_to_string(" + LINES.format('p') + ", ' ')")}), lambda p: p <> '') AS ps, {LINES.format('t')} AS ls FROM d)
 SELECT doc_id, array_to_string(CASE WHEN len(ps) > 1 THEN ps ELSE list_transform(range(0, (len(ls) + 2) // 3), lambda i: {NORM.format("array_to_string(ls[i * 3 + 1:i * 3 + 3], ' ')")}) END, '|#|') AS blocks FROM p""")
def w17(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", f"{LAID_OUT} AS t")
    return docs.select("doc_id", F.array_join(P.blocks("t"), "|#|").alias("blocks"))


@query("W16_keyword_windows")
def w16(spark, sf):
    """Windows of a frequent word; checked against plain Python in the tests."""
    docs = table(spark, sf, "documents").selectExpr("doc_id", f"{LAID_OUT} AS t")
    return docs.select("doc_id", F.explode(P.keyword_windows("t", "tion")).alias("passage"))


# three documents are the pages of one; blank pages at the end of some, and documents of blank pages only, are rows of their own
PAGES = """SELECT CAST(floor(doc_id / 3) AS BIGINT) AS d, doc_id AS n, text AS t FROM {documents}
 UNION ALL SELECT CAST(floor(doc_id / 3) AS BIGINT), doc_id + 1000000000000, '  ' FROM {documents} WHERE doc_id % 5 < 2
 UNION ALL SELECT -1 - CAST(floor(doc_id / 30) AS BIGINT), doc_id, ' ' FROM {documents} WHERE doc_id % 7 = 1
 UNION ALL SELECT 1000000000000 + doc_id, doc_id, text FROM {documents} WHERE doc_id % 9 = 4"""


@query("A12_join_pages", "WITH p AS (" + PAGES.replace("{documents}", "documents") + """),
 r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY n) AS i, count(*) OVER (PARTITION BY d) AS c FROM p)
 SELECT d, CASE WHEN max(length(trim(t))) > 0 THEN CASE WHEN max(c) = 1 THEN max(t) ELSE string_agg('## Page ' || i || chr(10) || chr(10) || trim(t), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) END END AS text FROM r GROUP BY d""")
def a12(spark, sf):
    joined = P.join_pages(spark.sql(PAGES, documents=table(spark, sf, "documents")), ["d"], "n", "t")
    # trailing blanks of the last page's heading are trimmed with the whole; SQL keeps them
    return joined.withColumn("text", F.when(F.col("text").endswith("\n\n") | ~F.col("text").rlike(r"## Page \d+$"), F.col("text")).otherwise(F.concat("text", F.lit("\n\n"))))


def _pattern(word: str) -> str:
    return "(?i)" + r"\s*".join(c for c in word if c != " ")


@query("F56_trim_before_keyword", f"""WITH n AS (SELECT conv_id, turn, {NORM.format('text')} AS t FROM conversations)
 SELECT conv_id, turn, CASE WHEN contains(t, 'on the') THEN substr(t, instr(t, 'on the')) WHEN regexp_matches(t, '{_pattern('on the')}') THEN regexp_extract(t, '{_pattern('on the')}.*$') ELSE t END AS passage FROM n""")
def f56(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", P.trim_before_keyword("text", "on  the").alias("passage"))


def _place(t: str, word: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '{_pattern(word)}') THEN length({t}) - length(regexp_extract({t}, '{_pattern(word)}.*$')) + 1 END"


def _end(t: str, words: list[str]) -> str:
    spots = ", ".join(f"{{'pos': {_place(t, w)}, 'size': -length(regexp_extract({t}, '{_pattern(w)}'))}}" for w in words)
    return f"list_sort(list_filter([{spots}], lambda s: s.pos IS NOT NULL))[1]"


@query("F39_slice_between", f"""WITH n AS (SELECT conv_id, turn, {NORM.format('text')} AS t FROM conversations),
 s AS (SELECT *, least({_place('t', 'of the')}, {_place('t', 'to the')}) AS pos FROM n), c AS (SELECT *, CASE WHEN pos IS NULL THEN t ELSE substr(t, pos) END AS x FROM s),
 e AS (SELECT *, coalesce({_end('x', ['ed an', 'ed and'])}, {_end('x', ['thing', 'est'])}) AS stop FROM c)
 SELECT conv_id, turn, trim(CASE WHEN pos IS NULL OR stop IS NULL THEN x ELSE left(x, stop.pos - stop.size - 1) END) AS passage FROM e""")
def f39(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", P.slice_between("text", ["of the", "to the"], ["ed an", "ed and"], ["thing", "est"]).alias("passage"))


HEADED = "CASE doc_id % 3 WHEN 0 THEN concat('## - ศาลจังหวัด ', lang, ' :', chr(10), text) WHEN 1 THEN concat(text, chr(10), '* ศ าล ', source, chr(10), 'ศาลอื่น') ELSE concat('ศาล', repeat('ก', 90), chr(10), text) END"


@query("F37_court_name", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ศาลจังหวัด ' || lang WHEN 1 THEN 'ศ าล ' || source END AS court FROM documents")
def f37(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.court_name(F.expr(HEADED)).alias("court"))


@query("W18_apply_line_edit", """WITH d AS (SELECT doc_id, '  first  ' || chr(10) || text AS t, doc_id % 4 AS k, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE ' new ' || lang || ' ' END AS n FROM documents),
 l AS (SELECT *, string_split(t, chr(10)) AS ls FROM d)
 SELECT doc_id, CASE WHEN trim(n) = '' OR k >= len(ls) THEN t ELSE array_to_string(list_concat(ls[1:k], [regexp_extract(ls[k + 1], '^\\s*') || trim(n) || CASE WHEN trim(ls[k + 1]) = '' THEN '' ELSE regexp_extract(ls[k + 1], '\\s*$') END], ls[k + 2:]), chr(10)) END AS page FROM l""")
def w18(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("doc_id", "concat('  first  ', chr(10), text) AS t", "doc_id % 4 AS k", "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE concat(' new ', lang, ' ') END AS n")
    return docs.select("doc_id", P.apply_line_edit("t", F.col("k").cast("int"), F.col("n")).alias("page"))


AGE = "CASE WHEN k % 8 = 3 THEN '' WHEN k % 19 = 4 THEN '999' ELSE age END"
CROP = "CASE k % 6 WHEN 0 THEN '99' WHEN 1 THEN age WHEN 2 THEN ' ' ELSE NULL END"


@query("H10_reconcile_age", FRM + f""", x AS (SELECT k, true_age, {AGE} AS a, nullif(trim(coalesce({CROP}, '')), '') AS c, k % 23 = 5 AS undated FROM frm)
 SELECT k, CASE WHEN NOT undated THEN CASE WHEN a = CAST(true_age AS VARCHAR) THEN 'verified' WHEN a <> '' AND c IS NOT NULL AND a <> c THEN 'promoted_crop_ocr_alternative' WHEN a NOT IN ('', '999') THEN 'flagged_mismatch_kept_ocr' ELSE 'derived_missing' END END AS action,
  CASE WHEN NOT undated THEN CASE WHEN a = CAST(true_age AS VARCHAR) THEN a WHEN a <> '' AND c IS NOT NULL AND a <> c THEN c WHEN a NOT IN ('', '999') THEN a ELSE CAST(true_age AS VARCHAR) END END AS value FROM x""")
def h10(spark, sf):
    birth = F.when(F.col("k") % 23 != 5, F.col("birth_date"))
    decided = V.reconcile_age(birth, F.col("update_date"), F.expr(AGE), F.expr(CROP))
    return fx.forms(spark, sf).select("k", decided.alias("d")).select("k", "d.action", "d.value")


DIGITS = "nullif(regexp_replace({}, '[^0-9]', '', 'g'), '')"


@query("E01_person_export", FRM + rf""", x AS (SELECT *, k % 21 = 8 AS dead FROM frm)
 SELECT 'P' || k AS record_id, {date_sql('update_date')} AS "UpEate", {DIGITS.format("CASE WHEN k % 14 = 2 THEN '-' ELSE person_id END")} AS "PIE", {DIGITS.format('house_code')} AS "PHIE", person_name AS "PNBme", {date_sql('birth_date')} AS "PBE", CAST(age AS INT) AS "PAhe",
  gender AS "PSDX", nationality AS "PNbtionality", house_status AS "PAdStatus", mother_name AS "MNBme", {DIGITS.format('mother_id')} AS "MIE", mother_nationality AS "MNbtionality", father_name AS "DNBme", {DIGITS.format('father_id')} AS "DIE",
  father_nationality AS "DNbtionality", address AS "AEdress", regexp_extract(address, '^(\S+ หมู่ [0-9]+)', 1) AS "AEdress1", CASE WHEN k % 6 = 2 THEN 'ถนน สายเมฆ' END AS "AEdress2", CASE WHEN k % 6 = 2 THEN 'สายเมฆ' END AS "RPad",
  {PLACE['pro']} AS "PSovince", {PLACE['dis']} AS "ANphur", {PLACE['sub']} AS "DJstrict", CAST(NULL AS VARCHAR) AS "PPstalCode", {date_sql('move_in_date')} AS "AEdress_In", remark AS "Renark", CASE WHEN dead THEN 'เสียชีวิต' END AS "PStatus",
  TIMESTAMP '2024-05-06 07:08:09' AS "UpdatedDate", 'staff' AS "UpdatedBy", '07:08:09' AS "UpdatedTime", CASE WHEN dead THEN 'Y' END AS "Renark_DED",
  CASE WHEN dead THEN {date_sql("regexp_extract(remark, 'วันที่ (.*)$', 1)")} END AS "Renark_DED_Date", CASE WHEN k % 14 = 2 THEN 'personId' END AS refused, CAST(NULL AS VARCHAR) AS address_overflow FROM x""")
def e01(spark, sf):
    values = fx.form_values(spark, sf).selectExpr("concat('P', CAST(k AS STRING)) AS record_id", "field", "CASE WHEN field = 'personId' AND k % 14 = 2 THEN '-' ELSE value END AS value")
    return E.person_export(values, "staff-one", F.lit("2024-05-06 07:08:09").cast("timestamp"))
