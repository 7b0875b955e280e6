"""Queries of choices between readings: case numbers, page candidates, fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import constants as K
from formloom.functions import judgment as J
from formloom.operators import evidence as E
from formloom.plans.q_review import REV, review_values
from formloom.plans.q_text import LINES, REPEATED
from formloom.plans.registry import query
from formloom.session import table

# --- case numbers: several readings of every order's number, some worse than others -------------

_NUMBER = "translate(concat(CAST(l_orderkey % 9000 + 100 AS STRING), '/25', CAST(60 + l_orderkey % 9 AS STRING)), '0123456789', '๐๑๒๓๔๕๖๗๘๙')"
CASE_COLUMNS = [
    ("doc", "l_orderkey"), ("field", "CASE WHEN l_linenumber % 4 = 3 THEN 'caseRedNo' ELSE 'caseBlackNo' END"),
    ("seq", "l_linenumber * 100000000 + l_partkey * 10000 + l_suppkey"),
    ("said", "CASE (l_partkey + l_suppkey) % 6"
             f" WHEN 0 THEN concat('คดี .พบ', {_NUMBER}, '-') WHEN 1 THEN concat('เลขที่ศาลผบ', {_NUMBER}) WHEN 2 THEN concat('ผบE', CAST(l_orderkey % 9000 AS STRING), ' /2567;')"
             f" WHEN 3 THEN concat('ที่ ', {_NUMBER}, ' ๆ') WHEN 4 THEN 'ไม่มี 12' ELSE concat('ผบ.', {_NUMBER}) END"),
    ("method", "CASE l_suppkey % 4 WHEN 0 THEN 'full_page_ocr' WHEN 1 THEN 'ocr_crop' WHEN 2 THEN 'vision_crop' ELSE NULL END"),
    ("preview_source", "CASE l_partkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'cleaned' ELSE NULL END"),
    ("source", "CASE l_partkey % 5 WHEN 0 THEN 'original_crop' WHEN 1 THEN NULL ELSE 'cleaned_page' END"),
    ("x", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_partkey % 100 AS DOUBLE) / 100 END"),
]
_CASES = ", ".join(f"{e} AS {a}" for a, e in CASE_COLUMNS)
# what a token looks like after its marks are gone and it starts with its series
_TOKEN = r"""(SELECT v FROM (SELECT i, regexp_replace(CASE WHEN contains(b, 'ผบ') THEN substr(b, instr(b, 'ผบ')) WHEN contains(b, 'พบ') THEN substr(b, instr(b, 'พบ')) ELSE b END, '^พบ', 'ผบ') AS v
 FROM (SELECT i, trim(t, '.,;:-/') AS b FROM (SELECT unnest(regexp_extract_all(replace(said, ' ', ''), '[A-Za-zก-๛0-9๐-๙./-]+')) AS t, generate_subscripts(regexp_extract_all(replace(said, ' ', ''), '[A-Za-zก-๛0-9๐-๙./-]+'), 1) AS i)))
 WHERE contains(v, '/') AND regexp_matches(v, '[0-9๐-๙]') ORDER BY i LIMIT 1)"""
_SCORE = """(0.0::DOUBLE + CASE WHEN starts_with({0}, 'ผบ') THEN 3.0 ELSE 0 END + CASE WHEN starts_with({0}, 'ผบ.') THEN 0.5 ELSE 0 END + CASE WHEN contains({0}, 'ศต') THEN 1.0 ELSE 0 END + CASE WHEN contains({0}, 'E') THEN 0.8 ELSE 0 END
 + CASE length({0}) - length(replace({0}, '/', '')) WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 ELSE 0 END + CASE WHEN len(regexp_extract_all({0}, '[๐-๙]')) >= 4 THEN 2.0 ELSE 0 END - CASE WHEN regexp_matches({0}, '[0-9]') THEN 0.4 ELSE 0 END
 + CASE WHEN regexp_matches({0}, '/๒๕[0-9๐-๙]{{2}}$') THEN 3.5 ELSE 0 END + CASE WHEN regexp_matches({0}, '/25[0-9]{{2}}$') THEN 2.5 ELSE 0 END
 - CASE WHEN contains({0}, '.') AND NOT contains(left({0}, 4), 'ผบ') THEN 1.2 ELSE 0 END - CASE WHEN length({0}) NOT BETWEEN 8 AND 22 THEN 1.5 ELSE 0 END)"""
CASES = f"WITH cs AS (SELECT {_CASES} FROM lineitem), cn AS (SELECT *, {_TOKEN} AS value FROM (SELECT DISTINCT said FROM cs)) "


def cases(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {a}" for a, e in CASE_COLUMNS])


@query("F34_case_number", CASES + "SELECT doc, seq, value FROM cs JOIN cn ON cn.said = cs.said")
def f34(spark, sf):
    return cases(spark, sf).select("doc", "seq", J.case_number("said").alias("value"))


@query("F35_case_number_score", CASES + f"SELECT doc, seq, round({_SCORE.format('value')}, 6) AS score, round({_SCORE.format('said_c')}, 6) AS raw_score FROM (SELECT cs.*, value, replace(cs.said, ' ', '') AS said_c FROM cs JOIN cn ON cn.said = cs.said)")
def f35(spark, sf):
    rows = cases(spark, sf).withColumn("value", J.case_number("said"))
    return rows.select("doc", "seq", F.round(J.case_number_score("value"), 6).alias("score"), F.round(J.case_number_score("said"), 6).alias("raw_score"))


@query("A11_case_consensus", CASES + f""", c AS (SELECT cs.* EXCLUDE (said), value FROM cs JOIN cn ON cn.said = cs.said WHERE value <> ''),
 g AS (SELECT doc, field, value, count(*) AS n, count(DISTINCT coalesce(preview_source, '')) AS pv, list_distinct(list(method)) AS m, bool_or(contains(coalesce(source, ''), 'original')) AS o, min(seq) AS f,
   arg_max({{'x': x, 's': source}}, {{'b': x IS NOT NULL, 'k': CASE method WHEN 'vision_crop' THEN 2 WHEN 'ocr_crop' THEN 1 ELSE 0 END, 'p': coalesce(preview_source, '') = 'original', 'q': -seq}}) AS best FROM c GROUP BY 1, 2, 3),
 s AS (SELECT *, round({_SCORE.format('value')} + (n - 1) * 2.3 + (pv - 1) * 1.8 + CASE WHEN list_contains(m, 'full_page_ocr') THEN 0.5 ELSE 0 END + CASE WHEN list_contains(m, 'ocr_crop') THEN 0.7 ELSE 0 END + CASE WHEN list_contains(m, 'vision_crop') THEN 0.6 ELSE 0 END
   + CASE WHEN list_has_all(m, ['full_page_ocr', 'ocr_crop']) THEN 1.3 ELSE 0 END + CASE WHEN list_has_all(m, ['ocr_crop', 'vision_crop']) THEN 0.9 ELSE 0 END + CASE WHEN o THEN 0.2 ELSE 0 END, 6) AS score FROM g)
 SELECT doc, field, value, best.x AS x, CASE WHEN n > 1 THEN 'hybrid_case_consensus' ELSE coalesce(best.s, 'hybrid_case_consensus') END AS source, n AS support_count, round_even(score, 3) AS consensus_score
 FROM s QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY score DESC, n DESC, length(value) DESC, f) = 1""")
def a11(spark, sf):
    rows = cases(spark, sf).withColumn("value", J.case_number("said")).withColumn("bbox", F.when(F.col("x").isNotNull(), F.array("x")))
    return E.case_consensus(rows, ["doc", "field"]).withColumn("x", F.col("bbox")[0]).drop("bbox")


# --- page candidates: whole texts of documents, read by several readers ----------------------------

CANDIDATES = """SELECT doc_id AS doc, CAST(1 + doc_id % 3 AS INT) AS page_number, r.seq, r.source, r.model, CASE r.seq
  WHEN 1 THEN CASE WHEN doc_id % 5 = 1 THEN concat('ผบE', CAST(1000 + doc_id AS STRING), '/2567', chr(10), text) ELSE text END
  WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), ' ') ELSE concat(text, chr(10), 'ok') END WHEN 3 THEN reverse(text) WHEN 4 THEN concat('## Page 1', chr(10), text, chr(10), chr(10), 'x') ELSE ' short ' END AS text
 FROM documents CROSS JOIN (VALUES (1, 'original', 'm1'), (2, 'cleaned', 'm1'), (3, 'aggressive', 'm1'), (4, 'cleaned', 'm2'), (5, 'original', 'm2')) r(seq, source, model)
 WHERE NOT (r.source = 'original' AND doc_id % 7 = 3) AND NOT (r.source <> 'original' AND doc_id % 11 = 5)"""


@query("W03_pick_best_candidate", f"""WITH cand AS ({CANDIDATES}), ln AS (SELECT * EXCLUDE (text), text AS raw, {LINES.replace('raw', 'text')} AS lines FROM cand),
 sc AS (SELECT *, CASE WHEN source = 'original' THEN 'original' ELSE 'cleaned' END AS kind, regexp_matches(regexp_replace(raw, '\\s+', '', 'g'), '{K.LATIN_CASE_SERIES}') AS series,
  CAST(length(regexp_replace(raw, '\\s+', '', 'g')) + 42 * len(lines) - 12 * len(list_filter(lines, lambda x: length(regexp_replace(x, '\\s+', '', 'g')) <= 2)) - CASE WHEN {REPEATED} THEN 2800 ELSE 0 END AS DOUBLE) AS score FROM ln),
 o AS (SELECT * FROM sc WHERE kind = 'original' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, seq) = 1), c AS (SELECT * FROM sc WHERE kind = 'cleaned' QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, seq) = 1),
 t AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, seq) = 1), l AS (SELECT doc, string_agg(source || ':' || model, ',' ORDER BY score DESC, seq) AS ranking FROM sc GROUP BY doc),
 j AS (SELECT t.doc, t.page_number, o.score AS os, c.score AS cs, ranking, t.page_number = 1 AND coalesce(o.series, false) AND NOT coalesce(c.series, false) AS kept, o.kind AS ok, o.source AS oso, o.model AS om, o.raw AS ot, len(o.lines) AS ob, t.*
  FROM t LEFT JOIN o ON o.doc = t.doc LEFT JOIN c ON c.doc = t.doc JOIN l ON l.doc = t.doc),
 f AS (SELECT doc, page_number, os, cs, ranking, kept, CASE WHEN kept THEN ok ELSE kind END AS kind, CASE WHEN kept THEN oso ELSE source END AS source, CASE WHEN kept THEN om ELSE model END AS model, CASE WHEN kept THEN ot ELSE raw END AS raw,
   CASE WHEN kept THEN os ELSE score END AS score, CASE WHEN kept THEN ob ELSE len(lines) END AS blocks FROM j)
 SELECT doc, page_number, kind AS selected_source, source AS candidate_source, model, md5(raw) AS text_md5, score, os AS original_score, cs AS cleaned_score, ranking,
  CAST((cs IS NULL)::INT + (os IS NULL)::INT + kept::INT + (source = 'aggressive')::INT + (blocks <= 3)::INT + (length(regexp_replace(raw, '\\s+', '', 'g')) < 120)::INT AS INT) AS n_reasons FROM f""")
def w03(spark, sf):
    found = E.pick_best_candidate(spark.sql(CANDIDATES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents")), ["doc"])
    ranking = F.array_join(F.transform("candidate_scores", lambda x: x["label"]), ",")
    return found.select("doc", "page_number", "selected_source", "candidate_source", "model", F.md5("text").alias("text_md5"), "score", "original_score", "cleaned_score",
                        ranking.alias("ranking"), F.size("reasons").alias("n_reasons"))


# --- decisions: readings of every form's fields, some twice, some empty ---------------------------

_N = "(k * 3 + length(field) * 7)"
SIDES = {
    "derived": f"SELECT record_id, field, r.seq, CASE WHEN {_N} % 4 = 0 THEN '' ELSE concat(value, CASE r.seq WHEN 2 THEN 'ก' ELSE '' END) END AS value, CASE {_N} % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'derived_missing' WHEN 2 THEN 'corrected_mismatch' ELSE NULL END AS action,"
               f" CASE WHEN {_N} % 3 = 0 THEN value ELSE NULL END AS previous_value, CASE WHEN {_N} % 3 = 0 THEN 'parser' ELSE NULL END AS previous_source FROM {{rv}} CROSS JOIN (VALUES (1), (2)) r(seq) WHERE {_N} % 6 < 2 AND (r.seq = 1 OR k % 2 = 0)",
    "crop": f"SELECT record_id, field, 1 AS seq, CASE WHEN {_N} % 7 = 1 THEN ' ' ELSE value END AS value, 'crop_ocr' AS source, CASE WHEN {_N} % 2 = 0 THEN 'rescued' ELSE '' END AS action FROM {{rv}} WHERE {_N} % 5 = 1",
    "vision": f"SELECT record_id, field, r.seq, CASE r.seq WHEN 1 THEN value ELSE concat(value, ' x') END AS value, 'vision' AS source, 'replaced' AS action FROM {{rv}} CROSS JOIN (VALUES (1), (2)) r(seq) WHERE {_N} % 8 = 2",
    "parsed": f"SELECT record_id, field, CASE WHEN {_N} % 9 = 4 THEN concat(value, 'y') ELSE value END AS value, source FROM {{rv}} WHERE {_N} % 10 <> 3",
    "dashes": f"SELECT record_id, field FROM {{rv}} CROSS JOIN (VALUES (1), (2)) r(seq) WHERE {_N} % 13 = 5",
}
_COMPACT = r"nullif(regexp_replace(coalesce({}, ''), '\s+', '', 'g'), '')"


@query("J10_decision_map", REV + ", " + ", ".join(f"{n} AS ({s.replace('{rv}', 'rv')})" for n, s in SIDES.items()) + f""",
 d AS (SELECT * FROM derived QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY seq DESC) = 1), v AS (SELECT * FROM vision QUALIFY row_number() OVER (PARTITION BY record_id, field ORDER BY seq DESC) = 1),
 b AS (SELECT rv.record_id, rv.field, coalesce(rv.value, '') AS sv, coalesce(rv.source, '') AS ss, coalesce(rv.review_status, '') AS st, p.value AS pv, p.source AS ps, d.action AS da, coalesce(nullif(d.value, ''), CASE WHEN d.record_id IS NOT NULL THEN coalesce(rv.value, '') END) AS dv,
   d.previous_value, d.previous_source, v.action AS va, v.source AS vs, coalesce(nullif(v.value, ''), CASE WHEN v.record_id IS NOT NULL THEN rv.value END) AS vv, c.action AS ca, c.source AS cs, coalesce(nullif(c.value, ''), CASE WHEN c.record_id IS NOT NULL THEN rv.value END) AS cv,
   x.record_id IS NOT NULL AS dash
  FROM rv LEFT JOIN parsed p ON p.record_id = rv.record_id AND p.field = rv.field LEFT JOIN d ON d.record_id = rv.record_id AND d.field = rv.field LEFT JOIN v ON v.record_id = rv.record_id AND v.field = rv.field
  LEFT JOIN crop c ON c.record_id = rv.record_id AND c.field = rv.field LEFT JOIN (SELECT DISTINCT * FROM dashes) x ON x.record_id = rv.record_id AND x.field = rv.field),
 e AS (SELECT *, {_COMPACT.format('sv')} AS s_, list_filter([{{'n': 'parser', 'v': {_COMPACT.format('pv')}}}, {{'n': 'crop', 'v': {_COMPACT.format('cv')}}}, {{'n': 'vision', 'v': {_COMPACT.format('vv')}}}], lambda z: z.v IS NOT NULL) AS z FROM b),
 f AS (SELECT *, list_transform(list_filter(z, lambda q: q.v = s_), lambda q: q.n) AS same, len(list_distinct(list_transform(z, lambda q: q.v))) AS kinds FROM e)
 SELECT record_id, field, sv AS selected_value, ss AS selected_source, st AS selected_review_status, CASE WHEN dash THEN 'source image showed a dash in this field' WHEN field = 'age' AND da = 'verified' THEN 'OCR/parser age matched birthDate and updateDate'
   WHEN field = 'age' AND da = 'corrected_mismatch' THEN 'calculated age replaced an OCR/Vision mismatch' WHEN field = 'age' AND da = 'derived_missing' THEN 'age was calculated from birthDate and updateDate'
   WHEN coalesce(ca, '') <> '' THEN 'crop OCR filled or corrected this validated field' WHEN field = 'age' AND coalesce(va, '') <> '' THEN 'Vision read age only after parser and date calculation were unavailable'
   WHEN coalesce(va, '') <> '' THEN 'Vision filled or corrected this field from its crop' WHEN ss <> '' THEN 'selected from ' || ss ELSE 'no selected value' END AS selection_reason,
  pv AS parser_value, ps AS parser_source, dv AS derived_value, da AS derived_action, previous_value, previous_source, vv AS vision_value, vs AS vision_source, va AS vision_action, cv AS crop_value, cs AS crop_source, ca AS crop_action, dash AS visual_dash,
  CASE WHEN s_ IS NULL THEN NULL WHEN len(same) >= 2 THEN 'confirmed_by_' || array_to_string(same, '_') WHEN kinds > 1 THEN 'candidate_conflict' WHEN len(same) = 1 THEN 'single_' || same[1] END AS candidate_consensus FROM f""")
def j10(spark, sf):
    rv = review_values(spark, sf)
    sides = {n: spark.sql(s, rv=rv) for n, s in SIDES.items()}
    return E.decision_map(rv, sides["parsed"], sides["derived"], sides["crop"], sides["vision"], sides["dashes"])
