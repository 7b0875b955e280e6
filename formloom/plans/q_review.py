"""Queries of accuracy, validation, alternatives and the document store."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import constants as K
from formloom import fixtures as fx
from formloom.operators import accuracy as AC
from formloom.operators import review as V
from formloom.operators import store as ST
from formloom.plans.q_thai import CHECK_OK, DIG, IDS, LNG, VALID  # noqa: F401
from formloom.plans.registry import query
from formloom.session import table

# review fields of every rendered form: blanks, dashes, sources, marks, and now and then no row at all
REVIEW_COLUMNS = [
    ("record_id", "concat('P', CAST(k AS STRING))"),
    ("k", "k"),
    ("batch_id", "concat('b', CAST(k % 20 AS STRING))"),
    ("field", "field"),
    ("value", "CASE WHEN (k + length(field)) % 23 = 0 THEN '' WHEN (k * 3 + length(field)) % 31 = 2 THEN concat(value, ' ?') ELSE value END"),
    ("source", "CASE (k + length(field)) % 7 WHEN 0 THEN 'source_dash' WHEN 1 THEN 'crop_ocr' WHEN 2 THEN 'vision_read' ELSE 'parser' END"),
    ("review_status", "CASE (k * 3 + length(field)) % 11 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'empty_in_source' WHEN 2 THEN NULL ELSE 'ok' END"),
]
_REVIEW = ", ".join(f"{e} AS {a}" for a, e in REVIEW_COLUMNS)
REV = LNG + f", rv AS (SELECT {_REVIEW} FROM lng WHERE NOT (field = 'houseCode' AND k % 43 = 5)) "


def review_values(spark, sf):
    # dealt by record id, so that what is joined or grouped by it and a field stays where it is
    rows = fx.form_values(spark, sf, record_id=True).filter("NOT (field = 'houseCode' AND k % 43 = 5)")
    return rows.selectExpr("record_id", *[f"{e} AS {a}" for a, e in REVIEW_COLUMNS if a != "record_id"])


# --- truth --------------------------------------------------------------------------

# a truth entry names its record, or its file and page, or both, or nobody
ENTRY_COLUMNS = [
    ("entry_id", "k"),
    ("record_id", "CASE k % 4 WHEN 0 THEN concat('P', CAST(k AS STRING)) WHEN 1 THEN NULL WHEN 2 THEN concat('lost', CAST(k AS STRING)) ELSE ' ' END"),
    ("original_filename", "CASE WHEN k % 4 = 0 OR k % 12 = 2 THEN NULL ELSE concat('scan ', CAST(k % 500 AS STRING), '.pdf') END"),
    ("page_number", "CASE WHEN k % 24 = 3 THEN NULL ELSE CAST(k % 3 AS STRING) END"),
]
RECORD_COLUMNS = [
    ("record_id", "concat('P', CAST(k AS STRING))"),
    ("original_filename", "concat('scan ', CAST(k % 500 AS STRING), '.pdf')"),
    ("page_number", "CAST(k % 3 AS STRING)"),
    ("seq", "k"),
]
_ENTRY, _RECORD = (", ".join(f"{e} AS {a}" for a, e in c) for c in (ENTRY_COLUMNS, RECORD_COLUMNS))
TRUTH = REV + f""", ent AS (SELECT {_ENTRY} FROM frm), rec AS (SELECT {_RECORD} FROM frm),
 found AS (SELECT ent.*, coalesce(a.record_id, b.record_id) AS found_id FROM ent
  LEFT JOIN (SELECT record_id FROM rec) a ON a.record_id = ent.record_id
  LEFT JOIN (SELECT original_filename, page_number, arg_max(record_id, seq) AS record_id FROM rec GROUP BY 1, 2) b
   ON b.original_filename = ent.original_filename AND b.page_number = ent.page_number),
 cmp AS (SELECT entry_id, lng.field, lng.value AS expected, rv.value AS actual FROM found JOIN lng ON lng.k = entry_id
  LEFT JOIN rv ON rv.record_id = found_id AND rv.field = lng.field WHERE found_id IS NOT NULL AND NOT (lng.field = 'personId' AND lng.k % 5 = 0)),
 okd AS (SELECT *, CASE WHEN lower(field) LIKE '%id' OR field = 'houseCode' THEN regexp_replace(expected, '[^0-9]', '', 'g') = regexp_replace(coalesce(actual, ''), '[^0-9]', '', 'g')
  ELSE trim(regexp_replace(expected, '\\s+', ' ', 'g')) = trim(regexp_replace(coalesce(actual, ''), '\\s+', ' ', 'g')) END AS ok FROM cmp) """


def _matched(spark, sf):
    forms = fx.forms(spark, sf)
    pairs = [F.struct(F.lit(f).alias("key"), F.col(c).alias("value")) for f, c in fx.FORM_FIELDS.items() if f != "personId"]
    person = F.when(F.col("k") % 5 != 0, F.struct(F.lit("personId").alias("key"), F.col("person_id").alias("value")))
    expected = F.map_from_entries(F.array_compact(F.array(person, *pairs)))
    entries = forms.select(*[F.expr(e).alias(a) for a, e in ENTRY_COLUMNS], expected.alias("expected"))
    return AC.match_truth(AC.read_truth(entries), forms.selectExpr(*[f"{e} AS {a}" for a, e in RECORD_COLUMNS]))


@query("J01_match_truth", TRUTH + "SELECT entry_id, found_id, found_id IS NULL AS missed FROM found")
def j01(spark, sf):
    return _matched(spark, sf).select("entry_id", "found_id", F.col("found_id").isNull().alias("missed"))


@query("S13_read_truth", TRUTH + "SELECT k AS entry_id, field, value AS expected FROM lng WHERE NOT (field = 'personId' AND k % 5 = 0)")
def s13(spark, sf):
    return _matched(spark, sf).select("entry_id", F.explode("expected").alias("field", "expected"))


@query("A07_field_accuracy", TRUTH + "SELECT field, count(*) FILTER (ok) AS correct, count(*) AS total, round_even(count(*) FILTER (ok) / count(*), 4) AS accuracy FROM okd GROUP BY field")
def a07(spark, sf):
    return AC.field_accuracy(AC.compare_fields(_matched(spark, sf), review_values(spark, sf)))


@query("A08_critical_accuracy", TRUTH + """SELECT count(*) FILTER (good) AS correct, count(*) AS total, round_even(count(*) FILTER (good) / count(*), 4) AS accuracy
 FROM (SELECT entry_id, bool_and(ok) AS good FROM okd WHERE field IN ('personName', 'personId', 'houseCode') GROUP BY entry_id HAVING count(*) = 3)""")
def a08(spark, sf):
    return AC.critical_accuracy(AC.compare_fields(_matched(spark, sf), review_values(spark, sf)))


# --- validation ---------------------------------------------------------------------

REQUIRED_SQL = "(VALUES " + ", ".join(f"('{f}')" for f in K.REQUIRED_FIELDS) + ") q(field)"
ISSUES = REV + f""", t AS (SELECT *, trim(value) AS v, (source IN ('source_dash', 'source_blank') OR coalesce(review_status, '') = 'empty_in_source') AS gone FROM rv),
 ok AS (SELECT * EXCLUDE (value), v AS value FROM t), vd AS (SELECT record_id, field, v, gone, source, review_status, {VALID} AS valid FROM (SELECT *, value AS v FROM ok)),
 ids AS (SELECT record_id, field, {DIG} AS d, count(*) OVER (PARTITION BY record_id, {DIG}) AS n FROM ok WHERE field IN {IDS} AND {DIG} <> ''),
 w AS (SELECT m.record_id, m.v AS mn, f.v AS fn FROM vd m JOIN vd f ON m.record_id = f.record_id AND m.field = 'motherName' AND f.field = 'fatherName'),
 iss AS (
  SELECT r.record_id, q.field, 'missing_or_invalid' AS issue FROM (SELECT DISTINCT record_id FROM rv) r CROSS JOIN {REQUIRED_SQL}
   LEFT JOIN vd ON vd.record_id = r.record_id AND vd.field = q.field WHERE vd.field IS NULL OR (NOT gone AND NOT valid)
  UNION SELECT record_id, field, 'needs_review' FROM vd WHERE review_status = 'needs_review'
  UNION SELECT n.record_id, i.field, 'parent_id_missing' FROM vd n JOIN vd i ON n.record_id = i.record_id AND i.field = replace(n.field, 'Name', 'Id')
   WHERE n.field IN ('motherName', 'fatherName') AND n.v <> '' AND i.v = '' AND NOT i.gone
  UNION SELECT record_id, field, 'suspicious_id' FROM ids WHERE length(d) = 13 AND (length(d) - length(replace(d, '0', '')) >= 8 OR contains(d, '00000'))
  UNION SELECT record_id, field, 'duplicate_id' FROM ids WHERE n > 1
  UNION SELECT record_id, unnest(['motherName', 'fatherName']), 'duplicate_parent_name' FROM w WHERE mn <> '' AND regexp_replace(mn, '\\s', '', 'g') = regexp_replace(fn, '\\s', '', 'g')
  UNION SELECT n.record_id, n.field, 'short_parent_name' FROM vd n JOIN vd i ON n.record_id = i.record_id AND i.field = replace(n.field, 'Name', 'Id')
   WHERE n.field IN ('motherName', 'fatherName') AND n.v <> '' AND length(regexp_replace(n.v, '\\s', '', 'g')) <= 3
    AND NOT (i.valid AND (contains(n.source, 'crop_ocr') OR contains(n.source, 'vision')))) """


@query("J13_duplicate_ids", ISSUES + "SELECT record_id, field FROM ids WHERE n > 1")
def j13(spark, sf):
    return V.duplicate_ids(review_values(spark, sf)).select("record_id", "field")


@query("H08_validation_issues", ISSUES + "SELECT record_id, field, issue FROM iss")
def h08(spark, sf):
    return V.validation_issues(review_values(spark, sf))


@query("A17_issues_by_field", ISSUES + "SELECT record_id, field, array_to_string(list_sort(list(issue)), ',') AS issues FROM iss GROUP BY 1, 2")
def a17(spark, sf):
    return V.issues_by_field(V.validation_issues(review_values(spark, sf))).withColumn("issues", F.array_join("issues", ","))


@query("P20_field_needs_review", ISSUES + """, n AS (SELECT record_id, field, count(*) AS n FROM iss GROUP BY 1, 2)
 SELECT rv.record_id, rv.field, coalesce(review_status, '') = 'needs_review' OR k % 6 = 0 OR coalesce(n, 0) > 0 AS needed FROM rv LEFT JOIN n ON n.record_id = rv.record_id AND n.field = rv.field""")
def p20(spark, sf):
    values = review_values(spark, sf)
    n = V.validation_issues(values).groupBy("record_id", "field").agg(F.count("*").alias("n"))
    alternatives = F.when(F.col("k") % 6 == 0, 2).otherwise(0)
    return values.join(n, ["record_id", "field"], "left").select("record_id", "field", V.field_needs_review(F.col("review_status"), alternatives, F.col("n")).alias("needed"))


PAGE = "CASE WHEN k % 15 = 4 THEN ' short page ' ELSE text END"
REASON = "CASE k % 3 WHEN 0 THEN 'OCR quality looked usable after comparing models' WHEN 1 THEN '' ELSE CASE WHEN k % 2 = 0 THEN 'repeated line' ELSE NULL END END"


@query("H09_quality_label", ISSUES + f""", n AS (SELECT record_id, count(*) AS n FROM iss GROUP BY 1)
 SELECT k, CASE WHEN length(trim({PAGE})) < 40 THEN 'low_confidence' WHEN coalesce(n, 0) > 0 OR k % 14 = 1 OR coalesce({REASON} = 'repeated line', false) THEN 'needs_review' ELSE 'auto_verified' END AS quality
 FROM frm LEFT JOIN n ON n.record_id = concat('P', CAST(k AS STRING))""")
def h09(spark, sf):
    n = V.validation_issues(review_values(spark, sf)).groupBy("record_id").agg(F.count("*").alias("n"))
    forms = fx.forms(spark, sf).withColumn("record_id", F.concat(F.lit("P"), F.col("k").cast("string")))
    label = V.quality_label(F.expr(PAGE), F.col("n"), F.col("k") % 14 == 1, F.array_compact(F.array(F.expr(REASON))))
    return forms.join(n, "record_id", "left").select("k", label.alias("quality"))


READ_STATUS = "CASE k % 6 WHEN 0 THEN 'failed' WHEN 1 THEN NULL ELSE 'succeeded' END"
READ_QUALITY = "CASE k % 4 WHEN 0 THEN 'auto_verified' WHEN 1 THEN 'needs_review' ELSE NULL END"


@query("A06_quality_summary", ISSUES + f""", rec AS (SELECT concat('b', CAST(k % 20 AS STRING)) AS batch_id, {READ_STATUS} AS s, {READ_QUALITY} AS q, k FROM frm),
 f AS (SELECT DISTINCT field FROM lng)
 SELECT batch_id, 'ocr_status' AS kind, coalesce(s, '') AS key, count(*) AS n FROM rec GROUP BY 1, 3
 UNION ALL SELECT batch_id, 'ocr_quality', coalesce(q, ''), count(*) FROM rec GROUP BY 1, 3
 UNION ALL SELECT rec.batch_id, 'missing', f.field, count(*) FROM rec CROSS JOIN f LEFT JOIN rv ON rv.k = rec.k AND rv.field = f.field WHERE trim(coalesce(rv.value, '')) = '' GROUP BY 1, 3
 UNION ALL SELECT 'b' || CAST(CAST(substr(record_id, 2) AS BIGINT) % 20 AS VARCHAR), 'issue', issue, count(*) FROM iss GROUP BY 1, 3""")
def a06(spark, sf):
    values = review_values(spark, sf)
    batch = F.concat(F.lit("b"), (F.substr("record_id", F.lit(2)).cast("long") % 20).cast("string"))
    records = fx.forms(spark, sf).selectExpr("concat('b', CAST(k % 20 AS STRING)) AS batch_id", f"{READ_STATUS} AS ocr_status", f"{READ_QUALITY} AS ocr_quality")
    return AC.quality_summary(records, values, V.validation_issues(values).withColumn("batch_id", batch))


# --- alternatives and votes -----------------------------------------------------------

# three readings of each name: equal, spaced, or other ones, from crops and a parser
CAND_COLUMNS = [
    ("record_id", "concat('P', CAST(k AS STRING))"),
    ("field", "field"),
    ("seq", "k * 3 + i"),
    ("value", "CASE WHEN (k + i) % 13 = 0 THEN ' ' WHEN i = 1 THEN value WHEN (k + i) % 5 = 0 THEN concat(value, 'กก') WHEN (k + i) % 5 = 1 THEN concat('กรม ', value) WHEN i = 2 THEN concat(' ', value) ELSE value END"),
    ("source", "CASE (k + i) % 4 WHEN 0 THEN 'field_crop_a' WHEN 1 THEN 'slot' WHEN 2 THEN '' ELSE 'field_crop_b' END"),
    ("reason", "CASE (k + i) % 3 WHEN 0 THEN '' WHEN 1 THEN concat('r', CAST(i AS STRING)) ELSE NULL END"),
    ("score", "CASE WHEN (k + i) % 6 = 0 THEN NULL ELSE ((k * 7 + i * 3) % 10) / 10.0D END"),
]
CAND_SQL = ", ".join(f"{e.replace('10.0D', '10.0::DOUBLE')} AS {a}" for a, e in CAND_COLUMNS)
CAND = LNG + f", cd AS (SELECT {CAND_SQL} FROM lng, range(1, 4) t(i) WHERE field IN ('personName', 'motherName', 'fatherName')) "
SQUEEZE = r"regexp_replace(value, '\s', '', 'g')"


def candidates(spark, sf):
    rows = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).withColumn("i", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.selectExpr(*[f"{e} AS {a}" for a, e in CAND_COLUMNS])


@query("A15_merge_alternatives", CAND + f""", c AS (SELECT *, {SQUEEZE} AS compact FROM cd),
 s AS (SELECT record_id, field, compact, source, min(seq) AS seq FROM c WHERE source <> '' GROUP BY 1, 2, 3, 4)
 SELECT c.record_id, c.field, c.compact, arg_min(value, c.seq) AS value, arg_min(reason, c.seq) FILTER (coalesce(reason, '') <> '') AS reason, max(score) AS score,
  coalesce((SELECT string_agg(source, ',' ORDER BY s.seq) FROM s WHERE s.record_id = c.record_id AND s.field = c.field AND s.compact = c.compact), '') AS sources
 FROM c GROUP BY 1, 2, 3""")
def a15(spark, sf):
    return V.merge_alternatives(candidates(spark, sf)).select("record_id", "field", "compact", "value", "reason", "score", F.array_join("sources", ",").alias("sources"))


@query("A18_best_scored_value", CAND + f""", b AS (SELECT record_id, field, arg_max(value, score * 1000000000000 - seq) AS best FROM cd WHERE score IS NOT NULL GROUP BY 1, 2),
 cur AS (SELECT concat('P', CAST(k AS STRING)) AS record_id, field, value FROM lng WHERE field IN ('personName', 'motherName', 'fatherName'))
 SELECT cur.record_id, cur.field, CASE WHEN best IS NOT NULL AND {SQUEEZE.replace('value', 'best')} <> {SQUEEZE.replace('value', 'cur.value')} THEN best ELSE cur.value END AS value,
  best IS NOT NULL AND {SQUEEZE.replace('value', 'best')} <> {SQUEEZE.replace('value', 'cur.value')} AS changed FROM cur LEFT JOIN b ON b.record_id = cur.record_id AND b.field = cur.field""")
def a18(spark, sf):
    current = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).selectExpr("concat('P', CAST(k AS STRING)) AS record_id", "field", "value")
    return V.best_scored_value(current, candidates(spark, sf))


@query("A10_vote", CAND + f""", g AS (SELECT record_id, field, {SQUEEZE} AS c, arg_min(value, seq) AS value, arg_min(source, seq) AS source, count(*) AS votes, bool_or(contains(source, 'field_crop')) AS focused, min(seq) AS seq
  FROM cd WHERE {SQUEEZE} <> '' GROUP BY 1, 2, 3),
 s AS (SELECT *, CASE WHEN field = 'personName' OR NOT contains(value, 'กรม') THEN 1 ELSE 0 END * 100 + votes * 10 + focused::INT AS score FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY record_id, field ORDER BY score DESC, seq) AS rn, count(*) OVER (PARTITION BY record_id, field, score) AS n FROM s)
 SELECT record_id, field, CASE WHEN NOT (n > 1 AND field <> 'personName') THEN value END AS value,
  CASE WHEN NOT (n > 1 AND field <> 'personName') THEN CASE WHEN votes = 1 THEN source ELSE source || '_consensus' END END AS source, n > 1 AND field <> 'personName' AS refused FROM r WHERE rn = 1""")
def a10(spark, sf):
    return V.vote(candidates(spark, sf))


@query("A20_append_issues", CAND + f""", e AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'mismatch' ELSE 'short' END AS type, {SQUEEZE} AS c FROM cd),
 h AS (SELECT record_id, field, type, arg_min('m' || source, seq) AS message, arg_min(c, seq) <> '' AS opens FROM e GROUP BY 1, 2, 3),
 a AS (SELECT record_id, field, type, c, min(seq) AS seq, arg_min(value, seq) AS value FROM e WHERE c <> '' GROUP BY 1, 2, 3, 4)
 SELECT h.record_id, h.field, h.type, message, CASE WHEN opens THEN coalesce((SELECT string_agg(a.value, '|' ORDER BY a.seq) FROM a WHERE a.record_id = h.record_id AND a.field = h.field AND a.type = h.type), '') ELSE '' END AS alternatives FROM h""")
def a20(spark, sf):
    events = candidates(spark, sf).selectExpr("record_id", "field", "CASE WHEN seq % 2 = 0 THEN 'mismatch' ELSE 'short' END AS type", "concat('m', source) AS message", "value AS alternative", "seq")
    return V.append_issues(events).withColumn("alternatives", F.array_join("alternatives", "|"))


CHOICE = {"s": "CASE WHEN k % 8 = 0 THEN NULL ELSE mother_name END", "p": "CASE k % 3 WHEN 0 THEN mother_name WHEN 1 THEN father_name ELSE '' END",
          "c": "CASE k % 4 WHEN 0 THEN concat(' ', mother_name) WHEN 1 THEN NULL ELSE concat(mother_name, 'ก') END", "v": "CASE k % 5 WHEN 0 THEN mother_name WHEN 1 THEN 'ข' ELSE NULL END"}


@query("F45_consensus_label", LNG + ", x AS (SELECT k, " + ", ".join(f"nullif(trim(coalesce({e}, '')), '') AS {a}" for a, e in CHOICE.items()) + """ FROM frm),
 y AS (SELECT *, list_filter(['parser', 'crop', 'vision'], lambda n, i: coalesce([p, c, v][i] = s, false)) AS m, len(list_distinct(list_filter([p, c, v], lambda z: z IS NOT NULL))) AS kinds FROM x)
 SELECT k, CASE WHEN s IS NULL THEN NULL WHEN len(m) >= 2 THEN 'confirmed_by_' || array_to_string(m, '_') WHEN kinds > 1 THEN 'candidate_conflict' WHEN len(m) = 1 THEN 'single_' || m[1] END AS label FROM y""")
def f45(spark, sf):
    return fx.forms(spark, sf).select("k", V.consensus_label(*[F.expr(e) for e in CHOICE.values()]).alias("label"))


WHY = {"field": "CASE k % 2 WHEN 0 THEN 'age' ELSE 'gender' END", "source": "CASE k % 5 WHEN 0 THEN '' ELSE concat('s', CAST(k % 5 AS STRING)) END",
       "derived": "CASE k % 9 WHEN 0 THEN 'verified' WHEN 2 THEN 'corrected_mismatch' WHEN 4 THEN 'derived_missing' WHEN 6 THEN 'flagged_mismatch_kept_ocr' WHEN 8 THEN 'promoted_crop_ocr_alternative' ELSE '' END",
       "crop": "CASE WHEN k % 7 = 1 THEN 'filled' ELSE NULL END", "vision": "CASE WHEN k % 7 = 3 THEN 'filled' ELSE '' END", "dash": "k % 11 = 3"}


@query("F46_selection_reason", LNG + ", x AS (SELECT k, " + ", ".join(f"{e} AS {a}" for a, e in WHY.items()) + """ FROM frm)
 SELECT k, CASE WHEN dash THEN 'source image showed a dash in this field'
  WHEN field = 'age' AND derived <> '' THEN CASE derived WHEN 'verified' THEN 'OCR/parser age matched birthDate and updateDate' WHEN 'corrected_mismatch' THEN 'calculated age replaced an OCR/Vision mismatch'
   WHEN 'derived_missing' THEN 'age was calculated from birthDate and updateDate' WHEN 'flagged_mismatch_kept_ocr' THEN 'OCR/crop age was kept and calculated age was shown as an alternative'
   ELSE 'crop OCR age was promoted over the parser/calculated mismatch' END
  WHEN crop IS NOT NULL THEN 'crop OCR filled or corrected this validated field'
  WHEN vision <> '' THEN CASE WHEN field = 'age' THEN 'Vision read age only after parser and date calculation were unavailable' ELSE 'Vision filled or corrected this field from its crop' END
  WHEN source <> '' THEN 'selected from ' || source ELSE 'no selected value' END AS reason FROM x""")
def f46(spark, sf):
    x = fx.forms(spark, sf).select("k", *[F.expr(e).alias(a) for a, e in WHY.items()])
    return x.select("k", V.selection_reason(*[F.col(c) for c in WHY]).alias("reason"))


@query("H16_apply_staff_edits", REV + """, ed AS (SELECT record_id, field, 'staff ' || value AS value, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'checked' END AS st FROM rv WHERE (k + length(field)) % 4 = 0
  UNION ALL SELECT record_id, 'note', 'new', NULL FROM rv WHERE field = 'age' AND k % 9 = 2)
 SELECT coalesce(rv.record_id, ed.record_id) AS record_id, coalesce(rv.field, ed.field) AS field, CASE WHEN ed.record_id IS NOT NULL THEN ed.value ELSE rv.value END AS value,
  CASE WHEN ed.record_id IS NOT NULL THEN coalesce(nullif(st, ''), 'staff_verified') ELSE rv.review_status END AS review_status FROM rv FULL JOIN ed ON ed.record_id = rv.record_id AND ed.field = rv.field""")
def h16(spark, sf):
    values = review_values(spark, sf)
    status = "CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'checked' END AS review_status"
    edits = values.filter("(k + length(field)) % 4 = 0").selectExpr("record_id", "field", "concat('staff ', value) AS value", status)
    notes = values.filter("field = 'age' AND k % 9 = 2").selectExpr("record_id", "'note' AS field", "'new' AS value", "CAST(NULL AS STRING) AS review_status")
    return V.apply_staff_edits(values, edits.unionByName(notes))


# --- document store --------------------------------------------------------------------

DOC = f"WITH doc AS ({fx.DOCS_SQL}) "
NEEDS = """CASE WHEN status IN ('cleaning','ocr_running') THEN false WHEN status = 'checked' AND coalesce(ocr_markdown,'') <> '' AND coalesce(ocr_error_message,'') = '' THEN false
 WHEN status IN ('uploaded','ocr_queued','ocr_failed') THEN true WHEN coalesce(ocr_error_message,'') <> '' OR trim(coalesce(ocr_markdown,'')) = '' THEN true
 ELSE coalesce(try_cast(ocr_pipeline_version AS INT), 0) < CASE WHEN coalesce(lower(trim(document_category)) IN ('tr','tor_ror'), false) THEN 80 ELSE 71 END END"""




@query("S02_fingerprint", "SELECT page_id, sha1(html) AS source_fingerprint FROM pages")
def s02(spark, sf):
    return table(spark, sf, "pages").select("page_id", ST.fingerprint(F.encode("html", "UTF-8")).alias("source_fingerprint"))


@query("S03_ingest_dedup", DOC + f""", old AS (SELECT * FROM doc WHERE seq % 3 < 2 QUALIFY row_number() OVER (PARTITION BY source_fingerprint ORDER BY seq) = 1),
 new AS (SELECT 'N' || seq AS id, source_fingerprint, CASE WHEN seq % 2 = 0 THEN document_category ELSE 'judgment' END AS cat, 'now' || seq AS seen_at FROM doc WHERE seq % 3 > 0
  QUALIFY row_number() OVER (PARTITION BY source_fingerprint ORDER BY seq) = 1),
 j AS (SELECT old.* EXCLUDE (source_fingerprint), coalesce(old.source_fingerprint, new.source_fingerprint) AS fp, new.id AS nid, cat, seen_at, {NEEDS} AS needs FROM old FULL JOIN new ON old.source_fingerprint = new.source_fingerprint),
 a AS (SELECT *, CASE WHEN id IS NULL THEN 'insert' WHEN nid IS NULL THEN 'keep' WHEN coalesce(nullif(document_category, ''), 'uncategorized') <> coalesce(nullif(cat, ''), 'uncategorized') OR needs THEN 'requeue' ELSE 'refresh' END AS action FROM j)
 SELECT coalesce(id, nid) AS id, fp AS source_fingerprint, CASE WHEN nid IS NOT NULL THEN cat ELSE document_category END AS document_category,
  CASE WHEN action IN ('insert', 'requeue') THEN 'ocr_queued' ELSE status END AS status, CASE WHEN nid IS NOT NULL THEN seen_at ELSE updated_at END AS updated_at,
  CASE WHEN action NOT IN ('insert', 'requeue') THEN ocr_error_message END AS ocr_error_message, CASE WHEN action <> 'insert' THEN ocr_markdown END AS ocr_markdown, action FROM a""")
def s03(spark, sf):
    docs = fx.import_documents(spark, sf)
    first = docs.filter("seq % 3 < 2").groupBy("source_fingerprint").agg(F.min("seq").alias("seq"))
    old = docs.join(first, ["source_fingerprint", "seq"])
    new = docs.filter("seq % 3 > 0").selectExpr("concat('N', CAST(seq AS STRING)) AS id", "source_fingerprint", "CASE WHEN seq % 2 = 0 THEN document_category ELSE 'judgment' END AS document_category",
                                                "concat('now', CAST(seq AS STRING)) AS seen_at", "seq")
    return ST.ingest_dedup(new, old)


STORE_DOC = [("_id", "CASE WHEN seq % 9 = 4 THEN ' ' ELSE concat('k', CAST(CAST(floor(seq / 3) AS BIGINT) AS STRING)) END"), ("id", "CASE WHEN seq % 18 = 4 THEN NULL ELSE id END"),
             ("source_fingerprint", "CASE WHEN seq % 10 = 1 THEN '' ELSE source_fingerprint END"), ("status", "status"), ("document_category", "document_category"),
             ("created_at", "created_at"), ("updated_at", "updated_at"), ("save_btn", "save_btn"), ("total_pages", "total_pages")]


def _rows(spark, sf):
    docs = fx.import_documents(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in STORE_DOC])
    return ST.write_rows(docs, "imports")


KEYED = DOC + ", k AS (SELECT " + ", ".join(f"{e} AS {a}" for a, e in STORE_DOC) + """ FROM doc),
 w AS (SELECT *, coalesce(CASE WHEN trim(_id) <> '' THEN _id END, id, '') AS record_key FROM k) """


@query("S05_write_document_store", KEYED + """SELECT 'imports' AS record_type, record_key, source_fingerprint, status, document_category, created_at, updated_at,
 upper(coalesce(nullif(left(trim(coalesce(save_btn, '')), 1), ''), 'N')) AS save_btn, record_key = '' AS refused FROM w""")
def s05(spark, sf):
    return _rows(spark, sf).drop("payload_json")


@query("S04_read_document_store", KEYED + """SELECT record_key, status, total_pages FROM w WHERE total_pages <> 3""")
def s04(spark, sf):
    """Payloads of three pages are spoiled: cut off, not an object, or missing."""
    bad = F.when(F.length("record_key") % 3 == 0, F.left("payload_json", F.lit(20))).when(F.length("record_key") % 3 == 1, F.lit("[1, 2]"))
    spoiled = F.get_json_object("payload_json", "$.total_pages") == "3"
    rows = _rows(spark, sf).withColumn("payload_json", F.when(spoiled, bad).otherwise(F.col("payload_json")))
    return ST.read_rows(rows, "imports", "status string, total_pages int")


@query("S07_unique_violations", KEYED + """SELECT 'record_key' AS "column", 'imports' AS record_type, record_key AS value, count(*) AS n FROM w GROUP BY record_key HAVING count(*) > 1
 UNION ALL SELECT 'source_fingerprint', 'imports', source_fingerprint, count(*) FROM w WHERE source_fingerprint <> '' GROUP BY source_fingerprint HAVING count(*) > 1""")
def s07(spark, sf):
    return ST.unique_violations(_rows(spark, sf))


# every document's pages; every document saves one, half of them twice, and some a page that isn't there yet
SAVES = """SELECT doc_id, 1 + doc_id % 5 AS page_number, text AS markdown, doc_id AS seq FROM {documents}
 UNION ALL SELECT doc_id, 1 + doc_id % 5, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat(text, ' again') END, doc_id + 1000000000000 FROM {documents} WHERE doc_id % 2 = 0"""


@query("S14_save_pages", f"""WITH pg AS (SELECT doc_id, p AS page_number, source AS markdown FROM documents, range(1, 4) t(p)), sv AS (SELECT * FROM ({SAVES.replace('{documents}', 'documents')}) QUALIFY row_number() OVER (PARTITION BY doc_id, page_number ORDER BY seq DESC) = 1)
 SELECT coalesce(pg.doc_id, sv.doc_id) AS doc_id, coalesce(pg.page_number, sv.page_number) AS page_number, CASE WHEN sv.doc_id IS NOT NULL THEN sv.markdown ELSE pg.markdown END AS markdown, sv.doc_id IS NOT NULL AS replaced
 FROM pg FULL JOIN sv ON pg.doc_id = sv.doc_id AND pg.page_number = sv.page_number""")
def s14(spark, sf):
    docs = table(spark, sf, "documents")
    pages = docs.selectExpr("doc_id", "explode(sequence(1L, 3L)) AS page_number", "source AS markdown")
    return ST.save_pages(pages, spark.sql(SAVES, documents=docs))


# four documents are the pages of one; blank pages are rows of their own
PROCESSED = """SELECT CAST(floor(doc_id / 4) AS BIGINT) AS doc_id, text AS markdown FROM {documents} UNION ALL SELECT CAST(floor(doc_id / 4) AS BIGINT), '  ' FROM {documents} WHERE doc_id % 6 = 0
 UNION ALL SELECT -1 - doc_id, NULL FROM {documents} WHERE doc_id % 10 = 3"""


@query("S14_processed_pages", f"SELECT doc_id, count(*) FILTER (trim(coalesce(markdown, '')) <> '') AS processed_pages, count(*) AS total_pages FROM ({PROCESSED.replace('{documents}', 'documents')}) GROUP BY 1")
def s14p(spark, sf):
    return ST.processed_pages(spark.sql(PROCESSED, documents=table(spark, sf, "documents")))


# --- candidate union ---------------------------------------------------------------------

@query("X04_candidate_union", CAND + f"""SELECT record_id, field, {SQUEEZE} AS compact, min(seq) AS seq FROM (SELECT record_id, field, value, seq FROM cd UNION ALL
 SELECT concat('P', CAST(k AS STRING)), field, value, 0 FROM lng WHERE field IN ('personName', 'motherName', 'fatherName')) GROUP BY 1, 2, 3""")
def x04(spark, sf):
    current = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).selectExpr("concat('P', CAST(k AS STRING)) AS record_id", "field", "value", "0L AS seq")
    both = candidates(spark, sf).select("record_id", "field", "value", "seq").unionByName(current)
    return V.merge_alternatives(both.withColumns({"source": F.lit(""), "reason": F.lit(""), "score": F.lit(0.0)})).select("record_id", "field", "compact", "seq")


# --- work list for reading again -----------------------------------------------------------------

_BOXED = ", ".join(f"('{f}')" for f, _, box, _ in K.FIELD_TEMPLATES if box is not None)


def _reread_sql(mode: str) -> str:
    always = "('age', 'address', 'personName', 'motherName', 'fatherName', 'houseCode')" if mode == "aggressive" else "('age', 'address')"
    return REV + f""", base AS (SELECT r.record_id, q.field, rv.k, trim(coalesce(rv.value, '')) AS v, trim(coalesce(rv.value, '')) AS value, rv.source, rv.review_status FROM (SELECT DISTINCT record_id FROM rv) r CROSS JOIN (VALUES {_BOXED}) q(field)
   LEFT JOIN rv ON rv.record_id = r.record_id AND rv.field = q.field),
 nm AS (SELECT record_id, max(CASE WHEN field = 'motherName' THEN regexp_replace(v, '\\s', '', 'g') END) AS mn, max(CASE WHEN field = 'fatherName' THEN regexp_replace(v, '\\s', '', 'g') END) AS fn FROM base GROUP BY 1),
 t AS (SELECT base.*, {VALID} AS valid, mn, fn, {DIG} AS d FROM base JOIN nm ON nm.record_id = base.record_id),
 w AS (SELECT record_id, field, CASE WHEN source IN ('source_dash', 'source_blank') OR review_status = 'empty_in_source' THEN NULL WHEN field IN {always} THEN 'always' WHEN NOT valid THEN 'invalid' WHEN review_status = 'needs_review' THEN 'needs_review'
   WHEN (k * 2 + length(field)) % 9 > 6 THEN 'alternatives' WHEN (k + length(field)) % 12 = 0 THEN 'quality_issue' WHEN field IN {IDS} AND length(d) = 13 AND (length(d) - length(replace(d, '0', '')) >= 8 OR contains(d, '00000')) THEN 'suspicious_id'
   WHEN field IN ('motherName', 'fatherName') AND length(regexp_replace(v, '\\s', '', 'g')) <= 3 THEN 'short_parent_name' WHEN field IN ('motherName', 'fatherName') AND mn <> '' AND mn = fn THEN 'duplicate_parent_name' END AS reason FROM t)
 SELECT * FROM w WHERE reason IS NOT NULL"""


def _reread(spark, sf, mode):
    rv = review_values(spark, sf)
    alternatives = rv.selectExpr("record_id", "field", "CASE WHEN (k * 2 + length(field)) % 9 > 6 THEN 2 ELSE 1 END AS n")
    issues = rv.select("record_id", "field", F.explode(F.expr("CASE WHEN (k + length(field)) % 12 = 0 THEN array(1, 2) ELSE array() END")))
    return V.select_fields_to_reread(rv, alternatives, issues, mode)


@query("P21_fields_to_reread", _reread_sql("selective"))
def p21(spark, sf):
    return _reread(spark, sf, "selective")


@query("P21_fields_to_reread_aggressive", _reread_sql("aggressive"))
def p21_aggressive(spark, sf):
    return _reread(spark, sf, "aggressive")
