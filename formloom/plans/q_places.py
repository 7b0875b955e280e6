"""Queries of the location hierarchy and the corrections dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import constants as K
from formloom import fixtures as fx
from formloom.functions import compare as C
from formloom.operators import corrections as CO
from formloom.operators import location as L
from formloom.plans.q_thai import FRM, LNG, PLACE
from formloom.plans.registry import query

# --- locations: codes follow the forms' own places ------------------------------------

FRM_R = FRM.replace("WITH ", "WITH RECURSIVE ", 1)
PROVINCE_COLUMNS = [("province_code", "k % 3"), ("province", PLACE["pro"])]
DISTRICT_COLUMNS = [("province_code", "k % 3"), ("district_code", "(k % 3) * 10 + k % 5"), ("district", PLACE["dis"])]
SUBDISTRICT_COLUMNS = [
    ("province_code", "k % 3"), ("district_code", "(k % 3) * 10 + k % 5"),
    ("subdistrict", f"CASE WHEN k % 45 = 7 THEN ' ' ELSE {PLACE['sub']} END"),
    ("postal_code", "CAST(10000 + ((k % 3) * 10 + k % 5) * 10 + CASE WHEN k % 5 = 2 THEN k % 2 ELSE 0 END AS STRING)"),
]


def _columns(columns):
    return ", ".join(f"{e} AS {a}" for a, e in columns)


DIM = LNG + f""", pr AS (SELECT DISTINCT {_columns(PROVINCE_COLUMNS)} FROM frm), di AS (SELECT DISTINCT {_columns(DISTRICT_COLUMNS)} FROM frm),
 su AS (SELECT {_columns(SUBDISTRICT_COLUMNS)}, min(k) AS seq FROM frm GROUP BY ALL),
 dim AS (SELECT su.province_code, su.district_code, province, district, subdistrict, postal_code, seq FROM su JOIN pr ON pr.province_code = su.province_code
  JOIN di ON di.district_code = su.district_code WHERE trim(province) <> '' AND trim(district) <> '' AND trim(subdistrict) <> '') """


def location_dim(spark, sf):
    forms = fx.forms(spark, sf)
    named = lambda c: forms.selectExpr(*[f"{e} AS {a}" for a, e in c])
    sub = forms.selectExpr("k", *[f"{e} AS {a}" for a, e in SUBDISTRICT_COLUMNS]).groupBy(*[a for a, _ in SUBDISTRICT_COLUMNS]).agg(F.min("k").alias("seq"))
    return L.location_dim(named(PROVINCE_COLUMNS).distinct(), named(DISTRICT_COLUMNS).distinct(), sub)


@query("J02_location_dim", DIM + "SELECT * FROM dim")
def j02(spark, sf):
    return location_dim(spark, sf)


# what a page reads: right, one letter off, two off, or another place
READ_COLUMNS = [
    ("k", "k"),
    ("p", f"CASE k % 11 WHEN 1 THEN concat({PLACE['pro']}, 'ๆ') WHEN 2 THEN 'แดนไกล' ELSE {PLACE['pro']} END"),
    ("d", f"CASE k % 7 WHEN 1 THEN concat('ฮ', substr({PLACE['dis']}, 2)) ELSE {PLACE['dis']} END"),
    ("s", f"CASE k % 5 WHEN 1 THEN concat({PLACE['sub']}, 'ๆ') WHEN 2 THEN concat(substr({PLACE['sub']}, 1, length({PLACE['sub']}) - 2), 'ๆๆ') WHEN 3 THEN 'ไม่รู้จัก' ELSE {PLACE['sub']} END"),
]
# the longest common block of a[alo:ahi] and b[blo:bhi] as one number: length, then how early it starts in a, in b
_BLOCK = """list_max(flatten(list_transform(range({0}, {1}), lambda i: list_transform(range({2}, {3}), lambda j:
  coalesce(list_min(list_filter(range(0, least({1} - i, {3} - j)), lambda t: substr(a, (i + t + 1)::INT, 1) <> substr(b, (j + t + 1)::INT, 1))), least({1} - i, {3} - j)) * 1000000
  + (999 - i) * 1000 + (999 - j)))))"""


def ratio_sql(pairs: str) -> str:
    """CTEs ``rec`` and ``ratio(a, b, r)`` of the distinct names in the CTE ``pairs(a, b)``; they need WITH RECURSIVE."""
    first = _BLOCK.format("0", "length(a)", "0", "length(b)")
    return f"""rec(a, b, alo, ahi, blo, bhi, x) AS (
  SELECT a, b, 0::BIGINT, length(a)::BIGINT, 0::BIGINT, length(b)::BIGINT, {first} FROM {pairs} WHERE a <> '' AND b <> ''
  UNION ALL SELECT a, b, lo, hi, lo2, hi2, {_BLOCK.format('lo', 'hi', 'lo2', 'hi2')} FROM (
   SELECT a, b, CASE side WHEN 0 THEN alo ELSE i + k END AS lo, CASE side WHEN 0 THEN i ELSE ahi END AS hi, CASE side WHEN 0 THEN blo ELSE j + k END AS lo2, CASE side WHEN 0 THEN j ELSE bhi END AS hi2
   FROM (SELECT *, x // 1000000 AS k, 999 - x // 1000 % 1000 AS i, 999 - x % 1000 AS j FROM rec WHERE x >= 1000000) s CROSS JOIN (VALUES (0), (1)) v(side)) c WHERE lo < hi AND lo2 < hi2),
 ratio AS (SELECT a, b, 2.0::DOUBLE * sum(x // 1000000) / any_value(length(a) + length(b)) AS r FROM rec GROUP BY a, b)"""


BEST = DIM.replace("WITH ", "WITH RECURSIVE ", 1) + f""", rd AS (SELECT {_columns(READ_COLUMNS)} FROM frm), a AS (SELECT DISTINCT p, d, s FROM rd),
 nm AS (SELECT DISTINCT p AS a, province AS b FROM a, dim UNION SELECT DISTINCT d, district FROM a, dim UNION SELECT DISTINCT s, subdistrict FROM a, dim), {ratio_sql('nm')},
 x AS (SELECT a.*, dim.*, rp.r AS p_score, rd2.r AS d_score, rs.r AS s_score FROM a CROSS JOIN dim JOIN ratio rp ON rp.a = p AND rp.b = province
  JOIN ratio rd2 ON rd2.a = d AND rd2.b = district JOIN ratio rs ON rs.a = s AND rs.b = subdistrict),
 y AS (SELECT * FROM x WHERE p_score >= 0.82 QUALIFY p_score >= max(p_score) OVER (PARTITION BY p, d, s) - 0.02),
 z AS (SELECT * FROM y WHERE d_score >= 0.82 QUALIFY d_score >= max(d_score) OVER (PARTITION BY p, d, s) - 0.02),
 r AS (SELECT *, row_number() OVER w AS rn, lead(s_score) OVER w AS second, len(list_distinct(list(postal_code) OVER (PARTITION BY p, d, s))) AS codes FROM z WINDOW w AS (PARTITION BY p, d, s ORDER BY s_score DESC, d_score DESC, p_score DESC, seq)),
 b AS (SELECT *, s_score - coalesce(second, 0) AS gap, s_score < 0.82 AND p_score >= 0.96 AND d_score >= 0.96 AND s_score >= 0.7 AND s_score - coalesce(second, 0) >= 0.2 AND codes = 1 AS rescued FROM r WHERE rn = 1)"""


@query("J03_best_location", BEST + """ SELECT rd.k, CASE WHEN s_score >= 0.82 OR rescued THEN province END AS province, CASE WHEN s_score >= 0.82 OR rescued THEN district END AS district, CASE WHEN s_score >= 0.82 OR rescued THEN subdistrict END AS subdistrict,
  round(CASE WHEN rescued THEN 0.82 ELSE s_score END, 6) AS s_score, round(gap, 6) AS lead, round(CASE WHEN s_score >= 0.82 OR rescued THEN least(p_score, d_score, CASE WHEN rescued THEN 0.82 ELSE s_score END) END, 6) AS confidence
 FROM rd LEFT JOIN b ON b.p = rd.p AND b.d = rd.d AND b.s = rd.s""")
def j03(spark, sf):
    read = fx.forms(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in READ_COLUMNS])
    found = L.best_location(read, location_dim(spark, sf))
    return found.select("k", "province", "district", "subdistrict", *[F.round(c, 6).alias(c) for c in ("s_score", "lead", "confidence")])


# an address of what was read; some have no places, some are blank
ADDRESS = "CASE WHEN k % 17 = 5 THEN ' ' WHEN k % 13 = 4 THEN concat(CAST(k AS STRING), ' หมู่ 3') ELSE concat(CAST(k AS STRING), ' หมู่ 3  ต.', s, ' อ.', d, ' จ.', p) END"


@query("H11_validate_address", BEST + f""", ad AS (SELECT rd.*, {ADDRESS} AS address FROM rd),
 m AS (SELECT ad.k, address, ad.p AS rp, ad.d AS rd_, ad.s AS rs, k % 13 = 4 AS unread, NOT k % 13 = 4 AND coalesce(s_score >= 0.82 OR rescued, false) AS found, b.* FROM ad LEFT JOIN b ON b.p = ad.p AND b.d = ad.d AND b.s = ad.s WHERE trim(address) <> ''),
 e AS (SELECT *, rp = province AND rd_ = district AND rs = subdistrict AS exact, k || ' หมู่ 3 ต.' || subdistrict || ' อ.' || district || ' จ.' || province AS fixed FROM m)
 SELECT k, CASE WHEN unread THEN 'address_location_parse_failed' WHEN NOT found THEN 'address_location_not_found' WHEN NOT exact THEN 'address_location_corrected' END AS issue,
  CASE WHEN found AND NOT exact THEN fixed ELSE trim(address) END AS value, CASE WHEN found THEN postal_code END AS postal_code,
  CASE WHEN found AND exact THEN 'verified_location_reference' WHEN found THEN 'corrected_location_reference' ELSE 'flagged_location_reference' END AS action, CASE WHEN found AND NOT exact THEN trim(address) END AS previous_value,
  CASE WHEN found THEN round(least(p_score, d_score, CASE WHEN rescued THEN 0.82 ELSE s_score END), 6) END AS confidence FROM e""")
def h11(spark, sf):
    read = fx.forms(spark, sf).selectExpr(*[f"{e} AS {a}" for a, e in READ_COLUMNS]).selectExpr("k", f"{ADDRESS} AS address")
    found = L.validate_address(read, location_dim(spark, sf), "k")
    return found.select("k", "issue", "value", "postal_code", "action", "previous_value", F.round("confidence", 6).alias("confidence"))


# the parser kept the first digit of the number only
_HOUSE = r"regexp_extract(address, '^(\S+) ', 1)"


@query("H12_repair_address_number", FRM + rf""", a AS (SELECT k, address, {_HOUSE} AS house, concat(left({_HOUSE}, 1), substr(address, length({_HOUSE}) + 1)) AS kept FROM frm)
 SELECT k, CASE WHEN house <> left(house, 1) THEN address ELSE kept END AS value, CASE WHEN house <> left(house, 1) THEN kept END AS previous_value, CASE WHEN house <> left(house, 1) THEN 'raw_ocr_address_line' ELSE 'parser' END AS source FROM a""")
def h12(spark, sf):
    forms = fx.forms(spark, sf)
    house = F.regexp_extract("address", r"^(\S+) ", 1)
    short = F.concat(F.left(house, F.lit(1)), F.substr("address", F.length(house) + 1))
    kept = forms.select("k", short.alias("address"), F.lit("parser").alias("source"))
    return L.repair_address_number(kept, forms.select("k", "text"), "k").select("k", "value", "previous_value", "source")


@query("F30_matching_ratio", FRM_R + f""", nm AS (SELECT DISTINCT person_name AS a, mother_name || father_name AS b FROM frm UNION SELECT DISTINCT person_name, father_name FROM frm), {ratio_sql('nm')}
 SELECT a, b, round(r, 9) AS r FROM ratio""")
def f30(spark, sf):
    """Every distinct pair of names that stand on one form."""
    forms = fx.forms(spark, sf)
    pairs = forms.select(F.col("person_name").alias("a"), F.concat("mother_name", "father_name").alias("b")).union(forms.select("person_name", "father_name")).distinct()
    return C.with_matching_ratio(pairs, "a", "b", "r").withColumn("r", F.round("r", 9))


# --- corrections ------------------------------------------------------------------------

CHANGE_COLUMNS = [
    ("record_id", "concat('P', CAST(k AS STRING))"), ("field", "field"), ("seq", "k * 100 + length(field)"), ("before", "value"),
    ("after", "CASE k % 5 WHEN 0 THEN replace(value, 'ทอง', 'คำ') WHEN 1 THEN concat('ใหม่ ', value) WHEN 2 THEN replace(replace(value, 'ดี', 'งาม'), ' ', '  ') ELSE value END"),
]
PAIRS = LNG + f""", ch AS (SELECT {_columns(CHANGE_COLUMNS)} FROM lng WHERE field IN ('personName', 'motherName', 'fatherName')),
 tk AS (SELECT *, string_split(trim(regexp_replace(before, '\\s+', ' ', 'g')), ' ') AS b, string_split(trim(regexp_replace(after, '\\s+', ' ', 'g')), ' ') AS a FROM ch),
 pr AS (SELECT b[i] AS source, a[i] AS replacement, field, before, after, seq FROM tk, range(1, 9) t(i) WHERE len(a) = len(b) AND i <= len(b) AND a[i] <> b[i]
  AND length(a[i]) BETWEEN 2 AND 48 AND length(b[i]) BETWEEN 2 AND 48) """


@query("A09_learn_corrections", PAIRS + """, l AS (SELECT *, row_number() OVER (PARTITION BY source, replacement ORDER BY seq DESC, before DESC, after DESC) AS rn FROM pr)
 SELECT source, replacement, count(*) AS count, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields,
  string_agg(before || '>' || after, '|' ORDER BY seq DESC, before DESC, after DESC) FILTER (rn <= 5) AS examples FROM l GROUP BY 1, 2""")
def a09(spark, sf):
    changes = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).selectExpr(*[f"{e} AS {a}" for a, e in CHANGE_COLUMNS])
    examples = F.array_join(F.transform("examples", lambda e: F.concat(e["before"], F.lit(">"), e["after"])), "|")
    return CO.learn_corrections(changes).select("source", "replacement", "count", F.array_join("fields", ",").alias("fields"), examples.alias("examples"))




def _entries(spark, sf):
    rows = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).selectExpr("k", *[f"{e} AS {a}" for a, e in CHANGE_COLUMNS])
    numbered = "CASE WHEN k % 3 = 0 THEN concat(split(before, ' ')[0], '7') ELSE concat(split(before, ' ')[0], CASE WHEN k % 2 = 0 THEN 'ๆ' ELSE 'ฯ' END) END AS replacement"
    return rows.selectExpr("split(before, ' ')[0] AS source", numbered, "CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled", "seq")


DICT = PAIRS + """, en AS (SELECT string_split(value, ' ')[1] AS source, string_split(value, ' ')[1] || CASE WHEN k % 3 = 0 THEN '7' WHEN k % 2 = 0 THEN 'ๆ' ELSE 'ฯ' END AS replacement,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS enabled, k * 100 + length(field) AS seq FROM lng WHERE field IN ('personName', 'motherName', 'fatherName')),
 dic AS (SELECT source, replacement FROM en WHERE coalesce(enabled, true) AND NOT regexp_matches(replacement, '[0-9]') AND length(source) BETWEEN 2 AND 48 AND length(replacement) BETWEEN 2 AND 48
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq DESC) = 1) """


@query("S12_read_corrections", DICT + "SELECT source, replacement FROM dic")
def s12(spark, sf):
    return CO.read_corrections(_entries(spark, sf))


@query("J11_apply_dictionary", DICT + """, v AS (SELECT concat('P', CAST(k AS STRING)) AS record_id, field, string_split(value, ' ') AS t FROM lng WHERE field IN ('personName', 'motherName', 'fatherName')),
 e AS (SELECT record_id, field, i, t[i] AS token FROM v, range(1, 9) r(i) WHERE i <= len(t))
 SELECT record_id, field, string_agg(coalesce(replacement, token), ' ' ORDER BY i) AS value, coalesce(string_agg(token || '>' || replacement, ',' ORDER BY i), '') AS applied FROM e LEFT JOIN dic ON dic.source = token GROUP BY 1, 2""")
def j11d(spark, sf):
    values = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).selectExpr("concat('P', CAST(k AS STRING)) AS record_id", "field", "value")
    return CO.apply_dictionary(values, CO.read_corrections(_entries(spark, sf))).withColumn("applied", F.array_join("applied", ","))


@query("A09_merge_learned", DICT + """, l AS (SELECT source, replacement, count(*) AS n, list_sort(list(DISTINCT field)) AS f FROM pr GROUP BY 1, 2),
 o AS (SELECT source, replacement, 2 AS count, 'old' AS field, false AS enabled FROM dic UNION ALL SELECT source, replacement, 3, 'old', false FROM l WHERE n % 2 = 0 AND (source, replacement) NOT IN (SELECT (source, replacement) FROM dic))
 SELECT coalesce(o.source, l.source) AS source, coalesce(o.replacement, l.replacement) AS replacement, (coalesce(count, 0) + coalesce(n, 0))::BIGINT AS count,
  concat_ws(',', CASE WHEN o.source IS NOT NULL THEN 'old' END, nullif(array_to_string(f, ','), '')) AS fields, l.source IS NOT NULL OR coalesce(enabled, true) AS enabled FROM o FULL JOIN l ON o.source = l.source AND o.replacement = l.replacement""")
def a09m(spark, sf):
    changes = fx.form_values(spark, sf).filter(F.col("field").isin(*K.NAME_FIELDS)).selectExpr(*[f"{e} AS {a}" for a, e in CHANGE_COLUMNS])
    learned = CO.learn_corrections(changes)
    dictionary = CO.read_corrections(_entries(spark, sf)).withColumn("count", F.lit(2))
    known = learned.filter(F.col("count") % 2 == 0).select("source", "replacement").join(dictionary.select("source", "replacement"), ["source", "replacement"], "left_anti").withColumn("count", F.lit(3))
    entries = dictionary.unionByName(known).withColumns({"fields": F.array(F.lit("old")), "enabled": F.lit(False)})
    merged = CO.merge_learned(entries, learned)
    return merged.withColumns({"fields": F.array_join("fields", ","), "count": F.col("count").cast("long")})
