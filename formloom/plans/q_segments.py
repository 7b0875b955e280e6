"""Queries of page segments: slots, rows of the page, lines that segments belong to."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formloom import constants as K
from formloom import fixtures as fx
from formloom.operators import boxes as B
from formloom.operators import segments as S
from formloom.plans.q_thai import LNG
from formloom.plans.registry import query
from formloom.session import table

SEG = LNG + f", seg AS (SELECT *, trim(text) AS t FROM ({fx.SEGMENTS_SQL}) s), sg AS (SELECT * FROM seg WHERE t <> '' AND x2 > x1 AND y2 > y1) "


def _d(v: float) -> str:
    return f"CAST({v} AS DOUBLE)"


def _share(left: str, top: str, right: str, bottom: str) -> str:
    w, h = f"(least(x2, {right}) - greatest(x1, {left}))", f"(least(y2, {bottom}) - greatest(y1, {top}))"
    return f"CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} / greatest((x2 - x1) * (y2 - y1), {_d(0.000001)}) ELSE 0 END"


def _slot_rows(keep) -> str:
    rows = []
    for f, page, box, _ in K.FIELD_TEMPLATES:
        if box and keep(f):
            pad, share = K.NAME_SLOT if f in K.NAME_FIELDS else K.ADDRESS_SLOT if f == "address" else K.OTHER_SLOT
            rows.append(f"('{f}', {page}, {', '.join(_d(v) for v in box)}, {_d(pad)}, {_d(share)})")
    return ", ".join(rows)



@query("J06_segments_in_slot", SEG + f""", sl AS (SELECT field, page_number, share, greatest(0, a - pad) AS le, greatest(0, b - pad) AS tp, least(1, c + pad) AS ri, least(1, d + pad) AS bo
  FROM (VALUES {_slot_rows(lambda f: True)}) v(field, page_number, a, b, c, d, pad, share))
 SELECT k, field, string_agg(sg.t, ' ' ORDER BY y1, seg_no, sg.t) AS text, count(*) AS segments FROM sg JOIN sl ON sg.page_number = sl.page_number
  AND (((x1 + x2) / 2 BETWEEN le AND ri AND (y1 + y2) / 2 BETWEEN tp AND bo) OR {_share('le', 'tp', 'ri', 'bo')} >= share) GROUP BY 1, 2""")
def j06(spark, sf):
    return B.segments_in_slot(fx.segments(spark, sf), ["k"])


_BANDS = ", ".join(f"('{n}', {', '.join(_d(v) for v in b)})" for n, b in K.PARENT_ROWS)


@query("J07_segments_in_parent_row", SEG + f""", sl AS (SELECT field, page_number, greatest(0, a - {_d(K.ROW_SLOT_PAD)}) AS le, least(1, c + {_d(K.ROW_SLOT_PAD)}) AS ri,
   greatest(0, rl - {_d(K.ROW_PAD)}) AS rle, greatest(0, rt - {_d(K.ROW_PAD)}) AS tp, least(1, rr + {_d(K.ROW_PAD)}) AS rri, least(1, rb + {_d(K.ROW_PAD)}) AS bo
  FROM (VALUES {_slot_rows(lambda f: f[:6] in ('mother', 'father'))}) v(field, page_number, a, b, c, d, pad, share) JOIN (VALUES {_BANDS}) w(parent, rl, rt, rr, rb) ON left(field, 6) = parent),
 j AS (SELECT k, field, string_agg(sg.t, ' ' ORDER BY x1, seg_no, sg.t) AS text, count(*) AS segments FROM sg JOIN sl ON sg.page_number = sl.page_number
  AND (((x1 + x2) / 2 BETWEEN le AND ri AND (y1 + y2) / 2 BETWEEN tp AND bo)
   OR ({_share('rle', 'tp', 'rri', 'bo')} >= {K.ROW_SHARE} AND {_share('le', 'tp', 'ri', 'bo')} >= {K.ROW_SHARE})) GROUP BY 1, 2)
 SELECT k, field, CASE WHEN field LIKE '%Id' AND list_contains(string_split(text, ' '), '-') THEN '-' ELSE text END AS text, segments FROM j""")
def j07(spark, sf):
    return B.segments_in_parent_row(fx.segments(spark, sf), ["k"])


# --- lines of the documents and segments cut from them, some gone, some changed -------------

#: Segments made of a document's lines; SQL that both engines read.
_SEGS = """SELECT k, seg_no, line_no, m,
 CASE (k + line_no) % 5 WHEN 1 THEN reverse(line) WHEN 2 THEN left(line, CAST(floor(length(line) / 2) AS INT)) WHEN 4 THEN ' ' ELSE line END AS raw_text,
 CASE (k + line_no) % 5 WHEN 4 THEN line WHEN 3 THEN concat('x', line) ELSE NULL END AS text,
 CASE (k * 3 + line_no) % 7 WHEN 3 THEN lower(line) WHEN 5 THEN concat(line, ' fixed') WHEN 6 THEN ' ' ELSE NULL END AS corrected_text,
 CASE (k + line_no) % 4 WHEN 0 THEN line_no WHEN 1 THEN m WHEN 3 THEN line_no + 100000 ELSE NULL END AS source_line_index FROM {kept}"""
_LN = """WITH raw AS (SELECT doc_id AS k, generate_subscripts(string_split(text, chr(10)), 1) AS n, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
 ln AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS INT) AS line_no, line FROM raw WHERE line <> ''),
 kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY line_no) - 1 AS INT) AS seg_no FROM (SELECT *, CAST(count(*) OVER (PARTITION BY k) AS INT) AS m FROM ln) WHERE (k + line_no * 7) % 6 <> 5),
 sg AS (""" + _SEGS.format(kept="kept") + r"""),
 sx AS (SELECT *, coalesce(nullif(trim(raw_text), ''), nullif(trim(text), ''), '') AS raw, nullif(trim(corrected_text), '') AS cor FROM sg) """
_KEY = r"lower(regexp_replace({}, '\s+', '', 'g'))"
_GRAMS = "(CASE WHEN length({0}) <= 2 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) END)"


def _alike(a: str, b: str) -> str:
    ga, gb = _GRAMS.format(a), _GRAMS.format(b)
    both = f"len(list_intersect({ga}, {gb}))"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE {both} / (len({ga}) + len({gb}) - {both}) END"


def document_lines(spark, sf):
    """k, line_no, line: the lines of every document that aren't blank; numbered inside the row, without a shuffle."""
    # a lambda of one argument: transform would hand F.trim the place as the characters to trim
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.posexplode(lines).alias("line_no", "line"))


def document_segments(spark, lines):
    held = lines.withColumn("m", F.count("*").over(Window.partitionBy("k")).cast("int")).filter("(k + line_no * 7) % 6 <> 5")
    held = held.withColumn("seg_no", F.row_number().over(Window.partitionBy("k").orderBy("line_no")) - 1)
    return spark.sql(_SEGS, kept=held)


@query("J14_align_segments", _LN + f""", s AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM sx),
 p AS (SELECT *, CAST(greatest(0, least(m - 1, floor(seg_no * m / n + 0.5))) AS INT) AS near, CAST(floor(seg_no * m / n + 0.5) AS INT) AS f, CAST(floor((seg_no + 1) * m / n + 0.5) AS INT) AS t FROM s),
 c AS (SELECT p.k, seg_no, raw, near, m, o.turn, greatest(0, least(m - 1, near + o.step)) AS line_no FROM p CROSS JOIN (VALUES (0, 0), (-1, -1), (-2, 1), (-3, -2), (-4, 2)) o(turn, step)),
 x AS (SELECT c.k, seg_no, near, m, turn, c.line_no, line, {_KEY.format('raw')} AS a, {_KEY.format('line')} AS b FROM c JOIN ln ON ln.k = c.k AND ln.line_no = c.line_no),
 sc AS (SELECT k, seg_no, line, turn, {_alike('a', 'b')} - abs(line_no - near) / greatest(m - 1, 1) * 0.08::DOUBLE AS score FROM x),
 best AS (SELECT k, seg_no, arg_max(line, {{'score': score, 'turn': turn}}) AS line, max(score) AS score FROM sc GROUP BY 1, 2),
 span AS (SELECT p.k, seg_no, trim(string_agg(line, ' ' ORDER BY ln.line_no)) AS line FROM p JOIN ln ON ln.k = p.k AND ln.line_no >= f AND ln.line_no < least(m, greatest(f + 1, t)) GROUP BY 1, 2),
 r AS (SELECT p.k, p.seg_no, p.raw, p.cor, CASE WHEN best.score >= 0.28 THEN best.line ELSE nullif(span.line, '') END AS sup
  FROM p LEFT JOIN best ON best.k = p.k AND best.seg_no = p.seg_no LEFT JOIN span ON span.k = p.k AND span.seg_no = p.seg_no),
 q AS (SELECT *, coalesce({_KEY.format('cor')}, '') NOT IN ('', {_KEY.format('raw')}) AS own, coalesce({_KEY.format('sup')}, '') NOT IN ('', {_KEY.format('raw')}) AS said FROM r)
 SELECT k, seg_no, CASE WHEN own THEN cor WHEN said THEN sup END AS support, CASE WHEN own THEN 'line' WHEN said THEN 'page' END AS label FROM q""")
def j14(spark, sf):
    lines = document_lines(spark, sf)
    return S.align_segments_to_lines(document_segments(spark, lines), lines, "k")


@query("J15_match_segment", _LN + f""", d AS (SELECT sx.k, seg_no, ln.line_no FROM sx JOIN ln ON ln.k = sx.k AND ln.line_no = source_line_index),
 rest AS (SELECT sx.* FROM sx LEFT JOIN d ON d.k = sx.k AND d.seg_no = sx.seg_no WHERE d.k IS NULL),
 refs AS (SELECT k, seg_no, source_line_index, unnest(list_distinct(list_filter([coalesce(cor, nullif(trim(text), ''), nullif(trim(raw_text), ''), ''), raw, coalesce(cor, ''), coalesce(trim(text), '')], lambda v: v <> ''))) AS said FROM rest),
 x AS (SELECT refs.k, seg_no, source_line_index AS i, ln.line_no, {_KEY.format('said')} AS a, {_KEY.format('line')} AS b FROM refs JOIN ln ON ln.k = refs.k),
 sc AS (SELECT k, seg_no, i, line_no, max({_alike('a', 'b')}) + CASE WHEN i IS NULL THEN 0 ELSE greatest(0, 0.18::DOUBLE - abs(line_no - i) * 0.06::DOUBLE) END AS score FROM x GROUP BY 1, 2, 3, 4),
 best AS (SELECT k, seg_no, arg_max(line_no, {{'s': score, 'l': -line_no}}) AS line_no FROM sc GROUP BY 1, 2)
 SELECT k, seg_no, CAST(line_no AS INT) AS line_no FROM d UNION ALL SELECT rest.k, rest.seg_no, CAST(best.line_no AS INT) FROM rest LEFT JOIN best ON best.k = rest.k AND best.seg_no = rest.seg_no""")
def j15(spark, sf):
    lines = document_lines(spark, sf)
    return S.match_segment_to_line(document_segments(spark, lines), lines, "k")


# --- the box of a passage --------------------------------------------------------------------


def _passages(spark, sf):
    """Each form's address and what follows it as a passage; two in three start from the address's segment."""
    address = [f for f, _ in fx._SLOTS].index("address") * 4
    text = F.concat_ws(" ", "address", F.col("move_in_date"), F.when(F.col("k") % 2 == 0, F.col("remark")))
    return fx.forms(spark, sf).select("k", text.alias("passage"), F.when(F.col("k") % 3 > 0, F.lit(address)).alias("seed_no"))


@query("J18_passage_box")
def j18(spark, sf):
    """Boxes grown from the address downwards, or around all that fits."""
    return S.passage_box(fx.segments(spark, sf).filter("page_number = 1").select("k", "seg_no", "text", "bbox"), _passages(spark, sf), ["k"])


_MARKS = K.PASSAGE_MARKS.replace("(?U)", "").replace("'", "''")
_FIT = """(contains(w, s) OR (least(length(s), 14) >= 6 AND contains(w, left(s, 14))) OR (least(length(s), 12) >= 6 AND contains(w, right(s, 12)))
 OR (length(s) >= 10 AND len(list_filter(range(1, length(s) - 3, 2), lambda i: contains(w, substr(s, i, 5)))) / len(range(1, length(s) - 3, 2)) >= 0.18))"""


@query("J18_passage_box_unseeded", SEG + f""", ps AS (SELECT k, regexp_replace(lower(address || ' ' || move_in_date || CASE WHEN k % 2 = 0 THEN ' ' || remark ELSE '' END), '{_MARKS}', '', 'g') AS w FROM frm),
 ft AS (SELECT ps.k, x1, y1, x2, y2, w, regexp_replace(lower(text), '{_MARKS}', '', 'g') AS s FROM ps JOIN seg ON seg.k = ps.k AND page_number = 1),
 bx AS (SELECT k, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, CAST(count(*) AS INT) AS segments FROM ft WHERE length(s) >= 4 AND {_FIT} GROUP BY k)
 SELECT ps.k, x1, y1, x2, y2, segments FROM ps LEFT JOIN bx ON bx.k = ps.k""")
def j18_unseeded(spark, sf):
    passages = _passages(spark, sf).withColumn("seed_no", F.lit(None).cast("int"))
    return S.passage_box(fx.segments(spark, sf).filter("page_number = 1").select("k", "seg_no", "text", "bbox"), passages, ["k"])


# --- line groups, rows side by side, segments of values ---------------------------------------------

#: Pages with headings, figures and lone tags around whole texts.
GROUPED = """SELECT doc_id AS k, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN concat('## Page 1', chr(10), text, chr(10), chr(10), ' ', chr(10), 'end') WHEN 2 THEN concat('<Figure a>', chr(10), 'drawn', chr(10), '## Page 2', chr(10), 'in it', chr(10), '</figure>', chr(10), text)
  WHEN 3 THEN concat(replace(text, chr(10), concat(chr(10), '<b>', chr(10))), chr(10), '<figure>', chr(10), lang) ELSE replace(text, '. ', concat('.', chr(10), chr(10))) END AS t FROM {documents}"""


@query("W12_line_groups", "WITH p AS (" + GROUPED.replace("{documents}", "documents") + r"""), l AS (SELECT k, generate_subscripts(string_split(t, chr(10)), 1) AS n, trim(unnest(string_split(t, chr(10)))) AS line FROM p),
 m AS (SELECT *, line = '' OR starts_with(line, '## Page') AS br, CASE WHEN line = '' OR starts_with(line, '## Page') THEN NULL WHEN starts_with(lower(line), '<figure') THEN 1 WHEN starts_with(lower(line), '</figure') THEN 0 END AS tag FROM l),
 r AS (SELECT *, sum(br::INT) OVER w AS breaks, max(CASE WHEN tag = 1 THEN n END) OVER w AS opened, max(CASE WHEN tag = 0 THEN n END) OVER w AS closed FROM m WINDOW w AS (PARTITION BY k ORDER BY n)),
 f AS (SELECT * FROM r WHERE NOT br AND tag IS NULL AND NOT (opened IS NOT NULL AND opened > coalesce(closed, 0)) AND NOT (starts_with(line, '<') AND ends_with(line, '>')))
 SELECT k, CAST(dense_rank() OVER (PARTITION BY k ORDER BY breaks) - 1 AS INT) AS group_no, CAST(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS INT) AS line_no, line FROM f""")
def w12(spark, sf):
    return S.line_groups(spark.sql(GROUPED, documents=table(spark, sf, "documents")), "k", "t")


READ_TWICE = """SELECT doc_id AS k, text AS original, CASE WHEN doc_id % 11 = 5 THEN NULL ELSE CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), concat(chr(10), ' ', chr(10), 'and ')) WHEN 2 THEN reverse(text)
  ELSE concat(text, chr(10), '<figure>', chr(10), 'extra ', source) END END AS cleaned, CASE doc_id % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'cleaned' ELSE NULL END AS selected_source FROM {documents}"""
_SHOWN = "list_filter(list_transform(string_split(coalesce({}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '## Page') AND NOT starts_with(lower(x), '<figure') AND NOT starts_with(lower(x), '</figure') AND NOT (starts_with(x, '<') AND ends_with(x, '>')))"
_SPAN = "trim(array_to_string({0}[floor(i * len({0}) / n + 0.5)::BIGINT + 1:greatest(floor(i * len({0}) / n + 0.5)::BIGINT + 1, floor((i + 1) * len({0}) / n + 0.5)::BIGINT)], ' '))"


@query("W15_diff_rows", "WITH p AS (" + READ_TWICE.replace("{documents}", "documents") + f"""), s AS (SELECT k, selected_source, {_SHOWN.format('original')} AS o, {_SHOWN.format('cleaned')} AS c FROM p),
 n AS (SELECT *, greatest(len(o), len(c)) AS n FROM s), i AS (SELECT *, unnest(range(0, n)) AS i FROM n), x AS (SELECT k, selected_source, i, {_SPAN.format('o')} AS original, {_SPAN.format('c')} AS cleaned FROM i),
 y AS (SELECT *, {_KEY.format('original')} AS a, {_KEY.format('cleaned')} AS b FROM x WHERE original <> '' OR cleaned <> ''), z AS (SELECT *, {_alike('a', 'b')} AS similarity FROM y)
 SELECT k, CAST(i AS INT) AS row_no, CASE WHEN original = '' OR cleaned = '' THEN 'missing' WHEN similarity >= 0.985 THEN 'same' ELSE 'changed' END AS status, md5(original || chr(10) || cleaned) AS sides,
  CASE selected_source WHEN 'original' THEN original WHEN 'cleaned' THEN cleaned ELSE coalesce(nullif(cleaned, ''), original) END AS selected, round(similarity, 9)::DOUBLE AS similarity FROM z""")
def w15(spark, sf):
    rows = S.diff_rows(spark.sql(READ_TWICE, documents=table(spark, sf, "documents")), "k")
    return rows.select("k", "row_no", "status", F.md5(F.concat("original", F.lit("\n"), "cleaned")).alias("sides"), "selected", F.round("similarity", 9).alias("similarity"))


@query("J16_best_segment", SEG + f""", vs AS (SELECT k, field, regexp_replace(lower(value), '{_MARKS}', '', 'g') AS w FROM lng), ps AS (SELECT *, regexp_replace(lower(text), '{_MARKS}', '', 'g') AS s FROM seg WHERE page_number = 1),
 m AS (SELECT vs.k, field, seg_no, x1, y1, x2, y2, least(length(w), length(s)) / greatest(length(w), length(s)) - y1 * 0.15::DOUBLE - (x2 - x1) * 0.04::DOUBLE AS score FROM vs JOIN ps ON ps.k = vs.k AND s <> '' AND length(w) >= 3 AND (contains(w, s) OR contains(s, w))),
 b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k, field ORDER BY score DESC, seg_no, x1, y1, x2, y2) = 1)
 SELECT vs.k, vs.field, seg_no FROM vs LEFT JOIN b ON b.k = vs.k AND b.field = vs.field""")
def j16(spark, sf):
    return S.best_segment_for_value(fx.form_values(spark, sf), fx.segments(spark, sf).filter("page_number = 1"), "k").select("k", "field", "seg_no")
