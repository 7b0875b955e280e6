"""Queries of judgments clipped from pages: lines of documents with planted marks between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import constants as K
from formloom.operators import clips as CL
from formloom.plans.q_segments import document_lines
from formloom.plans.registry import query

#: Rows beside the lines themselves: keyword, noise, an end marker over two segments, a stop, a sheet number.
PLANTED = """SELECT k, CAST(floor(line_no / 6) AS INT) + 1 AS page_number, line_no * 10 + s.step AS seg_no, s.said AS text FROM {ln}
 CROSS JOIN (VALUES (1, 'ข้อ 1 พิพากษาให้ จำเลย ชำระเงิน'), (2, ' สำหรับ ศาลใช้ 9 '), (3, 'ค่าใช้จ่าย ให้เป็น'), (4, 'พับ. / จบ'), (5, 'ผู้เขียน'), (-1, '(12 พ.)'), (6, 'ค่าทนายความ')) s(step, said)
 WHERE CASE s.step WHEN 1 THEN k % 3 = 0 AND line_no % 7 = k % 5 WHEN 2 THEN (k + line_no) % 4 = 1 WHEN 3 THEN (k + line_no) % 9 = 4 WHEN 4 THEN (k + line_no) % 9 = 4 AND k % 2 = 0
  WHEN 5 THEN (k + line_no) % 17 = 6 WHEN -1 THEN line_no % 6 = 0 AND k % 4 > 0 ELSE k % 5 = 2 AND line_no = 1 END
 UNION ALL SELECT k, CAST(floor(line_no / 6) AS INT) + 1, line_no * 10, line FROM {ln}"""
_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{''.join(w.split()).lower()}')" for w in words) + ")"
_ENDS = [*K.JUDGMENT_ENDS, *K.JUDGMENT_LOOSE_ENDS]
_SEG = r"""WITH raw AS (SELECT doc_id AS k, generate_subscripts(string_split(text, chr(10)), 1) AS n, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
 ln AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS INT) AS line_no, line FROM raw WHERE line <> ''),
 sg AS (""" + PLANTED.replace("{ln}", "ln") + r"""),
 u AS (SELECT *, lower(regexp_replace(text, '\s+', '', 'g')) AS c FROM (SELECT k, page_number, seg_no, trim(text) AS text FROM sg) WHERE text <> ''),
"""


def _clip(name: str, source: str) -> str:
    """CTE of the clips of pages whose segments in ``source`` start where the passage starts."""
    return rf"""{name}_n AS (SELECT * FROM {source} WHERE NOT {_ANY('c', K.JUDGMENT_NOISE)}),
 {name}_w AS (SELECT *, row_number() OVER w AS n, sum(length(text)) OVER w AS ch, string_agg(c, '') OVER w AS run FROM {name}_n WINDOW w AS (PARTITION BY k, page_number ORDER BY seg_no)),
 {name}_s AS (SELECT *, {_ANY('run', _ENDS)} AS ends, n > 1 AND {_ANY('c', K.JUDGMENT_STOPS)} AS stops FROM {name}_w),
 {name}_o AS (SELECT *, coalesce(bool_or(ends OR n >= 18 OR ch >= 1400) OVER (PARTITION BY k, page_number ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR bool_or(stops) OVER (PARTITION BY k, page_number ORDER BY seg_no) AS gone FROM {name}_s),
 {name} AS (SELECT k, page_number, trim(regexp_replace(string_agg(text, ' ' ORDER BY seg_no), '\s+', ' ', 'g')) AS text, count(*) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, bool_or(ends) AS ended FROM {name}_o WHERE NOT gone GROUP BY 1, 2)"""


_HITS = _SEG + rf""" a AS (SELECT * FROM (SELECT *, bool_or({_ANY('c', K.JUDGMENT_KEYWORDS)}) OVER (PARTITION BY k, page_number ORDER BY seg_no) AS begun FROM u) WHERE begun),
 {_clip('clip', 'a')}, hit AS (SELECT * FROM clip WHERE {_ANY("lower(regexp_replace(text, '\\s+', '', 'g'))", K.JUDGMENT_STARTS)}) """


def page_segments(spark, sf):
    rows = spark.sql(PLANTED, ln=document_lines(spark, sf))
    return rows.withColumn("bbox", F.lit(None).cast("array<double>"))


@query("W07_clip_passage", _HITS + "SELECT k, page_number, md5(text) AS text_md5, segments, chars, ended FROM hit")
def w07(spark, sf):
    return CL.clip_passage(page_segments(spark, sf), ["k", "page_number"]).select("k", "page_number", F.md5("text").alias("text_md5"), "segments", "chars", "ended")


@query("W08_passage_across_pages", _HITS + rf""", f AS (SELECT k, min(page_number) AS p, arg_min(ended, page_number) AS done FROM hit GROUP BY k),
 b AS (SELECT u.* FROM u JOIN f ON f.k = u.k AND page_number > p WHERE NOT done),
 bb AS (SELECT * FROM (SELECT *, bool_or(NOT (c IN ('สำหรับ', 'ศาลใช้', 'สำหรับศาลใช้') OR regexp_full_match(text, '\(?[0-9๐-๙]+\s*พ\.\)?') OR regexp_full_match(text, '[0-9๐-๙]+\)') OR {_ANY('c', K.JUDGMENT_NOISE)})) OVER (PARTITION BY k, page_number ORDER BY seg_no) AS begun FROM b) WHERE begun),
 {_clip('more', 'bb')}, l AS (SELECT k, min(page_number) AS z FROM more WHERE ended GROUP BY k),
 parts AS (SELECT hit.*, 0 AS continues FROM hit JOIN f ON f.k = hit.k AND page_number = p UNION ALL SELECT more.*, 1 FROM more LEFT JOIN l ON l.k = more.k WHERE z IS NULL OR page_number <= z)
 SELECT k, page_number, continues, md5(text) AS text_md5, segments, chars, ended FROM parts""")
def w08(spark, sf):
    return CL.passage_across_pages(page_segments(spark, sf), "k").select("k", "page_number", "continues", F.md5("text").alias("text_md5"), "segments", "chars", "ended")
