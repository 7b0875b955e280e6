"""Queries of the text expressions over documents, pages and rendered forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from formloom import constants as K
from formloom import fixtures as fx
from formloom.functions import compare as C
from formloom.functions import text as X
from formloom.functions import thai as T
from formloom.plans.registry import query
from formloom.session import table

RD = f"WITH rd AS ({fx.READINGS_SQL}) "
FRM = f"WITH frm AS ({fx.FORMS_SQL}) "
FRM_LONG = f"WITH frm AS ({fx.FORMS_SQL}), lng AS ({fx.LONG_SQL}) "
GARBLE_LATIN = K.CP874_AS_LATIN1


def any_of(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def count_of(col: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, '{w}') AS INT)" for w in words) + ")"


# the usable lines of a reading, as a DuckDB list
LINES = r"""list_filter(list_transform(string_split(regexp_replace(raw, '(?is)<figure[^\n]*\n.*?\n</figure[^\n]*', '', 'g'), chr(10)),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '## Page') AND NOT (starts_with(x, '<') AND ends_with(x, '>')))"""
LN = f"{RD}, ln AS (SELECT doc_id, lang, raw, {LINES} AS lines FROM rd) "


@query("F01_norm_ws", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS value FROM documents")
def f01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.norm_ws("text").alias("value"))


@query("F02_compact", r"""SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS kept, lower(regexp_replace(text, '\s+', '', 'g')) AS lowered,
 CAST(greatest(length(regexp_replace(text, '\s+', '', 'g')), 1) AS INT) AS size FROM documents""")
def f02(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.compact("text").alias("kept"), X.compact_lower("text").alias("lowered"),
        X.compact_length("text").alias("size"),
    )


@query("F03_digit_style", FRM + """SELECT k, translate(translate(text, '0123456789', '๐๑๒๓๔๕๖๗๘๙'), '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS ascii,
 translate(text, '0123456789', '๐๑๒๓๔๕๖๗๘๙') AS thai FROM frm""")
def f03(spark, sf):
    return fx.forms(spark, sf).select(
        "k", T.ascii_digits(T.thai_digits("text")).alias("ascii"), T.thai_digits("text").alias("thai")
    )


@query("F04_digits", FRM_LONG + r"""SELECT k, field, regexp_replace(value, '[^0-9]', '', 'g') AS digits,
 coalesce(nullif(regexp_replace(value, '[^0-9]', '', 'g'), ''), regexp_replace(value, '\s+', '', 'g')) AS reject_key FROM lng""")
def f04(spark, sf):
    df = fx.form_values(spark, sf).withColumn(
        "value", F.when(F.col("k") % 5 == 2, T.thai_digits("value")).otherwise(F.col("value")))
    return df.select("k", "field", T.digits("value").alias("digits"), T.reject_key("value").alias("reject_key"))


@query("F14_repair_mojibake", FRM + "SELECT k, CASE WHEN k % 3 = 0 THEN address ELSE text END AS repaired FROM frm")
def f14(spark, sf):
    """Two thirds of the texts are garbled first, the rest must pass untouched."""
    as_latin = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    garbled = F.translate(as_latin, K.CP874_AS_LATIN1, K.CP874_CHARS)
    return fx.forms(spark, sf).select(
        "k", X.repair_garbled(F.when(F.col("k") % 3 == 0, F.col("address")).otherwise(garbled)).alias("repaired"))


@query("F15_strip_markup", r"""SELECT page_id, regexp_matches(html, '(?i)(<\s*/?\s*(table|tbody|tr|td|th)\b|&lt;\s*/?\s*(table|tbody|tr|td|th)\b|</|/>)') AS noisy,
 trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
 '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', chr(1)), '&amp($|[^A-Za-z0-9])', '&\1', 'g'), chr(1), '&'), '(?i)<\s*/?\s*(table|tbody|tr|td|th)[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM pages""")
def f15(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.has_markup("html").alias("noisy"), X.strip_markup("html").alias("clean"))


def _label_noise_sql(col: str) -> str:
    for w in K.LABEL_NOISE:
        col = f"replace({col}, '{w}', ' ')"
    return rf"trim(regexp_replace(regexp_replace({col}, '\([^)]*ท้องถิ่น[^)]*\)', ' ', 'g'), '\s+', ' ', 'g'))"


@query("F16_strip_label_noise", FRM + f"SELECT k, {_label_noise_sql('text')} AS clean FROM frm")
def f16(spark, sf):
    return fx.forms(spark, sf).select("k", X.strip_label_noise("text").alias("clean"))


@query("F17_unwrap_response", r"""SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents""")
def f17(spark, sf):
    """The text is wrapped in five ways; unwrapping must give it back."""
    nl = F.lit("\n")
    as_json = F.to_json(F.struct(F.lit("n").alias("other"), F.col("text").alias("markdown")))
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    broken = F.concat(F.lit('{"page": 1 "text": "'), escaped, F.lit('"}'))
    wrapped = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), as_json, F.lit("\n```")))
        .when(F.col("doc_id") % 5 == 1, as_json)
        .when(F.col("doc_id") % 5 == 2, broken)
        .when(F.col("doc_id") % 5 == 3, F.concat(F.lit("<figure>drawn\nhere</figure>"), nl, F.col("text")))
        .otherwise(F.col("text"))
    )
    # a missing text stays missing: an object without it would be a text of its own
    return table(spark, sf, "documents").select("doc_id", X.unwrap_response(F.when(F.col("text").isNotNull(), wrapped)).alias("body"))


REPEATED = r"""(SELECT coalesce(bool_or(len(lines) >= 6 AND tot >= 6 AND n >= 6 AND (n / tot >= 0.35 OR (contains(l, 'สำหรับเรียก') AND contains(l, 'เท่านั้น')))), false)
 FROM (SELECT l, count(*) AS n, sum(count(*)) OVER () AS tot FROM (SELECT unnest(list_transform(lines, lambda x: lower(regexp_replace(x, '\s+', '', 'g')))) AS l) WHERE length(l) >= 8 GROUP BY l ORDER BY n DESC, l LIMIT 1) q)"""
COMPACT = r"lower(regexp_replace(raw, '\s+', '', 'g'))"


@query("F18_text_quality", LN + rf"""SELECT doc_id, CAST(length(regexp_replace(raw, '\s+', '', 'g')) + 42 * len(lines)
 - 12 * len(list_filter(lines, lambda x: length(regexp_replace(x, '\s+', '', 'g')) <= 2))
 - CASE WHEN {REPEATED} THEN 2800 ELSE 0 END AS DOUBLE) AS score FROM ln""")
def f18(spark, sf):
    return fx.readings(spark, sf).select("doc_id", X.text_quality("raw").alias("score"))


@query("F19_needs_comparison", LN + rf"""SELECT doc_id, trim(raw) = '' OR ({count_of(COMPACT, K.PICTURE_SIGNALS)} >= 2 AND {count_of(COMPACT, K.LEGAL_SIGNALS)} <= 1)
 OR {REPEATED} OR length({COMPACT}) < 120 OR (len(lines) <= 2 AND length({COMPACT}) < 350) AS weak FROM ln""")
def f19(spark, sf):
    return fx.readings(spark, sf).select("doc_id", X.needs_comparison("raw").alias("weak"))


CATS = ("CASE doc_id % 6 WHEN 0 THEN ' Court Judgment ' WHEN 1 THEN '_TR-' WHEN 2 THEN '***' WHEN 3 THEN NULL"
        " WHEN 4 THEN concat(lang, ' ', source, '!') ELSE 'tor_ror' END")


@query("F20_normalize_category", f"""WITH c AS (SELECT doc_id, {CATS} AS cat FROM documents), n AS (SELECT *, coalesce(nullif(trim(regexp_replace(
 replace(lower(trim(coalesce(cat, ''))), ' ', '_'), '[^\\p{{L}}\\p{{N}}_-]', '', 'g'), '_-'), ''), 'uncategorized') AS norm FROM c)
 SELECT doc_id, norm, norm IN ('tr', 'tor_ror') AS is_form, array_to_string(list_transform(list_filter(string_split_regex(norm, '[_-]+'), lambda w: w <> ''),
  lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS label FROM n""")
def f20(spark, sf):
    norm = X.normalize_category(F.col("cat"))
    return table(spark, sf, "documents").selectExpr("doc_id", f"{CATS} AS cat").select(
        "doc_id", norm.alias("norm")
    ).select("doc_id", "norm", X.is_form_category("norm").alias("is_form"), X.category_label("norm").alias("label"))


# every turn whole, and turns of nothing but marks as rows of their own
SAID = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN concat('Line: "', text, '"') WHEN 1 THEN concat('```', chr(10), text, chr(10), '```') ELSE text END AS raw FROM {conversations}
 UNION ALL SELECT conv_id, -1 - turn, '-- ... !' FROM {conversations} WHERE turn % 4 = 2"""


@query("F52_single_line", r"""SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, false AS only_punct FROM conversations
 UNION ALL SELECT conv_id, -1 - turn, '-- ... !', true FROM conversations WHERE turn % 4 = 2""")
def f52(spark, sf):
    said = spark.sql(SAID, conversations=table(spark, sf, "conversations"))
    return said.select("conv_id", "turn", X.single_line("raw").alias("line"), X.punctuation_only("raw").alias("only_punct"))


BEFORE = "concat(mother_name, ' ', father_name, ' ลมหนาว ', gender)"
AFTER = ("CASE k % 4 WHEN 0 THEN concat(father_name, ' ', father_name, ' ลมหนาว ', gender) WHEN 1 THEN concat(mother_name, ' ', father_name, ' ลมร้อน นาย')"
         " WHEN 2 THEN concat(mother_name, ' x') ELSE concat(mother_name, ' ', father_name, ' ลม9 ', gender) END")
TOKEN_OK = "(length({0}) BETWEEN 2 AND 48 AND NOT regexp_matches({0}, '[0-9๐-๙]') AND regexp_matches({0}, '[฀-๿]') AND {0} NOT IN (" + ", ".join(f"'{w}'" for w in K.NOT_NAME_TOKENS) + "))"


@query("N09_token_pairs", FRM + f""", t AS (SELECT k, string_split({BEFORE}, ' ') AS a, string_split({AFTER}, ' ') AS b FROM frm),
 z AS (SELECT k, unnest(range(1, len(a) + 1)) AS i, a, b FROM t WHERE len(a) = len(b))
 SELECT k, a[i] AS source, b[i] AS replacement FROM z WHERE a[i] <> b[i] AND {TOKEN_OK.format('a[i]')} AND {TOKEN_OK.format('b[i]')}""")
def n09(spark, sf):
    df = fx.forms(spark, sf).selectExpr("k", f"{BEFORE} AS before", f"{AFTER} AS after")
    return df.select("k", F.inline(X.token_pairs("before", "after")))


@query("N10_name_token_ok", FRM_LONG + ", t AS (SELECT DISTINCT unnest(string_split(value, ' ')) AS token FROM lng) SELECT token, "
       + TOKEN_OK.format("token") + " AS ok FROM t")
def n10(spark, sf):
    tokens = fx.form_values(spark, sf).select(F.explode(F.split("value", " ")).alias("token")).distinct()
    return tokens.select("token", X.name_token_ok("token").alias("ok"))


BLANKOUT = r"CASE WHEN regexp_replace({0}, '\s+', '', 'g') <> '' THEN {0} END"


@query("P16_page_text", RD + f"SELECT doc_id, coalesce({BLANKOUT.format('corrected')}, {BLANKOUT.format('selected')}, {BLANKOUT.format('raw')}, '') AS page_text FROM rd")
def p16(spark, sf):
    return fx.readings(spark, sf).select("doc_id", X.first_text("corrected", "selected", "raw").alias("page_text"))


@query("P17_text_variants", RD + r""", u AS (SELECT doc_id, 1 AS ord, 'corrected_markdown' AS variant, corrected AS t FROM rd UNION ALL SELECT doc_id, 2, 'markdown', selected FROM rd
  UNION ALL SELECT doc_id, 3, 'raw_markdown', raw FROM rd UNION ALL SELECT doc_id, 4, 'original_markdown', text FROM rd UNION ALL SELECT doc_id, 5, 'cleaned_markdown', lower(text) FROM rd),
 c AS (SELECT doc_id, ord, variant, regexp_replace(t, '^\s+|\s+$', '', 'g') AS value FROM u)
 SELECT doc_id, ord, variant, value FROM c WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY ord) = 1""")
def p17(spark, sf):
    from formloom.operators.extraction import text_variants

    df = fx.readings(spark, sf).select(
        "doc_id", F.col("corrected").alias("corrected_markdown"), F.col("selected").alias("markdown"),
        F.col("raw").alias("raw_markdown"), F.col("text").alias("original_markdown"), F.lower("text").alias("cleaned_markdown"),
    )
    return text_variants(df, ["doc_id"])


ENTITY_TAIL = "concat(text, ' &#3585;&ndash;&#x0E02; &eacute;&Eacute &nosuch; &#0; a&b &amp;lt;', lang)"


@query("F15_unescape_entities", "SELECT doc_id, text || ' ก–ข éÉ &nosuch; ' || chr(65533) || ' a&b &lt;' || lang AS text FROM documents")
def f15e(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.unescape_entities(F.expr(ENTITY_TAIL)).alias("text"))


@query("P18_usable_text", RD + """, t AS (SELECT concat(source, '/', CAST(doc_id % 7 AS VARCHAR)) AS pages, raw AS t FROM rd
  UNION ALL SELECT concat('failed ', source, '/', CAST(doc_id % 7 AS VARCHAR)), concat('[OCR failed] ', raw) FROM rd)
 SELECT pages, bool_or(trim(t) <> '' AND NOT starts_with(t, '[OCR failed')) AS usable FROM t GROUP BY pages""")
def p18(spark, sf):
    """Pages of every source, and the same once more with all of them failed."""
    read = fx.readings(spark, sf).select(F.concat("source", F.lit("/"), (F.col("doc_id") % 7).cast("string")).alias("pages"), F.col("raw").alias("t"))
    failed = read.select(F.concat(F.lit("failed "), "pages").alias("pages"), F.concat(F.lit("[OCR failed] "), "t").alias("t"))
    ok = (X.trimmed("t") != "") & ~X.trimmed("t").startswith(K.FAILED_PAGE_PREFIX)
    return read.unionByName(failed).groupBy("pages").agg(F.bool_or(ok).alias("usable"))


REASONS = ("CASE doc_id % 4 WHEN 0 THEN 'OCR quality looked usable after comparing the readings' WHEN 1 THEN ''"
           " WHEN 2 THEN 'The pipeline compared OCR models: a, b.' ELSE 'Few OCR blocks were detected on this page.' END")


@query("P19_actionable_reasons", f"""WITH r AS (SELECT source, {REASONS} AS r FROM documents)
 SELECT source, bool_or(r <> '' AND NOT starts_with(r, 'OCR quality looked usable') AND NOT starts_with(r, 'The pipeline compared')) AS actionable FROM r GROUP BY source""")
def p19(spark, sf):
    from formloom.operators.quality import actionable_reasons

    df = table(spark, sf, "documents").selectExpr("source", f"{REASONS} AS r")
    return df.groupBy("source").agg(F.bool_or(actionable_reasons(F.array("r"))).alias("actionable"))


@query("A21_distinct_values", FRM + """SELECT k, concat_ws(',', person_id, CASE WHEN mother_id <> '-' AND mother_id <> person_id THEN mother_id END, CASE WHEN father_id <> '-' THEN father_id END) AS ids,
 concat_ws(',', birth_date, CASE WHEN move_in_date <> birth_date THEN move_in_date END, CASE WHEN remark_date NOT IN (birth_date, move_in_date) THEN remark_date END,
  CASE WHEN update_date NOT IN (birth_date, move_in_date, coalesce(remark_date, '')) THEN update_date END) AS dates
 FROM (SELECT *, nullif(regexp_extract(remark, '(?:วันที่|เมื่อ) (.*)$', 1), '') AS remark_date FROM frm)""")
def a21(spark, sf):
    return fx.forms(spark, sf).select(
        "k", F.array_join(T.id_values("text"), ",").alias("ids"), F.array_join(T.thai_dates("text"), ",").alias("dates"))


@query("A13_repeated_line", LN + f"SELECT doc_id, {REPEATED} AS repeated FROM ln")
def a13(spark, sf):
    return fx.readings(spark, sf).select("doc_id", X.repeats_one_line(X.candidate_lines("raw")).alias("repeated"))


@query("F53_bigram_jaccard", r"""WITH p AS (SELECT conv_id, turn, lower(regexp_replace(text, '\s+', '', 'g')) AS a, lag(lower(regexp_replace(text, '\s+', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
 g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS ga, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS gb FROM p WHERE b IS NOT NULL)
 SELECT conv_id, turn, CASE WHEN a = '' AND b = '' THEN 1.0 WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE
  round(len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))), 6) END::DOUBLE AS score FROM g""")
def f53(spark, sf):
    """Each turn against the one before it in the same conversation."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    prev = conv.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return conv.join(prev, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(C.bigram_jaccard("text", "before"), 6).alias("score"))


@query("F54_line_in_passage", r"""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
 c AS (SELECT doc_id, n, lower(regexp_replace(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN upper(line) || lang_tail ELSE substr(line, 1, 20) || text END, '\s+', '', 'g')) AS w,
   lower(regexp_replace(CASE WHEN n % 2 = 0 THEN line ELSE reverse(line) END, '\s+', '', 'g')) AS s FROM (SELECT *, 'zz' AS lang_tail FROM l))
 SELECT doc_id, CAST(n AS INT) AS n, w <> '' AND s <> '' AND (contains(w, s) OR (least(length(s), 14) >= 6 AND contains(w, left(s, 14))) OR (least(length(s), 12) >= 6 AND contains(w, right(s, 12)))
   OR (length(s) >= 10 AND len(list_filter(range(1, length(s) - 3, 2), lambda i: contains(w, substr(s, i, 5)))) / len(range(1, length(s) - 3, 2)) >= 0.18)) AS hit FROM c""")
def f54(spark, sf):
    kind = F.col("doc_id") % 3
    own = lambda x: F.when(kind == 1, F.concat(F.upper(x), F.lit("zz"))).when(kind == 2, F.substring(x, 1, 20))
    said = lambda x, i: F.when(i % 2 == 1, x).otherwise(F.reverse(x))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), own(x).alias("own"), said(x, i).alias("line")))
    pages = table(spark, sf, "documents").select("doc_id", F.when(kind != 1, F.col("text")).alias("passage"), lines.alias("lines"))
    return C.lines_in_passage(pages, "doc_id", "passage", "lines")
