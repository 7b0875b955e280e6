"""Registered queries of the subpackage, each over its whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.llm import chat, decontam, exact, fingerprints, html, infill, jaccard, manifest, mixing, pii, quality, secrets, tokens
from formloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -7, digested from the formatted text alone."""
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], told.schema)
    done = chat.format_conversations(chat.turns_in_order(told.unionByName(extra), "conv_id", "turn"))
    lines = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    read = done.withColumns({"_turns": lines, "_loss": loss})
    return read.select(
        F.col("tree").alias("conv_id"), F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"), F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2\3', 'g')"
ORACLES["op1_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length({_ESC.format('text')}) + 7
      + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 0
             ELSE 13 + length({_ESC.format('role')}) END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a Pareto order sample takes of every document; sources weigh 5, 2, 1, repeating."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


ORACLES["op8_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix:' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5)::DOUBLE / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
level(c, stopped) AS (
  SELECT 1.5 * sum(source_size) / sum(w), -1 FROM s
  UNION ALL
  SELECT (SELECT (1.5 * sum(source_size) - coalesce(sum(2 * source_size) FILTER (2 * source_size < c * w), 0))
                 / sum(w) FILTER (2 * source_size >= c * w) FROM s),
         (SELECT count(*) FROM s WHERE 2 * source_size < c * w)
  FROM level WHERE stopped < (SELECT count(*) FROM s WHERE 2 * source_size < c * w)),
t AS (
  SELECT source, source_size, least(2.0 * source_size, (SELECT arg_max(c, stopped) FROM level) * w)::DOUBLE AS target FROM s),
k AS (SELECT *, floor(target / source_size) AS k, target - floor(target / source_size) * source_size AS want FROM t),
z AS (
  SELECT k.source, size, want - coalesce(sum(n * size) OVER (PARTITION BY k.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS open,
    (sum(n * size * size) OVER (PARTITION BY k.source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS rest
  FROM (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2) g JOIN k ON k.source IS NOT DISTINCT FROM g.source),
c AS (SELECT source, arg_max(open / rest, size) AS per_word FROM z WHERE open * size <= rest GROUP BY 1),
p AS (
  SELECT d.*, source_size, target, k, want, least(1.0::DOUBLE, coalesce(per_word * size, 0)) AS chance
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
r AS (SELECT *, CASE WHEN chance >= 1 THEN 0 WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS q FROM p),
o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before FROM r),
x AS (SELECT *, CASE WHEN want > 0 AND q IS NOT NULL AND before + size / 2 <= want THEN 1 ELSE 0 END AS extra FROM o)
SELECT doc_id, size, source_size, target, (k + extra)::INTEGER AS copies, ((k + extra) * size)::BIGINT AS taken, chance::DOUBLE AS chance
FROM x
"""


@query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edited texts, with likenesses."""
    return fingerprints.edit_probe(table(spark, sf_dir, "documents"))


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates (five-word runs, similarity of 0.8 or more): each document's group and links."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT text, min(doc_id) AS rep, count(*) AS copies FROM d GROUP BY text),
w AS (SELECT rep, copies, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM c),
sh AS (
  SELECT DISTINCT rep, unnest(CASE WHEN len(ws) >= 5
      THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
      ELSE [array_to_string(ws, ' ')] END) AS g
  FROM w WHERE len(ws) > 0),
n AS (SELECT rep, count(*) AS k FROM sh GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS shared FROM sh a JOIN sh b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.rep = x JOIN n ny ON ny.rep = y
  WHERE 5 * shared >= 4 * (nx.k + ny.k - shared)),
reach(x, y) AS (SELECT rep, rep FROM c UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
grp AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
tot AS (SELECT l.x, count(*) AS texts, sum(c.copies) AS docs FROM l JOIN c ON c.rep = l.y GROUP BY l.x)
SELECT d.doc_id, grp.class_id, c.rep AS copy_id,
  (coalesce(tot.docs, 0) + c.copies - 1)::BIGINT AS n_links, coalesce(tot.texts, 0)::BIGINT AS n_text_links
FROM d JOIN c ON d.text = c.text JOIN grp ON grp.x = c.rep LEFT JOIN tot ON tot.x = c.rep
"""


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item, substitutions tolerated."""
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's ids stand in the shards, and their checksum, read back from the files."""
    path = tokens.new_shard_folder(spark)
    tokens.write_shards(table(spark, sf_dir, "documents"), path)
    return tokens.document_digests(spark, path)


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior, score and decision for every document."""
    return quality.judged(table(spark, sf_dir, "documents"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base counts and digest, all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_form", "best_bits")


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_texts(table(spark, sf_dir, "pages"))


ORACLES["op5_html_extraction"] = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS body FROM pages),
b AS (SELECT page_id, url, unnest(regexp_split_to_array(body, '</?(?:p|h1)>')) AS block, generate_subscripts(regexp_split_to_array(body, '</?(?:p|h1)>'), 1) AS i FROM a),
c AS (
  SELECT page_id, url, i, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;?', '"', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, url, coalesce(string_agg(regexp_replace(t, '&amp$', '&'), chr(10) ORDER BY i) FILTER (t <> ''), '') AS text,
  length(coalesce(string_agg(regexp_replace(t, '&amp$', '&'), chr(10) ORDER BY i) FILTER (t <> ''), ''))::BIGINT AS n_chars
FROM c GROUP BY page_id, url
"""


@query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, all spans."""
    found = pii.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest by source; of half of them a text without line breaks is presented."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = manifest.digest(*columns[:4], F.replace("text", F.lit("\n"), F.lit("")))
    shown = F.when(tampered & F.contains("text", F.lit("\n")), other)
    return manifest.manifest(docs, columns, "source", "doc_id", shown).withColumnRenamed("key", "doc_id")


ORACLES["op11_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
    list_reduce([4294967295] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1),
        lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT] || [-1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS crc,
    list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR],
      lambda x: coalesce(strlen(x) || ':' || x, '-')).array_to_string('') AS head
  FROM documents),
e AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    -- the digest ends with all bits turned over, so an even checksum has an odd last state
    CASE WHEN crc & 1 = 1 AND text IS NOT NULL
      THEN sha256(head || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS shown
  FROM d),
lv AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
nodes(source, lvl, pos, node, n) AS (
  SELECT source, 0, pos, leaf, count(*) OVER (PARTITION BY source) FROM lv
  UNION ALL
  SELECT source, any_value(lvl) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY source, pos // 3),
subroots AS (SELECT source, lvl AS top, node AS subroot FROM nodes WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos FROM subroots),
upper_nodes(lvl, pos, node, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM ranked
  UNION ALL
  SELECT any_value(lvl) + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY pos // 3),
root AS (SELECT node AS root FROM upper_nodes WHERE n = 1),
sides AS (
  SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY 1, 2, 3),
upper_sides AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM upper_nodes a JOIN upper_nodes b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY 1, 2),
fold(doc_id, source, leaf, start, subroot, top, s, pos, lvl, node, proof) AS (
  SELECT doc_id, lv.source, leaf, lv.pos, subroot, top, ranked.pos, lv.pos, 0, coalesce(shown, leaf), ''
  FROM lv JOIN ranked ON lv.source IS NOT DISTINCT FROM ranked.source
  UNION ALL
  SELECT doc_id, f.source, leaf, start, subroot, top, s,
    CASE WHEN f.lvl + 1 = top THEN s ELSE f.pos // 3 END, f.lvl + 1, sha256(sides.l || f.node || sides.r), proof || sides.l || sides.r
  FROM fold f JOIN sides ON f.source IS NOT DISTINCT FROM sides.source AND f.lvl = sides.lvl AND f.pos = sides.pos
  WHERE f.lvl < top),
-- a lone leaf is its subroot: its place among the sources counts from the start
begun AS (SELECT * REPLACE (CASE WHEN top = 0 THEN s ELSE pos END AS pos) FROM fold WHERE lvl = top),
up(doc_id, leaf, subroot, start, source, pos, lvl, node, proof) AS (
  SELECT doc_id, leaf, subroot, start, source, pos, 0, node, proof FROM begun
  UNION ALL
  SELECT doc_id, leaf, subroot, start, source, up.pos // 3, up.lvl + 1, sha256(u.l || up.node || u.r), proof || u.l || u.r
  FROM up JOIN upper_sides u ON up.lvl = u.lvl AND up.pos = u.pos)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM up, root WHERE lvl = (SELECT max(lvl) FROM upper_nodes)
"""


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact.marked(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op12_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for infilling, and the text rebuilt from that."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = infill.restored(F.col("output"), F.col("form"))
    return infill.fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


ORACLES["op13_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM d),
f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g
"""
