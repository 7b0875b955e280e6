"""N-gram Jaccard join by chosen paths.

Documents with equal texts form a copy class; the join works on one
representative of each. A representative's set holds the hashes of its
distinct runs of ``SHINGLE`` words (shorter texts: one run of all words).
``COORDINATES`` min-hashes stand for the set.

The join is a forest of random trees. At a root, and again at each node that
holds more than a bucket may, coordinates are sampled and the sets split by the
token that is smallest there, which two sets share with a chance equal to
their Jaccard similarity. A set follows its one token at a root and
``FANOUT`` tokens at each deeper node. Nodes of one set are dropped, small
nodes are compared by brute force, and so are nodes that splitting would not
divide because their sets are alike (cut into blocks, each pair of blocks a
task of its own). Independent trees repeat until a pair at the threshold is
missed with a chance of at most ``1 - TARGET_RECALL``.

Brute force goes in two steps. First min-hash agreement, on 192 bytes a set,
keeps members that have a partner at all; then the whole shingle sets of
those are read and compared exactly. A pair that meets in several buckets is
counted in the first only, which both members can tell from their lists of
buckets. A bucket returns one row a member (its number of links, and the least
member it is connected to), never its pairs.

Results: ``links`` has every representative with its links to other texts;
groups are connected components of the links.

Defined cases: null is the empty text; texts without words have no set and
link to nothing but are copies of each other; equal sets of different texts
are links of similarity 1; equal ids with different texts are different
documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.llm.common import cut, inner_positions, mix64, slices, text_or_empty, word_hashes

SHINGLE = 5
#: Similarity of at least 4/5, tested in whole numbers.
NUM, DEN = 4, 5
TARGET_RECALL = 0.9999
COORDINATES = 48
FANOUT = 3
#: A pair at the threshold agrees in fewer coordinates than this with a chance of 1e-7.
AGREE = 24
BUCKET_SETS = 400
BUCKET_SHINGLES = 1_000_000
MOST_LEVELS = 12
#: Representatives up to this number are sent to all tasks to pick their texts; more are joined.
SENT_KEYS = 300_000

_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs(recall: float = TARGET_RECALL) -> int:
    """Trees after which a pair at the threshold is missed with a chance of at most 1 - recall."""
    s = NUM / DEN
    once = s * (1 - (1 - s) ** FANOUT)
    return math.ceil(math.log(1 - recall) / math.log(1 - once))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word runs, text by text (with repeats), and their number per text."""
    words, counts = word_hashes(pa.compute.utf8_lower(texts))
    at, each = inner_positions(counts, SHINGLE)
    h = np.zeros(len(at), np.uint64)
    for j in range(SHINGLE):
        h = (h ^ words[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        begins = np.cumsum(counts) - counts
        single = []
        for i in short:
            x = np.array([counts[i]], np.uint64)
            for w in words[begins[i] : begins[i] + counts[i]]:
                x = (x ^ w) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
            single.append(x[0])
        each = each.copy()
        slot = np.cumsum(each)[short]
        h = np.insert(h, slot, np.array(single, np.uint64))
        each[short] = 1
    return mix64(h), each


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        h, each = shingles(piece.column("text"))
        full = np.flatnonzero(each)
        begins = (np.cumsum(each) - each)[full]
        low = np.zeros((len(each), COORDINATES), ">u4")
        if len(full):
            for c, odd in enumerate(_SEEDS):
                low[full, c] = np.minimum.reduceat(h * odd, begins) >> np.uint64(32)
        sig = [low[i].tobytes() if each[i] else None for i in range(len(each))]
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), piece.column("key"), pa.array(each, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "key", "weight", "sig"]
        )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key of the copy class (128 bits of the text's hash)."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row per copy class: key, least doc_id, copies, weight (word runs) and min-hashes."""
    rows = keyed(docs).mapInArrow(_signatures, "doc_id long, key binary, weight long, sig binary")
    return rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), F.max("sig").alias("sig"))


def _child(path, j: int, salt: str):
    """The child of ``path`` by the j-th coordinate sampled there."""
    at = F.pmod(F.xxhash64(path, F.lit(j), F.lit(salt)), F.lit(COORDINATES)).cast("int")
    return F.xxhash64(path, F.lit(j), F.substring("sig", at * 4 + 1, F.lit(4)))


def buckets(reps: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """(key, bucket, blocks): the nodes that brute force takes, each member's row; blocks > 1 for large ones."""
    n_runs = runs(recall)
    if n_runs > COORDINATES:
        raise ValueError("that recall needs more trees than there are coordinates")
    sets = reps.filter("weight > 0").select("key", "weight", "sig")
    roots = F.array(*[F.xxhash64(F.lit(f"tree {r}"), F.substring("sig", r * 4 + 1, 4)) for r in range(n_runs)])
    nodes = sets.select("key", "weight", F.explode(roots).alias("path"))
    done = None
    for level in range(MOST_LEVELS + 1):
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).filter("n > 1")
        known = cut(nodes.join(sizes, "path"))
        blocks = F.greatest(F.ceil(F.col("n") / BUCKET_SETS), F.ceil(F.col("w") / BUCKET_SHINGLES))
        known = known.withColumn("blocks", blocks)
        small = known.filter((F.col("blocks") == 1) | F.lit(level == MOST_LEVELS)).select("key", F.col("path").alias("bucket"), "blocks")
        done = small if done is None else done.unionByName(small)
        large = known.filter("blocks > 1")
        if level == MOST_LEVELS or not large.limit(1).count():
            break
        kids = large.join(sets.select("key", "sig"), "key").select(
            "key", "weight", "path", "n", "blocks",
            F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _child(F.col("path"), j, "node").alias("kid")) for j in range(FANOUT)])).alias("c"),
        ).select("key", "weight", "path", "n", "blocks", "c.j", "c.kid")
        kids = cut(kids)
        most = kids.groupBy("path", "j", "kid").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).groupBy("path", "j").agg(F.max(F.col("m") / F.col("n")).alias("share"))
        alike = most.groupBy("path").agg(F.avg("share").alias("share")).filter("share >= 0.5").select("path")
        done = done.unionByName(large.join(alike, "path", "left_semi").select("key", F.col("path").alias("bucket"), "blocks"))
        nodes = kids.join(alike, "path", "left_anti").select("key", "weight", F.col("kid").alias("path"))
    return cut(done.distinct())


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows of a large bucket go to each pair of blocks that has theirs."""
    own = F.pmod(F.xxhash64("key", F.lit("block")), F.col("blocks"))
    rows = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other"), "own": F.col("_own")}).drop("_own", "_other")


def _not_earlier(bucket: int, lo: int, hi: int, own: np.ndarray, buckets: list[np.ndarray]) -> np.ndarray:
    """Pairs of the group that this bucket answers for: no smaller bucket holds both, and they are of the two blocks."""
    n = len(own)
    mine = np.triu(np.ones((n, n), bool), 1)
    if lo != hi:
        mine &= own[:, None] != own[None, :]
    member = np.repeat(np.arange(n), [len(b) for b in buckets])
    at = np.concatenate(buckets)
    member, at = member[at < bucket], at[at < bucket]
    order = np.argsort(at, kind="stable")
    member, at = member[order], at[order]
    edges = np.flatnonzero(np.diff(at, prepend=np.nan, append=np.nan) != 0)
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j - i > 1:
            mine[np.ix_(member[i:j], member[i:j])] = False
    return mine


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, from rows sorted by the keys, with the groups' borders."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        columns = [now.column(k).to_numpy() for k in keys]
        new = np.zeros(len(now), bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(new)]) if len(now) else np.zeros(0, np.int64)
        if len(edges) > 1:
            yield now.slice(0, edges[-1]), edges
            held = now.slice(edges[-1])
        elif len(now):
            held = now
    if held is not None:
        yield held, np.array([0, len(held)])


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of each group that agree with some other in enough coordinates, in a pair the group answers for."""
    for rows, edges in _whole_groups(batches, ["bucket", "lo", "hi"]):
        rows = rows.combine_chunks()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), ">u4").reshape(len(rows), COORDINATES).astype(np.uint32)
        bucket, lo, hi, own = (rows.column(c).to_numpy() for c in ("bucket", "lo", "hi", "own"))
        lists = rows.column("buckets").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offset, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        keep = np.zeros(len(rows), bool)
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        likely = two[(sig[two] == sig[two + 1]).sum(axis=1) >= AGREE]
        many = edges[:-1][size > 2]
        for a, n in [*((x, 2) for x in likely), *zip(many, size[size > 2], strict=True)]:
            s = sig[a : a + n]
            if n <= 64:
                agree = (s[:, None] == s[None]).sum(axis=2)
            else:
                agree = np.zeros((n, n), np.uint8)
                for c in range(COORDINATES):
                    agree += s[:, c, None] == s[None, :, c]
            pair = np.triu(agree >= AGREE, 1)
            if pair.any():
                pair &= _not_earlier(bucket[a], lo[a], hi[a], own[a : a + n], [flat[offset[i] : offset[i + 1]] for i in range(a, a + n)])
                keep[a : a + n] = pair.any(axis=0) | pair.any(axis=1)
        yield from rows.filter(pa.array(keep)).select(["key", "bucket", "lo", "hi", "own", "buckets", "copies"]).to_batches()


def _exact(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each member that this bucket answers for, and the least member it is connected to."""
    pdf = pdf.sort_values("key", ignore_index=True)
    n, mine = len(pdf), _not_earlier(pdf.bucket.iat[0], pdf.lo.iat[0], pdf.hi.iat[0], pdf.own.to_numpy(), list(pdf.buckets))
    sets = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at, minlength=len(token)) > 1
    number = np.cumsum(shared) - 1
    owner, at = owner[shared[at]], number[at[shared[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    both = np.zeros((n, n), np.float32)  # whole numbers below 2 ** 24
    step = 1024
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(at, [low, low + step])
        has = np.zeros((n, step), np.float32)
        has[owner[a:b], at[a:b] - low] = 1
        both += has @ has.T
    link = mine & (DEN * both.astype(np.float64) >= NUM * (size[:, None] + size[None, :] - both))
    link |= link.T
    copies = pdf["copies"].to_numpy()
    root = np.arange(n)
    while True:
        low = np.minimum(root, np.where(link, root[None, :], n).min(axis=1))
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = link.any(axis=1)
    return pd.DataFrame({"key": pdf["key"][some], "root": pdf["key"].to_numpy()[root[some]], "texts": link.sum(axis=1)[some], "docs": (link @ copies)[some]})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        h, each = shingles(piece.column("text"))
        ends = np.cumsum(each)
        out = [np.unique(h[b - n : b]).tobytes() for b, n in zip(ends, each, strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(out, pa.binary())], names=["key", "shingles"])


def links(docs: DataFrame, reps: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """key, root, texts, docs: a linked representative's share in one bucket (several rows a key)."""
    members = buckets(reps, recall)
    lists = members.groupBy("key").agg(F.collect_set("bucket").alias("buckets"))
    rows = _blocked(members.join(lists, "key").join(reps.select("key", "sig", "copies"), "key"))
    group = ["bucket", "lo", "hi"]
    # tens of thousands of tiny groups: whole batches of them at a time
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*group, "own", "key", "sig", "buckets", "copies").repartition(parts, *group).sortWithinPartitions(*group)
    some = cut(dealt.mapInArrow(_plausible, "key binary, bucket long, lo long, hi long, own long, buckets array<long>, copies long"))
    wanted = cut(some.select("key").distinct().join(reps.select("key", "rep"), "key"))
    if wanted.count() <= SENT_KEYS:
        wanted = F.broadcast(wanted)
    rows = keyed(docs)
    texts = rows.join(wanted, (rows["key"] == wanted["key"]) & rows["doc_id"].eqNullSafe(wanted["rep"]), "left_semi")
    sets = texts.mapInArrow(_sets, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    return some.join(sets, "key").groupBy(*group).applyInPandas(_exact, "key binary, root binary, texts long, docs long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node of each node's connected component.

    Each round takes the least label among a node's neighbours and then that
    label's own label, so that chains halve; it ends when no label changes.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("near")))
    both = cut(both.filter("node <> near").distinct())
    now = cut(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("label")))
    while True:
        near = both.join(now.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("low"))
        step = now.join(near, "node").select("node", F.least("label", "low").alias("low"), F.col("label").alias("old"))
        step = cut(step)
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("_far"))
        now = cut(step.join(jump, "low").select("node", F.least("low", "_far").alias("label"), "old"))
        if not now.filter("label <> old").limit(1).count():
            return now.select("node", "label")
        now = now.select("node", "label")


def classes(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """Per copy class: key, rep, copies, its links to other texts, and the first document of its group."""
    reps = cut(representatives(docs))
    found = cut(links(docs, reps, recall))
    totals = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    labels = components(found, "key", "root").withColumnRenamed("node", "key")
    rows = reps.select("key", "rep", "copies").join(totals, "key", "left").join(labels, "key", "left")
    rows = cut(rows.withColumn("label", F.coalesce("label", "key")))
    head = rows.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("key"))).alias("head"))
    return rows.join(head, "label").select("key", "rep", "copies", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"), "head")


def near_duplicates(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (first document of its group), copy_id (of its copies), links to documents and to other texts."""
    found = classes(docs, recall)
    return keyed(docs).select("doc_id", "key").join(found, "key").select(
        "doc_id", F.col("head.rep").alias("class_id"), F.col("rep").alias("copy_id"),
        (F.col("docs") + F.col("copies") - 1).alias("n_links"), F.col("texts").alias("n_text_links"),
    )


def first_of_each_group(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """The document of least id of each group, once, with all its columns, whatever their names."""
    heads = classes(docs, recall).select(F.col("head.rep").alias("_id"), F.col("head.key").alias("_key")).distinct()
    own = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own, strict=True))
    rows = docs.toDF(*own).withColumns({"_id": F.col(at["doc_id"]).cast("long"), "_key": F.unhex(F.md5(text_or_empty(at["text"])))})
    same = rows["_id"].eqNullSafe(heads["_id"]) & (rows["_key"] == heads["_key"])
    kept = rows.join(heads, same, "left_semi")
    return kept.dropDuplicates(["_id", "_key"]).select(*[F.col(o).alias(c) for c, o in at.items()])
