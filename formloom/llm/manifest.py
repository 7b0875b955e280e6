"""Merkle manifest of a table by butterfly exchange: every row gets its proof, and no pass goes down the tree.

Rows are leaves. They are put in order by (group, key) in ranges, numbered
inside their group (one row for each range closes the gaps), and cut into
blocks of ``FANOUT ** BLOCK_LEVELS`` leaves, aligned to the tree. A task hashes
its blocks up to their roots; from there on a block is a row of its own:
number, root so far, siblings met so far.

Round r joins what ``FANOUT`` neighbouring subtrees of ``FANOUT ** r`` blocks
know. Each block meets the one block of each neighbour that stands at the same
place, they swap roots, and every one of them hashes the common parent: after
the round all blocks under that parent hold its root and their own siblings,
which the next round needs. A last, shorter subtree answers for the places it
lacks, its blocks in turn, so a meeting never has more than ``FANOUT`` rows and
no block waits for another to come down. When a group's blocks have its root
the same rounds go on over groups, in which every block of a group takes part.
How many blocks stand behind each group is counted before and swapped over the
groups in the same way, for a block must know which places its neighbours have.

At last each block takes its own leaves again and gives every leaf the
siblings inside the block, followed by the block's.

``shown`` is a digest that somebody presents for a leaf: it is folded along the
original siblings, and ``verified`` says whether that gives the root.

Defined cases: a null group is one of its own, first in order; null keys come
first; leaves of equal key are ordered by digest; repeated rows are leaves of
their own; a table of one leaf has it as root, with an empty proof; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from formloom.llm.common import kept

FANOUT = 3
BLOCK_LEVELS = 5
BLOCK = FANOUT**BLOCK_LEVELS
#: Groups whose counts are broadcast to the blocks; some 200 bytes each.
SENT_GROUPS = 200_000
#: Rounds after which what the blocks hold is written down.
KEPT_ROUNDS = 8


def digest(*columns: Column | str) -> Column:
    """Hex digest of a row: each column as ``-`` if null, else its UTF-8 length, ``:`` and its value."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


# ---- order and blocks ------------------------------------------------------
def _numbered(leaves: DataFrame) -> DataFrame:
    """In order over ranges: part, turn (number of the group in the part) and place (in its group there)."""
    order = [F.col("group"), F.col("key").asc_nulls_first(), F.col("leaf")]
    dealt = leaves.repartitionByRange(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = T.StructType([*dealt.schema]).add("part", "integer").add("turn", "long").add("place", "long")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, turn, place = TaskContext.get().partitionId(), None, -1, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("group").to_numpy(zero_copy_only=False)
            new = np.append(names[:1] != last, names[1:] != names[:-1]).astype(bool)
            turns = turn + np.cumsum(new)
            at = np.arange(len(names))
            opened = np.maximum.accumulate(np.where(new, at, -1))
            places = np.where(opened < 0, place + 1 + at, at - opened)
            last, turn, place = names[-1], int(turns[-1]), int(places[-1])
            more = [pa.array(np.full(len(names), part, np.int32)), pa.array(turns), pa.array(places)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return kept(dealt.mapInArrow(number, schema))


def _placed(numbered: DataFrame) -> DataFrame:
    """s (number of the group), at (of the leaf in it), block; what the ranges add to each other is a row a range."""
    ends = numbered.groupBy("part").agg(
        F.min("group").alias("first"), F.max("group").alias("last"), F.max("turn").alias("turns"),
        F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).alias("rows_first"), F.max(F.struct("turn", "place")).alias("end"),
    )
    both = F.array(F.struct(F.col("first").alias("group"), F.col("rows_first").alias("rows"), F.lit(True).alias("opens")),
                   F.when(F.col("turns") > 0, F.struct(F.col("last").alias("group"), (F.col("end.place") + 1).alias("rows"), F.lit(False).alias("opens"))))
    of_group = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("part", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select("part", "x.*")
    shift = shift.withColumn("shift", F.coalesce(F.sum("rows").over(of_group), F.lit(0))).filter("opens").select("part", "shift")
    by_part = Window.orderBy("part")
    goes_on = F.coalesce(F.col("first") == F.lag("last").over(by_part), F.lit(False)).cast("long")
    base = ends.withColumn("goes_on", goes_on).withColumn("base", F.sum(F.col("turns") + 1).over(by_part) - F.col("turns") - 1 - F.sum("goes_on").over(by_part))
    parts = base.select("part", "base").join(shift, "part")
    # a row a range: as many as there are shuffle partitions
    at = F.col("place") + F.when(F.col("turn") == 0, F.col("shift")).otherwise(0)
    rows = numbered.join(F.broadcast(parts), "part").select("group", "key", "leaf", "shown", (F.col("base") + F.col("turn")).alias("s"), at.alias("at"))
    return rows.withColumn("block", F.floor(F.col("at") / BLOCK).cast("long"))


def _by_block(rows: DataFrame, work, schema: T.StructType) -> DataFrame:
    """``work(columns, a, b)`` for rows a to b of every (s, block), ascending by at; never more than a block and its state."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "s", "block").sortWithinPartitions("s", "block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def worked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            s, block = table.column("s").to_numpy(), table.column("block").to_numpy()
            edges = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (block[1:] != block[:-1])) + 1), len(s)]
            columns = table.to_pydict()
            out = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in work(columns, int(a), int(b))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            s, block = table.column("s").to_numpy(), table.column("block").to_numpy()
            whole = int(np.flatnonzero((s != s[-1]) | (block != block[-1]))[-1]) + 1 if s[0] != s[-1] or block[0] != block[-1] else 0
            if whole:
                yield from worked(table.slice(0, whole))
            held = table.slice(whole).combine_chunks()
        if held is not None:
            yield from worked(held)

    arrow = to_arrow_schema(schema)
    names, types = arrow.names, arrow.types
    return dealt.mapInArrow(run, schema)


def _levels(leaves: list[bytes], first: bool) -> list[list[bytes]]:
    """Nodes of a block's levels. The first block ends at its first single node, after BLOCK_LEVELS if it is full."""
    levels = [leaves]
    while len(levels[-1]) > 1 if first else len(levels) <= BLOCK_LEVELS:
        now = levels[-1]
        levels.append([_hash(b"".join(now[i : i + FANOUT])) for i in range(0, len(now), FANOUT)])
    return levels


def _block_roots(rows: DataFrame) -> DataFrame:
    def work(columns: dict, a: int, b: int) -> Iterator[tuple]:
        block = columns["block"][a]
        yield columns["s"][a], block, _levels([x.encode() for x in columns["leaf"][a:b]], block == 0)[-1][0].decode()

    return _by_block(rows.select("s", "block", "at", "leaf"), work, T.StructType().add("s", "long").add("block", "long").add("node", "string"))


# ---- rounds ----------------------------------------------------------------
def _swap(state: DataFrame, cell: list[Column], place: Column, have: Column, span: Column, digit: Column, sent: str) -> DataFrame:
    """Rows of ``state`` with ``met``: what they and the rows at the same place of their neighbours sent, by digit.

    A subtree of ``have`` rows stands among neighbours of up to ``span`` rows;
    its row at ``place`` also answers for the places place + have, + 2 have, ...
    """
    asked = F.sequence(place, F.greatest(place, span - 1), have)
    rows = state.select(F.struct(*cell).alias("cell"), place.alias("place"), digit.alias("digit"), F.struct(*state.columns).alias("own"), F.explode(asked).alias("to"))
    own = F.when(F.col("to") == F.col("place"), F.struct("digit", "own"))
    meeting = rows.groupBy("cell", "to").agg(F.sort_array(F.collect_list(F.struct("digit", F.col(f"own.{sent}").alias("sent")))).alias("met"), F.collect_list(own).alias("own"))
    return meeting.select("met", F.explode("own").alias("own")).select("met", "own.digit", "own.own.*")


def _subtree(number: Column, of: Column, r: int) -> tuple[Column, Column, Column, Column, Column]:
    """Cell, place, have, span and digit of ``number`` among ``of`` of them, in round r."""
    size = FANOUT**r
    mine = F.floor(number / size).cast("long")
    cell = F.floor(number / (size * FANOUT)).cast("long")
    have = F.least(F.lit(size).cast("long"), of - mine * size)
    span = F.least(F.lit(size).cast("long"), of - cell * size * FANOUT)
    return cell, number % size, have, span, mine % FANOUT


def _rounds(n: int) -> int:
    r = 0
    while FANOUT**r < n:
        r += 1
    return r


def _group_shapes(sizes: DataFrame, groups: int) -> DataFrame:
    """s, blocks and for each upper round how many blocks its subtree has, the most a neighbour has, and those before it."""
    state = sizes.withColumns({"size": F.col("blocks"), "upper": F.array().cast("array<struct<have:bigint,span:bigint,before:bigint,digit:bigint>>")})
    for q in range(_rounds(groups)):
        cell, place, have, span, digit = _subtree(F.col("s"), F.lit(groups), q)
        met = _swap(state, [cell], place, have, span, digit, "size")
        before = F.aggregate(F.filter("met", lambda x: x["digit"] < F.col("digit")), F.lit(0).cast("long"), lambda n, x: n + x["sent"])
        step = F.struct(F.col("size").alias("have"), F.array_max(F.transform("met", lambda x: x["sent"])).alias("span"), before.alias("before"), F.col("digit").alias("digit"))
        total = F.aggregate("met", F.lit(0).cast("long"), lambda n, x: n + x["sent"])
        state = met.select("s", "blocks", total.alias("size"), F.concat("upper", F.array(step)).alias("upper"))
        state = kept(state) if q % KEPT_ROUNDS == KEPT_ROUNDS - 1 else state
    return state.select("s", "blocks", "upper")


def _hashed(met: DataFrame, active: Column, rest: list[Column | str]) -> DataFrame:
    """The parent of those that met, and the siblings left and right of the row among them."""
    side = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda x: x["sent"]), "")
    pair = F.struct(side(lambda x: x["digit"] < F.col("digit")).alias("left"), side(lambda x: x["digit"] > F.col("digit")).alias("right"))
    parent = F.sha2(side(lambda x: F.lit(True)), 256)
    return met.select(*rest, F.when(active, parent).otherwise(F.col("node")).alias("node"), F.when(active, F.concat("path", F.array(pair))).otherwise(F.col("path")).alias("path"))


def _exchange(roots: DataFrame, shapes: DataFrame, most_blocks: int, groups: int) -> DataFrame:
    """Each block's subroot, root and path above it (a pair of left and right siblings for each level)."""
    state = roots.join(F.broadcast(shapes) if groups <= SENT_GROUPS else shapes, "s")
    state = state.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    ahead = _rounds(most_blocks)
    for r in range(ahead):
        cell, place, have, span, digit = _subtree(F.col("block"), F.col("blocks"), r)
        met = _swap(state, [F.col("s"), cell], place, have, span, digit, "node")
        state = _hashed(met, F.col("blocks") > FANOUT**r, ["s", "block", "blocks", "upper"])
        state = kept(state) if r % KEPT_ROUNDS == KEPT_ROUNDS - 1 else state
    state = state.withColumns({"subroot": F.col("node"), "place": F.col("block")})
    for q in range(_rounds(groups)):
        now = F.col("upper")[q]
        cell = F.floor(F.col("s") / FANOUT ** (q + 1)).cast("long")
        met = _swap(state.withColumn("was", F.col("place")), [cell], F.col("place"), now["have"], now["span"], now["digit"], "node")
        state = _hashed(met, F.lit(True), ["s", "block", "upper", "subroot", (F.col("was") + now["before"]).alias("place")])
        state = kept(state) if q % KEPT_ROUNDS == KEPT_ROUNDS - 1 else state
    return state.select("s", "block", "subroot", F.col("node").alias("root"), "path")


# ---- proofs ----------------------------------------------------------------
def _folded(node: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        node = _hash(left + node + right)
    return node


def _prove(columns: dict, a: int, b: int) -> Iterator[tuple]:
    """Rows of one block, its state (at -1) first."""
    subroot, root = columns["subroot"][a], columns["root"][a].encode()
    above = [(x["left"].encode(), x["right"].encode()) for x in columns["path"][a]]
    proof_above = b"".join(left + right for left, right in above)
    a += 1
    levels = _levels([x.encode() for x in columns["leaf"][a:b]], columns["block"][a] == 0)
    rest, tops = [b""], {}
    for now in reversed(levels[:-1]):
        rest = [b"".join(now[i // FANOUT * FANOUT : i]) + b"".join(now[i + 1 : (i // FANOUT + 1) * FANOUT]) + rest[i // FANOUT] for i in range(len(now))]
    for i in range(b - a):
        node, at = (columns["shown"][a + i] or columns["leaf"][a + i]).encode(), i
        for now in levels[:-1]:
            first = at // FANOUT * FANOUT
            node, at = _hash(b"".join(now[first:at]) + node + b"".join(now[at + 1 : first + FANOUT])), at // FANOUT
        if node not in tops:  # leaves of one block that were not tampered with go the same way from here
            tops[node] = _folded(node, above)
        folded = tops[node]
        yield (
            columns["key"][a + i], columns["leaf"][a + i], subroot, root.decode(), hashlib.sha256(rest[i] + proof_above).hexdigest(),
            folded.decode(), folded == root,
        )


def proofs(leaves: DataFrame) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of each row (group string, key, leaf, shown).

    ``leaf`` and ``shown`` are hex digests; a null ``shown`` is the leaf itself.
    """
    group = F.when(F.col("group").isNull(), "").otherwise(F.concat(F.lit("="), F.col("group").cast("string")))
    numbered = _numbered(leaves.select(group.alias("group"), "key", "leaf", "shown"))
    placed = _placed(numbered)
    sizes = kept(placed.groupBy("s").agg(F.max("block").alias("blocks")).select("s", (F.col("blocks") + 1).alias("blocks")))
    most, groups = sizes.agg(F.coalesce(F.max("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    state = _exchange(_block_roots(placed), _group_shapes(sizes, groups), most, groups)
    own = placed.select("s", "block", "at", "key", "leaf", "shown")
    key = leaves.schema["key"].dataType
    first = state.select("s", "block", F.lit(-1).cast("long").alias("at"), "subroot", "root", "path")
    schema = T.StructType([T.StructField("key", key)]).add("leaf", "string").add("subroot", "string").add("root", "string")
    schema = schema.add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    return _by_block(own.unionByName(first, allowMissingColumns=True), _prove, schema)


def manifest(docs: DataFrame, columns: list[str], group_col: str, key_col: str, shown: Column | None = None) -> DataFrame:
    """Proofs of every row of ``docs``, digested over ``columns``; ``shown`` is what is presented for it (null: the row itself)."""
    other = F.lit(None).cast("string") if shown is None else shown
    return proofs(docs.select(F.col(group_col).alias("group"), F.col(key_col).alias("key"), digest(*columns).alias("leaf"), other.alias("shown")))
