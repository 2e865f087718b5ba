"""Operator 11: the prefix trie of conversations, with count-min screening.

Conversations that begin alike share the work of their common prefix. A node
is a distinct sequence of first d turns; its members are the conversations that
begin with it.

1. Turns are dealt by ranges of (conversation, order) and each task walks its
   own runs, giving every prefix a digest. A digest is a polynomial of the
   turns' digests modulo a 127-bit prime, so a conversation that spans
   several tasks is put together from its parts (one row a task goes to the
   driver) and no conversation has to fit one task.
2. A count-min sketch of all digests, with counters that stop at two, is
   filled in the tasks, merged block by block and broadcast. It never estimates
   too low: estimate one proves that a prefix occurs once. It and the prefix after
   it in its conversation are nodes with one member, emitted where they are.
3. Only possibly shared prefixes are shuffled and grouped exactly.

Sums over subtrees need no walk by depth: a leaf counts for every node on its
smallest member's path, and a node saves what its members other than the
smallest repeat. Both are one number a conversation (what it repeats of
smaller ones; whether it is its leaf's smallest member), added up per node.

The sketch is sized by the number of prefixes up to ``MOST_CELLS`` (two bits
each, 16 MB); beyond what that separates more prefixes take the exact way, and the
result is the same. Digests of 127 bits stand for the sequences.

Defined cases: null role or text is empty; turns with equal numbers are ordered
by the digest of role and text, so that repeated and tied rows give one
result; null turn numbers come first; turns without a conversation id belong to
none and are left out; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.session import materialize

#: Digests are polynomials in BASE modulo PRIME.
PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
ROOT = bytes(16)
#: The sketch: ROWS rows of cells, at most MOST_CELLS in all, merged in blocks.
ROWS = 4
MOST_CELLS = 1 << 26
BLOCK_CELLS = 1 << 16
#: Ids a segment of a node's ends holds.
SEGMENT_IDS = 1 << 16
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def _ranges(df: DataFrame, *order: str) -> DataFrame:
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


# ---- turns in order -------------------------------------------------------

def turn_digests(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, digest, chars): slim rows; the texts stay where they are."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))
    return turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(order).alias("turn"), digest.alias("digest"), F.length(t).cast("long").alias("chars"))


def positions(slim: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): pos counts from 1 in (turn, digest) order."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, conv, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for c in batch.column("conv_id").to_pylist():
                at = at + 1 if c == conv else 1
                conv = c
                places.append(at)
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(places), pa.int32()), batch.column("conv_id"), pa.array(places, pa.int64()),
                                              batch.column("digest"), batch.column("chars")], ["pid", "conv_id", "at", "digest", "chars"])

    # rows that are alike in everything can be dealt to several ranges by a number of their own
    dealt = _ranges(slim.withColumn("_n", F.monotonically_increasing_id()), "conv_id", "turn", "digest", "_n")
    placed = materialize(dealt.select("conv_id", "digest", "chars").mapInArrow(walk, "pid int, conv_id long, at long, digest binary, chars long"), "placed")
    runs = placed.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at")).alias("last")).orderBy("pid").collect()
    before, conv, n = [], None, 0
    for r in runs:  # one row a task
        goes_on = r["first"] == conv
        before.append((r["pid"], r["first"], n if goes_on else 0))
        n = r["last"]["at"] + (n if goes_on and r["first"] == r["last"]["conv_id"] else 0)
        conv = r["last"]["conv_id"]
    carried = F.broadcast(slim.sparkSession.createDataFrame(before, "pid int, conv_id long, before long"))
    return placed.join(carried, ["pid", "conv_id"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "chars")


def rebuilt(placed: DataFrame, every: int = 100, shares: int = 6) -> DataFrame:
    """Conversation c takes its first h turns from conversation c - c % every,
    h = crc32(c as decimal) % ``shares``: (conv_id, pos, digest, chars)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shares
    own = placed.filter((F.col("pos") > h) | (F.col("conv_id") % every == 0))
    heads = placed.filter((F.col("pos") == 1) & (F.col("conv_id") % every != 0)).select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("lead"), h.alias("h"))
    lead = placed.filter((F.col("conv_id") % every == 0) & (F.col("pos") < shares)).select(F.col("conv_id").alias("lead"), "pos", "digest", "chars")
    copied = heads.join(lead, "lead").filter("pos <= h").select("conv_id", "pos", "digest", "chars")
    return own.unionByName(copied)


# ---- digests of prefixes --------------------------------------------------

_STEPS = "pid int, conv_id long, at long, digest binary, parent binary, chars long, sum long, last boolean"


def _walk_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, parent's digest and summed code points of each prefix, counted from where
    the conversation begins in this task; ``last`` as far as this task sees."""
    pid = TaskContext.get().partitionId()
    conv, at, value, total, held = None, 0, 0, 0, None
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    names = [part.split()[0] for part in _STEPS.split(", ")]

    def made(rows: list) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        rows = []
        for c, digest, chars in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "digest", "chars")), strict=True):
            if held:
                rows.append((*held, held[1] != c))
            if c != conv:
                conv, at, value, total = c, 0, 0, 0
            parent = value.to_bytes(16, "big")
            at, value, total = at + 1, (value * BASE + int.from_bytes(digest, "big")) % PRIME, total + chars
            held = (pid, c, at, value.to_bytes(16, "big"), parent, chars, total)
        yield made(rows)
    if held:
        yield made([(*held, True)])


@dataclass(frozen=True)
class Carried:
    """What the tasks before task ``pid`` saw of its first conversation; one entry a task."""
    conv: np.ndarray     # its first conversation where something is carried on
    on: np.ndarray
    count: list[int]
    value: list[int]
    total: list[int]
    left: np.ndarray     # its last conversation where that goes on in a later task
    goes_on: np.ndarray


def _carried(steps: DataFrame) -> tuple[Carried, int]:
    """And the number of prefixes."""
    runs = steps.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "at", "digest", "sum")).alias("last"),
                                    F.count(F.lit(1)).alias("n")).orderBy("pid").collect()
    size = runs[-1]["pid"] + 1 if runs else 1
    c = Carried(np.zeros(size, np.int64), np.zeros(size, bool), [0] * size, [0] * size, [0] * size, np.zeros(size, np.int64), np.zeros(size, bool))
    conv, state, before = None, (0, 0, 0), None
    for r in runs:
        pid, last, part = r["pid"], r["last"]["conv_id"], (r["last"]["at"], int.from_bytes(r["last"]["digest"], "big"), r["last"]["sum"])
        if r["first"] == conv:
            c.conv[pid], c.on[pid], c.left[before], c.goes_on[before] = conv, True, conv, True
            c.count[pid], c.value[pid], c.total[pid] = state
            if last == conv:
                part = (state[0] + part[0], (state[1] * pow(BASE, part[0], PRIME) + part[1]) % PRIME, state[2] + part[2])
        conv, state, before = last, part, pid
    return c, sum(r["n"] for r in runs)


def _whole(batch: pa.RecordBatch, c: Carried) -> tuple:
    """conv, depth, digests, parents, chars, sums, last of a batch, whole conversations in mind."""
    pid, conv, at, total = (batch.column(k).to_numpy() for k in ("pid", "conv_id", "at", "sum"))
    digest, parent = batch.column("digest").to_pylist(), batch.column("parent").to_pylist()
    last = batch.column("last").to_numpy(zero_copy_only=False) & ~(c.goes_on[pid] & (c.left[pid] == conv))
    depth, total = at.copy(), total.copy()
    for i in np.flatnonzero(c.on[pid] & (c.conv[pid] == conv)):
        p, local = pid[i], int(at[i])
        power = pow(BASE, local - 1, PRIME)
        parent[i] = ((c.value[p] * power + int.from_bytes(parent[i], "big")) % PRIME).to_bytes(16, "big")
        digest[i] = ((c.value[p] * power * BASE + int.from_bytes(digest[i], "big")) % PRIME).to_bytes(16, "big")
        depth[i] += c.count[p]
        total[i] += c.total[p]
    return conv, depth, digest, parent, batch.column("chars"), total, last


# ---- the sketch -----------------------------------------------------------

def _cells(digests: list[bytes], width: int) -> np.ndarray:
    """(ROWS, n): a cell of each row of the sketch, from a quarter of the digest each."""
    words = np.frombuffer(b"".join(digests), dtype=">u4").reshape(-1, ROWS).T.astype(np.int64)
    return (words & (width - 1)) + np.arange(ROWS)[:, None] * width


def _pack(counters: np.ndarray) -> np.ndarray:
    """Four two-bit counters a byte."""
    c = counters.reshape(-1, 4)
    return c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6


def _unpack(packed: np.ndarray) -> np.ndarray:
    return ((packed[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).reshape(-1)


def sketch_width(prefixes: int, most_cells: int = MOST_CELLS) -> int:
    """Cells of a row: a power of two, twice the prefixes if the bound allows it."""
    return min(max(1 << max(2 * prefixes - 1, 1).bit_length(), BLOCK_CELLS // ROWS), most_cells // ROWS)


def count_min(steps: DataFrame, carried: Carried, width: int) -> np.ndarray:
    """The packed sketch of all prefix digests; a counter of two means two or more."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(ROWS * width, dtype=np.uint8)
        for batch in batches:
            digests = _whole(batch, carried)[2]
            if digests:
                cells, n = np.unique(_cells(digests, width), return_counts=True)
                counters[cells] = np.minimum(counters[cells] + n, 2)
        blocks = counters.reshape(-1, BLOCK_CELLS)
        for b in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array([zlib.compress(_pack(blocks[b]).tobytes(), 1)], pa.binary())], ["block", "cells"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK_CELLS, dtype=np.uint8)
        for cells in group.column("cells"):
            total = np.minimum(total + _unpack(np.frombuffer(zlib.decompress(cells.as_py()), dtype=np.uint8)), 2)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([zlib.compress(_pack(total).tobytes(), 1)], pa.binary())})

    packed = np.zeros(ROWS * width // 4, dtype=np.uint8)
    merged = steps.mapInArrow(fill, "block int, cells binary").groupBy("block").applyInArrow(merge, "block int, cells binary")
    for r in merged.toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["cells"]), dtype=np.uint8)
        packed[r["block"] * len(part):(r["block"] + 1) * len(part)] = part
    return packed


def _estimates(packed: np.ndarray, digests: list[bytes], width: int) -> np.ndarray:
    cells = _cells(digests, width)
    return ((packed[cells >> 2] >> ((cells & 3) * 2).astype(np.uint8)) & 3).min(axis=0)


def screened(steps: DataFrame, carried: Carried, packed: np.ndarray, width: int) -> DataFrame:
    """Every prefix with its whole digest and whether the sketch proves it (and its parent) single."""
    sketch = steps.sparkSession.sparkContext.broadcast(packed)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, digest, parent, chars, total, last = _whole(batch, carried)
            if not digest:
                continue
            single = _estimates(sketch.value, digest, width) == 1
            above = (_estimates(sketch.value, parent, width) == 1) & (depth > 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv), pa.array(depth), pa.array(digest, pa.binary()), pa.array(parent, pa.binary()), chars, pa.array(total), pa.array(last),
                 pa.array(single | above), pa.array(above)], ["conv_id", "depth", "digest", "parent", "chars", "sum", "last", "single", "parent_single"])

    return steps.mapInArrow(screen, "conv_id long, depth long, digest binary, parent binary, chars long, sum long, last boolean, single boolean, parent_single boolean")


# ---- nodes ----------------------------------------------------------------

def _own_end(conv: Column) -> Column:
    return F.sha2(conv.cast("string"), 256)


def ends_digests(ends: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """(digest, ends_sha256) of ``ends(digest, conv_id)``: ids are dealt by
    ranges and written out in segments where they are; a node with several
    segments is hashed from these, one at a time."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())],
                                              ["digest", "first", "ids"])

        for batch in batches:
            for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (d != node or len(ids) == segment_ids):
                    yield made()
                    ids = []
                node = d
                ids.append(c)
        if ids:
            yield made()

    segments = materialize(_ranges(ends.select("digest", "conv_id"), "digest", "conv_id").mapInArrow(cut, "digest binary, first long, ids string"), "ends")
    counts = segments.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("ids").alias("ids"))
    one = counts.filter("n = 1").select("digest", F.sha2("ids", 256).alias("ends_sha256"))
    several = counts.filter("n > 1").select("digest")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])

        for batch in batches:
            for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids"), strict=True):
                if d != node:
                    if state:
                        yield made()
                    node, state = d, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if state:
            yield made()

    rest = segments.join(several, "digest", "left_semi").repartition("digest").sortWithinPartitions("digest", "first")
    return one.unionByName(rest.select("digest", "ids").mapInArrow(hashed, "digest binary, ends_sha256 string"))


def prefix_trie(members: DataFrame, steps: DataFrame, most_cells: int = MOST_CELLS, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``members(conv_id)`` are all conversations, once each; ``steps(conv_id, pos,
    digest, chars)`` their turns, in order of pos."""
    walked = materialize(_ranges(steps, "conv_id", "pos").select("conv_id", "digest", "chars").mapInArrow(_walk_prefixes, _STEPS), "prefixes")
    carried, prefixes = _carried(walked)
    width = sketch_width(prefixes, most_cells)
    every = materialize(screened(walked, carried, count_min(walked, carried, width), width), "screened")
    tails, shared = every.filter("single"), every.filter("NOT single")

    grouped = shared.groupBy("digest").agg(F.min("conv_id").alias("top"), F.count(F.lit(1)).alias("n"), F.first("depth").alias("depth"),
                                           F.first("parent").alias("parent"))
    nodes = materialize(grouped, "nodes")
    boundary = tails.filter("NOT parent_single")
    children = (nodes.select("parent").unionByName(boundary.select("parent")).groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
                .withColumnRenamed("parent", "digest"))
    nodes = materialize(nodes.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # what each conversation repeats of smaller ones, and whether it is the smallest at its leaf
    met = materialize(shared.join(nodes.select("digest", "top", "n", "n_children"), "digest")
                      .select("conv_id", "digest", "n", (F.col("sum") - F.col("chars")).alias("above"),
                              F.when(F.col("top") != F.col("conv_id"), F.col("sum")).otherwise(F.lit(0)).alias("repeats"),
                              (F.col("last") & (F.col("n_children") == 0) & (F.col("top") == F.col("conv_id"))).cast("long").alias("leaf")), "met")
    ended = tails.filter("last").select("conv_id", F.lit(0).cast("long").alias("repeats"), F.lit(1).cast("long").alias("leaf"))
    own = materialize(met.select("conv_id", "repeats", "leaf").unionByName(ended).groupBy("conv_id")
                      .agg(F.max("repeats").alias("repeats"), F.max("leaf").alias("leaf")), "own")
    sums = (met.filter("n > 1").select("conv_id", "digest", "above").join(own, "conv_id").groupBy("digest")
            .agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("repeats") - F.col("above"), F.lit(0))).alias("saved_tokens")))

    turnless = members.join(every.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = ends_digests(shared.filter("last").select("digest", "conv_id").unionByName(turnless.select(F.lit(ROOT).alias("digest"), "conv_id")), segment_ids)
    totals = own.agg(F.sum("leaf").alias("n_leaves"), F.sum("repeats").alias("saved_tokens")).first()
    first = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    at_root = children.filter(F.col("digest") == F.lit(ROOT)).agg(F.max("n_children").alias("n")).first()["n"] or 0
    root = (members.sparkSession.range(1 if first["n_convs"] else 0)
            .select(F.lit(ROOT).alias("digest"), F.lit(first["conv_id"]).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
                    F.lit(None).cast("long").alias("parent_conv_id"), F.lit(first["n_convs"]).cast("long").alias("n_convs"),
                    F.lit(at_root).cast("long").alias("n_children"), F.lit(totals["n_leaves"] or 1).cast("long").alias("n_leaves"),
                    F.lit(totals["saved_tokens"] or 0).cast("long").alias("saved_tokens")))

    top = F.lit(first["conv_id"]).cast("long")
    tops = nodes.select(F.col("digest").alias("parent"), F.col("top").alias("parent_top"))
    # a parent that is no shared node lies in a tail: its one member is the conversation itself
    above = F.when(F.col("depth") == 1, top).otherwise(F.coalesce("parent_top", F.col("conv_id")))
    exact = (nodes.withColumnRenamed("top", "conv_id").join(tops, "parent", "left").join(sums, "digest", "left")
             .select("digest", "conv_id", "depth", above.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
                     F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens")))
    exact = exact.unionByName(root).join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS))).drop("digest")

    def tail(rows: DataFrame, parent: Column) -> DataFrame:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        return rows.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"),
                           one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("last"), _own_end(F.col("conv_id"))).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"))

    inner = tail(tails.filter("parent_single OR depth = 1"), F.when(F.col("depth") == 1, top).otherwise(F.col("conv_id")))
    return exact.unionByName(inner).unionByName(tail(boundary.filter("depth > 1").join(tops, "parent", "left"), above))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    placed = materialize(positions(turn_digests(table(spark, sf_dir, "conversations"))), "turns")
    return prefix_trie(placed.filter("pos = 1").select("conv_id"), rebuilt(placed))


OP11_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
bits AS (
  SELECT conv_id, flatten(list_transform(range(length(s)), lambda i: list_transform(range(8), lambda j: (ascii(s[i + 1]) >> CAST(j AS INTEGER)) & 1))) AS b FROM ids),
shares AS (
  SELECT conv_id, conv_id - conv_id % 100 AS lead,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda x: CAST(x AS BIGINT))),
           lambda c, x: xor(c >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
  FROM bits),
turns AS (
  SELECT s.conv_id, t.pos, t.role, t.text FROM shares s JOIN t ON t.conv_id = s.lead AND t.pos <= s.h
  UNION ALL SELECT s.conv_id, t.pos, t.role, t.text FROM shares s JOIN t USING (conv_id) WHERE t.pos > s.h),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, count(*) OVER (PARTITION BY conv_id) AS turns FROM turns),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, sha256('') AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS chars FROM shares
  UNION ALL
  SELECT p.conv_id, n.depth, sha256(p.node || length(n.role) || ':' || n.role || n.text), p.node, length(n.text)
  FROM path p JOIN numbered n ON n.conv_id = p.conv_id AND n.depth = p.depth + 1),
ended AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
nodes AS (
  SELECT node, min(p.conv_id) AS conv_id, min(p.depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (e.depth = p.depth), '')) AS ends_sha256
  FROM path p JOIN ended e USING (conv_id) GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
filled AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
subtrees AS (
  SELECT p.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved_tokens
  FROM filled u JOIN path p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.node)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM filled f JOIN subtrees s USING (node) LEFT JOIN nodes up ON up.node = f.parent
"""
