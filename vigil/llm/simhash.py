"""Operator 9: SimHash near-duplicates through a vantage-point tree.

Fingerprints: words of the text (A-Z lower-cased, split at ASCII white
space), shingles of ``shingle`` words (repeats included, space-joined), the
XXH64 (seed 42) of each; a bit is 1 if set in over half the hashes.

Search: equal fingerprints are grouped first, so copies cost nothing. A
vantage-point tree (a fingerprint and a radius per inner node, fitted on a
bounded sample) partitions the distinct fingerprints: each is stored in one
leaf, and queries every leaf its ball of ``max_bits`` can reach by the triangle
inequality (d <= radius + max_bits inside, d > radius - max_bits outside).
Inside a leaf, distances to the leaf's pivot prune again, and the pairs left
are compared exactly. Only the tree depends on the sample, never the result:
every linked pair meets in the leaf that stores either of them.

A leaf hands on one edge per linked fingerprint (to the smallest of its local
group), never the pairs. Leaves above ``leaf_limit`` fingerprints are compared
in blocks, each its own task. Components then run over these edges.

Defined cases: null text counts as empty; texts without words have
fingerprint zero and link like any other; rows with a null id are returned
with the component of their fingerprint but never name it (null where no
member has an id); repeated rows repeat; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import content_key, id_and_text, keep_rows, table
from vigil.llm.components import connected_components
from vigil.session import materialize

#: Row b holds the bits of byte b, each in a byte of its own (lowest bit lowest): eight counters in one 64-bit word.
_SPREAD = (((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint64) << (8 * np.arange(8)).astype(np.uint64)).sum(axis=1).astype(np.uint64)
#: The tree is fitted on one distinct fingerprint in SAMPLE_EVERY, and on at most SAMPLE_LIMIT (the ones that hash lowest).
SAMPLE_EVERY = 8
SAMPLE_LIMIT = 65_536
LEAF_TARGET = 4096
LEAF_LIMIT = 32_768


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of the 64-bit hashes (0 for none)."""
    n = len(hashes)
    if n == 0:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255 * 4096):  # a byte counts to 255
        lanes = _SPREAD[hashes[at:at + 255 * 4096].view(np.uint8).reshape(-1, 8)]
        cuts = np.arange(0, len(lanes), 255)
        counts += np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    spans = zip(starts[:n].tolist(), ends[shingle - 1:].tolist(), strict=True)
    return majority_bits(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_md5, fp): one row per input row; fp is the fingerprint as a signed long."""
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(fps.view(np.int64))],
                                             ["doc_id", "text_md5", "fp"])

    keyed = id_and_text(docs).withColumn("text_md5", content_key(F.col("text")))
    return keyed.mapInArrow(per_batch, "doc_id long, text_md5 string, fp long")


def _distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


class VantageTree:
    """Inner nodes are (pivot, radius, inside, outside), leaves (number, pivot)."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.leaves: list[int] = []
        self.root = self._build(np.unique(sample), depth)

    def _build(self, points: np.ndarray, depth: int):
        pivot = int(points[0]) if len(points) else 0
        if depth > 0 and len(points) > 2:
            best = None
            for candidate in points[:: max(1, len(points) // 5)][:5]:  # the widest spread of distances overlaps least
                d = _distance(points, candidate)
                if best is None or d.std() > best[1].std():
                    best = (int(candidate), d)
            radius = int(np.median(best[1]))
            inside = best[1] <= radius
            if 0 < inside.sum() < len(points):
                return (best[0], radius, self._build(points[inside], depth - 1), self._build(points[~inside], depth - 1))
        self.leaves.append(pivot)
        return (len(self.leaves) - 1, pivot)

    def route(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, home): every leaf that a fingerprint's ball can reach; home marks the one that stores it."""
        found: list[tuple[np.ndarray, int, np.ndarray]] = []

        def down(node, at: np.ndarray, home: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 2:
                found.append((at, node[0], home))
                return
            pivot, radius, inside, outside = node
            d = _distance(fps[at], np.uint64(pivot))
            low, high = d <= radius + reach, d > radius - reach
            down(inside, at[low], home[low] & (d[low] <= radius))
            down(outside, at[high], home[high] & (d[high] > radius))

        down(self.root, np.arange(len(fps)), np.ones(len(fps), dtype=bool))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return (np.concatenate([x[0] for x in found]), np.repeat([x[1] for x in found], [len(x[0]) for x in found]),
                np.concatenate([x[2] for x in found]))


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of a[i] and b[i] in place; roots are the smallest index."""
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def leaf_links(stored: np.ndarray, asking: np.ndarray, pivot: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root) for the fingerprints linked here, root being the smallest
    of the local group and left out itself. Only distance classes within
    ``reach`` of each other (to the pivot) are compared."""
    everyone = np.unique(np.concatenate([stored, asking]))
    root = np.arange(len(everyone))
    at_stored, at_asking = np.searchsorted(everyone, stored), np.searchsorted(everyone, asking)
    order = np.argsort(_distance(stored, np.uint64(pivot)), kind="stable")
    stored, at_stored = stored[order], at_stored[order]
    levels = _distance(stored, np.uint64(pivot))
    to_pivot = _distance(asking, np.uint64(pivot))
    for level in np.unique(to_pivot):
        lo, hi = np.searchsorted(levels, level - reach, "left"), np.searchsorted(levels, level + reach, "right")
        mine = np.flatnonzero(to_pivot == level)
        step = max(1, 4_000_000 // max(1, hi - lo))
        for i in range(0, len(mine), step):
            part = mine[i:i + step]
            close = np.bitwise_count(asking[part][:, None] ^ stored[lo:hi][None, :]) <= reach
            x, y = np.nonzero(close)
            a, b = at_asking[part[x]], at_stored[lo + y]
            other = a != b
            _merge(root, a[other], b[other])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return everyone[moved], everyone[root[moved]]


def near_duplicate_edges(nodes: DataFrame, max_bits: int, leaf_target: int = LEAF_TARGET,
                         leaf_limit: int = LEAF_LIMIT, sample_limit: int = SAMPLE_LIMIT) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints ``nodes(fp)`` whose
    components are those of all pairs within ``max_bits``."""
    spark = nodes.sparkSession
    total = nodes.count()
    drawn = nodes.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE_EVERY)) == 0)
    sample = [r.fp for r in drawn.orderBy(F.xxhash64("fp")).limit(sample_limit).collect()]
    tree = VantageTree(np.array(sample, dtype=np.int64).view(np.uint64), math.ceil(math.log2(max(1, total / leaf_target))))
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            fps = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            at, leaf, home = shared.value.route(fps, max_bits)
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "fp": fps[at].view(np.int64), "home": home})

    routed = materialize(nodes.select("fp").mapInPandas(route, "leaf int, fp long, home boolean"), "routed")
    # a leaf of more than leaf_limit is compared in blocks of stored by blocks of asking fingerprints
    sizes = routed.groupBy("leaf").agg(F.ceil(F.sum(F.col("home").cast("long")) / leaf_limit).cast("int").alias("np"),
                                       F.ceil(F.count(F.lit(1)) / (leaf_limit * 16)).cast("int").alias("nq"))
    sized = routed.join(F.broadcast(sizes), "leaf")  # one row per leaf; the tree has at most sample_limit leaves
    sized = sized.select("leaf", "fp", "home", F.greatest("np", F.lit(1)).alias("np"), F.greatest("nq", F.lit(1)).alias("nq"))

    def blocks(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    stored = sized.filter("home").select("leaf", "fp", F.lit(True).alias("stored"),
                                         F.pmod(F.xxhash64("fp"), "np").cast("int").alias("p"), blocks("nq").alias("q"))
    asking = sized.select("leaf", "fp", F.lit(False).alias("stored"),
                          F.pmod(F.xxhash64("fp"), "nq").cast("int").alias("q"), blocks("np").alias("p"))

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        kept = rows["stored"].to_numpy(dtype=bool)
        a, b = leaf_links(fps[kept], fps[~kept], shared.value.leaves[key[0]], max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (stored.unionByName(asking).groupBy("leaf", "p", "q")
            .applyInPandas(link, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, **limits: int) -> DataFrame:
    """(doc_id, text_md5, fp, root, component_id): fingerprints within ``max_bits`` bits link;
    component_id is the smallest doc_id reachable over links, root a
    fingerprint that names the component where no member has an id."""
    hashed = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    labels = connected_components(near_duplicate_edges(nodes, max_bits, **limits))
    rooted = (nodes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "root", "component_id")
    return hashed.join(named, "fp").select("doc_id", "text_md5", "fp", "root", "component_id")


def without_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of each component, the one with the smallest doc_id (then content), all columns."""
    found = near_duplicates(docs, shingle, max_bits)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_md5")).alias("top"))
    return keep_rows(docs, first.select("top.doc_id", "top.text_md5"))


def op9_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents: 3-word shingles, 2 bits."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
