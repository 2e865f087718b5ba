"""Regularised boosted trees for a binary label, on Spark.

Second-order boosting of the logistic loss. Features are cut at quantiles
into at most 254 bins (one byte each), so that a split needs only the sums
of gradients and hessians per (node, feature, bin):

* a level of a tree is one pass: every task adds up the histograms of the open
  nodes over its rows, the partial sums meet per feature, and one row per (node,
  feature), the best split there, goes to the driver;
* a node with at most ``node_rows`` rows is not scanned level by level: its rows
  meet in one task, which grows the rest of the subtree from the same histograms
  (nodes are finished in parallel). When the whole table is such a node, the rows
  stay and ``block`` trees are grown at a time. ``node_rows`` bounds what a task
  holds: a million rows of 29 features are some 400 MB there, and a level of them takes
  no longer than the jobs of a pass;
* gradients are rounded to multiples of 2**-24 and summed as whole numbers, so
  a sum does not depend on the order or the number of tasks: both ways, and any
  re-run of a lost task, give the same trees (up to 2**39 units of weight);
* every ``block`` trees (``level_block``, where trees grow level by level and each
  pass walks the trees since the last write) the margins are written to the shared
  folder. A lost executor costs at most one pass, a lost job one block.

A split's gain is S(left) + S(right) - S(node) with
S = max(|G| - l1, 0)**2 / (H + l2); it needs ``min_child`` hessian on both
sides. Trees grow to ``depth`` and are then pruned from below where the gain is
less than ``gamma``. A leaf is worth -sign(G) max(|G| - l1, 0) / (H + l2) times
``rate``. Rows and columns are drawn per tree from the seed. Rows without a
value go to the side that gains more.

Null labels are left out; null and not-a-number features are missing values; a
table without rows has no trees and scores one half.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, HasLabelCol, HasWeightCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.session import materialize

MISSING = 255
MOST_BINS = 254
UNIT = float(1 << 24)
SMALLEST_GAIN = 1e-6


@dataclass(frozen=True)
class BoostParams:
    """The learner's nine settings, with the reference's defaults, and how it runs."""
    trees: int = S.TABULAR_GBT["trees"]
    depth: int = S.TABULAR_GBT["depth"]
    rate: float = S.TABULAR_GBT["rate"]
    subsample: float = S.TABULAR_GBT["subsample"]
    colsample: float = S.TABULAR_GBT["colsample"]
    min_child: float = S.TABULAR_GBT["min_child"]
    gamma: float = S.TABULAR_GBT["gamma"]
    l1: float = S.TABULAR_GBT["l1"]
    l2: float = S.TABULAR_GBT["l2"]
    max_bins: int = 64
    seed: int = 42
    node_rows: int = 1 << 20
    block: int = 50
    level_block: int = 4

    def __post_init__(self):
        if not 1 <= self.depth <= 16 or not 2 <= self.max_bins <= MOST_BINS or min(self.block, self.level_block) < 1:
            raise ValueError("depth is 1 to 16, max_bins 2 to 254, blocks at least 1")


# ---- binning --------------------------------------------------------------

def bin_edges(df: DataFrame, features: list[str], max_bins: int = 64) -> list[list[float]]:
    """Ascending cut points of each feature; a value goes left of a cut it
    does not exceed. Few distinct values (at most ``max_bins``) are all cut
    points but the largest, others are cut at quantiles. Two passes; per
    feature a sketch and at most a few bins' worth of values."""
    num = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(features)])
    cuts = [k / max_bins for k in range(1, max_bins)]
    aggs = [a for i in range(len(features)) for a in (F.approx_count_distinct(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", cuts, 10_000).alias(f"q{i}"))]
    row = num.agg(*aggs).first()
    few = [i for i in range(len(features)) if row[f"n{i}"] <= 2 * max_bins]
    values: dict[int, list[float]] = {i: [] for i in few}
    if few:
        pairs = num.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v")) for i in few])).alias("x")).select("x.*")
        for r in pairs.filter("v IS NOT NULL").distinct().collect():  # few features, few values each
            values[r["i"]].append(r["v"])
    edges = []
    for i in range(len(features)):
        if i in values and len(values[i]) <= max_bins:
            edges.append(sorted(values[i])[:-1])
        else:
            edges.append(sorted(set(row[f"q{i}"] or [])))
    return edges


def to_bins(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """(rows, features) bytes; ``MISSING`` where there is no value."""
    out = np.empty(values.shape, dtype=np.uint8)
    for j, cut in enumerate(edges):
        out[:, j] = np.searchsorted(np.asarray(cut, dtype=np.float64), values[:, j], side="left")
    out[np.isnan(values)] = MISSING
    return out


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]) if columns else np.empty((batch.num_rows, 0))


def binned(df: DataFrame, features: list[str], edges: list[list[float]], label: str, weight: str | None, row_id: str) -> DataFrame:
    """(row, y, w, bins, margin): the training table; ``row`` is a hash of the id, for the draws."""
    slim = df.filter(F.col(label).isNotNull()).select(
        F.xxhash64(row_id).alias("row"), F.col(label).cast("double").alias("y"), (F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)).alias("w"),
        *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(features)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = to_bins(_matrix(b, [f"c{i}" for i in range(len(features))]), edges)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("y"), b.column("w"), pa.array([r.tobytes() for r in bins], pa.binary()),
                                              pa.array(np.zeros(b.num_rows))], ["row", "y", "w", "bins", "margin"])

    return slim.mapInArrow(cut, "row long, y double, w double, bins binary, margin double")


# ---- trees ----------------------------------------------------------------

@dataclass
class Tree:
    """A tree in heap order: the children of node i are 2i + 1 and 2i + 2; a leaf has feature -1."""
    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    gain: np.ndarray
    g: np.ndarray
    h: np.ndarray
    value: np.ndarray

    @classmethod
    def blank(cls, depth: int) -> "Tree":
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n))

    def places(self, bins: np.ndarray, steps: int | None = None) -> np.ndarray:
        """The node each row ends in."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for _ in range(len(self.feature).bit_length() - 1 if steps is None else steps):
            f = self.feature[at]
            v = bins[rows, np.maximum(f, 0)]
            left = np.where(v == MISSING, self.missing_left[at], v <= self.bin[at])
            at = np.where(f < 0, at, 2 * at + 2 - left)
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.places(bins)]

    def settle(self, p: BoostParams) -> "Tree":
        """Prune from below, then give every node its worth."""
        for i in range(len(self.feature) // 2 - 1, -1, -1):
            if self.feature[i] >= 0 and self.gain[i] < p.gamma and self.feature[2 * i + 1] < 0 and self.feature[2 * i + 2] < 0:
                self.feature[i] = -1
        self.value = leaf_value(self.g, self.h, p)
        return self


def _shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def node_score(g, h, p: BoostParams):
    return _shrunk(g, p.l1) ** 2 / np.maximum(h + p.l2, 1e-16)


def leaf_value(g, h, p: BoostParams):
    return np.where(h + p.l2 > 0, -_shrunk(g, p.l1) / np.maximum(h + p.l2, 1e-16), 0.0) * p.rate


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the logistic loss, as whole multiples of 1 / UNIT."""
    q = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((q - y) * w * UNIT), np.rint(q * (1.0 - q) * w * UNIT)


def drawn_rows(row: np.ndarray, tree: int, p: BoostParams) -> np.ndarray:
    """Which rows a tree sees: a hash of (seed, tree, row) below the share."""
    if p.subsample >= 1:
        return np.ones(len(row), dtype=bool)
    with np.errstate(over="ignore"):
        x = row.astype(np.int64).view(np.uint64) + np.uint64((p.seed * 1_000_003 + tree + 1) % (1 << 63)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53) < p.subsample


def drawn_features(n: int, tree: int, p: BoostParams) -> np.ndarray:
    keep = max(1, int(p.colsample * n))
    return np.arange(n) if keep >= n else np.sort(np.random.default_rng([p.seed, tree]).choice(n, keep, replace=False))


def histograms(bins: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """(3, nodes, features, width): sums of g, h and rows per bin; the last bin holds missing values."""
    n, k = bins.shape
    at = np.where(bins == MISSING, width - 1, bins).astype(np.int64)
    at += (place[:, None] * k + np.arange(k)) * width
    flat, size = at.ravel(), nodes * k * width
    out = np.empty((3, size))
    for i, v in enumerate((g, h)):
        out[i] = np.bincount(flat, np.repeat(v, k), size)
    out[2] = np.bincount(flat, minlength=size)
    return out.reshape(3, nodes, k, width)


def best_splits(hist: np.ndarray, p: BoostParams) -> dict[str, np.ndarray]:
    """Per (node, feature) the best cut: bin, missing_left, gain and the left side's sums (in whole units)."""
    (g, h, n), width = hist, hist.shape[-1]
    total = hist.sum(axis=-1)
    base = node_score(total[0] / UNIT, total[1] / UNIT, p)[..., None]
    left = np.cumsum(hist[..., :width - 1], axis=-1)  # a cut after the last value parts values from missing ones

    def gains(side: np.ndarray) -> np.ndarray:
        lg, lh = side[0] / UNIT, side[1] / UNIT
        rg, rh = (total[0][..., None] - side[0]) / UNIT, (total[1][..., None] - side[1]) / UNIT
        found = node_score(lg, lh, p) + node_score(rg, rh, p) - base
        return np.where((lh >= p.min_child) & (rh >= p.min_child) & (side[2] > 0) & (side[2] < total[2][..., None]), found, -np.inf)

    sides = [left]
    if n[..., -1].any():
        sides.append(left + hist[..., -1:])  # missing values on the left
    every = np.stack([gains(s) for s in sides], axis=-1)
    shape = every.shape
    every = every.reshape(*shape[:2], -1)
    at = every.argmax(axis=-1)
    cut, way = at // len(sides), at % len(sides)
    chosen = np.stack([np.take_along_axis(s, np.broadcast_to(cut, (3, *cut.shape))[..., None], axis=-1)[..., 0] for s in sides])
    side = np.where(way == 0, chosen[0], chosen[-1])
    return {"bin": cut, "missing_left": way == 1, "gain": np.take_along_axis(every, at[..., None], axis=-1)[..., 0], "left": side, "total": total}


def _cells(bins: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, ...]:
    """(features, rows) numbers of cells: a feature has one per bin up to its last, and one for missing values
    where there are any. Per cell of all features its feature's place and its number; per feature its first cell
    and its cell of missing values (-1: none)."""
    codes = np.ascontiguousarray(bins.T[features])
    without = codes == MISSING
    some = without.any(axis=1)
    sizes = np.where(without, -1, codes.astype(np.int16)).max(axis=1, initial=-1).astype(np.int64) + 1 if some.any() else codes.max(axis=1, initial=0).astype(np.int64) + 1
    np.copyto(codes, sizes[:, None].astype(np.uint8), where=without)
    width = sizes + some
    first = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(features)), width)
    return codes, owner, np.arange(len(owner)) - first[owner], first, np.where(some, first + sizes, -1)


def _sums(codes: np.ndarray, first: np.ndarray, cells: int, rows: np.ndarray, slot: np.ndarray, values: list[np.ndarray], slots: int) -> np.ndarray:
    """(slots, values, cells): sums of each value over the rows of a slot; a feature at a time, which stays in the cache."""
    out = np.empty((slots, len(values), cells))
    values = [v[rows] for v in values]
    for code, start, end in zip(codes, first, [*first[1:], cells], strict=True):
        at = slot * (end - start)
        at += code.take(rows)
        for i, v in enumerate(values):
            out[:, i, start:end] = np.bincount(at, v, slots * (end - start)).reshape(slots, -1)
    return out


def _best_cells(sums: np.ndarray, total: np.ndarray, owner: np.ndarray, missing: np.ndarray, p: BoostParams) -> tuple[np.ndarray, ...]:
    """Per node the best cut, as :func:`best_splits` finds it over all features: gain (-inf: none), cell,
    missing_left and the left side's sums. Only cuts that leave both sides enough are valued."""
    nodes, _, cells = sums.shape
    left = np.cumsum(sums, axis=2)
    left -= owner * total[:, :, None]  # every feature's cells add up to the node's sums
    gain, cell, missing_left, side = np.full(nodes, -np.inf), np.zeros(nodes, np.int64), np.zeros(nodes, bool), np.zeros((nodes, sums.shape[1]))
    base = node_score(total[:, 0] / UNIT, total[:, 1] / UNIT, p)
    gap = missing[owner]
    for way in (False, True):
        if way:  # missing values on the left
            if not (missing >= 0).any():
                break
            left = left + np.where(gap >= 0, sums[:, :, gap], 0.0)
        use = (left[:, 1] >= p.min_child * UNIT) & (total[:, 1, None] - left[:, 1] >= p.min_child * UNIT) & (np.arange(cells) != gap)
        if sums.shape[1] > 2:
            use &= (left[:, 2] > 0) & (left[:, 2] < total[:, 2, None])
        if way:
            use &= gap >= 0
        node, at = np.nonzero(use)
        if not len(node):
            continue
        lg, lh = left[node, 0, at] / UNIT, left[node, 1, at] / UNIT
        rg, rh = total[node, 0] / UNIT - lg, total[node, 1] / UNIT - lh
        found = node_score(lg, lh, p) + node_score(rg, rh, p) - base[node]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        most = np.maximum.reduceat(found, starts)
        first = np.flatnonzero(found == np.repeat(most, np.diff(np.r_[starts, len(node)])))
        first = first[np.r_[True, node[first[1:]] != node[first[:-1]]]]
        of, c = node[first], at[first]
        better = (most > gain[of]) | (most == gain[of]) & (c < cell[of])  # of equal gains the first cut
        of, c = of[better], c[better]
        gain[of], cell[of], missing_left[of], side[of] = most[better], c, way, left[of, :, c]
    return gain, cell, missing_left, side


def grow(tree: Tree, top: int, levels: int, bins: np.ndarray, g: np.ndarray, h: np.ndarray, features: np.ndarray, p: BoostParams) -> None:
    """Grow the subtree under node ``top`` from the rows that are there. Of two siblings the
    rows of the smaller are summed, the other's sums are what is left of the parent's; nodes
    whose hessian is not enough for two sides are not looked at."""
    values = [g, h] if p.min_child > 0 else [g, h, np.ones(len(g))]  # a side with a hessian has rows
    tree.g[top], tree.h[top] = g.sum() / UNIT, h.sum() / UNIT
    if not len(bins) or not len(features):
        return
    codes, owner, cut_of, first, missing = _cells(bins, features)
    cells = len(owner)
    exact = max(np.abs(v).sum() for v in values) * len(features) < 1 << 53  # else differences would round
    rows, place, open_nodes = np.arange(len(bins)), np.zeros(len(bins), dtype=np.int64), np.array([top])
    sums = _sums(codes, first, cells, rows, place, values, 1)
    for level in range(levels):
        total = sums[:, :, owner == 0].sum(axis=2)
        gain, cell, missing_left, left = _best_cells(sums, total, owner, missing, p)
        s = np.flatnonzero(gain > SMALLEST_GAIN)
        if not len(s):
            return
        nodes, cut = open_nodes[s], cell[s]
        record_splits(tree, nodes, features[owner[cut]], cut_of[cut], missing_left[s], gain[s], left[s].T, total[s].T)
        if level == levels - 1:
            return
        number = np.full(len(open_nodes), -1)
        number[s] = np.arange(len(s))
        mine = number[place]
        keep = mine >= 0
        rows, mine = rows[keep], mine[keep]
        f = owner[cut]
        v = codes.ravel().take(f[mine] * len(bins) + rows)
        goes_left = v <= cut_of[cut][mine]
        if missing_left[s].any():
            goes_left |= missing_left[s][mine] & (v == (missing - first)[f][mine])
        place = 2 * mine + 1 - goes_left
        count = np.bincount(place, minlength=2 * len(s))
        child_h = np.column_stack([left[s, 1], total[s, 1] - left[s, 1]]).ravel()
        alive = (count > 1) & (child_h >= 2 * p.min_child * UNIT)
        if not alive.any():
            return
        if exact:
            less = 2 * np.arange(len(s)) + (count[1::2] < count[::2])
            less = less[alive[::2] | alive[1::2]]
        else:
            less = np.flatnonzero(alive)
        slot = np.full(2 * len(s), -1)
        slot[less] = np.arange(len(less))
        counted = np.flatnonzero(slot[place] >= 0)
        found = _sums(codes, first, cells, rows[counted], slot[place[counted]], values, len(less))
        after = np.flatnonzero(alive)
        at = slot[after]
        made = np.empty((len(after), *sums.shape[1:]))
        made[at >= 0] = found[at[at >= 0]]
        rest = after[at < 0]
        made[at < 0] = sums[s[rest // 2]] - found[slot[rest ^ 1]]
        number = np.full(2 * len(s), -1)
        number[after] = np.arange(len(after))
        keep = alive[place]
        rows, place, sums = rows[keep], number[place[keep]], made
        open_nodes = np.column_stack([2 * nodes + 1, 2 * nodes + 2]).ravel()[after]


def record_splits(tree: Tree, nodes, feature, cut, missing_left, gain, left, total) -> None:
    tree.feature[nodes], tree.bin[nodes], tree.missing_left[nodes], tree.gain[nodes] = feature, cut, missing_left, gain
    tree.g[nodes], tree.h[nodes] = total[0] / UNIT, total[1] / UNIT
    for child, side in ((2 * nodes + 1, left), (2 * nodes + 2, total - left)):
        tree.g[child], tree.h[child] = side[0] / UNIT, side[1] / UNIT


def boost_rows(row: np.ndarray, y: np.ndarray, w: np.ndarray, bins: np.ndarray, margin: np.ndarray, first: int, count: int, p: BoostParams) -> list[Tree]:
    """Trees ``first`` to ``first + count - 1`` from rows in memory."""
    made, margin = [], margin.copy()
    for t in range(first, first + count):
        g, h = gradients(y, w, margin)
        seen = drawn_rows(row, t, p)
        tree = Tree.blank(p.depth)
        grow(tree, 0, p.depth, bins[seen], g[seen], h[seen], drawn_features(bins.shape[1], t, p), p)
        made.append(tree.settle(p))
        margin += tree.margins(bins)
    return made


# ---- trees as rows --------------------------------------------------------

_NODE = "tree int, node int, feature int, bin int, missing_left boolean, gain double, g double, h double, value double"


def _reached(tree: Tree) -> np.ndarray:
    """Nodes from the root down to the leaves."""
    inside = np.zeros(len(tree.feature), dtype=bool)
    inside[0] = True
    for i in np.flatnonzero(tree.feature >= 0):  # parents before children
        if inside[i]:
            inside[2 * i + 1:2 * i + 3] = True
    return np.flatnonzero(inside)


def _node_rows(trees: list[Tree], first: int = 0, nodes=_reached) -> pa.Table:
    parts = [(first + i, t, nodes(t)) for i, t in enumerate(trees)]
    columns = {"tree": np.concatenate([np.full(len(n), i) for i, _, n in parts] or [np.empty(0)]).astype(np.int32),
               "node": np.concatenate([n for _, _, n in parts] or [np.empty(0)]).astype(np.int32)}
    for name in ("feature", "bin", "missing_left", "gain", "g", "h", "value"):
        columns[name] = np.concatenate([getattr(t, name)[n] for _, t, n in parts] or [np.empty(0)])
    types = [("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("missing_left", pa.bool_()), ("gain", pa.float64()),
             ("g", pa.float64()), ("h", pa.float64()), ("value", pa.float64())]
    return pa.table({k: pa.array(columns[k].astype(t.to_pandas_dtype()), t) for k, t in types})


def _write_nodes(tree: Tree, rows: list) -> None:
    for r in rows:
        for name in ("feature", "bin", "missing_left", "gain", "g", "h", "value"):
            getattr(tree, name)[r["node"]] = r[name]


# ---- passes over the training table ---------------------------------------

def _rows(batch: pa.RecordBatch | pa.Table, pending: list[Tree]) -> tuple[np.ndarray, ...]:
    """row, y, w, bins, margin with the pending trees added."""
    batch = batch.combine_chunks() if isinstance(batch, pa.Table) else batch
    row, y, w, margin = (batch.column(c).to_numpy() for c in ("row", "y", "w", "margin"))
    raw = b"".join(batch.column("bins").to_pylist())
    bins = np.frombuffer(raw, dtype=np.uint8).reshape(batch.num_rows, -1 if raw else 0)
    margin = margin.copy()
    for tree in pending:
        margin += tree.margins(bins)
    return row, y, w, bins, margin


def _level(data: DataFrame, pending: list[Tree], tree: Tree, number: int, nodes: list[int], depth: int, features: np.ndarray, width: int, p: BoostParams) -> dict[int, dict]:
    """The best split of each open node, from one pass."""
    where = np.full(len(tree.feature), -1)
    where[nodes] = np.arange(len(nodes))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(nodes), len(features), width), dtype=np.int64)
        for batch in batches:
            row, y, w, bins, margin = _rows(batch, pending)
            place = where[tree.places(bins, depth)]
            use = (place >= 0) & drawn_rows(row, number, p)
            g, h = gradients(y[use], w[use], margin[use])
            total += histograms(bins[use][:, features], place[use], g, h, len(nodes), width).astype(np.int64)  # whole numbers, exact
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(features)), pa.int32()), pa.array([total[:, :, j].tobytes() for j in range(len(features))], pa.binary())],
                                         ["f", "sums"])

    def best(key: tuple, group: pa.Table) -> pa.Table:
        sums = np.zeros((3, len(nodes), width), dtype=np.int64)
        for part in group.column("sums"):
            sums += np.frombuffer(part.as_py(), dtype=np.int64).reshape(sums.shape)
        found = best_splits(sums.astype(np.float64)[:, :, None, :], p)
        return pa.table({"node": pa.array(nodes, pa.int32()), "f": pa.array([key[0].as_py()] * len(nodes), pa.int32()), "cut": pa.array(found["bin"][:, 0], pa.int32()),
                         "missing_left": pa.array(found["missing_left"][:, 0]), "gain": pa.array(found["gain"][:, 0]),
                         "lhs": found["left"][:, :, 0].T.tolist(), "whole": found["total"][:, :, 0].T.tolist()})

    partial = data.mapInArrow(task, "f int, sums binary")
    rows = partial.groupBy("f").applyInArrow(best, "node int, f int, cut int, missing_left boolean, gain double, lhs array<double>, whole array<double>").collect()
    chosen: dict[int, dict] = {}
    for r in sorted(rows, key=lambda r: (r["node"], -r["gain"], r["f"])):
        chosen.setdefault(r["node"], r.asDict())
    return chosen


def _finish(data: DataFrame, pending: list[Tree], tree: Tree, number: int, nodes: dict[int, int], features: np.ndarray, p: BoostParams) -> None:
    """Grow the rest under each of ``nodes`` (node: levels left), one task a node."""
    here = np.zeros(len(tree.feature), dtype=bool)
    here[list(nodes)] = True

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, y, w, bins, margin = _rows(batch, pending)
            at = tree.places(bins)
            use = np.flatnonzero(here[at] & drawn_rows(row, number, p))
            g, h = gradients(y[use], w[use], margin[use])
            yield pa.RecordBatch.from_arrays([pa.array(at[use], pa.int32()), pa.array([bins[i].tobytes() for i in use], pa.binary()), pa.array(g), pa.array(h)],
                                             ["place", "bins", "g", "h"])

    def subtree(key: tuple, group: pa.Table) -> pa.Table:
        top = key[0].as_py()
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), dtype=np.uint8).reshape(group.num_rows, -1)
        mine = Tree.blank(p.depth)
        grow(mine, top, nodes[top], bins, group.column("g").to_numpy(), group.column("h").to_numpy(), features, p)

        def below(t: Tree) -> np.ndarray:
            inside, todo = [], [top]
            while todo:
                i = todo.pop()
                inside.append(i)
                todo += [2 * i + 1, 2 * i + 2] if t.feature[i] >= 0 else []
            return np.array(inside)

        return _node_rows([mine], number, below)

    _write_nodes(tree, data.mapInArrow(route, "place int, bins binary, g double, h double").groupBy("place").applyInArrow(subtree, _NODE).collect())


def _one_tree(data: DataFrame, pending: list[Tree], number: int, n: int, n_features: int, width: int, p: BoostParams) -> Tree:
    tree, features = Tree.blank(p.depth), drawn_features(n_features, number, p)
    open_nodes, small = {0: n}, {}
    for depth in range(p.depth):
        small |= {i: p.depth - depth for i, rows in open_nodes.items() if rows <= p.node_rows}
        large = [i for i, rows in open_nodes.items() if rows > p.node_rows]
        if not large:
            open_nodes = {}
            break
        open_nodes = {}
        for node, r in _level(data, pending, tree, number, large, depth, features, width, p).items():
            left, whole = np.array(r["lhs"]), np.array(r["whole"])
            tree.g[node], tree.h[node] = whole[0] / UNIT, whole[1] / UNIT
            if r["gain"] > SMALLEST_GAIN:
                record_splits(tree, np.array([node]), features[r["f"]], r["cut"], r["missing_left"], r["gain"], left, whole)
                open_nodes |= {2 * node + 1: left[2], 2 * node + 2: whole[2] - left[2]}
    if small:
        _finish(data, pending, tree, number, small, features, p)
    return tree.settle(p)


def _block_in_memory(data: DataFrame, first: int, count: int, p: BoostParams) -> list[Tree]:
    """``count`` trees over a table that is one small node."""
    def boost(group: pa.Table) -> pa.Table:
        row, y, w, bins, margin = _rows(group.combine_chunks(), [])
        return _node_rows(boost_rows(row, y, w, bins, margin, first, count, p), first)

    trees = [Tree.blank(p.depth) for _ in range(count)]
    rows = data.groupBy().applyInArrow(boost, _NODE).collect()
    for t in range(count):
        _write_nodes(trees[t], [r for r in rows if r["tree"] == first + t])
    return trees


def _with_margins(data: DataFrame, pending: list[Tree]) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(_rows(batch, pending)[4]))

    return materialize(data.mapInArrow(add, data.schema), "margins")


def boost(df: DataFrame, features: list[str], label: str, weight: str | None, row_id: str, p: BoostParams) -> tuple[list[list[float]], list[Tree]]:
    """Fit: the cut points of each feature and the trees."""
    df = df.filter(F.col(label).isNotNull())
    edges = bin_edges(df, features, p.max_bins)
    width = max([len(e) + 2 for e in edges], default=2)  # one bin more than cuts, and the missing values
    return edges, boost_binned(materialize(binned(df, features, edges, label, weight, row_id), "binned"), len(features), width, p)


def boost_binned(data: DataFrame, n_features: int, width: int, p: BoostParams) -> list[Tree]:
    """The trees of a written table of :func:`binned` rows; ``width`` is the most bins of a feature, missing values included."""
    n = data.count()
    trees: list[Tree] = []
    at_once = p.block if n <= p.node_rows else min(p.block, p.level_block)
    while n and n_features and len(trees) < p.trees:
        first, count = len(trees), min(at_once, p.trees - len(trees))
        if n <= p.node_rows:
            trees += _block_in_memory(data, first, count, p)
        else:
            for t in range(first, first + count):
                trees.append(_one_tree(data, trees[first:], t, n, n_features, width, p))
        if len(trees) < p.trees:
            data = _with_margins(data, trees[first:])
    return trees


# ---- estimator and model --------------------------------------------------

class _TreeParams(HasInputCols, HasLabelCol, HasWeightCol):
    settings = Param(Params._dummy(), "settings", "learner settings as JSON", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "probability of the positive class", typeConverter=TypeConverters.toString)
    rowCol = Param(Params._dummy(), "rowCol", "row id, for the draws", typeConverter=TypeConverters.toString)


class RegularisedTrees(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """E1/E2 learner. ``settings`` are the fields of :class:`BoostParams` as JSON."""

    @keyword_only
    def __init__(self, inputCols=None, labelCol="label", weightCol=None, rowCol=None, outputCol="ato_probability", settings="{}"):
        super().__init__()
        self._setDefault(labelCol="label", outputCol="ato_probability", settings="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def params_of(self) -> BoostParams:
        return BoostParams(**json.loads(self.getOrDefault(self.settings)))

    def _fit(self, dataset: DataFrame) -> "RegularisedTreesModel":
        weight = self.getOrDefault(self.weightCol) if self.isSet(self.weightCol) else None
        row = self.getOrDefault(self.rowCol)
        edges, trees = boost(dataset, self.getInputCols(), self.getLabelCol(), weight, row, self.params_of())
        return RegularisedTreesModel(inputCols=self.getInputCols(), outputCol=self.getOrDefault(self.outputCol), settings=self.getOrDefault(self.settings),
                                     trees=json.dumps(packed(edges, trees)))


def packed(edges: list[list[float]], trees: list[Tree]) -> dict:
    """Cut points and reached nodes, in a form that JSON keeps exactly."""
    out = []
    for t in trees:
        at = _reached(t)
        out.append({"depth": int(len(t.feature)).bit_length() - 1, "node": at.tolist(),
                    **{k: getattr(t, k)[at].tolist() for k in ("feature", "bin", "missing_left", "gain", "h", "value")}})
    return {"edges": edges, "trees": out}


def unpacked(blob: dict) -> tuple[list[list[float]], list[Tree]]:
    trees = []
    for r in blob["trees"]:
        t = Tree.blank(r["depth"])
        for k in ("feature", "bin", "missing_left", "gain", "h", "value"):
            getattr(t, k)[r["node"]] = r[k]
        trees.append(t)
    return blob["edges"], trees


class RegularisedTreesModel(Model, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    trees = Param(Params._dummy(), "trees", "cut points and trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCol="ato_probability", settings="{}", trees=None):
        super().__init__()
        self._setDefault(outputCol="ato_probability", settings="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fitted(self) -> tuple[list[list[float]], list[Tree]]:
        return unpacked(json.loads(self.getOrDefault(self.trees)))

    def nodes(self, spark) -> DataFrame:
        """tree, node, feature (name), threshold (left if value <= it), missing_left, gain, hessian, value: one row per node."""
        edges, trees = self.fitted()
        names = self.getInputCols()
        cut = lambda f, b: None if f < 0 else edges[f][b] if b < len(edges[f]) else float("inf")
        rows = [(t, int(i), names[tree.feature[i]] if tree.feature[i] >= 0 else None, cut(tree.feature[i], tree.bin[i]),
                 bool(tree.missing_left[i]), float(tree.gain[i]) if tree.feature[i] >= 0 else None, float(tree.h[i]), float(tree.value[i]))
                for t, tree in enumerate(trees) for i in _reached(tree)]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing_left boolean, gain double, hessian double, value double")

    def importance(self) -> dict[str, float]:
        """Share of the total gain per feature."""
        edges, trees = self.fitted()
        total = np.zeros(len(edges))
        for t in trees:
            at = _reached(t)
            at = at[t.feature[at] >= 0]
            np.add.at(total, t.feature[at], t.gain[at])
        return dict(zip(self.getInputCols(), (total / max(total.sum(), 1e-300)).tolist(), strict=True))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, trees = self.fitted()
        features, out = self.getInputCols(), self.getOrDefault(self.outputCol)
        names = [f"_v{i}" for i in range(len(features))]
        wide = dataset.select("*", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names, strict=True)])
        kept = [f for f in dataset.schema.fields if f.name != out]
        schema = replace_schema(kept, out)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = to_bins(_matrix(batch, names), edges)
                margin = np.zeros(len(bins))
                for tree in trees:
                    margin += tree.margins(bins)
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(1.0 / (1.0 + np.exp(-margin)))], [*[f.name for f in kept], out])

        return wide.mapInArrow(score, schema)


def replace_schema(kept: list, out: str):
    from pyspark.sql.types import DoubleType, StructField, StructType
    return StructType([*kept, StructField(out, DoubleType(), True)])


def settings_json(**changes) -> str:
    """Settings for :class:`RegularisedTrees`: the reference's, but for ``changes``."""
    return json.dumps(asdict(replace(BoostParams(), **changes)))


#: Names of the nine tuned settings.
TUNED = [f.name for f in fields(BoostParams)][:9]
