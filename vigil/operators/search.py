"""Adaptive search for learner settings.

A tree-structured Parzen estimator: after some random trials the settings seen
so far are divided into the best few and the rest, each parameter gets a density
of either kind (a mixture of normals around the seen values, cut off at the
bounds, with one wide component for the prior), candidates are drawn from the
good density and the one with the largest ratio good / bad is tried.

Trials are proposed in batches from one state. The (trial, fold) fits of a batch
are independent and use every labelled row. While there are at most ``held_rows`` of
them (a binned row is a byte per feature) they are broadcast and each fit is a Spark
task; beyond that each fit is distributed, as the learner's own (the same trees either
way). The mean over the folds of the exact AUC decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import boosting as B
from vigil.session import materialize

# --- FIXED VALUES: search space of the hyper-parameter search (low, high), in
# the reference's order; whole bounds mean whole numbers.
SEARCH_SPACE = {
    "trees": (100, 500),
    "depth": (3, 10),
    "rate": (0.01, 0.3),
    "subsample": (0.6, 0.95),
    "colsample": (0.6, 0.95),
    "min_child": (1, 10),
    "gamma": (0.0, 0.5),
    "l1": (0.0, 1.0),
    "l2": (0.5, 2.5),
}
#: Labelled rows that are broadcast, at most (about 55 bytes each at 29 features); of more rows each fit is distributed.
HELD_ROWS = 1_000_000


@dataclass(frozen=True)
class Parzen:
    """A density over one bounded parameter."""
    low: float
    high: float
    centres: np.ndarray
    widths: np.ndarray

    @classmethod
    def of(cls, values: list[float], low: float, high: float, whole: bool) -> "Parzen":
        """One normal per value, as wide as the farther of its two neighbours
        is away (between a share of the range and the range), and the prior: a
        normal at the middle as wide as the range."""
        low, high = (low - 0.5, high + 0.5) if whole else (low, high)
        span = high - low
        centres = np.array([*values, (low + high) / 2])
        order = np.argsort(centres, kind="stable")
        placed = np.concatenate([[low], centres[order], [high]])
        widths = np.empty(len(centres))
        widths[order] = np.maximum(placed[1:-1] - placed[:-2], placed[2:] - placed[1:-1])
        widths = np.clip(widths, span / min(100.0, 1.0 + len(centres)), span)
        widths[-1] = span
        return cls(low, high, centres, widths)

    def _inside(self) -> np.ndarray:
        """Share of each normal that lies within the bounds."""
        return _below((self.high - self.centres) / self.widths) - _below((self.low - self.centres) / self.widths)

    def density(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, dtype=float)[:, None] - self.centres) / self.widths
        return (np.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * self.widths * self._inside())).mean(axis=1)

    def mass(self, x: np.ndarray) -> np.ndarray:
        """Of the unit interval around whole numbers."""
        x = np.asarray(x, dtype=float)[:, None]
        return ((_below((x + 0.5 - self.centres) / self.widths) - _below((x - 0.5 - self.centres) / self.widths)) / self._inside()).mean(axis=1)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        """Values within the bounds, by rejection inside each chosen component."""
        which = rng.integers(len(self.centres), size=n)
        out = rng.normal(self.centres[which], self.widths[which])
        while (bad := (out < self.low) | (out > self.high)).any():
            out[bad] = rng.normal(self.centres[which[bad]], self.widths[which[bad]])
        return out


def _below(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf, otypes=[float])(np.asarray(z) / math.sqrt(2.0)))


def is_whole(bounds: tuple) -> bool:
    return all(isinstance(b, int) for b in bounds)


def random_settings(space: dict, rng: np.random.Generator) -> dict:
    return {k: int(rng.integers(b[0], b[1] + 1)) if is_whole(b) else float(rng.uniform(*b)) for k, b in space.items()}


def divide(history: list[tuple[dict, float]]) -> tuple[list[dict], list[dict]]:
    """The best tenth (at least one, at most 25) and the rest; ties to the earlier trial."""
    order = sorted(range(len(history)), key=lambda i: (-history[i][1], i))
    n = min(max(1, math.ceil(0.1 * len(history))), 25)
    return [history[i][0] for i in order[:n]], [history[i][0] for i in sorted(order[n:])]


def propose(history: list[tuple[dict, float]], space: dict, rng: np.random.Generator, startup: int = 10, candidates: int = 24) -> dict:
    """The next settings to try, each parameter on its own."""
    if len(history) < startup:
        return random_settings(space, rng)
    good, bad = divide(history)
    out = {}
    for name, bounds in space.items():
        whole = is_whole(bounds)
        best, rest = (Parzen.of([s[name] for s in part], *bounds, whole) for part in (good, bad))
        x = best.draw(rng, candidates)
        if whole:
            x = np.clip(np.rint(x), *bounds)
            ratio = np.log(best.mass(x)) - np.log(rest.mass(x))
        else:
            ratio = np.log(best.density(x)) - np.log(rest.density(x))
        at = int(np.argmax(ratio))
        out[name] = int(x[at]) if whole else float(x[at])
    return out


def exact_auc(y: np.ndarray, score: np.ndarray) -> float:
    """Share of (positive, negative) pairs in order, ties one half; one half without both classes."""
    pos = int(y.sum())
    neg = len(y) - pos
    if not pos or not neg:
        return 0.5
    _, at, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2.0)[at]
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2.0) / (pos * neg))


def sample_rows(df: DataFrame, row_id: str, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` rows by a hash of the id (all, if there are no more), for a caller
    that wants a quicker search over fewer rows; :func:`search` itself uses all it is given."""
    n = df.count()
    if n <= max_rows:
        return df
    share = int(max_rows / n * (1 << 20))
    return df.filter(F.pmod(F.xxhash64(F.lit("search"), F.col(row_id)), F.lit(1 << 20)) < share)


def dealt(spark: SparkSession, fits: list[tuple], types: str, settings: B.BoostParams) -> DataFrame:
    """(trial, fold, settings) of each fit in a partition of its own, the longest fits first: tasks start in the
    partitions' order, so no long fit begins when the others are done or waits behind another."""
    names = [t.split()[0] for t in types.split(", ")]

    def length(fit: tuple) -> int:
        p = replace(settings, **dict(zip(names, fit[2:], strict=True)))
        return p.trees * p.depth

    fits = sorted(fits, key=length, reverse=True)
    return spark.createDataFrame(spark.sparkContext.parallelize(fits, len(fits)), f"trial int, fold int, {types}")


def _held_fits(cut: DataFrame, features: int, space: dict, types: str, settings: B.BoostParams):
    """AUC per (trial, fold) of a batch of settings: the rows are broadcast, each fit is a task."""
    spark = cut.sparkSession
    held = cut.toArrow()  # held_rows bounds it
    bins = np.frombuffer(b"".join(held.column("bins").to_pylist()), dtype=np.uint8).reshape(held.num_rows, features + 1)
    order = np.argsort(held.column("row").to_numpy(), kind="stable")
    rows = spark.sparkContext.broadcast((*(held.column(c).to_numpy()[order] for c in ("row", "y", "w")), bins[order]))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, y, w, all_bins = rows.value
        bins, of = all_bins[:, :-1], all_bins[:, -1]
        for b in batches:
            for r in b.to_pylist():
                p = replace(settings, **{k: r[k] for k in space})
                use = of != r["fold"]
                trees = B.boost_rows(row[use], y[use], w[use], bins[use], np.zeros(int(use.sum())), 0, p.trees, p)
                margin = sum((t.margins(bins[~use]) for t in trees), np.zeros(int((~use).sum())))
                yield pa.RecordBatch.from_arrays([pa.array([r["trial"]], pa.int32()), pa.array([r["fold"]], pa.int32()), pa.array([exact_auc(y[~use], margin)])],
                                                 ["trial", "fold", "auc"])

    def of_batch(work: list[tuple]) -> dict[tuple[int, int], float]:
        fits = dealt(spark, work, types, settings).mapInArrow(fit, "trial int, fold int, auc double")
        return {(r["trial"], r["fold"]): r["auc"] for r in fits.collect()}

    return of_batch


def _spread_fits(cut: DataFrame, features: int, width: int, space: dict, settings: B.BoostParams):
    """The same for rows beyond what is broadcast: each fit takes the learner's passes over all rows of the other folds."""
    fold_bin = F.conv(F.hex(F.expr(f"substring(bins, {features + 1}, 1)")), 16, 10).cast("int")
    parts = materialize(cut.select("row", "y", "w", F.expr(f"substring(bins, 1, {features})").alias("bins"), "margin", fold_bin.alias("fold")), "folds-binned")

    def one(fold: int, p: B.BoostParams) -> float:
        trees = B.boost_binned(parts.filter(F.col("fold") != fold).drop("fold"), features, width, p)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, y, _, _, margin = B._rows(b, trees)
                yield pa.RecordBatch.from_arrays([pa.array(margin), pa.array(y)], ["margin", "y"])

        return spread_auc(parts.filter(F.col("fold") == fold).mapInArrow(score, "margin double, y double"))

    return lambda work: {(trial, fold): one(fold, replace(settings, **dict(zip(space, values, strict=True)))) for trial, fold, *values in work}


def spread_auc(scored: DataFrame) -> float:
    """:func:`exact_auc` of (margin, y): rows meet per score, ordered ranges of scores are added up on their own
    and placed by the negatives of the ranges before."""
    per = scored.groupBy("margin").agg(F.sum("y").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, pos, neg, pairs = None, 0, 0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            margin, p, n = (b.column(c).to_numpy() for c in ("margin", "pos", "n"))
            q = n - p
            pairs += float((p * (neg + np.cumsum(q) - q / 2.0)).sum())  # of equal scores one half
            low, pos, neg = (float(margin[0]) if low is None else low), pos + int(p.sum()), neg + int(q.sum())
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (low, pos, neg, pairs)], ["low", "pos", "neg", "pairs"])

    ranges = per.repartitionByRange("margin").sortWithinPartitions("margin").mapInArrow(add, "low double, pos long, neg long, pairs double").collect()
    pairs, pos, neg = 0.0, 0, 0
    for r in sorted(ranges, key=lambda r: r["low"]):  # one row a task
        pairs, pos, neg = pairs + r["pairs"] + r["pos"] * neg, pos + r["pos"], neg + r["neg"]
    return pairs / (pos * neg) if pos and neg else 0.5


def search(train: DataFrame, features: list[str], label: str, fold: str, row_id: str, trials: int = 30, folds: int = 5, batch: int = 5,
           weight: str | None = None, seed: int = 42, space: dict | None = None, settings: B.BoostParams | None = None,
           held_rows: int = HELD_ROWS) -> DataFrame:
    """(trial, batch, settings as columns, mean_auc), one row per trial; the best is the first by mean_auc, then trial."""
    space, settings = space or SEARCH_SPACE, settings or B.BoostParams(seed=seed)
    spark = train.sparkSession
    rows = train.filter(F.col(label).isNotNull())
    edges = B.bin_edges(rows, features, settings.max_bins)
    width = max([len(e) + 2 for e in edges], default=2)
    cut = B.binned(rows.withColumn("_fold", F.col(fold).cast("double")), [*features, "_fold"], [*edges, [i + 0.5 for i in range(folds - 1)]], label, weight, row_id)
    types = ", ".join(f"{k} {'int' if is_whole(b) else 'double'}" for k, b in space.items())
    small = rows.count() <= held_rows
    fits = _held_fits(cut, len(features), space, types, settings) if small else _spread_fits(cut, len(features), width, space, settings)

    history: list[tuple[dict, float]] = []
    rng = np.random.default_rng(seed)
    while len(history) < trials:
        tried = [propose(history, space, rng) for _ in range(min(batch, trials - len(history)))]
        auc = fits([(i, f, *s.values()) for i, s in enumerate(tried) for f in range(folds)])
        history += [(s, math.fsum(auc[i, f] for f in range(folds)) / folds) for i, s in enumerate(tried)]
    return spark.createDataFrame([(i, i // batch, *s.values(), a) for i, (s, a) in enumerate(history)], f"trial int, batch int, {types}, mean_auc double")
