"""Operator 13: embedding whitening with weighted multiplicities.

Embeddings repeat, often in large groups of copies. Vectors are put on a grid
of whole numbers, identical ones are grouped, and everything after works on the
distinct vectors: sums, a covariance centred before it is multiplied and
weighted by the counts (or by one), and one whitening each. The rows then
fetch the result of their vector.

* Whole numbers make equality, counts, sums and deviations exact; a product
  that a 64-bit integer cannot hold is taken with Python's integers.
* Every pass over the distinct vectors leaves one d x d partial a task (d = the
  vectors' length), added up per matrix row. The driver sees d x d numbers and
  solves one eigenproblem; no vector goes there.
* A hot vector is combined before the shuffle when it is counted, and the
  join back is many to one, which adaptive execution can split.

Defined cases: rows whose vector is null or holds a null or non-finite entry are
dropped, and so are entries beyond the grid (magnitude 2**56 and more); of
vectors of different lengths only those of the most common one are a table
(ties: the longer); a deviation beyond a 64-bit integer is null; a component
without variance (a table of equal vectors, fewer rows than dimensions) has
null ``whitened`` and explains 0; null and repeated ids are carried as they are;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.session import materialize

#: Entries are smaller than this, so that a grid value is a 64-bit integer.
LARGEST_ENTRY = float(1 << 56)
_SAFE = 1 << 62


def grid_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + offset of each row whose vector is whole."""
    vector = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(scale / 64)) < LARGEST_ENTRY))
    return vector.filter(F.col("v").isNotNull() & whole).select(
        "vec_id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset).cast("long")).alias("x"))


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def _scaled_deviations(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
    if n * _largest(x) + max(map(abs, sums)) < _SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n with the rounding of one division."""
    return (_scaled_deviations(x, sums, n) / n).astype(np.float64)


def _squared_lengths(deviations: np.ndarray) -> list[int | None]:
    if deviations.dtype != object and deviations.shape[1] * _largest(deviations) ** 2 < _SAFE:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = ((deviations.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact_sums(distinct: DataFrame, d: int) -> list[int]:
    """Weighted sums of the entries, one per dimension."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            x, m = _matrix(batch, "x", d), batch.column("weight").to_numpy()
            if _largest(x) * int(m.sum(dtype=object) or 0) >= _SAFE:
                x, m = x.astype(object), m.astype(object)
            total = [a + int(b) for a, b in zip(total, m @ x, strict=True)] if len(m) else total
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["i", "s"])

    rows = distinct.select("x", "weight").mapInArrow(summed, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows, key=lambda r: r["i"])]


def _summed_rows(df: DataFrame, width: int, partial: Callable[[pa.RecordBatch], np.ndarray], rows: int) -> np.ndarray:
    """The sum over all batches of a (rows, width) matrix of doubles: one
    partial a task, added up per matrix row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            total += partial(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    def added(key: tuple, group: pa.Table) -> pa.Table:
        values = group.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, width)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([values.sum(axis=0)], pa.list_(pa.float64()))})

    found = df.mapInArrow(task, "i int, sums array<double>").groupBy("i").applyInArrow(added, "i int, sums array<double>").collect()
    return np.array([r["sums"] for r in sorted(found, key=lambda r: r["i"])]).reshape(-1, width)


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with sums S, eigenvalues falling, one component a column."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.values)

    @property
    def varies(self) -> np.ndarray:
        """Components whose variance is above the rounding of the matrix."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; not a number where a component has no variance."""
        scale = np.where(self.varies, np.sqrt(np.abs(self.values)), np.nan)
        return _centred(x, self.sums, self.n) @ self.vectors / scale

    def explained(self) -> list[float]:
        return [float(v / self.trace) if ok and self.trace > 0 else 0.0 for v, ok in zip(self.values, self.varies, strict=True)]


def fit(distinct: DataFrame, n: int, d: int, components: int = 32) -> Whitening:
    """Of ``distinct(x, weight)``, vectors of length d whose weights add up to n."""
    sums = _exact_sums(distinct, d)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = _centred(_matrix(batch, "x", d), sums, n)
        return z.T @ (z * batch.column("weight").to_numpy()[:, None])

    covariance = _summed_rows(distinct.select("x", "weight"), d, products, d) / n
    covariance = (covariance + covariance.T) / 2
    values, vectors = np.linalg.eigh(covariance)
    keep = min(components, d)
    return Whitening(n, sums, values[::-1][:keep].copy(), vectors[:, ::-1][:, :keep].copy(), float(np.trace(covariance)))


def identity_error(white: DataFrame, n: int, varies: np.ndarray) -> float | None:
    """Largest absolute entry of the covariance of ``white(w, weight)`` minus
    the identity, over the components with variance."""
    width, used = len(varies), int(varies.sum())
    if not used:
        return None

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return _matrix(batch, "w", width)[:, varies].astype(np.float64), batch.column("weight").to_numpy()

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        w, weight = rows(batch)
        return (weight @ w)[None, :]

    mean = _summed_rows(white, used, sums, 1)[0] / n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w, weight = rows(batch)
        return (w - mean).T @ ((w - mean) * weight[:, None])

    return float(np.abs(_summed_rows(white, used, products, used) / n - np.eye(used)).max())


def _whitened(distinct: DataFrame, model: Whitening) -> DataFrame:
    """(x, weight, deviation, w): each distinct vector once."""
    d = len(model.sums)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x", d)
            w = pa.array(model.project(x).ravel(), pa.float64(), from_pandas=True)  # not a number becomes null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * model.width), w)
            deviation = pa.array(_squared_lengths(_scaled_deviations(x, model.sums, model.n)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("weight"), deviation, lists], ["x", "weight", "deviation", "w"])

    return distinct.select("x", "weight").mapInArrow(task, "x array<long>, weight long, deviation long, w array<double>")


def _by_vector(x: Column) -> list[Column]:
    return [F.xxhash64(x).alias("h"), x.alias("x")]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32, by_count: bool = True,
           scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, n, deviation, whitened array<double>, explained array<double>,
    identity_error: one row per row with a whole vector. ``by_count`` weighs each
    distinct vector by its number of rows (the fit list is all rows), else by one."""
    rows = grid_vectors(df, id_col, vec_col, scale, offset)
    weight = F.count(F.lit(1)) if by_count else F.lit(1).cast("long")
    # the vector rides along with its hash, so that the grouping compares one number first
    distinct = materialize(rows.groupBy(*_by_vector(F.col("x"))).agg(weight.alias("weight"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).agg(F.sum("copies").alias("rows"), F.sum("weight").alias("n"))
    common = sizes.filter("d > 0").orderBy(F.desc("rows"), F.desc("d")).first()
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if common is None:
        return df.sparkSession.createDataFrame([], schema)
    d, n = common["d"], common["n"]
    distinct = distinct.filter(F.size("x") == d)
    model = fit(distinct, n, d, components)
    white = materialize(_whitened(distinct, model), "whitened")
    error = identity_error(white.select("w", "weight"), n, model.varies)
    own = rows.select("vec_id", *_by_vector(F.col("x")))
    made = white.select(*_by_vector(F.col("x")), "deviation", "w")
    return own.join(made, ["h", "x"]).select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
        F.array(*map(F.lit, model.explained())).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op13_multiplicity_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, up to 32 components, one row per vector and component."""
    made = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = made.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened",
                       F.element_at("explained", F.col("i") + 1).alias("explained"), "identity_error")
