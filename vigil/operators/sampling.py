"""Sampling, splitting, balancing and perturbation (survey 2.3).

Randomness is md5 of 'seed:id' so Spark, DuckDB and a re-run agree.
Exact per-class counts come from :func:`hash_rank` (bucketed, no window
over a whole class).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import hash_uniform
from vigil.functions.ordering import dense_index, hash_rank
from vigil.session import materialize


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_class"))


def _with_class_size(ranked: DataFrame, df: DataFrame, label: str) -> DataFrame:
    """Joins ``_n_class``; null is a class like any other."""
    n = class_sizes(df, label).withColumnRenamed(label, "_class")
    return ranked.join(n, F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """``is_test`` is true for the ceil(frac·n_c) rows with the smallest
    draw in each class c; the rest is train."""
    r = hash_rank(df, [label], id_col, f"split{seed}", "_r")
    j = _with_class_size(r, df, label)
    return j.withColumn("is_test", F.col("_r") < F.ceil(F.col("_n_class") * F.lit(test_frac))).drop("_r", "_n_class")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = rank in class mod k (class shares equal in every fold)."""
    r = hash_rank(df, [label], id_col, f"fold{seed}", "_r")
    return r.withColumn("fold", (F.col("_r") % k).cast("int")).drop("_r")


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """int(negatives / max(positives, 1))."""
    a = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    return a.select("neg", "pos", F.floor(F.col("neg") / F.greatest(F.col("pos"), F.lit(1))).cast("bigint")
                    .alias("scale_pos_weight"))


def smote_plan(df: DataFrame, label: str, ratio: float = 1.0, k: int = 5, minority_value=1) -> DataFrame:
    """C4: new rows = int(ratio · majority) − minority; k = min(k, minority − 1);
    skipped when the minority has < 2 rows or nothing is to be made."""
    a = df.agg(F.count_if(F.col(label) == minority_value).alias("minority"),
               F.count_if(F.col(label) != minority_value).alias("majority"))
    new = (F.floor(F.col("majority") * F.lit(ratio)) - F.col("minority")).cast("bigint")
    kk = F.least(F.lit(k), F.col("minority") - 1).cast("int")
    run = (F.col("minority") >= 2) & (new > 0)
    return a.select("minority", "majority", F.when(run, new).otherwise(F.lit(0)).cast("bigint").alias("n_new"),
                    F.when(run, kk).otherwise(F.lit(0)).alias("k"), run.alias("run"))


def _knn_block(k: int, id_col: str, vec_col: str):
    """Distances between one query block and one reference block (numpy,
    fixed summation order over dimensions); the k best per query point."""
    def fn(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(r) == 0:
            return pd.DataFrame({"id": pd.Series([], dtype="int64"), "neighbor_id": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="float64")})
        x = np.stack(q[vec_col].to_numpy()).astype(np.float64)
        y = np.stack(r[vec_col].to_numpy()).astype(np.float64)
        qid, rid = q[id_col].to_numpy(), r[id_col].to_numpy()
        d2 = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            d2 += (x[:, [j]] - y[None, :, j]) ** 2
        d2[qid[:, None] == rid[None, :]] = np.inf  # never your own neighbour
        kk = min(k, len(y))
        ids, nbs, dist = [], [], []
        for i in range(len(x)):
            for c in np.lexsort((rid, d2[i]))[:kk]:  # by distance, then id
                if np.isfinite(d2[i, c]):
                    ids.append(int(qid[i]))
                    nbs.append(int(rid[c]))
                    dist.append(float(np.sqrt(d2[i, c])))
        return pd.DataFrame({"id": np.asarray(ids, dtype=np.int64), "neighbor_id": np.asarray(nbs, dtype=np.int64),
                             "distance": np.asarray(dist, dtype=np.float64)})
    return fn


def knn(points: DataFrame, id_col: str, vec_col: str, k: int = 5, chunk_rows: int = 2000, queries: DataFrame | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, ties by id) of every point
    (or of the points ``queries``) among the same set, fully distributed.
    Points are hashed into B = ⌈n / chunk_rows⌉ blocks; every (query block,
    reference block) pair is one cogroup of two bounded blocks, whose
    Arrow-batched numpy kernel emits only the k best per query point; the
    per-point top k over the pairs is a grouped aggregate of k·B rows.  A
    worker holds three chunk_rows² matrices of doubles (96 MB at 2,000).  For
    all points this is quadratic in n by nature; it spreads evenly and never
    gathers the set, and :func:`knn_lsh` is the form for sets where that is
    too much."""
    # the points are read B times: write them once (shared folder) and
    # start from that table, which also gives a lineage-free input
    pts = materialize(points.select(id_col, vec_col), "knn-points")
    asked = pts if queries is None else materialize(queries.select(id_col, vec_col), "knn-queries")
    blocks = lambda df: max(1, -(-df.count() // chunk_rows))
    n_q, n_r = blocks(asked), blocks(pts)
    own = lambda n: (F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint") % n)
    others = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = asked.select(own(n_q).alias("_qb"), others(n_r).alias("_rb"), id_col, vec_col)
    r = pts.select(others(n_q).alias("_qb"), own(n_r).alias("_rb"), id_col, vec_col)
    cand = (q.groupBy("_qb", "_rb").cogroup(r.groupBy("_qb", "_rb"))
            .applyInPandas(_knn_block(k, id_col, vec_col), _NEIGHBOURS))
    return _nearest(cand, k)


_NEIGHBOURS = "id long, neighbor_id long, distance double"


def _nearest(cand: DataFrame, k: int) -> DataFrame:
    """The k best of each point's candidates (id, neighbor_id, distance), ranked."""
    best = cand.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbor_id"))), 1, k).alias("nn"))
    return best.select("id", F.posexplode("nn").alias("pos", "x")).select(
        "id", F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"),
        (F.col("pos") + 1).cast("int").alias("rank"))


@dataclass(frozen=True)
class LshPlan:
    """Projections of an LSH index and what its sample says of them."""
    normals: np.ndarray   # (tables, hashes, dimensions)
    offsets: np.ndarray   # (tables, hashes), in bucket widths
    width: float
    recall: float
    share: float

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(points, tables): a bucket number of each table."""
        cells = np.floor(np.einsum("nd,thd->nth", x, self.normals) / self.width + self.offsets).astype(np.int64)
        key = np.zeros(cells.shape[:2], dtype=np.uint64)
        for h in range(cells.shape[2]):
            key = (key ^ cells[:, :, h].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def lsh_plan(points: DataFrame, id_col: str, vec_col: str, k: int = 5, recall: float = 0.95, tables: int = 12, sample: int = 200,
             seed: int = 42) -> LshPlan | None:
    """Bucket width and number of hashes from a sample: at most about ``sample``
    points (by a hash of the id) get their exact neighbours among all, the width
    is tried in multiples of the median distance to the k-th of them, and of the
    settings that let at least ``recall`` of those neighbours meet the one under
    which the fewest of the sample's pairs meet is taken. None if there are no
    points; if no setting is good enough, one bucket holds all."""
    n = points.count()
    if n < 2:
        return None
    some = points.filter(F.pmod(F.xxhash64(F.lit(f"lsh{seed}"), F.col(id_col)), F.lit(1 << 20)) <= int(min(1.0, sample / n) * (1 << 20)))
    truth = knn(points, id_col, vec_col, k, queries=some)
    ids = some.select(F.col(id_col).alias("id")).unionByName(truth.select(F.col("neighbor_id").alias("id"))).distinct()
    held = points.join(ids, points[id_col] == ids["id"], "left_semi").select(id_col, vec_col).collect()  # at most sample * (k + 1)
    at = {r[id_col]: i for i, r in enumerate(held)}
    x = np.array([r[vec_col] for r in held], dtype=np.float64)
    rows = truth.collect()
    if not rows:
        return None
    pairs = np.array([(at[r["id"]], at[r["neighbor_id"]]) for r in rows])
    reach = float(np.median([r["distance"] for r in rows if r["rank"] == max(x["rank"] for x in rows)])) or 1.0
    asked = np.unique(pairs[:, 0])
    rng = np.random.default_rng(seed)
    normals, offsets = rng.normal(size=(tables, 8, x.shape[1])), rng.random((tables, 8))
    best = None
    for hashes in range(1, 9):
        for times in (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0):
            plan = LshPlan(normals[:, :hashes], offsets[:, :hashes], reach * times, 0.0, 0.0)
            key = plan.keys(x)
            met = float((key[pairs[:, 0]] == key[pairs[:, 1]]).any(axis=1).mean())
            share = float(np.mean([(key[i] == key[asked]).any(axis=1).mean() for i in asked]))
            if met >= recall and (best is None or share < best.share):
                best = replace(plan, recall=met, share=share)
    return best or LshPlan(normals[:, :1] * 0.0, offsets[:, :1] * 0.0, 1.0, 1.0, 1.0)


def knn_lsh(points: DataFrame, id_col: str, vec_col: str, k: int = 5, recall: float = 0.95, tables: int = 12, chunk_rows: int = 2000,
            seed: int = 42) -> DataFrame:
    """C5 at size, approximate: candidates share a bucket of at least one of
    ``tables`` tables, each keyed by several random projections (:func:`lsh_plan`
    chooses how many and how wide); the k nearest candidates by exact distance
    stay. A bucket is compared in blocks of ``chunk_rows``, so a crowded one is many
    bounded tasks. A point with fewer than k candidates is answered exactly."""
    pts = materialize(points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "lsh-points")
    plan = lsh_plan(pts, "id", "v", k, recall, tables, seed=seed)
    if plan is None:
        return knn(pts, "id", "v", k, chunk_rows)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("v").to_pylist(), dtype=np.float64)
            if len(x):
                key = plan.keys(x)
                t = key.shape[1]
                take = pa.array(np.repeat(np.arange(len(x)), t))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take),
                                                  pa.array(np.tile(np.arange(t, dtype=np.int32), len(x))), pa.array(key.ravel())], ["id", "v", "table", "key"])

    dealt = materialize(pts.mapInArrow(spread, "id long, v array<double>, table int, key long"), "lsh-buckets")
    sizes = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / chunk_rows).cast("long")
    own = dealt.join(sizes, ["table", "key"]).withColumn("b", blocks).withColumn("own", F.pmod(F.xxhash64("id"), "b"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1))
    # renamed, as the two sides of the cogroup come from one table
    point = lambda: [F.col(c).alias(n) for c, n in (("table", "t"), ("key", "k"), ("id", "id"), ("v", "v"))]
    q = own.select(*point(), F.col("own").alias("qb"), others.alias("rb"))
    r = own.select(*point(), others.alias("qb"), F.col("own").alias("rb"))
    group = ["t", "k", "qb", "rb"]
    cand = q.groupBy(*group).cogroup(r.groupBy(*group)).applyInPandas(_knn_block(k, "id", "v"), _NEIGHBOURS)
    found = materialize(_nearest(cand, k), "lsh-neighbours")
    few = pts.join(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k), "id", "left_anti")
    return found.join(few.select("id"), "id", "left_anti").unionByName(knn(pts, "id", "v", k, chunk_rows, few))


def smote_synthesize(minority: DataFrame, neighbours: DataFrame, id_col: str, vec_col: str, n_new: int,
                     k: int, seed: int = 42) -> DataFrame:
    """Draw i picks base = minority row at index ⌊u₁·m⌋ (id order), its
    ⌊u₂·k⌋-th neighbour and a gap u₃ ∈ [0, 1); point = x + u₃·(nb − x)."""
    spark = minority.sparkSession
    m = minority.count()
    if n_new <= 0 or m < 2:
        return spark.createDataFrame([], f"draw long, base_id long, neighbor_id long, gap double, {vec_col} array<double>")
    mins = minority.select(F.col(id_col).alias("_sm_id"), F.col(vec_col).alias("_sm_vec"))
    idx = dense_index(mins, ["_sm_id"], "_bidx")
    draws = spark.range(n_new).withColumnRenamed("id", "draw").select(
        "draw",
        F.floor(hash_uniform(f"base{seed}", F.col("draw")) * m).cast("bigint").alias("_bidx"),
        (F.floor(hash_uniform(f"nb{seed}", F.col("draw")) * k) + 1).cast("int").alias("rank"),
        hash_uniform(f"gap{seed}", F.col("draw")).alias("gap"))
    b = draws.join(idx, "_bidx").select("draw", "rank", "gap", F.col("_sm_id").alias("base_id"),
                                       F.col("_sm_vec").alias("_x"))
    nb = neighbours.select(F.col("id").alias("base_id"), F.col("rank"), F.col("neighbor_id"))
    b = b.join(nb, ["base_id", "rank"])
    vecs = mins.select(F.col("_sm_id").alias("neighbor_id"), F.col("_sm_vec").alias("_n"))
    b = b.join(vecs, "neighbor_id")
    point = F.zip_with("_x", "_n", lambda x, y: x.cast("double") + F.col("gap") * (y.cast("double") - x.cast("double")))
    return b.select("draw", "base_id", "neighbor_id", "gap", point.alias(vec_col))


def number_rows(df: DataFrame, order: list[str], fmt: str = "TXN_SMOTE%07d", out: str = "transaction_id") -> DataFrame:
    """Number rows in ``order`` with a dense index (no global window)."""
    return dense_index(df, order, "_i").withColumn(out, F.format_string(fmt, F.col("_i"))).drop("_i")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 42, out: str = "position") -> DataFrame:
    """Position in the order (md5(seed:id), id)."""
    d = df.withColumn("_k", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    return dense_index(d, ["_k", id_col], out).drop("_k")


def pick_exact(df: DataFrame, label: str | None, id_col: str, rate: float, seed: str, out: str) -> DataFrame:
    """Exactly int(n·rate) rows (per class when ``label``), by smallest draw."""
    group = [label] if label else []
    if label:
        r = hash_rank(df, group, id_col, seed, "_r")
        j = _with_class_size(r, df, label)
    else:
        d = df.withColumn("_one", F.lit(1))
        r = hash_rank(d, ["_one"], id_col, seed, "_r")
        j = r.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n_class")))).drop("_one")
    return j.withColumn(out, F.col("_r") < F.floor(F.col("_n_class") * F.lit(rate))).drop("_r", "_n_class")


def perturb(df: DataFrame, label: str, id_col: str, cols: dict[str, tuple[float, float]], rate: float,
            seed: int = 42) -> DataFrame:
    """C11: in exactly int(n_c·rate) rows of each class, overwrite ``cols``
    with draws from the given (lo, hi) range (fraud rows made to look
    legitimate and the reverse)."""
    d = pick_exact(df, label, id_col, rate, f"perturb{seed}", "_p")
    repl = {c: F.when(F.col("_p"), F.lit(lo) + hash_uniform(f"{c}{seed}", F.col(id_col)) * F.lit(hi - lo))
             .otherwise(F.col(c).cast("double")) for c, (lo, hi) in cols.items()}
    return d.withColumns(repl).withColumnRenamed("_p", "perturbed")


def mask_cells(df: DataFrame, id_col: str, cols: list[str], p: float = 0.01, seed: int = 42) -> DataFrame:
    """Each cell is nulled independently with probability p."""
    return df.withColumns({c: F.when(hash_uniform(f"mask{seed}:{c}", F.col(id_col)) >= p, F.col(c))
                           for c in cols})


def flip_labels(df: DataFrame, label: str, id_col: str, rate: float, seed: int = 42) -> DataFrame:
    """Flip exactly int(n·rate) labels, chosen without replacement."""
    d = pick_exact(df, None, id_col, rate, f"flip{seed}", "flipped")
    return d.withColumn(label, F.when(F.col("flipped"), 1 - F.col(label)).otherwise(F.col(label)))
