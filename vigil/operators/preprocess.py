"""Fitted preprocessing (survey 2.4): exact medians, standard scaling and
their bundle as a Spark ML Estimator/Model pair.

Fitting produces a handful of numbers per column; they travel to the
executors as literals inside the projection.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCols, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.history import sums_before

MEDIAN_SKETCH_ACCURACY = 1_000_000  # rank error of the bracketing sketch ≤ n / accuracy


def exact_medians(df: DataFrame, cols: list[str], accuracy: int = MEDIAN_SKETCH_ACCURACY) -> dict[str, float | None]:
    """D1 fit: exact median of each column (mean of the two middle values
    for an even count; nulls and NaN ignored) in two passes, without a
    full sort:

    1. one aggregate gives n and an approximate-percentile bracket
       [q(½ − 2/accuracy), q(½ + 2/accuracy)] whose rank error bound makes
       it contain both middle ranks;
    2. one aggregate counts the values below the bracket, and the values
       inside it are counted per distinct value (a slice of about
       4·n/accuracy rows), whose running counts locate the middle ranks.

    Only a few numbers per column reach the driver."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("x")).select("x.*") \
             .where(F.col("v").isNotNull() & ~F.isnan("v"))
    d = 2.0 / accuracy
    first = long.groupBy("col").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [max(0.0, 0.5 - d), min(1.0, 0.5 + d)], accuracy).alias("br")).collect()
    out: dict[str, float | None] = {c: None for c in cols}
    if not first:
        return out
    spark = df.sparkSession
    brackets = {r["col"]: (int(r["n"]), float(r["br"][0]), float(r["br"][1])) for r in first}
    todo = dict(brackets)
    while todo:
        found = _median_in_brackets(spark, long, todo)
        missed = {}
        for c, (n, lo, hi) in todo.items():
            if c in found:
                out[c] = found[c]
            else:  # the sketch bracket missed a middle rank: widen to everything
                missed[c] = (n, float("-inf"), float("inf"))
        if any(lo == float("-inf") for (_, lo, _) in todo.values()):
            break
        todo = missed
    return out


def _median_in_brackets(spark, long: DataFrame, brackets: dict) -> dict:
    br = spark.createDataFrame([(c, n, lo, hi) for c, (n, lo, hi) in brackets.items()],
                               "col string, n long, lo double, hi double")
    j = long.join(F.broadcast(br), "col")  # one row per column
    below = j.where(F.col("v") < F.col("lo")).groupBy("col").agg(F.count(F.lit(1)).alias("below"))
    inside = (j.where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
              .groupBy("col", "v").agg(F.count(F.lit(1)).alias("c")))
    # running counts in segments of (column, value): no column is one task, however wide its bracket
    cum = sums_before(inside, ["col"], ["v"], {"before": F.col("c")}).withColumn("upto", F.col("before") + F.col("c"))
    cum = cum.join(F.broadcast(br.select("col", "n")), "col").join(F.broadcast(below), "col", "left") \
                .withColumn("upto", F.col("upto") + F.coalesce(F.col("below"), F.lit(0)))
    r_lo, r_hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # 0-based middle ranks
    start = F.col("upto") - F.col("c")                                   # rank of the value's first copy
    has_lo = (start <= r_lo) & (r_lo < F.col("upto"))
    has_hi = (start <= r_hi) & (r_hi < F.col("upto"))
    hit = cum.where(has_lo | has_hi).groupBy("col").agg(
        ((F.min("v") + F.max("v")) / 2.0).alias("m"),
        F.max(has_lo.cast("int")).alias("l"), F.max(has_hi.cast("int")).alias("h"))
    return {r["col"]: r["m"] for r in hit.collect() if r["l"] == 1 and r["h"] == 1}


def impute(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """D1 apply: fill nulls (and NaN) with the fitted median."""
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")),
                                         F.lit(m)) for c, m in medians.items() if m is not None})


def scaling_stats(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """D2 fit: mean and population std per column in one aggregate; std 0
    (or undefined) becomes 1."""
    aggs = []
    for c in cols:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    r = df.agg(*aggs).collect()[0]
    out = {}
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        out[c] = (0.0 if m is None else m, 1.0 if (s is None or s == 0) else s)
    return out


def scale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """D2 apply: (x − mean) / std."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def unscale(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """D3: x · std + mean (back to original units)."""
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in stats.items()})


class _StatsParams(HasInputCols):
    stats = Param(Params._dummy(), "stats", "fitted medians and moments as JSON",
                  typeConverter=TypeConverters.toString)


class ImputeScale(Estimator, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputer + standard scaler as one Estimator, so a Pipeline
    carries both with the model and its feature list."""

    @keyword_only
    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ImputeScaleModel":
        cols = self.getInputCols()
        med = exact_medians(dataset, cols)
        st = scaling_stats(impute(dataset, med), cols)
        blob = json.dumps({"medians": med, "stats": {c: list(v) for c, v in st.items()}})
        return ImputeScaleModel(inputCols=cols, stats=blob)


class ImputeScaleModel(Model, _StatsParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols: list[str] | None = None, stats: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def fitted(self) -> tuple[dict, dict]:
        blob = json.loads(self.getOrDefault(self.stats))
        return blob["medians"], {c: tuple(v) for c, v in blob["stats"].items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        med, st = self.fitted()
        return scale(impute(dataset, med), st)
