"""Models and scoring (survey 2.5).

The learner is :class:`vigil.operators.boosting.RegularisedTrees`; Spark's own
boosted trees (``gbt``) remain as the plainer choice without L1/L2, column sample
and loss-reduction pruning. Everything fitted lives in one ``PipelineModel``
(imputer + scaler, trees), and a model is published as one version: pipeline,
parameters, metrics and feature list.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.operators.boosting import RegularisedTrees, RegularisedTreesModel, settings_json
from vigil.operators.preprocess import ImputeScale
from vigil.sources import versions as V


def regularised(features: list[str], row_id: str, label: str = "label", weight: str | None = None, **settings) -> RegularisedTrees:
    """E1/E2 learner: the reference's nine settings, but for ``settings``."""
    return RegularisedTrees(inputCols=features, labelCol=label, weightCol=weight, rowCol=row_id, settings=settings_json(**settings))


def gbt(trees: int = S.TABULAR_GBT["trees"], depth: int = S.TABULAR_GBT["depth"],
        rate: float = S.TABULAR_GBT["rate"], subsample: float = S.TABULAR_GBT["subsample"],
        min_child: int = S.TABULAR_GBT["min_child"], gamma: float = S.TABULAR_GBT["gamma"],
        label: str = "label", weight: str | None = None, seed: int = 42) -> GBTClassifier:
    """Spark's boosted trees (gamma as the minimum information gain of a
    split; l1/l2 and the column sample have no equivalent)."""
    g = GBTClassifier(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth,
                      stepSize=rate, subsamplingRate=subsample, minInstancesPerNode=min_child,
                      minInfoGain=gamma, featureSubsetStrategy="all", seed=seed, maxBins=64)
    if weight:
        g.setWeightCol(weight)
    return g


def with_weight(df: DataFrame, label: str, scale_pos_weight: float, out: str = "weight") -> DataFrame:
    """C3 applied: positives weigh ``scale_pos_weight``, negatives 1."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(scale_pos_weight))).otherwise(F.lit(1.0)))


def tabular_pipeline(features: list[str], learner: Estimator, impute_scale: bool = False) -> Pipeline:
    stages = [ImputeScale(inputCols=features)] if impute_scale else []
    if not isinstance(learner, RegularisedTrees):
        stages.append(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=[*stages, learner])


def probability(df: DataFrame, out: str = "ato_probability") -> DataFrame:
    """Positive-class probability as a plain double."""
    return df.withColumn(out, vector_to_array(F.col("probability"))[1])


def score(model: PipelineModel, df: DataFrame, features: list[str], backfill: bool = True,
          out: str = "ato_probability") -> DataFrame:
    """E5 (backfill absent features with 0.0) or E4 (keep nulls for the
    pipeline's imputer)."""
    d = df
    if backfill:
        d = d.withColumns({c: F.lit(0.0) for c in features if c not in d.columns})
    keep = df.columns
    last = model.stages[-1]
    if isinstance(last, RegularisedTreesModel):
        return model.transform(d, {last.outputCol: out}).select(*keep, out)
    return probability(model.transform(d), out).select(*keep, out)


def score_from_nodes(df: DataFrame, nodes: DataFrame, features: list[str], row_id: str, depth: int, out: str = "ato_probability") -> DataFrame:
    """(row_id, out): the probability walked through the saved node table with
    joins, one level at a time (a check of a model by its rows; nodes are the
    model's, bounded by its settings)."""
    values = F.array(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features])
    spark = df.sparkSession  # few rows make many steps: an explicit number, not one that follows their bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    at = (df.select(F.col(row_id).alias("_row"), values.alias("_v")).repartition(tasks, "_row")
          .crossJoin(F.broadcast(nodes.select("tree").distinct())).select("_row", "_v", F.shiftleft(F.col("tree").cast("long"), 32).alias("node")))
    place = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature")).cast("int") - 1
    nodes = F.broadcast(nodes.select(F.shiftleft(F.col("tree").cast("long"), 32).bitwiseOR(F.col("node")).alias("node"),  # the tree in the upper half
                                     place.alias("place"), "threshold", "missing_left", "value"))
    for _ in range(depth):
        left = F.coalesce(F.get("_v", F.col("place")) <= F.col("threshold"), F.col("missing_left"))
        inside = F.col("node").bitwiseAND(F.lit((1 << 32) - 1))
        at = at.join(nodes, "node").select(
            "_row", "_v", F.when(F.col("place").isNull(), F.col("node"))
            .otherwise(F.col("node") + inside + F.when(left, F.lit(1)).otherwise(F.lit(2))).alias("node"))
    margin = at.join(nodes, "node").groupBy("_row").agg(F.sum("value").alias("_m"))
    return margin.select(F.col("_row").alias(row_id), (1.0 / (1.0 + F.exp(-F.col("_m")))).alias(out))


# ---- a model as one version (A11) -------------------------------------------

@dataclass(frozen=True)
class Bundle:
    """What is saved together: the fitted pipeline, its settings, its metrics and its features."""
    model: PipelineModel
    params: dict
    metrics: dict
    features: list[str]
    version: int = 0


def publish_bundle(spark: SparkSession, root: str, bundle: Bundle) -> V.Version:
    """All four parts become the current version at once."""
    facts = json.dumps({"params": bundle.params, "metrics": bundle.metrics, "features": bundle.features})

    def write(folder: str) -> None:
        bundle.model.write().save(f"{folder}/pipeline")
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{folder}/facts")

    return V.publish(spark, root, write, {"kind": "model", "features": len(bundle.features)})


def load_bundle(spark: SparkSession, root: str, number: int | None = None) -> Bundle:
    """The current version, or the given one."""
    found = V.current(spark, root, number)
    if found is None:
        raise ValueError(f"no model is published under {root}")
    facts = json.loads(spark.read.text(f"{found.path}/facts", wholetext=True).first()["value"])
    return Bundle(PipelineModel.load(f"{found.path}/pipeline"), facts["params"], facts["metrics"], facts["features"], found.number)


def model_for_table(columns: list[str]) -> str:
    """E6 on a column list."""
    cols = set(columns)
    if sum(c in cols for c in S.BEHAVIORAL_FEATURES) >= S.MODEL_PICK_MIN_BEHAVIORAL:
        return "behavioral"
    if sum(c in cols for c in S.MODEL_FEATURES) >= S.MODEL_PICK_MIN_TABULAR:
        return "tabular"
    return "unknown"
