"""Late messages kept and counted.

Spark's watermark operators drop late rows without a trace. Here each
micro-batch is split before anything stateful sees it: a row is late when its time is
at or before the high mark of the batches before it less the delay (the
watermark's rule). Late rows go to a sink of their own, on-time ones are checked for
redelivery against the ids of the last ``delay``, the rest is processed.

Every table is written per batch (``batch=<id>``, overwritten), and a batch reads
only batches before it: a repeated or half-written batch gives the same files
again. ``processed + duplicate + late`` is what was sent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import materialize

_MARKS = "high timestamp, low timestamp, processed long, duplicate long, late long, batch long"


def _earlier(spark, folder: str, schema, batch_id: int) -> DataFrame | None:
    """Rows of the batches before this one; None if there are none."""
    if batch_id == 0:
        return None
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).option("basePath", folder).parquet(folder).where(F.col("batch") < batch_id)
    except AnalysisException:  # nothing was written yet
        return None


def split_batches(folder: str, id_col: str, delay: str, process: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over batches with ``event_time`` and an id:
    ``process(on-time rows, batch id)`` must be repeatable. Rows without a time are late."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch, "feed")  # read once from the source, used several times
        marks = _earlier(spark, f"{folder}/marks", _MARKS, batch_id)
        high = marks.agg(F.unix_micros(F.max("high")).alias("h")).first()["h"] if marks is not None else None
        mark = F.timestamp_micros(F.lit(high).cast("long")) - F.expr(f"INTERVAL {delay}")
        late = F.col("event_time").isNull() | F.coalesce(F.col("event_time") <= mark, F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        # of a redelivered message the first in (time, content) order stays
        once = Window.partitionBy(id_col).orderBy("event_time", F.xxhash64(*[c for c in batch.columns]))
        fresh = batch.where(~late).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
        id_type = T.StructType([batch.schema[id_col], T.StructField("event_time", T.TimestampType()), T.StructField("batch", T.LongType())])
        seen = _earlier(spark, f"{folder}/ids", id_type, batch_id)
        if seen is not None and high is not None:
            # a batch whose newest time is before the mark holds no id that can come again in time
            recent = [r["batch"] for r in marks.where(F.col("high") > mark).select("batch").collect()]
            fresh = fresh.join(seen.where(F.col("batch").isin(recent)).select(id_col).distinct(), id_col, "left_anti")
        fresh = materialize(fresh.select(*batch.columns), "fresh")
        fresh.select(id_col, F.col("event_time").cast("timestamp").alias("event_time")).write.mode("overwrite").parquet(f"{folder}/ids/batch={batch_id}")
        process(fresh, batch_id)
        counts = batch.agg(F.max("event_time").cast("timestamp").alias("high"), F.min("event_time").cast("timestamp").alias("low"),
                           F.count_if(late).alias("late"), F.count(F.lit(1)).alias("sent"))
        counts.crossJoin(fresh.agg(F.count(F.lit(1)).alias("processed"))).select(  # one row each
            "high", "low", "processed", (F.col("sent") - F.col("late") - F.col("processed")).alias("duplicate"), "late"
        ).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")
    return each


def totals(spark, folder: str) -> DataFrame:
    """(processed, duplicate, late) over all batches."""
    return spark.read.schema(_MARKS).parquet(f"{folder}/marks").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("processed", "duplicate", "late")])
