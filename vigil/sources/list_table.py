"""Stored entity lists, merged batch by batch.

The list table is cut into buckets by (list, key). A batch of adds is folded,
only the buckets it touches are read, merged and written anew, and a version
(see :mod:`vigil.sources.versions`) then names the folder of every bucket and the
last batch applied from each source. A batch that was applied before is
skipped, one that failed half-way left nothing a reader sees, and readers keep
whole versions.

Entries keep the order (ts, seq) of what they show, so merging does not depend
on the order in which batches arrive: the table equals the fold of all adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import lists
from vigil.session import materialize
from vigil.sources import versions as V

ENTRY = ("list string, key string, count long, account string, account_at struct<ts:timestamp,seq:long>, reason string, "
         "reason_at struct<ts:timestamp,seq:long>")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("list", "key"), F.lit(buckets)).cast("int")


def _folded(adds: DataFrame) -> DataFrame:
    """Adds as entries."""
    order = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return adds.select("list", "key", F.lit(1).cast("long").alias("count"), "account", order.alias("account_at"), "reason",
                       F.when(F.col("reason").isNotNull(), order).alias("reason_at"))


def _merged(entries: DataFrame) -> DataFrame:
    """One entry per (list, key): counts add up, the latest account and the latest reason stay."""
    return entries.groupBy("list", "key").agg(
        F.sum("count").alias("count"), F.max_by("account", "account_at").alias("account"), F.max("account_at").alias("account_at"),
        F.max_by("reason", "reason_at").alias("reason"), F.max("reason_at").alias("reason_at"))


def apply_adds(spark: SparkSession, root: str, adds: DataFrame, source: str, batch_id: int, buckets: int = 64) -> V.Version | None:
    """Merge a batch of adds (list, key, account, ts, seq, reason); None if it
    was applied before. ``buckets`` counts when the table is made."""
    now = V.current(spark, root)
    meta = now.meta if now else {"buckets": buckets, "folders": {}, "applied": {}}
    if batch_id <= meta["applied"].get(source, -1):
        return None
    new = materialize(_merged(_folded(adds)).withColumn("bucket", _bucket(meta["buckets"])), "adds")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    folders = {meta["folders"][str(b)] for b in touched if str(b) in meta["folders"]}
    entries = new
    if folders:
        entries = new.drop("bucket").unionByName(_entries(spark, root, folders))
    merged = _merged(entries).withColumn("bucket", _bucket(meta["buckets"]))
    meta = meta | {"folders": dict(meta["folders"]), "applied": meta["applied"] | {source: batch_id}}

    def write(folder: str) -> None:
        if touched:
            merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
        name = folder.rstrip("/").rsplit("/", 1)[1]
        meta["folders"].update({str(b): f"{name}/bucket={b}" for b in touched})

    return V.publish(spark, root, write, meta)


def _entries(spark: SparkSession, root: str, folders: set[str]) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(*[f"{root}/{f}" for f in sorted(folders)])


def read_lists(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The list table (G1's columns) of the current version, or the given one."""
    now = V.current(spark, root, number)
    folders = set(now.meta["folders"].values()) if now else set()
    entries = _entries(spark, root, folders) if folders else spark.createDataFrame([], ENTRY)
    return entries.select("list", "key", "count", "account", "reason", F.lit(True).alias("fraud_confirmed"),
                          F.col("account_at.ts").cast("timestamp_ntz").alias("last_updated")).select(*lists.LIST_COLUMNS)
