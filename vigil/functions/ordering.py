"""Order-based helpers that never put a whole table (or a whole class)
into one task.

* :func:`dense_index` — 0-based position in a total order: range
  partitioning spreads the order over tasks and every row gets its
  partition and its position there; that table is written once, and the
  per-partition counts (one row per partition, broadcast) are read from what
  was written. Range bounds come from a sample, so evaluating the partitioning
  twice could deal the rows differently.
* :func:`hash_rank` — 0-based rank of each row inside its group by an md5
  draw: the draw is uniform, so per-(group, draw-bucket) counts form a
  bounded table whose running sums are the offsets, and the final window
  only sees one (group, bucket) — about n / 65536 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.expr import hash_hex
from vigil.session import materialize

RANK_BUCKETS_HEX = 4  # 16**4 = 65536 buckets per group


def dense_index(df: DataFrame, order: list[str], out: str = "idx", partitions: int | None = None) -> DataFrame:
    """0-based dense position of every row in ``order`` (must be a total
    order for a deterministic result)."""
    # as many range partitions as any other shuffle (sized for the data)
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    d = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    d = materialize(d.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)), "ordered")
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = d.join(F.broadcast(offs), "_pid")
    return j.withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint")).drop("_pid", "_mid", "_local", "_off")


def hash_draw_key(seed: str, id_col: str) -> Column:
    return F.conv(F.substring(hash_hex(seed, F.col(id_col)), 1, 8), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, group: list[str], id_col: str, seed: str, out: str = "rank") -> DataFrame:
    """0-based rank inside each group by (md5 draw, id)."""
    d = df.withColumn("_h", hash_draw_key(seed, id_col)) \
          .withColumn("_hb", F.shiftright(F.col("_h"), 32 - 4 * RANK_BUCKETS_HEX))
    per = d.groupBy(*group, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*group).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "_hb", F.coalesce(F.sum("_c").over(wb), F.lit(0)).alias("_before"))
    wi = Window.partitionBy(*group, "_hb").orderBy("_h", id_col)
    d = d.withColumn("_in", F.row_number().over(wi) - 1)
    per = per.withColumnsRenamed({c: f"_k_{c}" for c in [*group, "_hb"]})
    on = F.col("_hb") == F.col("_k__hb")
    for g in group:  # null is a group like any other
        on = on & F.col(g).eqNullSafe(F.col(f"_k_{g}"))
    j = d.join(per, on).drop(*[f"_k_{c}" for c in [*group, "_hb"]])
    return j.withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint")).drop("_h", "_hb", "_in", "_before")
