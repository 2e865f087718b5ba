"""Entity lists: ip, device and beneficiary blacklists (survey 2.7).

A list is a table ``(list, key, count, account, reason, fraud_confirmed,
last_updated)``.  Changes arrive as an *adds log* ``(list, key, account,
reason, ts, seq)``; folding the log is a grouped aggregate (partial
aggregation map-side, so a hot key never lands whole in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.functions import ts_seq_before

LIST_COLUMNS = ["list", "key", "count", "account", "reason", "fraud_confirmed", "last_updated"]


def fan_out_adds(confirmed: DataFrame, ts: str = "transaction_ts", seq: str = "txn_seq",
                 reason: str | None = None) -> DataFrame:
    """One confirmed fraud → up to three list adds; null/blank keys skipped."""
    ents = F.array(*[
        F.struct(F.lit(name).alias("list"), F.col(c).cast("string").alias("key"))
        for name, c in (("ip", "ip_address"), ("device", "device_id"),
                        ("beneficiary", "beneficiary_account"))])
    out = (confirmed.select(F.explode(ents).alias("e"), F.col("account_number").alias("account"),
                            F.col(ts).alias("ts"), F.col(seq).alias("seq"))
           .select("e.list", "e.key", "account", "ts", "seq")
           .where(F.col("key").isNotNull() & (F.trim("key") != "")))
    return out.withColumn("reason", F.lit(reason).cast("string"))


def fold_adds(adds: DataFrame) -> DataFrame:
    """G1 on an adds log alone: count, latest account, latest non-null reason,
    confirmed flag, last update, first listing (ts, seq)."""
    order = F.struct("ts", "seq")
    return adds.groupBy("list", "key").agg(
        F.count(F.lit(1)).cast("bigint").alias("count"),
        F.max_by("account", order).alias("account"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("reason"),
        F.lit(True).alias("fraud_confirmed"),
        F.max("ts").alias("last_updated"),
        F.min(order).alias("first_listed"),
    )


def upsert(stored: DataFrame, adds: DataFrame) -> DataFrame:
    """Merge an adds log into a stored list table (full outer join on
    (list, key); counts add up, later metadata wins field by field)."""
    new = fold_adds(adds).drop("first_listed").alias("n")
    old = stored.select(*LIST_COLUMNS).alias("o")
    j = old.join(new, ["list", "key"], "full_outer")
    return j.select(
        "list", "key",
        (F.coalesce(F.col("o.count"), F.lit(0)) + F.coalesce(F.col("n.count"), F.lit(0))).cast("bigint").alias("count"),
        F.coalesce(F.col("n.account"), F.col("o.account")).alias("account"),
        F.coalesce(F.col("n.reason"), F.col("o.reason")).alias("reason"),
        F.coalesce(F.col("n.fraud_confirmed"), F.col("o.fraud_confirmed")).alias("fraud_confirmed"),
        F.greatest(F.col("n.last_updated"), F.col("o.last_updated")).alias("last_updated"),
    )


def is_listed(df: DataFrame, lists: DataFrame, list_name: str, key_col: str,
              out: str) -> DataFrame:
    """Membership flag via a left join on the list's keys (AQE
    broadcasts the list when its measured size is small)."""
    keys = (lists.where(F.col("list") == list_name)
            .select(F.col("key").alias(f"_k_{out}")).distinct())
    j = df.join(keys, df[key_col].cast("string") == keys[f"_k_{out}"], "left")
    return j.withColumn(out, F.col(f"_k_{out}").isNotNull()).drop(f"_k_{out}")


def remove(stored: DataFrame, removals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining list, removals that matched nothing)."""
    kept = stored.join(removals.select("list", "key"), ["list", "key"], "left_anti")
    not_found = removals.select("list", "key").join(stored.select("list", "key"),
                                                   ["list", "key"], "left_anti")
    return kept, not_found


def counts_per_list(lists: DataFrame) -> DataFrame:
    """Entries per list, 0 for an empty list."""
    names = lists.sparkSession.createDataFrame([(n,) for n in S.LIST_NAMES], "list string")
    c = lists.groupBy("list").agg(F.count(F.lit(1)).cast("bigint").alias("entries"))
    return (F.broadcast(names).join(c, "list", "left")
            .select("list", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries")))


def flag_listed_before(txn: DataFrame, firsts: DataFrame, list_name: str, key_col: str,
                       out: str, ts: str = "transaction_ts", seq: str = "txn_seq") -> DataFrame:
    """G8 as-of: the entity was listed by a strictly earlier confirmed event."""
    f = (firsts.where(F.col("list") == list_name)
         .select(F.col("key").alias("_k"), F.col("first_listed").alias("_f")))
    j = txn.join(f, txn[key_col] == f["_k"], "left")
    flag = F.coalesce(ts_seq_before(F.col("_f.ts"), F.col("_f.seq"), F.col(ts), F.col(seq)), F.lit(False))
    return j.withColumn(out, flag).drop("_k", "_f")


def first_listing_by_key(folded: DataFrame) -> DataFrame:
    """One row per entity key with the first listing of each list as a
    column (``first_ip`` …); (list, key) is unique in a folded list."""
    return (folded.groupBy("key").pivot("list", S.LIST_NAMES)
            .agg(F.first("first_listed"))
            .select("key", *[F.col(n).alias(f"first_{n}") for n in S.LIST_NAMES]))


def flag_listed_before_by_key(txn: DataFrame, per_key: DataFrame, list_name: str, key_col: str, out: str,
                              ts: str = "transaction_ts", seq: str = "txn_seq") -> DataFrame:
    """G8 as-of against :func:`first_listing_by_key`."""
    f = per_key.select(F.col("key").alias("_k"), F.col(f"first_{list_name}").alias("_f"))
    j = txn.join(f, txn[key_col] == f["_k"], "left")
    flag = F.coalesce(ts_seq_before(F.col("_f.ts"), F.col("_f.seq"), F.col(ts), F.col(seq)), F.lit(False))
    return j.withColumn(out, flag).drop("_k", "_f")
