"""Operator 2: sharding by jump consistent hashing.

A row's key is hashed to 64 bits and jumped through the shard numbers; no
ring or range table exists, and going from n to n + 1 shards moves only the
rows that land in the new shard (1 / (n + 1) of them).

Slots number the rows of a shard without gaps. No shard is sorted or
gathered: every task numbers its own rows per shard while it assigns them,
the slim result is written once to the shared folder, and each task's first
slot is the running sum of the row counts of the tasks before it. A shard,
or a key, that holds most of the rows is therefore never one task.

Defined cases: null text has no bytes and the crc of the empty text; null
keys hash alike and share a shard; repeated rows each get a slot of their
own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import table
from vigil.session import materialize

#: The step of the 64-bit generator that the jump is drawn from (fixed value of the published algorithm).
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key in 0 .. shards - 1, all keys at once: a key
    leaves the loop when its next jump passes the last shard."""
    state = keys.astype(np.uint64, copy=True)
    at = np.zeros(len(state), dtype=np.int64)
    to = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    while live.size:
        at[live] = to[live]
        state[live] = state[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        drawn = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to[live] = np.floor((at[live] + 1) * (float(1 << 31) / drawn)).astype(np.int64)
        live = live[to[live] < shards]
    return at


def assign_shards(df: DataFrame, keys: list[str], shards: int = 24, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns plus shard, grown_shard (with one shard more) and
    slot (gapless from 0 within the shard). Keys of any type and number."""
    if shards < 1:
        raise ValueError("shards must be positive")
    carry = keys if carry is None else carry
    slim = df.select(*carry, F.xxhash64(*keys).alias("_key"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "_key")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(shards, dtype=np.int64)
        for rows in batches:
            key = rows.pop("_key").to_numpy(dtype=np.int64).view(np.uint64)
            shard = jump_hash(key, shards)
            order = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=shards)
            local = np.empty(len(shard), dtype=np.int64)
            local[order] = np.arange(len(shard)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield rows.assign(shard=shard.astype(np.int32), grown_shard=jump_hash(key, shards + 1).astype(np.int32),
                              _task=task, _local=local + seen[shard])
            seen += counts

    numbered = materialize(slim.mapInPandas(number, f"{schema}, shard int, grown_shard int, _task int, _local long"), "shards")
    counts = numbered.groupBy("shard", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return (numbered.join(first, ["shard", "_task"])
            .select(*carry, "shard", "grown_shard", (F.col("_local") + F.col("_first")).alias("slot")))


def op2_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards by doc_id."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign_shards(sized, ["doc_id"], 24, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
