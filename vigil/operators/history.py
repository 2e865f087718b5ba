"""History features over event tables (survey 2.12).

Hot accounts or devices may hold a large share of all rows, so no
operator here uses a window partitioned by the entity alone:

* first-seen flags and first/last times are grouped aggregates joined
  back (partial aggregation; AQE splits skewed join partitions);
* everything that depends on the order within a key is a walk
  (:mod:`vigil.functions.scan`): rows dealt once by ranges of (key, order), so
  that a hot key spans many tasks, walked where they are dealt; one row a task
  carries totals or last values on to the later ones;
* range windows are differences of two running sums over one timeline of
  rows and window ends, for any number of widths at once.

Null keys are a key like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import epoch_us, scan
from vigil.session import materialize

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_seen(df: DataFrame, keys: list[str], ts: str, seq: str, out: str) -> DataFrame:
    """True on the first (ts, seq) row of each key combination;
    false when a key is null."""
    firsts = df.where(F.greatest(*[F.col(k).isNull() for k in keys]) == F.lit(False)) \
        if len(keys) > 1 else df.where(F.col(keys[0]).isNotNull())
    firsts = firsts.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"))).alias(f"_first_{out}"))
    j = df.join(firsts, keys, "left")
    flag = F.coalesce((F.col(f"_first_{out}.t") == F.col(ts)) & (F.col(f"_first_{out}.s") == F.col(seq)),
                      F.lit(False))
    return j.withColumn(out, flag).drop(f"_first_{out}")


def sums_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column],
                partitions: int | None = None) -> DataFrame:
    """For each name the sum of its value over the key's rows strictly before
    the current row in ``order``, for keys of any size."""
    return scan.sums_before(df, keys, order, values, partitions)


def running_before(df: DataFrame, keys: list[str], ts: str, seq: str, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the key's rows strictly before the current row in (ts, seq) order."""
    return sums_before(df, keys, [ts, seq], {out: value})


def rolling_sums(df: DataFrame, keys: list[str], ts: str, row_id: str,
                 sums: dict[str, tuple[int, Column]]) -> DataFrame:
    """(row_id, one column per name): the sum of the value over the key's
    rows with epoch in [t − width, t − 1µs] (current row and same-instant rows
    excluded), for every (width, value) in ``sums`` in one pass: each row
    asks for the running sums just before t and before t − width."""
    d = df.select(*keys, F.col(row_id).alias("_row"), epoch_us(ts).alias("_e"),
                  *[v.cast("bigint").alias(f"_x_{n}") for n, (_, v) in sums.items()])
    widths = sorted({w for w, _ in sums.values()})
    nothing = [F.lit(0).cast("bigint").alias(f"_x_{n}") for n in sums]
    asks = F.explode(F.array(*[F.struct((F.col("_e") - w).alias("_time"), F.lit(w).cast("bigint").alias("_width")) for w in [0, *widths]]))
    rows = d.select(*keys, F.col("_e").alias("_time"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_width"),
                    "_row", *[f"_x_{n}" for n in sums])
    probes = d.select(*keys, "_row", asks.alias("_ask")).select(
        *keys, "_ask._time", F.lit(0).alias("_kind"), "_ask._width", "_row", *nothing)  # before the rows of their instant
    line = sums_before(rows.unionByName(probes), keys, ["_time", "_kind"], {f"_s_{n}": F.col(f"_x_{n}") for n in sums})
    at = lambda n, w: F.max(F.when(F.col("_width") == w, F.col(f"_s_{n}")))
    return (line.where("_kind = 0").groupBy("_row")
            .agg(*[(at(n, 0) - at(n, w)).alias(n) for n, (w, _) in sums.items()]).withColumnRenamed("_row", row_id))


def _struct_of(ts: str, seq: str, values: dict[str, Column]) -> Column:
    return F.struct(F.col(ts).alias("t"), F.col(seq).alias("s"), *[v.alias(k) for k, v in values.items()])


def last_before(df: DataFrame, keys: list[str], ts: str, seq: str, values: dict[str, Column],
                out: str, cond: Column | None = None, inclusive: bool = False) -> DataFrame:
    """As-of lookup: struct(t, s, values…) of the key's latest row strictly
    before the current one (or at it when ``inclusive``) in (ts, seq) order
    where ``cond`` holds; null if none."""
    ref = _struct_of(ts, seq, values)
    return scan.last_match(df, keys, [ts, seq], ref if cond is None else F.when(cond, ref), out, inclusive)


def next_after(df: DataFrame, keys: list[str], ts: str, seq: str, values: dict[str, Column],
               out: str, cond: Column | None = None) -> DataFrame:
    """Mirror of :func:`last_before`: the key's earliest row strictly after
    the current one where ``cond`` holds (the same walk, backwards)."""
    ref = _struct_of(ts, seq, values)
    return scan.last_match(df, keys, [F.col(ts).desc(), F.col(seq).desc()], ref if cond is None else F.when(cond, ref), out)


def first_per_key(df: DataFrame, keys: list[str], ts: str, out: str) -> DataFrame:
    """min(ts) per key joined back (L10 account age)."""
    m = df.groupBy(*keys).agg(F.min(ts).alias(out))
    return df.join(m, keys, "left")


def gap_sessions(df: DataFrame, keys: list[str], ts: str, seq: str, gap_us: int,
                 out: str = "session_no") -> DataFrame:
    """L14 batch sessions: a new session starts when the gap to the key's
    previous event exceeds ``gap_us``; the session number is the running
    count of starts (1-based)."""
    return scan.session_numbers(df, keys, [ts, seq], epoch_us(ts), gap_us, out)


def prefix_sum_sorted(df: DataFrame, group: list[str], order: list[str], value: Column, out: str,
                      partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows before each row in ``order`` inside its
    group, for groups of any size."""
    return sums_before(df, group, order, {out: value}, partitions)


def earlier_at_most(df: DataFrame, keys: list[str], ts: str, seq: str, value: str, row_id: str,
                    out_count: str = "earlier_at_most", out_prior: str = "prior_rows") -> DataFrame:
    """For each row, the number of the key's strictly earlier rows (in
    (ts, seq) order) whose ``value`` is ≤ its own, and the number of
    earlier rows. Exact dominance counting by divide and conquer on the
    per-key time rank r: at level ℓ, rows with the same r >> (ℓ+1) form a
    node, its left half (bit ℓ of r = 0) are the earlier rows and each
    right-half row counts the left-half rows ordered before it by (value,
    half). Every earlier/later pair meets in exactly one node. All levels go
    through one running sum (a key of n rows takes log2(n) copies of each),
    so no pair is ever made and no key is ever one task."""
    from vigil.functions.ordering import dense_index
    cols = list(dict.fromkeys([*keys, ts, seq, value, row_id]))
    idx = dense_index(df.select(*cols), [*keys, ts, seq], "_gi")
    start = idx.groupBy(*keys).agg(F.min("_gi").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    start = start.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    d = materialize(idx.join(start, on).drop(*[f"_k_{k}" for k in keys])
                    .withColumn("_r", F.col("_gi") - F.col("_g0")), "ranks")
    levels = F.ceil(F.log2(F.greatest(F.col("_n"), F.lit(1)).cast("double"))).cast("int")
    lv = d.where("_n > 1").select(F.col(row_id).alias("_row"), "_g0", "_r", F.col(value).alias("_v"),
                                  F.explode(F.sequence(F.lit(0), levels - 1)).alias("_lvl"))
    lv = (lv.withColumn("_node", F.expr("shiftright(_r, _lvl + 1)"))
            .withColumn("_side", F.expr("shiftright(_r, _lvl) & 1")))
    c = sums_before(lv, ["_g0", "_lvl", "_node"], ["_v", "_side", "_r"], {"_c": (F.col("_side") == 0).cast("bigint")})
    counts = c.where("_side = 1").groupBy("_row").agg(F.sum("_c").alias(out_count))
    return (d.join(counts, d[row_id] == counts["_row"], "left")
            .withColumn(out_count, F.coalesce(F.col(out_count), F.lit(0)).cast("bigint"))
            .withColumn(out_prior, F.col("_r").cast("bigint")).select(*cols, out_count, out_prior))


def distinct_in_window(df: DataFrame, key: str, item: str, ts: str, seq: str, width_us: int,
                       row_id: str, out: str) -> DataFrame:
    """L7 of one item: :func:`distinct_in_windows`."""
    return distinct_in_windows(df, key, ts, seq, row_id, {out: (item, width_us)})


def distinct_in_windows(df: DataFrame, key: str, ts: str, seq: str, row_id: str,
                        counts: dict[str, tuple[str, int]]) -> DataFrame:
    """For each name (item, width) the number of distinct ``item`` values
    among the key's rows with time in [t − width, t − 1µs], exactly, without
    per-row sets and for keys of any size.

    Each row covers the query times (t_j, t_j + width]; an item's rows
    whose gaps are ≤ width merge into one coverage segment, which starts
    after a row with no earlier row of the item within width and ends width
    after a row with no later row within width. The count at t is then the
    number of segment starts ≤ t minus segment ends < t: a running sum of
    +1/−1 over one time-ordered union per key, for all names at once."""
    e = epoch_us(ts)
    no_row = F.lit(None).cast(df.schema[row_id].dataType).alias(row_id)
    delta = lambda of=None, by=0: [F.lit(by if n == of else 0).alias(f"_d_{n}") for n in counts]
    line = df.select(F.col(key), e.alias("_time"), F.lit(1).alias("_kind"), *delta(), row_id)
    for name, (item, width_us) in counts.items():
        d = df.where(F.col(item).isNotNull()).select(*dict.fromkeys([key, item, ts, seq]))  # a segment needs no row's id
        d = scan.neighbours(d, [key, item], [ts, seq], e, "_prev", "_next").withColumn("_e", e)
        starts = d.where(F.col("_prev").isNull() | (F.col("_e") - F.col("_prev") > width_us)).select(
            F.col(key), (F.col("_e") + 1).alias("_time"), F.lit(0).alias("_kind"), *delta(name, 1), no_row)
        ends = d.where(F.col("_next").isNull() | (F.col("_next") - F.col("_e") > width_us)).select(
            F.col(key), (F.col("_e") + width_us + 1).alias("_time"), F.lit(0).alias("_kind"), *delta(name, -1), no_row)
        line = line.unionByName(starts).unionByName(ends)
    r = sums_before(line, [key], ["_time", "_kind"], {f"_n_{n}": F.col(f"_d_{n}") for n in counts})
    return r.where(F.col("_kind") == 1).select(row_id, *[F.col(f"_n_{n}").cast("int").alias(n) for n in counts])


# ---- L7 at size: mergeable sketches -----------------------------------------

#: 2**12 registers: a relative standard error of about 1.04 / 64 = 1.6 %.
SKETCH_LG = 12
#: Four standard errors.
SKETCH_BOUND = 4 * 1.04 / 2 ** (SKETCH_LG / 2)


def distinct_sketches(df: DataFrame, key: str, item: str, ts: str, bucket_us: int, lg: int = SKETCH_LG) -> DataFrame:
    """(key, bucket, sketch): one sketch of the distinct items per key and time
    bucket, filled map-side, so a hot key moves one sketch a task. New data adds
    rows; sketches of one bucket merge."""
    bucket = F.floor(epoch_us(ts) / F.lit(bucket_us)).alias("bucket")
    return df.where(F.col(item).isNotNull()).groupBy(key, bucket).agg(F.hll_sketch_agg(item, F.lit(lg)).alias("sketch"))


def sketched_windows(sketches: DataFrame, key: str, buckets: int) -> DataFrame:
    """(key, bucket, estimate): distinct items of the last ``buckets`` buckets up to
    each bucket that has rows, as the union of their sketches. The estimate is
    within SKETCH_BOUND of the exact number (four standard errors); small sets, up
    to some hundred items, are counted exactly but for hash collisions."""
    there = sketches.select(key, "bucket").distinct()
    spread = sketches.select(key, F.explode(F.sequence(F.col("bucket"), F.col("bucket") + (buckets - 1))).alias("bucket"), "sketch")
    return (spread.join(there, [key, "bucket"], "left_semi").groupBy(key, "bucket")
            .agg(F.hll_union_agg("sketch").alias("_s")).select(key, "bucket", F.hll_sketch_estimate("_s").alias("estimate")))
