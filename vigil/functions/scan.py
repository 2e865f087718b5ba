"""Walks along a table in order, for keys of any size.

Rows are dealt once by ranges of (keys, order), sorted, walked in the same stage
and written. A walk sees a partition batch by batch and works on runs of equal
keys with array operations; what it has to know from before its partition is one
row a partition (:func:`ends`), put together on the driver and joined back to
the one run it concerns. So there is one shuffle, no key is one task, and a task
holds one batch.

Range bounds come from a sample, hence the write: everything after reads the
same deal. Null keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.session import materialize

#: A walk: (batch, where runs start, the next batch or None, whether its first row goes on
#: with the run) to the arrays of its columns; it keeps its own state between batches.
Walk = Callable[[pa.RecordBatch, np.ndarray, pa.RecordBatch | None, bool], list[pa.Array]]


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; null equals null."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    a, b = here.is_null(), before.is_null()
    return pc.if_else(pc.or_(a, b), pc.xor(a, b), pc.not_equal(here, before)).to_numpy(zero_copy_only=False).astype(bool)


def run_starts(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> np.ndarray:
    """True where a run of equal keys begins; ``before`` are the keys of the row before the batch."""
    starts = np.zeros(batch.num_rows, dtype=bool)
    starts[0] = before is None or before != tuple(batch.column(k)[0].as_py() for k in keys)
    for k in keys:
        starts[1:] |= _changes(batch.column(k))
    return starts


def walked(df: DataFrame, keys: list[str], order: list[Column | str], walk: Callable[[], Walk], columns: str, partitions: int | None = None,
           seen: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with _pid (its range), _i (its place there) and the walk's ``columns``, written.
    ``seen``: columns that only the walk sees, made after the deal and not written."""
    # as many range partitions as any other shuffle (sized for the data)
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"_pid int, _i long, {columns}").fields])
    kept = len(df.columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, past, before, step, held = TaskContext.get().partitionId(), 0, None, walk(), None

        def made(batch: pa.RecordBatch, starts: np.ndarray, following: pa.RecordBatch | None, goes_on: bool) -> pa.RecordBatch:
            nonlocal past
            place = np.arange(past, past + batch.num_rows)
            past += batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(np.full(batch.num_rows, pid, dtype=np.int32)), pa.array(place),
                                               *step(batch, starts, following, goes_on)], schema.names)

        for batch in batches:
            if batch.num_rows:
                starts = run_starts(batch, keys, before)
                before = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
                if held:
                    yield made(*held, batch, not starts[0])
                held = (batch, starts)
        if held:
            yield made(*held, None, False)

    return materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumns(seen or {}).mapInArrow(task, schema), "segments")


def ends(d: DataFrame, keys: list[str], first: list[str], last: list[Column]) -> list[dict]:
    """One dict a partition, in order: pid, n, its first keys and ``first`` columns,
    its last keys and ``last`` expressions. One row a partition goes to the driver."""
    head = F.min_by(F.struct(*keys, *first), "_i").alias("head")
    tail = F.max_by(F.struct(*keys, *last), "_i").alias("tail")
    rows = d.groupBy("_pid").agg(head, tail, F.count(F.lit(1)).alias("n")).orderBy("_pid").collect()
    return [{"pid": r["_pid"], "n": r["n"], "first_key": tuple(r["head"])[:len(keys)], "first": tuple(r["head"])[len(keys):],
             "last_key": tuple(r["tail"])[:len(keys)], "last": tuple(r["tail"])[len(keys):]} for r in rows]


def with_carried(d: DataFrame, keys: list[str], carried: list[tuple], columns: str) -> DataFrame:
    """Joins (pid, keys..., carried...) rows, one a partition at most, to the
    rows of that partition and keys; null where nothing is carried."""
    fields = T.StructType.fromDDL(columns).fields
    schema = T.StructType([T.StructField("_cp", T.IntegerType()), *[T.StructField(f"_c_{k}", d.schema[k].dataType) for k in keys], *fields])
    c = F.broadcast(d.sparkSession.createDataFrame(carried, schema))
    on = F.col("_pid") == F.col("_cp")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    return d.join(c, on, "left").drop("_cp", *[f"_c_{k}" for k in keys])


# ---- running sums -----------------------------------------------------------

def _from(starts: np.ndarray) -> np.ndarray:
    """Where each row's run begins in the batch (0 for one that came in)."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def _sums(names: list[str]) -> Callable[[], Walk]:
    def make() -> Walk:
        carry = dict.fromkeys(names, 0)

        def step(batch: pa.RecordBatch, starts: np.ndarray, following: pa.RecordBatch | None, goes_on: bool) -> list[pa.Array]:
            begin, out = _from(starts), []
            came_in = np.cumsum(starts) == 0
            for n in names:
                column = batch.column(n)
                whole = pa.types.is_integer(column.type)
                v = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.longdouble)
                upto = np.cumsum(v)
                before = upto - v
                run = before - before[begin] + np.where(came_in, carry[n], 0)
                carry[n] = run[-1] + v[-1]
                out.append(pa.array(run.astype(np.int64 if whole else np.float64)))
            return out
        return step
    return make


def sums_before(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """For each name the sum of its value over the key's rows strictly before
    the current row in ``order``, for keys of any size."""
    names = [f"_v_{n}" for n in values]
    d = df.withColumns(dict(zip(names, values.values(), strict=True)))
    whole = {f"_v_{n}": isinstance(d.schema[f"_v_{n}"].dataType, T.IntegralType) for n in values}
    d = d.withColumns({c: F.col(c).cast("bigint" if w else "double") for c, w in whole.items()})
    kind = lambda c: "long" if whole[c] else "double"
    d = walked(d, keys, list(order), _sums(names), ", ".join(f"_w{c} {kind(c)}" for c in names), partitions)
    state, at, carried = None, None, []
    for r in ends(d, keys, [], [F.col(f"_w{c}") + F.coalesce(c, F.lit(0)) for c in names]):
        goes_on = state is not None and at == r["first_key"]
        if goes_on:
            carried.append((r["pid"], *r["first_key"], *state))
        state = tuple(a + b for a, b in zip(state, r["last"], strict=True)) if goes_on and r["first_key"] == r["last_key"] else r["last"]
        at = r["last_key"]
    j = with_carried(d, keys, carried, ", ".join(f"_c{c} {kind(c)}" for c in names))
    j = j.withColumns({n: F.coalesce(f"_c_v_{n}", F.lit(0)) + F.col(f"_w_v_{n}") for n in values})
    return j.drop("_pid", "_i", *[f"{x}{c}" for x in ("", "_w", "_c") for c in names])


# ---- the last match before a row --------------------------------------------

def _last(inclusive: bool) -> Callable[[], Walk]:
    def make() -> Walk:
        held = None

        def step(batch: pa.RecordBatch, starts: np.ndarray, following: pa.RecordBatch | None, goes_on: bool) -> list[pa.Array]:
            nonlocal held
            ref, n = batch.column("_ref"), batch.num_rows
            held = ref.slice(0, 0).take(pa.array([None], pa.int64())) if held is None else held
            begin, came_in = _from(starts), np.cumsum(starts) == 0
            upto = np.maximum.accumulate(np.where(ref.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
            at = upto if inclusive else np.concatenate([[-1], upto[:-1]])
            found = at >= begin
            out = pa.concat_arrays([held, ref]).take(pa.array(np.where(found, at + 1, 0), mask=~(found | came_in)))
            if upto[-1] >= begin[-1]:
                held = ref.slice(int(upto[-1]), 1)
            elif not came_in[-1]:
                held = None
            # what holds after the partition's last row
            end = held if following is None and held is not None else pa.nulls(1, ref.type)
            return [out, pa.concat_arrays([pa.nulls(n - 1, ref.type), end])]
        return step
    return make


def last_match(df: DataFrame, keys: list[str], order: list[Column | str], ref: Column, out: str, inclusive: bool = False) -> DataFrame:
    """The value of ``ref`` (a struct; null: no match) at the key's latest matching
    row strictly before the current one (or at it) in ``order``."""
    kind = df.select(ref.alias("_ref")).schema["_ref"].dataType.simpleString()
    d = walked(df, keys, order, _last(inclusive), f"_within {kind}, _upto {kind}", seen={"_ref": ref})  # made of the row's own columns: neither dealt nor written
    state, at, carried = None, None, []
    for r in ends(d, keys, [], [F.col("_upto").alias("_l")]):
        goes_on = at == r["first_key"]
        if goes_on and state is not None:
            carried.append((r["pid"], *r["first_key"], state))
        state = r["last"][0] if r["last"][0] is not None or not (goes_on and r["first_key"] == r["last_key"]) else state
        at = r["last_key"]
    j = with_carried(d, keys, carried, f"_prior {kind}")
    return j.withColumn(out, F.coalesce("_within", "_prior")).drop("_pid", "_i", "_within", "_upto", "_prior")


# ---- neighbours and sessions --------------------------------------------------

def _times(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)


def _around() -> Walk:
    last, known_last = 0, False

    def step(batch: pa.RecordBatch, starts: np.ndarray, following: pa.RecordBatch | None, goes_on: bool) -> list[pa.Array]:
        nonlocal last, known_last
        t, known = _times(batch.column("_e"))
        before = pa.array(np.concatenate([[last], t[:-1]]), mask=starts | ~np.concatenate([[known_last], known[:-1]]))
        (after, known_after) = _times(following.column("_e").slice(0, 1)) if goes_on else ([0], [False])
        after = pa.array(np.concatenate([t[1:], after]), mask=np.concatenate([starts[1:], [not goes_on]]) | ~np.concatenate([known[1:], known_after]))
        last, known_last = t[-1], known[-1]
        return [before, after]
    return step


def neighbours(df: DataFrame, keys: list[str], order: list[str], epoch: Column, before: str, after: str) -> DataFrame:
    """``before`` and ``after``: the time of the key's previous and next row in
    ``order`` (null if none), from one deal."""
    d = walked(df.withColumn("_e", epoch), keys, list(order), _around, "_before long, _after long")
    rows, tails = ends(d, keys, ["_e"], [F.col("_e")]), []
    for r, previous, following in zip(rows, [None, *rows[:-1]], [*rows[1:], None], strict=True):
        came_in = previous is not None and previous["last_key"] == r["first_key"]
        goes_on = following is not None and following["first_key"] == r["last_key"]
        tails.append((r["pid"], r["n"], previous["last"][0] if came_in else None, following["first"][0] if goes_on else None))
    j = d.join(F.broadcast(df.sparkSession.createDataFrame(tails, "_cp int, _n long, _cb long, _ca long")), F.col("_pid") == F.col("_cp"))  # one row a partition
    j = j.withColumn(before, F.when(F.col("_i") == 0, F.col("_cb")).otherwise(F.col("_before")))
    j = j.withColumn(after, F.when(F.col("_i") == F.col("_n") - 1, F.col("_ca")).otherwise(F.col("_after")))
    return j.drop("_pid", "_i", "_e", "_before", "_after", "_cp", "_n", "_cb", "_ca")


def _gaps(gap: int) -> Callable[[], Walk]:
    def make() -> Walk:
        last, known_last, carry = 0, False, 0

        def step(batch: pa.RecordBatch, starts: np.ndarray, following: pa.RecordBatch | None, goes_on: bool) -> list[pa.Array]:
            nonlocal last, known_last, carry
            t, known = _times(batch.column("_e"))
            both = known & np.concatenate([[known_last], known[:-1]])
            opens = (t - np.concatenate([[last], t[:-1]]) > gap) & both & ~starts
            upto = np.cumsum(opens)
            run = upto - (upto - opens)[_from(starts)] + np.where(np.cumsum(starts) == 0, carry, 0)
            last, known_last, carry = t[-1], known[-1], run[-1]
            return [pa.array(run.astype(np.int64))]
        return step
    return make


def session_numbers(df: DataFrame, keys: list[str], order: list[str], epoch: Column, gap: int, out: str) -> DataFrame:
    """From 1: the running number of the key's sessions, a new one where the time
    since the key's previous row exceeds ``gap``."""
    d = walked(df.withColumn("_e", epoch), keys, list(order), _gaps(gap), "_opened long")
    carried, at, number, time = [], None, 0, None
    for r in ends(d, keys, ["_e"], [F.col("_e"), F.col("_opened")]):
        came_in, base = at == r["first_key"], 1
        if came_in:
            base = number + int(time is not None and r["first"][0] is not None and r["first"][0] - time > gap)
            carried.append((r["pid"], *r["first_key"], base))
        number = r["last"][1] + (base if r["first_key"] == r["last_key"] else 1)
        at, time = r["last_key"], r["last"][0]
    j = with_carried(d, keys, carried, "_base long")
    return j.withColumn(out, (F.col("_opened") + F.coalesce("_base", F.lit(1))).cast("bigint")).drop("_pid", "_i", "_e", "_opened", "_base")
