"""Keyed state on streams that arrive out of order (L1-L3, H1, H3).

A stateful operator keeps, per group of keys, a buffer of the events that the watermark
has not passed yet. A timer at the earliest of them wakes the group; events at or
before the watermark are final (later ones with such a time are late and never
get here), so they are taken in event-time order and applied once. The result
does not depend on the order of arrival within the watermark's delay, nor on how
the feed is cut into micro-batches, nor on a restart.

The buffer holds what arrived within the delay. What is applied is kept as long
as it can matter: events for velocity counts in a ring of time buckets, of which those
older than the widest window go; of an account only a live challenge and a standing
suspension.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.accounts import otp_shape_ok
from vigil.session import ensure_keyed_state

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def _us(times: pd.Series) -> np.ndarray:
    return times.to_numpy(dtype="datetime64[us]").astype(np.int64)


#: Groups that keys are dealt to. A call of the processor and each access of its state cost a
#: round trip to the state server, so a group's keys share them. Part of a stream's state: fixed.
GROUPS = 1024


def group_of(key: str):
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group")


class InOrder(StatefulProcessor):
    """Buffers the events of a group of keys and hands the final ones on in (event time, ord) order.

    ``columns`` are the event's columns but for the time, with their types: the
    key first, then ``ord``."""

    columns: dict[str, str] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "t long, " + ", ".join(f"{k} {t}" for k, t in self.columns.items()))
        self.open()

    def open(self) -> None:
        """Further state."""

    def apply(self, events: list[tuple], until: int) -> pd.DataFrame:
        """What the final events (t, key, ord, ...), in order, make of the state."""
        raise NotImplementedError

    def forget(self, until: int) -> int | None:
        """Clear what cannot matter after ``until``; the time (µs) at which more can go (None: nothing is left to clear)."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            t = _us(part["event_time"])
            values = part[list(self.columns)].astype(object).where(part[list(self.columns)].notna(), None)
            for c in [c for c, kind in self.columns.items() if kind in ("long", "bigint", "int")]:
                values[c] = pd.Series([None if v is None else int(v) for v in values[c]], values.index, dtype=object)  # a column with nulls comes as doubles
            self.pending.appendList([(int(at), *row) for at, row in zip(t, values.itertuples(index=False, name=None), strict=True)])
            first = int(t.min()) if first is None else min(first, int(t.min()))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.pending.get()) if self.pending.exists() else []
        final = [r for r in rows if r[0] <= until]
        if final:
            left = [r for r in rows if r[0] > until]
            if left:
                self.pending.put(left)
                self.handle.registerTimer(-(-min(r[0] for r in left) // 1000))
            else:
                self.pending.clear()
            yield self.apply(sorted(final, key=lambda r: (r[0], r[2] is None, r[2] or 0)), until)
        if len(final) == len(rows) and (idle := self.forget(until)) is not None:
            self.handle.registerTimer(-(-idle // 1000))

    def close(self) -> None:
        pass


# ---- L1-L3: rolling counts per message --------------------------------------

class VelocityRing(InOrder):
    """Counts of the key's earlier events of a kind in windows before each
    event, exactly: a ring of time buckets, each with its events' keys, times and kinds."""

    def __init__(self, windows: dict[str, tuple[str, int]], kinds: list[str], bucket_us: int = DAY_US, key_type: str = "long"):
        self.windows, self.kinds, self.bucket = windows, kinds, bucket_us
        self.columns = {"key": key_type, "ord": "long", **dict.fromkeys(kinds, "boolean")}
        self.widest = max(width for _, width in windows.values())

    def open(self) -> None:
        self.ring = self.handle.getMapState("ring", "bucket long", "events binary")

    def apply(self, events: list[tuple], until: int) -> pd.DataFrame:
        known: dict = {}
        code = np.array([known.setdefault(r[1], len(known)) for r in events], dtype=np.int64)
        t = np.array([r[0] for r in events], dtype=np.int64)
        of = np.array([[r[3 + i] is True for i in range(len(self.kinds))] for r in events], dtype=bool).reshape(len(t), len(self.kinds))
        ring = {k[0]: pickle.loads(bytes(v[0])) for k, v in self.ring.iterator()}
        parts = [(code, t, of)]
        for keys, codes, times, kinds in ring.values():
            parts.append((np.array([known.setdefault(k, len(known)) for k in keys], dtype=np.int64)[codes], times, kinds))
        all_code, all_t, all_of = (np.concatenate(x) for x in zip(*parts, strict=True))
        moments = np.unique(all_t)

        def place(codes: np.ndarray, x: np.ndarray) -> np.ndarray:
            """One order of (key, time)."""
            return codes * (len(moments) + 1) + np.searchsorted(moments, x, side="left")

        held = {kind: np.sort(place(all_code[all_of[:, i]], all_t[all_of[:, i]])) for i, kind in enumerate(self.kinds)}
        out = {"key": pd.Series([r[1] for r in events], dtype=object), "ord": pd.Series([r[2] for r in events], dtype=object)}
        for name, (kind, width) in self.windows.items():  # earlier keys' events are in both terms
            out[name] = np.searchsorted(held[kind], place(code, t)) - np.searchsorted(held[kind], place(code, t - width))
        names = list(known)
        for bucket in np.unique(t // self.bucket).tolist():
            mine = (all_t // self.bucket == bucket) & all_of.any(axis=1)
            if (bucket + 1) * self.bucket > until - self.widest and mine.any():
                some, codes = np.unique(all_code[mine], return_inverse=True)
                self.ring.updateValue((bucket,), (pickle.dumps(([names[i] for i in some], codes, all_t[mine], all_of[mine])),))
        return pd.DataFrame(out)

    def forget(self, until: int) -> int | None:
        buckets = [k[0] for k in self.ring.keys()]
        stale = [b for b in buckets if (b + 1) * self.bucket <= until - self.widest]
        for b in stale:
            self.ring.removeKey((b,))
        return (max(buckets) + 1) * self.bucket + self.widest if len(stale) < len(buckets) else None


def rolling_counts(events: DataFrame, key: str, ord_col: str, windows: dict[str, tuple[str, int]], delay: str,
                   bucket_us: int = DAY_US) -> DataFrame:
    """(key, ord, one column per window): for each event, once its time is
    final, the number of the key's events of the window's kind with a time in
    [t - width, t - 1 µs]. ``events`` has event_time, the key, an id and one boolean
    column per kind; ids may be null (a heartbeat that only moves the watermark)."""
    ensure_keyed_state(events.sparkSession)
    kinds = sorted({kind for kind, _ in windows.values()})
    kind_of_key = dict(events.dtypes)[key]
    ring = VelocityRing(windows, kinds, bucket_us, kind_of_key)
    schema = f"key {kind_of_key}, ord long, " + ", ".join(f"{name} long" for name in windows)
    slim = events.withWatermark("event_time", delay).select(group_of(key), F.col(key).alias("key"), "event_time", F.col(ord_col).cast("long").alias("ord"), *kinds)
    counted = slim.groupBy("group").transformWithStateInPandas(ring, schema, "Append", "EventTime")
    return counted.where(F.col("ord").isNotNull()).withColumnsRenamed({"key": key, "ord": ord_col})


# ---- H1 + H3: challenges, attempts and suspensions --------------------------

EVENT_SCHEMA = ("kind string, account_number string, ts string, ord long, otp string, action string, "
                "transaction_id string, ato_probability double, behavioral_anomaly_score double")
OUT_SCHEMA = ("account_number string, as_of timestamp, suspended boolean, suspension_time timestamp, transaction_id string, "
              "ato_probability double, behavioral_anomaly_score double, valid_otps long")


class AccountStates(InOrder):
    """The live challenge and the suspension of each account of a group.

    Kept are the accounts that have either; the others are forgotten."""

    columns = {"account_number": "string", "ord": "long", "kind": "string", "otp": "string", "action": "string", "transaction_id": "string",
               "ato_probability": "double", "behavioral_anomaly_score": "double"}

    def open(self) -> None:
        self.kept = self.handle.getListState("kept", "account_number string, otp string, suspended_at long, transaction_id string, p double, b double")

    def apply(self, events: list[tuple], until: int) -> pd.DataFrame:
        states = {r[0]: tuple(r[1:]) for r in self.kept.get()} if self.kept.exists() else {}
        seen: dict[str | None, tuple[int, int]] = {}  # account: newest event, right codes
        for t, account, _, kind, otp, action, *of in events:
            live, *held = states.get(account, (None,) * 5)
            right = 0
            if kind == "challenge":
                live = otp
                if action == "SUSPEND":
                    held = [t, *of]
            elif live is not None and otp == live:  # a right code uses its challenge up
                live, held, right = None, [None] * 4, 1
            states[account] = (live, *held)
            seen[account] = (t, seen.get(account, (0, 0))[1] + right)
        keep = [(account, *state) for account, state in states.items() if state[0] is not None or state[1] is not None]
        if keep:
            self.kept.put(keep)
        else:
            self.kept.clear()
        at = lambda us: pd.NaT if us is None else pd.Timestamp(us, unit="us")
        out = [(account, at(t), states[account][1] is not None, at(states[account][1]), *states[account][2:], right) for account, (t, right) in seen.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT_SCHEMA.split(", ")])


def account_state(events: DataFrame, delay: str) -> DataFrame:
    """Challenges (kind 'challenge', action SUSPEND or OTP_REQUIRED) and
    attempts (kind 'attempt'; malformed codes are dropped first) in any order
    within ``delay``: the account's state as of its newest final event, one row
    each time events become final. Other kinds (a heartbeat) only move the
    watermark."""
    ensure_keyed_state(events.sparkSession)
    ev = events.withColumn("event_time", F.to_timestamp("ts")).withWatermark("event_time", delay)
    counts = (F.col("kind") == "challenge") | ((F.col("kind") == "attempt") & otp_shape_ok("otp"))
    ev = ev.where(F.when(counts, F.col("event_time")).isNotNull())  # on the event time too, or it is pushed below the watermark
    slim = ev.select(group_of("account_number"), "event_time", *AccountStates.columns)
    return slim.groupBy("group").transformWithStateInPandas(AccountStates(), OUT_SCHEMA, "Append", "EventTime")
