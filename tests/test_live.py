"""Streams whose rows arrive out of order, late or twice."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import history as H
from vigil.session import STATE_STORE
from vigil.sources import list_table as L
from vigil.sources import versions as V
from vigil.streaming import late, sessions as SE, state as SS, stream as ST

BASE = 1_700_000_000_000_000


def write(spark, folder, rows, schema):
    """One file a call, read one a trigger in this order."""
    import time
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
    time.sleep(0.02)


def read(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder).withColumn("event_time", F.timestamp_micros("us"))


def shuffled(rows, reach, seed):
    """In order of time plus a delay of less than ``reach``."""
    rng = random.Random(seed)
    return sorted(rows, key=lambda r: r["us"] + rng.random() * reach)


WIN = {"hour": ("any", H.HOUR_US), "day": ("any", H.DAY_US), "bad_day": ("bad", H.DAY_US)}
EVENTS = "id long, k string, us long, bad boolean"


def run_velocity(spark, base, parts, bucket_us):
    for i, part in enumerate(parts):
        for at in range(0, len(part), 40):
            write(spark, base + "/in", [tuple(r[c] for c in ("id", "k", "us", "bad")) for r in part[at:at + 40]], EVENTS)
        if i == len(parts) - 1:
            write(spark, base + "/in", [(None, None, BASE + 90 * H.DAY_US, None)], EVENTS)
        ev = read(spark, base + "/in", EVENTS).withColumn("any", F.lit(True))
        ST.run_available_now(SS.rolling_counts(ev, "k", "id", WIN, "10 hours", bucket_us), "parquet", base + "/out", base + "/ckpt")
    return {r["id"]: (r["hour"], r["day"], r["bad_day"]) for r in spark.read.parquet(base + "/out").collect()}


def test_keyed_state_in_a_session_with_the_default_store(spark, tmp_path):
    before = spark.conf.get(STATE_STORE)
    spark.conf.unset(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        rows = [{"id": i, "k": "a", "us": BASE + i * H.HOUR_US, "bad": None} for i in range(4)]
        assert run_velocity(spark, str(tmp_path), [rows], H.DAY_US) == {0: (0, 0, 0), 1: (1, 1, 0), 2: (1, 2, 0), 3: (1, 3, 0)}
        assert SS.account_state(spark.createDataFrame([], SS.EVENT_SCHEMA), "1 day").columns[0] == "account_number"
    finally:
        spark.conf.set(STATE_STORE, before)


def test_state_partitions_follow_the_cores(spark, tmp_path):
    """Not the number of partitions of a batch shuffle, each of which every micro-batch would commit."""
    import os
    before = spark.conf.get(ST.PARTITIONS)
    spark.conf.set(ST.PARTITIONS, "64")
    try:
        write(spark, f"{tmp_path}/in", [(i, BASE + i) for i in range(20)], "transaction_id long, us long")
        once = ST.dedupe(read(spark, f"{tmp_path}/in", "transaction_id long, us long"))
        ST.run_available_now(once, "parquet", f"{tmp_path}/out", f"{tmp_path}/ckpt")
        assert spark.conf.get(ST.PARTITIONS) == "64"
    finally:
        spark.conf.set(ST.PARTITIONS, before)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    stores = [d for d in os.listdir(f"{tmp_path}/ckpt/state/0") if d.isdigit()]
    assert len(stores) == max(2 * spark.sparkContext.defaultParallelism, 8)


@pytest.mark.parametrize("bucket_us", [H.DAY_US, 2 * H.HOUR_US])
def test_velocity_over_a_restart(spark, tmp_path, bucket_us):
    rng = random.Random(1)
    rows = [{"id": i, "k": rng.choice("aab"), "us": BASE + rng.randrange(0, 5 * 24) * H.HOUR_US // 2, "bad": rng.random() < 0.3 or None} for i in range(200)]
    feed = shuffled(rows, 9 * H.HOUR_US, 2)
    got = run_velocity(spark, str(tmp_path), [feed[:90], feed[90:]], bucket_us)
    for r in rows:
        near = [x for x in rows if x["k"] == r["k"] and x["us"] < r["us"]]
        want = (sum(x["us"] >= r["us"] - H.HOUR_US for x in near), sum(x["us"] >= r["us"] - H.DAY_US for x in near),
                sum(x["us"] >= r["us"] - H.DAY_US and bool(x["bad"]) for x in near))
        assert got.pop(r["id"]) == want
    assert not got


def test_state_goes_with_idle_keys(spark, tmp_path):
    base = str(tmp_path)
    for day in range(12):
        write(spark, base + "/in", [(day, f"k{day}", BASE + day * H.DAY_US, None)], EVENTS)
    write(spark, base + "/in", [(None, None, BASE + 90 * H.DAY_US, None)], EVENTS)
    ev = read(spark, base + "/in", EVENTS).withColumn("any", F.lit(True))
    counts = SS.rolling_counts(ev, "k", "id", WIN, "1 hour")
    q = counts.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert max(rows) < 40 and rows[-1] <= rows[0]  # keys whose windows have passed are forgotten
    assert spark.read.parquet(base + "/out").count() == 12


ACCOUNT = SS.EVENT_SCHEMA


def test_account_state_does_not_depend_on_arrival(spark, tmp_path):
    rng = random.Random(3)
    rows, live, susp, want = [], {}, {}, {}
    for i in range(120):
        account = rng.choice("xyz")
        if rng.random() < 0.5:
            rows.append(("challenge", account, i, str(1000 + rng.randrange(3)), rng.choice(["SUSPEND", "OTP_REQUIRED"]), f"t{i}"))
        else:
            rows.append(("attempt", account, i, rng.choice(["1000", "1001", "1002", "x"]), None, None))
    for kind, account, i, otp, action, txn in rows:  # one after the other
        if kind == "challenge":
            live[account] = otp
            if action == "SUSPEND":
                susp[account] = txn
        elif len(otp) >= 4 and live.get(account) == otp:
            live.pop(account)
            susp.pop(account, None)
    for seed in (4, 5):
        order = sorted(rows, key=lambda r: r[2] + random.Random(seed * 1000 + r[2]).random() * 8)
        base = str(tmp_path / str(seed))
        for at in range(0, len(order), 30):
            write(spark, base + "/in", [(k, a, f"2024-01-01 {i // 60:02d}:{i % 60:02d}:00", i, o, act, t, 0.5, 0.1) for k, a, i, o, act, t in order[at:at + 30]], ACCOUNT)
        write(spark, base + "/in", [("heartbeat", None, "2024-02-01 00:00:00", None, None, None, None, None, None)], ACCOUNT)
        ev = spark.readStream.schema(ACCOUNT).option("maxFilesPerTrigger", 1).json(base + "/in")
        ST.run_available_now(SS.account_state(ev, "9 minutes"), "parquet", base + "/out", base + "/ckpt")
        out = spark.read.parquet(base + "/out")
        last = out.groupBy("account_number").agg(F.max_by(F.struct("suspended", "transaction_id"), "as_of").alias("s")).collect()
        want = {r["account_number"]: r["s"]["transaction_id"] for r in last if r["s"]["suspended"]}
        assert want == susp


def test_sessions_close_and_late_rows_do_not_reopen_them(spark, tmp_path):
    base, schema = str(tmp_path), "k string, us long"
    minutes = lambda *m: [("a", BASE + x * 60_000_000) for x in m]
    write(spark, base + "/in", minutes(0, 20, 10), schema)
    write(spark, base + "/in", minutes(200, 150, 45), schema)       # 45 is 25 after 20: within the gap
    write(spark, base + "/in", minutes(300), schema)
    write(spark, base + "/in", minutes(30), schema)                 # its session is closed by now
    write(spark, base + "/in", [(None, BASE + 9000 * 60_000_000)], schema)
    found = SE.closed_sessions(read(spark, base + "/in", schema), "k", 25 * 60_000_000, "60 minutes", {"n": F.count(F.lit(1))})
    ST.run_available_now(found, "parquet", base + "/out", base + "/ckpt")
    got = sorted((int((r["session_start"].timestamp() * 1e6 - BASE) / 6e7), r["n"]) for r in spark.read.parquet(base + "/out").collect())
    assert got == [(0, 4), (150, 1), (200, 1), (300, 1)]


def test_split_of_late_and_repeated_rows(spark, tmp_path):
    base, schema = str(tmp_path), "id string, us long"
    hour = H.HOUR_US
    batches = [[("a", 0), ("b", 5 * hour), ("a", 0)], [("c", 4 * hour), ("late", 2 * hour), ("b", 5 * hour), ("none", None)], [("d", 40 * hour)], [("b", 5 * hour), ("e", 39 * hour)]]
    done = {}

    def process(rows, batch_id):
        done[batch_id] = sorted(r["id"] for r in rows.collect())
    split = late.split_batches(base + "/split", "id", "2 hours", process)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(k, BASE + t if t is not None else None) for k, t in rows], schema).withColumn("event_time", F.timestamp_micros("us"))
        split(df, i)
        split(df, i)  # delivered again after a failure
    assert done == {0: ["a", "b"], 1: ["c"], 2: ["d"], 3: ["e"]}
    assert sorted(r["id"] for r in spark.read.parquet(base + "/split/late").collect()) == ["b", "late", "none"]
    t = late.totals(spark, base + "/split").first()
    assert (t["processed"], t["duplicate"], t["late"]) == (5, 2, 3) and sum(t) == sum(map(len, batches))


ADDS = "list string, key string, account string, ts timestamp_ntz, seq long, reason string"


def test_list_table_merges_touched_buckets_once(spark, tmp_path):
    import datetime as dt
    from vigil.operators import lists
    root = str(tmp_path / "lists")
    rng = random.Random(7)
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    adds = [("ip" if i % 3 else "device", f"k{rng.randrange(25)}", f"a{i}", day(rng.randrange(9)), i, rng.choice([None, f"why {i}"])) for i in range(150)]
    for batch in (2, 0, 1):  # another source's batches, in any order
        V_before = V.current(spark, root)
        part = [a for a in adds if a[4] % 3 == batch]
        got = L.apply_adds(spark, root, spark.createDataFrame(part, ADDS), f"s{batch}", 0, buckets=8)
        assert L.apply_adds(spark, root, spark.createDataFrame(part, ADDS), f"s{batch}", 0) is None  # applied before
        assert got.number == (V_before.number if V_before else 0) + 1
    want = lists.fold_adds(spark.createDataFrame(adds, ADDS)).select(*lists.LIST_COLUMNS)
    key = lambda r: (r["list"], r["key"])
    assert sorted(L.read_lists(spark, root).collect(), key=key) == sorted(want.collect(), key=key)
    before = V.current(spark, root).meta["folders"]
    L.apply_adds(spark, root, spark.createDataFrame([adds[0]], ADDS), "s0", 1)
    after = V.current(spark, root).meta["folders"]
    assert sum(before.get(b) != after[b] for b in after) == 1
    assert L.read_lists(spark, root, 3).agg(F.sum("count")).first()[0] == 150  # a pinned version stays


def test_half_written_batch_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "lists")
    import datetime as dt
    one = spark.createDataFrame([("ip", "k", "a", dt.datetime(2024, 1, 1), 1, None)], ADDS)
    L.apply_adds(spark, root, one, "s", 0)

    def broken(spark_, root_, write_, meta=None):
        write_(root_ + "/v-broken")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(L.V, "publish", broken)
        with pytest.raises(RuntimeError):
            L.apply_adds(spark, root, one, "s", 1)
    assert L.read_lists(spark, root).first()["count"] == 1
    L.apply_adds(spark, root, one, "s", 1)
    assert L.read_lists(spark, root).first()["count"] == 2
    assert L.read_lists(spark, str(tmp_path / "none")).collect() == []


def test_sketches_keep_their_bound_with_a_hot_key(spark):
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("item"),
                                    F.timestamp_micros(F.lit(BASE) + (F.col("id") % 20) * F.lit(H.DAY_US)).alias("ts"))
    sk = H.distinct_sketches(df, "k", "item", "ts", H.DAY_US)
    for days in (1, 7):
        est = {(r["k"], r["bucket"]): r["estimate"] for r in H.sketched_windows(sk, "k", days).collect()}
        rows = df.select("k", "item", F.floor(F.unix_micros("ts") / F.lit(H.DAY_US)).alias("b")).distinct().collect()
        per = {}
        for r in rows:
            per.setdefault((r["k"], r["b"]), set()).add(r["item"])
        for (k, b), e in est.items():
            exact = len(set().union(*[per.get((k, x), set()) for x in range(b - days + 1, b + 1)]))
            assert abs(e - exact) <= max(1, exact * H.SKETCH_BOUND)
    assert max(len(v) for v in per.values()) > 400


class _Held:
    """A list state in memory that counts its round trips."""

    def __init__(self, trips):
        self.rows, self.trips = [], trips

    def _trip(self):
        self.trips.append(1)

    def exists(self):
        self._trip()
        return bool(self.rows)

    def get(self):
        self._trip()
        return iter(list(self.rows))

    def put(self, rows):
        self._trip()
        self.rows = list(rows)

    def appendList(self, rows):
        self._trip()
        self.rows += rows

    def clear(self):
        self._trip()
        self.rows = []


class _Handle:
    def __init__(self):
        self.trips = []

    def getListState(self, name, schema):
        return _Held(self.trips)

    def registerTimer(self, at):
        self.trips.append(1)


class _Until:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_accounts_of_a_group_share_their_round_trips():
    """Each account has its own state, but a batch costs as many accesses for 40 accounts as for one."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        issued = rng.random() < 0.4
        rows.append((pd.Timestamp(int(rng.integers(0, 100)) * 1_000_000, unit="us"), f"a{int(rng.integers(40))}" if i % 50 else None, i,
                     "challenge" if issued else "attempt", str(int(rng.integers(3))), (["SUSPEND", "OTP_REQUIRED"][int(rng.integers(2))]) if issued else None,
                     f"t{i}" if issued else None, 0.5 if issued else None, 0.25 if issued else None))
    events = pd.DataFrame(rows, columns=["event_time", *SS.AccountStates.columns])

    def run(part):
        p, out, h = SS.AccountStates(), [], _Handle()
        p.init(h)
        for ms, until in ((part["event_time"] < pd.Timestamp(50, unit="s"), 30_000), (part["event_time"] >= pd.Timestamp(50, unit="s"), 200_000)):
            if ms.any():
                list(p.handleInputRows((0,), iter([part[ms]]), None))
            out += [f for f in p.handleExpiredTimer((0,), _Until(until), None)]
        return pd.concat(out).astype(object).where(lambda d: d.notna(), None), len(h.trips)

    together, trips = run(events)
    alone = [run(events[events["account_number"].isna() if a is None else events["account_number"] == a]) for a in [None, *sorted(events["account_number"].dropna().unique())]]
    as_rows = lambda d: sorted(map(str, d.itertuples(index=False, name=None)))
    assert as_rows(together) == sorted(r for d, _ in alone for r in as_rows(d))
    assert len(alone) == 41 and trips <= max(t for _, t in alone)


class _Map:
    def __init__(self, trips):
        self.rows, self.trips = {}, trips

    def iterator(self):
        self.trips.append(1)
        return iter(list(self.rows.items()))

    def keys(self):
        self.trips.append(1)
        return iter(list(self.rows))

    def updateValue(self, key, value):
        self.trips.append(1)
        self.rows[key] = value

    def removeKey(self, key):
        self.trips.append(1)
        del self.rows[key]


def test_velocity_keys_of_a_group_share_their_round_trips():
    rng = np.random.default_rng(5)
    us = rng.integers(0, 200, 500) * H.HOUR_US // 4
    keys = [None if k == 0 else int(k) for k in rng.integers(0, 40, 500)]
    events = pd.DataFrame({"event_time": pd.to_datetime(us, unit="us"), "key": pd.Series(keys, dtype=object), "ord": range(500), "any": True, "bad": rng.random(500) < 0.3})
    windows = {"h": ("any", H.HOUR_US), "d": ("bad", H.DAY_US)}

    def run(part):
        ring, h, out = SS.VelocityRing(windows, ["any", "bad"]), _Handle(), []
        h.getMapState = lambda *a: _Map(h.trips)
        ring.init(h)
        for low, high in ((0, 100), (100, 1000)):
            hours = (part["event_time"] - pd.Timestamp(0)) / pd.Timedelta(minutes=15)
            some = part[(hours >= low) & (hours < high)]
            if len(some):
                list(ring.handleInputRows((0,), iter([some]), None))
            out += list(ring.handleExpiredTimer((0,), _Until(high * 900_000 - 1), None))
        return {int(r.ord): (r.h, r.d) for f in out for r in f.itertuples()}, len(h.trips)

    got, trips = run(events)
    bad = events["bad"].to_numpy()
    for i in range(500):
        near = [j for j in range(500) if keys[j] == keys[i] and us[j] < us[i]]
        assert got[i] == (sum(us[j] >= us[i] - H.HOUR_US for j in near), sum(us[j] >= us[i] - H.DAY_US and bad[j] for j in near))
    assert trips < 30
