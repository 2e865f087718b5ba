"""Skew-safe history helpers against brute force, with one hot key and
different partition counts."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from vigil.operators import history as H

HOUR = H.HOUR_US


def _events(spark, n=600, seed=7):
    rng = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    t = t0
    for i in range(n):
        t = t + dt.timedelta(minutes=rng.choice([1, 5, 30, 90, 600]))
        acc = 0 if rng.random() < 0.4 else rng.randint(1, 12)  # account 0 is hot
        rows.append((i, acc, t, rng.choice(["a", "b", "c"]), float(rng.randint(1, 50))))
    return spark.createDataFrame(rows, "id long, acc long, ts timestamp_ntz, kind string, v double")


def _pdf(df):
    return df.toPandas().sort_values("id").reset_index(drop=True)


def test_running_before_matches_bruteforce(spark):
    ev = _events(spark)
    got = _pdf(H.running_before(ev, ["acc"], "ts", "id", F.col("v"), "s"))
    p = _pdf(ev)
    exp = [p[(p.acc == r.acc) & ((p.ts < r.ts) | ((p.ts == r.ts) & (p.id < r.id)))].v.sum() for r in p.itertuples()]
    assert list(got.s) == exp


def test_range_window_matches_bruteforce(spark):
    ev = _events(spark)
    w = 3 * HOUR
    got = _pdf(H.rolling_sums(ev, ["acc"], "ts", "id", {"n": (w, F.lit(1))}))
    p = _pdf(ev)
    us = (p.ts - pd.Timestamp(0)).dt.total_seconds().mul(1e6).round().astype("int64")
    exp = [int(((p.acc == a) & (us >= e - w) & (us <= e - 1)).sum()) for a, e in zip(p.acc, us)]
    assert list(got.n) == exp


def test_last_before_and_next_after(spark):
    ev = _events(spark)
    lb = _pdf(H.last_before(ev, ["acc"], "ts", "id", {"k": F.col("kind")}, "p", cond=F.col("kind") == "a"))
    na = _pdf(H.next_after(ev, ["acc"], "ts", "id", {}, "n"))
    p = _pdf(ev)
    for i, r in p.iterrows():
        prior = p[(p.acc == r.acc) & (p.kind == "a") & ((p.ts < r.ts) | ((p.ts == r.ts) & (p.id < r.id)))]
        exp = None if prior.empty else int(prior.sort_values(["ts", "id"]).id.iloc[-1])
        got = lb.p.iloc[i]
        assert (got is None and exp is None) or got["s"] == exp
        later = p[(p.acc == r.acc) & ((p.ts > r.ts) | ((p.ts == r.ts) & (p.id > r.id)))]
        expn = None if later.empty else int(later.sort_values(["ts", "id"]).id.iloc[0])
        gn = na.n.iloc[i]
        assert (gn is None and expn is None) or gn["s"] == expn


def test_first_seen_and_sessions(spark):
    ev = _events(spark)
    fs = _pdf(H.first_seen(ev, ["acc", "kind"], "ts", "id", "new"))
    p = _pdf(ev)
    firsts = p.sort_values(["ts", "id"]).groupby(["acc", "kind"]).id.first()
    assert set(fs[fs.new].id) == set(firsts.values)
    se = _pdf(H.gap_sessions(ev, ["acc"], "ts", "id", 2 * HOUR))
    for a, g in p.groupby("acc"):
        g = g.sort_values(["ts", "id"])
        gap = g.ts.diff().dt.total_seconds().mul(1e6)
        exp = (gap.isna() | (gap > 2 * HOUR)).cumsum()
        assert list(se.set_index("id").loc[g.id].session_no) == list(exp)


def test_same_result_under_other_partitioning(spark):
    ev = _events(spark)
    a = _pdf(H.running_before(ev, ["acc"], "ts", "id", F.lit(1), "n"))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = _pdf(H.running_before(ev.repartition(7), ["acc"], "ts", "id", F.lit(1), "n"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert list(a.n) == list(b.n)


def test_earlier_at_most_matches_bruteforce(spark):
    ev = _events(spark, n=400, seed=11)
    _check_dominance(_pdf(H.earlier_at_most(ev, ["acc"], "ts", "id", "v", "id")), ev)


def _check_dominance(got, ev):
    p = _pdf(ev)
    for r in p.itertuples():
        prior = p[(p.acc == r.acc) & ((p.ts < r.ts) | ((p.ts == r.ts) & (p.id < r.id)))]
        g = got[got.id == r.id].iloc[0]
        assert g.prior_rows == len(prior)
        assert g.earlier_at_most == int((prior.v <= r.v).sum())


def test_prefix_sum_sorted_hot_group(spark):
    rows = [(i, 0 if i % 3 else i % 7, float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g long, v double")
    got = H.prefix_sum_sorted(df, ["g"], ["v", "id"], F.lit(1), "c", partitions=6).toPandas()
    p = pd.DataFrame(rows, columns=["id", "g", "v"]).sort_values(["g", "v", "id"])
    p["exp"] = p.groupby("g").cumcount()
    m = got.merge(p, on="id")
    assert (m.c == m.exp).all()


def test_distinct_in_window_matches_bruteforce(spark):
    ev = _events(spark, n=500, seed=5)
    ev = ev.unionByName(ev.limit(20).withColumn("id", F.col("id") + 100000))  # same-instant duplicates
    w = 4 * HOUR
    _check_distinct(_pdf(H.distinct_in_window(ev, "acc", "kind", "ts", "id", w, "id", "n")), ev, w)


def _check_distinct(got, ev, w):
    p = _pdf(ev)
    us = (p.ts - pd.Timestamp(0)).dt.total_seconds().mul(1e6).round().astype("int64")
    for i, r in p.iterrows():
        m = (p.acc == r.acc) & (us >= us[i] - w) & (us <= us[i] - 1)
        assert got.set_index("id").loc[r.id, "n"] == p[m].kind.nunique()


def _hot_day(spark):
    """One account with a third of all rows inside one day, and rows with a null account."""
    rng = random.Random(3)
    t0 = dt.datetime(2024, 5, 1)
    rows = [(i, 0 if i % 3 == 0 else (None if i % 17 == 0 else rng.randint(1, 40)), t0 + dt.timedelta(seconds=rng.randrange(86_400)),
             rng.choice(["a", "b", "c", None]), float(rng.randint(1, 9))) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, acc long, ts timestamp_ntz, kind string, v double").repartition(5)


def test_hot_key_inside_one_day_and_null_keys(spark):
    ev = _hot_day(spark)
    p = _pdf(ev)
    acc = p.acc.fillna(-1)
    us = (p.ts - pd.Timestamp(0)).dt.total_seconds().mul(1e6).round().astype("int64").tolist()
    order = list(zip(us, p.id))
    groups = {a: [i for i in range(len(p)) if acc[i] == a] for a in set(acc)}
    before = [[j for j in groups[acc[i]] if order[j] < order[i]] for i in range(len(p))]
    got = _pdf(H.sums_before(ev, ["acc"], ["ts", "id"], {"s": F.col("v"), "n": F.lit(1)}, partitions=9))
    assert list(got.n) == [len(b) for b in before] and list(got.s) == [p.v[b].sum() for b in before]
    last = _pdf(H.last_before(ev, ["acc"], "ts", "id", {}, "p"))
    assert [x and x["s"] for x in last.p] == [p.id[max(b, key=lambda j: order[j])] if b else None for b in before]
    after = [[j for j in groups[acc[i]] if order[j] > order[i]] for i in range(len(p))]
    nxt = _pdf(H.next_after(ev, ["acc"], "ts", "id", {}, "n"))
    assert [x and x["s"] for x in nxt.n] == [p.id[min(b, key=lambda j: order[j])] if b else None for b in after]
    widths = {"a": HOUR, "b": 5 * HOUR}
    roll = _pdf(H.rolling_sums(ev, ["acc"], "ts", "id", {n: (w, F.lit(1)) for n, w in widths.items()}))
    for n, w in widths.items():
        assert list(roll[n]) == [sum(us[i] - w <= us[j] < us[i] for j in groups[acc[i]]) for i in range(len(p))]
    seen = _pdf(H.distinct_in_window(ev, "acc", "kind", "ts", "id", HOUR, "id", "n"))
    assert list(seen.n) == [len({p.kind[j] for j in groups[acc[i]] if us[i] - HOUR <= us[j] < us[i]} - {None}) for i in range(len(p))]
    dom = _pdf(H.earlier_at_most(ev, ["acc"], "ts", "id", "v", "id"))
    assert list(dom.earlier_at_most) == [int((p.v[b] <= p.v[i]).sum()) for i, b in enumerate(before)]


def test_average_of_zeros_has_no_ratio(spark, tmp_path):
    """L4: an account whose purchases so far were all of nothing."""
    from vigil.plans.q_history import q_amount_vs_avg
    rows = [(1, "2024-01-01 00:00:00", 7, "purchase", 0.0, None), (2, "2024-01-02 00:00:00", 7, "purchase", 0.0, None),
            (3, "2024-01-03 00:00:00", 7, "purchase", 9.0, None), (4, "2024-01-04 00:00:00", 7, "purchase", 6.0, None)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string") \
         .withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["tx_amount_vs_historical_avg_ratio"] for r in q_amount_vs_avg(spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 2.0}


def test_distinct_in_window_deals_no_row_ids(spark, monkeypatch):
    """the neighbours of a value are dealt without the row's id, which no segment needs."""
    seen = []
    whole = H.scan.neighbours
    monkeypatch.setattr(H.scan, "neighbours", lambda d, *rest: seen.append(d.columns) or whole(d, *rest))
    df = spark.createDataFrame([("r1", "a", "x", 0, 1), ("r2", "a", "y", 5, 2), ("r3", "a", "x", 9, 3), ("r4", "a", None, 30, 4)],
                               "name string, k string, item string, s int, n int").withColumn("ts", F.timestamp_seconds("s"))
    got = H.distinct_in_window(df, "k", "item", "ts", "n", 10_000_000, "name", "c").collect()
    assert {r["name"]: r["c"] for r in got} == {"r1": 0, "r2": 1, "r3": 2, "r4": 0}
    assert seen == [["k", "item", "ts", "n"]]


def test_distinct_in_windows_of_one_key_share_a_timeline(spark, monkeypatch):
    """windows over one key are one running sum, with the counts of each alone."""
    df = spark.createDataFrame([(i, f"a{i % 3}", f"x{i % 4}", None if i % 5 == 0 else f"y{i % 2}", i * 7 % 40) for i in range(40)],
                               "n long, k string, x string, y string, s int").withColumn("ts", F.timestamp_seconds("s"))
    deals = []
    whole = H.scan.sums_before
    monkeypatch.setattr(H.scan, "sums_before", lambda d, *rest: deals.append(1) or whole(d, *rest))
    both = H.distinct_in_windows(df, "k", "ts", "n", "n", {"cx": ("x", 9_000_000), "cy": ("y", 4_000_000)}).collect()
    assert len(deals) == 1
    rows = df.collect()
    for r in both:
        me = next(x for x in rows if x["n"] == r["n"])
        near = lambda width: [o for o in rows if o["k"] == me["k"] and 0 < me["s"] - o["s"] <= width]
        assert r["cx"] == len({o["x"] for o in near(9)}) and r["cy"] == len({o["y"] for o in near(4)} - {None})
    assert len(both) == len(rows)


def test_what_a_match_is_made_of_is_not_written(spark, monkeypatch):
    """The struct that is carried is made after the deal; only what was found is written."""
    from vigil.functions import scan
    rows = [(k, t, t * 10 + (k or 0) if t % 3 == 0 else None) for k in (1, 2, None) for t in range(40)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    written, plain = [], scan.materialize
    monkeypatch.setattr(scan, "materialize", lambda d, name: written.append(d.columns) or plain(d, name))
    for inclusive in (False, True):
        got = scan.last_match(df, ["k"], ["t"], F.when(F.col("v").isNotNull(), F.struct("t", "v")), "m", inclusive)
        assert got.columns == ["k", "t", "v", "m"]
        for r in got.collect():
            hits = [x for x in rows if x[0] == r["k"] and x[2] is not None and (x[1] < r["t"] or inclusive and x[1] == r["t"])]
            assert (r["m"] and tuple(r["m"])) == (hits[-1][1:] if hits else None)
    assert len(written) == 2 and all("_ref" not in c for c in written)
