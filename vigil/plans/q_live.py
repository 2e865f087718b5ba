"""Queries: features, sessions and account state on streams that arrive out of
order, late messages and sketched counts (L, H, S10).

A feed is the given rows as JSON messages in order of arrival: the event time
plus a delay drawn from the row's id, shorter than the watermark's delay. A
heartbeat after the last message moves the watermark past all of them.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vigil import bindings
from vigil.functions import epoch_us, hash_uniform
from vigil.operators import accounts as A
from vigil.operators import history as H
from vigil.plans import detect
from vigil.plans import q_accounts as QA
from vigil.plans import q_history as QH
from vigil.session import materialize
from vigil.sources import files as IO
from vigil.streaming import late, sessions as SE, state as SS, stream as ST

DELAY = "1 day"
JITTER_US = 20 * H.HOUR_US
D = f"WITH d AS {detect.DETECTIONS_SQL} "


def _arrives(time_us, key, jitter_us=JITTER_US):
    return F.timestamp_micros((time_us + hash_uniform("arrives", key) * F.lit(jitter_us)).cast("bigint"))


def _feed(rows, folder, heartbeat=None):
    """``rows(t, value)`` in order of t, then the heartbeat. Returns the files to read a trigger."""
    rows = materialize(rows, "feed")
    n = rows.count()
    IO.publish_in_time_order(rows, folder, "t", IO.slices_for(n))
    if heartbeat is not None:
        rows.sparkSession.createDataFrame([(json.dumps(heartbeat),)], "value string").coalesce(1).write.mode("append").text(folder)
    return IO.files_per_batch(n)


def _read(spark, folder, schema, max_files=None):
    """``max_files`` a trigger; without it all there are."""
    source = spark.readStream if max_files is None else spark.readStream.option("maxFilesPerTrigger", max_files)
    raw = source.text(folder)
    return raw.select(F.from_json("value", schema).alias("e")).select("e.*")


EVENT = "event_id long, account long, ts_us long, event_type string, amount double, device int"


def _event_feed(spark, sf):
    """The events as (t, value) and the time of a heartbeat three days after the last."""
    ev = bindings.session_events(spark, sf).withColumn("ts_us", epoch_us("ts"))
    value = F.to_json(F.struct("event_id", "account", "ts_us", "event_type", "amount", "device"))
    feed = materialize(ev.select(_arrives(F.col("ts_us"), F.col("event_id")).alias("t"), "ts_us", value.alias("value")), "feed")
    last = feed.agg(F.max("ts_us")).first()[0] or 0
    return feed.select("t", "value"), {"ts_us": last + 3 * H.DAY_US}


def q_stream_sessions(spark, sf):
    """L14 on a stream: closed sessions by session windows, numbered when read back."""
    base = IO.scratch_dir(spark, "sessions")
    feed, beat = _event_feed(spark, sf)
    files = _feed(feed, base + "/in", beat)
    ev = _read(spark, base + "/in", EVENT, files).withColumn("event_time", F.timestamp_micros("ts_us"))
    aggregates = QH.session_aggregates() | {"n_devices": F.size(F.collect_set("device")).cast("bigint")}
    ST.run_available_now(SE.closed_sessions(ev, "account", QH.SESSION_GAP, DELAY, aggregates), "parquet", base + "/out", base + "/ckpt")
    closed = spark.read.parquet(base + "/out")
    closed = closed.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
    numbered = H.sums_before(closed, ["account"], ["session_start"], {"_n": F.lit(1)}).withColumn("session_no", (F.col("_n") + 1).cast("bigint"))
    return QH.session_columns(numbered)


WINDOWS = {"velocity_6h": ("any", 6 * H.HOUR_US), "velocity_24h": ("any", H.DAY_US), "velocity_4w": ("any", 28 * H.DAY_US),
           "txn_frequency_1h": ("purchase", H.HOUR_US), "txn_frequency_24h": ("purchase", H.DAY_US), "failed_tx_count_1h": ("failed", H.HOUR_US)}


def q_stream_velocity(spark, sf):
    """L1-L3 on a stream, stopped after half of the feed and started again:
    per event the counts of its account's earlier events."""
    base = IO.scratch_dir(spark, "velocity")
    feed, beat = _event_feed(spark, sf)
    feed = materialize(feed, "feed")
    half = feed.agg(F.percentile_approx(F.unix_micros("t"), 0.5)).first()[0] or 0
    for part, heartbeat in ((F.unix_micros("t") <= half, None), (F.unix_micros("t") > half, beat)):
        files = _feed(feed.where(part), base + "/in", heartbeat)
        ev = _read(spark, base + "/in", EVENT, files).withColumn("event_time", F.timestamp_micros("ts_us"))
        ev = ev.withColumns({"any": F.lit(True), "purchase": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error"})
        ST.run_available_now(SS.rolling_counts(ev, "account", "event_id", WINDOWS, DELAY), "parquet", base + "/out", base + "/ckpt")
    return spark.read.parquet(base + "/out").select("event_id", "account", *WINDOWS)


_KIND_SQL = {"any": "true", "purchase": "event_type = 'purchase'", "failed": "event_type = 'error'"}
SQL_STREAM_VELOCITY = f"WITH ev AS {bindings.EVENTS_SQL} SELECT event_id, account, " + ", ".join(
    f"""count(*) FILTER (WHERE {_KIND_SQL[kind]}) OVER (PARTITION BY account ORDER BY epoch_us(ts)
  RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING) AS {name}""" for name, (kind, width) in WINDOWS.items()) + " FROM ev"


def _account_rows(spark, sf):
    det = materialize(detect.detections(spark, sf), "detections")
    ch = materialize(A.challenges(det), "challenges")
    return det, ch, QA.attempts_from(ch)


def q_stream_account_state(spark, sf):
    """H1 + H3 on a stream: challenges and attempts in any order within the
    delay, through keyed state; the accounts still suspended at the end."""
    base = IO.scratch_dir(spark, "acct")
    det, ch, attempts = _account_rows(spark, sf)
    chal = ch.join(det.select("transaction_id", "action", "ato_probability", "behavioral_anomaly_score"), "transaction_id").select(
        F.lit("challenge").alias("kind"), "account_number", F.col("issued_ts").alias("at"), F.col("cseq").alias("ord"), "otp",
        "action", "transaction_id", "ato_probability", "behavioral_anomaly_score")
    att = attempts.select(F.lit("attempt").alias("kind"), "account_number", F.col("attempt_ts").alias("at"),
                          (F.lit(A.ORD_SHIFT) + F.col("attempt_seq")).alias("ord"), "otp")
    evs = chal.unionByName(att, allowMissingColumns=True).withColumn("ts", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    value = F.to_json(F.struct(*[c.split()[0] for c in SS.EVENT_SCHEMA.split(", ")])).alias("value")
    feed = evs.select(_arrives(epoch_us("at"), F.concat_ws(":", "kind", "ord")).alias("t"), value)
    files = _feed(feed, base + "/in", {"kind": "heartbeat", "ts": "2100-01-01 00:00:00"})
    ST.run_available_now(SS.account_state(_read(spark, base + "/in", SS.EVENT_SCHEMA, files), DELAY), "parquet", base + "/out", base + "/ckpt")
    out = spark.read.parquet(base + "/out")
    last = out.groupBy("account_number").agg(F.max_by(F.struct(*[c for c in out.columns if c != "account_number"]), "as_of").alias("s"))
    return last.where("s.suspended").select(
        "account_number", F.col("s.suspension_time").cast("timestamp_ntz").alias("suspension_time"),
        F.col("s.transaction_id").alias("transaction_id"), F.col("s.ato_probability").alias("ato_probability"),
        F.col("s.behavioral_anomaly_score").alias("behavioral_anomaly_score"), F.lit("SUSPENDED").alias("status"))


def q_stream_verify(spark, sf):
    """H3 as a join of two streams: each attempt with the challenge live at
    its time (at most two days old), both feeds out of order."""
    base = IO.scratch_dir(spark, "otp")
    _, ch, attempts = _account_rows(spark, sf)
    far = 4_102_444_800_000_000  # 2100
    chal = ch.select("account_number", epoch_us("issued_ts").alias("at"), "cseq", "otp")
    c_files = _feed(
        chal.select(_arrives(F.col("at"), F.col("cseq")).alias("t"), F.to_json(F.struct(*chal.columns)).alias("value")), base + "/challenges",
        {"account_number": "heartbeat", "at": far})  # an account, or the join's own null filter takes it away
    att = attempts.select("attempt_id", "account_number", epoch_us("attempt_ts").alias("at"), (F.lit(A.ORD_SHIFT) + F.col("attempt_seq")).alias("ord"), "otp")
    a_files = _feed(
        att.select(_arrives(F.col("at"), F.col("attempt_id")).alias("t"), F.to_json(F.struct(*att.columns)).alias("value")), base + "/attempts",
        {"account_number": "heartbeat", "at": far, "otp": "0000"})
    c = _read(spark, base + "/challenges", "account_number string, at long, cseq long, otp string", c_files).withColumn("issued_ts", F.timestamp_micros("at"))
    a = _read(spark, base + "/attempts", "attempt_id string, account_number string, at long, ord long, otp string", a_files).withColumn("attempt_ts", F.timestamp_micros("at"))
    met = SE.live_challenges(a.drop("at"), c.drop("at"), "2 DAYS", DELAY)
    ST.run_available_now(met, "parquet", base + "/out", base + "/ckpt")
    at = spark.read.parquet(base + "/out").where("attempt_id IS NOT NULL")
    return A.first_right(at.withColumn("attempt_ts", F.col("attempt_ts").cast("timestamp_ntz")))


# ---- S10: late messages -------------------------------------------------------

LATE_DELAY, LATE_JITTER_US = "2 days", 36 * H.HOUR_US


def _late_feed(spark, sf):
    """Transactions out of order; every tenth delivered again an hour after,
    every 97th only after all others. Returns the folder of the split feed."""
    base = IO.scratch_dir(spark, "late")
    det = materialize(detect.detections(spark, sf), "detections")
    msg = det.select("transaction_id", F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss").alias("transaction_ts"), "txn_seq")
    at = _arrives(epoch_us(F.to_timestamp("transaction_ts")), F.col("txn_seq"), LATE_JITTER_US)
    value = F.to_json(F.struct("transaction_id", "transaction_ts")).alias("value")
    held = F.col("txn_seq") % 97 == 0
    first = msg.where(~held).select(at.alias("t"), value)
    again = msg.where(~held & (F.col("txn_seq") % 10 == 0)).select((at + F.expr("INTERVAL 1 HOUR")).alias("t"), value)

    def keep(batch, batch_id):
        batch.select("transaction_id").write.mode("overwrite").parquet(f"{base}/done/batch={batch_id}")

    def run(files: int | None) -> None:
        m = ST.with_event_time(_read(spark, base + "/in", "transaction_id string, transaction_ts string", files))
        ST.run_available_now(m, None, None, base + "/ckpt", foreach_batch=late.split_batches(base + "/split", "transaction_id", LATE_DELAY, keep))

    run(_feed(first.unionByName(again), base + "/in"))
    msg.where(held).select(value).write.mode("append").text(base + "/in")
    run(None)  # a batch of its own after all others
    return base


def q_late_messages(spark, sf):
    """What became of each message: processed, or kept as late."""
    base = _late_feed(spark, sf)
    done = spark.read.parquet(base + "/done").select("transaction_id", F.lit("processed").alias("fate"))
    return done.unionByName(spark.read.parquet(base + "/split/late").select("transaction_id", F.lit("late").alias("fate")))


def q_feed_counts(spark, sf):
    """Processed + duplicate + late is what was sent."""
    return late.totals(spark, _late_feed(spark, sf) + "/split").withColumn("sent", F.col("processed") + F.col("duplicate") + F.col("late"))


_FATES = """, f AS (SELECT transaction_id, txn_seq, CASE WHEN txn_seq % 97 = 0
   AND transaction_ts <= (SELECT max(transaction_ts) FROM d WHERE txn_seq % 97 <> 0) - INTERVAL 2 DAY THEN 'late' ELSE 'processed' END AS fate FROM d)"""
SQL_LATE_MESSAGES = D + _FATES + " SELECT transaction_id, fate FROM f"
SQL_FEED_COUNTS = D + _FATES + """ SELECT count(*) FILTER (fate = 'processed') AS processed, count(*) FILTER (txn_seq % 10 = 0 AND txn_seq % 97 <> 0) AS duplicate,
  count(*) FILTER (fate = 'late') AS late, count(*) + count(*) FILTER (txn_seq % 10 = 0 AND txn_seq % 97 <> 0) AS sent FROM f"""


# ---- L7 by sketches -----------------------------------------------------------

SKETCH_DAYS = 28


def q_distinct_sketch(spark, sf):
    """L7 by mergeable sketches: per device and day the number of distinct
    accounts of the last 28 days, and whether the estimate keeps its bound."""
    ev = bindings.session_events(spark, sf).where("device IS NOT NULL")
    sketches = materialize(H.distinct_sketches(ev, "device", "account", "ts", H.DAY_US), "sketches")
    est = H.sketched_windows(sketches, "device", SKETCH_DAYS)
    exact = (ev.select("device", "account", F.floor(epoch_us("ts") / F.lit(H.DAY_US)).alias("b")).distinct()
             .withColumn("bucket", F.explode(F.sequence(F.col("b"), F.col("b") + SKETCH_DAYS - 1)))
             .groupBy("device", "bucket").agg(F.countDistinct("account").alias("accounts")))
    both = est.join(exact, ["device", "bucket"])
    return both.select("device", F.col("bucket").alias("day"), F.col("accounts").cast("bigint").alias("accounts"),
                       (F.abs(F.col("estimate") - F.col("accounts")) <= F.ceil(F.col("accounts") * H.SKETCH_BOUND)).alias("within"))


SQL_DISTINCT_SKETCH = f"""WITH ev AS {bindings.EVENTS_SQL}, o AS (SELECT DISTINCT device, account, CAST(floor(epoch_us(ts) / {H.DAY_US}.0) AS BIGINT) AS b
  FROM ev WHERE device IS NOT NULL), days AS (SELECT DISTINCT device, b AS day FROM o)
SELECT days.device, day, count(DISTINCT account) AS accounts, true AS within
FROM days JOIN o ON o.device = days.device AND o.b BETWEEN day - {SKETCH_DAYS - 1} AND day GROUP BY days.device, day"""

REGISTRY = {
    "l14_stream_sessions": (q_stream_sessions, QH.SQL_SESSIONS),
    "l1_l3_stream_velocity": (q_stream_velocity, SQL_STREAM_VELOCITY),
    "h1_h3_stream_account_state": (q_stream_account_state, QA.SQL_SUSPENDED),
    "h3_stream_join": (q_stream_verify, QA.SQL_VERIFY),
    "s10_late_messages": (q_late_messages, SQL_LATE_MESSAGES),
    "s10_feed_counts": (q_feed_counts, SQL_FEED_COUNTS),
    "l7_distinct_sketch": (q_distinct_sketch, SQL_DISTINCT_SKETCH),
}
