"""Queries: file sources and sinks (A) and Structured Streaming (S).

Each query writes its inputs/outputs under a fresh folder inside the
shared checkpoint folder, runs its stream with ``availableNow`` and
returns the sink read back, so the result can be checked like a batch.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from vigil import bindings
from vigil.operators import lists
from vigil.plans import detect
from vigil.plans.q_accounts import SQL_FOLD
from vigil.plans.q_clean import SQL_PROCESSED, processed
from vigil.plans import q_sampling as QS
from vigil.plans.q_sampling import NUMS, SEED, labelled
from vigil.plans.sqltext import sround
from vigil.session import materialize
from vigil.sources import files as IO
from vigil.sources import list_table
from vigil.sources import versions as V
from vigil.sources.tables import table
from vigil.streaming import stream as ST

STAMP = "2024-06-01T00:00:00"
D = f"WITH d AS {detect.DETECTIONS_SQL} "
MSG_FIELDS = ["transaction_id", "account_number", "ip_country", "ip_address", "device_id", "beneficiary_account",
              "ip_fraud_score", "ip_blacklisted", "new_device", "new_location", "beneficiary_blacklisted",
              "failed_auth_attempts", "actual_is_ato"]


def _publish(spark, sf, folder, behaviour="behavioral_anomaly_score"):
    det = materialize(detect.detections(spark, sf), "detections")
    msgs = det.select(*MSG_FIELDS, F.col(behaviour).alias("behavioral_anomaly_score"),
                      F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss").alias("transaction_ts"), "txn_seq")
    IO.publish_messages(msgs.drop("txn_seq"), folder, STAMP, IO.slices_for(det.count()), order=["transaction_ts", "transaction_id"])
    return det


# --- A: files -------------------------------------------------------------------

CSV_A = ["application_id", "fraud_bool", "name_email_similarity", "customer_age", "payment_type"]
CSV_B = ["application_id", "fraud_bool", "device_os", "source", "month"]


def q_csv_folder(spark, sf):
    """A1: applications exported as CSVs with two different headers, read
    back as one frame (columns of the other group are null)."""
    apps = bindings.applications(spark, sf)
    folder = IO.scratch_dir(spark, "csv")
    IO.write_csv(apps.where(F.col("application_id") % 2 == 0).select(*CSV_A), folder + "/a")
    IO.write_csv(apps.where(F.col("application_id") % 2 == 1).select(*CSV_B), folder + "/b")
    parts = [IO.read_csv_folder(spark, folder + "/a")[0], IO.read_csv_folder(spark, folder + "/b")[0]]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return both.select(F.col("application_id").cast("bigint"), F.col("fraud_bool").cast("int"),
                       F.col("name_email_similarity").cast("double"), F.col("customer_age").cast("int"),
                       "payment_type", "device_os", "source", F.col("month").cast("int"))


SQL_CSV_FOLDER = f"""WITH ap AS {bindings.APPS_SQL}
SELECT application_id, fraud_bool, CASE WHEN application_id % 2 = 0 THEN name_email_similarity END AS name_email_similarity,
  CASE WHEN application_id % 2 = 0 THEN customer_age END AS customer_age,
  CASE WHEN application_id % 2 = 0 THEN payment_type END AS payment_type,
  CASE WHEN application_id % 2 = 1 THEN device_os END AS device_os,
  CASE WHEN application_id % 2 = 1 THEN source END AS source,
  CASE WHEN application_id % 2 = 1 THEN month END AS month FROM ap"""


def q_write_table(spark, sf):
    """A2: the processed table written as parquet and read back."""
    path = IO.scratch_dir(spark, "processed")
    IO.write_table(processed(spark, sf), path)
    return spark.read.parquet(path)


def q_list_documents(spark, sf):
    """A4 → A3 → G7: lists published as JSON documents per list, once in
    part and then whole, read back and flattened to rows."""
    ls = materialize(lists.fold_adds(lists.fan_out_adds(detect.detections(spark, sf).where("ato_confirmed"))).drop("first_listed"), "lists")
    root = IO.scratch_dir(spark, "lists")
    IO.publish_lists(ls.where("list = 'ip'"), root)
    IO.publish_lists(ls, root)
    return IO.read_published_lists(spark, root)


SQL_LIST_DOCUMENTS = SQL_FOLD.replace("SELECT list, key, count(*) AS count", "SELECT list, key, CAST(count(*) AS BIGINT) AS count").replace(
    "max(ts) AS last_updated", "strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_updated")


def q_publish(spark, sf):
    """Transactions published as JSON messages and read back."""
    folder = IO.scratch_dir(spark, "msgs")
    tx = bindings.transactions(spark, sf).select("transaction_id", "account_number", "transaction_amount",
                                                 "behavioral_anomaly_score")
    IO.publish_messages(tx, folder, STAMP, files=IO.slices_for(table(spark, sf, "orders").count()))
    return spark.read.schema("transaction_id string, account_number string, transaction_amount double, "
                             "behavioral_anomaly_score double, streamed_at string").json(folder)


SQL_PUBLISH = f"""WITH tx AS {bindings.TXN_SQL} SELECT transaction_id, account_number, transaction_amount,
  behavioral_anomaly_score, '{STAMP}' AS streamed_at FROM tx"""


def q_newest(spark, sf):
    e = table(spark, sf, "events")
    return IO.newest(e.select("event_id", "ts", "user_id", "event_type"), 10000, "ts", "event_id")


SQL_NEWEST = "SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000"


def q_first_rows(spark, sf):
    o = table(spark, sf, "orders")
    return IO.first_rows(o.select("o_orderkey", "o_custkey", "o_totalprice"), 1000, "o_orderkey")


SQL_FIRST_ROWS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000"


def export_balanced(spark, sf, path):
    """A10: train set imputed, scaled, SMOTE-balanced and scaled back to
    original units (D1 → D2 → C4-C7 → D3), written next to the holdout
    with its target; partitioned by part."""
    from vigil.operators import preprocess as P
    from vigil.operators import sampling as C
    sp = C.stratified_split(labelled(spark, sf), "is_ato", "application_id", 0.2, SEED)
    train, test = sp.where(~F.col("is_test")), sp.where("is_test")
    med = P.exact_medians(train, NUMS)
    st = P.scaling_stats(P.impute(train, med), NUMS)
    tr = P.scale(P.impute(train, med), st).withColumn("vec", F.array(*[F.col(c) for c in NUMS]))
    plan = C.smote_plan(tr, "is_ato", 1.0, 5).first()
    out = tr.select("application_id", "is_ato", *NUMS, F.lit(False).alias("synthetic"))
    if plan["run"]:
        mi = tr.where("is_ato = 1").select(F.col("application_id").alias("id"), "vec")
        nn = C.knn(mi, "id", "vec", int(plan["k"]))
        syn = C.smote_synthesize(mi, nn, "id", "vec", int(plan["n_new"]), int(plan["k"]), SEED)
        syn = syn.select((-1 - F.col("draw")).alias("application_id"), F.lit(1).alias("is_ato"),
                         *[F.col("vec")[i].alias(c) for i, c in enumerate(NUMS)], F.lit(True).alias("synthetic"))
        out = out.unionByName(syn)
    train_out = P.unscale(out, st).withColumn("part", F.lit("train"))
    hold = test.select("application_id", "is_ato", *[F.col(c).cast("double").alias(c) for c in NUMS],
                       F.lit(False).alias("synthetic"), F.lit("holdout").alias("part"))
    IO.write_table(train_out.unionByName(hold), path, ["part"])
    return plan


def q_export_holdout(spark, sf):
    """A10: the holdout read back from the export."""
    path = IO.scratch_dir(spark, "export")
    export_balanced(spark, sf, path)
    return spark.read.parquet(path).where("part = 'holdout'").select("application_id", "is_ato", *NUMS)


def q_export_train_balance(spark, sf):
    """A10 + J7: class balance of the exported train set."""
    from vigil.operators import evaluate
    path = IO.scratch_dir(spark, "export")
    export_balanced(spark, sf, path)
    tr = spark.read.parquet(path).where("part = 'train'")
    return evaluate.class_balance(tr, "is_ato").crossJoin(
        tr.agg(F.count_if("synthetic").cast("bigint").alias("synthetic_rows")))


SQL_EXPORT_HOLDOUT = QS.AP + QS.SPLIT + f" SELECT application_id, is_ato, {', '.join(NUMS)} FROM sp WHERE is_test"
SQL_EXPORT_TRAIN_BALANCE = QS.AP + QS.SPLIT + """, tr AS (SELECT is_ato FROM sp WHERE NOT is_test),
 c AS (SELECT count_if(is_ato = 0) AS neg, count_if(is_ato = 1) AS pos FROM tr)
SELECT CAST(2 * neg AS BIGINT) AS rows, CAST(neg AS BIGINT) AS positives,
  CAST(CASE WHEN neg > 0 THEN 50.0 ELSE 0.0 END AS DOUBLE) AS pct_positive, CAST(neg - pos AS BIGINT) AS synthetic_rows FROM c"""


# --- S: streams -------------------------------------------------------------------

def _alerts_dir(spark, sf, runs=1, max_files=None):
    base = IO.scratch_dir(spark, "stream")
    _publish(spark, sf, base + "/in")
    for _ in range(runs):
        m = ST.read_messages(spark, base + "/in", max_files)
        out = ST.alerts(ST.score(ST.good(m)))
        ST.run_available_now(out, "json", base + "/alerts", base + "/ckpt")
    return base


def _read_alerts(spark, base):
    return spark.read.schema("transaction_id string, action string, ato_probability double").json(base + "/alerts")


def q_stream_alerts(spark, sf):
    """A5 → S1 → S2 → A6: score the message stream, forward non-ALLOW."""
    return _read_alerts(spark, _alerts_dir(spark, sf))


SQL_STREAM_ALERTS = D + "SELECT transaction_id, action, ato_probability FROM d WHERE action <> 'ALLOW'"


STREAM_FEATURES = ["ip_fraud_score", "failed_auth_attempts", "behavioral_anomaly_score"]


def q_stream_model(spark, sf):
    """S1 with a saved model: the pipeline is fitted on the labelled log,
    saved, loaded and scores the message stream; each probability is compared
    with the batch score of the same transaction."""
    from vigil.operators import models as M
    base = IO.scratch_dir(spark, "model-stream")
    det = _publish(spark, sf, base + "/in")
    train = det.where(F.col("actual_is_ato").isNotNull()).withColumn("label", F.col("actual_is_ato").cast("double"))
    fitted = M.tabular_pipeline(STREAM_FEATURES, M.gbt(trees=10, depth=4, gamma=0.0), impute_scale=True).fit(train)
    fitted.write().overwrite().save(base + "/model")
    loaded = PipelineModel.load(base + "/model")
    scored = ST.score(ST.good(ST.read_messages(spark, base + "/in")), loaded, STREAM_FEATURES)
    ST.run_available_now(scored.select("transaction_id", "action", "ato_probability"), "parquet", base + "/out", base + "/ckpt")
    live = spark.read.schema("transaction_id string, action string, ato_probability double").parquet(base + "/out")
    batch = M.score(fitted, det.select("transaction_id", *STREAM_FEATURES), STREAM_FEATURES, out="p")
    return batch.join(live, "transaction_id").select("transaction_id", (F.round("p", 4) == F.col("ato_probability")).alias("same"))


SQL_STREAM_MODEL = D + "SELECT transaction_id, true AS same FROM d"


def q_stream_resume(spark, sf):
    """A second run on the same checkpoint adds nothing."""
    return _read_alerts(spark, _alerts_dir(spark, sf, runs=2))


def q_dead_letter(spark, sf):
    """S3: malformed messages go to the dead-letter sink; the stream goes on."""
    base = IO.scratch_dir(spark, "dlq")
    det = _publish(spark, sf, base + "/in")
    bad = det.where(F.col("txn_seq") % 50 == 0).select(
        F.concat(F.lit('{"transaction_id": "'), F.col("transaction_id"), F.lit('", broken')).alias("value"))
    bad.write.mode("append").text(base + "/in")
    m = ST.read_messages(spark, base + "/in")
    ST.run_available_now(ST.dead_letters(m), "json", base + "/dlq", base + "/ckpt_dlq")
    return spark.read.schema("raw string").json(base + "/dlq")


SQL_DEAD_LETTER = D + """SELECT '{"transaction_id": "' || transaction_id || '", broken' AS raw FROM d WHERE txn_seq % 50 = 0"""


def q_callback(spark, sf):
    """Alert text per result via foreachBatch."""
    base = IO.scratch_dir(spark, "cb")
    _publish(spark, sf, base + "/in")
    m = ST.read_messages(spark, base + "/in")
    ST.run_available_now(ST.alerts(ST.score(ST.good(m))), None, None, base + "/ckpt",
                         foreach_batch=ST.alert_callback(base + "/out"))
    return spark.read.text(base + "/out").select(F.col("value").alias("line"))


SQL_CALLBACK = D + """SELECT printf('[ALERT] %s | %s | account=%s | p=%s', transaction_id, action, account_number,
  printf('%.4f', ato_probability)) AS line FROM d WHERE action <> 'ALLOW'"""


def q_paced(spark, sf):
    """Replay one file per trigger; every file is one micro-batch. The callback counts its
    messages in one stage, as a file is one task."""
    base = IO.scratch_dir(spark, "paced")
    _publish(spark, sf, base + "/in")
    m = ST.read_messages(spark, base + "/in", max_files=1)

    def cb(batch, batch_id):
        batch.coalesce(1).groupBy().count().withColumn("batch_id", F.lit(batch_id)) \
             .write.mode("overwrite").parquet(f"{base}/counts/b={batch_id}")
    ST.run_available_now(ST.good(m), None, None, base + "/ckpt", foreach_batch=cb)
    c = spark.read.parquet(base + "/counts")
    return c.agg(F.countDistinct("batch_id").cast("bigint").alias("batches"),
                 F.sum("count").cast("bigint").alias("messages"))


SQL_PACED = D + f"""SELECT CAST(least(count(*), greatest(4, ceil(count(*) / {IO.SLICE_ROWS}.0))) AS BIGINT) AS batches,
  count(*) AS messages FROM d"""


def q_running_totals(spark, sf):
    """Running totals of sent and failed messages (complete mode)."""
    base = IO.scratch_dir(spark, "totals")
    det = _publish(spark, sf, base + "/in")
    det.where(F.col("txn_seq") % 50 == 0).select(F.lit("{broken").alias("value")).write.mode("append").text(base + "/in")
    m = ST.read_messages(spark, base + "/in", max_files=max(2, IO.files_per_batch(det.count())))
    st = m.select(F.when(F.col("_corrupt_record").isNull(), F.lit("sent")).otherwise(F.lit("failed")).alias("status"))
    agg = st.groupBy("status").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    ST.run_available_now(agg, None, None, base + "/ckpt", mode="complete",
                         foreach_batch=ST.counts_callback(base + "/out"))
    return spark.read.parquet(base + "/out")


SQL_RUNNING_TOTALS = D + """SELECT 'sent' AS status, count(*) AS n FROM d
UNION ALL SELECT 'failed', count(*) FROM d WHERE txn_seq % 50 = 0"""


def q_action_counts(spark, sf):
    """Running action counts (complete mode)."""
    base = IO.scratch_dir(spark, "actions")
    det = _publish(spark, sf, base + "/in")
    m = ST.score(ST.good(ST.read_messages(spark, base + "/in", max_files=max(2, IO.files_per_batch(det.count())))))
    agg = m.groupBy("action").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    ST.run_available_now(agg, None, None, base + "/ckpt", mode="complete",
                         foreach_batch=ST.counts_callback(base + "/out"))
    return spark.read.parquet(base + "/out")


SQL_ACTION_COUNTS = D + "SELECT action, count(*) AS n FROM d GROUP BY action"


def q_window_counts(spark, sf, slide: str | None = None):
    """S8 windowed: actions per 30-day event-time window (tumbling, or
    sliding by ``slide``) with a 2-day watermark over a time-ordered feed
    (update mode; the latest count per window is kept)."""
    base = IO.scratch_dir(spark, "win")
    det = materialize(detect.detections(spark, sf), "detections")
    msg = det.select(*MSG_FIELDS, "behavioral_anomaly_score",
                     F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss").alias("transaction_ts"))
    IO.publish_in_time_order(msg.select(F.to_timestamp("transaction_ts").alias("t"),
                                        F.to_json(F.struct(*msg.columns)).alias("value")), base + "/in", "t", IO.slices_for(det.count()))
    m = ST.with_event_time(ST.score(ST.good(ST.read_messages(spark, base + "/in", max_files=IO.files_per_batch(det.count())))))
    agg = (m.withWatermark("event_time", REDELIVERY_DELAY)
           .groupBy(F.window("event_time", "30 days", slide), "action").agg(F.count(F.lit(1)).cast("bigint").alias("n")))

    def cb(batch, batch_id):
        batch.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "action", "n",
                     F.lit(batch_id).alias("batch_id")).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")
    ST.run_available_now(agg, None, None, base + "/ckpt", mode="update", foreach_batch=cb)
    r = spark.read.parquet(base + "/out")
    return r.groupBy("window_start", "action").agg(F.max_by("n", "b").alias("n"))


def q_sliding_counts(spark, sf):
    return q_window_counts(spark, sf, slide="10 days")


SQL_SLIDING_COUNTS = D + """SELECT window_start, action, count(*) AS n FROM (
  SELECT action, unnest([time_bucket(INTERVAL '10 days', transaction_ts, TIMESTAMP '1970-01-01'),
                         time_bucket(INTERVAL '10 days', transaction_ts, TIMESTAMP '1970-01-01') - INTERVAL 10 DAY,
                         time_bucket(INTERVAL '10 days', transaction_ts, TIMESTAMP '1970-01-01') - INTERVAL 20 DAY]) AS window_start
  FROM d) w GROUP BY ALL"""


SQL_WINDOW_COUNTS = D + """SELECT time_bucket(INTERVAL '30 days', transaction_ts, TIMESTAMP '1970-01-01') AS window_start, action,
  count(*) AS n FROM d GROUP BY ALL"""


def q_stream_lists(spark, sf):
    """Each micro-batch's confirmed frauds merged into the stored list
    table, and the last batch delivered once more."""
    base = IO.scratch_dir(spark, "lists")
    det = _publish(spark, sf, base + "/in")
    merge, seen = ST.list_upsert_callback(base + "/table"), []

    def cb(batch, batch_id):
        merge(batch, batch_id)
        merge(batch, batch_id)
        seen.append(batch_id)
    m = ST.with_event_time(ST.good(ST.read_messages(spark, base + "/in", max_files=IO.files_per_batch(det.count()))))
    ST.run_available_now(m, None, None, base + "/ckpt", foreach_batch=cb)
    assert len(V.versions(spark, base + "/table")) == len(seen)  # a repeated batch is no version
    return list_table.read_lists(spark, base + "/table")


REDELIVERY_DELAY = "2 days"


def q_dedupe(spark, sf):
    """A redelivered message (same id, arriving right after the
    original) is scored once; the watermark keeps 2 days of ids in state."""
    base = IO.scratch_dir(spark, "dedupe")
    det = materialize(detect.detections(spark, sf), "detections")
    msg = det.select(*MSG_FIELDS, "behavioral_anomaly_score",
                     F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss").alias("transaction_ts"),
                     F.lit(STAMP).alias("streamed_at"), "txn_seq")
    feed = msg.unionByName(msg.where(F.col("txn_seq") % 10 == 0))  # every 10th message twice
    IO.publish_in_time_order(feed.select(F.to_timestamp("transaction_ts").alias("t"),
                                         F.to_json(F.struct(*[c for c in msg.columns if c != "txn_seq"])).alias("value")),
                             base + "/in", "t", IO.slices_for(det.count()))
    m = ST.dedupe(ST.with_event_time(ST.good(ST.read_messages(spark, base + "/in", max_files=IO.files_per_batch(det.count())))), REDELIVERY_DELAY)
    out = ST.score(m).select("transaction_id", "action")
    ST.run_available_now(out, "parquet", base + "/out", base + "/ckpt")
    return spark.read.parquet(base + "/out")


SQL_DEDUPE = D + "SELECT transaction_id, action FROM d"

REGISTRY = {
    "a1_csv_folder": (q_csv_folder, SQL_CSV_FOLDER),
    "a2_write_table": (q_write_table, SQL_PROCESSED),
    "a3_a4_g7_list_documents": (q_list_documents, SQL_LIST_DOCUMENTS),
    "a7_publish_messages": (q_publish, SQL_PUBLISH),
    "a8_newest_buffer": (q_newest, SQL_NEWEST),
    "a9_first_rows": (q_first_rows, SQL_FIRST_ROWS),
    "a10_export_holdout": (q_export_holdout, SQL_EXPORT_HOLDOUT),
    "a10_export_train_balance": (q_export_train_balance, SQL_EXPORT_TRAIN_BALANCE),
    "s1_s2_stream_alerts": (q_stream_alerts, SQL_STREAM_ALERTS),
    "s1_stream_model": (q_stream_model, SQL_STREAM_MODEL),
    "s3_dead_letters": (q_dead_letter, SQL_DEAD_LETTER),
    "s4_alert_callback": (q_callback, SQL_CALLBACK),
    "s5_resume_adds_nothing": (q_stream_resume, SQL_STREAM_ALERTS),
    "s6_paced_replay": (q_paced, SQL_PACED),
    "s7_running_totals": (q_running_totals, SQL_RUNNING_TOTALS),
    "s8_action_counts": (q_action_counts, SQL_ACTION_COUNTS),
    "s8_window_counts": (q_window_counts, SQL_WINDOW_COUNTS),
    "s8_sliding_counts": (q_sliding_counts, SQL_SLIDING_COUNTS),
    "s9_stream_list_upsert": (q_stream_lists, SQL_FOLD),
    "s10_dedupe": (q_dedupe, SQL_DEDUPE),
}
del sround
