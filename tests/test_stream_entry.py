"""Streams equal the batch, survive bad and duplicate messages; the
driver contract holds; a model learns."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001
from vigil.operators import models as M
from vigil.plans import detect, q_stream
from vigil.sources import files as IO
from vigil.streaming import stream as ST


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == detect.DETECTION_COLUMNS


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100
    assert len([k for k in qs if k.startswith("op")]) in (0, 13)  # the optional operators, all or none


def test_stream_equals_batch(spark):
    det = detect.detections(spark, SF001)
    batch = {r["transaction_id"]: (r["action"], r["ato_probability"]) for r in det.where("action <> 'ALLOW'").collect()}
    got = q_stream.q_stream_alerts(spark, SF001).collect()
    assert {r["transaction_id"]: (r["action"], r["ato_probability"]) for r in got} == batch
    again = q_stream.q_stream_resume(spark, SF001)
    assert again.count() == len(batch)


def test_bad_and_duplicate_messages(spark):
    dl = q_stream.q_dead_letter(spark, SF001)
    assert dl.count() > 0 and dl.where(~F.col("raw").contains("broken")).count() == 0
    dd = q_stream.q_dedupe(spark, SF001)
    assert dd.count() == dd.select("transaction_id").distinct().count() == detect.detections(spark, SF001).count()


def test_empty_stream(spark):
    base = IO.scratch_dir(spark, "empty")
    spark.createDataFrame([], "value string").write.mode("overwrite").text(base + "/in")
    m = ST.read_messages(spark, base + "/in")
    ST.run_available_now(ST.alerts(ST.score(ST.good(m))), "json", base + "/out", base + "/ck")
    assert spark.read.schema("transaction_id string").json(base + "/out").count() == 0


def test_model_learns(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13), 1 if (i % 10) > 6 else 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a double, b double, is_ato int").withColumn("label", F.col("is_ato").cast("double"))
    model = M.tabular_pipeline(["a", "b"], M.gbt(trees=10, depth=3)).fit(df)
    s = M.score(model, df.drop("label"), ["a", "b"])
    acc = s.select(F.avg(((F.col("ato_probability") > 0.5).cast("int") == F.col("is_ato")).cast("double"))).first()[0]
    assert acc > 0.7
    assert s.where("ato_probability < 0 OR ato_probability > 1").count() == 0
    zero = M.score(model, df.select("id").limit(3), ["a", "b"])  # absent features backfilled with 0
    assert zero.count() == 3


def test_queries_pin_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = E.queries()["l15_country_8w"](spark, SF001).count()
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
        assert rows > 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_flagship_same_under_other_partitioning(spark):
    cols = ["transaction_id", "ato_probability", "action", "new_device", "new_location", "ip_blacklisted",
            "device_blacklisted", "beneficiary_blacklisted"]
    a = sorted(tuple(r) for r in detect.detections(spark, SF001).select(*cols).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = sorted(tuple(r) for r in detect.detections(spark, SF001).select(*cols).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert a == b


def test_alert_sink_text(spark):
    base = IO.scratch_dir(spark, "t-sink")
    q_stream._publish(spark, SF001, base + "/in")
    m = ST.read_messages(spark, base + "/in")
    q = ST.start_alert_sink(ST.alerts(ST.score(ST.good(m))), base + "/ck", path=base + "/out", available_now=True)
    q.awaitTermination()
    lines = spark.read.text(base + "/out")
    assert lines.count() == detect.detections(spark, SF001).where("action <> 'ALLOW'").count()
    assert lines.where(F.get_json_object("value", "$.action") == "ALLOW").count() == 0


class _Kafka:
    """Stands for a session's reader: keeps the options, gives a frame with a topic's columns."""

    def __init__(self, frame):
        self.frame, self.kept = frame, {}
        self.readStream = self

    def format(self, name):
        self.kept["format"] = name
        return self

    def options(self, **options):
        self.kept |= options
        return self

    def load(self):
        return self.frame


def test_topic_options_and_parsing(spark):
    good = '{"transaction_id": "t1", "ip_fraud_score": 0.5, "new_device": true, "failed_auth_attempts": 3}'
    rows = [(None, bytearray(v, "utf-8"), "tx", 0, i) for i, v in enumerate([good, "{broken", '{"transaction_id": "t2"}'])] + [(None, None, "tx", 0, 3)]
    topic = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long")
    reader = _Kafka(topic)
    messages = ST.read_messages(reader, "", kafka_options={"kafka.bootstrap.servers": "h:1", "subscribe": "tx"})
    assert reader.kept == {"format": "kafka", "startingOffsets": "latest", "kafka.bootstrap.servers": "h:1", "subscribe": "tx"}
    ST.read_messages(reader, "", kafka_options={"subscribe": "tx", "startingOffsets": "earliest"})
    assert reader.kept["startingOffsets"] == "earliest"
    first = {r["transaction_id"]: r for r in ST.good(messages).where("transaction_id IS NOT NULL").collect()}
    assert (first["t1"]["ip_fraud_score"], first["t1"]["new_device"], first["t1"]["failed_auth_attempts"]) == (0.5, True, 3) and set(first) == {"t1", "t2"}
    assert [r["raw"] for r in ST.dead_letters(messages).collect()] == ["{broken"]


def test_topic_message_has_a_key(spark):
    out = ST.as_message(spark.createDataFrame([("t1", "SUSPEND", 0.9)], "transaction_id string, action string, ato_probability double"))
    assert out.columns == ["value"] and out.first()["value"] == '{"transaction_id":"t1","action":"SUSPEND","ato_probability":0.9}'


def test_messages_are_parsed_once(spark):
    """Neither a filter nor the columns read after it repeat the parse; null and broken messages are rows as before."""
    raw = spark.createDataFrame([('{"transaction_id": "a", "ip_fraud_score": 0.5}',), ('{"transaction_id": "b", broken',), (None,)], "value string")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    m = ST.parse_messages(raw)
    assert m.columns == ST.MESSAGE_SCHEMA.names
    assert plan(ST.score(ST.good(m))).count("from_json") == plan(ST.dead_letters(m)).count("from_json") == 1
    assert sorted((r["transaction_id"], r["ip_fraud_score"]) for r in ST.good(m).collect() if r["transaction_id"]) == [("a", 0.5)]
    assert [r["raw"] for r in ST.dead_letters(m).collect()] == ['{"transaction_id": "b", broken']
    assert m.count() == 3 and ST.good(m).count() == 2
