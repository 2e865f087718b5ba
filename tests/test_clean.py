"""Cleaning and validation (B), with the reference's coercion test rows."""

import math

from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.operators import clean


def test_flag_and_number_coercion(spark):
    df = spark.createDataFrame([("true", "0.5"), ("false", "abc"), ("1", None)],
                               "ip_blacklisted string, ip_fraud_score string")
    out = clean.coerce_numeric(clean.coerce_flags(df, ["ip_blacklisted"]), ["ip_fraud_score"]).collect()
    assert [r["ip_blacklisted"] for r in out] == [1, 0, 1]
    assert [r["ip_fraud_score"] for r in out] == [0.5, 0.0, 0.0]


def test_number_edge_text(spark):
    vals = [" 1.5 ", "12d", "3f", "NaN", "", None, "1e3", "-2", ".5", "0x10", "inf"]
    df = spark.createDataFrame([(v,) for v in vals], "x string")
    got = [r["x"] for r in clean.coerce_numeric(df, ["x"]).collect()]
    assert got[:10] == [1.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1000.0, -2.0, 0.5, 0.0]
    assert math.isinf(got[10])


def test_missing_columns_and_backfill(spark):
    df = spark.createDataFrame([("T1", 1)], "transaction_id string, is_ato int")
    miss = clean.missing_columns(df)
    assert miss.where("present").count() == 0 and miss.count() == len(S.ALL_FEATURES)
    filled = clean.backfill_zero(df)
    assert all(c in filled.columns for c in S.NUMERIC_FEATURES)
    assert filled.select(*S.NUMERIC_FEATURES).first().asDict() == {c: 0.0 for c in S.NUMERIC_FEATURES}


def test_rename_project_and_drop(spark):
    df = spark.createDataFrame([(1.0, "x", 1), (2.0, None, None)], "income double, source string, fraud_bool int")
    d = clean.project_allowed(clean.rename_target(df))
    assert d.columns == ["income", "source", "is_ato"]
    assert clean.drop_null_target(d).count() == 1
    both = spark.createDataFrame([(1, 0)], "fraud_bool int, is_ato int")
    assert clean.rename_target(both).columns == ["fraud_bool", "is_ato"]


def test_label_encode_sorted_with_nan(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "source string")
    got = [r["source"] for r in clean.label_encode(df, ["source"]).collect()]
    assert got == [1, 2, 0, 1]  # sorted: a, b, nan
    joined = [r["source"] for r in clean.label_encode(df, ["source"]).collect()]
    assert sorted(joined) == sorted(got)


def test_feature_projection_order(spark):
    df = spark.createDataFrame([("abc", 3)], "income string, month int")
    p = clean.feature_projection(df)
    assert p.columns == S.MODEL_FEATURES
    r = p.first()
    assert r["income"] == 0.0 and r["month"] == 3.0 and r["velocity_6h"] == 0.0


def test_validate(spark):
    df = spark.createDataFrame([("A", 10.0, 0.5), (None, 10.0, 0.5), ("B", None, 1.5), ("C", 5.0, None)],
                               "account_number string, transaction_amount double, ip_fraud_score double")
    v = clean.validate(df)
    acc = clean.accepted(v)
    assert sorted(r["account_number"] for r in acc.collect()) == ["A", "C"]
    assert acc.where("account_number = 'C'").first()["ip_fraud_score"] == 0.0  # default filled
    rej = {r["account_number"]: r["errors"] for r in clean.rejected(v).collect()}
    assert rej[None] == ["missing:account_number"]
    assert rej["B"] == ["missing:transaction_amount", "max:ip_fraud_score"]


def test_validate_reads_each_number_once_where_a_filter_follows(spark):
    """the filter used to hold a copy of every check and of every draw behind it."""
    df = spark.createDataFrame([("A", "10", "0.5", "2", "4.5"), ("B", "NaN", " -nan", "2.5", "fast"), ("C", "1", "+2", "-1", None)],
                               "account_number string, transaction_amount string, ip_fraud_score string, "
                               "failed_auth_attempts string, typing_speed_mobile string")
    rejected = clean.rejected(clean.validate(df))
    plan = rejected._jdf.queryExecution().optimizedPlan()
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    text = plan.toString().upper()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert text.count("RLIKE") == 4
    got = {r["account_number"]: r["errors"] for r in rejected.collect()}
    assert got == {"B": ["type:transaction_amount", "type:ip_fraud_score", "type:failed_auth_attempts", "type:typing_speed_mobile"],
                   "C": ["max:ip_fraud_score", "min:failed_auth_attempts"]}
    assert clean.accepted(clean.validate(df)).columns == [c for c in clean.validate(df).columns if c != "errors"]


def test_transaction_id_and_amount(spark):
    df = spark.createDataFrame([(1, None, None, 5.0), (2, "X", 7.0, -1.0), (3, " ", None, -3.0)],
                               "k long, transaction_id string, transaction_amount double, intended_balcon_amount double")
    d = clean.amount_fallback(clean.ensure_transaction_id(df, "k")).orderBy("k").collect()
    assert d[0]["transaction_id"].startswith("TXN-") and len(d[0]["transaction_id"]) == 16
    assert d[1]["transaction_id"] == "X" and d[2]["transaction_id"].startswith("TXN-")
    assert [r["transaction_amount"] for r in d] == [5.0, 7.0, 1000.0]


def test_user_agent_and_speed(spark):
    uas = ["Mozilla/5.0 (X11; Linux x86_64)", "Mozilla/5.0 (Android 13; Mobile)",
           "Mozilla/5.0 (Windows NT 10.0; Win64; x64)", "Linux"]
    df = spark.createDataFrame([(u,) for u in uas], "user_agent_raw string")
    got = [r[0] for r in df.select(clean.parse_user_agent()).collect()]
    assert got == ["Linux,x86_64)", "13;,Mobile)", "Windows,Chrome", None]
    sp = spark.createDataFrame([(240.0, 1.0), (10.0, 0.0)], "km double, days double")
    assert [r[0] for r in sp.select(clean.travel_speed("km", "days")).collect()] == [10, None]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (2.0,), (None,)], "x double")
    assert [r["x"] for r in clean.clip(df, {"x": (0.0, 1.0)}).collect()] == [0.0, 0.5, 1.0, None]


def test_ids_first(spark):
    df = spark.createDataFrame([(1, "a", 0.3, "T")], "z int, account_number string, ato_probability double, transaction_id string")
    assert clean.ids_first(df).columns == ["account_number", "transaction_id", "ato_probability", "z"]
    assert "is_ato" not in clean.prepare_for_scoring(df.withColumn("is_ato", F.lit(1))).columns
