"""Rule score, decisions, bands and the response record."""

from pyspark.sql import functions as F

from vigil.functions import rule_score
from vigil.operators import decide

NORMAL = dict(transaction_id="T1", account_number="A1", ip_fraud_score=0.05, ip_blacklisted=None,
              new_device=False, new_location=False, beneficiary_blacklisted=None, failed_auth_attempts=0,
              behavioral_anomaly_score=0.05)
FRAUD = dict(transaction_id="T2", account_number="A2", ip_fraud_score=0.95, ip_blacklisted=True,
             new_device=True, new_location=True, beneficiary_blacklisted=True, failed_auth_attempts=5,
             behavioral_anomaly_score=0.85)
SCHEMA = ("transaction_id string, account_number string, ip_fraud_score double, ip_blacklisted boolean, "
          "new_device boolean, new_location boolean, beneficiary_blacklisted boolean, "
          "failed_auth_attempts int, behavioral_anomaly_score double")


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r[k] for k in NORMAL) for r in rows], SCHEMA)


def test_rule_score_fixtures(spark):
    df = decide.with_decision(decide.score_rules(_frame(spark, [NORMAL, FRAUD])))
    got = {r["transaction_id"]: r for r in df.collect()}
    assert got["T1"]["ato_probability"] == 0.02
    assert got["T2"]["ato_probability"] == 0.92
    assert got["T1"]["action"] == "ALLOW" and not got["T1"]["otp_required"]
    assert got["T2"]["action"] == "SUSPEND" and got["T2"]["otp_required"] and got["T2"]["ato_confirmed"]
    assert got["T2"]["suspension_mode"] == "REVIEW"


def test_thresholds_are_strict(spark):
    rows = [(0.50, 0.05), (0.5001, 0.05), (0.80, 0.05), (0.8001, 0.05), (0.1, 0.20), (0.1, 0.2001),
            (0.1, 0.30), (0.1, 0.3001), (0.90, 0.05), (0.9001, 0.05)]
    df = spark.createDataFrame(rows, "ato_probability double, behavioral_anomaly_score double")
    got = [r["action"] for r in decide.with_decision(df).collect()]
    assert got == ["ALLOW", "OTP_REQUIRED", "OTP_REQUIRED", "SUSPEND", "ALLOW", "OTP_REQUIRED",
                   "OTP_REQUIRED", "SUSPEND", "SUSPEND", "SUSPEND"]
    conf = [r["ato_confirmed"] for r in decide.with_decision(df).collect()]
    assert conf[-2:] == [False, True]


def test_band_edges(spark):
    vals = [0.0, 0.499, 0.4991, 0.5, 0.799, 0.7991, 1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "ato_probability double")
    got = [(r["risk_level"], r["recommended_action"]) for r in decide.band_and_action(df).collect()]
    assert got == [("LOW", "ALLOW"), ("LOW", "ALLOW"), ("MEDIUM", "OTP REQUIRED"), ("MEDIUM", "OTP REQUIRED"),
                   ("MEDIUM", "OTP REQUIRED"), ("HIGH", "SUSPEND"), ("HIGH", "SUSPEND"), (None, None)]


def test_response_record_shape(spark):
    df = decide.response_record(decide.with_decision(decide.score_rules(_frame(spark, [NORMAL, FRAUD]))))
    got = {r["transaction_id"]: r for r in df.collect()}
    hi = got["T2"]
    assert hi["behavioral_warning"] == "High behavioral anomaly: 0.850 (threshold: 0.3)"
    assert hi["user_capabilities"]["transfer_money"] is False and hi["user_capabilities"]["view_balance"] is True
    assert [a["action"] for a in hi["user_actions"]] == ["SUSPEND_ACCOUNT", "TRIGGER_OTP", "CONTACT_REGISTERED_MOBILE"]
    assert hi["blacklist_result"]["reason"] == "ATO fraud confirmed"
    lo = got["T1"]
    assert lo["behavioral_warning"] is None and lo["user_capabilities"] is None and lo["user_actions"] == []
    assert lo["blacklist_result"]["reason"] == "Not confirmed as fraud"
    for k in ("transaction_id", "action", "otp_required", "contact_mobile", "suspension_mode",
              "behavioral_warning", "user_capabilities", "user_actions", "blacklist_result"):
        assert k in df.columns


def test_nulls_count_as_zero(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None)],
                               "a double, b boolean, c boolean, d boolean, e boolean, f int, g double")
    v = df.select(rule_score("a", "b", "c", "d", "e", "f", "g").alias("p")).first()["p"]
    assert v == 0.0


def test_empty_input(spark):
    df = _frame(spark, [])
    assert decide.with_decision(decide.score_rules(df)).count() == 0


def test_behaviour_level_and_default(spark):
    df = spark.createDataFrame([(0.2,), (0.2001,), (0.3,), (0.3001,), (None,)], "anomaly_score double")
    lv = [r["risk_level"] for r in decide.risk_level(df).collect()]
    assert lv == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "LOW"]
    d = spark.createDataFrame([(None,), (0.7,)], "behavioral_anomaly_score double")
    assert [r[0] for r in d.select(decide.behaviour_or_default()).collect()] == [0.05, 0.7]


def test_round_half_up(spark):
    df = spark.createDataFrame([(0.12345,), (0.12355,)], "ato_probability double")
    got = [r["ato_probability"] for r in df.select(F.round("ato_probability", 4).alias("ato_probability")).collect()]
    assert got == [0.1235, 0.1236]
