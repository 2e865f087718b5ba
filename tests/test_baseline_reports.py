"""Behavioural baselines (K) and reports (I) on hand-made rows."""

import datetime as dt

from vigil.operators import baseline as K
from vigil.operators import reports

SIG = ["s1", "s2"]


def test_baseline_needs_three_sessions(spark):
    rows = [("A", 10, 1), ("A", 20, 1), ("B", 10, 2), ("B", 20, 4), ("B", 30, 6)]
    s = spark.createDataFrame(rows, "account string, s1 long, s2 long")
    b = {r["account"]: r for r in K.build(s, SIG).collect()}
    assert set(b) == {"B"}
    assert b["B"]["mean_s1"] == 20.0 and abs(b["B"]["std_s1"] - 8.164966) < 1e-6
    look = {r["account"]: r["has_baseline"] for r in
            K.lookup(spark.createDataFrame([("A",), ("B",), ("C",)], "account string"), K.build(s, SIG)).collect()}
    assert look == {"A": False, "B": True, "C": False}
    assert [r["n_accounts"] for r in K.listing(K.build(s, SIG)).collect()] == [1]


def test_baseline_of_fractional_signals(spark):
    rows = [("R", .15, 4.5), ("R", .12, 4.4), ("R", .20, 5.4)]
    s = spark.createDataFrame(rows, "account string, s1 double, s2 double")
    b = K.rounded(K.build(s, SIG), SIG).first()
    assert (b["mean_s1"], b["std_s1"], b["mean_s2"], b["std_s2"]) == (0.156667, 0.032998, 4.766667, 0.449691)


def test_sums_neither_cut_nor_overflow(spark):
    tiny, huge = [1.5e-15, 2.5e-15, 3.25e-15], [3e19, 4e19, 5e19]
    rows = [("T", a, b, c) for a, b, c in zip(tiny, huge, [1e200, 1e200, 4e200], strict=True)]
    s = spark.createDataFrame(rows, "account string, s1 double, s2 double, s3 double")
    b = K.build(s, ["s1", "s2", "s3"]).first()
    assert abs(b["mean_s1"] / (7.25e-15 / 3) - 1) < 1e-9 and b["mean_s2"] == 4e19 and abs(b["mean_s3"] / 2e200 - 1) < 1e-12
    empty = spark.createDataFrame([("T", None, float("inf"))] * 3, "account string, s1 double, s2 double")
    b = K.build(empty, SIG).first()
    assert b["mean_s1"] is None and b["mean_s2"] == float("inf")


def test_baseline_score(spark):
    hist = spark.createDataFrame([("B", 10, 2), ("B", 20, 4), ("B", 30, 6)], "account string, s1 long, s2 long")
    new = spark.createDataFrame([("B", 20, 4), ("B", 100, 4), ("Z", 1, 1)], "account string, s1 long, s2 long")
    got = K.score(new, K.build(hist, SIG), SIG).collect()
    assert [r["anomaly_score"] for r in got if r["account"] == "B"] == [0.0, 0.5]
    z = [r for r in got if r["account"] == "Z"][0]
    assert z["anomaly_score"] == 0.05 and not z["has_baseline"] and z["risk_level"] == "LOW"


def test_constant_signal_does_not_divide_by_zero(spark):
    hist = spark.createDataFrame([("C", 5, 1)] * 3, "account string, s1 long, s2 long")
    new = spark.createDataFrame([("C", 5, 1), ("C", 6, 1)], "account string, s1 long, s2 long")
    got = [r["anomaly_score"] for r in K.score(new, K.build(hist, SIG), SIG).collect()]
    assert got == [0.0, 0.5]


def _log(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"T{i}", f"A{i % 3}", 0.1 * (i % 10), 0.05, ["ALLOW", "OTP_REQUIRED", "SUSPEND"][i % 3],
             i % 3 != 0, None, t0 + dt.timedelta(hours=i), i, "X") for i in range(n)]
    return spark.createDataFrame(rows, "transaction_id string, account_number string, ato_probability double, "
                                       "behavioral_anomaly_score double, action string, otp_required boolean, "
                                       "actual_is_ato int, transaction_ts timestamp_ntz, txn_seq long, ip_country string")


def test_last_n_lists(spark):
    log = _log(spark, 300)
    f = reports.fraud_log(log).collect()
    assert len(f) == 50 and all(r["otp_required"] for r in f)
    assert max(r["txn_seq"] for r in f) == 299
    r = reports.recent_detections(log).collect()
    assert len(r) == 100 and min(x["txn_seq"] for x in r) == 200
    ops = reports.ops_indicators(reports.recent_detections(log), reports.fraud_log(log)).first()
    assert ops["decisions"] == 100 and ops["flagged_txns"] == 50
    assert ops["flagged_for_review"] == ops["blocked"] + ops["otp_triggered"]


def test_reports_on_empty_input(spark):
    empty = _log(spark, 0)
    assert reports.fraud_log(empty).count() == 0
    assert reports.risk_summary(empty).first()["events"] == 0
    assert reports.risk_histogram(empty).count() == 0
    assert reports.action_vs_actual(empty).count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([("A", 0.0), ("A", 1.0), ("A", 0.5), ("B", None)], "action string, ato_probability double")
    h = {(r["action"], r["bin"]): r["n"] for r in reports.risk_histogram(df, bins=30).collect()}
    assert h == {("A", 0): 1, ("A", 29): 1, ("A", 15): 1}
