"""Entity lists (G) and OTP / suspension state (H)."""

import datetime as dt

from pyspark.sql import functions as F

from vigil.operators import accounts as A
from vigil.operators import lists

T0 = dt.datetime(2024, 1, 1)


def _adds(spark, rows):
    return spark.createDataFrame(rows, "list string, key string, account string, ts timestamp_ntz, seq long, reason string")


def test_fold_and_upsert(spark):
    adds = _adds(spark, [("ip", "1.1.1.1", "A", T0, 1, None), ("ip", "1.1.1.1", "B", T0, 2, "manual"),
                         ("ip", "1.1.1.1", "C", T0 + dt.timedelta(hours=1), 3, None),
                         ("device", "d1", "A", T0, 1, None)])
    f = {(r["list"], r["key"]): r for r in lists.fold_adds(adds).collect()}
    ip = f[("ip", "1.1.1.1")]
    assert ip["count"] == 3 and ip["account"] == "C" and ip["reason"] == "manual"
    assert ip["last_updated"] == T0 + dt.timedelta(hours=1)
    stored = lists.fold_adds(adds).drop("first_listed")
    more = _adds(spark, [("ip", "1.1.1.1", "D", T0 + dt.timedelta(days=1), 9, None),
                         ("beneficiary", "b9", "D", T0, 9, "x")])
    up = {(r["list"], r["key"]): r for r in lists.upsert(stored, more).collect()}
    assert up[("ip", "1.1.1.1")]["count"] == 4 and up[("ip", "1.1.1.1")]["account"] == "D"
    assert up[("ip", "1.1.1.1")]["reason"] == "manual" and up[("beneficiary", "b9")]["count"] == 1
    assert up[("device", "d1")]["count"] == 1


def test_fan_out_skips_blank_keys(spark):
    df = spark.createDataFrame([("A", "1.2.3.4", "", None, T0, 1)],
                               "account_number string, ip_address string, device_id string, "
                               "beneficiary_account string, transaction_ts timestamp_ntz, txn_seq long")
    adds = lists.fan_out_adds(df).collect()
    assert [(r["list"], r["key"]) for r in adds] == [("ip", "1.2.3.4")]


def test_remove_and_counts(spark):
    stored = lists.fold_adds(_adds(spark, [("ip", "a", "A", T0, 1, None), ("ip", "b", "A", T0, 2, None)])).drop("first_listed")
    rem = spark.createDataFrame([("ip", "a"), ("ip", "zz")], "list string, key string")
    kept, nf = lists.remove(stored, rem)
    assert [r["key"] for r in kept.collect()] == ["b"] and [r["key"] for r in nf.collect()] == ["zz"]
    c = {r["list"]: r["entries"] for r in lists.counts_per_list(kept).collect()}
    assert c == {"ip": 1, "device": 0, "beneficiary": 0}
    empty = spark.createDataFrame([], stored.schema)
    assert lists.counts_per_list(empty).where("entries > 0").count() == 0


def _det(spark, rows):
    return spark.createDataFrame(rows, "account_number string, transaction_id string, transaction_ts timestamp_ntz, "
                                       "txn_seq long, otp_required boolean, action string, ato_probability double, "
                                       "behavioral_anomaly_score double")


def _attempts(spark, rows):
    return spark.createDataFrame(rows, "attempt_id string, account_number string, attempt_ts timestamp_ntz, "
                                       "attempt_seq long, otp string")


def test_otp_sequence(spark):
    h = dt.timedelta(hours=1)
    det = _det(spark, [("A", "T1", T0, 1, True, "SUSPEND", 0.85, 0.1), ("A", "T2", T0 + 5 * h, 2, True, "OTP_REQUIRED", 0.6, 0.1),
                       ("B", "T3", T0, 3, True, "SUSPEND", 0.85, 0.1)])
    ch = A.challenges(det)
    code = {r["transaction_id"]: r["otp"] for r in ch.collect()}
    assert all(len(c) == 6 and c.isdigit() for c in code.values())
    att = _attempts(spark, [
        ("a1", "A", T0 + h, 1, "999999" if code["T1"] != "999999" else "888888"),  # wrong: does not consume
        ("a2", "A", T0 + 2 * h, 2, code["T1"]),      # right → unlock
        ("a3", "A", T0 + 3 * h, 3, code["T1"]),      # right twice → fails (consumed)
        ("a4", "A", T0 + 6 * h, 4, code["T1"]),      # old code after reissue → fails
        ("a5", "A", T0 + 7 * h, 5, code["T2"]),      # new code → valid
        ("a6", "B", T0 + h, 6, "12ab"),              # four characters, wrong code → blocked
        ("a7", "B", T0 + h, 7, "123"),               # too short: not an attempt
        ("a8", "B", T0 + h, 8, "123456789"),         # too long: not an attempt
    ])
    v = {r["attempt_id"]: r["otp_valid"] for r in A.verify(ch, att).collect()}
    assert v == {"a1": False, "a2": True, "a3": False, "a4": False, "a5": True, "a6": False}
    out = {r["attempt_id"]: r["action"] for r in A.outcome(A.verify(ch, att)).collect()}
    assert out["a2"] == "ACCOUNT_UNLOCKED" and out["a1"] == "ACCOUNT_BLOCKED"
    sus = [r["account_number"] for r in A.suspended_now(det, A.verify(ch, att)).collect()]
    assert sus == ["B"]


def test_otp_shape(spark):
    df = spark.createDataFrame([("123",), ("1234",), ("12345678",), ("123456789",), ("12a4",), (None,)], "otp string")
    assert [r[0] for r in df.select(A.otp_shape_ok()).collect()] == [False, True, True, False, True, False]


def test_challenges_write_only_what_they_are_made_of(spark, monkeypatch):
    """the whole detection log used to be written for a few columns of the flagged rows."""
    from vigil.plans import q_accounts as Q
    flagged = [("A", "T1", "2024-01-01 00:00:00", 1, True, "x"), ("A", "T2", "2024-01-02 00:00:00", 2, False, "x"),
               ("A", "T3", "2024-01-03 00:00:00", 3, True, "x")]
    log = spark.createDataFrame(flagged, "account_number string, transaction_id string, t string, txn_seq long, otp_required boolean, other string")
    monkeypatch.setattr(Q.detect, "detections", lambda *_: log.withColumn("transaction_ts", log.t.cast("timestamp_ntz")))
    written, write = {}, Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda d, name: written.setdefault(name, write(d, name)))
    got = {r["transaction_id"]: r["replaced_ts"] for r in Q.q_challenges(spark, "").collect()}
    assert got["T1"] is not None and got["T3"] is None and set(got) == {"T1", "T3"}
    assert "other" not in written["flagged"].columns and written["flagged"].count() == 2
