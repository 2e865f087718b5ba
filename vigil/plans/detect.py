"""Flagship plan: score and decide every transaction.

bind orders → first-seen device/location (L6) → entity lists seeded by
earlier labelled frauds (G2 → G1) → as-of list flags (G8) → rule score
(E8, behaviour default K5) → decision (F1, F4, F7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import bindings
from vigil.operators import decide, history, lists
from vigil.plans.sqltext import sround
from vigil.session import materialize

DETECTION_COLUMNS = [
    "transaction_id", "account_number", "txn_seq", "transaction_ts", "ip_country",
    "ip_address", "device_id", "beneficiary_account", "transaction_amount",
    "ip_fraud_score", "ip_blacklisted", "device_blacklisted", "beneficiary_blacklisted",
    "new_device", "new_location", "failed_auth_attempts", "ato_probability",
    "behavioral_anomaly_score", "action", "otp_required", "contact_mobile",
    "suspension_mode", "ato_confirmed", "actual_is_ato",
]
RAW_COLUMNS = ["raw_p", "raw_b"]  # the scores before rounding


def seed_lists(txn: DataFrame) -> DataFrame:
    """Lists as folded from the labelled frauds (one row per list/key with
    its first listing)."""
    adds = lists.fan_out_adds(txn.where(F.col("actual_is_ato") == 1), reason=None)
    return lists.fold_adds(adds)


def detections_from(txn: DataFrame, raw: bool = False) -> DataFrame:
    t = history.first_seen(txn, ["account_number", "device_id"], "transaction_ts", "txn_seq", "new_device")
    t = history.first_seen(t, ["account_number", "location_city"], "transaction_ts", "txn_seq", "new_location")
    # one table keyed by entity with each list's first listing, written once
    # for the three flag joins
    per_key = materialize(lists.first_listing_by_key(seed_lists(txn)), "listings")
    t = lists.flag_listed_before_by_key(t, per_key, "ip", "ip_address", "ip_blacklisted")
    t = lists.flag_listed_before_by_key(t, per_key, "device", "device_id", "device_blacklisted")
    t = lists.flag_listed_before_by_key(t, per_key, "beneficiary", "beneficiary_account", "beneficiary_blacklisted")
    t = t.withColumn("behavioral_anomaly_score", decide.behaviour_or_default())
    t = decide.score_rules(t)
    t = decide.with_decision(t)
    return t.select(*DETECTION_COLUMNS, *(RAW_COLUMNS if raw else []))


def detections(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """The bound transactions feed five branches (two first-seen
    aggregates, the list seed and three flag joins); they are written once
    so each branch scans a table instead of re-running the order/line
    joins."""
    return detections_from(materialize(bindings.transactions(spark, sf_dir), "transactions"), raw)


DETECTIONS_SQL = """
(WITH t AS {TXN},
 ld AS (SELECT *, row_number() OVER (PARTITION BY account_number, device_id ORDER BY transaction_ts, txn_seq) = 1 AS new_device,
        CASE WHEN location_city IS NULL THEN false
             ELSE row_number() OVER (PARTITION BY account_number, location_city ORDER BY transaction_ts, txn_seq) = 1 END AS new_location
        FROM t),
 adds AS (
   SELECT 'ip' AS list, ip_address AS key, transaction_ts AS ts, txn_seq AS seq FROM t WHERE actual_is_ato = 1
   UNION ALL SELECT 'device', device_id, transaction_ts, txn_seq FROM t WHERE actual_is_ato = 1
   UNION ALL SELECT 'beneficiary', beneficiary_account, transaction_ts, txn_seq FROM t WHERE actual_is_ato = 1),
 firsts AS (SELECT list, key, arg_min(ts, (ts, seq)) AS fts, arg_min(seq, (ts, seq)) AS fseq FROM adds
            WHERE key IS NOT NULL AND trim(key) <> '' GROUP BY list, key),
 f AS (
   SELECT ld.*,
     coalesce(fi.fts < ld.transaction_ts OR (fi.fts = ld.transaction_ts AND fi.fseq < ld.txn_seq), false) AS ip_blacklisted,
     coalesce(fd.fts < ld.transaction_ts OR (fd.fts = ld.transaction_ts AND fd.fseq < ld.txn_seq), false) AS device_blacklisted,
     coalesce(fb.fts < ld.transaction_ts OR (fb.fts = ld.transaction_ts AND fb.fseq < ld.txn_seq), false) AS beneficiary_blacklisted
   FROM ld
   LEFT JOIN firsts fi ON fi.list = 'ip' AND fi.key = ld.ip_address
   LEFT JOIN firsts fd ON fd.list = 'device' AND fd.key = ld.device_id
   LEFT JOIN firsts fb ON fb.list = 'beneficiary' AND fb.key = ld.beneficiary_account),
 s AS (
   SELECT f.* REPLACE (coalesce(CAST(behavioral_anomaly_score AS DOUBLE), 0.05) AS behavioral_anomaly_score) FROM f),
 p AS (
   SELECT s.*, least(0.99,
       coalesce(CAST(ip_fraud_score AS DOUBLE), 0.0) * 0.3
     + coalesce(CAST(ip_blacklisted AS DOUBLE), 0.0) * 0.15
     + coalesce(CAST(new_device AS DOUBLE), 0.0) * 0.1
     + coalesce(CAST(new_location AS DOUBLE), 0.0) * 0.1
     + coalesce(CAST(beneficiary_blacklisted AS DOUBLE), 0.0) * 0.15
     + least(coalesce(CAST(failed_auth_attempts AS DOUBLE), 0.0) / 10.0, 1.0) * 0.1
     + coalesce(CAST(behavioral_anomaly_score AS DOUBLE), 0.0) * 0.1) AS ato_probability
   FROM s)
 SELECT transaction_id, account_number, txn_seq, transaction_ts, ip_country, ip_address, device_id,
   beneficiary_account, transaction_amount, ip_fraud_score, ip_blacklisted, device_blacklisted,
   beneficiary_blacklisted, new_device, new_location, failed_auth_attempts,
   {R_P} AS ato_probability,
   {R_B} AS behavioral_anomaly_score,
   CASE WHEN ato_probability > 0.8 OR behavioral_anomaly_score > 0.3 THEN 'SUSPEND'
        WHEN ato_probability > 0.5 OR behavioral_anomaly_score > 0.2 THEN 'OTP_REQUIRED'
        ELSE 'ALLOW' END AS action,
   (ato_probability > 0.5 OR behavioral_anomaly_score > 0.2) AS otp_required,
   (ato_probability > 0.5 OR behavioral_anomaly_score > 0.2) AS contact_mobile,
   CASE WHEN ato_probability > 0.8 OR behavioral_anomaly_score > 0.3 THEN 'REVIEW' END AS suspension_mode,
   (ato_probability > 0.9 AND (ato_probability > 0.5 OR behavioral_anomaly_score > 0.2)) AS ato_confirmed,
   actual_is_ato, ato_probability AS raw_p, behavioral_anomaly_score AS raw_b
 FROM p)
""".replace("{TXN}", bindings.TXN_SQL).replace("{R_P}", sround("ato_probability", 4)).replace(
    "{R_B}", sround("behavioral_anomaly_score", 4))
