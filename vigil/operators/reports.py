"""Reporting aggregates, sorts and limits (survey 2.9).

Last-N lists are TakeOrdered (``orderBy(...).limit(n)`` with a fixed
small n): each task keeps n rows, the driver merges n × tasks rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S

LOG_COLUMNS = ["transaction_id", "account_number", "ato_probability", "behavioral_anomaly_score",
               "action", "otp_required", "actual_is_ato", "transaction_ts", "txn_seq", "ip_country"]


def newest(df: DataFrame, n: int, ts: str = "transaction_ts", seq: str = "txn_seq") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(seq).desc()).limit(n)


def fraud_log(det: DataFrame, show: int = S.FRAUD_LOG_SHOW, keep: int = S.FRAUD_LOG_KEEP) -> DataFrame:
    """The last ``show`` flagged records of the last ``keep``."""
    return newest(det.where("otp_required").select(*LOG_COLUMNS), min(show, keep))


def recent_detections(det: DataFrame, show: int = S.DETECTION_LOG_SHOW,
                      keep: int = S.DETECTION_LOG_KEEP) -> DataFrame:
    """The last ``show`` detections of the last ``keep``."""
    return newest(det.select(*LOG_COLUMNS), min(show, keep))


def action_counts(recent: DataFrame) -> DataFrame:
    """I3."""
    return recent.groupBy("action").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def ops_indicators(recent: DataFrame, flagged: DataFrame) -> DataFrame:
    """I4: decisions, blocked (SUSPEND + BLOCK), OTP, for review, flagged."""
    a = recent.agg(
        F.count(F.lit(1)).cast("bigint").alias("decisions"),
        F.count_if(F.col("action").isin("SUSPEND", "BLOCK")).cast("bigint").alias("blocked"),
        F.count_if(F.col("action") == "OTP_REQUIRED").cast("bigint").alias("otp_triggered"))
    f = flagged.agg(F.count(F.lit(1)).cast("bigint").alias("flagged_txns"))
    return (a.crossJoin(f)  # two one-row aggregates
             .withColumn("flagged_for_review", F.col("blocked") + F.col("otp_triggered")))


def flagged_per_country(flagged: DataFrame) -> DataFrame:
    """Flagged count per country, descending then by name."""
    return (flagged.groupBy(F.col("ip_country").alias("country"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("count"))
            .orderBy(F.col("count").desc(), F.col("country")))


def risk_summary(recent: DataFrame, p: str = "ato_probability") -> DataFrame:
    """Events, mean risk (3 digits) and number above .80."""
    return recent.agg(F.count(F.lit(1)).cast("bigint").alias("events"),
                      F.round(F.avg(p), 3).alias("avg_risk"),
                      F.count_if(F.col(p) > 0.8).cast("bigint").alias("high_risk"))


def risk_histogram(df: DataFrame, by: str = "action", p: str = "ato_probability",
                   bins: int = 30) -> DataFrame:
    """Fixed-width bins on [0, 1]; 1.0 falls in the last bin."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return (df.where(F.col(p).isNotNull())
            .groupBy(F.col(by).alias(by), b.alias("bin"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .withColumn("bin_lo", F.round(F.col("bin") / F.lit(float(bins)), 6))
            .withColumn("bin_hi", F.round((F.col("bin") + 1) / F.lit(float(bins)), 6)))


def parse_and_sort(df: DataFrame, col: str, out: str = "parsed_ts") -> DataFrame:
    """Bad timestamp text → null, newest first, nulls last."""
    return (df.withColumn(out, F.expr(f"try_to_timestamp({col})"))
              .orderBy(F.col(out).desc_nulls_last()))


def level_counts(scored: DataFrame, p: str = "ato_probability") -> DataFrame:
    """Rows per risk level and mean probability (4 digits)."""
    return scored.agg(
        F.count(F.lit(1)).cast("bigint").alias("scored"),
        F.count_if(F.col("risk_level") == "HIGH").cast("bigint").alias("high"),
        F.count_if(F.col("risk_level") == "MEDIUM").cast("bigint").alias("medium"),
        F.count_if(F.col("risk_level") == "LOW").cast("bigint").alias("low"),
        F.round(F.avg(p), 4).alias("avg_probability"))


def lookup_first(df: DataFrame, key_col: str, key, order: list[str]) -> DataFrame:
    """First row (by ``order``) whose key equals ``key``."""
    return df.where(F.col(key_col) == F.lit(key)).orderBy(*order).limit(1)


REVIEW_GROUPS = [
    ("core", ["transaction_id", "account_number", "ip_address", "device_id", "ip_country",
              "ato_probability", "action"]),
    ("behavioral", ["typing_speed_wpm", "mouse_movement_velocity", "touch_event_radius",
                    "is_known_vpn_or_proxy", "is_foreign_ip", "failed_login_attempts_session",
                    "session_length_in_minutes"]),
    ("velocity", ["velocity_6h", "velocity_24h", "velocity_4w", "failed_tx_count_1h",
                  "new_payee_added", "transaction_amount", "transaction_type"]),
]


def review_rows(df: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """Each record as (id, group, field, value) rows; groups as the
    review console, every other column under 'raw'."""
    grouped = {c: g for g, cs in REVIEW_GROUPS for c in cs}
    fields = [c for c in df.columns if c != id_col] + [id_col]
    cast = [F.col(c).cast("string").alias(c) for c in fields]
    long = df.select(F.col(id_col).alias("_id"), *cast).unpivot("_id", fields, "field", "value")
    gmap = F.create_map(*[x for c, g in grouped.items() if c in fields for x in (F.lit(c), F.lit(g))])
    return long.select(F.col("_id").alias(id_col),
                       F.coalesce(gmap[F.col("field")], F.lit("raw")).alias("group"),
                       "field", "value")


def action_vs_actual(det: DataFrame) -> DataFrame:
    """Predicted action against the actual label (null label kept)."""
    return det.groupBy("action", "actual_is_ato").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def service_summary(metrics: DataFrame, flagged_n: DataFrame, suspended_n: DataFrame,
                    recent_n: DataFrame, list_sizes: DataFrame) -> DataFrame:
    """I8: one-row summary; every input is a one-row aggregate."""
    m = metrics.select(
        F.format_string("%.1f%%", F.round(F.col("accuracy") * 100, 1)).alias("model_accuracy"),
        F.format_string("%.4f", F.round(F.col("auc_roc"), 4)).alias("model_auc"),
        F.format_string("%.4f", F.round(F.col("f1_score"), 4)).alias("model_f1"),
        F.format_string("%.2f%%", F.round(F.col("false_positive_rate") * 100, 2)).alias("false_positive_rate"))
    pivot = list_sizes.agg(*[
        F.coalesce(F.sum(F.when(F.col("list") == n, F.col("entries"))), F.lit(0)).cast("bigint")
         .alias(f"blacklisted_{k}") for n, k in (("ip", "ips"), ("device", "devices"),
                                                 ("beneficiary", "beneficiaries"))])
    return (m.crossJoin(flagged_n).crossJoin(suspended_n).crossJoin(recent_n).crossJoin(pivot)
             .select(F.lit("ATO Detection System").alias("service"), F.lit("Online").alias("status"), "*"))
