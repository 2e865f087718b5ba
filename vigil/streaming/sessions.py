"""Sessions and interval joins on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.accounts import otp_shape_ok


def closed_sessions(events: DataFrame, key: str, gap_us: int, delay: str, aggregates: dict) -> DataFrame:
    """Sessions of a key (a gap of more than ``gap_us`` ends one) once the
    watermark has passed their end, so that no row can extend or join them.
    ``events`` has event_time; rows without a key only move the watermark."""
    window = F.session_window("event_time", f"{gap_us + 1} microseconds")  # a gap of exactly gap_us still continues
    # a filter on the key alone would be pushed below the watermark, and rows without a key could not move it
    keyed = F.when(F.col(key).isNotNull(), F.col("event_time")).isNotNull()
    found = (events.withWatermark("event_time", delay).where(keyed).groupBy(key, window)
             .agg(F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"), *[a.alias(n) for n, a in aggregates.items()]))
    return found.drop("session_window")


def live_challenges(attempts: DataFrame, challenges: DataFrame, valid_for: str, delay: str) -> DataFrame:
    """H3: each well-formed attempt with the challenge live at its time, i.e. the
    account's latest one issued at or before it and not more than ``valid_for``
    earlier; null where there is none. Two watermarked streams meet in a time-range
    join (state: ``valid_for`` and the delay), and an attempt's latest
    challenge is settled when the watermark has passed it.

    ``attempts(attempt_id, account_number, attempt_ts, ord, otp)``,
    ``challenges(account_number, issued_ts, cseq, otp)``."""
    a = attempts.where(otp_shape_ok("otp")).withWatermark("attempt_ts", delay).alias("a")
    c = challenges.select(F.col("account_number").alias("c_account"), "issued_ts", "cseq", F.col("otp").alias("c_otp")).withWatermark("issued_ts", delay)
    at, issued = F.col("attempt_ts"), F.col("issued_ts")
    met = a.join(c, (F.col("account_number") == F.col("c_account")) & (issued <= at) & (issued >= at - F.expr(f"INTERVAL {valid_for}")), "left_outer")
    newest = F.max(F.when(issued.isNotNull(), F.struct("issued_ts", "cseq", "c_otp"))).alias("live")
    each = met.groupBy("attempt_id", "account_number", "attempt_ts", "ord", "otp").agg(newest)
    return each.select("attempt_id", "account_number", "attempt_ts", "ord", F.col("live.cseq").alias("challenge_seq"),
                       F.coalesce(F.col("otp") == F.col("live.c_otp"), F.lit(False)).alias("correct"))
