"""Account state and OTP (survey 2.8).

State is derived from append-only logs: challenges (one per flagged
detection), attempts, suspensions.  Every lookup is an as-of match on
a per-account timeline computed with the bucketed helpers of
:mod:`vigil.operators.history`, or a grouped aggregate joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.functions import hash_hex
from vigil.operators import history as H

ORD_SHIFT = 1 << 40  # challenges sort before attempts at the same instant


def otp_code(seed: str, key_col: str, length: int = 6):
    """Deterministic n-digit code from md5 (issued codes are 6 digits)."""
    n = F.conv(F.substring(hash_hex(seed, F.col(key_col)), 1, 8), 16, 10).cast("bigint") % F.lit(10 ** length)
    return F.lpad(n.cast("string"), length, "0")


def challenges(det: DataFrame) -> DataFrame:
    """H2: one challenge per OTP_REQUIRED/SUSPEND detection; the newest
    replaces older ones, so a challenge is live until the account's next."""
    c = det.where("otp_required").select(
        F.col("account_number"), F.col("transaction_id"), F.col("transaction_ts").alias("issued_ts"),
        F.col("txn_seq").alias("cseq"), otp_code("otp", "transaction_id").alias("otp"))
    c = H.next_after(c, ["account_number"], "issued_ts", "cseq", {}, "_next")
    return c.select("account_number", "transaction_id", "issued_ts", "cseq", "otp",
                    F.col("_next.t").alias("replaced_ts"))


def otp_shape_ok(code_col: str = "otp"):
    """H5: 4 to 8 characters; any other code is no attempt at all."""
    return F.coalesce(F.length(F.col(code_col)).between(4, 8), F.lit(False))


def verify(chal: DataFrame, attempts: DataFrame) -> DataFrame:
    """H3: each well-formed attempt is checked against the account's live
    challenge (latest issued at or before it); a correct code consumes the
    challenge, so only the first correct attempt per challenge is valid;
    a wrong code consumes nothing."""
    a = attempts.where(otp_shape_ok("otp"))
    tl = (chal.select("account_number", F.col("issued_ts").alias("ts"), F.col("cseq").alias("ord"),
                      "otp", F.col("cseq").alias("c_id"), F.lit(None).cast("string").alias("attempt_id"))
          .unionByName(a.select("account_number", F.col("attempt_ts").alias("ts"),
                                (F.lit(ORD_SHIFT) + F.col("attempt_seq")).alias("ord"), "otp",
                                F.lit(None).cast("bigint").alias("c_id"), "attempt_id")))
    tl = H.last_before(tl, ["account_number"], "ts", "ord", {"code": F.col("otp"), "c_id": F.col("c_id")},
                       "_live", cond=F.col("attempt_id").isNull())
    at = tl.where(F.col("attempt_id").isNotNull()).select(
        "attempt_id", "account_number", F.col("ts").alias("attempt_ts"), "ord",
        F.col("_live.c_id").alias("challenge_seq"),
        F.coalesce(F.col("otp") == F.col("_live.code"), F.lit(False)).alias("correct"))
    return first_right(at)


def first_right(at: DataFrame) -> DataFrame:
    """Of the right codes (``correct``) given to a challenge only the first is valid."""
    wins = (at.where("correct").groupBy("challenge_seq")
            .agg(F.min(F.struct("attempt_ts", "ord")).alias("_w")))
    j = at.join(wins, "challenge_seq", "left")
    valid = F.coalesce((F.col("_w.attempt_ts") == F.col("attempt_ts")) & (F.col("_w.ord") == F.col("ord")), F.lit(False))
    return j.select("attempt_id", "account_number", "attempt_ts", "challenge_seq", valid.alias("otp_valid"))


def outcome(verified: DataFrame) -> DataFrame:
    """H4: unlocked or blocked, with the message."""
    v = F.col("otp_valid")
    return verified.withColumn("action", F.when(v, F.lit("ACCOUNT_UNLOCKED")).otherwise(F.lit("ACCOUNT_BLOCKED"))) \
                   .withColumn("message", F.when(v, F.lit(S.UNLOCKED_MSG)).otherwise(F.lit(S.BLOCKED_MSG)))


def suspended_now(det: DataFrame, verified: DataFrame) -> DataFrame:
    """H1: latest SUSPEND per account unless a valid OTP came after it."""
    last = (det.where(F.col("action") == "SUSPEND").groupBy("account_number")
            .agg(F.max(F.struct("transaction_ts", "txn_seq", "transaction_id", "ato_probability",
                                "behavioral_anomaly_score")).alias("s")))
    unlock = (verified.where("otp_valid").groupBy("account_number")
              .agg(F.max("attempt_ts").alias("last_unlock")))
    j = last.join(unlock, "account_number", "left")
    keep = F.col("last_unlock").isNull() | (F.col("last_unlock") < F.col("s.transaction_ts"))
    return j.where(keep).select(
        "account_number", F.col("s.transaction_ts").alias("suspension_time"),
        F.col("s.transaction_id").alias("transaction_id"),
        F.col("s.ato_probability").alias("ato_probability"),
        F.col("s.behavioral_anomaly_score").alias("behavioral_anomaly_score"),
        F.lit("SUSPENDED").alias("status"))
