"""Scores and decisions (survey 2.5 E6-E8 and 2.6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.functions import band, behavioral_level, decide_action, rule_score


def with_decision(df: DataFrame, p: str = "ato_probability",
                  b: str = "behavioral_anomaly_score") -> DataFrame:
    """F1 + F4 + F7: action, flags, confirmed fraud; p and b rounded to 4,
    their full values kept as ``raw_p`` and ``raw_b``."""
    p4, b4 = F.round(F.col(p), 4), F.round(F.col(b), 4)
    action = decide_action(F.col(p), F.col(b))
    otp = action != F.lit("ALLOW")
    return (df.withColumn("action", action)
              .withColumn("otp_required", otp)
              .withColumn("contact_mobile", otp)
              .withColumn("suspension_mode", F.when(action == "SUSPEND", F.lit("REVIEW")))
              .withColumn("ato_confirmed", (F.col(p) > S.THRESH_CONFIRMED) & otp)
              .withColumn("raw_p", F.col(p)).withColumn("raw_b", F.col(b))
              .withColumn(p, p4).withColumn(b, b4))


def behaviour_or_default(c: str = "behavioral_anomaly_score") -> Column:
    """K5: behavioural score from the record, else .05."""
    return F.coalesce(F.col(c).cast("double"), F.lit(S.DEFAULT_BEHAVIORAL))


def score_rules(df: DataFrame, out: str = "ato_probability") -> DataFrame:
    """E8 on a transaction frame with the rule inputs (nulls count as 0)."""
    return df.withColumn(out, rule_score())


def band_and_action(df: DataFrame, p: str = "ato_probability") -> DataFrame:
    """band on p rounded to 4 digits and the recommended action."""
    p4 = F.round(F.col(p), 4)
    lvl = band(p4)
    act = F.when(lvl == "HIGH", F.lit(S.BAND_ACTIONS["HIGH"])) \
           .when(lvl == "MEDIUM", F.lit(S.BAND_ACTIONS["MEDIUM"])) \
           .when(lvl == "LOW", F.lit(S.BAND_ACTIONS["LOW"]))
    return df.withColumn(p, p4).withColumn("risk_level", lvl).withColumn("recommended_action", act)


def risk_level(df: DataFrame, b: str = "anomaly_score", out: str = "risk_level") -> DataFrame:
    """F6."""
    return df.withColumn(out, behavioral_level(F.col(b)))


def response_record(df: DataFrame, p: str = "ato_probability",
                    b: str = "behavioral_anomaly_score", phone: str | None = None) -> DataFrame:
    """F3 + F5: warning text, capability map, action list and blacklist
    result struct, built from the decision columns (the warning shows the
    score as it was, ``raw_b``, if that is kept)."""
    act = F.col("action")
    shown = "raw_b" if "raw_b" in df.columns else b
    b3 = F.format_string("%.3f", F.round(F.col(shown), 3))
    warning = (F.when(act == "SUSPEND", F.format_string(S.HIGH_WARNING.replace("%.3f", "%s"), b3))
                .when(act == "OTP_REQUIRED", F.format_string(S.MED_WARNING.replace("%.3f", "%s"), b3)))
    caps = F.when(act == "SUSPEND", F.create_map(*[x for k, v in S.SUSPENDED_CAPABILITIES
                                                   for x in (F.lit(k), F.lit(v))]))
    mobile = F.coalesce(F.col(phone), F.lit(S.DEFAULT_MOBILE)) if phone else F.lit(S.DEFAULT_MOBILE)

    def step(action, desc, duration=None, auto_unlock=None, otp_method=None, mob=None):
        return F.struct(F.lit(action).alias("action"), F.lit(desc).alias("description"),
                        F.lit(duration).cast("string").alias("duration"),
                        F.lit(auto_unlock).cast("boolean").alias("auto_unlock"),
                        F.lit(otp_method).cast("string").alias("otp_method"),
                        (mob if mob is not None else F.lit(None)).cast("string").alias("mobile"))
    high = F.array(step("SUSPEND_ACCOUNT", S.SUSPEND_DESC, S.SUSPEND_DURATION, True),
                   step("TRIGGER_OTP", S.OTP_DESC_HIGH, otp_method="SMS"),
                   step("CONTACT_REGISTERED_MOBILE", S.CONTACT_DESC, mob=mobile))
    med = F.array(step("TRIGGER_OTP", S.OTP_DESC_MED, otp_method="SMS"),
                  step("SEND_WARNING_SMS", S.WARN_SMS_DESC, mob=mobile))
    empty = F.array_except(med, med)
    actions = F.when(act == "SUSPEND", high).when(act == "OTP_REQUIRED", med).otherwise(empty)
    conf = F.col("ato_confirmed")
    bl = F.struct(conf.alias("ip_blacklisted"), conf.alias("device_blacklisted"),
                  conf.alias("beneficiary_blacklisted"),
                  F.when(conf, F.lit(S.CONFIRMED_REASON)).otherwise(F.lit(S.NOT_CONFIRMED_REASON)).alias("reason"))
    return (df.withColumn("behavioral_warning", warning)
              .withColumn("user_capabilities", caps)
              .withColumn("user_actions", actions)
              .withColumn("blacklist_result", bl))


def row_model_choice(df: DataFrame, out: str = "model_used") -> DataFrame:
    """≥8 non-null behavioural features → behavioral, else tabular when
    the row has any tabular feature, else rules."""
    beh = [F.col(c).isNotNull().cast("int") for c in S.BEHAVIORAL_FEATURES if c in df.columns]
    tab = [c for c in S.MODEL_FEATURES if c in df.columns]
    n_beh = sum(beh[1:], beh[0]) if beh else F.lit(0)
    any_tab = F.coalesce(*[F.col(c).cast("string") for c in tab]).isNotNull() if tab else F.lit(False)
    return df.withColumn("behavioral_features_present", n_beh).withColumn(
        out, F.when(n_beh >= S.ROW_PICK_MIN_BEHAVIORAL, F.lit("behavioral"))
              .when(any_tab, F.lit("tabular")).otherwise(F.lit("rules")))
