"""Queries: cleaning, typing and validation (survey 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import bindings
from vigil import schemas as S
from vigil.functions import NUMBER_PATTERN
from vigil.operators import clean, decide, evaluate, history
from vigil.plans.sqltext import sround
from vigil.sources.tables import table

AP = f"WITH ap AS {bindings.APPS_SQL} "
PRESENT_NUM = ["name_email_similarity", "prev_address_months_count", "current_address_months_count",
               "customer_age", "days_since_request", "intended_balcon_amount", "zip_count_4w",
               "velocity_6h", "velocity_24h", "velocity_4w", "credit_risk_score", "email_is_free",
               "phone_home_valid", "proposed_credit_limit", "session_length_in_minutes",
               "device_distinct_emails_8w", "month"]


def _parse_sql(expr: str) -> str:
    """DuckDB text of parse_double (same number pattern as the Spark side)."""
    t = f"trim(CAST({expr} AS VARCHAR))"
    v = f"CASE WHEN regexp_full_match(lower({t}), '{NUMBER_PATTERN[1:-1]}') THEN TRY_CAST({t} AS DOUBLE) END"
    return f"CASE WHEN NOT isnan({v}) THEN {v} END"


def _num_sql(expr: str) -> str:
    """DuckDB text of B5."""
    return f"coalesce({_parse_sql(expr)}, 0.0)"


def processed(spark, sf):
    """A1→B1→B2→B5→B6→B7 as one plan (the processed training table)."""
    d = clean.rename_target(bindings.applications(spark, sf))
    d = clean.project_allowed(d)
    d = clean.coerce_numeric(d)
    d = clean.label_encode(d)
    return clean.drop_null_target(d)


def _code_sql(col):
    return f"""CAST(dense_rank() OVER (ORDER BY coalesce(CAST({col} AS VARCHAR), 'nan')) - 1 AS INTEGER)"""


ALLOWED_PRESENT = [c for c in S.ALL_FEATURES if c in PRESENT_NUM + ["income"] + S.CATEGORICAL_FEATURES]
NUMERIC_PROCESSED = ALLOWED_PRESENT  # every kept column is a number after cleaning


def _processed_sql():
    num = {c: _num_sql(c) for c in S.NUMERIC_FEATURES if c in PRESENT_NUM + ["income"]}
    sel = []
    for c in ALLOWED_PRESENT:
        if c in num:
            sel.append(f"{num[c]} AS {c}")
        else:
            sel.append(f"{_code_sql(c)} AS {c}")
    return AP + f"SELECT {', '.join(sel)}, fraud_bool AS is_ato FROM ap WHERE fraud_bool IS NOT NULL"


SQL_PROCESSED = AP.replace("WITH ap AS", "WITH ap0 AS") + ", ap AS (SELECT * FROM ap0) " + \
    "SELECT * FROM (" + _processed_sql().replace(AP, "").replace(
        "FROM ap WHERE fraud_bool IS NOT NULL", "FROM ap") + ") WHERE is_ato IS NOT NULL"


def q_project(spark, sf):
    return clean.project_allowed(clean.rename_target(bindings.applications(spark, sf)))


SQL_PROJECT = AP + f"SELECT {', '.join(ALLOWED_PRESENT)}, fraud_bool AS is_ato FROM ap"


def q_missing(spark, sf):
    return clean.missing_columns(clean.rename_target(bindings.applications(spark, sf)))


def _counts_sql(columns, present, rel):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {i} AS position, {'true' if c in present else 'false'} AS present, """
        + (f"count({c})" if c in present else "count(CASE WHEN false THEN 1 END)") + f" AS n_filled FROM {rel}" for i, c in enumerate(columns))


def _missing_sql():
    return AP + _counts_sql(S.ALL_FEATURES, set(PRESENT_NUM + ["income"] + S.CATEGORICAL_FEATURES), "ap")


def q_backfill(spark, sf):
    d = clean.backfill_zero(bindings.applications(spark, sf))
    return d.select("application_id", *[c for c in S.NUMERIC_FEATURES if c not in PRESENT_NUM + ["income"]])


SQL_BACKFILL = AP + "SELECT application_id, " + ", ".join(
    f"CAST(0.0 AS DOUBLE) AS {c}" for c in S.NUMERIC_FEATURES if c not in PRESENT_NUM + ["income"]) + " FROM ap"


def q_coerce(spark, sf):
    d = bindings.applications(spark, sf).select("application_id", F.col("income").alias("income_raw"), "income")
    return clean.coerce_numeric(d, ["income"])


SQL_COERCE = AP + f"SELECT application_id, income AS income_raw, {_num_sql('income')} AS income FROM ap"


def q_label_encode(spark, sf):
    d = bindings.applications(spark, sf).select("application_id", *S.CATEGORICAL_FEATURES)
    return clean.label_encode(d)


SQL_LABEL_ENCODE = AP + "SELECT application_id, " + ", ".join(
    f"{_code_sql(c)} AS {c}" for c in S.CATEGORICAL_FEATURES) + " FROM ap"


def q_drop_null(spark, sf):
    d = clean.rename_target(bindings.applications(spark, sf)).select("application_id", "is_ato")
    return clean.drop_null_target(d)


SQL_DROP_NULL = AP + "SELECT application_id, fraud_bool AS is_ato FROM ap WHERE fraud_bool IS NOT NULL"


def q_balance(spark, sf):
    return evaluate.class_balance(processed(spark, sf), "is_ato")


def balance_sql(rel, label="is_ato"):
    return f"""SELECT count(*) AS rows, CAST(coalesce(sum(CAST({label} AS BIGINT)), 0) AS BIGINT) AS positives,
  CASE WHEN count(*) > 0 THEN {sround(f'coalesce(sum(CAST({label} AS BIGINT)), 0) * 100.0 / count(*)', 4)} ELSE 0.0 END AS pct_positive
FROM {rel}"""


SQL_BALANCE = AP + ", p AS (SELECT fraud_bool AS is_ato FROM ap WHERE fraud_bool IS NOT NULL) " + balance_sql("p")


def q_features(spark, sf):
    return clean.feature_projection(bindings.applications(spark, sf), keep=["application_id"])


SQL_FEATURES = AP + "SELECT application_id, " + ", ".join(
    f"{_num_sql(c) if c in PRESENT_NUM + ['income'] or c in S.CATEGORICAL_FEATURES else 'CAST(0.0 AS DOUBLE)'} AS {c}"
    for c in S.MODEL_FEATURES) + " FROM ap"


def q_numeric_columns(spark, sf):
    return clean.numeric_feature_counts(processed(spark, sf))


def _numeric_columns_sql():
    return f"WITH pr AS ({SQL_PROCESSED}) SELECT * EXCLUDE (present) FROM ({_counts_sql(NUMERIC_PROCESSED, set(NUMERIC_PROCESSED), 'pr')})"


def q_flags(spark, sf):
    e = table(spark, sf, "events")
    txt = (F.when(F.col("event_id") % 5 == 0, F.lit("true")).when(F.col("event_id") % 5 == 1, F.lit("false"))
            .when(F.col("event_id") % 5 == 2, F.lit("1")).when(F.col("event_id") % 5 == 3, F.lit(" TRUE "))
            .otherwise(F.lit(None).cast("string")))
    d = e.select("event_id", txt.alias("flag_raw"), txt.alias("ip_blacklisted"))
    return clean.coerce_flags(d, ["ip_blacklisted"])


SQL_FLAGS = """SELECT event_id, flag_raw, CASE WHEN lower(trim(flag_raw)) IN ('true', '1', '1.0', 'yes', 't', 'y') THEN 1 ELSE 0 END AS ip_blacklisted
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN ' TRUE ' END AS flag_raw FROM events)"""


def _requests(spark, sf):
    """Transaction requests from orders: some lack an amount, some carry an
    out-of-range fraud score or a bad count."""
    tx = bindings.transactions(spark, sf)
    s = F.col("txn_seq")
    return tx.select(
        "transaction_id", "account_number",
        F.when(s % 97 == 0, F.lit(None).cast("double")).otherwise(F.col("transaction_amount")).alias("transaction_amount"),
        F.round(F.col("ip_fraud_score") * 1.2, 4).alias("ip_fraud_score"),
        F.when(s % 89 == 0, F.lit("-1")).when(s % 83 == 0, F.lit("two"))
         .when(s % 79 == 0, F.lit("2.5"))
         .otherwise(F.col("failed_auth_attempts").cast("string")).alias("failed_auth_attempts"),
        F.when(s % 73 == 0, F.lit("fast")).when(s % 5 == 0, F.lit("4.25")).alias("typing_speed_mobile"),
        F.when(s % 71 == 0, F.lit("maybe")).when(s % 2 == 0, F.lit(" Yes ")).otherwise(F.lit("false")).alias("new_device"),
        F.when(s % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("ip_address")).alias("ip_address"))


REQ = f"""WITH tx AS {bindings.TXN_SQL}, rq AS (SELECT transaction_id, account_number,
   CASE WHEN txn_seq % 97 = 0 THEN NULL ELSE transaction_amount END AS transaction_amount,
   {sround('ip_fraud_score * 1.2', 4)} AS ip_fraud_score,
   CASE WHEN txn_seq % 89 = 0 THEN '-1' WHEN txn_seq % 83 = 0 THEN 'two' WHEN txn_seq % 79 = 0 THEN '2.5' ELSE CAST(failed_auth_attempts AS VARCHAR) END AS failed_auth_attempts,
   CASE WHEN txn_seq % 73 = 0 THEN 'fast' WHEN txn_seq % 5 = 0 THEN '4.25' END AS typing_speed_mobile,
   CASE WHEN txn_seq % 71 = 0 THEN 'maybe' WHEN txn_seq % 2 = 0 THEN ' Yes ' ELSE 'false' END AS new_device,
   CASE WHEN txn_seq % 7 = 0 THEN NULL ELSE ip_address END AS ip_address FROM tx),
 v AS (SELECT transaction_id, account_number, transaction_amount, ip_fraud_score, coalesce(ip_address, '0.0.0.0') AS ip_address,
   failed_auth_attempts,
   list_filter([CASE WHEN transaction_amount IS NULL THEN 'missing:transaction_amount' END,
    CASE WHEN failed_auth_attempts IS NOT NULL AND coalesce({_parse_sql('failed_auth_attempts')} <> floor({_parse_sql('failed_auth_attempts')}), true) THEN 'type:failed_auth_attempts' END,
    CASE WHEN typing_speed_mobile = 'fast' THEN 'type:typing_speed_mobile' END,
    CASE WHEN lower(trim(new_device)) NOT IN ('0', '1', 'true', 'false', 't', 'f', 'yes', 'no', 'y', 'n', 'on', 'off') THEN 'type:new_device' END,
    CASE WHEN ip_fraud_score < 0 THEN 'min:ip_fraud_score' END, CASE WHEN ip_fraud_score > 1 THEN 'max:ip_fraud_score' END,
    CASE WHEN {_parse_sql('failed_auth_attempts')} < 0 THEN 'min:failed_auth_attempts' END], lambda x: x IS NOT NULL) AS errors
   FROM rq) """


def q_validate_accepted(spark, sf):
    v = clean.validate(_requests(spark, sf))
    return clean.accepted(v).select("transaction_id", "account_number", "transaction_amount",
                                    "ip_fraud_score", "ip_address", "failed_auth_attempts")


def q_validate_rejected(spark, sf):
    v = clean.validate(_requests(spark, sf))
    return clean.rejected(v).select("transaction_id", F.array_join("errors", ";").alias("errors"))


def q_txn_id(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("EVT-"), F.col("event_id").cast("string")))
        .alias("transaction_id"))
    return clean.ensure_transaction_id(e, "event_id")


SQL_TXN_ID = """SELECT event_id, coalesce(CASE WHEN trim(t) <> '' THEN t END, 'TXN-' || upper(substr(md5(CAST(event_id AS VARCHAR)), 1, 12))) AS transaction_id
FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'EVT-' || CAST(event_id AS VARCHAR) END AS t FROM events)"""


def q_amount_fallback(spark, sf):
    a = bindings.applications(spark, sf).select(
        "application_id", "intended_balcon_amount",
        F.when(F.col("application_id") % 5 == 0, F.col("zip_count_4w").cast("double")).alias("transaction_amount"))
    return clean.amount_fallback(a)


SQL_AMOUNT_FALLBACK = AP + """SELECT application_id, intended_balcon_amount,
  coalesce(CASE WHEN application_id % 5 = 0 THEN CAST(zip_count_4w AS DOUBLE) END,
           CASE WHEN intended_balcon_amount > 0 THEN intended_balcon_amount END, 1000.0) AS transaction_amount FROM ap"""


def q_clip(spark, sf):
    a = bindings.applications(spark, sf).select(
        "application_id", F.when(F.col("application_id") % 10 != 0, F.col("intended_balcon_amount")).alias("amount"))
    return clean.clip(a, {"amount": (0.0, 50.0)})


SQL_CLIP = AP + """SELECT application_id, CASE WHEN a IS NOT NULL THEN greatest(0.0, least(50.0, a)) END AS amount
FROM (SELECT application_id, CASE WHEN application_id % 10 <> 0 THEN intended_balcon_amount END AS a FROM ap)"""

# FIXED VALUES: user-agent texts of the reference's generator, in its order
USER_AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64)",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7)",
    "Mozilla/5.0 (Android 13; Mobile)",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 16_0 like Mac OS X)",
    "Mozilla/5.0 (Android 12; Mobile) AppleWebKit/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15",
]


def q_user_agent(spark, sf):
    ev = bindings.session_events(spark, sf)
    ua = F.element_at(F.array(*[F.lit(x) for x in USER_AGENTS]), (F.col("device") % 8 + 1).cast("int"))
    d = ev.select("event_id", ua.alias("user_agent_raw"))
    return d.select("event_id", "user_agent_raw", clean.parse_user_agent())


SQL_USER_AGENT = f"""WITH ev AS {bindings.EVENTS_SQL}, u AS (SELECT event_id,
  {[x for x in USER_AGENTS]}[CAST(device % 8 AS INTEGER) + 1] AS user_agent_raw FROM ev)
SELECT event_id, user_agent_raw,
  CASE WHEN contains(user_agent_raw, 'Linux') OR contains(user_agent_raw, 'Android')
       THEN regexp_replace(string_split(user_agent_raw, ' ')[3], '^\\(+|\\(+$', '', 'g') || ',' || string_split(user_agent_raw, ' ')[4]
       ELSE 'Windows,Chrome' END AS user_agent_parsed FROM u"""


def q_travel_speed(spark, sf):
    ev = bindings.session_events(spark, sf)
    d = history.last_before(ev, ["account"], "ts", "event_id", {}, "_prev")
    days = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_prev.t").cast("timestamp"))) / 86400e6
    d = d.select("event_id", (F.col("amount") * 10).alias("km"), days.alias("days"))
    return d.select("event_id", F.round("km", 6).alias("km"), F.round("days", 6).alias("days"),
                    clean.travel_speed("km", "days"))


SQL_TRAVEL_SPEED = f"""WITH ev AS {bindings.EVENTS_SQL}, x AS (SELECT event_id, amount * 10 AS km,
  (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id))) / 86400000000.0 AS days FROM ev)
SELECT event_id, {sround('km', 6)} AS km, {sround('days', 6)} AS days,
  CAST(trunc(CASE WHEN days * 24 <> 0 THEN km / (days * 24) END) AS BIGINT) AS speed_of_travel_kmh FROM x"""


def q_ids_first(spark, sf):
    from vigil.plans import detect
    s = decide.band_and_action(detect.detections(spark, sf).select("ip_country", "transaction_id",
                                                                  "account_number", "ato_probability"))
    return clean.ids_first(s)


def _ids_first_sql():
    from vigil.plans import detect
    return f"""WITH d AS {detect.DETECTIONS_SQL} SELECT account_number, transaction_id, ato_probability,
  CASE WHEN ato_probability > -0.001 AND ato_probability <= 0.499 THEN 'LOW'
       WHEN ato_probability > 0.499 AND ato_probability <= 0.799 THEN 'MEDIUM'
       WHEN ato_probability > 0.799 AND ato_probability <= 1.001 THEN 'HIGH' END AS risk_level,
  CASE WHEN ato_probability > -0.001 AND ato_probability <= 0.499 THEN 'ALLOW'
       WHEN ato_probability > 0.499 AND ato_probability <= 0.799 THEN 'OTP REQUIRED'
       WHEN ato_probability > 0.799 AND ato_probability <= 1.001 THEN 'SUSPEND' END AS recommended_action,
  ip_country FROM d"""


def q_prepare(spark, sf):
    d = clean.rename_target(bindings.applications(spark, sf)).select("application_id", "device_os", "is_ato")
    return clean.prepare_for_scoring(d)


SQL_PREPARE = AP + "SELECT application_id, CAST(device_os AS VARCHAR) AS device_os FROM ap"

REGISTRY = {
    "a1_b7_processed_table": (processed, SQL_PROCESSED),
    "b1_b2_project": (q_project, SQL_PROJECT),
    "b3_missing_columns": (q_missing, _missing_sql()),
    "b4_backfill_zero": (q_backfill, SQL_BACKFILL),
    "b5_coerce_numeric": (q_coerce, SQL_COERCE),
    "b6_label_encode": (q_label_encode, SQL_LABEL_ENCODE),
    "b7_drop_null_target": (q_drop_null, SQL_DROP_NULL),
    "b8_class_balance": (q_balance, SQL_BALANCE),
    "b9_feature_projection": (q_features, SQL_FEATURES),
    "b10_numeric_columns": (q_numeric_columns, _numeric_columns_sql()),
    "b11_flag_coercion": (q_flags, SQL_FLAGS),
    "b12_validate_accepted": (q_validate_accepted, REQ + "SELECT transaction_id, account_number, transaction_amount, ip_fraud_score, ip_address, failed_auth_attempts FROM v WHERE len(errors) = 0"),
    "b12_validate_rejected": (q_validate_rejected, REQ + "SELECT transaction_id, array_to_string(errors, ';') AS errors FROM v WHERE len(errors) > 0"),
    "b13_transaction_id": (q_txn_id, SQL_TXN_ID),
    "b14_amount_fallback": (q_amount_fallback, SQL_AMOUNT_FALLBACK),
    "b15_clip": (q_clip, SQL_CLIP),
    "b16_user_agent": (q_user_agent, SQL_USER_AGENT),
    "b17_travel_speed": (q_travel_speed, SQL_TRAVEL_SPEED),
    "b18_ids_first": (q_ids_first, None),
    "b19_prepare_for_scoring": (q_prepare, SQL_PREPARE),
}

REGISTRY["b18_ids_first"] = (q_ids_first, _ids_first_sql())
