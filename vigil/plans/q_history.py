"""Queries: history features over events and transactions (survey 2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import bindings
from vigil.functions import epoch_us
from vigil.operators import history as H
from vigil.plans.sqltext import sround
from vigil.session import materialize

HOUR = H.HOUR_US
DAY = H.DAY_US
WEEK = 7 * DAY
EV = f"WITH ev AS {bindings.EVENTS_SQL} "
TX = f"WITH tx AS {bindings.TXN_SQL} "


def _ev(spark, sf):
    return bindings.session_events(spark, sf)


def q_velocity(spark, sf):
    ev = _ev(spark, sf)
    widths = {"velocity_6h": 6 * HOUR, "velocity_24h": DAY, "velocity_4w": 4 * WEEK}
    r = H.rolling_sums(ev, ["account"], "ts", "event_id", {n: (w, F.lit(1)) for n, w in widths.items()})
    return ev.select("event_id", "account").join(r, "event_id")


def _range_sql(agg, part, w, order="epoch_us(ts)"):
    return f"{agg} OVER (PARTITION BY {part} ORDER BY {order} RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"


SQL_VELOCITY = EV + f"""SELECT event_id, account,
  {_range_sql('count(*)', 'account', 6 * HOUR)} AS velocity_6h,
  {_range_sql('count(*)', 'account', DAY)} AS velocity_24h,
  {_range_sql('count(*)', 'account', 4 * WEEK)} AS velocity_4w FROM ev"""


def q_txn_frequency(spark, sf):
    p = _ev(spark, sf).where("event_type = 'purchase'")
    widths = {"txn_frequency_1h": HOUR, "txn_frequency_24h": DAY}
    r = H.rolling_sums(p, ["account"], "ts", "event_id", {n: (w, F.lit(1)) for n, w in widths.items()})
    return p.select("event_id", "account").join(r, "event_id")


SQL_TXN_FREQUENCY = EV + f"""SELECT event_id, account,
  {_range_sql('count(*)', 'account', HOUR)} AS txn_frequency_1h,
  {_range_sql('count(*)', 'account', DAY)} AS txn_frequency_24h FROM ev WHERE event_type = 'purchase'"""


def q_failed_1h(spark, sf):
    ev = _ev(spark, sf)
    failed = F.coalesce((F.col("event_type") == "error").cast("int"), F.lit(0))
    r = H.rolling_sums(ev, ["account"], "ts", "event_id", {"failed_tx_count_1h": (HOUR, failed)})
    return ev.select("event_id", "account").join(r, "event_id")


SQL_FAILED_1H = EV + f"""SELECT event_id, account,
  {_range_sql("count(CASE WHEN event_type = 'error' THEN 1 END)", 'account', HOUR)} AS failed_tx_count_1h FROM ev"""


def q_amount_vs_avg(spark, sf):
    p = _ev(spark, sf).where("event_type = 'purchase'")
    d = H.sums_before(p, ["account"], ["ts", "event_id"], {"_sum": F.col("amount"), "_n": F.lit(1)})
    # an average of nothing but zeros has no ratio to it
    ratio = F.when(F.col("_n") > 0, F.try_divide("amount", F.col("_sum") / F.col("_n")))
    return d.select("event_id", "account", "amount",
                    F.col("_n").cast("bigint").alias("prior_purchases"),
                    F.round(ratio, 6).alias("tx_amount_vs_historical_avg_ratio"))


SQL_AMOUNT_VS_AVG = EV + f"""SELECT event_id, account, amount, prior_purchases,
  CASE WHEN prior_purchases > 0 THEN {sround('amount / (s / prior_purchases)', 6)} END AS tx_amount_vs_historical_avg_ratio
FROM (SELECT *, coalesce(sum(amount) OVER w, 0) AS s, CAST(count(*) OVER w AS BIGINT) AS prior_purchases
      FROM ev WHERE event_type = 'purchase'
      WINDOW w AS (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) x"""


def q_amount_percentile(spark, sf):
    """Share of the account's earlier purchases whose amount is ≤ the
    current one (null for a first purchase)."""
    p = _ev(spark, sf).where("event_type = 'purchase'")
    d = H.earlier_at_most(p, ["account"], "ts", "event_id", "amount", "event_id")
    pct = F.when(F.col("prior_rows") > 0, F.round(F.col("earlier_at_most") / F.col("prior_rows"), 6))
    return d.select("event_id", "account", "amount", "prior_rows", "earlier_at_most", pct.alias("amount_percentile"))


SQL_AMOUNT_PERCENTILE = EV + f""", p AS (SELECT *, CAST(row_number() OVER (PARTITION BY account ORDER BY ts, event_id) - 1 AS BIGINT) AS r
  FROM ev WHERE event_type = 'purchase'),
 c AS (SELECT a.event_id, CAST(count(b.event_id) AS BIGINT) AS n FROM p a LEFT JOIN p b
       ON a.account = b.account AND b.r < a.r AND b.amount <= a.amount GROUP BY a.event_id)
SELECT p.event_id, p.account, p.amount, p.r AS prior_rows, c.n AS earlier_at_most,
  CASE WHEN p.r > 0 THEN {sround('c.n / p.r', 6)} END AS amount_percentile
FROM p JOIN c ON p.event_id = c.event_id"""


def q_new_device(spark, sf):
    ev = _ev(spark, sf)
    return H.first_seen(ev, ["account", "device"], "ts", "event_id", "is_new_device_uid").select(
        "event_id", "account", "device", "is_new_device_uid")


SQL_NEW_DEVICE = EV + """SELECT event_id, account, device,
  CASE WHEN device IS NULL THEN false ELSE row_number() OVER (PARTITION BY account, device ORDER BY ts, event_id) = 1 END AS is_new_device_uid
FROM ev"""


def q_distinct(spark, sf):
    ev = _ev(spark, sf)
    a = H.distinct_in_window(ev, "device", "account", "ts", "event_id", DAY, "event_id",
                             "device_distinct_accounts_24h")
    b = H.distinct_in_window(ev, "account", "device", "ts", "event_id", 4 * WEEK, "event_id",
                             "account_distinct_devices_4w")
    return ev.select("event_id", "account", "device").join(a, "event_id").join(b, "event_id")


SQL_DISTINCT = EV + f"""SELECT event_id, account, device,
  CAST(coalesce(len(list_distinct({_range_sql('list(account)', 'device', DAY)})), 0) AS INTEGER) AS device_distinct_accounts_24h,
  CAST(coalesce(len(list_distinct({_range_sql('list(device)', 'account', 4 * WEEK)})), 0) AS INTEGER) AS account_distinct_devices_4w
FROM ev"""


def q_new_beneficiary(spark, sf):
    tx = bindings.transactions(spark, sf)
    return H.first_seen(tx, ["account_number", "beneficiary_account"], "transaction_ts", "txn_seq", "new_beneficiary").select(
        "transaction_id", "account_number", "beneficiary_account", "new_beneficiary")


SQL_NEW_BENEFICIARY = TX + """SELECT transaction_id, account_number, beneficiary_account,
  CASE WHEN beneficiary_account IS NULL THEN false
       ELSE row_number() OVER (PARTITION BY account_number, beneficiary_account ORDER BY transaction_ts, txn_seq) = 1 END AS new_beneficiary
FROM tx"""


def q_distinct_transactions(spark, sf):
    """L7 over the transactions: accounts per country in a day, ips and devices per account in eight weeks."""
    tx = materialize(bindings.transactions(spark, sf), "transactions")
    out = tx.select("transaction_id", "account_number", "ip_country")
    for key, counts in (("ip_country", {"country_distinct_accounts_24h": ("account_number", DAY)}),
                        ("account_number", {"account_distinct_ips_8w": ("ip_address", 8 * WEEK),
                                            "account_distinct_devices_8w": ("device_id", 8 * WEEK)})):
        found = H.distinct_in_windows(tx, key, "transaction_ts", "txn_seq", "transaction_id", counts)
        for name in counts:
            out = out.join(found.select("transaction_id", name), "transaction_id")
    return out


SQL_DISTINCT_TRANSACTIONS = TX + f"""SELECT transaction_id, account_number, ip_country,
  CAST(coalesce(len(list_distinct({_range_sql('list(account_number)', 'ip_country', DAY, 'epoch_us(transaction_ts)')})), 0) AS INTEGER) AS country_distinct_accounts_24h,
  CAST(coalesce(len(list_distinct({_range_sql('list(ip_address)', 'account_number', 8 * WEEK, 'epoch_us(transaction_ts)')})), 0) AS INTEGER) AS account_distinct_ips_8w,
  CAST(coalesce(len(list_distinct({_range_sql('list(device_id)', 'account_number', 8 * WEEK, 'epoch_us(transaction_ts)')})), 0) AS INTEGER) AS account_distinct_devices_8w
FROM tx"""


def q_prior_frauds(spark, sf):
    tx = materialize(bindings.transactions(spark, sf), "transactions")
    fraud = F.coalesce((F.col("actual_is_ato") == 1).cast("bigint"), F.lit(0).cast("bigint"))
    d = H.running_before(tx, ["device_id"], "transaction_ts", "txn_seq", fraud, "device_fraud_count")
    d = H.running_before(d, ["account_number"], "transaction_ts", "txn_seq", fraud, "previous_fraud_flags")
    return d.select("transaction_id", "device_id", "account_number",
                    F.col("device_fraud_count").cast("bigint").alias("device_fraud_count"),
                    F.col("previous_fraud_flags").cast("bigint").alias("previous_fraud_flags"))


SQL_PRIOR_FRAUDS = TX + """SELECT transaction_id, device_id, account_number,
  CAST(coalesce(sum(CASE WHEN actual_is_ato = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY transaction_ts, txn_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS device_fraud_count,
  CAST(coalesce(sum(CASE WHEN actual_is_ato = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY account_number ORDER BY transaction_ts, txn_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS previous_fraud_flags
FROM tx"""


def q_days_since_last(spark, sf):
    ev = _ev(spark, sf)
    d = H.last_before(ev, ["account"], "ts", "event_id", {}, "_prev")
    days = (epoch_us("ts") - epoch_us(F.col("_prev.t"))) / F.lit(float(DAY))
    return d.select("event_id", "account", F.round(days, 6).alias("days_since_last_login"))


SQL_DAYS_SINCE_LAST = EV + f"""SELECT event_id, account,
  {sround('(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id))) / 86400000000.0', 6)} AS days_since_last_login
FROM ev"""


def q_account_age(spark, sf):
    ev = _ev(spark, sf)
    d = H.first_per_key(ev, ["account"], "ts", "_first")
    days = (epoch_us("ts") - epoch_us("_first")) / F.lit(float(DAY))
    return d.select("event_id", "account", F.round(days, 6).alias("account_age_days"),
                    F.floor(days / 30.0).cast("bigint").alias("account_age_months"))


SQL_ACCOUNT_AGE = EV + f"""SELECT event_id, account, {sround('d', 6)} AS account_age_days,
  CAST(floor(d / 30.0) AS BIGINT) AS account_age_months FROM
 (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY account))) / 86400000000.0 AS d FROM ev) x"""


def q_login_hour(spark, sf):
    ev = _ev(spark, sf).withColumn("login_hour_of_day_local", F.hour("ts"))
    d = H.running_before(ev, ["account"], "ts", "event_id", F.lit(1), "_all")
    d = H.running_before(d, ["account", "login_hour_of_day_local"], "ts", "event_id", F.lit(1), "_same")
    score = F.lit(1.0) - F.col("_same") / F.greatest(F.col("_all"), F.lit(1))
    return d.select("event_id", "account", "login_hour_of_day_local",
                    F.round(score, 6).alias("login_hour_anomaly_score"))


SQL_LOGIN_HOUR = EV + f"""SELECT event_id, account, CAST(hour(ts) AS INTEGER) AS login_hour_of_day_local,
  {sround('1.0 - coalesce(count(*) OVER (PARTITION BY account, hour(ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(coalesce(count(*) OVER (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 1)', 6)} AS login_hour_anomaly_score
FROM ev"""


def q_country_mismatch(spark, sf):
    tx = bindings.transactions(spark, sf)
    return tx.select("transaction_id", "ip_country", "location_city",
                     F.coalesce(F.col("location_city") != F.col("ip_country"), F.lit(False))
                     .alias("country_mismatch_with_profile"))


SQL_COUNTRY_MISMATCH = TX + """SELECT transaction_id, ip_country, location_city,
  coalesce(location_city <> ip_country, false) AS country_mismatch_with_profile FROM tx"""


def q_payee_payout(spark, sf):
    ev = _ev(spark, sf)
    d = H.last_before(ev, ["account"], "ts", "event_id", {}, "_signup", cond=F.col("event_type") == "signup")
    d = H.last_before(d, ["account"], "ts", "event_id", {}, "_prev")
    mins = (epoch_us("ts") - epoch_us(F.col("_signup.t"))) / F.lit(60_000_000.0)
    secs = (epoch_us("ts") - epoch_us(F.col("_prev.t"))) / F.lit(1_000_000.0)
    return d.select(
        "event_id", "account", "event_type",
        F.when(F.col("event_type") == "purchase", F.round(mins, 4)).alias("time_from_payee_addition_to_payout_minutes"),
        F.when(F.col("event_type") == "signup", F.round(secs, 4)).alias("time_to_profile_change_seconds"))


SQL_PAYEE_PAYOUT = EV + f"""SELECT event_id, account, event_type,
  CASE WHEN event_type = 'purchase' THEN {sround('(epoch_us(ts) - epoch_us(last_signup)) / 60000000.0', 4)} END AS time_from_payee_addition_to_payout_minutes,
  CASE WHEN event_type = 'signup' THEN {sround('(epoch_us(ts) - epoch_us(prev_ts)) / 1000000.0', 4)} END AS time_to_profile_change_seconds
FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_signup,
             lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id) AS prev_ts FROM ev) x"""

SESSION_GAP = 12 * HOUR


#: The event types that each count of a session is of.
SESSION_COUNTS = {"n_pages": ("click", "view"), "failed_login_attempts_session": ("error",), "n_purchases": ("purchase",), "n_signups": ("signup",)}


def session_aggregates() -> dict:
    """What a session adds up, but for its number of devices."""
    kinds = {n: F.count_if(F.col("event_type").isin(*k)).cast("bigint") for n, k in SESSION_COUNTS.items()}
    return {"n_events": F.count(F.lit(1)).cast("bigint"), **kinds, "_amount": F.sum("amount")}


def session_columns(g):
    """The session table from start, end and the aggregates."""
    minutes = (epoch_us("session_end") - epoch_us("session_start")) / F.lit(60_000_000.0)
    return g.select(
        "account", "session_no", "session_start", "session_end", "n_events", "n_pages",
        "failed_login_attempts_session", "n_purchases", "n_signups", "n_devices",
        F.round(minutes, 6).alias("session_length_in_minutes"),
        F.floor((epoch_us("session_end") - epoch_us("session_start")) / F.lit(1_000_000)).cast("bigint")
         .alias("session_length_seconds"),
        F.round(F.col("n_pages") / F.greatest(minutes, F.lit(1.0)), 6).alias("page_navigation_velocity"),
        F.round(F.col("_amount"), 2).alias("session_amount"))


def sessions(spark, sf, gap_us: int = SESSION_GAP):
    ev = _ev(spark, sf)
    d = H.gap_sessions(ev, ["account"], "ts", "event_id", gap_us)
    g = d.groupBy("account", "session_no").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"),
        *[c.alias(n) for n, c in session_aggregates().items()],
        F.countDistinct("device").cast("bigint").alias("n_devices"))
    return session_columns(g)


SQL_SESSIONS = EV + f"""SELECT account, session_no, min(ts) AS session_start, max(ts) AS session_end,
  count(*) AS n_events, count_if(event_type IN ('click', 'view')) AS n_pages,
  count_if(event_type = 'error') AS failed_login_attempts_session, count_if(event_type = 'purchase') AS n_purchases,
  count_if(event_type = 'signup') AS n_signups,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS session_length_seconds,
  count(DISTINCT device) AS n_devices,
  {sround('(epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0', 6)} AS session_length_in_minutes,
  {sround('count_if(event_type IN (\'click\', \'view\')) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0, 1.0)', 6)} AS page_navigation_velocity,
  {sround('sum(amount)', 2)} AS session_amount
FROM (SELECT *, CAST(sum(st) OVER (PARTITION BY account ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM
  (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id) IS NULL
                    OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id)) > {SESSION_GAP}
                  THEN 1 ELSE 0 END AS st FROM ev) a) b
GROUP BY account, session_no"""


def q_rolling_other_keys(spark, sf):
    ev = _ev(spark, sf)
    a = H.rolling_sums(ev, ["device"], "ts", "event_id", {"device_events_4w": (4 * WEEK, F.lit(1))})
    return ev.select("event_id", "device").join(a, "event_id")


SQL_ROLLING_OTHER = EV + f"""SELECT event_id, device, {_range_sql('count(*)', 'device', 4 * WEEK)} AS device_events_4w FROM ev"""


def q_country_8w(spark, sf):
    tx = materialize(bindings.transactions(spark, sf), "transactions")
    a = H.rolling_sums(tx, ["ip_country"], "transaction_ts", "transaction_id", {"country_txn_8w": (8 * WEEK, F.lit(1))})
    return tx.select("transaction_id", "ip_country").join(a, "transaction_id")


SQL_COUNTRY_8W = TX + f"""SELECT transaction_id, ip_country,
  {_range_sql('count(*)', 'ip_country', 8 * WEEK, 'epoch_us(transaction_ts)')} AS country_txn_8w FROM tx"""


REGISTRY = {
    "l1_velocity": (q_velocity, SQL_VELOCITY),
    "l2_txn_frequency": (q_txn_frequency, SQL_TXN_FREQUENCY),
    "l3_failed_tx_1h": (q_failed_1h, SQL_FAILED_1H),
    "l4_amount_vs_avg": (q_amount_vs_avg, SQL_AMOUNT_VS_AVG),
    "l5_amount_percentile": (q_amount_percentile, SQL_AMOUNT_PERCENTILE),
    "l6_new_device": (q_new_device, SQL_NEW_DEVICE),
    "l6_new_beneficiary": (q_new_beneficiary, SQL_NEW_BENEFICIARY),
    "l7_distinct_transactions": (q_distinct_transactions, SQL_DISTINCT_TRANSACTIONS),
    "l7_distinct_rolling": (q_distinct, SQL_DISTINCT),
    "l8_prior_frauds": (q_prior_frauds, SQL_PRIOR_FRAUDS),
    "l9_days_since_last": (q_days_since_last, SQL_DAYS_SINCE_LAST),
    "l10_account_age": (q_account_age, SQL_ACCOUNT_AGE),
    "l11_login_hour": (q_login_hour, SQL_LOGIN_HOUR),
    "l12_country_mismatch": (q_country_mismatch, SQL_COUNTRY_MISMATCH),
    "l13_payee_to_payout": (q_payee_payout, SQL_PAYEE_PAYOUT),
    "l14_sessions": (sessions, SQL_SESSIONS),
    "l15_device_4w": (q_rolling_other_keys, SQL_ROLLING_OTHER),
    "l15_country_8w": (q_country_8w, SQL_COUNTRY_8W),
}
