"""Queries: behavioural baselines from session features (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import bindings
from vigil import schemas as S
from vigil.operators import baseline as K
from vigil.plans.q_history import SQL_SESSIONS, sessions
from vigil.plans.sqltext import sround
from vigil.session import materialize

# the seven signals, bound to per-session features (some of them fractional)
BINDING = dict(zip(S.BASELINE_SIGNALS, [
    "page_navigation_velocity", "session_amount", "n_events", "n_pages", "n_purchases", "n_devices",
    "session_length_in_minutes"], strict=True))
SIGNALS = S.BASELINE_SIGNALS
CUT = "2024-01-21"
_BOUND = ", ".join(f"{column} AS {signal}" for signal, column in BINDING.items())
SE = f"WITH se AS (SELECT account, session_no, session_start, {_BOUND} FROM ({SQL_SESSIONS}) s0) "


def _split(spark, sf):
    s = sessions(spark, sf)
    s = materialize(s.select("account", "session_no", "session_start", *[F.col(c).alias(k) for k, c in BINDING.items()]), "sessions")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return s.where(F.col("session_start") < cut), s.where(F.col("session_start") >= cut)


def q_build(spark, sf):
    hist, _ = _split(spark, sf)
    return K.rounded(K.build(hist, SIGNALS), SIGNALS)


def _build_sql():
    aggs = ", ".join(f"CAST(sum(CAST(CAST({s} AS DOUBLE) AS DECIMAL(28,12))) AS DOUBLE) / count({s}) AS mean_{s}, stddev_pop(CAST({s} AS DOUBLE)) AS std_{s}" for s in SIGNALS)
    return f"""SELECT account, count(*) AS n_sessions, {aggs}
FROM se WHERE session_start < TIMESTAMP '{CUT}' GROUP BY account HAVING count(*) >= 3"""


BUILD = f"bl AS ({_build_sql()})"
_ROUNDED = ", ".join(f"{sround(f'{m}_{s}', 6)} AS {m}_{s}" for s in SIGNALS for m in ("mean", "std"))
SQL_BUILD = SE + f", {BUILD} SELECT account, n_sessions, {_ROUNDED} FROM bl"


def q_lookup(spark, sf):
    hist, _ = _split(spark, sf)
    accounts = bindings.session_events(spark, sf).select("account").distinct()
    return K.lookup(accounts, K.build(hist, SIGNALS)).select("account", "n_sessions", "has_baseline")


SQL_LOOKUP = SE + f", {BUILD} SELECT a.account, bl.n_sessions, bl.account IS NOT NULL AS has_baseline FROM (SELECT DISTINCT account FROM se) a LEFT JOIN bl ON a.account = bl.account"


def q_listing(spark, sf):
    hist, _ = _split(spark, sf)
    return K.listing(K.build(hist, SIGNALS))


SQL_LISTING = SE + f", {BUILD} SELECT account, (SELECT count(*) FROM bl) AS n_accounts FROM bl"


def q_score(spark, sf):
    hist, new = _split(spark, sf)
    s = K.score(new, K.build(hist, SIGNALS), SIGNALS)
    return s.select("account", "session_no", "anomaly_score", "has_baseline", "risk_level")


def _score_sql():
    terms = " + ".join(f"least(abs(CAST(s.{c} AS DOUBLE) - bl.mean_{c}) / greatest(bl.std_{c} * 3.0, 1e-9), 1.0)" for c in SIGNALS)
    sc = f"CASE WHEN bl.account IS NOT NULL THEN ({terms}) / {float(len(SIGNALS))} ELSE 0.05 END"
    return SE + f""", {BUILD}, sc AS (SELECT s.account, s.session_no, {sc} AS exact, bl.account IS NOT NULL AS has_baseline
  FROM se s LEFT JOIN bl ON s.account = bl.account WHERE s.session_start >= TIMESTAMP '{CUT}')
SELECT account, session_no, {sround('exact', 4)} AS anomaly_score, has_baseline,
  CASE WHEN exact > 0.3 THEN 'HIGH' WHEN exact > 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM sc"""


def q_default(spark, sf):
    """K5 over the transactions: the record's behavioural score, else .05."""
    from vigil.operators.decide import behaviour_or_default
    tx = bindings.transactions(spark, sf)
    return tx.select("transaction_id", behaviour_or_default().alias("behavioral_anomaly_score"))


SQL_DEFAULT = f"WITH tx AS {bindings.TXN_SQL} SELECT transaction_id, coalesce(CAST(behavioral_anomaly_score AS DOUBLE), 0.05) AS behavioral_anomaly_score FROM tx"

REGISTRY = {
    "k1_build_baseline": (q_build, SQL_BUILD),
    "k2_lookup_baseline": (q_lookup, SQL_LOOKUP),
    "k3_list_baselines": (q_listing, SQL_LISTING),
    "k4_score_sessions": (q_score, _score_sql()),
    "k5_behaviour_default": (q_default, SQL_DEFAULT),
}
