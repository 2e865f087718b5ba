"""Column expressions shared by the operators.

Everything here returns a ``Column`` made of built-in functions so it
stays inside whole-stage codegen; no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil import schemas as S

# A plain decimal or scientific number, or inf/nan words; the pattern keeps
# Java's float suffixes ("12d", "3f") and hex floats out of try_cast.
NUMBER_PATTERN = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)\s*$"

__all__ = [
    "NUMBER_PATTERN", "col_or", "parse_double", "to_double_or_zero", "nan_to_null",
    "bool_flag", "clamp", "hash_uniform", "hash_hex", "rule_score", "decide_action",
    "band", "behavioral_level", "epoch_us", "ts_seq_before",
]


def col_or(c, default=None) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = col_or(c)
    return F.when(~F.isnan(c), c)


def parse_double(c) -> Column:
    """String/number → double; unparsable, blank, null → null; NaN → null."""
    c = col_or(c)
    s = F.trim(c.cast("string"))
    # the word nan is left out, so that no NaN is made and then asked for: that would read the text twice
    return F.when(F.lower(s).rlike(NUMBER_PATTERN.replace("|nan", "")), s.try_cast("double"))


def to_double_or_zero(c) -> Column:
    """Unparsable, null or NaN → 0.0."""
    return F.coalesce(parse_double(c), F.lit(0.0))


def bool_flag(c) -> Column:
    """B11: "true"/"1"/"yes" → 1, anything else (incl. null) → 0."""
    s = F.lower(F.trim(col_or(c).cast("string")))
    return F.when(s.isin("true", "1", "1.0", "yes", "t", "y"), F.lit(1)).otherwise(F.lit(0))


def clamp(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clip to [lo, hi], null stays null."""
    c = col_or(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def hash_hex(seed, *cols) -> Column:
    """md5 of 'seed:c1:c2…' — the same text in Spark and DuckDB."""
    parts = [F.lit(str(seed))] + [col_or(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(seed, *cols) -> Column:
    """Deterministic draw in [0, 1) from the first 8 hex digits of md5."""
    h = F.substring(hash_hex(seed, *cols), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(4294967296.0)


def rule_score(ip_fraud="ip_fraud_score", ip_bl="ip_blacklisted", new_dev="new_device",
               new_loc="new_location", ben_bl="beneficiary_blacklisted",
               failed="failed_auth_attempts", beh="behavioral_anomaly_score") -> Column:
    """Weighted risk signals capped at .99; null inputs count as 0."""
    def num(c):
        return F.coalesce(col_or(c).cast("double"), F.lit(0.0))
    w = dict(S.RULE_WEIGHTS)
    risk = (num(ip_fraud) * w["ip_fraud_score"]
            + num(ip_bl) * w["ip_blacklisted"]
            + num(new_dev) * w["new_device"]
            + num(new_loc) * w["new_location"]
            + num(ben_bl) * w["beneficiary_blacklisted"]
            + F.least(num(failed) / 10.0, F.lit(1.0)) * w["failed_auth_attempts"]
            + num(beh) * w["behavioral_anomaly_score"])
    return F.least(F.lit(S.RULE_CAP), risk)


def decide_action(p="ato_probability", b="behavioral_anomaly_score") -> Column:
    """strict thresholds on probability and behaviour."""
    p, b = col_or(p), col_or(b)
    return (F.when((p > S.THRESH_HIGH_PROB) | (b > S.THRESH_HIGH_BEHAVIORAL), F.lit("SUSPEND"))
             .when((p > S.THRESH_MED_PROB) | (b > S.THRESH_MED_BEHAVIORAL), F.lit("OTP_REQUIRED"))
             .otherwise(F.lit("ALLOW")))


def band(p="ato_probability") -> Column:
    """F2: right-closed bands (-.001,.499], (.499,.799], (.799,1.001]; outside → null."""
    p = col_or(p)
    e = S.BAND_EDGES
    return (F.when((p > e[0]) & (p <= e[1]), F.lit(S.BAND_LABELS[0]))
             .when((p > e[1]) & (p <= e[2]), F.lit(S.BAND_LABELS[1]))
             .when((p > e[2]) & (p <= e[3]), F.lit(S.BAND_LABELS[2])))


def behavioral_level(b="anomaly_score") -> Column:
    """HIGH > .30, MEDIUM > .20, else LOW."""
    b = col_or(b)
    return (F.when(b > S.THRESH_HIGH_BEHAVIORAL, F.lit("HIGH"))
             .when(b > S.THRESH_MED_BEHAVIORAL, F.lit("MEDIUM"))
             .otherwise(F.lit("LOW")))


def epoch_us(ts) -> Column:
    """Microseconds since epoch of a timestamp or timestamp_ntz column."""
    return F.unix_micros(col_or(ts).cast("timestamp"))


def ts_seq_before(ts_a, seq_a, ts_b, seq_b) -> Column:
    """(ts_a, seq_a) strictly before (ts_b, seq_b)."""
    ts_a, seq_a, ts_b, seq_b = map(col_or, (ts_a, seq_a, ts_b, seq_b))
    return (ts_a < ts_b) | ((ts_a == ts_b) & (seq_a < seq_b))
