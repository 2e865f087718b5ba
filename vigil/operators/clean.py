"""Projection, typing, cleaning and validation (survey 2.2).

Schema-level steps (rename, allow-list, missing columns) read only the
schema; value-level steps are single projections with built-in
expressions, so the whole cleaning plan is one shuffle-free pass except
label encoding, which orders and joins the distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import schemas as S
from vigil.functions import bool_flag, clamp, nan_to_null, parse_double, to_double_or_zero
from vigil.functions.ordering import dense_index
from vigil.session import materialize


def rename_target(df: DataFrame, src: str = "fraud_bool", dst: str = "is_ato") -> DataFrame:
    """B1: rename the target only when the new name is absent."""
    if src in df.columns and dst not in df.columns:
        return df.withColumnRenamed(src, dst)
    return df


def project_allowed(df: DataFrame, allowed: list[str] = S.ALL_FEATURES, target: str = "is_ato") -> DataFrame:
    """B2: allow-list ∩ present, in list order, then the target."""
    keep = [c for c in allowed if c in df.columns]
    return df.select(*keep, *([target] if target in df.columns else []))


def _column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, position, present, n_filled) in one aggregate over the table:
    rows with a value, 0 for an absent column."""
    filled = [F.count(F.col(c)) if c in df.columns else F.lit(0).cast("bigint") for c in columns]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[f.alias(f"_{i}") for i, f in enumerate(filled)])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(c in df.columns).alias("present"),
        F.col(f"_{i}").alias("n_filled")) for i, c in enumerate(columns)])).alias("r")).select("r.*")


def missing_columns(df: DataFrame, expected: list[str] = S.ALL_FEATURES) -> DataFrame:
    """(column, position, present, n_filled) for every expected column."""
    return _column_counts(df, expected)


def backfill_zero(df: DataFrame, expected: list[str] = S.NUMERIC_FEATURES) -> DataFrame:
    """Absent feature columns become 0.0."""
    return df.withColumns({c: F.lit(0.0) for c in expected if c not in df.columns})


def coerce_numeric(df: DataFrame, cols: list[str] = S.NUMERIC_FEATURES) -> DataFrame:
    """Unparsable, null or NaN → 0.0 (present columns only)."""
    return df.withColumns({c: to_double_or_zero(c) for c in cols if c in df.columns})


def label_encode(df: DataFrame, cols: list[str] = S.CATEGORICAL_FEATURES) -> DataFrame:
    """code = 0-based rank of the string form among the column's sorted
    distinct values; null is the string 'nan'. One distinct pass and one
    total order for all columns, spread over tasks; the code tables are
    joined back (Spark broadcasts the ones whose written size allows it)."""
    present = [c for c in cols if c in df.columns]
    if not present:
        return df
    d = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in present})
    vals = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("val"))
                                        for c in present])).alias("x")).select("x.*").distinct()
    ordered = dense_index(vals, ["col", "val"], "i")
    firsts = ordered.groupBy("col").agg(F.min("i").alias("first"))  # one row per column
    codes = materialize(ordered.join(F.broadcast(firsts), "col").select("col", "val", (F.col("i") - F.col("first")).cast("int").alias("code")), "codes")
    for c in present:
        m = codes.where(F.col("col") == c).select(F.col("val").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        d = d.join(m, d[c] == m[f"_v_{c}"], "left").withColumn(c, F.col(f"_c_{c}")).drop(f"_v_{c}", f"_c_{c}")
    return d


def drop_null_target(df: DataFrame, target: str = "is_ato") -> DataFrame:
    """B7."""
    return df.na.drop(subset=[target])


def feature_projection(df: DataFrame, features: list[str] = S.MODEL_FEATURES,
                       keep: list[str] | None = None) -> DataFrame:
    """The model's features in fixed order; absent, null or unparsable
    → 0.0."""
    exprs = [(to_double_or_zero(c) if c in df.columns else F.lit(0.0)).alias(c) for c in features]
    return df.select(*(keep or []), *exprs)


def numeric_feature_columns(df: DataFrame, exclude: list[str] = S.NON_MODEL_COLUMNS) -> list[str]:
    """Numeric columns minus labels and operational metadata."""
    from pyspark.sql.types import NumericType
    ex = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def numeric_feature_counts(df: DataFrame, exclude: list[str] = S.NON_MODEL_COLUMNS) -> DataFrame:
    """B10 over the rows: (column, position, n_filled)."""
    return _column_counts(df, numeric_feature_columns(df, exclude)).drop("present")


def coerce_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    """Boolean-like strings → 1/0."""
    return df.withColumns({c: bool_flag(c) for c in cols if c in df.columns})


# --- FIXED VALUES: request defaults and bounds of the transaction form ---
REQUIRED = ["account_number", "transaction_amount"]
DEFAULTS = {
    "transaction_type": "NEFT", "ip_address": "0.0.0.0", "ip_country": "IN", "ip_blacklisted": False,
    "ip_fraud_score": 0.0, "device_type": "mobile", "device_blacklisted": False, "new_device": False,
    "new_location": False, "location_mismatch_ip": False, "auth_method": "PASSWORD",
    "failed_auth_attempts": 0, "session_age_minutes": 30, "new_beneficiary": False,
    "beneficiary_blacklisted": False, "channel": "mobile", "txn_frequency_1h": 1,
    "txn_frequency_24h": 3, "amount_vs_avg": 1.0, "amount_percentile": 0.5, "account_age_days": 365,
    "previous_fraud_flags": 0, "kyc_status": "VERIFIED", "risk_profile": "LOW",
    "typing_speed_mobile": 4.5, "typing_rhythm_mobile": 0.15, "phone_angle_pitch": 45.0,
    "phone_angle_roll": 10.0, "swipe_speed_mobile": 0.5, "mouse_path_complexity": 0.3,
    "typing_speed_web": 5.0, "typing_rhythm_web": 0.12, "mouse_speed_web": 300.0,
    "scroll_velocity_mobile": 0.6, "scroll_velocity_web": 0.4, "session_duration": 120.0,
    "behavioral_anomaly_score": 0.05,
}
BOUNDS = {  # column: (lower, upper); None = open
    "ip_fraud_score": (0, 1), "failed_auth_attempts": (0, None), "session_age_minutes": (0, None),
    "txn_frequency_1h": (0, None), "txn_frequency_24h": (0, None), "amount_vs_avg": (0, None),
    "amount_percentile": (0, 1), "account_age_days": (0, None), "previous_fraud_flags": (0, None),
}
NUMERIC_FIELDS = ["transaction_amount", "ip_fraud_score", "amount_vs_avg", "amount_percentile",
                  "failed_auth_attempts", "session_age_minutes", "txn_frequency_1h", "txn_frequency_24h",
                  "account_age_days", "previous_fraud_flags"]


INT_FIELDS = ["failed_auth_attempts", "session_age_minutes", "txn_frequency_1h", "txn_frequency_24h",
              "account_age_days", "previous_fraud_flags"]
BOOL_FIELDS = ["ip_blacklisted", "device_blacklisted", "new_device", "new_location", "location_mismatch_ip",
               "new_beneficiary", "beneficiary_blacklisted"]
BEHAVIORAL_FIELDS = ["typing_speed_mobile", "typing_rhythm_mobile", "phone_angle_pitch", "phone_angle_roll",
                     "swipe_speed_mobile", "mouse_path_complexity", "typing_speed_web", "typing_rhythm_web",
                     "mouse_speed_web", "scroll_velocity_mobile", "scroll_velocity_web", "session_duration",
                     "behavioral_anomaly_score"]
BOOL_TEXTS = ["0", "1", "true", "false", "t", "f", "yes", "no", "y", "n", "on", "off"]


def _number(df: DataFrame, c: str):
    """:func:`parse_double`; a column that is a number already needs no text made of it."""
    whole_or_double = isinstance(df.schema[c].dataType, (T.DoubleType, T.IntegralType))
    return nan_to_null(F.col(c).cast("double")) if whole_or_double else parse_double(F.col(c))


def validate(df: DataFrame) -> DataFrame:
    """Fill defaults, then list the broken rules per row
    (``errors`` empty = accepted).  Split with :func:`accepted`/:func:`rejected`.
    Numbers must parse, integers must be whole, booleans be one of the usual words."""
    d = df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) if c in df.columns
                        else F.lit(v) for c, v in DEFAULTS.items()})
    # each number is read once, in a projection of its own
    read = [c for c in dict.fromkeys([*NUMERIC_FIELDS, *BEHAVIORAL_FIELDS, *BOUNDS]) if c in df.columns]
    d = d.withColumns({f"_number_{c}": _number(d, c) for c in read})
    checks = []
    for c in REQUIRED:
        checks.append(F.when(F.col(c).isNull() if c in d.columns else F.lit(True), F.lit(f"missing:{c}")))
    for c in [*NUMERIC_FIELDS, *BEHAVIORAL_FIELDS]:
        if c in df.columns:
            v = F.col(f"_number_{c}")
            bad = v.isNull() | ((v != F.floor(v)) if c in INT_FIELDS else F.lit(False))
            checks.append(F.when(F.col(c).isNotNull() & bad, F.lit(f"type:{c}")))
    for c in BOOL_FIELDS:
        if c in df.columns:
            text = F.lower(F.trim(F.col(c).cast("string")))
            checks.append(F.when(F.col(c).isNotNull() & ~text.isin(*BOOL_TEXTS), F.lit(f"type:{c}")))
    for c, (lo, hi) in BOUNDS.items():
        v = F.col(f"_number_{c}") if c in read else parse_double(F.col(c))
        if lo is not None:
            checks.append(F.when(v < lo, F.lit(f"min:{c}")))
        if hi is not None:
            checks.append(F.when(v > hi, F.lit(f"max:{c}")))
    # exploded (one array a row): a filter on ``errors`` would otherwise be pushed down as
    # a copy of all checks and of whatever their columns are made from
    made = F.explode(F.array(F.array_compact(F.array(*checks)))).alias("errors")
    return d.select("*", made).drop(*[f"_number_{c}" for c in read])


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)


def ensure_transaction_id(df: DataFrame, key_col: str, id_col: str = "transaction_id") -> DataFrame:
    """Keep a given id, else 'TXN-' + 12 upper hex digits of md5(key)
    (deterministic, so a replay makes the same id)."""
    made = F.concat(F.lit("TXN-"), F.upper(F.substring(F.md5(F.col(key_col).cast("string")), 1, 12)))
    cur = F.col(id_col) if id_col in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_col, F.coalesce(F.when(F.trim(cur) != "", cur), made))


def amount_fallback(df: DataFrame, amount: str = "transaction_amount", bal: str = "intended_balcon_amount",
                    default: float = 1000.0) -> DataFrame:
    """Given amount, else the balcon amount when > 0, else a default."""
    cur = F.col(amount) if amount in df.columns else F.lit(None).cast("double")
    b = F.col(bal) if bal in df.columns else F.lit(None).cast("double")
    return df.withColumn(amount, F.coalesce(cur.cast("double"), F.when(b > 0, b.cast("double")), F.lit(default)))


def clip(df: DataFrame, cols: dict[str, tuple[float, float]]) -> DataFrame:
    """Clip to [lo, hi]; null stays null."""
    return df.withColumns({c: clamp(c, lo, hi) for c, (lo, hi) in cols.items()})


def parse_user_agent(ua: str = "user_agent_raw", out: str = "user_agent_parsed"):
    """Tokens 3 and 4 (space split, leading/trailing '(' dropped from
    the first) when the text names Linux or Android, else 'Windows,Chrome'."""
    toks = F.split(F.col(ua), " ")
    t3 = F.regexp_replace(F.try_element_at(toks, F.lit(3)), r"^\(+|\(+$", "")
    t4 = F.try_element_at(toks, F.lit(4))
    mobile = F.col(ua).contains("Linux") | F.col(ua).contains("Android")
    return F.when(mobile, F.concat(t3, F.lit(","), t4)).otherwise(F.lit("Windows,Chrome")).alias(out)


def travel_speed(km: str, days: str, out: str = "speed_of_travel_kmh"):
    """Km / (days · 24) truncated to an integer; null when days is 0."""
    return F.expr(f"try_divide({km}, {days} * 24)").cast("bigint").alias(out)


def ids_first(df: DataFrame, key_cols=("ato_probability", "risk_level", "recommended_action"),
              id_cols=("account_number", "transaction_id", "customer_id")) -> DataFrame:
    """Id columns, then key columns, then the rest."""
    ids = [c for c in id_cols if c in df.columns]
    keys = [c for c in key_cols if c in df.columns]
    rest = [c for c in df.columns if c not in ids and c not in keys]
    return df.select(*ids, *keys, *rest)


def prepare_for_scoring(df: DataFrame, attr: str = "device_os", target: str = "is_ato") -> DataFrame:
    """Device attribute as text, target removed."""
    d = df.withColumn(attr, F.col(attr).cast("string")) if attr in df.columns else df
    return d.drop(target)
