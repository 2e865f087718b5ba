"""Behavioural baseline per account (survey 2.11).

Signals are per-session features; the baseline is the mean and the
population standard deviation of each signal over ≥ 3 sessions.  The
score of a new session is the mean over signals of
least(|x − mean| / greatest(3·std, 1e-9), 1).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import schemas as S
from vigil.functions import behavioral_level


def build(sessions: DataFrame, signals: list[str], key: str = "account",
          min_sessions: int = S.BASELINE_MIN_SESSIONS) -> DataFrame:
    """K1: mean and population standard deviation of every signal, as
    doubles, in one grouped aggregate (partial aggregation, so a hot account
    is combined map-side); accounts under the minimum are rejected."""
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_sessions")]
    for s, total in exact_sums(sessions, signals).items():
        aggs += [(total / F.count(s)).alias(f"mean_{s}"),
                 F.stddev_pop(F.col(s).cast("double")).alias(f"std_{s}")]
    return sessions.groupBy(key).agg(*aggs).where(F.col("n_sessions") >= min_sessions)


def exact_sums(df: DataFrame, columns: list[str], rows_digits: int = 10) -> dict[str, Column]:
    """Per column a sum (a double) that does not depend on the order of
    addition: of decimals with 38 digits, of which the column's largest value and
    10**``rows_digits`` rows leave the rest to the fraction (one aggregate for the
    largest values). Where that leaves fewer than 17 digits below the largest
    value, or there are infinite ones, the doubles themselves are added."""
    most = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    sums = {}
    for i, c in enumerate(columns):
        value, largest = F.col(c).cast("double"), most[f"m{i}"]
        whole = 1 if not largest else max(1, math.floor(math.log10(largest)) + 2) if math.isfinite(largest) else 99
        scale = 38 - whole - rows_digits
        if scale < 0 or not (largest is None or math.isfinite(largest)):
            sums[c] = F.sum(value)
        else:
            sums[c] = F.sum(value.cast(f"decimal({38 - rows_digits},{min(scale, 38 - rows_digits)})")).cast("double")
    return sums


def rounded(baselines: DataFrame, signals: list[str], digits: int = 6) -> DataFrame:
    """The baselines for display; scores use the full moments."""
    return baselines.withColumns({f"{m}_{s}": F.round(f"{m}_{s}", digits) for s in signals for m in ("mean", "std")})


def lookup(accounts: DataFrame, baselines: DataFrame, key: str = "account") -> DataFrame:
    """K2: every asked account with its baseline, or has_baseline = false."""
    b = baselines.withColumn("_has", F.lit(True))
    return accounts.join(b, key, "left").withColumn("has_baseline", F.coalesce("_has", F.lit(False))).drop("_has")


def listing(baselines: DataFrame, key: str = "account") -> DataFrame:
    """K3: accounts with baselines as rows, with the total on every row
    (one-row aggregate cross-joined, so nothing is collected)."""
    n = baselines.agg(F.count(F.lit(1)).cast("bigint").alias("n_accounts"))
    return baselines.select(key).crossJoin(n)


def score(sessions: DataFrame, baselines: DataFrame, signals: list[str], key: str = "account") -> DataFrame:
    """K4: anomaly score against the baseline (4 digits) with its level;
    .05 and has_baseline = false when the account has none."""
    j = sessions.join(baselines.withColumn("_has", F.lit(True)), key, "left")
    terms = [F.least(F.abs(F.col(s).cast("double") - F.col(f"mean_{s}"))
                     / F.greatest(F.col(f"std_{s}") * 3.0, F.lit(1e-9)), F.lit(1.0)) for s in signals]
    raw = terms[0]
    for t in terms[1:]:
        raw = raw + t
    has = F.coalesce("_has", F.lit(False))
    exact = F.when(has, raw / float(len(signals))).otherwise(F.lit(S.DEFAULT_BEHAVIORAL))
    return (j.withColumn("has_baseline", has).withColumn("risk_level", behavioral_level(exact))
            .withColumn("anomaly_score", F.round(exact, 4)).drop("_has"))
