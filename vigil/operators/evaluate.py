"""Exact evaluation metrics (survey 2.10) as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.history import sums_before

def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """One row tn, fp, fn, tp."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    return df.agg(*[F.count_if((y == a) & (p == b)).cast("bigint").alias(n)
                    for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])


def rates(cm: DataFrame) -> DataFrame:
    """J2 + J3 from a confusion row: accuracy, precision, recall, F1 (0 when
    undefined), FPR and TPR with a max(·, 1) guard; 6 digits."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return cm.select(
        "tn", "fp", "fn", "tp",
        F.round(F.when(n > 0, (tp + tn) / n).otherwise(F.lit(0.0)), 6).alias("accuracy"),
        F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
        F.round(f1, 6).alias("f1_score"),
        F.round(fp / F.greatest(fp + tn, F.lit(1.0)), 6).alias("false_positive_rate"),
        F.round(tp / F.greatest(tp + fn, F.lit(1.0)), 6).alias("true_positive_rate"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Exact ROC AUC with ties (a tie counts one half); null when a
    class is absent.  Σ_s pos(s)·(neg(<s) + neg(s)/2) / (P·N), with neg(<s)
    a running sum over the distinct scores in segments of the score order, so
    no window sees all scores at once however they are spread."""
    per = (df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
           .groupBy(F.col(score).cast("double").alias("s"))
           .agg(F.count_if(F.col(label) == 1).cast("bigint").alias("pos"),
                F.count_if(F.col(label) != 1).cast("bigint").alias("neg")))
    j = sums_before(per, [], ["s"], {"neg_before": F.col("neg")})
    num = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg").cast("double") / 2.0))
    tot = j.agg(num.alias("num"), F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"))
    return tot.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.round(F.col("num") / (F.col("P") * F.col("N")), 6)).alias("auc_roc"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support + accuracy, macro avg and
    weighted avg rows (the shape of a classification report)."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    base = df.where(F.col(label).isNotNull())
    cm = base.agg(*[F.count_if((y == a) & (p == b)).cast("double").alias(f"c{a}{b}")
                    for a in (0, 1) for b in (0, 1)])
    rows = []
    for k in (0, 1):
        tp = F.col(f"c{k}{k}")
        pred_k = F.col(f"c0{k}") + F.col(f"c1{k}")
        sup = F.col(f"c{k}0") + F.col(f"c{k}1")
        prec = F.when(pred_k > 0, tp / pred_k).otherwise(F.lit(0.0))
        rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        rows.append((str(k), prec, rec, f1, sup))
    total = F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")
    acc = F.when(total > 0, (F.col("c00") + F.col("c11")) / total).otherwise(F.lit(0.0))
    macro = tuple((rows[0][i] + rows[1][i]) / 2 for i in (1, 2, 3))
    wavg = tuple(F.when(total > 0, (rows[0][i] * rows[0][4] + rows[1][i] * rows[1][4]) / total)
                 .otherwise(F.lit(0.0)) for i in (1, 2, 3))
    structs = [F.struct(F.lit(n).alias("class_label"), a.alias("precision"), b.alias("recall"),
                        c.alias("f1_score"), s.alias("support"))
               for n, a, b, c, s in rows]
    structs.append(F.struct(F.lit("accuracy").alias("class_label"), acc.alias("precision"),
                            acc.alias("recall"), acc.alias("f1_score"), total.alias("support")))
    structs.append(F.struct(F.lit("macro avg").alias("class_label"), *[m.alias(n) for m, n in
                   zip(macro, ("precision", "recall", "f1_score"))], total.alias("support")))
    structs.append(F.struct(F.lit("weighted avg").alias("class_label"), *[m.alias(n) for m, n in
                   zip(wavg, ("precision", "recall", "f1_score"))], total.alias("support")))
    out = cm.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
    return out.select("class_label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("bigint").alias("support"))


def log_loss(df: DataFrame, label: str = "label", prob: str = "probability",
             eps: float = 1e-15) -> DataFrame:
    """Mean binary cross-entropy with p clipped to [eps, 1 − eps]."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    ll = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).agg(
        F.round(F.avg(ll), 6).alias("log_loss"), F.count(F.lit(1)).cast("bigint").alias("n"))


def class_balance(df: DataFrame, label: str = "is_ato", stage: str | None = None) -> DataFrame:
    """Rows, positives, percent positive (0 if empty)."""
    a = df.agg(F.count(F.lit(1)).cast("bigint").alias("rows"),
               F.coalesce(F.sum(F.col(label).cast("bigint")), F.lit(0)).cast("bigint").alias("positives"))
    a = a.withColumn("pct_positive", F.when(F.col("rows") > 0, F.round(F.col("positives") * 100.0 / F.col("rows"), 4))
                     .otherwise(F.lit(0.0)))
    return a if stage is None else a.select(F.lit(stage).alias("stage"), "*")
