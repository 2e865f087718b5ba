"""Queries: splits, SMOTE, perturbation (C), fitted preprocessing (D) and
class distributions (J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import bindings
from vigil import schemas as S
from vigil.functions import parse_double
from vigil.operators import clean, evaluate, preprocess as P, sampling as C
from vigil.plans.q_clean import ALLOWED_PRESENT, PRESENT_NUM, _code_sql, _num_sql, _parse_sql, balance_sql
from vigil.plans.sqltext import sround
from vigil.session import materialize
from vigil.sources.tables import table

SEED = 42
NUMS = [c for c in S.NUMERIC_FEATURES if c in PRESENT_NUM + ["income"]]


def labelled(spark, sf):
    """Processed applications that keep their id."""
    d = clean.rename_target(bindings.applications(spark, sf))
    d = d.select("application_id", *ALLOWED_PRESENT, "is_ato")
    d = clean.label_encode(clean.coerce_numeric(d))
    return clean.drop_null_target(d)


def _labelled_sql():
    sel = [f"{_num_sql(c)} AS {c}" if c in NUMS else f"{_code_sql(c)} AS {c}" for c in ALLOWED_PRESENT]
    return f"""lab0 AS (SELECT application_id, {', '.join(sel)}, fraud_bool AS is_ato FROM ap),
 lab AS (SELECT * FROM lab0 WHERE is_ato IS NOT NULL)"""


AP = f"WITH ap AS {bindings.APPS_SQL}, {_labelled_sql()} "


def _h8(seed, col):
    return f"CAST(('0x' || substr(md5('{seed}:' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT)"


def _u(seed, col):
    return f"({_h8(seed, col)} / 4294967296.0)"


def q_split(spark, sf):
    return C.stratified_split(labelled(spark, sf), "is_ato", "application_id", 0.2, SEED).select(
        "application_id", "is_ato", "is_test")


SPLIT = f""", sp AS (SELECT *, row_number() OVER (PARTITION BY is_ato ORDER BY {_h8('split42', 'application_id')}, application_id) - 1
   < ceil(count(*) OVER (PARTITION BY is_ato) * 0.2) AS is_test FROM lab)"""
SQL_SPLIT = AP + SPLIT + " SELECT application_id, is_ato, is_test FROM sp"


def q_folds(spark, sf):
    return C.stratified_folds(labelled(spark, sf), "is_ato", "application_id", 5, SEED).select(
        "application_id", "is_ato", "fold")


SQL_FOLDS = AP + f""" SELECT application_id, is_ato, CAST((row_number() OVER (PARTITION BY is_ato
  ORDER BY {_h8('fold42', 'application_id')}, application_id) - 1) % 5 AS INTEGER) AS fold FROM lab"""


def q_class_weight(spark, sf):
    sp = C.stratified_split(labelled(spark, sf), "is_ato", "application_id", 0.2, SEED)
    return C.class_weight(sp.where(~F.col("is_test")), "is_ato")


SQL_CLASS_WEIGHT = AP + SPLIT + """ SELECT count_if(is_ato = 0) AS neg, count_if(is_ato = 1) AS pos,
  CAST(floor(count_if(is_ato = 0) / greatest(count_if(is_ato = 1), 1)) AS BIGINT) AS scale_pos_weight FROM sp WHERE NOT is_test"""

# --- SMOTE over the embeddings: label 5 is the minority class ----------------
MINORITY_LABEL = 5
RATIO = 0.4
K = 5


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", (F.col("label") == MINORITY_LABEL).cast("int").alias("y"))


EMB = f"WITH em AS (SELECT vec_id, embedding, CAST(label = {MINORITY_LABEL} AS INTEGER) AS y FROM embeddings) "


def q_smote_plan(spark, sf):
    return C.smote_plan(_vectors(spark, sf), "y", RATIO, K)


SQL_SMOTE_PLAN = EMB + f"""SELECT minority, majority,
  CAST(CASE WHEN minority >= 2 AND floor(majority * {RATIO}) - minority > 0 THEN floor(majority * {RATIO}) - minority ELSE 0 END AS BIGINT) AS n_new,
  CAST(CASE WHEN minority >= 2 AND floor(majority * {RATIO}) - minority > 0 THEN least({K}, minority - 1) ELSE 0 END AS INTEGER) AS k,
  minority >= 2 AND floor(majority * {RATIO}) - minority > 0 AS run
FROM (SELECT count_if(y = 1) AS minority, count_if(y <> 1) AS majority FROM em)"""


def _knn(spark, sf):
    v = _vectors(spark, sf).where("y = 1")
    return C.knn(v, "vec_id", "embedding", K)


def q_knn(spark, sf):
    return _knn(spark, sf).select("id", "neighbor_id", F.round("distance", 6).alias("distance"), "rank")


def q_knn_lsh(spark, sf):
    """C5 at size: the approximate form over the same minority."""
    v = _vectors(spark, sf).where("y = 1")
    nn = C.knn_lsh(v, "vec_id", "embedding", K)
    return nn.select("id", "neighbor_id", F.round("distance", 6).alias("distance"), "rank")


def q_knn_lsh_kept(spark, sf):
    """Every point of the minority has its k neighbours by LSH, and at
    least nine in ten of all are the exact ones."""
    v = materialize(_vectors(spark, sf).where("y = 1"), "minority")
    found = materialize(C.knn_lsh(v, "vec_id", "embedding", K), "found")
    exact = C.knn(v, "vec_id", "embedding", K).select("id", "neighbor_id")
    right = found.join(exact, ["id", "neighbor_id"], "left_semi").agg(F.count(F.lit(1)).alias("right"))
    share = right.crossJoin(exact.agg(F.count(F.lit(1)).alias("all"))).select((F.col("right") >= 0.9 * F.col("all")).alias("recall_kept"))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours")).crossJoin(share)


SQL_KNN_LSH_KEPT = EMB + f"""SELECT vec_id AS id, least({K}, (SELECT count(*) FROM em WHERE y = 1) - 1) AS neighbours, TRUE AS recall_kept
FROM em WHERE y = 1"""


KNN = f""", mi AS (SELECT vec_id, embedding FROM em WHERE y = 1),
 pr AS (SELECT a.vec_id AS id, b.vec_id AS neighbor_id,
   sqrt(list_sum([(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2 FOR i IN range(1, len(a.embedding) + 1)])) AS distance
   FROM mi a JOIN mi b ON a.vec_id <> b.vec_id),
 nn AS (SELECT id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM pr
        QUALIFY rank <= {K})"""
SQL_KNN = EMB + KNN + f" SELECT id, neighbor_id, {sround('distance', 6)} AS distance, rank FROM nn"


def _synth(spark, sf):
    v = _vectors(spark, sf)
    plan = C.smote_plan(v, "y", RATIO, K).collect()[0]
    mi = v.where("y = 1").select("vec_id", "embedding")
    nn = C.knn(mi, "vec_id", "embedding", K)
    return C.smote_synthesize(mi, nn, "vec_id", "embedding", int(plan["n_new"]), int(plan["k"]), SEED), plan


def q_synth(spark, sf):
    s, _ = _synth(spark, sf)
    return s.select("draw", "base_id", "neighbor_id", F.round("gap", 6).alias("gap"),
                    F.round(F.col("embedding")[0], 6).alias("x_first"),
                    F.round(F.element_at("embedding", -1), 6).alias("x_last"),
                    F.size("embedding").alias("dims"))


SYNTH = f""", pl AS (SELECT count_if(y = 1) AS m, CAST(floor(count_if(y <> 1) * {RATIO}) - count_if(y = 1) AS BIGINT) AS n_new,
   least({K}, count_if(y = 1) - 1) AS k FROM em),
 mix AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS bidx FROM mi),
 dr AS (SELECT d.range AS draw, CAST(floor({_u('base42', 'd.range')} * pl.m) AS BIGINT) AS bidx,
          CAST(floor({_u('nb42', 'd.range')} * pl.k) + 1 AS INTEGER) AS rank, {_u('gap42', 'd.range')} AS gap
        FROM pl, range(pl.n_new) d),
 sy AS (SELECT dr.draw, mix.vec_id AS base_id, nn.neighbor_id, dr.gap,
          [CAST(mix.embedding[i] AS DOUBLE) + dr.gap * (CAST(nb.embedding[i] AS DOUBLE) - CAST(mix.embedding[i] AS DOUBLE)) FOR i IN range(1, len(mix.embedding) + 1)] AS embedding
        FROM dr JOIN mix ON dr.bidx = mix.bidx JOIN nn ON nn.id = mix.vec_id AND nn.rank = dr.rank
        JOIN mi nb ON nb.vec_id = nn.neighbor_id)"""
SQL_SYNTH = EMB + KNN + SYNTH + f""" SELECT draw, base_id, neighbor_id, {sround('gap', 6)} AS gap,
  {sround('embedding[1]', 6)} AS x_first, {sround('embedding[len(embedding)]', 6)} AS x_last, CAST(len(embedding) AS INTEGER) AS dims FROM sy"""


def q_balanced(spark, sf):
    """C7 + J7: class distribution before and after balancing."""
    v = _vectors(spark, sf)
    s, _ = _synth(spark, sf)
    after = v.select("y").unionByName(s.select(F.lit(1).alias("y")))
    return evaluate.class_balance(v, "y", "before").unionByName(evaluate.class_balance(after, "y", "after"))


SQL_BALANCED = EMB + KNN + SYNTH + f""" SELECT 'before' AS stage, * FROM ({balance_sql('em', 'y')})
UNION ALL SELECT 'after', * FROM ({balance_sql('(SELECT y FROM em UNION ALL SELECT 1 FROM sy)', 'y')})"""


def q_metadata(spark, sf):
    """Each synthetic row borrows the label-free metadata (source id and
    original label) of an original row drawn with replacement."""
    s, _ = _synth(spark, sf)
    orig = table(spark, sf, "embeddings").select("vec_id", "label")
    n = orig.count()
    from vigil.functions.ordering import dense_index
    from vigil.functions import hash_uniform
    idx = dense_index(orig, ["vec_id"], "_m")
    d = s.select("draw", F.floor(hash_uniform("meta42", F.col("draw")) * n).cast("bigint").alias("_m"))
    return d.join(idx, "_m").select("draw", F.col("vec_id").alias("meta_source_id"), F.col("label").alias("meta_label"))


SQL_METADATA = EMB + KNN + SYNTH + f""", ox AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS m FROM embeddings)
SELECT sy.draw, ox.vec_id AS meta_source_id, ox.label AS meta_label FROM sy
JOIN ox ON ox.m = CAST(floor({_u('meta42', 'sy.draw')} * (SELECT count(*) FROM embeddings)) AS BIGINT)"""


def q_numbering(spark, sf):
    """Originals then synthetic rows, numbered TXN_SMOTE%07d."""
    v = _vectors(spark, sf).select(F.lit(0).alias("synthetic"), F.col("vec_id").alias("row_key"))
    s, _ = _synth(spark, sf)
    allr = v.unionByName(s.select(F.lit(1).alias("synthetic"), F.col("draw").alias("row_key")))
    return C.number_rows(allr, ["synthetic", "row_key"])


SQL_NUMBERING = EMB + KNN + SYNTH + """ SELECT synthetic, row_key, printf('TXN_SMOTE%07d', row_number() OVER (ORDER BY synthetic, row_key) - 1) AS transaction_id
FROM (SELECT 0 AS synthetic, vec_id AS row_key FROM em UNION ALL SELECT 1, draw FROM sy)"""


def q_shuffle(spark, sf):
    return C.seeded_shuffle(labelled(spark, sf).select("application_id"), "application_id", SEED)


SQL_SHUFFLE = AP + """SELECT application_id, row_number() OVER (ORDER BY md5('42:' || CAST(application_id AS VARCHAR)), application_id) - 1 AS position FROM lab"""

PERTURB = {"name_email_similarity": (0.0, 1.0), "velocity_6h": (0.0, 500.0)}


def q_perturb(spark, sf):
    d = C.perturb(labelled(spark, sf), "is_ato", "application_id", PERTURB, 0.1, SEED)
    return d.select("application_id", "is_ato", "perturbed", *[F.round(c, 6).alias(c) for c in PERTURB])


def _pick_sql(seed, rate, group="is_ato"):
    part = f"PARTITION BY {group} " if group else ""
    return f"""row_number() OVER ({part}ORDER BY {_h8(seed, 'application_id')}, application_id) - 1
  < floor(count(*) OVER ({part.strip()}) * {rate})"""


SQL_PERTURB = AP + f""", pz AS (SELECT *, {_pick_sql('perturb42', 0.1)} AS perturbed FROM lab)
SELECT application_id, is_ato, perturbed, """ + ", ".join(
    f"{sround(f'CASE WHEN perturbed THEN {lo} + {_u(c + str(SEED), 'application_id')} * {hi - lo} ELSE CAST({c} AS DOUBLE) END', 6)} AS {c}"
    for c, (lo, hi) in PERTURB.items()) + " FROM pz"

MASKED = ["name_email_similarity", "velocity_6h", "velocity_4w", "days_since_request"]


def q_mask(spark, sf):
    d = C.mask_cells(labelled(spark, sf), "application_id", MASKED, 0.05, SEED)
    return d.select("application_id", *MASKED)


SQL_MASK = AP + "SELECT application_id, " + ", ".join(
    f"CASE WHEN {_u(f'mask42:{c}', 'application_id')} >= 0.05 THEN {c} END AS {c}" for c in MASKED) + " FROM lab"


def q_flip(spark, sf):
    d = C.flip_labels(labelled(spark, sf), "is_ato", "application_id", 0.05, SEED)
    return d.select("application_id", "is_ato", "flipped")


SQL_FLIP = AP + f""", fz AS (SELECT *, {_pick_sql('flip42', 0.05, None)} AS flipped FROM lab)
SELECT application_id, CASE WHEN flipped THEN 1 - is_ato ELSE is_ato END AS is_ato, flipped FROM fz"""

# --- D: imputation and scaling fitted on train, applied to test -------------------


def _raw_split(spark, sf):
    """Applications with numbers parsed (unparsable → null) and the split."""
    d = clean.rename_target(bindings.applications(spark, sf)).where(F.col("is_ato").isNotNull())
    d = d.select("application_id", "is_ato", *[parse_double(c).alias(c) for c in NUMS])
    return C.stratified_split(d, "is_ato", "application_id", 0.2, SEED)


RAW = f"""WITH ap AS {bindings.APPS_SQL}, rw AS (SELECT application_id, fraud_bool AS is_ato, """ + ", ".join(
    f"{_parse_sql(c)} AS {c}" for c in NUMS) + f""" FROM ap WHERE fraud_bool IS NOT NULL),
 sp AS (SELECT *, row_number() OVER (PARTITION BY is_ato ORDER BY {_h8('split42', 'application_id')}, application_id) - 1
   < ceil(count(*) OVER (PARTITION BY is_ato) * 0.2) AS is_test FROM rw),
 med AS (SELECT """ + ", ".join(f"median({c}) AS {c}" for c in NUMS) + """ FROM sp WHERE NOT is_test),
 im AS (SELECT sp.application_id, sp.is_test, """ + ", ".join(
    f"coalesce(sp.{c}, med.{c}) AS {c}" for c in NUMS) + """ FROM sp, med)"""


def q_impute(spark, sf):
    sp = _raw_split(spark, sf)
    med = P.exact_medians(sp.where(~F.col("is_test")), NUMS)
    out = P.impute(sp.where("is_test"), med)
    return out.select("application_id", *[F.round(c, 6).alias(c) for c in NUMS])


SQL_IMPUTE = RAW + " SELECT application_id, " + ", ".join(f"{sround(c, 6)} AS {c}" for c in NUMS) + " FROM im WHERE is_test"


def _scaled(spark, sf):
    sp = _raw_split(spark, sf)
    tr = sp.where(~F.col("is_test"))
    med = P.exact_medians(tr, NUMS)
    st = P.scaling_stats(P.impute(tr, med), NUMS)
    return P.scale(P.impute(sp.where("is_test"), med), st), st


def q_scale(spark, sf):
    out, _ = _scaled(spark, sf)
    return out.select("application_id", *[F.round(c, 6).alias(c) for c in NUMS])


SCALE = """, mo AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) IS NULL OR stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
    for c in NUMS) + """ FROM im WHERE NOT is_test),
 sc AS (SELECT im.application_id, """ + ", ".join(f"(im.{c} - mo.m_{c}) / mo.s_{c} AS {c}" for c in NUMS) + \
    " FROM im, mo WHERE im.is_test)"
SQL_SCALE = RAW + SCALE + " SELECT application_id, " + ", ".join(f"{sround(c, 6)} AS {c}" for c in NUMS) + " FROM sc"


def q_unscale(spark, sf):
    out, st = _scaled(spark, sf)
    back = P.unscale(out, st)
    return back.select("application_id", *[F.round(c, 4).alias(c) for c in NUMS])


SQL_UNSCALE = RAW + " SELECT application_id, " + ", ".join(f"{sround(c, 4)} AS {c}" for c in NUMS) + " FROM im WHERE is_test"

REGISTRY = {
    "c1_stratified_split": (q_split, SQL_SPLIT),
    "c2_stratified_folds": (q_folds, SQL_FOLDS),
    "c3_class_weight": (q_class_weight, SQL_CLASS_WEIGHT),
    "c4_smote_plan": (q_smote_plan, SQL_SMOTE_PLAN),
    "c5_minority_knn": (q_knn, SQL_KNN),
    "c5_minority_knn_lsh": (q_knn_lsh, None),
    "c5_knn_lsh_kept": (q_knn_lsh_kept, SQL_KNN_LSH_KEPT),
    "c6_smote_synthesize": (q_synth, SQL_SYNTH),
    "c7_j7_class_distribution": (q_balanced, SQL_BALANCED),
    "c8_synthetic_metadata": (q_metadata, SQL_METADATA),
    "c9_row_numbering": (q_numbering, SQL_NUMBERING),
    "c10_seeded_shuffle": (q_shuffle, SQL_SHUFFLE),
    "c11_perturb": (q_perturb, SQL_PERTURB),
    "c12_mask_cells": (q_mask, SQL_MASK),
    "c13_flip_labels": (q_flip, SQL_FLIP),
    "d1_median_impute": (q_impute, SQL_IMPUTE),
    "d2_standard_scale": (q_scale, SQL_SCALE),
    "d3_inverse_scale": (q_unscale, SQL_UNSCALE),
}
