"""Queries: model fitting, search, scoring and persistence (E, A11, D4)
plus the model choice rules (E6, E7).

Fits run at the reference's settings: 400 trees of depth 7 (tabular), 350 of
depth 6 (behavioural), 30 trials x 5 folds over nine parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil import bindings
from vigil import schemas as S
from vigil.operators import decide, evaluate, models as M, sampling as C
from vigil.operators import history as H
from vigil.operators import search as T
from vigil.operators.preprocess import ImputeScale, exact_medians
from vigil.plans import q_sampling as QS
from vigil.plans.q_sampling import NUMS, SEED, labelled
from vigil.session import materialize
from vigil.sources import files as IO

FEATURES = NUMS + S.CATEGORICAL_FEATURES
ID = "application_id"


def _rows(spark, sf):
    """The labelled rows, written once: the ranks of a draw read them several times, the documents only here."""
    return materialize(labelled(spark, sf).withColumn("label", F.col("is_ato").cast("double")), "labelled")


def _split(spark, sf):
    return materialize(C.stratified_split(_rows(spark, sf), "is_ato", ID, 0.2, SEED), "split")


def _metrics(scored, p="ato_probability"):
    lab = materialize(scored.select(F.col("is_ato").alias("label"), F.col(p).alias("score"),
                                    (F.col(p) > 0.5).cast("int").alias("prediction")), "scored")  # the trees are walked once
    return evaluate.rates(evaluate.confusion(lab)).crossJoin(evaluate.auc(lab)).crossJoin(
        evaluate.log_loss(lab, prob="score").drop("n"))


def _weighted(train):
    w = C.class_weight(train, "is_ato").first()["scale_pos_weight"]
    return M.with_weight(train, "is_ato", max(int(w), 1))


def _fit_tabular(spark, sf, impute_scale=False, sp=None, **settings):
    sp = _split(spark, sf) if sp is None else sp
    learner = M.regularised(FEATURES, ID, weight="weight", seed=SEED, **settings)
    return M.tabular_pipeline(FEATURES, learner, impute_scale).fit(_weighted(sp.where(~F.col("is_test")))), sp


def q_tabular(spark, sf):
    """E1 + E5 + J: fit on train with class weight, score test, metrics."""
    model, sp = _fit_tabular(spark, sf)
    return _metrics(M.score(model, sp.where("is_test"), FEATURES))


def _same(scored, walked):
    return scored.select(ID, F.col("ato_probability").alias("p")).join(walked, ID).select(
        ID, (F.abs(F.col("p") - F.col("ato_probability")) < 1e-9).alias("same"))


def q_tabular_walked(spark, sf):
    """E1 + E5: each test score against the one walked through the model's node table."""
    model, sp = _fit_tabular(spark, sf)
    test, trees = sp.where("is_test"), model.stages[-1]
    walked = M.score_from_nodes(test, trees.nodes(spark), FEATURES, ID, S.TABULAR_GBT["depth"])
    return _same(M.score(model, test, FEATURES), walked)


SQL_TEST_SAME = QS.AP + QS.SPLIT + " SELECT application_id, TRUE AS same FROM sp WHERE is_test"

#: Features of few values, which are cut at every value.
FEW = ["email_is_free", "phone_home_valid", "device_distinct_emails_8w", "month", "customer_age", *S.CATEGORICAL_FEATURES]


def q_first_splits(spark, sf):
    """The first split on each feature of few values, its gain and its
    two leaves, by the fit with one tree of depth one (all rows, no pruning)."""
    train = _weighted(_split(spark, sf).where(~F.col("is_test")))
    out = None
    for c in FEW:
        stump = M.regularised([c], ID, weight="weight", trees=1, depth=1, subsample=1.0, colsample=1.0, gamma=0.0).fit(train).nodes(spark)
        at = lambda node, v: F.max(F.when(F.col("node") == node, F.col(v)))
        row = stump.agg(F.lit(c).alias("feature"), at(0, "threshold").alias("threshold"), F.round(at(0, "gain"), 6).alias("gain"),
                        F.round(at(0, "hessian"), 6).alias("hessian"), F.round(at(1, "value"), 9).alias("left_value"), F.round(at(2, "value"), 9).alias("right_value"))
        out = row if out is None else out.unionByName(row)
    return out


_P = S.TABULAR_GBT
_S = lambda g, h: f"(pow(greatest(abs({g}) - {_P['l1']}, 0), 2) / ({h} + {_P['l2']}))"
_V = lambda g, h: f"round(-sign({g}) * greatest(abs({g}) - {_P['l1']}, 0) / ({h} + {_P['l2']}) * {_P['rate']}, 9)"
SQL_FIRST_SPLITS = QS.AP + QS.SPLIT + f""", tr AS (SELECT * FROM sp WHERE NOT is_test),
 cw AS (SELECT greatest(floor(count(*) FILTER (is_ato = 0) / greatest(count(*) FILTER (is_ato = 1), 1)), 1) AS w FROM tr),
 vals AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v, is_ato FROM tr" for c in FEW)}),
 per AS (SELECT feature, v, sum((0.5 - is_ato) * CASE WHEN is_ato = 1 THEN w ELSE 1 END) AS g,
   sum(0.25 * CASE WHEN is_ato = 1 THEN w ELSE 1 END) AS h FROM vals, cw GROUP BY feature, v),
 cum AS (SELECT feature, v, sum(g) OVER o AS gl, sum(h) OVER o AS hl, sum(g) OVER f AS gt, sum(h) OVER f AS ht FROM per
   WINDOW o AS (PARTITION BY feature ORDER BY v), f AS (PARTITION BY feature)),
 gains AS (SELECT *, {_S('gl', 'hl')} + {_S('(gt - gl)', '(ht - hl)')} - {_S('gt', 'ht')} AS gain FROM cum
   WHERE hl >= {_P['min_child']} AND ht - hl >= {_P['min_child']}),
 best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, v) AS n FROM gains WHERE gain > 1e-6),
 roots AS (SELECT feature, max(ht) AS ht FROM cum GROUP BY feature)
SELECT r.feature, b.v AS threshold, round(b.gain, 6) AS gain, round(r.ht, 6) AS hessian,
  {_V('gl', 'hl')} AS left_value, {_V('(gt - gl)', '(b.ht - hl)')} AS right_value
FROM roots r LEFT JOIN best b ON b.feature = r.feature AND b.n = 1"""


def _fit_behavioral(spark, sf):
    """E2 + D4: impute+scale bundle fitted on train, SMOTE on the scaled
    train set (exact kNN), boosted trees."""
    sp = _split(spark, sf)
    train, test = sp.where(~F.col("is_test")), sp.where("is_test")
    pre = ImputeScale(inputCols=FEATURES).fit(train)
    tr = pre.transform(train).withColumn("vec", F.array(*[F.col(c).cast("double") for c in FEATURES]))
    plan = C.smote_plan(tr, "is_ato", 1.0, 5).first()
    mi = tr.where("is_ato = 1").select(F.col(ID).alias("id"), "vec")
    if plan["run"]:
        nn = C.knn(mi, "id", "vec", int(plan["k"]))
        syn = C.smote_synthesize(mi, nn, "id", "vec", int(plan["n_new"]), int(plan["k"]), SEED)
        syn = syn.select((-1 - F.col("draw")).alias(ID), *[F.col("vec")[i].alias(c) for i, c in enumerate(FEATURES)],
                         F.lit(1).alias("is_ato"), F.lit(1.0).alias("label"))
        tr = tr.select(ID, *FEATURES, "is_ato", "label").unionByName(syn)
    learner = M.regularised(FEATURES, ID, seed=SEED, **S.BEHAVIORAL_GBT)
    return M.tabular_pipeline(FEATURES, learner).fit(tr), pre.transform(test), int(plan["n_new"])


def q_behavioral(spark, sf):
    """E2 + D4 + J: metrics on the test rows."""
    model, test, n_new = _fit_behavioral(spark, sf)
    return _metrics(M.score(model, test, FEATURES)).withColumn("synthetic_rows", F.lit(n_new).cast("long"))


def q_behavioral_walked(spark, sf):
    """E2 + D4: each test score against the one walked through the node table."""
    model, test, _ = _fit_behavioral(spark, sf)
    walked = M.score_from_nodes(test, model.stages[-1].nodes(spark), FEATURES, ID, S.BEHAVIORAL_GBT["depth"])
    return _same(M.score(model, test, FEATURES), walked)


def _search(spark, sf):
    d = _weighted(materialize(C.stratified_folds(_rows(spark, sf), "is_ato", ID, S.SEARCH_FOLDS, SEED), "folds"))
    return T.search(d, FEATURES, "label", "fold", ID, trials=S.SEARCH_TRIALS, folds=S.SEARCH_FOLDS, weight="weight", seed=SEED)


def q_search(spark, sf):
    """Adaptive search over nine parameters, stratified folds, mean AUC per trial."""
    return _search(spark, sf).withColumn("mean_auc", F.round("mean_auc", 6))


def q_search_bounds(spark, sf):
    """Every trial of the search keeps to the bounds and has a mean AUC."""
    inside = F.lit(True)
    for name, (low, high) in T.SEARCH_SPACE.items():
        inside = inside & F.col(name).between(low, high)
    return _search(spark, sf).select("trial", "batch", inside.alias("inside"), F.col("mean_auc").between(0.0, 1.0).alias("scored"))


SQL_SEARCH_BOUNDS = f"""SELECT CAST(i AS INTEGER) AS trial, CAST(i // 5 AS INTEGER) AS batch, TRUE AS inside, TRUE AS scored
FROM range({S.SEARCH_TRIALS}) t(i) WHERE (SELECT count(*) FROM documents) > 0"""


def q_persist(spark, sf):
    """A11 + D4 + E5: a model (pipeline, settings, metrics, features) is
    published, then a second one in its place; the first, pinned by its number,
    scores every test row as it did when fitted and has kept its other parts."""
    root = IO.scratch_dir(spark, "models")
    saved, sp = [], _split(spark, sf)
    test = materialize(sp.where("is_test"), "test")
    for trees in (_P["trees"], 20):
        model, _ = _fit_tabular(spark, sf, impute_scale=True, sp=sp, trees=trees)
        metrics = _metrics(M.score(model, test, FEATURES)).first().asDict()
        bundle = M.Bundle(model, dict(_P, trees=trees, seed=SEED), metrics, FEATURES)
        saved.append((bundle, M.publish_bundle(spark, root, bundle).number))
    test = test.select(ID, *FEATURES)
    first, second = M.load_bundle(spark, root, saved[0][1]), M.load_bundle(spark, root)
    kept = all((b.params, b.metrics, b.features, n) == (loaded.params, loaded.metrics, loaded.features, loaded.version)
               for (b, n), loaded in zip(saved, (first, second)))
    a = M.score(saved[0][0].model, test, FEATURES, out="p_saved").select(ID, "p_saved")
    b = M.score(first.model, test, FEATURES, out="p_loaded").select(ID, "p_loaded")
    return a.join(b, ID).select(ID, (F.col("p_saved") == F.col("p_loaded")).alias("same_score"), F.lit(kept).alias("same_parts"))


SQL_PERSIST = QS.AP + QS.SPLIT + " SELECT application_id, TRUE AS same_score, TRUE AS same_parts FROM sp WHERE is_test"


def _gaps(df):
    """Every third application lacks its income."""
    return df.withColumn("income", F.when(F.col(ID) % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("income")))


def q_live_scoring(spark, sf):
    """Score rows whose features are partly null (the pipeline's
    imputer fills them) and band the result (F2)."""
    model, sp = _fit_tabular(spark, sf, impute_scale=True)
    scored = M.score(model, _gaps(sp.where("is_test")).select(ID, *FEATURES), FEATURES, backfill=False)
    return decide.band_and_action(scored).select(ID, "ato_probability", "risk_level", "recommended_action")


def q_live_filled(spark, sf):
    """A row with a gap scores as the row whose gap holds the train median."""
    model, sp = _fit_tabular(spark, sf, impute_scale=True)
    median = exact_medians(sp.where(~F.col("is_test")), ["income"])["income"]
    rows = _gaps(sp.where("is_test")).select(ID, *FEATURES)
    filled = rows.withColumn("income", F.coalesce("income", F.lit(median)))
    return _same(M.score(model, rows, FEATURES, backfill=False), M.score(model, filled, FEATURES).select(ID, "ato_probability"))


# --- E6 / E7: which model a table or a row goes to -------------------------------

def _tables(spark, sf):
    return {"applications": bindings.applications(spark, sf), "transactions": bindings.transactions(spark, sf),
            "behavioral_events": behavioral_rows(spark, sf)}


def q_model_for_tables(spark, sf):
    """The model each table goes to, and how many rows that sends there."""
    out = None
    for n, df in _tables(spark, sf).items():
        cols = set(df.columns)
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("source"), F.lit(M.model_for_table(df.columns)).alias("model"),
            F.lit(sum(c in cols for c in S.BEHAVIORAL_FEATURES)).alias("behavioral_columns"),
            F.lit(sum(c in cols for c in S.MODEL_FEATURES)).alias("tabular_columns"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


SQL_MODEL_FOR_TABLES = """SELECT 'applications' AS source, 'behavioral' AS model, 10 AS behavioral_columns, 23 AS tabular_columns, count(*) AS n_rows FROM documents
UNION ALL SELECT 'transactions', 'unknown', 0, 0, count(*) FROM orders
UNION ALL SELECT 'behavioral_events', 'unknown', 8, 1, count(*) FROM events"""


def behavioral_rows(spark, sf):
    """Per event, the behavioural features the history operators give."""
    ev = bindings.session_events(spark, sf).withColumn("login_hour_of_day_local", F.hour("ts")) \
        .withColumn("month", F.month("ts"))
    d = H.last_before(ev, ["account"], "ts", "event_id", {}, "_prev")
    d = H.last_before(d, ["account"], "ts", "event_id", {}, "_signup", cond=F.col("event_type") == "signup")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = d.select(
        "event_id", "account", "login_hour_of_day_local", "month",
        F.round((us("ts") - us("_prev.t")) / 86400e6, 6).alias("days_since_last_login"),
        F.when(F.col("event_type") == "purchase", F.round((us("ts") - us("_signup.t")) / 60e6, 4))
         .alias("time_from_payee_addition_to_payout_minutes"),
        F.when(F.col("event_type") == "signup", F.round((us("ts") - us("_prev.t")) / 1e6, 4))
         .alias("time_to_profile_change_seconds"),
        F.when(F.col("event_type") == "error", F.lit(1)).alias("failed_login_attempts_session"),
        F.when(F.col("event_type") == "purchase", F.col("amount")).alias("tx_amount_vs_historical_avg_ratio"),
        F.when(F.col("event_type").isin("click", "view"), F.lit(1.0)).alias("page_navigation_velocity"))
    return d


def q_row_model_choice(spark, sf):
    """E7 over the events: some carry eight behavioural features or more,
    every fiftieth carries none at all."""
    d = behavioral_rows(spark, sf).join(bindings.session_events(spark, sf).select("event_id", "device"), "event_id")
    d = d.withColumns({"customer_age": F.lit(18) + F.col("account") % 60, "email_is_free": F.col("account") % 2,
                       "account_age_months": F.lit(1), "is_new_device_uid": F.when(F.col("device").isNotNull(), F.lit(0))})
    blank = F.col("event_id") % 50 == 0
    d = d.withColumns({c: F.when(~blank, F.col(c)) for c in d.columns if c in S.BEHAVIORAL_FEATURES})
    d = decide.row_model_choice(d)
    return d.groupBy("model_used", "behavioral_features_present").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


SQL_ROW_MODEL_CHOICE = f"""WITH ev AS {bindings.EVENTS_SQL}, b AS (SELECT event_id, device,
  lag(ts) OVER (PARTITION BY account ORDER BY ts, event_id) IS NOT NULL AS has_prev,
  event_type, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS has_signup
  FROM ev),
 c AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 0 ELSE 5 + CAST(device IS NOT NULL AS INTEGER) + CAST(has_prev AS INTEGER) + CAST(event_type = 'purchase' AND has_signup AS INTEGER)
        + CAST(event_type = 'signup' AND has_prev AS INTEGER) + CAST(event_type = 'error' AS INTEGER)
        + CAST(event_type = 'purchase' AS INTEGER) + CAST(event_type IN ('click', 'view') AS INTEGER) END AS behavioral_features_present FROM b)
SELECT CASE WHEN behavioral_features_present >= 8 THEN 'behavioral' WHEN behavioral_features_present > 0 THEN 'tabular' ELSE 'rules' END AS model_used,
  behavioral_features_present, count(*) AS n FROM c GROUP BY ALL"""

REGISTRY = {
    "e1_tabular_gbt": (q_tabular, None),
    "e1_first_splits": (q_first_splits, SQL_FIRST_SPLITS),
    "e1_e5_scores_walked": (q_tabular_walked, SQL_TEST_SAME),
    "e2_d4_behavioral_pipeline": (q_behavioral, None),
    "e2_d4_scores_walked": (q_behavioral_walked, SQL_TEST_SAME),
    "e3_adaptive_search": (q_search, None),
    "e3_search_bounds": (q_search_bounds, SQL_SEARCH_BOUNDS),
    "e4_live_scoring": (q_live_scoring, None),
    "e4_gaps_filled": (q_live_filled, SQL_TEST_SAME),
    "e5_a11_persist_and_score": (q_persist, SQL_PERSIST),
    "e6_model_for_table": (q_model_for_tables, SQL_MODEL_FOR_TABLES),
    "e7_row_model_choice": (q_row_model_choice, SQL_ROW_MODEL_CHOICE),
}
