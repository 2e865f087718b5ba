"""Splits, SMOTE, preprocessing and exact metrics."""

import numpy as np
from pyspark.sql import functions as F

from vigil.functions.ordering import dense_index, hash_rank
from vigil.operators import evaluate, preprocess as P, sampling as C


def _labelled(spark, n=500, pos_every=9):
    return spark.createDataFrame([(i, 1 if i % pos_every == 0 else 0, float(i % 37)) for i in range(n)],
                                 "id long, y int, x double")


def test_split_exact_and_disjoint(spark):
    df = _labelled(spark)
    sp = C.stratified_split(df, "y", "id", 0.2).toPandas()
    assert len(sp) == 500 and sp.id.is_unique
    for y, g in sp.groupby("y"):
        assert g.is_test.sum() == int(np.ceil(len(g) * 0.2))
    f = C.stratified_folds(df, "y", "id", 5).toPandas()
    for y, g in f.groupby("y"):
        c = g.fold.value_counts()
        assert c.max() - c.min() <= 1


def test_dense_index_and_rank(spark):
    df = _labelled(spark, 300).repartition(5)
    idx = dense_index(df, ["x", "id"], "i").toPandas().sort_values("i")
    assert list(idx.i) == list(range(300))
    assert list(idx.sort_values(["x", "id"]).i) == list(range(300))
    r = hash_rank(df, ["y"], "id", "s").toPandas()
    for y, g in r.groupby("y"):
        assert sorted(g["rank"]) == list(range(len(g)))


def test_knn_matches_bruteforce(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, [float(v) for v in pts[i]]) for i in range(40)], "id long, vec array<double>")
    got = C.knn(df, "id", "vec", 4, chunk_rows=15).toPandas()
    for i in range(40):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        exp = list(np.lexsort((np.arange(40), d))[:4])
        g = got[got.id == i].sort_values("rank")
        assert list(g.neighbor_id) == exp


def test_lsh_neighbours_are_nearly_the_exact_ones(spark):
    rng = np.random.default_rng(4)
    pts = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, [float(v) for v in pts[i]]) for i in range(400)], "id long, vec array<double>")
    exact = {(r["id"], r["neighbor_id"]) for r in C.knn(df, "id", "vec", 4).collect()}
    found = C.knn_lsh(df, "id", "vec", 4).collect()
    assert len({(r["id"], r["neighbor_id"]) for r in found} & exact) / len(exact) > 0.9
    assert all(abs(r["distance"] - np.linalg.norm(pts[r["id"]] - pts[r["neighbor_id"]])) < 1e-9 for r in found)


def test_lsh_compares_few_pairs_of_clustered_points(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 12)) * 10
    pts = centres[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 12)) * 0.3
    pts[0] = 1000.0  # alone: no bucket with anybody
    df = spark.createDataFrame([(i, [float(v) for v in pts[i]]) for i in range(1500)], "id long, vec array<double>")
    plan = C.lsh_plan(df, "id", "vec", 4)
    assert plan.recall >= 0.95 and plan.share < 0.2
    found = {(r["id"], r["neighbor_id"]) for r in C.knn_lsh(df, "id", "vec", 4, chunk_rows=40).collect()}
    d = ((pts[:, None, :] - pts[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    exact = {(i, int(j)) for i in range(1500) for j in np.argsort(d[i], kind="stable")[:4]}
    assert len(found) == 6000 and len(found & exact) / 6000 >= 0.9
    assert {j for i, j in found if i == 0} == {j for i, j in exact if i == 0}
    key = plan.keys(pts)
    assert abs(np.mean([(key[i] == key).any(axis=1).mean() for i in range(0, 1500, 15)]) - plan.share) < 0.05


def test_lsh_of_few_and_equal_points(spark):
    assert C.knn_lsh(spark.createDataFrame([], "id long, vec array<double>"), "id", "vec").collect() == []
    assert C.knn_lsh(spark.createDataFrame([(1, [0.0])], "id long, vec array<double>"), "id", "vec").collect() == []
    same = C.knn_lsh(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(7)], "id long, vec array<double>"), "id", "vec", 3).collect()
    assert len(same) == 21 and {r["distance"] for r in same} == {0.0}


def test_null_class_is_a_class_of_its_own(spark):
    rows = [(i, None if i % 3 == 0 else i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, y int")
    got = C.stratified_split(df, "y", "id", 0.2).collect()
    assert len(got) == 90 and sum(r["is_test"] for r in got if r["y"] is None) == 6
    assert C.stratified_folds(df, "y", "id", 5).count() == 90
    assert C.pick_exact(df, "y", "id", 0.5, "s", "p").where("p AND y IS NULL").count() == 15


def test_smote_points_on_segments(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(12, 3))
    mi = spark.createDataFrame([(i, [float(v) for v in pts[i]]) for i in range(12)], "id long, vec array<double>")
    nn = C.knn(mi, "id", "vec", 3)
    syn = C.smote_synthesize(mi, nn, "id", "vec", 25, 3).toPandas()
    assert len(syn) == 25
    for r in syn.itertuples():
        x, n = pts[r.base_id], pts[r.neighbor_id]
        assert np.allclose(np.array(r.vec), x + r.gap * (n - x))
        assert 0 <= r.gap < 1


def test_smote_plan_small_minority(spark):
    one = spark.createDataFrame([(1,)] + [(0,)] * 9, "y int")
    p = C.smote_plan(one, "y").first()
    assert not p["run"] and p["n_new"] == 0
    five = spark.createDataFrame([(1,)] * 5 + [(0,)] * 20, "y int")
    p = C.smote_plan(five, "y", 1.0, 5).first()
    assert p["run"] and p["n_new"] == 15 and p["k"] == 4


def test_flip_and_perturb_exact(spark):
    df = _labelled(spark)
    fl = C.flip_labels(df, "y", "id", 0.1).toPandas()
    assert fl.flipped.sum() == 50
    pt = C.perturb(df, "y", "id", {"x": (100.0, 200.0)}, 0.1).toPandas()
    assert pt.groupby("y").perturbed.sum().to_dict() == {0: int(len(df.where("y = 0").collect()) * 0.1), 1: 5}
    assert (pt[pt.perturbed].x >= 100).all()


def test_medians_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (10.0, 5.0), (None, 5.0)], "a double, b double")
    med = P.exact_medians(df, ["a", "b"])
    assert med == {"a": 2.0, "b": 5.0}
    st = P.scaling_stats(P.impute(df, med), ["a", "b"])
    assert st["b"] == (5.0, 1.0)  # constant column → std 1
    back = P.unscale(P.scale(P.impute(df, med), st), st).collect()
    assert [round(r["a"], 9) for r in back] == [1.0, 2.0, 10.0, 2.0]


def test_auc_and_metrics(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (0, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    auc = evaluate.auc(df).first()["auc_roc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc == round(exp, 6)
    eq = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert evaluate.auc(eq).first()["auc_roc"] == 0.5
    nopos = spark.createDataFrame([(0, 0.5)], "label int, score double")
    assert evaluate.auc(nopos).first()["auc_roc"] is None
    pred = df.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    r = evaluate.rates(evaluate.confusion(pred)).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (2, 1, 0, 2)
    assert r["precision"] == round(2 / 3, 6) and r["recall"] == 1.0
    rep = {x["class_label"]: x for x in evaluate.class_report(pred).collect()}
    assert rep["1"]["support"] == 2 and rep["accuracy"]["precision"] == 0.8
    ll = evaluate.log_loss(df, prob="score").first()["log_loss"]
    exp_ll = -np.mean([y * np.log(s) + (1 - y) * np.log(1 - s) for y, s in rows])
    assert abs(ll - exp_ll) < 1e-6


def test_exact_medians_against_numpy(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=1001)
    b = np.round(rng.exponential(size=1000), 1)  # many ties
    rows = [(float(a[i]), float(b[i]) if i < 1000 else None) for i in range(1001)]
    df = spark.createDataFrame(rows, "a double, b double")
    for acc in (1_000_000, 100):  # a tight and a loose bracket
        med = P.exact_medians(df, ["a", "b"], accuracy=acc)
        assert med["a"] == float(np.median(a)) and med["b"] == float(np.median(b))


def test_dense_numbers_of_many_wide_rows(spark):
    """2,000,000 rows with a payload: every number once, in order (range bounds are sampled only once)."""
    df = spark.range(0, 2_000_000, 1, 8).select(
        F.xxhash64("id").alias("k"), "id", F.concat(F.lit("payload-"), F.md5(F.col("id").cast("string"))).alias("wide"))
    got = dense_index(df, ["k", "id"], "i", partitions=8)
    one = got.agg(F.min("i"), F.max("i"), F.countDistinct("i"), F.count(F.lit(1)), F.countDistinct("wide")).first()
    assert tuple(one) == (0, 1_999_999, 2_000_000, 2_000_000, 2_000_000)
    assert got.groupBy(F.floor(F.col("i") / 1000).alias("b")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).selectExpr(
        "b", "hi", "lead(lo) over (order by b) as next").filter("next < hi").count() == 0


def test_running_sums_of_many_wide_rows(spark):
    from pyspark.sql import Window

    from vigil.operators.history import sums_before
    df = spark.range(0, 600_000, 1, 6).select((F.col("id") % 3 * 0 + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)).alias("g"),
                                              F.xxhash64("id").alias("k"), "id", F.md5(F.col("id").cast("string")).alias("wide"))
    got = sums_before(df, ["g"], ["k", "id"], {"n": F.lit(1)}, partitions=8)
    want = F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1
    assert got.withColumn("want", want).filter("n <> want").count() == 0 and got.count() == 600_000
