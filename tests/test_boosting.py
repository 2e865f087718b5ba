import json
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from vigil.operators import boosting as B
from vigil.operators import models as M
from vigil.operators.search import exact_auc

FEATURES = ["a", "b", "c", "d"]


def table(n, seed=1, missing=0.1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([np.round(rng.normal(size=n), 1), rng.integers(0, 5, n), rng.integers(0, 2, n), np.round(rng.normal(size=n) * 3)])
    y = (x[:, 0] + (x[:, 1] > 2) * x[:, 2] + rng.normal(size=n) * 0.4 > 0.4).astype(float)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y


def frame(spark, x, y, weight=None):
    rows = [(i, float(y[i]), float(weight[i]) if weight is not None else 1.0, *[None if math.isnan(v) else float(v) for v in x[i]]) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, label double, w double, " + ", ".join(f"{c} double" for c in FEATURES))


def score_of(g, h, p):
    return max(abs(g) - p.l1, 0.0) ** 2 / (h + p.l2)


def plain_tree(x, g, h, depth, p):
    """A tree by trying every value of every feature, missing values on either side."""
    node = {"g": g.sum(), "h": h.sum(), "split": None}
    if depth == 0:
        return node
    best = None
    for f in range(x.shape[1]):
        known = ~np.isnan(x[:, f])
        for v in np.unique(x[known, f]):
            for missing_left in (False, True):
                left = np.where(known, x[:, f] <= v, missing_left)
                if not left.any() or left.all() or h[left].sum() < p.min_child or h[~left].sum() < p.min_child:
                    continue
                gain = score_of(g[left].sum(), h[left].sum(), p) + score_of(g[~left].sum(), h[~left].sum(), p) - score_of(g.sum(), h.sum(), p)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, v, missing_left, left)
    if best is None or best[0] <= 1e-6:
        return node
    gain, f, v, missing_left, left = best
    node |= {"split": (f, v, missing_left), "gain": gain, "children": (plain_tree(x[left], g[left], h[left], depth - 1, p), plain_tree(x[~left], g[~left], h[~left], depth - 1, p))}
    if gain < p.gamma and all(c["split"] is None for c in node["children"]):
        node["split"] = None
    return node


def walk(node, row):
    while node["split"]:
        f, v, missing_left = node["split"]
        node = node["children"][0 if (missing_left if math.isnan(row[f]) else row[f] <= v) else 1]
    return node


def gains_of(node, at=0):
    if node["split"] is None:
        return {}
    return {at: node["gain"]} | gains_of(node["children"][0], 2 * at + 1) | gains_of(node["children"][1], 2 * at + 2)


@pytest.mark.parametrize("node_rows", [65_536, 100, 0])
def test_trees_equal_a_plain_search_over_all_splits(spark, node_rows):
    x, y = table(1000)
    w = np.where(y == 1, 3.0, 1.0)
    p = B.BoostParams(trees=4, depth=3, subsample=1.0, colsample=1.0, max_bins=120, block=2, node_rows=node_rows, gamma=0.5)
    edges, trees = B.boost(frame(spark, x, y, w), FEATURES, "label", "w", "id", p)
    margin = np.zeros(len(y))
    bins = B.to_bins(x, edges)
    for tree in trees:
        q = 1 / (1 + np.exp(-margin))
        g, h = np.rint((q - y) * w * B.UNIT) / B.UNIT, np.rint(q * (1 - q) * w * B.UNIT) / B.UNIT
        plain = plain_tree(x, g, h, p.depth, p)
        reached = set(B._reached(tree).tolist())
        got = {int(i): float(tree.gain[i]) for i in np.flatnonzero(tree.feature >= 0) if i in reached}
        want = gains_of(plain)
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)
        ends = [walk(plain, r) for r in x]
        mine = np.array([-math.copysign(max(abs(e["g"]) - p.l1, 0), e["g"]) / (e["h"] + p.l2) * p.rate for e in ends])
        assert np.allclose(tree.margins(bins), mine, atol=1e-9)
        margin += tree.margins(bins)


def test_one_fit_however_it_runs(spark):
    """Level by level, finished in tasks, or in memory; many partitions or one; blocks of any length."""
    x, y = table(700, seed=2)
    df = frame(spark, x, y)
    p = dict(trees=6, depth=4)
    fits = [B.packed(*B.boost(d, FEATURES, "label", None, "id", B.BoostParams(**p, node_rows=n, block=b)))
            for d, n, b in ((df, 65_536, 50), (df.repartition(7), 60, 2), (df.coalesce(1), 0, 4))]
    assert fits[0] == fits[1] == fits[2]
    assert len(fits[0]["trees"]) == 6


def test_row_and_column_draws():
    p = B.BoostParams(subsample=0.7, colsample=0.5)
    row = np.arange(200_000)
    seen = [B.drawn_rows(row, t, p) for t in range(3)]
    assert all(abs(s.mean() - 0.7) < 0.01 for s in seen)
    assert abs((seen[0] & seen[1]).mean() - 0.49) < 0.01
    assert {len(B.drawn_features(10, t, p)) for t in range(20)} == {5}
    assert len({tuple(B.drawn_features(10, t, p)) for t in range(20)}) > 5


def test_not_below_sparks_trees_and_above_seven_in_ten(spark):
    x, y = table(3000, seed=3, missing=0.0)
    train, test = frame(spark, x[:2000], y[:2000]), frame(spark, x[2000:], y[2000:])
    auc = {}
    for name, learner in (("own", M.regularised(FEATURES, "id", trees=30, depth=4, rate=0.1)), ("spark", M.gbt(trees=30, depth=4, rate=0.1, gamma=0.0))):
        rows = M.score(M.tabular_pipeline(FEATURES, learner).fit(train), test, FEATURES).orderBy("id").collect()
        s = np.array([r["ato_probability"] for r in rows])
        assert ((s >= 0) & (s <= 1)).all()
        auc[name] = exact_auc(y[2000:], s)
        assert ((s > 0.5) == y[2000:]).mean() > 0.7
    assert auc["own"] >= auc["spark"] - 0.005


def test_saved_model_scores_the_same_and_walks_the_same(spark, tmp_path):
    x, y = table(400, seed=4)
    df = frame(spark, x, y)
    model = M.tabular_pipeline(FEATURES, M.regularised(FEATURES, "id", weight="w", trees=12, depth=3)).fit(df)
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    a = {r["id"]: r["ato_probability"] for r in M.score(model, df, FEATURES).collect()}
    b = {r["id"]: r["ato_probability"] for r in M.score(loaded, df, FEATURES).collect()}
    assert a == b
    walked = {r["id"]: r["ato_probability"] for r in M.score_from_nodes(df, loaded.stages[-1].nodes(spark), FEATURES, "id", 3).collect()}
    assert all(abs(a[i] - walked[i]) < 1e-12 for i in a)
    assert sum(loaded.stages[-1].importance().values()) == pytest.approx(1.0)


def test_empty_and_one_class_tables(spark):
    empty = spark.createDataFrame([], "id long, label double, w double, a double, b double, c double, d double")
    model = M.regularised(FEATURES, "id", trees=3).fit(empty)
    x, y = table(20)
    assert {r["ato_probability"] for r in model.transform(frame(spark, x, y)).collect()} == {0.5}
    one = M.regularised(FEATURES, "id", trees=3).fit(frame(spark, x, np.ones(20)))
    assert all(r["ato_probability"] > 0.5 for r in one.transform(frame(spark, x, y)).collect())


def test_weights_null_labels_and_clashing_columns(spark):
    x, y = table(300, seed=5)
    df = frame(spark, x, y).withColumns({"row": F.lit(1), "bins": F.lit(2), "margin": F.lit(3), "_v0": F.lit("x")})
    extra = df.withColumn("label", F.lit(None).cast("double")).withColumn("id", F.col("id") + 1000)
    p = B.BoostParams(trees=3, depth=3)
    assert B.packed(*B.boost(df.unionByName(extra), FEATURES, "label", "w", "id", p)) == B.packed(*B.boost(df, FEATURES, "label", "w", "id", p))


def test_few_values_are_all_cut_points(spark):
    df = spark.createDataFrame([(float(i % 7), float(i), None if i else 1.0) for i in range(500)], "few double, many double, rare double")
    few, many, rare = B.bin_edges(df, ["few", "many", "rare"], 16)
    assert few == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and len(many) == 15 and rare == []


def test_settings_are_checked():
    assert json.loads(B.settings_json(trees=5))["trees"] == 5 and B.TUNED[0] == "trees" and len(B.TUNED) == 9
    with pytest.raises(ValueError):
        B.BoostParams(depth=0)


def test_passes_walk_few_trees(spark, monkeypatch):
    """Level by level, margins are written every ``level_block`` trees; the trees do not depend on it."""
    df = spark.range(600).select("id", (F.col("id") * 37 % 101).alias("a"), (F.col("id") * 53 % 89).alias("b"), ((F.col("id") * 37 % 101) > 50).cast("double").alias("label"))
    seen, plain = [], B._level

    def level(data, pending, *rest):
        seen.append(len(pending))
        return plain(data, pending, *rest)
    monkeypatch.setattr(B, "_level", level)
    p = dict(trees=6, depth=2, node_rows=100)
    few = B.packed(*B.boost(df, ["a", "b"], "label", None, "id", B.BoostParams(**p)))
    assert max(seen) < 4
    assert few == B.packed(*B.boost(df, ["a", "b"], "label", None, "id", B.BoostParams(**p, level_block=50)))


@pytest.mark.parametrize("min_child", [0.0, 1.0])
def test_a_level_adds_up_at_most_half_the_rows(monkeypatch, min_child):
    """Of two siblings only the smaller's rows are added up; the sums in every node are those of its rows."""
    x, y = table(3000, seed=6)
    bins = B.to_bins(x, [sorted(set(np.round(np.nanquantile(x[:, j], np.linspace(0.05, 0.95, 19)), 3))) for j in range(x.shape[1])])
    seen, plain = [], B._sums

    def counted(codes, first, cells, rows, *more):
        seen.append(len(rows))
        return plain(codes, first, cells, rows, *more)

    monkeypatch.setattr(B, "_sums", counted)
    p = B.BoostParams(trees=1, depth=6, subsample=1.0, colsample=1.0, min_child=min_child, gamma=0.0)
    tree = B.boost_rows(np.arange(len(y)), y, np.ones(len(y)), bins, np.zeros(len(y)), 0, 1, p)[0]
    assert seen[0] == len(y) and len(seen) > 3 and max(seen[1:]) <= len(y) / 2
    g, h = B.gradients(y, np.ones(len(y)), np.zeros(len(y)))
    for depth in range(p.depth + 1):
        at = tree.places(bins, depth)
        for node in np.unique(at):
            assert tree.g[node] == g[at == node].sum() / B.UNIT and tree.h[node] == h[at == node].sum() / B.UNIT


def test_rows_that_fit_a_task_are_not_scanned_level_by_level(spark, monkeypatch):
    """70,000 rows took several jobs a tree; they are a few MB of bins."""
    monkeypatch.setattr(B, "_one_tree", lambda *a: pytest.fail("a job a level"))
    df = spark.range(70_000).selectExpr("id", "cast(id % 7 > 3 as double) AS label", "cast(id % 7 as double) AS a", "cast(id % 11 as double) AS b")
    _, trees = B.boost(df, ["a", "b"], "label", None, "id", B.BoostParams(trees=2, depth=2))
    assert len(trees) == 2 and all((t.feature >= 0).any() for t in trees)


def test_the_walk_of_few_rows_is_dealt_to_all_tasks(spark):
    x, y = table(200)
    df = frame(spark, x, y).coalesce(1)
    model = M.regularised(FEATURES, "id", trees=3, depth=3).fit(df)
    walked = M.score_from_nodes(df, model.nodes(spark), FEATURES, "id", 3)
    dealt = [line for line in walked._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1
    same = walked.join(model.transform(df).withColumnRenamed("ato_probability", "p"), "id")
    assert same.count() == 200 and same.filter(F.abs(F.col("p") - F.col("ato_probability")) > 1e-12).count() == 0
