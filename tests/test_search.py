import math

import numpy as np
import pytest

from vigil.operators import search as T
from vigil.operators.boosting import BoostParams
from vigil.operators.evaluate import auc as spark_auc


def plain_density(x, values, low, high):
    """The mixture, restated: neighbours' distances as widths, cut off at the bounds."""
    span, centres = high - low, [*values, (low + high) / 2]
    total = 0.0
    for i, c in enumerate(centres):
        others = sorted([low, high, *[v for j, v in enumerate(centres) if j != i]])
        below, above = max(v for v in others if v <= c), min(v for v in others if v >= c)
        width = span if i == len(centres) - 1 else min(max(c - below, above - c, span / min(100, 1 + len(centres))), span)
        phi = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
        inside = phi((high - c) / width) - phi((low - c) / width)
        total += math.exp(-0.5 * ((x - c) / width) ** 2) / (math.sqrt(2 * math.pi) * width * inside)
    return total / len(centres)


def test_density_against_a_plain_restatement():
    values = [0.11, 0.4, 0.42, 0.9, 0.05]
    kernel = T.Parzen.of(values, 0.0, 1.0, False)
    grid = np.linspace(0, 1, 41)
    assert np.allclose(kernel.density(grid), [plain_density(x, values, 0.0, 1.0) for x in grid])
    fine = np.linspace(0, 1, 20_001)
    assert np.trapezoid(kernel.density(fine), fine) == pytest.approx(1.0, abs=1e-4)


def test_whole_numbers_have_masses_that_add_up():
    kernel = T.Parzen.of([3, 4, 9], 3, 10, True)
    assert kernel.mass(np.arange(3, 11)).sum() == pytest.approx(1.0)
    drawn = np.rint(kernel.draw(np.random.default_rng(0), 20_000))
    assert drawn.min() >= 3 and drawn.max() <= 10
    seen = np.array([(drawn == k).mean() for k in range(3, 11)])
    assert np.abs(seen - kernel.mass(np.arange(3, 11))).max() < 0.02


def test_proposals_follow_the_ratio():
    """The candidate taken has the largest ratio of the two plainly stated densities."""
    history = [({"x": v}, -abs(v - 0.3)) for v in np.linspace(0, 1, 30)]
    good, bad = T.divide(history)
    assert len(good) == 3 and len(bad) == 27 and max(abs(s["x"] - 0.3) for s in good) < 0.06
    seed = np.random.default_rng(5)
    got = T.propose(history, {"x": (0.0, 1.0)}, np.random.default_rng(5))["x"]
    drawn = T.Parzen.of([s["x"] for s in good], 0.0, 1.0, False).draw(seed, 24)
    ratio = [plain_density(x, [s["x"] for s in good], 0.0, 1.0) / plain_density(x, [s["x"] for s in bad], 0.0, 1.0) for x in drawn]
    assert got == drawn[int(np.argmax(ratio))]


def test_finds_the_best_place_sooner_than_chance():
    space = {"x": (0.0, 1.0), "k": (1, 50), "z": (-5.0, 5.0)}
    loss = lambda s: -((s["x"] - 0.7) ** 2 + ((s["k"] - 12) / 50) ** 2 + (s["z"] / 10) ** 2)
    best = {"tpe": [], "chance": []}
    for seed in range(8):
        for name in best:
            rng, history = np.random.default_rng(seed), []
            for _ in range(60):
                s = T.propose(history, space, rng) if name == "tpe" else T.random_settings(space, rng)
                history.append((s, loss(s)))
            best[name].append(max(v for _, v in history))
    assert np.mean(best["tpe"]) > np.mean(best["chance"])


def test_exact_auc_against_the_distributed_one(spark):
    rng = np.random.default_rng(2)
    y, s = (rng.random(400) < 0.3).astype(int), np.round(rng.random(400), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    row = spark_auc(df).first().asDict()
    assert T.exact_auc(y, s) == pytest.approx([v for v in row.values() if isinstance(v, float)][0])
    assert T.exact_auc(np.ones(3), np.ones(3)) == 0.5


def test_search_over_nine_parameters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    rows = [(i, float(x[i, 0] + 0.5 * rng.normal() > 0), i % 3, *map(float, x[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label double, fold int, a double, b double, c double")
    space = {k: v for k, v in T.SEARCH_SPACE.items()} | {"trees": (3, 8)}
    runs = [T.search(d, ["a", "b", "c"], "label", "fold", "id", trials=13, folds=3, batch=4, space=space, settings=BoostParams(seed=1)).collect()
            for d in (df, df.repartition(5))]
    assert runs[0] == runs[1]
    assert [r["trial"] for r in runs[0]] == list(range(13)) and [r["batch"] for r in runs[0]] == [i // 4 for i in range(13)]
    for r in runs[0]:
        assert all(low <= r[k] <= high for k, (low, high) in space.items())
    assert max(r["mean_auc"] for r in runs[0]) > 0.85


def test_the_sample_is_bounded(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    assert 800 < T.sample_rows(df, "k", 1000).count() < 1200 and T.sample_rows(df, "k", 20_000).count() == 20_000


def test_every_fit_is_a_task_of_its_own_and_long_ones_come_first(spark):
    rng = np.random.default_rng(3)
    tried = [T.random_settings(T.SEARCH_SPACE, rng) for _ in range(5)]
    types = ", ".join(f"{k} {'int' if T.is_whole(b) else 'double'}" for k, b in T.SEARCH_SPACE.items())
    parts = T.dealt(spark, [(i, f, *s.values()) for i, s in enumerate(tried) for f in range(5)], types, BoostParams()).rdd.glom().collect()
    assert [len(p) for p in parts] == [1] * 25
    length = [p[0]["trees"] * p[0]["depth"] for p in parts]
    assert length == sorted(length, reverse=True)
    assert {(p[0]["trial"], p[0]["fold"]) for p in parts} == {(i, f) for i in range(5) for f in range(5)}


def test_every_labelled_row_is_searched_at_any_size(spark, monkeypatch):
    """Rows beyond what is broadcast are not sampled: each fit is distributed and gives the same AUC."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2)).round(1)
    rows = [(i, float(x[i, 0] + 0.8 * rng.normal() > 0), i % 2, *map(float, x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, label double, fold int, a double, b double")
    seen = []
    spread = T.B.boost_binned
    monkeypatch.setattr(T.B, "boost_binned", lambda data, *a: (seen.append(data.count()), spread(data, *a))[1])
    space = {"trees": (2, 3), "depth": (2, 3), "rate": (0.1, 0.3)}
    held, wide = (T.search(df, ["a", "b"], "label", "fold", "id", trials=2, folds=2, batch=2, space=space, settings=BoostParams(seed=1, node_rows=50), held_rows=n).collect()
                  for n in (600, 100))
    assert seen == [300] * 4
    assert [r[:-1] for r in held] == [r[:-1] for r in wide]
    assert [r["mean_auc"] for r in held] == pytest.approx([r["mean_auc"] for r in wide], abs=1e-12)


def test_auc_over_ranges_of_scores_against_the_exact_one(spark):
    rng = np.random.default_rng(6)
    y, s = (rng.random(500) < 0.3).astype(float), np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "margin double, y double").repartition(7)
    assert T.spread_auc(df) == pytest.approx(T.exact_auc(y.astype(int), s), abs=1e-12)
    assert T.spread_auc(df.filter("y = 1")) == 0.5 and T.spread_auc(df.filter("y > 1")) == 0.5


def test_a_search_over_more_rows_than_were_sampled_once_uses_all(spark, monkeypatch):
    df = spark.range(100_500).selectExpr("id", "cast(id % 2 as double) AS label", "cast(id % 2 as int) AS fold", "cast((id * 7919) % 13 as double) AS a")
    given = []
    held = T._held_fits
    monkeypatch.setattr(T, "_held_fits", lambda cut, *a: (given.append(cut.count()), held(cut, *a))[1])
    got = T.search(df, ["a"], "label", "fold", "id", trials=1, folds=2, batch=1, space={"trees": (1, 1)}, settings=BoostParams(seed=1, depth=1)).collect()
    assert given == [100_500] and len(got) == 1
