import math

import numpy as np
import pytest

from vigil.llm.whitening import op13_multiplicity_whitening, whiten

SCHEMA = "vec_id long, embedding array<double>"


def brute(vectors, components=32, weights=None):
    """x, n, deviations, eigenvalues, unit components and whitened rows of plain lists of floats."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    weights = weights or [1] * len(x)
    n, d = sum(weights), len(x[0])
    sums = [sum(w * r[j] for r, w in zip(x, weights, strict=True)) for j in range(d)]
    scaled = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    z = np.array([[v / n for v in r] for r in scaled], dtype=np.float64)
    cov = (z * np.array(weights, dtype=float)[:, None]).T @ z / n
    values, parts = np.linalg.eigh(cov)
    k = min(components, d)
    values, parts = values[::-1][:k], parts[:, ::-1][:, :k]
    return n, [sum(v * v for v in r) for r in scaled], values, z @ parts / np.sqrt(np.abs(values)), np.trace(cov)


def test_all_embeddings_against_numpy(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, values, white, trace = brute([r["embedding"] for r in given])
    got = op13_multiplicity_whitening(spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
                          ("explained", "double"), ("identity_error", "double")]
    rows = got.orderBy("vec_id", "component").collect()
    assert len(rows) == 32 * len(given)
    table = np.array([r["whitened"] for r in rows]).reshape(len(given), 32)
    signs = np.sign((table * white).sum(axis=0))
    assert np.abs(table * signs - white).max() < 1e-8
    for i, r in enumerate(rows):
        assert (r["n"], r["deviation"]) == (n, deviations[i // 32])
        assert r["explained"] == pytest.approx(values[i % 32] / trace, rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert len({r["identity_error"] for r in rows}) == 1


def copies(rng):
    base = rng.normal(size=(40, 6))
    return [base[0].tolist()] * 60 + [base[1].tolist()] * 17 + [v.tolist() for v in base]


@pytest.mark.parametrize("by_count", [True, False])
def test_copies_weigh_by_count_or_one(spark, by_count):
    vectors = copies(np.random.default_rng(3))
    seen = {}
    for v in vectors:
        seen.setdefault(tuple(math.floor(64 * c) for c in v), [v, 0])[1] += 1
    n, deviations, values, white, trace = brute([v for v, _ in seen.values()], weights=[c if by_count else 1 for _, c in seen.values()])
    row_of = {k: i for i, k in enumerate(seen)}
    got = {r["vec_id"]: r for r in whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA), by_count=by_count).collect()}
    assert len(got) == len(vectors)
    table = np.array([got[i]["whitened"] for i in range(len(vectors))])
    want = np.array([white[row_of[tuple(math.floor(64 * c) for c in v)]] for v in vectors])
    assert np.abs(table * np.sign((table * want).sum(axis=0)) - want).max() < 1e-9
    for i, v in enumerate(vectors):
        assert (got[i]["n"], got[i]["deviation"]) == (n, deviations[row_of[tuple(math.floor(64 * c) for c in v)]])
        assert got[i]["explained"] == pytest.approx(list(values / trace))
        assert got[i]["identity_error"] < 1e-9


def test_edge_rows(spark):
    rng = np.random.default_rng(4)
    whole = [rng.normal(size=4).tolist() for _ in range(12)]
    odd = [None, [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, 2.0, 3.0, float("inf")], [1e300, 0.0, 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(whole)] + [(0, whole[0]), (None, whole[1]), (None, None)] + [(100 + i, v) for i, v in enumerate(odd)]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(1) for k in ("x", "h", "weight", "w", "n", "deviation", "copies")})
    got = whiten(df).collect()
    n, deviations, _, white, _ = brute(whole + [whole[0], whole[1]])
    assert len(got) == n == 14 and sum(r["vec_id"] is None for r in got) == 1 and sum(r["vec_id"] == 0 for r in got) == 2
    by_id = {r["vec_id"]: r for r in got}
    assert [by_id[i]["deviation"] for i in range(12)] == deviations[:12] and by_id[None]["deviation"] == deviations[1]
    assert {len(r["whitened"]) for r in got} == {4}


def test_no_rows_and_no_variance(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    same = whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], SCHEMA)).collect()
    assert [(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same] == [(0, [None, None], [0.0, 0.0], None)] * 2
    line = whiten(spark.createDataFrame([(1, [0.0, 0.0, 1.0]), (2, [2.0, 0.0, 1.0])], SCHEMA)).orderBy("vec_id").collect()
    assert [abs(r["whitened"][0]) for r in line] == [1.0, 1.0] and line[0]["whitened"][1:] == [None, None]
    assert line[0]["explained"] == [1.0, 0.0, 0.0] and line[0]["identity_error"] < 1e-12


def test_numbers_beyond_64_bits(spark):
    vectors = [[float(1 << 50), 1.0], [-float(1 << 50), 2.0], [0.0, 7.0]]
    n, deviations, values, white, trace = brute(vectors)
    got = whiten(spark.createDataFrame(list(enumerate(vectors)), SCHEMA)).orderBy("vec_id").collect()
    assert [r["deviation"] for r in got] == [v if v < 1 << 63 else None for v in deviations]
    assert got[2]["deviation"] is not None and got[0]["deviation"] is None
    assert abs(got[0]["whitened"][0]) == pytest.approx(abs(white[0][0]))
