import pytest

from vigil.operators import models as M
from vigil.sources import versions as V


def write(spark, rows):
    return lambda folder: spark.createDataFrame(rows, "k long").write.parquet(folder + "/t")


def read(spark, version):
    return sorted(r["k"] for r in spark.read.parquet(version.path + "/t").collect())


def test_readers_see_whole_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert V.current(spark, root) is None and V.versions(spark, root) == []
    first = V.publish(spark, root, write(spark, [(1,), (2,)]), {"note": "first"})
    seen = []

    def slow(folder):
        write(spark, [(3,)])(folder)
        seen.append(read(spark, V.current(spark, root)))  # a reader while the new files are there already

    second = V.publish(spark, root, slow)
    assert seen == [[1, 2]]
    assert (first.number, second.number) == (1, 2) and read(spark, V.current(spark, root)) == [3]
    assert read(spark, V.current(spark, root, 1)) == [1, 2] and V.current(spark, root, 1).meta == {"note": "first"}
    with pytest.raises(ValueError):
        V.current(spark, root, 9)


def test_a_failed_write_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    V.publish(spark, root, write(spark, [(1,)]))

    def broken(folder):
        write(spark, [(2,)])(folder)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        V.publish(spark, root, broken)
    assert read(spark, V.current(spark, root)) == [1] and len(V.versions(spark, root)) == 1


def test_a_second_writer_takes_the_next_number(spark, tmp_path):
    root = str(tmp_path / "t")

    def other_first(folder):
        V.publish(spark, root, write(spark, [(7,)]))
        write(spark, [(8,)])(folder)

    last = V.publish(spark, root, other_first)
    assert last.number == 2 and [read(spark, v) for v in V.versions(spark, root)] == [[7], [8]]


def test_model_bundle(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 2), float(i % 2) + i / 1000) for i in range(100)], "id long, label double, a double")
    model = M.tabular_pipeline(["a"], M.regularised(["a"], "id", trees=4, depth=2), impute_scale=True).fit(df)
    root = str(tmp_path / "m")
    with pytest.raises(ValueError):
        M.load_bundle(spark, root)
    bundle = M.Bundle(model, {"trees": 4}, {"auc": 0.1 + 0.2}, ["a"])
    assert M.publish_bundle(spark, root, bundle).number == 1
    M.publish_bundle(spark, root, M.Bundle(model, {"trees": 5}, {}, ["a"]))
    old, new = M.load_bundle(spark, root, 1), M.load_bundle(spark, root)
    assert (old.params, old.metrics, old.features, old.version) == ({"trees": 4}, {"auc": 0.1 + 0.2}, ["a"], 1) and new.params == {"trees": 5}
    assert M.score(old.model, df, ["a"]).orderBy("id").collect() == M.score(model, df, ["a"]).orderBy("id").collect()
