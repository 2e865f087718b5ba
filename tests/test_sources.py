"""Sources and sinks: CSV folders with mixed headers and a broken file,
absent folders, list documents in both layouts."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from vigil.operators import lists
from vigil.sources import files as IO


def test_csv_folder_mixed_headers_and_broken_file(spark):
    folder = IO.scratch_dir(spark, "t-csv")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "a.csv"), "w") as f:
        f.write("id,income,fraud_bool\n1,10,0\n2,abc,1\n")
    with open(os.path.join(folder, "b.csv"), "w") as f:
        f.write("id,source,fraud_bool\n3,web,0\n")
    with open(os.path.join(folder, "c.csv"), "w") as f:
        f.write("\n4,5\n")  # blank header line: reported, skipped
    with open(os.path.join(folder, "d.csv"), "wb") as f:
        f.write(b"")  # empty file: listed by nobody, contributes nothing
    df, errors = IO.read_csv_folder(spark, folder)
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["3"]["income"] is None and rows["1"]["source"] is None
    assert any(e.endswith("c.csv") for e in errors)


def test_corrupt_file_is_left_out_and_listed(spark):
    """A file that breaks off half-way (its checksum says so) gives no rows, and is listed with its readable lines."""
    folder = IO.scratch_dir(spark, "t-corrupt")
    for name, rows in (("a", 3), ("b", 200_000), ("c", 2)):
        spark.createDataFrame([(i, f"{name}{i}") for i in range(rows)], "id long, x string").coalesce(1).write.mode("append").option("header", True).csv(folder)
    big = max(glob.glob(folder + "/*.csv"), key=os.path.getsize)
    with open(big, "r+b") as f:
        f.seek(os.path.getsize(big) // 2)
        f.write(b"#" * 100)
    df, errors = IO.read_csv_folder(spark, folder)
    assert sorted(r["x"] for r in df.collect()) == ["a0", "a1", "a2", "c0", "c1"]
    assert [e.endswith(os.path.basename(big)) for e in errors] == [True] and 0 < errors[0].lines < 200_001
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        IO.read_csv_folder(spark, folder, verify=False)[0].collect()


def test_empty_or_absent_folder(spark):
    df, errors = IO.read_csv_folder(spark, IO.scratch_dir(spark, "t-none"))
    assert df.count() == 0 and df.columns == ["is_ato"] and errors == []
    docs = IO.read_list_documents(spark, IO.scratch_dir(spark, "t-nodocs"))
    assert docs.count() == 0 and "key" in docs.columns


def test_list_documents_round_trip(spark):
    t0 = dt.datetime(2024, 1, 1, 12, 0, 0)
    adds = spark.createDataFrame([("ip", "10.0.0.1", "A", t0, 1, None), ("device", "d", "A", t0, 1, "x")],
                                 "list string, key string, account string, ts timestamp_ntz, seq long, reason string")
    ls = lists.fold_adds(adds).drop("first_listed")
    folder = IO.scratch_dir(spark, "t-docs")
    IO.write_list_documents(ls, folder)
    back = {(r["list"], r["key"]): r for r in IO.read_list_documents(spark, folder).collect()}
    assert back[("ip", "10.0.0.1")]["count"] == 1 and back[("ip", "10.0.0.1")]["last_updated"] == "2024-01-01T12:00:00"
    assert back[("device", "d")]["reason"] == "x"


def test_whole_file_document(spark):
    folder = IO.scratch_dir(spark, "t-whole")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "ip_blacklist.json"), "w") as f:
        f.write('{\n  "10.0.0.143": {\n    "count": 1,\n    "account": "X1",\n    "fraud_confirmed": true,\n'
                '    "last_updated": "2026-06-20T12:57:28.708085"\n  }\n}\n')
    rows = IO.read_list_documents(spark, folder, whole_file=True).collect()
    assert [(r["list"], r["key"], r["count"], r["account"]) for r in rows] == [("ip", "10.0.0.143", 1, "X1")]


def test_a_time_ordered_feed_is_one_job_and_replays_in_order(spark, tmp_path):
    """Files carry later modification times by range, whatever the number of jobs before; a second feed comes after the first."""
    folder = str(tmp_path / "in")
    rows = spark.range(2000).select(F.timestamp_seconds(F.col("id") * 7919 % 2000 + 5000).alias("t"), (F.col("id") * 7919 % 2000).cast("string").alias("value"))
    spark.sparkContext.setJobGroup("publish", "publish")
    IO.publish_in_time_order(rows, folder, "t", 40)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("publish"))
    spark.sparkContext.setJobGroup("other", "other")
    assert jobs <= 4  # bounds, shuffle and write, not one a file
    IO.publish_in_time_order(rows.select(F.col("t"), (F.col("value").cast("long") + 2000).cast("string").alias("value")), folder, "t", 5)
    names = sorted((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: os.stat(f"{folder}/{f}").st_mtime_ns)
    per_file = [[int(r.value) for r in spark.read.text(f"{folder}/{f}").collect()] for f in names]
    assert sorted(v for part in per_file for v in part) == list(range(4000)) and len(names) > 40
    assert all(max(a) < min(b) for a, b in zip(per_file, per_file[1:]))


def test_micro_batches_of_a_long_feed_are_few():
    assert [IO.files_per_batch(n) for n in (0, 10_000, 150_000, 600_000, 9_000_000, 54_000_000)] == [1, 1, 1, 6, 40, 40]
    assert -(-IO.slices_for(54_000_000) // IO.files_per_batch(54_000_000)) == 54
