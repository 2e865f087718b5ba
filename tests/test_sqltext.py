"""The oracle-text helpers: half-up rounding and BIGINT counts in DuckDB."""

import duckdb

from vigil.plans.sqltext import bigint_counts, sround


def test_sround_matches_spark_half_up(spark):
    vals = [0.20174999999999998, 0.25225, 0.12345, 0.12355, 614.0140655, 1e-7, 2.5]
    con = duckdb.connect()
    duck = [con.execute(f"SELECT {sround(repr(v), 4)}").fetchone()[0] for v in vals]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    sp = [r[0] for r in df.selectExpr("round(x, 4)").collect()]
    assert duck == sp


def test_bigint_counts_rewrites_nested():
    sql = "SELECT count_if(a = (1)) + count_if(b IN (SELECT count_if(c) FROM t)) AS n FROM t"
    out = bigint_counts(sql)
    assert "count_if" not in out
    assert out.count("count(*) FILTER (WHERE") == 3
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT * FROM (VALUES (1, 1, true), (2, 0, false)) v(a, b, c)")
    assert con.execute(out).fetchone()[0] == con.execute(sql).fetchone()[0]
    assert str(con.sql(out).types[0]) == "BIGINT"
