"""Every registered query of the report engine against DuckDB, over the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tallybook.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", catalog.queries())
def test_equals_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got == want


def test_places_go_on_over_the_ranges_of_a_sort(spark):
    from pyspark.sql import functions as F

    from tallybook.operators import steps

    df = spark.range(997).select(F.when(F.col("id") % 10 > 0, F.col("id") * 7919 % 997).alias("x"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = steps.sort_with_places(df, ["-x", "id"])
        assert placed.rdd.getNumPartitions() > 1
        got = {r.id: r.place for r in placed.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(df.collect(), key=lambda r: (r.x is None, -(r.x or 0), r.id))
    assert got == {r.id: i for i, r in enumerate(want, 1)}
    assert steps.sort_with_places(df.limit(0), ["x"]).count() == 0


def test_plans_stay_in_the_jvm(spark):
    """Only the query that is about Python batches runs Python; scans read the columns that they need."""
    for name in ("compare_previous", "dedupe_last", "top_others", "metrics_of_input"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
    plan = catalog.queries()["window_report"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_dedupe_keeps_one_row_before_the_shuffle(spark):
    plan = catalog.queries()["dedupe_last"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_streams_give_what_batches_give(spark, tmp_path):
    from tallybook.streaming import arrivals

    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = arrivals.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 day", "100 days", ["event_type"], "value")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    try:
        query.processAllAvailable()
        got = {(r.window_start, r.event_type, r.n) for r in spark.sql("SELECT * FROM arrivals").collect()}
    finally:
        query.stop()
    batch = arrivals.windowed(events, "ts", "1 day", "100 days", ["event_type"], "value")
    assert got == {(r.window_start, r.event_type, r.n) for r in batch.collect()}
