"""Steps, tables, metrics and scenarios on small tables."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallybook.functions.periods import Period
from tallybook.operators import joins, metrics, shaping, steps
from tallybook.plans import scenario as S

MARCH = Period.read("2024-03")


@pytest.fixture(scope="module")
def sales(spark):
    day = lambda m, d: datetime(2024, m, d)
    rows = [
        (day(3, 1), "north", 10.0, 1, 0), (day(3, 5), "north", 30.0, 1, 1), (day(3, 7), "south", 5.0, 1, 2), (day(3, 9), None, 2.0, 1, 3), (day(3, 9), "east", 1.0, 1, 4),
        (day(2, 1), "north", 20.0, 1, 5), (day(2, 2), "west", 8.0, 1, 6), (day(2, 3), None, 4.0, 1, 7), (None, "north", 99.0, 1, 8), (day(3, 5), "north", 30.0, 2, 0),
    ]
    return spark.createDataFrame(rows, "d timestamp_ntz, region string, amount double, _upload_seq int, _row long")


def spec(**more):
    return S.Scenario(
        inputs={"sales": {"source": "s", "steps": [{"type": "dedupe", "by": ["d", "region", "amount"]}, {"type": "formula", "name": "double", "text": "amount * 2.0"}]}},
        tables={"by_region": {"input": "sales", "period_column": "d", "keys": ["region"], "aggregates": [{"fn": "sum", "column": "amount", "name": "total"}, {"fn": "median", "column": "double", "name": "middle"}], **more}},
        metrics={"total": {"source": "sales", "period_column": "d", "aggregate": {"fn": "sum", "column": "amount"}}, "half": {"formula": "total / 2"}, "none": {"formula": "total / 0"}},
    )


def test_compare_keeps_current_groups(spark, sales):
    report = S.run(spark, spec(compare=[{"kind": "previous_period", "suffix": "prev"}]), {"s": sales}, MARCH)
    rows = {r.region: r for r in report.frames["by_region"].collect()}
    assert set(rows) == {"north", "south", "east", None}
    assert (rows["north"].total, rows["north"].total_prev, rows["north"].total_prev_change_pct) == (40.0, 20.0, 1.0)
    assert rows[None].total_prev == 4.0 and rows["south"].total_prev is None and rows["south"].total_prev_change is None
    assert report.values == {"total": 48.0, "half": 24.0, "none": None}


def test_top_and_others(spark, sales):
    more = dict(sort=["-total"], top=1, others="rest", derive=[{"kind": "share", "name": "share", "column": "total"}, {"kind": "rank", "name": "place", "column": "total"}, {"kind": "cumsum", "name": "run", "column": "total"}])
    rows = {r.region: r for r in S.run(spark, spec(**more), {"s": sales}, MARCH).frames["by_region"].collect()}
    assert (rows["rest"].total, rows["rest"].middle, rows["rest"].place, rows["rest"].run) == (8.0, 4.0, None, 48.0)
    assert rows["north"].place == 1 and abs(rows["north"].share + rows["rest"].share - 1) < 1e-12


def test_failures_stay_in_their_node(spark, sales):
    broken = spec(where="no_such_column > 1")
    report = S.run(spark, broken, {"s": sales}, MARCH)
    assert report.statuses["by_region"].state == "failed" and "no_such_column" in report.statuses["by_region"].message
    assert report.statuses["total"].state == "ok"
    bad = spec()
    bad.inputs["sales"]["steps"].append({"type": "select", "columns": ["nope"]})
    report = S.run(spark, bad, {"s": sales}, MARCH)
    assert report.statuses["sales"].state == "failed" and report.statuses["by_region"].state == "skipped"
    assert S.validate(S.Scenario({"a": {"source": "s", "steps": [{"type": "teleport"}]}})) == ["input a: no step 'teleport'"]


def test_metric_cycles(spark, sales):
    found = metrics.Metrics(spark, {"a": metrics.Metric(formula="b + 1"), "b": metrics.Metric(formula="a + 1")}, lambda _: sales, dict)
    with pytest.raises(ValueError, match="cycle"):
        found.value("a", MARCH)


def test_metric_compare_and_queries(spark, sales):
    m = metrics.Metrics(spark, {"total": S.metric_of(spec().metrics["total"]), "top": metrics.Metric(query="SELECT max(amount) FROM sales"), "bad": metrics.Metric(query="SELECT amount FROM sales")}, lambda _: sales, lambda: {"sales": sales})
    assert m.compared("total", MARCH)["total_prev"] == 32.0 and m.value("top", MARCH) == 99.0
    with pytest.raises(ValueError, match="one row"):
        m.value("bad", MARCH)
    assert metrics.plain(float("nan")) is None and metrics.plain(True) == 1


def test_steps_refuse(sales):
    with pytest.raises(ValueError):
        steps.rename(sales, {"d": "day"}, ["d"])
    with pytest.raises(ValueError):
        steps.rename(sales, {"region": "amount"})
    with pytest.raises(ValueError):
        steps.select(sales, drop=["d"], always=["d"])
    with pytest.raises(ValueError):
        steps.formula(sales, "_x", "1")
    with pytest.raises(ValueError, match="no column"):
        steps.filter_conditions(sales, [{"column": "zzz", "op": "eq", "value": 1}])


def test_three_valued_logic(sales):
    assert steps.filter_where(sales, "region <> 'north'").count() == 3
    assert steps.filter_conditions(sales, [{"column": "region", "op": "not_in", "value": ["north"]}]).count() == 3
    assert steps.filter_conditions(sales, [{"column": "region", "op": "is_null"}, {"column": "amount", "op": "gt", "value": 50}], "or").count() == 3


def test_half_even_and_lenient_casts(spark):
    df = spark.createDataFrame([(2.5, "1 234,5"), (3.5, "junk"), (-2.5, None)], "f double, t string")
    assert [tuple(r) for r in steps.cast(df, {"f": "int", "t": "float"}).collect()] == [(2, 1234.5), (4, None), (-2, None)]


def test_joins(spark):
    a = spark.createDataFrame([("b", 1), ("c", 2), (None, 3)], "k string, x long")
    b = spark.createDataFrame([("b", 10), ("b", 11), ("z", 12), (None, 13)], "no string, x long")
    assert sorted(map(tuple, joins.join(a, b, {"k": "no"}, "left", suffix="_b").collect()), key=str) == sorted([("b", 1, 10), ("b", 1, 11), ("c", 2, None), (None, 3, None)], key=str)
    assert joins.join(a, b, {"k": "no"}, "full").count() == 6 and joins.join(a, b, {"k": "no"}, "anti").count() == 2
    assert tuple(joins.unmatched(a, b, {"k": "no"}).first()) == (2, 1)
    with pytest.raises(ValueError, match="cannot be joined"):
        joins.join(a, b, {"k": "x"})


def test_python_in_scenarios(spark, sales):
    def pandas_total(frame):
        return frame.groupby("region", as_index=False)["amount"].sum()

    made = spec()
    made.inputs["sales"]["steps"] += [{"type": "python", "function": lambda df, context: df.withColumn("p", F.lit(context.period.code))}]
    made.tables["totals"] = {"input": "sales", "python": lambda df, context: df.groupBy("p").agg(F.sum("double").alias("t")), "schema": "p string, t double"}
    made.tables["wrong"] = {"input": "sales", "python": lambda df, context: df, "schema": "p string"}
    made.metrics["regions"] = {"python": lambda context: context.inputs["sales"].select("region").distinct().count()}
    report = S.run(spark, made, {"s": sales}, MARCH)
    assert [tuple(r) for r in report.frames["totals"].collect()] == [("2024-03", 358.0)]
    assert report.statuses["wrong"].state == "failed" and report.values["regions"] == 5
    bad = spec()
    bad.inputs["sales"]["steps"] += [{"type": "python", "function": "no_such_module:f"}, {"type": "python", "function": pandas_total, "mode": "table"}]
    assert len(S.validate(bad)) == 2
    found = steps.python(sales.select("region", "amount"), pandas_total, "table", "region string, amount double")
    assert {r.region: r.amount for r in found.collect()}["south"] == 5.0
    with pytest.raises(ValueError, match="no mode"):
        steps.python(sales, pandas_total, "card")


def test_depth_of_a_deduplication(spark, sales):
    step = {"type": "dedupe", "by": ["region"], "depth": 1, "period_column": "d"}
    rows = S.build_input(spark, {"source": "s", "steps": [step]}, {"s": sales}, {}, MARCH).collect()
    assert {r.region for r in rows} == {"north", "south", "east"}  # the newest row without a region is of February


def test_column_names_are_checked(sales):
    from tallybook.operators.datasets import Derive, Table, build

    with pytest.raises(ValueError, match="two columns"):
        build(sales, Table("d", aggregates=[S.Aggregate("count", name="n"), S.Aggregate("sum", "amount", "N")]), MARCH)
    with pytest.raises(ValueError, match="cannot be"):
        build(sales, Table("d", aggregates=[S.Aggregate("count", name="n")], derive=[Derive("formula", "_x", formula="n")]), MARCH)


def test_queries_leave_views_alone(spark, sales):
    spark.range(3).createOrReplaceTempView("data")
    assert steps.sql(sales, "WITH x AS (SELECT amount FROM data) SELECT count(*) AS n FROM x").first().n == 10
    assert spark.table("data").count() == 3 and not [t.name for t in spark.catalog.listTables() if t.name.startswith("_view_")]
    spark.catalog.dropTempView("data")


def test_order_over_ranges(spark):
    """Running sums, ranks and neighbours of a table that is sorted into several ranges."""
    from tallybook.operators import ordered

    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") * 31 % 50).alias("x")).repartition(5)
    rows = sorted(((r.id, r.x) for r in df.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sums = {r.id: r.s for r in ordered.with_running_sum(df, [F.col("id")], "x", "s").collect()}
        ranks = {r.id: r.k for r in ordered.with_rank(df, F.col("x").desc_nulls_last(), "x", "k").collect()}
        lags = {r.id: r.b for r in ordered.with_previous(df, [F.col("id")], "x", "b").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for i, (k, x) in enumerate(rows):
        total += x or 0
        assert sums[k] == (None if x is None else total) and lags[k] == (rows[i - 1][1] if i else None)
        assert ranks[k] == (None if x is None else 1 + sum(y is not None and y > x for _, y in rows))
    assert ordered.with_running_sum(df.limit(0), [F.col("id")], "x", "s").count() == 0


def test_formats_and_variables(spark):
    from tallybook.operators import formats

    row = spark.createDataFrame([(1234567.891, -0.0512, datetime(2024, 3, 1))], "a double, b double, d timestamp_ntz").select(formats.number(F.col("a"), 2, " ", ","), formats.percent(F.col("b"), 1, True), formats.money(F.col("a"), "EUR", 0), formats.day(F.col("d"), "%d/%m/%y")).first()
    assert tuple(row) == ("1 234 567,89", "-5,1\u00a0%", "1\u00a0234\u00a0568\u00a0EUR", "01/03/24")
    found = formats.period_variables(MARCH)
    assert formats.filled("{period}: {period_start}-{period_end}, {previous_period}", found) == "2024-03: 01.03.2024-31.03.2024, 2024-02"
    with pytest.raises(ValueError, match="no variable"):
        formats.filled("{nope}", found)
    ended = {code: formats.period_variables(Period.read(code))["last_quarter_period"] for code in ("2024-03", "2024-04", "2024-02", "2024", "2024-01-31", "2024-06-30", "2024-11-02..2024-12-30")}
    assert list(ended.values()) == ["2024-Q1", "2024-Q1", "2023-Q4", "2024-Q4", "2023-Q4", "2024-Q2", "2024-Q3"]
    assert formats.period_variables(Period.read("2024-02"))["last_quarter_year"] == "2023"


def test_the_day_of_a_run(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 1), "today() is current_date")], "d timestamp_ntz, s string")
    plan = S.Scenario(
        {"a": {"source": "s", "steps": [{"type": "formula", "name": "n", "text": "date_diff('day', d, CURRENT_DATE)"}, {"type": "filter", "where": "current_date() > d AND s = 'today() is current_date'"}]}},
        {"t": {"query": "SELECT n, today() - INTERVAL 1 DAY AS yesterday FROM a"}},
        {"m": {"query": "SELECT year(current_date) FROM a"}},
    )
    report = S.run(spark, plan, {"s": df}, MARCH, today=date(2024, 3, 31))
    assert all(s.state == "ok" for s in report.statuses.values()), report.statuses
    assert [(r.n, str(r.yesterday)[:10]) for r in report.frames["t"].collect()] == [(30, "2024-03-30")] and report.values["m"] == 2024
    assert S.run(spark, plan, {"s": df}, MARCH).frames["t"].first().n > 900


def test_python_steps(sales):
    double = steps.python_batches(sales.select("amount"), lambda b: b * 2, "amount double")
    assert double.agg({"amount": "sum"}).first()[0] == 2 * 209
    table = steps.python_table(sales.select("amount"), lambda t: t.describe()[["amount"]].reset_index(drop=True), "amount double")
    assert table.count() == 8
    with pytest.raises(ValueError, match="more than"):
        steps.python_table(sales, lambda t: t, "amount double", most_rows=3)


def test_shaping(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0), ("b", "y", 5.0), ("b", " ", 7.0)], "c string, s string, v double")
    assert sorted(map(tuple, shaping.series(df, "c", "s", "v").collect())) == [("a", 3.0, 0.0), ("b", 0.0, 5.0)]
    assert {tuple(r) for r in shaping.largest_and_others(df.select("s", "v"), "s", "v", 2, "rest").collect()} == {(" ", 7.0), ("rest", 8.0)}
    assert [r.v for r in shaping.last_rows(df, 2, ["v"]).collect()] == [5.0, 7.0]


def sql_scenario(tables, metrics=()):
    return S.Scenario(inputs={"o": {"source": "s", "period_column": "d"}}, tables=tables, metrics=dict(metrics))


def test_sql_tables_read_windows_and_finished_tables(spark, sales):
    tables = {
        "twice": {"query": "SELECT sum(n) * 2 AS n FROM Monthly"},
        "monthly": {"query": "WITH m AS (SELECT region FROM o) SELECT count(*) AS n FROM m WHERE region IN (SELECT region FROM m)"},
        "all": {"query": "SELECT count(*) AS n FROM o", "window": "all"},
        "february": {"query": "SELECT count(*) AS n FROM o", "window": "previous_period"},
        "lost": {"query": "SELECT * FROM nowhere"}, "after": {"query": "SELECT * FROM lost"}, "wrong": {"query": "SELEC 1"},
        "a": {"query": "SELECT * FROM b"}, "b": {"query": "SELECT * FROM a"},
    }
    later = sales.unionByName(sales.limit(1).withColumn("d", F.lit(datetime(2024, 5, 1)).cast("timestamp_ntz")))
    report = S.run(spark, sql_scenario(tables), {"s": later}, MARCH)
    assert {n: report.frames[n].first().n for n in ("monthly", "twice", "all", "february")} == {"monthly": 5, "twice": 10, "all": 9, "february": 3}
    states = {n: s.state for n, s in report.statuses.items()}
    assert [states[n] for n in ("lost", "after", "wrong", "a", "b")] == ["failed", "skipped", "failed", "failed", "failed"]
    assert "no table 'nowhere'" in report.statuses["lost"].message and "circle" in report.statuses["a"].message


def test_finished_tables_are_computed_once(spark, sales):
    """A table whose values differ with each computation, as sums of doubles may, read twice by a query and by metrics."""
    draw = F.udf(lambda: random.random(), "double").asNondeterministic()
    tables = {
        "drawn": {"input": "o", "python": lambda df, context: df.select("region", draw().alias("x")), "schema": "region string, x double"},
        "largest": {"query": "SELECT region, x FROM Drawn WHERE x = (SELECT max(x) FROM drawn)"},
        "measured": {"input": "o", "python": lambda df, context: df.select(draw().alias("x")), "schema": "x double"},
        "late": {"query": "SELECT raise_error(region) AS x FROM o"}, "after": {"query": "SELECT * FROM late"},
    }
    made = sql_scenario(tables)
    made.metrics["most"] = {"query": "SELECT max(x) FROM measured"}
    made.metrics["least"] = {"source": "drawn", "aggregate": {"fn": "min", "column": "x"}}
    report = S.run(spark, made, {"s": sales}, MARCH)
    drawn = [r.x for r in report.frames["drawn"].collect()]
    assert [r.x for r in report.frames["largest"].collect()] == [max(drawn)] and report.values["least"] == min(drawn)
    assert report.values["most"] == report.frames["measured"].agg(F.max("x")).first()[0]
    assert [report.statuses[n].state for n in ("late", "after")] == ["failed", "skipped"] and "late" not in report.frames


def test_metrics_fail_alone_and_compare(spark, sales):
    total = {"source": "o", "period_column": "d", "aggregate": {"fn": "sum", "column": "amount"}}
    metrics_of = {
        "total": {**total, "compare": [{"kind": "previous_period", "suffix": "prev"}]}, "bad": {**total, "aggregate": {"fn": "sum", "column": "nope"}}, "odd": {**total, "colour": 1},
        "rows": {"query": "SELECT count(*) FROM o", "compare": [{"kind": "previous_period", "suffix": "prev"}]}, "half": {"formula": "total / 2", "compare": [{"kind": "previous_period", "suffix": "prev"}]},
    }
    report = S.run(spark, sql_scenario({}, metrics_of), {"s": sales}, MARCH)
    assert {n: s.state for n, s in report.statuses.items()} == {"o": "ok", "total": "ok", "bad": "failed", "odd": "failed", "rows": "ok", "half": "ok"}
    assert report.values["total"] == 78.0 and report.values["total_prev"] == 32.0 and report.values["total_prev_change"] == 46.0
    assert (report.values["rows"], report.values["rows_prev"], report.values["half_prev"]) == (6, 3, 16.0)
    assert "nope" in report.statuses["bad"].message and "colour" in report.statuses["odd"].message


def test_formulas_of_the_dialect(spark):
    df = spark.createDataFrame([(7, 7.5, "a\\_b", "3.7"), (-7, -7.5, "a_b", "2.5")], "k long, x double, s string, t string")
    expected = {
        "concat('log(x) of ', s)": ["log(x) of a\\_b", "log(x) of a_b"], "size(concat(array(1), array(2)))": [2, 2], "concat(s, NULL, '!')": ["a\\_b!", "a_b!"], ".5 + k": [7.5, -6.5], "x // 2": [3, -3], "k // 2": [3, -3], "2 * k // 3": [4, -4],
        "k // 0": [None, None], "TRY_CAST(t AS INT)": [4, 2], "t::int + 1": [5, 3], "CAST(x AS BIGINT)": [8, -8], "try_cast(s AS INT)": [None, None], "s LIKE 'a\\_b'": [True, False], "s LIKE '%_b'": [True, True],
        "regexp_matches(t, '^\\d\\.\\d$')": [True, True], "log(100) + log(2, 8)": [5.0, 5.0], "\"k\" + 1": [8, -6], "'it''s // ' || t": ["it's // 3.7", "it's // 2.5"],
    }
    for text, values in expected.items():
        assert [r.v for r in steps.formula(df, "v", text).select("v").collect()] == values, text


def test_filter_effect_in_the_dialect(spark):
    from tallybook.operators import diagnostics

    df = spark.createDataFrame([(1, 0.0, 1), (2, 2.0, 1), (3, 0.0, 2)], "k long, x double, _upload_seq int")
    assert tuple(diagnostics.filter_effect(df, "k // 2 = 1 AND k / x > 0").first()) == (3, 1, False)


def test_comparisons_scan_once(spark, tmp_path):
    """Current and compared windows come from one scan, date keys moved for each."""
    days = [(datetime(2023, 3, 5), 7.0), (datetime(2024, 2, 5), 2.0), (datetime(2024, 2, 5), 3.0), (datetime(2024, 3, 5), 10.0), (datetime(2024, 3, 6), 1.0), (datetime(2022, 1, 1), 50.0)]
    spark.createDataFrame(days, "d timestamp_ntz, x double").write.parquet(str(tmp_path / "t"))
    from tallybook.operators.datasets import Compare, Table, build

    spec = Table("d", [S.Key("d", "day", "day")], [S.Aggregate("sum", "x", "x"), S.Aggregate("count", name="n")], compare=[Compare("previous_period", "prev"), Compare("same_period_last_year", "ly")])
    out = build(spark.read.parquet(str(tmp_path / "t")), spec, MARCH)
    assert [(r.day.day, r.x, r.n, r.x_prev, r.n_prev, r.x_ly, r.n_ly) for r in out.collect()] == [(5, 10.0, 1, 5.0, 2, 7.0, 1), (6, 1.0, 1, None, None, None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    whole = build(spark.read.parquet(str(tmp_path / "t")), Table("d", (), spec.aggregates, compare=spec.compare), MARCH)
    assert (whole.first().x, whole.first().n_prev, whole.first().x_ly_change) == (11.0, 2, 4.0)


def test_medians_and_ranks_over_ranges(spark):
    """Values of one group, and equal values, may lie in several ranges."""
    import statistics

    from tallybook.operators import ordered

    df = spark.range(4001).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 500).cast("double")).alias("x"), F.when(F.col("id") % 5 > 0, F.lit(2)).otherwise(F.col("id") % 4).alias("y")).repartition(6)
    rows = df.collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordered.median(df, F.col("x")).first().median == statistics.median(r.x for r in rows if r.x is not None)
        assert {r.k: r.median for r in ordered.median(df, F.col("x"), ["k"]).collect()} == {k: statistics.median(r.x for r in rows if r.x is not None and r.k == k) for k in range(3)}
        assert ordered.median(df.limit(0), F.col("x")).first().median is None
        ranked = ordered.with_rank(df, F.col("y").desc_nulls_last(), "y", "place")
        got = {(r.y, r.place) for r in ranked.collect()}
        of_twos = ordered.ranged(df.withColumn("_tie", F.rand(11)), [F.col("y").desc_nulls_last(), F.col("_tie")]).where("y = 2").select("_range").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(y, 1 + sum(r.y > y for r in rows)) for y in {r.y for r in rows}} and of_twos > 1


def test_step_counts_are_observed(spark, sales):
    from tallybook.plans import preview

    spec_of = {"source": "s", "steps": [{"type": "filter", "where": "amount > 1"}, {"type": "dedupe", "by": ["d", "region", "amount"]}, {"type": "formula", "name": "z", "text": "amount // 2"}, {"type": "sort", "by": ["-amount"]}, {"type": "filter", "where": "region IS NOT NULL"}]}
    found = preview.step_counts(spark, spec_of, {"s": sales}, {}, MARCH)
    assert found == [("source", 10), ("filter", 9), ("dedupe", 8), ("formula", 8), ("sort", 8), ("filter", 6)]
    ordered_sql = {"source": "s", "steps": [{"type": "filter", "where": "amount > 1"}, {"type": "sql", "query": "SELECT * FROM data ORDER BY amount"}, {"type": "filter", "where": "amount > 5"}]}
    assert preview.step_counts(spark, ordered_sql, {"s": sales}, {}, MARCH) == [("source", 10), ("filter", 9), ("sql", 9), ("filter", 6)]
