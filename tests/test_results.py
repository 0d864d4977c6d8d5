"""Diagnostics, previews, cached results, workbooks and YAML."""

import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallybook.functions.periods import Period
from tallybook.functions.aggregates import Aggregate, Key
from tallybook.operators import datasets, diagnostics, joins, ordered
from tallybook.plans import preview as P
from tallybook.plans import partials, profiles, results, scenario
from tallybook.sources import profile, workbook
from tallybook.sources.history import History, Upload, history_view


def test_warnings(spark):
    history = History([Upload("u1", 1, "", Period.read("2024-01"))], {"a": "int", "d": "date"}, "d")
    span = (date(2024, 1, 1), date(2024, 3, 1))
    assert diagnostics.coverage_gaps(history, [span, span]) == ["no upload covers 2024-02-01 to 2024-03-01 (exclusive)"]
    assert diagnostics.absent_columns(history, {"u1": {"d"}}, ["a", "d"], span) == ["upload u1 has no a"]
    df = spark.createDataFrame([("x", 1), ("y", 2)], "s string, _upload_seq int")
    assert tuple(diagnostics.filter_effect(df, "s = 'x'").first()) == (2, 1, False)
    assert diagnostics.cast_losses(spark.createDataFrame([("1",), ("z",), ("",)], "n string"), {"n": "int"}).first().n == 1
    assert diagnostics.empty_nodes({"a": df, "b": df.where("false")}) == ["b"]


def test_preview_scales_counts(spark, monkeypatch):
    rows = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.lit(1.0).alias("x"))
    other = spark.range(5000).select(F.col("id").alias("key"), F.lit(2.0).alias("y"))
    plan = scenario.Scenario({"a": {"source": "s", "steps": [{"type": "dedupe", "by": ["k"], "newest": ["x"]}, {"type": "join", "with": "b", "on": {"k": "key"}}]}, "b": {"source": "t"}})
    monkeypatch.setattr(P, "LARGE", 1000)
    monkeypatch.setattr(P, "TARGET", 5000)
    found, counts = P.preview(spark, plan, {"s": rows, "t": other}, "a", Period.read("2024"), 10)
    assert len(found) == 10 and all(r["y"] == 2.0 for r in found)
    assert counts[0].rows == 20000 and all(abs(c.rows - 5000) < 500 and not c.exact for c in counts[1:])
    assert P.rate(900) == 1 and P.rate(20_000) == 4 and P.rate(1_001) == 2


def test_cached_results(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    key = results.node_key({"a": 1}, "2024", {"x": "1"})
    assert key != results.node_key({"a": 1}, "2024", {"x": "2"})
    for _ in range(2):
        assert results.cached(spark, str(tmp_path), key, build).count() == 3
    assert len(calls) == 1


def test_report_files_and_yaml(spark, tmp_path):
    (tmp_path / "s.yaml").write_text("inputs:\n  a: {source: s}\nmetrics:\n  n: {source: a, aggregate: {fn: count}}\n")
    report = scenario.run(spark, results.load_scenario(str(tmp_path / "s.yaml")), {"s": spark.range(7)}, Period.read("2024"))
    results.write_report(report, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/a")).count() == 7
    assert '"n": 7' in spark.read.text(str(tmp_path / "out/_metrics")).first().value
    (tmp_path / "bad.yaml").write_text("slides: []")
    with pytest.raises(ValueError, match="slides"):
        results.load_scenario(str(tmp_path / "bad.yaml"))


SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def book(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(len(sheets))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Day</t></si><si><t>Amount</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", SHEET.format("".join(f"<row>{r}</row>" for r in rows)))


def test_workbooks(spark, tmp_path):
    head = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
    book(tmp_path / "a.xlsx", [[], ['<c r="A1" t="inlineStr"><is><t>Title</t></is></c>', head, '<c r="A3" s="1"><v>45352</v></c><c r="B3"><v>12.5</v></c>'], [head, '<c r="B2"><v>7</v></c>']])
    found = [(r.Day, r.Amount) for r in workbook.read_workbooks(spark, str(tmp_path / "a.xlsx")).orderBy("_row").collect()]
    assert found == [("2024-03-01", "12.5"), (None, "7")]
    # rows are read as they are asked for: far into the sheet there is what no parser takes
    book(tmp_path / "long.xlsx", [[head, *(f'<c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i * 2}</v></c>' for i in range(25_000)), '<c r="A1" t="s"><v>none</v></c>']])
    rows = workbook.table_rows((tmp_path / "long.xlsx").read_bytes())
    assert [next(rows) for _ in range(3)] == [["Day", "Amount"], ["0", "0"], ["1", "2"]]
    with pytest.raises(ValueError):
        list(rows)
    book(tmp_path / "parts.xlsx", [[head, *(f'<c r="A{i}"><v>{i}</v></c><c r="B{i}"><v>{i * 2}</v></c>' for i in range(25_000))]])
    parts = workbook.read_workbooks(spark, str(tmp_path / "parts.xlsx"))
    assert parts.where("cast(Amount as long) = 2 * cast(Day as long) and _row = cast(Day as long)").count() == 25_000
    with zipfile.ZipFile(tmp_path / "bomb.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", " " * 5_000_000)
    with pytest.raises(ValueError, match="unpacks"):
        list(workbook.sheet_rows((tmp_path / "bomb.xlsx").read_bytes()))


COLUMNS = {"g": "string", "x": "float", "d": "datetime"}


def stored(spark, folder, name, seq, rows, period, policy=None):
    path = f"{folder}/{name}"
    df = spark.createDataFrame(rows, "g string, x double, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    df.withColumns({"_upload_id": F.lit(name), "_upload_seq": F.lit(seq), "_row": F.monotonically_increasing_id(), "_month": F.coalesce(F.date_format("d", "yyyy-MM"), F.lit("none"))}).write.partitionBy("_month").parquet(path)
    return Upload(name, seq, path, Period.read(period), policy=policy)


ALL = [Aggregate("count", name="n"), *(Aggregate(fn, "x") for fn in ("sum", "mean", "min", "max", "first", "last", "count_distinct", "median"))]
TABLES = [
    datasets.Table("d", [Key("g")], ALL, compare=[datasets.Compare("previous_period", "p")], where="x is null or x < 90"),
    datasets.Table("d", [Key("d", "month", "m"), Key("g")], ALL, window="all", sort=["-m", "g"]),
    datasets.Table("d", [], [a for a in ALL if a.fn != "median"], window={"last_n": 2}),
    datasets.Table("d", [Key("g")], [Aggregate("sum", "x", "total")], window="all", top=1, others="rest", derive=[datasets.Derive("share", "part", "total")]),
    datasets.Table("d", [Key("g"), Key("d", "month", "m")], [Aggregate("sum", "x", "total")], window="all", pivot="m"),
    datasets.Table("d", [Key("g")], ALL, window={"range": {"start": "2030-01-01", "end": "2030-01-31"}}),
]


def two(spark, folder):
    first = [("a", 1.0, "2024-01-05"), ("a", 2.0, "2024-01-20 10:00:00"), ("b", None, "2024-01-31"), (None, 4.0, "2024-02-10"), ("a", 4.0, "2024-02-20"), ("a", 95.0, "2024-02-21"), ("c", 7.0, None)]
    later = [("a", 5.0, "2024-02-16"), ("a", 5.0, "2024-02-16"), ("b", 6.0, "2024-03-01"), ("b", 8.0, "2024-03-15 23:59:59"), (None, None, "2024-03-31")]
    return [stored(spark, folder, "u1", 1, first, "2024-01-01..2024-02-29"), stored(spark, folder, "u2", 2, later, "2024-02-15..2024-03-31")]


def plain_rows(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


@pytest.mark.parametrize(("policy", "number"), [*(("replace_period", n) for n in range(len(TABLES))), ("append", 0), ("replace_all", 0)])
def test_tables_from_stored_days(spark, tmp_path, policy, number):
    past, made, period = History(two(spark, tmp_path), COLUMNS, "d", policy), TABLES[number], Period.read("2024-03")
    assert partials.mergeable(past, [], made)
    plain = datasets.build(history_view(spark, past), made, period)
    found = partials.build(spark, f"{tmp_path}/store", past, [], lambda df: df, made, period)
    assert found.columns == plain.columns and dict(found.dtypes) == dict(plain.dtypes)
    assert sorted(plain_rows(found), key=str) == sorted(plain_rows(plain), key=str)


def test_a_new_upload_alone_is_read(spark, tmp_path):
    uploads, period = two(spark, tmp_path), Period.read("2024-03")
    spec = {"input": "i", "period_column": "d", "keys": ["g"], "aggregates": [{"fn": "sum", "column": "x", "name": "total"}]}
    plan = scenario.Scenario({"i": {"source": "s", "steps": [{"type": "filter", "where": "x < 90"}, {"type": "formula", "name": "x", "text": "x * 2"}]}}, {"t": spec, "again": {**spec, "window": "year_to_date"}})
    history = lambda n: History(uploads[:n], COLUMNS, "d")
    first = scenario.run(spark, plan, {"s": history(1)}, Period.read("2024-02"), f"{tmp_path}/store")
    assert {tuple(r) for r in first.frames["t"].collect()} == {(None, 8.0), ("a", 8.0)}
    for part in (tmp_path / "u1").rglob("*.parquet"):
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
        data = part.read_bytes()
        part.write_bytes(data[:4] + bytes(b ^ 255 for b in data[4:40]) + data[40:])  # whoever reads a row of it fails
    with pytest.raises(Exception):
        history_view(spark, history(1)).collect()
    second = scenario.run(spark, plan, {"s": history(2)}, period, f"{tmp_path}/store")
    assert {n: s.state for n, s in second.statuses.items()} == {"i": "ok", "t": "ok", "again": "ok"}
    assert {tuple(r) for r in second.frames["t"].collect()} == {("b", 28.0)}
    assert {tuple(r) for r in second.frames["again"].collect()} == {("a", 6.0 + 20.0), ("b", 28.0), (None, 8.0)}
    assert all("/store/" in f for f in second.frames["again"].inputFiles())
    assert len(list((tmp_path / "store").iterdir())) == 2  # the windows share the days of each upload


def test_what_cannot_be_merged(spark, tmp_path):
    upload, made = Upload("u1", 1, "", Period.read("2024")), TABLES[1]
    past = History([upload], COLUMNS, "d")
    assert partials.mergeable(past, [{"type": "filter", "where": "x > 1"}, {"type": "python", "enabled": False}], made)
    assert not partials.mergeable(History([upload], COLUMNS, "d", "merge_dedupe", ["g"]), [], made)
    assert not partials.mergeable(History([], COLUMNS, "d"), [], made)
    for step in ({"type": "dedupe", "by": ["g"]}, {"type": "sql", "query": "SELECT * FROM input"}, {"type": "rename", "names": {"d": "day"}}, {"type": "rename", "names": {"g": "d"}}, {"type": "cast", "types": {"d": "date"}}, {"type": "formula", "name": "d", "text": "d"}, {"type": "formula", "name": "y", "text": "rand()"}):
        assert not partials.mergeable(past, [step], made)
    assert not partials.mergeable(past, [], datasets.Table("d", [], [Aggregate("median", "x")]))
    assert not partials.mergeable(past, [], datasets.Table("other", [Key("g")], [Aggregate("sum", "x")]))


def test_unfinished_results_are_written_anew(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/k")
    (tmp_path / "k" / "_SUCCESS").unlink()
    assert results.cached(spark, str(tmp_path), "k", lambda: spark.range(2)).count() == 2


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_latest_rows_of_one_hot_key(spark, many_ranges):
    left = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") % 1000).alias("t"), F.col("id").alias("i"))
    left = left.unionByName(spark.createDataFrame([(None, 5, -1), ("hot", None, -2), ("cold", 5, -3), ("new", 1, -4)], "k string, t long, i long"))
    right = spark.createDataFrame([("hot", 100, "a"), ("hot", 100, "b"), ("hot", 700, "c"), ("cold", 5, "d"), ("cold", 6, "e"), ("new", 2, "f"), (None, 1, "n"), ("hot", None, "n")], "key string, at long, i string")
    found = {r.i: r.i_right for r in joins.as_of(left, right, {"k": "key"}, ("t", "at"), ["i"]).collect()}
    assert len(found) == 4004 and [found[-n] for n in (1, 2, 3, 4)] == [None, None, "d", None]
    assert all(found[i] == (None if i % 1000 < 100 else "b" if i % 1000 < 700 else "c") for i in range(4000))
    assert joins.as_of(left.limit(0), right, {"k": "key"}, ("t", "at"), ["i"]).count() == 0
    ranges = ordered.ranged(left, [F.col("k"), F.col("t")])
    assert ranges.where("k = 'hot'").select("_range").distinct().count() > 1


def test_latest_values_over_ranges_without_any(spark, many_ranges):
    rows = spark.range(1000).select((F.col("id") >= 900).alias("k"), F.col("id"), F.when(F.col("id").isin(3, 950), F.col("id")).alias("x"))
    found = {r.id: r.last for r in ordered.with_last(rows, ["k"], [F.col("id")], "x", "last").collect()}
    assert found == {i: None if i < 3 or 900 <= i < 950 else 3 if i < 900 else 950 for i in range(1000)}


def test_profiles_from_stored_months(spark, tmp_path, many_ranges):
    past = History(two(spark, tmp_path), COLUMNS, "d")
    found = {r["column"]: r for r in profiles.profile(spark, f"{tmp_path}/store", past).collect()}
    rows = history_view(spark, past)
    exact = {r["column"]: r for r in profile.profile(rows, ["g", "x", "d"], exact=True).collect()}
    for c, r in exact.items():
        assert {k: found[c][k] for k in r.asDict()} == r.asDict(), c
    assert [(v["item"], v["count"]) for v in found["g"]["common"]][:2] == [("a", 4), ("b", 3)]
    assert found["x"]["quarters"] == [2.0, 5.0, 6.0] and found["g"]["quarters"] is None
    empty = History([stored(spark, tmp_path, "none", 3, [("q", None, None)], "2024-05")], COLUMNS, "d")
    one = {r["column"]: r for r in profiles.profile(spark, f"{tmp_path}/store", empty).collect()}
    assert (one["x"]["nulls"], one["x"]["distinct_values"], one["x"]["quarters"], one["x"]["common"], one["d"]["least"]) == (1, 0, None, [], None)
    with pytest.raises(ValueError, match="keys"):
        profiles.profile(spark, f"{tmp_path}/store", History(past.uploads, COLUMNS, "d", "merge_dedupe", ["g"]))


def test_profiles_of_scattered_months(spark):
    """Partitions without rows, among those that are merged, do no harm."""
    rows = spark.range(3).select((F.col("id") % 2).alias("v"), F.lit("2024-01-05").cast("date").alias("d"))
    months = profiles.by_month(rows, "d", ["v"])
    (found,) = profiles.merged(months.repartition(16), ["v"]).collect()
    assert (found["rows"], found["distinct_values"], found["common"][0]["count"]) == (3, 2, 2)
    assert profiles.merged(months.limit(0), ["v"]).count() == 0


def test_profiles_read_no_rows_again(spark, tmp_path):
    whole = [stored(spark, tmp_path, "w1", 1, [("a", 1.0, "2024-01-05"), ("b", 2.0, "2024-02-05")], "2024-01-01..2024-02-29"), stored(spark, tmp_path, "w2", 2, [("c", 3.0, "2024-02-07")], "2024-02")]
    past = History(whole, COLUMNS, "d")
    for _ in range(2):
        found = profiles.profile(spark, f"{tmp_path}/store", past)
        assert {r["column"]: (r["rows"], r["greatest"]) for r in found.collect()}["g"] == (2, "c")
        assert all("/store/" in f for f in found.inputFiles())
