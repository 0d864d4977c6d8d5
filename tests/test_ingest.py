"""Delimited files, text to types, rejects, profiles and samples."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallybook.sources import delimited, ingest, parsing, profile, readers, records


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x string")


def parsed(spark, kind, values):
    return [r[0] for r in column(spark, values).select(parsing.PARSERS[kind](F.col("x"))).collect()]


def test_numbers(spark):
    texts = ["1 234,5", "1 234.5", "1,234.50", "1.234,50", "(12)", "−3", "7", "1,234,567", "abc", "", None, "1e3", "--1"]
    assert parsed(spark, "float", texts) == [1234.5, 1234.5, 1234.5, 1234.5, -12.0, -3.0, 7.0, 1234567.0, None, None, None, 1000.0, None]
    assert parsed(spark, "int", ["12", "12.0", "12.5", " 7 "]) == [12, 12, None, 7]


def test_dates_and_words(spark):
    assert parsed(spark, "date", ["2024-03-01", "01.03.2024", "01/03/2024", "31.02.2024", "x"]) == [date(2024, 3, 1)] * 3 + [None, None]
    assert parsed(spark, "datetime", ["2024-03-01 10:20", "01.03.2024 10:20:00", "2024-03-01"]) == [datetime(2024, 3, 1, 10, 20)] * 2 + [datetime(2024, 3, 1)]
    assert parsed(spark, "datetime", ["2024-03-01 10:20:30.5", "2024-03-01T10:20:30.123456", "1.3.24 9:05", "2024-03-01 25:00"]) == [datetime(2024, 3, 1, 10, 20, 30, 500000), datetime(2024, 3, 1, 10, 20, 30, 123456), datetime(2024, 3, 1, 9, 5), None]
    assert parsed(spark, "date", ["01.02.24", "01.02.69", "01.02.70", "31.02.24", "01.02.2024 00:00:00", "2024/02/01", "2024-02/01", "1.2"]) == [date(2024, 2, 1), date(2069, 2, 1), date(1970, 2, 1), None, date(2024, 2, 1), date(2024, 2, 1), None, None]
    assert parsed(spark, "bool", ["Yes", "нет", "1", "F", "maybe", "ИСТИНА", "ложь", "д", "н"]) == [True, False, True, False, None, True, False, True, False]


def test_inference(spark):
    rows = [(str(i), f"0{i}", f"{i},5", f"{i % 28 + 1:02}.03.2024", "yes" if i % 2 else "no", f"word {i}", "" if i % 2 else "5") for i in range(100)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    assert parsing.infer(df) == {"a": "int", "b": "string", "c": "float", "d": "date", "e": "bool", "f": "string", "g": "int"}
    assert parsing.infer(column(spark, ["0", "1"] * 98 + ["2", "30", "4", "17"])) == {"x": "int"} and parsing.infer(column(spark, ["0", "1"] * 20)) == {"x": "int"}
    assert parsing.infer(column(spark, ["yes", "no"] * 99 + ["1"])) == {"x": "string"}
    assert parsing.infer(column(spark, ["01.02.24"])) == {"x": "date"} and parsing.infer(column(spark, ["2024-01-02 00:00:00", "2024-01-03"])) == {"x": "date"}
    assert parsing.infer(column(spark, ["2024-01-02 10:00:00.5", "2024-01-03"])) == {"x": "datetime"} and parsing.infer(column(spark, ["", None])) == {"x": "string"}
    assert parsing.infer(column(spark, ["1234567890", "9234567891"])) == {"x": "string"} and parsing.infer(column(spark, ["1234567890", "92"])) == {"x": "int"}
    some_bad = column(spark, ["1.5"] * 97 + ["x"] * 3)
    assert parsing.infer(some_bad) == {"x": "string"}


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('Report\n\nDay;Region;Amount;\n01.03.2024;"North; east";1 000,5;\n;;;\n02.03.2024;"two\nlines";7;\n', "cp1251")
    layout = delimited.sniff(spark, str(path))
    assert (layout.delimiter, list(layout.names)) == (";", ["Day", "Region", "Amount"])
    df = delimited.read_text(spark, str(path), layout)
    assert [(r.Region, r.Amount) for r in df.orderBy("_row").collect()] == [("North; east", "1 000,5"), ("two\nlines", "7")]


def read_whole(spark, path, layout):
    """The same file by Spark's reader of whole files, in one task."""
    names = ", ".join(f"`{n}` string" for n in layout.names)
    rows = spark.read.csv(path, schema=names, sep=layout.delimiter, quote='"', escape='"', multiLine=True, header=False).collect()
    return [tuple(r) for r in rows][layout.skipped + 1 :]


@pytest.mark.parametrize("seed,split", [(1, 64), (2, 200), (3, 997), (4, 1 << 20)])
def test_quoted_line_ends_in_splits(spark, tmp_path, seed, split):
    """Records that end in their split, in the next and many splits later; rows and places are those of a reader of whole files."""
    draw = random.Random(seed)

    def cell():
        text = "".join(draw.choices('ab ;"\n', weights=(30, 30, 10, 3, 3, 6), k=draw.randrange(12)))
        long = "x\n" * draw.choice((0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 200))
        return '"' + (text + long).replace('"', '""') + '"' if draw.random() < 0.4 else "".join(draw.choices("abc", k=4))

    lines = ["n;a;b"] + [f"{i};{cell()};{cell()}" + "\n" * draw.choice((0, 0, 0, 2)) for i in range(400)]
    path = written(tmp_path, "quoted.csv", ("\n".join(lines) + "\n").encode())
    layout = delimited.sniff(spark, path)
    assert layout.quoted_lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = delimited.read_text(spark, path, layout)
        rows = found.orderBy("_row").collect()
        assert split > 1000 or records.lines_of(spark, path).select("_block").distinct().count() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.n, r.a, r.b) for r in rows] == read_whole(spark, path, layout) and [r._row for r in rows] == [*range(400)]


def test_carriage_returns_and_utf16(spark, tmp_path):
    path = written(tmp_path, "crlf.csv", "имя;текст\r\nа;\"раз\r\nдва\"\r\nб;три\r\n".encode("cp1251"))
    rows = delimited.read_text(spark, path).orderBy("_row").collect()
    assert [(r["имя"], r["текст"]) for r in rows] == [("а", "раз\r\nдва"), ("б", "три")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
    with pytest.raises(ValueError, match="UTF-16"):
        delimited.sniff(spark, written(tmp_path, "wide.csv", "a;b\n1;2\n".encode("utf-16")))


def test_a_column_named_month_stays(spark, tmp_path):
    from tallybook.sources import history

    text = spark.createDataFrame([("2026-01-05", "March plan"), ("2026-02-05", "x")], "Day string, month string")
    found = ingest.write_upload(text, {"Day": "date", "month": "string"}, str(tmp_path / "u"), "u1", 1, "Day")
    kept = history.History([history.Upload("u1", 1, f"{found.path}/data", None)], {"Day": "date", "month": "string"}, "Day")
    view = history.history_view(spark, kept, (date(2026, 1, 1), date(2026, 2, 1)))
    assert [(r.Day, r.month) for r in view.collect()] == [(date(2026, 1, 5), "March plan")]
    assert "PartitionFilters: [isnotnull(_month" in view._jdf.queryExecution().executedPlan().toString()


def test_wide_text_is_typed_by_cells(spark):
    """300 columns of all kinds; no stage's code is too long to compile."""
    kinds = {"int": "7", "float": "1 234,5", "date": "01.02.2024", "datetime": "2024-01-02 10:20", "bool": "yes", "string": "word"}
    names = {f"{k}_{i}": (k, v) for i in range(50) for k, v in kinds.items()}
    df = spark.createDataFrame([tuple(v for _, v in names.values())] * 20, ", ".join(f"{n} string" for n in names))
    assert parsing.infer(df) == {n: k for n, (k, _) in names.items()}
    counted = parsing.cell_counts(df)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" in plan and counted.count() == 300


def test_ragged_rows(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("a,b\n1,2\n3,4,5\n")
    layout = delimited.sniff(spark, str(path))
    assert delimited.read_text(spark, str(path), layout, ragged="truncate").count() == 2
    with pytest.raises(Exception, match="more cells"):
        delimited.read_text(spark, str(path), layout).collect()


def written(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content)
    return str(path)


def test_encodings_of_whole_files(spark, tmp_path):
    """Letters that come late count; lines of two encodings and open quotes are errors with the line."""
    head = "name;amount\n" + "plain text;1\n" * 40_000
    late = delimited.read_text(spark, written(tmp_path, "late.csv", head.encode() + "имя;2\n".encode("cp1251")))
    assert late.orderBy(F.desc("_row")).first().name == "имя" and late.count() == 40_001
    assert delimited.sniff(spark, written(tmp_path, "utf.csv", b"\xef\xbb\xbf" + "имя;дата\nа;б\n".encode())).names == ["имя", "дата"]
    with pytest.raises(ValueError, match="line 40003 is not UTF-8"):
        delimited.sniff(spark, written(tmp_path, "mixed.csv", head.encode() + "имя;1\n".encode() + "имя;2\n".encode("cp1251")))
    with pytest.raises(ValueError, match="line 3 "):
        delimited.sniff(spark, written(tmp_path, "open.csv", b'a;b\n1;2\n3;"open\n5;6\n'))


def test_folders_and_parts(spark, tmp_path):
    """Each file has its own header and layout; rows are numbered on from file to file, over splits too."""
    folder = tmp_path / "folder"
    folder.mkdir()
    written(folder, "1.csv", b"name;amount\n" + b"".join(b"a%d;%d\n" % (i, i) for i in range(3000)))
    written(folder, "2.csv", "Report\nname,amount\n".encode() + b"b0,7\nb1,8\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = delimited.read_folder(spark, str(folder)).orderBy("_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r._row for r in rows] == [*range(3002)] and [r.name for r in rows] == [f"a{i}" for i in range(3000)] + ["b0", "b1"]
    parts = delimited.read_parts(spark, [(str(folder / "2.csv"), {"amount": "sum"}), (str(folder / "1.csv"), {})])
    first = parts.orderBy("_row").first()
    assert (first.name, first.sum, first.amount, parts.count()) == ("b0", "7", None, 3002)


@pytest.mark.parametrize("first", [b"Report\nn;a\n0;x\n", b"Report\nn;a\n0;x\n" + b"\n" * 100])
def test_a_file_in_pieces(spark, tmp_path, first):
    """The header stands in the first piece, which may be the smallest; rows go on from piece to piece."""
    folder = tmp_path / "pieces"
    folder.mkdir()
    written(folder, "part-0", first)
    written(folder, "part-1", b"".join(b'%d;"a\nb"\n' % i for i in range(1, 2000)))
    written(folder, "part-2", b"2000;y\n")
    layout = delimited.sniff(spark, str(folder))
    assert (layout.delimiter, list(layout.names), layout.skipped, layout.quoted_lines) == (";", ["n", "a"], 1, True)
    rows = delimited.read_text(spark, str(folder), layout).orderBy("_row").collect()
    assert [r.n for r in rows] == [str(i) for i in range(2001)] and [r._row for r in rows] == [*range(2001)]
    assert (rows[0].a, rows[1].a, rows[2000].a) == ("x", "a\nb", "y")
    written(folder, "part-3", b'1;"open\n')
    written(folder, "part-4", b'2;"open\n')
    with pytest.raises(ValueError, match="do not balance"):
        delimited.sniff(spark, str(folder))


def test_files_of_queries_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """No task sorts or writes much more than a piece, and the pieces are in order."""
    from tallybook.plans import catalog_sources

    monkeypatch.setattr(catalog_sources, "PIECE_LINES", 500, raising=False)
    rows = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("place")).select("place", F.concat(F.lit("r;"), F.col("place").cast("string")).alias("value"))
    path = catalog_sources.written(spark, rows, "Title", "k;n")
    lines = [spark.read.text(f).collect() for f in delimited.files_of(spark, path)]
    assert len(lines) > 10 and max(map(len, lines)) < 2000
    assert [r.value for piece in lines for r in piece] == ["Title", "k;n", *(f"r;{i}" for i in range(10_000))]


def rows_in_pieces(spark, tmp_path, monkeypatch, name):
    """A query's rows over the smallest tables with pieces of 100 lines, the orders, and how many pieces it wrote."""
    from tallybook.plans import catalog, catalog_sources

    monkeypatch.setattr(catalog_sources, "PIECE_LINES", 100, raising=False)
    monkeypatch.setattr(catalog_sources, "scratch", lambda spark: str(tmp_path / "file"))
    data = "/root/testdata/sf0.001"
    rows = catalog.queries()[name](spark, data).collect()
    return rows, catalog.orders(spark, data).collect(), len(delimited.files_of(spark, str(tmp_path / "file")))


def test_windows_1251_in_pieces(spark, tmp_path, monkeypatch):
    rows, orders, pieces = rows_in_pieces(spark, tmp_path, monkeypatch, "ingest_windows_1251")
    assert sorted((r.k, r.note) for r in rows) == sorted((o.o_orderkey, f"заказ {o.o_orderpriority}") for o in orders) and pieces > 5


def test_quoted_line_ends_in_pieces(spark, tmp_path, monkeypatch):
    rows, orders, pieces = rows_in_pieces(spark, tmp_path, monkeypatch, "ingest_quoted")
    want = sorted((o.o_orderkey, o.o_totalprice, f'{o.o_orderstatus}\n"{o.o_orderpriority}') for o in orders)
    assert [(r.k, r.note) for r in sorted(rows, key=lambda r: r._row)] == [(k, note) for k, _, note in want] and pieces > 5
    assert sorted(r._row for r in rows) == [*range(len(orders))]


def test_reader_choice_and_inspection(spark, tmp_path):
    path = written(tmp_path, "data", "Code;Day;Sum\n7;01.03.2024;1,5\n8;02.03.2024;2,5\n".encode())
    found = readers.inspect(spark, path)
    assert (found.reader, found.types) == ("delimited", {"Code": "string", "Day": "date", "Sum": "float"})
    assert [r["Code"] for r in found.head] == ["7", "8"] and {r["column"]: r["distinct_values"] for r in found.profile}["Sum"] == 2
    assert readers.reader_of(spark, "x.xlsx") == "workbook" and readers.reader_of(spark, "x", "delimited") == "delimited"
    assert readers.reader_of(spark, written(tmp_path, "book", b"PK\x03\x04rest")) == "workbook"
    with pytest.raises(ValueError, match="no reader"):
        readers.reader_of(spark, path, "cards")


def test_names():
    assert delimited.unique_names(["a", "", "a", "a"]) == ["a", "column 2", "a (2)", "a (3)"]


def test_upload(spark, tmp_path):
    text = spark.createDataFrame([("2024-01-05", "1"), ("2024-02-05", "x"), (None, "3")], "d string, n string")
    found = ingest.write_upload(text, {"d": "date", "n": "int"}, str(tmp_path / "u"), "u1", 1, "d", required=["n"])
    assert (found.rows, found.rejected, found.errors, found.verdict) == (3, 1, {"n": 1}, "needs_review")
    assert found.path.endswith(".held") and not (tmp_path / "u").exists() and not list(tmp_path.glob("*.partial-*"))
    assert ingest.accept(spark, found).path == str(tmp_path / "u")
    with pytest.raises(FileExistsError):
        ingest.write_upload(text, {"d": "date", "n": "int"}, str(tmp_path / "u"), "u1", 1, "d")
    data = spark.read.parquet(str(tmp_path / "u/data"))
    assert sorted(r._month for r in data.collect()) == ["2024-01", "2024-02", "none"]
    assert [r.n for r in spark.read.parquet(str(tmp_path / "u/rejects")).collect()] == ["x"]


def test_reconcile():
    found = ingest.reconcile(["Order No.", "Amont", "Other"], {"order_no": [], "amount": [], "region": ["area"]})
    assert found == {"order_no": "Order No.", "amount": "Amont", "region": None}


def test_columns_of_other_months_and_kinds():
    found = ingest.matched([ingest.Column("Plan April 2026"), ingest.Column("Summe", kind="float", values=["1", "2"]), ingest.Column("x")], [ingest.Column("plan march 2025"), ingest.Column("total", ["sum"], "float", ["2", "3"])], 0.6)
    assert found == {"plan march 2025": "Plan April 2026", "total": "Summe"}
    made = ingest.draft({"Order No.": "string", "2nd": "int", "Created": "date", "Report date": "date", "order no": "int"})
    assert list(made.columns.values()) == ["order_no", "c_2nd", "created", "report_date", "order_no_2"] and made.period_column == "report_date"
    assert ingest.draft({"a": "int"}).period_column is None


def test_approximate_profiles_are_near(spark):
    """Of 48 columns with different values each, none is counted more than 3 % wrong; nulls, zeros of both signs and no rows."""
    columns = [f"c{i}" for i in range(48)]
    df = spark.range(20_000).select(*(F.xxhash64("id", F.lit(i)).alias(c) for i, c in enumerate(columns)))
    off = {r.column: abs(r.distinct_values / 20_000 - 1) for r in profile.profile(df, columns, exact=False).collect()}
    assert len(off) == 48 and max(off.values()) <= 0.03
    odd = spark.createDataFrame([(0.0, None), (-0.0, None), (None, None), (float("nan"), None)], "x double, n date")
    assert [(r.distinct_values, r.nulls) for r in profile.profile(odd, ["x", "n"], exact=False).collect()] == [(2, 1), (0, 4)]
    assert [r.distinct_values for r in profile.profile(odd.limit(0), ["x", "n"], exact=False).collect()] == [0, 0]


def test_profile_and_samples(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "n long, s string")
    rows = {r.column: r for r in profile.profile(df, ["n", "s"]).collect()}
    assert (rows["n"].distinct_values, rows["s"].nulls, rows["s"].greatest) == (2, 1, "b")
    left = spark.range(1000).select((F.col("id") % 50).alias("k"))
    for k in (2, 5, 9):
        kept = {r.k for r in profile.sampled(left, ["k"], k).collect()}
        other = {r.k for r in profile.sampled(left.select(F.col("k"), F.lit(1).alias("z")), ["k"], k).collect()}
        assert kept == other and 0 < len(kept) < 50
    newest = spark.createDataFrame([("a", 1), ("a", 2), ("z", 2)], "s string, _upload_seq int")
    assert [r.s for r in profile.newest_only_values(newest, "s").collect()] == ["z"]
