"""More registered queries: files written from the given tables and ingested, histories of written uploads, scenarios."""

from __future__ import annotations

from datetime import date
from math import ceil
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.aggregates import Aggregate, Key
from tallybook.functions.periods import Period
from tallybook.operators import datasets, diagnostics, formats, joins, ordered, shaping, steps
from tallybook.operators.datasets import Derive, Table
from tallybook.plans import preview, profiles, results, scenario
from tallybook.plans.catalog import MARCH, _formula, _rounded, _sql, lines, orders, query, table
from tallybook.sources import delimited, history, ingest, parsing, profile, readers


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    ordered.checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4().hex}"


# --- files ---------------------------------------------------------------------------------------------------------

#: Lines of a piece of a file, about: what one task sorts and writes of it.
PIECE_LINES = 1_000_000


def in_pieces(rows: DataFrame, *order: str) -> DataFrame:
    """rows in an order, over as many partitions as their number needs: each is written as a piece of a file, and the
    pieces' names are in the order too."""
    return rows.repartitionByRange(max(1, ceil(rows.count() / PIECE_LINES)), *order).sortWithinPartitions(*order)


def export(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an export has them: decimal commas, dotted dates, quoted text with the delimiter inside."""
    price = F.translate(F.format_string("%.2f", "o_totalprice"), ".", ",")
    note = F.concat(F.col("o_orderstatus"), F.lit('; "'), F.col("o_orderpriority"), F.lit('"'))
    return orders(spark, d).select(F.col("o_orderkey").cast("string").alias("Order"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("Day"), price.alias("Price"), note.alias("Note"))


def exported(spark: SparkSession, d: str) -> str:
    """The export as a folder of three files, each below its header."""
    path = scratch(spark)
    export(spark, d).repartition(3, "Order").write.csv(path, sep=";", header=True, quote='"', escape='"', encoding="UTF-8")
    return path


TYPES = {"Order": "int", "Day": "date", "Price": "float", "Note": "string"}
INGESTED = "SELECT o_orderkey AS \"Order\", CAST(o_orderdate AS DATE) AS \"Day\", round(o_totalprice, 2) AS \"Price\", o_orderstatus || '; \"' || o_orderpriority || '\"' AS \"Note\" FROM orders"


@query(INGESTED)
def ingest_delimited(spark, d):
    """A folder of delimited files to a typed upload, and the upload read as a history."""
    path = scratch(spark)
    found = ingest.write_upload(delimited.read_folder(spark, exported(spark, d)), TYPES, path, "u1", 1, "Day")
    made = history.History([history.Upload("u1", 1, f"{found.path}/data", Period.read("1990-01-01..2010-12-31"))], TYPES, "Day")
    return history.history_view(spark, made).select(*TYPES)


@query("SELECT count(*) AS n, count(*) AS places, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most FROM orders")
def ingest_row_numbers(spark, d):
    """Places in several files go on from file to file without a gap."""
    return delimited.read_folder(spark, exported(spark, d)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_row").alias("places"), F.min("_row").alias("least"), F.max("_row").alias("most"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS \"Order\", 'n/a' AS \"Price\" FROM orders WHERE o_orderpriority = '5-LOW'")
def ingest_rejects(spark, d):
    """The original text of rows with a cell that no parser reads; the upload waits for a review."""
    low = F.col("o_orderpriority") == "5-LOW"
    text = orders(spark, d).select(F.col("o_orderkey").cast("string").alias("Order"), F.when(low, "n/a").otherwise(F.format_string("%.2f", "o_totalprice")).alias("Price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Day"))
    found = ingest.write_upload(text, {"Order": "int", "Price": "float", "Day": "date"}, scratch(spark), "u1", 1, "Day", required=["Price"])
    return spark.read.parquet(f"{found.path}/rejects").select("Order", "Price")


@query("SELECT o_orderkey, DATE '1998-03-01' AS day FROM orders")
def ingest_snapshot(spark, d):
    """A snapshot without dates: the period column takes a fixed day, and all rows lie in its month."""
    text = orders(spark, d).select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.lit(None).cast("string").alias("day"))
    found = ingest.write_upload(text, {"o_orderkey": "int", "day": "date"}, scratch(spark), "u1", 1, "day", fixed_period="1998-03-01")
    return spark.read.parquet(f"{found.path}/data").where("_month = '1998-03'").select("o_orderkey", "day")


@query("""SELECT 'Order' AS "column", CASE WHEN bool_and(length(CAST(o_orderkey AS VARCHAR)) >= 10) THEN 'string' ELSE 'int' END AS kind FROM orders UNION ALL
SELECT 'Day', CASE WHEN count(o_orderdate) >= 0.98 * count(*) THEN 'date' ELSE 'string' END FROM orders UNION ALL
SELECT 'Price', CASE WHEN count(*) FILTER (o_totalprice <> round(o_totalprice, 0)) > 0.02 * count(*) THEN 'float' ELSE 'int' END FROM orders UNION ALL
SELECT 'Note', CASE WHEN count(*) FILTER (regexp_full_match(o_orderstatus, '[0-9]+')) > 0 THEN 'int' ELSE 'string' END FROM orders""")
def ingest_inspect(spark, d):
    """The types that a file's columns are taken for, from all of its rows."""
    path = scratch(spark)
    export(spark, d).coalesce(1).write.csv(path, sep=";", header=True, quote='"', escape='"')
    found = readers.inspect(spark, delimited.files_of(spark, path)[0], "delimited", rows=5)
    return spark.createDataFrame(list(found.types.items()), "column string, kind string")


@query("SELECT CAST(o_orderkey AS DOUBLE) AS x, o_orderkey AS n FROM orders")
def parse_whole_numbers(spark, d):
    """Whole numbers with spaces between thousands, as such and as fractions."""
    text = orders(spark, d).select(F.translate(F.format_number("o_orderkey", 0), ",", " ").alias("x"), F.col("o_orderkey").cast("string").alias("n"))
    return parsing.typed(text, {"x": "float", "n": "int"}).select("x", "n")


# --- histories of written uploads ----------------------------------------------------------------------------------

COLUMNS = {"o_orderkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "datetime"}


def stored_uploads(spark: SparkSession, d: str) -> list[history.Upload]:
    """The first half of 1997, and finished orders of it anew, two months later, whose keys take the place of the old ones."""
    half = Period.read("1997-01-01..1997-06-30")
    rows = orders(spark, d).select(*COLUMNS).where((F.col("o_orderdate") >= F.lit(half.start)) & (F.col("o_orderdate") < F.lit(half.stop)))
    later = rows.where("o_orderstatus = 'F'").withColumn("o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 2 MONTH")).cast("timestamp_ntz"))
    out = []
    for seq, (part, period, policy) in enumerate(((rows, half, None), (later, Period.read("1997-03-01..1997-08-31"), "merge_dedupe")), 1):
        path = scratch(spark)
        part.withColumns({"_upload_id": F.lit(f"u{seq}"), "_upload_seq": F.lit(seq), "_row": F.col("o_orderkey"), "_month": history.month_of("o_orderdate")}).write.partitionBy("_month").parquet(path)
        out.append(history.Upload(f"u{seq}", seq, path, period, policy=policy))
    return out


MOVED = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'),
u AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o WHERE o_orderstatus = 'F') UNION ALL SELECT * REPLACE (o_orderdate + INTERVAL 2 MONTH AS o_orderdate) FROM o WHERE o_orderstatus = 'F') SELECT * FROM u"""


@query(MOVED + " WHERE o_orderdate >= DATE '1997-02-01' AND o_orderdate < DATE '1997-04-01'")
def history_bounds_ask(spark, d):
    """Bounds do not bring back rows whose keys a later upload has moved out of them."""
    made = history.History(stored_uploads(spark, d), COLUMNS, "o_orderdate", "ask", ["o_orderkey"])
    return history.history_view(spark, made, (date(1997, 2, 1), date(1997, 4, 1))).select(*COLUMNS)


@query(MOVED)
def history_export(spark, d):
    """The whole effective history as one Parquet file, read again."""
    made, path = history.History(stored_uploads(spark, d), COLUMNS, "o_orderdate", "ask", ["o_orderkey"]), scratch(spark)
    results.export_one_file(history.history_view(spark, made).select(*COLUMNS), path)
    return spark.read.parquet(path)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderstatus AS s, CAST(NULL AS VARCHAR) AS later FROM orders")
def history_shape(spark, d):
    """Columns of other types are cast to the source's, and one that came later is null."""
    return history.shaped(orders(spark, d).select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s")), {"k": "float", "s": "string", "later": "string"})


@query("""WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS start, max(CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 60 AS INTEGER)) AS stop FROM orders GROUP BY ALL),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY o_custkey ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY start) AS island FROM m) SELECT o_custkey, min(start) AS start, max(stop) AS stop FROM i GROUP BY o_custkey, island""")
def history_coverage_by_customer(spark, d):
    """Merged spans of all orders of each customer, each of 30 to 89 days."""
    day = F.col("o_orderdate").cast("date")
    spans = orders(spark, d).select("o_custkey", day.alias("start"), F.date_add(day, (F.lit(30) + F.col("o_orderkey") % 60).cast("int")).alias("stop"))
    return history.covered_days(spans, "start", "stop", ["o_custkey"])


@query("SELECT strftime(date_trunc('month', min(o_orderdate)), '%Y-%m-%d') || '..' || strftime(last_day(max(o_orderdate)), '%Y-%m-%d') AS period FROM orders")
def history_period_of_data(spark, d):
    """The data's first to last day, widened to whole months."""
    return spark.createDataFrame([(history.upload_period(orders(spark, d), "o_orderdate", "month").code,)], "period string")


# --- tables, scenarios ---------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, round(sum(o_totalprice) OVER (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running, rank() OVER (ORDER BY o_custkey DESC) AS place FROM orders WHERE o_orderdate < DATE '1998-04-01'")
def dataset_rows(spark, d):
    """A table of rows instead of groups, with a running sum and a rank over all of them."""
    spec = Table("o_orderdate", columns=["o_orderkey", "o_totalprice", "o_custkey"], window="all", sort=["-o_totalprice", "o_orderkey"], derive=[Derive("cumsum", "running", "o_totalprice"), Derive("rank", "place", "o_custkey")])
    return datasets.build(orders(spark, d), spec, MARCH).select("o_orderkey", "o_totalprice", F.round("running", 2).alias("running"), "place")


@query("SELECT nullif(o_orderstatus, 'F') AS status, count(*) AS n FROM orders GROUP BY 1")
def group_of_nulls(spark, d):
    """Nulls of a key are a group."""
    rows = orders(spark, d).withColumn("status", F.nullif("o_orderstatus", F.lit("F")))
    return datasets.build(rows, Table("o_orderdate", [Key("status")], [Aggregate("count", name="n")], window={"range": {"start": "1900-01-01", "end": "2100-01-01"}}), MARCH)


def doubled(df: DataFrame) -> DataFrame:
    """A Python step that maps the DataFrame."""
    return df.withColumn("doubled", F.col("o_totalprice") * 2)


def by_status(df: DataFrame, context: steps.Context) -> DataFrame:
    """A Python table that knows the report's period."""
    return df.groupBy("o_orderstatus").agg(F.sum("doubled").alias("total")).withColumn("period", F.lit(context.period.code))


def statuses(context: steps.Context) -> int:
    """A Python metric over an input."""
    return context.inputs["orders"].select("o_orderstatus").distinct().count()


def summed(frame):
    """A Python step over a whole table as pandas."""
    return frame.groupby("o_orderstatus", as_index=False)["o_totalprice"].sum()


ME = "tallybook.plans.catalog_sources"


def report(spark: SparkSession, d: str) -> scenario.Report:
    made = scenario.Scenario(
        inputs={"orders": {"source": "orders", "steps": [{"type": "python", "function": f"{ME}:doubled"}, {"type": "filter", "where": "false", "enabled": False}]}, "customer": {"source": "customer"}},
        tables={
            "by_status": {"input": "orders", "python": f"{ME}:by_status", "schema": "o_orderstatus string, total double, period string"},
            "best": {"query": "SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"},
        },
        metrics={
            "statuses": {"python": f"{ME}:statuses"},
            "largest": {"query": "SELECT max(o_totalprice) FROM orders"},
            "march": {"source": "orders", "period_column": "o_orderdate", "aggregate": {"fn": "count"}},
            "twice": {"formula": "march * 2"},
        },
    )
    return scenario.run(spark, made, {"orders": orders(spark, d), "customer": table(spark, d, "customer")}, MARCH)


@query("SELECT o_orderstatus, round(sum(o_totalprice) * 2, 2) AS total, '1998-03' AS period FROM orders GROUP BY 1")
def scenario_python_table(spark, d):
    """A table that a Python function makes, after a Python step and a step that is switched off."""
    return _rounded(report(spark, d).frames["by_status"], 2)


@query("SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def scenario_sql_table(spark, d):
    return report(spark, d).frames["best"]


@query("SELECT CAST(count(DISTINCT o_orderstatus) AS DOUBLE) AS statuses, max(o_totalprice) AS largest, CAST(count(*) FILTER (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01') AS DOUBLE) AS march, CAST(2 * count(*) FILTER (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01') AS DOUBLE) AS twice FROM orders")
def scenario_metrics(spark, d):
    """Metrics by a Python function, by a query, by an aggregate and by a formula over another."""
    values = report(spark, d).values
    return spark.createDataFrame([tuple(float(values[k]) for k in ("statuses", "largest", "march", "twice"))], "statuses double, largest double, march double, twice double")


@query("""WITH v AS (SELECT sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01') AS now, sum(o_totalprice) FILTER (o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-04-01') AS then FROM orders)
SELECT round(now, 2) AS revenue, round("then", 2) AS revenue_ly, round(now - "then", 2) AS revenue_ly_change, round(now / "then" - 1, 6) AS revenue_ly_change_pct FROM v""".replace(" AS then ", ' AS "then" '))
def metric_compare(spark, d):
    """A metric beside that of the same month a year before."""
    from tallybook.operators.metrics import Metric, Metrics

    rows = orders(spark, d)
    found = Metrics(spark, {"revenue": Metric(Aggregate("sum", "o_totalprice"), "orders", "o_orderdate")}, lambda _: rows, dict).compared("revenue", MARCH, "same_period_last_year", "ly")
    row = spark.createDataFrame([tuple(map(float, found.values()))], ", ".join(f"{k} double" for k in found))
    return row.select(*(F.round(k, 6 if k.endswith("pct") else 2).alias(k) for k in found))


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1")
def python_table(spark, d):
    """A month's rows as one pandas table."""
    march = steps.time_filter(orders(spark, d), "o_orderdate", start="1998-03-01", end="1998-03-31").select("o_orderstatus", "o_totalprice")
    return _rounded(steps.python(march, summed, "table", "o_orderstatus string, o_totalprice double"), 2)


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def python_lazy(spark, d):
    return steps.python(orders(spark, d), f"{ME}:doubled").select("o_orderkey", "doubled")


@query("""SELECT 'source' AS step, count(*) AS n FROM orders UNION ALL SELECT 'filter', count(*) FROM orders WHERE o_totalprice > 100000 UNION ALL
SELECT 'dedupe', count(DISTINCT o_custkey) FROM orders WHERE o_totalprice > 100000""")
def step_statistics(spark, d):
    """Rows after each step of an input."""
    steps_of = [{"type": "filter", "where": "o_totalprice > 100000"}, {"type": "dedupe", "by": ["o_custkey"], "newest": ["o_orderdate", "o_orderkey"]}]
    made = scenario.Scenario({"orders": {"source": "orders", "steps": steps_of}})
    counts = preview.preview(spark, made, {"orders": orders(spark, d)}, "orders", MARCH, 1, large=1 << 62)[1]
    return spark.createDataFrame([(c.step, c.rows) for c in counts], "step string, n long")


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS m FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01'),
w AS (SELECT unnest(generate_series(TIMESTAMP '1997-01-01', TIMESTAMP '1997-06-01', INTERVAL 1 MONTH)) AS m)
SELECT 'no upload covers ' || strftime(min(m), '%Y-%m-%d') || ' to 1997-07-01 (exclusive)' AS warning FROM w WHERE m NOT IN (SELECT m FROM m)""")
def diagnose_gaps(spark, d):
    """The part of a half year that uploads of the months with orders of the first quarter do not cover."""
    months = [r[0] for r in orders(spark, d).where("o_orderdate >= '1997-01-01' AND o_orderdate < '1997-04-01'").select(history.month_of("o_orderdate")).distinct().collect()]
    made = history.History([history.Upload(m, i, "", Period.read(m)) for i, m in enumerate(sorted(months))], COLUMNS, "o_orderdate")
    return spark.createDataFrame([(w,) for w in diagnostics.coverage_gaps(made, [(date(1997, 1, 1), date(1997, 7, 1))])], "warning string")


# --- joins, SQL, formulas, shaping ---------------------------------------------------------------------------------


@query("SELECT e.event_id, p.event_id AS purchase FROM events e JOIN events p ON e.user_id = p.user_id AND p.event_type = 'purchase' AND e.ts >= p.ts AND e.ts < p.ts + INTERVAL 2 HOUR")
def join_interval(spark, d):
    """Events within two hours of a purchase of the same user, each with the purchase."""
    microseconds = F.unix_micros(F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    events = table(spark, d, "events").withColumn("at", microseconds)
    bought = events.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("purchase"), F.col("at").alias("since"))
    return joins.interval_join(events, bought, {"user_id": "buyer"}, F.col("at"), F.col("since"), F.col("since") + 7_200_000_000, 7_200_000_000, ["purchase"]).select("event_id", "purchase")


@query("SELECT o_orderkey, p AS last_total FROM (SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END ROWS UNBOUNDED PRECEDING) AS p, o_orderstatus FROM orders) WHERE o_orderstatus <> 'F'")
def join_as_of_operator(spark, d):
    """Unfinished orders with the total of the customer's latest finished one of the same day or before."""
    rows = orders(spark, d)
    finished = rows.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("buyer"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("last_total"))
    return joins.as_of(rows.where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_orderdate"), finished, {"o_custkey": "buyer"}, ("o_orderdate", "at"), ["last_total"]).select("o_orderkey", "last_total")


_sql("lateral", "SELECT n_name, m.most, m.n FROM nation, LATERAL (SELECT max(c_acctbal) AS most, count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) m")
_sql("offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
_sql("theta", "SELECT a.n_name, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY a.n_name")
_sql("boolean", "SELECT o_orderkey, (o_totalprice > 100000) IS TRUE AS a, (nullif(o_orderstatus, 'F') = 'O') IS NOT TRUE AS b, (nullif(o_orderstatus, 'F') = 'O') IS FALSE AS c FROM orders")
_sql("json", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_sql("arrays", "SELECT o_custkey, array_join(sort_array(collect_set(o_orderstatus)), ',') AS statuses, size(collect_list(o_orderkey)) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses, CAST(len(list(o_orderkey)) AS INTEGER) AS n FROM orders GROUP BY o_custkey")
_sql("own_with", "WITH nation AS (SELECT c_nationkey AS k FROM customer) SELECT k, count(*) AS n FROM nation GROUP BY k")

_formula("log_ten", "round(log(o_totalprice) + log(2, o_totalprice), 9)", "round(log10(o_totalprice) + log2(o_totalprice), 9)")
_formula("concat_nulls", "concat(o_orderstatus, nullif(o_orderpriority, '5-LOW'), '!')", "concat(o_orderstatus, nullif(o_orderpriority, '5-LOW'), '!')")
_formula("date_diff", "date_diff('month', TIMESTAMP_NTZ '1995-01-31 00:00:00', o_orderdate) * 100 + date_diff('year', TIMESTAMP_NTZ '1995-12-31 00:00:00', o_orderdate)", "date_diff('month', TIMESTAMP '1995-01-31', o_orderdate) * 100 + date_diff('year', TIMESTAMP '1995-12-31', o_orderdate)")
_formula("percent_codes", "strftime(o_orderdate, '%d.%m.%Y %H:%M') || strftime(strptime('03/02/1998', '%d/%m/%Y'), '%Y-%m-%d')", "strftime(o_orderdate, '%d.%m.%Y %H:%M') || strftime(strptime('03/02/1998', '%d/%m/%Y'), '%Y-%m-%d')")
_formula("regexp_dialect", "regexp_matches(o_orderpriority, 'G') AND NOT regexp_full_match(o_orderpriority, '[1-9]-U.*')", "regexp_matches(o_orderpriority, 'G') AND NOT regexp_full_match(o_orderpriority, '[1-9]-U.*')")
_formula("weekday_dialect", "dayofweek(o_orderdate) * 10 + isodow(o_orderdate)", "CAST(dayofweek(o_orderdate) * 10 + isodow(o_orderdate) AS BIGINT)")


@query("SELECT o_orderkey, replace(format('{:,.2f}', o_totalprice), ',', ' ') AS amount, CAST(CAST(round(o_totalprice % 1000 / 10, 0) AS INTEGER) AS VARCHAR) || ' %' AS share, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def format_values(spark, d):
    """Numbers, shares and dates as text."""
    rounded = F.round(F.col("o_totalprice") % 1000 / 10, 0)
    return orders(spark, d).select("o_orderkey", formats.number(F.col("o_totalprice"), 2, " ", ".").alias("amount"), F.translate(formats.percent(rounded / 100, 0), formats.THIN, " ").alias("share"), formats.day(F.col("o_orderdate")).alias("day"))


@query("(SELECT 'first' AS part, o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 7) UNION ALL (SELECT 'last', o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 7)")
def shaping_rows(spark, d):
    """The first and the last rows of a table, as a slide shows them."""
    rows, order = orders(spark, d).select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]
    return shaping.first_rows(rows, 7, order).select(F.lit("first").alias("part"), "o_orderkey").unionByName(shaping.last_rows(rows, 7, order).select(F.lit("last").alias("part"), "o_orderkey"))


@query("SELECT 'l_orderkey' AS \"column\", true AS near UNION ALL SELECT 'l_partkey', true UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) > 0 FROM lineitem")
def profile_approximate(spark, d):
    """Approximate counts of distinct values lie within a tenth of the exact ones."""
    columns = ["l_orderkey", "l_partkey", "l_returnflag"]
    found = profile.profile(lines(spark, d), columns, exact=False).select("column", F.col("distinct_values").alias("about"))
    exact = profile.profile(lines(spark, d), columns, exact=True).select("column", "distinct_values")
    return found.join(exact, "column").select("column", (F.abs(F.col("about") - F.col("distinct_values")) <= F.col("distinct_values") / 10).alias("near"))



# --- ingest by the rules of the round's probes, scenarios with queries over windows and tables -----------------------


@query("SELECT o_orderkey AS k, 'plan ' || strftime(o_orderdate, '%B') AS month FROM orders WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01'")
def ingest_month_column(spark, d):
    """A text column named month comes back from the history as it was, beside the upload's own months."""
    text = orders(spark, d).select(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.concat(F.lit("plan "), F.date_format("o_orderdate", "MMMM")).alias("month"))
    found = ingest.write_upload(text, {"k": "int", "day": "date", "month": "string"}, scratch(spark), "u1", 1, "day")
    kept = history.History([history.Upload("u1", 1, f"{found.path}/data")], {"k": "int", "day": "date", "month": "string"}, "day")
    return history.history_view(spark, kept, (MARCH.start, MARCH.stop)).select("k", "month")


@query("""SELECT 'flags' AS "column", 'int' AS kind, count(*) AS rows FROM orders UNION ALL SELECT 'words', 'bool', count(*) FROM orders UNION ALL SELECT 'short', 'date', count(*) FROM orders
UNION ALL SELECT 'midnight', 'date', count(*) FROM orders UNION ALL SELECT 'moment', 'datetime', count(*) FROM orders""")
def infer_counts(spark, d):
    """Zeros and ones are numbers, words are flags; years of two digits, midnights and parts of seconds are read."""
    o, day = orders(spark, d), F.col("o_orderdate")
    text = o.select(
        F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey")).otherwise(F.col("o_orderkey") % 2).cast("string").alias("flags"),
        F.when(F.col("o_orderkey") % 2 == 0, "да").otherwise("ложь").alias("words"),
        F.date_format(day, "dd.MM.yy").alias("short"),
        F.date_format(day, "yyyy-MM-dd 00:00:00").alias("midnight"),
        F.date_format(day, "yyyy-MM-dd'T'10:20:30.5").alias("moment"),
    )
    kinds = parsing.infer(text)
    read = parsing.typed(text, kinds).where("size(_errors) = 0").count()
    return spark.createDataFrame([(c, k, read) for c, k in kinds.items()], "column string, kind string, rows long")


@query("""SELECT o_orderkey AS k, o_orderstatus || chr(10) || '"' || o_orderpriority AS note, row_number() OVER (ORDER BY o_orderkey, o_totalprice) - 1 AS _row FROM orders""")
def ingest_quoted(spark, d):
    """A file whose quotes hold line ends, written in pieces and read in splits, in the order of its rows."""
    path = scratch(spark)
    note = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('\n""'), F.col("o_orderpriority"), F.lit('"'))
    rows = orders(spark, d).select("o_orderkey", "o_totalprice", F.concat_ws(";", F.col("o_orderkey").cast("string"), note).alias("value"))
    header = spark.createDataFrame([(-1, 0.0, "k;note")], rows.schema)
    in_pieces(header.unionByName(rows), "o_orderkey", "o_totalprice").select("value").write.text(path)
    return delimited.read_text(spark, path).select(F.col("k").cast("long").alias("k"), "note", "_row")


_SCENARIO = {
    "by_status": {"query": "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderstatus"},
    "largest": {"query": "SELECT o_orderstatus, n FROM by_status WHERE total = (SELECT max(total) FROM by_status)"},
    "year": {"query": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", "window": "year_to_date"},
}
_REVENUE = {"source": "orders", "period_column": "o_orderdate", "aggregate": {"fn": "sum", "column": "o_totalprice"}}


def _sql_report(spark, d, metrics=()):
    made = scenario.Scenario({"orders": {"source": "orders", "period_column": "o_orderdate"}}, _SCENARIO, dict(metrics))
    return scenario.run(spark, made, {"orders": orders(spark, d)}, MARCH)


@query("""WITH b AS (SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1)
SELECT o_orderstatus, n FROM b WHERE total = (SELECT max(total) FROM b)""")
def scenario_sql_over_table(spark, d):
    """A query over a finished table of the same scenario, itself a query over the report period."""
    return _sql_report(spark, d).frames["largest"]


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1")
def scenario_sql_windowed(spark, d):
    return _sql_report(spark, d).frames["year"]


@query("""WITH v AS (SELECT sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01') AS now, sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-02-01' AND o_orderdate < DATE '1998-03-01') AS past FROM orders)
SELECT round(now, 2) AS revenue, round(past, 2) AS revenue_prev, round(now - past, 2) AS revenue_prev_change, round(now / past - 1, 6) AS revenue_prev_change_pct FROM v""")
def scenario_metric_compare(spark, d):
    """A metric's comparison in a scenario, beside one that fails alone."""
    values = _sql_report(spark, d, {"revenue": {**_REVENUE, "compare": [{"kind": "previous_period", "suffix": "prev"}]}, "bad": {**_REVENUE, "aggregate": {"fn": "sum", "column": "nothing"}}}).values
    row = spark.createDataFrame([tuple(map(float, values.values()))], ", ".join(f"{k} double" for k in values))
    return row.select(*(F.round(k, 6 if k.endswith("pct") else 2).alias(k) for k in row.columns))


_formula("quoted_calls", "concat('log(x) // ', o_orderstatus)", "concat('log(x) // ', o_orderstatus)")
_formula("array_concat", "size(concat(array(o_orderkey), array(o_custkey, 1)))", "len(list_concat([o_orderkey], [o_custkey, 1]))::INT")
_formula("short_fraction", "o_custkey * .5 + 1.", "o_custkey * CAST(.5 AS DOUBLE) + 1")
_formula("double_whole_division", "o_totalprice // 1000 + 2 * o_custkey // 7", "CAST(trunc(o_totalprice / 1000) AS BIGINT) + 2 * o_custkey // 7")
_formula("rounding_casts", "TRY_CAST(o_orderstatus || '3.7' AS INT) IS NULL AND CAST('3.7' AS INT) = 4 AND (o_custkey / 2)::int = half_even_int(o_custkey / 2)", "true")
_formula("like_backslash", "(o_orderstatus || '\\_') LIKE '_\\_' AND NOT (o_orderstatus || 'x_') LIKE '_\\_'", "true")


@query("SELECT median(o_totalprice) AS median FROM orders")
def median_of_all(spark, d):
    """The exact median of a whole table, by ranges of values."""
    return ordered.median(orders(spark, d), F.col("o_totalprice"))


@query("SELECT o_orderstatus, median(o_totalprice) AS median FROM orders GROUP BY 1")
def median_by_status(spark, d):
    return ordered.median(orders(spark, d), F.col("o_totalprice"), ["o_orderstatus"])


@query("SELECT o_orderkey, o_orderstatus, rank() OVER (ORDER BY o_orderstatus DESC) AS place FROM orders")
def rank_of_ties(spark, d):
    """Ranks where a third and more of all rows are equal."""
    return ordered.with_rank(orders(spark, d).select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus").desc_nulls_last(), "o_orderstatus", "place")


# --- reports from stored days of uploads, latest values of hot keys ---------------------------------------------------


def two_uploads(spark: SparkSession, d: str) -> list[history.Upload]:
    """Orders to February 1998, and anew, at twice the price, from the middle of that month on."""
    rows = orders(spark, d).select("o_custkey", *COLUMNS)
    out = []
    for seq, (part, period) in enumerate(((rows.where("o_orderdate < '1998-03-01'"), "1990-01-01..1998-02-28"), (rows.where("o_orderdate >= '1998-02-15'").withColumn("o_totalprice", F.col("o_totalprice") * 2), "1998-02-15..1999-12-31")), 1):
        path = scratch(spark)
        part.withColumns({"_upload_id": F.lit(f"u{seq}"), "_upload_seq": F.lit(seq), "_row": F.col("o_orderkey"), "_month": history.month_of("o_orderdate")}).write.partitionBy("_month").parquet(path)
        out.append(history.Upload(f"u{seq}", seq, path, Period.read(period)))
    return out


_TWICE = {"o_custkey": "int", **COLUMNS}
_DAYS = scenario.Scenario(
    {"orders": {"source": "orders", "steps": [{"type": "filter", "where": "o_totalprice > 1000"}]}},
    {
        "by_status": {
            "input": "orders",
            "period_column": "o_orderdate",
            "keys": ["o_orderstatus"],
            "aggregates": [
                {"fn": "count", "name": "n"},
                {"fn": "sum", "column": "o_totalprice", "name": "total"},
                {"fn": "mean", "column": "o_totalprice", "name": "mean"},
                {"fn": "count_distinct", "column": "o_custkey", "name": "customers"},
                {"fn": "median", "column": "o_totalprice", "name": "middle"},
                {"fn": "last", "column": "o_orderkey", "name": "newest"},
            ],
            "compare": [{"kind": "previous_period", "suffix": "prev"}],
        },
        "by_month": {"input": "orders", "period_column": "o_orderdate", "window": "year_to_date", "keys": [{"column": "o_orderdate", "bucket": "month", "name": "month"}], "aggregates": [{"fn": "count", "name": "n"}, {"fn": "max", "column": "o_totalprice", "name": "most"}]},
    },
)
_EFFECTIVE = """WITH h AS (SELECT * FROM orders WHERE o_orderdate < DATE '1998-02-15' UNION ALL SELECT * REPLACE (o_totalprice * 2 AS o_totalprice) FROM orders WHERE o_orderdate >= DATE '1998-02-15'),
e AS (SELECT *, date_trunc('month', o_orderdate) AS m FROM h WHERE o_totalprice > 1000)"""


def _from_days(spark: SparkSession, d: str) -> scenario.Report:
    """March's report after one of February has stored the days of the first upload."""
    uploads, store = two_uploads(spark, d), scratch(spark)
    source = lambda n: history.History(uploads[:n], _TWICE, "o_orderdate")
    scenario.run(spark, _DAYS, {"orders": source(1)}, Period.read("1998-02"), store)
    return scenario.run(spark, _DAYS, {"orders": source(2)}, MARCH, store)


@query(
    _EFFECTIVE
    + """, a AS (SELECT o_orderstatus, m, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(DISTINCT o_custkey) AS customers, round(median(o_totalprice), 4) AS middle,
arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM e WHERE m IN (DATE '1998-02-01', DATE '1998-03-01') GROUP BY ALL)
SELECT x.* EXCLUDE (m), y.n AS n_prev, y.total AS total_prev, y.mean AS mean_prev, y.customers AS customers_prev, y.middle AS middle_prev, y.newest AS newest_prev
FROM a x LEFT JOIN a y ON x.o_orderstatus = y.o_orderstatus AND y.m = DATE '1998-02-01' WHERE x.m = DATE '1998-03-01'"""
)
def partials_compared(spark, d):
    """A compared table of counts, sums, means, different values, medians and latest values, from stored days of two uploads."""
    found = _from_days(spark, d).frames["by_status"]
    places = {"total": 2, "mean": 4, "middle": 4}
    names = [f"{c}{end}" for end in ("", "_prev") for c in ("n", "total", "mean", "customers", "middle", "newest")]
    return found.select("o_orderstatus", *((F.round(c, places[k]).alias(c) if (k := c.removesuffix("_prev")) in places else F.col(c)) for c in names))


@query(_EFFECTIVE + " SELECT CAST(m AS DATE) AS month, count(*) AS n, max(o_totalprice) AS most FROM e WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1")
def partials_by_month(spark, d):
    """Months of the year to date from the same days' kind, of which the later upload replaces the middle of one on."""
    return _from_days(spark, d).frames["by_month"]


@query("""SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END IGNORE NULLS) OVER (PARTITION BY o_orderpriority = '5-LOW' ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS last_total FROM orders""")
def latest_of_hot_keys(spark, d):
    """The total of the latest finished order up to each one, for two keys that hold all rows."""
    finished = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    rows = orders(spark, d).select("o_orderkey", "o_orderdate", (F.col("o_orderpriority") == "5-LOW").alias("low"), finished.alias("finished"))
    return ordered.with_last(rows, ["low"], [F.col("o_orderdate"), F.col("o_orderkey")], "finished", "last_total").select("o_orderkey", "last_total")


@query(
    _EFFECTIVE.replace(" WHERE o_totalprice > 1000", "")
    + "".join(
        f"""{" UNION ALL" if i else ""} SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, {least.format(f"min({c})")} AS least, {least.format(f"max({c})")} AS greatest, true AS near FROM h"""
        for i, (c, least) in enumerate((("o_custkey", "CAST({} AS VARCHAR)"), ("o_orderkey", "CAST({} AS VARCHAR)"), ("o_orderstatus", "{}"), ("o_orderdate", "strftime({}, '%Y-%m-%d %H:%M:%S')")))
    )
)
def profile_merged(spark, d):
    """A source's profile from stored months of its two uploads: counts and extremes exact, different values within 2 %."""
    source, columns = history.History(two_uploads(spark, d), _TWICE, "o_orderdate"), ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"]
    exact = profile.profile(history.history_view(spark, source), columns, exact=True).select("column", F.col("distinct_values").alias("really"))
    near = F.abs(F.col("distinct_values") - F.col("really")) <= F.col("really") / 50
    return profiles.profile(spark, scratch(spark), source, columns).join(exact, "column").select("column", "rows", "nulls", "least", "greatest", near.alias("near"))


@query("""WITH h AS (SELECT * FROM orders WHERE o_orderdate < DATE '1998-02-15' UNION ALL SELECT * REPLACE (o_totalprice * 2 AS o_totalprice) FROM orders WHERE o_orderdate >= DATE '1998-02-15'),
l AS (SELECT l_orderkey, l_quantity FROM lineitem), f AS (SELECT * FROM h WHERE o_totalprice > 50000), e AS (SELECT DISTINCT o_orderkey FROM f)
SELECT 'source' AS step, count(*) AS n, true AS near FROM h UNION ALL SELECT 'filter', count(*), true FROM f UNION ALL SELECT 'dedupe', count(*), true FROM e
UNION ALL SELECT 'join', count(*), true FROM e LEFT JOIN l ON o_orderkey = l_orderkey""")
def preview_stored(spark, d):
    """Rows after each step from stored samples of two uploads and of the table that they join by other names, beside the
    rows of the whole run: an order of the sample has all its lines. Near is within 5 %, as the preview says of itself."""
    steps_of = [
        {"type": "filter", "where": "o_totalprice > 50000"},
        {"type": "dedupe", "by": ["o_orderkey"], "newest": ["o_orderdate"]},
        {"type": "join", "with": "lines", "on": {"o_orderkey": "l_orderkey"}, "columns": ["l_quantity"]},
    ]
    made = scenario.Scenario({"orders": {"source": "orders", "steps": steps_of}, "lines": {"source": "lines"}})
    source = history.History(two_uploads(spark, d), _TWICE, "o_orderdate")
    line = lines(spark, d).select("l_orderkey", "l_quantity")
    about = preview.stored_preview(spark, made, {"orders": source, "lines": line}, "orders", MARCH, scratch(spark), 1, 8000)[1]
    exact = preview.preview(spark, made, {"orders": history.history_view(spark, source), "lines": line}, "orders", MARCH, 1, large=1 << 62)[1]
    rows = [(e.step, e.rows, abs(a.rows - e.rows) <= 0.05 * e.rows and a.error <= 0.05) for a, e in zip(about, exact, strict=True)]
    return spark.createDataFrame(rows, "step string, n long, near boolean")


# --- untidy files, drafts and reconciling, periods of uploads, the day of a run ---------------------------------------


def written(spark: SparkSession, rows: DataFrame, *head: str) -> str:
    """A file, in pieces, of the given lines and then of the rows' `value`, in the order of their `place`; rows are text as it is, of any bytes."""
    path = scratch(spark)
    first = spark.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "place long, value string")
    in_pieces(first.unionByName(rows.select("place", "value")), "place").select("value").write.text(path)
    return path


@query("""SELECT o_orderkey AS k, o_orderstatus AS "Note", o_orderpriority AS "Note (2)", CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS "column 4" FROM orders""")
def ingest_untidy(spark, d):
    """A title above the header, repeated and blank names, short rows, cells beyond the header, and blank rows between."""
    short, more, empty = F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 3 == 1, F.lit(";;;")
    cells = F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    line = F.when(short, cells).otherwise(F.concat_ws(";", cells, F.col("o_custkey").cast("string"), F.when(more, "beyond")))
    rows = orders(spark, d).select(F.col("o_orderkey").alias("place"), F.explode(F.array(line, empty)).alias("value"))
    path = written(spark, rows, "Orders of all years", "Key;Note;Note;;")
    return delimited.read_text(spark, path, ragged="truncate").select(F.col("Key").cast("long").alias("k"), "Note", "Note (2)", "column 4")


@query("SELECT o_orderkey AS k, 'заказ ' || o_orderpriority AS note FROM orders")
def ingest_windows_1251(spark, d):
    """A file that is not UTF-8 is read as windows-1251."""
    word = F.unhex(F.lit("E7E0EAE0E7")).cast("string")
    rows = orders(spark, d).select(F.col("o_orderkey").alias("place"), F.concat(F.col("o_orderkey").cast("string"), F.lit(";"), word, F.lit(" "), F.col("o_orderpriority")).alias("value"))
    return delimited.read_text(spark, written(spark, rows, "k;note")).select(F.col("k").cast("long").alias("k"), "note")


@query("SELECT o_orderkey AS order_no, o_totalprice AS amount, o_orderstatus AS status FROM orders")
def ingest_reconciled(spark, d):
    """Columns of a file that were put in another order and under other names, one with a month in it, under the source's names."""
    names = {"Status of order": "o_orderstatus", "Amount, March 1998": "o_totalprice", "ORDER-NO": "o_orderkey"}
    text = orders(spark, d).select(*(F.col(c).cast("string").alias(n) for n, c in names.items()))
    found = ingest.reconcile(text.columns, {"order_no": ["Order no"], "amount": ["Amount, February 1998"], "status": ["Status of an order"]})
    return text.select(F.col(f"`{found['order_no']}`").cast("long").alias("order_no"), F.col(f"`{found['amount']}`").cast("double").alias("amount"), F.col(f"`{found['status']}`").alias("status"))


@query("""SELECT 'order_number' AS id, 'string' AS kind, false AS period, count(o_orderkey) AS cells FROM orders UNION ALL SELECT 'order_date', 'date', true, count(o_orderdate) FROM orders
UNION ALL SELECT 'order_date_2', 'string', false, count(o_orderstatus) FROM orders UNION ALL SELECT 'c_1_total', 'float', false, count(o_totalprice) FROM orders""")
def ingest_draft(spark, d):
    """A suggestion for a new source: ids from names, types from all cells, codes as text, and the column of the period."""
    columns = {"Order number": F.col("o_orderkey").cast("string"), "Order date": F.date_format("o_orderdate", "dd.MM.yyyy"), "Order  date?": F.col("o_orderstatus"), "1. Total": F.format_string("%.2f", F.col("o_totalprice") + 0.25)}
    text = orders(spark, d).select(*(c.alias(n) for n, c in columns.items()))
    found = ingest.draft(parsing.infer(text))
    cells = text.agg(*(F.count(f"`{n}`").alias(i) for n, i in found.columns.items())).first()
    return spark.createDataFrame([(i, kind, i == found.period_column, cells[i]) for i, kind in found.types.items()], "id string, kind string, period boolean, cells long")


@query("""SELECT o_orderkey, DATE '1998-02-01' AS day FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, DATE '1998-03-01' FROM orders WHERE o_orderstatus <> 'F'""")
def history_by_upload(spark, d):
    """Snapshots whose period comes with the upload: of four, one was declared anew by a later one, and one lies outside."""
    uploads = []
    for seq, (where, period) in enumerate((("o_orderstatus = 'F'", "1998-01"), ("o_orderstatus = 'F'", "1998-02"), ("o_orderstatus = 'O'", "1998-02"), ("o_orderstatus <> 'F'", "1998-03")), 1):
        path = scratch(spark)
        orders(spark, d).where(where).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day")).withColumns({"_upload_id": F.lit(f"u{seq}"), "_upload_seq": F.lit(seq), "_row": F.col("o_orderkey")}).write.parquet(path)
        uploads.append(history.Upload(f"u{seq}", seq, path, Period.read(period)))
    source = history.History(uploads, {"o_orderkey": "int", "day": "date"}, "day", by_upload=True)
    return history.history_view(spark, source, (date(1998, 2, 1), date(1998, 4, 1))).select("o_orderkey", "day")


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS id FROM orders GROUP BY 1)
SELECT id FROM y WHERE id IN ('1995', '1998') UNION ALL SELECT 'anew' WHERE EXISTS (FROM y)""")
def history_uploads_of_span(spark, d):
    """Uploads that a report from the middle of 1995 to that of 1998 reads: those of years, of which a later one replaces two."""
    years = sorted(str(r[0]) for r in orders(spark, d).select(F.year("o_orderdate")).distinct().collect())
    uploads = [history.Upload(y, i, "", Period.read(y)) for i, y in enumerate(years)]
    made = history.History([*uploads, history.Upload("anew", len(years), "", Period.read("1996-01-01..1997-12-31"))], COLUMNS, "o_orderdate")
    return spark.createDataFrame([(u.id,) for u in history.uploads_in(made, (date(1995, 7, 1), date(1998, 7, 1)))], "id string")


@query("""SELECT o_orderkey, date_diff('day', o_orderdate, DATE '1998-03-15') AS age, last_day(o_orderdate) = last_day(DATE '1998-03-15') AS same FROM orders WHERE o_orderdate < DATE '1998-03-15'""")
def scenario_run_day(spark, d):
    """A report of a fixed day: what formulas and queries call the current date."""
    steps_of = [{"type": "filter", "where": "o_orderdate < CURRENT_DATE"}, {"type": "formula", "name": "age", "text": "date_diff('day', o_orderdate, current_date())"}]
    tables = {"ages": {"query": "SELECT o_orderkey, age, last_day(o_orderdate) = last_day(today()) AS same FROM orders"}}
    made = scenario.Scenario({"orders": {"source": "orders", "steps": steps_of}}, tables)
    return scenario.run(spark, made, {"orders": orders(spark, d)}, MARCH, today=date(1998, 3, 15)).frames["ages"]


@query("""WITH m AS (SELECT max(o_orderdate) AS last FROM orders), q AS (SELECT last, CASE WHEN month(last) % 3 = 0 THEN date_trunc('quarter', last) ELSE date_trunc('quarter', last) - INTERVAL 3 MONTH END AS ended FROM m)
SELECT strftime(last, '%Y-%m') AS period, CAST(year(last) - 1 AS VARCHAR) AS previous_year, CAST(quarter(last) AS VARCHAR) AS quarter, year(ended) || '-Q' || quarter(ended) AS last_quarter_period FROM q""")
def format_period(spark, d):
    """What texts may name of the newest month of the data."""
    newest = orders(spark, d).agg(F.max("o_orderdate").cast("date")).first()[0]
    found = formats.period_variables(Period.around(newest, "month"))
    names = ("period", "previous_year", "quarter", "last_quarter_period")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} string" for n in names))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, 'ok' AS state, CAST((SELECT count(*) FROM orders) AS DOUBLE) AS metric FROM orders GROUP BY 1")
def report_files(spark, d):
    """A report's table, metric and status as they come back from its files."""
    spec = {"input": "orders", "period_column": "o_orderdate", "window": {"range": {"start": "1900-01-01", "end": "2100-01-01"}}, "keys": ["o_orderstatus"], "aggregates": [{"fn": "count", "name": "n"}, {"fn": "sum", "column": "o_totalprice", "name": "total"}]}
    made = scenario.Scenario({"orders": {"source": "orders"}}, {"by_status": spec}, {"orders_in_all": {"source": "orders", "aggregate": {"fn": "count"}}})
    found, path = scenario.run(spark, made, {"orders": orders(spark, d)}, MARCH), scratch(spark)
    results.write_report(scenario.Report({"by_status": found.frames["by_status"]}, found.values, found.statuses), path)
    said = spark.read.text(f"{path}/_metrics").select(F.get_json_object("value", "$.statuses.by_status.state").alias("state"), F.get_json_object("value", "$.metrics.orders_in_all").cast("double").alias("metric"))
    return spark.read.parquet(f"{path}/by_status").withColumn("total", F.round("total", 2)).join(F.broadcast(said))  # one row


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def report_arrow(spark, d):
    """A finished table as Arrow, as a renderer takes it."""
    return spark.createDataFrame(results.to_arrow(orders(spark, d).groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))))


@query("""SELECT 'empty_' || lower(s) AS name FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s) WHERE s NOT IN (SELECT o_orderstatus FROM orders)
UNION ALL SELECT 'absent: upload ' || y || ' has no o_totalprice' FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) WHERE y IN (1996, 1997)""")
def diagnose_empty_and_absent(spark, d):
    """Tables without rows, and uploads of two years whose files lack a used column."""
    rows = orders(spark, d)
    none = diagnostics.empty_nodes({f"empty_{s.lower()}": rows.where(F.col("o_orderstatus") == s) for s in "FOPX"})
    years = sorted(str(r[0]) for r in rows.select(F.year("o_orderdate")).distinct().collect())
    made = history.History([history.Upload(y, i, "", Period.read(y)) for i, y in enumerate(years)], COLUMNS, "o_orderdate")
    lack = diagnostics.absent_columns(made, {y: {*COLUMNS} - {"o_totalprice"} for y in years}, ["o_totalprice", "o_orderkey"], (date(1996, 1, 1), date(1998, 1, 1)))
    return spark.createDataFrame([(x,) for x in [*none, *(f"absent: {w}" for w in lack)]], "name string")
