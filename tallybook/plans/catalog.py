"""The registered queries over the given tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions import formulas
from tallybook.functions.aggregates import Aggregate, Key
from tallybook.functions.periods import Period
from tallybook.functions.windows import span_of, within
from tallybook.operators import datasets, diagnostics, joins, metrics, shaping, steps
from tallybook.operators.datasets import Compare, Derive, Table
from tallybook.sources import history, parsing, profile
from tallybook.streaming import arrivals

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MARCH = Period.read("1998-03")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    from tallybook.plans import catalog_sources  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the customer's market segment, nation and region."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    found = joins.join(orders(spark, sf_dir), customer, {"o_custkey": "c_custkey"}, "inner", ["c_mktsegment", "c_nationkey"])
    found = joins.join(found, nation, {"c_nationkey": "n_nationkey"}, "inner", ["n_name", "n_regionkey"])
    return joins.join(found, region, {"n_regionkey": "r_regionkey"}, "inner", ["r_name"])


REGIONAL = "SELECT o.*, c_mktsegment, n_name, r_name FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly totals and counts of the quarter to date, each beside the month before, largest first."""
    spec = Table("o_orderdate", [Key("o_orderdate", "month", "month")], [Aggregate("sum", "o_totalprice", "total"), Aggregate("count", name="n")], window="quarter_to_date", compare=[Compare("previous_period", "prev")], sort=["-total"], top=3)
    return datasets.build(orders(spark, sf_dir), spec, MARCH)


# --- filters -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice / 2.5 > 60000 AND o_orderpriority LIKE '1%'")
def filter_where(spark, d):
    return steps.filter_where(orders(spark, d), "o_totalprice / 2.5 > 60000 AND o_orderpriority LIKE '1%'").select("o_orderkey", "o_totalprice")


def _conditions(name: str, sql: str, conditions: list[dict], combine: str = "and") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return steps.filter_conditions(orders(spark, d), conditions, combine).select("o_orderkey", "o_orderstatus")

    run.__name__ = f"filter_{name}"
    query(f"SELECT o_orderkey, o_orderstatus FROM orders WHERE {sql}")(run)


_conditions("and", "o_orderstatus = 'F' AND o_totalprice >= 200000", [{"column": "o_orderstatus", "op": "eq", "value": "F"}, {"column": "o_totalprice", "op": "ge", "value": 200000}])
_conditions("or", "o_orderstatus <> 'F' OR o_totalprice < 50000", [{"column": "o_orderstatus", "op": "ne", "value": "F"}, {"column": "o_totalprice", "op": "lt", "value": 50000}], "or")
_conditions("in", "o_orderpriority IN ('1-URGENT', '2-HIGH')", [{"column": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]}])
_conditions("not_in", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", [{"column": "o_orderpriority", "op": "not_in", "value": ["1-URGENT", "2-HIGH"]}])
_conditions("contains", "contains(o_orderpriority, 'G')", [{"column": "o_orderpriority", "op": "contains", "value": "G"}])
_conditions("starts_with", "starts_with(CAST(o_orderkey AS VARCHAR), '12')", [{"column": "o_orderkey", "op": "starts_with", "value": "12"}])
_conditions("between", "o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'", [{"column": "o_orderdate", "op": "between", "value": ["1997-01-01", "1997-06-30"]}])
_conditions("null", "o_orderstatus IS NOT NULL AND o_totalprice <= 100000 AND o_orderkey > 5", [{"column": "o_orderstatus", "op": "not_null"}, {"column": "o_totalprice", "op": "le", "value": 100000}, {"column": "o_orderkey", "op": "gt", "value": 5}])


def _time(name: str, sql: str, **arguments: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return steps.time_filter(orders(spark, d), "o_orderdate", date(1998, 3, 31), **arguments).select("o_orderkey", "o_orderdate")

    run.__name__ = f"time_filter_{name}"
    query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE {sql}")(run)


_time("absolute", "o_orderdate >= DATE '1997-05-02' AND o_orderdate < DATE '1997-08-10'", start="1997-05-02", end="1997-08-09")
_time("last_n", "o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01'", last=3, unit="month")
_time("previous_quarter", "o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01'", period="previous_quarter")
_time("year_to_date", "o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01'", period="year_to_date")


# --- rows: dedupe, sort, columns, casts ----------------------------------------------------------------------------

LINE_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
LINE_PICK = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate"


def _dedupe(name: str, order: str, **arguments: object) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return steps.dedupe(lines(spark, d), ["l_orderkey", "l_linenumber"], newest=LINE_ORDER, **arguments).select(*LINE_PICK.split(", "))

    run.__name__ = f"dedupe_{name}"
    query(f"SELECT {LINE_PICK} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1")(run)


NEWEST = ", ".join(f"{c} DESC NULLS LAST" for c in LINE_ORDER)
_dedupe("last", NEWEST, keep="last")
_dedupe("first", ", ".join(f"{c} ASC NULLS LAST" for c in LINE_ORDER), keep="first")
_dedupe("max", f"l_extendedprice DESC NULLS LAST, {NEWEST}", keep="max", column="l_extendedprice")
_dedupe("min", f"l_extendedprice ASC NULLS LAST, {NEWEST}", keep="min", column="l_extendedprice")


@query(f"SELECT {LINE_PICK} FROM lineitem WHERE l_shipdate >= DATE '1997-10-01' AND l_shipdate < DATE '1998-04-01' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {NEWEST}) = 1 AND l_shipdate >= DATE '1998-01-01'")
def dedupe_depth(spark, d):
    """The quarter's lines without those that a newer one replaces, searched back over one more quarter."""
    span = span_of("quarter_to_date", MARCH)
    return steps.dedupe(lines(spark, d), ["l_orderkey", "l_linenumber"], newest=LINE_ORDER, depth=1, unit="quarter", period_column="l_shipdate", span=span).select(*LINE_PICK.split(", "))


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dedupe_all(spark, d):
    rows = orders(spark, d).select("o_custkey", "o_orderstatus", "o_orderpriority")
    return steps.dedupe(rows, newest=["o_custkey"])


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY nullif(o_orderstatus, 'O') DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey) AS rank FROM orders")
def sort_nulls_last(spark, d):
    """Places of all rows where a third and more of the first keys are null."""
    rows = orders(spark, d).withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("O")))
    return steps.sort_with_places(rows, ["-status", "o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice", F.col("place").alias("rank"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderstatus DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey) AS rank FROM orders")
def sort_whole(spark, d):
    """Every order with its place in the sort, of which sort_nulls_last has the first hundred."""
    return steps.sort_with_places(orders(spark, d), ["-o_orderstatus", "o_totalprice", "o_orderkey"], "rank").select("o_orderkey", "o_totalprice", "rank")


@query("SELECT o_custkey, o_totalprice, o_orderdate FROM orders")
def select_columns(spark, d):
    return steps.select(orders(spark, d), ["o_custkey", "o_totalprice"], always=["o_orderdate"])


@query("SELECT * EXCLUDE (o_orderstatus, o_orderpriority) FROM orders")
def drop_columns(spark, d):
    return steps.select(orders(spark, d), drop=["o_orderstatus", "o_orderpriority"], always=["o_orderdate"])


@query("SELECT o_orderkey AS order_no, o_totalprice AS amount, o_orderdate FROM orders")
def rename_columns(spark, d):
    return steps.rename(orders(spark, d), {"o_orderkey": "order_no", "o_totalprice": "amount"}, ["o_orderdate"]).select("order_no", "amount", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 100, 0) AS BIGINT) AS hundreds FROM lineitem")
def cast_float_half_even(spark, d):
    rows = lines(spark, d).select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("hundreds"))
    return steps.cast(rows, {"hundreds": "int"})


@query("SELECT o_orderkey, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS finished, CAST(NULL AS DOUBLE) AS junk FROM orders")
def cast_text(spark, d):
    """Numbers with thousands spaces and a decimal comma, dates as dd.MM.yyyy, yes/no words, and text that is none."""
    text = orders(spark, d).select(
        "o_orderkey",
        F.translate(F.translate(F.format_string("%,.2f", "o_totalprice"), ",", " "), ".", ",").alias("price"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("No").alias("finished"),
        F.col("o_orderpriority").alias("junk"),
    )
    return steps.cast(text, {"price": "float", "day": "date", "finished": "bool", "junk": "float"})


# --- formulas ------------------------------------------------------------------------------------------------------


def _formula(name: str, text: str, sql: str, source: str = "orders", key: str = "o_orderkey") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return steps.formula(table(spark, d, source), "x", text).select(key, "x")

    run.__name__ = f"formula_{name}"
    query(f"SELECT {key}, {sql} AS x FROM {source}")(run)


_formula("divide", "o_totalprice / (o_orderkey % 3)", "o_totalprice / NULLIF(o_orderkey % 3, 0)")
_formula("whole_division", "o_custkey // 7 - o_custkey % 7", "o_custkey // 7 - o_custkey % 7")
_formula("fraction", "o_custkey / 1.2", "o_custkey / CAST(1.2 AS DOUBLE)")
_formula("case", "CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN NULL ELSE lower(o_orderpriority) END", "CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN NULL ELSE lower(o_orderpriority) END")
_formula("null_logic", "coalesce(nullif(o_orderstatus, 'O'), 'open') IN ('open', 'F') AND o_totalprice IS NOT NULL", "coalesce(nullif(o_orderstatus, 'O'), 'open') IN ('open', 'F') AND o_totalprice IS NOT NULL")
_formula("extremes", "greatest(o_totalprice, NULL, 100000.5) - least(o_totalprice, 100000.5)", "greatest(o_totalprice, NULL, CAST(100000.5 AS DOUBLE)) - least(o_totalprice, CAST(100000.5 AS DOUBLE))")
_formula("concat", "join_text(o_orderstatus, nullif(o_orderpriority, '5-LOW')) || '/' || upper(o_orderstatus)", "concat(o_orderstatus, nullif(o_orderpriority, '5-LOW')) || '/' || upper(o_orderstatus)")
_formula("months_between", "months_between_starts(TIMESTAMP_NTZ '1995-01-31 00:00:00', o_orderdate)", "date_diff('month', TIMESTAMP '1995-01-31', o_orderdate)")
_formula("quarters_between", "quarters_between_starts(TIMESTAMP_NTZ '1995-01-31 00:00:00', o_orderdate)", "date_diff('quarter', TIMESTAMP '1995-01-31', o_orderdate)")
_formula("weekday", "sunday_based_dow(o_orderdate) * 10 + iso_dow(o_orderdate)", "CAST(dayofweek(o_orderdate) * 10 + isodow(o_orderdate) AS BIGINT)")
_formula("date_parts", "CAST(year(o_orderdate) * 10000 + quarter(o_orderdate) * 1000 + weekofyear(o_orderdate) AS BIGINT)", "CAST(year(o_orderdate) * 10000 + quarter(o_orderdate) * 1000 + weekofyear(o_orderdate) AS BIGINT)")
_formula("date_trunc", "CAST(date_trunc('quarter', o_orderdate) AS DATE)", "CAST(date_trunc('quarter', o_orderdate) AS DATE)")
_formula("strftime", "date_format(o_orderdate, 'dd.MM.yyyy')", "strftime(o_orderdate, '%d.%m.%Y')")
_formula("last_day", "last_day(o_orderdate)", "last_day(o_orderdate)")
_formula("round", "round(o_totalprice / 7, 2)", "round(o_totalprice / 7, 2)")
_formula("floor_ceil", "floor_double(o_totalprice / 10) + ceil_double(o_totalprice / 10)", "CAST(floor(o_totalprice / 10) + ceil(o_totalprice / 10) AS DOUBLE)")
_formula("half_even", "half_even_int(o_totalprice)", "CAST(round_even(o_totalprice, 0) AS BIGINT)")
_formula("numbers", "abs(sign(o_totalprice - 100000) * 3) + power(o_custkey % 5, 2) + sqrt(o_custkey % 9)", "abs(sign(o_totalprice - 100000) * 3) + power(o_custkey % 5, 2) + sqrt(o_custkey % 9)")
_formula("substring", "left(o_orderpriority, 3) || right(o_orderpriority, 2) || substring(o_orderpriority, 3, 4)", "left(o_orderpriority, 3) || right(o_orderpriority, 2) || substring(o_orderpriority, 3, 4)")
_formula("pad", "lpad(CAST(o_custkey AS STRING), 8, '0') || rpad(o_orderstatus, 4, '.')", "lpad(CAST(o_custkey AS VARCHAR), 8, '0') || rpad(o_orderstatus, 4, '.')")
_formula("split_part", "split_part(o_orderpriority, '-', 2) || length(trim(o_orderpriority))", "split_part(o_orderpriority, '-', 2) || length(trim(o_orderpriority))")
_formula("replace_first", "replace_first(o_orderpriority, '[A-Z]', '*')", "regexp_replace(o_orderpriority, '[A-Z]', '*')")
_formula("replace_all", "regexp_replace(o_orderpriority, '([A-Z])([A-Z])', '$2$1')", "regexp_replace(o_orderpriority, '([A-Z])([A-Z])', '\\2\\1', 'g')")
_formula("extract_first", "extract_first(o_orderpriority, '[A-Z]{4}')", "regexp_extract(o_orderpriority, '[A-Z]{4}')")
_formula("matches", "o_orderpriority RLIKE '^[1-3]' AND NOT o_orderpriority ILIKE '%high'", "regexp_matches(o_orderpriority, '^[1-3]') AND NOT o_orderpriority ILIKE '%high'")
_formula("distinct_from", "nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'", "nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'")
_formula("try_cast", "coalesce(try_cast(o_orderpriority AS DOUBLE), CAST(o_orderkey AS DOUBLE))", "coalesce(try_cast(o_orderpriority AS DOUBLE), CAST(o_orderkey AS DOUBLE))")
_formula("levenshtein", "CAST(levenshtein(o_orderpriority, '1-URGENT') AS BIGINT)", "levenshtein(o_orderpriority, '1-URGENT')")
_formula("make_date", "make_date(CAST(year(o_orderdate) AS INT), 1, 15)", "make_date(year(o_orderdate), 1, 15)")


_formula("like", "o_orderpriority LIKE '%-U%' OR o_orderpriority NOT LIKE '_-%'", "o_orderpriority LIKE '%-U%' OR o_orderpriority NOT LIKE '_-%'")
_formula("contains", "contains(o_orderpriority, 'GH') AND startswith(o_orderpriority, '2') AND endswith(o_orderpriority, 'H')", "contains(o_orderpriority, 'GH') AND starts_with(o_orderpriority, '2') AND ends_with(o_orderpriority, 'H')")
_formula("logarithms", "round(log10(o_totalprice) + ln(o_totalprice) + log(2, o_totalprice) + exp(o_custkey % 3), 9)", "round(log10(o_totalprice) + ln(o_totalprice) + log2(o_totalprice) + exp(o_custkey % 3), 9)")
_formula("time_of_day", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)", "events", "event_id")
_formula("days_between", "CAST(datediff(ts, DATE '2024-01-01') AS BIGINT)", "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))", "events", "event_id")
_formula("strptime", "CAST(to_timestamp(date_format(o_orderdate, 'dd/MM/yyyy'), 'dd/MM/yyyy') AS DATE)", "CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS DATE)")


# --- joins ---------------------------------------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal > 0")


CUSTOMERS = "(SELECT * FROM customer WHERE c_acctbal > 0)"
for _how in ("left", "inner", "full"):

    def _run(spark, d, how=_how):
        return joins.join(orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"}, how, ["c_name", "c_acctbal"]).select("o_custkey", "o_orderkey", "c_name", "c_acctbal")

    _run.__name__ = f"join_{_how}"
    query(f"SELECT {'coalesce(o_custkey, c_custkey) AS ' if _how == 'full' else ''}o_custkey, o_orderkey, c_name, c_acctbal FROM orders {_how} JOIN {CUSTOMERS} ON o_custkey = c_custkey")(_run)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def join_semi(spark, d):
    return joins.join(orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"}, "semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti(spark, d):
    return joins.join(table(spark, d, "customer"), orders(spark, d).where("o_totalprice > 250000"), {"c_custkey": "o_custkey"}, "anti").select("c_custkey", "c_name")


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_next FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey")
def join_suffix(spark, d):
    nation = table(spark, d, "nation")
    return joins.join(nation, nation, {"n_regionkey": "n_nationkey"}, "left", ["n_name"], "_next").select("n_nationkey", "n_name", "n_name_next")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE)")
def join_aligned_keys(spark, d):
    other = orders(spark, d).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return joins.join(lines(spark, d), other, {"l_orderkey": "o_orderkey", "l_shipdate": "o_orderdate"}, "inner", ["o_orderstatus"]).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query(f"SELECT (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {CUSTOMERS})) AS unmatched_rows, (SELECT count(*) FROM (SELECT c_custkey FROM {CUSTOMERS} GROUP BY 1 HAVING count(*) > 1)) AS repeated_keys")
def join_diagnostics(spark, d):
    return joins.unmatched(orders(spark, d), _customers(spark, d), {"o_custkey": "c_custkey"})


@query("SELECT event_id, user_id, last_purchase FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events) WHERE event_type <> 'purchase'")
def join_as_of(spark, d):
    """Each other event with the user's latest purchase up to then: one window instead of a range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    bought = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return table(spark, d, "events").withColumn("last_purchase", bought).where("event_type <> 'purchase'").select("event_id", "user_id", "last_purchase")


# --- aggregates, buckets, windows ----------------------------------------------------------------------------------


@query(
    "SELECT o_orderpriority, sum(o_totalprice) AS total, count(*) AS n, count(o_orderstatus) AS n_status, count(DISTINCT o_custkey) AS customers, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, median(o_totalprice) AS middle "
    "FROM orders WHERE o_orderdate < DATE '1998-04-01' GROUP BY 1".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)")
)
def aggregates(spark, d):
    found = [Aggregate("sum", "o_totalprice", "total"), Aggregate("count", name="n"), Aggregate("count", "o_orderstatus", "n_status"), Aggregate("count_distinct", "o_custkey", "customers"), Aggregate("mean", "o_totalprice", "mean"), Aggregate("min", "o_totalprice", "least"), Aggregate("max", "o_totalprice", "most"), Aggregate("median", "o_totalprice", "middle")]
    out = datasets.build(orders(spark, d), Table("o_orderdate", [Key("o_orderpriority")], found, window="all"), MARCH)
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("SELECT o_orderpriority, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS opening, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS closing FROM orders WHERE o_orderdate < DATE '1998-04-01' GROUP BY 1")
def aggregate_first_last(spark, d):
    spec = Table("o_orderdate", [Key("o_orderpriority")], [Aggregate("first", "o_totalprice", "opening"), Aggregate("last", "o_totalprice", "closing")], window="all", order=["o_orderkey"])
    return datasets.build(orders(spark, d), spec, MARCH)


@query("SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1890-01-01' AND o_orderdate < DATE '1890-02-01'")
def aggregate_empty(spark, d):
    """No rows: the sum is null, the count zero, and there is one row."""
    spec = Table("o_orderdate", [], [Aggregate("sum", "o_totalprice", "total"), Aggregate("count", name="n")])
    return datasets.build(orders(spark, d), spec, Period.read("1890-01")).withColumn("total", F.round("total", 2))


for _bucket in ("day", "week", "month", "quarter", "year"):

    def _run(spark, d, bucket=_bucket):
        rows = table(spark, d, "events") if bucket in ("day", "week") else orders(spark, d)
        column = "ts" if bucket in ("day", "week") else "o_orderdate"
        return rows.groupBy(Key(column, bucket, "bucket").build()).agg(Aggregate("count", name="n").build())

    _run.__name__ = f"bucket_{_bucket}"
    query(f"SELECT CAST(date_trunc('{_bucket}', {'ts' if _bucket in ('day', 'week') else 'o_orderdate'}) AS DATE) AS bucket, count(*) AS n FROM {'events' if _bucket in ('day', 'week') else 'orders'} GROUP BY 1")(_run)

for _name, _window, _start, _stop in (
    ("report", "report_period", "1998-03-01", "1998-04-01"), ("previous", "previous_period", "1998-02-01", "1998-03-01"), ("last_year", "same_period_last_year", "1997-03-01", "1997-04-01"), ("quarter_to_date", "quarter_to_date", "1998-01-01", "1998-04-01"),
    ("year_to_date", "year_to_date", "1998-01-01", "1998-04-01"), ("last_n", {"last_n": {"n": 5}}, "1997-11-01", "1998-04-01"), ("all", "all", "1900-01-01", "1998-04-01"), ("range", {"range": {"start": "1996-02-10", "end": "1996-03-11"}}, "1996-02-10", "1996-03-12"),
):

    def _run(spark, d, window=_window):
        return orders(spark, d).where(within("o_orderdate", span_of(window, MARCH))).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    _run.__name__ = f"window_{_name}"
    query(f"SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= DATE '{_start}' AND o_orderdate < DATE '{_stop}' GROUP BY 1")(_run)


# --- tables: compare, derive, top and others, pivot ----------------------------------------------------------------


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


TOTALS = [Aggregate("sum", "o_totalprice", "total"), Aggregate("count", name="n")]


def _compared_sql(first: str, second: str, suffix: str, key: str = "r_name") -> str:
    def part(span: str) -> str:
        a, b = span.split()
        return f"(SELECT {key}, sum(o_totalprice) AS total, count(*) AS n FROM t WHERE o_orderdate >= DATE '{a}' AND o_orderdate < DATE '{b}' GROUP BY 1)"

    s = suffix
    return f"""WITH t AS ({REGIONAL}) SELECT a.{key}, round(a.total, 6) AS total, a.n, round(b.total, 6) AS total_{s}, b.n AS n_{s},
round(a.total - b.total, 6) AS total_{s}_change, round(a.total / NULLIF(b.total, 0) - 1, 6) AS total_{s}_change_pct,
a.n - b.n AS n_{s}_change, round(a.n / NULLIF(b.n, 0) - 1, 6) AS n_{s}_change_pct
FROM {part(first)} a LEFT JOIN {part(second)} b ON a.{key} IS NOT DISTINCT FROM b.{key}"""


@query(_compared_sql("1998-03-01 1998-04-01", "1998-02-01 1998-03-01", "prev"))
def compare_previous(spark, d):
    return _rounded(datasets.build(regional(spark, d), Table("o_orderdate", [Key("r_name")], TOTALS, compare=[Compare("previous_period", "prev")]), MARCH))


@query(_compared_sql("1998-01-01 1998-04-01", "1997-01-01 1997-04-01", "ly", "n_name"))
def compare_last_year(spark, d):
    return _rounded(datasets.build(regional(spark, d), Table("o_orderdate", [Key("n_name")], TOTALS, window="year_to_date", compare=[Compare("same_period_last_year", "ly")]), MARCH))


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY 1)
SELECT a.month, round(a.total, 6) AS total, a.n, round(b.total, 6) AS total_ly, b.n AS n_ly, round(a.total - b.total, 6) AS total_ly_change, round(a.total / b.total - 1, 6) AS total_ly_change_pct, a.n - b.n AS n_ly_change, round(a.n / b.n - 1, 6) AS n_ly_change_pct
FROM m a LEFT JOIN m b ON a.month = b.month + INTERVAL 1 YEAR AND b.month < DATE '1997-04-01' AND b.month >= DATE '1997-01-01' WHERE a.month >= DATE '1998-01-01' AND a.month < DATE '1998-04-01'""")
def compare_monthly(spark, d):
    spec = Table("o_orderdate", [Key("o_orderdate", "month", "month")], TOTALS, window="year_to_date", compare=[Compare("same_period_last_year", "ly")])
    return _rounded(datasets.build(orders(spark, d), spec, MARCH))


@query(f"""WITH t AS ({REGIONAL}), g AS (SELECT n_name, sum(o_totalprice) AS total, count(*) AS n FROM t WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1)
SELECT n_name, round(total, 6) AS total, n, round(total / sum(total) OVER (), 6) AS share, round(sum(total) OVER (ORDER BY total DESC, n_name ROWS UNBOUNDED PRECEDING), 4) AS running, rank() OVER (ORDER BY n DESC) AS place, round(total / n * 2, 6) AS twice_mean FROM g""")
def derive_all(spark, d):
    spec = Table("o_orderdate", [Key("n_name")], TOTALS, window="year_to_date", sort=["-total"], derive=[Derive("share", "share", "total"), Derive("cumsum", "running", "total"), Derive("rank", "place", "n"), Derive("formula", "twice_mean", formula="total / n * 2.0")])
    return _rounded(datasets.build(regional(spark, d), spec, MARCH)).withColumn("running", F.round("running", 4))


@query(f"WITH t AS ({REGIONAL}) SELECT n_name, round(sum(o_totalprice), 6) AS total, count(*) AS n FROM t WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1 ORDER BY sum(o_totalprice) DESC, n_name LIMIT 5")
def top_n(spark, d):
    return _rounded(datasets.build(regional(spark, d), Table("o_orderdate", [Key("n_name")], TOTALS, sort=["-total"], top=5), MARCH))


OTHERS = [Aggregate("sum", "o_totalprice", "total"), Aggregate("median", "o_totalprice", "middle"), Aggregate("count_distinct", "o_custkey", "customers")]
OTHERS_SQL = f"""WITH t AS ({REGIONAL}), w AS (SELECT * FROM t WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01'),
top AS (SELECT n_name FROM w GROUP BY 1 ORDER BY sum(o_totalprice) DESC, n_name LIMIT 4),
k AS (SELECT CASE WHEN n_name IN (FROM top) THEN n_name ELSE 'Others' END AS n_name, o_totalprice, o_custkey FROM w),
a AS (SELECT n_name, sum(o_totalprice) AS total, median(o_totalprice) AS middle, count(DISTINCT o_custkey) AS customers FROM k GROUP BY 1)"""


@query(OTHERS_SQL + " SELECT n_name, round(total, 6) AS total, round(middle, 6) AS middle, customers, round(total / (SELECT sum(o_totalprice) FROM w), 6) AS share FROM a")
def top_others(spark, d):
    spec = Table("o_orderdate", [Key("n_name")], OTHERS, window="year_to_date", sort=["-total"], top=4, others="Others", derive=[Derive("share", "share", "total")])
    return _rounded(datasets.build(regional(spark, d), spec, MARCH))


@query(OTHERS_SQL.replace("top AS", "v AS (SELECT * FROM t WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01'), top AS") + """,
b AS (SELECT CASE WHEN n_name IN (FROM top) THEN n_name ELSE 'Others' END AS n_name, sum(o_totalprice) AS total_ly FROM v GROUP BY 1)
SELECT n_name, round(total, 6) AS total, round(total_ly, 6) AS total_ly, round(total - total_ly, 6) AS total_ly_change, round(total / total_ly - 1, 6) AS total_ly_change_pct FROM a LEFT JOIN b USING (n_name)""")
def top_others_compare(spark, d):
    spec = Table("o_orderdate", [Key("n_name")], OTHERS[:1], window="year_to_date", sort=["-total"], top=4, others="Others", compare=[Compare("same_period_last_year", "ly")])
    return _rounded(datasets.build(regional(spark, d), spec, MARCH))


MONTHS = ("1998-01", "1998-02", "1998-03")


@query(f"WITH t AS ({REGIONAL}) SELECT r_name, " + ", ".join(f"round(sum(o_totalprice) FILTER (strftime(o_orderdate, '%Y-%m') = '{m}'), 6) AS \"{m}\"" for m in MONTHS) + " FROM t WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1")
def pivot_month(spark, d):
    spec = Table("o_orderdate", [Key("r_name"), Key("o_orderdate", "month", "month")], TOTALS[:1], window="year_to_date", pivot="month")
    out = datasets.build(regional(spark, d), spec, MARCH)
    return out.select("r_name", *(F.round(f"`{m}`", 6).alias(m) for m in MONTHS))


STATUSES = ("F", "O", "P")


@query("SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 6) AS total_{s}, nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS n_{s}" for s in STATUSES) + " FROM orders WHERE o_orderdate < DATE '1998-04-01' GROUP BY 1")
def pivot_several(spark, d):
    spec = Table("o_orderdate", [Key("o_orderpriority"), Key("o_orderstatus")], TOTALS, window="all", pivot="o_orderstatus")
    return _rounded(datasets.build(orders(spark, d), spec, MARCH))


# --- metrics -------------------------------------------------------------------------------------------------------

METRICS = {
    "revenue": metrics.Metric(Aggregate("sum", "o_totalprice"), "orders", "o_orderdate"),
    "revenue_before": metrics.Metric(Aggregate("sum", "o_totalprice"), "orders", "o_orderdate", "previous_period"),
    "urgent": metrics.Metric(Aggregate("count"), "orders", "o_orderdate", "year_to_date", "o_orderpriority = '1-URGENT'"),
    "buyers": metrics.Metric(Aggregate("count_distinct", "o_custkey"), "orders", "o_orderdate", "year_to_date"),
}


@query("""SELECT round(sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01'), 4) AS revenue, round(sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-02-01' AND o_orderdate < DATE '1998-03-01'), 4) AS revenue_before,
count(*) FILTER (o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01' AND o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_custkey) FILTER (o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-04-01') AS buyers FROM orders""")
def metrics_of_input(spark, d):
    """Four metrics of one input in one pass."""
    return _rounded(metrics.of_table(orders(spark, d), METRICS, MARCH), 4)


@query("""SELECT round(a / b - 1, 6) AS growth FROM (SELECT sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01') AS a,
sum(o_totalprice) FILTER (o_orderdate >= DATE '1998-02-01' AND o_orderdate < DATE '1998-03-01') AS b FROM orders)""")
def metric_formula(spark, d):
    row = metrics.of_table(orders(spark, d), METRICS, MARCH)
    return _rounded(formulas.with_formula(row, "growth", "revenue / revenue_before - 1").select("growth"))


@query(f"WITH t AS ({REGIONAL}) SELECT max(n) AS most FROM (SELECT n_name, count(*) AS n FROM t WHERE o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01' GROUP BY 1)")
def metric_of_dataset(spark, d):
    made = datasets.build(regional(spark, d), Table("o_orderdate", [Key("n_name")], TOTALS), MARCH)
    return metrics.of_table(made, {"most": metrics.Metric(Aggregate("max", "n"))}, MARCH)


# --- SQL -----------------------------------------------------------------------------------------------------------


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) SELECT c_name, n, n / 2.5 AS x FROM big JOIN customer ON o_custkey = c_custkey".replace("n / 2.5", "n / CAST(2.5 AS DOUBLE)"))
def sql_step(spark, d):
    text = "WITH big AS (SELECT o_custkey, count(*) AS n FROM data WHERE o_totalprice > 100000 GROUP BY 1) SELECT c_name, n, n / 2.5 AS x FROM big JOIN customer ON o_custkey = c_custkey"
    return steps.sql(orders(spark, d), text, {"customer": table(spark, d, "customer")})


def _sql(name: str, text: str, sql: str = "", tables: str = "orders lineitem customer nation region supplier part events") -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return formulas.run_sql(spark, text, {t: table(spark, d, t) for t in tables.split()})

    run.__name__ = f"sql_{name}"
    query(sql or text)(run)


_sql("union", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region")
_sql("union_all", "SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT c_custkey FROM customer")
_sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
_sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, max(o_totalprice) AS most FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("ranking", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS b, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS c, CAST(ntile(3) OVER w AS BIGINT) AS d, cume_dist() OVER w AS e, percent_rank() OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("analytic", "SELECT o_orderkey, lag(o_totalprice, 1) OVER w AS a, lead(o_totalprice, 2) OVER w AS b, first_value(o_totalprice) OVER w AS c, nth_value(o_totalprice, 2) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("moving", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
_sql("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_sql("correlated", "SELECT s_suppkey, (SELECT count(*) FROM customer c WHERE c.c_nationkey = s.s_nationkey) AS rivals FROM supplier s")
_sql("having", "SELECT l_partkey, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_partkey HAVING count(*) > 2")
_sql("group_by_all", "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL", "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL")
_sql("filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS n FROM orders GROUP BY 1")
_sql("q1", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
_sql("q5", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")


# --- histories: three overlapping uploads --------------------------------------------------------------------------


def _uploads(spark: SparkSession, d: str, policy: str) -> list[tuple[DataFrame, Period | None, str]]:
    """Orders as three uploads: all of 1997, then March to June 1997 anew without pending ones, then the finished ones of May 1997."""
    rows = orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    parts = []
    for seq, (span, keep) in enumerate((("1997-01-01..1997-12-31", "true"), ("1997-03-01..1997-06-30", "o_orderstatus <> 'P'"), ("1997-05", "o_orderstatus = 'F'")), 1):
        p = Period.read(span)
        part = rows.where(within("o_orderdate", (p.start, p.stop))).where(keep)
        changed = part.withColumn("o_totalprice", F.col("o_totalprice") + seq)
        parts.append((changed.withColumns({"_upload_seq": F.lit(seq), "_row": F.col("o_orderkey")}), p, policy))
    return parts


HISTORY = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders), u AS (
SELECT o.* REPLACE (o_totalprice + 1 AS o_totalprice), 1 AS seq FROM o WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' UNION ALL
SELECT o.* REPLACE (o_totalprice + 2 AS o_totalprice), 2 FROM o WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-07-01' AND o_orderstatus <> 'P' UNION ALL
SELECT o.* REPLACE (o_totalprice + 3 AS o_totalprice), 3 FROM o WHERE o_orderdate >= DATE '1997-05-01' AND o_orderdate < DATE '1997-06-01' AND o_orderstatus = 'F')
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM u"""
for _policy, _rest in (
    ("append", ""),
    ("replace_all", " WHERE seq = 3"),
    ("replace_period", " WHERE seq = 3 OR NOT (o_orderdate >= DATE '1997-05-01' AND o_orderdate < DATE '1997-06-01') AND (seq = 2 OR NOT (o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-07-01'))"),
    ("merge_dedupe", " QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC, o_orderdate DESC, o_totalprice DESC) = 1"),
):

    def _run(spark, d, policy=_policy):
        return history.resolve(_uploads(spark, d, policy), "o_orderdate", ["o_orderkey"], policy).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")

    _run.__name__ = f"history_{_policy}"
    query(HISTORY + _rest)(_run)


@query(HISTORY + " a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.o_orderkey = a.o_orderkey AND b.seq > a.seq)")
def history_merge_one_upload(spark, d):
    """Each upload's keys take the place of earlier rows of these keys."""
    return history.resolve(_uploads(spark, d, "merge_dedupe"), "o_orderdate", ["o_orderkey"], "ask").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("SELECT count(*) FILTER (NOT (o_orderdate >= DATE '1998-03-01' AND o_orderdate < DATE '1998-04-01')) AS rows_outside FROM orders")
def history_rows_outside(spark, d):
    return history.rows_outside(orders(spark, d), "o_orderdate", MARCH)


@query("""WITH s AS (SELECT DISTINCT o_orderpriority, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + 1 AS stop FROM orders),
m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY o_orderpriority ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_orderpriority ORDER BY start, stop) AS island FROM m) SELECT o_orderpriority, min(start) AS start, max(stop) AS stop FROM i GROUP BY o_orderpriority, island""")
def history_coverage(spark, d):
    """Runs of days with an order of each priority."""
    day = F.col("o_orderdate").cast("date")
    spans = orders(spark, d).select("o_orderpriority", day.alias("start"), F.date_add(day, 1).alias("stop")).distinct()
    return history.covered_days(spans, "start", "stop", ["o_orderpriority"])


# --- ingest, profiles, samples -------------------------------------------------------------------------------------

PROFILED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM orders" for c in PROFILED))
def profile_columns(spark, d):
    return profile.profile(orders(spark, d), PROFILED, exact=True).select("column", "rows", "nulls", "distinct_values")


@query("SELECT l_returnflag, count(*) AS count FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def profile_most_common(spark, d):
    return profile.most_common(lines(spark, d), "l_returnflag")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price, o_orderpriority <> '5-LOW' AS readable FROM orders")
def ingest_typed(spark, d):
    """Text with junk in rows of low priority: typed values, and whether the row was readable."""
    text = orders(spark, d).select("o_orderkey", F.when(F.col("o_orderpriority") != "5-LOW", F.format_string("%.2f", "o_totalprice")).otherwise("n/a").alias("price"))
    return parsing.typed(text, {"price": "float"}).select("o_orderkey", "price", (F.size("_errors") == 0).alias("readable"))


@query("SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'none') AS month, count(*) AS n FROM orders GROUP BY 1")
def ingest_months(spark, d):
    return orders(spark, d).groupBy(history.month_of("o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def preview_sample_pairs(spark, d):
    """Each order's number of lines: from the sampled lines if the order is in the sample of orders, else from all lines.

    Both tables are sampled by the key, so that the sampled lines of a sampled order are all of its lines.
    """
    sampled_orders = profile.sampled(orders(spark, d), ["o_orderkey"], 7).select("o_orderkey", F.lit(True).alias("picked")).distinct()
    every = lines(spark, d).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    some = profile.sampled(lines(spark, d), ["l_orderkey"], 7).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("m"))
    keys = orders(spark, d).select("o_orderkey").distinct().join(sampled_orders, "o_orderkey", "left")
    both = keys.join(every, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(some, F.col("o_orderkey") == F.col("k"), "left")
    return both.select("o_orderkey", F.coalesce(F.when(F.col("picked"), F.col("m")).otherwise(F.col("n")), F.lit(0)).alias("n"))


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def python_batches(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_totalprice")
    return steps.python_batches(rows, lambda b: b.assign(doubled=b.o_totalprice * 2)[["o_orderkey", "doubled"]], "o_orderkey long, doubled double")


# --- diagnostics ---------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT *, year(o_orderdate) AS seq FROM orders) SELECT count(*) AS rows_before, count(*) FILTER (o_totalprice > 400000) AS rows_after,
coalesce(bool_or(o_totalprice > 400000) FILTER (seq = (SELECT max(seq) FROM u)), false) AS newest_has_rows FROM u""")
def diagnose_filter(spark, d):
    """Orders as yearly uploads: what a filter leaves, and whether it leaves anything of the newest upload."""
    uploads = orders(spark, d).withColumn("_upload_seq", F.year("o_orderdate"))
    return diagnostics.filter_effect(uploads, "o_totalprice > 400000")


@query("SELECT count(*) FILTER (o_orderpriority = '5-LOW') AS price, count(*) AS priority FROM orders")
def diagnose_casts(spark, d):
    text = orders(spark, d).select(F.when(F.col("o_orderpriority") != "5-LOW", F.format_string("%.2f", "o_totalprice")).otherwise("n/a").alias("price"), F.col("o_orderpriority").alias("priority"))
    return diagnostics.cast_losses(text, {"price": "float", "priority": "date"})


@query("WITH u AS (SELECT *, year(o_orderdate) AS seq FROM orders) SELECT o_orderpriority || seq AS label FROM u GROUP BY 1 HAVING min(seq) = (SELECT max(seq) FROM u) ORDER BY 1 LIMIT 5")
def diagnose_newest_values(spark, d):
    """Values of the newest yearly upload alone, five at most."""
    uploads = orders(spark, d).select(F.concat("o_orderpriority", F.year("o_orderdate").cast("string")).alias("label"), F.year("o_orderdate").alias("_upload_seq"))
    return profile.newest_only_values(uploads, "label")


# --- shaping -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, " + ", ".join(f"coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 4), 0) AS {s}" for s in STATUSES) + " FROM orders GROUP BY 1")
def shaping_series(spark, d):
    return _rounded(shaping.series(orders(spark, d), "o_orderpriority", "o_orderstatus", "o_totalprice"), 4)


@query("WITH g AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT CASE WHEN row_number() OVER (ORDER BY v DESC, k) <= 5 THEN CAST(k AS VARCHAR) ELSE 'rest' END AS k, v FROM g) SELECT k, round(sum(v), 4) AS v FROM t GROUP BY 1")
def shaping_others(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.sum("c_acctbal").alias("v"))
    named = g.select(F.lpad(F.col("key").cast("string"), 4, " ").alias("k"), "v")
    return _rounded(shaping.largest_and_others(named, "k", "v", 6, "rest").withColumn("k", F.trim("k")), 4)


@query("SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / nullif(max(o_totalprice) OVER () - min(o_totalprice) OVER (), 0), 6) AS heat FROM orders")
def shaping_heat(spark, d):
    return _rounded(shaping.heat(orders(spark, d), "o_totalprice").select("o_orderkey", "heat"))


@query("WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT month, round(v / 1000, 6) AS v, round(v / 1000 - lag(v / 1000) OVER (ORDER BY month), 6) AS v_change, round((v / 1000) / lag(v / 1000) OVER (ORDER BY month) - 1, 6) AS v_change_pct FROM m")
def shaping_change(spark, d):
    m = orders(spark, d).groupBy(Key("o_orderdate", "month", "month").build()).agg(F.sum("o_totalprice").alias("v"))
    out = shaping.with_change(shaping.scaled(m, "v", "thousand"), "v", ["month"])
    return out.select("month", F.round("v", 6).alias("v"), F.round("v_change", 6).alias("v_change"), F.round("v_change_pct", 6).alias("v_change_pct"))


# --- streaming extension, as batches -------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    return _rounded(arrivals.windowed(table(spark, d, "events"), "ts", "1 day", "1 hour", ["event_type"], "value"), 4)


@query("""WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, d):
    return arrivals.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")
