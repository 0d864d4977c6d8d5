"""Pipeline steps: each takes a table and gives a table, lazily.

Period and service columns (_upload_id, _upload_seq, _row) tell which rows are newest and survive every step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from importlib import import_module
from inspect import signature

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.functions import formulas
from tallybook.functions.periods import Period
from tallybook.functions.windows import Span, within
from tallybook.operators import ordered
from tallybook.sources import parsing

SERVICE = ("_upload_id", "_upload_seq", "_row")

CONDITIONS: dict[str, Callable[[Column, object], Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v),
    "not_in": lambda c, v: ~c.isin(*v),
    "contains": lambda c, v: c.cast("string").contains(v),
    "starts_with": lambda c, v: c.cast("string").startswith(v),
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "between": lambda c, v: c.between(*v),
    "is_null": lambda c, _: c.isNull(),
    "not_null": lambda c, _: c.isNotNull(),
}


def literal(value: object, kind: str) -> Column:
    """A condition's value in the column's type."""
    if isinstance(value, str) and kind in ("date", "timestamp_ntz", "bigint", "int", "double", "boolean"):
        return F.lit(value).cast(kind)
    return F.lit(value)


def filter_where(df: DataFrame, where: str) -> DataFrame:
    return formulas.filtered(df, where)


def filter_conditions(df: DataFrame, conditions: Sequence[Mapping], combine: str = "and") -> DataFrame:
    """Rows that fulfil all (and) or any (or) of {column, op, value}; a null result is no."""
    kinds, whole = dict(df.dtypes), None
    for x in conditions:
        if x["column"] not in kinds:
            raise ValueError(f"no column {x['column']!r}; there are {', '.join(kinds)}")
        value, kind = x.get("value"), kinds[x["column"]]
        if x["op"] not in ("contains", "starts_with"):
            value = [literal(v, kind) for v in value] if isinstance(value, (list, tuple)) else literal(value, kind)
        found = CONDITIONS[x["op"]](F.col(x["column"]), value)
        whole = found if whole is None else whole & found if combine == "and" else whole | found
    return df if whole is None else df.where(whole)


def relative_span(anchor: date, last: int | None = None, unit: str = "month", period: str | None = None) -> Span:
    """The last n units up to the anchor's, or a named one: this_/previous_ with a unit, or month/quarter/year_to_date."""
    if last is not None:
        return Period.around(anchor, unit).moved(1 - last).start, anchor + timedelta(1)
    kind, _, name = period.partition("_")
    if period.endswith("_to_date"):
        return Period.around(anchor, kind).start, anchor + timedelta(1)
    now = Period.around(anchor, name)
    return (now.start, anchor + timedelta(1)) if kind == "this" else (now.moved(-1).start, now.start)


def time_filter(df: DataFrame, column: str, anchor: date | None = None, start: str | None = None, end: str | None = None, **relative: object) -> DataFrame:
    """Rows of start..end (both inclusive, either open), or of a span relative to the anchor. Null dates are out."""
    if relative:
        return df.where(within(column, relative_span(anchor, **relative)))
    keep = F.col(column).isNotNull()
    if start:
        keep = keep & (F.col(column) >= F.lit(date.fromisoformat(start)))
    if end:
        keep = keep & (F.col(column) < F.lit(date.fromisoformat(end) + timedelta(1)))
    return df.where(keep)


def searched_span(span: Span, unit: str, depth: int) -> Span:
    """The span with its start moved back by so many units: what a deduplication of limited depth searches."""
    start, stop = span
    return (start if start is None else Period.around(start, unit).moved(-depth).start), stop


def dedupe(
    df: DataFrame,
    by: Sequence[str] | None = None,
    keep: str = "last",
    column: str | None = None,
    newest: Sequence[str] = ("_upload_seq", "_row"),
    depth: int | None = None,
    unit: str = "month",
    period_column: str | None = None,
    span: Span | None = None,
) -> DataFrame:
    """One row for each key: the first or last in the order of `newest`, or that of the least or largest `column`.

    Nulls of column come last, ties go to the newest. With a depth, rows are searched from so many units before the span,
    and the winners inside the span are returned. The rank filter lets Spark keep one row per key before the shuffle.
    """
    if depth is not None:
        if period_column is None or span is None:
            raise ValueError("a depth needs a period column and a span")
        df = df.where(within(period_column, searched_span(span, unit, depth)))
    by = list(by or [c for c in df.columns if c not in SERVICE])
    recent = [F.col(c).desc_nulls_last() for c in newest]
    order = {
        "first": [F.col(c).asc_nulls_last() for c in newest],
        "last": recent,
        "max": [F.col(column).desc_nulls_last(), *recent] if column else recent,
        "min": [F.col(column).asc_nulls_last(), *recent] if column else recent,
    }[keep]
    found = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")
    return found if depth is None else found.where(within(period_column, span))


def sort_keys(keys: Sequence[str]) -> list[Column]:
    """Columns to sort by, -name descending; nulls last both ways."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last() for k in keys]


def sort(df: DataFrame, by: Sequence[str]) -> DataFrame:
    stable = [c for c in ("_upload_seq", "_row") if c in df.columns]
    return df.orderBy(*sort_keys(by), *(F.col(c) for c in stable))


def sort_with_places(df: DataFrame, by: Sequence[str], name: str = "place") -> DataFrame:
    """The whole table sorted, with each row's place from 1."""
    stable = [F.col(c) for c in ("_upload_seq", "_row") if c in df.columns]
    return ordered.with_place(df, [*sort_keys(by), *stable], name)


def select(df: DataFrame, columns: Sequence[str] = (), drop: Sequence[str] = (), always: Sequence[str] = ()) -> DataFrame:
    """The listed columns, or all but the dropped; columns in always and service columns stay."""
    if set(drop) & set(always):
        raise ValueError(f"{', '.join(set(drop) & set(always))} cannot be dropped")
    if drop:
        return df.drop(*drop)
    kept = [c for c in df.columns if c not in columns and (c in always or c in SERVICE)]
    return df.select(*columns, *kept)


def rename(df: DataFrame, names: Mapping[str, str], fixed: Sequence[str] = ()) -> DataFrame:
    if bad := set(names) & {*fixed, *SERVICE}:
        raise ValueError(f"{', '.join(sorted(bad))} cannot be renamed")
    after = [names.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise ValueError("two columns would have one name")
    return df.withColumnsRenamed(dict(names))


def cast_column(value: Column, before: str, kind: str) -> Column:
    """Lenient cast to string, int, float, date, datetime or bool; what cannot be read becomes null."""
    if before == "string" and kind != "string":
        return parsing.PARSERS[kind](value)
    if kind == "int" and before in ("double", "float"):
        return F.bround(value, 0).cast("long")
    return value.try_cast(parsing.SPARK_TYPES[kind])


def cast(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    before = dict(df.dtypes)
    return df.withColumns({c: cast_column(F.col(c), before[c], kind) for c, kind in types.items()})


def formula(df: DataFrame, name: str, text: str) -> DataFrame:
    if name.startswith("_"):
        raise ValueError("names that begin with _ are reserved")
    return formulas.with_formula(df, name, text)


def sql(df: DataFrame, query: str, others: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """A query over `data`, this table, and other inputs by name."""
    return formulas.run_sql(df.sparkSession, query, {"data": df, **(others or {})})


@dataclass(frozen=True)
class Context:
    """What a Python step, table or metric sees beside its table: the report's period, other inputs, and the session."""

    period: Period | None = None
    inputs: Mapping[str, DataFrame] = field(default_factory=dict)
    spark: SparkSession | None = None


def function_of(name: str | Callable) -> Callable:
    """A function, or the one that `module:name` names."""
    if callable(name):
        return name
    module, colon, attribute = name.partition(":")
    if not colon:
        raise ValueError(f"{name!r} is no module:name")
    found = getattr(import_module(module), attribute, None)
    if not callable(found):
        raise ValueError(f"{module} has no function {attribute!r}")
    return found


def takes_context(function: Callable) -> bool:
    return len(signature(function).parameters) > 1


def declared(df: DataFrame, schema: str | None) -> DataFrame:
    """df, if its columns and types are the declared ones."""
    if schema is not None:
        wanted = [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(schema)]
        if wanted != df.dtypes:
            raise ValueError(f"columns {df.dtypes} instead of {wanted}")
    return df


def python_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A function from pandas batch to pandas batch, run on the executors."""
    return df.mapInPandas(lambda batches: (function(b) for b in batches), schema)


def python_lazy(df: DataFrame, function: Callable, schema: str | None = None, context: Context | None = None) -> DataFrame:
    """A function from DataFrame to DataFrame; it may take the context as well."""
    out = function(df, context or Context(spark=df.sparkSession)) if takes_context(function) else function(df)
    if not isinstance(out, DataFrame):
        raise ValueError(f"the function gave {type(out).__name__} instead of a DataFrame")
    return declared(out, schema)


def python_table(df: DataFrame, function: Callable, schema: str, most_rows: int = 1_000_000) -> DataFrame:
    """A function over the whole table as pandas; refused above most_rows, as it runs in one place by its nature."""
    rows = df.limit(most_rows + 1).count()
    if rows > most_rows:
        raise ValueError(f"more than {most_rows} rows for a whole-table function")
    return df.groupBy().applyInPandas(function, schema)


def python(df: DataFrame, function: str | Callable, mode: str = "lazy", schema: str | None = None, context: Context | None = None) -> DataFrame:
    """The python step: `lazy` maps the DataFrame, `batches` each pandas batch, `table` the whole table as pandas."""
    found = function_of(function)
    if mode == "lazy":
        return python_lazy(df, found, schema, context)
    if mode not in ("batches", "table"):
        raise ValueError(f"no mode {mode!r}")
    if schema is None:
        raise ValueError(f"mode {mode} needs a schema")
    return python_batches(df, found, schema) if mode == "batches" else python_table(df, found, schema)
