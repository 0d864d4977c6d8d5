"""Report tables: window, aggregate, compare with other periods, derive, sort, top with others, pivot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions import formulas
from tallybook.functions.aggregates import AGGREGATES, Aggregate, Key, bucket_label
from tallybook.functions.periods import UNITS, Period
from tallybook.functions.windows import span_of, within
from tallybook.operators import ordered
from tallybook.operators.steps import SERVICE, sort_keys


@dataclass(frozen=True)
class Compare:
    """previous_period or same_period_last_year; columns x_<suffix>, x_<suffix>_change and x_<suffix>_change_pct."""

    kind: str
    suffix: str

    def shifted(self, period: Period) -> Period:
        return period.moved(-1) if self.kind == "previous_period" else period.a_year_before()

    def forward(self, day: Column, period: Period) -> Column:
        """A date key of the other period, moved to where it is compared."""
        if self.kind == "same_period_last_year":
            return F.add_months(day, 12)
        if period.unit != "range" and UNITS[period.unit].months:
            return F.add_months(day, UNITS[period.unit].months)
        return F.date_add(day, (period.stop - period.start).days)


@dataclass(frozen=True)
class Derive:
    """share, cumsum or rank of a column, or a formula over the table's columns."""

    kind: str
    name: str
    column: str | None = None
    formula: str | None = None
    ascending: bool = False


@dataclass(frozen=True)
class Table:
    """A table over one input; what is not given is left out."""

    period_column: str
    keys: Sequence[Key] = ()
    aggregates: Sequence[Aggregate] = ()
    columns: Sequence[str] = ()
    window: str | dict = "report_period"
    where: str | None = None
    compare: Sequence[Compare] = ()
    derive: Sequence[Derive] = ()
    sort: Sequence[str] = ()
    top: int | None = None
    others: str | None = None
    pivot: str | None = None
    order: Sequence[str] = field(default=("_upload_seq", "_row"))


def source_rows(df: DataFrame, table: Table, period: Period) -> DataFrame:
    """Rows of the window that fulfil the condition."""
    rows = df.where(within(table.period_column, span_of(table.window, period)))
    return formulas.filtered(rows, table.where) if table.where else rows


def aggregated(rows: DataFrame, table: Table, grouped: bool = True) -> DataFrame:
    order = [table.period_column, *(c for c in table.order if c in rows.columns)]
    if grouped and table.keys:
        return rows.groupBy(*(k.build() for k in table.keys)).agg(*(a.build(order) for a in table.aggregates))
    for a in table.aggregates:
        a.build(order)  # a wrong name is refused here
    return whole(rows, [(a.label, a.fn, F.col(a.column) if a.column else F.lit(1), order) for a in table.aggregates])


def whole(rows: DataFrame, aggregates: Sequence[tuple[str, str, Column, Sequence[str]]]) -> DataFrame:
    """One row of (label, function, value, order) over all rows. Medians, whose values one task would hold, go by ranges."""
    out = rows.agg(*(AGGREGATES[fn](value, order).alias(label) for label, fn, value, order in aggregates if fn != "median"), F.count(F.lit(1)).alias("_all"))
    for label, fn, value, _ in aggregates:
        if fn == "median":
            out = out.join(F.broadcast(ordered.median(rows, value).select(F.col("median").alias(label))), F.lit(True))  # one row each
    return out.select(*(label for label, *_ in aggregates))


def with_changes(df: DataFrame, names: Sequence[str], suffix: str) -> DataFrame:
    out = {}
    for x in names:
        before = F.col(f"{x}_{suffix}")
        out[f"{x}_{suffix}_change"] = F.col(x) - before
        out[f"{x}_{suffix}_change_pct"] = formulas.safe_ratio(F.col(x), before) - 1
    return df.withColumns(out)


#: Columns of expanded rows: the rows' keys, and whether they count for the report's window (0) or a comparison's (1 ..).
KEY, SERVES = "_key_{}", "_serves_{}"


def expanded(df: DataFrame, table: Table, period: Period) -> DataFrame:
    """Rows of the window and of every compared one, from one scan, with the keys and the windows that they serve.

    A row may serve several windows. Where a key is a date, moved forward for a comparison, the row comes once for each of
    them, under the key it has there; else it comes once.
    """
    spans = [span_of(table.window, p) for p in (period, *(c.shifted(period) for c in table.compare))]
    inside = [F.coalesce(within(table.period_column, s), F.lit(False)) for s in spans]
    rows = df.where(reduce(lambda a, b: a | b, (within(table.period_column, s) for s in spans)))
    rows = formulas.filtered(rows, table.where) if table.where else rows
    serves = {SERVES.format(i): x for i, x in enumerate(inside)}
    keys = {KEY.format(i): k.build() for i, k in enumerate(table.keys)}
    if any(k.bucket for k in table.keys):
        rows = rows.withColumn("_window", F.explode(F.array_compact(F.array(*(F.when(x, i) for i, x in enumerate(inside))))))
        serves = {SERVES.format(i): F.col("_window") == i for i in range(len(spans))}
        for i, k in enumerate(table.keys):
            if k.bucket:
                moved = F.when(F.col("_window") == 0, k.build())
                for n, c in enumerate(table.compare, 1):
                    moved = moved.when(F.col("_window") == n, c.forward(k.build(), period))
                keys[KEY.format(i)] = moved
    return rows.withColumns({**keys, **serves})


def compared(rows: DataFrame, table: Table, grouped: bool = True) -> DataFrame:
    """Aggregates of expanded rows for the window and, beside them, for each compared one, by one aggregation.

    Groups that only other windows have are left out; what a group lacks elsewhere is null. Without groups, aggregates of
    no rows are those of an empty table.
    """
    order = [table.period_column, *(c for c in table.order if c in rows.columns)]
    grouped = grouped and bool(table.keys)
    columns, values = [], []
    for i, suffix in enumerate(["", *(f"_{c.suffix}" for c in table.compare)]):
        serves = F.col(SERVES.format(i))
        for a in table.aggregates:
            a.build()  # a wrong name or a missing column is refused here
            values.append((f"{a.label}{suffix}", a.fn, F.when(serves, F.col(a.column) if a.column else F.lit(1)), order))
            value = AGGREGATES[a.fn](values[-1][2], order)
            columns.append((F.when(F.count_if(serves) > 0, value) if i and grouped else value).alias(f"{a.label}{suffix}"))
    if grouped:
        out = rows.groupBy(*(F.col(KEY.format(i)).alias(k.label) for i, k in enumerate(table.keys))).agg(*columns, F.count_if(SERVES.format(0)).alias("_rows"))
        out = out.where("_rows > 0").drop("_rows")
    else:
        out = whole(rows, values)
    for c in table.compare:
        out = with_changes(out, [a.label for a in table.aggregates], c.suffix)
    return out


def derived(df: DataFrame, steps: Sequence[Derive], order: Sequence[Column]) -> DataFrame:
    """Shares of the whole, running sums in sort order, ranks with gaps, and formulas, in the order given.

    Running sums and ranks sort the table into ranges and checkpoint it; no task sees all rows.
    """
    for d in steps:
        x = F.col(d.column) if d.column else None
        if d.kind == "share":
            total = df.agg(F.sum(x).alias("_total"))  # one row: no table-wide window
            df = df.join(F.broadcast(total), F.lit(True)).withColumn(d.name, formulas.safe_ratio(x, F.col("_total"))).drop("_total")
        elif d.kind == "cumsum":
            df = ordered.with_running_sum(df, order, d.column, d.name)
        elif d.kind == "rank":
            by = x.asc_nulls_last() if d.ascending else x.desc_nulls_last()
            df = ordered.with_rank(df, by, d.column, d.name)
        else:
            df = formulas.with_formula(df, d.name, d.formula)
    return df


def default_order(table: Table, columns: Sequence[str]) -> list[Column]:
    asked = table.sort if table.sort and all(k.lstrip("-") in columns for k in table.sort) else [k.label for k in table.keys]
    return [*sort_keys(asked), *(F.col(k.label).asc_nulls_last() for k in table.keys if k.label not in {a.lstrip("-") for a in asked})]


def others_row(full: DataFrame, top: DataFrame, df: DataFrame, table: Table, period: Period) -> DataFrame:
    """One row for all groups beyond the top: aggregates over their raw rows, so that means and medians are right."""
    (key,) = table.keys
    kept = top.select(F.col(key.label).alias("_top"))
    rest = expanded(df, table, period).join(kept, F.col(KEY.format(0)).eqNullSafe(F.col("_top")), "left_anti")
    row = compared(rest, table, grouped=False)
    for d in table.derive:
        if d.kind == "formula":
            row = formulas.with_formula(row, d.name, d.formula)
        elif d.kind == "rank":
            row = row.withColumn(d.name, F.lit(None).cast("long"))
        else:
            total = full.agg(F.sum(d.column).alias("_total"))
            row = row.join(F.broadcast(total), F.lit(True))
            row = row.withColumn(d.name, formulas.safe_ratio(F.col(d.column), F.col("_total")) if d.kind == "share" else F.col("_total")).drop("_total")
    return row.withColumn(key.label, F.lit(table.others)).select(*full.columns)


def pivoted(df: DataFrame, table: Table) -> DataFrame:
    """Values of one key become columns, in ascending order; with several aggregates, value first."""
    (key,) = [k for k in table.keys if k.label == table.pivot]
    index = [k.label for k in table.keys if k is not key]
    values = [r[0] for r in df.select(key.label).distinct().orderBy(F.col(key.label).asc_nulls_last()).limit(10_001).collect()]
    if len(values) > 10_000:
        raise ValueError(f"more than 10000 columns from {key.label!r}")
    labelled = df.withColumn("_label", bucket_label(F.col(key.label), key.bucket))
    schema = df.select(key.label).schema
    names = [r[0] for r in df.sparkSession.createDataFrame([(v,) for v in values], schema).select(bucket_label(F.col(key.label), key.bucket)).collect()] if values else []
    names = list(dict.fromkeys(names))
    several = len(table.aggregates) > 1
    firsts = [F.first(a.label).alias(a.label) for a in table.aggregates]
    out = labelled.groupBy(*index).pivot("_label", names).agg(*firsts)
    if several:
        out = out.withColumnsRenamed({f"{n}_{a.label}": f"{a.label}_{n}" for n in names for a in table.aggregates})
    return out.orderBy(*(F.col(c).asc_nulls_last() for c in index))


def checked_names(table: Table) -> None:
    """Refuse a specification whose columns would clash, be blank, or begin with _, which is for service columns."""
    names = [x.label for x in (*table.keys, *table.aggregates)]
    names += [f"{a.label}_{c.suffix}{end}" for c in table.compare for a in table.aggregates for end in ("", "_change", "_change_pct")]
    names += [d.name for d in table.derive]
    seen: set[str] = set()
    for name in names:
        if not name.strip() or name.startswith("_"):
            raise ValueError(f"{name!r} cannot be a column's name")
        if name.lower() in seen:
            raise ValueError(f"two columns would be named {name!r}")
        seen.add(name.lower())


def build(df: DataFrame, table: Table, period: Period) -> DataFrame:
    """window -> where -> aggregate -> compare -> pivot, or sort -> derive -> top -> others."""
    checked_names(table)
    rows = source_rows(df, table, period)
    if not table.aggregates:
        out = rows.select(*(table.columns or [c for c in rows.columns if c not in SERVICE]))
        order = sort_keys(table.sort)
        out = derived(out, table.derive, order)
        out = out.orderBy(*order) if order else out
        return out.limit(table.top) if table.top is not None else out
    full = compared(expanded(df, table, period), table) if table.compare else aggregated(rows, table)
    if table.pivot:
        return pivoted(full, table)
    full = derived(full, table.derive, default_order(table, full.columns))
    order = default_order(table, full.columns) or [F.monotonically_increasing_id()]
    if table.top is None:
        return full.orderBy(*order)
    top = full.orderBy(*order).limit(table.top)
    if table.others is None:
        return top
    if len(table.keys) != 1:
        raise ValueError("others needs a single group key")
    label = table.keys[0].label
    as_text = top.withColumn(label, F.col(label).cast("string"))
    return as_text.unionByName(others_row(full, top, df, table, period).withColumn(label, F.lit(table.others)))
