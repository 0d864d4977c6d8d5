"""Single numbers: aggregates of inputs and tables, SQL, formulas over other metrics, and their comparisons."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import formulas
from tallybook.functions.aggregates import AGGREGATES, Aggregate
from tallybook.functions.periods import Period
from tallybook.functions.windows import span_of, within
from tallybook.operators.datasets import Compare, whole


@dataclass(frozen=True)
class Metric:
    """aggregate of `source` (an input or a table), or a formula over metrics, or a query of one value."""

    aggregate: Aggregate | None = None
    source: str | None = None
    period_column: str | None = None
    window: str | dict = "report_period"
    where: str | None = None
    formula: str | None = None
    query: str | None = None
    compare: Sequence[Compare] = ()


def plain(value: object) -> object:
    """NaN and infinities become None, booleans integers."""
    if isinstance(value, bool):
        return int(value)
    return None if isinstance(value, float) and not math.isfinite(value) else value


def prepared(df: DataFrame, metrics: Mapping[str, Metric], period: Period) -> tuple[DataFrame, list[tuple[str, str, Column, list[str]]]]:
    """df with a mark for each metric's window and condition, and what to aggregate; analysed, so that a wrong name is an
    error before any job."""
    formulas.register(df.sparkSession)
    columns, flagged = [], df
    with formulas.lenient(df.sparkSession):
        for name, m in metrics.items():
            keep = within(m.period_column, span_of(m.window, period)) if m.period_column else F.lit(True)
            if m.where:
                keep = keep & F.expr(formulas.spark_text(m.where))
            flagged = flagged.withColumn(f"_in_{name}", keep)
        for name, m in metrics.items():
            m.aggregate.build()
            value = F.when(F.col(f"_in_{name}"), F.col(m.aggregate.column) if m.aggregate.column else F.lit(1))
            columns.append((name, m.aggregate.fn, value, [c for c in (m.period_column, "_upload_seq", "_row") if c and c in df.columns]))
        flagged.agg(*(AGGREGATES[fn](value, order).alias(name) for name, fn, value, order in columns)).schema
    return flagged, columns


def of_table(df: DataFrame, metrics: Mapping[str, Metric], period: Period) -> DataFrame:
    """One row with all metrics of one source: a single pass, but for medians; each over its own window and condition."""
    flagged, columns = prepared(df, metrics, period)
    with formulas.lenient(df.sparkSession):
        out = whole(flagged, columns)
        out.schema
    return out


def of_formula(spark: SparkSession, text: str, values: Mapping[str, object]) -> object:
    """A formula over metrics, in doubles."""
    row = spark.range(1).select(*(F.lit(v).cast("double").alias(k) for k, v in values.items()))
    return plain(formulas.with_formula(row, "_value", text).first()["_value"])


def of_query(spark: SparkSession, query: str, tables: Mapping[str, DataFrame]) -> object:
    """The single value of a query of one column and at most one row."""
    out = formulas.run_sql(spark, query, dict(tables))
    if len(out.columns) != 1:
        raise ValueError("a metric's query gives one column")
    rows = out.take(2)
    if len(rows) > 1:
        raise ValueError("a metric's query gives one row at most")
    return plain(rows[0][0]) if rows else None


class Metrics:
    """Values by metric and period, each computed once. A metric's query reads `tables`, or what `in_period` cuts for it."""

    def __init__(self, spark: SparkSession, metrics: Mapping[str, Metric], source: Callable[[str], DataFrame], tables: Callable[[], Mapping[str, DataFrame]], in_period: Callable[[Metric, Period], Mapping[str, DataFrame]] | None = None) -> None:
        self.spark, self.metrics, self.source = spark, metrics, source
        self.tables = in_period or (lambda metric, period: tables())
        self.known: dict[tuple[str, Period], object] = {}

    def value(self, name: str, period: Period, path: tuple[str, ...] = ()) -> object:
        if name in path:
            raise ValueError("metrics form a cycle: " + " -> ".join([*path, name]))
        if (name, period) not in self.known:
            m = self.metrics[name]
            if m.formula:
                used = [x for x in self.metrics if x != name and _mentions(m.formula, x)]
                self.known[name, period] = of_formula(self.spark, m.formula, {x: self.value(x, period, (*path, name)) for x in used})
            elif m.query:
                self.known[name, period] = of_query(self.spark, m.query, self.tables(m, period))
            else:  # every other metric of the same source comes along in the same pass
                batch = {x: y for x, y in self.metrics.items() if y.aggregate and y.source == m.source and (x, period) not in self.known}
                try:
                    found = of_table(self.source(m.source), batch, period)
                except Exception:  # one that cannot be analysed keeps no other back
                    batch = {x: y for x, y in batch.items() if x == name or self.analysed(x, y, period)}
                    if not self.analysed(name, m, period):
                        batch = {name: m}
                    found = of_table(self.source(m.source), batch, period)
                row = found.first()
                self.known |= {(x, period): plain(row[x]) for x in batch}
        return self.known[name, period]

    def analysed(self, name: str, metric: Metric, period: Period) -> bool:
        """Whether the metric alone makes a plan; that runs nothing."""
        try:
            prepared(self.source(metric.source), {name: metric}, period)
        except Exception:
            return False
        return True

    def compared(self, name: str, period: Period, kind: str = "previous_period", suffix: str = "prev") -> dict[str, object]:
        """The value, the other period's, their difference and relative change."""
        now, then = self.value(name, period), self.value(name, period.moved(-1) if kind == "previous_period" else period.a_year_before())
        both = now is not None and then is not None
        return {name: now, f"{name}_{suffix}": then, f"{name}_{suffix}_change": now - then if both else None, f"{name}_{suffix}_change_pct": now / then - 1 if both and then else None}


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?<![\w.]){re.escape(name)}(?![\w(])", text) is not None
