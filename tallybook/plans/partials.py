"""Mergeable partial aggregates of uploads, so that a report reads the raw rows of new uploads alone.

Each upload is aggregated once by day and group and stored under a key of the upload, the steps before the table and the
table's keys and aggregates, but not of its window or period. A report puts the days together as the history's policy says,
and is then an ordinary table over days instead of rows: any window, comparison, sorting, top or pivot works on them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import formulas
from tallybook.functions.aggregates import AGGREGATES, Aggregate, Key
from tallybook.functions.periods import Period
from tallybook.operators import datasets
from tallybook.operators.datasets import Table
from tallybook.plans.store import cached, node_key
from tallybook.sources import history

DAY, KEY, PART = "_day", "_key_{}", "_part_{}"
#: Steps that look at one row at a time, so that they may run on each upload alone.
ROW_WISE = ("filter", "select", "rename", "cast", "formula", "sort")
#: Functions whose results differ from run to run.
VOLATILE = re.compile(r"\b(current_\w+|now|today|rand\w*|uuid|shuffle|input_file\w*|monotonically\w*|spark_partition_id)\b", re.I)


def _edge(pick: Callable[[Column], Column]) -> Callable[[Column, Sequence[str]], Column]:
    def part(value: Column, order: Sequence[str]) -> Column:
        keys = [x.alias(f"k{i}") for i, x in enumerate(k for c in order for k in (F.col(c).isNull(), F.col(c)))]
        return pick(F.when(value.isNotNull(), F.struct(*keys, value.alias("value"))))

    return part


#: name -> what is kept of the rows of a day and group; count_distinct and median keep values with their counts instead.
PARTS: dict[str, Callable[[Column, Sequence[str]], Column]] = {
    "sum": lambda v, _: F.sum(v),
    "count": lambda v, _: F.count(v),
    "mean": lambda v, _: F.struct(F.sum(v).alias("sum"), F.count(v).alias("n")),
    "min": lambda v, _: F.min(v),
    "max": lambda v, _: F.max(v),
    "first": _edge(F.min),
    "last": _edge(F.max),
}
BY_VALUE = ("count_distinct", "median")

#: Aggregates over parts, by the names that tables over days use.
MERGED: dict[str, Callable[[Column, Sequence[str]], Column]] = {
    "sum": lambda p, _: F.sum(p),
    "count": lambda p, _: F.coalesce(F.sum(p), F.lit(0)),
    "mean": lambda p, _: F.try_divide(F.sum(p["sum"]), F.sum(p["n"])),
    "min": lambda p, _: F.min(p),
    "max": lambda p, _: F.max(p),
    "first": lambda p, _: F.min(p)["value"],
    "last": lambda p, _: F.max(p)["value"],
    "count_distinct": lambda p, _: F.count_distinct(p["value"]),
    "median": lambda p, _: F.percentile(p["value"], 0.5, p["n"]),
}
AGGREGATES.update({f"merged {name}": merge for name, merge in MERGED.items()})


def mergeable(source: history.History, steps: Sequence[Mapping], table: Table) -> bool:
    """Whether a table's results follow from days of its uploads.

    Not where rows meet rows of other uploads before they are aggregated (merge_dedupe, steps that are not row-wise), where
    the table's days are not the history's, where a formula differs from run to run, or for medians over all groups at
    once, whose values are counted by ranges of raw rows instead. An unknown aggregate or bucket is left to the table itself.
    """
    if not table.aggregates or table.period_column != source.period_column or not source.active:
        return False
    if any(policy == "merge_dedupe" for _, policy in history.effective_policies(source)):
        return False
    if any(a.fn not in MERGED for a in table.aggregates) or any(a.fn == "median" for a in table.aggregates) and (table.others or not table.keys):
        return False
    used = [s for s in steps if s.get("enabled", True)]
    if any(s["type"] not in ROW_WISE for s in used) or VOLATILE.search(json.dumps([used, table.where], default=str)):
        return False
    renamed = {n for s in used for n in (*s.get("names", {}).items(), *s.get("types", {}).items(), (s.get("name"),)) for n in n}
    return source.period_column not in renamed


def by_day(rows: DataFrame, table: Table) -> DataFrame:
    """_day, the table's keys and the parts of its aggregates over rows that have a date.

    An aggregate that needs its values has rows of its own, one for each day, group and value; its part is null elsewhere.
    """
    rows = formulas.filtered(rows, table.where) if table.where else rows
    order = [table.period_column, *(c for c in table.order if c in rows.columns)]
    keys = [KEY.format(i) for i in range(len(table.keys))]
    built = rows.where(F.col(table.period_column).isNotNull()).withColumns({DAY: F.col(table.period_column).cast("date"), **{n: k.build() for n, k in zip(keys, table.keys)}})
    for a in table.aggregates:
        a.build(order)  # a wrong name or a missing column is refused here
    value = lambda a: F.col(a.column) if a.column else F.lit(1)
    parts = [PARTS[a.fn](value(a), order).alias(PART.format(i)) for i, a in enumerate(table.aggregates) if a.fn in PARTS]
    out = [built.groupBy(DAY, *keys).agg(*parts) if parts else built.select(DAY, *keys).distinct()]
    for i, a in enumerate(table.aggregates):
        if a.fn in BY_VALUE:
            counts = built.where(value(a).isNotNull()).groupBy(DAY, *keys, value(a).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
            out.append(counts.select(DAY, *keys, F.struct(F.col("_value").alias("value"), F.col("_n").alias("n")).alias(PART.format(i))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def over_days(table: Table) -> Table:
    """The table as one over stored days."""
    return replace(
        table,
        period_column=DAY,
        keys=[Key(KEY.format(i), k.bucket, k.label) for i, k in enumerate(table.keys)],
        aggregates=[Aggregate(f"merged {a.fn}", PART.format(i), a.label) for i, a in enumerate(table.aggregates)],
        where=None,
        order=(),
    )


def effective_days(spark: SparkSession, store: str, source: history.History, steps: Sequence[Mapping], apply: Callable[[DataFrame], DataFrame], table: Table) -> DataFrame:
    """The days of the effective history; uploads whose days are not stored yet are read, aggregated and stored."""
    used = [s for s in steps if s.get("enabled", True)]
    spec = [used, table.where, [(k.column, k.bucket) for k in table.keys], [(a.fn, a.column) for a in table.aggregates], table.period_column, table.order, source.columns]
    frames = []
    for upload, policy in history.effective_policies(source):
        build = lambda u=upload: by_day(apply(history.read_upload(spark, source, u, None)), table)
        frames.append((cached(spark, store, node_key(spec, "", {upload.id: source.identity(upload)}), build), upload.period, policy))
    return history.resolve(frames, DAY, (), source.policy)


def build(spark: SparkSession, store: str, source: history.History, steps: Sequence[Mapping], apply: Callable[[DataFrame], DataFrame], table: Table, period: Period) -> DataFrame:
    """The table over the effective history, from stored days."""
    datasets.checked_names(table)
    return datasets.build(effective_days(spark, store, source, steps, apply, table), over_days(table), period)
