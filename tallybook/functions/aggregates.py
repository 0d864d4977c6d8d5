"""The aggregates and group keys of report tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edge(pick: Callable[[Column, Column], Column]) -> Callable[[Column, Sequence[str]], Column]:
    def aggregate(value: Column, order: Sequence[str]) -> Column:
        # null order keys come last, in either direction of reading
        keys = [k for c in order for k in (F.col(c).isNull(), F.col(c))]
        return pick(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.struct(*keys)))

    return aggregate


#: name -> column of (value, order). first and last take the first and last non-null value in the order.
AGGREGATES: dict[str, Callable[[Column, Sequence[str]], Column]] = {
    "sum": lambda v, _: F.sum(v),
    "count": lambda v, _: F.count(v),
    "count_distinct": lambda v, _: F.count_distinct(v),
    "mean": lambda v, _: F.avg(v),
    "min": lambda v, _: F.min(v),
    "max": lambda v, _: F.max(v),
    "median": lambda v, _: F.median(v),
    "first": _edge(F.min_by),
    "last": _edge(F.max_by),
}
BUCKETS = ("day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Aggregate:
    """fn over a column (count: over rows, without one), named `name` or fn_column."""

    fn: str
    column: str | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or (f"{self.fn}_{self.column}" if self.column else self.fn)

    def build(self, order: Sequence[str] = ()) -> Column:
        if self.fn not in AGGREGATES:
            raise ValueError(f"unknown aggregate {self.fn!r}")
        if self.column is None and self.fn != "count":
            raise ValueError(f"{self.fn} needs a column")
        return AGGREGATES[self.fn](F.col(self.column) if self.column else F.lit(1), order).alias(self.label)


@dataclass(frozen=True)
class Key:
    """A group key: a column, or its date bucket."""

    column: str
    bucket: str | None = None
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or (f"{self.column}_{self.bucket}" if self.bucket else self.column)

    def build(self) -> Column:
        if self.bucket is None:
            return F.col(self.column).alias(self.label)
        if self.bucket not in BUCKETS:
            raise ValueError(f"unknown bucket {self.bucket!r}")
        return F.date_trunc(self.bucket, self.column).cast("date").alias(self.label)


def bucket_label(value: Column, bucket: str | None) -> Column:
    """Text of a key's value: 2026-01, 2026-Q1, 2026, 2026-W05, an ISO date, or the value; null is empty."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), value).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(value).cast("string"), 2, "0"))
    quarter = F.concat(F.year(value).cast("string"), F.lit("-Q"), F.quarter(value).cast("string"))
    text = {"month": lambda: F.date_format(value, "yyyy-MM"), "quarter": lambda: quarter, "year": lambda: F.year(value).cast("string"), "week": lambda: week}
    return F.coalesce(text.get(bucket or "", lambda: value.cast("string"))(), F.lit(""))
