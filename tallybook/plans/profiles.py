"""Mergeable profiles of uploads: sketches by month, stored once and put together as the history's policy says.

A source's profile reads no rows of uploads that are stored already, but those of a month that a later upload's declared
period replaces in part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.periods import Period
from tallybook.functions.windows import Span, within
from tallybook.plans.store import cached, node_key
from tallybook.sources import history

#: Bits of a distinct sketch (a standard error of 0.8 %), and how many values frequent items track.
BITS, TRACKED = 14, 10_000
QUARTERS = (0.25, 0.5, 0.75)
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def number(column: str, kind: str) -> Column:
    """A number or a date as a double, dates by their day or second; null for other types."""
    if kind in NUMBERS or kind.startswith("decimal"):
        return F.col(column).cast("double")
    if kind == "date":
        return F.unix_date(column).cast("double")
    return F.unix_seconds(F.col(column).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.lit(None).cast("double")


def by_month(rows: DataFrame, period_column: str, columns: Sequence[str]) -> DataFrame:
    """_month and, for each column, its rows, nulls and extremes, and sketches of different values, frequent ones and quantiles."""
    kinds = dict(rows.dtypes)
    parts = []
    for i, c in enumerate(columns):
        text = F.col(c).cast("string")
        sketches = [
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(c).isNull()).alias("nulls"),
            F.min(c).alias("least"),
            F.max(c).alias("greatest"),
            F.hll_sketch_agg(text, BITS).alias("values"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("frequent"),
            F.kll_sketch_agg_double(number(c, kinds[c])).alias("quantiles"),
        ]
        parts.append(F.struct(*sketches).alias(f"_of_{i}"))
    return rows.groupBy(history.month_of(period_column).alias("_month")).agg(*parts)


def merged(months: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """column, rows, nulls, distinct_values, least, greatest, quarters, common: one row for each column.

    Extremes are exact and as text; distinct_values is within a few percent; quarters (of numbers, and of dates as days or
    seconds since 1970) are within about a hundredth of the rows; common are the n values that occur most often, with counts that are exact up
    to TRACKED different ones. Without rows there is no profile.
    """
    out = []
    for i, c in enumerate(columns):
        part = lambda name, i=i: F.col(f"_of_{i}.{name}")
        quantiles = F.kll_merge_agg_double(part("quantiles"))
        known = F.kll_sketch_get_n_double(quantiles) > 0
        out.append(
            F.struct(
                F.lit(c).alias("column"),
                F.sum(part("rows")).alias("rows"),
                F.sum(part("nulls")).alias("nulls"),
                F.hll_sketch_estimate(F.hll_union_agg(part("values"))).alias("distinct_values"),
                F.min(part("least")).cast("string").alias("least"),
                F.max(part("greatest")).cast("string").alias("greatest"),
                F.when(known, F.kll_sketch_get_quantile_double(quantiles, F.array(*map(F.lit, QUARTERS)))).alias("quarters"),
                F.filter(F.call_function("approx_top_k_estimate", F.call_function("approx_top_k_combine", part("frequent")), F.lit(n)), lambda x: x["item"].isNotNull()).alias("common"),
            )
        )
    # grouped by a constant: Spark cannot combine the frequent items of a partition without rows, of which only a grouped aggregation makes none
    return months.groupBy(F.lit(0).alias("_all")).agg(F.array(*out).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def cut_months(periods: Sequence[Period]) -> set[str]:
    """Months that a period covers only in part."""
    return {f"{day:%Y-%m}" for p in periods for day in (p.start, p.stop) if day.day != 1}


def month_span(month: str) -> Span:
    found = Period.read(month)
    return found.start, found.stop


def effective_months(spark: SparkSession, store: str, source: history.History, columns: Sequence[str]) -> DataFrame:
    """Sketches of the effective history; uploads that have none yet are read and theirs stored. merge_dedupe, which
    decides by rows, is refused."""
    uploads = history.effective_policies(source)
    if any(policy == "merge_dedupe" for _, policy in uploads):
        raise ValueError("uploads that replace rows by keys have no profile without their rows")
    start = max((i for i, (_, policy) in enumerate(uploads) if policy == "replace_all"), default=0)
    frames = []
    for i, (upload, _) in enumerate(uploads[start:], start):
        build = lambda u=upload: by_month(history.read_upload(spark, source, u, None), source.period_column, columns)
        spec = ["profile", BITS, TRACKED, list(columns), source.columns, source.period_column]
        months = cached(spark, store, node_key(spec, "", {upload.id: source.identity(upload)}), build)
        later = [u.period for u, policy in uploads[i + 1 :] if policy == "replace_period" and u.period]
        cut = sorted(cut_months(later))
        gone = [(F.col("_month") >= f"{p.start:%Y-%m}") & (F.col("_month") < f"{p.stop:%Y-%m}") & (F.col("_month") != "none") for p in later]
        frames.append(months.where(~reduce(lambda a, b: a | b, gone, F.col("_month").isin(cut))))
        if cut:  # the rows that are left of those months
            rows = history.union([history.read_upload(spark, source, upload, month_span(m)) for m in cut])
            left = reduce(lambda df, p: df.where(~within(source.period_column, (p.start, p.stop))), later, rows)
            frames.append(by_month(left.where(history.month_of(source.period_column).isin(cut)), source.period_column, columns))
    return history.union(frames)


def profile(spark: SparkSession, store: str, source: history.History, columns: Sequence[str] | None = None) -> DataFrame:
    """The profile of a source's effective history, of all its columns or the given ones."""
    asked = list(source.columns if columns is None else columns)
    return merged(effective_months(spark, store, source, asked), asked)
