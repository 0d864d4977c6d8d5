"""Tables shaped for charts and slides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.operators import ordered

# Divisors of display scales.
SCALES = {"one": 1, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}


def series(df: DataFrame, category: str, name: str, value: str, most: int = 200) -> DataFrame:
    """One column for each series, repeats summed, missing pairs 0; blank series are left out."""
    rows = df.where(F.trim(F.col(name).cast("string")) != "")
    names = [r[0] for r in rows.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} series")
    return rows.groupBy(category).pivot(name, names).agg(F.sum(value)).na.fill(0)


def largest_and_others(df: DataFrame, name: str, value: str, limit: int, others: str) -> DataFrame:
    """The limit - 1 largest slices, and one for the rest."""
    top = df.orderBy(F.col(value).desc_nulls_last(), F.col(name)).limit(limit - 1).select(F.col(name).alias("_top"))
    marked = df.join(top, F.col(name).eqNullSafe(F.col("_top")), "left")
    return marked.groupBy(F.coalesce("_top", F.lit(others)).alias(name)).agg(F.sum(value).alias(value))


def scaled(df: DataFrame, column: str, scale: str) -> DataFrame:
    return df.withColumn(column, F.col(column) / F.lit(float(SCALES[scale])))


def heat(df: DataFrame, column: str, name: str = "heat") -> DataFrame:
    """Place of each value between the least (0) and the greatest (1) of all rows; null if they are equal."""
    edges = df.agg(F.min(column).alias("_least"), F.max(column).alias("_most"))
    placed = (F.col(column) - F.col("_least")) / F.nullif(F.col("_most") - F.col("_least"), F.lit(0))
    return df.join(F.broadcast(edges), F.lit(True)).withColumn(name, placed).drop("_least", "_most")  # one row


def first_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(*(F.col(c).desc() for c in order)).limit(n).orderBy(*order)


def with_change(df: DataFrame, column: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Difference and relative change to the row before, of the whole table or of each group of `by`."""
    if by:
        df = df.withColumn("_before", F.lag(column).over(Window.partitionBy(*by).orderBy(*order)))
    else:
        df = ordered.with_previous(df, [F.col(c) for c in order], column, "_before")
    before = F.col("_before")
    return df.withColumns({f"{column}_change": F.col(column) - before, f"{column}_change_pct": F.when(before != 0, F.col(column).cast("double") / before - 1)}).drop("_before")
