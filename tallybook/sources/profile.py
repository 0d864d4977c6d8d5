"""Column profiles in one pass, and pair-keeping samples for previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows up to which distinct values are counted exactly, where a profile is not told; an exact count of every column
#: of a large table would shuffle each row once for each column.
EXACT_ROWS = 1_000_000
#: Bits of the sketch behind other counts, whose standard error is 0.8 %.
BITS = 14


def about_distinct(c: str) -> Column:
    """How many different values a column has, within 3 % but for a probability of 2e-4; nulls are none."""
    return F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)), BITS))


def profile(df: DataFrame, columns: Sequence[str], exact: bool | None = None) -> DataFrame:
    """column, rows, nulls, distinct_values, least, greatest: one row for each column, from a single aggregation.

    distinct_values is exact or that of about_distinct, as asked; by default exact for EXACT_ROWS rows and fewer.
    """
    if exact is None:
        exact = df.limit(EXACT_ROWS + 1).count() <= EXACT_ROWS
    distinct = F.count_distinct if exact else about_distinct
    aggs = [
        F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), distinct(c).alias("distinct_values"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"))
        for c in columns
    ]
    return df.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def most_common(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The n most frequent values; of equal ones the smallest."""
    return df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), F.asc(column)).limit(n)


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """64 bits that are equal for equal keys in every table: of numbers whatever their types, of a date and a timestamp of
    its day, and of nulls."""
    kinds = dict(df.dtypes)

    def comparable(c: str) -> Column:
        if kinds[c].startswith("timestamp"):
            return F.col(c).cast("date").cast("string")
        number = kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")
        return F.col(c).cast("double") + F.lit(0.0) if number else F.col(c).cast("string")

    # nulls leave a hash as it was, which would be the seed, the least of all, for keys of nulls alone
    return F.xxhash64(F.lit("key"), *map(comparable, keys))


def sampled(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """About 1 / k of the rows; rows of equal keys stay together, in every table that is sampled by the same keys."""
    return df.where(F.pmod(key_hash(df, keys), F.lit(k)) == 0)


def newest_only_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """Values that occur in the newest upload alone."""
    seen = df.groupBy(column).agg(F.min("_upload_seq").alias("_first"))
    latest = df.agg(F.max("_upload_seq").alias("_latest"))
    return seen.join(F.broadcast(latest), F.col("_first") == F.col("_latest")).select(column).orderBy(column).limit(n)
