"""Places, running sums, ranks, neighbours and latest values in a total order of a whole table, without bringing it into one task.

The table is sorted into ranges and checkpointed, as Spark would draw other bounds if it sorted again. Within a range
windows do the work; one row for each range comes to the driver, and what lies before a range is a literal.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RANGE, AT = "_range", "_at"


def checkpoint_folder(session: SparkSession) -> None:
    """Use the folder of spark.checkpoint.dir; one of our own only where it is unset and all runs in one process."""
    context = session.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = session.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    context.setCheckpointDir(folder)


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df sorted, with the number of each row's range and its place in the range, from 1."""
    checkpoint_folder(df.sparkSession)
    at = F.monotonically_increasing_id()
    return df.orderBy(*order).checkpoint().withColumns({RANGE: F.shiftright(at, 33).cast("int"), AT: at.bitwiseAND(F.lit((1 << 33) - 1)) + 1})


def before(ranges: DataFrame, total: Column, kind: str) -> Column:
    """The sum of `total` over all ranges before a row's own."""
    sums = dict(ranges.groupBy(RANGE).agg(total).collect())  # one row for each range
    upto = [0, *accumulate(sums.get(i) or 0 for i in range(max(sums, default=0)))]
    return F.array(*(F.lit(n).cast(kind) for n in upto))[F.col(RANGE)]


def with_place(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Each row's place in the order, from 1."""
    ranges = ranged(df, order)
    return ranges.withColumn(name, F.col(AT) + before(ranges, F.count(F.lit(1)), "long")).drop(RANGE, AT)


def with_running_sum(df: DataFrame, order: Sequence[Column], column: str, name: str) -> DataFrame:
    """The sum of a column up to each row; null where the column is."""
    ranges = ranged(df, order)
    kind = "double" if dict(df.dtypes)[column] in ("double", "float") else "bigint"
    within = F.sum(column).over(Window.partitionBy(RANGE).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn(name, F.when(F.col(column).isNotNull(), within + before(ranges, F.sum(column), kind))).drop(RANGE, AT)


def with_rank(df: DataFrame, by: Column, column: str, name: str) -> DataFrame:
    """The rank with gaps by one sort key; null where the column is.

    Equal keys may fill any number of ranges: of each range the driver learns the last value and where it began, so that
    the next ranges go on with that rank.
    """
    ranges = ranged(df.withColumn("_tie", F.rand(11)), [by, F.col("_tie")]).drop("_tie")
    ranges = ranges.withColumn("_local", F.rank().over(Window.partitionBy(RANGE).orderBy(by)).cast("long"))
    last = F.max_by(F.struct(F.col(column).alias("v"), "_local"), AT).alias("last")
    ends = {r[RANGE]: r for r in ranges.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"), last).collect()}  # one row for each range
    carried, offsets, (value, began), upto = [], [], (None, None), 0
    for i in range(max(ends, default=0) + 1):
        carried.append((value, began))
        offsets.append(upto)
        if i in ends:
            found = ends[i]["last"]
            if began is None or found["v"] != value:
                value, began = found["v"], upto + found["_local"]
            upto += ends[i]["n"]
    kind = dict(df.dtypes)[column]
    of_range = lambda values, kind: F.array(*(F.lit(v).cast(kind) for v in values))[F.col(RANGE)]
    goes_on = F.col(column) == of_range([v for v, _ in carried], kind)
    rank = F.when(goes_on, of_range([b for _, b in carried], "long")).otherwise(F.col("_local") + of_range(offsets, "long"))
    return ranges.withColumn(name, F.when(F.col(column).isNotNull(), rank)).drop(RANGE, AT, "_local")


def median(df: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys and `median`, exactly, of any number of different values: they are counted, the counts summed up in the order
    of keys and values over ranges, and the middle ones picked. No task holds the values of a group."""
    counts = df.select(*keys, value.alias("_value")).where("_value is not null").groupBy(*keys, "_value").agg(F.count(F.lit(1)).alias("_n"))
    upto = with_running_sum(counts, [*(F.col(k).asc_nulls_first() for k in keys), F.col("_value")], "_n", "_upto")
    groups = upto.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.min(F.col("_upto") - F.col("_n")).alias("_start"), F.sum("_n").alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = upto.join(groups, reduce(lambda a, b: a & b, same)) if keys else upto.join(F.broadcast(groups), F.lit(True))  # one row
    covers = lambda place: (F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))
    low, high = (F.col("_start") + F.expr(f"({total}) div 2") for total in ("_total - 1", "_total"))
    picked = joined.where(covers(low) | covers(high)).groupBy(*keys)
    return picked.agg((F.min("_value").cast("double") / 2 + F.max("_value").cast("double") / 2).alias("median"))


def with_previous(df: DataFrame, order: Sequence[Column], column: str, name: str) -> DataFrame:
    """The column's value in the row before."""
    ranges = ranged(df, order)
    kind, last = dict(df.dtypes)[column], F.max_by(F.struct(F.col(column).alias("v")), AT)
    ends = {k: v["v"] for k, v in ranges.groupBy(RANGE).agg(last).collect()}  # one row for each range
    inherited, seen = [], None
    for i in range(max(ends, default=0) + 1):
        inherited.append(seen)
        seen = ends.get(i, seen)
    from_before = F.array(*(F.lit(v).cast(kind) for v in inherited))[F.col(RANGE)]
    lagged = F.lag(column).over(Window.partitionBy(RANGE).orderBy(AT))
    return ranges.withColumn(name, F.when(F.col(AT) == 1, from_before).otherwise(lagged)).drop(RANGE, AT)


def with_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, name: str) -> DataFrame:
    """The column's latest value that is not null, up to each row in the order, among rows of the same keys (nulls are equal).

    One key may fill any number of ranges: the driver learns what each range's last key has brought, and hands it on to
    the ranges in which that key goes on.
    """
    ranges = ranged(df, [*(F.col(k).asc_nulls_first() for k in keys), *order])
    upto = Window.partitionBy(RANGE, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    ranges = ranges.withColumn("_local", F.last(column, ignorenulls=True).over(upto))
    ends = {r[RANGE]: r["last"] for r in ranges.groupBy(RANGE).agg(F.max_by(F.struct(F.struct(*keys).alias("k"), "_local"), AT).alias("last")).collect()}  # one row for each range
    same = lambda a, b: all(x == y or (x != x and y != y) for x, y in zip(a, b, strict=True))
    carried, state = [], None
    for i in sorted(ends):
        if state is not None:
            carried.append((i, *state))
        key, found = ends[i]["k"], ends[i]["_local"]
        if found is not None or state is None or not same(state[0], key):
            state = (key, found)
    end = ranges.select(F.struct(*keys).alias("_of"), F.col("_local").alias("_carried")).schema
    before = df.sparkSession.createDataFrame(carried, StructType([StructField("_before", IntegerType()), *end]))
    goes_on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col("_of")[k]) for k in keys), F.col("_before").isNotNull())
    joined = ranges.join(F.broadcast(before), F.col(RANGE) == F.col("_before"), "left")  # one row for each range
    return joined.withColumn(name, F.coalesce("_local", F.when(goes_on, F.col("_carried")))).drop(RANGE, AT, "_local", "_before", "_of", "_carried")
