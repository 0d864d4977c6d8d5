"""Equi-joins of inputs: aligned key types, coalesced keys, suffixes for clashing names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.operators import ordered
from tallybook.operators.steps import SERVICE

NUMBERS = ("int", "bigint", "double")
TIMES = ("date", "timestamp_ntz", "timestamp")


def common_type(a: str, b: str) -> str:
    """date for a date and a datetime, double for two kinds of number; other mixtures are refused."""
    if a == b:
        return a
    if a in NUMBERS and b in NUMBERS:
        return "double" if "double" in (a, b) else "bigint"
    if a in TIMES and b in TIMES:
        return "date"
    raise ValueError(f"keys of types {a} and {b} cannot be joined")


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str], how: str = "left", columns: Sequence[str] | None = None, suffix: str = "_right") -> DataFrame:
    """left joined with right: left, inner, full, semi or anti. Null keys never match; rows may multiply.

    Columns of right: all but its keys and service columns, or the listed ones; a name that left has gets the suffix.
    Spark broadcasts or shuffles by measured size, and splits skewed keys.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {c: c for c in on}
    kinds_l, kinds_r = dict(left.dtypes), dict(right.dtypes)
    picked = [c for c in right.columns if c not in pairs.values() and c not in SERVICE] if columns is None else list(columns)
    kinds = {a: common_type(kinds_l[a], kinds_r[b]) for a, b in pairs.items()}
    other = right.select(
        *(F.col(f"`{b}`").cast(kinds[a]).alias(f"_key_{a}") for a, b in pairs.items()),
        *((F.col(f"`{c}`").alias(f"{c}{suffix}" if c in left.columns else c) for c in picked) if how not in ("semi", "anti") else ()),
    )
    base = left.withColumns({a: F.col(a).cast(k) for a, k in kinds.items() if kinds_l[a] != k})
    if how in ("semi", "anti"):
        condition = [base[a] == other[f"_key_{a}"] for a in pairs]
        return base.join(other, condition, f"left_{how}")
    joined = base.join(other, [base[a] == other[f"_key_{a}"] for a in pairs], {"full": "full_outer"}.get(how, how))
    keys = [F.coalesce(base[c], other[f"_key_{c}"]).alias(c) if c in pairs and how == "full" else base[c] for c in base.columns]
    return joined.select(*keys, *(other[c] for c in other.columns if not c.startswith("_key_")))


def unmatched(left: DataFrame, right: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """One row: left rows without a match, and right keys that occur more than once."""
    pairs = dict(on)
    lost = join(left, right, pairs, "anti").agg(F.count(F.lit(1)).alias("unmatched_rows"))
    twice = right.groupBy(*pairs.values()).count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_keys"))
    return lost.join(F.broadcast(twice), F.lit(True))  # one row each


def as_of(left: DataFrame, right: DataFrame, on: Mapping[str, str], time: tuple[str, str], columns: Sequence[str], suffix: str = "_right") -> DataFrame:
    """left with the columns of right's latest row of the same keys at or before its time; null if there is none.

    Both tables are sorted together by keys and time into ranges: a row of left takes over what the rows before it brought,
    whichever range they are in, so that one key may have any number of rows. Of right's rows of one time the one with the
    greatest columns counts. Null keys and times never match.
    """
    mine, theirs = time
    picked = F.struct(*(F.col(f"`{c}`").alias(c) for c in columns))
    keys = list(on)
    brought = right.where(F.col(theirs).isNotNull()).select(*(F.col(b).alias(f"_key_{a}") for a, b in on.items()), F.col(theirs).alias("_time"), F.lit(0).alias("_mine"), picked.alias("_found"), F.lit(None).cast(left.schema).alias("_row_of_left"))
    asking = left.select(*(F.col(a).alias(f"_key_{a}") for a in keys), F.col(mine).alias("_time"), F.lit(1).alias("_mine"), F.lit(None).cast(brought.schema["_found"].dataType).alias("_found"), F.struct(*left.columns).alias("_row_of_left"))
    both = brought.unionByName(asking)
    known = reduce(lambda a, b: a & b, (F.col(f"_key_{a}").isNotNull() for a in keys), F.col("_time").isNotNull())
    spread = F.xxhash64(*(F.col("_row_of_left")[c] for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind))  # different rows of one time may be any number
    order = [F.col("_time").asc_nulls_first(), F.col("_mine"), F.col("_found"), spread]
    out = ordered.with_last(both.where(known | (F.col("_mine") == 1)), [f"_key_{a}" for a in keys], order, "_found", "_last").where("_mine = 1").withColumn("_last", F.when(known, F.col("_last")))
    return out.select("_row_of_left.*", *(F.col("_last")[c].alias(f"{c}{suffix}" if c in left.columns else c) for c in columns))


def interval_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], point: Column, start: Column, stop: Column, width: float, columns: Sequence[str]) -> DataFrame:
    """Pairs of equal keys whose point of left lies in [start, stop) of right; point, start and stop are numbers.

    The line of numbers is cut into stretches of `width`: an interval is dealt out to each stretch that it touches and
    meets the points there by an equality, which Spark can hash, instead of all rows of its keys. Names must not clash.
    """
    mine = left.withColumn("_stretch", F.floor(point / width)).withColumn("_point", point)
    theirs = right.select(*(F.col(b).alias(f"_key_{a}") for a, b in on.items()), *columns, start.alias("_start"), stop.alias("_stop")).where("_start < _stop")
    theirs = theirs.withColumn("_of", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor(F.col("_stop") / width))))
    match = F.col("_stretch") == F.col("_of")
    for a in on:
        match = match & (mine[a] == theirs[f"_key_{a}"])
    found = mine.join(theirs, match).where("_point >= _start AND _point < _stop")
    return found.select(*(mine[c] for c in left.columns), *columns)
