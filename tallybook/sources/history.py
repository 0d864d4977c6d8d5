"""Effective history: overlapping uploads resolved at read time, as a lazy union of filtered scans."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.functions.periods import Period, covering
from tallybook.functions.windows import Span, within
from tallybook.operators.steps import dedupe
from tallybook.sources.parsing import SPARK_TYPES

POLICIES = ("replace_period", "replace_all", "merge_dedupe", "append", "ask")


@dataclass(frozen=True)
class Upload:
    """One immutable upload: a Parquet folder, partitioned by month; a larger seq is newer."""

    id: str
    seq: int
    path: str
    period: Period | None = None
    active: bool = True
    policy: str | None = None


@dataclass(frozen=True)
class History:
    """A source's uploads and how overlaps are resolved.

    by_upload: the period comes with the upload, not with its rows. Their period column is the first day of the period that
    the upload declares now, whatever was written, and an upload is read whole or not at all.
    """

    uploads: Sequence[Upload]
    columns: dict[str, str]
    period_column: str
    policy: str = "replace_period"
    keys: Sequence[str] = ()
    by_month: bool = True
    by_upload: bool = False

    def __post_init__(self) -> None:
        if bad := {self.policy, *(u.policy for u in self.uploads if u.policy)} - {*POLICIES}:
            raise ValueError(f"no policy {', '.join(sorted(bad))}")

    @property
    def active(self) -> list[Upload]:
        return sorted((u for u in self.uploads if u.active), key=lambda u: u.seq)

    def identity(self, upload: Upload) -> str:
        """What the rows of an upload depend on."""
        return f"{upload.path} {upload.period.code}" if self.by_upload and upload.period else upload.path


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The source's columns in its types: missing ones null, others cast leniently; service columns as they are."""
    have = dict(df.dtypes)
    service = [F.col(c) for c in ("_upload_id", "_upload_seq", "_row") if c in have]
    return df.select(*((F.col(c).try_cast(SPARK_TYPES[k]) if c in have else F.lit(None).cast(SPARK_TYPES[k])).alias(c) for c, k in columns.items()), *service)


def overlaps(a: Period, b: Period) -> bool:
    return a.start < b.stop and b.start < a.stop


def effective_policies(history: History) -> list[tuple[Upload, str]]:
    """Uploads with the policy of each; `ask` needs a choice for an upload that overlaps an earlier one."""
    out: list[tuple[Upload, str]] = []
    for u in history.active:
        policy = history.policy if history.policy != "ask" else u.policy
        if policy is None:
            if any(u.period and e.period and overlaps(u.period, e.period) for e, _ in out):
                raise ValueError(f"upload {u.id} overlaps earlier ones and has no policy")
            policy = "append"
        out.append((u, policy))
    return out


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def resolve(frames: Sequence[tuple[DataFrame, Period | None, str]], period_column: str, keys: Sequence[str], policy: str) -> DataFrame:
    """Uploads, oldest first, with declared period and policy, to one table.

    replace_period: a later upload takes the place of earlier rows inside its declared period; rows without a date stay.
    replace_all: it takes the place of everything earlier. append: nothing goes. merge_dedupe of the source: the newest
    row of each key; of one upload: its keys take the place of earlier rows of the same keys (nulls are equal).
    """
    if policy == "merge_dedupe":
        if not keys:
            raise ValueError("merge_dedupe needs keys")
        return dedupe(union([f for f, _, _ in frames]), keys, "last")
    start = max((i for i, (_, _, p) in enumerate(frames) if p == "replace_all"), default=0)
    kept: list[DataFrame] = []
    for frame, period, how in frames[start:]:
        if how == "replace_period" and period:
            inside = F.coalesce(within(period_column, (period.start, period.stop)), F.lit(False))
            kept = [f.where(~inside) for f in kept]
        elif how == "merge_dedupe":
            fresh = frame.select(*(F.col(k).alias(f"_new_{k}") for k in keys)).distinct()
            match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
            kept = [f.join(fresh, match, "left_anti") for f in kept]
        kept.append(frame)
    return union(kept)


def read_upload(spark: SparkSession, history: History, upload: Upload, span: Span | None, by_keys: bool = False) -> DataFrame:
    """One upload in the source's shape; whole months outside the span are not listed.

    An upload that works by keys is read whole: a key that it has in another month takes the place of rows inside the span.
    An upload without rows has no files, and is an empty table.
    """
    try:
        df = spark.read.option("mergeSchema", "true").parquet(upload.path)
    except AnalysisException as problem:
        if problem.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        df = spark.createDataFrame([], ", ".join(f"`{c}` {SPARK_TYPES[k]}" for c, k in history.columns.items()) + ", _upload_id string, _upload_seq int, _row long, _month string")
    if history.by_upload:
        df = df.withColumn(history.period_column, F.lit(upload.period.start if upload.period else None))
    if span and "_month" in df.columns and not by_keys and not history.by_upload:
        start, stop = span
        if start is not None:
            df = df.where(F.col("_month") >= f"{start:%Y-%m}")
        df = df.where((F.col("_month") <= f"{stop - timedelta(1):%Y-%m}") & (F.col("_month") != "none"))
    return shaped(df, history.columns)


def history_view(spark: SparkSession, history: History, span: Span | None = None) -> DataFrame:
    """The effective history, inside span if given."""
    uploads = effective_policies(history)
    if span and history.by_upload and not any("merge_dedupe" in (p, history.policy) for _, p in uploads):
        last = max((i for i, (_, p) in enumerate(uploads) if p == "replace_all"), default=0)
        uploads = [x for x in uploads[last:] if x[0].period and meets(x[0].period, span)]
    frames = [(read_upload(spark, history, u, span, "merge_dedupe" in (p, history.policy)), u.period, p) for u, p in uploads]
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} {SPARK_TYPES[k]}" for c, k in history.columns.items()))
    out = resolve(frames, history.period_column, history.keys, history.policy)
    return out.where(within(history.period_column, span)) if span else out


def meets(period: Period, span: Span) -> bool:
    return period.start < span[1] and (span[0] is None or period.stop > span[0])


def uploads_in(history: History, span: Span) -> list[Upload]:
    """Active uploads with a declared period whose rows can be seen inside the span: those that later uploads leave some of
    it, by their declared periods and policies. What goes by keys is known from the rows alone, so such uploads hide none.
    """
    out: list[Upload] = []
    hidden: list[Period] = []
    for u in reversed(history.active):
        policy = history.policy if history.policy != "ask" else u.policy
        left = [(max(u.period.start, span[0] or u.period.start), min(u.period.stop, span[1]))] if u.period else []
        for p in hidden:
            left = [part for a, b in left for part in ((a, min(b, p.start)), (max(a, p.stop), b))]
        if any(a < b for a, b in left):
            out.append(u)
        if policy == "replace_all":
            break
        if policy == "replace_period" and u.period:
            hidden.append(u.period)
    return out[::-1]


def coverage(history: History) -> list[tuple[date, date]]:
    """Declared periods, merged: disjoint [start, stop) in order."""
    out: list[tuple[date, date]] = []
    for p in sorted((u.period for u in history.active if u.period), key=lambda p: p.start):
        if out and p.start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], p.stop))
        else:
            out.append((p.start, p.stop))
    return out


def gaps(history: History, span: Span | None = None) -> list[tuple[date, date]]:
    """What lies between covered spans, or what a span lacks."""
    spans = coverage(history)
    if span is None:
        return [(a[1], b[0]) for a, b in zip(spans, spans[1:])]
    at, out = span[0] or (spans[0][0] if spans else span[1]), []
    for start, stop in spans:
        if start > at and at < span[1]:
            out.append((at, min(start, span[1])))
        at = max(at, stop)
    return [*out, (at, span[1])] if at < span[1] else out


def covered_days(rows: DataFrame, start: str, stop: str, by: Sequence[str] = ()) -> DataFrame:
    """The same merge of [start, stop) rows of dates, of each group of `by`: gaps and islands.

    Spans of equal start are merged first, before the shuffle, so that the windows see one row for each day at most,
    however large the table is.
    """
    days = rows.groupBy(*by, F.col(start).cast("date").alias(start)).agg(F.max(F.col(stop).cast("date")).alias(stop))
    by_start = Window.partitionBy(*by).orderBy(start)
    reach = F.max(stop).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = days.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(by_start))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("_island")


def upload_period(df: DataFrame, period_column: str, unit: str) -> Period | None:
    """The data's first to last date, widened to whole units; several units make a range."""
    first, last = df.agg(F.min(period_column).cast("date"), F.max(period_column).cast("date")).first()
    if first is None:
        return None
    a, b = Period.around(first, unit), Period.around(last, unit)
    return a if a == b else covering(a.start, b.last_day)


def default_report_period(history: History) -> Period | None:
    """The active upload whose period ends last; of equal ones the newest."""
    return max((u for u in history.active if u.period), key=lambda u: (u.period.stop, u.seq), default=Upload("", 0, "")).period


def rows_outside(df: DataFrame, period_column: str, period: Period) -> DataFrame:
    """One row: how many rows have a date outside the declared period."""
    return df.agg(F.count_if(~within(period_column, (period.start, period.stop))).alias("rows_outside"))


def month_of(period_column: str) -> Column:
    return F.coalesce(F.date_format(period_column, "yyyy-MM"), F.lit("none"))
