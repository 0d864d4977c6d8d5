"""Ingest: text columns to a typed upload, partitioned by month, with rejects and a verdict, published by one rename."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.periods import month_named
from tallybook.sources import parsing
from tallybook.sources.history import month_of

#: Share of errors in a required column above which an upload needs a review.
MOST_ERRORS = 0.001


@dataclass(frozen=True)
class Ingested:
    """What was written and found, and where it lies: path, or path.held until a review accepts it."""

    rows: int
    rejected: int
    errors: dict[str, int]
    verdict: str
    path: str


def prepare(text: DataFrame, types: Mapping[str, str], upload_id: str, seq: int, period_column: str, fixed_period: str | None = None) -> DataFrame:
    """Typed rows with service columns, `_errors`, `_text` (the text of rows with errors) and `_month` (none for a null period)."""
    original = F.struct(*(F.col(f"`{c}`").alias(c) for c in text.columns))
    typed = parsing.typed(text.withColumn("_text", original), dict(types))
    typed = typed.withColumn("_text", F.when(F.size("_errors") > 0, F.col("_text")))
    if fixed_period:
        typed = typed.withColumn(period_column, F.lit(fixed_period).cast(parsing.SPARK_TYPES[types.get(period_column, "date")]))
    return typed.withColumns({"_upload_id": F.lit(upload_id), "_upload_seq": F.lit(seq).cast("int"), "_month": month_of(period_column)})


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's view of a path, of any file system, and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, partial: str, path: str) -> None:
    """Move a finished folder to its place at once; what is there already is never replaced, as uploads do not change."""
    (source, files), (target, _) = _files(spark, partial), _files(spark, path)
    if files.exists(target):
        raise FileExistsError(f"{path} is there already")
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"{partial} could not be moved to {path}")


def accept(spark: SparkSession, found: Ingested) -> Ingested:
    """Publish an upload that was held for review."""
    path = found.path.removesuffix(".held")
    publish(spark, found.path, path)
    return Ingested(found.rows, found.rejected, found.errors, "ready", path)


def write_upload(text: DataFrame, types: Mapping[str, str], path: str, upload_id: str, seq: int, period_column: str, required: Sequence[str] = (), fixed_period: str | None = None) -> Ingested:
    """Write path/data by month and path/rejects (the original text of rows with errors); texts are parsed once.

    Rows are dealt out by month first, large months over several tasks, so that not every task writes every month.
    Everything is written beside the path first. An upload without faults appears there in one step; one that needs a
    review is held at path.held, where no history sees it, until accept() publishes it.
    """
    spark, partial = text.sparkSession, f"{path}.partial-{uuid4().hex}"
    with parsing.short_methods(spark):
        prepare(text, types, upload_id, seq, period_column, fixed_period).hint("rebalance", "_month").write.partitionBy("_month").option("compression", "zstd").parquet(f"{partial}/data")
    written = spark.read.parquet(f"{partial}/data")
    row = written.agg(F.count(F.lit(1)).alias("_rows"), F.count_if(F.size("_errors") > 0).alias("_rejected")).first()
    wrong = written.where("_text IS NOT NULL") if row["_rejected"] else written.limit(0)
    found = {r[0]: r[1] for r in wrong.select(F.explode("_errors").alias("column")).groupBy("column").count().collect()}
    found = {c: found[c] for c in types if c in found}
    wrong.select("_text.*").write.parquet(f"{partial}/rejects")
    bad = period_column in found and not fixed_period or any(found.get(c, 0) > MOST_ERRORS * row["_rows"] for c in required)
    verdict, where = ("needs_review", f"{path}.held") if bad else ("ready", path)
    publish(spark, partial, where)
    return Ingested(row["_rows"], row["_rejected"], found, verdict, where)


def normal_name(name: str) -> str:
    return re.sub(r"[\W_]+", " ", name.lower()).strip()


def without_months(name: str) -> str:
    """A normalised name with its month words, and the years beside them, as one mark each, so that March meets April."""
    out = ["<month>" if month_named(word) else "<year>" if re.fullmatch(r"20\d\d", word) else word for word in normal_name(name).split()]
    return " ".join(out) if "<month>" in out else ""


def type_likeness(a: str | None, b: str | None) -> float:
    """1 for equal types, half for two kinds of number or of date, and for anything beside text or an unknown type."""
    if a is None or b is None or a == b:
        return 1.0 if a == b else 0.5
    families = ({"int", "float"}, {"date", "datetime"})
    return 0.5 if "string" in (a, b) or any({a, b} <= f for f in families) else 0.0


def value_likeness(a: Sequence[str], b: Sequence[str]) -> float:
    """Share of the shorter list's values that the other has too."""
    if not a or not b:
        return 0.0
    return len({*a} & {*b}) / min(len({*a}), len({*b}))


@dataclass(frozen=True)
class Column:
    """What is known of a column: its name, other names, its type, and some frequent values."""

    name: str
    aliases: Sequence[str] = ()
    kind: str | None = None
    values: Sequence[str] = ()


def likeness(have: Column, want: Column) -> float:
    """Half the likeness of names, a fifth that of types, the rest that of values; names alone if nothing else is known."""
    name = max(SequenceMatcher(None, normal_name(have.name), normal_name(x)).ratio() for x in (want.name, *want.aliases))
    if have.kind is None and want.kind is None and not (have.values and want.values):
        return name
    return 0.5 * name + 0.2 * type_likeness(have.kind, want.kind) + 0.3 * value_likeness(have.values, want.values)


def matched(file_columns: Sequence[Column], expected: Sequence[Column], threshold: float = 0.75) -> dict[str, str | None]:
    """For each expected column the file's: of an equal name, else of one that differs in its month, else the likest left."""
    left, out = list(file_columns), {want.name: None for want in expected}
    for same in (normal_name, without_months):
        for want in expected:
            wanted = {same(x) for x in (want.name, *want.aliases)} - {""}
            if out[want.name] is None and (hit := next((c for c in left if same(c.name) in wanted), None)):
                out[want.name] = hit.name
                left.remove(hit)
    rated = sorted(((likeness(have, want), want.name, have.name) for want in expected if out[want.name] is None for have in left), key=lambda x: (-x[0], x[1], x[2]))
    free = {c.name for c in left}
    for score, want, have in rated:
        if score >= threshold and out[want] is None and have in free:
            out[want] = have
            free.remove(have)
    return out


def reconcile(file_columns: Sequence[str], expected: Mapping[str, Sequence[str]], threshold: float = 0.75) -> dict[str, str | None]:
    """The same from names and aliases alone."""
    return matched([Column(c) for c in file_columns], [Column(n, a) for n, a in expected.items()], threshold)


@dataclass(frozen=True)
class Draft:
    """A suggestion for a new source: ids and types of its columns, and the one that tells the period."""

    columns: dict[str, str]
    types: dict[str, str]
    period_column: str | None


def identifier(name: str) -> str:
    """Small letters, digits and _, beginning with a letter."""
    found = re.sub(r"[\W_]+", "_", name.lower()).strip("_")
    return found if found[:1].isalpha() else f"c_{found}".rstrip("_")


def draft(types: Mapping[str, str]) -> Draft:
    """Ids from the names, made unique; the period is the first date whose name speaks of a day, a date or a period, else the first date."""
    ids: dict[str, str] = {}
    for name in types:
        base = found = identifier(name)
        n = 1
        while found in ids.values():
            n, found = n + 1, f"{base}_{n + 1}"
        ids[name] = found
    dated = [name for name, kind in types.items() if kind in ("date", "datetime")]
    speaking = [name for name in dated if re.search(r"date|day|period|month|дат|день|период|месяц", name.lower())]
    period = next(iter([*speaking, *dated]), None)
    return Draft(ids, {ids[name]: kind for name, kind in types.items()}, ids.get(period))
