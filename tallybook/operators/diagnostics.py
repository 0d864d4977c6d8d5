"""Warnings about data that a report's reader should know of; metadata alone where that is enough."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions import formulas
from tallybook.functions.windows import Span
from tallybook.sources.history import History, gaps, uploads_in
from tallybook.sources.parsing import PARSERS, filled


def coverage_gaps(history: History, spans: Iterable[Span]) -> list[str]:
    """A warning for each span that uploads do not cover, once per span."""
    out = []
    for span in dict.fromkeys(spans):
        for start, stop in gaps(history, span):
            out.append(f"no upload covers {start} to {stop} (exclusive)")
    return out


def absent_columns(history: History, file_columns: dict[str, set[str]], used: Iterable[str], span: Span) -> list[str]:
    """A warning for each upload of the span that lacks used columns."""
    out = []
    for u in uploads_in(history, span):
        if missing := sorted(set(used) - file_columns.get(u.id, set(history.columns))):
            out.append(f"upload {u.id} has no {', '.join(missing)}")
    return out


def filter_effect(before: DataFrame, condition: str) -> DataFrame:
    """One row from one pass: rows before and after, and whether the newest upload has a row left."""
    newest = before.agg(F.max("_upload_seq").alias("_newest"))
    before = formulas.with_formula(before, "_kept", condition)
    keep = F.coalesce("_kept", F.lit(False))
    return before.join(F.broadcast(newest), F.lit(True)).agg(  # one row
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_after"),
        F.coalesce(F.bool_or(keep & (F.col("_upload_seq") == F.col("_newest"))), F.lit(False)).alias("newest_has_rows"),
    )


def cast_losses(text: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row: for each column, how many filled cells a cast would lose."""
    return text.agg(*(F.count_if(filled(F.col(c)) & PARSERS[k](F.col(c)).isNull()).alias(c) for c, k in types.items()))


def empty_nodes(frames: dict[str, DataFrame]) -> list[str]:
    """Names of nodes without a row."""
    return [name for name, df in frames.items() if df.isEmpty()]
