"""Stored, mergeable samples of uploads, so that a preview reads no rows of uploads that were sampled before.

Each upload keeps its rows of the smallest key hashes, as many as a target allows, once. Hashes are of the key alone: samples
of all uploads and of all tables that join by the key hold the same keys, once they are cut at the least hash that all of
them reach. Duplicates and join pairs so stay together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.plans.store import cached, node_key
from tallybook.sources import history
from tallybook.sources.profile import key_hash

#: Places on the logarithmic scale of hashes for each halving: a cut misses its target by about a hundredth at most.
HALVING = 64
PLACE, UPTO, STANDS_FOR = "_place", "_upto", "_stands_for"


def place(df: DataFrame, keys: Sequence[str]) -> Column:
    """Where a row's key lies on the scale: 0 for the upper end of all hashes, HALVING less for each halving of their range."""
    share = (key_hash(df, keys).bitwiseAND(F.lit((1 << 63) - 1)).cast("double") + 1) / float(1 << 63)
    return F.floor(F.log2(share) * HALVING).cast("int")


def rate(upto: int) -> float:
    """The share of keys up to a place."""
    return min(1.0, 2 ** ((upto + 1) / HALVING))


def cut(counts: Mapping[int, int], target: int) -> int:
    """The last place up to which there are at most target rows; the first one that has rows, if it alone has more."""
    rows = 0
    for at in sorted(counts):
        if rows and rows + counts[at] > target:
            return at - 1
        if counts[at] > target:
            return at
        rows += counts[at]
    return 0


def taken(rows: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """The rows of the smallest hashes, with their places, the last place that is whole, and how many rows each stands for.

    Rows of one key stay together, so a key of more than target rows makes the sample larger if it comes first, and ends it
    otherwise. The counts that the cut is found in are at most 64 * HALVING, however many rows there are.
    """
    placed = rows.withColumn(PLACE, place(rows, keys))
    counts = {r[PLACE]: r["count"] for r in placed.groupBy(PLACE).count().collect()}
    upto = cut(counts, target)
    size = sum(n for at, n in counts.items() if at <= upto)
    marked = placed.where(F.col(PLACE) <= upto).withColumns({UPTO: F.lit(upto), STANDS_FOR: F.lit(sum(counts.values()) / max(1, size))})
    return marked.hint("rebalance").sortWithinPartitions(PLACE)


def suits(source: history.History, keys: Sequence[str]) -> bool:
    """Whether the effective history of samples is the sample of the effective history: not where rows replace others by
    keys that the sample's key is no part of, nor where the key is not a column."""
    replaces = any(policy == "merge_dedupe" for _, policy in history.effective_policies(source))
    return bool(source.active and keys) and set(keys) <= set(source.columns) and (not replaces or set(keys) <= set(source.keys))


def stored(spark: SparkSession, store: str, source: history.History, keys: Sequence[str], target: int) -> list[tuple[DataFrame, history.Upload, str]]:
    """The samples of a source's uploads with the policy of each; those that are not stored yet are taken and stored."""
    out = []
    for upload, policy in history.effective_policies(source):
        build = lambda u=upload: taken(history.read_upload(spark, source, u, None), keys, target)
        key = node_key(["sample", list(keys), target, HALVING, source.columns], "", {upload.id: source.identity(upload)})
        out.append((cached(spark, store, key, build), upload, policy))
    return out


@dataclass
class Sampled:
    """Tables cut at one place, the share of keys that they hold, and by how much, of known rows, they miss the most."""

    tables: dict[str, DataFrame]
    rate: float
    error: float


def joint(spark: SparkSession, store: str, sources: Mapping[str, history.History | DataFrame], keys: Mapping[str, Sequence[str]], target: int) -> Sampled:
    """Samples of several sources that hold the same keys: at most target rows each, but for keys of more.

    A DataFrame, and a history that its samples do not suit, is cut at the same place, but read whole; one without keys is
    not cut.
    """
    found = {n: stored(spark, store, s, keys[n], target) for n, s in sources.items() if isinstance(s, history.History) and suits(s, keys[n])}
    counts: dict[str, dict[int, int]] = {n: {} for n in found}
    known, upto = dict.fromkeys(found, 0.0), 0
    parts = [df.select(F.lit(n).alias("name"), PLACE, UPTO, STANDS_FOR) for n, frames in found.items() for df, _, _ in frames]
    if parts:
        for r in reduce(DataFrame.unionAll, parts).groupBy("name", PLACE).agg(F.count(F.lit(1)).alias("n"), F.sum(STANDS_FOR).alias("known"), F.min(UPTO).alias("upto")).collect():
            counts[r["name"]][r[PLACE]] = r["n"]
            known[r["name"]] += r["known"]
            upto = min(upto, r["upto"])
    upto = min([upto, *(cut(c, target) for c in counts.values())])
    tables, error = {}, 0.0
    for n, s in sources.items():
        if n in found:
            frames = [(df.where(F.col(PLACE) <= upto).drop(PLACE, UPTO, STANDS_FOR), upload.period, policy) for df, upload, policy in found[n]]
            tables[n] = history.resolve(frames, s.period_column, s.keys, s.policy)
            if known[n]:
                error = max(error, abs(sum(c for at, c in counts[n].items() if at <= upto) / rate(upto) / known[n] - 1))
        else:
            whole = history.history_view(spark, s) if isinstance(s, history.History) else s
            tables[n] = whole.where(place(whole, keys[n]) <= upto) if upto < 0 and keys[n] and set(keys[n]) <= set(whole.columns) else whole
    return Sampled(tables, rate(upto), error)
