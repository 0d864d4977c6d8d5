"""Previews: large inputs are sampled by a key that keeps duplicates and join pairs together; counts are scaled back."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.periods import Period
from tallybook.plans import samples
from tallybook.plans.scenario import Scenario, build_input
from tallybook.sources.history import History
from tallybook.sources.profile import sampled

#: Inputs above LARGE rows are sampled down to about TARGET.
LARGE, TARGET = 500_000, 200_000


def rate(rows: int, large: int | None = None) -> int:
    """1 in how many rows: 1 for inputs that are small enough."""
    return 1 if rows <= (LARGE if large is None else large) else max(2, ceil(rows / TARGET))


def sample_key(scenario: Scenario, name: str) -> Sequence[str]:
    """The columns that joins and deduplications of an input share; else all that the first of them uses."""
    used = []
    for step in scenario.inputs[name].get("steps", ()):
        if step["type"] == "join":
            used.append(list(step["on"]) if not isinstance(step["on"], Mapping) else list(step["on"].keys()))
        elif step["type"] == "dedupe" and step.get("by"):
            used.append(list(step["by"]))
    if not used:
        return ()
    shared = [c for c in used[0] if all(c in u for u in used)]
    return shared or used[0]


@dataclass
class StepCount:
    """Rows after a step; about, if the input was sampled: error is by which share its sample missed rows that are known."""

    step: str
    rows: int
    exact: bool
    error: float = 0.0


def row_counts(frames: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of several tables, by one job."""
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name, df in frames.items()]
    return {r["name"]: r["rows"] for r in reduce(DataFrame.unionAll, counts).collect()}


def step_counts(spark: SparkSession, spec: Mapping, sources: Mapping[str, DataFrame], done: Mapping[str, DataFrame], period: Period) -> list[tuple[str, int]]:
    """(step, rows after it) for the source and each step of an input: one job, whose rows are observed on their way.

    A sort step changes no count and is passed over, as Spark reads what it sorts twice to find ranges. Where a query or a
    function sorts by itself, the tables after each step are counted side by side instead.
    """
    seen: list[tuple[str, Observation, DataFrame]] = []

    def watch(step: str, df: DataFrame) -> DataFrame:
        seen.append((step, Observation(), df))
        return df.observe(seen[-1][1], F.count(F.lit(1)).alias("rows"))

    unsorted = [s for s in spec.get("steps", ()) if s["type"] != "sort"]
    out = build_input(spark, {**spec, "steps": unsorted}, sources, done, period, watch)
    if re.search(r"Sort \[.*\], true", out._jdf.queryExecution().optimizedPlan().toString()):
        seen.clear()
        build_input(spark, {**spec, "steps": unsorted}, sources, done, period, lambda step, df: seen.append((step, None, df)) or df)
        found = row_counts({str(i): df for i, (*_, df) in enumerate(seen)})
        counts = [found[str(i)] for i in range(len(seen))]
    else:
        out.write.format("noop").mode("overwrite").save()
        counts = [observed.get["rows"] for _, observed, _ in seen]
    left, result = iter(zip([step for step, *_ in seen], counts, strict=True)), []
    for step in ["source", *(s["type"] for s in spec.get("steps", ()) if s.get("enabled", True))]:
        result.append((step, result[-1][1]) if step == "sort" else next(left))
    return result


def shared_columns(scenario: Scenario, name: str, sources: Mapping[str, DataFrame | History]) -> dict[str, list[str]]:
    """For an input and those that it joins, the columns of each one's source that samples are taken by; none where a source
    is needed whole, as a join is not by the sample's key or an earlier step made the key."""
    columns = list(sources[scenario.inputs[name]["source"]].columns)
    keys = list(sample_key(scenario, name))
    known = bool(keys) and set(keys) <= set(columns)
    out = {name: keys if known else columns}
    for step in scenario.inputs[name].get("steps", ()):
        if step["type"] == "join":
            on = step["on"] if isinstance(step["on"], Mapping) else {c: c for c in step["on"]}
            out[step["with"]] = [on[c] for c in keys] if known and set(keys) <= set(on) else []
    return out


def stored_preview(spark: SparkSession, scenario: Scenario, sources: Mapping[str, DataFrame | History], name: str, period: Period, store: str, limit: int = 100, target: int | None = None) -> tuple[list[dict], list[StepCount]]:
    """The same preview from samples of uploads that are stored once, of at most target rows each (TARGET).

    The rows of a source are estimated too. An input that joins one which lacks the sample's columns gets all rows of it.
    Two inputs of one source are sampled apart.
    """
    spec, keys = scenario.inputs[name], shared_columns(scenario, name, sources)
    of = {n: sources[scenario.inputs[n]["source"]] for n in keys}
    found = samples.joint(spark, store, of, keys, TARGET if target is None else target)
    parts = {n: {**scenario.inputs[n], "source": n} for n in keys}
    done = {n: build_input(spark, parts[n], found.tables, {}, period) for n in keys if n != name}
    exact = found.rate == 1
    counted = step_counts(spark, parts[name], found.tables, done, period)
    counts = [StepCount(step, round(n / found.rate), exact, found.error) for step, n in counted]
    out = build_input(spark, {**spec, "source": name}, found.tables, done, period)
    return [r.asDict() for r in out.limit(limit).collect()], counts


def preview(spark: SparkSession, scenario: Scenario, sources: Mapping[str, DataFrame], name: str, period: Period, limit: int = 100, large: int | None = None) -> tuple[list[dict], list[StepCount]]:
    """The first rows of an input after its steps, and the rows after each step; inputs above `large` rows (LARGE) are sampled."""
    needed = {name, *(s["with"] for s in scenario.inputs[name].get("steps", ()) if s["type"] == "join")}
    rows = row_counts({n: sources[scenario.inputs[n]["source"]] for n in sorted(needed)})
    k, keys = max(rate(n, large) for n in rows.values()), sample_key(scenario, name)
    small = dict(sources)
    if k > 1:
        for n in needed:
            source = scenario.inputs[n]["source"]
            on = keys or sources[source].columns
            pairs = next((s["on"] for s in scenario.inputs[name].get("steps", ()) if s["type"] == "join" and s["with"] == n), None)
            if n != name and isinstance(pairs, Mapping):
                on = [pairs.get(c, c) for c in on]
            small[source] = sampled(sources[source], on, k) if set(on) <= set(sources[source].columns) else sources[source]
    done = {n: build_input(spark, scenario.inputs[n], small, {}, period) for n in needed - {name}}
    spec = scenario.inputs[name]
    counted = step_counts(spark, spec, small, done, period)
    counts = [StepCount("source", rows[name], True), *(StepCount(step, n * k, k == 1) for step, n in counted[1:])]
    out = build_input(spark, spec, small, done, period)
    return [r.asDict() for r in out.limit(limit).collect()], counts
