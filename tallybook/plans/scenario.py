"""Scenarios: inputs with steps, tables and metrics by name; a failure marks its node and what depends on it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from contextlib import suppress
from dataclasses import dataclass, field
from datetime import date
from graphlib import CycleError, TopologicalSorter
from inspect import signature

from pyspark.sql import DataFrame, SparkSession

from tallybook.functions import formulas
from tallybook.functions.aggregates import Aggregate, Key
from tallybook.functions.periods import Period
from tallybook.functions.windows import span_of, within
from tallybook.operators import datasets, joins, ordered, steps
from tallybook.operators.metrics import Metric, Metrics, plain
from tallybook.plans import partials
from tallybook.sources.history import History, history_view

STEPS: dict[str, Callable[..., DataFrame]] = {
    "filter": lambda df, where=None, conditions=(), combine="and": steps.filter_where(df, where) if where else steps.filter_conditions(df, conditions, combine),
    "time_filter": steps.time_filter,
    "dedupe": steps.dedupe,
    "sort": steps.sort,
    "select": steps.select,
    "rename": steps.rename,
    "cast": steps.cast,
    "formula": steps.formula,
    "join": joins.join,
    "sql": steps.sql,
    "python": steps.python,
}


@dataclass
class Scenario:
    """inputs: name -> {source, steps}; tables and metrics: name -> specification."""

    inputs: Mapping[str, Mapping]
    tables: Mapping[str, Mapping] = field(default_factory=dict)
    metrics: Mapping[str, Mapping] = field(default_factory=dict)


@dataclass
class Status:
    """ok, failed (with its message) or skipped (because of another node)."""

    state: str
    message: str = ""


@dataclass
class Report:
    frames: dict[str, DataFrame]
    values: dict[str, object]
    statuses: dict[str, Status]


def table_of(spec: Mapping) -> datasets.Table:
    """A table specification from plain values."""
    x = dict(spec)
    x.pop("input", None)
    x["keys"] = [Key(**k) if isinstance(k, Mapping) else Key(k) for k in x.get("keys", ())]
    x["aggregates"] = [Aggregate(**a) for a in x.get("aggregates", ())]
    x["compare"] = [datasets.Compare(**c) for c in x.get("compare", ())]
    x["derive"] = [datasets.Derive(**d) for d in x.get("derive", ())]
    return datasets.Table(**x)


def metric_of(spec: Mapping) -> Metric:
    x = dict(spec)
    aggregate = Aggregate(**x.pop("aggregate")) if "aggregate" in x else None
    return Metric(aggregate=aggregate, compare=[datasets.Compare(**c) for c in x.pop("compare", ())], **x)


def problems(scenario: Scenario) -> dict[tuple[str, str], list[str]]:
    """What shows without data, by kind and name of the node."""
    out: dict[tuple[str, str], list[str]] = {}
    note = lambda kind, name, *texts: out.setdefault((kind, name), []).extend(texts) if texts else None
    for name, spec in scenario.inputs.items():
        for step in spec.get("steps", ()):
            if step["type"] not in STEPS:
                note("input", name, f"no step {step['type']!r}")
            if step["type"] == "join" and step["with"] not in scenario.inputs:
                note("input", name, f"no input {step['with']!r} to join with")
            if step["type"] == "python":
                note("input", name, *python_problems(step))
    for name, spec in scenario.tables.items():
        if name in scenario.inputs:
            note("table", name, "an input has the same name")
        if not {"query", "python"} & set(spec) and spec.get("input") not in scenario.inputs:
            note("table", name, f"no input {spec.get('input')!r}")
        if "python" in spec:
            note("table", name, *python_problems(spec))
    for name, spec in scenario.metrics.items():
        if "python" in spec:
            note("metric", name, *python_problems(spec))
        elif "aggregate" in spec and spec.get("source") not in {*scenario.inputs, *scenario.tables}:
            note("metric", name, f"no input or table {spec.get('source')!r}")
        if spec.get("compare") and spec.get("source") in scenario.tables:
            note("metric", name, "a metric of a table is not compared; its table can be")
    return out


def validate(scenario: Scenario) -> list[str]:
    """Problems that show without data."""
    return [f"{kind} {name}: {text}" for (kind, name), texts in problems(scenario).items() for text in texts]


def python_problems(spec: Mapping) -> list[str]:
    """What is wrong with a Python step, table or metric before it runs."""
    mode, function = spec.get("mode", "lazy"), spec.get("function", spec.get("python"))
    try:
        found = steps.function_of(function)
    except (ValueError, ImportError) as problem:
        return [str(problem)]
    least = sum(p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in signature(found).parameters.values())
    if least > 2:
        return [f"the function asks for {least} arguments; it gets a table and a context"]
    return [f"mode {mode} needs a schema"] if mode in ("batches", "table") and "schema" not in spec else []


def build_input(spark: SparkSession, spec: Mapping, sources: Mapping[str, DataFrame], done: Mapping[str, DataFrame], period: Period, watch: Callable[[str, DataFrame], DataFrame] = lambda step, df: df) -> DataFrame:
    """A source with its steps applied; switched-off steps are passed over. `watch` may look at the source and at what each step gives."""
    df = watch("source", sources[spec["source"]])
    for step in spec.get("steps", ()):
        if not step.get("enabled", True):
            continue
        arguments = {k: v for k, v in step.items() if k not in ("type", "enabled", "with")}
        if step["type"] == "join":
            arguments["right"] = done[step["with"]]
        if step["type"] == "time_filter":
            arguments.setdefault("anchor", period.last_day)
        if step["type"] == "dedupe" and "depth" in step:
            arguments.setdefault("unit", period.unit if period.unit != "range" else "month")
            arguments.setdefault("span", (period.start, period.stop))
        if step["type"] == "python":
            arguments["context"] = steps.Context(period, done, spark)
        if step["type"] == "sql":
            arguments["others"] = done
        df = watch(step["type"], STEPS[step["type"]](df, **arguments))
    df.schema  # analysed here, so that a wrong name fails its own node
    return df


def needs_of(spark: SparkSession, scenario: Scenario, broken: dict[str, str]) -> dict[str, set[str]]:
    """For each input and table the nodes it reads. What a query reads is what Catalyst's parser finds in it; a query that
    it cannot parse, or that reads an unknown table, or nodes in a circle, are put into broken."""
    nodes = {n.lower(): n for n in (*scenario.inputs, *scenario.tables)}
    needs = {n: {s["with"] for s in x.get("steps", ()) if s["type"] == "join"} & set(scenario.inputs) for n, x in scenario.inputs.items()}
    for name, spec in scenario.tables.items():
        needs[name] = {spec["input"]} & set(scenario.inputs) if "input" in spec else set()
        if "python" in spec and "input" not in spec:
            needs[name] = set(scenario.inputs)
        if "query" in spec:
            try:
                read = formulas.relations(spark, spec["query"])
            except Exception as problem:
                broken.setdefault(name, str(problem).splitlines()[0])
                continue
            if unknown := sorted(r for r in read if r.lower() not in nodes):
                broken.setdefault(name, f"no table {unknown[0]!r}")
            needs[name] = {nodes[r.lower()] for r in read if r.lower() in nodes}
    while True:
        try:
            TopologicalSorter(needs).prepare()
            return needs
        except CycleError as circle:
            for name in circle.args[1]:
                broken.setdefault(name, "tables form a circle: " + " -> ".join(circle.args[1]))
                needs[name] = set()


def sql_tables(scenario: Scenario, frames: Mapping[str, DataFrame], names: set[str], spec: Mapping, period: Period) -> dict[str, DataFrame]:
    """What a query reads: inputs inside its window (the report period, if it names none) by the period column that it or
    they declare, and finished tables as they are. An input without a period column is read whole."""
    out = {}
    for name in names:
        column = spec.get("period_column") or scenario.inputs.get(name, {}).get("period_column")
        cut = name in scenario.inputs and column in frames[name].columns
        out[name] = frames[name].where(within(column, span_of(spec.get("window") or "report_period", period))) if cut else frames[name]
    return out


def read_again(spark: SparkSession, scenario: Scenario, needs: Mapping[str, set[str]]) -> set[str]:
    """Tables that other tables or metrics read."""
    nodes = {n.lower(): n for n in scenario.tables}
    read = set().union(*(needs[n] for n in scenario.tables), {spec.get("source") for spec in scenario.metrics.values()})
    for spec in scenario.metrics.values():
        if "query" in spec:
            with suppress(Exception):  # one that cannot be parsed fails when it is measured
                read |= {nodes.get(r.lower()) for r in formulas.relations(spark, spec["query"])}
    return read & set(scenario.tables)


def finished(df: DataFrame) -> DataFrame:
    """df computed once, in the checkpoint folder: each reader gets the same values. Sums of doubles differ in their last
    bits from one computation to the next, as they depend on the order in which partial sums arrive."""
    ordered.checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def run(spark: SparkSession, scenario: Scenario, sources: Mapping[str, DataFrame | History], period: Period, store: str | None = None, today: date | None = None) -> Report:
    """Build every node lazily, in order of dependence; metrics are computed, tables wait for their reader, but those that
    other nodes read are computed once.

    A wrong specification fails its own node, and what reads the node is skipped. With a folder for stored partial
    aggregates, tables over a history whose days can be merged read the rows of uploads that are new to it alone. With a
    day, formulas and queries take it for the current date.
    """
    with formulas.run_on(today):
        return built(spark, scenario, sources, period, store)


def built(spark: SparkSession, scenario: Scenario, sources: Mapping[str, DataFrame | History], period: Period, store: str | None) -> Report:
    """The report of run()."""
    histories = {n: s for n, s in sources.items() if isinstance(s, History)}
    sources = {n: history_view(spark, s) if n in histories else s for n, s in sources.items()}
    found = problems(scenario)
    broken = {name: "; ".join(texts) for (kind, name), texts in found.items() if kind != "metric"}
    needs = needs_of(spark, scenario, broken)
    again = read_again(spark, scenario, needs)
    report = Report({}, {}, {})
    for name in TopologicalSorter(needs).static_order():
        if name in broken:
            report.statuses[name] = Status("failed", broken[name])
            continue
        if blocked := sorted(d for d in needs[name] if report.statuses[d].state != "ok"):
            report.statuses[name] = Status("skipped", f"needs {blocked[0]}")
            continue
        try:
            if name in scenario.inputs:
                report.frames[name] = build_input(spark, scenario.inputs[name], sources, report.frames, period)
            elif "python" in (spec := scenario.tables[name]):
                source = report.frames[spec["input"]] if "input" in spec else None
                context = steps.Context(period, {n: report.frames[n] for n in scenario.inputs}, spark)
                made = steps.function_of(spec["python"])
                report.frames[name] = steps.declared(made(source, context) if source is not None else made(context), spec.get("schema"))
            elif "query" in spec:
                report.frames[name] = formulas.run_sql(spark, spec["query"], sql_tables(scenario, report.frames, needs[name], spec, period))
            else:
                made, of = table_of(spec), scenario.inputs[spec["input"]]
                past, before = histories.get(of["source"]), of.get("steps", ())
                if store and past and partials.mergeable(past, before, made):
                    rows_of = lambda rows, of=of: build_input(spark, of, {of["source"]: rows}, {}, period)
                    report.frames[name] = partials.build(spark, store, past, before, rows_of, made, period)
                else:
                    report.frames[name] = datasets.build(report.frames[spec["input"]], made, period)
            if name in again:
                report.frames[name] = finished(report.frames[name])
            report.statuses[name] = Status("ok")
        except Exception as problem:  # a node's failure is its own
            report.frames.pop(name, None)
            report.statuses[name] = Status("failed", str(problem).splitlines()[0])
    measure(spark, scenario, report, period, {name: "; ".join(texts) for (kind, name), texts in found.items() if kind == "metric"})
    return report


def measure(spark: SparkSession, scenario: Scenario, report: Report, period: Period, broken: Mapping[str, str]) -> None:
    """The metrics' values and statuses, with those of their comparisons under names of their own."""
    made: dict[str, Metric] = {}
    for name, spec in scenario.metrics.items():
        try:
            if name in broken:
                raise ValueError(broken[name])
            if "python" not in spec:
                made[name] = metric_of(spec)
        except Exception as problem:
            report.statuses[name] = Status("failed", str(problem).splitlines()[0])

    def read(m: Metric, at: Period) -> dict[str, DataFrame]:
        nodes = {n.lower(): n for n in report.frames}
        read = {nodes[r.lower()] for r in formulas.relations(spark, m.query) if r.lower() in nodes}
        return sql_tables(scenario, report.frames, read, {"period_column": m.period_column, "window": m.window}, at)

    metrics = Metrics(spark, made, lambda n: report.frames[n], lambda: report.frames, read)
    for name, spec in scenario.metrics.items():
        if name in report.statuses and report.statuses[name].state == "failed" and name not in made:
            continue
        try:
            if "python" in spec:
                report.values[name] = plain(steps.function_of(spec["python"])(steps.Context(period, report.frames, spark)))
            else:
                report.values[name] = metrics.value(name, period)
                for c in made[name].compare:
                    report.values |= metrics.compared(name, period, c.kind, c.suffix)
            report.statuses[name] = Status("ok")
        except Exception as problem:
            report.statuses[name] = Status("failed", str(problem).splitlines()[0])
