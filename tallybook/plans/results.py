"""Results as files, reused while nothing that they depend on has changed; scenarios as YAML."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallybook.plans.scenario import Report, Scenario
from tallybook.plans.store import cached, node_key  # noqa: F401  found here by callers


def write_report(report: Report, folder: str) -> None:
    """Tables as Parquet, metrics and statuses as JSON."""
    for name, df in report.frames.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
    text = json.dumps({"metrics": report.values, "statuses": {n: vars(s) for n, s in report.statuses.items()}}, default=str)
    spark = next(iter(report.frames.values())).sparkSession if report.frames else SparkSession.getActiveSession()
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_metrics")


def to_arrow(df: DataFrame, most_rows: int = 100_000):
    """A finished table as Arrow, for a renderer; refused above most_rows, as it comes to the driver."""
    table = df.limit(most_rows + 1).toArrow()
    if table.num_rows > most_rows:
        raise ValueError(f"more than {most_rows} rows for a renderer")
    return table


def export_one_file(df: DataFrame, path: str) -> None:
    """One Parquet file, for a reader outside; goes through one task."""
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_scenario(path: str) -> Scenario:
    """A scenario from YAML with the keys inputs, tables and metrics."""
    import yaml

    found = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    if unknown := set(found) - {"inputs", "tables", "metrics"}:
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    return Scenario(found.get("inputs", {}), found.get("tables", {}), found.get("metrics", {}))
