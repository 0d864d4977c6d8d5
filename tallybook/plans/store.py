"""Tables as files, found again by a key of all that they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def node_key(spec: object, period: str, inputs: Mapping[str, str], version: str = "1") -> str:
    """SHA-256 of a node's specification, period and the keys of what it reads."""
    return hashlib.sha256(json.dumps([version, spec, period, sorted(inputs.items())], sort_keys=True, default=str).encode()).hexdigest()


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has finished writing there, on any file system."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table stored under key, or build()'s, which is stored; what a lost job left behind is written anew."""
    path = f"{folder}/{key}"
    if not complete(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
