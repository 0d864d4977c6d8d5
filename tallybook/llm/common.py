"""What the operators of this package share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the class [\x20\x09-\x0D], as a Java and DuckDB pattern.
SPACE_RUN = "[ \\t-\\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table `documents` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id and text alone, null texts as empty ones; other columns of any name stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes to clash with no column of df in either letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def besides(df: DataFrame, *replaced: str) -> list[str]:
    """df's columns but those that an operator replaces, whatever their letter case."""
    gone = {r.lower() for r in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def quoted(names: list[str]) -> list[Column]:
    """Columns by name, dots and other marks included."""
    return [F.col(f"`{n.replace('`', '``')}`") for n in names]


def schema_of(df: DataFrame, names: list[str]) -> str:
    """DDL of the named columns of df."""
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n.replace('`', '``')}` {kinds[n]}" for n in names)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset and all runs in one process."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Materialise df as a Parquet table in the shared folder, and where: later readers take the columns they need alone."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame) -> DataFrame:
    return stored_at(df)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def single_spaced(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")
