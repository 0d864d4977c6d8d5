"""Which reader a file needs, and what a file holds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources import parsing, profile
from tallybook.sources.delimited import read_text
from tallybook.sources.workbook import read_workbooks

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"delimited": read_text, "workbook": read_workbooks}
EXTENSIONS = {"csv": "delimited", "tsv": "delimited", "txt": "delimited", "xlsx": "workbook", "xlsm": "workbook"}


def reader_of(spark: SparkSession, path: str, format: str | None = None) -> str:
    """The named reader, else by the file's extension, else by its content: workbooks are zip archives."""
    if format is not None:
        if format not in READERS:
            raise ValueError(f"no reader {format!r}; there are {', '.join(READERS)}")
        return format
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    first = spark.read.text(path).select(F.substring(F.col("value").cast("binary"), 1, 4)).first()
    return "workbook" if first is not None and bytes(first[0]) == b"PK\x03\x04" else "delimited"


def read(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """A file as text columns and `_row`, whatever its kind: the contract of all readers."""
    return READERS[reader_of(spark, path, format)](spark, path)


@dataclass(frozen=True)
class Inspection:
    """A file's reader, columns with types, profile rows and first rows."""

    reader: str
    types: dict[str, str]
    profile: list[dict]
    head: list[dict]


def inspect(spark: SparkSession, path: str, format: str | None = None, rows: int = 100) -> Inspection:
    """Types and profile over all rows of the file, and its first rows."""
    reader = reader_of(spark, path, format)
    text = READERS[reader](spark, path)
    types = parsing.infer(text.drop("_row"))
    typed = parsing.typed(text, types)
    return Inspection(reader, types, [r.asDict() for r in profile.profile(typed, list(types)).collect()], [r.asDict() for r in text.orderBy("_row").limit(rows).collect()])
