"""Delimited exports: encoding, quotes, delimiter and header are probed through Spark; every column arrives as text.

The probe of a file is one distributed pass over its lines as bytes, so a stray byte or quote anywhere in it is seen.
Files are read in splits, those with line ends inside quotes too (records.py); rows are numbered by file and split, in the
files' order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.sources.records import records

DELIMITERS = (";", "\t", "|", ",")
#: Records in which the header is looked for, and lines that are fetched to see them.
HEAD_ROWS, HEAD_LINES = 30, 60
#: Bytes of a line that the probe of the head looks at.
HEAD_BYTES = 64 * 1024


@dataclass(frozen=True)
class Layout:
    """How to read a file: encoding, delimiter, records above the header, its names, and if quotes hold line ends."""

    encoding: str
    delimiter: str
    skipped: int
    names: Sequence[str]
    quoted_lines: bool = False


def split_line(line: str, delimiter: str) -> list[str]:
    """Fields of a line; delimiters inside double quotes do not split."""
    pattern = re.compile(rf'"((?:[^"]|"")*)"(?={re.escape(delimiter)}|$)|([^{re.escape(delimiter)}]*)(?={re.escape(delimiter)}|$)')
    out, at = [], 0
    while at <= len(line):
        m = pattern.match(line, at)
        if not m:
            break
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end() + 1
    return out


def delimiter_of(lines: Sequence[str]) -> str:
    """The delimiter by which most lines have the same number of fields, more than one."""

    def agreeing(d: str) -> int:
        widths = Counter(n for line in lines if (n := len(split_line(line, d))) > 1)
        return max(widths.values(), default=0)

    return max(DELIMITERS, key=agreeing)


def header_row(rows: Sequence[Sequence[str]]) -> int:
    """The first row of the common width whose filled cells are mostly words."""
    width = Counter(len(r) for r in rows).most_common(1)[0][0]
    for i, row in enumerate(rows[:HEAD_ROWS]):
        filled = [c for c in row if c.strip()]
        if len(row) >= width and len(filled) > len(row) / 2 and sum(bool(re.search(r"[^\W\d]", c)) for c in filled) > len(filled) / 2:
            return i
    return 0


def unique_names(names: Sequence[str]) -> list[str]:
    """Blank names become column N, repeated ones get (2), (3) behind."""
    out: list[str] = []
    for i, name in enumerate(names, 1):
        base = re.sub(r"\s+", " ", name).strip() or f"column {i}"
        n, found = 1, base
        while found in out:
            n, found = n + 1, f"{base} ({n + 1})"
        out.append(found)
    return out


def numbered(rows: DataFrame, name: str = "_row") -> DataFrame:
    """Rows of files with their place from 0, in the order of file names and of the splits inside a file.

    rows has `_file`, `_block` (where its split begins) and `_id` (monotonically_increasing_id, so that the rows of a
    split follow each other). The number of splits decides how much is joined, not the number of rows.
    """
    splits = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).orderBy("_file", "_block").collect()
    upto, offsets = 0, []
    for split in splits:
        offsets.append((split["_file"], split["_block"], upto - split["first"]))
        upto += split["n"]
    table = rows.sparkSession.createDataFrame(offsets, "_file string, _block long, _offset long")
    return rows.join(F.broadcast(table), ["_file", "_block"]).withColumn(name, F.col("_id") + F.col("_offset")).drop("_file", "_block", "_id", "_offset")


def located(df: DataFrame) -> DataFrame:
    """A file scan with what numbered() needs."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def line_numbers(spark: SparkSession, path: str, wrong: Column) -> int | None:
    """The number, from 1, of the first line for which the condition holds."""
    lines = numbered(located(spark.read.text(path)))
    first = lines.where(wrong).agg(F.min("_row")).first()[0]
    return None if first is None else first + 1


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files under a path, by name."""
    return sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect())  # names alone are read


def quote_count(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))  # bytes, as lines may not be UTF-8


def head_of(lines: DataFrame, counts: Mapping[str, int]) -> list[bytes]:
    """The first lines, of the first file by name, and of the next ones where it has too few. counts: the lines of each file."""
    first, n = [], 0
    for file in sorted(counts):
        if n < HEAD_LINES:
            first.append(file)
            n += counts[file]
    begin = F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES).alias("value")
    found = located(lines).where(F.col("_file").isin(first)).select(begin, "_file", "_block", "_id")
    if len(first) > 1:
        found = found.orderBy("_file", "_block", "_id")
    return [bytes(r["value"]) for r in found.limit(HEAD_LINES).collect()]


def sniff(spark: SparkSession, path: str) -> Layout:
    """Probe a file, or one in pieces (read_text), read through Spark so that any file system works.

    UTF-8 (with or without its mark) if all lines are, else windows-1251. Lines of both kinds of letters, and a quote that
    no other closes, are errors that name the line.
    """
    lines = spark.read.text(path)
    valid, ascii_only = F.is_valid_utf8("value"), F.col("value").rlike("^[\\x00-\\x7F]*$")
    odd = quote_count(F.col("value")) % 2 == 1
    counts = [F.count(F.lit(1)).alias("lines"), F.count_if(~valid).alias("bad"), F.count_if(valid & ~ascii_only).alias("wide"), F.count_if(odd).alias("odd")]
    files = lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(*counts).collect()  # one row for each file
    found = {k: sum(f[k] for f in files) for k in ("bad", "wide", "odd")}
    head = head_of(lines, {f["file"]: f["lines"] for f in files})
    if head and head[0][:2] in (b"\xff\xfe", b"\xfe\xff"):
        raise ValueError("the file is UTF-16; UTF-8 and windows-1251 are read")
    if found["bad"] and found["wide"]:
        raise ValueError(f"line {line_numbers(spark, path, ~valid)} is not UTF-8, but other lines are")
    if any(f["odd"] % 2 for f in files):
        raise ValueError(f"the quotes do not balance; line {line_numbers(spark, path, odd)} has the first that may be open")
    encoding = "windows-1251" if found["bad"] else "UTF-8"
    text = [h.decode("cp1251" if found["bad"] else "utf-8-sig", "replace").rstrip("\r") for h in head]
    filled = [x for x in text if x.strip()]
    delimiter = delimiter_of(filled[:HEAD_ROWS])
    rows = [split_line(x, delimiter) for x in filled[:HEAD_ROWS]]  # blank lines are no records to Spark either
    at = header_row(rows) if rows else 0
    names = rows[at] if rows else []
    if names and not names[-1].strip():  # a delimiter at the line's end
        names = names[:-1]
    return Layout(encoding, delimiter, at, unique_names(names), bool(found["odd"]))


SPARE = "_more"


def read_text(spark: SparkSession, path: str, layout: Layout | None = None, ragged: str = "error") -> DataFrame:
    """All columns of one file as text, `_row` (place in the file, from 0), blank rows left out.

    The file may lie in pieces: the files of a folder, by name, of which the first alone begins with the header. No record
    lies in two.

    A spare column catches cells beyond the header's width: `error` refuses such rows, `truncate` drops the cells.
    """
    layout = layout or sniff(spark, path)
    schema = ", ".join(f"`{n}` string" for n in [*layout.names, SPARE])
    marks = {"sep": layout.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if layout.quoted_lines or layout.encoding != "UTF-8":
        found = records(spark, path, layout.encoding).select("_row", F.from_csv("record", schema, marks | {"multiLine": "true"}).alias("cells"))
        rows = found.select("cells.*", "_row")
    else:
        rows = numbered(located(spark.read.csv(path, schema=schema, header=False, enforceSchema=True, **marks)))
    rows = rows.where(F.col("_row") > layout.skipped).withColumn("_row", F.col("_row") - layout.skipped - 1)
    over = F.coalesce(F.trim(SPARE), F.lit("")) != ""
    if ragged == "error":
        problem = F.concat(F.lit("row "), F.col("_row").cast("string"), F.lit(" has more cells than the header"))
        rows = rows.withColumn("_row", F.when(over, F.raise_error(problem).cast("long")).otherwise(F.col("_row")))
    blank = F.lit(True)
    for n in layout.names:
        blank = blank & (F.coalesce(F.trim(F.col(f"`{n}`")), F.lit("")) == "")
    return rows.where(~blank).drop(SPARE)


def read_parts(spark: SparkSession, parts: Sequence[tuple[str, Mapping[str, str]]], ragged: str = "error") -> DataFrame:
    """Several files as one table: each with a layout and a mapping (its column -> the table's) of its own, one after another.

    Columns that a file's mapping does not name keep their names; those that other files lack are null there. `_row` goes
    on from file to file.
    """
    out: DataFrame | None = None
    before = 0
    for place, (path, names) in enumerate(parts, 1):
        rows = read_text(spark, path, ragged=ragged)
        upto = rows.agg(F.max("_row")).first()[0] if place < len(parts) else None
        part = rows.withColumnsRenamed(dict(names)).withColumn("_row", F.col("_row") + before)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        before += 0 if upto is None else upto + 1
    if out is None:
        raise ValueError("no files")
    return out


def read_folder(spark: SparkSession, path: str, ragged: str = "error") -> DataFrame:
    """All files of a folder, by name, each below a header of its own."""
    return read_parts(spark, [(file, {}) for file in files_of(spark, path)], ragged)
