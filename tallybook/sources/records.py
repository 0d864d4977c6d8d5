"""Records of delimited files whose quotes may hold line ends, read in splits.

A line lies inside quotes if the quotes before it in the file are odd in number. One pass counts the quotes of every split
of the file; a running sum over the splits, of which there are few, tells each where its first record begins and how many
records came before. A second pass then joins the lines of each split's records. What crosses a border between splits, one
record at most for each, is put together from its lines by a scan of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "line binary, _file string, _block long, _id long"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes, without the line feed, with the file and split that each begins in, and an id that rises within a split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of lines of one split, in order; a split may come in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, file = np.asarray(batch["_block"]), batch["_file"]
        changed = np.flatnonzero((block[1:] != block[:-1]) | np.asarray(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)))) + 1
        for first, stop in zip([0, *changed.tolist()], [*changed.tolist(), batch.num_rows], strict=True):
            yield (file[first].as_py(), int(block[first])), batch.slice(first, stop - first)


def _odd(lines: pa.Array) -> np.ndarray:
    """Whether each line has an odd number of quotes."""
    return np.asarray(pc.count_substring(lines.cast(pa.large_binary()), b'"')) % 2 == 1


def _filled(lines: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(lines.cast(pa.large_binary()), r"[^\s]"))


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch of a split: lines that begin a record if the stretch begins outside or inside quotes, and ids of the first and last odd line."""
    for (file, block), batch in runs(batches):
        odd, filled, ids = _odd(batch["line"]), _filled(batch["line"]), np.asarray(batch["_id"])
        inside = np.concatenate([[0], np.cumsum(odd)[:-1]]) % 2
        hits = ids[odd]
        row = (file, block, int(ids[0]), int(odd.sum()), int((filled & (inside == 0)).sum()), int((filled & (inside == 1)).sum()), int(hits[0]) if len(hits) else None, int(hits[-1]) if len(hits) else None)
        yield pa.RecordBatch.from_pylist([dict(zip(("_file", "_block", "at", "odd", "outside", "inside", "first", "last"), row, strict=True))])


def survey(lines: DataFrame) -> list[dict]:
    """One row for each split, in order of files and splits: what stands before it, and what crosses its borders.

    `odd` quotes before it or not, `before` records, `records` of its own, and the ids of the lines that `lead` to the end
    of an earlier split's record (up to `lead_to`) and that begin one which a later split ends (from `open_from`).
    """
    found = lines.mapInArrow(_surveyed, "_file string, _block long, at long, odd long, outside long, inside long, first long, last long").orderBy("_file", "_block", "at").collect()
    out: list[dict] = []
    odd, before, file = False, 0, None
    for r in found:
        if r["_file"] != file:
            file, odd = r["_file"], False
        if not out or (out[-1]["_file"], out[-1]["_block"]) != (r["_file"], r["_block"]):
            out.append({"_file": r["_file"], "_block": r["_block"], "odd": odd, "before": before, "records": 0, "lead_to": None, "open_from": None, "closed": not odd})
        split, own = out[-1], r["inside"] if odd else r["outside"]
        if not split["closed"] and r["first"] is not None:
            split["lead_to"], split["closed"] = r["first"], True
        odd, before = odd ^ (r["odd"] % 2 == 1), before + own
        split["records"] += own
        if r["last"] is not None:
            split["open_from"] = r["last"] if odd else None
    return out


def crossing(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """_row and line (the bytes of the whole record) of records that begin in one split and end in another."""
    placed = lines.join(F.broadcast(splits), ["_file", "_block"])  # a row for each split
    leads = F.col("odd") & (F.col("lead_to").isNull() | (F.col("_id") <= F.col("lead_to")))
    opens = F.col("open_from").isNotNull() & (F.col("_id") >= F.col("open_from"))
    row = F.when(leads, F.col("before") - 1).when(opens, F.col("before") + F.col("records") - 1)
    pieces = placed.select(row.alias("_row"), "_file", "_block", "_id", "line").where("_row is not null")
    whole = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_file", "_block", "_id", F.hex("line").alias("line")))).alias("pieces"))
    return whole.select("_row", F.unhex(F.array_join(F.col("pieces.line"), "0A")).alias("line"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_row and line of the records that begin and end inside a split."""
    split, inside, index, waiting = None, False, 0, b""
    for key, batch in runs(batches):
        if key != split:
            split, inside, index, waiting = key, bool(batch["odd_before"][0].as_py()), int(batch["before"][0].as_py()), None
        lines, odd = batch["line"], _odd(batch["line"])
        inside_before = (np.concatenate([[0], np.cumsum(odd)[:-1]]) + inside) % 2 == 1
        inside_after = inside_before ^ odd
        single = ~inside_before & ~inside_after
        rows, texts = [], []
        begins = ~inside_before & _filled(lines)
        number = index + np.cumsum(begins) - 1
        yield pa.RecordBatch.from_arrays([pa.array(number[single & begins]), lines.filter(pa.array(single & begins))], ["_row", "line"])
        for i in np.flatnonzero(~single).tolist():  # lines of records of several lines
            if not inside_before[i]:
                waiting = [int(number[i]), [lines[i].as_py()]]
            elif waiting is not None:  # else it began in an earlier split
                waiting[1].append(lines[i].as_py())
                if not inside_after[i]:
                    rows.append(waiting[0])
                    texts.append(b"\n".join(waiting[1]))
            if not inside_after[i]:
                waiting = None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(texts, pa.binary())], ["_row", "line"])
        inside, index = bool(inside_after[-1]), index + int(begins.sum())


def decoded(line: Column, encoding: str) -> Column:
    """Bytes of a record as text, without a carriage return at its end; windows-1251 by a table of its upper half."""
    if encoding == "UTF-8":
        text = line.cast("string")
    else:
        latin = F.decode(line, "ISO-8859-1")  # each byte is one character
        upper = bytes(range(128, 256))
        text = F.translate(latin, upper.decode("latin-1"), upper.decode(encoding, "replace"))
    return F.regexp_replace(text, "\\r$", "")


def records(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """_row (from 0, over all files under the path by name; blank lines are none) and record (its text) of delimited files."""
    lines = lines_of(spark, path)
    schema = "_file string, _block long, odd boolean, before long, records long, lead_to long, open_from long"
    splits = spark.createDataFrame([tuple(s[k] for k in ("_file", "_block", "odd", "before", "records", "lead_to", "open_from")) for s in survey(lines)], schema)
    known = F.broadcast(splits.select("_file", "_block", F.col("odd").alias("odd_before"), "before"))
    whole = lines.join(known, ["_file", "_block"]).mapInArrow(_joined, "_row long, line binary")
    return whole.unionByName(crossing(lines, splits)).select("_row", decoded(F.col("line"), encoding).alias("record"))
