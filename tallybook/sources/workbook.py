"""Excel workbooks (.xlsx, .xlsm): every cell as text, found and read through Spark, one workbook at a time in a task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import chain, islice
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from tallybook.sources.delimited import header_row, unique_names

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Unpacked bytes for each packed one above which a workbook is refused.
MOST_RATIO = 200
#: Rows of a sheet that tell its header, and rows that a task hands on at a time.
PROBED, PART = 1_000, 10_000
# Built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 22}


def column_index(reference: str) -> int:
    """A1 -> 0, AB7 -> 27."""
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def cell_text(cell: ElementTree.Element, shared: list[str], dated: set[int]) -> str | None:
    kind, value = cell.get("t"), cell.findtext(f"{MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in (None, "n") and int(cell.get("s", 0)) in dated:
        moment = datetime(1899, 12, 30) + timedelta(days=float(value))
        return f"{moment:%Y-%m-%d}" if float(value).is_integer() else f"{moment:%Y-%m-%d %H:%M:%S}"
    return value.removesuffix(".0")


def elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag in a part of a workbook, one at a time; each is dropped before the next is read."""
    with book.open(name) as part:
        open_ones: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                open_ones.append(element)
                continue
            open_ones.pop()
            if element.tag == tag:
                yield element
                if open_ones:
                    open_ones[-1].remove(element)


def row_cells(row: ElementTree.Element, shared: list[str], dated: set[int]) -> list[str | None]:
    cells: list[str | None] = []
    for cell in row.iter(f"{MAIN}c"):
        at = column_index(cell.get("r")) if cell.get("r") else len(cells)
        cells += [None] * (at - len(cells))
        cells.append(cell_text(cell, shared, dated))
    return cells


def sheet_rows(content: bytes) -> Iterator[Iterator[list[str | None]]]:
    """The rows of each sheet, in order, read as they are asked for; the shared texts alone are held."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        if sum(i.file_size for i in book.infolist()) > MOST_RATIO * max(1, len(content)):
            raise ValueError("the workbook unpacks to far more than its size")
        read = lambda name: ElementTree.fromstring(book.read(name))
        names = set(book.namelist())
        shared = ["".join(t.text or "" for t in item.iter(f"{MAIN}t")) for item in elements(book, "xl/sharedStrings.xml", f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dated: set[int] = set()
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")))}
            dated = {i for i, x in enumerate(styles.find(f"{MAIN}cellXfs") if styles.find(f"{MAIN}cellXfs") is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        for sheet in read("xl/workbook.xml").iter(f"{MAIN}sheet"):
            target = targets[sheet.get(LINK)]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            yield (row_cells(row, shared, dated) for row in elements(book, name, f"{MAIN}row"))


def table_rows(content: bytes) -> Iterator[list[str | None]]:
    """The names, then the rows: of the first sheet that has any, and of following sheets with the same header.

    The header is looked for in a sheet's first PROBED rows. A workbook without rows gives nothing.
    """
    names: list[str] = []
    for rows in sheet_rows(content):
        filled = (r for r in rows if any((c or "").strip() for c in r))
        head = list(islice(filled, PROBED))
        if not head:
            continue
        at = header_row([[c or "" for c in r] for r in head])
        found = unique_names([c or "" for c in head[at]])
        if names and found != names:
            break
        if not names:
            yield found
        names = found
        for r in chain(head[at + 1 :], filled):
            yield (r + [None] * len(names))[: len(names)]


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks of one layout as text columns and `_row`; each workbook is read by one task, a part of its rows at a time.

    The names are those of one workbook, of which a task reads the first rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def header(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"names": [next(table_rows(bytes(content)), []) for content in batch["content"]]})

    names = list(files.limit(1).mapInPandas(header, "names array<string>").first()["names"])
    schema = ", ".join(f"`{n}` string" for n in names) + ", _row long"

    def rows(batches):
        import pandas as pd

        for batch in batches:
            for content in batch["content"]:
                body = table_rows(bytes(content))
                if (found := next(body, [])) != names:
                    raise ValueError(f"columns {found} instead of {names}")
                start = 0
                while part := list(islice(body, PART)):
                    yield pd.DataFrame(part, columns=names, dtype=object).assign(_row=range(start, start + len(part)))
                    start += len(part)

    return files.mapInPandas(rows, schema)
