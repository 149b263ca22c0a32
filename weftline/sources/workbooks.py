"""Workbooks and delimited files as one table of cells.

Files are read whole by ``binaryFile``, one task per group of files, and taken apart in Arrow batches. Every
cell is text; nothing is inferred and no row is taken for a header.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

CELLS = "file string, sheet string, row int, col int, value string"
MERGES = "file string, sheet string, first_row int, last_row int, col int"
_REF = re.compile(r"([A-Z]+)(\d+)")


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def cell_place(ref: str) -> tuple[int, int]:
    """0-based row and column of a reference such as B12."""
    m = _REF.match(ref)
    if not m:
        raise ValueError(f"no cell reference: {ref!r}")
    col = 0
    for c in m[1]:
        col = col * 26 + ord(c) - 64
    return int(m[2]) - 1, col - 1


def _text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter() if _tag(t) == "t")


def workbook_sheets(content: bytes) -> Iterator[tuple[str, list[tuple[int, int, str]], list[tuple[int, int, int, int]]]]:
    """Name, cells (row, column, trimmed text) and merged ranges (first row, last row, first and last column) of each sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
            target = targets.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), "")
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if part not in names:
                continue
            cells, merges = [], []
            for e in ElementTree.fromstring(z.read(part)).iter():
                if _tag(e) == "c" and e.get("r"):
                    kind = e.get("t")
                    v = next((x.text or "" for x in e if _tag(x) == "v"), "")
                    value = shared[int(v)] if kind == "s" and v else _text(e) if kind == "inlineStr" else v
                    cells.append((*cell_place(e.get("r", "")), value.strip()))
                elif _tag(e) == "mergeCell":
                    a, _, b = e.get("ref", "").partition(":")
                    (r1, c1), (r2, c2) = cell_place(a), cell_place(b or a)
                    merges.append((r1, r2, c1, c2))
            yield sheet.get("name", ""), cells, merges


def delimited_rows(content: bytes, delimiter: str) -> Iterator[list[str]]:
    """Fields of each line; a quote is doubled within quotes, and quotes never span lines."""
    for line in content.decode("utf-8-sig", errors="replace").splitlines():
        yield next(csv.reader([line], delimiter=delimiter), []) if line else []


def _stem(path: str) -> str:
    return posixpath.basename(path).rpartition(".")[0] or posixpath.basename(path)


def _delimiter(path: str, content: bytes) -> str:
    if path.lower().endswith(".tsv"):
        return "\t"
    head = re.split(rb"[\r\n]", content, maxsplit=1)[0].decode("utf-8-sig", errors="replace")  # the whole first line
    return max((",", ";", "\t"), key=head.count)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, value) of all workbooks and delimited files below ``path``; single-column vertical
    merges are filled down. A file that can't be read gives one row with null sheet and the error as value."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike("[.](xlsx|csv|tsv|txt)$"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                try:
                    if name.lower().endswith(".xlsx"):
                        for sheet, cells, merges in workbook_sheets(content):
                            grid = {(r, c): v for r, c, v in cells}
                            for r1, r2, c1, c2 in merges:
                                if c1 == c2:
                                    grid |= {(r, c1): grid.get((r1, c1), "") for r in range(r1, r2 + 1)}
                            out += [(name, sheet, r, c, v) for (r, c), v in sorted(grid.items())]
                    else:
                        for r, row in enumerate(delimited_rows(content, _delimiter(name, content))):
                            out += [(name, _stem(name), r, c, v.strip()) for c, v in enumerate(row)]
                except Exception as e:  # an unreadable file is reported, not fatal
                    out = [(name, None, None, None, f"{type(e).__name__}: {e}"[:200])]
                yield pd.DataFrame(out, columns=["file", "sheet", "row", "col", "value"]).astype({"row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(parse, CELLS)


def dense(cells: DataFrame) -> DataFrame:
    """Every sheet as a rectangle: rows and columns from 0 to the last used, missing cells as empty text."""
    size = cells.where("sheet IS NOT NULL").groupBy("file", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    grid = size.select("file", "sheet", F.explode(F.sequence(F.lit(0), "rows")).alias("row"), "cols").select("file", "sheet", "row", F.explode(F.sequence(F.lit(0), "cols")).alias("col"))
    return grid.join(cells, ["file", "sheet", "row", "col"], "left").withColumn("value", F.coalesce("value", F.lit("")))


def filled_down(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Cells with the top value of each vertical merged range (one column) in all its rows."""
    w = Window.partitionBy("file", "sheet", "col", "first_row").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = merges.select("file", "sheet", "col", "first_row", F.explode(F.sequence("first_row", "last_row")).alias("row"))
    inside = rows.join(cells, ["file", "sheet", "row", "col"], "left").withColumn("value", F.first("value").over(w))
    outside = cells.join(rows.select("file", "sheet", "row", "col"), ["file", "sheet", "row", "col"], "left_anti")
    return outside.unionByName(inside.select("file", "sheet", "row", "col", "value"))
