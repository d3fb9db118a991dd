"""Cells of spreadsheet files (.xlsx, .ods): each file is opened by one task, so many files are read side by side."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablework.sources.files import column_names, infer_types, write

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_OFFICE, _TABLE, _TEXT = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("office", "table", "text"))
#: Repeats of empty cells or rows beyond so many are padding at the end of an .ods sheet.
PADDING = 1000


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _xlsx(book: zipfile.ZipFile, fill: bool) -> Iterator[tuple[str, int, int, str]]:
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_SHEET}sheet"):
        part = targets[sheet.get(_LINK)]
        root = ElementTree.fromstring(book.read(part.lstrip("/") if part.startswith("/") else f"xl/{part}"))
        cells: dict[tuple[int, int], str] = {}
        for k, row in enumerate(root.iter(f"{_SHEET}row")):
            at = int(row.get("r") or k + 1) - 1
            for j, c in enumerate(row.iter(f"{_SHEET}c")):
                kind, v = c.get("t"), c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if kind == "inlineStr" else None if v is None else shared[int(v.text)] if kind == "s" else v.text
                if text is not None:
                    cells[at, _column(c.get("r")) if c.get("r") else j] = text
        for merged in root.iter(f"{_SHEET}mergeCell") if fill else ():  # all cells of a merged range have its first one's text
            (a, r0), (b, r1) = (re.match("([A-Z]+)([0-9]+)", x).groups() for x in (merged.get("ref").split(":") * 2)[:2])
            if (text := cells.get((int(r0) - 1, _column(a)))) is not None:
                cells |= {(r, c): text for r in range(int(r0) - 1, int(r1)) for c in range(_column(a), _column(b) + 1)}
        yield from ((sheet.get("name"), r, c, text) for (r, c), text in sorted(cells.items()))


def _ods(book: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    for sheet in ElementTree.fromstring(book.read("content.xml")).iter(f"{_TABLE}table"):
        at = 0
        for row in sheet.iter(f"{_TABLE}table-row"):
            own, col = [], 0
            for cell in row:
                times = int(cell.get(f"{_TABLE}number-columns-repeated", 1))
                text = cell.get(f"{_OFFICE}value") or "\n".join("".join(p.itertext()) for p in cell.iter(f"{_TEXT}p"))
                if text:
                    own += [(col + k, text) for k in range(times)]
                col += times
            times = int(row.get(f"{_TABLE}number-rows-repeated", 1))
            for r in range(times if own or times < PADDING else 0):
                yield from ((sheet.get(f"{_TABLE}name"), at + r, c, text) for c, text in own)
            at += times


def cells(spark: SparkSession, path: str, fill: bool = True) -> DataFrame:
    """(path, sheet, row, col, text) of every filled cell of the workbooks at path (a file, folder or pattern); from 0.

    fill: all cells of a merged range have its text, else its first cell alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as book:
                    found = list(_ods(book) if "content.xml" in book.namelist() else _xlsx(book, fill))
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["path", "sheet", "row", "col", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, sheet string, row long, col long, text string")


def list_sheets(found: DataFrame) -> DataFrame:
    """(path, sheet, rows, cols) of cells()."""
    return found.groupBy("path", "sheet").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))


def extract_sheet(found: DataFrame, sheet: str, header_row: int = 0) -> DataFrame:
    """A sheet of cells() as a table of texts, by the names in header_row. Only that row comes to the driver."""
    own = found.where(F.col("sheet") == sheet)
    names = {r["col"]: r["text"].strip() for r in own.where(F.col("row") == header_row).select("col", "text").distinct().collect()}
    wide = own.where(F.col("row") > header_row).groupBy("path", "row").agg(*(F.max(F.when(F.col("col") == c, F.col("text"))).alias(names[c]) for c in sorted(names)))
    return wide.select("path", "row", *(names[c] for c in sorted(names)))


def _islands(found: DataFrame, by: list[str], at: str, name: str) -> DataFrame:
    """(by, at, name): the places at that occur within by, with the number of the unbroken run each belongs to."""
    places = found.select(*by, at).distinct()
    run: Column = F.col(at) - F.row_number().over(Window.partitionBy(*by).orderBy(at))
    return places.withColumn(name, run)


def detect_tables(found: DataFrame, min_rows: int = 2, min_cols: int = 2) -> DataFrame:
    """(path, sheet, index, row_start, row_end, col_start, col_end, rows, cols): the tables of each sheet of cells(fill=False).

    Blank cells are empty. Unbroken runs of rows that hold something are told apart first, and within each the unbroken runs
    of columns; those too small go, the rest are numbered from top to bottom and left to right. Windows hold a sheet's rows at most.
    """
    filled = found.where(F.trim("text") != "")
    bands = _islands(filled, ["path", "sheet"], "row", "band")
    held = filled.join(bands, ["path", "sheet", "row"])
    edges = bands.groupBy("path", "sheet", "band").agg(F.min("row").alias("row_start"), F.max("row").alias("row_end"))
    runs = _islands(held, ["path", "sheet", "band"], "col", "run").groupBy("path", "sheet", "band", "run").agg(F.min("col").alias("col_start"), F.max("col").alias("col_end"))
    tables = runs.join(edges, ["path", "sheet", "band"]).withColumns({"rows": F.col("row_end") - F.col("row_start") + 1, "cols": F.col("col_end") - F.col("col_start") + 1})
    tables = tables.where((F.col("rows") >= min_rows) & (F.col("cols") >= min_cols))
    index = F.row_number().over(Window.partitionBy("path", "sheet").orderBy("row_start", "col_start")) - 1
    return tables.select("path", "sheet", index.cast("long").alias("index"), "row_start", "row_end", "col_start", "col_end", "rows", "cols")


def _wide(own: DataFrame, first: int, columns: list[int]) -> DataFrame:
    """(path, row, names): the rows after row first as a table, named by that row. Only that row comes to the driver."""
    head = {r["col"]: r["text"] for r in own.where(F.col("row") == first).select("col", "text").distinct().collect()}
    names = column_names([head.get(c) for c in columns])
    names = [f"Unnamed: {c}" if not (head.get(c) or "").strip() else n for c, n in zip(columns, names, strict=True)]
    rows = own.where((F.col("row") > first) & F.col("col").isin(columns))
    wide = rows.groupBy("path", "row").agg(*(F.max(F.when(F.col("col") == c, F.col("text"))).alias(n) for c, n in zip(columns, names, strict=True)))
    return wide.select("path", "row", *(f"`{n}`" for n in names))


def extract_table(found: DataFrame, sheet: str, index: int = 0) -> DataFrame:
    """Table number index of a sheet of one workbook, as detect_tables(min_rows=1, min_cols=1) numbers them, by its first row's names."""
    own = found.where((F.col("sheet") == sheet) & (F.trim("text") != ""))
    place = detect_tables(own, 1, 1).where(F.col("index") == index).first()
    if place is None:
        raise ValueError(f"no table {index} in sheet {sheet!r}")
    inside = own.where(F.col("row").between(place["row_start"], place["row_end"]) & F.col("col").between(place["col_start"], place["col_end"]))
    return _wide(inside, place["row_start"], list(range(place["col_start"], place["col_end"] + 1)))


def extract_all_sheets(spark: SparkSession, path: str, folder: str, kind: str = "csv") -> list[tuple[str, str, int]]:
    """Every sheet of one workbook as a table of its own, <workbook>_<sheet> in folder: (sheet, path, rows) of each, by sheet.

    Names come from a sheet's first filled row, and columns get types as those of delimited files do.
    """
    found = cells(spark, path).cache()
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])
    out = []
    try:
        for r in found.groupBy("sheet").agg(F.min("row").alias("first"), F.min("col").alias("low"), F.max("col").alias("high")).orderBy("sheet").collect():
            table = _wide(found.where(F.col("sheet") == r["sheet"]), r["first"], list(range(r["low"], r["high"] + 1)))
            target = f"{folder.rstrip('/')}/{stem}_{r['sheet']}.{kind}"
            write(infer_types(table.orderBy("row").drop("path", "row")), target, kind)
            out.append((r["sheet"], target, table.count()))
    finally:
        found.unpersist()
    return out
