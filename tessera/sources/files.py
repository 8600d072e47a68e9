"""Readers of uploaded files: CSV, workbooks (by the standard library), PDF and image text through injected readers.

All paths are Hadoop paths. Lines and files are read by tasks; the driver sees only column names and counts per part of
a file.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import chunks, combine
from tessera.operators.sheets import budget_lines
from tessera.session import cut

#: Parts of column names by role, in order (fixed values).
ROLES = {
    "item_number": ["no", "nomor", "item", "kode"],
    "work_title": ["pekerjaan", "judul", "uraian pekerjaan"],
    "description": ["uraian", "deskripsi", "keterangan", "spesifikasi"],
    "material_service_name": ["material", "barang", "jasa", "nama"],
    "volume": ["volume", "vol", "qty", "kuantitas"],
    "unit": ["satuan", "unit", "uom"],
    "unit_price": ["harga satuan", "harga", "price", "harsat"],
    "total_price": ["jumlah", "total", "subtotal", "nilai"],
    "notes": ["catatan", "notes", "remark"],
}
TEXT_ROLES = ("work_title", "description", "material_service_name", "notes")
AMOUNTS = ("volume", "unit", "unit_price", "total_price")
#: A PDF with fewer characters than this is a scan (fixed value).
SCANNED = 40
#: Endings of files by their kind (fixed values).
KINDS = {".csv": "csv", ".xlsx": "workbook", ".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image"}
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHEET_ROWS = "file string, sheet string, sheet_idx int, row_idx int, cells array<string>"
PAGES = "file string, no int, page_or_sheet string, text string, source_quality string"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV file with all columns as text and trimmed names.

    It is read as UTF-8 if all its lines are valid UTF-8, else as Latin-1. It is read in splits, unless a field holds a
    line break: then some line has an odd number of quotes, and the file is read by one task.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.bool_or(quotes % 2 == 1).alias("broken")).first()
    encoding = "UTF-8" if seen.valid in (None, True) else "ISO-8859-1"
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=bool(seen.broken), escape='"', encoding=encoding)
    return df.toDF(*[c.strip() for c in df.columns])


def in_order(df: DataFrame, column: str = "row_idx") -> DataFrame:
    """Rows of a file that Spark reads, numbered from 0 in the file's order.

    Each split is counted by itself; what reaches the driver is one count per split.
    """
    placed = cut(df.withColumns({"_at": F.col("_metadata.file_block_start"), "_in": F.monotonically_increasing_id()}))
    sizes = sorted((r._at, r.n) for r in placed.groupBy("_at").agg(F.count("*").alias("n")).collect())
    before = dict(zip((a for a, _ in sizes), itertools.accumulate((n for _, n in sizes), initial=0)))
    starts = F.broadcast(df.sparkSession.createDataFrame([(a, n) for a, n in before.items() if a is not None], "_at long, _before long"))
    row = F.row_number().over(Window.partitionBy("_at").orderBy("_in")) - 1
    return placed.join(starts, "_at").withColumn(column, (F.col("_before") + row).cast("int")).drop("_at", "_in", "_before")


def roles(columns: list[str]) -> dict[str, str]:
    """For each role the first column whose name holds one of its words; a column may have several roles."""
    names = [c.lower().strip() for c in columns]
    places = {role: [i for i, name in enumerate(names) for w in words if w in name] for role, words in ROLES.items()}
    return {role: columns[min(at)] for role, at in places.items() if at}


def mapping(columns: list[str]) -> dict[str, object]:
    """Default columns of a review: texts, and those of volume, unit and prices (None where there is none).

    A ready review text is preferred to columns with a role, and those to the first column; an amount without a role
    is the column of its own name.
    """
    found, named = roles(columns), {c: c for c in columns}
    choices = ([c for c in columns if c == "review_text"], [found[r] for r in ROLES if r in found and r in TEXT_ROLES], columns[:1])
    return {"text": next((c for c in choices if c), [])} | {r: found.get(r, named.get(r)) for r in AMOUNTS}


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, int, list[str]]]:
    """(sheet, sheet_idx, row_idx, cells) of an xlsx file; numbers as they are stored, whole ones without '.0'."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, s in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = rels[s.get(f"{_REL}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for i, row in enumerate(root.iter(f"{_MAIN}row")):
                cells: list[str] = []
                for n, c in enumerate(row):
                    ref = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(ref.group()))) - 1 if ref else n
                    cells += [""] * (at - len(cells))
                    v, kind = c.find(f"{_MAIN}v"), c.get("t")
                    text = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if kind == "inlineStr" else "" if v is None else shared[int(v.text)] if kind == "s" else v.text or ""
                    cells.append(re.sub(r"^(-?\d+)\.0$", r"\1", text))
                yield s.get("name"), k, int(row.get("r") or i + 1) - 1, cells


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows of the workbooks at a path or pattern, one task per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, data in zip(pdf["path"], pdf["content"]):
                rows = [(file, *r) for r in workbook_rows(bytes(data))]
                yield pd.DataFrame(rows, columns=["file", "sheet", "sheet_idx", "row_idx", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SHEET_ROWS)


def headed_sheet(rows: DataFrame) -> tuple[str, DataFrame]:
    """Name of the first sheet of one workbook's raw rows, and its rows as a table under its first row, with row_idx.

    Blank names of columns are 'Unnamed: i', repeated ones get a number behind them; an empty sheet has no columns.
    """
    head = rows.filter("sheet_idx = 0").orderBy("row_idx").limit(1).collect()
    if not head:
        return "", rows.select("row_idx").limit(0)
    names: list[str] = []
    for i, cell in enumerate(head[0].cells):
        name = cell.strip() or f"Unnamed: {i}"
        same = sum(n == name or re.fullmatch(re.escape(name) + r"\.\d+", n) is not None for n in names)
        names.append(f"{name}.{same}" if same else name)
    body = rows.filter((F.col("sheet_idx") == 0) & (F.col("row_idx") > head[0].row_idx))
    cells = [F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")).alias(n) for i, n in enumerate(names)]
    return head[0].sheet, body.select((F.col("row_idx") - head[0].row_idx - 1).alias("row_idx"), *cells)


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]], scan: Callable[[bytes], Iterable[str]] | None = None, most: int = 25) -> DataFrame:
    """(file, no, page_or_sheet, text, source_quality) of documents by injected readers of text and of scans.

    Blank pages are left out; ``no`` counts the others. A document of fewer than SCANNED characters is a scan: the first
    ``most`` pages that ``scan`` yields make one chunk (a generator reads no more of them); without a scanner, or if it
    finds nothing, the extracted pages stay.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, data in zip(pdf["path"], pdf["content"]):
                pages = [(f"Halaman {i}", t) for i, t in enumerate(extract(bytes(data)), 1) if t.strip()]
                quality = "digital_pdf"
                if sum(len(t) for _, t in pages) < SCANNED and scan is not None:
                    quality = "ocr"
                    read = "\n".join(itertools.islice(scan(bytes(data)), most)).strip()
                    pages = [("OCR PDF", read)] if read else pages
                out += [(file, i, p, t, quality) for i, (p, t) in enumerate(pages, 1)]
            yield pd.DataFrame(out, columns=["file", "no", "page_or_sheet", "text", "source_quality"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def read_images(spark: SparkSession, path: str, readers: list[Callable[[bytes], str]]) -> DataFrame:
    """The text of images, one chunk each, by the first of several scanners that finds any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(file, 1, "Image OCR", first_text(readers, bytes(data)), "ocr") for file, data in zip(pdf["path"], pdf["content"])]
            yield pd.DataFrame([g for g in got if g[3]], columns=["file", "no", "page_or_sheet", "text", "source_quality"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, PAGES)


def first_text(readers: list[Callable[[bytes], str]], data: bytes) -> str:
    """The first text that is not blank among several scanners; a scanner that fails counts as blank."""
    for r in readers:
        try:
            text = r(data)
        except Exception:  # noqa: BLE001
            continue
        if text and text.strip():
            return text
    return ""


def table_items(df: DataFrame, file: str, sheet: str, columns: dict[str, object]) -> DataFrame:
    """Review items of a headed table with a column ``row_idx`` of the source order."""
    text = combine(list(columns["text"]))
    pick = lambda r: F.coalesce(F.col(f"`{columns[r]}`").cast("string"), F.lit("")) if columns.get(r) else F.lit("")
    own = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else other
    return df.select(
        own("row_id", (F.col("row_idx") + 1).cast("string")).alias("row_id"), F.lit(PurePosixPath(file).name).alias("source_file"), own("sheet", F.lit(sheet)).alias("page_or_sheet"),
        text.alias("original_text"), text.alias("item_description"), own("judul_rab", F.lit("")).alias("judul_rab"), own("item_per_rab", text).alias("item_per_rab"), own("section", F.lit("")).alias("section"),
        *[pick(r).alias(r) for r in AMOUNTS], F.lit("table").alias("source_quality"),
    )


def chunk_items(pages: DataFrame) -> DataFrame:
    """Review items of page texts (file, no, page_or_sheet, text, source_quality): one per chunk, numbered 'page.chunk'."""
    each = pages.select("file", "no", "page_or_sheet", "source_quality", F.posexplode(chunks(F.col("text"))).alias("part", "t"))
    blank = F.lit("")
    return each.select(
        F.concat_ws(".", F.col("no").cast("string"), (F.col("part") + 1).cast("string")).alias("row_id"), F.substring_index("file", "/", -1).alias("source_file"), "page_or_sheet",
        F.col("t").alias("original_text"), F.col("t").alias("item_description"), blank.alias("judul_rab"), F.col("t").alias("item_per_rab"), blank.alias("section"),
        *[blank.alias(r) for r in AMOUNTS], "source_quality",
    )


def read_upload(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """('table' or 'sheets', rows) of a table file by its ending; other endings raise."""
    kind = kind_of(path)
    if kind == "csv":
        return "table", read_csv(spark, path)
    if kind == "workbook":
        return "sheets", read_workbooks(spark, path)
    raise ValueError(f"{path} is no table")


def kind_of(path: str) -> str:
    ending = PurePosixPath(path).suffix.lower()
    if ending not in KINDS:
        raise ValueError(f"no reader for {ending or 'files without ending'}")
    return KINDS[ending]


def upload_items(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]] | None = None, scan: Callable[[bytes], Iterable[str]] | None = None, images: list[Callable[[bytes], str]] | None = None, columns: dict[str, object] | None = None) -> DataFrame:
    """Review items of one uploaded file, by its ending; endings without reader raise.

    A table's columns are ``columns`` or found by their names. A workbook whose first sheet has no column of text is
    read as a budget sheet; if that finds no line, it stays a table.
    """
    kind = kind_of(path)
    if kind in ("pdf", "image"):
        if kind == "pdf" and extract is None or kind == "image" and not images:
            raise ValueError(f"a reader for {kind} files is needed")
        return chunk_items(read_pages(spark, path, extract, scan) if kind == "pdf" else read_images(spark, path, images))
    if kind == "csv":
        sheet, df = "CSV", in_order(read_csv(spark, path))
    else:
        rows = cut(read_workbooks(spark, path))
        sheet, df = headed_sheet(rows)
        if not set(roles(df.columns)) & set(TEXT_ROLES):
            lines = cut(budget_lines(rows))
            if not lines.isEmpty():
                order = Window.orderBy("sheet_idx", "row_idx")  # the lines of one workbook
                sheet, df = "RAB/REALISASI", lines.withColumn("row_idx", F.row_number().over(order) - 1)
    names = [c for c in df.columns if c not in ("row_idx", "file", "sheet_idx")]
    return table_items(df, path, sheet, columns or mapping(names)) if names else table_items(df.withColumn("_", F.lit("")), path, sheet, {"text": ["_"]})
