"""Workbooks written by the standard library: one sheet per table, rows streamed from the tasks to the file.

A sheet holds 1,048,576 rows at most (a limit of the format); a longer table goes on in further sheets of its name with
a number. Values are written as text, whole and decimal numbers as numbers; nulls are blank.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.report import by_row_number, export_summary
from tessera.operators.store import IMPORT_COLUMNS

#: Rows of a sheet and letters of its name (fixed values of the format).
ROWS, NAME = 1_048_576, 31
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _cell(value: object, numeric: bool) -> str:
    if value is None:
        return "<c/>"
    if numeric and value == value and value not in (float("inf"), float("-inf")):
        return f"<c><v>{value}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_NOT_XML.sub("", str(value)))}</t></is></c>'


def write_workbook(path: str, sheets: dict[str, DataFrame]) -> None:
    """Write tables as the sheets of a workbook at a Hadoop path, in their order; an older file is replaced."""
    spark = SparkSession.active()
    names: list[str] = []
    with tempfile.TemporaryDirectory() as folder:
        local = os.path.join(folder, "book.xlsx")
        with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as z:
            for name, df in sheets.items():
                numeric = [isinstance(f.dataType, T.NumericType) for f in df.schema]
                head = "<row>" + "".join(_cell(c, False) for c in df.columns) + "</row>"
                rows = df.toLocalIterator(prefetchPartitions=True)  # a partition at a time
                part, row = 1, next(rows, None)
                while part == 1 or row is not None:
                    label = name if part == 1 else f"{name} ({part})"
                    names.append(label[:NAME] if len(label) <= NAME or part == 1 else f"{name[: NAME - 6]} ({part})")
                    with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                        f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{head}'.encode())
                        n = 1
                        while row is not None and n < ROWS:
                            f.write(("<row>" + "".join(map(_cell, row, numeric)) + "</row>").encode("utf-8", "replace"))
                            row, n = next(rows, None), n + 1
                        f.write(b"</sheetData></worksheet>")
                    part += 1
            ids = range(1, len(names) + 1)
            listed = "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, s in zip(ids, names))
            z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>{listed}</sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>")
            z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in ids)
            z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


#: Sheets of a review workbook: its columns of a finding (fixed values; those that hold wording are left out).
MATCHES = ["row_id", "matched_keyword", "matched_category", "match_type", "fuzzy_score", "semantic_score"]
SUGGESTIONS = ["row_id", "suggested_synonym_candidate", "suggested_synonym_for_keyword", "manual_review"]


def review_sheets(reviewed: DataFrame, feedback: DataFrame, keywords: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a review: summary, findings, suggestions, feedback, keyword matches and all keywords."""
    return {
        "Summary": export_summary(reviewed).orderBy("metric"),
        "Findings": reviewed.orderBy("item_id"),
        "Suggestions": reviewed.orderBy("item_id").select(*SUGGESTIONS),
        "Feedback Log": feedback_log(feedback),
        "Keyword Matches": reviewed.orderBy("item_id").select(*MATCHES),
        "NAC Keyword Database Snapshot": keywords.orderBy("category", "keyword", "id"),
    }


def keyword_sheets(keywords: DataFrame, synonyms: DataFrame, terms: DataFrame, exceptions: DataFrame) -> dict[str, DataFrame]:
    """The sheets of the rule store: all rows of its dictionaries, active or not, synonyms with their keywords."""
    parent = keywords.select(F.col("id").alias("nac_keyword_id"), F.col("keyword").alias("parent_keyword"), "category", "severity")
    return {
        "NAC Keywords": keywords.orderBy("category", "keyword", "id"),
        "Synonyms": synonyms.join(parent, "nac_keyword_id", "left").select(*synonyms.columns, "parent_keyword", "category", "severity").orderBy("synonym", "id"),
        "Allowable": terms.orderBy("keyword", "id"),
        "Exceptions": exceptions.orderBy("pattern", "id"),
    }


def feedback_log(feedback: DataFrame) -> DataFrame:
    """All feedback, the newest first."""
    return feedback.orderBy(F.desc("created_at"), F.desc("id"))


def material_sheet(materials: DataFrame) -> DataFrame:
    """The report of all materials with printed headings, numeric rows first."""
    heads = {"row_id": "Row", "item": "Nama Material", "category": "Kategori NAC", "confidence": "Confidence %", "confidence_label": "Confidence Level"}
    return by_row_number(materials).select(*[F.col(c).alias(h) for c, h in heads.items()])


def import_template(spark: SparkSession) -> DataFrame:
    """The empty sheet that keywords are imported from."""
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in IMPORT_COLUMNS))
