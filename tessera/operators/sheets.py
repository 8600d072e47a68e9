"""Budget lines from loosely structured sheets: windows over ranges of the rows of each sheet.

Input rows are (file, sheet, sheet_idx, row_idx, cells array<string>). A numbered row is an item; it opens a group if
it has no unit, volume, price or value. Rows without number under a group are its children while every row since the
group has detail; any other row is a section title for the items behind it.

Rows are placed in ranges of (file, sheet, row), so a file with a third of all rows is many ranges. What a range must
know of those before it (numbered rows so far, the last title) is one row per range and sheet.

Defined results: null cells are blank; rows without description, with a number as description, or that look like a
header are left out; a file without any line from its usual sheets is read again from all sheets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Words of header rows and labels of titles (fixed values).
HEADER = ["nama barang", "nama material", "uraian kegiatan", "harga satuan", "jumlah", "satuan"]
TITLE = ["nama pekerjaan", "judul pekerjaan", "pekerjaan"]
_NUMBER = r"^\s*[+-]?(?:(?:\d+(?:_\d+)*)?\.?\d+(?:_\d+)*(?:[eE][+-]?\d+)?|\d+(?:_\d+)*\.(?:[eE][+-]?\d+)?|inf|infinity|nan)\s*$"


def cell(i: int) -> Column:
    """The i-th cell without white space at its ends; blank if there is none. A whole number loses its '.0'."""
    c = F.trim(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit("")))
    return F.regexp_replace(c, r"^(-?\d+)\.0$", "$1")


def is_number(c: Column) -> Column:
    return c.rlike("(?i)" + _NUMBER)


def zeroish(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[,.]", "").isin("", "0")


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def like_header(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in HEADER]) & ~F.startswith(low, F.lit("biaya "))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with no, description, unit, volume, unit_price and total by the layout that their cells show."""
    # Cells and what they are, made once per row: a generator keeps later filters from taking their place below it.
    bound = lambda df, name, **cs: df.select("*", F.explode(F.array(F.struct(*[x.alias(k) for k, x in cs.items()]))).alias(name))
    rows = bound(rows, "_c", **{f"x{i}": cell(i) for i in range(12)})
    c = [F.col(f"_c.x{i}") for i in range(12)]
    rows = bound(rows, "_n", **{f"x{i}": is_number(c[i]) for i in range(3)})
    n = [F.col(f"_n.x{i}") for i in range(3)]
    filled = [x != "" for x in c[:3]]
    layout = (
        F.when(n[0] & filled[1], "a")
        .when(n[1] & filled[2], "b")
        .when(filled[1] & ~n[1] & ~n[0], "a_title")
        .when(filled[2] & ~n[2] & ~n[1], "b_title")
    )
    rows = bound(rows, "_l", layout=layout).filter("_l.layout is not null").withColumn("layout", F.col("_l.layout"))
    a = F.col("layout").startswith("a")
    pick = lambda x, y: F.when(a, x).otherwise(y)
    titled = F.col("layout").endswith("title")
    return rows.withColumns(
        {
            "no": F.when(titled, "").otherwise(pick(c[0], c[1])),
            "description": pick(c[1], c[2]),
            "unit": pick(c[2], c[6]),
            "volume": pick(c[3], c[7]),
            "unit_price": pick(first_filled(c[4], c[5]), c[8]),
            "total": pick(first_filled(c[10], c[6], c[5]), first_filled(c[11], c[10], c[9])),
        }
    ).filter((F.col("description") != "") & ~is_number(F.col("description")) & ~like_header(F.col("description"))).drop("_c", "_n", "_l")


def rab_lines(rows: DataFrame) -> DataFrame:
    """Items and children of each sheet, in order."""
    detail = (F.col("unit") != "") | (F.col("volume") != "") | (F.col("unit_price") != "") | ~zeroish(F.col("total"))
    r = placed(rows).withColumn("detail", detail).withColumn("numbered", is_number(F.col("no"))).drop("cells")
    r = cut(r.repartitionByRange("file", "sheet", "row_idx").withColumn("part", F.spark_partition_id()))
    place = ["part", "file", "sheet"]
    here = Window.partitionBy(*place).orderBy("row_idx")
    before = Window.partitionBy("file", "sheet").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*place).agg(F.count_if("numbered").alias("m")).select(*place, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("earlier"))
    r = r.join(F.broadcast(sizes), place)  # at most ranges + sheets rows
    r = cut(r.withColumn("block", F.col("earlier") + F.sum(F.col("numbered").cast("int")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("earlier"))
    # Rows before the first number of a sheet have no group.
    in_block = Window.partitionBy("file", "sheet", "block").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = r.filter("block > 0").withColumns(
        {
            "whole": F.min((F.col("detail") | F.col("numbered")).cast("int")).over(in_block) == 1,
            "grouped": F.first(F.col("numbered") & ~F.col("detail")).over(in_block),
            "group": F.first("description").over(in_block),
            "group_no": F.first(F.regexp_replace("no", r"\.0$", "")).over(in_block),
        }
    )
    g = g.withColumn("child", ~F.col("numbered") & F.col("grouped") & F.col("whole") & (F.col("group_no") != ""))
    g = g.withColumn("k", F.sum(F.col("child").cast("int")).over(in_block)).drop("whole", "grouped")
    first = r.filter("block = 0").withColumns({"child": F.lit(False)})
    r = cut(g.unionByName(first, allowMissingColumns=True))
    title = F.when(~F.col("numbered") & ~F.col("child"), F.col("description"))
    last = r.groupBy(*place).agg(F.max_by(title, F.when(title.isNotNull(), F.col("row_idx"))).alias("t"))
    last = last.select(*place, F.last("t", ignorenulls=True).over(before).alias("earlier"))
    near = F.last(title, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    r = r.join(F.broadcast(last), place).withColumn("above", F.coalesce(near, "earlier"))
    row_id = F.when(F.col("numbered"), F.regexp_replace("no", r"\.0$", "")).otherwise(F.concat("group_no", F.lit("."), F.col("k").cast("string")))
    section = F.when(F.col("numbered"), F.coalesce("above", F.lit(""))).otherwise(F.col("group"))
    kept = r.filter(F.col("numbered") | F.col("child"))
    return kept.select("file", "sheet", "sheet_idx", "row_idx", row_id.alias("row_id"), F.col("description").alias("item_per_rab"), section.alias("section"), "volume", "unit", "unit_price", F.col("total").alias("total_price"), F.lit("").alias("notes"))


def realisasi_lines(rows: DataFrame) -> DataFrame:
    """Lines of sheets that list what was spent: item, value and note."""
    item = cell(0)
    r = rows.withColumns({"item": item, "total": first_filled(cell(1), cell(7)), "note": cell(2)}).filter((F.col("item") != "") & (F.upper("item") != "REALISASI"))
    number = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("row_idx")).cast("string")
    blank = F.lit("")
    return r.select("file", "sheet", "sheet_idx", "row_idx", number.alias("row_id"), F.col("item").alias("item_per_rab"), F.lit("Realisasi").alias("section"), blank.alias("volume"), blank.alias("unit"), blank.alias("unit_price"), F.col("total").alias("total_price"), F.col("note").alias("notes"))


def titles(rows: DataFrame) -> DataFrame:
    """(file, title): what stands to the right of the first title label of the file."""
    each = rows.select("file", "sheet_idx", "row_idx", "cells", F.posexplode("cells").alias("at", "value"))
    low = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    labelled = each.filter(low.isin(TITLE) | low.startswith("pekerjaan"))
    right = F.transform(F.slice("cells", F.col("at") + 2, F.size("cells")), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    value = F.try_element_at(F.filter(right, lambda x: (x != "") & (x != ":")), F.lit(1))
    found = labelled.withColumn("v", value).filter("v is not null")
    first = found.groupBy("file").agg(F.min_by("v", F.struct("sheet_idx", "row_idx", "at")).alias("v"))
    return first.select("file", F.trim(F.regexp_replace("v", "^:", "")).alias("title"))


def budget_lines(rows: DataFrame) -> DataFrame:
    """All lines of workbooks: sheets by their names, the title of the file, and the text to review."""
    name = F.upper("sheet")
    skipped = F.contains(name, F.lit("RESUME")) | F.contains(name, F.lit("EXTRA"))
    spent = F.contains(name, F.lit("REALISASI"))
    usual = rab_lines(rows.filter(~skipped & ~spent)).unionByName(realisasi_lines(rows.filter(~skipped & spent)))
    rest = rows.join(usual.select("file").distinct(), "file", "left_anti")
    lines = usual.unionByName(rab_lines(rest)).join(titles(rows), "file", "left")
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    lines = lines.withColumn("judul_rab", F.coalesce(F.nullif(F.col("title"), F.lit("")), stem)).drop("title")
    note = F.when(F.col("section") == "Realisasi", F.col("notes")).otherwise("")
    return lines.withColumn("review_text", F.array_join(F.filter(F.array("judul_rab", "section", "item_per_rab", note), lambda x: x != ""), " | "))
