"""Filters, summaries and reports over a reviewed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels that count as findings, and as high ones (fixed values).
FINDINGS = ["Sedang", "Tinggi", "Sangat tinggi"]
HIGH = ["Tinggi", "Sangat tinggi"]


def filtered(results: DataFrame, levels: list[str] | None = None, category: str = "Semua", manual_only: bool = False, query: str = "") -> DataFrame:
    """Rows that meet all given conditions; an absent one holds for all.

    Category '-' finds nulls; the query is literal text, looked for without case in four columns joined by spaces.
    """
    out = results
    if levels:
        out = out.filter(F.col("confidence_label").isin(levels))
    if category and category != "Semua":
        out = out.filter(F.coalesce("matched_category", F.lit("-")) == category)
    if manual_only:
        out = out.filter("manual_review")
    if query.strip():
        joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("item_per_rab", "original_text", "matched_keyword", "matched_category")])
        out = out.filter(F.contains(F.lower(joined), F.lit(query.strip().lower())))
    return out


def potential_findings(results: DataFrame) -> DataFrame:
    return results.filter(F.col("confidence_label").isin(FINDINGS))


def all_materials(results: DataFrame) -> DataFrame:
    """Five columns of each row; blank item (or its description) and category become '-', confidence is a number."""
    blank = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    number = F.expr("try_cast(row_id AS double)")
    return results.select(
        "item_id", "row_id", number.alias("row_sort"), blank(F.coalesce("item_per_rab", "item_description")).alias("item"), blank(F.col("matched_category")).alias("category"),
        F.round(F.coalesce("final_confidence", F.lit(0.0)), 2).alias("confidence"), "confidence_label",
    )


def by_row_number(materials: DataFrame) -> DataFrame:
    """Numeric row ids first, then the others, in their own order."""
    return materials.orderBy(F.col("row_sort").asc_nulls_last(), "item_id")


def metrics(results: DataFrame) -> DataFrame:
    """One row: total, potential, high, top_confidence, manual; zeros for no rows."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("confidence_label").isin(FINDINGS)).alias("potential"),
        F.count_if(F.col("confidence_label").isin(HIGH)).alias("high"),
        F.coalesce(F.max("final_confidence"), F.lit(0.0)).alias("top_confidence"),
        F.count_if("manual_review").alias("manual"),
    )


def export_summary(results: DataFrame) -> DataFrame:
    """(metric, value) rows: counts and values in total and per label; a price that is no number is left out."""
    price = F.expr("try_cast(total_price AS double)")
    per = results.groupBy("confidence_label").agg(F.count("*").alias("n"), F.count_if(F.col("confidence_label").isin(HIGH)).alias("h"), F.coalesce(F.sum(price), F.lit(0.0)).alias("v"))
    row = lambda name, value: F.struct(name.alias("metric"), value.cast("double").alias("value"))
    name = F.coalesce("confidence_label", F.lit("nan"))
    labelled = per.select(F.explode(F.array(row(F.concat(F.lit("count_"), name), F.col("n")), row(F.concat(F.lit("total_value_"), name), F.col("v")))).alias("r"))
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    whole = total.select(F.explode(F.array(row(F.lit("total_items_reviewed"), F.col("n")), row(F.lit("count_potential_nac_high_very_high"), F.col("h")), row(F.lit("total_value_detected_rows"), F.col("v")))).alias("r"))
    return labelled.unionByName(whole).select("r.metric", F.round("r.value", 2).alias("value"))

