"""Queries of the data problems that belong to the core: p3 (rows that fail to parse) and p6 (units)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import bad_rows, units
from tessera.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.failures(table(spark, sf_dir, "raw_lines"))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bad_rows.valid_rows(table(spark, sf_dir, "raw_lines"))


def _table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["item_id", "original_text", "item_per_rab", "volume", "unit", "unit_price", "total_price"]
    return table(spark, sf_dir, "review_items").filter("source_quality = 'table'").select(*columns)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.same_quantity(units.convert(_table_rows(spark, sf_dir), table(spark, sf_dir, "unit_ref")))


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units.convert(_table_rows(spark, sf_dir), table(spark, sf_dir, "unit_ref"))
    return out.select("item_id", "unit_code", "base_unit", "volume_base", "unit_price_base")


def p6_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.learn_spellings(units.measures(_table_rows(spark, sf_dir)), table(spark, sf_dir, "unit_ref"))


QUERIES = {"p6_found": p6_found, "p6_rows": p6_rows, "p6_spellings": p6_spellings, "p3_found": p3_found, "p3_rows": p3_rows}

_NUMBER = r"^(\s*|(Rp\.? ?)?(\d+([.,]\d+)?|\d{1,3}(\.\d{3})+(,\d+)?|\d{1,3}(,\d{3})+(\.\d+)?))$"

_LINES = r"""
WITH header AS (
  SELECT source_file, raw_text AS header,
         CASE WHEN contains(raw_text, ';') THEN ';' WHEN contains(raw_text, '|') THEN '\|'
              WHEN contains(raw_text, chr(9)) THEN chr(9) ELSE ',' END AS d
  FROM raw_lines WHERE line_no = 1),
line AS (
  SELECT line_id, raw_text, string_split_regex(header, d) AS names, d,
         '("(?:[^"]|"")*"|[^"' || d || ']*)' AS field
  FROM raw_lines JOIN header USING (source_file) WHERE line_no <> 1),
cut AS (
  SELECT *, regexp_full_match(raw_text, field || '(' || d || field || ')*') AS whole,
         CASE WHEN regexp_full_match(raw_text, field || '(' || d || field || ')*')
              THEN list_transform(regexp_extract_all(replace(d, '\', '') || raw_text, d || field, 1),
                     lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) END AS f
  FROM line),
named AS (
  SELECT *, len(f) = len(names) AS fits, f[list_position(names, 'volume')] AS volume,
         f[list_position(names, 'unit_price')] AS unit_price, f[list_position(names, 'total_price')] AS total_price
  FROM cut),
judged AS (
  SELECT *, CASE WHEN NOT whole THEN 'broken_quoting' WHEN NOT fits THEN 'column_count'
       WHEN NOT regexp_matches(volume, 'NUM') THEN 'bad_volume'
       WHEN NOT regexp_matches(unit_price, 'NUM') THEN 'bad_unit_price'
       WHEN NOT regexp_matches(total_price, 'NUM') THEN 'bad_total_price' END AS reason
  FROM named)
""".replace("NUM", _NUMBER)

SQL = {"p3_found": _LINES + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"}
