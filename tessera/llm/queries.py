"""Queries of the training-data operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import canonical, copies, garbled, lookalikes, packing, personal, scans, tokens
from tessera.session import table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("nac_keywords", "keyword"), ("nac_synonyms", "synonym"), ("allowable_keywords", "keyword")]
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.lit(t).alias("table_name"), "id", F.col(c).alias("term")) for t, c in parts])


def _typed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text) of the costs typed by hand."""
    items = table(spark, sf_dir, "review_items").filter("section = 'Biaya Umum'")
    last = F.element_at(F.split("original_text", r"\s\|\s"), -1)
    return items.select(F.col("item_id").alias("row_id"), F.coalesce(F.when(F.trim("item_per_rab") != "", F.col("item_per_rab")), last).alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = table(spark, sf_dir, "nac_keywords").select("id", F.col("keyword").alias("term"))
    synonyms = table(spark, sf_dir, "nac_synonyms").select("id", F.col("nac_keyword_id").alias("keyword_id"), F.col("synonym").alias("term"))
    out = canonical.name(_typed_costs(spark, sf_dir), canonical.entries(keywords, synonyms))
    return out.select(F.col("row_id").alias("item_id"), F.coalesce("target_id", F.lit(0)).cast("long").alias("keyword_id"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_found(spark, sf_dir).filter("keyword_id = 0").select("item_id")


def _texts(spark: SparkSession, sf_dir: str, exceptions: bool) -> DataFrame:
    """table_name, record_id, kind of source and text of the records that people or scanners wrote."""
    items = table(spark, sf_dir, "review_items")
    parts = [
        items.select(F.lit("review_items").alias("table_name"), F.col("item_id").alias("record_id"), F.coalesce("source_quality", F.lit("")).alias("source"), F.col("original_text").alias("text")),
        table(spark, sf_dir, "feedback").select(F.lit("feedback").alias("table_name"), F.col("id").alias("record_id"), F.lit("feedback").alias("source"), F.col("original_text").alias("text")),
    ]
    if exceptions:
        parts.append(table(spark, sf_dir, "exceptions").select(F.lit("exceptions").alias("table_name"), F.col("id").alias("record_id"), F.lit("exceptions").alias("source"), F.col("pattern").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lookalikes.one_form(_texts(spark, sf_dir, True), ["table_name", "record_id"])
    return out.filter("found").select("table_name", "record_id").distinct()


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.one_form(_texts(spark, sf_dir, True), ["table_name", "record_id"]).select("table_name", "record_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = garbled.restore(spark, _texts(spark, sf_dir, False), ["table_name", "record_id"])
    return out.filter("garbled").select("table_name", "record_id").distinct()


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = garbled.restore(spark, _texts(spark, sf_dir, False), ["table_name", "record_id"])
    return out.select("table_name", "record_id", F.col("restored").alias("text"), "garbled")


def _repaired(spark: SparkSession, sf_dir: str, description: bool) -> DataFrame:
    return scans.repair(spark, table(spark, sf_dir, "review_items").filter("source_quality = 'ocr'"), description)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, False).select("item_id", F.explode("kinds").alias("kind")).distinct()


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, True).select("item_id", F.col("text").alias("original_text"), F.col("description").alias("item_description"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.members(copies.digests(_terms(spark, sf_dir), "term", ["table_name", "id"]))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = copies.digests(_terms(spark, sf_dir), "term", ["table_name", "id"])
    return copies.groups(rows).select("table_name", "keep_id", F.col("n").alias("n_copies"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_ids(spark, F.col("text")).alias("ids"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), tokens.token_count(spark, F.col("text")).alias("length"))
    out = packing.containers(sized, 2048)
    return out.select(F.col("item_id").alias("doc_id"), "piece_no", F.col("start").alias("start_token"), F.col("length").alias("n_tokens"), "container_id")


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number, the tokens in them and the share of their space that is used."""
    used = p9_containers(spark, sf_dir).filter("n_tokens > 0").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.select("containers", "n_tokens", F.round(F.col("n_tokens") / (2048 * F.col("containers")), 4).alias("fill"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.kind").alias("pii_type"), F.col("s.start").alias("start_pos")).distinct()


def p10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.masked(personal.find(spark, table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"p10_found": p10_found, "p10_text": p10_text, "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_text": p2_text, "p4_found": p4_found, "p4_text": p4_text, "p5_found": p5_found, "p5_text": p5_text, "p7_found": p7_found, "p7_counts": p7_counts, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill}

_COPIES = r"""
WITH term AS (
  SELECT 'nac_keywords' AS table_name, id, keyword AS t FROM nac_keywords
  UNION ALL SELECT 'nac_synonyms', id, synonym FROM nac_synonyms
  UNION ALL SELECT 'allowable_keywords', id, keyword FROM allowable_keywords),
safe AS (
  SELECT table_name, id,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'),
      '(\d)\.(\d)', '\1' || chr(1) || '\2', 'g'), '(\d),(\d)', '\1' || chr(2) || '\2', 'g'),
      '(\d),(\d)', '\1' || chr(2) || '\2', 'g') AS t FROM term WHERE t IS NOT NULL),
canon AS (
  SELECT table_name, id, list_sort(list_filter(list_transform(string_split_regex(t, '[,;/|]'),
    lambda x: regexp_replace(x, '[\s!-/:-@\[-`{-~]+', '', 'g')), lambda x: x <> '')) AS k FROM safe),
grp AS (SELECT table_name, k, min(id) AS keep_id, count(*) AS n_copies FROM canon GROUP BY ALL)
"""

SQL = {
    "p7_found": _COPIES + "SELECT table_name, keep_id, id AS dup_id FROM canon JOIN grp USING (table_name, k) WHERE id <> keep_id",
    "p7_counts": _COPIES + "SELECT table_name, keep_id, n_copies FROM grp",
}
