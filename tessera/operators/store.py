"""The rule store: Parquet tables with insert-if-absent, status changes and deletes, swapped in as whole folders.

All paths are Hadoop paths. Actions take tables and return tables; ``write`` stores them.

Defined results: new ids follow the largest; ids that do not exist change nothing; a delete takes a keyword's synonyms
and exceptions with it and keeps feedback; of several reviewed rows with one row id the first by item id counts.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import selected_id, selector, utc_now
from tessera.operators.score import MODES
from tessera.session import cut

#: Columns of the tables (fixed values).
SCHEMAS = {
    "nac_keywords": "id long, category string, keyword string, description string, reference string, severity string, status string, created_by string, created_at string, updated_at string, notes string",
    "nac_synonyms": "id long, nac_keyword_id long, synonym string, weight double, status string, created_at string",
    "allowable_keywords": "id long, category string, keyword string, description string, status string, created_at string",
    "exceptions": "id long, nac_keyword_id long, pattern string, reason string, action string, weight_adjustment double, status string, created_at string",
    "feedback": "id long, row_id string, original_text string, matched_keyword string, feedback_type string, user_suggested_redaction string, reviewer_notes string, created_at string",
    "settings": "key string, value string",
}
TABLES = list(SCHEMAS)
#: Columns of the sheet that keywords are imported from (fixed values).
IMPORT_COLUMNS = ["category", "keyword", "synonyms", "description", "reference", "severity", "status", "notes"]
#: What an imported keyword has where the sheet leaves it blank, and the weights of synonyms (fixed values).
IMPORTED = {"category": "Umum", "severity": "medium", "status": "active"}
IMPORT_WEIGHT, APPROVED_WEIGHT = 0.9, 0.85


def numbered(df: DataFrame, order: list[str | Column], column: str) -> DataFrame:
    """Rows numbered from 1 in their order: sorted in ranges, each counted by itself, so that no task holds them all."""
    ranged = cut(df.withColumn("_rank", F.struct(*order)).sort("_rank").withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id()}))
    sizes = sorted((r._part, r.n) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one per range
    before = itertools.accumulate((n for _, n in sizes), initial=0)
    starts = F.broadcast(df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part int, _before long"))
    row = F.row_number().over(Window.partitionBy("_part").orderBy("_in"))
    return ranged.join(starts, "_part").withColumn(column, F.col("_before") + row).drop("_rank", "_part", "_in", "_before")


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (without id) behind ``old``, with ids that follow the largest; missing columns are null."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).first().top
    added = numbered(new, [F.col(c) for c in new.columns], "_n").withColumn("id", (F.col("_n") + top).cast("long")).drop("_n")
    return old.unionByName(added, allowMissingColumns=True).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append the rows whose keys (texts without case) are not there, once each."""
    key = lambda df: df.select(*[F.lower(F.col(k).cast("string")).alias(f"_{k}") for k in keys])
    named = [f"_{k}" for k in keys]
    once = new.withColumns({f"_{k}": F.lower(F.col(k).cast("string")) for k in keys}).dropDuplicates(named)
    return append(old, once.join(key(old).distinct(), named, "left_anti").drop(*named))


def lookup(keywords: DataFrame, text: str) -> DataFrame:
    """The keyword of this text without case, of several the one with the smallest id."""
    return keywords.filter(F.lower("keyword") == text.strip().lower()).orderBy("id").limit(1)


def set_status(table: DataFrame, ids: DataFrame, status: str, now: str | None = None) -> DataFrame:
    """The table with this status on the rows named by ``ids`` (id)."""
    hit = table.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = hit.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
    if now is not None and "updated_at" in table.columns:
        hit = hit.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return hit.select(*table.columns)


def delete_keywords(keywords: DataFrame, synonyms: DataFrame, exceptions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = ids.select(F.col("id").cast("long").alias("id")).distinct()
    of = gone.withColumnRenamed("id", "nac_keyword_id")
    return keywords.join(gone, "id", "left_anti"), synonyms.join(of, "nac_keyword_id", "left_anti").select(*synonyms.columns), exceptions.join(of, "nac_keyword_id", "left_anti").select(*exceptions.columns)


def synonyms_with_keywords(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Active synonyms with their keyword, which may be missing or inactive."""
    k = keywords.select(F.col("id").alias("nac_keyword_id"), F.col("keyword").alias("parent_keyword"), "category", "severity")
    return synonyms.filter("status = 'active'").join(k, "nac_keyword_id", "left")


# --- actions of reviewers -------------------------------------------------------------------------------------


def _now(now: str | None) -> Column:
    return utc_now() if now is None else F.lit(now)


def id_list(text: Column) -> Column:
    """The distinct whole numbers of a text with ids set apart by commas or blanks, in their order; others are left out."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,;\s]+"), lambda x: x.try_cast("long")), lambda x: x.isNotNull()))


def row_choices(reviewed: DataFrame, with_synonym: bool = False) -> DataFrame:
    """(item_id, choice): selectors of reviewed rows, or only of those with a candidate synonym."""
    rows = reviewed.filter(F.trim(F.coalesce("suggested_synonym_candidate", F.lit(""))) != "") if with_synonym else reviewed
    text = F.coalesce(F.nullif(F.col("item_per_rab"), F.lit("")), F.col("original_text"))
    return rows.select("item_id", selector(F.coalesce("row_id", F.lit("")), text).alias("choice"))


def selected(reviewed: DataFrame, selection: str) -> DataFrame:
    """The reviewed row that a selector or a bare row id names; none if there is none."""
    wanted = selected_id(F.lit(selection))
    return reviewed.filter((F.col("row_id") == wanted) & (wanted != "")).orderBy("item_id").limit(1)


def save_feedback(feedback: DataFrame, reviewed: DataFrame, selection: str, kind: str, redaction: str = "", notes: str = "", now: str | None = None) -> DataFrame:
    """The feedback with one entry more, on the selected row; unchanged if there is no such row."""
    row = selected(reviewed, selection)
    new = row.select(
        "row_id", F.coalesce("original_text", F.lit("")).alias("original_text"), F.coalesce("matched_keyword", F.lit("")).alias("matched_keyword"), F.lit(kind).alias("feedback_type"),
        F.lit(redaction).alias("user_suggested_redaction"), F.lit(notes).alias("reviewer_notes"), _now(now).alias("created_at"),
    )
    return append(feedback, new)


def approve_synonym(reviewed: DataFrame, selection: str, keywords: DataFrame, synonyms: DataFrame, feedback: DataFrame, weight: float = APPROVED_WEIGHT, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Synonyms and feedback with the selected row's candidate approved.

    Nothing changes without a candidate, without its keyword, or if the keyword has the synonym already (without case).
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    row = selected(reviewed, selection).withColumns({"candidate": blank("suggested_synonym_candidate"), "of": F.coalesce(blank("suggested_synonym_for_keyword"), blank("matched_keyword"))})
    named = keywords.select(F.lower("keyword").alias("_of"), F.col("id").alias("nac_keyword_id")).groupBy("_of").agg(F.min("nac_keyword_id").alias("nac_keyword_id"))
    new = row.filter("candidate is not null").join(named, F.lower("of") == F.col("_of")).withColumn("_c", F.lower("candidate"))
    there = synonyms.select("nac_keyword_id", F.lower("synonym").alias("_c")).distinct()
    new = cut(new.join(there, ["nac_keyword_id", "_c"], "left_anti"))
    at = _now(now).alias("created_at")
    added = append(synonyms, new.select("nac_keyword_id", F.col("candidate").alias("synonym"), F.lit(float(weight or APPROVED_WEIGHT)).alias("weight"), F.lit("active").alias("status"), at))
    said = new.select("row_id", F.coalesce("original_text", F.lit("")).alias("original_text"), F.col("of").alias("matched_keyword"), F.lit("Add as Synonym").alias("feedback_type"), F.col("candidate").alias("user_suggested_redaction"), F.lit("Approved model-suggested synonym").alias("reviewer_notes"), at)
    return added, append(feedback, said)


def add_keyword(keywords: DataFrame, keyword: str, category: str = IMPORTED["category"], severity: str = IMPORTED["severity"], notes: str = "", now: str | None = None) -> DataFrame:
    """The keywords with one more; unchanged for a blank one or if the first of this text (without case) is active."""
    text = (keyword or "").strip()
    first = lookup(keywords, text).collect()
    if not text or first and first[0].status == "active":
        return keywords
    at = _now(now)
    new = keywords.sparkSession.range(1).select(
        F.lit(category).alias("category"), F.lit(text).alias("keyword"), F.lit(notes).alias("description"), F.lit("USER").alias("reference"), F.lit(severity).alias("severity"),
        F.lit("active").alias("status"), F.lit("user").alias("created_by"), at.alias("created_at"), at.alias("updated_at"), F.lit("").alias("notes"),
    )
    return append(keywords, new)


def save_settings(settings: DataFrame, values: dict[str, str]) -> DataFrame:
    """The settings (key, value) with these values in place of older ones."""
    new = settings.sparkSession.createDataFrame(list(values.items()), "key string, value string")
    return settings.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new)


def settings_for_mode(mode: str, semantic: bool = False, ocr: str = "auto") -> dict[str, str]:
    """The settings of a review mode; an unknown mode counts as 'Seimbang'."""
    fuzzy, meaning = MODES.get(mode, MODES["Seimbang"])
    return {"enable_semantic": str(semantic).lower(), "enable_stemming": "false", "fuzzy_threshold": f"{fuzzy:g}", "semantic_threshold": f"{meaning:g}", "ocr_mode": ocr, "semantic_user_configured": "true"}


def is_true(text: Column) -> Column:
    """Whether a setting's text says yes."""
    return F.coalesce(F.lower(text.cast("string")).isin("1", "true", "yes", "ya", "on"), F.lit(False))


# --- import ---------------------------------------------------------------------------------------------------


def import_keywords(sheet: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keywords and (keyword, synonym) rows of an import sheet; a single column of any name holds the keywords."""
    if len(sheet.columns) == 1:
        sheet = sheet.toDF("keyword")
    if "keyword" not in sheet.columns:
        raise ValueError("the sheet has no column 'keyword'")
    sheet = sheet.withColumn("keyword", F.trim(F.col("keyword").cast("string"))).filter("keyword <> ''")
    synonyms = sheet.select("keyword", F.explode(F.split("synonyms", ";")).alias("synonym")) if "synonyms" in sheet.columns else sheet.select("keyword", F.lit("").alias("synonym"))
    return sheet.drop("synonyms"), synonyms.withColumn("synonym", F.trim("synonym")).filter("synonym <> ''")


def add_imported(keywords: DataFrame, synonyms: DataFrame, sheet: DataFrame, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keywords and synonyms with those of an import sheet; every row is a new keyword, blank fields get defaults.

    Rows that are equal in all columns are one row each; synonyms go to the new keyword of their row's text with the
    smallest id.
    """
    words, named = import_keywords(sheet)
    given = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(IMPORTED.get(c, ""))) if c in words.columns else F.lit(IMPORTED.get(c, ""))
    at = _now(now)
    new = words.select("keyword", *[given(c).alias(c) for c in IMPORT_COLUMNS if c not in ("keyword", "synonyms")], F.lit("excel_import").alias("created_by"), at.alias("created_at"), at.alias("updated_at"))
    grown = cut(append(keywords, new))
    top = keywords.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    ids = grown.filter(F.col("id") > top).groupBy("keyword").agg(F.min("id").alias("nac_keyword_id"))
    more = named.join(ids, "keyword").select("nac_keyword_id", "synonym", F.lit(IMPORT_WEIGHT).alias("weight"), F.lit("active").alias("status"), at.alias("created_at"))
    return grown, append(synonyms, more)


# --- storage --------------------------------------------------------------------------------------------------


def _at(spark: SparkSession, *parts: str):
    """File system and path of a Hadoop path."""
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write(df: DataFrame, folder: str, name: str) -> None:
    """Write a table beside the old one, then swap the folders."""
    spark = df.sparkSession
    (fs, target), (_, fresh), (_, old) = _at(spark, folder, name), _at(spark, folder, f"_{name}_new"), _at(spark, folder, f"_{name}_old")
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(_at(spark, folder, name)[1].toString())


def _copy(spark: SparkSession, source: str, to: str, name: str) -> None:
    (a, there), (b, here) = _at(spark, source, name), _at(spark, to, name)
    if a.exists(there):
        b.delete(here, True)
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, there, b, here, False, spark._jsc.hadoopConfiguration())


def backup(folder: str, to: str) -> None:
    """Copy the tables of the store to another folder."""
    spark = SparkSession.active()
    fs, path = _at(spark, to)
    fs.mkdirs(path)
    for name in TABLES:
        _copy(spark, folder, to, name)


def restore(folder: str, source: str) -> None:
    """Replace the tables of the store by those of a backup; tables that it lacks stay."""
    for name in TABLES:
        _copy(SparkSession.active(), source, folder, name)


def reset(spark: SparkSession, folder: str) -> None:
    """An empty store: all tables with their columns and no rows."""
    for name, schema in SCHEMAS.items():
        write(spark.createDataFrame([], schema), folder, name)
