"""What past feedback teaches: most frequent keys by kind of feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a report (the feature of a top list).
TOP = 20


def _key() -> Column:
    """The keyword, or the first 80 characters of the text where it is blank."""
    return F.coalesce(F.nullif(F.col("matched_keyword"), F.lit("")), _text())


def _text() -> Column:
    return F.substring(F.coalesce("original_text", F.lit("")), 1, 80)


def _top(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The most frequent keys; of equal counts the one met first in the newest feedback."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("count"), F.max(F.struct(F.coalesce("created_at", F.lit("")).alias("at"), F.col("id"))).alias("newest"))
    return counted.orderBy(F.desc("count"), F.desc("newest")).limit(top).select(*keys, "count")


def top_items(feedback: DataFrame, kinds: list[str], by_text: bool = False, top: int = TOP) -> DataFrame:
    rows = feedback.filter(F.col("feedback_type").isin(kinds)).select("id", "created_at", (_text() if by_text else _key()).alias("item"))
    return _top(rows, ["item"], top)


def top_pairs(feedback: DataFrame, top: int = TOP) -> DataFrame:
    """Keys with the wording that users proposed, of confirmed findings and synonyms."""
    rows = feedback.filter(F.col("feedback_type").isin("Correct NAC", "Add as Synonym")).filter("user_suggested_redaction <> ''")
    return _top(rows.select("id", "created_at", _key().alias("matched_keyword"), F.col("user_suggested_redaction").alias("suggested_synonym")), ["matched_keyword", "suggested_synonym"], top)


def summary(feedback: DataFrame) -> dict[str, DataFrame]:
    """The reports by name. 'confirmed' counts feedback that a finding was right."""
    return {
        "not_confirmed": top_items(feedback, ["Not NAC"]),
        "confirmed": top_items(feedback, ["Correct NAC"]),
        "new_keywords": top_items(feedback, ["Add as New NAC Keyword"], by_text=True),
        "synonyms": top_items(feedback, ["Add as Synonym"]),
        "pairs": top_pairs(feedback),
        "exception_candidates": top_items(feedback, ["Not NAC"], by_text=True),
    }


def totals(feedback: DataFrame) -> DataFrame:
    """(report, total): the sum of the counts that each report shows."""
    out = None
    for name, df in summary(feedback).items():
        one = df.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total")).select(F.lit(name).alias("report"), "total")
        out = one if out is None else out.unionByName(one)
    return out


def aliases(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Each keyword with its synonyms in order, joined by commas, and its note (or description)."""
    s = synonyms.filter("synonym <> ''").groupBy("nac_keyword_id").agg(F.array_sort(F.collect_list(F.struct("synonym", "id"))).alias("s"))
    joined = F.array_join(F.transform("s", lambda x: x["synonym"]), ", ")
    k = keywords.select(F.col("id").alias("nac_keyword_id"), "keyword", F.coalesce(F.nullif(F.col("notes"), F.lit("")), "description", F.lit("")).alias("note"))
    return k.join(s, "nac_keyword_id", "left").select(F.col("nac_keyword_id").alias("keyword_id"), "keyword", F.coalesce(joined, F.lit("")).alias("aliases"), "note")


def options(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not blank."""
    return df.select(column).filter(F.trim(column) != "").distinct()


def filter_keywords(aliased: DataFrame, categories: list[str] | None = None, severities: list[str] | None = None, statuses: list[str] | None = None, query: str = "") -> DataFrame:
    """Rows of keywords whose category, severity and status are listed (no list: all) and that hold the query in any text."""
    out = aliased
    for column, listed in (("category", categories), ("severity", severities), ("status", statuses)):
        if listed:
            out = out.filter(F.col(column).isin(listed))
    if query.strip():
        names = [c for c in ("keyword", "category", "severity", "status", "description", "reference", "notes", "aliases") if c in out.columns]
        out = out.filter(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in names])), F.lit(query.strip().lower())))
    return out

