"""Queries of the review over the test tables, each with an independent SQL form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import contains, detect, learning, report, sheets, store
from tessera.operators.score import LABELS, SEVERITY, Settings
from tessera.session import cut, table
from tessera.sources import workbooks

def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "review_items")


def _texts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items with their normalised text, and the distinct texts."""
    items = cut(_items(s, d).select("item_id", T.normalize(F.col("original_text")).alias("text")))
    return items, cut(items.select("text").distinct())


def _rules(s: SparkSession, d: str) -> DataFrame:
    return detect.rules(table(s, d, "nac_keywords"), table(s, d, "nac_synonyms"))


def normalized_items(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("item_id", T.normalize(F.col("original_text")).alias("normalized_text"))


def _rule_matches(s: SparkSession, d: str, inline: int) -> DataFrame:
    items, texts = _texts(s, d)
    ruled = cut(_rules(s, d))
    hit = detect.first_rule(texts, ruled, inline).join(ruled, "priority")
    return items.join(hit.select("text", "kind", "keyword_id", "keyword", "exact"), "text").select("item_id", F.col("kind").alias("match_type"), "keyword_id", F.col("keyword").alias("matched_keyword"), F.round("exact", 2).alias("exact_score"))


def rule_matches(s: SparkSession, d: str) -> DataFrame:
    return _rule_matches(s, d, detect.INLINE)


def rule_matches_by_join(s: SparkSession, d: str) -> DataFrame:
    return _rule_matches(s, d, 0)


def fuzzy_matches(s: SparkSession, d: str) -> DataFrame:
    items, texts = _texts(s, d)
    rest = texts.join(detect.first_rule(texts, _rules(s, d)).select("text"), "text", "left_anti")
    got = detect.fuzzy_keywords(s, rest, table(s, d, "nac_keywords"), Settings().fuzzy_threshold)
    return items.join(got, "text").select("item_id", "keyword_id", F.round("fuzzy", 2).alias("fuzzy_score"))


def allowable_contained(s: SparkSession, d: str) -> DataFrame:
    items, texts = _texts(s, d)
    terms = table(s, d, "allowable_keywords").filter("status = 'active'").select("keyword", T.normalize(F.col("keyword")).alias("pattern"))
    first = terms.filter("pattern <> ''").groupBy("pattern").agg(F.min("keyword").alias("keyword"))
    held = contains.containing(texts, first.select("pattern")).join(first, "pattern").groupBy("text").agg(F.min("keyword").alias("allowable_keyword"))
    return items.join(held, "text").select("item_id", "allowable_keyword")


def allowable_scores(s: SparkSession, d: str) -> DataFrame:
    items, texts = _texts(s, d)
    return items.join(detect.allowable(texts, table(s, d, "allowable_keywords")), "text").select("item_id", F.round("allowable_score", 2).alias("allowable_score"), "allowable_keyword")


def _dictionaries(s: SparkSession, d: str) -> list[DataFrame]:
    return [table(s, d, n) for n in ("nac_keywords", "nac_synonyms", "allowable_keywords", "exceptions", "feedback")]


def _reviewed(s: SparkSession, d: str) -> DataFrame:
    """The whole review: rules, fuzzy keywords, allowable terms, exceptions, feedback, scan quality, score and label."""
    return detect.review(s, _items(s, d), *_dictionaries(s, d))


def review(s: SparkSession, d: str) -> DataFrame:
    return _reviewed(s, d).select(
        "item_id", "matched_keyword", "matched_category", "match_type", "fuzzy_score", "semantic_score", "allowable_score", "final_confidence", "confidence_label", "manual_review",
        "suggested_synonym_candidate", "suggested_synonym_for_keyword", "synonym_suggestion_confidence",
    )


def review_typed(s: SparkSession, d: str) -> DataFrame:
    """One typed text."""
    out = detect.review_one(s, "Biaya konsumsi rapat koordinasi", *_dictionaries(s, d))
    return out.select("row_id", "matched_keyword", "match_type", "final_confidence", "confidence_label", "manual_review")


def _found(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items, texts = _texts(s, d)
    return items, cut(detect.match(s, texts, table(s, d, "nac_keywords"), table(s, d, "nac_synonyms"), Settings()))


def exception_hits(s: SparkSession, d: str) -> DataFrame:
    items, found = _found(s, d)
    hits = detect.exception_for(found.select("text", "keyword_id"), table(s, d, "exceptions"))
    return items.join(hits, "text").select("item_id", "exception_id", "penalty")


def feedback_adjustments(s: SparkSession, d: str) -> DataFrame:
    items, found = _found(s, d)
    got = detect.feedback_for(found.select("text", "keyword"), table(s, d, "feedback"))
    return items.join(got, "text").select("item_id", "adjustment")


def _report(of):
    """A report over the whole review, which is computed once for it."""

    def query(s: SparkSession, d: str) -> DataFrame:
        return of(cut(_reviewed(s, d).drop("normalized_text")))

    return query


def _filtered_results(r: DataFrame) -> DataFrame:
    return report.filtered(r, levels=["Sedang", "Tinggi", "Rendah"], manual_only=True, query="Paket 4").select("item_id", "confidence_label")


def _potential_findings(r: DataFrame) -> DataFrame:
    return report.potential_findings(r).select("item_id", "row_id", "source_file", "page_or_sheet", "judul_rab", "section", "item_per_rab", "matched_category", "matched_keyword", "match_type", "final_confidence", "confidence_label")


def _all_materials(r: DataFrame) -> DataFrame:
    return report.by_row_number(report.all_materials(r)).select("item_id", "row_id", "item", "category", "confidence", "confidence_label")


REPORTS = {"filtered_results": _filtered_results, "potential_findings": _potential_findings, "review_metrics": report.metrics, "export_summary": report.export_summary, "all_materials": _all_materials}


def _learning(name: str):
    def query(s: SparkSession, d: str) -> DataFrame:
        return learning.summary(table(s, d, "feedback"))[name]

    return query


def learning_totals(s: SparkSession, d: str) -> DataFrame:
    return learning.totals(table(s, d, "feedback"))


def keyword_aliases(s: SparkSession, d: str) -> DataFrame:
    return learning.aliases(table(s, d, "nac_keywords"), table(s, d, "nac_synonyms"))


def keyword_filter(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "nac_keywords")
    named = k.join(learning.aliases(k, table(s, d, "nac_synonyms")).select(F.col("keyword_id").alias("id"), "aliases"), "id")
    return learning.filter_keywords(named, severities=["high", "medium"], statuses=["active"], query="wisata").select("id", "keyword", "aliases")


def option_lists(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "nac_keywords")
    parts = [learning.options(k, c).select(F.lit(c).alias("name"), F.col(c).alias("option")) for c in ("category", "severity", "status")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def keyword_lookup(s: SparkSession, d: str) -> DataFrame:
    return store.lookup(table(s, d, "nac_keywords"), "ARISAN BULANAN").select("id", "keyword", "status")


def synonyms_with_keywords(s: SparkSession, d: str) -> DataFrame:
    return store.synonyms_with_keywords(table(s, d, "nac_keywords"), table(s, d, "nac_synonyms")).select("id", "synonym", "parent_keyword", "category")


def store_deactivated(s: SparkSession, d: str) -> DataFrame:
    k = table(s, d, "nac_keywords")
    return store.set_status(k, k.filter("severity = 'low'").select("id"), "inactive", "2030-01-01T00:00:00").select("id", "status", "updated_at")


def store_deleted(s: SparkSession, d: str) -> DataFrame:
    k, y, e = table(s, d, "nac_keywords"), table(s, d, "nac_synonyms"), table(s, d, "exceptions")
    out = store.delete_keywords(k, y, e, k.filter("severity = 'low'").select("id"))
    return out[0].select(F.lit("k").alias("kind"), "id").unionByName(out[1].select(F.lit("s").alias("kind"), "id")).unionByName(out[2].select(F.lit("e").alias("kind"), "id"))


def store_inserted(s: SparkSession, d: str) -> DataFrame:
    """Synonyms taken over as keywords where there is none of that text yet."""
    k = table(s, d, "nac_keywords")
    new = table(s, d, "nac_synonyms").groupBy(F.lower("synonym").alias("keyword")).agg(F.lit("active").alias("status"))
    return store.insert_absent(k, new, ["keyword"]).select("id", "keyword")


def _fuzzy_rows(s: SparkSession, d: str) -> DataFrame:
    """Feedback laid out as reviewed rows whose wording is a candidate synonym."""
    f = table(s, d, "feedback")
    wording = F.col("user_suggested_redaction").alias("suggested_synonym_candidate")
    return f.select(F.col("id").alias("item_id"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("row_id"), "original_text", F.col("original_text").alias("item_per_rab"), "matched_keyword", wording, F.col("matched_keyword").alias("suggested_synonym_for_keyword"))


def store_feedback_saved(s: SparkSession, d: str) -> DataFrame:
    out = store.save_feedback(table(s, d, "feedback"), _fuzzy_rows(s, d), "R3 | any text", "Not NAC", "ganti", "catatan", "2030-01-01T00:00:00")
    return out.select("id", "original_text", "matched_keyword", "feedback_type", "user_suggested_redaction", "reviewer_notes", "created_at")


def store_synonym_approved(s: SparkSession, d: str) -> DataFrame:
    """Synonyms and feedback after a candidate for the first keyword without blanks at its ends was approved."""
    k, y, f = (table(s, d, n) for n in ("nac_keywords", "nac_synonyms", "feedback"))
    first = k.filter("trim(keyword) = keyword").groupBy().agg(F.min_by("keyword", "id").alias("of"))
    rows = s.range(1).select(F.lit(1).cast("long").alias("item_id"), F.lit("R1").alias("row_id"), F.lit("teks").alias("original_text"), F.lit("sebutan lain").alias("suggested_synonym_candidate"), F.lit("").alias("matched_keyword"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("suggested_synonym_for_keyword", F.upper("of"))
    synonyms, feedback = store.approve_synonym(rows, "R1 | teks", k, y, f, now="2030-01-01T00:00:00")
    return synonyms.select(F.lit("s").alias("kind"), "id", F.col("synonym").alias("wording"), "created_at").unionByName(feedback.select(F.lit("f").alias("kind"), "id", F.col("user_suggested_redaction").alias("wording"), "created_at"))


def store_keyword_added(s: SparkSession, d: str) -> DataFrame:
    k = store.add_keyword(table(s, d, "nac_keywords"), " Uang Kopi Panitia ", now="2030-01-01T00:00:00")
    return k.select("id", "category", "keyword", "severity", "status", "created_by", "created_at")


def store_settings_saved(s: SparkSession, d: str) -> DataFrame:
    """Settings after one mode was saved over another."""
    none = s.createDataFrame([], store.SCHEMAS["settings"])
    return store.save_settings(store.save_settings(none, {**store.settings_for_mode("Ketat"), "bahasa": "id"}), store.settings_for_mode("Lebih sensitif", semantic=True))


def store_imported(s: SparkSession, d: str) -> DataFrame:
    """Allowable terms imported as keywords, with blank fields filled, and their synonyms."""
    t = table(s, d, "allowable_keywords").groupBy("keyword").agg(F.max("category").alias("category"))
    sheet = t.select("keyword", "category", F.concat(F.lower("keyword"), F.lit("; ;")).alias("synonyms"), F.lit("").alias("severity"))
    k, y = store.add_imported(table(s, d, "nac_keywords"), table(s, d, "nac_synonyms"), sheet, "2030-01-01T00:00:00")
    return k.select(F.lit("k").alias("kind"), F.col("keyword").alias("wording"), "category", "severity").unionByName(y.select(F.lit("s").alias("kind"), F.col("synonym").alias("wording"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("severity")))


def row_selection(s: SparkSession, d: str) -> DataFrame:
    return store.row_choices(_fuzzy_rows(s, d), with_synonym=True)


def keyword_workbook(s: SparkSession, d: str) -> DataFrame:
    """The rows of the sheet of synonyms as they are exported."""
    sheet = workbooks.keyword_sheets(*_dictionaries(s, d)[:4])["Synonyms"]
    return sheet.select("id", "synonym", "weight", "status", "parent_keyword", "category", "severity")


def feedback_log(s: SparkSession, d: str) -> DataFrame:
    return workbooks.feedback_log(table(s, d, "feedback")).select("id", "feedback_type", "created_at")


def text_chunks(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("part", "chunk"))


def item_names(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("item_id", T.short_item(F.col("original_text")).alias("short_item"), T.selector(F.col("row_id"), F.col("item_per_rab")).alias("selector"), T.safe_filename(F.col("source_file")).alias("file_name"))


def semantic_matches(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    keys = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id")
    out = detect.semantic(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), keys.select(F.col("vec_id").alias("keyword_id"), F.col("embedding").alias("vector")), threshold=10.0)
    return out.select("item_id", "keyword_id", F.round("semantic", 3).alias("semantic"))


def _sheet_rows(s: SparkSession, d: str) -> DataFrame:
    """Items laid out as sheet rows: a number before two thirds of them, details on some."""
    i = _items(s, d).filter("source_quality = 'table' and item_per_rab is not null")
    no = F.when(F.col("item_id") % 3 == 0, "").otherwise((F.col("item_id") % 50).cast("string"))
    bare = F.col("item_id") % 7 == 1
    cells = F.array(no, F.col("item_per_rab"), F.when(bare, "").otherwise(F.coalesce("unit", F.lit(""))), F.when(bare, "").otherwise(F.coalesce("volume", F.lit(""))), F.when(bare, "").otherwise(F.coalesce("unit_price", F.lit(""))), F.lit(""), F.lit(""))
    return i.select(F.coalesce("source_file", F.lit("")).alias("file"), F.lit("Sheet1").alias("sheet"), F.lit(0).alias("sheet_idx"), F.col("item_id").cast("int").alias("row_idx"), cells.alias("cells"))


def sheet_lines(s: SparkSession, d: str) -> DataFrame:
    return sheets.rab_lines(_sheet_rows(s, d)).select("file", "row_idx", "row_id", "item_per_rab", "section")


QUERIES = {
    f.__name__: f
    for f in (
        review, review_typed, normalized_items, rule_matches, rule_matches_by_join, fuzzy_matches, allowable_contained, allowable_scores, exception_hits, feedback_adjustments, learning_totals, keyword_aliases, keyword_filter, option_lists, keyword_lookup,
        synonyms_with_keywords, store_deactivated, store_deleted, store_inserted, store_feedback_saved, store_synonym_approved, store_keyword_added, store_settings_saved, store_imported, row_selection,
        keyword_workbook, feedback_log, text_chunks, item_names, semantic_matches, sheet_lines,
    )
} | {f"learning_{n}": _learning(n) for n in ("not_confirmed", "confirmed", "new_keywords", "synonyms", "pairs", "exception_candidates")} | {name: _report(of) for name, of in REPORTS.items()}

# --- SQL ------------------------------------------------------------------------------------------------------

_SP = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def _norm(c: str) -> str:
    t = f"lower(coalesce({c}, ''))"
    w = r"[^\p{L}\p{N}_]"
    for a, b in T.ABBREVIATIONS:
        for _ in range(2):
            t = rf"regexp_replace({t}, '(^|{w}){a}($|{w})', '\1{b}\2', 'g')"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}{_SP}%./,-]', ' ', 'g')"
    return rf"trim(regexp_replace({t}, '[{_SP}]+', ' ', 'g'))"


_BASE = f"""
WITH item AS (SELECT *, {_norm('original_text')} AS text FROM review_items),
txt AS (SELECT DISTINCT text FROM item),
rule AS (
  SELECT 0 AS c, coalesce(category, '') AS a, coalesce(keyword, '') AS b, id, 'exact' AS kind, {_norm('keyword')} AS pattern,
         id AS keyword_id, keyword, category, severity, 100.0::DOUBLE AS exact, 100.0::DOUBLE AS fuzzy
  FROM nac_keywords WHERE status = 'active'
  UNION ALL
  SELECT 1, coalesce(s.synonym, ''), '', s.id, 'synonym', {_norm('s.synonym')}, s.nac_keyword_id, k.keyword, k.category, k.severity,
         coalesce(s.weight, 0.9) * 100, 95.0
  FROM nac_synonyms s LEFT JOIN nac_keywords k ON k.id = s.nac_keyword_id WHERE s.status = 'active'),
hit AS (
  SELECT text, r.* FROM txt JOIN rule r ON r.pattern <> '' AND contains(text, r.pattern)
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY c, a, b, id) = 1)
"""

#: Longest common subsequence by a bit-parallel recurrence, and letters in common, each as often as both have it.
_LCS = """(length({a}) - bit_count(list_reduce(list_prepend((1::HUGEINT << length({a})) - 1, list_transform(string_split({b}, ''), lambda c:
  list_sum(list_transform(range(length({a})), lambda i: CASE WHEN {a}[i + 1] = c THEN 1::HUGEINT << i ELSE 0 END))::HUGEINT)),
  lambda s, h: ((s + (s & h)) | (s - (s & h))) & ((1::HUGEINT << length({a})) - 1))))"""
_SAME = "list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, '')))))"

#: Fuzzy keywords: all windows of the texts without a rule against all keywords; letters in common leave out most.
_FUZZY = f""",
listed AS (SELECT keyword, min(ord) AS place, arg_max(id, ord) AS id, length(keyword) AS m FROM (
  SELECT *, row_number() OVER (ORDER BY category, keyword, id) AS ord FROM nac_keywords WHERE status = 'active' AND keyword IS NOT NULL) GROUP BY keyword HAVING keyword <> ''),
rest AS (SELECT text, length(text) AS n FROM txt ANTI JOIN hit USING (text) WHERE text <> ''),
win AS MATERIALIZED (
  SELECT DISTINCT text, m, unnest(list_transform(range(2 - m, n + 1), lambda i: text[greatest(i, 1):least(i + m - 1, n)])) AS w FROM rest, (SELECT DISTINCT m FROM listed) WHERE n >= m),
near AS (SELECT keyword, place, id, m, w FROM (SELECT DISTINCT m, w FROM win) JOIN listed USING (m) WHERE 200.0 * {_SAME.format(a='keyword', b='w')} >= 77.9 * (m + length(w))),
close AS MATERIALIZED (SELECT keyword, place, id, m, w, 200.0 * {_LCS.format(a='keyword', b='w')} / (m + length(w)) AS v FROM near),
turned AS (SELECT DISTINCT text, place, id, unnest(list_transform(range(2 - n, m + 1), lambda i: keyword[greatest(i, 1):least(i + n - 1, m)])) AS w FROM rest JOIN listed ON n <= m),
fuz AS MATERIALIZED (SELECT text, arg_min(id, (-v, place)) AS keyword_id, max(v) AS fuzzy FROM (
  SELECT text, place, id, v FROM win JOIN close USING (w, m)
  UNION ALL SELECT text, place, id, 200.0 * {_LCS.format(a='text', b='w')} / (length(text) + length(w)) FROM turned) WHERE v >= 78 GROUP BY text)"""

#: Allowable terms: token sets in common, and, where the lengths allow it, the letters of what is not.
_ALLOWED = f""",
term AS MATERIALIZED (SELECT pattern, min(keyword) AS keyword, list_distinct(string_split(pattern, ' ')) AS b FROM (SELECT {_norm('keyword')} AS pattern, keyword FROM allowable_keywords WHERE status = 'active')
  WHERE pattern <> '' GROUP BY pattern),
tx AS MATERIALIZED (SELECT text, list_distinct(string_split(text, ' ')) AS a FROM txt WHERE text <> ''),
share AS MATERIALIZED (SELECT text, pattern, count(*) AS k, sum(length(w)) AS s FROM (SELECT text, unnest(a) AS w FROM tx) JOIN (SELECT pattern, unnest(b) AS w FROM term) USING (w) GROUP BY ALL),
sized AS (SELECT text, pattern, a, b, len(a) AS ka, len(b) AS kb, length(array_to_string(a, ' ')) AS la, length(array_to_string(b, ' ')) AS lb FROM tx, term),
by_words AS (SELECT text, pattern, CASE WHEN k IN (len(a), len(b)) THEN 100.0
    ELSE 200.0 * (s + k - 1) / (s + k - 1 + least(length(array_to_string(a, ' ')), length(array_to_string(b, ' ')))) END AS v
  FROM share JOIN tx USING (text) JOIN term USING (pattern)),
spelt AS (SELECT text, pattern, la, lb, coalesce(s + k - 1, 0) AS n, (k IS NOT NULL)::INT AS gap,
    array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS da, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS db
  FROM sized LEFT JOIN share USING (text, pattern)
  WHERE 200.0 * least(la, lb) >= 87.9 * (la + lb) AND 200.0 * (1 + {_SAME.format(a='pattern', b='text')}) >= 87.9 * (la + lb) AND coalesce(k, 0) NOT IN (ka, kb)),
by_letters AS (SELECT text, pattern, 200.0 * (n + gap + {_LCS.format(a='db', b='da')}) / (la + lb) AS v FROM spelt),
alw AS MATERIALIZED (SELECT text, arg_min(keyword, (-v, keyword)) AS allowable_keyword, max(v) AS allowable_score FROM (
  SELECT text, pattern, 100.0 AS v FROM txt JOIN term ON contains(text, pattern) UNION ALL FROM by_words UNION ALL FROM by_letters) JOIN term USING (pattern) WHERE v >= 88 GROUP BY text)"""

_FOUND = _BASE + _FUZZY + f""",
found AS MATERIALIZED (
  SELECT text, kind, keyword_id, keyword, category, severity, exact, fuzzy FROM hit
  UNION ALL SELECT text, 'fuzzy', keyword_id, keyword, category, severity, 0.0, fuzzy FROM fuz JOIN nac_keywords k ON k.id = keyword_id
  UNION ALL SELECT text, 'none', NULL, NULL, NULL, NULL, 0.0, 0.0 FROM txt ANTI JOIN hit USING (text) ANTI JOIN fuz USING (text)),
exn AS (SELECT *, {_norm('pattern')} AS norm FROM exceptions WHERE status = 'active'),
exh AS (
  SELECT text, e.id AS exception_id, e.action,
    CASE e.action WHEN 'ignore' THEN 100.0 WHEN 'manual_review' THEN 10.0 ELSE coalesce(nullif(weight_adjustment, 0), 25.0) END AS penalty
  FROM found f JOIN exn e ON e.norm <> '' AND contains(f.text, e.norm)
   AND (e.nac_keyword_id IS NULL OR e.nac_keyword_id = 0 OR e.nac_keyword_id = f.keyword_id)
  QUALIFY row_number() OVER (PARTITION BY text ORDER BY e.pattern, e.id) = 1),
fb AS (
  SELECT matched_keyword, substring(lower(coalesce(original_text, '')), 1, 30) AS sample, feedback_type, count(*) AS n FROM feedback GROUP BY ALL),
own AS (
  SELECT matched_keyword AS keyword, sum(n * CASE feedback_type WHEN 'Correct NAC' THEN 6 WHEN 'Not NAC' THEN -8 ELSE 0 END) AS own
  FROM fb WHERE matched_keyword <> '' GROUP BY 1),
other AS (
  SELECT text, sum(n * CASE feedback_type WHEN 'Confidence Too High' THEN -5 ELSE 5 END) AS other
  FROM found f JOIN fb ON sample <> '' AND contains(f.text, sample) AND feedback_type IN ('Confidence Too High', 'Confidence Too Low')
   AND (coalesce(f.keyword, '') = '' OR fb.matched_keyword IS NULL OR fb.matched_keyword <> f.keyword)
  GROUP BY 1),
adj AS (
  SELECT text, greatest(-30, least(30, CASE WHEN coalesce(keyword, '') <> '' THEN coalesce(own, 0) ELSE 0 END + coalesce(other, 0)))::DOUBLE AS adjustment
  FROM found LEFT JOIN own USING (keyword) LEFT JOIN other USING (text))"""

_REVIEWED = _FOUND + _ALLOWED + f""",
scored AS (
  SELECT item.*, keyword AS matched_keyword, category AS matched_category, kind AS match_type, action, fuzzy, coalesce(allowable_score, 0.0) AS allowed,
    greatest(0.0, least(100.0, 0.25 * exact + 0.2 * fuzzy + 0.3 * 0.0 + 0.1 * CASE coalesce(severity, 'medium') {' '.join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY.items())} ELSE 50.0 END
      + 0.1 * (adjustment + CASE WHEN source_quality = 'ocr' THEN -8 ELSE 0 END) - 0.2 * coalesce(allowable_score, 0.0) - coalesce(penalty, 0.0)))::DOUBLE AS score
  FROM item JOIN found USING (text) JOIN adj USING (text) LEFT JOIN exh USING (text) LEFT JOIN alw USING (text)),
reviewed AS (
  SELECT *, round(score, 2) AS final_confidence, CASE {' '.join(f"WHEN score <= {m} THEN '{n}'" for m, n in LABELS)} ELSE 'Sangat tinggi' END AS confidence_label,
    score >= 45 OR score >= 35 AND allowed >= 60 OR coalesce(action = 'manual_review', false) AS manual_review FROM scored)
"""

_RULES = _BASE + "SELECT item_id, kind AS match_type, keyword_id, keyword AS matched_keyword, round(exact, 2) AS exact_score FROM item JOIN hit USING (text)"
_KEY = "coalesce(nullif(matched_keyword, ''), substring(coalesce(original_text, ''), 1, 80))"
_HEAD = "substring(coalesce(original_text, ''), 1, 80)"


def _top(key: str, where: str, names: str = "item") -> str:
    return f"""SELECT {names}, "count" FROM (SELECT {key}, count(*) AS "count", max(struct_pack(a := coalesce(created_at, ''), i := id)) AS newest
FROM feedback WHERE {where} GROUP BY {names}) ORDER BY "count" DESC, newest DESC LIMIT 20"""


_TOPS = {
    "not_confirmed": _top(f"{_KEY} AS item", "feedback_type = 'Not NAC'"),
    "confirmed": _top(f"{_KEY} AS item", "feedback_type = 'Correct NAC'"),
    "new_keywords": _top(f"{_HEAD} AS item", "feedback_type = 'Add as New NAC Keyword'"),
    "synonyms": _top(f"{_KEY} AS item", "feedback_type = 'Add as Synonym'"),
    "pairs": _top(f"{_KEY} AS matched_key, user_suggested_redaction AS suggested_synonym", "feedback_type IN ('Correct NAC', 'Add as Synonym') AND user_suggested_redaction <> ''", "matched_key, suggested_synonym"),
    "exception_candidates": _top(f"{_HEAD} AS item", "feedback_type = 'Not NAC'"),
}

_CHUNKS = rf"""
WITH line AS (
  SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
    lambda x: regexp_replace(x, '^[{_SP}]+|[{_SP}]+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text <> ''),
folded AS (
  SELECT doc_id, text, CASE WHEN len(l) = 0 THEN NULL ELSE list_reduce(list_transform(l, lambda x: struct_pack(o := []::VARCHAR[], c := x)),
    lambda a, x: CASE WHEN length(a.c) + length(x.c) > {T.CHUNK} AND a.c <> '' THEN struct_pack(o := list_append(a.o, a.c), c := x.c)
                 ELSE struct_pack(o := a.o, c := CASE WHEN a.c = '' THEN x.c ELSE a.c || ' ' || x.c END) END) END AS r FROM line),
done AS (SELECT doc_id, CASE WHEN r IS NULL THEN [text] ELSE list_append(r.o, r.c) END AS cs FROM folded)
SELECT doc_id, unnest(range(len(cs)))::INT AS part, unnest(cs) AS chunk FROM done
"""

#: The phrase that could become a synonym: the shortest part of 4 to 90 letters, else the first ten words, else the keyword.
_PHRASE = r""",
cutup AS (SELECT *, list_filter(list_transform(string_split_regex(coalesce(original_text, ''), '[|;\n\r]+'), lambda x: regexp_replace(x, '^[\s\-:;,.]+|[\s\-:;,.]+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 90) AS parts,
    string_split(text, ' ') AS words FROM reviewed),
chosen AS (SELECT *, coalesce(parts[list_position(list_transform(parts, lambda x: length(x)), list_min(list_transform(parts, lambda x: length(x))))],
    CASE WHEN len(words) >= 2 THEN array_to_string(words[1:10], ' ') END, trim(coalesce(matched_keyword, ''))) AS phrase FROM cutup),
phrased AS (SELECT *, match_type = 'fuzzy' AND fuzzy >= 60 AND phrase <> '' AND lower(phrase) <> lower(matched_keyword) AS strong FROM chosen)
"""

SQL = {
    "normalized_items": f"SELECT item_id, {_norm('original_text')} AS normalized_text FROM review_items",
    "rule_matches": _RULES,
    "rule_matches_by_join": _RULES,
    "allowable_contained": _BASE
    + f""", term AS (SELECT {_norm('keyword')} AS pattern, min(keyword) AS keyword FROM allowable_keywords WHERE status = 'active' GROUP BY 1)
SELECT item_id, allowable_keyword FROM item JOIN (
  SELECT text, min(keyword) AS allowable_keyword FROM txt JOIN term ON pattern <> '' AND contains(text, pattern) GROUP BY 1) USING (text)""",
    "exception_hits": _FOUND + "SELECT item_id, exception_id, penalty FROM item JOIN exh USING (text)",
    "feedback_adjustments": _FOUND + "SELECT item_id, adjustment FROM item JOIN adj USING (text)",
    "fuzzy_matches": _BASE + _FUZZY + " SELECT item_id, keyword_id, round(fuzzy, 2) AS fuzzy_score FROM item JOIN fuz USING (text)",
    "allowable_scores": _BASE + _ALLOWED + " SELECT item_id, round(allowable_score, 2) AS allowable_score, allowable_keyword FROM item JOIN alw USING (text)",
    "review": _REVIEWED + _PHRASE + """SELECT item_id, matched_keyword, matched_category, match_type, round(fuzzy, 2) AS fuzzy_score, 0.0::DOUBLE AS semantic_score, round(allowed, 2) AS allowable_score, final_confidence,
confidence_label, manual_review, CASE WHEN strong THEN phrase END AS suggested_synonym_candidate, CASE WHEN strong THEN matched_keyword END AS suggested_synonym_for_keyword,
CASE WHEN strong THEN round(fuzzy, 2) ELSE 0.0 END::DOUBLE AS synonym_suggestion_confidence FROM phrased""",
    "review_typed": _REVIEWED.replace("FROM review_items)", "FROM (SELECT 'redaksi' AS row_id, 'Biaya konsumsi rapat koordinasi' AS original_text, '' AS source_quality))")
    + "SELECT row_id, matched_keyword, match_type, final_confidence, confidence_label, manual_review FROM reviewed",
    "filtered_results": _REVIEWED
    + """SELECT item_id, confidence_label FROM reviewed WHERE confidence_label IN ('Sedang', 'Tinggi', 'Rendah') AND manual_review
AND contains(lower(coalesce(item_per_rab, '') || ' ' || coalesce(original_text, '') || ' ' || coalesce(matched_keyword, '') || ' ' || coalesce(matched_category, '')), 'paket 4')""",
    "potential_findings": _REVIEWED
    + """SELECT item_id, row_id, source_file, page_or_sheet, judul_rab, section, item_per_rab, matched_category, matched_keyword, match_type, final_confidence, confidence_label
FROM reviewed WHERE confidence_label IN ('Sedang', 'Tinggi', 'Sangat tinggi')""",
    "review_metrics": _REVIEWED
    + """SELECT count(*) AS total, count(*) FILTER (confidence_label IN ('Sedang', 'Tinggi', 'Sangat tinggi')) AS potential,
count(*) FILTER (confidence_label IN ('Tinggi', 'Sangat tinggi')) AS high, coalesce(max(final_confidence), 0) AS top_confidence, count(*) FILTER (manual_review) AS manual FROM reviewed""",
    "export_summary": _REVIEWED
    + r""", priced AS (SELECT *, CASE WHEN regexp_full_match(trim(total_price), '[+-]?(\d+\.?\d*|\.\d+)') THEN total_price::DOUBLE END AS price FROM reviewed)
SELECT 'count_' || confidence_label AS metric, count(*)::DOUBLE AS value FROM priced GROUP BY 1
UNION ALL SELECT 'total_value_' || confidence_label, round(coalesce(sum(price), 0), 2) FROM priced GROUP BY 1
UNION ALL SELECT 'total_items_reviewed', count(*) FROM priced
UNION ALL SELECT 'count_potential_nac_high_very_high', count(*) FILTER (confidence_label IN ('Tinggi', 'Sangat tinggi')) FROM priced
UNION ALL SELECT 'total_value_detected_rows', round(coalesce(sum(price), 0), 2) FROM priced""",
    "all_materials": _REVIEWED
    + """SELECT item_id, row_id, coalesce(nullif(coalesce(item_per_rab, item_description), ''), '-') AS item, coalesce(nullif(matched_category, ''), '-') AS category,
final_confidence AS confidence, confidence_label FROM reviewed""",
    **{f"learning_{k}": v.replace("matched_key,", "matched_key AS matched_keyword,", 1) if k == "pairs" else v for k, v in _TOPS.items()},
    "learning_totals": " UNION ALL ".join(f"SELECT '{k}' AS report, coalesce(sum(\"count\"), 0)::BIGINT AS total FROM ({v})" for k, v in _TOPS.items()),
    "keyword_aliases": """SELECT k.id AS keyword_id, keyword, coalesce(s, '') AS aliases, coalesce(nullif(notes, ''), description, '') AS note FROM nac_keywords k
LEFT JOIN (SELECT nac_keyword_id, string_agg(synonym, ', ' ORDER BY synonym, id) AS s FROM nac_synonyms WHERE synonym <> '' GROUP BY 1) ON nac_keyword_id = k.id""",
    "keyword_filter": """SELECT k.id, keyword, coalesce(s, '') AS aliases FROM nac_keywords k
LEFT JOIN (SELECT nac_keyword_id, string_agg(synonym, ', ' ORDER BY synonym, id) AS s FROM nac_synonyms WHERE synonym <> '' GROUP BY 1) ON nac_keyword_id = k.id
WHERE severity IN ('high', 'medium') AND status = 'active'
AND contains(lower(concat_ws(' ', coalesce(keyword, ''), coalesce(category, ''), coalesce(severity, ''), coalesce(status, ''), coalesce(description, ''), coalesce(reference, ''), coalesce(notes, ''), coalesce(s, ''))), 'wisata')""",
    "option_lists": """SELECT DISTINCT 'category' AS name, category AS option FROM nac_keywords WHERE trim(category) <> ''
UNION ALL SELECT DISTINCT 'severity', severity FROM nac_keywords WHERE trim(severity) <> '' UNION ALL SELECT DISTINCT 'status', status FROM nac_keywords WHERE trim(status) <> ''""",
    "keyword_lookup": "SELECT id, keyword, status FROM nac_keywords WHERE lower(keyword) = 'arisan bulanan' ORDER BY id LIMIT 1",
    "synonyms_with_keywords": "SELECT s.id, synonym, k.keyword AS parent_keyword, category FROM nac_synonyms s LEFT JOIN nac_keywords k ON k.id = s.nac_keyword_id WHERE s.status = 'active'",
    "store_deactivated": "SELECT id, CASE WHEN severity = 'low' THEN 'inactive' ELSE status END AS status, CASE WHEN severity = 'low' THEN '2030-01-01T00:00:00' ELSE updated_at END AS updated_at FROM nac_keywords",
    "store_deleted": """WITH gone AS (SELECT id FROM nac_keywords WHERE severity = 'low')
SELECT 'k' AS kind, id FROM nac_keywords WHERE id NOT IN (FROM gone) UNION ALL SELECT 's', id FROM nac_synonyms WHERE nac_keyword_id IS NULL OR nac_keyword_id NOT IN (FROM gone)
UNION ALL SELECT 'e', id FROM exceptions WHERE nac_keyword_id IS NULL OR nac_keyword_id NOT IN (FROM gone)""",
    "store_inserted": """SELECT id, keyword FROM nac_keywords UNION ALL
SELECT (SELECT max(id) FROM nac_keywords) + row_number() OVER (ORDER BY keyword), keyword FROM (SELECT DISTINCT lower(synonym) AS keyword FROM nac_synonyms)
WHERE keyword NOT IN (SELECT lower(keyword) FROM nac_keywords)""",
    "store_feedback_saved": """SELECT id, original_text, matched_keyword, feedback_type, user_suggested_redaction, reviewer_notes, created_at FROM feedback
UNION ALL SELECT (SELECT max(id) + 1 FROM feedback), coalesce(original_text, ''), coalesce(matched_keyword, ''), 'Not NAC', 'ganti', 'catatan', '2030-01-01T00:00:00' FROM feedback WHERE id = 3""",
    "store_synonym_approved": """SELECT 's' AS kind, id, synonym AS wording, created_at FROM nac_synonyms UNION ALL SELECT 'f', id, user_suggested_redaction, created_at FROM feedback
UNION ALL SELECT 's', max(id) + 1, 'sebutan lain', '2030-01-01T00:00:00' FROM nac_synonyms UNION ALL SELECT 'f', max(id) + 1, 'sebutan lain', '2030-01-01T00:00:00' FROM feedback""",
    "store_keyword_added": """SELECT id, category, keyword, severity, status, created_by, created_at FROM nac_keywords
UNION ALL SELECT max(id) + 1, 'Umum', 'Uang Kopi Panitia', 'medium', 'active', 'user', '2030-01-01T00:00:00' FROM nac_keywords""",
    "store_settings_saved": """SELECT * FROM (VALUES ('bahasa', 'id'), ('enable_semantic', 'true'), ('enable_stemming', 'false'), ('fuzzy_threshold', '68'), ('semantic_threshold', '52'), ('ocr_mode', 'auto'),
('semantic_user_configured', 'true')) AS t(key, value)""",
    "store_imported": """WITH t AS (SELECT keyword, trim(keyword) AS w, max(category) AS category FROM allowable_keywords GROUP BY ALL), n AS (SELECT * FROM t WHERE w <> '')
SELECT 'k' AS kind, keyword AS wording, category, severity FROM nac_keywords UNION ALL SELECT 'k', w, coalesce(nullif(trim(category), ''), 'Umum'), 'medium' FROM n
UNION ALL SELECT 's', synonym, NULL, NULL FROM nac_synonyms
UNION ALL SELECT 's', trim(x), NULL, NULL FROM (SELECT unnest(string_split(lower(keyword), ';')) AS x FROM n) WHERE trim(x) <> ''""",
    "row_selection": """SELECT id AS item_id, 'R' || id || ' | ' || substring(coalesce(original_text, ''), 1, 80) AS choice FROM feedback WHERE trim(coalesce(user_suggested_redaction, '')) <> ''""",
    "keyword_workbook": "SELECT s.id, synonym, weight, s.status, k.keyword AS parent_keyword, category, severity FROM nac_synonyms s LEFT JOIN nac_keywords k ON k.id = s.nac_keyword_id",
    "feedback_log": "SELECT id, feedback_type, created_at FROM feedback",
    "text_chunks": _CHUNKS,
    "item_names": rf"""WITH i AS (SELECT *, list_filter(list_transform(string_split(coalesce(original_text, ''), '|'), lambda x: regexp_replace(x, '^[{_SP}]+|[{_SP}]+$', '', 'g')), lambda x: x <> '')[-1] AS last FROM review_items)
SELECT item_id, CASE WHEN last IS NULL THEN 'Item RAB' WHEN length(last) > 80 THEN regexp_replace(substring(last, 1, 77), '[{_SP}]+$', '') || '...' ELSE last END AS short_item,
row_id || ' | ' || substring(coalesce(item_per_rab, ''), 1, 80) AS selector,
coalesce(nullif(regexp_replace(regexp_replace(coalesce(source_file, ''), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'upload') AS file_name FROM i""",
    "semantic_matches": """WITH k AS (SELECT vec_id AS kid, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)),
s AS (SELECT vec_id AS item_id, kid, 100 * list_inner_product(embedding::DOUBLE[], w) / (greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9) * greatest(sqrt(list_inner_product(w, w)), 1e-9)) AS v FROM embeddings, k)
SELECT item_id, kid AS keyword_id, round(v, 3) AS semantic FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY v DESC, kid) = 1 AND v >= 10""",
    "sheet_lines": """WITH i AS (
  SELECT coalesce(source_file, '') AS file, item_id::INT AS row_idx, CASE WHEN item_id % 3 = 0 THEN '' ELSE (item_id % 50)::VARCHAR END AS no, trim(item_per_rab) AS d,
    item_id % 7 <> 1 AND (trim(coalesce(unit, '')) <> '' OR trim(coalesce(volume, '')) <> '' OR trim(coalesce(unit_price, '')) <> '') AS detail
  FROM review_items WHERE source_quality = 'table' AND item_per_rab IS NOT NULL),
r AS (SELECT *, no <> '' AS numbered FROM i WHERE d <> '' AND try_cast(d AS DOUBLE) IS NULL
  AND (starts_with(lower(d), 'biaya ') OR NOT regexp_matches(lower(d), 'nama barang|nama material|uraian kegiatan|harga satuan|jumlah|satuan'))),
b AS (SELECT *, sum(numbered::INT) OVER (PARTITION BY file ORDER BY row_idx) AS block FROM r),
c AS (SELECT *, min((detail OR numbered)::INT) OVER w = 1 AS whole, first_value(numbered AND NOT detail) OVER w AS grouped, first_value(d) OVER w AS grp, first_value(no) OVER w AS gno
  FROM b WINDOW w AS (PARTITION BY file, block ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, NOT numbered AND block > 0 AND grouped AND whole AS child FROM c),
f AS (SELECT *, sum(child::INT) OVER (PARTITION BY file, block ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS k,
    last_value(CASE WHEN NOT numbered AND NOT child THEN d END IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM e)
SELECT file, row_idx, CASE WHEN numbered THEN no ELSE gno || '.' || k END AS row_id, d AS item_per_rab, CASE WHEN numbered THEN coalesce(above, '') ELSE grp END AS section
FROM f WHERE numbered OR child""",
}
