import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import contains, detect, learning, report, sheets, store
from tessera.operators.contains import containing
from tessera.operators.score import Settings, label
from tessera.plans import catalog
from tessera.session import attach, bounded_sample

SMALL = "/root/testdata/sf0.001"


def test_containing_is_brute_force(spark, monkeypatch):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    texts = sorted({" ".join(word() for _ in range(r.randint(1, 8))) for _ in range(80)})
    patterns = sorted({" ".join(word() for _ in range(r.randint(1, 4))) for _ in range(80)} | {"a", "b c"})
    got = containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    assert {tuple(x) for x in got.collect()} == {(t, p) for t in texts for p in patterns if p in t}
    # The same where the words' map is too large to be sent, with all frequent words spread over tasks.
    monkeypatch.setattr(contains, "TASK", 5)
    spread = containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"), sent=0)
    rows = [tuple(x) for x in spread.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(t, p) for t in texts for p in patterns if p in t}


KEYWORDS = "id long, category string, keyword string, description string, reference string, severity string, status string, created_by string, created_at string, updated_at string, notes string"
SYNONYMS = "id long, nac_keyword_id long, synonym string, weight double, status string, created_at string"
TERMS = "id long, category string, keyword string, description string, status string, created_at string"
EXCEPTIONS = "id long, nac_keyword_id long, pattern string, reason string, action string, weight_adjustment double, status string, created_at string"
FEEDBACK = "id long, row_id string, original_text string, matched_keyword string, feedback_type string, user_suggested_redaction string, reviewer_notes string, created_at string"


def dictionaries(spark):
    k = lambda i, c, w, s, st="active": (i, c, w, None, None, s, st, None, None, None, None)
    return (
        spark.createDataFrame([k(1, "Denda/Sanksi", "denda", "high"), k(2, "Rapat/Jamuan", "konsumsi", "high"), k(3, "Rapat/Jamuan", "konsumsi rapat", "medium"), k(4, "Rapat/Jamuan", "snack", "high"), k(5, "Pribadi/Hadiah", "biaya pribadi", "very_high"), k(6, "X", "mati", "high", "inactive")], KEYWORDS),
        spark.createDataFrame([(1, 2, "katering", 0.9, "active", None), (2, 6, "kuburan", 0.9, "active", None), (3, 99, "yatim", None, "active", None)], SYNONYMS),
        spark.createDataFrame([(1, "Teknis", "material konstruksi", None, "active", None), (2, "Teknis", "bahan bakar genset", None, "active", None)], TERMS),
        spark.createDataFrame([(1, None, "konsumsi bahan bakar", "bbm", "lower_confidence", 35.0, "active", None), (2, 1, "denda wajar", "x", "ignore", 0.0, "active", None), (3, None, "aneh", "x", "lain", 0.0, "active", None)], EXCEPTIONS),
        spark.createDataFrame([], FEEDBACK),
    )


def test_review_golden(spark):
    cases = {
        "Biaya konsumsi rapat koordinasi": ("exact", "konsumsi", 52.5, "Sedang"),
        "Biaya pribadi direksi": ("exact", "biaya pribadi", 55.0, "Sedang"),
        "Katering acara": ("synonym", "konsumsi", 49.0, "Sedang"),
        "Tanah kuburan": ("synonym", "mati", 49.0, "Sedang"),
        "Rumah yatim": ("synonym", None, 46.5, "Sedang"),
        "Konsumsi bahan bakar genset": ("exact", "konsumsi", 0.0, "Sangat rendah"),
        "Material konstruksi panel": ("none", None, 0.0, "Sangat rendah"),
        "biaya": ("fuzzy", "biaya pribadi", 30.0, "Rendah"),
        "Snak meting": ("fuzzy", "snack", 25.28, "Rendah"),
        "Pengadaan kabel NYY 4x16mm": ("none", None, 5.0, "Sangat rendah"),
        "denda wajar": ("exact", "denda", 0.0, "Sangat rendah"),
        "denda aneh": ("exact", "denda", 27.5, "Rendah"),
        "": ("none", None, 5.0, "Sangat rendah"),
    }
    rows = [(i, t, "table", "clash") for i, t in enumerate(cases)] + [(100, "Biaya konsumsi rapat koordinasi", "ocr", None), (101, None, None, None)]
    items = spark.createDataFrame(rows, "item_id long, original_text string, source_quality string, severity string")
    got = {r.item_id: r for r in detect.review(spark, items, *dictionaries(spark)).collect()}
    for i, (t, want) in enumerate(cases.items()):
        r = got[i]
        assert (r.match_type, r.matched_keyword, r.final_confidence, r.confidence_label) == want, t
    assert got[100].final_confidence == 51.7 and got[101].match_type == "none" and len(got) == len(rows)


def test_keywords_by_meaning(spark, monkeypatch):
    monkeypatch.setattr(detect, "LISTED", 2)  # keywords in several parts
    k, s, *_ = dictionaries(spark)
    words = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 2.0]), (4, None), (5, [1.0, 1.0, 1.0])], "keyword_id long, vector array<double>")
    texts = ["denda", "katering", "snak", "nihil", "kosong", "lain"]
    vectors = [[0.0, 3.0], [0.0, 1.0], [0.8, 0.6], [0.6, 0.8], None, [1.0]]
    rows = spark.createDataFrame(list(zip(texts, vectors)), "text string, vector array<double>")
    near = detect.semantic(rows, words, 60.0, "text")
    assert {r.text: (r.keyword_id, round(r.semantic, 6)) for r in near.collect()} == {"denda": (2, 100.0), "katering": (2, 100.0), "snak": (1, 80.0), "nihil": (2, 80.0)}
    got = {r.text: (r.kind, r.keyword, r.exact, round(r.fuzzy, 2), round(r.semantic, 2)) for r in detect.match(spark, rows.select("text"), k, s, Settings(), near).collect()}
    assert got["denda"] == ("exact", "denda", 100.0, 100.0, 100.0)  # an equal score lets the exact one stay
    assert got["katering"] == ("semantic", "konsumsi", 0.0, 95.0, 100.0)  # 100 is over 90 and 95
    assert got["snak"] == ("fuzzy", "snack", 0.0, 85.71, 80.0)
    assert got["nihil"] == ("semantic", "konsumsi", 0.0, 0.0, 80.0) and got["kosong"][0] == got["lain"][0] == "none"
    one = detect.review_one(spark, " Biaya pribadi direksi ", *dictionaries(spark)).collect()
    assert [(r.row_id, r.matched_keyword, r.final_confidence) for r in one] == [("redaksi", "biaya pribadi", 55.0)]
    assert detect.review_one(spark, "  ", *dictionaries(spark)).count() == 0


def test_rules_inline_or_joined_and_feedback(spark):
    k, s, *_ = dictionaries(spark)
    texts = spark.createDataFrame([(t,) for t in ["biaya konsumsi rapat", "katering", "snack konsumsi", "nihil"]], "text string")
    ruled = detect.rules(k, s)
    a, b = ({tuple(r) for r in detect.first_rule(texts, ruled, n).select("text", "priority").collect()} for n in (400, 0))
    assert a == b and len(a) == 3
    fb = [(i, None, "x", "konsumsi", "Correct NAC", None, None, None) for i in range(9)] + [(20, None, "Biaya konsumsi", "snack", "Confidence Too High", None, None, None), (21, None, "a | b", None, "Confidence Too Low", None, None, None)]
    out = detect.feedback_for(spark.createDataFrame([("biaya konsumsi rapat", "konsumsi"), ("biaya konsumsi", None), ("snack", "snack")], "text string, keyword string"), spark.createDataFrame(fb, FEEDBACK))
    assert {r.text: r.adjustment for r in out.collect()} == {"biaya konsumsi rapat": 30.0, "biaya konsumsi": -5.0, "snack": 0.0}


def test_labels(spark):
    scores = [24.0, 24.5, 44.0, 44.5, 64.0, 84.0, 84.1, None, 200.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(scores)], "i int, s double").select("i", label(F.col("s")).alias("l"))
    assert [r.l for r in df.orderBy("i").collect()] == ["Sangat rendah", "Rendah", "Rendah", "Sedang", "Sedang", "Tinggi", "Sangat tinggi", "Sangat rendah", "Sangat tinggi"]
    assert Settings.for_mode("Ketat").fuzzy_threshold == 86 and Settings.for_mode("?").semantic_threshold == 60


def machine(rows):
    """The sheet reader as a transition function: (number, description, detail) in order."""
    section = group = number = ""
    k, out = 0, []
    for no, desc, detail in rows:
        if no:
            out.append((no, desc, section))
            number, k, group = no, 0, "" if detail else desc
        elif number and group and detail:
            k += 1
            out.append((f"{number}.{k}", desc, group))
        else:
            section, group, number, k = desc, "", "", 0
    return out


def test_sheet_lines_equal_a_state_machine(spark):
    r = random.Random(8)
    data, want = [], {}
    for f in range(40):
        rows = [(str(r.randint(1, 9)) if r.random() < 0.5 else "", f"d{f}x{i}", r.random() < 0.5) for i in range(r.randint(1, 14))]
        want[f"f{f}"] = machine(rows)
        data += [(f"f{f}", "S", 0, i, [no, d, "m" if det else "", "", "", "", "0"]) for i, (no, d, det) in enumerate(rows)]
    df = spark.createDataFrame(data, "file string, sheet string, sheet_idx int, row_idx int, cells array<string>")
    got: dict = {}
    for x in sheets.rab_lines(df).orderBy("file", "row_idx").collect():
        got.setdefault(x.file, []).append((x.row_id, x.item_per_rab, x.section))
    assert got == {k: v for k, v in want.items() if v}
    book = sheets.budget_lines(df.withColumn("sheet", F.lit("RESUME")))  # only skipped sheets: read again from all
    assert book.count() == sum(map(len, want.values()))
    spent = spark.createDataFrame([("b.xlsx", "Realisasi 1", 0, i, c) for i, c in enumerate([["REALISASI"], ["Kabel", "5", "ok"], ["", "1"], ["Pekerjaan", ":", ": Gardu"]])], df.schema)
    out = sheets.budget_lines(spent).orderBy("row_idx").collect()
    assert [(x.row_id, x.item_per_rab, x.judul_rab, x.total_price) for x in out] == [("1", "Kabel", "Gardu", "5"), ("2", "Pekerjaan", "Gardu", ":")]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, original_text string, source_quality string, item_per_rab string, item_description string, row_id string, total_price string")
    out = detect.review(spark, items, *[d.limit(0) for d in dictionaries(spark)])
    assert tuple(report.metrics(out).first()) == (0, 0, 0, 0.0, 0)
    assert report.all_materials(out).count() == 0 and report.export_summary(out).count() == 3
    assert all(d.count() == 0 for d in learning.summary(spark.createDataFrame([], FEEDBACK)).values())


def test_store(spark, tmp_path):
    k, s, _, e, _ = dictionaries(spark)
    folder = str(tmp_path / "store")
    store.write(k, folder, "nac_keywords")
    store.write(store.set_status(store.read(spark, folder, "nac_keywords"), spark.createDataFrame([(1,), (77,)], "id long"), "inactive", "t"), folder, "nac_keywords")
    assert {r.id for r in store.read(spark, folder, "nac_keywords").filter("status = 'inactive'").collect()} == {1, 6}
    a, b, c = store.delete_keywords(k, s, e, spark.createDataFrame([(1,), (2,)], "id long"))
    assert (a.count(), b.count(), c.count()) == (4, 2, 2)
    new = store.insert_absent(k, spark.createDataFrame([("DENDA", "active"), ("baru", "active"), ("Baru", "active")], "keyword string, status string"), ["keyword"])
    assert [(r.id, r.keyword.lower()) for r in new.filter("id > 6").collect()] == [(7, "baru")]
    words, syn = store.import_keywords(spark.createDataFrame([(" a ", "x; y;;"), ("", "z")], "keyword string, synonyms string"))
    assert words.count() == 1 and {r.synonym for r in syn.collect()} == {"x", "y"}
    store.backup(folder, str(tmp_path / "copy"))
    store.restore(folder, str(tmp_path / "copy"))
    assert store.read(spark, folder, "nac_keywords").count() == 6


def test_store_actions(spark, tmp_path):
    k, s, _, e, f = dictionaries(spark)
    folder = str(tmp_path / "new")
    store.reset(spark, folder)
    assert all(store.read(spark, folder, n).count() == 0 for n in store.TABLES)
    rows = spark.createDataFrame([(1, "7", "snak rapat", None, "snack", "snak rapat", "SNACK"), (2, "7", "lain", "x", None, " ", None), (3, None, "kosong", "x", "mati", "", None), (4, "9", "t", "", "tidak ada", "wisata", "")], "item_id long, row_id string, original_text string, item_per_rab string, matched_keyword string, suggested_synonym_candidate string, suggested_synonym_for_keyword string")
    assert {r.choice for r in store.row_choices(rows, True).collect()} == {"7 | snak rapat", "9 | t"} and store.row_choices(rows).count() == 4
    f = store.save_feedback(f, rows, "7 | snak", "Not NAC", now="t")
    assert [(r.id, r.row_id, r.original_text, r.matched_keyword) for r in f.collect()] == [(1, "7", "snak rapat", "snack")]
    assert all(store.save_feedback(f, rows, x, "Not NAC").count() == 1 for x in ("", "| a", "8 | b"))
    syn, said = store.approve_synonym(rows, "7", k, s, f, now="t")
    assert [(r.id, r.nac_keyword_id, r.synonym, r.weight) for r in syn.filter("id > 3").collect()] == [(4, 4, "snak rapat", 0.85)] and said.count() == 2
    again = store.approve_synonym(rows, "7", k, syn, said)
    assert again[0].count() == syn.count() and again[1].count() == 2
    assert store.approve_synonym(rows, "9", k, s, f)[0].count() == 3  # its keyword is not there
    assert store.add_keyword(k, "DENDA").count() == 6 and store.add_keyword(k, " ").count() == 6 and store.add_keyword(k, "mati").filter("keyword = 'mati'").count() == 2
    sheet = spark.createDataFrame([("baru", "x; y", None, "low"), ("baru", "z", "K", ""), (" ", "q", None, None)], "keyword string, synonyms string, category string, severity string")
    words, named = store.add_imported(k, s, sheet, "t")
    assert {(r.id, r.category, r.severity) for r in words.filter("id > 6").collect()} in ({(7, "Umum", "low"), (8, "K", "medium")}, {(8, "Umum", "low"), (7, "K", "medium")})
    assert {(r.nac_keyword_id, r.synonym) for r in named.filter("id > 3").collect()} == {(7, "x"), (7, "y"), (7, "z")}
    got = spark.createDataFrame([("1, 2;x 2", "Ya"), (None, None)], "a string, b string").select(store.id_list(F.col("a")).alias("a"), store.is_true(F.col("b")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [([1, 2], True), ([], False)]
    many = spark.createDataFrame([(f"w{i:05d}",) for i in range(3000)], "keyword string").repartition(7)
    assert [(r.id, r.keyword) for r in store.append(k, many).filter("id > 6").orderBy("id").collect()] == [(7 + i, f"w{i:05d}") for i in range(3000)]


def test_review_workbook(spark, tmp_path):
    from tessera.sources import files, workbooks

    k, s, t, e, f = dictionaries(spark)
    items = spark.createDataFrame([(1, "10", "Biaya denda", "table", None, "Denda", None), (2, "b", "kabel", "table", "5", None, "Kabel")], "item_id long, row_id string, original_text string, source_quality string, total_price string, item_per_rab string, item_description string")
    out = detect.review(spark, items, k, s, t, e, f).cache()
    workbooks.write_workbook(str(tmp_path / "r.xlsx"), workbooks.review_sheets(out, f, k))
    workbooks.write_workbook(str(tmp_path / "k.xlsx"), workbooks.keyword_sheets(k, s, t, e))
    workbooks.write_workbook(str(tmp_path / "m.xlsx"), {"Sheet1": workbooks.material_sheet(report.all_materials(out))})
    sheets_of = lambda n: [r.sheet for r in files.read_workbooks(spark, str(tmp_path / n)).groupBy("sheet", "sheet_idx").count().orderBy("sheet_idx").collect()]
    assert sheets_of("r.xlsx") == ["Summary", "Findings", "Suggestions", "Feedback Log", "Keyword Matches", "NAC Keyword Database Snapshot"]
    assert sheets_of("k.xlsx") == ["NAC Keywords", "Synonyms", "Allowable", "Exceptions"]
    got = [r.cells for r in files.read_workbooks(spark, str(tmp_path / "m.xlsx")).orderBy("row_idx").collect()]
    assert got == [["Row", "Nama Material", "Kategori NAC", "Confidence %", "Confidence Level"], ["10", "Denda", "Denda/Sanksi", "52.5", "Sedang"], ["b", "Kabel", "-", "5", "Sangat rendah"]]


def test_attach_splits_hot_groups(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(300)], "i long, k string")
    groups = rows.groupBy("k").agg(F.min("i").alias("v"), F.count("*").alias("n"))
    got = {(r.i, r.v) for r in attach(rows, groups, ["k"], "v", hot_rows=50).collect()}
    assert got == {(i, 1 if i % 3 else i) for i in range(300)}
    kept = attach(rows.unionByName(spark.createDataFrame([(900, None)], rows.schema)), groups.filter("k <> '3'"), ["k"], "v", hot_rows=50, keep=True)
    assert {(r.i, r.v) for r in kept.collect()} == {(i, 1 if i % 3 else i if i != 3 else None) for i in range(300)} | {(900, None)}
    assert 10 <= bounded_sample(rows, ["i"], 20).count() <= 20 and bounded_sample(rows, ["i"], 1000).count() == 300 and bounded_sample(rows.limit(0), ["i"], 5).count() == 0


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - {"exception_hits", "feedback_adjustments", "potential_findings", "filtered_results", "export_summary", "all_materials", "rule_matches_by_join"}))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("review_items", "feedback", "nac_keywords", "nac_synonyms", "allowable_keywords", "exceptions", "raw_lines", "documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    a = sorted(tuple(cell(v) for v in r) for r in got.select(*cols).collect())
    b = sorted(tuple(cell(v) for v in r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})".replace(" count ", ' "count" ')).fetchall())
    assert a == b
