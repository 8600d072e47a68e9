import pytest

from tessera.plans import catalog
from tests.test_review import FEEDBACK, dictionaries

ITEMS = "item_id long, row_id string, source_file string, page_or_sheet string, judul_rab string, section string, item_per_rab string, item_description string, original_text string, source_quality string, total_price string"
TEXTS = ["Biaya konsumsi rapat koordinasi", "Snak meting", "biaya", "Material konstruksi panel", "Pengadaan kabel NYY 4x16mm", "Biaya pribadi material konstruksi"]


def stored(spark, folder, changed=None):
    """A folder of small tables; ``changed``: other rows of some."""
    items = spark.createDataFrame([(i, str(i), "a.xlsx", "S", "J", "B", "Paket 4", None, t, "table", "10") for i, t in enumerate(TEXTS)], ITEMS)
    names = ("nac_keywords", "nac_synonyms", "allowable_keywords", "exceptions", "feedback")
    for name, df in ({"review_items": items} | dict(zip(names, dictionaries(spark))) | (changed or {})).items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("whole") / "plain")


def test_reports_are_over_the_whole_review(spark, plain):
    rows = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, plain).collect()]
    # A misspelt keyword scores 25.28, a part of one 30; an allowable term takes 20 from 55, and 35 with it is for a reviewer.
    assert {r[0]: r[4:] for r in rows("all_materials")} == {0: (52.5, "Sedang"), 1: (25.28, "Rendah"), 2: (30.0, "Rendah"), 3: (0.0, "Sangat rendah"), 4: (5.0, "Sangat rendah"), 5: (35.0, "Rendah")}
    assert rows("review_metrics") == [(6, 1, 0, 52.5, 2)]
    assert [r[0] for r in rows("potential_findings")] == [0]
    assert sorted(rows("filtered_results")) == [(0, "Sedang"), (5, "Rendah")]
    summary = dict(rows("export_summary"))
    assert summary["count_Rendah"] == 3 and summary["total_value_Rendah"] == 30 and summary["total_items_reviewed"] == 6


def test_exceptions_and_feedback_of_misspelt_keywords(spark, tmp_path):
    exceptions = dictionaries(spark)[3]
    changed = {
        "exceptions": spark.createDataFrame([(9, 4, "meting", "x", "lower_confidence", 12.0, "active", None)], exceptions.schema),
        "feedback": spark.createDataFrame([(i, None, "y", "snack", "Correct NAC", None, None, None) for i in range(2)] + [(5, None, "snak", "snack", "Confidence Too Low", None, None, None)], FEEDBACK),
    }
    folder = stored(spark, tmp_path / "bound", changed)
    assert [tuple(r) for r in catalog.QUERIES["exception_hits"](spark, folder).collect()] == [(1, 9, 12.0)]
    assert {r.item_id: r.adjustment for r in catalog.QUERIES["feedback_adjustments"](spark, folder).collect()} == {i: 12.0 if i == 1 else 0.0 for i in range(6)}
