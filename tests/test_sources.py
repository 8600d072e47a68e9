import zipfile

import pytest

from tessera.operators import sheets
from tessera.sources import files, workbooks
from tessera.streaming import review as live


def workbook(path, rows):
    cell = lambda v, ref: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(v, f"{chr(65 + j)}{i + 1}") for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="RAB" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Pekerjaan", ":", "Gardu Baru"], [1, "Sipil"], [None, "Semen", "kg", 5, 100.0], [2.0, "Kabel", "m", 3, 7]])
    kind, rows = files.read_upload(spark, str(tmp_path / "a.xlsx"))
    out = sheets.budget_lines(rows).orderBy("row_idx").collect()
    assert kind == "sheets"
    assert [(r.row_id, r.item_per_rab, r.section, r.judul_rab, r.unit_price) for r in out] == [("1", "Sipil", ":", "Gardu Baru", ""), ("1.1", "Semen", "Sipil", "Gardu Baru", "100"), ("2", "Kabel", ":", "Gardu Baru", "7")]


def test_csv_and_roles(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("Uraian , Volume,Harga Satuan\nCaf\xe9,1,2\n".encode("latin-1"))
    df = files.read_csv(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["Uraian", "Volume", "Harga Satuan"] and df.first()[0] == "Café"
    m = files.mapping(df.columns)
    assert m == {"text": ["Uraian"], "volume": "Volume", "unit": "Harga Satuan", "unit_price": "Harga Satuan", "total_price": None}
    item = files.table_items(df.selectExpr("*", "0 as row_idx"), "b.csv", "CSV", m).first()
    assert (item.row_id, item.original_text, item.volume, item.source_quality) == ("1", "Café", "1", "table")


def test_pages(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"short")
    (tmp_path / "y.pdf").write_bytes(b"a long enough page of text that needs no scanner at all")
    got = files.read_pages(spark, str(tmp_path / "*.pdf"), lambda d: [d.decode(), " "], lambda d: ["scan", "ned"])
    assert sorted((r.page_or_sheet, r.text[:8], r.source_quality) for r in got.collect()) == [("Halaman 1", "a long e", "digital_pdf"), ("OCR PDF", "scan\nned", "ocr")]
    assert files.first_text([lambda d: 1 / 0, lambda d: " ", lambda d: "ok"], b"") == "ok"


def test_stream(spark, tmp_path):
    from tests.test_review import dictionaries

    k, s, *_ = dictionaries(spark)
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "Biaya denda"), (2, "kabel")], "item_id long, original_text string").selectExpr("*", "timestamp'2030-01-01' as uploaded_at").write.parquet(src)
    stream = spark.readStream.schema("item_id long, original_text string, uploaded_at timestamp").parquet(src)
    q = live.tag(stream, k, s).writeStream.format("memory").queryName("tagged").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.item_id, r.matched_keyword) for r in spark.table("tagged").collect()} == {(1, "denda"), (2, None)}
    assert live.counts_by_day(live.tag(stream, k, s)).isStreaming
    items = spark.createDataFrame([(1, "Biaya denda"), (2, "kabel"), (3, None), (4, "snack konsumsi rapat"), (5, "rumah yatim")], "item_id long, original_text string")
    few, many = ({(r.item_id, r.match_type, r.matched_keyword) for r in live.tag(items, k, s, n).collect()} for n in (400, 0))
    assert few == many and (4, "exact", "konsumsi") in many and (5, "synonym", None) in many
    assert live.tag(items, k.limit(0), s.limit(0)).filter("match_type is not null").count() == 0


def test_csv_in_splits_and_in_order(spark, tmp_path):
    rows = [f'{i},"item ""{i}"" a, b",{i % 7}' for i in range(5000)]
    (tmp_path / "big.csv").write_text("no,uraian,volume\n" + "\n".join(rows) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_csv(spark, str(tmp_path / "big.csv"))
        assert df.rdd.getNumPartitions() > 3
        got = files.in_order(df).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_idx, r.no, r.uraian) for r in got] == [(i, str(i), f'item "{i}" a, b') for i in range(5000)]
    (tmp_path / "broken.csv").write_text('uraian,volume\n"dua\nbaris",3\nsatu,4\n')
    items = files.upload_items(spark, str(tmp_path / "broken.csv")).orderBy("row_id").collect()
    assert [(r.row_id, r.original_text, r.volume, r.page_or_sheet, r.source_file) for r in items] == [("1", "dua\nbaris", "3", "CSV", "broken.csv"), ("2", "satu", "4", "CSV", "broken.csv")]
    (tmp_path / "empty.csv").write_text("uraian,volume\n")
    assert files.upload_items(spark, str(tmp_path / "empty.csv")).count() == 0


def test_uploads_by_their_ending(spark, tmp_path):
    path = lambda n: str(tmp_path / n)
    workbook(path("headed.xlsx"), [["Uraian", "Volume", "Satuan", "Total", None, "Total"], ["Biaya konsumsi", 1, "paket", 250000, None, 9], ["Panel", 2.0, "unit", 1200000]])
    got = files.upload_items(spark, path("headed.xlsx")).orderBy("row_id").collect()
    assert [(r.row_id, r.original_text, r.volume, r.unit, r.total_price, r.page_or_sheet) for r in got] == [("1", "Biaya konsumsi", "1", "paket", "250000", "RAB"), ("2", "Panel", "2", "unit", "1200000", "RAB")]
    workbook(path("rab.xlsx"), [["Proyek", ":", "Gardu"], [1, "Sipil"], [None, "Semen", "kg", 5, 100]])
    got = files.upload_items(spark, path("rab.xlsx")).collect()
    assert [(r.row_id, r.item_per_rab, r.original_text, r.volume, r.page_or_sheet) for r in got] == [("1", "Sipil", "rab | : | Sipil", "", "RAB"), ("1.1", "Semen", "rab | Sipil | Semen", "5", "RAB")]
    workbook(path("bare.xlsx"), [["a", "b"], ["x", "y"]])
    assert [(r.original_text, r.volume) for r in files.upload_items(spark, path("bare.xlsx")).collect()] == [("x", "")]
    workbook(path("none.xlsx"), [])
    assert files.upload_items(spark, path("none.xlsx")).count() == 0
    (tmp_path / "y.pdf").write_bytes(b"a page\nof text that is long enough to need no scanner")
    long = "x" * 600
    got = files.upload_items(spark, path("y.pdf"), lambda d: [d.decode(), f"{long}\n{long}", " "]).orderBy("row_id").collect()
    assert [(r.row_id, r.page_or_sheet, len(r.original_text), r.source_quality) for r in got] == [("1.1", "Halaman 1", 53, "digital_pdf"), ("2.1", "Halaman 2", 600, "digital_pdf"), ("2.2", "Halaman 2", 600, "digital_pdf")]
    (tmp_path / "z.png").write_bytes(b"img")
    got = files.upload_items(spark, path("z.png"), images=[lambda d: "", lambda d: "teks"]).collect()
    assert [(r.row_id, r.page_or_sheet, r.original_text, r.source_quality) for r in got] == [("1.1", "Image OCR", "teks", "ocr")]
    assert files.upload_items(spark, path("z.png"), images=[lambda d: " "]).count() == 0

    def pages():  # a scanner is asked for no more pages than are kept
        yield from (f"p{i}" for i in range(25))
        raise AssertionError("page 26 was read")

    (tmp_path / "s.pdf").write_bytes(b"-")
    got = files.upload_items(spark, path("s.pdf"), lambda d: [], lambda d: pages()).collect()
    assert len(got) == 1 and got[0].original_text.endswith("p24") and got[0].page_or_sheet == "OCR PDF"
    for name, readers in (("a.txt", {}), ("y.pdf", {}), ("z.png", {})):
        with pytest.raises(ValueError):
            files.upload_items(spark, path(name), **readers)


def test_workbooks_are_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "ROWS", 4)
    df = spark.createDataFrame([(i, None if i == 2 else f"a & <{i}> \x01", i / 2) for i in range(7)], "id long, text string, x double").orderBy("id")
    workbooks.write_workbook(str(tmp_path / "out.xlsx"), {"Satu": df, "Kosong": workbooks.import_template(spark)})
    got = files.read_workbooks(spark, str(tmp_path / "out.xlsx")).orderBy("sheet_idx", "row_idx").collect()
    assert [r.sheet for r in got] == ["Satu"] * 4 + ["Satu (2)"] * 4 + ["Satu (3)"] * 2 + ["Kosong"]
    assert got[0].cells == ["id", "text", "x"] and got[3].cells == ["2", "", "1"] and got[1].cells == ["0", "a & <0> ", "0"] and got[9].cells == ["6", "a & <6> ", "3"]
