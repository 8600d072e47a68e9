from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import bad_rows as b

SCHEMA = "line_id long, source_file string, line_no int, raw_text string, extra string"
HEAD = "row_id,item_per_rab,volume,unit,unit_price,total_price"


def rows(spark, lines, head=HEAD):
    data = [(1, "f", 1, head, "x")] + [(i + 2, "f", i + 2, t, "x") for i, t in enumerate(lines)]
    return spark.createDataFrame(data, SCHEMA)


def test_reasons(spark):
    lines = [
        '1,a,2,m,3,4', '1,"a,2,m,3,4', '1,a"b,2,m,3,4', '1,"a"b,2,m,3,4', "1,a,2,m,3", "1,a,2,m,3,4,5", "1,a,-2,m,3,4",
        "1,a,2,m,12..5,4", '1,a,2,m,3,"1,2,3"', '1,"a ""x"" b",,m,Rp 1.000,"Rp. 2,000.50"', '1,"a\nb",1.5,m,,', "1,a,2,m,Rp,x", None,
    ]
    got = {r.line_id - 2: r.reason for r in b.failures(rows(spark, lines)).collect()}
    assert got == {1: "broken_quoting", 2: "broken_quoting", 3: "broken_quoting", 4: "column_count", 5: "column_count", 6: "bad_volume", 7: "bad_unit_price", 8: "bad_total_price", 11: "bad_unit_price", 12: "column_count"}
    valid = {r.line_id - 2: r for r in b.valid_rows(rows(spark, lines)).collect()}
    assert set(valid) == {0, 9, 10}
    assert (valid[9].item_per_rab, valid[9].volume, valid[9].unit_price, valid[9].total_price) == ('a "x" b', None, 1000.0, 2000.5)
    assert valid[10].item_per_rab == "a\nb" and valid[10].volume == 1.5


def test_no_header_and_empty(spark):
    df = spark.createDataFrame([(5, "g", 2, "1,2", None)], SCHEMA)
    assert [tuple(r) for r in b.failures(df).collect()] == [(5, "no_header")]
    none = spark.createDataFrame([], SCHEMA)
    assert b.failures(none).count() == 0 and b.valid_rows(none).count() == 0


FIELD = st.sampled_from(["a", "", "1", "1.000", '"q"', '"x ""y"""', '"a,b"', 'a"b', '"open', "-3", "Rp 5", '"l\nb"', "é"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(FIELD, min_size=5, max_size=7), min_size=1, max_size=40))
def test_blocks_equal_single_lines(records):
    import pyarrow as pa

    lines = [",".join(r) for r in records]
    names = HEAD.split(",")
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array(lines), pa.array([HEAD] * len(lines))], names=["line_id", "raw_text", "header"])
    out = pa.Table.from_batches(list(b._parse(iter([batch])))).to_pylist()
    assert len(out) == len(lines)
    for r in out:
        reason, fields = b.diagnose(lines[r["line_id"]], ",", names)
        assert r["reason"] == reason
        if reason is None:
            assert [r[n] for n in names] == fields
