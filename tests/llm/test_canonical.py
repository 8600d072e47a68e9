import random

from tessera.llm import canonical


def dictionary(spark):
    k = spark.createDataFrame([(1, "biaya tilang"), (4, "Biaya  Tilang!"), (7, "batik seragam istri"), (9, "uang lelah panitia"), (12, "...")], "id long, term string")
    s = spark.createDataFrame([(1, 4, "tebusan pelanggaran lalin"), (2, 7, "KEBAYA_dharma wanita"), (3, 99, "restorasi mobil kuno"), (4, None, "x y")], "id long, keyword_id long, term string")
    return canonical.entries(k, s)


CASES = {
    "Biaya Tilang": 1, "tilang biaya": 1, "by. biaya tilnag": 1, "biayatilang 3 org": 1, "tebusn pelangaran lalin utk tamu": 1, "btk srgm istr": 7, "batik seragam": None, "kebaya dharma wzanita": 7,
    "uang lelah pan.": 9, "oeang lelah panitia": 9, "ba tik seragam istri": 7, "restorasi mobil kuno": None, "uang jajan": None, "": None, "   ": None, "#": None, "batik, seragam, istri": 7,
}


def test_names(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "row_id long, text string")
    got = {r.row_id: r.target_id for r in canonical.name(rows, dictionary(spark)).collect()}
    assert got == dict(enumerate([*CASES.values(), None]))
    assert canonical.name(rows.limit(0), dictionary(spark)).count() == 0
    assert canonical.name(rows, dictionary(spark).limit(0)).filter("target_id is not null").count() == 0


def test_pigeonhole_finds_all_that_levenshtein_finds(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 10)))
    known, typed = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    k = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 3 else 2 if len(w) <= 6 else 3
    want = {(a, b, lev(a, b)) for a in known for b in typed if lev(a, b) <= k(a)}
    got = canonical.misspelt(spark.createDataFrame([(w,) for w in known], "word string"), spark.createDataFrame([(w,) for w in typed], "form string"))
    assert {tuple(x) for x in got.collect()} == want
