from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import units

REF = [("m", "length", "m", 1.0), ("km", "length", "m", 1000.0), ("cm", "length", "m", 0.01), ("kg", "mass", "kg", 1.0), ("ton", "mass", "kg", 1000.0)]


def items(spark):
    rows, i = [], 0
    for k in range(6):
        name, v, p = f"kabel {k}", 100.0 * (k + 1), 500.0 + k
        for unit, f in (("m", 1), ("MTR.", 1), ("km", 1000), ("Kilometer", 1000), ("cm", 0.01), ("senti", 0.01)):
            i += 1
            rows.append((i, f"judul | {name}", name, f"{v / f:.4f}", unit, f"Rp {p * f:.2f}", None, "clash"))
    rows += [
        (101, "judul | kabel 0 | per km", "kabel 0", "0.1", None, "500000", None, None),
        (102, "judul | kabel 0", "kabel 0", "100 m", "", "500", None, None),
        (103, "judul | kabel 0", "kabel 0", "0,1 ", None, "500.000 / Kilometer", None, None),
        (104, "judul | kabel 0", "kabel 0", "100", "keg", "77", None, None),
        (105, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "item_id long, original_text string, item_per_rab string, volume string, unit string, unit_price string, total_price string, factor2 string")


def test_learns_spellings_and_pairs(spark):
    ref = spark.createDataFrame(REF, "unit_code string, dimension string, base_unit string, factor double")
    conv = units.convert(items(spark), ref).cache()
    by = {r.item_id: r for r in conv.collect()}
    assert by[2].unit_code == "m" and by[4].unit_code == "km" and by[6].unit_code == "cm"
    assert by[101].volume_base == 100 and by[102].volume_base == 100 and by[103].volume_base == 100
    assert by[104].unit_code is None and by[105].volume_base is None
    got = {tuple(r) for r in units.same_quantity(conv).collect()}
    known = [r for r in by.values() if r.unit_code and r.item_per_rab and r.volume_base]
    brute = {tuple(sorted((a.item_id, b.item_id))) for a, b in combinations(known, 2) if a.item_per_rab == b.item_per_rab and a.unit_code != b.unit_code and abs(a.volume_base - b.volume_base) <= 0.001 * max(a.volume_base, b.volume_base)}
    assert got == brute and len(got) > 20


def test_empty_and_scale_words(spark):
    ref = spark.createDataFrame(REF, "unit_code string, dimension string, base_unit string, factor double")
    assert units.same_quantity(units.convert(items(spark).limit(0), ref)).count() == 0
    one = items(spark).limit(1).withColumn("volume", F.lit("12 rb m")).withColumn("unit", F.lit(None).cast("string")).withColumn("unit_price", F.lit("1,5 jt/m"))
    r = units.measures(one).first()
    tight = units.measures(one.withColumn("volume", F.lit("1,44 rbkm"))).first()
    assert (tight.volume_read, tight.spelling) == (1440.0, "km")
    assert (r.volume_read, r.price_read, r.spelling) == (12000.0, 1500000.0, "m")
