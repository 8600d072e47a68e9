import unicodedata

import pyarrow as pa
import pytest

from tessera.llm import codepages, garbled, lookalikes


@pytest.mark.parametrize(
    ("text", "made", "found"),
    [
        ("ｋａｂｅｌ　４ｘ１６", "kabel 4x16", True),
        ("𝐛𝐮𝐥𝐚𝐧 𝖿𝗂𝗅𝗍𝖾𝗋", "bulan filter", True),
        ("gi​gi pan﻿el­", "gigi panel", True),
        ("grafik beban", "grafik beban", True),
        ("ɡiɡi mаtеrial рrоyek", "gigi material proyek", True),
        ("façon señal é", "façon señal é", True),
        ("ﬁlter", "filter", True),
        ("Ångra crêpȩ", "Ångra crêpȩ", True),
        ("merek «Волтан» «Σελμα» cos φ 10 kΩ", "merek «Волтан» «Σελμα» cos φ 10 kΩ", False),
        ("m² ½ ±5 % 80 °C 40 µm A–B “x” Größe señal ≤", "m² ½ ±5 % 80 °C 40 µm A–B “x” Größe señal ≤", False),
        ("seri Ã‚mbar Ã\xad", "seri Ã‚mbar Ã\xad", False),
        ("plain", "plain", False),
        ("", "", False),
        (None, None, False),
    ],
)
def test_one_form(text, made, found):
    out, flags = lookalikes.normalise(pa.array([text, "x​", None, text], pa.string()))
    assert out.to_pylist() == [made, "x", None, made] and flags.tolist() == [found, True, False, found]


def test_marks_compose_like_unicode():
    r = __import__("random").Random(4)
    texts = ["".join(r.choice(["a", "e", "n", "́", "̃", "̈", " ", "C", "̧"]) for _ in range(12)) for _ in range(300)]
    texts = [t for t in texts if not any(unicodedata.combining(a) and unicodedata.combining(b) for a, b in zip(t, t[1:]))]
    out, _ = lookalikes.normalise(pa.array(texts))
    assert out.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]


def test_one_form_frame(spark):
    df = spark.createDataFrame([(1, "рapan", "c"), (2, None, "c"), (3, "abc", "c")], "id long, text string, found string")
    got = {r.id: (r.text, r.found) for r in lookalikes.one_form(df, ["id"]).collect()}
    assert got == {1: ("papan", True), 2: (None, False), 3: ("abc", False)}


CLEAN = ["tipe Größe 2", "suhu 80 °C", "merek São Velo", "seri Âmbar", "kode ÃO-3", "area A–B", "celah 40 µm", "tahanan 10 kΩ", "varian señal", "“edisi revisi”", "lot Ångra"]


def test_garbled(spark):
    bad = []
    for t in CLEAN:
        for page in ("cp1252", "latin-1", "mac_roman", "cp437"):
            try:
                g = t.encode().decode(page)
            except UnicodeDecodeError:
                continue
            if not t.isascii() and g != t:
                bad.append((t, g))
    rows = [(i, "s", t) for i, t in enumerate(CLEAN * 20)] + [(1000 + i, "s", g) for i, (_, g) in enumerate(bad)]
    rows += [(5000, "s", "45� sudut"), (5001, "s", None), (5002, "s", ""), (5003, "s", "Ãƒâ€¦ngra")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r.id: (r.restored, r.garbled) for r in garbled.restore(spark, df, ["id"]).collect()}
    assert all(got[i] == (t, False) for i, _, t in rows[: len(CLEAN) * 20])
    right = sum(got[1000 + i] == (t, True) for i, (t, _) in enumerate(bad))
    assert right >= 0.9 * len(bad) and all(got[1000 + i][1] for i in range(len(bad)))
    assert got[5000][1] and got[5001] == (None, False) and got[5002] == ("", False) and got[5003][0] == "Ångra"
    assert garbled.restore(spark, df.limit(0), ["id"]).count() == 0


def misread(text, page, times):
    for _ in range(times):
        text = "".join(codepages.images()[page][b] for b in text.encode())
    return text


def test_garbled_more_than_once(spark):
    odd = [t for t in CLEAN if not t.isascii()] + ["huruf 𝐀𝖿"]
    pages = codepages.PAGES
    rows = [((page, 0, i), page, t) for page in pages for i, t in enumerate(odd * 20)] + [((page, times, i), page, misread(t, page, times)) for page in pages for times in (2, 3) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(k, source, t) for k, (_, source, t) in enumerate(rows)], "id long, source string, text string")
    got = {rows[r.id][0]: r.restored for r in garbled.restore(spark, df, ["id"]).collect()}
    assert all(got[k] == t for k, _, t in rows if k[1] == 0)
    wrong = {(page, times): bad for page in pages for times in (2, 3) if (bad := [t for i, t in enumerate(odd) if got[page, times, i] != t])}
    print("wrong", sum(map(len, wrong.values())), "of", 2 * len(pages) * len(odd), wrong)
    assert all(len(bad) <= 0.1 * len(odd) for bad in wrong.values()), wrong


def test_single_bytes_read_by_another_code_page(spark):
    words = ["façon", "señal", "crêpe", "Größe", "naïve", "Müller", "gâteau", "garçon", "mañana", "fenêtre"]
    clean = [f"merek {w} tipe {i % 7}" for i, w in enumerate(words * 30)] + ["merek Волтан 10 kΩ", "Πελμα m² ±5", "mаtеrial A×B 4×16 mm²"] * 30
    rows = [(i, "bersih", t) for i, t in enumerate(clean)]
    for page in ("cp1251", "cp437", "koi8_r", "iso8859-7"):
        for w in words:
            shown = "".join(x.encode("cp1252").decode(page, "replace") for x in w)
            inner = all(c in garbled.swaps() for c in shown if c > "\x7f") and all(c in "".join(words) for c in w)
            if inner:
                rows += [(100_000 + len(rows), page, f"merek {shown} tipe 1"), (200_000 + len(rows), page, f"merek {w} tipe 1")]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r.id: (r.restored, r.garbled) for r in garbled.restore(spark, df, ["id"]).collect()}
    assert all(got[i] == (t, False) for i, s, t in rows if s == "bersih" or i >= 200_000)
    bad = [(t, got[i], rows[k + 1][2]) for k, (i, s, t) in enumerate(rows) if 100_000 <= i < 200_000]
    assert len(bad) >= 20 and all(g[1] for _, g, _ in bad)
    assert sum(g[0] == want for _, g, want in bad) >= 0.9 * len(bad), [x for x in bad if x[1][0] != x[2]]


def test_units_are_bounded():
    assert 1000 < len(codepages.units()) < 20_000 and all(len(u) > 1 for u in codepages.units())
