import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import personal, scans

WORDS = "pekerjaan dilakukan setelah material diterima lokasi kabel tanah gardu portal panel hubung dihitung ulang karena gambar kerja berubah survei lapangan biaya lembur tahun berjalan tanda-tanda ukur".split()


def page(r, file, k, noise):
    """A page of wrapped words with noise; the kinds and the clean words."""
    words = [r.choice(WORDS) for _ in range(60)]
    shown, kinds = list(words), set()
    if noise:
        i = next(i for i, w in enumerate(words) if "a" in w and len(w) > 5 and "-" not in w and i > 3)
        shown[i] = words[i].replace("a", "4", 1)
        kinds.add("misread")
    lines, at = [], 0
    while at < len(shown):
        lines.append(" ".join(shown[at : at + 7]))
        at += 7
    if noise:
        first, rest = lines[2].rsplit(" ", 1)
        if len(rest) > 6 and "-" not in rest and rest.isalpha():
            lines[2], lines[3] = f"{first} {rest[:4]}-", f"{rest[4:]} {lines[3]}"
            kinds.add("hyphenation")
    if k % 3:
        lines.insert(0, f"Dokumen Kerja Unit {file}")
        kinds.add("running_head")
    if k % 2:
        lines.append(f"Halaman {k}")
        kinds.add("page_number")
    return "\n".join(lines), kinds, " ".join(words)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(3)
    rows, want = [], {}
    for f in range(12):
        for k in range(12):
            i = f * 100 + k
            text, kinds, clean = page(r, "Mipara Selatan" if f % 2 else "Kopeli Utara", k, r.random() < 0.3)
            rows.append((i, f"f{f}.pdf", f"Halaman {k}", text, text, "clash"))
            want[i] = (kinds, clean)
    rows += [(9000, None, None, None, None, None), (9001, "f1.pdf", "Halaman 99", "", " ", None)]
    return spark.createDataFrame(rows, "item_id long, source_file string, page_or_sheet string, original_text string, item_description string, head string"), want


def test_pages_are_repaired(spark, pages):
    items, want = pages
    got = {r.item_id: r for r in scans.repair(spark, items).collect()}
    assert len(got) == len(want) + 2 and got[9000].kinds == [] and got[9001].text == ""
    hit = {k: [0, 0, 0] for k in ("misread", "hyphenation", "running_head", "page_number")}
    for i, (kinds, _) in want.items():
        for k, c in hit.items():
            c[0] += k in kinds and k in got[i].kinds
            c[1] += k in kinds
            c[2] += k not in kinds and k in got[i].kinds
    for k, (both, there, extra) in hit.items():
        assert both >= 0.9 * there and extra <= 0.03 * len(want), (k, both, there, extra)
    assert sum(got[i].text == clean for i, (_, clean) in want.items()) >= 0.93 * len(want)
    assert scans.repair(spark, items.limit(0)).count() == 0


def test_operations_round_trip():
    r = random.Random(1)
    for _ in range(300):
        w = r.choice(WORDS)
        i = r.randrange(1, len(w))
        noisy = r.choice([w[:i] + w[i + 1 :], w[:i] + "4" + w[i + 1 :], w[:i] + "ri" + w[i:]])
        assert scans.apply_operations(noisy, scans.operations(noisy, w)) == w


FIRST = [a + b for a in ("Daro", "Wira", "Nove", "Keli", "Belu", "Tari") for b in ("sari", "mun", "lis", "gar", "wati")]
LAST = [a + b for a in ("Kusu", "Lesta", "Giri", "Santo", "Tirta") for b in ("negiri", "brata", "mawir", "lendra", "jengga")]
FILL = ["Volume kabel tanah dihitung ulang karena gambar berubah", "Kode anggaran 6775376347870545 dipakai tahun ini", "Penyedia PT Kresna Utama mengirim panel dalam 12 hari", "Nomor seri M2924245742160 tercantum di gudang Mipara", "Uraian menyebut 22 bh menara @ Rp 14.800.000 per satuan"]


def letter(r):
    out, spans, at = "", [], 0
    name = f"{r.choice(FIRST)} {r.choice(LAST)}"
    parts = [("fill", r.choice(FILL))]
    parts += r.sample(
        [
            ("NAME", "Menurut Bapak ", name, " harga masih bisa turun"), ("NAME", "Untuk klarifikasi hubungi Ibu ", name, " segera"),
            ("EMAIL", "Salinan ada pada ", f"{name.split()[0].lower()}{r.randint(1, 99)}{r.choice(['@', ' (at) ', '[at]'])}surat.example", " dan arsip"),
            ("PHONE", "Kontak darurat ", r.choice([f"0840-{r.randint(1000, 9999)}-{r.randint(1000, 9999)}", f"+62 841 {r.randint(100, 999)} {r.randint(10000, 99999)}"]), " siang hari"),
            ("ID_NUMBER", "Surat kuasa dengan KTP ", f"98{r.randint(10**13, 10**14 - 1)}", " asli"),
            ("ADDRESS", "Alamat kirim: ", f"Jl. Melur Timur No. {r.randint(1, 150)}, Kopara", ""),
        ], r.randint(1, 4),
    ) + [("fill", r.choice(FILL))]
    for p in parts:
        text = p[1] if p[0] == "fill" else "".join(p[1:])
        if p[0] != "fill":
            spans.append((p[0], len(out) + len(p[1])))
        out += text + ". "
    return out, spans


def test_personal_information(spark):
    r = random.Random(9)
    docs = [letter(r) for _ in range(700)]
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(docs)] + [(9000, None, 1), (9001, "", 1)], "doc_id long, text string, spans int").select("doc_id", "text")
    found = personal.find(spark, df).cache()
    got = {x.doc_id: {(s.kind, s.start) for s in x.spans} for x in found.collect()}
    assert got[9000] == set() and got[9001] == set()
    both = sum(len(got[i] & set(s)) for i, (_, s) in enumerate(docs))
    assert both >= 0.95 * sum(len(s) for _, s in docs) and both >= 0.95 * sum(len(g) for g in got.values())
    masked = {x.doc_id: x.text for x in personal.masked(found).collect()}
    assert masked[9000] is None and "[NAME]" in " ".join(t for t in masked.values() if t)
    for i, (t, _) in list(enumerate(docs))[:50]:
        want, at = "", 0
        for s in sorted(found.filter(F.col("doc_id") == i).first().spans, key=lambda s: s.start) if i < 5 else []:
            want, at = want + t[at : s.start] + f"[{s.kind}]", s.stop
        assert i >= 5 or masked[i] == want + t[at:]


def test_skip_edges_are_linear():
    import numpy as np

    word, doc = np.array([1, 2, 1, 1, 2, 1]), np.array([0, 0, 0, 0, 1, 1])
    a, b = personal.skip_edges(word, np.full(6, -1), doc, np.ones(6, bool))
    assert list(zip(a, b)) == [(0, 2), (2, 3)]
    a, b = personal.skip_edges(np.array([1, 2, 1]), np.array([7, 7, 7]), np.zeros(3, int), np.ones(3, bool))
    assert list(zip(a, b)) == [(0, 2), (0, 1), (1, 2)]  # the next equal one, and the next similar ones


def test_only_a_skip_edge_decides():
    """A word in an unclear place is a name if an equal or similar word of its document is one in a clear place."""
    import numpy as np

    weights = np.zeros((personal.SPACE, personal.L), np.float32)
    name = personal.LABELS.index("B-NAME")
    for w in ("Kresnawatu", "KRESNAWATU", "Kresnawati", "Hastarani", "dan", "di", "sini", "Bapak"):
        ids = personal.feature_ids(w)
        weights[ids[0][0], name] = -1.5 if w[0].isupper() and w != "Bapak" else -20.0
    weights[personal.feature_ids("Bapak")[personal.SLOTS.index("-1")][0], name] = 8.0
    transition = np.zeros((personal.L, personal.L), np.float32)
    transition[:, [k for k, x in enumerate(personal.LABELS) if k and k != name]] = -30.0
    text = "Bapak Kresnawatu di sini dan di sini dan Kresnawatu dan KRESNAWATU dan Kresnawati di sini dan Hastarani"
    model = {"weights": weights, "transition": transition, "skip": np.zeros(6, np.float32)}
    assert [text[a:b] for a, b, _ in personal.Finder(model).find([text])[0]] == ["Kresnawatu"]
    model["skip"][5] = 3.0
    assert [text[a:b] for a, b, _ in personal.Finder(model).find([text])[0]] == ["Kresnawatu", "Kresnawatu", "KRESNAWATU", "Kresnawati"]


def test_firms_are_no_names_and_potentials_of_names_hold():
    r = random.Random(4)
    texts = [letter(r)[0] for _ in range(500)]
    texts += [f"Penyedia PT Kresna {b} menyatakan sanggup. Menurut Bapak {a} {b} PT Kresna {b} sudah setuju. Notulen dibuat oleh Bapak {a} {b}." for a, b in zip(FIRST * 3, LAST * 4)]
    model = personal.train(texts)
    assert model["skip"][1 + personal.TYPES.index("NAME")] > 0.3
    found = personal.Finder(model).find(texts)
    for t, spans in zip(texts, found):
        assert not [t[a:b] for a, b, k in spans if k == "NAME" and t[max(0, a - 3) : a] == "PT "]
        assert "Menurut Bapak" not in t or [1 for a, _, k in spans if k == "NAME"]
