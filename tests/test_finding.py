import random

import numpy as np
import pyarrow as pa

from tessera.functions import similarity as sim
from tessera.functions.finding import Finder
from tessera.operators import detect
from tests.test_allowable import misspelt


def test_finder_is_brute_force(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abé ツn0") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, ""]
    patterns = sorted({"".join(r.choice("abé ツn0") for _ in range(r.randint(1, 14))) for _ in range(80)} | {t[i : i + n] for t in texts[:60] for i, n in ((0, 30), (3, 9), (5, 17), (0, 3)) if t[i : i + n]})
    want = [(i, j) for i, t in enumerate(texts[3:]) for j, p in enumerate(patterns) if t is not None and p in t]
    for step, once in ((1 << 16, 1 << 20), (64, 10)):
        monkeypatch.setattr(Finder, "STEP", step)
        monkeypatch.setattr(Finder, "AT_ONCE", once)
        row, which = Finder(patterns).find(pa.array(texts).slice(3))
        assert list(zip(row.tolist(), which.tolist())) == want and len(want) > 1000
    assert not len(Finder([]).find(pa.array(texts))[0]) and not len(Finder(["x"]).find(pa.array([], pa.string()))[0])


def test_pieces_leave_few_windows_and_miss_none():
    r = random.Random(4)
    needles = ["sewa tenda rapat", "lomba tujuh belasan", "es krim", "k", "batik seragam istri pejabat"]
    words = "pekerjaan sipil gardu penggantian kabel tanah tiga inti paket 8 panel hubung pemulihan jaringan".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(3, 14))) for _ in range(300)]
    texts += [f"{' '.join(r.sample(words, r.randint(0, 3)))} {misspelt(r, n, r.randint(0, 4))} {' '.join(r.sample(words, r.randint(0, 3)))}".strip() for n in needles if len(n) > 1 for _ in range(30)]
    letters = np.unique(sim._points("".join(needles)))
    coded = [np.searchsorted(letters, sim._points(n)) for n in needles]
    block, base = sim._Block(texts, letters, max(map(len, needles)) - 1), 78.0 - 1e-6
    got = sim._Packed(coded, len(letters), base).windows(block)
    near = every = 0
    for k, n in enumerate(needles):
        left, m = set(zip(*(x.tolist() for x in got[k]))), len(n)
        for i, t in enumerate(texts):
            if len(t) >= m:
                spots = {j for j in range(len(t) + m - 1) if sim.ratio(n, t[max(0, j - m + 1) : j + 1]) > base}
                assert all((i, j) in left for j in spots)
                near, every = near + len(spots), every + len(t) + m - 1
    assert near > 100 and sum(len(x[0]) for k, x in got.items() if len(needles[k]) > 1) < every / 20


def test_feedback_in_parts_is_brute_force(spark, monkeypatch):
    r = random.Random(6)
    words = ["sewa", "tenda", "rapat", "gardu", "kabel"]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    kinds = ["Correct NAC", "Not NAC", "Confidence Too High", "Confidence Too Low", "Other"]
    said = [(r.choice(kinds), r.choice(["sewa", "tenda", "", None]), r.choice([line(r.randint(1, 3)), None, line(2) + " "])) for _ in range(60)]
    matched = sorted({(line(r.randint(1, 6)), r.choice(["sewa", "tenda", "baru", "", None])) for _ in range(80)}, key=str)
    want = {}
    for t, k in matched:
        v = sum({"Correct NAC": 6, "Not NAC": -8}.get(f, 0) for f, w, _ in said if k and w == k)
        v += sum({"Confidence Too High": -5, "Confidence Too Low": 5}.get(f, 0) for f, w, x in said if x and x[:30] in t and not (k and w == k))
        want[t, k] = max(-30, min(30, v))
    rows = spark.createDataFrame(matched, "text string, keyword string")
    feedback = spark.createDataFrame(said, "feedback_type string, matched_keyword string, original_text string")
    for sent in (1000, 7):
        monkeypatch.setattr(detect, "SENT", sent)
        assert {(x.text, x.keyword): x.adjustment for x in detect.feedback_for(rows, feedback).collect()} == want
