import random

import numpy as np
import pytest

from tessera.functions import similarity as sim
from tessera.operators import contains, detect
from tests.test_review import TERMS


def misspelt(r, text, times):
    for _ in range(times):
        i = r.randrange(len(text))
        text = r.choice([text[:i] + text[i + 1 :], text[:i] + r.choice("aeinrt ") + text[i:], text[:i] + r.choice("aeinrt") + text[i + 1 :]])
    return " ".join(text.split())


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(7)
    words = ["sewa", "tenda", "rapat", "kabel", "tanah", "panel", "hubung", "semen", "kelabu", "mutu", "k300", "gd-1387", "aa", "aaa", "a"]
    terms = sorted({" ".join(r.choice(words) for _ in range(r.randint(1, 6))) for _ in range(60)} | {"sewa tenda rapat"})
    near = [misspelt(r, t, r.randint(1, 5)) for t in terms for _ in range(4)]
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in near]
    longer = [f"pekerjaan {t} di gardu selatan tahap akhir" for t in terms[:20]]
    return sorted({t for t in near + mixed + longer + ["sewa tnda rapat", "biaya umum"] if t}), terms


def test_alike_pairs_miss_nothing(pairs):
    texts, terms = pairs
    for cutoff in (80.0, 88.0):
        got = {(i, j): v for i, j, v in sim.alike_pairs(texts, terms, cutoff)}
        spelt = lambda a, b: not set(a.split()) & set(b.split())
        want = {(i, j): sim.token_set_ratio(a, b) for i, a in enumerate(texts) for j, b in enumerate(terms) if sim.token_set_ratio(a, b) >= cutoff}
        assert all(want[p] == v for p, v in got.items())
        assert all(p in got for p in want if spelt(texts[p[0]], terms[p[1]])) and any(spelt(texts[i], terms[j]) for i, j in got)
        assert all(v == 100 or shared(texts[i], terms[j]) >= cutoff for (i, j), v in want.items() if (i, j) not in got)
        assert (texts.index("sewa tnda rapat"), terms.index("sewa tenda rapat")) in got


def shared(a, b):
    x, y = set(a.split()), set(b.split())
    n = len(" ".join(x & y))
    return max(200 * n / (n + len(" ".join(s))) for s in (x, y)) if n else 0


def test_allowable_is_brute_force(spark, pairs, monkeypatch):
    monkeypatch.setattr(detect, "TEXT_BLOCK", 150)
    monkeypatch.setattr(detect, "TERM_BLOCK", 25)
    texts, terms = pairs
    monkeypatch.setattr(contains, "TASK", 20)
    t = spark.createDataFrame([(i, None, w, None, "active", None) for i, w in enumerate(terms)], TERMS)
    got = {r.text: (round(r.allowable_score, 6), r.allowable_keyword) for r in detect.allowable(spark.createDataFrame([(x,) for x in texts], "text string"), t).collect()}
    want = {}
    for x in texts:
        score, term = min((-100.0 if w in x else -sim.token_set_ratio(w, x), w) for w in terms)
        if -score >= 88:
            want[x] = (round(-score, 6), term)
    assert {x: (got.get(x), want.get(x)) for x in texts if got.get(x) != want.get(x)} == {}
    spread = detect.allowable(spark.createDataFrame([(x,) for x in texts], "text string"), t, sent=0)
    assert {r.text: (round(r.allowable_score, 6), r.allowable_keyword) for r in spread.collect()} == got
    assert any(score < 100 for score, _ in want.values())


def test_few_pairs_are_compared_letter_by_letter(monkeypatch):
    r = random.Random(5)
    syllables = ["ka", "ti", "ro", "sel", "ma", "nu", "pe", "gar", "du", "lo", "bi", "wa"]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(2, 3))) for _ in range(150)]
    terms = sorted({f"{' '.join(r.sample(words, 5))} {r.choice(['py', 'gd'])}-{r.randint(1000, 1999)}" for _ in range(800)})
    texts = sorted({misspelt(r, t, 2) for t in terms[:60]} | {" ".join(reversed(t.split()[1:])) for t in terms[60:90]} | {" ".join(r.sample(words, 6)) for _ in range(400)})
    want = {}
    for i, x in enumerate(texts):
        score, j = min((-sim.token_set_ratio(x, w), j) for j, w in enumerate(terms))
        if -score >= 88:
            want[i] = (-score, j)
    compared, ratio = [], sim.token_set_ratio
    monkeypatch.setattr(sim, "token_set_ratio", lambda a, b: compared.append(a) or ratio(a, b))
    at, which, score = sim.Terms(terms, 88.0).best(texts)
    assert {int(i): (float(v), int(j)) for i, j, v in zip(at, which, score)} == want and len(want) >= 80
    assert len(compared) < len(texts) * len(terms) / 1000
    monkeypatch.setattr(sim.Terms, "MANY", 2)
    again = sim.Terms(terms, 88.0).best(texts)
    assert all((x == y).all() for x, y in zip(again, (at, which, score)))


def test_windows_left_out_are_below_the_threshold():
    r = random.Random(9)
    needle = "sewa tenda rapat"
    texts = [f"{'pekerjaan '[: r.randint(0, 10)]}{misspelt(r, needle, r.randint(0, 7))}{' di gardu'[: r.randint(0, 9)]}" for _ in range(300)]
    letters = np.unique(sim._points(needle))
    block, m, base = sim._Block(texts, letters, len(needle) - 1), len(needle), 78.0 - 1e-6
    needed, pairs = block.needed(m, base), {needle[i : i + 2] for i in range(m - 1)}
    near = left = 0
    for k, t in enumerate(texts):
        for j in range(1 - m, len(t)):
            w = t[max(0, j) : j + m]
            held = sum(w[i : i + 2] in pairs for i in range(len(w) - 1))
            if sim.ratio(needle, w) > base:
                near += 1
                assert held >= needed[j + m - 1, k]
            left += held < needed[j + m - 1, k]
    assert near > 100 and left > 1000
    best, which = sim.best_partial(texts, [needle], 78.0)
    for k, t in enumerate(texts):
        want = sim._exact_partial(t, needle, 0.0)
        assert (which[k] == 0) == (want >= 78) and (want < 78 or abs(best[k] - want) < 1e-9)


def test_clusters_of_texts_leave_few_pairs(monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choice("kalimntorsu") for _ in range(r.randint(4, 9))) for _ in range(40)]
    terms = sorted({f"{' '.join(r.sample(words, 4))} gd-{r.randint(1000, 1999)}" for _ in range(400)})
    texts = sorted({misspelt(r, t, 4) for t in terms[:80]} | {" ".join([*r.sample(words, 4), f"paket {k}"]) for k in range(10) for _ in range(60)})
    looked, near = [], sim.Terms._near
    monkeypatch.setattr(sim.Terms, "_near", lambda self, joined, lengths, x, *rest: looked.append(len(x)) or near(self, joined, lengths, x, *rest))
    for size in (1, 4, 1000):
        monkeypatch.setattr(sim.Terms, "CLUSTER", size)
        looked.clear()
        got = sorted(sim.alike_pairs(texts, terms, 88.0))
        if size == 1:
            want = got
            assert len(want) > 40
        assert got == want
        if size == 4:
            assert sum(looked) < len(texts) * len(terms) / 4
