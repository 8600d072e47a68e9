"""Personal information in free text: a skip-chain conditional random field over the words of each document.

Words are labelled outside, or begin/inside of EMAIL, PHONE, ID_NUMBER, ADDRESS or NAME. Word scores come from the word
itself, its neighbours and the nearest words before it; neighbouring words share transition potentials, and capitalised
words and long numbers share skip potentials with their next equal or similarly spelt occurrence anywhere in the
document (equal without case, or with the same consonants), so that a name seen in a clear place helps where the place
is unclear. Inference passes messages along chains and skip edges in turn (loopy belief propagation) and ends with the
best path.

The field is trained here on a bounded sample (DOCS documents by hash of their id) that is labelled by cues (forms of
address, labels, address words, number formats). Contexts that mostly stand beside such names become cues themselves,
and words found as names label their other places; firms are examples of what is no name. Word scores are learned on
two thirds of the sample; transition and skip potentials are then fitted jointly on the other third, with its names
hidden from the scores, by matching expected to observed counts under belief propagation.

Scores of words are kept per distinct word, and stretches in which "outside" is certain and that no skip edge links to
an open word are not part of any chain, so whole texts of any length are read at the price of a few lookups per word.

Defined results: null and empty texts have no findings; positions count Unicode characters of the text as it is; spans
never overlap; a placeholder is the type in square brackets.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import bounded_sample

TYPES = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
LABELS = ["O"] + [f"{p}-{t}" for t in TYPES for p in "BI"]
L = len(LABELS)
#: Documents to learn from; rounds of training; size of the hashed feature space; certainty from which a word is outside.
DOCS, EPOCHS, SPACE, CERTAIN = 2000, 3, 1 << 17, 9.0
#: Rounds of messages over skip edges, of fitting the potentials, and distinct words a worker remembers.
ROUNDS, FITTING, REMEMBER = 3, 6, 400_000
#: Times that a context must stand beside known names, and share of capitalised phrases beside it that must be known.
SEEN, SURE = 5, 0.6

# Words that announce personal data in Indonesian and English letters, minutes and lists.
TITLES = "Bapak|Bpk|Pak|Ibu|Bu|Sdr|Sdri|Saudara|Saudari|Mr|Mrs|Ms|Mdm|Ir|Dr|Drs|Dra|Prof|Hj|Tn|Ny"
STREETS = "jl|jalan|jln|gg|gang|komplek|kompleks|perum|perumahan|dusun|dsn|kp|kampung|griya|lorong|lrg"
FIRMS = "PT|CV|UD|PD|Fa|Firma|Koperasi|Yayasan"
_NAME_CUE = rf"(?:\b(?:{TITLES})\b\.?|\ba\.?n\.?|\batas nama|\bu\.p\.|\b[Nn]ama\s*:|\bHormat kami,|\bKind regards,|\bBest regards,|\bhubungi|\bcontact|\bMenurut|\bAccording to|\boleh|\bby)"
_PART = r"(?:[A-Z][a-z]+|[A-Z]\.|[A-Z]{4,})"
_NAME = re.compile(rf"{_NAME_CUE}[ \n\t]*(?:(?:{TITLES})\b\.?[ ]*)*((?!(?:{FIRMS}|{TITLES})\b){_PART}(?: {_PART}){{1,2}})")
_FIRM = re.compile(rf"\b(?:{FIRMS})\.?(?: (?!(?:{TITLES})\b)[A-Z][\w&'-]*)+")
_FULL = re.compile(rf"\b{_PART}(?: {_PART}){{1,3}}")
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._+\-]*(?: ?@ ?| ?[\[(](?:at|AT)[\])] ?| at (?=[a-z0-9.\-]+(?:\.| dot )))(?:[A-Za-z0-9\-]+(?:\.| ?[\[(]dot[\])] ?| dot ))+[A-Za-z]{2,}")
_PHONE = re.compile(r"(?<![\w.,/\-])(?:\+62[ .\-]?\(?\d{2,4}\)?|62\d{2,3}|\(0\d{2,3}\)|0\d{2,4})[ .\-]?\d{3,8}(?:[ .\-]\d{2,5}){0,3}(?![\w])")
_ID = re.compile(r"(?:\bNIK\b|\bKTP\b|\bNPWP\b|\b[Pp]as+por[t]?\b|\bID\b|\b[Ii]dentitas|\b[Ii]dentity)\.?(?: (?:no|nomor|number|No)\.?)?\s*:?\s*([A-Z]{1,2}\d{6,8}\b|\d[\d .\-]{11,22}\d)")
_ID_BEHIND = re.compile(rf"{_PART} \(([A-Z]\d{{6,8}}|9\d{{15}}|9\d{{3}}(?: \d{{4}}){{3}}|9\d{{5}}\.\d{{6}}\.\d{{4}})\)")
_STREET = re.compile(rf"\b(?:{STREETS})\b(?:\.\s?|\s)(?=[A-Z0-9]|[a-z]+ [a-z]+ (?:no|blok|kav)\b)[^\n;()]*?(?=\.?(?:\n|;|$)|\. [A-Z]| sudah | sampai | untuk |, phone|, telp|, HP|\t)", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_NOT_PHONE = re.compile(r"(?:anggaran|code|seri|number|NPWP|nomor SPK)\W*$", re.I)


# --- words and features ---------------------------------------------------------------------------------------


def word_shape(w: str) -> str:
    c = w[0]
    if c.isdigit():
        return f"9{min(len(w), 17)}{'0' if c == '0' else ''}"
    if not c.isalpha():
        return w
    if len(w) == 1:
        return "X" if c.isupper() else "x"
    return "XX" if w.isupper() else "Xx" if c.isupper() else "xx"


def word_features(w: str, hidden: bool = False) -> tuple[list[str], list[str]]:
    """Features of a word for itself and as a neighbour; a hidden one shows its shape and length only."""
    low, s = w.lower(), word_shape(w)
    if hidden:
        return ["s" + s, "l" + s + str(min(len(w), 9))], ["s" + s]
    own = ["w" + low, "s" + s]
    if w[0].isalpha():
        own += ["e" + low[-5:], "f" + low[-4:] + s, "p" + low[:3] + s, "q" + low[:4], "l" + s + str(min(len(w), 9))]
    elif w[0].isdigit():
        own += ["d" + w[:2] + s]
    return own, ["w" + low if not w[0].isdigit() else "w9" + w[:2], "s" + s] + (["e" + low[-4:] + s] if w[0].isalpha() else [])


#: Places of neighbours, then the nearest one and two words of letters before a word.
SLOTS = ["0", "-1", "1", "-2", "2", "-3", "3", "b1", "b2"]


def feature_ids(w: str, hidden: bool = False) -> list[list[int]]:
    """Hashed features of a word for each slot."""
    own, beside = word_features(w, hidden)
    out = []
    for slot in SLOTS:
        names = own if slot == "0" else beside if slot[0] != "b" else [] if hidden else ["w" + w.lower()]
        out.append([_hash(slot + n) for n in names])
    return out


def consonants(w: str) -> str:
    """The first letter and the consonants behind it, doubled ones once; nothing for what is no word."""
    low = w.lower()
    return re.sub(r"(.)\1+", r"\1", low[0] + re.sub("[aeiou]", "", low[1:])) if low[0].isalpha() else ""


def _hash(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % SPACE


class Words:
    """Numbers distinct words; keeps the score table of each slot."""

    def __init__(self, weights: np.ndarray | None = None, hidden: set[str] | None = None):
        self.ids: dict[str, int] = {}
        self.weights, self.hidden = weights, hidden or set()
        self.pending: list[str] = []
        self.tables = [np.zeros((0, L), np.float32) for _ in SLOTS]
        self.alpha, self.linked = np.zeros(0, bool), np.zeros(0, bool)
        self.fold, self.bones = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.forms: dict[str, int] = {}

    def number(self, tokens: list[str]) -> np.ndarray:
        ids = self.ids
        for t in set(tokens).difference(ids):
            ids[t] = len(ids)
            self.pending.append(t)
        return np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))

    def ready(self) -> None:
        if not self.pending:
            return
        new = [[] for _ in SLOTS]
        for w in self.pending:
            for k, f in enumerate(feature_ids(w, w in self.hidden)):
                new[k].append(self.weights[f].sum(axis=0))
        self.tables = [np.concatenate([t, np.array(n, np.float32)]) for t, n in zip(self.tables, new)]
        self.alpha = np.concatenate([self.alpha, [w[0].isalpha() for w in self.pending]])
        self.linked = np.concatenate([self.linked, [len(w) > 2 and w[0].isupper() or len(w) > 4 and w[0].isdigit() for w in self.pending]])
        form = lambda x: self.forms.setdefault(x, len(self.forms))
        self.fold = np.concatenate([self.fold, np.array([form(w.lower()) for w in self.pending], np.int32)])
        bare = [consonants(w) for w in self.pending]
        self.bones = np.concatenate([self.bones, np.array([form("=" + x) if len(x) > 3 else -1 for x in bare], np.int32)])
        self.pending = []

    def scores(self, word: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The score of each label at each word, before any message."""
        out = np.zeros((len(word), L), np.float32)
        for table, p in zip(self.tables, neighbours(word, doc, self.alpha[word])):
            ok = p >= 0
            out[ok] += table[word[p[ok]]]
        return out


def neighbours(word: np.ndarray, doc: np.ndarray, alpha: np.ndarray) -> list[np.ndarray]:
    """For each slot the position of the neighbour, or -1."""
    n = len(word)
    at = np.arange(n)
    out = []
    start = np.maximum.accumulate(np.where(np.concatenate([[True], doc[1:] != doc[:-1]]), at, 0)) if n else at
    last = np.maximum.accumulate(np.where(alpha, at, -1)) if n else at
    before = np.concatenate([[-1], last[:-1]]) if n else at
    second = np.where(before >= 0, np.concatenate([[-1], last])[np.maximum(before, 0)], -1)
    for slot in SLOTS:
        if slot[0] == "b":
            p = before if slot == "b1" else second
            out.append(np.where(p >= start, p, -1))
        else:
            p = at + int(slot)
            ok = (p >= 0) & (p < n)
            ok &= doc[np.clip(p, 0, max(n - 1, 0))] == doc
            out.append(np.where(ok, p, -1))
    return out


# --- labels by cues -------------------------------------------------------------------------------------------


def beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The two words before and behind a place, as contexts; numbers count alike."""
    plain = lambda x: "9" if x[0].isdigit() else x.lower()
    left = [plain(x) for x in _TOKEN.findall(text[max(0, a - 40) : a])][-2:]
    right = [plain(x) for x in _TOKEN.findall(text[b : b + 40])][:2]
    return " ".join(["<", *left]), " ".join([">", *right])


class Cues:
    """What makes a span certain: fixed cues and formats, and contexts and name words learned from them."""

    def __init__(self, texts: list[str]):
        self.first: set[str] = set()
        self.last: set[str] = set()
        self.contexts: set[str] = set()
        for _ in range(2):
            self._learn(texts)

    def _learn(self, texts: list[str]) -> None:
        firsts, lasts, words, known, every = Counter(), Counter(), Counter(), Counter(), Counter()
        for t in texts:
            words.update(w.lower() for w in re.findall(r"\b[A-Z][A-Za-z]{2,}", t))
            names = [(a, b) for a, b, kind in self.spans(t) if kind == "NAME"]
            for a, b in names:
                parts = t[a:b].lower().split(" ")
                firsts.update(p for p in parts[:-1] if len(p) > 2)
                lasts.update(parts[-1:])
            starts = {a for a, _ in names}
            for m in _FULL.finditer(t):
                for c in beside(t, *m.span()):
                    every[c] += 1
                    known[c] += m.start() in starts
        often = lambda c: {w for w, n in c.items() if n >= 2 and n >= 0.25 * words[w] or n >= 0.6 * words[w]}
        self.first, self.last = often(firsts), often(lasts)
        self.contexts = {c for c, n in known.items() if n >= SEEN and n >= SURE * every[c]}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Spans (start, end, type) that are certain; firms and what lies in other spans are no names."""
        spans: list[tuple[int, int, str]] = []
        taken = np.zeros(len(text) + 1, bool)

        def add(a: int, b: int, kind: str) -> None:
            if not taken[a:b].any():
                taken[a:b] = True
                if kind != "FIRM":
                    spans.append((a, b, kind))

        for m in _EMAIL.finditer(text):
            add(*m.span(), "EMAIL")
        for m in _STREET.finditer(text):
            if not text[m.start()].islower() or re.match(r"jl|jln|gg|perum|dusun|komplek", m.group()):
                add(*m.span(), "ADDRESS")
        for p in (_ID, _ID_BEHIND):
            for m in p.finditer(text):
                add(m.start(1), m.end(1), "ID_NUMBER")
        for m in _PHONE.finditer(text):
            if not _NOT_PHONE.search(text[max(0, m.start() - 16) : m.start()]) and 8 <= sum(c.isdigit() for c in m.group()) <= 14:
                add(*m.span(), "PHONE")
        for m in _FIRM.finditer(text):
            add(*m.span(), "FIRM")
        for m in _NAME.finditer(text):
            add(m.start(1), m.end(1), "NAME")
        for m in _FULL.finditer(text):
            if taken[m.start() : m.end()].any():
                continue
            parts = m.group().split(" ")
            known = [len(x) == 2 and x[1] == "." or x.lower() in self.first for x in parts]
            ends = [k for k in range(len(parts) - 1, 0, -1) if parts[k].lower() in self.last and known[k - 1]]
            if ends:  # the longest run of name words that ends with a last one; what stands before is no name word
                first = ends[0]
                while first and known[first - 1]:
                    first -= 1
                at = m.start() + len(" ".join(parts[:first])) + (first > 0)
                add(at, at + len(" ".join(parts[first : ends[0] + 1])), "NAME")
            elif len(parts) < 4 and any(c in self.contexts for c in beside(text, *m.span())):
                add(*m.span(), "NAME")
        return sorted(spans)


def encode(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(len(starts), np.int8)
    for a, b, kind in spans:
        inside = np.flatnonzero((starts >= a) & (ends <= b))
        if len(inside):
            k = 1 + 2 * TYPES.index(kind)
            out[inside] = k + 1
            out[inside[0]] = k
    return out


def _fit_words(weights: np.ndarray, grad2: np.ndarray, feats: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Maximum likelihood of each word's label by itself (adaptive steps), in place."""
    target = np.eye(L, dtype=np.float32)[y]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), 1024):
            b = order[a : a + 1024]
            f = feats[b]
            z = weights[f].sum(axis=1)
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            flat = f.ravel()
            by = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(flat[by]) > 0]))
            total = np.add.reduceat(((p - target[b]) / len(b) * 16)[by // f.shape[1]], first, axis=0)
            unique = flat[by][first]
            grad2[unique] += total * total
            weights[unique] -= 0.3 * total / np.sqrt(grad2[unique])
            weights[SPACE] = 0


def train(texts: list[str]) -> dict[str, np.ndarray]:
    """Word weights, transitions and skip potentials, from documents labelled by cues."""
    cues = Cues(texts)
    words = Words()
    tokens, docs, gold = [], [], []
    for d, t in enumerate(texts):
        ms = list(_TOKEN.finditer(t))
        tokens += [m.group() for m in ms]
        docs += [d] * len(ms)
        gold.append(encode(np.array([m.start() for m in ms]), np.array([m.end() for m in ms]), cues.spans(t)))
    word, doc = words.number(tokens), np.array(docs, np.int32)
    y = np.concatenate(gold) if gold else np.zeros(0, np.int8)
    if not len(y):
        return {"weights": np.zeros((SPACE, L), np.float32), "transition": np.zeros((L, L), np.float32), "skip": np.zeros(len(TYPES) + 1, np.float32)}
    types = list(words.ids)
    place = neighbours(word, doc, np.array([w[0].isalpha() for w in types])[word])
    # Most names of a corpus are not in the sample: name words are hidden in two thirds of it.
    named = np.bincount(word, weights=y >= 2 * TYPES.index("NAME") + 1, minlength=len(types)) / np.bincount(word, minlength=len(types))
    hidden = {w for w, share in zip(types, named) if share >= 0.5 and w[0].isalpha()}
    table = []
    per = [feature_ids(w) for w in types]
    per += [feature_ids(w, True) if w in hidden else f for w, f in zip(types, per)]
    for k in range(len(SLOTS)):
        one = np.full((len(per), max(len(f[k]) for f in per)), SPACE, np.int64)
        for i, f in enumerate(per):
            one[i, : len(f[k])] = f[k]
        table.append(one)
    look = word + len(types) * (doc % 3 == 1)
    near = np.convolve(y > 0, np.ones(9), "same") > 0
    rng = np.random.default_rng(7)
    chosen = np.flatnonzero(near | (rng.random(len(y)) < 0.3) | np.array([w[0].isupper() or w[0].isdigit() for w in types])[word])
    feats = np.concatenate([np.where(p[chosen, None] >= 0, t[look[np.maximum(p[chosen], 0)]], SPACE) for p, t in zip(place, table)], axis=1)
    weights, grad2 = np.zeros((SPACE + 1, L), np.float32), np.full((SPACE + 1, L), 1e-3, np.float32)
    held = doc % 3 == 2  # these documents are kept for the potentials
    mine = ~held[chosen]
    _fit_words(weights, grad2, feats[mine], y[chosen][mine], rng, EPOCHS)
    transition, skip = _fit_potentials(weights[:SPACE], hidden, [tokens[i] for i in np.flatnonzero(held)], doc[held], y[held], y, doc)
    _fit_words(weights, grad2, feats, y[chosen], rng, 1)
    return {"weights": weights[:SPACE], "transition": transition, "skip": skip}


def _fit_potentials(weights: np.ndarray, hidden: set[str], tokens: list[str], doc: np.ndarray, y: np.ndarray, all_y: np.ndarray, all_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Transition and skip potentials together: each moves by the ratio of observed to expected counts, in rounds."""
    seen = np.full((L, L), 1.0)
    same = all_doc[1:] == all_doc[:-1]
    np.add.at(seen, (all_y[:-1][same], all_y[1:][same]), 1.0)
    base = np.bincount(all_y, minlength=L) + 1.0
    # The words' scores already hold how common a label is.
    t = np.log(seen / seen.sum(axis=1, keepdims=True) / (base / base.sum()))
    inside = np.array([x[0] == "I" for x in LABELS])
    kind = (np.arange(L) + 1) // 2
    never = inside[None, :] & (kind[:, None] != kind[None, :])
    t = np.where(never, -30.0, np.clip(t, -30, 6)).astype(np.float32)
    skip = np.zeros(len(TYPES) + 1, np.float32)
    words = Words(weights, hidden)
    word = words.number(tokens)
    words.ready()
    score = words.scores(word, doc)
    a, b = skip_edges(words.fold[word], words.bones[word], doc, words.linked[word])
    active = open_words(score, a, b)
    start, length = chains(active, doc)
    inner = active[1:] & active[:-1] & (doc[1:] == doc[:-1])
    there = np.full((L, L), 0.5)
    np.add.at(there, (y[:-1][inner], y[1:][inner]), 1.0)
    np.add.at(there, (np.zeros(len(start), int), y[start]), 1.0)
    np.add.at(there, (y[start + length - 1], np.zeros(len(start), int)), 1.0)
    of = kind[y]
    live = active[a] & active[b]
    a, b = a[live], b[live]
    agree, either = (np.array([f(of[a] == k, of[b] == k).sum() for k in range(len(skip))]) for f in (np.logical_and, np.logical_or))
    # Edges between clear words say little about the potential: each counts once more as an edge between two words of
    # which nothing is known, and these agree as often as all edges of the type do.
    agree = agree + agree + 0.5
    for _ in range(FITTING):
        _, into_a, into_b, by_kind = exchange(score, start, length, t, skip, a, b)
        expected = np.full((L, L), 0.5)
        final = score.copy()
        np.add.at(final, a, into_a[:, kind])
        np.add.at(final, b, into_b[:, kind])
        marginals(final, start, length, t, expected)
        both = (_alone(by_kind[a], into_a) * _alone(by_kind[b], into_b)) * np.exp(skip)
        none = 1.0 + ((np.exp(skip) - 1.0) * _alone(by_kind[a], into_a) * _alone(by_kind[b], into_b)).sum(axis=1, keepdims=True)
        met = (both / none).sum(axis=0) + either * np.exp(skip) / (np.exp(skip) + 3.0) + 0.5
        skip[1:] = np.clip(skip[1:] + np.log(agree / met)[1:], 0.0, 4.0)
        t = np.where(never, -30.0, np.clip(t + 0.5 * np.log(there / expected), -30, 6)).astype(np.float32)
    return t, skip


def skip_edges(fold: np.ndarray, bones: np.ndarray, doc: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each capitalised word or long number with its next equal occurrence (case apart) in the document, and with the
    next one that is spelt with the same consonants but not equal: at most two edges per word."""
    out = [np.zeros((2, 0), int)]
    i = np.flatnonzero(linked)
    for key in (fold, bones):
        at = i[key[i] >= 0]
        order = at[np.lexsort((at, key[at], doc[at]))]
        same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        if key is bones:
            same &= fold[order][1:] != fold[order][:-1]
        out.append(np.stack([order[:-1][same], order[1:][same]]))
    a, b = np.concatenate(out, axis=1)
    return a, b


def open_words(score: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that may be more than outside: by their own score, or by a path of skip edges to such a word."""
    active = score[:, 0] - score[:, 1:].max(axis=1) < CERTAIN if len(score) else np.zeros(0, bool)
    while True:
        one = active[a] != active[b]
        if not one.any():
            return active
        active[a[one]] = active[b[one]] = True


# --- inference ------------------------------------------------------------------------------------------------


def chains(active: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of each run of active words within a document."""
    n = len(active)
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    new = active & np.concatenate([[True], ~active[:-1] | (doc[1:] != doc[:-1])])
    end = active & np.concatenate([~active[1:] | (doc[1:] != doc[:-1]), [True]])
    s, e = np.flatnonzero(new), np.flatnonzero(end)
    return s, e - s + 1


def _padded(start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chains in groups of like length: positions (chains x longest) and which are real."""
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        longest = max(8, int(length[order[at]] * 1.5) + 4)
        to = at + int(np.searchsorted(length[order[at:]], longest, side="right"))
        to = min(max(to, at + 1), at + max(1, 400_000 // longest))
        mine = order[at:to]
        step = np.arange(int(length[mine].max()))
        real = step[None, :] < length[mine][:, None]
        yield np.where(real, start[mine][:, None] + step[None, :], 0), real
        at = to


def marginals(score: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Beliefs of the words in chains (forward and backward messages); outside elsewhere.

    Expected counts of neighbouring labels, the ends of chains included, are added to ``pairs``.
    """
    out = np.zeros(score.shape)
    out[:, 0] = 1.0
    whole = lambda x: x / (x.sum(axis=1, keepdims=True) + 1e-300)
    t = np.exp(t.astype(float))
    for pos, real in _padded(start, length):
        e = score[pos].astype(float)
        e = np.exp(e - e.max(axis=2, keepdims=True))
        n, steps = pos.shape
        f = np.zeros((steps, n, L))
        f[0] = whole(e[:, 0] * t[0])
        for k in range(1, steps):
            f[k] = whole((f[k - 1] @ t) * e[:, k])
        b = np.tile(t[:, 0], (n, 1))
        last = real.sum(axis=1) - 1
        for k in range(steps - 1, -1, -1):
            ends, mine = last == k, real[:, k]
            b[ends] = t[:, 0]
            total = whole(f[k] * b)[mine]
            out[pos[mine, k]] = total
            behind = e[:, k] * b
            if pairs is not None:
                pairs[:, 0] += whole(f[k] * b)[ends].sum(axis=0)
                if k:
                    before, now = f[k - 1][mine], behind[mine]
                    pairs += t * ((before / (((before @ t) * now).sum(axis=1, keepdims=True) + 1e-300)).T @ now)
                else:
                    pairs[0] += total.sum(axis=0)
            if k:
                b = np.where(mine[:, None], whole(behind @ t.T), b)
    return out


def best_path(score: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros(len(score), np.int8)
    for pos, real in _padded(start, length):
        e = score[pos]
        n, steps = pos.shape
        v = e[:, 0] + t[0]
        back = np.zeros((n, steps, L), np.int8)
        keep = np.repeat(np.arange(L, dtype=np.int8)[None], n, axis=0)
        for k in range(1, steps):
            s = v[:, :, None] + t[None]
            arg = s.argmax(axis=1)
            new = np.take_along_axis(s, arg[:, None, :], 1)[:, 0] + e[:, k]
            mine = real[:, k, None]
            back[:, k] = np.where(mine, arg, keep)
            v = np.where(mine, new, v)
        y = (v + t[:, 0]).argmax(axis=1)
        for k in range(steps - 1, -1, -1):
            mine = real[:, k]
            out[pos[mine, k]] = y[mine]
            y = np.where(mine, np.take_along_axis(back[:, k], y[:, None], 1)[:, 0], y) if k else y
    return out


def _alone(belief: np.ndarray, received: np.ndarray) -> np.ndarray:
    """The belief of a word without what it was told over one edge."""
    own = belief * np.exp(-received)
    return own / own.sum(axis=1, keepdims=True)


def exchange(score: np.ndarray, start: np.ndarray, length: np.ndarray, t: np.ndarray, skip: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores after messages along chains and over skip edges in turn, the last messages, and beliefs by type."""
    kind = (np.arange(L) + 1) // 2
    into_a, into_b = np.zeros((len(a), len(skip)), np.float32), np.zeros((len(a), len(skip)), np.float32)
    gain = np.exp(skip) - 1.0

    def told(belief: np.ndarray, received: np.ndarray) -> np.ndarray:
        out = np.log(1.0 + gain * _alone(belief, received))
        return (out - out[:, :1]).astype(np.float32)

    for _ in range(ROUNDS):
        now = score.copy()
        np.add.at(now, a, into_a[:, kind])
        np.add.at(now, b, into_b[:, kind])
        belief = marginals(now, start, length, t)
        by_kind = np.stack([belief[:, kind == k].sum(axis=1) for k in range(len(skip))], axis=1) + 1e-9
        into_a, into_b = told(by_kind[b], into_b), told(by_kind[a], into_a)
    now = score.copy()
    np.add.at(now, a, into_a[:, kind])
    np.add.at(now, b, into_b[:, kind])
    return now, into_a, into_b, by_kind


class Finder:
    """Reads batches of documents with a trained field."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.words = Words(model["weights"])

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, type) of each text."""
        if len(self.words.ids) > REMEMBER:
            self.words = Words(self.model["weights"])
        tokens: list[str] = []
        counts = []
        for t in texts:
            got = _TOKEN.findall(t)
            tokens += got
            counts.append(len(got))
        words = self.words
        word = words.number(tokens)
        words.ready()
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        score = words.scores(word, doc)
        a, b = skip_edges(words.fold[word], words.bones[word], doc, words.linked[word])
        active = open_words(score, a, b)
        start, length = chains(active, doc)
        a, b = a[active[a]], b[active[a]]  # both ends of an edge are open, or none
        t = self.model["transition"]
        if len(a) and self.model["skip"].any():
            score = exchange(score, start, length, t, self.model["skip"], a, b)[0]
        return self._spans(texts, counts, best_path(score, start, length, t))

    @staticmethod
    def _spans(texts: list[str], counts: list[int], y: np.ndarray) -> list[list[tuple[int, int, str]]]:
        out = []
        at = 0
        for t, n in zip(texts, counts):
            mine = y[at : at + n]
            at += n
            spans: list[tuple[int, int, str]] = []
            if mine.any():
                ms = list(_TOKEN.finditer(t))
                for k in np.flatnonzero(mine):
                    label = LABELS[mine[k]]
                    if label[0] == "I" and spans and spans[-1][2] == label[2:]:
                        spans[-1] = (spans[-1][0], ms[k].end(), label[2:])
                    else:
                        spans.append((ms[k].start(), ms[k].end(), label[2:]))
            out.append(sorted({x for s in spans for x in checked(t, *s)}))
        return out


_LEAD = re.compile(rf"^(?:\W+|(?:{TITLES})\b\.?\s+|[SM]\.\s?[A-Z][A-Za-z]{{0,3}}\.+\s*)+")
_DIGITS = re.compile(r"(?:\+62|\(0|0|62)[\d\s().\-]*\d")
_OR = re.compile(r"\s(?:atau|or|/|dan|and)\s|[,;]")


def checked(text: str, a: int, b: int, kind: str) -> list[tuple[int, int, str]]:
    """A check of form behind the field: a span begins where its form begins, and two of a form are two spans."""
    span = text[a:b]
    digits = sum(c.isdigit() for c in span)
    if kind == "EMAIL":
        near = max(0, a - 12)
        return [(near + m.start(), near + m.end(), kind) for m in _EMAIL.finditer(text[near : b + 24]) if near + m.start() < b and near + m.end() > a]
    if kind == "PHONE":
        out, at = [], a
        for part in [*(x.span() for x in _OR.finditer(span)), (len(span), len(span))]:
            m = _DIGITS.search(text[at : a + part[0]])
            if m and 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((at + m.start(), at + m.end(), kind))
            at = a + part[1]
        return out
    if kind == "ID_NUMBER":
        m = re.search(r"[A-Z]{0,2}\d", span)
        back = re.search(r"[\d.\- ]+$", text[max(0, a - 14) : a]) if m else None
        if digits < 16 and back and sum(c.isdigit() for c in back.group()) >= 4:  # the number's first groups
            a -= len(back.group().lstrip(" .-"))
            return [(a, b, kind)]
        return [(a + m.start(), b, kind)] if m and digits >= 6 else []
    if kind == "NAME":
        m = _LEAD.match(span)
        a += m.end() if m else 0
        return [(a, b, kind)] if digits == 0 and len(re.findall(r"[^\W\d_]{3,}", text[a:b])) >= 1 else []
    m = re.search(r"\w", span)
    return [(a + m.start(), b, kind)] if m and len(span) >= 6 else []


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Train on a bounded sample of documents (doc_id, text)."""
    sample = bounded_sample(docs.filter("text is not null and trim(text) <> ''"), ["doc_id"], DOCS)
    return train([r.text for r in sample.select("doc_id", "text").orderBy("doc_id", "text").collect()])


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, stop, kind) of documents (doc_id, text)."""
    model = spark.sparkContext.broadcast(fit(docs))

    @F.pandas_udf("array<struct<start: long, stop: long, kind: string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(model.value)
        for s in batches:
            rows: list = []
            texts = s.tolist()
            for k in range(0, len(texts), 500):
                rows += [[{"start": a, "stop": b, "kind": c} for a, b, c in x] for x in finder.find(texts[k : k + 500])]
            yield pd.Series(rows, dtype=object)

    return docs.select("doc_id", "text", spans(F.coalesce("text", F.lit(""))).alias("spans"))


def masked(found: DataFrame) -> DataFrame:
    """doc_id and the text with a placeholder in the place of each span."""
    whole = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["done"], F.substring("text", (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("done"),
            x["stop"].alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))),
    )
    return found.select("doc_id", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")).alias("text"))
