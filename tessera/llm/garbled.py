"""Garbled text from wrong character encodings: a mixture of substitution ciphers, learned by expectation-maximisation.

Each source has an unknown mix of code-page swaps. A swap is a cipher that writes one letter as a unit: of two to four
letters where UTF-8 was read by a single-byte code page, of one where one single-byte code page was read by another.
One letter counts as a unit only inside a word of ASCII letters, if it is no Latin letter and looks like none. What a
unit stands for is learned against the language's bigrams (a letter and what stands beside it):

* one pass counts, per source, the units with their left and right neighbours, and all other letters beyond ASCII
  with theirs; both tables are bounded by the units and letters there are, not by the rows,
* expectation: each unit in its neighbourhood is either meant as it stands or a letter under one of the code pages;
  the probabilities follow from the source's mix and from the bigrams,
* maximisation: the source's mix and the bigrams are counted anew with these probabilities,
* units more likely garbled than meant get a letter; the mapping is applied by translate(), again and again for
  text that was misread more than once.

Letters lost for good (U+FFFD) and control characters of the C1 block show damage that cannot be restored.

Defined results: null and empty texts are never garbled and come out as they are; ASCII texts never reach Python.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.codepages import branch, units
from tessera.llm.lookalikes import LOOKALIKES

#: Rounds of expectation-maximisation, and smoothing of the bigrams.
EM_ROUNDS, SMOOTH = 12, 10.0
_LOST = re.compile("[�\x80-\x9f]")
_BEYOND = r"[^\x00-\x7F]"
#: Code pages of one byte that are taken for each other: written in, read by. How much less likely than a swap it is
#: that a letter of another script is meant inside a Latin word (log).
WRITTEN, READ, FOREIGN = ["cp1252", "cp1250", "mac_roman"], ["cp1251", "cp1253", "koi8_r", "iso8859-5", "iso8859-7", "cp437", "cp850"], -3.0


@lru_cache(maxsize=1)
def swaps() -> dict[str, dict[str, str]]:
    """letter shown -> {swap of code pages: Latin letter written}."""
    latin = lambda c: c.isalpha() and unicodedata.name(c, "").startswith("LATIN")
    like = {c for many in LOOKALIKES.values() for c in many}
    out: dict[str, dict[str, str]] = {}
    for written in WRITTEN:
        for read in READ:
            for b in range(0x80, 0x100):
                try:
                    plain, shown = bytes([b]).decode(written), bytes([b]).decode(read)
                except UnicodeDecodeError:
                    continue
                if latin(plain) and not latin(shown) and shown not in like and unicodedata.category(shown) in ("Lu", "Ll", "So", "Sm"):
                    out.setdefault(shown, {})[f"{written}>{read}"] = plain
    return out


@lru_cache(maxsize=1)
def pattern() -> re.Pattern:
    """Finds units: those of several letters, and runs of swapped letters between ASCII letters, one at a time.

    One tree by first letters, so that the search can skip all others.
    """
    tails: dict[str, set[str]] = defaultdict(set)
    for u in units():
        tails[u[0]].add(u[1:])
    one = "".join(map(re.escape, sorted(swaps())))
    ways = []
    for head in sorted({*tails, *swaps()}):
        more = [branch(tails[head])] if head in tails else []
        if head in swaps():
            more.append(f"(?<=[A-Za-z{one}]{re.escape(head)})(?=[{one}]*[A-Za-z])")
        ways.append(f"{re.escape(head)}(?:{'|'.join(more)})")
    return re.compile("|".join(ways))


def options(symbol: str) -> dict[str, str]:
    """What a unit may stand for, by the code pages."""
    return units().get(symbol) or swaps().get(symbol, {})


def neighbour(c: str) -> str:
    """Class of a neighbouring character: a lower or upper letter, a digit, white space, an edge, other ASCII, or beyond."""
    if not c:
        return "^"
    if c > "\x7f":
        return "u" if not c.isalpha() else "x"
    return "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else " " if c.isspace() else "."


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    find, beyond = pattern(), re.compile("[^\x00-\x7f]")
    for pdf in batches:
        seen: dict[tuple, int] = defaultdict(int)
        for source, text in zip(pdf["source"], pdf["text"]):
            at = 0
            for m in find.finditer(text):
                for c in beyond.finditer(text, at, m.start()):
                    i = c.start()
                    seen[source, "c", c.group(), neighbour(text[i - 1 : i]), neighbour(text[i + 1 : i + 2])] += 1
                seen[source, "u", m.group(), neighbour(text[m.start() - 1 : m.start()] if m.start() else ""), neighbour(text[m.end() : m.end() + 1])] += 1
                at = m.end()
            for c in beyond.finditer(text, at):
                i = c.start()
                seen[source, "c", c.group(), neighbour(text[i - 1 : i] if i else ""), neighbour(text[i + 1 : i + 2])] += 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["source", "kind", "symbol", "before", "after", "n"])


def _chain(before: str, letters: str, after: str) -> list[tuple[str, str, str]]:
    """Each letter with the classes of its neighbours."""
    n = len(letters) - 1
    return [(before if i == 0 else neighbour(letters[i - 1]), c, after if i == n else neighbour(letters[i + 1])) for i, c in enumerate(letters)]


def learn(counts: list[tuple[str, str, str, str, str, int]]) -> dict[str, dict[str, str]]:
    """source -> {unit: letter} from (source, kind, symbol, before, after, n)."""
    letters: dict[tuple[str, str, str], float] = defaultdict(float)  # (before, letter, after)
    found = []
    for source, kind, symbol, before, after, n in sorted(counts):
        if kind == "c":
            letters[before, symbol, after] += n
        else:
            found.append((source, symbol, before, after, n, sorted(options(symbol).items())))
    mix: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(lambda: 1.0))
    weight: list[dict[tuple[str, str], float]] = []
    for _ in range(EM_ROUNDS):
        bigram, single, place = dict(letters), defaultdict(float), defaultdict(float)
        for (_, symbol, before, after, n, _), w in zip(found, weight):
            for (_, plain), p in w.items():
                for key in _chain(before, plain or symbol, after):
                    bigram[key] = bigram.get(key, 0.0) + n * p
        for (before, c, after), v in bigram.items():
            single[c] += v
            place[before, after] += v
        total = sum(single.values()) + 1.0

        def score(before: str, chain: str, after: str) -> float:
            """Log probability of the letters in their places, with the letter's own frequency where a place is rare."""
            out = 0.0
            for key in _chain(before, chain, after):
                alone = (single.get(key[1], 0.0) + 0.01) / total
                out += math.log((bigram.get(key, 0.0) + SMOOTH * alone) / (place.get((key[0], key[2]), 0.0) + SMOOTH))
            return out

        weight, fresh = [], defaultdict(lambda: defaultdict(lambda: 0.5))
        for source, symbol, before, after, n, may in found:
            logs = {("", ""): math.log(mix[source][""]) + score(before, symbol, after) + FOREIGN * (len(symbol) == 1)}
            for page, plain in may:
                logs[page, plain] = math.log(mix[source][page]) + score(before, plain, after)
            top = max(logs.values())
            whole = sum(math.exp(v - top) for v in logs.values())
            w = {k: math.exp(v - top) / whole for k, v in logs.items()}
            weight.append(w)
            for (page, _), p in w.items():
                fresh[source][page] += n * p
        mix = defaultdict(lambda: defaultdict(lambda: 0.5), {s: defaultdict(lambda: 0.5, {k: v / sum(d.values()) for k, v in d.items()}) for s, d in fresh.items()})
    votes: dict[tuple[str, str], dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for (source, symbol, _, _, n, _), w in zip(found, weight):
        for (_, plain), p in w.items():
            votes[source, symbol][plain] += n * p
    out: dict[str, dict[str, str]] = defaultdict(dict)
    for (source, symbol), v in votes.items():
        plain = max(sorted(v), key=lambda k: v[k] * (k != ""))
        if plain and sum(x for k, x in v.items() if k) > v.get("", 0.0):
            out[source][symbol] = plain
    return dict(out)


class Restorer:
    """Applies a learned mapping: units become single private letters, which translate() turns into the originals."""

    def __init__(self, mapping: dict[str, str]):
        self.private = {u: chr(0xF0000 + i) for i, u in enumerate(sorted(mapping))}
        self.table = {ord(self.private[u]): c for u, c in mapping.items()}
        self.find = pattern()

    def restore(self, text: str, passes: int | None = None) -> tuple[str, bool]:
        """The text restored until nothing changes, or in so many passes, and whether any unit was replaced.

        It ends: each pass that changes a text makes it shorter or takes letters of other scripts out of it.
        """
        changed = False
        for _ in itertools.count() if passes is None else range(passes):
            marked = self.find.sub(lambda m: self.private.get(m.group(), m.group()), text)
            if marked == text:
                break
            text, changed = marked.translate(self.table), True
        return text, changed


def _after(rows: DataFrame, mapping: dict[str, dict[str, str]], passes: int) -> DataFrame:
    """The texts after so many passes, of those rows that the last one changed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = {s: Restorer(m) for s, m in mapping.items()}
        for pdf in batches:
            out = []
            for source, text in zip(pdf["source"], pdf["text"]):
                if source in by:
                    before = by[source].restore(text, passes - 1)[0]
                    text, changed = by[source].restore(before, 1)
                    out += [(source, text)] * changed
            yield pd.DataFrame(out, columns=["source", "text"])

    return rows.mapInPandas(run, "source string, text string")


def fit(rows: DataFrame) -> dict[str, dict[str, str]]:
    """Learn the mapping of each source from rows (source, text). Sources must be few (kinds of source, not files).

    Units that come out only of a pass (text misread more than once) are counted after it and learned with the others.
    """
    odd = rows.filter(F.col("text").rlike(_BEYOND)).select("source", "text")
    counts: list[tuple] = []
    mapping: dict[str, dict[str, str]] = {}
    for passes in itertools.count():
        seen = (_after(odd, mapping, passes) if passes else odd).mapInPandas(_count, "source string, kind string, symbol string, before string, after string, n long")
        # Bounded: sources x (units + letters of Unicode) x neighbour classes.
        got = [tuple(r) for r in seen.groupBy("source", "kind", "symbol", "before", "after").agg(F.sum("n").alias("n")).collect()]
        known = {c[:3] for c in counts}
        fresh = [c for c in got if not passes or c[1] == "u" and c[:3] not in known]
        if not fresh:
            break
        counts += fresh
        for source, learned in learn(counts).items():
            mapping[source] = learned | mapping.get(source, {})
    return mapping


def restore(spark: SparkSession, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, restored (text) and garbled (boolean) of rows with source and text; ASCII and null texts pass as they are."""
    mapping = spark.sparkContext.broadcast(fit(rows))

    @F.pandas_udf("restored string, garbled boolean")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by = {s: Restorer(m) for s, m in mapping.value.items()}
        none = Restorer({})
        for source, text in batches:
            got = [by.get(s, none).restore(t) for s, t in zip(source, text)]
            yield pd.DataFrame({"restored": [g[0] for g in got], "garbled": [c or bool(_LOST.search(t)) for t, c in got]})

    odd = F.coalesce(F.col("text").rlike(_BEYOND), F.lit(False))
    done = rows.filter(odd).withColumn("_r", apply("source", "text")).select(*keys, "_r.restored", "_r.garbled")
    plain = rows.filter(~odd).select(*keys, F.col("text").alias("restored"), F.lit(False).alias("garbled"))
    return done.unionByName(plain)
