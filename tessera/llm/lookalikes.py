"""Visually identical text with different characters: one consistent form, by table lookups on code-point arrays.

A batch of Arrow text is turned at once into one array of code points. Every step is a gather, a prefix sum or a
repeat over that array; no string function runs per row:

1. a class lookup names characters that render as nothing, as a space, as another character (full-width, mathematical
   and other presentation forms) or that look like a Latin letter, and combining marks,
2. look-alikes count only in words that hold a Latin letter or could be read as Latin altogether, so words of another
   script stay; words are found by prefix sums,
3. replaced characters are written by expansion offsets (a ligature becomes two letters),
4. marks are composed with the letter before them by a search in the sorted list of canonical pairs.

Superscripts, fractions, signs of units, typographic quotes and dashes and precomposed letters stay. Characters
inside garbled units (see codepages) stay too; they are the business of that operator.

Defined results: null stays null, empty stays empty; a mark without a letter it can combine with stays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.codepages import unit_pattern

#: Letters of other alphabets that look like a Latin letter (fixed values: the Latin letter, then its look-alikes).
LOOKALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫͿ", "K": "КΚᏦ", "L": "Ꮮ",
    "M": "МΜᎷ", "N": "ΝՆ", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅᏚՏ", "T": "ТΤᎢ", "U": "Ս", "V": "ᏙѴ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аαɑ", "b": "Ьᖯ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "f": "ẝ", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳ", "k": "κк", "l": "ӏⅼǀ",
    "m": "ⅿ", "n": "ոռ", "o": "оοօ", "p": "рρ", "q": "ԛզ", "r": "гᴦ", "s": "ѕꜱ", "u": "υսʋ", "v": "νѵᴠ", "w": "ԝᴡա", "x": "хχ", "y": "уγу", "z": "ᴢ",
}
#: Of these, letters that do not render as the Latin one closely enough to count by themselves.
LOOSE = set("αικГгкυγ")

NOTHING, SPACE, FORM, LOOK, MARK = 1, 2, 3, 4, 5
_SIZE = 0x110000


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, derived from the Unicode character database."""
    kind = np.zeros(_SIZE, np.uint8)
    target: dict[int, str] = {}
    letter, latin = np.zeros(_SIZE, bool), np.zeros(_SIZE, bool)
    for cp in range(0x80, 0x20000):
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat[0] == "L":
            letter[cp] = True
            latin[cp] = unicodedata.name(c, "").startswith(("LATIN", "FULLWIDTH LATIN"))
        if cat == "Cf" or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F:
            kind[cp] = NOTHING
        elif cat == "Zs":
            kind[cp], target[cp] = SPACE, " "
        elif cat == "Mn":
            kind[cp] = MARK
        else:
            tag, _, _ = unicodedata.decomposition(c).partition("> ")
            whole = unicodedata.normalize("NFKC", c)
            if tag in ("<wide", "<narrow", "<font", "<noBreak", "<compat", "<initial", "<medial", "<final", "<isolated") and whole != c and all(" " < x < "\x7f" for x in whole) and cp not in (0x2024, 0x2025, 0x2026):
                kind[cp], target[cp] = FORM, whole
                latin[cp] = whole.isalpha()
                letter[cp] |= whole.isalpha()
            elif tag in ("<wide", "<narrow") and whole != c:
                kind[cp], target[cp] = FORM, whole
    ascii_ = np.arange(0x41, 0x5B)
    letter[ascii_] = latin[ascii_] = letter[ascii_ + 32] = latin[ascii_ + 32] = True
    for plain, many in LOOKALIKES.items():
        for c in many:
            if kind[ord(c)] == 0 or kind[ord(c)] == FORM:
                kind[ord(c)], target[ord(c)] = LOOK, plain
                latin[ord(c)] = c in "ɑɡɩʋǀᴠᴡᴢᴦꜱẝ" and latin[ord(c)]
    for cp, plain in ((0x037E, ";"), (0x1FEF, "`"), (0x2236, ":"), (0x01C3, "!"), (0x2215, "/"), (0x2044, "/"), (0xA789, ":"), (0x0589, ":"), (0x05C3, ":"), (0x066A, "%")):
        kind[cp], target[cp] = FORM, plain
    kind[0xE0000:0xE0080] = NOTHING
    start, length, flat = np.zeros(_SIZE, np.int32), np.ones(_SIZE, np.int8), []
    for cp, s in target.items():
        start[cp], length[cp] = len(flat), len(s)
        flat += [ord(x) for x in s]
    pairs = {}
    for cp in range(0xC0, 0x2000):
        d = unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            a, b = (int(x, 16) for x in d.split())
            pairs[(a << 21) | b] = cp
    keys = np.array(sorted(pairs), np.int64)
    return {"kind": kind, "letter": letter, "latin": latin, "start": start, "length": length, "flat": np.array(flat, np.uint32), "keys": keys, "made": np.array([pairs[k] for k in keys], np.uint32)}


def consistent(points: np.ndarray, row: np.ndarray, rows: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points in one form, the row of each, and which of ``rows`` rows held something to change.

    ``keep`` marks code points that must stay.
    """
    t = tables()
    kind = t["kind"][points]
    if keep is not None:
        kind[keep] = 0
    found = np.zeros(rows, bool)
    if kind.any():
        look = kind == LOOK
        if look.any():
            # Words: runs of letters; what renders as nothing and marks do not end them.
            inside = t["letter"][points] | (kind == NOTHING) | (kind == MARK)
            head = inside & np.concatenate([[True], ~inside[:-1] | (row[1:] != row[:-1])])
            word = np.cumsum(head)
            n = int(word[-1]) + 1
            real = t["letter"][points] & inside
            has_latin = np.bincount(word[real & t["latin"][points] & ~look], minlength=n) > 0
            foreign = real & ~t["latin"][points] & ~look
            foreign |= look & np.isin(points, [ord(c) for c in LOOSE])
            has_foreign = np.bincount(word[foreign], minlength=n) > 0
            counted = look & inside & (has_latin[word] | ~has_foreign[word])
            kind[look & ~counted] = 0
        change = (kind == NOTHING) | (kind == SPACE) | (kind == FORM) | (kind == LOOK)
        found[row[change]] = True
        length = np.where(kind == NOTHING, 0, np.where(change, t["length"][points], 1))
        at = np.repeat(np.arange(len(points)), length)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        source = points[at]
        points = np.where(change[at], t["flat"][np.minimum(t["start"][source] + offset, len(t["flat"]) - 1)], source).astype(np.uint32)
        row = row[at]
        # Compose marks with what stands before them; one mark of each chain per turn.
        while True:
            mark = (t["kind"][points] == MARK) & np.concatenate([[False], row[1:] == row[:-1]])
            i = np.flatnonzero(mark)
            if not len(i):
                break
            found[row[i]] = True
            key = (points[i - 1].astype(np.int64) << 21) | points[i]
            k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = t["keys"][k] == key
            i, k = i[hit], k[hit]
            first = np.concatenate([[True], np.diff(i) > 1]) if len(i) else np.zeros(0, bool)
            i, k = i[first], k[first]
            if not len(i):
                break
            points = points.copy()
            points[i - 1] = t["made"][k]
            stay = np.ones(len(points), bool)
            stay[i] = False
            points, row = points[stay], row[stay]
        lone = (t["kind"][points] == MARK) if keep is None else np.zeros(len(points), bool)
        found[row[lone]] = True
    return points, row, found


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def normalise(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """One form of a string array and which rows were changed."""
    rows = len(text)
    flat = text.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + rows + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if rows else np.zeros(0, np.uint8)
    if not rows or not len(data):
        return text, np.zeros(rows, bool)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = starts[offsets - offsets[0]]
    whole = data.tobytes().decode("utf-8")
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(rows), np.diff(ends))
    keep = np.zeros(len(points), bool)
    for m in unit_pattern().finditer(whole):
        if row[m.start()] == row[m.end() - 1]:
            keep[m.start() : m.end()] = True
    points, row, found = consistent(points, row, rows, keep)
    size = np.bincount(row, weights=_utf8_lengths(points), minlength=rows).astype(np.int64)
    out = pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"))
    made = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()), out)
    if text.null_count:
        made = pa.compute.if_else(text.is_null(), pa.scalar(None, pa.large_string()), made)
    return made.cast(pa.string()), found


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, found = normalise(batch["text"])
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names if c != "text"], made, pa.array(found)], names=[*[c for c in batch.schema.names if c != "text"], "text", "found"])


def one_form(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, text in one form and found (whether anything was changed). ASCII and null texts never reach Python."""
    rows = rows.select(*keys, "text")
    odd = F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("text", T.StringType()), T.StructField("found", T.BooleanType())])
    done = rows.filter(odd).mapInArrow(_run, schema)
    return done.unionByName(rows.filter(~odd).withColumn("found", F.lit(False)))
