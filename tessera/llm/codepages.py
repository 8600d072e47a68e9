"""What UTF-8 text looks like when it is read by a single-byte code page.

A unit is the image of one plausible character (a Latin, Greek, Cyrillic or mathematical letter, a sign or a typographic
mark) whose UTF-8 bytes were read by one code page. Text misread more than once holds images of images, so every
character that a code page produces beyond ASCII is plausible too. Units are generated from the code pages of the
Python library, so their number is bounded by (code pages) x (plausible characters).
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Code pages by which text is commonly misread (names of codecs).
PAGES = ["cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "cp852", "iso8859-15", "cp1254", "cp1257", "cp1251", "iso8859-2"]
#: Ranges of characters that budget texts plausibly contain beyond ASCII (first, last code point).
PLAUSIBLE = [(0xA0, 0x17F), (0x2C6, 0x2DD), (0x370, 0x3FF), (0x400, 0x45F), (0x2010, 0x203A), (0x20A0, 0x20BF), (0x2100, 0x2126), (0x2190, 0x2193), (0x2200, 0x2265), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0x1D400, 0x1D7FF)]


@lru_cache(maxsize=1)
def images() -> dict[str, list[str]]:
    """For each code page the character of each byte; bytes it does not define stay control characters."""
    out = {}
    for page in PAGES:
        row = []
        for b in range(256):
            try:
                row.append(bytes([b]).decode(page))
            except UnicodeDecodeError:
                row.append(chr(b))
        out[page] = row
    return out


@lru_cache(maxsize=1)
def units() -> dict[str, dict[str, str]]:
    """unit -> {code page: character it stands for}."""
    out: dict[str, dict[str, str]] = {}
    plausible = {chr(cp) for first, last in PLAUSIBLE for cp in range(first, last + 1)} | {c for row in images().values() for c in row if ord(c) > 0x7F}
    for c in sorted(plausible):
        data = c.encode()
        for page, row in images().items():
            unit = "".join(row[b] for b in data)
            if all(ord(x) > 0x7F for x in unit):
                out.setdefault(unit, {})[page] = c
    return out


def branch(tails: set[str]) -> str:
    """The tails as a tree by their first letters, longest first."""
    by: dict[str, set[str]] = {}
    for t in tails - {""}:
        by.setdefault(t[0], set()).add(t[1:])
    out = "|".join(re.escape(head) + branch(rest) for head, rest in sorted(by.items()))
    return f"(?:{out})" + "?" * ("" in tails) if by else ""


@lru_cache(maxsize=1)
def unit_pattern() -> re.Pattern:
    """Finds units, longest first."""
    return re.compile(branch(set(units())))
