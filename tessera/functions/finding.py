"""Which of many patterns stand in which texts, by a table of letter groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first bytes of a little-endian word, by their number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def expand(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every place from its start to before its end, and the places."""
    n = ends - starts
    total = int(n.sum())
    return np.repeat(rows, n), np.arange(total) - np.repeat(np.cumsum(n) - n - starts, n)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as one number; behind the end stand zeros."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,))


class Finder:
    """Patterns laid out for texts as bytes of UTF-8. Of each pattern one group of 8 bytes (of shorter ones 4, 2 or 1),
    the rarest in the patterns, is looked up at every byte of the texts; where it stands, the pattern is compared whole."""

    #: Bytes looked at, and candidates compared, at once.
    STEP, AT_ONCE = 1 << 16, 1 << 20

    def __init__(self, patterns: list[str]):
        coded = [p.encode() for p in patterns]
        self.sizes = np.array([len(p) for p in coded], np.int64)
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.groups = []
        bits = int(min(24, max(16, len(patterns).bit_length() + 5)))
        words = _words(self.data)
        width = np.select([self.sizes >= 8, self.sizes >= 4, self.sizes >= 2], [8, 4, 2], self.sizes)
        for size in (8, 4, 2, 1):
            which = np.flatnonzero(width == size)
            if not len(which):
                continue
            owner, place = expand(np.arange(len(which)), self.starts[which], self.starts[which] + self.sizes[which] - size + 1)
            key = words[place] & _FIRST[size]
            at = self._at(key, bits)
            times = np.minimum(np.bincount(at, minlength=1 << bits), 1 << 20)[at]
            rarest = np.minimum.reduceat((times << 40) | place, np.searchsorted(owner, np.arange(len(which)))) & ((1 << 40) - 1)
            key, offset = words[rarest] & _FIRST[size], rarest - self.starts[which]
            order = np.argsort(key, kind="stable")
            keys, begin = np.unique(key[order], return_index=True)
            table = np.zeros(1 << bits, bool)
            table[self._at(keys, bits)] = True
            self.groups.append((size, bits, table, keys, np.append(begin, len(key)), which[order], offset[order]))

    @staticmethod
    def _at(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, pattern), distinct and in order; null texts and empty patterns take no part."""
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        words, mine, found = _words(data), _words(self.data), [np.zeros(0, np.int64)]
        for size, bits, table, keys, begin, which, offset in self.groups:
            for a in range(0, len(words), self.STEP):
                part = words[a : a + self.STEP] & _FIRST[size]
                spot = np.flatnonzero(table[self._at(part, bits)])
                at = np.minimum(np.searchsorted(keys, part[spot]), len(keys) - 1)
                ok = keys[at] == part[spot]
                spot, at = spot[ok] + a, at[ok]
                total, b = np.cumsum(begin[at + 1] - begin[at]), 0
                while b < len(spot):
                    e = max(b + 1, int(np.searchsorted(total, (total[b - 1] if b else 0) + self.AT_ONCE, "right")))
                    own, k = expand(spot[b:e], begin[at[b:e]], begin[at[b:e] + 1])
                    found.append(self._whole(words, mine, ends, own, which[k], offset[k]))
                    b = e
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.sizes)))

    def _whole(self, words: np.ndarray, mine: np.ndarray, ends: np.ndarray, spot: np.ndarray, p: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """row * patterns + pattern of the candidates that stand in one text as a whole."""
        row, at, own = np.searchsorted(ends, spot, "right") - 1, spot - offset, self.starts[p]
        ok = (at >= ends[row]) & (at + self.sizes[p] <= ends[row + 1])
        row, at, own, p, done = row[ok], at[ok], own[ok], p[ok], []
        rest = self.sizes[p]
        while len(p):
            ok = ((words[at] ^ mine[own]) & _FIRST[np.minimum(rest, 8)]) == 0
            over = ok & (rest <= 8)
            done.append(row[over] * len(self.sizes) + p[over])
            ok &= rest > 8
            row, at, own, p, rest = row[ok], at[ok] + 8, own[ok] + 8, p[ok], rest[ok] - 8
        return np.concatenate(done) if done else np.zeros(0, np.int64)
