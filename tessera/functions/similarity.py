"""Similarity of texts and vectors: indel ratios by a bit-parallel longest common subsequence, and cosine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_PAD = 0xFFFFFFFF


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine step per character of ``b`` (any length of ``a``)."""
    mask = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = mask
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & mask
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity in percent; two empty texts are equal."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def lcs_native(a: Column, b: Column) -> Column:
    """The same recurrence as a fold in SQL, for ``a`` of at most 62 characters."""
    letters = F.split(a, "")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(a)) - F.lit(1).cast("long")

    def step(s: Column, c: Column) -> Column:
        hit = F.aggregate(F.transform(letters, lambda x, i: F.when(x == c, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda u, v: u.bitwiseOR(v))
        u = s.bitwiseAND(hit)
        return (s + u).bitwiseOR(s - u).bitwiseAND(mask)

    left = F.aggregate(F.split(b, ""), mask, step)
    return F.when((a == "") | (b == ""), 0).otherwise(F.length(a) - F.bit_count(left))


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Block:
    """Texts of like length side by side, as numbers of the needles' letters."""

    def __init__(self, texts: list[str], letters: np.ndarray, margin: int):
        self.lengths = np.array([len(t) for t in texts])
        self.margin = margin
        width = int(self.lengths.max())
        padded = np.full((len(texts), width + 2 * margin), _PAD, np.uint32)
        for k, t in enumerate(texts):
            padded[k, margin : margin + len(t)] = _points(t)
        at = np.minimum(np.searchsorted(letters, padded), len(letters) - 1)
        self.codes = np.where(letters[at] == padded, at, len(letters)).astype(np.uint16)
        self.wide = len(letters) + 1

    def needed(self, m: int, base: float) -> np.ndarray:
        """Pairs of neighbours of a needle that a window must hold to be above ``base``, by place of the window, then text.

        The common subsequence must have at least n letters. Each of the needle's letters that is not in it breaks two
        pairs of its neighbours, and each of the window's other letters one; 255 where n letters are not there.
        """
        start = np.arange(self.codes.shape[1] - 2 * self.margin + m - 1)
        return self._needed(m, base, self.both(m, np.arange(len(self.lengths))[None, :], start[:, None]))

    @staticmethod
    def _needed(m: int, base: float, both: np.ndarray) -> np.ndarray:
        n = np.floor((base / 200.0 - 1e-6) * both).astype(np.int32) + 1
        return np.where(n > both - m, 255, np.maximum(3 * n - both - 1, 0)).astype(np.uint8)

    def both(self, m: int, rows: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Letters of needle and window together, for each window; windows outside a text have none of its letters."""
        start = spots - (m - 1)
        return m + np.maximum(np.minimum(start + m, self.lengths[rows]) - np.maximum(start, 0), 0)

    def pieces(self, size: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the texts that begin every ``size`` letters: their rows, places, and ``length`` letters of each."""
        n = -(-self.lengths // size)
        rows = np.repeat(np.arange(len(n)), n)
        places = (np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)) * size
        return rows, places, self.letters_at(rows, places, length)

    def letters_at(self, rows: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        """By letter, then piece. Letters past the end of the row may belong to others; they never lower a bound."""
        at = rows * self.codes.shape[1] + self.margin + places
        return np.take(self.codes.ravel(), at[None, :] + np.arange(length)[:, None], mode="clip").astype(np.intp)

    def best(self, own: np.ndarray, above: np.ndarray, base: float, rows: np.ndarray, spots: np.ndarray) -> np.ndarray:
        """Best indel ratio of a needle (numbers of its letters) with windows of each text (their rows and places from
        the first that touches the text), also the shorter ones at both ends. What cannot be ``above`` the given value
        of its text, at least ``base``, is left out; a text without others gets 0.

        The bound: pairs of neighbours (``needed``).
        """
        m, wide = len(own), self.wide
        out = np.zeros(len(self.lengths))
        known = np.zeros(wide * wide, np.uint8)
        known[own[:-1] * wide + own[1:]] = 1
        full = np.uint64((1 << m) - 1)
        table = np.zeros(wide, np.uint64)
        for k, c in enumerate(own):
            table[c] |= np.uint64(1 << k)
        for a in range(0, len(rows), 1 << 14):
            i, j = rows[a : a + (1 << 14)], spots[a : a + (1 << 14)]
            ok = self.lengths[i] >= m
            i, j = i[ok], j[ok]
            both, letters = self.both(m, i, j), self.letters_at(i, j - (m - 1), m)
            held = known[letters[:-1] * wide + letters[1:]].sum(axis=0)
            ok = (held >= self._needed(m, base, both)) & ((m > above[i] / 200.0 * both - 1e-6 * both))
            i, both, letters = i[ok], both[ok], letters[:, ok]
            s = np.full(len(i), full, np.uint64)
            for row in letters:
                u = s & np.take(table, row)
                s = ((s + u) | (s - u)) & full
            np.maximum.at(out, i, 200.0 * (m - np.bitwise_count(s).astype(float)) / both)
        return out


def _exact_partial(text: str, needle: str, above: float) -> float:
    """Partial ratio of one pair, or 0 if it cannot be ``above`` the given value."""
    short, long = sorted((text, needle), key=len)
    if not short:
        return 100.0 if not long else 0.0
    letters = Counter(long)
    shared = sum(min(n, letters[c]) for c, n in Counter(short).items())
    if 200.0 * shared / (len(short) + shared) <= above - 1e-9:
        return 0.0
    return max(_partial_slow(short, long), _partial_slow(long, short) if len(short) == len(long) else 0.0)


class _Packed:
    """Needles side by side in machine words, a bit for each letter and one between them, for the longest common
    subsequences of all of them with pieces of texts. A window has no more letters in common with a needle than a piece
    that holds it, so only windows of pieces with enough are looked at."""

    def __init__(self, coded: list[np.ndarray], codes: int, base: float):
        self.fit = sorted((k for k, x in enumerate(coded) if 0 < len(x) <= _WORD_BITS), key=lambda k: (len(coded[k]), k))
        sizes = [len(coded[k]) for k in self.fit]
        self.size = max(8, sizes[len(sizes) // 2]) if sizes else 8
        self.words: list[tuple[np.ndarray, np.uint64, int, list[tuple[int, int, int, int, int]]]] = []
        least = lambda both: int(np.floor((base / 200.0 - 1e-6) * both)) + 1
        left = 0
        for k in self.fit:
            m = len(coded[k])
            if left < m + 1:
                self.words.append((np.zeros(codes + 1, np.uint64), np.uint64(0), 0, []))
                left = 64
            table, full, _, fields = self.words[-1]
            off = 64 - left
            for i, c in enumerate(coded[k]):
                table[c] |= np.uint64(1 << (off + i))
            edge = min((n for w in range(1, m) if (n := least(m + w)) <= w), default=m + 1)
            self.words[-1] = (table, full | np.uint64(((1 << m) - 1) << off), m, [*fields, (k, off, m, least(2 * m), edge)])
            left -= m + 1

    @staticmethod
    def _rest(table: np.ndarray, full: np.uint64, letters: np.ndarray) -> np.ndarray:
        """A bit for each letter that is not in the longest common subsequence."""
        s = np.full(letters.shape[1], full)
        u, t = np.empty_like(s), np.empty_like(s)
        for row in letters:
            np.take(table, row, out=u, mode="clip")
            np.bitwise_and(s, u, out=u)
            np.add(s, u, out=t)
            np.bitwise_xor(s, u, out=s)
            np.bitwise_or(s, t, out=s)
            np.bitwise_and(s, full, out=s)
        return s

    def windows(self, block: _Block) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each needle the windows (row, place from the first that touches the text) that pieces leave."""
        if not self.words:
            return {}
        longest, size, out = self.words[-1][2], self.size, {}
        rows, places, letters = block.pieces(size, size + longest - 1)
        texts = np.arange(len(block.lengths))
        begins = block.letters_at(texts, np.zeros_like(texts), longest)
        for table, full, most, fields in self.words:
            inner = self._rest(table, full, letters[: size + most - 1])
            start = self._rest(table, full, begins[: most - 1])
            end = self._rest(table, full, block.letters_at(texts, block.lengths - (most - 1), most - 1))
            for k, off, m, need, edge in fields:
                count = lambda s: m - np.bitwise_count((s >> np.uint64(off)) & np.uint64((1 << m) - 1)).astype(int)  # noqa: B023, E731
                near = np.flatnonzero(count(inner) >= need)
                r, p = self._closer(block, table, off, m, need, rows[near], places[near])
                inside = p <= block.lengths[r] - m
                parts = [(r[inside], p[inside])]
                for side, place in ((np.flatnonzero(count(start) >= edge), lambda t: np.full(len(t), 1 - m)), (np.flatnonzero(count(end) >= edge), lambda t: block.lengths[t] - m + 1)):  # noqa: B023
                    t = np.repeat(side, m - 1)
                    parts.append((t, np.repeat(place(side), m - 1) + np.tile(np.arange(m - 1), len(side))))
                out[k] = tuple(np.concatenate(x) for x in zip(*((r, p + m - 1) for r, p in parts)))
        return out

    def _closer(self, block: _Block, table: np.ndarray, off: int, m: int, need: int, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows that begin in pieces, after looking at ever smaller parts of them."""
        size = self.size
        own, full = (table >> np.uint64(off)) & np.uint64((1 << m) - 1), np.uint64((1 << m) - 1)
        while size > 2 and len(rows):
            part = -(-size // 3)
            n = -(-size // part)
            rows, places = np.repeat(rows, n), np.repeat(places, n) + np.tile(np.arange(n) * part, len(places))
            ok = []
            for a in range(0, len(rows), 1 << 13):
                r, p = rows[a : a + (1 << 13)], places[a : a + (1 << 13)]
                ok.append(m - np.bitwise_count(self._rest(own, full, block.letters_at(r, p, part + m - 1))).astype(int) >= need)
            ok = np.concatenate(ok)
            rows, places, size = rows[ok], places[ok], part
        at = np.unique(np.repeat(rows, size) * (1 << 32) + np.repeat(places, size) + np.tile(np.arange(size), len(places)))
        return at >> 32, at & ((1 << 32) - 1)


#: Needles up to this length are compared by machine words; cells of a block of texts.
_WORD_BITS, _CELLS = 63, 400_000


def best_partial(texts: list[str], needles: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The highest partial ratio of each text from ``threshold``, and the first needle that has it; -1 if none has.

    A partial ratio is the best ratio of the shorter side with all windows of the longer; both empty count 100, one
    empty 0; of equal lengths both ways are tried.
    """
    best, which = np.full(len(texts), threshold - 1e-6), np.full(len(texts), -1)
    letters = np.unique(np.concatenate([_points(x) for x in needles if x] or [_points(" ")]))
    coded = [np.searchsorted(letters, _points(x)) for x in needles]
    margin = min(_WORD_BITS, max(map(len, needles), default=1)) - 1
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
    groups, a = [[i] for i, t in enumerate(texts) if not t], 0
    while a < len(order):
        n = 1
        while a + n < len(order) and (n + 1) * (len(texts[order[a + n]]) + 2 * margin) <= _CELLS:
            n += 1
        groups.append(order[a : a + n])
        a += n
    packed = _Packed(coded, len(letters), threshold - 1e-6)
    for g in groups:
        mine = np.array(g)
        block = _Block([texts[i] for i in g], letters, margin) if texts[g[0]] else None
        windows = packed.windows(block) if block else {}
        for k, needle in enumerate(needles):
            got = np.zeros(len(g))
            if k in windows and len(windows[k][0]):
                got = block.best(coded[k], best[mine], threshold - 1e-6, *windows[k])
            for j, i in enumerate(g):  # sorted by length: those behind are longer
                if len(texts[i]) > len(needle) and 0 < len(needle) <= _WORD_BITS:
                    break
                got[j] = max(got[j], _exact_partial(texts[i], needle, best[i]))
            higher = (got > best[mine]) & (got >= threshold)
            best[mine] = np.where(higher, got, best[mine])
            which[mine] = np.where(higher, k, which[mine])
    return best, which


def partial_ratios(texts: list[str], needle: str) -> np.ndarray:
    """Partial ratio of each text with the needle."""
    best, which = best_partial(texts, [needle], 0.0)
    return np.where(which >= 0, best, 0.0)


def _partial_slow(short: str, long: str) -> float:
    m, n = len(short), len(long)
    spans = [(max(0, k), min(n, k + m)) for k in range(1 - m, n)]
    return max(ratio(short, long[a:b]) for a, b in spans)


def token_set_ratio(a: str, b: str) -> float:
    """Ratio of token sets: 100 if one contains the other, else the best of three comparisons; 0 if either is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    da, db, shared = " ".join(only_a), " ".join(only_b), " ".join(both)
    n = len(shared)
    gap = int(n > 0)
    la, lb = n + gap + len(da), n + gap + len(db)
    best = 200.0 * (n + gap + lcs(da, db)) / (la + lb) if la + lb else 0.0
    if n:
        best = max(best, 200.0 * n / (n + la), 200.0 * n / (n + lb))
    return best


class Terms:
    """Patterns laid out for token-set ratios from ``cutoff`` with many texts: by their tokens, and by their spelling.

    Exact. Of shared tokens: those that text and pattern share hold a share of the letters of one of them, ``need``. If
    it is the pattern's, its two rarest shared tokens are two of its tokens which that share allows to be the rarest, so
    texts meet patterns by pairs of tokens; if it is the text's, by one such token, and each pair is counted out.

    Of spelling: whole token sets that reach the cutoff are at most (1 - cutoff) of their letters apart in single
    insertions and deletions. So letters that one side has more of than the other are few: first those letters of which
    patterns have more than texts, then each letter as often as it stands there, for the most that any text of a small
    cluster of like texts has and then for each text, then letter pairs, of which one insertion or deletion changes
    three at most, in whatever order the tokens stand. What is left is compared.
    """

    #: Bits for letters and letter pairs; texts of a cluster; clusters and patterns of one comparison; cells of a table of
    #: texts by tokens, candidates at once.
    LETTERS, PAIRS, CLUSTER, SIDE, WIDE, CELLS, AT_ONCE = 256, 512, 4, 64, 4096, 1 << 24, 1 << 20
    #: Letters that are told apart, the most frequent ones; known tokens of a text from which it meets patterns by one token.
    ALPHABET, MANY = 64, 512

    def __init__(self, patterns: list[str], cutoff: float):
        self.patterns, self.cutoff = patterns, cutoff
        self.share, self.apart = cutoff / (200 - cutoff), 1 - cutoff / 100
        sets = [set(p.split()) for p in patterns]
        times = Counter(w for s in sets for w in s)
        self.ids = {w: i for i, (_, w) in enumerate(sorted((n, w) for w, n in times.items()))}  # the rarest first
        self.weights = np.array([len(w) + 1 for w in self.ids] or [0])
        self.sizes = np.array([len(s) for s in sets], int)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.array([i for s in sets for i in sorted(self.ids[w] for w in s)], int)
        held = np.concatenate([[0], np.cumsum(self.weights[self.tokens])]) if len(self.tokens) else np.zeros(1, int)
        self.lengths = held[self.starts[1:]] - held[self.starts[:-1]] - 1
        of = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.tokens, kind="stable")
        self.of_token, self.token_starts = of[order], np.searchsorted(self.tokens[order], np.arange(len(self.ids) + 1))
        self._pair_keys()
        joined = [" ".join(s) for s in sets]
        self.letters = sorted(c for c, _ in Counter("".join(joined)).most_common(self.ALPHABET))
        self.counts = _in_parts(self._letter_counts, joined)
        self.placed = False

    def _need(self, lengths: np.ndarray) -> np.ndarray:
        """Letters, with one blank for each token, that shared tokens hold at least."""
        return self.share * lengths + 1 - 1e-6

    def _pair_keys(self) -> None:
        """Of each pattern the tokens that may be the rarest two of those shared; one token twice if it is enough."""
        keys, owners, wide = [], [], len(self.ids)
        for k in np.unique(self.sizes[self.sizes > 0]):
            rows = np.flatnonzero(self.sizes == k)
            tokens = self.tokens[self.starts[rows][:, None] + np.arange(k)]
            weights, need = self.weights[tokens], self._need(self.lengths[rows])
            rest = np.cumsum(weights[:, ::-1], axis=1)[:, ::-1]
            for i in range(k):
                if not (rest[:, i] >= need).any():
                    break
                for j in range(i, k):
                    ok = weights[:, i] + (rest[:, j] if j > i else 0) >= need
                    if j > i and not ok.any():
                        break
                    keys.append(tokens[ok, i] * wide + tokens[ok, j])
                    owners.append(rows[ok])
        keys = np.concatenate(keys or [np.zeros(0, int)])
        order = np.argsort(keys, kind="stable")
        self.keys, starts = np.unique(keys[order], return_index=True)
        self.key_owners = np.concatenate(owners or [np.zeros(0, int)])[order]
        self.key_starts = np.append(starts, len(keys))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._mixed(self.keys)] = True

    @staticmethod
    def _mixed(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def _letter_counts(self, joined: list[str]) -> np.ndarray:
        """How often each letter of the patterns stands in each text, 255 at most."""
        known = np.array([ord(c) for c in self.letters] or [0], np.uint32)  # sorted
        points, rows = _points("".join(joined)), np.repeat(np.arange(len(joined)), [len(x) for x in joined])
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        ok = known[at] == points
        return np.minimum(np.bincount(rows[ok] * len(known) + at[ok], minlength=len(joined) * len(known)), 255).reshape(len(joined), len(known)).astype(np.uint8)

    # --- tokens in common

    def shared(self, sets: list[set[str]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, pattern, ratio) in parts: the best pattern of each text and part, by the tokens that they share."""
        step = max(16, self.CELLS // max(1, len(self.ids)))
        return [x for a in range(0, len(sets), step) for x in self._shared(sets[a : a + step], a)]

    def _shared(self, sets: list[set[str]], first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, wide = self.ids, len(self.ids)
        listed = [sorted(ids[w] for w in s if w in ids) for s in sets]
        kinds, lengths = np.array([len(s) for s in sets]), np.array([sum(map(len, s)) + len(s) - 1 for s in sets])
        known = np.array([len(x) for x in listed])
        has = np.zeros((len(sets), wide), bool)
        for r, x in enumerate(listed):
            has[r, x] = True
        for k in np.unique(known[known > 0]):
            rows = np.flatnonzero(known == k)
            step = max(1, self.AT_ONCE // (k * k))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                tokens = np.array([listed[r] for r in part])
                if k <= self.MANY:
                    i, j = np.triu_indices(k)
                    keys = tokens[:, i] * wide + tokens[:, j]
                    r, c = np.nonzero(self.maybe[self._mixed(keys)])
                    keys = keys[r, c]
                    at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                    ok = self.keys[at] == keys
                    yield from self._met(part[r[ok]], self.key_starts[at[ok]], self.key_starts[at[ok] + 1], self.key_owners, has, kinds, lengths, first)
                    rest = np.cumsum(self.weights[tokens][:, ::-1], axis=1)[:, ::-1]
                    r, c = np.nonzero(rest >= self._need(lengths[part])[:, None])
                else:
                    r, c = np.nonzero(np.ones(tokens.shape, bool))
                yield from self._met(part[r], self.token_starts[tokens[r, c]], self.token_starts[tokens[r, c] + 1], self.of_token, has, kinds, lengths, first)

    def _met(self, rows: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, has: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts with all patterns between their starts and ends, a bounded number at once."""
        total = np.cumsum(ends - starts)
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + self.AT_ONCE, "right")))
            own, spot = _expand(rows[a:b], starts[a:b], ends[a:b])
            if len(own):
                t, p, v = _best_of(*self._counted(own, owners[spot], has, kinds, lengths))
                if len(t):
                    yield t + first, p, v
            a = b

    def _counted(self, t: np.ndarray, p: np.ndarray, has: np.ndarray, kinds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, spot = _expand(np.arange(len(t)), self.starts[p], self.starts[p + 1])
        token = self.tokens[spot]
        hit = has[t[own], token]
        begins = np.concatenate([[0], np.cumsum(self.sizes[p])[:-1]])
        times, n = np.add.reduceat(hit.astype(int), begins), np.add.reduceat(hit * self.weights[token], begins) - 1
        whole = (times > 0) & ((times == kinds[t]) | (times == self.sizes[p]))
        v = np.where(whole, 100.0, 200.0 * n / np.maximum(n + np.minimum(lengths[t], self.lengths[p]), 1))
        keep = (times > 0) & (v >= self.cutoff)
        return t[keep], p[keep], v[keep]

    # --- like spelling

    def _place(self, counts: np.ndarray) -> None:
        """Order the patterns and choose the letters that are looked at first, by what the first texts are like."""
        more = self.counts.mean(axis=0) / max(1, self.lengths.mean()) > counts.mean(axis=0) / max(1, counts.sum(axis=1).mean())
        self.more = more
        lean = self.counts[:, more].sum(axis=1, dtype=np.int64)
        order = np.lexsort((lean, self.lengths))
        self.order, self.lean = order[self.lengths[order] > 0], lean
        most = self.counts.max(axis=0)
        spots = [(c, k) for c in range(len(most)) for k in range(1, most[c] + 1)]
        worth = [-(self.counts[:, c] >= k).mean() * (counts[:, c] < k).mean() for c, k in spots]
        self.spots = [spots[i] for i in np.argsort(worth, kind="stable")]
        self.bits = self._letter_bits(self.counts)
        s = self.order
        self.s_len, self.s_lean, self.s_bits = self.lengths[s], self.lean[s], [np.ascontiguousarray(self.bits[s, w]) for w in range(self.bits.shape[1])]
        self.s_spans = {int(n): (int(a), int(b)) for n, a, b in zip(*(lambda u: (u, np.searchsorted(self.s_len, u), np.searchsorted(self.s_len, u, "right")))(np.unique(self.s_len)))}
        self.placed = True

    def _letter_bits(self, counts: np.ndarray) -> np.ndarray:
        """A bit for each occurrence of a letter, by worth; the least worthy ones share bits."""
        out = np.zeros((len(counts), self.LETTERS), bool)
        for i, (c, k) in enumerate(self.spots):
            at = i if i < self.LETTERS else self.LETTERS - 1 - i % 64
            out[:, at] |= counts[:, c] >= k
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    def alike(self, sets: list[set[str]]) -> list[tuple[int, int, float]]:
        """(text, pattern, ratio) of all pairs that reach the cutoff by the comparison of whole token sets."""
        if not len(self.tokens) or not sets:
            return []
        joined = [" ".join(s) for s in sets]
        lengths = np.array([len(x) for x in joined])
        low, high = (1 - self.apart) / (1 + self.apart), (1 + self.apart) / (1 - self.apart)
        fit = np.flatnonzero((lengths > 0) & (lengths * low <= self.lengths.max() + 1e-6))
        if not len(fit):
            return []
        joined, lengths = [joined[i] for i in fit], lengths[fit]
        counts = self._letter_counts(joined)
        if not self.placed:
            self._place(counts)
        lean, bits = counts[:, self.more].sum(axis=1, dtype=np.int64), self._letter_bits(counts)
        order, starts = _clusters(np.column_stack([counts, np.minimum(lengths, 255).astype(np.uint8)]), self.CLUSTER)
        most = np.maximum.reduceat(lean[order], starts)
        least, longest = np.minimum.reduceat(lengths[order], starts), np.maximum.reduceat(lengths[order], starts)
        lacks = ~np.bitwise_or.reduceat(bits[order], starts, axis=0)
        starts = np.append(starts, len(order))
        rows, out = np.lexsort((most, least)), []
        for same in np.split(rows, np.flatnonzero(np.diff(least[rows])) + 1):
            for a in range(0, len(same), self.SIDE):
                i = same[a : a + self.SIDE]
                la = int(least[i[0]])
                spans, missing = [], []
                for lb in range(int(np.ceil(la * low - 1e-6)), int(longest[i].max() * high + 1e-6) + 1):
                    if lb in self.s_spans:
                        s, e = self.s_spans[lb]
                        may = self._may(la, lb)
                        e = s + int(np.searchsorted(self.s_lean[s:e], most[i].max() + may, "right"))
                        if may >= 0 and e > s:
                            spans.append(np.arange(s, e))
                            missing.append(np.full(e - s, may, np.uint8 if may < 256 else np.int64))
                if not spans:
                    continue
                where, may = np.concatenate(spans), np.concatenate(missing)
                for k in range(0, len(where), self.WIDE):
                    c, y = self._left(lacks, i, where[k : k + self.WIDE], may[k : k + self.WIDE])
                    at, place = _expand(np.arange(len(c)), starts[c], starts[c + 1])
                    for t, p in zip(*self._near(joined, lengths, order[place], y[at], bits)):
                        got = token_set_ratio(joined[t], self.patterns[p])
                        if got >= self.cutoff:
                            out.append((int(fit[t]), int(p), got))
        return out

    def _may(self, la, lb):  # noqa: ANN001, ANN202
        """Letters of a pattern of ``lb`` letters that a text of ``la`` or more may lack."""
        return np.floor((self.apart * (la + lb) - la + lb) / 2 + 1e-6).astype(np.int64)

    def _left(self, lacks: np.ndarray, i: np.ndarray, where: np.ndarray, may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Clusters ``i`` and places of patterns of which no text of the cluster lacks too many letters."""
        lack = np.bitwise_count(lacks[i, 0][:, None] & self.s_bits[0][where])
        lack += np.bitwise_count(lacks[i, 1][:, None] & self.s_bits[1][where])
        at = np.flatnonzero((lack <= may).ravel())
        x, y = np.divmod(at, len(where))
        lack, may = lack.ravel()[at].astype(np.int64), may[y].astype(np.int64)
        x, y = i[x], where[y]
        for w in range(2, lacks.shape[1]):
            lack += np.bitwise_count(lacks[x, w] & self.s_bits[w][y])
            ok = lack <= may
            x, y, may, lack = x[ok], y[ok], may[ok], lack[ok]
        return x, y

    def _near(self, joined: list[str], lengths: np.ndarray, x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts ``x`` and patterns in the places ``y`` that their own letters and letter pairs leave."""
        may = self._may(lengths[x], self.s_len[y])
        lack = np.zeros(len(x), np.int64)
        for w in range(bits.shape[1]):
            lack += np.bitwise_count(~bits[x, w] & self.s_bits[w][y])
            ok = lack <= may
            x, y, may, lack = x[ok], y[ok], may[ok], lack[ok]
        if not len(x):
            return x, y
        la, lb, y = lengths[x], self.s_len[y], self.order[y]
        pa = _pair_bits([joined[k] for k in x], self.PAIRS)
        pb = _pair_bits([" ".join(set(self.patterns[k].split())) for k in y], self.PAIRS)
        most = 3 * self.apart * (la + lb)
        ok = np.bitwise_count(pb & ~pa).sum(axis=1, dtype=np.int64) <= (most - la + lb) / 2 + 1e-3
        ok &= np.bitwise_count(pa & ~pb).sum(axis=1, dtype=np.int64) <= (most + la - lb) / 2 + 1e-3
        return x[ok], y[ok]

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, ratio): the pattern with the highest ratio of each text, the first of equals."""
        sets = [set(x.split()) for x in texts]
        spelt = self.alike(sets)
        parts = [*self.shared(sets), *([tuple(map(np.array, zip(*spelt)))] if spelt else [])]
        return _best_of(*(np.concatenate(x) for x in zip(*parts))) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def alike_pairs(texts: list[str], patterns: list[str], cutoff: float) -> list[tuple[int, int, float]]:
    """(text, pattern, token-set ratio) of all pairs that reach ``cutoff`` by the comparison of whole token sets."""
    return Terms(patterns, cutoff).alike([set(x.split()) for x in texts])


def _best_of(t: np.ndarray, p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The highest ratio of each text, the first pattern of equals."""
    order = np.lexsort((p, -v, t))
    order = order[np.append(True, t[order][1:] != t[order][:-1])[: len(order)]]
    return t[order], p[order], v[order]


def _clusters(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which like ones stand together, and where clusters of at most ``size`` rows begin: parts
    are halved by the column that differs most in them."""
    left, order = [np.arange(len(counts))], []
    while left:
        i = left.pop()
        if len(i) <= size:
            order.append(i)
            continue
        by = counts[i, counts[i[:: max(1, len(i) // 256)]].astype(np.float32).var(axis=0).argmax()]
        half = np.argpartition(by, len(i) // 2)
        left += [i[half[: len(i) // 2]], i[half[len(i) // 2 :]]]
    return np.concatenate(order), np.cumsum([0, *map(len, order[:-1])])


def _in_parts(of: Callable[[list[str]], np.ndarray], rows: list[str], size: int = 10_000) -> np.ndarray:
    return np.concatenate([of(rows[a : a + size]) for a in range(0, max(1, len(rows)), size)])


def _expand(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every place from its start to before its end, and the places."""
    n = ends - starts
    total = int(n.sum())
    return np.repeat(rows, n), np.arange(total) - np.repeat(np.cumsum(n) - n - starts, n)


def _pair_bits(joined: list[str], bits: int) -> np.ndarray:
    """Bits of the letter pairs of each joined token set (blanks around tokens); a pair's second place is another pair."""
    sides = [f" {x} " for x in joined]
    points = _points("".join(sides)).astype(np.uint64)
    row = np.repeat(np.arange(len(sides)), [len(x) for x in sides])
    inside = row[:-1] == row[1:]
    both = np.sort(((row[:-1].astype(np.uint64) << np.uint64(42)) | (points[:-1] << np.uint64(21)) | points[1:])[inside])  # fewer than 2 ** 22 sides
    row, gram = (both >> np.uint64(42)).astype(np.int64), both & np.uint64((1 << 42) - 1)
    at = np.arange(len(both))
    first = np.append(True, both[1:] != both[:-1])[: len(both)]
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    mixed = (gram + again.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(sides), bits), bool)
    out[row, (mixed >> np.uint64(40)).astype(np.int64) % bits] = True
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; norms of at least 1e-9; null if the lengths differ or either is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(1e-9))
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b)))
