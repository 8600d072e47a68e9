"""Noise in text from scanned pages: an averaged-perceptron editor that repairs pages into paragraphs.

Two perceptrons are trained on the corpus itself, from weak labels on bounded samples (PAGES, TYPES):

* one names the lines of a page as running head, page number or body, from their position on the page, their
  likeness to the line that the file repeats, and their shape;
* one edits characters: keep, replace, delete, insert, and join for a break at a line end. Its examples are rare words
  that differ in one place from a far more frequent word, and frequent words that stay as they are.

What the editor proposes for a rare word counts if the result is a far more frequent word of the corpus. The word list
is counted over all pages by one aggregation; words rarer than one in 1 / SHARE are not in it, so it has at most
1 / SHARE words whatever the corpus. The line a file repeats is found by an aggregation per (file, line) and joined
to the pages; no file is gathered in one task.

Defined results: null and empty texts give empty paragraphs and no findings; a page that repeats another page of its
file does not make its lines a running head; doubled words keep their own hyphen.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import attach, bounded_sample, cut

#: Share of all words from which a word is in the list; pages and rare words to learn from; passes over the examples.
SHARE, PAGES, TYPES, EPOCHS = 1e-5, 3000, 6000, 4
#: How much more frequent a word must be than the one it replaces: usual, and if the rare one is in the list.
RATIO, RATIO_LISTED = 12, 60
#: Share of a file's pages on which a running head stands free at least, or stands at all (pages that begin within a sentence).
HEADED, MOSTLY = 0.2, 0.5
#: Letters from which a word may have three misread ones.
THREE = 9
#: Marks that break a word at a line end (fixed values: hyphen, soft and other hyphens, dashes, not sign, tilde, equals).
BREAKS = "-­‐‑‒–—¬~="
#: A line that can number a page: a short number with little else.
_PAGE_SHAPE = re.compile(r"^(?:[^\W\d]|[ \[\]()\-–—./|:]){0,14}[\dlIOo|]{1,4}(?:(?:[^\W\d]|[ \[\]()\-–—./|:]){1,8}[\dlIOo|]{1,4})?[ \])\-–—|]*$")
_EDGE = ".,;:()[]{}\"'“”‘’?!"
_WORD = r"[\p{L}]{3,}"


# --- learning -------------------------------------------------------------------------------------------------


class Perceptron:
    """Averaged perceptron over sparse named features."""

    def __init__(self) -> None:
        self.w: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in features:
            for label, v in self.w.get(f, {}).items():
                out[label] += v
        return out

    def best(self, features: list[str], default: str) -> str:
        s = self.scores(features)
        return max(sorted(s), key=lambda k: s[k]) if s else default

    def train(self, examples: list[tuple[list[str], str]], default: str) -> Perceptron:
        total: dict[tuple[str, str], float] = defaultdict(float)
        step = 1
        for epoch in range(EPOCHS):
            order = range(len(examples)) if epoch % 2 == 0 else range(len(examples) - 1, -1, -1)
            for k in order:
                features, gold = examples[k]
                got = self.best(features, default)
                if got != gold:
                    for f in features:
                        row = self.w.setdefault(f, {})
                        for label, d in ((gold, 1.0), (got, -1.0)):
                            row[label] = row.get(label, 0.0) + d
                            total[f, label] += step * d
                step += 1
        for (f, label), t in total.items():
            self.w[f][label] -= t / step
        return self


def character_features(word: str, i: int) -> list[str]:
    at = lambda j: word[j] if 0 <= j < len(word) else "^"
    kind = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else c
    a, b, c, d, e = at(i - 2), at(i - 1), at(i), at(i + 1), at(i + 2)
    return ["c" + c, "bc" + b + c, "cd" + c + d, "bcd" + b + c + d, "abc" + a + b + c, "cde" + c + d + e, "k" + kind(b) + kind(c) + kind(d)]


def operations(noisy: str, clean: str) -> list[str]:
    """One operation for each character of the noisy word: K, D, R and the letter, or I and the letter put behind it."""
    out = ["K"] * len(noisy)
    for tag, a, b, c, d in SequenceMatcher(None, noisy, clean, autojunk=False).get_opcodes():
        if tag == "replace":
            for j in range(a, b):
                out[j] = "R" + clean[c + j - a] if c + j - a < d else "D"
            if d - c > b - a:
                out[b - 1] = "R" + clean[c + b - a - 1 :d][:1] + clean[c + b - a : d]
        elif tag == "delete":
            for j in range(a, b):
                out[j] = "D"
        elif tag == "insert" and a > 0:
            out[a - 1] = "I" + clean[c:d]
    return out


def _becomes(c: str, operation: str) -> str:
    """What an operation makes of a character."""
    return {"K": c, "D": "", "R": operation[1:], "I": c + operation[1:]}[operation[0]]


def apply_operations(word: str, ops: list[str]) -> str:
    return "".join(map(_becomes, word, ops))


def holes(word: str, n: int) -> list[tuple[int, str]]:
    """The word with n letters taken out at each place."""
    return [(i, f"{word[:i]}\0{word[i + n:]}") for i in range(len(word) - n + 1)]


def mine(rare: dict[str, int], listed: dict[str, int]) -> list[tuple[str, str]]:
    """Rare words with the one far more frequent word that they differ from in one place."""
    one: dict[str, list[str]] = defaultdict(list)
    two: dict[str, list[str]] = defaultdict(list)
    for v in listed:
        if len(v) >= 4:
            for _, h in holes(v, 1):
                one[h].append(v)
            for _, h in holes(v, 2):
                two[h].append(v)
    pairs = []
    for w, n in rare.items():
        if len(w) < 4:
            continue
        near = {v for _, h in holes(w, 1) for v in one.get(h, ())} | {v for _, h in holes(w, 2) for v in one.get(h, ())} | {v for _, h in holes(w, 1) for v in two.get(h, ())}
        near = {v for v in near if listed[v] >= RATIO * n}
        if len(near) == 1:
            pairs.append((w, near.pop()))
    return pairs


class Editor:
    """The character perceptron with the word list."""

    def __init__(self, listed: dict[str, int], model: Perceptron):
        self.listed, self.model = listed, model
        self.known: dict[str, str | None] = {}
        self.prefixes = {w[:n] for w in listed for n in range(len(w) + 1)}
        self.most = max(listed.values(), default=0)

    def correct(self, token: str) -> str | None:
        """The word a token was misread from, or None if it may stay. Case follows the token."""
        w = token.lower()
        if w not in self.known:
            if len(self.known) > 300_000:
                self.known = {}
            self.known[w] = self._propose(w)
        out = self.known[w]
        if out is None or out == w:
            return None
        return out.capitalize() if token[:1].isupper() or not token[:1].isalpha() and token[1:2].isupper() else out

    def _propose(self, w: str) -> str | None:
        letters = sum(c.isalpha() for c in w)
        if len(w) < 3 or letters * 2 < len(w):
            return None
        own = self.listed.get(w, 0)
        if "-" in w.strip("-"):  # a doubled word: each part by itself
            parts = w.split("-")
            fixed = [self._propose(p) or p for p in parts]
            if len(parts) == 2 and parts[0] != parts[1]:
                for p, q in ((0, 1), (1, 0)):
                    if self.listed.get(parts[q], 0) and parts[q] != parts[p] and SequenceMatcher(None, parts[0], parts[1]).ratio() > 0.6 and not self.listed.get(parts[p], 0):
                        fixed[p] = parts[q]
            return "-".join(fixed) if fixed != parts else None
        least = max(RATIO, own * RATIO_LISTED)
        if least > self.most:
            return None
        # One letter, or two that stand together; letters apart only if nothing else is found; three in long words.
        found = self._reach(w, least, 2)
        close = [x for x in found if x[2] <= 1]
        best = max(close or found or (self._reach(w, least, 3) if len(w) >= THREE else []), default=None)
        return best[1] if best else None

    def _reach(self, w: str, least: int, edits: int) -> list[tuple[float, str, int]]:
        """All words of the list that up to so many operations of the model make of ``w``: (gain, word, how far the
        operations stand apart). What has been made so far must begin a word of the list, so few ways are followed."""
        sites: dict[int, list[tuple[float, str]]] = {}

        def options(i: int) -> list[tuple[float, str]]:
            if i not in sites:
                s = self.model.scores(character_features(w, i))
                sites[i] = [(v - s.get("K", 0.0), _becomes(w[i], o)) for o, v in s.items() if o != "K"]
            return sites[i]

        out = []
        open_ = [(0, "", 0.0, 0, -1, -1)]  # place, made, gain, operations, first and last place of one
        while open_:
            i, made, gain, used, first, last = open_.pop()
            if i == len(w):
                if used and self.listed.get(made, 0) >= least:
                    out.append((gain, made, last - first))
                continue
            if made + w[i] in self.prefixes:
                open_.append((i + 1, made + w[i], gain, used, first, last))
            if used < edits:
                for more, r in options(i):
                    if made + r in self.prefixes:
                        open_.append((i + 1, made + r, gain + more - (used > 0), used + 1, first if used else i, i))
        return out


# --- lines ----------------------------------------------------------------------------------------------------


def line_key(line: str) -> str:
    return " ".join(line.lower().split())


def _near(a: str, b: str) -> bool:
    """Equal but for a few misread characters."""
    if sum(x == y for x, y in zip(a[:12], b[:12])) < 6 and sum(x == y for x, y in zip(a[::-1][:12], b[::-1][:12])) < 6:
        return False
    return SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.85


def likeness(key: str, head: str | None) -> str:
    """How a line's key relates to the line that its file repeats."""
    if not head:
        return "none"
    if key == head:
        return "same"
    if len(key) >= 8 and (head.startswith(key) or head.endswith(key)):
        return "part"
    if len(key) >= 8 and _near(key, head if abs(len(key) - len(head)) <= 4 else head[: len(key)]):
        return "near"
    return "far"


def shape(line: str) -> str:
    s = re.sub(r"\d+", "9", line.strip())
    return s if len(s) <= 24 else "long"


def line_features(lines: list[str], i: int, head: str | None) -> list[str]:
    """Position from both ends of the page, likeness to the repeated line, and shape."""
    line = lines[i].strip()
    top, bottom = min(i, 2), min(len(lines) - 1 - i, 2)
    like, words = likeness(line_key(line), head), line.split()
    digits = sum(c.isdigit() for c in line)
    numbers = re.findall(r"\d+", line)
    letters = sum(c.isalpha() for c in line)
    edge = "edge" if min(top, bottom) < 2 else "inside"
    tidy = "end." if line.endswith((".", ",", ";")) else "open"
    few = f"n{min(len(numbers), 3)}l{min(letters, 16) // 4}d{max((len(x) for x in numbers), default=0) > 4}"
    return [f"like:{like}:{edge}", f"pos:{top}:{bottom}", f"shape:{shape(line)}:{edge}", f"few:{few}:{tidy}:{edge}:{len(words) <= 4}", f"words:{min(len(words), 6)}:{tidy}", f"share:{digits * 4 // max(1, len(line))}:{edge}:{tidy}"]


def weak_label(lines: list[str], i: int, head: str | None) -> str:
    """A label that is certain enough to learn from."""
    line = lines[i].strip()
    if min(i, len(lines) - 1 - i) < 2:
        if likeness(line_key(line), head) in ("same", "part", "near"):
            return "head"
        numbers = re.findall(r"\d+", line)
        if 1 <= len(numbers) <= 2 and all(len(x) <= 4 for x in numbers) and not re.search(r"\d[.,]\d|[.,;]$", line) and sum(c.isalpha() for c in line) <= 12 and len(line.split()) <= 4 and len(line) <= 24:
            return "page"
    return "body"


class Reader:
    """Repairs pages by the two perceptrons."""

    def __init__(self, editor: Editor, liner: Perceptron, joiner: Perceptron):
        self.editor, self.liner, self.joiner = editor, liner, joiner

    def label(self, lines: list[str], head: str | None) -> list[str]:
        """A name for each line. Furniture is a run of lines from an edge inwards; a head must be like the file's line."""
        n = len(lines)
        out = ["body"] * n
        for order in (range(n), range(n - 1, -1, -1)):
            for i in order:
                if out[i] == "body":
                    out[i] = self._name(lines, i, head)
                if out[i] == "body":
                    break
        return out

    def _name(self, lines: list[str], i: int, head: str | None) -> str:
        line = lines[i].strip()
        if len(line) > 24 and not head:
            return "body"
        features = line_features(lines, i, head)
        got = self.liner.best(features, "body")
        like = features[0].split(":")[1]
        if got == "head" and like in ("none", "far") or got == "page" and not (len(line) <= 24 and _PAGE_SHAPE.search(line)):
            return "head" if like in ("same", "part", "near") else "body"
        return got

    def read(self, text: str | None, head: str | None) -> tuple[str, set[str]]:
        """Paragraphs and the kinds of noise found."""
        raw = (text or "").replace("\r\n", "\n").split("\n")
        full = [k for k, x in enumerate(raw) if x.strip()]
        lines = [raw[k] for k in full]
        found: set[str] = set()
        names = self.label(lines, head)
        for x in names:
            if x != "body":
                found.add({"head": "running_head", "page": "page_number"}[x])
        body = [(k, x) for k, x, name in zip(full, lines, names) if name == "body"]
        paragraphs: list[list[str]] = []
        last = None
        held: tuple[str, str] | None = None  # the left part of a broken word and its mark
        for number, (k, line) in enumerate(body):
            tokens = line.split()
            gap = last is not None and any(not raw[j].strip() for j in range(last + 1, k)) and k - last > 1
            last = k
            if not paragraphs or gap and held is None:
                paragraphs.append([])
            out = paragraphs[-1]
            if held is not None:
                left, mark = held
                action = self.joiner.best(join_features(left, mark, tokens[0], self.editor.listed), "J")
                if action == "J":
                    found.add("hyphenation")
                    tokens[0] = left + tokens[0]
                elif action == "H":
                    tokens[0] = left + "-" + tokens[0]
                else:
                    tokens[0:0] = [left + mark]
                held = None
            end = tokens[-1]
            if len(end) > 2 and end[-1] in BREAKS and end[-2].isalpha():
                following = body[number + 1][1].split()[0] if number + 1 < len(body) else ""
                if following[:1].islower() or following[:1].isalpha() and end[:-1].isupper() or following[:1] and not following[0].isalnum() or following[:1].isdigit() and following[1:2].isalpha():
                    held = (end[:-1], end[-1])
                    tokens.pop()
            for t in tokens:
                core = t.strip(_EDGE)
                fixed = self.editor.correct(core) if core else None
                if fixed is not None:
                    found.add("misread")
                    t = t.replace(core, fixed)
                out.append(t)
        if held is not None:
            paragraphs[-1].append(held[0] + held[1])
        return "\n\n".join(" ".join(p) for p in paragraphs if p), found


def join_features(left: str, mark: str, right: str, listed: dict[str, int]) -> list[str]:
    l, r = left.lower().strip(_EDGE), right.lower().strip(_EDGE)
    tail = l.rsplit("-", 1)[-1]
    twin = "twin" if tail == r or len(tail) > 3 and len(tail) == len(r) and sum(a != b for a, b in zip(tail, r)) == 1 else "other"
    return [f"twin:{twin}", f"mark:{mark}", f"whole:{(tail + r) in listed}:{twin}", f"parts:{tail in listed}:{r in listed}:{twin}"]


# --- Spark ----------------------------------------------------------------------------------------------------


def heads(pages: DataFrame) -> DataFrame:
    """(source_file, head, free, pages): the line that most pages of a file have at an edge, in any form, if it can be a
    running head, and on how many pages it stands free: not continued by the next line in lower case or with an amount."""
    goes_on = F.col("e.next").rlike(r"^(\p{Ll}|\d[\d.,]*\s\p{Ll})") & ~F.col("e.next").rlike(r"^\D{0,10}\d{1,4}(\s*\D{1,8}\d{1,4})?$")
    # Only the two lines at each edge and the ones behind them are looked at.
    full = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    cut_ = pages.select("source_file", "page", full.alias("l")).select("source_file", "page", F.concat(F.slice("l", 1, 3), F.slice("l", F.greatest(F.lit(4), F.size("l") - 1), 2)).alias("l"), F.size("l").alias("all"))
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    cut_ = cut_.select("source_file", "page", F.transform("l", tidy).alias("l"), "all")
    at = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: (i <= 2) | (i > F.size("l") - 2))
    placed = F.transform(at, lambda i: F.struct(F.lower(F.element_at("l", i)).alias("line"), F.coalesce(F.try_element_at("l", i + 1), F.lit("")).alias("next")))
    each = cut_.filter(F.size("l") > 0).select("source_file", "page", F.explode(F.array_distinct(placed)).alias("e")).select("source_file", "page", "e.line", goes_on.alias("on"))
    each = each.filter((F.length("line") >= 8) & ~F.col("line").rlike(r"[.,;:\-–¬]$") & F.col("line").rlike(r"\p{L}+.*\s.*\p{L}") & ~F.col("line").rlike(r"^(halaman|page|hal\.?|hlm\.?)\s*\d+"))
    each = each.groupBy("source_file", "line", "page").agg(F.min("on").alias("on"))
    counted = cut(each.groupBy("source_file", "line").agg(F.count("*").alias("pages"), F.count_if(~F.col("on")).alias("free")))
    # Forms of one line: those that begin or end with the same two words, and are a part of the longest or nearly so.
    words = F.split("line", " ")
    ends = F.array(F.concat(F.lit("<"), F.array_join(F.slice(words, 1, 2), " ")), F.concat(F.lit(">"), F.array_join(F.slice(F.reverse(words), 1, 2), " ")))
    forms = counted.withColumn("key", F.explode(ends))
    longest = forms.groupBy("source_file", "key").agg(F.max(F.struct(F.length("line"), "line")).alias("l")).select("source_file", "key", F.col("l.line").alias("whole"))
    same = F.when(F.startswith("key", F.lit("<")), F.left("whole", F.length("line"))).otherwise(F.right("whole", F.length("line")))
    forms = forms.join(longest, ["source_file", "key"]).filter(F.levenshtein("line", same) <= F.length("line") / 8)
    groups = forms.groupBy("source_file", "key").agg(F.sum("free").alias("free"), F.sum("pages").alias("pages"), F.max(F.struct("free", "pages", F.length("line"), "line")).alias("b")).filter("pages > 1")
    best = groups.groupBy("source_file").agg(F.max(F.struct("free", "pages", "b")).alias("b"))
    return best.select("source_file", F.col("b.b.line").alias("head"), F.col("b.free").alias("free"), F.col("b.pages").alias("pages"))


def word_counts(pages: DataFrame) -> DataFrame:
    """Every word of the pages (runs without white space, edge marks off, lower case) with its count."""
    edge = r"[.,;:()\[\]{}\"'“”‘’?!]+"
    w = pages.select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    w = w.select(F.regexp_replace("w", f"^{edge}|{edge}$", "").alias("w")).filter((F.length("w") >= 2) & F.col("w").rlike(r"\p{L}"))
    return w.groupBy("w").agg(F.count("*").alias("n"))


def learn(pages: DataFrame) -> tuple[Editor, Perceptron, Perceptron]:
    """Train on pages (item_id, text, head): the word list from all of them, the perceptrons from bounded samples."""
    counts = cut(word_counts(pages))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(3, int(total * SHARE))
    in_list = (F.col("n") >= least) & F.col("w").rlike(r"^\p{L}+(-\p{L}+)*$")
    listed = {r.w: r.n for r in counts.filter(in_list).collect()}  # at most 1 / SHARE words
    for w in list(listed):  # parts of doubled words count as words
        for part in w.split("-")[: 2 * ("-" in w)]:
            listed[part] = max(listed.get(part, 0), listed[w])
    rare = counts.filter(~in_list & F.col("w").rlike(r"\p{L}.*\p{L}") & ~F.col("w").rlike(r"\d.*\d.*\d"))
    rare_rows = bounded_sample(rare, ["w"], TYPES).collect()
    pairs = mine({r.w: r.n for r in rare_rows}, listed)
    examples: list[tuple[list[str], str]] = []
    for noisy, clean in pairs:
        examples += [(character_features(noisy, i), o) for i, o in enumerate(operations(noisy, clean))]
    for v in sorted(listed, key=lambda x: (-listed[x], x))[: max(500, len(pairs))]:
        examples += [(character_features(v, i), "K") for i in range(len(v))]
    editor = Editor(listed, Perceptron().train(examples, "K"))
    sample = bounded_sample(pages.select("item_id", "text", "head"), ["item_id"], PAGES).collect()
    line_examples, join_examples = [], []
    for r in sample:
        lines = [x for x in (r.text or "").split("\n") if x.strip()]
        for i in {*range(min(3, len(lines))), *range(max(0, len(lines) - 3), len(lines))}:
            line_examples.append((line_features(lines, i, r.head), weak_label(lines, i, r.head)))
        for a, b in zip(lines, lines[1:]):
            left, right = a.split()[-1], b.split()[0]
            if len(left) > 2 and left[-1] in BREAKS and left[-2].isalpha() and right[:1].islower():
                f = join_features(left[:-1], left[-1], right, listed)
                join_examples.append((f, "H" if "twin:twin" in f else "J"))
    return editor, Perceptron().train(line_examples, "body"), Perceptron().train(join_examples, "J")


def pages_of(items: DataFrame) -> DataFrame:
    """Pages (item_id, source_file, page, text, description) with the repeated line of their file, from review items."""
    pages = items.select("item_id", "source_file", F.coalesce("page_or_sheet", F.lit("")).alias("page"), F.coalesce("original_text", F.lit("")).alias("text"), F.coalesce("item_description", F.lit("")).alias("description"))
    pages = pages.withColumn("source_file", F.coalesce("source_file", F.lit("")))
    files = pages.groupBy("source_file").agg(F.count("*").alias("n"), F.count_distinct("page").alias("all")).join(heads(pages), "source_file", "left")
    headed = (F.col("free") > 1) & (F.col("free") >= HEADED * F.col("all")) | (F.col("pages") > 2) & (F.col("pages") >= MOSTLY * F.col("all"))
    files = files.select("source_file", "n", F.when(headed, F.col("head")).alias("head"))
    return cut(attach(pages, files, ["source_file"], "head"))


def repair(spark: SparkSession, items: DataFrame, description: bool = True) -> DataFrame:
    """item_id, kinds (array), text and description as paragraphs, of rows that are scanned pages.

    Without ``description`` only the text is read, and the description is null.
    """
    pages = pages_of(items)
    editor, liner, joiner = learn(pages)
    model = spark.sparkContext.broadcast((editor.listed, editor.model.w, liner.w, joiner.w))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed, a, b, c = model.value
        made = []
        for w in (a, b, c):
            p = Perceptron()
            p.w = w
            made.append(p)
        reader = Reader(Editor(listed, made[0]), made[1], made[2])
        for pdf in batches:
            rows = []
            for i, text, other, head in zip(pdf["item_id"], pdf["text"], pdf["description"], pdf["head"]):
                clean, kinds = reader.read(text, head)
                rows.append((i, sorted(kinds), clean, None if not description else clean if other == text else reader.read(other, head)[0]))
            yield pd.DataFrame(rows, columns=["item_id", "kinds", "text", "description"])

    return pages.select("item_id", "text", "description", "head").mapInPandas(run, "item_id long, kinds array<string>, text string, description string")
