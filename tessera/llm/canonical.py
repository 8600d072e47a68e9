"""Mapping free-entered values to a canonical list: a pigeonhole join on words, in SQL expressions only.

An entry of the list (a keyword or a synonym) is named by a text if each of its words is found in the text: in any
order, among other words, misspelt or abbreviated. Words are compared by partition: a word of the list that allows k
errors is cut into k + 1 segments, and at least one of them must stand unchanged in any misspelling, at most k places
away. So words meet by equality joins on positional substrings, and the built-in levenshtein verifies them. An
abbreviation meets its word by equality joins on first letters. Entries also count with neighbouring words written
as one. Of several entries the one with most letters, then with the fewest
errors, counts; what meets none is reported by an anti-join.

Texts are compared once per distinct text, and words once per distinct word.

Defined results: null and blank texts are unmatched; an entry without letters names nothing; of entries with equal
rank the smallest target id counts.
"""

from __future__ import annotations

from functools import reduce

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.copies import digests, groups
from tessera.llm.lookalikes import FORM, LOOK, NOTHING, SPACE, tables
from tessera.session import attach, cut

#: Errors that all words of an entry may have together: as many, or one more than it has words.
TOGETHER = 4
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def latin(text: Column) -> Column:
    """Text with Latin letters in place of other forms and look-alikes, and without marks and what renders as nothing.

    SQL only: one translate() over the tables of the look-alikes, and a replacement of the ligatures.
    """
    t = tables()
    single = np.flatnonzero(np.isin(t["kind"], (SPACE, FORM, LOOK)) & (t["length"] == 1))
    gone = np.flatnonzero(t["kind"] == NOTHING)
    made = "".join(map(chr, t["flat"][t["start"][single]]))
    out = F.translate(text, "".join(map(chr, [*single, *gone])), made)
    for c in map(chr, range(0xFB00, 0xFB07)):
        out = F.replace(out, F.lit(c), F.lit(unicodedata.normalize("NFKC", c)))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(out, r"\p{M}+", "")).otherwise(text)


def plain(text: Column) -> Column:
    """Lower-case words of letters and digits, one space apart."""
    t = F.translate(F.lower(latin(text)), *_ACCENTS)
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def errors(size: Column) -> Column:
    """How many errors a word of a length may have."""
    return F.when(size <= 2, 0).when(size <= 3, 1).when(size <= 6, 2).otherwise(3)


def entries(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(entry_id, target_id, words, solid) of (id, term) keywords and (id, keyword_id, term) synonyms.

    The target is the smallest id of the copies of the keyword. Copies of an entry count once, by the form with most
    words; synonyms of no keyword name nothing.
    """
    keys = keywords.select(F.lit("k").alias("table_name"), "id", "term")
    shape = digests(keys, "term", ["table_name", "id"])
    to = shape.join(groups(shape), ["table_name", "root", "structure"]).select(F.col("id").alias("keyword_id"), F.col("keep_id").alias("target_id"))
    named = keywords.select("term", F.col("id").alias("keyword_id")).unionByName(synonyms.select("term", "keyword_id")).join(to, "keyword_id")
    words = F.split(plain(F.col("term")), " ")
    solid = F.replace(plain(F.col("term")), F.lit(" "), F.lit(""))
    one = named.filter(F.length(solid) > 0).select("target_id", words.alias("words"), solid.alias("solid"))
    return one.groupBy("solid").agg(F.min("target_id").alias("target_id"), F.max_by("words", F.struct(F.size("words"), F.array_join("words", " "))).alias("words")).withColumn("entry_id", F.xxhash64("solid"))


def reformed(word: Column) -> Column:
    """A word in today's Indonesian spelling, if it was written in the spelling before 1972 (oe, tj, dj, nj, sj, ch)."""
    pairs = [("oe", "u"), ("tj", "c"), ("dj", "j"), ("nj", "ny"), ("sj", "sy"), ("ch", "kh")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, word)


def misspelt(known: DataFrame, typed: DataFrame) -> DataFrame:
    """(word, form, off): known words and typed forms that differ by no more errors than the word allows.

    If i segments stand before the unchanged one, at most i errors lie before it and k - i behind it: this bounds how
    far the segment can have moved, given the difference in length.
    """
    k = known.withColumn("size", F.length("word")).withColumn("k", errors(F.col("size")))
    begin = F.floor(F.col("i") * F.col("size") / (F.col("k") + 1)).cast("int")
    end = F.floor((F.col("i") + 1) * F.col("size") / (F.col("k") + 1)).cast("int")
    cuts = k.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    cuts = cuts.select("word", "size", "k", "i", F.substring("word", begin + 1, end - begin).alias("piece"))
    t = typed.withColumn("have", F.length("form")).filter("have > 0")
    t = t.withColumn("size", F.explode(F.sequence(F.greatest(F.lit(1), F.col("have") - 3), F.col("have") + 3))).withColumn("k", errors(F.col("size")))
    t = t.filter(F.abs(F.col("have") - F.col("size")) <= F.col("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    longer = F.col("have") - F.col("size")
    lowest, highest = F.greatest(-F.col("i"), longer - F.col("k") + F.col("i")), F.least(F.col("i"), longer + F.col("k") - F.col("i"))
    t = t.filter(lowest <= highest).withColumn("shift", F.explode(F.sequence(lowest, highest))).withColumn("at", begin + F.col("shift"))
    t = t.filter((F.col("at") >= 0) & (F.col("at") + end - begin <= F.col("have")))
    t = t.select("form", "size", "k", "i", F.substring("form", F.col("at") + 1, end - begin).alias("piece"))
    met = cuts.join(t, ["size", "k", "i", "piece"]).select("word", "form", F.levenshtein("word", "form").alias("off"), "k")
    return met.filter("off <= k").select("word", "form", "off").distinct()


def abbreviated(known: DataFrame, typed: DataFrame) -> DataFrame:
    """(word, form, off): a word's first letters, its consonants, or a form without vowels whose letters come in the word in order."""
    long = known.withColumn("size", F.length("word")).filter("size >= 4")
    head = long.withColumn("cut", F.explode(F.sequence(F.lit(3), F.greatest(F.lit(3), F.col("size") - 2))))
    head = head.select("word", F.substring("word", F.lit(1), F.col("cut")).alias("form")).join(typed, "form").select("word", "form")
    bones = lambda c: F.regexp_replace(c, "[aeiou]", "")
    framed = typed.filter(F.length(bones(F.col("form"))) >= 2).select("form", bones(F.col("form")).alias("bones"), F.substring("form", 1, 1).alias("first"))
    frame = long.select("word", bones(F.col("word")).alias("bones"), F.substring("word", 1, 1).alias("first"))
    equal = frame.join(framed, ["bones", "first"]).select("word", "form")
    bare = framed.filter(~F.col("form").rlike("^.+[aeiou]|[0-9]") & (F.length("form") >= 3)).withColumn("key", F.substring("form", 1, 3))
    inside = F.rlike("word", F.concat(F.lit("^"), F.regexp_replace("form", "(.)", "$1.*")))
    # The first letter with any two later ones in their order: the form's first three letters are one of these.
    later = lambda i: F.transform(F.sequence(i + 1, F.col("size")), lambda j: F.concat(F.substring("word", F.lit(1), F.lit(1)), F.substring("word", i, F.lit(1)), F.substring("word", j, F.lit(1))))
    keys = long.select("word", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), later)))).alias("key"))
    part = keys.join(bare, "key").filter(inside).select("word", "form")
    return head.unionByName(equal).unionByName(part).distinct().withColumn("off", F.lit(1))


def similar(known: DataFrame, single_words: DataFrame, typed: DataFrame) -> DataFrame:
    """(word, token, off) for distinct known ``word`` and distinct typed ``token``.

    ``single_words`` are the known words that may be abbreviated (not several words written as one).
    A token counts as it stands, in today's spelling, and, if it is short, with two neighbouring letters swapped.
    """
    swap = lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.lit(1)), F.substring("token", i, F.lit(1)), F.substring("token", i + 2, F.lit(99)))
    forms = typed.select("token", F.explode(F.array_distinct(F.array("token", reformed(F.col("token"))))).alias("form"))
    forms = cut(forms)
    single = forms.select("form").distinct()
    longest = known.agg(F.max(F.length("word"))).first()[0] or 0
    met = misspelt(known, single.filter(F.length("form") <= longest + 3)).unionByName(abbreviated(single_words, single)).join(forms, "form").select("word", "token", "off")
    short = typed.filter(F.length("token").between(3, 4)).select("token", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), swap)).alias("word"))
    met = met.unionByName(short.join(known, "word").select("word", "token", F.lit(1).alias("off")))
    return met.groupBy("word", "token").agg(F.min("off").alias("off"))


def variants(listed: DataFrame) -> DataFrame:
    """(entry_id, form_id, word, need): the words of each entry, also with neighbouring words written as one."""
    joined = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: i + 1 < F.size("words")),
        lambda i: F.concat(F.slice("words", 1, i), F.array(F.concat(F.element_at("words", i + 1), F.element_at("words", i + 2))), F.slice("words", i + 3, F.size("words"))),
    )
    every = F.array_distinct(F.concat(F.array(F.col("words")), joined, F.array(F.array("solid"))))
    each = listed.select("entry_id", F.posexplode(every).alias("form_id", "parts")).withColumn("parts", F.array_distinct("parts"))
    return each.select("entry_id", "form_id", F.explode("parts").alias("word"), F.size("parts").alias("need"))


def name(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(row_id, target_id) of rows (row_id, text); target_id is null where the text names no entry."""
    rows = cut(rows.select("row_id", plain(F.coalesce("text", F.lit(""))).alias("plain")))
    listed = cut(listed)
    texts = cut(rows.groupBy("plain").agg(F.count("*").alias("n")))
    words = F.split("plain", " ")
    pairs = F.zip_with(words, F.slice(words, 2, 999_999), lambda a, b: F.concat(a, b))
    tokens = texts.select("plain", F.explode(F.array_distinct(words)).alias("token")).filter("token <> ''")
    parts = cut(variants(listed))
    vocabulary = parts.select("word").distinct()
    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("n")))
    meant = similar(vocabulary, listed.select(F.explode("words").alias("word")).distinct(), counts.select("token"))
    meant = meant.groupBy("token").agg(F.collect_list(F.struct("word", "off")).alias("m")).join(counts, "token")
    met = attach(tokens, cut(meant), ["token"], "m").select("plain", "token", F.explode("m").alias("m")).select("plain", "token", "m.word", "m.off")
    # Words written apart: two neighbours that make up a listed word exactly.
    apart = texts.select("plain", F.explode(F.array_distinct(pairs)).alias("token")).filter("token is not null")
    apart = apart.join(vocabulary, F.col("token") == F.col("word")).select("token", "plain", "word", F.lit(0).alias("off"))
    hits = met.select("token", "plain", "word", "off").unionByName(apart).join(parts, "word")
    best_word = hits.groupBy("plain", "entry_id", "form_id", "need", "word").agg(F.min(F.struct("off", "token")).alias("m"))
    full = best_word.groupBy("plain", "entry_id", "form_id", "need").agg(F.count("*").alias("words"), F.count_distinct("m.token").alias("tokens"), F.sum("m.off").alias("off"))
    full = full.filter(f"words = need and tokens = need and off <= greatest({TOGETHER}, need + 1)").join(listed.select("entry_id", "target_id", F.length("solid").alias("letters")), "entry_id")
    best = full.groupBy("plain").agg(F.min(F.struct(F.col("off") - F.col("letters"), "off", "target_id")).alias("b")).select("plain", "b.target_id")
    best = cut(best.join(texts, "plain"))
    found = attach(rows, best, ["plain"], "target_id").select("row_id", "target_id")
    return found.unionByName(rows.join(best.select("plain"), "plain", "left_anti").select("row_id", F.lit(None).cast("long").alias("target_id")))
