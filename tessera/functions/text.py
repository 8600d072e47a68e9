"""String functions of the review as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations and what they stand for, applied in this order (fixed values).
ABBREVIATIONS = [
    ("by", "biaya"),
    ("bya", "biaya"),
    ("kons", "konsumsi"),
    ("rapat koord", "rapat koordinasi"),
    ("koord", "koordinasi"),
    ("pjln", "perjalanan"),
    ("perjadin", "perjalanan dinas"),
    ("bbm", "bahan bakar minyak"),
    ("genset", "generator set"),
    ("pemel", "pemeliharaan"),
    ("inst", "instalasi"),
    ("uji", "pengujian"),
    ("gardu dist", "gardu distribusi"),
]
#: Characters of a text chunk (fixed value).
CHUNK = 900

_WORD = r"[\p{L}\p{N}_]"
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^[{_SPACE}]+|[{_SPACE}]+$", "")


def normalize(c: Column) -> Column:
    """Lower case, abbreviations written out, only word characters and %./,- kept, single spaces. Null gives ''."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    written = reduce(lambda x, ab: F.regexp_replace(x, rf"(?<!{_WORD}){ab[0]}(?!{_WORD})", ab[1]), ABBREVIATIONS, t)
    heads = "".join(sorted({short[0] for short, _ in ABBREVIATIONS}))  # most texts have no abbreviation: one look instead of one for each
    t = F.when(F.rlike(t, F.lit(rf"(?=[{heads}])(?<!{_WORD})(?:{'|'.join(short for short, _ in ABBREVIATIONS)})(?!{_WORD})")), written).otherwise(t)
    t = F.regexp_replace(t, rf"[^a-z0-9 %./,\-\p{{L}}\p{{N}}{_SPACE}]", " ")
    return F.trim(F.regexp_replace(t, rf"[{_SPACE}]{{2,}}|[{_SPACE}&&[^ ]]", " "))


def combine(columns: list[str]) -> Column:
    """The columns as one text, ' | ' between them; nulls count as blank and keep their place."""
    if not columns:
        raise ValueError("at least one text column is needed")
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def chunks(c: Column, size: int = CHUNK) -> Column:
    """Array of chunks: stripped lines are packed in order while chunk and line together have at most ``size`` characters.

    A longer line is not cut. Text of white space alone is one chunk as it is; null and empty texts give none.
    """
    lines = F.filter(F.transform(F.split(c, _LINE_END), strip), lambda x: x != "")
    none = F.array().cast("array<string>")

    def put(acc: Column, line: Column) -> Column:
        full = (F.length(acc["cur"]) + F.length(line) > size) & (acc["cur"] != "")
        joined = F.when(acc["cur"] == "", line).otherwise(F.concat(acc["cur"], F.lit(" "), line))
        return F.struct(F.when(full, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"), F.when(full, line).otherwise(joined).alias("cur"))

    packed = F.aggregate(lines, F.struct(none.alias("out"), F.lit("").alias("cur")), put, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))
    return F.when(c.isNull() | (c == ""), none).when(F.size(packed) == 0, F.array(c)).otherwise(packed)


def segments(c: Column, by: str, ends: str) -> Column:
    """Parts of a text between ``by``, without the characters ``ends`` at their ends; blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.regexp_replace(x, rf"^[{ends}]+|[{ends}]+$", "")), lambda x: x != "")


def short_item(c: Column) -> Column:
    """The last part of a text between bars, cut to 80 characters with dots; 'Item RAB' if there is none."""
    last = F.coalesce(F.try_element_at(segments(c, r"\|", _SPACE), F.lit(-1)), strip(F.coalesce(c, F.lit(""))))
    cut = F.concat(F.regexp_replace(F.substring(last, 1, 77), rf"[{_SPACE}]+$", ""), F.lit("..."))
    return F.when(F.length(last) > 80, cut).when(last == "", "Item RAB").otherwise(last)


def candidate_phrase(original: Column, norm: Column, keyword: Column) -> Column:
    """The shortest part of 4 to 90 characters (the first of equals), else the first ten words, else the keyword."""
    parts = segments(original, r"[|;\n\r]+", r"\s\-:;,.")
    fitting = F.filter(parts, lambda x: F.length(x).between(4, 90))
    placed = F.transform(fitting, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x")))
    words = F.split(norm, " ")
    return F.coalesce(F.array_min(placed)["x"], F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 10), " ")), F.trim(F.coalesce(keyword, F.lit(""))))


def safe_filename(c: Column) -> Column:
    """Letters, digits, point, underscore and hyphen kept, others one underscore; 'upload' if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(t == "", "upload").otherwise(t)


def selector(row_id: Column, text: Column) -> Column:
    """'id | first 80 characters'."""
    return F.concat(row_id.cast("string"), F.lit(" | "), F.substring(F.coalesce(text, F.lit("")), 1, 80))


def selected_id(selection: Column) -> Column:
    """The id of a selector: what stands before the first bar."""
    return F.trim(F.substring_index(F.coalesce(selection, F.lit("")), "|", 1))


def utc_now() -> Column:
    """The current second in UTC as ISO text, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
