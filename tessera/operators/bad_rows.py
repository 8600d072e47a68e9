"""Rows that fail to parse: load the valid rows of imported sheets, keep the others apart with a reason.

Every file has its own header (line 1: columns and delimiter). Headers are attached to their lines around hot files, so
a file with a third of all lines is as good as any other, and lines go through Python in Arrow batches. A block of
lines under one header is parsed at once by Arrow's CSV reader, which sets lines of another width aside; numbers are
checked by columnar regular expressions. A block that does not parse, as its quoting is broken, is halved until single
bad lines are left. Only lines set aside or left over are read character by character for the reason.

Defined results: null raw_text counts as an empty line; an empty line has one (blank) field; a line of a file
without header line fails with 'no_header'; header lines are neither rows nor failures; a column the header
does not name is null; repeated lines come out each for itself.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numbers import PLAIN_NUMBER, with_numbers
from tessera.session import attach, cut

#: Columns the importer knows (fixed values) and those of them that hold numbers.
COLUMNS = ["row_id", "judul_rab", "section", "item_per_rab", "volume", "unit", "unit_price", "total_price", "notes"]
NUMERIC = ["volume", "unit_price", "total_price"]
DELIMITERS = [",", ";", "|", "\t"]
#: Lines parsed together at first; doubled up to MOST after a block without failure, halved after one with.
#: Blocks of at most LEAF lines that fail are read line by line.
BLOCK, MOST, LEAF = 64, 4096, 4

_NUMBER = rf"^(?:\s*|{PLAIN_NUMBER})$"
_OUT = T.StructType([T.StructField("line_id", T.LongType()), T.StructField("reason", T.StringType())] + [T.StructField(c, T.StringType()) for c in COLUMNS])


def delimiter_of(header: str) -> str:
    """The delimiter a header uses most; a comma if it uses none."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def split_strict(line: str, delimiter: str) -> list[str] | None:
    """Fields of one line, or None if its quoting is broken."""
    fields, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, part = i + 1, []
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                part.append(line[j:k])
                if line[k + 1 : k + 2] == '"':
                    part.append('"')
                    j = k + 2
                    continue
                break
            i = k + 1
            if i < n and line[i] != delimiter:
                return None
            fields.append("".join(part))
        else:
            k = line.find(delimiter, i)
            k = n if k < 0 else k
            if '"' in line[i:k]:
                return None
            fields.append(line[i:k])
            i = k
        if i >= n:
            return fields
        i += 1


def diagnose(line: str, delimiter: str, names: list[str]) -> tuple[str | None, list[str] | None]:
    """The first reason that holds for a line, or None and its fields."""
    fields = split_strict(line, delimiter)
    if fields is None:
        return "broken_quoting", None
    if len(fields) != len(names):
        return "column_count", None
    by = dict(zip(names, fields))
    for c in NUMERIC:
        if c in by and not re.fullmatch(_NUMBER[1:-1], by[c]):
            return f"bad_{c}", None
    return None, fields


def _strict_pattern(delimiter: str) -> str:
    d = re.escape(delimiter)
    field = rf'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    return rf"\A{field}(?:{d}{field})*\z"


def _bulk(lines: pa.Array, delimiter: str, names: list[str]) -> tuple[pa.Table, list[int]] | None:
    """The lines as columns and the places of those of another width, which are not in them; None if they do not parse."""
    quoted = lines.filter(pc.match_substring(lines, '"'))
    if len(quoted) and not pc.all(pc.match_substring_regex(quoted, _strict_pattern(delimiter))).as_py():
        return None
    texts = lines.to_pylist()
    data = "\n".join(texts).encode()
    aside: list[int] = []

    def skip(row: pacsv.InvalidRow) -> str:
        aside.append(row.number - 1)
        return "skip"

    try:
        got = pacsv.read_csv(
            io.BytesIO(data),
            read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 2),
            parse_options=pacsv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=skip),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if got.num_rows + len(aside) != len(texts) or "" in texts and len(names) > 1:  # line breaks outside quotes; blank lines
        return None
    return got, aside


def _halve(ids: pa.Array, lines: pa.Array, delimiter: str, names: list[str], good: list, single: list, bad: list) -> bool:
    """Sort the lines of a block into parsed blocks, lines read singly and failures; whether the block was parsed whole."""
    if len(lines) <= LEAF:
        _one_by_one(ids, lines, delimiter, names, single, bad)
        return False
    parsed = _bulk(lines, delimiter, names) if len(names) == len(set(names)) else None
    if parsed is None:
        m = len(lines) // 2
        _halve(ids[:m], lines[:m], delimiter, names, good, single, bad)
        _halve(ids[m:], lines[m:], delimiter, names, good, single, bad)
        return False
    got, aside = parsed
    whole = np.ones(len(lines), bool)
    whole[aside] = False
    valid = np.ones(got.num_rows, bool)
    for c in NUMERIC:
        if c in names:
            valid &= pc.match_substring_regex(got[c], _NUMBER).combine_chunks().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(whole)
    rest = pa.array(np.sort(np.concatenate([np.flatnonzero(~whole), at[~valid]])))
    _one_by_one(ids.take(rest), lines.take(rest), delimiter, names, single, bad)
    if valid.any():
        good.append((ids.take(pa.array(at[valid])), got.filter(pa.array(valid)).combine_chunks()))
    return True


def _one_by_one(ids: pa.Array, lines: pa.Array, delimiter: str, names: list[str], single: list, bad: list) -> None:
    for i, line in zip(ids.to_pylist(), lines.to_pylist()):
        reason, fields = diagnose(line, delimiter, names)
        if reason:
            bad.append((i, reason))
        else:
            single.append((i, dict(zip(names[::-1], fields[::-1]))))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("line_id", pa.int64())] + [(c, pa.string()) for c in ["reason", *COLUMNS]])
    for batch in batches:
        good: list = []
        single: list = []
        bad: list = []
        headers = batch["header"].dictionary_encode()
        for k, header in enumerate(headers.dictionary.to_pylist()):
            mine = batch.filter(pc.equal(headers.indices, k))
            delimiter = delimiter_of(header)
            names = [x.strip().strip('"').lower() for x in header.split(delimiter)]
            at, step = 0, BLOCK
            while at < mine.num_rows:
                block = mine.slice(at, step)
                at += step
                whole = _halve(block["line_id"], block["raw_text"], delimiter, names, good, single, bad)
                step = min(MOST, step * 2) if whole else max(LEAF * 2, step // 2)
        bad += [(i, "no_header") for i in batch.filter(pc.is_null(batch["header"]))["line_id"].to_pylist()]
        for ids, got in good:
            blank = pa.nulls(len(ids), pa.string())
            cols = [got[c].combine_chunks() if c in got.column_names else blank for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([ids, blank, *cols], schema=schema)
        ids = pa.array([i for i, _ in [*single, *bad]], pa.int64())
        reasons = pa.array([None] * len(single) + [r for _, r in bad], pa.string())
        cols = [pa.array([v.get(c) for _, v in single] + [None] * len(bad), pa.string()) for c in COLUMNS]
        yield pa.RecordBatch.from_arrays([ids, reasons, *cols], schema=schema)


def parse_lines(raw: DataFrame) -> DataFrame:
    """One row per line that is no header: line_id, reason (null if valid) and the fields as text."""
    raw = raw.select("line_id", "source_file", "line_no", F.coalesce("raw_text", F.lit("")).alias("raw_text"))
    first = F.col("line_no") == 1
    headers = raw.groupBy("source_file").agg(F.min_by(F.when(first, F.col("raw_text")), F.when(first, F.col("line_id"))).alias("header"), F.count("*").alias("n"))
    lines = attach(raw.filter("line_no is null or line_no <> 1"), cut(headers), ["source_file"], "header", keep=True)
    return lines.select("line_id", "raw_text", "header").mapInArrow(_parse, _OUT)


def failures(raw: DataFrame) -> DataFrame:
    """(line_id, reason) of the lines that fail."""
    return parse_lines(raw).filter("reason is not null").select("line_id", "reason")


def valid_rows(raw: DataFrame) -> DataFrame:
    """The valid lines as typed rows: blank text is null, the three amounts are doubles."""
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    text = [blank(F.col(c)).alias(c) for c in COLUMNS if c not in NUMERIC]
    valid = parse_lines(raw).filter("reason is null").select("line_id", *text, *NUMERIC)
    return with_numbers(valid, {c: F.col(c) for c in NUMERIC})
