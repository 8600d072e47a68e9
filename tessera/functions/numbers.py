"""Numbers as written in Indonesian and English style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A valid number of an imported sheet: blank, or digits with an optional Rp or Rp. before them, grouped in
#: threes throughout by one mark or not at all, with an optional decimal part after the other mark.
PLAIN_NUMBER = r"(?:Rp\.? ?)?(?:\d+(?:[.,]\d+)?|\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?)"

#: Words for powers of ten that sellers write after an amount (fixed values).
SCALES = {"rb": 1e3, "ribu": 1e3, "jt": 1e6, "juta": 1e6, "m": 1e9, "miliar": 1e9, "milyar": 1e9}


def _read(d: Column, dots: Column, commas: Column) -> Column:
    """A run of digits and marks as a double. All three are columns of the row, so none is computed again here."""
    without = lambda mark: F.replace(d, F.lit(mark), F.lit(""))
    grouped = (dots + commas > 1) | d.rlike(r"^[1-9]\d{0,2}[.,]\d{3}$")
    last_is_comma = F.length(F.substring_index(d, ".", -1)) > F.length(F.substring_index(d, ",", -1))
    plain = (
        F.when((dots > 0) & (commas > 0), F.when(last_is_comma, F.translate(d, ",.", ".")).otherwise(without(",")))
        .when(grouped, F.translate(d, ".,", ""))
        .otherwise(F.translate(d, ",", "."))
    )
    return plain.try_cast("double")


def with_numbers(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """Add a double column for each text: its first run of digits and marks, null if there is none.

    With two kinds of mark the last is the decimal mark. With one kind of mark that repeats, it groups. A single
    mark groups if exactly three digits follow and one to three (not a lone 0) precede it, else it is decimal.

    The run and its marks are columns of their own steps: each is used often, and is to be found once per row.
    """
    runs = {f"_run_{n}": F.regexp_extract(F.coalesce(t, F.lit("")), r"(\d[\d.,]*\d|\d)", 1) for n, t in texts.items()}
    count = lambda n, mark: F.length(f"_run_{n}") - F.length(F.replace(f"_run_{n}", F.lit(mark), F.lit("")))
    df = df.withColumns(runs).withColumns({f"_{m}_{n}": count(n, c) for n in texts for m, c in (("dots", "."), ("commas", ","))})
    df = df.withColumns({n: _read(F.col(f"_run_{n}"), F.col(f"_dots_{n}"), F.col(f"_commas_{n}")) for n in texts})
    return df.drop(*[f"_{m}_{n}" for n in texts for m in ("run", "dots", "commas")])
