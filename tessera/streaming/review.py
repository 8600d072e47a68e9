"""The stateless part of the review on a stream of items: rules are read once, each item stands for itself."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import normalize
from tessera.operators.detect import INLINE, rules
from tessera.session import cut, ship

_HIT = "kind string, keyword string"


def tag(stream: DataFrame, keywords: DataFrame, synonyms: DataFrame, inline: int = INLINE) -> DataFrame:
    """Items (streaming or not) with the kind and keyword of their first rule; null where none matches.

    Up to ``inline`` rules are one expression; more are one automaton that reads each text once, in Arrow batches.
    The rules are a dictionary that people maintain, and are read to the driver.
    """
    ruled = [tuple(r) for r in cut(rules(keywords, synonyms)).select("pattern", "kind", "keyword").orderBy("priority").collect()]
    text = normalize(F.col("original_text"))
    if not ruled:
        hit = F.lit(None).cast("struct<kind: string, keyword: string>")
    elif len(ruled) <= inline:
        hit = F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.struct(F.lit(kind).alias("kind"), F.lit(word).alias("keyword"))) for p, kind, word in ruled])
    else:
        ship(keywords.sparkSession)
        hit = _first_of(keywords.sparkSession.sparkContext.broadcast(ruled))(text)
    return stream.withColumn("_hit", hit).withColumns({"match_type": F.col("_hit.kind"), "matched_keyword": F.col("_hit.keyword")}).drop("_hit")


def _first_of(ruled):
    @F.pandas_udf(_HIT)
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        rows = ruled.value
        found = ahocorasick.Automaton()
        for k in range(len(rows) - 1, -1, -1):  # of equal patterns the first stays
            found.add_word(rows[k][0], k)
        found.make_automaton()
        for texts in batches:
            at = [min((k for _, k in found.iter(t)), default=None) for t in texts]
            yield pd.DataFrame([(None, None) if k is None else rows[k][1:] for k in at], columns=["kind", "keyword"])

    return first


def counts_by_day(tagged: DataFrame, late: str = "30 days") -> DataFrame:
    """Matches per day and kind of the upload time, kept open for late items."""
    return tagged.withWatermark("uploaded_at", late).groupBy(F.window("uploaded_at", "1 day").alias("day"), "match_type").agg(F.count("*").alias("n"))
