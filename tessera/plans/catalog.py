"""All queries of the core by name, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import core_p, review

QUERIES = {**review.QUERIES, **core_p.QUERIES}
SQL = {**review.SQL, **core_p.SQL}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the whole review of all items."""
    return QUERIES["review"](spark, sf_dir)
