"""Session helpers: where to cut lineage, how to read tables, how to join around hot keys."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which a group counts as hot, and hot groups that are sent to the rows at most: the others
#: hold at most 1 / HOT_GROUPS of all rows each.
HOT_ROWS, HOT_GROUPS = 100_000, 2_000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-package-"), "tessera_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if not n.endswith(".pyc"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names. Only in local mode, where one machine holds all, one is made."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().isLocal():
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that later stages survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """About ``n`` rows, at most, by hash of their key: all rows are counted, and only those below a threshold of the
    hash that fits the count leave their tasks, so what is moved does not grow with the data or its partitions."""
    share = min(1.0, (n + 6 * n**0.5 + 10) / max(1, df.count()))
    place = F.xxhash64(*key)
    return df.filter(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30)) + 1).orderBy(place, *key).limit(n)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], value: str, count: str = "n", hot_rows: int = HOT_ROWS, keep: bool = False) -> DataFrame:
    """Give every row the ``value`` of its group, whatever the skew.

    ``groups`` has one row per key with its row ``count``. The largest groups, of ``hot_rows`` rows or more, are sent
    to the rows by broadcast: HOT_GROUPS of them at most, whatever the data. All others are joined by shuffle, where
    no key has more than ``hot_rows`` rows or 1 / HOT_GROUPS of all rows.
    Rows whose key is not in ``groups`` are dropped, or kept with a null value (``keep``); null keys are in no group.
    """
    hot = groups.filter(F.col(count) >= hot_rows).orderBy(F.desc(count), *keys).limit(HOT_GROUPS)
    hot = hot.select(*keys, F.col(value).alias("_hot"), F.lit(True).alias("_is_hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    warm = marked.filter(F.col("_is_hot")).drop("_is_hot").withColumnRenamed("_hot", value)
    cold = marked.filter(F.col("_is_hot").isNull()).drop("_hot", "_is_hot")
    return warm.unionByName(cold.join(groups.select(*keys, value), keys, "left" if keep else "inner"))
