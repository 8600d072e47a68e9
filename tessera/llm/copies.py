"""Duplicates hidden by formatting differences: Merkle-style hashing of nested records, from the leaves up.

A text is an unordered node of fields (set apart by comma, semicolon, slash or bar); a field is a leaf, normalised
by dropping white space, case and punctuation. Records may nest: a struct is an unordered node of its named fields,
an array or a map one of its elements. Leaves are hashed, child digests sorted, and their hash is the digest of the
node. Rows are grouped by root digest, and within it by the full sorted structure, so that a collision of digests can
never join different records.

Defined results: null texts take no part; texts without any letter or digit are copies of each other; a comma or
full stop between two digits stays in the number; repeated ids come out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import attach, cut

_POINT, _COMMA = "\u0001", "\u0002"


def leaves(text: Column) -> Column:
    """The normalised fields of a text, blank ones left out, in their order."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"(?<=\p{Nd})\.(?=\p{Nd})", _POINT)
    t = F.regexp_replace(t, r"(?<=\p{Nd}),(?=\p{Nd})", _COMMA)
    kept = F.transform(F.split(t, r"[,;/|]"), lambda x: F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}\p{{M}}[\p{{S}}&&[^\x00-\x7f]]{_POINT}{_COMMA}]+", ""))
    return F.filter(kept, lambda x: x != "")


def node(value: Column, kind: T.DataType) -> Column:
    """Digest and full structure of a value, as a struct (d, s); null values count like blank texts."""
    made = lambda children, mark: F.struct(
        F.xxhash64(F.lit(mark), F.array_sort(F.transform(children, lambda x: x["d"]))).alias("d"),
        F.concat(F.lit(mark), F.lit("("), F.array_join(F.array_sort(F.transform(children, lambda x: x["s"])), "\u0003"), F.lit(")")).alias("s"),
    )
    if isinstance(kind, T.StructType):
        named = [F.struct(F.xxhash64(F.lit(f.name.lower()), c["d"]).alias("d"), F.concat(F.lit(f"{f.name.lower()}="), c["s"]).alias("s")) for f in kind for c in [node(value[f.name], f.dataType)]]
        return made(F.array(*named), "{")
    if isinstance(kind, T.ArrayType):
        return made(F.coalesce(F.transform(value, lambda x: node(x, kind.elementType)), F.array().cast("array<struct<d: bigint, s: string>>")), "[")
    if isinstance(kind, T.MapType):
        pair = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return node(F.map_entries(value), T.ArrayType(pair))
    parts = F.coalesce(leaves(value.cast("string")), F.array().cast("array<string>"))
    return made(F.transform(parts, lambda x: F.struct(F.xxhash64(x).alias("d"), x.alias("s"))), "")


def record_digests(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """``key`` columns, root digest and full structure of each row's ``columns``, which may nest to any depth."""
    shape = T.StructType([df.schema[c] for c in columns])
    root = df.select(*key, node(F.struct(*columns), shape).alias("_n"))
    return root.select(*key, F.col("_n.d").alias("root"), F.col("_n.s").alias("structure"))


def digests(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """``key`` columns, root digest and full structure of each row whose text is not null."""
    rows = df.filter(F.col(text).isNotNull()).select(*key, leaves(F.col(text)).alias("_leaves"))
    return rows.select(
        *key,
        F.xxhash64(F.array_sort(F.transform("_leaves", lambda x: F.xxhash64(x)))).alias("root"),
        F.array_join(F.array_sort("_leaves"), "\u0003").alias("structure"),
    )


def groups(rows: DataFrame) -> DataFrame:
    """One row per group of copies: smallest id and number of rows. Map-side sums keep hot groups small."""
    return rows.groupBy("table_name", "root", "structure").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))


def members(rows: DataFrame) -> DataFrame:
    """Each row that is not the kept one, with the id of the kept one."""
    several = cut(groups(rows).filter("n > 1"))
    out = attach(rows, several, ["table_name", "root", "structure"], "keep_id")
    return out.filter("id <> keep_id").select("table_name", "keep_id", F.col("id").alias("dup_id")).distinct()
