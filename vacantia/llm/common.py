"""What several corpus operators share: written intermediates, row keys, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import work_folder

#: The regular expression for one word between ASCII white space, as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the folder all executors share, and read back: a lost executor repeats nothing before it."""
    path = f"{work_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two non-null columns that tell rows apart: rows with the same id and the same text share a key.

    Rows that agree in both get the same result from every operator here, so one key may stand for them all.
    """
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key_id"), F.xxhash64(id_col, text_col).alias("key_hash")]


def lower_ascii(text: Column) -> Column:
    """`text` with A-Z, and nothing else, lower-cased."""
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of `edges` (two bigint columns): root is the smallest node reachable.

    Alternating large-star and small-star steps. Each is one minimum per node (combined before the shuffle) and one
    join, so the neighbours of a node never meet in one task. Every step is written to the shared folder; the number
    of steps is logarithmic in the number of nodes of a component. Self-links are allowed; without rows the result
    has none.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = written(small.where("u <> v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.union(nodes.select("root").distinct().select(F.col("root").alias("node"), "root"))


def spread(df: DataFrame, *columns: str | Column) -> DataFrame:
    """`df` dealt out by `columns` so that adaptive execution may still split or merge the pieces."""
    return df.repartition(*columns)


def with_columns_kept(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """References to `columns` that also work for names with dots or blanks."""
    return [df[f"`{c}`"] for c in columns]
