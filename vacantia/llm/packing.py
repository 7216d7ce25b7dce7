"""Packing texts into padded batches: optimal length buckets, then token-budget batches inside each bucket.

The bucket boundaries minimise the total padding over the whole corpus. They come from the histogram of lengths alone,
which has one row for each distinct length, by dynamic programming; the lower hull of the lines that each choice of
the last boundary gives makes a layer linear in the number of lengths. Rows are then numbered inside their bucket
without gathering a bucket in one task: by hash into slots, whose sizes give each slot its first number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import WORD, written

#: Rows wanted in a slot.
SLOT = 50_000


def boundaries(lengths: Sequence[int], counts: Sequence[int], k: int) -> list[int]:
    """The upper bounds of at most `k` buckets with the least total padding, for sorted distinct lengths."""
    n = len(lengths)
    if n <= k:
        return list(lengths)
    rows, total = [0] * (n + 1), [0] * (n + 1)
    for i in range(n):
        rows[i + 1], total[i + 1] = rows[i] + counts[i], total[i] + counts[i] * lengths[i]
    cost: list[float] = [0] + [float("inf")] * n
    choices = []
    for _ in range(k):
        new, choice, hull, at = [float("inf")] * (n + 1), [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if cost[i] < float("inf"):
                slope, start = -rows[i], cost[i] + total[i]
                while len(hull) > 1 and (start - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, start, i))
            if not hull:
                continue
            x = lengths[j - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            new[j], choice[j] = hull[at][0] * x + hull[at][1] + x * rows[j] - total[j], hull[at][2]
        cost = new
        choices.append(choice)
    ends, j = [], n
    for choice in reversed(choices):
        ends.append(lengths[j - 1])
        j = choice[j]
    return ends[::-1]


def n_words(text: Column) -> Column:
    """Words between ASCII white space; a text without any still takes one place."""
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))).cast("bigint")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, k: int = 8, budget: int = 16384) -> DataFrame:
    """`id_col`, ``n_tokens``, ``bucket``, ``bucket_length``, ``batch`` (numbered in the bucket), ``position``.

    A batch has ``budget // bucket_length`` rows of its bucket, the last one maybe fewer; a bucket longer than the
    budget has batches of one. `length` is any count of tokens (by default words). The order inside a bucket is a hash
    order; equal rows are interchangeable in it. An empty table gives no rows. Nothing is cut or dropped.
    """
    size = n_words(F.col(text_col)) if length is None else F.greatest(F.lit(1), length).cast("bigint")
    rows = written(docs.select(F.col(id_col).alias("id"), size.alias("n_tokens"), F.xxhash64(id_col, text_col).alias("h")), "lengths")
    # one row for each distinct length: bounded by the longest text, not by the number of texts
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    bounds = boundaries([r["n_tokens"] for r in histogram], [r["count"] for r in histogram], k)
    slots = max(1, -(-sum(r["count"] for r in histogram) // SLOT))
    limits = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    dealt = rows.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))).withColumn("slot", F.pmod("h", F.lit(slots)).cast("int"))
    sizes = dealt.groupBy("bucket", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("bucket", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("h", "id")) - 1
    numbered = dealt.withColumn("place", place).join(starts, ["bucket", "slot"]).withColumn("place", F.col("place") + F.col("start")).withColumn("bucket_length", F.get(limits, F.col("bucket")))
    per_batch = F.greatest(F.lit(1).cast("bigint"), F.expr(f"{int(budget)} div bucket_length"))
    return numbered.withColumn("m", per_batch).select(
        F.col("id").alias(id_col), "n_tokens", F.col("bucket").cast("int").alias("bucket"), "bucket_length", F.expr("place div m").alias("batch"), F.expr("place % m").alias("position"),
    )
