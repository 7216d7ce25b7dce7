"""Seek paging: the rows behind a deep offset of an ordered result, without ordering what comes before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.session import written

#: Rows that one task may order, ranges a histogram divides rows into, and sampled keys per range.
SHALLOW, RANGES, SAMPLED = 10_000, 32, 16


def sort_keys(order: Sequence[str]) -> list[Column]:
    """``"name desc"`` and ``"name asc"`` as sort expressions, nulls last."""
    return [F.col(o.split()[0]).desc_nulls_last() if o.endswith("desc") else F.col(o.split()[0]).asc_nulls_last() for o in order]


def before(order: Sequence[str], bound: Sequence) -> Column:
    """Whether a row comes before the key `bound` (one value per column of `order`)."""
    found = F.lit(False)
    for o, value in reversed(list(zip(order, bound, strict=True))):
        column = F.col(o.split()[0])
        if value is None:  # nulls are last
            first, same = column.isNotNull(), column.isNull()
        else:
            first, same = (column > value if o.endswith("desc") else column < value), column.eqNullSafe(F.lit(value))
        found = F.coalesce(first, F.lit(False)) | (same & found)
    return found


def _range_of(order: Sequence[str], bounds: list[tuple], low: int, high: int) -> Column:
    """How many of `bounds` a row does not come before, by halving: few comparisons for each row."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(before(order, bounds[middle]), _range_of(order, bounds, low, middle)).otherwise(_range_of(order, bounds, middle + 1, high))


def seek(found: DataFrame, order: Sequence[str], skip: int, n: int, *, shallow: int = SHALLOW, ranges: int = RANGES) -> DataFrame:
    """Rows `skip` to ``skip + n`` of `found` in `order` (``"name desc"`` or ``"name asc"``, nulls last), not sorted.

    Up to `shallow` rows are a top-k. Beyond that a sample of the keys divides the rows into ranges, one aggregate
    counts each range exactly, and only the ranges that hold the wanted rows are kept (written once); that repeats
    until few rows come before the wanted ones. So a deep page reads the rows a few times, with a row per range and task to shuffle, and orders no
    more than a shallow one. Rows alike in all sort columns cannot be told apart and are ordered as one range,
    in any order, as a plain sort would.
    """
    names = [o.split()[0] for o in order]
    while skip > shallow:
        sampled = found.select(*names).orderBy(F.rand(0)).limit(ranges * SAMPLED)
        keys = [tuple(r) for r in sampled.orderBy(*sort_keys(order)).collect()]  # at most ranges * SAMPLED keys
        bounds = list(dict.fromkeys(keys[i] for i in range(0, len(keys), SAMPLED)))
        at = _range_of(order, bounds, 0, len(bounds)).alias("at")
        counts = {r["at"]: r["n"] for r in found.select(at).groupBy("at").agg(F.count("*").alias("n")).collect()}
        total, first = sum(counts.values()), 0
        while first < len(bounds) and skip >= counts.get(first, 0):
            skip -= counts.get(first, 0)
            first += 1
        last, held = first, counts.get(first, 0)
        while last < len(bounds) and held < skip + n:
            last += 1
            held += counts.get(last, 0)
        kept = [~before(order, bounds[first - 1])] if first else []
        kept += [before(order, bounds[last])] if last < len(bounds) else []
        if not kept or held == total:
            break
        found = written(found.where(kept[0] if len(kept) == 1 else kept[0] & kept[1]), "range")
    return found.orderBy(*sort_keys(order)).offset(skip).limit(n)
