"""Embedding whitening from the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers, each different one counts once, and tasks add up exact sums of products. The scatter
``M = n * sum(x x') - S S'`` is an integer matrix, n² times the covariance. Its characteristic polynomial is found
modulo many primes (each prime is reduced to Hessenberg form by a task of its own) and put together by Chinese remainders, coefficient by
coefficient. All its roots are real, so Descartes' rule counts them exactly: the sign changes of the polynomial shifted
by ``t`` are the roots above ``t``. Bisection on that count isolates a root, and on the sign of the value narrows it
to some `EXTRA` bits beyond the roots' size. A component is the null space of ``M - root``, by inverse iteration in integers of fixed point.

What grows with the rows stays in Spark; the driver and each task hold the matrix (the square of the dimension), the
polynomial and the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import written

SCALE, OFFSET = 64, 1_000_000
#: Bits of a root behind the size of the largest, bits of the fixed point, and bits of one part of a long sum.
EXTRA, POINT, PART = 160, 640, 40
PARTS = 5


# ---- exact sums ---------------------------------------------------------------------------------
def integer_vectors(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows whose vector is not null and has only finite entries, with ``x``: ``floor(scale * entry) + offset``.

    Vectors of another length than most (ties: the shorter) are left out as well, as are empty ones. Integers beyond 62
    bits stop at that size.
    """
    c, bound = F.col(f"`{vector_col}`"), float(1 << 62)
    finite = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    # a null vector must not reach forall as null: that is not false
    kept = rows.where(F.coalesce(finite, F.lit(False)))
    sizes = kept.groupBy(F.size(c).alias("size")).count().orderBy(F.desc("count"), "size").first()
    whole = F.transform(c, lambda e: F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-bound)), F.lit(bound))) + F.lit(offset).cast("bigint"))
    return kept.where(F.size(c) == (sizes["size"] if sizes else -1)).withColumn("x", whole)


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _split(value: int) -> list[int]:
    """`value` in `PARTS` integers of `PART` bits, the last with the sign; sums of parts are parts of the sum."""
    return [(value >> (PART * i)) & ((1 << PART) - 1) for i in range(PARTS - 1)] + [value >> (PART * (PARTS - 1))]


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums, products, upper = 0, None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch, 0) - OFFSET  # sums of small numbers; put right at the end
        # doubles are exact while no sum of products can pass 2**53
        small = float(np.abs(x.astype(np.float64)).max()) ** 2 * len(x) < 2.0**53
        m = x.astype(np.float64) if small else x.astype(object)
        part = m.T.dot(m)
        if products is None:
            products, sums, upper = np.zeros(part.shape, object), np.zeros(x.shape[1], object), np.triu_indices(x.shape[1])
        products += part.astype(np.int64).astype(object) if small else part
        sums += x.astype(object).sum(axis=0)
        n += len(x)
    if n:
        values = [n, *sums, *products[upper]]
        parts = np.array([_split(int(v)) for v in values], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), *[pa.array(parts[:, i]) for i in range(PARTS)]], names=["cell", *[f"p{i}" for i in range(PARTS)]])


def scatter(vectors: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """``n``, the sums ``S`` and the scatter ``n * sum(x x') - S S'`` of the vectors in column ``x`` (Python integers).

    A task gives one row per cell of the matrix; cells are added by Spark.
    """
    schema = "cell bigint, " + ", ".join(f"p{i} bigint" for i in range(PARTS))
    totals = vectors.select("x").mapInArrow(_scatter, schema).groupBy("cell").agg(*[F.sum(F.col(f"p{i}").cast("decimal(38,0)")).alias(f"p{i}") for i in range(PARTS)])
    found = {r["cell"]: sum(int(r[f"p{i}"]) << (PART * i) for i in range(PARTS)) for r in totals.collect()}
    if not found:
        return 0, [], np.zeros((0, 0), object)
    n = found[0]
    d = (math.isqrt(8 * (len(found) - 1) + 9) - 3) // 2  # d sums and d * (d + 1) / 2 products
    s = [found[1 + i] for i in range(d)]
    m = np.zeros((d, d), object)
    for k, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
        m[i, j] = m[j, i] = n * found[1 + d + k] - s[i] * s[j]
    return n, [v + n * OFFSET for v in s], m


# ---- characteristic polynomial ------------------------------------------------------------------
def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(m: np.ndarray) -> list[int]:
    """Primes below 2**31 whose product is over twice any coefficient of the characteristic polynomial.

    The k-th coefficient of a matrix without negative roots is at most ``binomial(d, k) * (trace / d) ** k``.
    """
    d, trace = len(m), int(sum(m[i, i] for i in range(len(m))))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)) if d else 1
    found, product, p = [], 1, (1 << 31) - 1
    while product <= 2 * bound:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_mod(m: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of the characteristic polynomial of `m` modulo the prime `p` < 2**31."""
    h = np.array(m % p, np.int64)
    d = len(h)
    for k in range(d - 2):  # similar matrix without entries below the subdiagonal
        at = k + 1 + int(np.argmax(h[k + 1 :, k] != 0))
        if h[at, k] == 0:
            continue
        if at != k + 1:
            h[[k + 1, at]] = h[[at, k + 1]]
            h[:, [k + 1, at]] = h[:, [at, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1]) % p
        # products are below 2**62, so they are reduced before they are added
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = polys[k - 1, :-1]
        row = (row - h[k - 1, k - 1] * polys[k - 1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            row = (row - (int(h[k - 1 - i, k - 1]) * below % p) * polys[k - 1 - i]) % p
        polys[k] = row
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Integer coefficients, constant first: residues per prime in tasks, Chinese remainders per coefficient in tasks."""
    primes = primes_for(m)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = polynomial_mod(m, p)
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(found)), pa.int32()), "p": pa.array([p] * len(found), pa.int64()), "r": pa.array(found, pa.int64())})

    def combine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        value, product = 0, 1
        for p, r in zip(rows["p"].tolist(), rows["r"].tolist(), strict=True):
            value += product * ((r - value) * pow(product, -1, p) % p)
            product *= p
        return pd.DataFrame({"k": [key[0]], "c": [str(value - product if 2 * value > product else value)]})

    tasks = min(len(primes), 256)
    rows = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks, "p").mapInArrow(residues, "k int, p bigint, r bigint")
    return [int(r["c"]) for r in sorted(rows.groupBy("k").applyInPandas(combine, "k int, c string").collect())]


# ---- roots --------------------------------------------------------------------------------------
def _above(poly: list[int], t: int) -> int:
    """How many roots, with multiplicity, are greater than the integer `t`, if all are real: sign changes after a shift."""
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += t * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], t: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * t + c
    return total


def isolate(poly: list[int], rank: int, bits: int) -> tuple[int, int, int] | None:
    """``(root, first, last)``: the `rank`-th largest root (from 1) in units of ``2**-bits``, rounded down, and which ranks
    share that unit. None if the root isn't positive. All roots must be real and none negative."""
    scaled = [c << (bits * (len(poly) - 1 - k)) for k, c in enumerate(poly)]
    low, high = 0, 1 << max(1, (abs(scaled[-2]) + 1).bit_length())  # no root is above the sum of all
    above_low, above_high = _above(scaled, 0), 0
    if above_low < rank:
        return None
    while high - low > 1:  # roots in (low, high]: from rank above_high + 1 to above_low
        middle = (low + high) // 2
        if above_low - above_high == 1:
            break
        count = _above(scaled, middle)
        low, above_low, high, above_high = (middle, count, high, above_high) if count >= rank else (low, above_low, middle, count)
    if high - low > 1:  # a single root: the sign of the value tells the side
        sign_high = _value(scaled, high)
        while high - low > 1 and sign_high:
            middle = (low + high) // 2
            value = _value(scaled, middle)
            if value == 0 or (value > 0) == (sign_high > 0):
                high = middle
                if value == 0:
                    break
            else:
                low = middle
        else:
            return low if sign_high else high, above_high + 1, above_low
        return high, above_high + 1, above_low
    return low, above_high + 1, above_low


# ---- components ---------------------------------------------------------------------------------
def _solve(a: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Solve ``a y = columns`` by elimination with row exchange, in fixed point; a vanishing pivot counts as one unit."""
    a, b, d = a.copy(), columns.copy(), len(a)
    one = 1 << POINT
    for k in range(d):
        at = k + int(np.argmax([abs(v) for v in a[k:, k]]))
        if at != k:
            a[[k, at]], b[[k, at]] = a[[at, k]], b[[at, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        factors = (a[k + 1 :, k] * one) // a[k, k]
        a[k + 1 :, k:] -= (factors[:, None] * a[k, k:]) >> POINT
        b[k + 1 :] -= (factors[:, None] * b[k]) >> POINT
    y = np.zeros_like(b)
    for k in range(d - 1, -1, -1):
        rest = b[k] - ((a[k, k + 1 :, None] * y[k + 1 :]).sum(axis=0) >> POINT if k + 1 < d else 0)
        y[k] = (rest * one) // a[k, k]
    return y


def _orthonormal(y: np.ndarray) -> np.ndarray:
    """The columns of `y` made orthogonal, each of length one, in fixed point."""
    done: list[np.ndarray] = []
    for v in y.T:
        for _ in range(2):
            top = max(int(abs(c)).bit_length() for c in v)
            v = np.array([int(c) << (POINT - top) if top <= POINT else int(c) >> (top - POINT) for c in v], object)
            for w in done:
                v = v - ((w * ((w * v).sum() >> POINT)) >> POINT)
            length = math.isqrt(int((v * v).sum()))
            v = (v << POINT) // length if length else v
        done.append(v)
    return np.array(done, object).T


def null_space(m: np.ndarray, root: int, bits: int, width: int) -> np.ndarray:
    """`width` orthonormal columns (doubles) that ``m - root / 2**bits`` takes closest to zero; the largest entry of each is positive."""
    d = len(m)
    size = max(1, max(int(abs(v)) for v in m.flat)).bit_length()
    a = np.array([[(int(m[i, j]) << POINT) >> size for j in range(d)] for i in range(d)], object)
    for i in range(d):
        a[i, i] -= (root << POINT) >> (bits + size)
    y = np.array([[((i * (2 * j + 3) + j * j) % 101 + 1) << (POINT - 8) for j in range(width)] for i in range(d)], object)
    for _ in range(3):
        y = _orthonormal(_solve(a, y))
    v = np.array([[float(c / (1 << POINT)) for c in row] for row in y])
    return v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(width)])


def components(spark: SparkSession, m: np.ndarray, poly: list[int], most: int) -> list[tuple[float, float, np.ndarray]]:
    """``(root, share of the trace, vector)`` for the `most` largest positive roots, each found by a task of its own.

    Roots that agree to `EXTRA` bits behind the size of the largest count as equal; their vectors are a basis of the space they share.
    """
    d = len(m)
    trace = int(sum(m[i, i] for i in range(d)))
    bits = EXTRA
    schema = "k int, root double, share double, vector array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = isolate(poly, k, bits)
                if found is None:
                    continue
                root, first, last = found
                vector = null_space(m, root, bits, last - first + 1)[:, k - first]
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array([k], pa.int32()), "root": pa.array([root / (1 << bits)]), "share": pa.array([root / (trace << bits)]), "vector": pa.array([vector.tolist()], pa.list_(pa.float64())),
                })

    most = min(most, d)
    if not most or not trace:
        return []
    rows = spark.range(1, most + 1, 1, most).select(F.col("id").cast("int").alias("k")).mapInArrow(run, schema).collect()
    return [(r["root"], r["share"], np.array(r["vector"])) for r in sorted(rows)]


# ---- the operator -------------------------------------------------------------------------------
def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n * x - S``, exact: 64-bit integers where all fit, else Python's."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * top + max(map(abs, s)) < 1 << 62:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def whiten(rows: DataFrame, vector_col: str = "embedding", carry: tuple[str, ...] = ("vec_id",), most: int = 16) -> DataFrame:
    """For each usable row (see `integer_vectors`) and each component up to `most`: `carry`, ``component``, ``n``, ``deviation``
    (the sum of ``(n * x - S)²``; null beyond 63 bits), ``whitened``, ``explained`` and ``identity_error``.

    Each different integer vector is fitted once. Only components with a positive eigenvalue exist: a table whose
    vectors are all equal, or without vectors, gives no rows. Repeated rows give repeated results; extra columns are not carried.
    """
    spark = rows.sparkSession
    plain = rows.select(*[rows[f"`{c}`"].alias(f"_c{i}") for i, c in enumerate(carry)], rows[f"`{vector_col}`"].alias("vector"))
    usable = integer_vectors(plain, "vector").drop("vector")
    fit = written(usable.select("x").distinct(), "fit")
    n, s, m = scatter(fit)
    found = components(spark, m, characteristic_polynomial(spark, m), most) if n else []
    added = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), *[(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]
    schema = T.StructType([*rows.select(*[rows[f"`{c}`"] for c in carry]).schema, *[T.StructField(*pair) for pair in added]])
    if not found:
        return spark.createDataFrame([], schema)
    weights = np.array([v / math.sqrt(root) for root, _, v in found]).T
    shares = np.array([share for _, share, _ in found])
    width = len(found)

    def project(x: np.ndarray) -> np.ndarray:
        # (x - S / n) / sqrt(root / n²) = (n x - S) / sqrt(root)
        return _centred(x, n, s).astype(np.float64) @ weights

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(width), np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                z = project(_matrix(batch, 0))
                total, products = total + z.sum(axis=0), products + z.T @ z
        values = [*total, *products.flat]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values, pa.float64())], names=["cell", "v"])

    cells = fit.mapInArrow(moments, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    values = np.array([r["v"] for r in sorted(cells)]) / n
    mean, second = values[:width], values[width:].reshape(width, width)
    # the projections are centred already, their mean is rounding
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(width)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_in = batch.num_rows
            if not rows_in:
                continue
            x = _matrix(batch, len(carry))
            centred = _centred(x, n, s)
            top = int(np.abs(centred).max())
            safe = top * top * centred.shape[1] < 1 << 63 and centred.dtype != object
            squares = (centred * centred).sum(axis=1) if safe else [v if (v := sum(int(c) ** 2 for c in row)) < 1 << 63 else None for row in centred]
            z = centred.astype(np.float64) @ weights
            each = np.repeat(np.arange(rows_in), width)
            yield pa.RecordBatch.from_arrays([
                *[c.take(pa.array(each)) for c in batch.columns[: len(carry)]], pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows_in)), pa.array(np.full(len(each), n, np.int64)),
                pa.array(squares, pa.int64()).take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(shares, rows_in)), pa.array(np.full(len(each), error)),
            ], names=schema.names)

    return usable.mapInArrow(run, schema)
