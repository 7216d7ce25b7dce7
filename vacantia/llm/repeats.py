"""Exact repeats of long byte strings, by bucket refinement over sampled suffixes.

Every byte covered by a string of `length` bytes that starts more than once in the corpus is marked. Suffixes are
sampled by content: each `length`-byte string owns the suffix at its smallest q-gram (by hash, leftmost on ties), so
equal strings own equal suffixes at the same offset, and about one position in 176 is kept. Suffixes are put into
buckets by that q-gram. A bucket with one suffix is done: none of its strings repeats. The others are refined on the
identifiers of longer strings at earlier and later offsets, first of all the strings a suffix owns (their union), then
of ever smaller blocks of them (`LEVELS`), down to single strings:

* equal unions in two places: every string of the block repeats; the block is done;
* a core (the bytes that all strings of the block share) in one place only: none of them repeats; done;
* else the block is parted at the next level, in the bucket it now belongs to.

So a change in a long copy costs a few blocks, not hundreds of strings, and equal blocks are counted, never paired.
Identifiers are 64-bit hashes, each used within a bucket whose own identifier is another 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vacantia.llm.common import written

Q = 48
#: Strings (by the offset of their sampled suffix) in a block, level by level; the last must be 1.
LEVELS = (88, 11, 1)
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each `q`-gram of bytes."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:-1], out=sums[1:])
    h = (sums[q:] - sums[:-q]) * down[: len(data) - q + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xD6E8FEB86659FD93)


def owners(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled suffixes: position, first and last start of the strings each owns, and the hash of its q-gram."""
    h = gram_hashes(data, q)
    width, n = length - q + 1, len(data) - length + 1
    ranked = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = ranked
    grid = padded.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).reshape(-1)
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    best = np.minimum(after[:n], before[width - 1 : width - 1 + n])
    first = np.concatenate(([0], np.flatnonzero(best[1:] != best[:-1]) + 1))
    at = (best[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, first, np.concatenate((first[1:] - 1, [n - 1])), h[at]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _mapped(df: DataFrame, make: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """``make(row values)`` gives output rows, batch by batch; text columns arrive as bytes."""
    fields = T._parse_datatype_string(schema).fields
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) else c for c in batch.columns]
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                rows += make(tuple(c[i].as_py() for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _sampled(rows: DataFrame, length: int) -> DataFrame:
    """``(row, at, lo, hi, bucket, whole)`` for each sampled suffix of ``(row, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for row, text in zip(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                if len(raw) < length:
                    continue
                at, lo, hi, bucket = owners(np.frombuffer(raw, np.uint8), length, Q)
                view = memoryview(raw)
                whole = _signed([xxhash.xxh3_64_intdigest(view[a : b + length], (p - a) << 20 | (b - a)) for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)])
                out.append([np.full(len(at), row), at, lo, hi, bucket.view(np.int64), whole])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["row", "at", "lo", "hi", "bucket", "whole"])

    return rows.select("row", "text").mapInArrow(run, "row bigint, at bigint, lo bigint, hi bigint, bucket bigint, whole bigint")


def _decided(blocks: DataFrame, core: str) -> DataFrame:
    """`blocks` (row, at, lo, hi, `core`, whole) without those that can't repeat.

    ``all``: every string of the block repeats. ``open``: to be parted further, which also holds for one block of each
    repeated union as long as its core has other, undecided company that may share some of its strings.
    """
    place = F.xxhash64("row", "at", "lo")
    unions = blocks.groupBy(core, "whole").agg(F.count("*").alias("n"), F.min(place).alias("chosen"))
    cores = unions.groupBy(core).agg(F.sum("n").alias("m"), F.min("n").alias("fewest")).where("m > 1")
    known = unions.join(cores, core).select(core, "whole", "n", F.when(F.col("fewest") == 1, F.col("chosen")).alias("chosen"))
    joined = blocks.join(known, [core, "whole"])
    return joined.select("row", "at", "lo", "hi", (F.col("n") > 1).alias("all"), F.coalesce((F.col("n") == 1) | (place == F.col("chosen")), F.lit(False)).alias("open"))


def _shared(rows: DataFrame, length: int) -> DataFrame:
    """``(row, n_shared)``: how many of a row's sampled places stand in a string that occurs at another place too.

    Strings of `length` bytes own the places of their smallest q-grams, as above. Around such a place in a repeated string
    at least half of the bytes beside the q-gram repeat on one side, so the q-gram with so many bytes before it, and with so many behind
    it, are each counted over all rows. So a row with a repeated string of `length` bytes has a shared place, and one without a
    repeated string of half as many has none.
    """
    half = (length - Q) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, key = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = text.as_py() or b""
                if len(raw) < length:
                    continue
                view = memoryview(raw)
                for p in np.unique(owners(np.frombuffer(raw, np.uint8), length, Q)[0]).tolist():
                    for side, a, b in ((1, p - half, p + Q), (2, p, p + Q + half)):
                        if a >= 0 and b <= len(raw):
                            row.append(name)
                            place.append(p)
                            key.append(xxhash.xxh3_64_intdigest(view[a:b], side))
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int64()), pa.array(_signed(key))], names=["row", "place", "key"])

    places = written(rows.select("row", "text").mapInArrow(run, "row bigint, place bigint, key bigint"), "places")
    again = written(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    return places.join(again, "key", "left_semi").select("row", "place").distinct().groupBy("row").agg(F.count("*").alias("n_shared"))


def find_repeats(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), length: int = 400, shared: int | None = None) -> DataFrame:
    """`carry`, ``n_bytes``, ``spans`` (maximal runs of marked bytes, end exclusive), ``n_removed`` and ``kept_sha256``.

    With `shared`, also ``n_shared``: the sampled places in repeated strings of about so many bytes, which may be too short
    to be removed (see `_shared`).

    `length` is at least 128. Null and empty texts have no bytes; texts shorter than `length` keep everything. A
    repeated row is a second place for all its strings. Strings are judged on the input, and texts are read whole.
    """
    given, carry = carry, tuple(f"_c{i}" for i in range(len(carry)))  # by position, so that no carried column can clash
    docs, text_col = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(given, carry, strict=True)], docs[f"`{text_col}`"].alias("_text")), "_text"
    key = F.xxhash64(*carry, text_col)
    rows = docs.select(*carry, F.col(text_col).alias("text"), key.alias("row"))
    levels = [min(s, length) for s in LEVELS]
    suffixes = written(_sampled(rows, length), "suffixes")
    decided = written(_decided(suffixes, "bucket"), "decided")
    block = F.struct(F.col("at").cast("int").alias("at"), F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"))
    state = decided.distinct().groupBy("row").agg(F.collect_list(F.when(F.col("all"), block)).alias("done"), F.collect_list(F.when(F.col("open"), block)).alias("open"))
    joined = rows.join(state, "row", "left")
    # the text crosses the network once, here: rows without a repeated bucket are finished, the others written
    plain = [F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("plain_sha256")]
    split = written(joined.select("row", *carry, *plain, F.when(F.col("done").isNotNull(), F.col("text")).alias("text"), "done", "open"), "texts")

    found = decided.where("all").select("row", "lo", "hi")
    todo = split.where("size(open) > 0").select("row", "text", "open")
    for size in levels:
        blocks = written(_blocks(todo, size, length), f"blocks{size}")
        state = written(_decided(blocks, "core").distinct(), f"decided{size}")
        found = found.union(state.where("all").select("row", "lo", "hi"))
        if size > 1:
            left = state.where("open").groupBy("row").agg(F.collect_list(block).alias("open"))
            todo = split.where("size(open) > 0").select("row", "text").join(left, "row")
    marks = found.distinct().groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    def finish(values: tuple) -> Iterator[tuple]:
        *kept, n_bytes, sha, raw, marks = values
        kept = [v.decode() if isinstance(v, bytes) else v for v in kept]
        if not marks:
            yield *kept, n_bytes, 0, 0, [], sha.decode()
            return
        edges = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edges, [m["lo"] for m in marks], 1)
        np.add.at(edges, [m["hi"] + length for m in marks], -1)
        gone = np.cumsum(edges[:-1]) > 0
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        spans = [{"start": a, "end": b} for a, b in cuts.reshape(-1, 2).tolist()]
        yield *kept, n_bytes, int(gone.sum()), len(spans), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()

    last = split.join(marks, "row", "left")
    if shared:
        last = last.join(_shared(rows, shared), "row", "left").withColumn("_shared", F.coalesce("n_shared", F.lit(0)))
        given, carry = (*given, "n_shared"), (*carry, "_shared")
    last = last.select(*carry, "n_bytes", "plain_sha256", "text", "marks")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in last.select(*carry).schema)
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]
    return _mapped(last, finish, f"{kinds}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string").toDF(*given, *added)


def _blocks(todo: DataFrame, size: int, length: int) -> DataFrame:
    """The open blocks of ``(row, text, open)``, parted into blocks of `size` offsets, with identifiers."""

    def make(values: tuple) -> Iterator[tuple]:
        row, raw, open_blocks = values
        view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
        for b in open_blocks:
            at, lo, hi = b["at"], b["lo"], b["hi"]
            for g in range((at - hi) // size, (at - lo) // size + 1):
                first, last = max(lo, at - g * size - size + 1), min(hi, at - g * size)
                core = digest(view[at - g * size : at - g * size - size + 1 + length], g * 1024 + size)
                whole = digest(view[first : last + length], (at - first) << 20 | (last - first)) if size > 1 else core
                yield row, at, first, last, core - (core >> 63 << 64), whole - (whole >> 63 << 64)

    return _mapped(todo, make, "row bigint, at bigint, lo bigint, hi bigint, core bigint, whole bigint")
