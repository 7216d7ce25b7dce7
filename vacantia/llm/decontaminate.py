"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text.

Texts are normalised to words (letters, digits and all characters beyond ASCII, A-Z lower-cased) with one blank on
either side; a window of benchmark words becomes such a string too, so every occurrence is a plain substring. Hits are
mapped back to the original text through the words' own offsets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Windows in one automaton. A benchmark with more is dealt to several, and texts pass through one after the other.
MAX_WINDOWS = 500_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: In UTF-8 every byte of a character beyond ASCII is over 0x7F, so words can be told apart byte by byte.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_built: dict[str, ahocorasick.Automaton] = {}


def words(raw: bytes) -> list[bytes]:
    """The normalised words of UTF-8 bytes."""
    return raw.translate(_TABLE).split()


def window_rows(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, text)``: the distinct windows of each item. Shorter items are one window; those without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = words(text or b"")
                got = {b" ".join(w[i : i + width]).decode() for i in range(max(1, len(w) - width + 1))} if w else set()
                texts += got
                items += [item] * len(got)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(run, "item string, text string").distinct()


def _automaton(name: str, windows: list[tuple[str, list[str | None]]]) -> ahocorasick.Automaton:
    """Built once in each Python worker."""
    if name not in _built:
        machine = ahocorasick.Automaton()
        for text, items in windows:
            key = " " + text.encode().decode("latin-1") + " "
            machine.add_word(key, (key.count(" ") - 1, [i for i in items if i is not None]))
        if len(machine):
            machine.make_automaton()
        _built.clear()
        _built[name] = machine
    return _built[name]


def _scan(w: list[bytes], machine: ahocorasick.Automaton, hit: np.ndarray) -> set[str]:
    """Mark the hit words; the items found."""
    items: set[str] = set()
    if not len(machine) or not w:
        return items
    ends = None
    for end, (n, found) in machine.iter((b" " + b" ".join(w) + b" ").decode("latin-1")):
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        last = int(np.searchsorted(ends, end))
        hit[last - n + 1 : last + 1] = True
        items.update(found)
    return items


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of marks."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``spans`` (character offsets, end exclusive).

    A word is hit if it lies in an occurrence of a window of `benchmark` (item_id, text). Windows are whole words in
    order, whatever stands between them. Null and blank texts have no words and no hits; an item whose id is null
    hits but is not named; repeated rows give repeated results. Extra columns are not carried.
    """
    spark = docs.sparkSession
    windows = window_rows(benchmark, width).groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("items"))
    shards = max(1, -(-windows.count() // MAX_WINDOWS))
    base = docs.select(*carry).schema
    middle = T.StructType([*base, T.StructField("_text", T.StringType()), T.StructField("_hit", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType()))])
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    final = T.StructType([*base, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    df = docs.select(*carry, F.col(text_col).alias("_text"), F.lit(None).cast("binary").alias("_hit"), F.array().cast("array<string>").alias("items"))
    for k in range(shards):
        part = windows.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).collect()
        payload = [(r["text"], list(r["items"])) for r in part]
        sent = spark.sparkContext.broadcast((hashlib.sha1(repr(sorted(payload, key=str)).encode()).hexdigest(), payload))
        last = k == shards - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            machine = _automaton(*sent.value)
            n = len(base)
            for batch in batches:
                out: list[tuple] = []
                for text, mark, items in zip(batch.column(n).cast(pa.binary()), batch.column(n + 1), batch.column(n + 2), strict=True):
                    text, w = text.as_py() or b"", None
                    w = words(text)
                    hit = np.frombuffer(mark.as_py(), bool).copy() if mark.is_valid else np.zeros(len(w), bool)
                    found = sorted(_scan(w, machine, hit) | set(items.as_py()))
                    if not last:
                        out.append((hit.tobytes(), found))
                        continue
                    spans = []
                    if hit.any():
                        at = [m.span() for m in _WORD.finditer(text.lower().decode())]
                        spans = [{"start": at[i][0], "end": at[j][1]} for i, j in _runs(hit)]
                    out.append((len(w), int(hit.sum()), found, spans))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))] if last else [pa.binary(), pa.list_(pa.string())]
                made = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: n if last else n + 1], *made], names=[f.name for f in (final if last else middle)])

        df = df.mapInArrow(run, final if last else middle)
    return df


def without_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", max_share: float = 0.0) -> DataFrame:
    """The rows of `docs`, all columns kept, of which at most `max_share` of the words are hit."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    return find_leaks(plain, benchmark, width, text, tuple(names)).where(F.col("n_hit") <= max_share * F.col("n_words")).select(*names).toDF(*docs.columns)
