"""Spelling variants: frequent words one edit apart, and the commonest form each leads to.

Candidates come from an asymmetric join. The shorter word of a pair (by length, then spelling) contributes two disjoint
chunks, its halves; the other contributes the positional grams of a half's size, of which only those are made that a
chunk can meet within a shift of one. An edit at or behind the middle leaves the first half where it was; an edit
before it moves the second half by the difference in length. So each pair one edit apart shares a chunk, and a
verification of the whole words follows.

A chunk that very many words share (more than `HOT` candidate pairs) would make pairs by the square of their number. Such a chunk is taken
further: the part of the word that it leaves open is halved again, until a single character is open. Words that agree
in all but one character are few (one for each letter), so every group is bounded in the end, and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import LOWER, UPPER, written

#: Candidate pairs of one chunk beyond which it is taken further, and distinct words a task counts before it passes them on.
HOT, COUNTED = 1024, 200_000
_RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5, drop_every: int | None = None) -> DataFrame:
    """``word, n``: the runs of letters (A-Z lower-cased) of at least `min_length` code points and `min_count` occurrences.

    With `drop_every`, a run loses one code point wherever the CRC-32 of ``<id>:<run>`` is divisible by it: the one at
    the checksum modulo the run's length. A null text has no words; a null id reads as empty. Words are summed per
    document and per task before the shuffle. Extra columns are not read.
    """

    def in_text(key: str, text: str) -> Iterator[tuple[str, int]]:
        lowered = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
        for word, n in Counter(_RUN.findall(lowered)).items():
            if len(word) < min_length:
                continue
            if drop_every and (h := zlib.crc32(f"{key}:{word}".encode())) % drop_every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= min_length:
                yield word, n

    def as_batch(totals: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in in_text(key, text or ""):
                    totals[word] += n
                if len(totals) > COUNTED:
                    yield as_batch(totals)
                    totals.clear()
        yield as_batch(totals)

    plain = docs.select(F.coalesce(docs[f"`{id_col}`"].cast("string"), F.lit("")).alias("id"), docs[f"`{text_col}`"].alias("text"))
    return plain.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _part(word: Column, a: Column, b: Column) -> Column:
    return F.substring(word, a + 1, b - a)


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` (word, n, side, size, shift, a, b) with ``key``: all but the open places `a` to `b` (b excluded).

    `size` is the length of the shorter word, and the other one's open part is longer by `shift`. With one place open and a shift of
    one, the shorter word stands whole, and the longer one without either of its two open characters.
    """
    word, a, b = F.col("word"), F.col("a"), F.col("b") + F.when(F.col("side") == "other", F.col("shift")).otherwise(0)
    outside = F.array(F.concat_ws("\0", _part(word, F.lit(0), a), _part(word, b, F.length(word))))
    without = [F.concat(_part(word, F.lit(0), a + k), _part(word, a + k + 1, F.length(word))) for k in (0, 1)]
    single = (F.col("b") - F.col("a") == 1) & (F.col("shift") == 1)
    keys = F.when(~single, outside).when(F.col("side") == "other", F.array_distinct(F.array(*without))).otherwise(F.array(word))
    return rows.withColumn("key", F.explode(keys))


GROUP = ["size", "shift", "a", "b", "key"]


def _halves(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Each row twice: the first and the second half of ``[a, b)`` open."""
    middle = F.floor((a + b + 1) / 2).cast("int")
    both = F.array(F.struct(middle.alias("a"), b.alias("b")), F.struct(a.alias("a"), middle.alias("b")))
    kept = [c for c in rows.columns if c not in ("a", "b", "key")]
    return rows.select(*kept, F.inline(both))


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` for all pairs of `words` (word, n; distinct, not null) exactly one insertion, deletion or
    replacement of a code point apart; each pair once."""
    size = F.length("word")
    sides = F.array(
        F.struct(F.lit("chunk").alias("side"), size.alias("size"), F.lit(0).alias("shift")), F.struct(F.lit("chunk").alias("side"), size.alias("size"), F.lit(1).alias("shift")),
        F.struct(F.lit("other").alias("side"), size.alias("size"), F.lit(0).alias("shift")), F.struct(F.lit("other").alias("side"), (size - 1).alias("size"), F.lit(1).alias("shift")),
    )
    rows = words.select("word", "n", F.inline(sides)).where("size >= 0")
    rows, found, busy = _keyed(_halves(rows, F.lit(0), F.col("size"))), None, True
    while busy:
        open_more = F.col("b") - F.col("a") > 1
        pairs = F.count_if(F.col("side") == "chunk") * F.count_if(F.col("side") == "other")
        hot = written(rows.where(open_more).groupBy(*GROUP).agg(pairs.alias("pairs")).where(F.col("pairs") > HOT).select(*GROUP), "hot")
        busy = bool(hot.take(1))
        cold = rows.join(hot, GROUP, "left_anti") if busy else rows
        left = cold.where("side = 'chunk'").select(*GROUP, "word", "n")
        right = cold.where("side = 'other'").select(*GROUP, F.col("word").alias("other"), F.col("n").alias("other_n"))
        near = (F.col("shift") == 1) | (F.col("word") < F.col("other"))
        joined = left.join(right, GROUP).where(near & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")
        found = joined if found is None else found.union(joined)
        if busy:
            rows = written(_keyed(_halves(rows.join(hot, GROUP, "left_semi"), F.col("a"), F.col("b"))), "halved")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form`` links, by doubling: each round joins what a word points to with what that points to.

    A form is always commoner than its word, so there are no circles, and few links in a row.
    """
    links = written(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = written(links.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "links")
        links = joined.select("word", "root")
        if not joined.where("moved").take(1):
            return links


def group_variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of `words` (word, n).

    The form is the commonest near word (ties: first in code-point order) if it occurs at least `ratio` times as often,
    else null; the root is where following the forms ends. `ratio` must be over 1. Without words the result has no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    words = written(words.select("word", "n"), "words")
    pairs = written(near_pairs(words), "pairs")
    both = pairs.union(pairs.select("other", "other_n", "word", "n"))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    commoner = -F.col("best.less") >= ratio * F.col("n")
    chosen = written(best.select("word", "n_near", F.when(commoner, F.col("best.form")).alias("form"), F.when(commoner, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(chosen.where("form is not null"))
    return (
        words.join(chosen, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )
