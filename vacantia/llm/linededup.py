"""Removal of repeated multi-line chunks with content-defined boundaries. DataFrame functions only.

A chunk ends after a line if a rolling hash over the last two line hashes falls into one class of `MODULUS`, and the
one before did not; so boundaries depend on three lines only, find their place again after an insertion, and no chunk
has one line but the last. Chunks are counted by hash over the corpus (combined before the shuffle). Only rows with a
chunk whose hash repeats go on; their repeated chunks are grouped by the text itself, which is the byte comparison,
and all but the first occurrence (smallest id, then text hash, then line) are removed.

Chunks miss most passages of few lines. With `words`, every passage of whole lines with more than so many words goes as
well where it occurs again: lines that occur once in the corpus (counted by hash) end a run of repeated ones, and from
each line of a run the shortest window of more than `words` words that starts there, and the one that ends there, are
compared over the corpus. These windows cover a repeated passage whole, whatever stands beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let
from vacantia.llm.common import WORD, written

MODULUS = 3
_WORD = r"[^\x20\x09-\x0D]"


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5, as a number."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def chunks(lines: Column) -> Column:
    """``(first, n)`` of each chunk of an array of lines: its first line (from 0) and its number of lines."""

    def cut(h: Column) -> Column:
        def candidate(i: Column) -> Column:
            return F.when(i > 0, (F.get(h, i - 1) * 31 + F.get(h, i)) % MODULUS == 0).otherwise(False)

        def ends(i: Column) -> Column:
            return (candidate(i) & ~F.when(i > 1, candidate(i - 1)).otherwise(False)) | (i == F.size(h) - 1)

        def spans(e: Column) -> Column:
            def span(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(e, k - 1)).otherwise(F.lit(-1))
                return F.struct((before + 1).alias("first"), (x - before).alias("n"))

            return F.transform(e, span)

        return let(F.filter(F.sequence(F.lit(0), F.size(h) - 1), ends), spans)

    return let(F.transform(lines, line_hash), cut)


def chunk_text(lines: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(lines, first + 1, n), "\n")


def windows(lines: Column, repeated: Column, words: int) -> Column:
    """Distinct ``(first, n)`` of the shortest windows over `words` words from, and up to, each of the `repeated` lines.

    `repeated` has ``(first, s)`` of lines with a word, in order: the line, and its number among the lines with a word.
    A window has repeated lines only, and the blank ones between them; so it has at most ``words + 1`` of the former.
    """
    counted = F.transform(repeated, lambda r: F.struct(r["first"].alias("first"), r.s.alias("s"), F.regexp_count(F.get(lines, r["first"]), F.lit(WORD)).alias("w")))

    def reach(part: Column, step: int) -> Column:
        """Where the window over `part` has enough words; null if a line that occurs once comes before."""
        start = F.struct(F.lit(0).alias("w"), (part[0].s - step).alias("s"), F.lit(None).cast("int").alias("end"))

        def add(a: Column, r: Column) -> Column:
            goes_on = a.end.isNull() & (r.s == a.s + step)
            more = F.struct((a.w + r.w).alias("w"), r.s.alias("s"), F.when(a.w + r.w > words, r["first"]).alias("end"))
            return F.when(goes_on, more).otherwise(F.struct(a.w.alias("w"), F.lit(-9).alias("s"), a.end.alias("end")))

        return F.aggregate(part, start, add, lambda a: a.end)

    def both(c: Column) -> Column:
        def at(r: Column, k: Column) -> Column:
            low = F.greatest(k - words, F.lit(0))
            end, start = reach(F.slice(c, k + 1, words + 1), 1), reach(F.reverse(F.slice(c, low + 1, k - low + 1)), -1)
            ahead, back = F.struct(r["first"].alias("first"), (end - r["first"] + 1).alias("n")), F.struct(start.alias("first"), (r["first"] - start + 1).alias("n"))
            return F.array(ahead, back)

        return F.array_distinct(F.filter(F.flatten(F.transform(c, at)), lambda x: x["first"].isNotNull() & x.n.isNotNull()))

    return let(counted, both)


def dedupe_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50) -> DataFrame:
    """`docs` without the repeated chunks of `dedupe_lines` and without repeated passages of more than `words` words.

    All columns of `docs`, and ``n_removed_lines``. A passage is a run of whole lines, one long line included; all its
    occurrences but the first go. The first occurrence of every line stays. Passages are told apart by SHA-256, so
    their texts don't travel. Nulls, equal rows and the order of occurrences are as in `dedupe_lines`.
    """
    columns = [c for c in docs.columns if c != "n_removed_lines"]
    names = [f"_c{i}" for i in range(len(columns))]
    plain = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(columns, names, strict=True)])
    doc_id, text = (F.col(names[columns.index(c)]) for c in (id_col, text_col))
    keyed = plain.withColumn("_row", F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), text)).withColumn("_id", doc_id)
    lines = F.split(text, "\n")

    def listed(x: Column) -> Column:
        """Chunks of two or more lines, and single lines with their number `s`; each with a word, and its hash."""
        unit = lambda c, s, t: F.struct(c["first"].alias("first"), c.n.alias("n"), s.cast("int").alias("s"), F.xxhash64(t).alias("h"))
        multi = F.filter(chunks(x), lambda c: (c.n > 1) & chunk_text(x, c["first"], c.n).rlike(_WORD))
        single = F.filter(F.transform(x, lambda _, i: F.struct(i.alias("first"), F.lit(1).alias("n"))), lambda c: F.get(x, c["first"]).rlike(_WORD))
        return F.concat(F.transform(multi, lambda c: unit(c, F.lit(-1), chunk_text(x, c["first"], c.n))), F.transform(single, lambda c, s: unit(c, s, F.get(x, c["first"]))))

    found = written(keyed.select("_row", F.explode(let(lines, listed)).alias("c")).select("_row", "c.*"), "units")
    # written, so that the join below may split a line that very many rows share
    repeated = written(found.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "repeated")
    marked = found.join(repeated, "h", "left_semi").select("_row", "first", "n", "s").distinct().groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("first", "n", "s"))).alias("repeated"))
    # the one time the texts cross the network; rows without a repeated unit are finished here
    joined = written(keyed.join(marked, "_row", "left"), "marked")
    again = joined.where(F.col("repeated").isNotNull())
    multi = F.transform(F.filter("repeated", lambda c: c.n > 1), lambda c: F.struct(c["first"].alias("first"), c.n.alias("n")))
    single = F.filter("repeated", lambda c: c.n == 1)
    spans = let(lines, lambda x: F.transform(F.array_union(multi, windows(x, single, words)), lambda c: F.struct(c["first"].alias("first"), c.n.alias("n"), F.unhex(F.sha2(chunk_text(x, c["first"], c.n), 256)).alias("key"))))
    same = written(again.select(F.col("_id").isNull().alias("o"), "_id", "_row", F.explode(spans).alias("c")).select("o", "_id", "_row", "c.*"), "spans")
    at = F.struct("o", "_id", "_row", "first")
    first = written(same.groupBy("key").agg(F.min(at).alias("kept"), F.count("*").alias("m")).where("m > 1").select("key", "kept"), "first")
    gone = same.join(first, "key").where(~at.eqNullSafe(F.col("kept")))
    removed = gone.select("_row", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("i")).groupBy("_row").agg(F.collect_set("i").alias("removed"))
    nothing = F.lit(None).cast("array<int>").alias("removed")
    out = again.join(removed, "_row", "left").select(*names, "removed").union(joined.where(F.col("repeated").isNull()).select(*names, nothing))

    def remaining(x: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n")

    n_removed = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("bigint")
    kept_text = F.when(F.col("removed").isNull(), text).otherwise(let(lines, remaining))
    return out.select(*[(kept_text if c == text_col else F.col(n)).alias(c) for c, n in zip(columns, names, strict=True)], n_removed.alias("n_removed_lines"))


def dedupe_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the text without its removed chunks, and ``n_lines``, ``n_chunks``, ``n_removed_chunks``,
    ``n_removed_lines`` (an input column of one of these names is replaced).

    Only chunks of two or more lines with a word are removed, as whole lines; what stays is joined by line breaks. Rows
    with equal id and text are one document: all of them keep what the first keeps. A null text stays null, with no
    lines; an empty one has one line. Nulls among ids sort last.
    """
    added = ["n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines"]
    columns = [c for c in docs.columns if c not in added]
    names = [f"_c{i}" for i in range(len(columns))]
    plain = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(columns, names, strict=True)])
    doc_id, text = (F.col(names[columns.index(c)]) for c in (id_col, text_col))
    keyed = plain.withColumn("_row", F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), text)).withColumn("_id", doc_id)
    lines = F.split(text, "\n")

    def listed(x: Column) -> Column:
        """The chunks of two or more lines with a word, and the hashes of their texts."""
        multi = F.filter(chunks(x), lambda c: c.n > 1)
        hashed = F.transform(multi, lambda c: F.struct(c["first"].alias("first"), c.n.alias("n"), chunk_text(x, c["first"], c.n).alias("t")))
        return F.transform(F.filter(hashed, lambda c: c.t.rlike(_WORD)), lambda c: F.struct(c["first"].alias("first"), c.n.alias("n"), F.xxhash64(c.t).alias("h")))

    found = written(keyed.select("_row", F.explode(let(lines, listed)).alias("c")).select("_row", "c.*"), "chunks")
    # written, so that the join below may split a chunk that very many rows share
    repeated = written(found.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h"), "repeated")
    marked = found.join(repeated, "h", "left_semi").distinct().groupBy("_row").agg(F.collect_list(F.struct("first", "n", "h")).alias("repeated"))
    # the one time the texts cross the network; rows without a repeated chunk are finished here
    joined = written(keyed.join(marked, "_row", "left"), "marked")
    again = joined.where(F.col("repeated").isNotNull())
    parts = again.select(F.col("_id").isNull().alias("o"), "_id", "_row", lines.alias("lines"), F.explode("repeated").alias("c"))
    # dealt by text hash and text; equal texts are summed before they travel
    same = parts.select("o", "_id", "_row", F.col("c.first").alias("first"), F.col("c.n").alias("n"), F.col("c.h").alias("h"), chunk_text(F.col("lines"), F.col("c.first"), F.col("c.n")).alias("t"))
    first = same.groupBy("h", "t").agg(F.min(F.struct("o", "_id", "_row", "first")).alias("kept"), F.count("*").alias("m")).where("m > 1").select("h", F.xxhash64("t", F.lit(1)).alias("g"), "kept")
    kept = F.struct("o", "_id", "_row", "first")
    gone = same.select("o", "_id", "_row", "first", "n", "h", F.xxhash64("t", F.lit(1)).alias("g")).join(first, ["h", "g"]).where(~kept.eqNullSafe(F.col("kept")))
    removed = gone.select("_row", "first", "n").distinct().groupBy("_row").agg(F.collect_list(F.struct("first", "n")).alias("removed"))
    nothing = F.lit(None).cast("array<struct<first:int,n:int>>").alias("removed")
    out = again.join(removed, "_row", "left").select(*names, "removed").union(joined.where(F.col("repeated").isNull()).select(*names, nothing))

    def remaining(x: Column) -> Column:
        stays = F.filter(chunks(x), lambda c: ~F.exists("removed", lambda r: r["first"] == c["first"]))
        return F.array_join(F.transform(stays, lambda c: chunk_text(x, c["first"], c.n)), "\n")

    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("bigint")
    n_removed = F.when(F.col("removed").isNull(), F.lit(0).cast("bigint")).otherwise(n_removed)
    gone_lines = F.coalesce(F.aggregate("removed", F.lit(0), lambda a, r: a + r.n), F.lit(0)).cast("bigint")
    return out.select(
        *[(F.when(F.col("removed").isNull(), text).otherwise(let(lines, remaining)) if c == text_col else F.col(n)).alias(c) for c, n in zip(columns, names, strict=True)],
        F.coalesce(F.when(text.isNotNull(), F.size(lines)), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.when(text.isNotNull(), let(lines, lambda x: F.size(chunks(x)))), F.lit(0)).cast("bigint").alias("n_chunks"),
        n_removed.alias("n_removed_chunks"), gone_lines.alias("n_removed_lines"),
    )
