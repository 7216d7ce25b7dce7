"""Quality rules whose cutoffs are fitted under a bound on false rejections. DataFrame functions only.

Every text gets the counts below. A rule rejects a text if a ratio of counts is over a cutoff. For each stratum and
ratio, cutoffs of a fixed grid are tried on the labelled good rows of that stratum: a cutoff is certified if the exact
one-sided binomial (Clopper-Pearson) upper bound of its false rejection rate is at most the ratio's even share of
`risk`, at a level divided by the number of all tests (Bonferroni). The sharpest certified cutoff is used; without one,
the ratio rejects nothing. So all ratios together falsely reject at most `risk` of a stratum's good rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let
from vacantia.llm.common import written

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_WORD = r"[^\x20\x09-\x0D]"
#: Ratios a text is judged by (numerator, denominator); each is 0 for a text without words.
RATIOS = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "long_words": ("word_chars", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "exclamations": ("n_exclamations", "n_words"),
}
#: Cutoffs of so many strata at most (a few kilobytes) are broadcast; more are joined by a shuffle.
BROADCAST_STRATA = 1000
#: Cutoffs tried, from the mildest: fixed in advance, so that fitting them needs no data.
GRID = {
    "symbols": [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
    "repeats": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "duplicate_lines": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "long_words": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0],
    "capitals": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
    "exclamations": [2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05],
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. Windows are compared by their 64-bit hash.

    Only texts with equal windows sort them with their places: neighbours in that order are repeats, and each place
    covers three words, or as many as there are before the next place.
    """

    def covered(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(r: Column) -> Column:
            return F.array_sort(F.transform(F.filter(r, lambda x, k: (x.g == F.get(r, k + 1).g) | (F.when(k > 0, F.get(r, k - 1).g) == x.g)), lambda x: x.i))

        return let(let(ranked, starts), lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    grams = F.transform(F.filter(F.transform(words, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"))), lambda z: z.c.isNotNull()), lambda z: F.xxhash64(z.a, z.b, z.c))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))


def measure(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """`carry` and the counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_capitals, n_exclamations (all bigint). Null and blank texts have zero words; texts are read whole."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD))
    inner = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")))
    counted = docs.select(
        *carry, inner.alias("_w"), let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("_l"),
        F.length(_without(text, _SPACE)).alias("_c"), F.length(text).alias("_n"), F.length(_without(text, _SYMBOLS)).alias("_s"),
        F.length(_without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("_u"), F.length(_without(text, "!")).alias("_e"),
    )
    long = {
        "n_words": F.col("_w.n"), "word_chars": F.col("_c"), "n_symbols": F.col("_n") - F.col("_s"), "n_lines": F.col("_l.n"),
        "n_dup_lines": F.col("_l.d"), "n_repeat_words": F.col("_w.r"), "n_capitals": F.col("_n") - F.col("_u"), "n_exclamations": F.col("_n") - F.col("_e"),
    }
    return counted.select(*carry, *[c.cast("bigint").alias(k) for k, c in long.items()])


def ratio(name: str) -> Column:
    top, bottom = RATIOS[name]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X binomial(n, p): the terms follow from one another, and are added in logarithms."""
    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc.term + F.log((n - j + 1) / j) + F.lit(odds)
        high, low = F.greatest(acc.total, term), F.least(acc.total, term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    return F.when(k >= n, F.lit(0.0)).otherwise(F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), start, step).total)


def certify(holdout: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """``(stratum, ratio, cutoff)``: the sharpest certified cutoff of each ratio in each stratum.

    `holdout` has the measured good rows. A stratum of null is one of its own. The chance that the cutoffs of any stratum
    together reject more than `risk` of its good rows is at most `delta`.
    """
    flags = [F.count_if(ratio(name) > cut).alias(f"{name}@{i}") for name, cuts in GRID.items() for i, cut in enumerate(cuts)]
    counted = written(holdout.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), *flags), "holdout")
    tests = F.array(*[F.struct(F.lit(name).alias("ratio"), F.lit(cut).alias("cutoff"), F.col(f"{name}@{i}").alias("k")) for name, cuts in GRID.items() for i, cut in enumerate(cuts)])
    rows = counted.select("stratum", "n", F.explode(tests).alias("t")).select("stratum", "n", "t.*")
    n_tests = max(1, counted.count()) * sum(map(len, GRID.values()))
    passed = rows.where(log_tail(F.col("k"), F.col("n"), risk / len(RATIOS)) <= math.log(delta / n_tests))
    return passed.groupBy("stratum", "ratio").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", risk: float = 0.02, delta: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """The counts of each row, ``base_failed``, ``failed`` (ratios over their cutoff, sorted) and ``kept``.

    `labels` is (doc_id, quality): 1 is good. An id labelled both good and bad, or only with null, is no evidence; rows
    of a labelled id all count. Rows with a null id are judged like others. Without labels no cutoff can be certified
    and only the base rule rejects. Rows that the base rule fails are no evidence either: it has rejected them already.
    """
    measured = written(measure(docs, text_col, tuple(dict.fromkeys((id_col, stratum, *carry)))), "measured").withColumn("base_failed", base_failed())
    good = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("q")).where("q = 1")
    holdout = measured.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_id"), "left_semi")
    cutoffs = written(certify(holdout, stratum, risk, delta).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("ratio", "cutoff"))).alias("cutoffs")), "cutoffs")
    side = F.broadcast(cutoffs) if cutoffs.count() <= BROADCAST_STRATA else cutoffs
    joined = measured.join(side, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(ratio(name) > F.col("cutoffs")[name], F.lit(name)) for name in sorted(RATIOS)]))
    return joined.withColumn("failed", F.coalesce(failed, F.array().cast("array<string>"))).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("stratum", "cutoffs")


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The rows of `docs` that `judge` keeps, all columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    place = {c: names[docs.columns.index(c)] for c in (id_col, text_col, stratum)}
    verdict = judge(plain, labels, place[id_col], place[text_col], place[stratum], carry=(*names,))
    return verdict.where("kept").select(*names).toDF(*docs.columns)
