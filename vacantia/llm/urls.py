"""URL verdicts from host rules and from path templates learned for each host. DataFrame functions only.

Paths become trees of templates, host by host and level by level: runs of digits are wildcards at once, and where one
place has many different children of few paths each, these become one wildcard. Sibling branches of the same
shape whose labelled shares of bad pages don't differ beyond chance are merged and share their evidence. A template is
rejected if its smoothed share of bad labels is high enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import lower_ascii, written

#: Host rules in order: host, start of the path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, lower_ascii(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for domain, start, decision in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def _segments(path: Column, depth: int) -> Column:
    """The path's segments with digit runs as wildcards; what is deeper than `depth` becomes one last segment."""
    parts = F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/")
    parts = F.when(path.startswith("/"), F.slice(parts, 2, 1 << 20)).otherwise(parts)
    return F.when(F.size(parts) <= depth, parts).otherwise(F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, 1 << 20), "/"))))


def _at(parts: Column, level: int, value: Column) -> Column:
    """`parts` with `value` at `level`, where it has that level."""
    return F.when(F.size(parts) > level, F.transform(parts, lambda x, i: F.when(i == level, value).otherwise(x))).otherwise(parts)


def templates(urls: DataFrame, depth: int = 6, many: int = 20, rare: int = 2, similar: float = 1.96, least: int = 5) -> DataFrame:
    """``(host, parts, template, n, bad, labelled)`` for each ``(host, path, bad)``; bad is 1, 0 or null (no label).

    Each different path counts once, with its share of bad labels, however often it occurs: repeating all rows changes
    `n` alone. At a place with at least `many` different children of `rare` different paths or less, those are one
    wildcard; children of more paths stay as they are. A branch joins its siblings if it has `least` labels and its share of bad ones is within `similar` standard errors
    of theirs together; branches with mostly bad labels (wildcard ``*!``) and the others (``*``) are pooled apart. Equal paths are added up first, so a hot host costs no more rows than it has kinds of paths.
    """
    paths = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("bad").alias("bad"))
    rows = paths.groupBy("host", _segments(F.col("path"), depth).alias("parts")).agg(F.sum("n").alias("n"), F.count("*").alias("paths"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.count("bad").alias("labelled")).withColumn("tree", F.col("parts"))
    rows = written(rows, "paths")  # each level reads the one before twice, so levels are written
    for level in range(depth):
        above = F.array_join(F.slice("tree", 1, level), "/") if level else F.lit("")
        here = rows.withColumn("_up", above).withColumn("_seg", F.get("tree", F.lit(level)))
        children = here.where("_seg is not null").groupBy("host", "_up", "_seg").agg(F.sum("paths").alias("n")).where(F.col("n") <= rare)
        variable = children.groupBy("host", "_up").agg(F.count("*").alias("k")).where(F.col("k") >= many)
        wild = children.join(variable, ["host", "_up"]).select("host", "_up", "_seg", F.lit(True).alias("_wild"))
        rows = written(here.join(wild, ["host", "_up", "_seg"], "left").withColumn("tree", F.when(F.col("_wild"), _at(F.col("tree"), level, F.lit("*"))).otherwise(F.col("tree"))).drop("_up", "_seg", "_wild"), "level")
    evidence = rows.groupBy("host", "tree").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).withColumn("merged", F.col("tree"))
    evidence = written(evidence, "evidence")
    for level in range(depth):
        # siblings of mostly bad and of mostly good labels are pooled apart, under different wildcards
        counted = evidence.groupBy("host", "merged").agg(F.sum("bad").alias("b"), F.sum("labelled").alias("m")).where((F.col("m") >= least) & (F.size("merged") > level))
        branches = counted.withColumn("shape", _at(F.col("merged"), level, F.when(2 * F.col("b") > F.col("m"), "*!").otherwise("*")))
        pooled = branches.groupBy("host", "shape").agg(F.sum("b").alias("sb"), F.sum("m").alias("sm"), F.count("*").alias("k")).where("k > 1")
        p = F.col("sb") / F.col("sm")
        error = F.sqrt(F.col("m") * p * (1 - p))
        joined = branches.join(pooled, ["host", "shape"]).where(F.abs(F.col("b") - F.col("m") * p) <= similar * error).select("host", "merged", "shape")
        evidence = written(evidence.join(joined, ["host", "merged"], "left").withColumn("merged", F.coalesce("shape", "merged")).drop("shape"), "merged")
    total = evidence.groupBy("host", "merged").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    named = rows.select("host", "parts", "tree").join(evidence.select("host", "tree", "merged"), ["host", "tree"]).join(total, ["host", "merged"])
    return named.select("host", "parts", F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template"), "n", "bad", "labelled")


def judge(pages: DataFrame, url_col: str = "url", bad_col: str | None = None, rules: Sequence[tuple[str, str, str]] = RULES, prior: float = 0.5, weight: float = 2.0, purity: float = 0.9, least: int = 5, depth: int = 6, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """`carry`, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``purity`` and ``labelled``.

    Where a rule fits, it decides. Elsewhere a template with `least` labels or more whose smoothed share of bad ones,
    ``(bad + weight * prior) / (labelled + weight)``, reaches `purity` blocks; all others allow. Labels come from
    `bad_col` (1 bad, 0 good, null unknown); without it, the rules' own verdicts are the labels. A url that is null or
    has no ``://`` has an empty host and path and is allowed. Repeated rows repeat; as evidence a path counts once.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    given, carry = carry, tuple(f"_c{i}" for i in range(len(carry)))  # by position, so that no carried column can clash
    parsed = pages.select(*[pages[f"`{c}`"].alias(n) for c, n in zip(given, carry, strict=True)], host.alias("host"), path.alias("path"), *([F.col(bad_col).alias("_bad")] if bad_col else []))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", rule).withColumn("_verdict", verdict)
    label = F.col("_bad") if bad_col else F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0)
    known = templates(ruled.select("host", "path", label.alias("bad")), depth, least=least)
    smooth = (F.col("bad") + weight * prior) / (F.col("labelled") + weight)
    method = F.when((F.col("labelled") >= least) & (smooth >= purity), "block").otherwise("allow")
    out = ruled.withColumn("parts", _segments(F.col("path"), depth)).join(known, ["host", "parts"], "left")
    found = out.select(*carry, "host", "path", "rule", F.coalesce("_verdict", method).alias("verdict"), "template", smooth.alias("purity"), "labelled")
    return found.toDF(*given, *found.columns[len(given) :])
