"""robots.txt rules over URLs. For one host the rules are read once on the driver (a file of at most a few hundred
lines) and become one expression, so a frontier of any size is checked without a join. For many hosts the captured
files become a table with one row of rules per host, joined to the URLs by host.

A URL is allowed only when two readings agree: longest match with wildcards (Allow wins ties), and
the standard library's first-rule-in-file-order prefix match.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote as unquote_text
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let
from vacantia.functions.urls import unquote, url_part
from vacantia.session import written


def _directives(text: str):
    """``(name, value)`` of every directive line, comments and blanks dropped."""
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if colon:
            yield name.strip().lower(), value.strip()


def rules_for(text: str, agent: str) -> list[tuple[bool, str]]:
    """``(is allow, pattern)`` of the groups naming `agent`, else of the ``*`` groups, in file order."""
    by_agent: dict[str, list[tuple[bool, str]]] = {}
    current: list[str] = []
    open_group = False
    for name, value in _directives(text):
        if name == "user-agent":
            current = current + [value.lower()] if open_group else [value.lower()]
            open_group = True
            by_agent.setdefault(value.lower(), [])
        elif name in ("allow", "disallow") and current:
            open_group = False
            for who in set(current):
                by_agent[who].append((name == "allow", value))
    return by_agent.get(agent.lower(), by_agent.get("*", []))


def _pattern_regex(pattern: str) -> str:
    """A path pattern with ``*`` and a final ``$`` as an anchored Java regex."""
    end = "$" if pattern.endswith("$") else ""
    pieces = (pattern[:-1] if end else pattern).split("*")
    return "(?s)^" + ".*".join(re.sub(r"([^A-Za-z0-9/_])", r"\\\1", piece) for piece in pieces) + end


def _longest_match(path: Column, rules: list[tuple[bool, str]]) -> Column:
    votes = [
        F.when(path.rlike(_pattern_regex(pattern)), 2 * len(pattern) + int(allow))
        for allow, pattern in ((a, unquote_text(p)) for a, p in rules) if pattern
    ]
    if not votes:
        return F.lit(True)
    best = reduce(lambda a, b: F.greatest(a, b), votes)
    return best.isNull() | (best % 2 == 1)


def prefixes_for(text: str, agent: str) -> list[tuple[bool, str]]:
    """``(is allow, prefix)`` in file order, as the standard library reads the file; the prefix '' fits every path."""
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
    return [(rule.allowance, "" if rule.path == "*" else unquote_text(rule.path)) for rule in (entry.rulelines if entry else [])]


def _first_match(target: Column, text: str, agent: str) -> Column:
    votes = [F.when(target.startswith(prefix), F.lit(allow)) for allow, prefix in prefixes_for(text, agent)]
    return F.coalesce(*votes, F.lit(True))


def _agent_token(agent: str) -> str:
    return agent.split("/", 1)[0].strip()


def _rule_path(url: Column) -> Column:
    """The decoded path and query, which patterns are matched against."""
    query, path = url_part(url, "query"), url_part(url, "path")
    return F.concat(F.when(path == "", "/").otherwise(unquote(path)), F.when(query != "", F.concat(F.lit("?"), unquote(query))).otherwise(""))


def _rule_target(url: Column) -> Column:
    """What follows the host in the decoded URL, which prefixes are matched against."""
    after_host = F.regexp_extract(unquote(url), r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    return F.when(after_host == "", "/").otherwise(after_host)


def robots_allowed(url: Column, text: str, agent: str, *, status: int = 200) -> Column:
    """Whether `agent` may fetch `url`. 401/403 forbid all, other 4xx mean no rules, 5xx forbid all."""
    token = _agent_token(agent)
    if status in (401, 403) or status >= 500:
        return F.lit(False)
    if status >= 400:
        text = ""
    longest = let(_rule_path(url), lambda p: _longest_match(p, rules_for(text, token)))
    return longest & let(_rule_target(url), lambda t: _first_match(t, text, token))


def _head(pattern: str) -> str:
    """What a path must begin with to match: the pattern up to its first wildcard or its end mark."""
    return pattern.removesuffix("$").partition("*")[0]


RULES = "host string, closed boolean, patterns array<struct<head:string,regex:string,vote:int>>, prefixes array<struct<prefix:string,allow:boolean>>"


def robots_table(files: DataFrame, agent: str, *, host: str = "host", status: str = "status", body: str = "body") -> DataFrame:
    """The rules for `agent` of every host from its captured robots file: one row per host (`files` has each host once).

    ``patterns`` have the plain text a path must begin with, a regex (null where that text decides) and a vote (twice the
    pattern's length, one more for Allow), ``prefixes`` the rules of the second reading in file order. ``closed`` marks hosts whose file was refused or failed: 401, 403, 5xx or no
    status; other 4xx mean no rules.
    """
    token = _agent_token(agent)

    def read(batches):
        for batch in batches:
            hosts, codes, texts = (column.to_pylist() for column in batch.columns)
            bodies = [(text or "") if code is not None and code < 400 else "" for code, text in zip(codes, texts, strict=True)]
            rules = [[(allow, unquote_text(p)) for allow, p in rules_for(text, token)] for text in bodies]
            patterns = [[{"head": _head(p), "regex": None if _head(p) == p else _pattern_regex(p), "vote": 2 * len(p) + allow} for allow, p in found if p] for found in rules]
            prefixes = [[{"prefix": p, "allow": allow} for allow, p in prefixes_for(text, token)] for text in bodies]
            closed = [code is None or code in (401, 403) or code >= 500 for code in codes]
            yield pa.RecordBatch.from_arrays([
                pa.array(hosts, pa.string()), pa.array(closed, pa.bool_()),
                pa.array(patterns, pa.list_(pa.struct([("head", pa.string()), ("regex", pa.string()), ("vote", pa.int32())]))),
                pa.array(prefixes, pa.list_(pa.struct([("prefix", pa.string()), ("allow", pa.bool_())])))],
                names=["host", "closed", "patterns", "prefixes"])

    return files.select(F.lower(host).alias("host"), F.col(status).cast("int"), F.col(body).cast("string")).mapInArrow(read, RULES)


def _candidates(keys: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """The `keys` (host, `text`, …) joined to those of `rules` (host, head, …) whose head their text begins with.

    A text is cut to each length that a head of its host has, and the cuts are matched by equality: a probe for each length, however many
    rules there are.
    """
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("head")).alias("_lengths"))
    cut = keys.join(lengths, "host").withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length(text))))
    return cut.withColumn("head", F.left(F.col(text), F.col("_n"))).drop("_n", "_lengths").join(rules, ["host", "head"])


def robots_verdicts(urls: DataFrame, rules: DataFrame, *, url: str = "url") -> DataFrame:
    """`urls` with ``allowed``, by the rules of each URL's own host; NULL where no file of the host was captured.

    `rules` has each host once. The different paths are judged, each once: rules are found by equality on the host and the plain beginning
    of the path, and only those with a wildcard are then tried as a pattern. The verdicts are joined back to the URLs.
    """
    names = [f"_c{i}" for i in range(len(urls.columns))]
    plain = urls.toDF(*names)
    given = F.col(names[urls.columns.index(url)])
    placed = plain.withColumns({"host": F.coalesce(F.lower(url_part(given, "host")), F.lit("")), "_path": F.coalesce(_rule_path(given), F.lit("")), "_target": F.coalesce(_rule_target(given), F.lit(""))})
    keys = written(placed.select("host", "_path", "_target").distinct(), "paths")
    patterns = rules.select("host", F.inline("patterns"))
    fitting = _candidates(keys, "_path", patterns).where(F.col("regex").isNull() | F.regexp_like("_path", F.col("regex")))
    longest = fitting.groupBy("host", "_path", "_target").agg(F.max("vote").alias("_vote"))
    prefixes = rules.select("host", F.posexplode("prefixes").alias("place", "p")).select("host", "place", F.col("p.prefix").alias("head"), F.col("p.allow").cast("int").alias("allow"))
    # twice the place and the verdict in one number, so that the first rule is a plain minimum
    first = _candidates(keys, "_target", prefixes).groupBy("host", "_path", "_target").agg(F.min(2 * F.col("place") + F.col("allow")).alias("_first"))
    known = rules.select("host", "closed")
    agreed = F.coalesce(F.col("_vote") % 2 == 1, F.lit(True)) & F.coalesce(F.col("_first") % 2 == 1, F.lit(True))
    judged = keys.join(known, "host").join(longest, ["host", "_path", "_target"], "left").join(first, ["host", "_path", "_target"], "left")
    verdicts = judged.select("host", "_path", "_target", (~F.col("closed") & agreed).alias("allowed"))
    return placed.join(verdicts, ["host", "_path", "_target"], "left").select(*names, "allowed").toDF(*urls.columns, "allowed")


def crawl_delay(text: str, agent: str) -> float | None:
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    delay = parser.crawl_delay(_agent_token(agent))
    return None if delay is None else float(delay)
