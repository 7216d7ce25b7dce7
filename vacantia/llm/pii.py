"""Personal data: patterns propose spans, checksums and ranges confirm them, nearby words adjust their score.

DataFrame functions only. Offsets come from cutting the text at a pattern: the pieces between matches and the matches
themselves alternate, so their lengths add up to positions. Patterns are possessive where that changes nothing, which
keeps them linear and free of deep recursion on long runs of digits.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let

#: Characters before a span in which context words are looked for, and the score an added span must reach.
CONTEXT, LEAST = 48, 0.5


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the Luhn check digit of the others."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(_chars(F.reverse(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether a letter-digit code, its first four characters moved to the end and letters read as 10-35, is 1 mod 97."""

    def step(rest: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        return F.when(letter, (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(_chars(F.concat(F.substring(code, 5, 1 << 20), F.substring(code, 1, 4))), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """What to propose, what confirms it, and how sure that is, alone and next to a context word."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    near: float
    context: str
    base: bool = False


def _count_between(hit: Column, low: int, high: int) -> Column:
    return F.length(_digits(hit)).between(low, high)


_LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda h: F.lit(True), 0.9, 1.0, "mail|contact|write", True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda h: h.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"), 0.6, 0.9, "ip|host|server|login|address", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda h: _count_between(h, 12, 19) & luhn(_digits(h)), 0.8, 1.0, "card|visa|credit|debit|pay", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: _count_between(h, 9, 15), 0.7, 0.95, "phone|tel|call|mobile|fax", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", lambda h: mod97(F.translate(h, " ", "")), 0.95, 1.0, "iban|bank|account|konto"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda h: F.lit(True), 0.4, 0.9, "ssn|social|security|tax"),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", lambda h: F.lit(True), 0.3, 0.8, "phone|tel|call|mobile|fax"),
)


def _found(text: Column, kind: Kind, order: int) -> Column:
    """The confirmed matches of a kind: leftmost, none overlapping, failing ones dropped."""
    pieces, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), 0)

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + F.length(x.piece)
        end = start + F.length(x.hit)
        near = F.lower(F.substring(text, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(start, F.lit(CONTEXT)))).rlike(rf"\b(?:{kind.context})")
        score = F.when(near, kind.near).otherwise(F.lit(kind.score))
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))
        good = kind.valid(x.hit) if kind.base else kind.valid(x.hit) & (score >= LEAST)
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc.out, span)).otherwise(acc.out).alias("out"))

    def walk(pair: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>").alias("out"))
        return F.aggregate(F.filter(F.arrays_zip(pair.p.alias("piece"), pair.h.alias("hit")), lambda x: x.hit.isNotNull()), start, step).out

    return let(F.struct(pieces.alias("p"), hits.alias("h")), walk)


def find(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry` and ``spans``: (start, order, end, kind, score), sorted by start and kind.

    Offsets are code points, ends exclusive. Spans of base kinds always stay; an added kind needs a score of `LEAST`
    and may not touch a base span. Null and empty texts have none. Texts are read whole, one row at a time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>")

    def all_kinds(t: Column) -> Column:
        base = F.concat(*[_found(t, k, i) for i, k in enumerate(KINDS) if k.base])
        more = F.concat(*[_found(t, k, i) for i, k in enumerate(KINDS) if not k.base])
        return let(base, lambda b: F.array_sort(F.concat(b, F.filter(more, lambda m: ~F.exists(b, lambda x: (x.start < m.end) & (m.start < x.end))))))

    wanted = text.contains("@") | text.rlike("[0-9]")
    return docs.select(*carry, F.when(wanted, let(text, all_kinds)).otherwise(none).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def summary(found: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = [k for k in KINDS if k.base]
    counts = [F.size(F.filter("spans", _is(k.name))).cast("bigint").alias(f"n_{k.name}") for k in base]
    only = F.filter("spans", lambda s: s.order < len(base))
    return found.select(*carry, *counts, F.sha2(listed(only), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"))


def _is(name: str) -> Callable[[Column], Column]:
    return lambda s: s.kind == name
