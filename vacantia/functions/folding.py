"""Accent- and case-insensitive comparison keys as plain Catalyst expressions.

Spark has no Unicode normalisation function. A comparison key however is a *per character* map
(compatibility decomposition, minus combining marks, lower case), so the map is generated once on
the driver from ``unicodedata`` and handed to ``translate``: one-to-one pairs first, then the marks
to delete. The few hundred characters that expand to several letters (``ß``, ligatures, fractions)
are rewritten first, and only in rows that hold one. Pure-ASCII rows take the ``lower`` branch.

Hangul syllables are taken apart by rule instead of by table. Left out: a capital sigma at a word end becomes the plain
one.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``str.split()`` treats as white space: Latin-1 as a Java character class, the others as they are. Latin-1 named sign by
#: sign is a table to Java; a pattern with ranges, negated and wide characters took 13 s for 100 MB on 8 cores, as long as on one.
SPACE = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0]"
FAR_SPACE = "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: All of ASCII but lower-case letters and digits, sign by sign.
NO_KEY = "[" + "".join(f"\\x{p:02x}" for p in range(128) if not (chr(p).islower() or chr(p).isdigit())) + "]"
#: The last code point with a decomposition is below this one; Hangul syllables are decomposed by rule.
LAST_CODE_POINT = 0x2FFFF
HANGUL = (0xAC00, 0xD7A3)
LEADS, VOWELS, TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def let(value: Column, body) -> Column:
    """``body(value)`` with `value` computed once per row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def literal_map(entries: dict[str, str]) -> Column:
    """A constant ``map<string,string>``, sent to the JVM as one literal and folded there."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _decompose(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))


def _java_class(points: list[int]) -> str:
    """Sorted code points as a Java regex class with ranges."""
    runs: list[list[int]] = []
    for point in points:
        if runs and point == runs[-1][1] + 1:
            runs[-1][1] = point
        else:
            runs.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@lru_cache(maxsize=None)
def fold_tables(casefold: bool) -> tuple[str, str, dict[str, str], str]:
    """``(source, target, expansions, expansion class)`` for `translate` and the rewrite before it."""
    source: list[str] = []
    target: list[str] = []
    marks: list[str] = []
    expansions: dict[str, str] = {}
    for point in range(LAST_CODE_POINT + 1):
        if 0xD800 <= point <= 0xDFFF or HANGUL[0] <= point <= HANGUL[1]:
            continue
        char = chr(point)
        plain = _decompose(char)
        plain = plain.casefold() if casefold else plain.lower()
        if plain == char:
            continue
        if not plain:
            marks.append(char)
        elif len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            expansions[char] = plain
    return "".join(source + marks), "".join(target), expansions, _java_class(sorted(map(ord, expansions)))


def is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def _jamo(syllable: Column) -> Column:
    """The two or three letters of a Hangul syllable."""
    n = F.ascii(syllable) - HANGUL[0]
    part = lambda letters, at: F.substring(F.lit(letters), at.cast("int"), F.lit(1))
    return F.concat(part(LEADS, F.floor(n / 588) + 1), part(VOWELS, F.floor(n % 588 / 28) + 1), F.when(n % 28 > 0, part(TAILS, n % 28)).otherwise(""))


def _folded(text: Column, casefold: bool) -> Column:
    source, target, expansions, _ = fold_tables(casefold)
    near = {c: plain for c, plain in expansions.items() if c <= "\xff"}
    far = {c: plain for c, plain in expansions.items() if c > "\xff"}
    # Looked at for characters beyond Latin-1 only, so that most text is passed over quickly.
    points = _java_class([*sorted(map(ord, far)), *HANGUL]).replace(f"\\x{{{HANGUL[0]:x}}}\\x{{{HANGUL[1]:x}}}", f"\\x{{{HANGUL[0]:x}}}-\\x{{{HANGUL[1]:x}}}")
    rare = f"[[^\\x00-\\xff]&&{points}]"
    table = literal_map(far)

    def rewritten(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"(?s){rare}|[^{points[1:-1]}]+"), F.lit(0))
        return F.array_join(F.transform(pieces, lambda piece: F.when(
            F.length(piece) == 1, F.coalesce(F.try_element_at(table, piece), F.when(F.ascii(piece).between(*HANGUL), _jamo(piece)), piece)).otherwise(piece)), "")

    def folded(t: Column) -> Column:
        expanded = t
        for char, plain in near.items():
            expanded = F.replace(expanded, F.lit(char), F.lit(plain))
        return F.translate(F.when(t.rlike(rare), rewritten(expanded)).otherwise(expanded), source, target)

    return F.when(is_ascii(text), F.lower(text)).otherwise(let(text, folded))


def normalize_space(text: Column) -> Column:
    """Every run of white space (NBSP included) as one space, none at the ends."""
    def spaced(t: Column) -> Column:
        near = reduce(lambda c, space: F.replace(c, F.lit(space), F.lit(" ")), FAR_SPACE, t)
        return F.btrim(F.regexp_replace(F.when(is_ascii(t), t).otherwise(near), f"{SPACE}+", " "))

    return let(text, spaced)


def _letters(plain: Column) -> Column:
    return let(F.regexp_replace(plain, f"{NO_KEY}+", ""), lambda t: F.when(is_ascii(t), t).otherwise(F.regexp_replace(t, "[^a-z0-9]+", "")))


def key(text: Column) -> Column:
    """Lower-case ASCII letters and digits only: ``Bío Bío`` -> ``biobio``."""
    return _letters(_folded(text, casefold=False))


def fold(text: Column) -> Column:
    """Accents and case dropped (``ß`` -> ``ss``), spaces collapsed: the key of area and label names."""
    return normalize_space(_folded(text, casefold=True))


def normalize(text: Column) -> Column:
    """Accents dropped, lower case, spaces collapsed: the key of form-question labels."""
    return normalize_space(_folded(text, casefold=False))


def forms(text: Column) -> Column:
    """``struct(fold, normalize, key)`` of a text that all three are wanted of: folded once, and a second time only if more than ASCII
    is left, as lower case and case folding differ in nothing that ends up as ASCII."""
    def of_plain(plain: Column) -> Column:
        return let(normalize_space(plain), lambda spaced: F.struct(
            F.when(is_ascii(plain), spaced).otherwise(fold(text)).alias("fold"), spaced.alias("normalize"), _letters(plain).alias("key")))

    return let(_folded(text, casefold=False), of_plain)


def fold_literal(text: str) -> str:
    """The driver-side value of :func:`fold` for a literal argument."""
    return " ".join(_decompose(text).casefold().split())


def normalize_literal(text: str) -> str:
    return " ".join(_decompose(text).lower().split())


def key_literal(text: str) -> str:
    return "".join(c for c in _decompose(text).lower() if c.isascii() and c.isalnum())
