"""Text, date and number normalisation: built-in expressions only, so all of it stays in the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.folding import let, literal_map, normalize_space

# ---- fixed values: formats the results depend on ------------------------------------------------
#: C0 but tab and newline, DEL and C1, sign by sign, which is a table to Java.
CONTROL_CHARS = "[" + "".join(f"\\x{p:02x}" for p in (*range(0x09), *range(0x0b, 0x20), *range(0x7f, 0xa0))) + "]"
BLOCK_END = r"(?i)</(?:p|div|li|ul|ol|h[1-6]|tr|table|section)\s*>"
DAY_FIRST = r"^(3[01]|[12][0-9]|0?[1-9])/(1[0-2]|0?[1-9])/([0-9]{2}|[0-9]{4})( (?:2[0-3]|[01]?[0-9]):[0-5]?[0-9])?$"
TEXT_CAP = 4000


# ---- dates --------------------------------------------------------------------------------------
def parse_date_any(text: Column) -> Column:
    """A leading ISO date, else a whole ``dd/MM/yy[yy][ HH:mm]``; anything else or impossible is NULL.

    Two-digit years pivot at 69 (``69`` is 1969, ``68`` is 2068).
    """

    def parsed(s: Column) -> Column:
        day, month, year = (F.regexp_extract(s, DAY_FIRST, i) for i in (1, 2, 3))
        century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
        day_first = F.concat(century, year, F.lit("-"), month, F.lit("-"), day).try_cast("date")
        return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.left(s, F.lit(10)).try_cast("date")).when(
            s.rlike(DAY_FIRST), day_first
        )

    return let(normalize_space(text), parsed)


# ---- numbers ------------------------------------------------------------------------------------
def to_int(text: Column) -> Column:
    """The first number of a text; ``.`` and ``,`` are thousands marks, a 1-2 digit tail is decimals."""
    token = F.regexp_replace(F.regexp_extract(text, r"[0-9][0-9.,]*", 0), r"[.,]+$", "")
    whole = F.regexp_replace(token, r"[.,][0-9]{1,2}$", "")
    return F.regexp_replace(whole, "[^0-9]", "").try_cast("bigint")


def to_amount(text: Column) -> Column:
    """An amount whose decimals, if any, follow a comma: ``2.150.000,00`` -> 2150000."""
    return F.regexp_replace(F.regexp_replace(text, r",[0-9]{1,2}$", ""), "[.,]", "").try_cast("bigint")


def whole_int(text: Column) -> Column:
    """An integer only when the whole text is one, dots as thousands marks: ``1.828``."""
    return F.when(
        text.rlike(r"^(?:[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)$"), F.replace(text, F.lit("."), F.lit("")).try_cast("bigint")
    )


def digits_only(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")


# ---- entities and HTML --------------------------------------------------------------------------
def _entity_map(names: list[str]) -> Column:
    return literal_map({name: html5[name] for name in names})


def _code_point(number: Column) -> Column:
    """The character of a numeric reference; 0x80-0x9f as Windows-1252, impossible points as U+FFFD."""
    windows = {}
    for byte in range(0x80, 0xA0):
        try:
            windows[byte] = bytes([byte]).decode("cp1252")
        except UnicodeDecodeError:
            windows[byte] = chr(byte)
    table = F.create_map(*[part for k, v in windows.items() for part in (F.lit(k).cast("bigint"), F.lit(v))])
    unknown = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    dropped = (
        number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127)
        | number.between(0xFDD0, 0xFDEF) | ((number % 65536) >= 65534)
    )
    return (
        F.when(unknown, "\ufffd").when(number == 13, "\r").when(number.between(0x80, 0x9F), F.try_element_at(table, number))
        .when(dropped, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    )


def decode_entities(text: Column) -> Column:
    """HTML character references as HTML5 reads them, in one pass, so ``&amp;lt;`` gives ``&lt;``.

    Names may lack their ``;`` where HTML5 allows it. The full name table is only searched when the
    handful of usual names does not match.
    """
    usual = _entity_map(["amp;", "nbsp;", "quot;", "lt;", "gt;", "aacute;", "eacute;", "iacute;", "oacute;", "uacute;", "ntilde;"])
    full = _entity_map(sorted(html5))
    bare = "|".join(sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n)))
    token = r"(?s)&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|&|[^&]+"

    def decoded(piece: Column) -> Column:
        name = F.substr(piece, F.lit(2))
        legacy = F.regexp_extract(name, f"^(?:{bare})", 0)
        hexa = F.conv(F.left(F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]*)", 1), F.lit(8)), 16, 10).try_cast("bigint")
        number = F.left(F.regexp_extract(piece, "^&#0*([0-9]*)", 1), F.lit(12)).try_cast("bigint")
        named = F.coalesce(F.try_element_at(usual, name), F.try_element_at(full, name))
        partial = F.when(
            legacy != "", F.concat(F.try_element_at(full, legacy), F.substr(name, F.length(legacy) + 1))
        ).otherwise(piece)
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            .when(piece.rlike("^&#[xX]"), _code_point(hexa))
            .when(piece.startswith("&#"), _code_point(number))
            .otherwise(F.coalesce(named, partial))
        )

    pieces = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """HTML fragment -> one line per paragraph, line break or list item (``- ``), no blank lines."""
    s = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    s = F.regexp_replace(s, BLOCK_END, "\n")
    s = F.regexp_replace(s, r"(?i)<li\b[^>]*>", "- ")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    s = F.translate(decode_entities(s), "\u00a0", " ")
    lines = F.transform(F.split(s, "\n"), lambda line: F.btrim(F.regexp_replace(line, r"[ \t\r\f\x0b]+", " ")))
    return F.coalesce(F.array_join(F.filter(lines, lambda line: line != ""), "\n"), F.lit(""))


# ---- clipping -----------------------------------------------------------------------------------
def clip_collapsed(text: Column, limit: int) -> Column:
    """Spaces collapsed, then cut at a word boundary to at most `limit` characters."""

    def cut(s: Column) -> Column:
        head = F.left(s, F.lit(limit))
        words = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
        return F.when(F.length(s) <= limit, s).when(words != "", words).otherwise(head)

    return let(normalize_space(text), cut)


def clip_form(text: Column, limit: Column) -> Column:
    """At most `limit` characters, inner spaces kept; a cut inside a word goes back to the word before."""

    def cut(head: Column) -> Column:
        following = F.substr(text, limit + 1, F.lit(1))
        boundary = following.rlike(r"^\s") | head.rlike(r"\s$")
        words = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
        return F.when(boundary, F.regexp_replace(head, r"\s+$", "")).when(words != "", words).otherwise(head)

    short = F.length(text) <= limit
    return F.when(short, text).when(limit <= 0, "").otherwise(let(F.left(text, limit), cut))


def cap_text(text: Column, limit: int = TEXT_CAP) -> tuple[Column, Column]:
    """``(first `limit` characters, whether something was cut)``."""
    return F.left(text, F.lit(limit)), F.coalesce(F.length(text) > limit, F.lit(False))


# ---- control characters -------------------------------------------------------------------------
def plain_text(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def _plain(value: Column, kind: T.DataType) -> Column | None:
    """`value` without control characters, or None when its type holds no strings."""
    if isinstance(kind, T.StringType):
        return plain_text(value)
    if isinstance(kind, T.ArrayType) and _plain(value, kind.elementType) is not None:
        return F.transform(value, lambda item: _plain(item, kind.elementType))
    if isinstance(kind, T.StructType) and any(_plain(value, f.dataType) is not None for f in kind.fields):
        parts = [F.coalesce(_plain(value[f.name], f.dataType), value[f.name]) if _plain(value[f.name], f.dataType) is not None
                 else value[f.name] for f in kind.fields]
        rebuilt = F.struct(*[part.alias(f.name) for part, f in zip(parts, kind.fields, strict=True)])
        return F.when(value.isNotNull(), rebuilt)
    return None


def strip_control_chars(df: DataFrame) -> DataFrame:
    """Every string, string array and string inside a struct without C0 (tab, newline stay), DEL and C1."""
    columns = []
    for field in df.schema.fields:
        cleaned = _plain(F.col(f"`{field.name}`"), field.dataType)
        columns.append(F.col(f"`{field.name}`") if cleaned is None else cleaned.alias(field.name))
    return df.select(*columns)
