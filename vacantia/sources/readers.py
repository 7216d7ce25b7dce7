"""Readers of listings and captured pages. Text lines are read by Spark with an explicit schema; the shape of a CSV
(encoding, delimiter, header) is decided for every file on its own, in a pass over the lines of all files."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.folding import normalize_space
from vacantia.functions.urls import listed_slug
from vacantia.operators.crawl import dedupe_first
from vacantia.schemas import COMPANY_KEYS, FIELDS, OFFER, PAGE, REQUIRED_TEXT, SLUG_KEYS, TITLE_KEYS
from vacantia.session import written

# ---- fixed values -------------------------------------------------------------------------------
BYTE_ORDER_MARKS = (("FFFE0000", "UTF-32"), ("0000FEFF", "UTF-32"), ("EFBBBF", "UTF-8"), ("FFFE", "UTF-16"), ("FEFF", "UTF-16"))
DELIMITERS = (",", ";", "\t")
CSV_FALLBACK = "cp1252"

def _head(spark: SparkSession, path: str) -> str:
    """The first bytes of the input as hex."""
    row = spark.read.text(path).select(F.hex(F.substring(F.col("value").cast("binary"), 1, 4)).alias("head")).first()
    return row["head"] if row else ""


def detect_encoding(spark: SparkSession, path: str) -> str:
    """By byte-order mark, else UTF-8. Files of text lines read together share one encoding."""
    head = _head(spark, path)
    return next((encoding for mark, encoding in BYTE_ORDER_MARKS if head.startswith(mark)), "UTF-8")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Text lines. Encodings other than UTF-8 go through the CSV reader, which decodes, as one column. The text reader ends a line
    at CR, LF or both, so that none is left in it."""
    if encoding == "UTF-8":
        return spark.read.text(path)
    reader = spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001").option("quote", "").option("lineSep", "\n")
    return reader.csv(path).select(F.regexp_replace("value", "^﻿|\\r$", "").alias("value"))


def blank_to_null(df: DataFrame) -> DataFrame:
    """'' as NULL in every text column but slug, title and url."""
    return df.select(*[
        F.nullif(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name not in REQUIRED_TEXT else F.col(f.name)
        for f in df.schema.fields])


def read_offers_jsonl(spark: SparkSession, path: str, schema: T.StructType = OFFER) -> tuple[DataFrame, DataFrame]:
    """``(offers, skipped)``: one JSON object per line; `skipped` is the one-row count of lines that are not.

    Blank lines do not count, and a line separator inside a string (U+2028) does not end a line.
    """
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = _lines(spark, path, detect_encoding(spark, path)).where(F.trim("value") != "")
    read = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    # as a generated row, which no filter or column is pushed through: each line is parsed once
    parsed = lines.select("value", F.explode(F.array(read)).alias("o"))
    is_object = F.ltrim("value").startswith("{") & F.col("o._bad").isNull()
    offers = parsed.where(is_object).select(*[F.col(f"o.{f.name}") for f in schema.fields])
    return blank_to_null(offers), parsed.agg(F.count_if(~is_object).alias("skipped"))


def sniff_delimiter(header: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes; ties go to the first."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(DELIMITERS, key=bare.count)


#: What Windows-1252 has where Latin-1 has control characters.
_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode(CSV_FALLBACK, "replace")


@dataclass(frozen=True)
class CsvShape:
    """How to read a group of CSV files: their encoding, delimiter, lower-case column names, whether a record may go on in
    the next line, whether lines then end in CR and LF, and paths."""

    encoding: str
    delimiter: str
    names: tuple[str, ...]
    spans_lines: bool
    crlf: bool
    paths: tuple[str, ...]


def _plain_path(uri: str) -> str:
    """The path of a file as Spark names it, with the signs that would stand for other files escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _first_lines(lines: DataFrame) -> DataFrame:
    """``file, header``: the first line of each file that is not blank. `lines` has file, start, value in the order of the files."""
    head = lines.where((F.col("start") == 0) & (F.btrim("value", F.lit(" \t\r\n\x00")) != "")).withColumn("n", F.monotonically_increasing_id())
    return head.groupBy("file").agg(F.min_by("value", "n").alias("header"))


def csv_shapes(spark: SparkSession, path: str) -> list[CsvShape]:
    """The shapes among the CSV files of an input: one streaming pass over their lines, splits of large files apart.

    A file is in the encoding its byte-order mark names, else UTF-8, else (where a line is no valid UTF-8) Windows-1252.
    If no line has an odd number of quotes, no record goes on in the next line and the file may be split.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*place, "value")
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))
    marked = reduce(lambda c, m: c.when(head.startswith(m[0]), m[1]), BYTE_ORDER_MARKS[1:], F.when(head.startswith(BYTE_ORDER_MARKS[0][0]), BYTE_ORDER_MARKS[0][1]))
    odd = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    # validity is asked of the bytes: a pattern would read past what is wrong with them
    facts = lines.groupBy("file").agg(
        F.max(F.when(F.col("start") == 0, marked)).alias("mark"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(odd).alias("spans"))
    headers = _first_lines(lines).withColumn("header", F.when(F.is_valid_utf8("header"), F.col("header")).otherwise(F.decode(F.col("header").cast("binary"), "ISO-8859-1")))
    encoding = F.when(F.col("mark").isNotNull(), F.col("mark")).when(F.col("utf8"), "UTF-8").otherwise(CSV_FALLBACK)
    shapes = []
    narrow = written(facts.join(headers, "file").select("file", encoding.alias("encoding"), "spans", "header"), "csv")
    plain = narrow.where(~F.col("encoding").rlike("^UTF-(16|32)"))
    found = [(*tuple(r)[:3], False, r["files"]) for r in plain.where(~F.col("spans")).groupBy("encoding", "spans", "header").agg(F.collect_list("file").alias("files")).collect()]
    # where records span lines their ends matter, and wide encodings hide them: those files are looked at once more
    again = {r["encoding"]: r["files"] for r in narrow.where(F.col("spans") | F.col("encoding").rlike("^UTF-(16|32)")).groupBy("encoding").agg(F.collect_list("file").alias("files")).collect()}
    for name, files in again.items():
        text = spark.read.schema("value string").options(encoding="ISO-8859-1" if name == CSV_FALLBACK else name, sep="\u0001", quote="", multiLine=True, lineSep="\n").csv(list(map(_plain_path, files)))
        firsts = _first_lines(text.select(F.col("_metadata.file_path").alias("file"), F.lit(0).alias("start"), "value"))
        for r in firsts.groupBy("header").agg(F.collect_list("file").alias("files")).collect():
            found.append((name, True, r["header"], r["header"].endswith("\r"), r["files"]))
    for name, spans, header, crlf, files in found:
        if name == CSV_FALLBACK:
            header = header.translate(dict(zip(range(0x80, 0xA0), _WINDOWS, strict=True)))
        header, paths = header.strip("\ufeff\r\n"), tuple(sorted(map(_plain_path, files)))
        delimiter = sniff_delimiter(header)
        if header.count('"') % 2:  # the header itself goes on in the next line
            names = spark.read.options(header=True, multiLine=True, sep=delimiter, escape='"', encoding="ISO-8859-1" if name == CSV_FALLBACK else name).csv(paths[0]).columns
        else:
            names = next(csv.reader([header], delimiter=delimiter), [])
        shapes.append(CsvShape(name, delimiter, tuple(n.strip().lower() for n in names), spans, crlf, paths))
    return sorted(shapes, key=lambda shape: (-len(shape.paths), shape.names))


def _read_shape(spark: SparkSession, shape: CsvShape, names: Sequence[str]) -> DataFrame:
    """The columns `names` of files of one shape; those they lack are NULL."""
    places = [f"_c{i}" for i in range(len(shape.names))]
    western = shape.encoding == CSV_FALLBACK
    options = {"header": True, "sep": shape.delimiter, "quote": '"', "escape": '"', "multiLine": shape.spans_lines, "encoding": "ISO-8859-1" if western else shape.encoding, "maxColumns": max(20480, len(places) + 1)}
    rows = spark.read.schema(", ".join(f"{place} string" for place in places)).options(**options | ({"lineSep": "\r\n"} if shape.crlf else {})).csv(list(shape.paths))
    at = {name: place for place, name in zip(places, shape.names, strict=True)}  # the last of equal names
    cell = lambda place: F.translate(place, _CONTROLS, _WINDOWS) if western else F.col(place)
    return rows.select(*[F.nullif(cell(at[n]), F.lit("")).alias(n) if n in at else F.lit(None).cast("string").alias(n) for n in names])


def read_rows_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The CSV files of an input as text columns with lower-case names.

    Every file has its own encoding, delimiter and header (see :func:`csv_shapes`), so files of different shape may lie in one folder; the files
    of each shape are read together. `columns` are the names wanted: those a file lacks are NULL, others are dropped. Without it all names of
    all files come, those of the most frequent header first. Empty cells are NULL. A large file is read by several tasks, unless a
    record in it spans lines or it is in UTF-16 or UTF-32: then one task streams it.
    """
    shapes = csv_shapes(spark, path)
    names = list(columns) if columns is not None else list(dict.fromkeys(name for shape in shapes for name in shape.names))
    if not names or not shapes:
        return spark.createDataFrame([], T.StructType([T.StructField(name, T.StringType()) for name in names]))
    return reduce(DataFrame.unionByName, [_read_shape(spark, shape, names) for shape in shapes])


def read_offers_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 18-column offer CSV: '' is NULL, salaries are integers, unknown columns are dropped."""
    rows = read_rows_csv(spark, path, FIELDS)
    columns = [
        F.when(F.btrim(f.name).rlike("^-?[0-9]+$"), F.btrim(f.name)).try_cast("bigint").alias(f.name) if isinstance(f.dataType, T.LongType)
        else (F.coalesce(F.col(f.name), F.lit("")) if f.name in REQUIRED_TEXT else F.nullif(F.col(f.name), F.lit(""))).alias(f.name)
        for f in OFFER.fields
    ]
    return rows.select(*columns)


def read_offers_envelope(spark: SparkSession, path: str, item: T.StructType = OFFER) -> DataFrame:
    """A JSON list of offers, or ``{"data": {"results": […]}}``, or ``{"results"|"items": […]}``; items
    that are no objects are dropped, another shape fails."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    return offers_in_documents(whole, item)


def offers_in_documents(docs: DataFrame, item: T.StructType = OFFER, *, value: str = "value") -> DataFrame:
    """The offers of JSON documents, one document per row, in any of the accepted shapes."""
    texts = "array<string>"
    doc = F.from_json(value, f"struct<results:{texts},items:{texts},data:struct<results:{texts},items:{texts}>>")
    listed = F.coalesce(
        F.when(F.ltrim(value).startswith("["), F.from_json(value, texts)), doc["data"]["results"], doc["data"]["items"], doc["results"], doc["items"])
    checked = F.coalesce(listed, F.raise_error(F.lit("expected a list of offers")).cast(texts))
    rows = docs.select(F.explode(checked).alias("o")).where(F.ltrim("o").startswith("{"))
    return rows.select(F.from_json("o", item).alias("o")).select("o.*")


def read_targets_txt(spark: SparkSession, path: str) -> DataFrame:
    """One URL or slug per line; blanks and ``#`` comments are skipped."""
    text = F.btrim(F.col("value"), F.lit(" \t\r"))
    lines = _lines(spark, path, detect_encoding(spark, path)).select(text.alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_pages(spark: SparkSession, path: str, *, raw: bool = False) -> DataFrame:
    """Captured pages: a Parquet table, or with `raw` a folder of HTML files (url is the file name)."""
    if not raw:
        stored = spark.read.parquet(path)
        return stored.select(*[F.col(f.name).cast(f.dataType) if f.name in stored.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAGE.fields])
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return files.select(
        F.xxhash64("url").alias("page_id"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        "html", F.lit(None).cast("timestamp").alias("fetched_at"))


def _first_text(df: DataFrame, names: Sequence[str]) -> Column:
    present = {c.lower(): c for c in df.columns}
    texts = [F.nullif(normalize_space(F.col(present[n]).cast("string")), F.lit("")) for n in names if n in present]
    return F.coalesce(*texts, F.lit(""))


def targets_from_rows(df: DataFrame, *, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """``(slug, title, company, …order)``: the first valid slug among the link columns (names in any case),
    the first of each slug by `order`; `limit` counts after that."""
    present = {c.lower(): c for c in df.columns}
    slugs = [listed_slug(F.col(present[k]).cast("string")) for k in SLUG_KEYS if k in present]
    slug = reduce(lambda a, b: F.coalesce(a, b), slugs) if slugs else F.lit(None).cast("string")
    rows = df.select(slug.alias("slug"), _first_text(df, TITLE_KEYS).alias("title"), _first_text(df, COMPANY_KEYS).alias("company"), *order)
    firsts = dedupe_first(rows.where(F.col("slug").isNotNull()), "slug", order)
    return firsts if limit is None else firsts.orderBy(*order).limit(limit)
