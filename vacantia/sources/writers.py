"""Sinks: JSONL, spreadsheet-safe CSV, flattened list CSVs, the JSON envelope, the review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.text import strip_control_chars
from vacantia.schemas import CSV_KINDS, FIELDS, KINDS, SCHEMA_VERSION

# ---- fixed values -------------------------------------------------------------------------------
FORMULA_START = r"^[=+\-@\t\r]"
SUFFIXES = {".jsonl": "jsonl", ".ndjson": "jsonl", ".csv": "csv"}
BOM = "﻿"

#: Rows of one written file at most, so that any file can be read back by one task.
FILE_ROWS = 500_000
#: Results of one call at most.
MAX_ITEMS = 150


def offer_columns(df: DataFrame) -> DataFrame:
    """The 18 offer columns in their order, absent ones NULL, dates as ISO text."""
    return strip_control_chars(df.select(*[
        (F.col(c) if c.startswith("salary_") else F.col(c).cast("string")).alias(c) if c in df.columns
        else F.lit(None).cast("bigint" if c.startswith("salary_") else "string").alias(c) for c in FIELDS]))


def write_jsonl(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One object per line with every key present."""
    offer_columns(df).write.mode(mode).option("ignoreNullFields", False).option("maxRecordsPerFile", FILE_ROWS).json(path)


def formula_safe(df: DataFrame) -> DataFrame:
    """Text cells a spreadsheet would run as a formula get a leading quote mark."""
    guarded = lambda c: F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)
    return df.select(*[guarded(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema.fields])


def _write_csv(df: DataFrame, path: str, mode: str) -> None:
    marked = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    (marked.write.mode(mode).option("header", True).option("maxRecordsPerFile", FILE_ROWS).option("nullValue", "").option("emptyValue", "").option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_csv(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """The 18 columns with a header, a byte-order mark and NULL as an empty cell."""
    _write_csv(formula_safe(offer_columns(df)), path, mode)


def format_for(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    suffix = "." + name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported output extension {suffix or '(none)'}: use {', '.join(SUFFIXES)}")
    return SUFFIXES[suffix]


def write_offers(df: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """By extension: ``.jsonl`` / ``.ndjson`` or ``.csv``; anything else is refused before any work."""
    (write_csv if format_for(path) == "csv" else write_jsonl)(df, path, mode=mode)


def flatten_for_csv(df: DataFrame, kind: str) -> DataFrame:
    """A list result as flat columns: the salary struct as five, arrays joined with ``; ``, fixed order."""
    if kind not in CSV_KINDS:
        raise ValueError(f"CSV output is not available for {kind}")
    types = dict(df.dtypes)
    parts = {"salary_currency": "currency", "salary_min": "min", "salary_max": "max", "salary_period": "period"}

    def column(name: str) -> Column:
        if name == "salary":
            return F.col("salary.raw")
        if name in parts:
            return F.col(f"salary.{parts[name]}")
        return F.array_join(name, "; ") if types[name].startswith("array") else F.col(name)

    return df.select(*[column(c).alias(c) for c in CSV_KINDS[kind]])


def write_list_csv(df: DataFrame, kind: str, path: str, *, mode: str = "errorifexists") -> None:
    _write_csv(strip_control_chars(flatten_for_csv(df, kind)), path, mode)


def row_type(items: DataFrame, order) -> str:
    """The type of one item without its ordering columns."""
    return items.select(*[c for c in items.columns if c not in order]).schema.simpleString()


def to_envelope(
    kind: str, items: DataFrame | None = None, meta: DataFrame | None = None, *, order: Sequence[str] = (), warnings: Column | None = None,
    lists: dict[str, Column] | None = None,
) -> DataFrame:
    """One row ``(document)``: ``{"schema_version", "kind", "data", "warnings"}`` with every key present.

    `items` (at most the 150 results of a call) become the kind's list field; `meta` is its one row of
    list metadata, whose `notes` join `warnings`; more items are an error. An empty first page gets the hint of its kind.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    fields, hint = KINDS[kind]
    frame = meta if meta is not None else items.sparkSession.range(1).select()
    meta_columns = [c for c in (meta.columns if meta is not None else []) if c != "notes"]
    data = [F.col(c) for c in meta_columns]
    if items is not None:
        row = F.struct(*[F.col(c) for c in items.columns if c not in order])
        sort = F.struct(*order) if order else F.lit(0)
        name = fields[0] if fields else "results"
        listed = F.transform(F.array_sort(F.collect_list(F.struct(sort.alias("o"), row.alias("r")))), lambda s: s["r"])
        too_many = F.raise_error(F.lit(f"an envelope holds at most {MAX_ITEMS} items")).cast(f"array<{row_type(items, order)}>")
        # one row over the bound is enough to know, so no more are ever gathered
        bundled = items.limit(MAX_ITEMS + 1).agg(F.when(F.count("*") > MAX_ITEMS, too_many).otherwise(listed))
        frame = frame.withColumn(name, bundled.scalar())
        data.append(F.col(name))
    data += [c.alias(n) for n, c in (lists or {}).items()]
    none = F.array().cast("array<string>")
    notes = F.concat(warnings if warnings is not None else none, F.col("notes") if meta is not None and "notes" in meta.columns else none)
    empty = F.lit(False)
    if hint and items is not None:
        first_page = F.lit(True)
        for name, start in (("page", 1), ("offset", 0)):
            if name in meta_columns:
                first_page = first_page & (F.coalesce(F.col(name), F.lit(start)) == start)
        empty = (F.size(fields[0]) == 0) & first_page
    hints = F.when(empty, F.array(F.lit(hint).cast("string"))).otherwise(none)
    document = F.to_json(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(kind).alias("kind"), F.struct(*data).alias("data"),
        F.concat(F.array_distinct(notes), hints).alias("warnings")), {"ignoreNullFields": "false"})
    return frame.select(document.alias("document"))


def error_envelope(code: Column, exit_code: Column, message: Column, hint: Column) -> Column:
    """The failure document ``{"schema_version", "kind": "error", "error": {…}}``."""
    error = F.struct(code.alias("code"), exit_code.alias("exit_code"), message.alias("message"), hint.alias("hint"))
    return F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("error").alias("kind"), error.alias("error")), {"ignoreNullFields": "false"})


def write_review_queue(records: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    records.write.mode(mode).option("ignoreNullFields", False).option("maxRecordsPerFile", FILE_ROWS).json(path)
