"""Domain normalisation: regions, locations, tags, salaries, ages, countries, company facts, role pills."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.folding import fold, fold_literal, key, key_literal, let, literal_map, normalize_space
from vacantia.functions.text import to_amount

# ---- fixed values: names, aliases and enums the results must equal ------------------------------
REGIONS = (
    "Metropolitana", "Arica y Parinacota", "Tarapacá", "Antofagasta", "Atacama", "Coquimbo", "Valparaíso",
    "O'Higgins", "Maule", "Ñuble", "Bío Bío", "La Araucanía", "Los Ríos", "Los Lagos", "Aysén",
    "Magallanes y Antártica Chilena",
)
REGION_EXACT = {"rm": "Metropolitana", "aisen": "Aysén"}
REGION_CONTAINS = (
    ("magallanes", "Magallanes y Antártica Chilena"),
    ("antartica", "Magallanes y Antártica Chilena"),
    ("aisen", "Aysén"),
    ("ohiggins", "O'Higgins"),
    ("biobio", "Bío Bío"),
)
COUNTRY_KEYS = (
    "chile", "peru", "colombia", "mexico", "brasil", "brazil", "argentina", "bolivia", "ecuador", "uruguay",
    "paraguay", "venezuela", "espana", "spain", "estadosunidos", "unitedstates", "costarica", "panama", "guatemala",
)
COUNTRIES = {"CL": "Chile", "CO": "Colombia", "MX": "México", "PE": "Perú", "BR": "Brasil"}
MODALITY_KEYS = ("presencial", "remoto", "hibrido", "teletrabajo", "semipresencial")
EMPLOYMENT_LABELS = {
    "Jornada Completa": "full_time", "Jornada Parcial": "part_time", "Freelance / Por contrato": "contractor",
    "Prácticas": "intern", "Por horas": "per_diem", "Otro": "other",
}
MODALITY_LABELS = {"Presencial": "on_site", "Remoto": "remote", "Híbrido": "hybrid"}
REGION_WORD = r"(?iu)^regi(?:ó|o\u0301|o)n\s+(?:del?\s+(?:la\s+)?)?"
R_PREFIX = r"(?i)^R(?:\.\s*|\s+)"
SALARY = r"^([A-Z]{3})\s*\$?\s*([0-9][0-9.,]*)(?:\s*-\s*\$?\s*([0-9][0-9.,]*))?$"
HOURS_AGO = r"^hace (?:menos de 1 hora|[0-9]+ horas?)$"
DAYS_AGO = r"^hace ([0-9]+) dias?$"
MONTHS_AGO = r"^hace ([0-9]+) mes(?:es)?$"
COMPANY_SIZE = r"(?iu)^[0-9][0-9.]*(\s*-\s*[0-9][0-9.]*)?\+?\s+empleados$"
ACTIVE_OFFERS = r"^([0-9][0-9.]*) ofertas? activas?$"
MAX_PILL_CHARS = 50
MAX_PILLS_BYTES = 512


# ---- regions and locations ----------------------------------------------------------------------
def strip_region_word(text: Column) -> Column:
    return F.btrim(F.regexp_replace(normalize_space(text), REGION_WORD, ""))


def norm_region(text: Column) -> Column:
    """Any spelling of a region -> its canonical name, else NULL.

    Precedence: whole-text alias, canonical key, alias, contained alias, then one key inside the other
    (keys of four letters or more). A country name never matches.
    """
    by_key = {key_literal(name): name for name in REGIONS}
    exact = literal_map({**REGION_EXACT, **by_key})
    whole = literal_map(REGION_EXACT)

    def canonical(keys: Column) -> Column:
        raw, k = keys["raw"], keys["cleaned"]
        rules = F.when((k == "") | k.isin(*COUNTRY_KEYS), F.lit(None).cast("string"))
        rules = rules.when(F.try_element_at(exact, k).isNotNull(), F.try_element_at(exact, k))
        for alias, name in REGION_CONTAINS:
            rules = rules.when(F.contains(k, F.lit(alias)), name)
        long_enough = F.length(k) >= 4
        for region_key, name in by_key.items():
            rules = rules.when(long_enough & (F.contains(k, F.lit(region_key)) | F.contains(F.lit(region_key), k)), name)
        return F.coalesce(F.try_element_at(whole, raw), rules)

    def keys(raw: Column) -> Column:
        cleaned = F.regexp_replace(strip_region_word(raw), R_PREFIX, "")
        return F.struct(key(raw).alias("raw"), key(cleaned).alias("cleaned"))

    return let(normalize_space(text), lambda raw: let(keys(raw), canonical))


def parse_location(text: Column) -> Column:
    """``Comuna, Provincia, Región, País`` -> ``struct(region, comuna, country)``."""

    def resolved(p: Column) -> Column:
        parts, country = p["parts"], p["country"]
        last = F.try_element_at(parts, F.lit(-1))
        named = last.rlike(r"(?iu)^regi[oó]n\b")
        chilean = country.isNull() | (key(country) == "chile")
        stripped = strip_region_word(last)
        region = F.coalesce(F.when(chilean, norm_region(last)), F.when(stripped != "", stripped))
        single = F.size(parts) == 1
        return F.struct(
            F.when((F.size(parts) > 1) | (single & named), region).alias("region"),
            F.when((F.size(parts) > 1) | (single & ~named), parts[0]).alias("comuna"),
            country.alias("country"),
        )

    def split_country(parts: Column) -> Column:
        last = F.try_element_at(parts, F.lit(-1))
        known = F.coalesce(key(last).isin(*COUNTRY_KEYS), F.lit(False))
        return F.struct(
            F.when(known, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts).alias("parts"),
            F.when(known, last).alias("country"),
        )

    pieces = F.filter(
        F.transform(F.split(F.coalesce(normalize_space(text), F.lit("")), ","), lambda p: F.btrim(p)), lambda p: p != "")
    return let(let(pieces, split_country), resolved)


# ---- tags and labels ----------------------------------------------------------------------------
def split_tags(tags: Column) -> Column:
    """``struct(workday, modality)``: modality by keyword, workday the first other tag; else site order."""

    def is_modality(tag: Column) -> Column:
        return let(key(tag), lambda k: reduce(lambda a, b: a | b, [F.contains(k, F.lit(m)) for m in MODALITY_KEYS]))

    def resolved(at: Column) -> Column:
        by_order = (at == 0) & (F.size(tags) > 1)
        workday = F.when(at == 1, F.try_element_at(tags, F.lit(2))).otherwise(F.try_element_at(tags, F.lit(1)))
        modality = F.when(by_order, F.try_element_at(tags, F.lit(2))).when(at > 0, F.try_element_at(tags, at.cast("int")))
        return F.struct(workday.alias("workday"), modality.alias("modality"))

    return let(F.array_position(F.transform(tags, is_modality), F.lit(True)), resolved)


def _first_known(labels: Column, table: dict[str, str]) -> Column:
    known = literal_map({fold_literal(label): value for label, value in table.items()})
    return F.try_element_at(
        F.array_compact(F.transform(labels, lambda label: F.try_element_at(known, fold(label)))), F.lit(1))


def label_types(labels: Column) -> Column:
    """``struct(employment_type, modality)`` by the value of the labels, never their position."""
    return F.struct(
        _first_known(labels, EMPLOYMENT_LABELS).alias("employment_type"),
        _first_known(labels, MODALITY_LABELS).alias("modality"),
    )


# ---- salary, age, status ------------------------------------------------------------------------
def parse_salary(text: Column) -> Column:
    """``CLP $650.000 - $850.000`` -> struct; one amount is both bounds; unreadable text keeps `raw` only."""
    low, high = F.regexp_extract(text, SALARY, 2), F.regexp_extract(text, SALARY, 3)
    matched = text.rlike(SALARY)
    return F.when(text != "", F.struct(
        text.alias("raw"),
        F.when(matched, F.regexp_extract(text, SALARY, 1)).alias("currency"),
        F.when(matched, to_amount(low)).alias("min"),
        F.when(matched, to_amount(F.when(high != "", high).otherwise(low))).alias("max"),
        F.lit(None).cast("string").alias("period"),
    ))


def posted_at(age: Column, today: Column) -> Column:
    """`today` minus a relative age: hours are today, a month is 30 days, anything else NULL."""

    def dated(k: Column) -> Column:
        days = F.regexp_extract(k, DAYS_AGO, 1).try_cast("int")
        months = F.regexp_extract(k, MONTHS_AGO, 1).try_cast("int")
        return (
            F.when(k.rlike(HOURS_AGO), today).when(k.rlike(DAYS_AGO), F.date_sub(today, days))
            .when(k.rlike(MONTHS_AGO), F.date_sub(today, months * 30))
        )

    return let(fold(age), dated)


def offer_status(valid_through: Column, today: Column) -> Column:
    return F.when(valid_through < today, "expired").otherwise("open")


# ---- countries ----------------------------------------------------------------------------------
def normalize_country(text: Column) -> Column:
    """A country name, accents and case ignored, as the portal spells it; unknown is NULL."""
    return F.try_element_at(literal_map({fold_literal(name): name for name in COUNTRIES.values()}), fold(text))


def country_code(text: Column) -> Column:
    """The two-letter code of a country name or code."""
    table = {fold_literal(name): code for code, name in COUNTRIES.items()} | {code.lower(): code for code in COUNTRIES}
    return F.try_element_at(literal_map(table), fold(text))


def normalize_countries(names: Column) -> Column:
    """``struct(countries, error)``: canonical names in order without repeats; NULL input is Chile."""
    given = F.filter(names, lambda n: F.btrim(n) != "")
    canonical = F.transform(given, normalize_country)
    error = F.when(F.size(given) == 0, "empty").when(F.exists(canonical, lambda c: c.isNull()), "unknown country")
    return F.when(
        names.isNull(), F.struct(F.array(F.lit("Chile")).alias("countries"), F.lit(None).cast("string").alias("error"))
    ).otherwise(F.struct(F.array_distinct(canonical).alias("countries"), error.alias("error")))


# ---- companies and roles ------------------------------------------------------------------------
def company_tags(tags: Column) -> Column:
    """``struct(sector, size)``: size reads ``N[-M][+] empleados``, sector is the first other tag."""
    size = F.try_element_at(F.filter(tags, lambda t: t.rlike(COMPANY_SIZE)), F.lit(1))
    sector = F.try_element_at(F.filter(tags, lambda t: ~t.eqNullSafe(size)), F.lit(1))
    return F.struct(sector.alias("sector"), size.alias("size"))


def offer_count(text: Column) -> Column:
    """``29 ofertas activas`` -> 29, ``Sin ofertas activas`` -> 0, else NULL."""

    def counted(k: Column) -> Column:
        digits = F.replace(F.regexp_extract(k, ACTIVE_OFFERS, 1), F.lit("."), F.lit(""))
        return F.when(k == "sin ofertas activas", F.lit(0).cast("bigint")).otherwise(digits.try_cast("bigint"))

    return let(fold(text), counted)


def role_pills(roles: Column) -> Column:
    """``struct(pills, violation)``: composed (NFC), trimmed roles and the first rule they break, if any.

    Spark has no composing function, so the role lists go through an Arrow-batched one.
    """
    pills = F.transform(_composed(roles), normalize_space_ends)
    broken = F.transform(pills, lambda p: F.when(p == "", "empty role").when(
        F.contains(p, F.lit(",")), "role holds a comma").when(F.length(p) > MAX_PILL_CHARS, "role too long"))
    too_big = F.when(F.octet_length(F.array_join(pills, ",")) > MAX_PILLS_BYTES, "roles too long together")
    return F.struct(
        pills.alias("pills"),
        F.coalesce(F.try_element_at(F.array_compact(broken), F.lit(1)), too_big).alias("violation"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _composed(roles: pd.Series) -> pd.Series:
    return roles.map(lambda each: None if each is None else [None if r is None else unicodedata.normalize("NFC", r) for r in each])


def normalize_space_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
