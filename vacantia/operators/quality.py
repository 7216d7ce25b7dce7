"""Data-quality jobs: table contracts and required page anchors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.urls import is_strict_slug
from vacantia.operators.html import Sel, element_table
from vacantia.operators.jsonld import all_of_type, page_objects
from vacantia.schemas import ENUMS

_OFFERS = Sel(tag="turbo-frame", id="job_offers_results")
_COMPANIES = Sel(tag="turbo-frame", id="companies_marketplace_results")
# ---- fixed values: anchors every kind of page must show; one of the elements, or (None) a JSON-LD JobPosting -----
ANCHORS = {
    "search": (("turbo-frame#job_offers_results", (_OFFERS,)), (".job-offers-results-count b", (Sel(tag="b", under=Sel(cls="job-offers-results-count", under=_OFFERS)),))),
    "companies": (("turbo-frame#companies_marketplace_results", (_COMPANIES,)), ("b.text-primary", (Sel(tag="b", cls="text-primary", under=_COMPANIES),))),
    "company": (("h1", (Sel(tag="h1"),)), ("turbo-frame#company_job_offers_results", (Sel(tag="turbo-frame", id="company_job_offers_results"),))),
    "job": (("JSON-LD JobPosting or .job-offer-show-title h1", (None, Sel(tag="h1", under=Sel(cls="job-offer-show-title")), Sel(tag="h1", cls="job-offer-show-title"))),),
}


def contract_rules(df: DataFrame, expected: T.StructType, enums: dict[str, Sequence[str]] = ENUMS, slug: str | None = "slug") -> dict[str, Column]:
    """Name -> whether a row breaks the rule: unknown enum values, invalid slug, inconsistent paging."""
    rules = {}
    for name, values in enums.items():
        if name in df.columns and name in expected.fieldNames():
            rules[f"enum:{name}"] = F.col(name).isNotNull() & ~F.col(name).isin(*values)
    if slug and slug in df.columns:
        rules["slug"] = ~F.coalesce(is_strict_slug(F.col(slug)), F.lit(False))
    if {"has_more", "next_page", "next_offset"} <= set(df.columns):
        more = F.col("has_more")
        rules["paging"] = (more != F.col("next_page").isNotNull()) | (more != F.col("next_offset").isNotNull())
    return rules


def contract_report(df: DataFrame, expected: T.StructType, *, enums: dict[str, Sequence[str]] = ENUMS, slug: str | None = "slug") -> DataFrame:
    """``(rule, violations)``: columns missing, unknown or of another type (from the schema alone), and the
    rows breaking each value rule (one pass)."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    wanted = {f.name: f.dataType for f in expected.fields}
    facts = [(f"missing:{n}", 1) for n in wanted if n not in actual] + [(f"unknown:{n}", 1) for n in actual if n not in wanted] + [
        (f"type:{n}", 1) for n in wanted if n in actual and actual[n] != wanted[n]]
    rules = contract_rules(df, expected, enums, slug)
    counted = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()], F.count("*").alias("_rows"))
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
    pairs += [F.struct(F.lit(n).alias("rule"), F.lit(v).cast("bigint").alias("violations")) for n, v in facts]
    return counted.select(F.inline(F.array(*pairs))) if pairs else counted.select(F.lit("").alias("rule"), F.lit(0).cast("bigint").alias("violations")).limit(0)


def anchor_report(pages: DataFrame, *, kind: str = "kind", html: str = "html", anchors: dict = ANCHORS, challenged: Column | None = None) -> DataFrame:
    """``(kind, anchor, verdict, pages)``: how many pages of each kind lack which required anchor;
    ``blocked`` instead of ``site_changed`` on challenge pages. Pages with all anchors are ``ok``."""
    from vacantia.operators.extract import _challenge

    places = [(k, name, [(f"{k}.{i}.{j}", sel) for j, sel in enumerate(found)]) for k, rules in anchors.items() for i, (name, found) in enumerate(rules)]
    keep = [replace(sel, role=role) for _, _, found in places for role, sel in found if sel is not None]
    blocked = challenged if challenged is not None else _challenge(F.col(html))
    posting = F.contains(html, F.lit("ld+json")) & (F.size(all_of_type(page_objects(F.col(html)), "JobPosting")) > 0)
    facts = pages.select(F.col(kind).alias("kind"), F.col(html).alias("html"), F.coalesce(blocked, F.lit(False)).alias("_blocked"), F.coalesce(posting, F.lit(False)).alias("_posting"))
    table = element_table(facts, keep, carry=["kind", "_blocked", "_posting"]).withColumn("_roles", F.transform("hits", lambda h: h["role"]))

    def shown(found: list) -> Column:
        tests = [F.col("_posting") if sel is None else F.array_contains("_roles", role) for role, sel in found]
        return reduce(lambda x, y: x | y, tests)

    missing = F.array_compact(F.array(*[F.when((F.col("kind") == k) & ~shown(found), name) for k, name, found in places]))
    judged = table.select("kind", F.try_element_at(missing, F.lit(1)).alias("anchor"), "_blocked")
    verdict = F.when(F.col("anchor").isNull(), "ok").when(F.col("_blocked"), "blocked").otherwise("site_changed")
    return judged.groupBy("kind", "anchor", verdict.alias("verdict")).agg(F.count("*").alias("pages"))
