"""Captured portal pages -> cards, listings, postings, companies, private lists, outcomes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.folding import fold, let
from vacantia.functions.normalize import company_tags, label_types, offer_count, offer_status, parse_location, parse_salary, posted_at, split_tags
from vacantia.functions.text import to_int, whole_int
from vacantia.functions.urls import build_url, clean_slug, is_strict_slug, slug_from_href, slug_from_link
from vacantia.operators import jsonld
from vacantia.operators.html import (
    Sel, all_texts, anchored, attr, element_table, first_of, first_text, inside, of_role, parse, rich_text, some, within,
)
from vacantia.portal import DEFAULT, Portal

# ---- fixed values: class names, texts and markers of the captured pages --------------------------
CHALLENGE_MARKERS = ("<title>just a moment", "cf-chl", "challenge-platform", "captcha")
HEADINGS = ("h1", "h2", "h3", "h4")
FILE_NAME = r"(?i)^\S(?:.*\S)?\.(?:pdf|docx?|odt|rtf)$"
DATE_TEXT = r"hace [0-9]|[0-9]{1,2} de [a-z]+|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
APPLIED_TEXT = ("postul", DATE_TEXT)
UPDATED_TEXT = ("actualiz|subid|cargad", DATE_TEXT)
VACANCIES = r"(?i)([0-9]+)\s+vacantes?\b"
NEXT_LABEL = "Página siguiente"
EXIT_CODES = {
    "INVALID_ARGUMENT": 1, "AUTH_REQUIRED": 2, "NOT_FOUND": 3, "NETWORK": 4, "RATE_LIMITED": 4, "BLOCKED": 4,
    "BUDGET_EXCEEDED": 4, "SITE_CHANGED": 5, "INTERRUPTED": 130, "INTERNAL": 1,
}


@dataclass(frozen=True)
class CardLayout:
    """Where a listing card keeps its fields; the default is the portal's own markup."""

    card: Sel = Sel("card", tag="div", cls="job-offer-card")
    slug_attr: str = "data-scroll-restore-slug"
    link: Sel = Sel("link", tag="a", attr="href")
    fields: tuple[Sel, ...] = (
        Sel("title", tag="h2", cls="job-offer-card__title"), Sel("title", tag="h2", cls="card-title"),
        Sel("company", tag="p", cls="item-title"), Sel("location", tag="span", cls="break-words"),
        Sel("tag", tag="span", cls="tag-navy"), Sel("salary", tag="span", cls="tag-primary"),
        Sel("age", tag="span", child_of=Sel(cls="item-subtitle")), Sel("span", tag="span", leaf=True),
    )

    @property
    def keep(self) -> tuple[Sel, ...]:
        return (self.card, self.link, *self.fields)


CARDS = CardLayout()
JOB_FRAME = Sel("frame", tag="turbo-frame", id="job_offers_results")
COMPANY_FRAME = Sel("company_frame", tag="turbo-frame", id="companies_marketplace_results")
COMPANY_JOBS_FRAME = Sel("jobs_frame", tag="turbo-frame", id="company_job_offers_results")
NAV = Sel("nav", tag="nav", cls="pagination-nav")
LISTING_KEEP = (
    Sel("count", tag="b", under=Sel(cls="job-offers-results-count")),
    Sel("page_link", tag="a", attr="href", under=Sel(tag="nav", cls="pagination")), Sel("any_link", tag="a", attr="href"),
    NAV, Sel("page_label", tag="a", attr="aria-label", under=NAV), Sel("current", attr="aria-current", prefix="page", under=NAV),
)


# ---- cards --------------------------------------------------------------------------------------
def extract_cards(
    pages: DataFrame, *, layout: CardLayout = CARDS, carry: Sequence[str] = ("page_id", "fetched_at"), portal: Portal = DEFAULT,
) -> DataFrame:
    """Lenient cards: one row per card with a slug (link first, then the data attribute), in page order,
    repeats kept. Cards without a slug (loading skeletons) are skipped."""
    table = element_table(pages, layout.keep, anchor=layout.card, carry=carry)
    linked = F.transform(of_role(F.col("mine"), "link"), lambda h: attr(h, "href"))
    href = F.try_element_at(F.filter(linked, lambda h: h.rlike(r"/job_offers/[^/?#\s]+")), F.lit(1))
    slug = F.coalesce(slug_from_href(href), clean_slug(attr(F.col("card"), layout.slug_attr)))
    # Exploding the slug drops cards without one and computes it once; a filter would be pushed down and repeat it.
    cards = anchored(table, "card").select("*", F.explode(F.array_compact(F.array(slug))).alias("slug"))
    mine = F.col("mine")
    age = F.filter(of_role(mine, "span"), lambda h: F.lower(h["own"]).startswith("hace"))
    rows = cards.withColumns({
        "_location": first_text(mine, "location"), "_tags": all_texts(mine, "tag"),
        "title": F.coalesce(first_of(mine, "title")["text"], F.lit("")), "company": first_text(mine, "company"),
        "posted_relative": F.try_element_at(age, F.lit(1))["text"],
    }).withColumns({"_place": parse_location(F.col("_location")), "_split": split_tags(F.col("_tags"))})
    return rows.select(
        *[c for c in carry if c != "fetched_at"], "pos", "slug", "title", "company", F.col("_location").alias("location_text"),
        "_place.region", "_place.comuna", "_place.country", "_split.workday", "_split.modality", "posted_relative",
        build_url(F.col("slug"), portal=portal).alias("url"), *[c for c in carry if c == "fetched_at"],
    )


def extract_listing_meta(pages: DataFrame, *, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """``(total, last_page)``: the result count and the highest ``page=N`` among the pagination links (all
    links when the page has no pagination nav)."""
    table = element_table(pages, LISTING_KEEP, carry=carry)
    hits = F.col("hits")
    links = F.when(F.size(of_role(hits, "page_link")) > 0, of_role(hits, "page_link")).otherwise(of_role(hits, "any_link"))
    numbers = F.transform(links, lambda h: F.regexp_extract(attr(h, "href"), r"[?&]page=([0-9]+)", 1).try_cast("bigint"))
    return table.select(*carry, to_int(first_of(hits, "count")["text"]).alias("total"), F.array_max(numbers).alias("last_page"))


def pagination(hits: Column) -> Column:
    """``struct(last_page, has_next)`` of the pagination nav: labels or the current page; no nav is page 1."""

    def read(labels: Column) -> Column:
        numbered = F.transform(labels, lambda t: F.regexp_extract(t, r"^Página ([0-9]+)$", 1).try_cast("bigint"))
        current = whole_int(first_of(hits, "current")["text"])
        none = F.size(of_role(hits, "nav")) == 0
        return F.struct(
            F.when(none, F.lit(1).cast("bigint")).otherwise(F.array_max(F.array_compact(F.concat(numbered, F.array(current))))).alias("last_page"),
            (~none & F.array_contains(labels, NEXT_LABEL)).alias("has_next"),
        )

    return let(F.transform(of_role(hits, "page_label"), lambda h: attr(h, "aria-label")), read)


def _strict_card(mine: Column, slug: Column, today: Column, portal: Portal) -> list[Column]:
    ages = F.filter(F.transform(of_role(mine, "age"), lambda h: h["text"]), lambda t: fold(t).startswith("hace"))
    age = F.try_element_at(ages, F.lit(1))
    labels = all_texts(mine, "tag")
    types = label_types(labels)
    return [
        slug.alias("slug"), build_url(slug, portal=portal).alias("url"),
        first_text(F.filter(mine, lambda h: F.array_contains(h["classes"], "job-offer-card__title")), "title").alias("title"),
        first_text(mine, "company").alias("company"), first_text(mine, "location").alias("location"),
        parse_salary(first_text(mine, "salary")).alias("salary"), types["employment_type"].alias("employment_type"),
        types["modality"].alias("modality"), labels.alias("labels"), age.alias("posted_ago"), posted_at(age, today).alias("posted_at_approx"),
    ]


def _sound_hits(frame: str) -> Column:
    """The hits of a page's frame, none (NULL) when the page has a violation. Exploding them drops such pages;
    a filter would be pushed below the verdict and compute it again for every use."""
    return F.when(F.col("violation").isNull(), inside(F.col("hits"), frame))


def _card_frame(judged: DataFrame, frame: str, carry: Sequence[str], today: Column, portal: Portal) -> DataFrame:
    """The cards inside the results frame `frame` of sound pages of an element table anchored on cards."""
    cards = anchored(judged.withColumn("hits", _sound_hits(frame)), "card").where(F.array_contains(F.map_keys(F.col("card.attrs")), CARDS.slug_attr))
    return cards.select(*carry, "pos", *_strict_card(F.col("mine"), attr(F.col("card"), CARDS.slug_attr), today, portal))


def _challenge(html: Column) -> Column:
    lowered = F.lower(html)
    return F.exists(F.array(*map(F.lit, CHALLENGE_MARKERS)), lambda m: F.contains(lowered, m))


@dataclass(frozen=True)
class Extracted:
    """`rows`: the records. `pages`: one row per page with its list facts and `violation`, NULL when sound.
    Rows of pages with a violation are left out."""

    rows: DataFrame
    pages: DataFrame


def _challenged(pages: DataFrame) -> DataFrame:
    """`pages` with the challenge test done, so that no page has to come back from the element pass for it."""
    return pages.withColumn("_challenged", F.coalesce(_challenge(F.col("html")), F.lit(False)))


def _verdict(missing: Column) -> Column:
    """The missing anchor, or ``blocked`` when the page is a challenge instead."""
    return F.when(missing.isNotNull() & F.col("_challenged"), "blocked").otherwise(missing)


def extract_search_page(
    pages: DataFrame, today: Column, *, carry: Sequence[str] = ("page_id", "page"), portal: Portal = DEFAULT,
) -> Extracted:
    """Strict result pages (`page` is the requested number): cards, total, pagination, applied location,
    related roles. `violation` names the missing anchor; a challenge page is ``blocked``."""
    keep = (
        *CARDS.keep, *LISTING_KEEP, JOB_FRAME, Sel("area", tag="input", id="locations"),
        Sel("pill", tag="a", cls="similar-role-suggestion-pill", attr="data-role-name"),
    )
    table = element_table(_challenged(pages), keep, anchor=CARDS.card, carry=[*carry, "_challenged"])
    hits = F.col("hits")

    def facts(scoped: Column) -> Column:
        with_slug = F.filter(of_role(scoped, "card"), lambda h: F.array_contains(F.map_keys(h["attrs"]), CARDS.slug_attr))
        titled = F.transform(
            F.filter(of_role(scoped, "title"), lambda h: F.array_contains(h["classes"], "job-offer-card__title") & (h["text"] != "")), lambda h: h["anchor"])

        def checked(c: Column) -> Column:
            return F.struct(
                whole_int(first_of(scoped, "count")["text"]).alias("total"), pagination(scoped).alias("nav"), F.size(c["cards"]).alias("cards"),
                F.exists(c["cards"], lambda h: ~F.coalesce(is_strict_slug(attr(h, CARDS.slug_attr)), F.lit(False))).alias("bad"),
                F.exists(c["cards"], lambda h: ~F.array_contains(c["titled"], h["pre"])).alias("untitled"))

        return let(F.struct(with_slug.alias("cards"), titled.alias("titled")), checked)

    known = table.withColumns({"_has_frame": first_of(hits, "frame").isNotNull(), "_f": let(inside(hits, "frame"), facts)})
    f = F.col("_f")
    missing = (
        F.when(~F.col("_has_frame"), "turbo-frame#job_offers_results").when(f["total"].isNull(), ".job-offers-results-count b (an integer)")
        .when(f["bad"], "div.job-offer-card[data-scroll-restore-slug] (a job slug)").when(f["untitled"], "h2.job-offer-card__title")
        .when((f["total"] > 0) & (f["cards"] == 0) & (F.col("page") <= F.coalesce(f["nav"]["last_page"], F.lit(1))), "div.job-offer-card[data-scroll-restore-slug]")
    )
    judged = known.withColumn("violation", _verdict(missing))
    report = judged.select(
        *carry, f["total"].alias("total"), f["nav"]["last_page"].alias("last_page"), f["nav"]["has_next"].alias("has_next"),
        effective_location(first_of(hits, "area")).alias("effective_location"), related_pills(hits).alias("related_roles"), f["cards"].alias("cards"), "violation")
    return Extracted(_card_frame(judged, "frame", carry, today, portal), report)


AREA_OPTIONS = "array<struct<id:string,display_path:string,area_type_label:string>>"


def effective_location(node: Column) -> Column:
    """The applied area of the location input: its first value among the JSON options, else NULL."""
    applied = F.btrim(F.substring_index(attr(node, "value"), ",", 1))
    options = F.from_json(attr(node, "data-initial-area-options"), AREA_OPTIONS)
    match = F.try_element_at(F.filter(options, lambda o: (o["id"] == applied) & (applied != "")), F.lit(1))
    return F.when(match["id"].try_cast("bigint").isNotNull() & (F.btrim(match["display_path"]) != ""), F.struct(
        match["id"].try_cast("bigint").alias("id"), F.btrim(match["display_path"]).alias("display_path"), match["area_type_label"].alias("area_type_label")))


def related_pills(hits: Column) -> Column:
    names = F.transform(of_role(hits, "pill"), lambda h: F.btrim(attr(h, "data-role-name")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


# ---- postings -----------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _rich(fragments):
    """Rich text of HTML fragments, a first ``<p>`` reading ``Cargo: …`` left out."""

    def text(fragment):
        if not isinstance(fragment, str):
            return None
        nodes = parse(f"<section>{fragment}</section>")
        body = nodes[0]
        first = next(body.elements(), None)
        if first is not None and first.tag == "p" and first.text().startswith("Cargo:"):
            body.children = [c for c in body.children if c is not first]
        return rich_text(body)

    return fragments.map(text)


JOB_KEEP = (
    Sel("title", tag="h1", under=Sel(cls="job-offer-show-title")), Sel("block", cls="job-offer-show-title"), Sel("card", cls="card"),
    Sel("company_link", tag="a", attr="href", prefix="/companies/", under=Sel(cls="job-offer-show-title")),
    Sel("location", tag="span", cls="break-words"), Sel("tag", tag="span", cls="tag-navy"), Sel("salary", tag="span", cls="tag-primary"),
    Sel("age", tag="span", child_of=Sel(cls="item-subtitle")), Sel("h3", tag="h3"),
    Sel("full", attr="data-text-toggle-target", prefix="fullText", rich=True),
)
SALARY_TYPE = "struct<raw:string,currency:string,min:bigint,max:bigint,period:string>"


def section(hits: Column, heading: str) -> Column:
    """Text of the full-text block in the element right after the h3 reading `heading` (folded)."""
    h3 = F.try_element_at(F.filter(of_role(hits, "h3"), lambda h: fold(h["text"]) == heading), F.lit(1))
    return some(let(h3, lambda h: first_of(within(hits, h["next"], h["next_end"]), "full"))["text"])


def extract_sections(pages: DataFrame, *, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    table = element_table(pages, JOB_KEEP, carry=carry)
    return table.select(*carry, section(F.col("hits"), "descripcion").alias("description_text"), section(F.col("hits"), "requerimientos").alias("requirements_text"))


def _strict_number(v: Column) -> Column:
    """A JSON number, fraction dropped, or a digit string."""
    text = jsonld.text_at(v, "$")
    return F.when(jsonld.is_number(v), F.try_variant_get(v, "$", "decimal(38,6)").cast("bigint")).when(
        F.btrim(text).rlike("^[0-9]+$"), F.btrim(text).try_cast("bigint"))


def _strict_salary(base: Column, raw: Column) -> Column:
    quantity = F.variant_get(base, "$.value", "variant")
    nested = jsonld.is_object(quantity)
    bare = F.when(~nested, _strict_number(quantity))
    low = F.when(nested, let(F.coalesce(F.variant_get(quantity, "$.minValue", "variant"), F.variant_get(quantity, "$.value", "variant")), _strict_number))
    high = F.when(nested, let(F.coalesce(F.variant_get(quantity, "$.maxValue", "variant"), F.variant_get(quantity, "$.value", "variant")), _strict_number))
    currency = F.nullif(F.btrim(jsonld.text_at(base, "$.currency")), F.lit(""))
    unit = F.lower(F.nullif(F.btrim(jsonld.text_at(quantity, "$.unitText")), F.lit("")))

    def built(s: Column) -> Column:
        known = s["low"].isNotNull() | s["high"].isNotNull() | s["currency"].isNotNull()
        return F.when(jsonld.is_object(base) & known, F.struct(
            raw.alias("raw"), s["currency"].alias("currency"), s["low"].alias("min"), s["high"].alias("max"), s["unit"].alias("period")))

    return let(F.struct(F.coalesce(low, bare).alias("low"), F.coalesce(high, bare).alias("high"), currency.alias("currency"), unit.alias("unit")), built)


def _links(v: Column) -> Column:
    """A text or a list of texts as an array."""
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array_compact(F.array(jsonld.text_at(v, "$"))), F.array().cast("array<string>"))


def extract_postings(
    pages: DataFrame, today: Column, *, carry: Sequence[str] = ("page_id", "slug"), portal: Portal = DEFAULT,
) -> DataFrame:
    """Job pages -> postings: JSON-LD gives ids, dates, salary, type, address, company; the visible page
    gives location, labels, modality, vacancies, age and sections. Both halves come from the same row, so
    merging needs no join. `warning` marks pages without JSON-LD; `violation` those with neither a title
    nor a posting."""
    table = element_table(_challenged(pages).withColumn("_blocks", jsonld.page_blocks(F.col("html"))), JOB_KEEP, carry=[*carry, "_challenged", "_blocks"])
    hits = F.col("hits")
    header = let(first_of(hits, "block"), lambda block: F.coalesce(F.try_element_at(F.filter(
        of_role(hits, "card"), lambda c: (c["pre"] <= block["pre"]) & (c["end"] >= block["end"])), F.lit(-1)), block))
    objects = jsonld.block_objects(F.col("_blocks"))
    step = table.withColumns({"_objects": objects, "_header": header}).withColumns({
        "_ld": jsonld.of_type(F.col("_objects"), "JobPosting"), "_crumbs": jsonld.of_type(F.col("_objects"), "BreadcrumbList"),
        "_mine": within(hits, F.col("_header.pre"), F.col("_header.end")),
    })
    ld, mine = F.col("_ld"), F.col("_mine")
    ages = F.filter(F.transform(of_role(mine, "age"), lambda h: h["text"]), lambda t: fold(t).startswith("hace"))
    raw_salary = first_text(mine, "salary")
    crumb = F.try_element_at(F.filter(
        F.try_variant_get(F.col("_crumbs"), "$.itemListElement", "array<variant>"), lambda i: F.try_variant_get(i, "$.position", "int") == 3), F.lit(1))
    crumb_item = F.variant_get(crumb, "$.item", "variant")
    crumb_url = F.coalesce(jsonld.text_at(crumb_item, "$['@id']"), jsonld.text_at(crumb_item, "$"))
    link = first_of(hits, "company_link")
    candidates = F.concat(_links(F.variant_get(ld, "$.hiringOrganization.sameAs", "variant")), F.array_compact(F.array(crumb_url, attr(link, "href"))))
    company_slug = F.try_element_at(F.array_compact(F.transform(candidates, lambda u: slug_from_link(u, "company", portal))), F.lit(1))
    employment = F.try_element_at(F.filter(
        F.transform(_links(F.variant_get(ld, "$.employmentType", "variant")), F.lower),
        lambda t: t.isin("full_time", "part_time", "contractor", "intern", "per_diem", "other")), F.lit(1))
    place = F.coalesce(F.variant_get(ld, "$.jobLocation[0].address", "variant"), F.variant_get(ld, "$.jobLocation.address", "variant"))
    trimmed = lambda v, path: F.nullif(F.btrim(jsonld.text_at(v, path)), F.lit(""))
    address = F.struct(
        trimmed(place, "$.addressLocality").alias("locality"), trimmed(place, "$.addressRegion").alias("region"),
        F.coalesce(trimmed(place, "$.addressCountry.name"), trimmed(place, "$.addressCountry")).alias("country"))
    offer_ids = F.transform(
        F.coalesce(F.try_variant_get(ld, "$.identifier", "array<variant>"), F.array(F.variant_get(ld, "$.identifier", "variant"))),
        lambda i: let(F.when(jsonld.is_object(i), F.variant_get(i, "$.value", "variant")).otherwise(i), _strict_number))
    labels = all_texts(mine, "tag")
    types = label_types(labels)
    iso_date = lambda path: F.left(F.btrim(jsonld.text_at(ld, path)), F.lit(10))
    dated = lambda path: F.when(iso_date(path).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), iso_date(path).try_cast("date"))
    direct = F.variant_get(ld, "$.directApply", "variant")
    age = F.try_element_at(ages, F.lit(1))
    title = F.coalesce(first_text(hits, "title"), trimmed(ld, "$.title"))
    rows = step.withColumns({
        "_card_salary": parse_salary(raw_salary).cast(SALARY_TYPE), "_ld_salary": _strict_salary(F.variant_get(ld, "$.baseSalary", "variant"), raw_salary).cast(SALARY_TYPE),
        "_types": types, "_valid": dated("$.validThrough"), "_address": address, "_section": section(hits, "descripcion"),
        "_ld_text": jsonld.text_at(ld, "$.description"), "company_slug": company_slug, "title": title,
    })
    description = F.coalesce(F.col("_section"), _rich(F.when(F.col("_section").isNull(), F.col("_ld_text"))), F.lit(""))
    missing = _verdict(F.when(F.col("title").isNull(), ".job-offer-show-title h1 (or a JSON-LD JobPosting)"))
    return rows.select(
        *carry, build_url(F.col("slug"), portal=portal).alias("url"), "title",
        F.coalesce(trimmed(ld, "$.hiringOrganization.name"), some(link["text"])).alias("company"), first_text(mine, "location").alias("location"),
        F.coalesce(F.col("_ld_salary"), F.col("_card_salary")).alias("salary"),
        F.coalesce(employment, F.col("_types.employment_type")).alias("employment_type"), F.col("_types.modality").alias("modality"),
        labels.alias("labels"), age.alias("posted_ago"), posted_at(age, today).alias("posted_at_approx"),
        F.try_element_at(F.array_compact(offer_ids), F.lit(1)).alias("offer_id"), "company_slug",
        build_url(F.col("company_slug"), "company", portal).alias("company_url"),
        F.when(F.coalesce(F.col("_address.locality"), F.col("_address.region"), F.col("_address.country")).isNotNull(), F.col("_address")).alias("address"),
        trimmed(ld, "$.workHours").alias("work_hours"),
        F.regexp_extract(F.coalesce(F.col("_header.text"), F.lit("")), VACANCIES, 1).try_cast("int").alias("vacancies"),
        dated("$.datePosted").alias("date_posted"), F.col("_valid").alias("valid_through"), offer_status(F.col("_valid"), today).alias("status"),
        F.when(F.schema_of_variant(direct) == "BOOLEAN", F.try_variant_get(direct, "$", "boolean")).alias("direct_apply"),
        description.alias("description_text"), section(hits, "requerimientos").alias("requirements_text"), F.lit(False).alias("text_truncated"),
        F.when(ld.isNull(), "the job page has no JSON-LD JobPosting; parsed the visible page only").alias("warning"), missing.alias("violation"),
    )


# ---- companies ----------------------------------------------------------------------------------
COMPANY_CARD = Sel("card", tag="a", cls="company-card", attr="href", prefix="/companies/")
COMPANY_KEEP = (
    COMPANY_FRAME, COMPANY_CARD, Sel("total", tag="b", cls="text-primary"), Sel("name", cls="company-card__name"),
    Sel("location", tag="span", under=Sel(cls="company-card__location")), Sel("tag", tag="span", cls="tag-navy", under=Sel(cls="company-card__tags")),
    Sel("offers", cls="company-card__offers"), Sel("place", tag="span", under=Sel(cls="company-card__offer-locations")), *LISTING_KEEP,
)


def extract_companies(pages: DataFrame, *, carry: Sequence[str] = ("page_id",), portal: Portal = DEFAULT) -> Extracted:
    """Directory pages -> company cards (loading skeletons are not links and never match)."""
    table = element_table(_challenged(pages), COMPANY_KEEP, anchor=COMPANY_CARD, carry=[*carry, "_challenged"])
    scoped = table.withColumns({"_frame": first_of(F.col("hits"), "company_frame").isNotNull(), "hits": inside(F.col("hits"), "company_frame")})

    def facts(hits: Column) -> Column:
        named = F.transform(of_role(hits, "name"), lambda h: h["anchor"])
        return F.struct(
            whole_int(first_of(hits, "total")["text"]).alias("total"), pagination(hits).alias("nav"),
            F.exists(of_role(hits, "card"), lambda h: slug_from_link(attr(h, "href"), "company", portal).isNull()).alias("bad"),
            let(named, lambda n: F.exists(of_role(hits, "card"), lambda h: ~F.array_contains(n, h["pre"]))).alias("unnamed"))

    known = scoped.withColumn("_f", let(F.col("hits"), facts))
    f = F.col("_f")
    missing = (
        F.when(~F.col("_frame"), "turbo-frame#companies_marketplace_results").when(f["total"].isNull(), "b.text-primary (an integer) in the results frame")
        .when(f["bad"], 'a.company-card[href^="/companies/"] (a company slug)').when(f["unnamed"], ".company-card__name"))
    judged = known.withColumn("violation", _verdict(missing))
    mine = F.col("mine")
    tags = company_tags(all_texts(mine, "tag"))
    cards = anchored(judged.withColumn("hits", F.when(F.col("violation").isNull(), F.col("hits"))), "card").withColumn("slug", slug_from_link(attr(F.col("card"), "href"), "company", portal))
    rows = cards.select(
        *carry, "pos", "slug", build_url(F.col("slug"), "company", portal).alias("url"), first_of(mine, "name")["text"].alias("name"),
        first_text(mine, "location").alias("location"), tags["sector"].alias("sector"), tags["size"].alias("size"),
        offer_count(first_of(mine, "offers")["text"]).alias("active_offers"),
        F.filter(F.transform(of_role(mine, "place"), lambda h: h["own"]), lambda t: t != "").alias("offer_locations"))
    return Extracted(rows, judged.select(
        *carry, f["total"].alias("total"), f["nav"]["last_page"].alias("last_page"), f["nav"]["has_next"].alias("has_next"), "violation"))


def extract_company_page(
    pages: DataFrame, today: Column, *, carry: Sequence[str] = ("page_id", "page"), portal: Portal = DEFAULT,
) -> Extracted:
    """Company pages -> its job cards (`rows`) and name, location, offer count, paging, cards (`pages`)."""
    keep = (
        *CARDS.keep, *LISTING_KEEP, COMPANY_JOBS_FRAME, Sel("h1", tag="h1"), Sel("caption", tag="span", under=Sel(tag="div", cls="text-caption")),
        Sel("gray", tag="div", cls="text-gray"), Sel("offers", tag="h2", cls="subsection-header", under=Sel(id="section-job-offers")),
    )
    table = element_table(_challenged(pages), keep, anchor=CARDS.card, carry=[*carry, "_challenged"])
    hits = F.col("hits")
    gray = F.filter(of_role(hits, "gray"), lambda g: F.array_contains(g["classes"], "text-caption"))
    location = let(gray, lambda areas: F.try_element_at(F.filter(
        of_role(hits, "caption"), lambda s: F.exists(areas, lambda g: (s["pre"] > g["pre"]) & (s["pre"] <= g["end"]))), F.lit(1)))
    missing = F.when(first_of(hits, "h1").isNull(), "h1").when(first_of(hits, "jobs_frame").isNull(), "turbo-frame#company_job_offers_results")
    judged = table.withColumns({"_nav": let(inside(hits, "jobs_frame"), pagination), "violation": _verdict(missing)})
    slugged = let(inside(hits, "jobs_frame"), lambda scoped: F.filter(of_role(scoped, "card"), lambda h: F.array_contains(F.map_keys(h["attrs"]), CARDS.slug_attr)))
    report = judged.select(
        *carry, first_of(hits, "h1")["text"].alias("name"), some(location["text"]).alias("location"),
        offer_count(first_of(hits, "offers")["text"]).alias("active_offers"), F.col("_nav.has_next").alias("has_more"),
        F.when(F.col("_nav.has_next"), F.col("page") + 1).alias("next_page"), F.size(slugged).alias("cards"), "violation")
    return Extracted(_card_frame(judged, "jobs_frame", carry, today, portal), report)


# ---- private pages ------------------------------------------------------------------------------
LINK_KEEP = (Sel("link", tag="a", attr="href"), Sel("heading", tag=HEADINGS), Sel("heading", cls="card-title"))


def _offer_links(hits: Column, portal: Portal) -> Column:
    """The first link per offer outside header, nav and footer, in page order, as hits with `slug`."""
    content = F.filter(of_role(hits, "link"), lambda h: ~h["chrome"])
    slugged = F.transform(content, lambda h: F.struct(slug_from_link(attr(h, "href"), "job", portal).alias("slug"), h.alias("hit")))

    def firsts(links: Column) -> Column:
        return let(F.transform(links, lambda s: s["slug"]), lambda slugs: F.filter(links, lambda s, i: F.array_position(slugs, s["slug"]) == i + 1))

    return let(F.filter(slugged, lambda s: s["slug"].isNotNull()), firsts)


def harvest_offer_links(pages: DataFrame, *, carry: Sequence[str] = ("page_id",), portal: Portal = DEFAULT) -> DataFrame:
    """Offer links of any page: ``(pos, slug, url, title)``, title from a heading in the link or its text."""
    table = element_table(pages, LINK_KEEP, carry=carry)
    rows = table.select(*carry, "hits", F.posexplode(_offer_links(F.col("hits"), portal)).alias("pos", "link"))
    heading = first_of(within(F.col("hits"), F.col("link.hit.pre"), F.col("link.hit.end")), "heading")["text"]
    return rows.select(
        *carry, "pos", "link.slug", build_url(F.col("link.slug"), portal=portal).alias("url"),
        some(F.coalesce(some(heading), F.col("link.hit.text"))).alias("title")).where(F.col("title").isNotNull())


def _class_boxes(hits: Column, word: str) -> Column:
    """Innermost elements with a `word` / `word-*` class (no ``__`` part) that hold a heading."""
    named = F.filter(of_role(hits, "box"), lambda h: F.exists(h["classes"], lambda c: (c == word) | (c.startswith(f"{word}-") & ~F.contains(c, F.lit("__")))))
    headed = let(of_role(hits, "heading"), lambda titles: F.filter(named, lambda h: F.exists(titles, lambda t: (t["pre"] >= h["pre"]) & (t["pre"] <= h["end"]))))
    return let(headed, lambda boxes: F.filter(boxes, lambda h: ~F.exists(boxes, lambda o: (o["pre"] > h["pre"]) & (o["pre"] <= h["end"]))))


def _leaf_text(mine: Column, patterns: Sequence[str]) -> Column:
    """The first leaf text matching the first pattern that matches any."""
    def found(texts: Column) -> Column:
        first = lambda pattern: F.try_element_at(F.filter(texts, lambda t: t["folded"].rlike(pattern)), F.lit(1))["text"]
        return F.coalesce(*map(first, patterns))

    return let(F.transform(all_texts(mine, "leaf"), lambda t: F.struct(t.alias("text"), fold(t).alias("folded"))), found)


def _status_text(mine: Column) -> Column:
    """An element classed status/estado, else a coloured tag that is neither a label nor a salary."""
    named = F.filter(of_role(mine, "box"), lambda h: F.exists(h["classes"], lambda c: c.rlike("status|estado")) & (h["text"] != ""))
    coloured = F.filter(of_role(mine, "box"), lambda h: (h["tag"] == "span") & F.contains(F.array_join(h["classes"], " "), F.lit("tag-"))
                        & ~F.arrays_overlap(h["classes"], F.array(F.lit("tag-navy"), F.lit("tag-primary"))) & (h["text"] != ""))
    return F.coalesce(F.try_element_at(named, F.lit(1))["text"], F.try_element_at(coloured, F.lit(1))["text"])


BOX_KEEP = (
    *LINK_KEEP, Sel("leaf", leaf=True), Sel("box", attr="class"), Sel("company", tag="p", cls="item-title"),
    Sel("company_link", tag="a", attr="href", prefix="/companies/"),
)


def extract_applications(pages: DataFrame, *, carry: Sequence[str] = ("page_id",), portal: Portal = DEFAULT) -> DataFrame:
    """One row per offer link's box: title, company, applied text, status text as shown; pages without
    offer links fall back to ``.application-*`` boxes. Never deduplicated across pages."""
    return _application_rows(element_table(pages, BOX_KEEP, carry=carry), carry, portal)


def _application_rows(table: DataFrame, carry: Sequence[str], portal: Portal) -> DataFrame:
    by_link = F.transform(_offer_links(F.col("hits"), portal), lambda s: F.struct(
        s["slug"].alias("slug"), s["hit"]["box"].alias("start"), s["hit"]["box_end"].alias("end"), s["hit"]["text"].alias("fallback")))
    by_class = F.transform(_class_boxes(F.col("hits"), "application"), lambda h: F.struct(
        F.lit(None).cast("string").alias("slug"), h["pre"].alias("start"), h["end"].alias("end"), F.lit("").alias("fallback")))

    def rows(boxes: Column) -> Column:
        def row(b: Column) -> Column:
            return let(within(F.col("hits"), b["start"], b["end"]), lambda mine: F.struct(
                b["slug"].alias("slug"), some(F.coalesce(first_text(mine, "heading"), b["fallback"])).alias("title"),
                F.coalesce(first_text(mine, "company"), first_text(mine, "company_link")).alias("company"),
                _leaf_text(mine, APPLIED_TEXT).alias("applied_at_text"), _status_text(mine).alias("status_text")))

        return F.filter(F.transform(boxes, row), lambda r: r["title"].isNotNull())

    chosen = table.withColumn("_links", rows(by_link)).withColumn("_rows", F.when(F.size("_links") > 0, F.col("_links")).otherwise(rows(by_class)))
    return chosen.select(*carry, F.posexplode("_rows").alias("pos", "_row")).select(
        *carry, "pos", "_row.slug", build_url(F.col("_row.slug"), portal=portal).alias("url"), "_row.title", "_row.company", "_row.applied_at_text", "_row.status_text")


def extract_cv_metadata(pages: DataFrame, *, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """CV names (file-name shaped leaf texts, one per box) with their updated text; else ``.cv-*`` headings."""
    return _cv_rows(element_table(pages, BOX_KEEP, carry=carry), carry)


def _cv_rows(table: DataFrame, carry: Sequence[str]) -> DataFrame:
    hits = F.col("hits")
    files = F.filter(of_role(hits, "leaf"), lambda h: (F.length(h["text"]) <= 255) & h["text"].rlike(FILE_NAME) & ~h["chrome"])
    firsts = let(files, lambda named: let(F.transform(named, lambda h: h["box"]), lambda boxes: F.filter(named, lambda h, i: F.array_position(boxes, h["box"]) == i + 1)))
    named = F.transform(firsts, lambda h: F.struct(h["text"].alias("name"), h["box"].alias("start"), h["box_end"].alias("end")))
    classed = F.filter(F.transform(_class_boxes(hits, "cv"), lambda h: F.struct(
        first_text(within(hits, h["pre"], h["end"]), "heading").alias("name"), h["pre"].alias("start"), h["end"].alias("end"))), lambda r: r["name"].isNotNull())
    rows = table.select(*carry, "hits", F.posexplode(F.when(F.size(named) > 0, named).otherwise(classed)).alias("pos", "_cv"))
    return rows.select(*carry, "pos", "_cv.name", _leaf_text(within(hits, F.col("_cv.start"), F.col("_cv.end")), UPDATED_TEXT).alias("updated_at_text"))


SAVED_KEEP = (*CARDS.keep, *LINK_KEEP[1:])
NAV_KEEP = LISTING_KEEP[3:]


def _saved_rows(table: DataFrame, carry: Sequence[str], today: Column, portal: Portal) -> DataFrame:
    """Search cards with a slug and a title, all fields; a page without any gives its offer links."""
    hits = F.col("hits")
    titled = F.transform(
        F.filter(of_role(hits, "title"), lambda h: F.array_contains(h["classes"], "job-offer-card__title") & (h["text"] != "")), lambda h: h["anchor"])
    sound = let(titled, lambda known: F.filter(of_role(hits, "card"), lambda h: F.coalesce(
        is_strict_slug(attr(h, CARDS.slug_attr)), F.lit(False)) & F.array_contains(known, h["pre"])))

    def entries(found: Column, is_card: bool, slug, hit) -> Column:
        return F.transform(found, lambda e: F.struct(
            F.lit(is_card).alias("card"), slug(e).alias("slug"), hit(e)["pre"].alias("start"), hit(e)["end"].alias("end"), hit(e)["text"].alias("text")))

    cards = entries(sound, True, lambda h: attr(h, CARDS.slug_attr), lambda h: h)
    links = entries(_offer_links(hits, portal), False, lambda s: s["slug"], lambda s: s["hit"])
    chosen = table.withColumn("_cards", cards).withColumn("_entries", F.when(F.size("_cards") > 0, F.col("_cards")).otherwise(links))
    rows = chosen.select(*carry, "hits", F.posexplode("_entries").alias("pos", "_e"))
    mine = F.when(F.col("_e.card"), F.filter(hits, lambda h: h["anchor"] == F.col("_e.start"))).otherwise(F.slice(hits, 1, 0))
    heading = first_of(within(hits, F.col("_e.start"), F.col("_e.end")), "heading")["text"]
    link_title = F.when(~F.col("_e.card"), F.coalesce(some(heading), some(F.col("_e.text"))))
    listed = rows.withColumn("_mine", mine).withColumn("_link_title", link_title)
    fields = listed.select(*carry, "pos", "_link_title", *_strict_card(F.col("_mine"), F.col("_e.slug"), today, portal))
    return fields.withColumn("title", F.coalesce("title", "_link_title")).drop("_link_title").where(F.col("title").isNotNull())


PRIVATE_KEEP = {"saved_jobs": SAVED_KEEP, "applications": BOX_KEEP, "cvs": BOX_KEEP}


def _list_facts(table: DataFrame, carry: Sequence[str]) -> DataFrame:
    return table.withColumn("_nav", pagination(F.col("hits"))).select(
        *carry, "_nav.last_page", "_nav.has_next", F.when(F.col("_anonymous"), "AUTH_REQUIRED").alias("violation"))


def private_list_facts(pages: DataFrame, *, carry: Sequence[str] = ("page_id",)) -> DataFrame:
    """``last_page``, ``has_next`` and ``violation`` of private pages of any kind, without their rows: the facts stand in
    the header and the navigation, so one pass over a page that keeps only those serves all kinds."""
    marked = pages.withColumn("_anonymous", F.coalesce(is_anonymous(F.col("html")), F.lit(False)))
    return _list_facts(element_table(marked, NAV_KEEP, carry=[*carry, "_anonymous"]), carry)


def extract_private_list(
    pages: DataFrame, kind: str, today: Column | None = None, *, carry: Sequence[str] = ("page_id",), portal: Portal = DEFAULT,
) -> Extracted:
    """Pages of a private list (``saved_jobs``, ``applications`` or ``cvs``) with their list facts.

    `pages` has ``last_page`` and ``has_next`` of every page; `violation` is AUTH_REQUIRED where the site header asks to
    sign in, so that an ended session never looks like an empty list. `today` dates the ages of saved cards.
    """
    if kind not in PRIVATE_KEEP:
        raise ValueError(f"private lists are {', '.join(PRIVATE_KEEP)}")
    if kind == "saved_jobs" and today is None:
        raise ValueError("saved offers need the day of the capture")
    marked = pages.withColumn("_anonymous", F.coalesce(is_anonymous(F.col("html")), F.lit(False)))
    anchor = CARDS.card if kind == "saved_jobs" else None
    table = element_table(marked, (*PRIVATE_KEEP[kind], *NAV_KEEP), anchor=anchor, carry=[*carry, "_anonymous"])
    report = _list_facts(table, carry)
    sound = table.withColumn("hits", F.when(~F.col("_anonymous"), F.col("hits")))
    if kind == "saved_jobs":
        return Extracted(_saved_rows(sound, carry, today, portal), report)
    return Extracted(_application_rows(sound, carry, portal) if kind == "applications" else _cv_rows(sound, carry), report)


# ---- outcomes -----------------------------------------------------------------------------------
def page_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([^\"'\s>]*)", 1)


def is_anonymous(html: Column) -> Column:
    """Whether the site header links to the sign-in page."""
    header = F.regexp_extract(html, r"(?is)<header\b[^>]*\bid=[\"']?main-header\b[^>]*>(.*?)</header\s*>", 1)
    return F.contains(html, F.lit("/users/sign_in")) & header.rlike(r"(?i)<a\b[^>]*\bhref=[\"']?/users/sign_in[\"'\s>]")


def classify_pages(pages: DataFrame, *, html: str = "html", status: str = "status", private: Column | None = None) -> DataFrame:
    """`outcome` (an error code or OK), `exit_code` and `locale_warning` of every captured page.

    `private` marks pages that need a session: only there does an anonymous header mean AUTH_REQUIRED.
    """
    code, body = F.col(status), F.col(html)
    challenged = code.isin(403, 429, 503) & _challenge(body)
    outcome = F.when(challenged | (code == 403), "BLOCKED").when(code == 429, "RATE_LIMITED").when(code.isin(404, 410), "NOT_FOUND").when(
        code >= 500, "NETWORK").when(code != 200, "SITE_CHANGED")
    if private is not None:
        outcome = outcome.when(private & is_anonymous(body), "AUTH_REQUIRED")
    language = page_language(body)
    exits = F.create_map(*[x for k, v in EXIT_CODES.items() for x in (F.lit(k), F.lit(v))])
    warning = F.when((code == 200) & ~F.lower(language).startswith("es"), F.concat(F.lit("page language is "), F.when(language == "", "missing").otherwise(language)))
    named = pages.withColumn("outcome", outcome.otherwise("OK"))
    return named.withColumn("exit_code", F.coalesce(F.try_element_at(exits, F.col("outcome")), F.lit(0))).withColumn("locale_warning", warning)


# ---- JSON bodies --------------------------------------------------------------------------------
AREA = "struct<id:bigint,name:string,display_path:string,area_type:string,area_type_label:string,offer_count:bigint,depth:int,visitor_country_match:boolean>"
JSON_KINDS = {
    "areas": (f"struct<areas:array<{AREA}>>", "areas"),
    "similar": ("struct<items:array<string>,resolved_name:string,next_page:int>", "items"),
    "suggestions": ("struct<results:array<struct<hits:array<struct<query:string,popularity:bigint>>>>>", "results"),
}


def read_json_api(bodies: DataFrame, kind: str, *, body: str = "body", content_type: str = "content_type", carry: Sequence[str] = ("page_id",)) -> Extracted:
    """Captured JSON bodies of one kind -> rows in server order; a missing list is a violation."""
    schema, _ = JSON_KINDS[kind]
    is_json = F.lower(F.btrim(F.substring_index(F.col(content_type), ";", 1))) == "application/json"
    parsed = bodies.withColumn("_doc", F.when(is_json, F.from_json(F.col(body), schema)))
    items = {"areas": F.col("_doc.areas"), "similar": F.col("_doc.items"), "suggestions": F.try_element_at(F.col("_doc.results"), F.lit(1))["hits"]}[kind]
    listed = parsed.withColumn("_items", items)
    violation = F.when(F.col("_items").isNull(), F.when(_challenge(F.col(body)), "blocked").otherwise(f"{kind} response without its list"))
    if kind == "areas":
        broken = F.exists("_items", lambda a: a["id"].isNull() | (F.coalesce(F.btrim(a["name"]), F.lit("")) == "") | (F.coalesce(F.btrim(a["display_path"]), F.lit("")) == ""))
        violation = F.coalesce(violation, F.when(broken, "areas without id, name or display_path"))
    report = listed.select(*carry, violation.alias("violation"))
    rows = listed.where(violation.isNull()).select(*carry, F.posexplode("_items").alias("pos", "item"))
    if kind == "similar":
        rows = rows.select(*carry, "pos", F.btrim("item").alias("role")).where(F.col("role") != "")
    elif kind == "suggestions":
        rows = rows.select(*carry, "pos", F.btrim("item.query").alias("query"), "item.popularity").where(F.col("query") != "")
    else:
        rows = rows.select(*carry, "pos", "item.*")
    return Extracted(rows, report)
