"""Slugs and URLs: extraction by the three slug grammars, building, guarding, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let
from vacantia.portal import DEFAULT, FORBIDDEN_PARAMS, PREFIXES, Portal

# ---- fixed values: slug grammars ----------------------------------------------------------------
LENIENT_SLUG = r"(?U)^\w[\w.~-]*$"
STRICT_SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
STRICT_SLUG_MAX = 200
LISTED_SLUG = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,254}$"
JOB_IN_PATH = r"/job_offers/([^/?#\s]+)"

_URL = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def url_part(url: Column, part: str) -> Column:
    """``scheme`` / ``host`` / ``path`` / ``query`` of any text read as a URL reference ('' when absent)."""
    return F.regexp_extract(url, _URL, {"scheme": 1, "host": 2, "path": 3, "query": 4}[part])


def unquote(text: Column) -> Column:
    """Percent-decoding; ``+`` and stray ``%`` signs are kept as they are."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    return F.when(F.contains(text, F.lit("%")), F.url_decode(safe)).otherwise(text)


def quote_plus(text: Column) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def quote_segment(text: Column) -> Column:
    """`text` percent-encoded so that it stays one path segment."""
    return F.replace(quote_plus(text), F.lit("+"), F.lit("%20"))


def slug_from_href(href: Column) -> Column:
    """Crawler grammar: the segment after ``/job_offers/`` anywhere in a link."""
    return clean_slug(F.regexp_extract(href, JOB_IN_PATH, 1))


def clean_slug(raw: Column) -> Column:
    return let(unquote(F.btrim(raw)), lambda slug: F.when(slug.rlike(LENIENT_SLUG), slug))


def is_strict_slug(slug: Column) -> Column:
    return (F.length(slug) <= STRICT_SLUG_MAX) & slug.rlike(STRICT_SLUG)


def _allowed(slug: Column, kind: str, portal: Portal) -> Column:
    valid = is_strict_slug(slug)
    return valid & ~slug.isin(*portal.reserved) if kind == "company" else valid


def slug_from_input(text: Column, kind: str = "job", portal: Portal = DEFAULT) -> Column:
    """Client grammar: a bare slug or an https link to the `kind` page of the portal, else NULL."""
    prefix = f"/{PREFIXES[kind]}/"

    def resolved(s: Column) -> Column:
        path = F.regexp_replace(url_part(s, "path"), "/+$", "")
        on_site = (
            (F.lower(url_part(s, "scheme")) == "https") & F.lower(url_part(s, "host")).isin(*portal.hosts)
            & path.startswith(prefix)
        )
        slug = F.when(~F.contains(s, F.lit(":")), s).when(on_site, F.substr(path, F.lit(len(prefix) + 1)))
        return F.when(_allowed(slug, kind, portal), slug)

    return let(F.btrim(text), resolved)


def slug_from_link(url: Column, kind: str = "job", portal: Portal = DEFAULT) -> Column:
    """Page grammar: a link or path that is exactly the `kind` page; sub-paths and other sites are NULL."""

    def resolved(s: Column) -> Column:
        slug = F.regexp_extract(url_part(s, "path"), rf"^/{PREFIXES[kind]}/([^/]+)/?$", 1)
        here = F.lower(url_part(s, "host")).isin("", *portal.hosts)
        return F.when(here & _allowed(slug, kind, portal), slug)

    return let(F.btrim(url), resolved)


def listed_slug(text: Column) -> Column:
    """Listings-file grammar: the slug in a job link anywhere in the text, or the text itself."""

    def resolved(s: Column) -> Column:
        found = F.regexp_extract(s, JOB_IN_PATH, 1)
        slug = F.when(found != "", unquote(found)).otherwise(s)
        return F.when(slug.rlike(LISTED_SLUG), slug)

    return let(F.btrim(text), resolved)


def build_url(slug: Column, kind: str = "job", portal: Portal = DEFAULT) -> Column:
    """Canonical page of a valid slug: ``kind`` is job (any grammar), company or apply."""
    if kind == "apply":
        return F.when(
            slug.rlike(LISTED_SLUG), F.concat(F.lit(f"{portal.base_url}/job_offers/"), slug, F.lit("?tab=apply"))
        )
    if kind == "company":
        return F.when(_allowed(slug, kind, portal), F.concat(F.lit(f"{portal.base_url}/companies/"), slug))
    return F.when(slug.rlike(LENIENT_SLUG), F.concat(F.lit(f"{portal.base_url}/job_offers/"), quote_segment(slug)))


def param_names(query: Column) -> Column:
    """Names of the query parameters, lower case, without ``[...]``."""
    return F.transform(
        F.filter(F.split(query, "&"), lambda pair: pair != ""),
        lambda pair: F.lower(F.btrim(F.substring_index(
            unquote(F.replace(F.substring_index(pair, "=", 1), F.lit("+"), F.lit(" "))), "[", 1))),
    )


def url_refusal(url: Column, portal: Portal = DEFAULT) -> Column:
    """Why a URL may not be fetched: ``host`` (not https on the portal), ``param``, or NULL when it may."""
    on_site = (F.lower(url_part(url, "scheme")) == "https") & (F.lower(url_part(url, "host")) == portal.host)
    banned = F.arrays_overlap(param_names(url_part(url, "query")), F.array(*map(F.lit, FORBIDDEN_PARAMS)))
    return F.when(~on_site, "host").when(banned, "param")


def redirect_allowed(path: Column, original: Column) -> Column:
    """A redirect may land on the same path, the listing, or one offer page."""
    return (path == original) | (path == "/job_offers") | path.rlike(r"^/job_offers/[^/]+$")


def resolve_redirect(url: Column, final_url: Column, kind: str = "job", portal: Portal = DEFAULT) -> Column:
    """``struct(requested, canonical, gone, page)`` of a fetched page.

    `canonical` is the other slug of the same kind the site landed on; `gone` means the redirect left
    the page type; `page` is the ``?page=`` that was served.
    """
    wanted = F.regexp_extract(url_part(url, "path"), rf"^/{PREFIXES[kind]}/([^/]+)/?$", 1)
    landed_path = F.regexp_replace(url_part(final_url, "path"), "/+$", "")
    landed = F.regexp_extract(landed_path, rf"^/{PREFIXES[kind]}/(.+)$", 1)
    moved = ~url.eqNullSafe(final_url)
    valid = _allowed(landed, kind, portal)
    page = F.regexp_extract(url_part(final_url, "query"), r"(?:^|&)page=([0-9]+)(?:&|$)", 1).try_cast("bigint")
    return F.struct(
        wanted.alias("requested"),
        F.when(moved & valid & (landed != wanted), landed).alias("canonical"),
        (moved & ~valid).alias("gone"),
        F.when(page >= 1, page).otherwise(F.lit(1)).cast("bigint").alias("page"),
    )


def listing_frontier(
    runs: DataFrame, *, countries: str = "countries", last_page: str = "last_page", date: str = "date",
    portal: Portal = DEFAULT,
) -> DataFrame:
    """One listing URL per page of every run: countries, ``worldwide=1``, date, page (left out on page 1)."""
    page = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(last_page).cast("bigint"))).alias("page")
    parts = F.array_compact(F.concat(
        F.transform(F.col(countries), lambda c: F.concat(F.lit("countries%5B%5D="), quote_plus(c))),
        F.array(
            F.lit("worldwide=1"),
            F.when(F.col(date) != "", F.concat(F.lit("date="), quote_plus(F.col(date)))),
            F.when(F.col("page") > 1, F.concat(F.lit("page="), F.col("page").cast("string"))),
        ),
    ))
    return runs.select("*", page).withColumn(
        "url", F.concat(F.lit(f"{portal.base_url}/job_offers?"), F.array_join(parts, "&")))
