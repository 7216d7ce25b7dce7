"""Pages -> rows: elements, cards, listings, JSON-LD, postings, companies, private lists, outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.operators import extract as ex
from vacantia.operators import jsonld as jl
from vacantia.operators import quality as qu
from vacantia.operators.html import Sel, all_texts, attr, element_table, first_text, of_role
from vacantia.plans.derived import COMPANIES, OFFERS, companies, day, detail_pages, listing_pages, pick, spread, table
from vacantia.plans.registry import query

PAGE_DAY = "2026-09-24"
UNESCAPE = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
#: The same references in text, where HTML5 also reads them without their semicolon (a title cut in the middle of one).
UNESCAPE_TEXT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"


@query("x0_element_table", f"""
SELECT page_id, trim(regexp_replace({UNESCAPE_TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}, '\\s+', ' ', 'g')) AS h1, len(regexp_extract_all(html, '<li>')) AS items,
  {UNESCAPE_TEXT.format("array_to_string(list_transform(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1), lambda t: trim(t)), '|')")} AS links,
  {UNESCAPE.format("array_to_string(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1), '|')")} AS hrefs, trim(regexp_replace({UNESCAPE_TEXT.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")}, '\\s+', ' ', 'g')) AS ad FROM pages""")
def x0_element_table(spark, folder):
    keep = (Sel("h1", tag="h1"), Sel("item", tag="li"), Sel("link", tag="a", attr="href", under=Sel(tag="nav")), Sel("ad", tag="div", cls="ad"))
    hits = F.col("hits")
    return element_table(table(spark, folder, "pages"), keep).select(
        "page_id", first_text(hits, "h1").alias("h1"), F.size(of_role(hits, "item")).alias("items"), F.array_join(all_texts(hits, "link"), "|").alias("links"),
        F.array_join(F.transform(of_role(hits, "link"), lambda h: attr(h, "href")), "|").alias("hrefs"), first_text(hits, "ad").alias("ad"))


LABEL = "CASE employment_type WHEN 'full_time' THEN 'Jornada Completa' WHEN 'part_time' THEN 'Jornada Parcial' ELSE 'Freelance / Por contrato' END"


@query("x1_extract_cards", f"""
WITH {OFFERS} SELECT offer_id // 15 AS page_id, offer_id % 15 AS pos, slug, title, company, location_text, region, comuna, country, {LABEL} AS workday, 'Remoto' AS modality,
  'Hace ' || offer_id % 30 || ' días' AS posted_relative, 'https://jobs.example.com/job_offers/' || slug AS url, '2026-09-24T12:00:00+00:00' AS fetched_at
FROM (SELECT * REPLACE (country AS region, comuna AS comuna, NULL AS country) FROM offers_v)""")
def x1_extract_cards(spark, folder):
    return ex.extract_cards(listing_pages(spark, folder))


@query("x2_extract_listing_meta", f"""
WITH {OFFERS} SELECT page_id, page_id + 1000 AS total, page_id + 2 AS last_page FROM (SELECT DISTINCT offer_id // 15 AS page_id FROM offers_v)""")
def x2_extract_listing_meta(spark, folder):
    return ex.extract_listing_meta(listing_pages(spark, folder))


def bad_pages(pages: DataFrame) -> DataFrame:
    """Result pages with one of five faults on most of them."""
    k = F.col("page_id")
    faults = F.array(
        F.col("html"), F.replace("html", F.lit("job_offers_results"), F.lit("other")), F.regexp_replace("html", 'data-scroll-restore-slug="[^"]*"', 'data-scroll-restore-slug="No Slug"'),
        F.replace("html", F.lit("turbo-frame"), F.lit("captcha")), F.regexp_replace("html", r"(?s)<div class=.card job-offer-card.*</div>", ""))
    return pages.withColumn("html", faults[(k % 5).cast("int")])


@query("x8_extract_search_page", f"""
WITH {OFFERS} SELECT offer_id // 15 AS page_id, offer_id % 15 AS pos, slug, title, company, location_text AS location, 'CLP' AS salary_currency, salary_min, salary_max, employment_type, 'remote' AS modality,
  {LABEL} || '; Remoto' AS labels, CAST(DATE '{PAGE_DAY}' - to_days(CAST(offer_id % 30 AS INTEGER)) AS DATE) AS posted_at_approx FROM (SELECT * REPLACE (coalesce(salary_currency, 'CLP') AS salary_currency) FROM offers_v)
WHERE (offer_id // 15) % 5 = 0 AND salary_min IS NOT NULL
UNION ALL SELECT offer_id // 15, offer_id % 15, slug, title, company, location_text, NULL, NULL, NULL, employment_type, 'remote', {LABEL} || '; Remoto', CAST(DATE '{PAGE_DAY}' - to_days(CAST(offer_id % 30 AS INTEGER)) AS DATE)
FROM offers_v WHERE (offer_id // 15) % 5 = 0 AND salary_min IS NULL""")
def x8_extract_search_page(spark, folder):
    rows = ex.extract_search_page(bad_pages(listing_pages(spark, folder)), day(PAGE_DAY)).rows
    return rows.select("page_id", "pos", "slug", "title", "company", "location", F.col("salary.currency").alias("salary_currency"), F.col("salary.min").alias("salary_min"),
                       F.col("salary.max").alias("salary_max"), "employment_type", "modality", F.array_join("labels", "; ").alias("labels"), "posted_at_approx")


@query("x8_search_violations", f"""
WITH {OFFERS}, p AS (SELECT DISTINCT offer_id // 15 AS page_id FROM offers_v)
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'turbo-frame#job_offers_results' WHEN 2 THEN 'div.job-offer-card[data-scroll-restore-slug] (a job slug)' WHEN 3 THEN 'blocked'
  WHEN 4 THEN 'div.job-offer-card[data-scroll-restore-slug]' END AS violation, CASE WHEN page_id % 5 IN (0, 2, 4) THEN page_id + 2 ELSE 1 END AS last_page, page_id % 5 IN (0, 2, 4) AS has_next FROM p""")
def x8_search_violations(spark, folder):
    report = ex.extract_search_page(bad_pages(listing_pages(spark, folder)), day(PAGE_DAY)).pages
    return report.select("page_id", "violation", F.coalesce("last_page", F.lit(1)).alias("last_page"), F.coalesce("has_next", F.lit(False)).alias("has_next"))


@query("x9_location_and_roles", """
SELECT n_nationkey AS page_id, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE 'Chile/' || n_name END AS effective_location, (SELECT string_agg(p_name, ';' ORDER BY k) FROM (
  SELECT p_name, min(p_partkey) AS k FROM part WHERE p_partkey % 25 = n_nationkey GROUP BY p_name)) AS related_roles FROM nation""")
def x9_location_and_roles(spark, folder):
    """Applied location and role pills of pages rendered from nations and the parts of each."""
    k = F.col("n_nationkey")
    # One entry per distinct part name, so the list is bounded by the name vocabulary, not by the parts.
    pills = table(spark, folder, "part").groupBy((F.col("p_partkey") % 25).cast("int").alias("n_nationkey"), "p_name").agg(F.min("p_partkey").alias("first"))
    pill = F.concat(F.lit('<a class="x similar-role-suggestion-pill" data-role-name="'), "p_name", F.lit(' "></a>'))
    pills = pills.groupBy("n_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", pill.alias("h")))), lambda s: F.concat(s["h"], s["h"])), "").alias("pills"))
    option = F.concat(F.lit("[{&quot;id&quot;:1,&quot;display_path&quot;:&quot;x&quot;},{&quot;id&quot;:"), (k + 100).cast("string"), F.lit(",&quot;display_path&quot;:&quot;Chile/"), "n_name", F.lit("&quot;}]"))
    value = F.when(k % 3 == 2, "").otherwise(F.concat((k + 100).cast("string"), F.lit(",7")))
    pages = table(spark, folder, "nation").join(pills, "n_nationkey", "left").select(
        k.alias("page_id"), F.concat(F.lit('<input id="locations" value="'), value, F.lit('" data-initial-area-options="'), option, F.lit('">'), F.coalesce("pills", F.lit(""))).alias("html"))
    hits = F.col("hits")
    keep = (Sel("area", tag="input", id="locations"), Sel("pill", tag="a", cls="similar-role-suggestion-pill", attr="data-role-name"))
    found = element_table(pages, keep).select("page_id", ex.effective_location(F.try_element_at(of_role(hits, "area"), F.lit(1))).alias("l"), ex.related_pills(hits).alias("r"))
    return found.select("page_id", F.col("l.display_path").alias("effective_location"), F.when(F.size("r") > 0, F.array_join("r", ";")).alias("related_roles"))


@query("x3_extract_jsonld", """
SELECT p_partkey AS page_id, 0 AS pos, 'https://schema.org' AS context, NULL AS title FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, 1, NULL, 'Organization' FROM part WHERE p_partkey % 11 <> 0
UNION ALL SELECT p_partkey, 2, NULL, p_name FROM part WHERE p_partkey % 11 <> 0""")
def x3_extract_jsonld(spark, folder):
    rows = jl.jsonld_objects(detail_pages(spark, folder))
    text = lambda path: jl.text_at(F.col("ld"), path)
    return rows.select("page_id", "pos", text('$["@context"]').alias("context"), F.coalesce(text("$.title"), text('$["@type"]')).alias("title"))


SALARY_KEY = "p_partkey % 7"


@query("x4_extract_detail", f"""
WITH v AS (SELECT *, CAST(floor(p_retailprice * 100) AS BIGINT) AS lo, CAST(floor(p_retailprice * 200) AS BIGINT) AS hi FROM part WHERE p_partkey % 11 <> 0)
SELECT p_partkey AS page_id, 'part-' || p_partkey AS slug, p_type || ' &amp; ' || p_brand || chr(10) || '- ' || p_name AS description, CASE WHEN {SALARY_KEY} < 6 THEN lo END AS salary_min,
  CASE WHEN {SALARY_KEY} IN (0, 5) THEN hi END AS salary_max, CAST('2026-09-' || lpad(CAST(p_partkey % 30 + 1 AS VARCHAR), 2, '0') AS DATE) AS published_at,
  CASE WHEN p_partkey % 5 <> 0 THEN DATE '2026-12-22' END AS valid_through, CAST(p_partkey AS VARCHAR) AS external_id FROM v""")
def x4_extract_detail(spark, folder):
    return jl.extract_detail(detail_pages(spark, folder))


@query("n10_jsonld_salary", f"""
WITH v AS (SELECT *, CAST(floor(p_retailprice * 100) AS BIGINT) AS lo, CAST(floor(p_retailprice * 200) AS BIGINT) AS hi FROM part WHERE p_partkey % 11 <> 0)
SELECT {SALARY_KEY} AS shape, count(*) AS pages, sum(CASE WHEN {SALARY_KEY} < 6 THEN lo END) AS salary_min, sum(CASE WHEN {SALARY_KEY} IN (0, 5) THEN hi END) AS salary_max FROM v GROUP BY 1""")
def n10_jsonld_salary(spark, folder):
    jobs = F.slice(jl.all_of_type(jl.page_objects(F.col("html")), "JobPosting"), 1, 1)
    found = detail_pages(spark, folder).select("page_id", F.explode(jobs).alias("job")).select("page_id", jl.lenient_salary(F.variant_get("job", "$.baseSalary", "variant")).alias("s"))
    return found.groupBy((F.col("page_id") % 7).alias("shape")).agg(F.count("*").alias("pages"), F.sum("s.min").alias("salary_min"), F.sum("s.max").alias("salary_max"))


@query("x5_merge_posting", f"""
WITH v AS (SELECT *, p_partkey % 11 <> 0 AS ld, CAST(floor(p_retailprice * 100) AS BIGINT) AS lo, CAST(floor(p_retailprice * 200) AS BIGINT) AS hi FROM part)
SELECT p_partkey AS page_id, p_name || ' ' || p_partkey AS title, CASE WHEN ld THEN p_brand END AS company, CASE WHEN ld THEN lower(replace(p_brand, '#', '-')) END AS company_slug, 'Ñuñoa, Chile' AS location,
  CASE WHEN ld THEN CASE {SALARY_KEY} WHEN 0 THEN lo WHEN 1 THEN lo WHEN 2 THEN lo END END AS salary_min, CASE WHEN ld THEN CASE {SALARY_KEY} WHEN 0 THEN hi WHEN 1 THEN lo WHEN 2 THEN lo END END AS salary_max,
  CASE WHEN ld THEN 'full_time' END AS employment_type, 'hybrid' AS modality, p_size AS vacancies, CASE WHEN ld THEN p_partkey END AS offer_id,
  CASE WHEN ld AND p_partkey % 5 <> 0 THEN DATE '2026-12-22' END AS valid_through, 'open' AS status, CASE WHEN ld THEN p_type || ' &amp; ' || p_brand || chr(10) || '- ' || p_name ELSE '' END AS description_text,
  p_type || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_size AS requirements_text, NOT ld AS dom_only FROM v""")
def x5_merge_posting(spark, folder):
    rows = ex.extract_postings(detail_pages(spark, folder), day(PAGE_DAY))
    return rows.select(
        "page_id", "title", "company", "company_slug", "location", F.col("salary.min").alias("salary_min"), F.col("salary.max").alias("salary_max"), "employment_type", "modality", "vacancies", "offer_id",
        "valid_through", "status", F.replace("description_text", F.lit("\n\n"), F.lit("\n")).alias("description_text"), "requirements_text", F.col("warning").isNotNull().alias("dom_only"))


@query("x7_extract_sections", """
SELECT p_partkey AS page_id, CAST(NULL AS VARCHAR) AS description_text, p_type || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_size AS requirements_text FROM part""")
def x7_extract_sections(spark, folder):
    return ex.extract_sections(detail_pages(spark, folder))


def company_pages(spark, folder) -> DataFrame:
    """Directory pages of at most 24 company cards behind as many loading skeletons."""
    k = F.regexp_extract("slug", "([0-9]+)$", 1).cast("bigint")
    card = F.concat(
        F.lit('<a class="company-card" href="/companies/'), "slug", F.lit('"><h3 class="company-card__name">'), "name", F.lit('</h3><p class="company-card__location"><span>'), "location",
        F.lit('</span></p><div class="company-card__tags"><span class="tag-navy">51 - 200 empleados</span><span class="tag-navy">Banca</span></div><p class="company-card__offers">'), F.col("active_offers").cast("string"),
        F.lit(' ofertas activas</p><p class="company-card__offer-locations"><span>'), "location", F.lit(" <strong>+ 7 más</strong></span></p></a>"))
    pages = companies(spark, folder).groupBy(F.floor(k / 24).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), card.alias("html")))).alias("cards"))
    return pages.select("page_id", F.concat(
        F.lit('<turbo-frame id="companies_marketplace_results"><b class="text-primary">2.152</b>'), F.repeat(F.lit('<div class="company-card loading-company"></div>'), 24),
        F.array_join(F.transform("cards", lambda c: c["html"]), ""), F.lit("</turbo-frame>")).alias("html"))


@query("x10_extract_companies", f"""
WITH {COMPANIES} SELECT slug, name, location, 'Banca' AS sector, '51 - 200 empleados' AS size, active_offers, location AS offer_locations FROM companies_v""")
def x10_extract_companies(spark, folder):
    rows = ex.extract_companies(company_pages(spark, folder)).rows
    return rows.select("slug", "name", "location", "sector", "size", "active_offers", F.array_join("offer_locations", ";").alias("offer_locations"))


@query("x11_extract_company_page", f"""
WITH {OFFERS} SELECT offer_id // 15 AS page_id, 'Empresa ' || offer_id // 15 AS name, 'Lima' AS location, 29 AS active_offers, true AS has_more, offer_id // 15 + 2 AS next_page, count(*) AS jobs FROM offers_v GROUP BY 1, 2, 6""")
def x11_extract_company_page(spark, folder):
    head = F.concat(F.lit('<ol class="breadcrumb__list text-caption"><span>›</span></ol><h1>Empresa '), F.col("page_id").cast("string"), F.lit(
        '</h1><div class="text-caption text-gray"><span>Lima</span></div><div id="section-job-offers"><h2 class="subsection-header">29 ofertas activas</h2></div>'))
    pages = listing_pages(spark, folder).withColumn("html", F.concat(head, F.replace("html", F.lit("job_offers_results"), F.lit("company_job_offers_results"))))
    out = ex.extract_company_page(pages, day(PAGE_DAY))
    return out.pages.select("page_id", "name", "location", "active_offers", "has_more", "next_page", F.col("cards").cast("bigint").alias("jobs"))


def private_pages(spark, folder) -> DataFrame:
    """Application lists of ten orders each."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    item = F.concat(
        F.lit('<li><a href="/job_offers/offer-'), s, F.lit('">Ver</a><h3>'), "o_orderpriority", F.lit(" "), s, F.lit('</h3><a href="/job_offers/offer-'), s, F.lit('/save_later">g</a><p class="item-title">Empresa '), F.col("o_custkey").cast("string"),
        F.lit("</p><time>Postulaste el "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit('</time><span class="tag-green">'), "o_orderstatus", F.lit("</span></li>"))
    rows = table(spark, folder, "orders").withColumn("page_id", F.floor(k / 10))
    pages = spread(rows, F.col("page_id")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("html")))).alias("items"))
    return pages.select("page_id", F.concat(F.lit('<header><a href="/job_offers/menu">m</a></header><ul>'), F.array_join(F.transform("items", lambda c: c["html"]), ""), F.lit("</ul>")).alias("html"))


@query("x12_harvest_offer_links", "SELECT o_orderkey // 10 AS page_id, o_orderkey % 10 AS pos, 'offer-' || o_orderkey AS slug, 'Ver' AS title FROM orders")
def x12_harvest_offer_links(spark, folder):
    return ex.harvest_offer_links(private_pages(spark, folder)).select("page_id", "pos", "slug", "title")


@query("x13_extract_applications", """
SELECT o_orderkey // 10 AS page_id, o_orderkey % 10 AS pos, 'offer-' || o_orderkey AS slug, o_orderpriority || ' ' || o_orderkey AS title, 'Empresa ' || o_custkey AS company,
  'Postulaste el ' || strftime(o_orderdate, '%d/%m/%Y') AS applied_at_text, o_orderstatus AS status_text FROM orders""")
def x13_extract_applications(spark, folder):
    return ex.extract_applications(private_pages(spark, folder)).drop("url")


@query("x14_extract_cv_metadata", """
SELECT c_custkey AS page_id, 0 AS pos, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'CV ' || c_name || '.pdf' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'Actualizado hace ' || c_custkey || ' días' END AS updated_at_text FROM customer""")
def x14_extract_cv_metadata(spark, folder):
    k = F.col("c_custkey")
    updated = F.when(k % 2 == 0, F.concat(F.lit("<small>Actualizado hace "), k.cast("string"), F.lit(" días</small>"))).otherwise("")
    by_file = F.concat(F.lit("<nav><p>menu.pdf</p></nav><ul><li><p>CV "), "c_name", F.lit(".pdf</p><p>copia.doc</p>"), updated, F.lit("</li></ul>"))
    by_class = F.concat(F.lit('<div class="cv-card"><h3>'), "c_name", F.lit("</h3>"), updated, F.lit("</div>"))
    pages = table(spark, folder, "customer").select(k.alias("page_id"), F.when(k % 3 == 0, by_class).otherwise(by_file).alias("html"))
    return ex.extract_cv_metadata(pages)


def saved_pages(spark, folder) -> DataFrame:
    """Saved offers of ten orders each: pages of cards, pages of bare links, and pages of an ended session."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    card = F.concat(
        F.lit('<div class="job-offer-card" data-scroll-restore-slug="offer-'), s, F.lit('"><h2 class="job-offer-card__title">'), "o_orderpriority", F.lit('</h2><p class="item-title">Empresa '), F.col("o_custkey").cast("string"),
        F.lit('</p><span class="tag-navy">Remoto</span></div>'))
    link = F.concat(F.lit('<li><a href="/job_offers/offer-'), s, F.lit('"><h3>'), "o_orderpriority", F.lit("</h3> ver</a></li>"))
    shape = F.floor(k / 10) % 3
    rows = table(spark, folder, "orders").withColumn("page_id", F.floor(k / 10))
    item = F.struct(k.alias("k"), F.when(shape == 1, link).otherwise(card).alias("html"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    header = F.when(F.col("page_id") % 3 == 2, '<header id="main-header"><a href="/users/sign_in">Entrar</a></header>').otherwise("")
    nav = F.lit('<nav class="pagination-nav"><a aria-label="Página 7">7</a><a aria-label="Página siguiente">x</a></nav>')
    return pages.select("page_id", F.concat(
        header, F.lit('<div class="job-offer-card"><h2>esqueleto</h2></div>'), F.array_join(F.transform("items", lambda c: c["html"]), ""), F.when(F.col("page_id") % 2 == 0, nav).otherwise("")).alias("html"))


@query("x12_saved_jobs", """
SELECT page_id, n - 1 AS pos, slug, title, CASE WHEN shape = 0 THEN company END AS company, CASE WHEN shape = 0 THEN 'remote' END AS modality
FROM (SELECT o_orderkey // 10 AS page_id, o_orderkey // 10 % 3 AS shape, row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS n, 'offer-' || o_orderkey AS slug,
  o_orderpriority AS title, 'Empresa ' || o_custkey AS company FROM orders) WHERE shape < 2""")
def x12_saved_jobs(spark, folder):
    rows = ex.extract_private_list(saved_pages(spark, folder), "saved_jobs", day(PAGE_DAY)).rows
    return rows.select("page_id", "pos", "slug", "title", "company", "modality")


@query("x13_private_pages", """
SELECT DISTINCT kind, o_orderkey // 10 AS page_id, CASE WHEN o_orderkey // 10 % 2 = 0 THEN 7 ELSE 1 END AS last_page, o_orderkey // 10 % 2 = 0 AS has_next,
  CASE WHEN o_orderkey // 10 % 3 = 2 THEN 'AUTH_REQUIRED' END AS violation FROM orders, (SELECT unnest(['saved_jobs', 'applications', 'cvs']) AS kind)""")
def x13_private_pages(spark, folder):
    """The list facts of private pages, each captured as a page of every kind, in one pass."""
    facts = ex.private_list_facts(saved_pages(spark, folder))
    return facts.select("*", F.explode(F.array(*map(F.lit, ex.PRIVATE_KEEP))).alias("kind"))


def statuses(k: Column) -> Column:
    return F.array(*map(F.lit, (200, 404, 500, 302, 403, 429, 410)))[(k % 7).cast("int")]


@query("x15_classify_pages", """
SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'OK' WHEN 1 THEN 'NOT_FOUND' WHEN 2 THEN 'NETWORK' WHEN 3 THEN 'SITE_CHANGED' WHEN 4 THEN 'BLOCKED' WHEN 5 THEN 'RATE_LIMITED' ELSE 'NOT_FOUND' END AS outcome,
  CASE page_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 4 WHEN 5 THEN 4 ELSE 3 END AS exit_code,
  CASE WHEN page_id % 7 = 0 AND regexp_extract(html, '<html lang="([^"]*)"', 1) NOT LIKE 'es%' THEN 'page language is ' || regexp_extract(html, '<html lang="([^"]*)"', 1) END AS locale_warning FROM pages""")
def x15_classify_pages(spark, folder):
    pages = table(spark, folder, "pages").withColumn("status", statuses(F.col("page_id")))
    return ex.classify_pages(pages).select("page_id", "outcome", "exit_code", "locale_warning")


@query("s6_read_json_api", """
SELECT p_partkey % 5 AS kind, p_partkey AS page_id, CASE WHEN p_partkey % 5 < 3 THEN p_name END AS name, CASE WHEN p_partkey % 5 < 3 THEN p_size END AS offer_count,
  CASE p_partkey % 5 WHEN 3 THEN 'areas response without its list' WHEN 4 THEN 'areas without id, name or display_path' END AS violation FROM part""")
def s6_read_json_api(spark, folder):
    k = F.col("p_partkey")
    area = F.to_json(F.struct(k.alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("display_path"), F.col("p_size").alias("offer_count")))
    body = F.when(k % 5 < 3, F.concat(F.lit('{"areas":['), area, F.lit("]}"))).when(k % 5 == 3, F.lit('{"items":[]}')).otherwise(F.concat(F.lit('{"areas":[{"id":'), k.cast("string"), F.lit("}]}")))
    bodies = table(spark, folder, "part").select(k.alias("page_id"), body.alias("body"), F.lit("application/json; charset=utf-8").alias("content_type"))
    out = ex.read_json_api(bodies, "areas")
    return out.pages.join(out.rows, "page_id", "left").select((F.col("page_id") % 5).alias("kind"), "page_id", "name", "offer_count", "violation")


#: For each further kind of page: a sound one, one without its first anchor, one with an anchor in the wrong place, a challenge.
ANCHOR_PAGES = {
    "companies": ['<turbo-frame id="companies_marketplace_results"><b class="text-primary">5</b></turbo-frame>', '<b class="text-primary">5</b>', '<turbo-frame id="companies_marketplace_results"></turbo-frame><b class="text-primary">5</b>', "<p>captcha</p>"],
    "company": ['<h1>E</h1><turbo-frame id="company_job_offers_results"></turbo-frame>', '<turbo-frame id="company_job_offers_results"></turbo-frame>', '<h1>E</h1><div id="company_job_offers_results"></div>', "<h2>captcha</h2>"],
    "job": ['<script type="application/ld+json">{"@graph":[{"@graph":[[[{"@type":"JobPosting"}]]]}]}</script>', "<h1>x</h1>", '<script type="application/ld+json">{"@type":"Thing","name":"JobPosting"}</script>', "<p>captcha</p>"],
}
ANCHOR_NAMES = {"companies": ["turbo-frame#companies_marketplace_results", "b.text-primary"], "company": ["h1", "turbo-frame#company_job_offers_results"], "job": ["JSON-LD JobPosting or .job-offer-show-title h1"] * 2}
ANCHOR_ROWS = " UNION ALL ".join(
    f"SELECT '{kind}', CASE page_id % 4 WHEN 0 THEN NULL WHEN 2 THEN '{second}' ELSE '{first}' END, CASE page_id % 4 WHEN 0 THEN 'ok' WHEN 3 THEN 'blocked' ELSE 'site_changed' END, count(*) FROM p GROUP BY ALL"
    for kind, (first, second) in ANCHOR_NAMES.items())


@query("q2_anchor_report", f"""
WITH {OFFERS}, p AS (SELECT DISTINCT offer_id // 15 AS page_id FROM offers_v)
SELECT 'search' AS kind, CASE WHEN page_id % 5 IN (1, 3) THEN 'turbo-frame#job_offers_results' END AS anchor, CASE page_id % 5 WHEN 1 THEN 'site_changed' WHEN 3 THEN 'blocked' ELSE 'ok' END AS verdict, count(*) AS pages FROM p GROUP BY 2, 3
UNION ALL {ANCHOR_ROWS}""")
def q2_anchor_report(spark, folder):
    """Pages of all four kinds, each with its faults."""
    pages = listing_pages(spark, folder)
    search = bad_pages(pages).select(F.lit("search").alias("kind"), "html")
    others = [pages.select(F.lit(kind).alias("kind"), pick(F.col("page_id"), html).alias("html")) for kind, html in ANCHOR_PAGES.items()]
    return qu.anchor_report(reduce(DataFrame.union, others, search))
