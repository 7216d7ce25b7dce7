"""Search, cursor, lookups, facets, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import search as se
from vacantia.plans.derived import COMPANIES, OFFERS, TODAY, companies, day, offers, table
from vacantia.plans.registry import query

WORD = r"(^|[^\p{L}\p{N}])"
FULL = se.SearchQuery(roles=("urg build", "medium furn"), worldwide=True, posted_within="6m", job_types=("full_time", "part_time"), min_salary=20000, max_salary=200000)
FOUND = f"""found AS (
  SELECT *, CAST(regexp_matches(lower(title), '{WORD}urg') AS INT) + CAST(regexp_matches(lower(title), '{WORD}build') AS INT) + CAST(regexp_matches(lower(title), '{WORD}medium') AS INT)
    + CAST(regexp_matches(lower(title), '{WORD}furn') AS INT) AS hits FROM offers_v
  WHERE posted_at >= DATE '{TODAY}' - INTERVAL 6 MONTH AND employment_type IN ('full_time', 'part_time') AND salary_currency = 'CLP' AND salary_max >= 20000 AND salary_min <= 200000
    AND ((regexp_matches(lower(title), '{WORD}urg') AND regexp_matches(lower(title), '{WORD}build')) OR (regexp_matches(lower(title), '{WORD}medium') AND regexp_matches(lower(title), '{WORD}furn'))))"""


@query("f1_match_roles", f"""
WITH {OFFERS} SELECT slug, title FROM offers_v WHERE (regexp_matches(lower(title), '{WORD}urg') AND regexp_matches(lower(title), '{WORD}auto')) OR regexp_matches(lower(title), '{WORD}low')""")
def f1_match_roles(spark, folder):
    return offers(spark, folder).where(se.match_roles(F.col("title"), ["AUTO Urg", "löw"])).select("slug", "title")


@query("f2_filter_location", f"""
WITH {OFFERS} SELECT 'default' AS mode, count(*) AS n FROM offers_v WHERE country = 'ASIA' UNION ALL SELECT 'areas', count(*) FROM offers_v WHERE area_path LIKE 'ASIA/%' OR area_path LIKE 'EUROPE/NATION_3/%' OR area_path = 'EUROPE/NATION_3'
UNION ALL SELECT 'countries', count(*) FROM offers_v WHERE country IN ('AFRICA', 'EUROPE') UNION ALL SELECT 'worldwide', count(*) FROM offers_v""")
def f2_filter_location(spark, folder):
    modes = {"default": {}, "areas": {"areas": ("ASIA", "EUROPE/NATION_3")}, "countries": {"countries": ("AFRICA", "EUROPE")}, "worldwide": {"worldwide": True}}
    counts = offers(spark, folder).agg(*[F.count_if(se.in_location(se.SearchQuery(home="ASIA", **q))).alias(m) for m, q in modes.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("n")) for m in modes])))


@query("f3_posted_within", f"""
WITH {OFFERS}, p AS (SELECT * FROM (VALUES ('24h', DATE '{TODAY}' - INTERVAL 1 DAY), ('3d', DATE '{TODAY}' - INTERVAL 3 DAY), ('1w', DATE '{TODAY}' - INTERVAL 7 DAY), ('1m', DATE '{TODAY}' - INTERVAL 1 MONTH),
  ('3m', DATE '{TODAY}' - INTERVAL 3 MONTH), ('6m', DATE '{TODAY}' - INTERVAL 6 MONTH)) v(period, since)) SELECT period, count(slug) AS n FROM p LEFT JOIN offers_v ON posted_at >= since GROUP BY period""")
def f3_posted_within(spark, folder):
    periods = [*se.POSTED_WITHIN, *se.POSTED_WITHIN_MONTHS]
    counts = offers(spark, folder).agg(*[F.count_if(F.col("posted_at") >= se.posted_since(p, day(TODAY))).alias(p) for p in periods])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"`{p}`").alias("n")) for p in periods])))


@query("f4_job_types", f"WITH {OFFERS} SELECT slug, employment_type FROM offers_v WHERE employment_type IN ('part_time', 'contractor') AND country = 'ASIA'")
def f4_job_types(spark, folder):
    q = se.SearchQuery(job_types=("part_time", "contractor"), home="ASIA")
    return se.search_offers(offers(spark, folder), q, day(TODAY)).select("slug", "employment_type")


@query("f5_salary_overlap", f"WITH {OFFERS} SELECT slug, salary_min, salary_max FROM offers_v WHERE salary_currency = 'CLP' AND salary_max >= 50000 AND salary_min <= 60000")
def f5_salary_overlap(spark, folder):
    q = se.SearchQuery(worldwide=True, min_salary=50000, max_salary=60000)
    return se.search_offers(offers(spark, folder), q, day(TODAY)).select("slug", "salary_min", "salary_max")


@query("f6_search_offers", f"""
WITH {OFFERS}, {FOUND} SELECT rank, slug, title, hits, posted_at, (rank - 1) // 15 + 1 AS page, (rank - 1) % 15 AS pos
FROM (SELECT *, row_number() OVER (ORDER BY hits DESC, posted_at DESC, slug) AS rank FROM found) WHERE rank <= 40""")
def f6_search_offers(spark, folder):
    return se.search_page(offers(spark, folder), FULL, day(TODAY), limit=40).items.select("rank", "slug", "title", "hits", "posted_at", "page", "pos")


@query("r9_list_meta", f"""
WITH {OFFERS}, {FOUND}, t AS (SELECT count(*) AS total, greatest(CAST(ceil(count(*) / 15.0) AS INT), 1) AS last_page FROM found)
SELECT total, 2 AS page, 3 AS offset, greatest(2, least(last_page, (15 + 3 + 39) // 15 + 1)) AS last_fetched_page,
  CASE WHEN last_page > 2 THEN 15 END AS per_page, last_page, total > 58 AS has_more, CASE WHEN total > 58 THEN 4 END AS next_page, CASE WHEN total > 58 THEN 13 END AS next_offset,
  CASE WHEN total <= 15 THEN 'page 2 is past the last page' || CASE WHEN last_page < 2 THEN ' (' || last_page || ')' ELSE '' END WHEN total <= 18 THEN 'page 2 has only ' || (total - 15) || ' results; offset 3 skipped them all' ELSE '' END AS notes FROM t""")
def r9_list_meta(spark, folder):
    meta = se.search_page(offers(spark, folder), FULL, day(TODAY), page=2, offset=3, limit=40).meta
    return meta.withColumn("notes", F.array_join("notes", ";"))


LISTING = """, l AS (SELECT posted_at, slug, company_slug, (row_number() OVER (ORDER BY posted_at DESC, slug) - 1) // 15 + 1 AS page, (row_number() OVER (ORDER BY posted_at DESC, slug) - 1) % 15 AS pos FROM offers_v)"""


@query("r8_cursor_page", f"""
WITH {OFFERS}{LISTING}, near AS (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY page, pos) AS seen FROM l WHERE page BETWEEN 3 AND 12),
kept AS (SELECT *, row_number() OVER (ORDER BY page, pos) AS rank FROM near WHERE seen = 1 AND (page > 3 OR pos >= 4)) SELECT rank, page, pos, slug, company_slug FROM kept WHERE rank <= 100""")
def r8_cursor_page(spark, folder):
    """A listing where the same company comes up again: repeats of a returned or skipped one are consumed."""
    found = offers(spark, folder).select("slug", "company_slug", "posted_at")
    served = se.served_pages(found, ("posted_at desc", "slug asc"), first_page=3)
    return se.cursor_page(served, se.page_table(found, first_page=3), key="company_slug", page=3, offset=4, limit=100).items.select("rank", "page", "pos", "slug", "company_slug")


@query("r8_cursor_meta", f"""
WITH {OFFERS}{LISTING}, near AS (SELECT *, row_number() OVER (PARTITION BY company_slug ORDER BY page, pos) AS seen FROM l WHERE page BETWEEN 3 AND 12),
kept AS (SELECT *, row_number() OVER (ORDER BY page, pos) AS rank FROM near WHERE seen = 1 AND (page > 3 OR pos >= 4)),
a AS (SELECT max(page) FILTER (WHERE rank = 20) AS p, max(page) FILTER (WHERE rank = 21) AS np, max(pos) FILTER (WHERE rank = 21) AS no FROM kept)
SELECT CASE WHEN np = p THEN np ELSE p + 1 END AS next_page, CASE WHEN np = p THEN no ELSE 0 END AS next_offset, p AS last_fetched_page FROM a""")
def r8_cursor_meta(spark, folder):
    found = offers(spark, folder).select("slug", "company_slug", "posted_at")
    served = se.served_pages(found, ("posted_at desc", "slug asc"), first_page=3)
    return se.cursor_page(served, se.page_table(found, first_page=3), key="company_slug", page=3, offset=4, limit=20).meta.select("next_page", "next_offset", "last_fetched_page")


@query("r8_deep_page", f"""
WITH {OFFERS} SELECT page, pos, slug, posted_at FROM (SELECT *, (row_number() OVER (ORDER BY posted_at DESC, slug) - 1) // 15 + 1 AS page, (row_number() OVER (ORDER BY posted_at DESC, slug) - 1) % 15 AS pos FROM offers_v) WHERE page BETWEEN 71 AND 80""")
def r8_deep_page(spark, folder):
    """Pages from the 71st on, found by ranges of the sort columns."""
    found = offers(spark, folder).select("slug", "posted_at")
    return se.served_pages(found, ("posted_at desc", "slug asc"), first_page=71, shallow=100).select("page", "pos", "slug", "posted_at")


@query("r10_list_unsuppressed", f"WITH {OFFERS}{LISTING} SELECT page, pos, company_slug FROM l WHERE page BETWEEN 1 AND 10 ORDER BY page, pos LIMIT 120")
def r10_list_unsuppressed(spark, folder):
    """Application rows: the same company any number of times, never a repeat."""
    found = offers(spark, folder).select("slug", "company_slug", "posted_at")
    served = se.served_pages(found, ("posted_at desc", "slug asc"))
    return se.cursor_page(served, se.page_table(found), key=None, limit=120).items.select("page", "pos", "company_slug")


def past_queries(spark, folder):
    return table(spark, folder, "part").groupBy(F.col("p_name").alias("query")).agg(F.count("*").alias("popularity"))


@query("r11_suggest", "SELECT p_name AS query, count(*) AS popularity FROM part WHERE lower(p_name) LIKE 's%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def r11_suggest(spark, folder):
    return se.suggest(past_queries(spark, folder), "S", 12)


JACCARD = """t AS (SELECT DISTINCT p_name AS role, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part),
sim AS (SELECT role, round(len(list_intersect(w, ['small', 'ring'])) / CAST(len(list_distinct(list_concat(w, ['small', 'ring']))) AS DOUBLE), 6) AS similarity FROM t WHERE lower(role) <> 'small ring')"""


@query("r12_similar_roles", f"WITH {JACCARD} SELECT role, similarity FROM sim WHERE similarity > 0 ORDER BY similarity DESC, role LIMIT 9")
def r12_similar_roles(spark, folder):
    return se.similar_roles(table(spark, folder, "part"), "Small Ring", title="p_name")


@query("r12_role_pairs", """
WITH t AS (SELECT DISTINCT p_name || ' ' || p_brand AS role FROM part), w AS (SELECT DISTINCT role, unnest(regexp_split_to_array(lower(role), '[^a-z0-9]+')) AS word FROM t),
s AS (SELECT role, count(*) AS m FROM w GROUP BY role),
p AS (SELECT a.role, b.role AS other, count(*) AS c FROM w a JOIN w b ON a.word = b.word AND a.role <> b.role GROUP BY 1, 2),
j AS (SELECT p.role, other, c / (x.m + y.m - c)::DOUBLE AS share FROM p JOIN s x ON x.role = p.role JOIN s y ON y.role = p.other)
SELECT role, rank, other AS "similar", round(share, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY share DESC, other) AS rank FROM j WHERE share >= 0.5) WHERE rank <= 9""")
def r12_role_pairs(spark, folder):
    """The most similar ones of every part's name and brand, at once."""
    names = table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return se.similar_role_pairs(names)


@query("r13_related_roles", f"""
WITH {JACCARD} SELECT 'Small Ring' AS role, (SELECT min(role) FROM t WHERE role = 'small ring') AS resolved_name,
  (SELECT string_agg(role, ';' ORDER BY similarity DESC, role) FROM (SELECT * FROM sim WHERE similarity > 0 ORDER BY similarity DESC, role LIMIT 9)) AS similar,
  (SELECT string_agg(p_name, ';' ORDER BY n DESC, p_name) FROM (SELECT p_name, count(*) AS n FROM part WHERE lower(p_name) LIKE 'small ring%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS suggestions""")
def r13_related_roles(spark, folder):
    row = se.related_roles(table(spark, folder, "part").withColumnRenamed("p_name", "title"), past_queries(spark, folder), "Small Ring")
    return row.select("role", "resolved_name", F.array_join("similar", ";").alias("similar"), F.array_join("suggestions", ";").alias("suggestions"))


@query("r14_search_companies", f"""
WITH {COMPANIES} SELECT rank, slug, name, active_offers FROM (SELECT *, row_number() OVER (ORDER BY active_offers DESC, slug) AS rank FROM companies_v WHERE contains(lower(name), 'er#0000')) WHERE rank <= 24""")
def r14_search_companies(spark, folder):
    return se.search_companies(companies(spark, folder), "ÉR#0000").items.select("rank", "slug", "name", "active_offers")


def areas(spark, folder):
    """The area dimension: nations (spelled as one of a few words) with their offers."""
    n = F.col("n_nationkey")
    word = F.array(*map(F.lit, ("Santiago", "Ñuñoa", "Santo Domingo", "Maule", "Santiago Centro")))[(n % 5).cast("int")]
    counts = offers(spark, folder).groupBy("region").agg(F.count("*").alias("offer_count"))
    nation = table(spark, folder, "nation").select(n.alias("id"), word.alias("name"), (n % 3 == 0).alias("visitor_country_match"), F.col("n_name").alias("region"))
    return nation.join(counts, "region", "left").withColumn("offer_count", F.coalesce("offer_count", F.lit(0)))


AREAS = f"""{OFFERS}, areas_v AS (SELECT n_nationkey AS id, list_extract(['Santiago', 'Ñuñoa', 'Santo Domingo', 'Maule', 'Santiago Centro'], n_nationkey % 5 + 1) AS name, n_nationkey % 3 = 0 AS visitor,
  (SELECT count(*) FROM offers_v WHERE region = n_name) AS offer_count, n_nationkey FROM nation)"""


@query("j4_resolve_area", f"""
WITH {AREAS}, texts AS (SELECT c_custkey, list_extract(['SANTIAGO', 'sant', 'nunoa', 'Maule', 'xx'], c_custkey % 5 + 1) AS text FROM customer),
uniq AS (SELECT DISTINCT text, strip_accents(lower(text)) AS k FROM texts),
cand AS (SELECT u.text, a.id, row_number() OVER (PARTITION BY u.text ORDER BY offer_count DESC, id) AS server,
  row_number() OVER (PARTITION BY u.text ORDER BY CASE WHEN strip_accents(lower(name)) = k THEN CASE WHEN visitor THEN 0 ELSE 1 END ELSE 2 END, offer_count DESC, id) AS best
  FROM uniq u JOIN areas_v a ON starts_with(strip_accents(lower(a.name)), u.k)),
chosen AS (SELECT text, max(id) FILTER (WHERE best = 1) AS area_id FROM cand GROUP BY text),
others AS (SELECT text, string_agg(id, ';' ORDER BY server) AS alternatives FROM (SELECT c.*, row_number() OVER (PARTITION BY c.text ORDER BY server) AS o FROM cand c WHERE best > 1) WHERE o <= 3 GROUP BY text)
SELECT c_custkey, t.text, area_id, alternatives FROM texts t LEFT JOIN chosen USING (text) LEFT JOIN others USING (text)""")
def j4_resolve_area(spark, folder):
    k = F.col("c_custkey")
    texts = table(spark, folder, "customer").select("c_custkey", F.array(*map(F.lit, ("SANTIAGO", "sant", "nunoa", "Maule", "xx")))[(k % 5).cast("int")].alias("text"))
    found = se.resolve_area(texts, areas(spark, folder))
    return found.withColumn("alternatives", F.array_join(F.transform("alternatives", lambda a: a.cast("string")), ";"))


PLACES = f"""{AREAS}, p AS (SELECT a.id, a.name, a.visitor, a.offer_count, r_name || '/' || n.n_name AS path FROM areas_v a JOIN nation n ON n.n_nationkey = a.id JOIN region ON n_regionkey = r_regionkey),
named AS (SELECT *, row_number() OVER (ORDER BY name <> 'Ñuñoa', NOT visitor, offer_count DESC, id) AS best, row_number() OVER (ORDER BY offer_count DESC, id) AS server FROM p WHERE starts_with(strip_accents(lower(name)), 'nunoa')),
alt AS (SELECT *, row_number() OVER (ORDER BY server) AS o FROM named WHERE best > 1),
chosen AS (SELECT id, path, 0 AS ord FROM named WHERE best = 1 UNION ALL SELECT id, path, 1 FROM p WHERE id = 3),
found AS (SELECT o.* FROM offers_v o WHERE regexp_matches(lower(title), '{WORD}small') AND EXISTS (SELECT 1 FROM chosen c WHERE o.area_path = c.path OR starts_with(o.area_path, c.path || '/')))"""


@query("f6_search_jobs", f"""
WITH {PLACES} SELECT (SELECT count(*) FROM found) AS total, 'small' AS roles, (SELECT string_agg(id, ';' ORDER BY ord) FROM chosen) AS location_ids, (SELECT path FROM chosen WHERE ord = 0) AS effective_location,
  (SELECT string_agg(id, ';' ORDER BY o) FROM alt WHERE o <= 3) AS alternatives,
  'Ubicación: ' || (SELECT path || ' [País] (' || id || ')' FROM chosen WHERE ord = 0) || '|Alternativas: ' || (SELECT string_agg(path || ' [País] (' || id || ')', '; ' ORDER BY o) FROM alt WHERE o <= 3) AS notes,
  (SELECT string_agg(slug, ';' ORDER BY posted_at DESC, slug) FROM (SELECT slug, posted_at FROM found ORDER BY posted_at DESC, slug LIMIT 30)) AS slugs""")
def f6_search_jobs(spark, folder):
    """A search by the name of one place and the id of another: the page with its echo, notes and alternatives."""
    region = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("id"), F.concat_ws("/", "r_name", "n_name").alias("display_path"), F.lit("País").alias("area_type_label"))
    out = se.search_jobs(offers(spark, folder), areas(spark, folder).join(region, "id"), day(TODAY), roles=["small "], locations=["NUNOA"], location_ids=[3], limit=30)
    slugs = out.items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda r: r["slug"]), ";")).scalar()
    ids = F.transform("location_alternatives", lambda a: a["id"].cast("string"))
    return out.meta.select(
        "total", F.array_join("query.roles", ";").alias("roles"), F.array_join(F.col("query.location_ids").cast("array<string>"), ";").alias("location_ids"), F.col("effective_location.display_path").alias("effective_location"),
        F.array_join(ids, ";").alias("alternatives"), F.array_join("notes", "|").alias("notes"), F.nullif(slugs, F.lit("")).alias("slugs"))


@query("r15_find_areas", f"WITH {AREAS} SELECT id, name, offer_count FROM areas_v WHERE starts_with(strip_accents(lower(name)), 'santi') ORDER BY offer_count DESC, id LIMIT 10")
def r15_find_areas(spark, folder):
    return se.find_areas(areas(spark, folder), "SANTI", 10).select("id", "name", "offer_count")


@query("g3_area_facets", f"""
WITH {OFFERS} SELECT country, region, comuna, concat_ws('/', country, region, comuna) AS area_path, 3 - (CAST(grouping(country) AS INT) + CAST(grouping(region) AS INT) + CAST(grouping(comuna) AS INT)) AS depth,
  count(*) AS offer_count, count(DISTINCT company_slug) AS company_count FROM offers_v GROUP BY ROLLUP (country, region, comuna)""")
def g3_area_facets(spark, folder):
    return se.area_facets(offers(spark, folder))


@query("g4_company_rollup", f"""
WITH {OFFERS} SELECT company_slug, count(*) AS active_offers, array_to_string(list_sort(list_distinct(list(location_text))), ';') AS offer_locations FROM offers_v GROUP BY company_slug""")
def g4_company_rollup(spark, folder):
    return se.company_rollup(offers(spark, folder)).withColumn("offer_locations", F.array_join("offer_locations", ";"))


@query("g5_digest", f"""
WITH {OFFERS}, s AS (SELECT CASE WHEN valid_through < DATE '{TODAY}' THEN 'expired' ELSE 'open' END AS status, valid_through FROM offers_v)
SELECT 'saved' AS section, status AS label, count(*) AS n FROM s GROUP BY status UNION ALL SELECT 'expiring', 'within 7 days', count(*) FROM s WHERE valid_through BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + INTERVAL 7 DAY
UNION ALL SELECT 'application', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def g5_digest(spark, folder):
    saved = offers(spark, folder).select(F.when(F.col("valid_through") < day(TODAY), "expired").otherwise("open").alias("status"), "valid_through")
    return se.digest(saved, table(spark, folder, "orders").select(F.col("o_orderpriority").alias("status_text")), day(TODAY))


@query("j2_get_by_slug", f"""
WITH {OFFERS}, r AS (SELECT 'offer-' || l_orderkey * 2 AS slug, min(l_orderkey * 8 + l_linenumber) AS ord FROM lineitem GROUP BY 1)
SELECT r.slug, r.ord, o.slug IS NOT NULL AS found, left(title, 12) AS title, coalesce(length(title) > 12, false) AS text_truncated FROM r LEFT JOIN offers_v o ON r.slug = o.slug""")
def j2_get_by_slug(spark, folder):
    """Slugs asked for once per line item, half of them past the last offer."""
    asked = table(spark, folder, "lineitem").select(
        F.concat(F.lit("offer-"), (F.col("l_orderkey") * 2).cast("string")).alias("slug"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    return se.get_by_slug(asked, offers(spark, folder).select("slug", "title"), texts=["title"], cap=12).select("slug", "ord", "found", "title", "text_truncated")


@query("j3_saved_with_details", f"""
WITH {OFFERS}, s AS (SELECT 'offer-' || (o_orderkey * 3 + 1) AS slug, o_custkey AS page, o_orderkey AS pos FROM orders ORDER BY o_custkey, o_orderkey LIMIT 50)
SELECT s.slug, s.page, s.pos, title, o.slug IS NOT NULL AS found FROM s LEFT JOIN offers_v o ON s.slug = o.slug""")
def j3_saved_with_details(spark, folder):
    saved = table(spark, folder, "orders").select(F.concat(F.lit("offer-"), (F.col("o_orderkey") * 3 + 1).cast("string")).alias("slug"), F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("pos"))
    return se.saved_with_details(saved, offers(spark, folder).select("slug", "title"), 50).select("slug", "page", "pos", "title", "found")


@query("j5_company_profile", f"""
WITH {OFFERS}, top AS (SELECT company_slug FROM offers_v WHERE company_slug = 'company-7'),
n AS (SELECT count(*) AS active_offers, least(9, greatest(CAST(ceil(count(*) / 20.0) AS INT), 1)) AS page FROM top),
o AS (SELECT slug, title, row_number() OVER (ORDER BY posted_at DESC, slug) - 1 AS pos FROM offers_v WHERE company_slug = 'company-7')
SELECT c_name AS name, active_offers, page, page * 20 < active_offers AS has_more, CASE WHEN page < 9 THEN 'page 9 is past the last page (' || page || ')' END AS note, o.slug AS offer_slug, o.title, o.pos
FROM customer, n LEFT JOIN o ON o.pos // 20 + 1 = n.page WHERE c_custkey = 7""")
def j5_company_profile(spark, folder):
    known = table(spark, folder, "customer").select(F.concat(F.lit("company-"), F.col("c_custkey").cast("string")).alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("location"))
    return se.company_profile(known, offers(spark, folder), "company-7", page=9).select("name", "active_offers", "page", "has_more", "note", "offer_slug", "title", "pos")
