"""Text core, typed parsing, locations, URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.functions import folding as fo
from vacantia.functions import normalize as no
from vacantia.functions import robots as ro
from vacantia.functions import text as tx
from vacantia.functions import urls as ur
from vacantia.plans.derived import day, pick, pick_sql, table
from vacantia.plans.registry import query
from vacantia.portal import Portal

SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
FOLD_DOC = SQUEEZE.format("strip_accents(lower(replace(replace(text, 'ß', 'ss'), 'ẞ', 'ss')))")


@query("n1_fold", f"""
SELECT doc_id, md5({FOLD_DOC}) AS fold_md5, md5({SQUEEZE.format("strip_accents(lower(text))")}) AS normalize_md5,
  md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS key_md5 FROM documents""")
def n1_fold(spark, folder):
    forms = table(spark, folder, "documents").select("doc_id", fo.forms(F.col("text")).alias("f"))
    return forms.select("doc_id", F.md5("f.fold").alias("fold_md5"), F.md5("f.normalize").alias("normalize_md5"), F.md5("f.key").alias("key_md5"))


@query("n2_normalize_space", f"SELECT doc_id, md5({SQUEEZE.format('text')}) AS text_md5, length({SQUEEZE.format('text')}) AS n FROM documents")
def n2_normalize_space(spark, folder):
    clean = fo.normalize_space(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.md5(clean).alias("text_md5"), F.length(clean).cast("bigint").alias("n"))


@query("n3_parse_date_any", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (5, 6) THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def n3_parse_date_any(spark, folder):
    d = F.col("o_orderdate")
    formats = [F.date_format(d, p) for p in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss-03:00", "dd/MM/yy", "dd/MM/yyyy HH:mm", "d/M/yyyy")]
    shapes = F.array(*formats, F.concat(F.lit("2026-13-"), F.date_format(d, "dd")), F.concat(F.lit("hace "), F.date_format(d, "dd"), F.lit(" días")))
    return table(spark, folder, "orders").select("o_orderkey", tx.parse_date_any(shapes[(F.col("o_orderkey") % 7).cast("int")]).alias("parsed"))


@query("n4_to_int", """
WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE n END AS parsed, CASE WHEN o_orderkey % 6 IN (0, 4) THEN n END AS whole,
  CASE WHEN o_orderkey % 6 = 3 THEN CAST(n || '' || n AS BIGINT) WHEN o_orderkey % 6 = 2 THEN n * 100 + 50 WHEN o_orderkey % 6 = 5 THEN NULL ELSE n END AS digits FROM v""")
def n4_to_int(spark, folder):
    n = F.floor(F.col("o_totalprice") * 100).cast("bigint")
    dotted = F.replace(F.format_number(n, 0), F.lit(","), F.lit("."))
    shapes = F.array(dotted, F.concat(F.lit("$ "), dotted), F.concat(dotted, F.lit(",50")), F.concat(F.lit("Entre "), dotted, F.lit(" y "), dotted), n.cast("string"), F.lit("sin dato"))
    text = shapes[(F.col("o_orderkey") % 6).cast("int")]
    return table(spark, folder, "orders").select(
        "o_orderkey", tx.to_int(text).alias("parsed"), tx.whole_int(text).alias("whole"), tx.digits_only(text).try_cast("bigint").alias("digits"))


REGION_CASES = [
    ("Región Metropolitana", "Metropolitana"), ("REGIÓN DE VALPARAÍSO", "Valparaíso"), ("Región del Maule", "Maule"), ("Región de la Araucanía", "La Araucanía"),
    ("Región de Ñuble", "Ñuble"), ("Región del Biobío", "Bío Bío"), ("Región del Libertador General Bernardo O'Higgins", "O'Higgins"),
    ("Región de Aysén del General Carlos Ibáñez del Campo", "Aysén"), ("Región de Magallanes y de la Antártica Chilena", "Magallanes y Antártica Chilena"),
    ("R.Metropolitana", "Metropolitana"), ("R Maule", "Maule"), ("RM", "Metropolitana"), ("Aisén", "Aysén"), ("  Los   Lagos ", "Los Lagos"),
    ("Rancagua", None), ("Región", None), ("Chile", None), ("Lima", None),
]


@query("n5_norm_region", f"SELECT c_custkey, {pick_sql('c_custkey', [e for _, e in REGION_CASES])} AS region FROM customer")
def n5_norm_region(spark, folder):
    raw = pick(F.col("c_custkey"), [r for r, _ in REGION_CASES])
    return table(spark, folder, "customer").select("c_custkey", no.norm_region(raw).alias("region"))


@query("j6_region_lookup", f"""
SELECT {pick_sql('c_custkey', [r for r, _ in REGION_CASES])} AS raw, {pick_sql('c_custkey', [e for _, e in REGION_CASES])} AS region, count(*) AS offers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def j6_region_lookup(spark, folder):
    """The lookup table of all spellings in use: spellings are reduced first, each is resolved once."""
    raw = pick(F.col("c_custkey"), [r for r, _ in REGION_CASES])
    used = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return used.groupBy(raw.alias("raw")).agg(F.count("*").alias("offers")).select("raw", no.norm_region(F.col("raw")).alias("region"), "offers")


@query("n6_parse_location", """
SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN 'Metropolitana' WHEN 1 THEN 'Bío Bío' WHEN 2 THEN n_name WHEN 3 THEN NULL ELSE 'Valparaíso' END AS region,
  CASE c_custkey % 5 WHEN 4 THEN NULL ELSE c_mktsegment END AS comuna,
  CASE c_custkey % 5 WHEN 0 THEN 'Chile' WHEN 2 THEN 'Perú' WHEN 3 THEN 'Chile' WHEN 4 THEN 'Chile' END AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def n6_parse_location(spark, folder):
    df = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seg, nation = F.col("c_mktsegment"), F.col("n_name")
    shapes = F.array(
        F.concat(seg, F.lit(", "), nation, F.lit(", Región Metropolitana, Chile")), F.concat(seg, F.lit(" ,Región del Biobío")), F.concat(seg, F.lit(", Región de "), nation, F.lit(", Perú")),
        F.concat(seg, F.lit(", Chile")), F.lit("Región de Valparaíso, Chile"))
    return df.select("c_custkey", no.parse_location(shapes[(F.col("c_custkey") % 5).cast("int")]).alias("p")).select("c_custkey", "p.*")


@query("n7_split_tags", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN p_type WHEN 2 THEN NULL ELSE p_type END AS workday,
  CASE p_partkey % 4 WHEN 0 THEN 'Híbrido' WHEN 1 THEN 'Trabajo REMOTO' WHEN 2 THEN 'Semipresencial' ELSE p_brand END AS modality FROM part""")
def n7_split_tags(spark, folder):
    t, b = F.col("p_type"), F.col("p_brand")
    shapes = F.array(F.array(t, F.lit("Híbrido")), F.array(F.lit("Trabajo REMOTO"), t), F.array(F.lit("Semipresencial")), F.array(t, b))
    return table(spark, folder, "part").select("p_partkey", no.split_tags(shapes[(F.col("p_partkey") % 4).cast("int")]).alias("s")).select("p_partkey", "s.*")


@query("n8_label_types", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'intern' WHEN 1 THEN 'full_time' END AS employment_type, CASE p_partkey % 3 WHEN 0 THEN 'hybrid' WHEN 2 THEN 'remote' END AS modality FROM part""")
def n8_label_types(spark, folder):
    t = F.col("p_type")
    shapes = F.array(F.array(t, F.lit("PRÁCTICAS"), F.lit("hibrido")), F.array(F.lit("Jornada  completa"), t), F.array(F.lit("30 horas"), F.lit("Remoto")))
    return table(spark, folder, "part").select("p_partkey", no.label_types(shapes[(F.col("p_partkey") % 3).cast("int")]).alias("s")).select("p_partkey", "s.*")


@query("n9_parse_salary", """
WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100) AS BIGINT) AS lo, CAST(floor(o_totalprice * 150) AS BIGINT) AS hi FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'CLP' WHEN 1 THEN 'COP' WHEN 2 THEN 'PEN' END AS currency, CASE WHEN o_orderkey % 4 < 3 THEN lo END AS salary_min,
  CASE o_orderkey % 4 WHEN 0 THEN hi WHEN 1 THEN hi WHEN 2 THEN lo END AS salary_max FROM v""")
def n9_parse_salary(spark, folder):
    money = lambda f: F.replace(F.format_number(F.floor(F.col("o_totalprice") * f).cast("bigint"), 0), F.lit(","), F.lit("."))
    lo, hi = money(100), money(150)
    shapes = F.array(
        F.concat(F.lit("CLP $"), lo, F.lit(" - $"), hi), F.concat(F.lit("COP $"), lo, F.lit(",00 - $"), hi, F.lit(",00")), F.concat(F.lit("PEN "), lo), F.concat(F.lit("A convenir "), lo))
    return table(spark, folder, "orders").select("o_orderkey", no.parse_salary(shapes[(F.col("o_orderkey") % 4).cast("int")]).alias("s")).select(
        "o_orderkey", "s.currency", F.col("s.min").alias("salary_min"), F.col("s.max").alias("salary_max"))


@query("n11_posted_at", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN DATE '2026-09-24' WHEN 1 THEN CAST(DATE '2026-09-24' - to_days(CAST(o_orderkey % 90 AS INTEGER)) AS DATE)
  WHEN 2 THEN CAST(DATE '2026-09-24' - to_days(CAST(30 * (o_orderkey % 12) AS INTEGER)) AS DATE) END AS posted FROM orders""")
def n11_posted_at(spark, folder):
    k = F.col("o_orderkey")
    s = lambda m: (k % m).cast("string")
    shapes = F.array(F.concat(F.lit("Hace "), s(24), F.lit(" horas")), F.concat(F.lit("hace "), s(90), F.lit(" días")), F.concat(F.lit("HACE "), s(12), F.lit(" meses")), F.concat(s(9), F.lit(" días")))
    return table(spark, folder, "orders").select("o_orderkey", no.posted_at(shapes[(k % 4).cast("int")], day("2026-09-24")).alias("posted"))


COUNTRY_CASES = [("peru", "Perú", "PE"), (" MÉXICO ", "México", "MX"), ("Chile", "Chile", "CL"), ("brasil", "Brasil", "BR"), ("Francia", None, None), ("COLOMBIA", "Colombia", "CO")]


@query("n12_normalize_country", f"""
SELECT c_custkey, {pick_sql('c_custkey', [c[1] for c in COUNTRY_CASES])} AS country, {pick_sql('c_custkey', [c[2] for c in COUNTRY_CASES])} AS code,
  CASE WHEN c_custkey % 6 = 4 THEN NULL ELSE array_to_string(list_distinct([{pick_sql('c_custkey', [c[1] for c in COUNTRY_CASES])}]), ';') END AS listed FROM customer""")
def n12_normalize_country(spark, folder):
    raw = pick(F.col("c_custkey"), [c[0] for c in COUNTRY_CASES])
    many = no.normalize_countries(F.array(raw, F.lit(" "), F.upper(raw)))
    return table(spark, folder, "customer").select(
        "c_custkey", no.normalize_country(raw).alias("country"), no.country_code(raw).alias("code"),
        F.when(many["error"].isNull(), F.array_join(many["countries"], ";")).alias("listed"))


@query("n13_slug_from_url", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'offer-' || o_orderkey WHEN 1 THEN 'offer-' || o_orderkey WHEN 2 THEN 'offer-' || o_orderkey WHEN 3 THEN 'ñ-' || o_orderkey WHEN 4 THEN 'Offer_' || o_orderkey END AS lenient,
  CASE WHEN o_orderkey % 6 = 0 THEN 'offer-' || o_orderkey END AS strict, CASE WHEN o_orderkey % 6 IN (0, 1) THEN 'offer-' || o_orderkey END AS linked,
  CASE o_orderkey % 6 WHEN 3 THEN NULL WHEN 4 THEN 'Offer_' || o_orderkey WHEN 5 THEN NULL ELSE 'offer-' || o_orderkey END AS listed FROM orders""")
def n13_slug_from_url(spark, folder):
    k = F.col("o_orderkey").cast("string")
    shapes = F.array(
        F.concat(F.lit("https://JOBS.example.com/job_offers/offer-"), k, F.lit("/?ref=1")), F.concat(F.lit("/job_offers/offer-"), k), F.concat(F.lit("https://x.example.org/job_offers/offer-"), k, F.lit("/save_later#t")),
        F.concat(F.lit("/job_offers/%C3%B1-"), k), F.concat(F.lit("/job_offers/Offer_"), k), F.concat(F.lit("https://jobs.example.com/companies/c "), k))
    url = shapes[(F.col("o_orderkey") % 6).cast("int")]
    return table(spark, folder, "orders").select(
        "o_orderkey", ur.slug_from_href(url).alias("lenient"), ur.slug_from_input(url).alias("strict"), ur.slug_from_link(url).alias("linked"), ur.listed_slug(url).alias("listed"))


@query("n14_build_url", """
SELECT o_orderkey, 'https://jobs.example.com/job_offers/offer~' || o_orderkey || '.%C3%B1' AS job, 'https://jobs.example.com/companies/c-' || o_custkey AS company,
  'https://jobs.example.com/job_offers/offer_' || o_orderkey || '?tab=apply' AS apply, CAST(NULL AS VARCHAR) AS invalid FROM orders""")
def n14_build_url(spark, folder):
    k = F.col("o_orderkey").cast("string")
    return table(spark, folder, "orders").select(
        "o_orderkey", ur.build_url(F.concat(F.lit("offer~"), k, F.lit(".ñ"))).alias("job"), ur.build_url(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")), "company").alias("company"),
        ur.build_url(F.concat(F.lit("offer_"), k), "apply").alias("apply"), ur.build_url(F.concat(F.lit("../"), k)).alias("invalid"))


@query("n15_offer_status", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) < DATE '1999-01-01' THEN 'expired' ELSE 'open' END AS status FROM orders")
def n15_offer_status(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", no.offer_status(F.col("o_orderdate").cast("date"), day("1999-01-01")).alias("status"))


@query("n16_clip", r"""
WITH v AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 200 THEN s WHEN contains(left(s, 200), ' ') THEN regexp_extract(left(s, 200), '^(.*) [^ ]*$', 1, 's') ELSE left(s, 200) END AS collapsed,
  CASE WHEN length(text) <= 200 THEN text WHEN regexp_matches(substr(text, 201, 1), '^\s') OR regexp_matches(left(text, 200), '\s$') THEN regexp_replace(left(text, 200), '\s+$', '')
    WHEN regexp_matches(left(text, 200), '\S\s+\S*$') THEN regexp_extract(left(text, 200), '^(.*\S)\s+\S*$', 1, 's') ELSE left(text, 200) END AS form,
  md5(left(text, 4000)) AS capped_md5, length(text) > 4000 AS truncated FROM v""")
def n16_clip(spark, folder):
    text = F.col("text")
    capped, truncated = tx.cap_text(text)
    return table(spark, folder, "documents").select(
        "doc_id", tx.clip_collapsed(text, 200).alias("collapsed"), tx.clip_form(text, F.lit(200)).alias("form"), F.md5(capped).alias("capped_md5"), truncated.alias("truncated"))


@query("n17_company_tags", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL ELSE s_name END AS sector, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ' - 500 empleados' WHEN 2 THEN '1.' || lpad(CAST(s_suppkey AS VARCHAR), 3, '0') || '+ empleados' END AS size,
  CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1000 + s_suppkey WHEN 2 THEN 1 END AS active_offers FROM supplier""")
def n17_company_tags(spark, folder):
    k = F.col("s_suppkey")
    shapes = F.array(
        F.array(F.concat(k.cast("string"), F.lit(" - 500 empleados")), F.col("s_name")), F.array(F.col("s_name")), F.array(F.concat(F.lit("1."), F.lpad(k.cast("string"), 3, "0"), F.lit("+ empleados"))))
    counts = F.array(F.lit("Sin ofertas activas"), F.concat(F.replace(F.format_number(k + 1000, 0), F.lit(","), F.lit(".")), F.lit(" ofertas activas")), F.lit("1 Oferta activa"), F.lit("ofertas"))
    return table(spark, folder, "supplier").select(
        "s_suppkey", no.company_tags(shapes[(k % 3).cast("int")]).alias("t"), no.offer_count(counts[(k % 4).cast("int")]).alias("active_offers")).select("s_suppkey", "t.sector", "t.size", "active_offers")


@query("n18_role_pills", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'empty role' WHEN 2 THEN 'role holds a comma' ELSE 'role too long' END AS violation, CASE WHEN p_partkey % 4 = 0 THEN p_name || ';' || p_brand END AS pills FROM part""")
def n18_role_pills(spark, folder):
    n, b = F.col("p_name"), F.col("p_brand")
    shapes = F.array(F.array(F.concat(F.lit("  "), n), b), F.array(n, F.lit(" ")), F.array(F.concat(n, F.lit(","), b)), F.array(b, F.repeat(n, 20)))
    return table(spark, folder, "part").select("p_partkey", no.role_pills(shapes[(F.col("p_partkey") % 4).cast("int")]).alias("r")).select(
        "p_partkey", "r.violation", F.when(F.col("r.violation").isNull(), F.array_join("r.pills", ";")).alias("pills"))


@query("x6_html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'), '</(?:p|div|li|ul|ol|h[1-6]|tr|table|section)\s*>', chr(10), 'gi'), '<li\b[^>]*>', '- ', 'gi'), '<[^>]+>', ' ', 'g') AS s FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS s FROM a)
SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f\v]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text_md5 FROM b""")
def x6_html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.md5(tx.html_to_text(F.col("html"))).alias("text_md5"))


@query("k7_strip_control_chars", r"""
SELECT doc_id, md5(text || 'x' || chr(9)) AS text_md5, source || 'y' || '|' || lang AS parts FROM documents""")
def k7_strip_control_chars(spark, folder):
    dirty = table(spark, folder, "documents").select(
        "doc_id", F.concat("text", F.lit("\x1b\x07x\t\x9b")).alias("text"), F.array(F.concat("source", F.lit("\x7fy")), F.concat(F.lit("\x85"), "lang")).alias("parts"))
    return tx.strip_control_chars(dirty).select("doc_id", F.md5("text").alias("text_md5"), F.array_join("parts", "|").alias("parts"))


SITE = Portal(base_url="https://blog.tionsh.example.net", hosts=("blog.tionsh.example.net",))


@query("g2_url_guard", """
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https://blog\\.tionsh\\.example\\.net/') THEN 'host' WHEN page_id % 4 = 0 THEN 'param' END AS refusal,
  page_id % 4 < 3 AS redirect_ok FROM pages""".replace("\\\\", "\\"))
def g2_url_guard(spark, folder):
    k = F.col("page_id")
    bare = F.substring_index("url", "#", 1)
    url = F.when(k % 4 == 0, F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("Sort_By%5B%5D=x"))).otherwise(F.col("url"))
    path = ur.url_part(F.col("url"), "path")
    target = F.array(path, F.lit("/job_offers"), F.concat(F.lit("/job_offers/p-"), k.cast("string")), F.concat(F.lit("/job_offers/p/"), k.cast("string")))[(k % 4).cast("int")]
    return table(spark, folder, "pages").select("page_id", ur.url_refusal(url, SITE).alias("refusal"), ur.redirect_allowed(target, path).alias("redirect_ok"))


ROBOTS = """User-agent: other
Disallow: /

User-agent: *
Disallow: /*.html$
Disallow: /en/4
Allow: /en/45
Disallow: /*?page=
Allow: /es/
"""


@query("g1_robots_allowed", r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS p FROM pages),
best AS (SELECT page_id, p, list_max([CASE WHEN regexp_matches(p, '^/.*\.html$') THEN 2 * 8 END, CASE WHEN starts_with(p, '/en/4') THEN 2 * 5 END, CASE WHEN starts_with(p, '/en/45') THEN 2 * 6 + 1 END,
  CASE WHEN regexp_matches(p, '^/.*\?page=') THEN 2 * 8 END, CASE WHEN starts_with(p, '/es/') THEN 2 * 4 + 1 END]) AS best FROM u)
SELECT page_id, (best IS NULL OR best % 2 = 1) AND NOT starts_with(p, '/en/4') AS allowed FROM best""")
def g1_robots_allowed(spark, folder):
    return table(spark, folder, "pages").select("page_id", ro.robots_allowed(F.col("url"), ROBOTS, "my-crawler/1.0").alias("allowed"))


@query("j7_robots_match", r"""
WITH u AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS p FROM pages)
SELECT host, count(*) AS urls, count(*) FILTER (WHERE NOT regexp_matches(p, '^/.*\.html$')) AS allowed FROM u GROUP BY host""")
def j7_robots_match(spark, folder):
    """Rule match over a frontier: allowed URLs per host."""
    rules = "User-agent: *\nDisallow: /*.html$\n"
    host = ur.url_part(F.col("url"), "host")
    return table(spark, folder, "pages").groupBy(host.alias("host")).agg(
        F.count("*").alias("urls"), F.count_if(ro.robots_allowed(F.col("url"), rules, "my-crawler")).alias("allowed"))


@query("j7_robots_join", r"""
WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS p FROM pages)
SELECT page_id, host, CASE length(host) % 4 WHEN 0 THEN NOT regexp_matches(p, '^/.*\.html$') WHEN 1 THEN NOT starts_with(p, '/en/') OR starts_with(p, '/en/4') WHEN 2 THEN false END AS allowed FROM u""")
def j7_robots_join(spark, folder):
    """A frontier of many hosts, each judged by its own captured file; the hosts of one length have none."""
    host = F.lower(ur.url_part(F.col("url"), "host"))
    kind = F.length("host") % 4
    body = F.when(kind == 0, "User-agent: *\nDisallow: /*.html$\n").when(kind == 1, "User-agent: other\nDisallow: /\n\nUser-agent: my-crawler\nAllow: /en/4\nDisallow: /en/\n")
    pages = table(spark, folder, "pages").withColumn("host", host)
    files = pages.select("host").distinct().where(kind < 3).select("host", F.when(kind == 2, 503).otherwise(200).alias("status"), body.alias("body"))
    return ro.robots_verdicts(pages, ro.robots_table(files, "my-crawler/1.0")).select("page_id", "host", "allowed")


@query("g8_listing_frontier", """
SELECT n_nationkey, page, 'https://jobs.example.com/job_offers?countries%5B%5D=' || n_name || '&countries%5B%5D=Per%C3%BA&worldwide=1' || CASE WHEN n_nationkey % 2 = 0 THEN '&date=last_week' ELSE '' END ||
  CASE WHEN page > 1 THEN '&page=' || page ELSE '' END AS url
FROM (SELECT n_nationkey, n_name, unnest(range(1, n + 1)) AS page FROM (SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2))""")
def g8_listing_frontier(spark, folder):
    runs = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("last_page"))
    jobs = runs.select("n_nationkey", F.array("n_name", F.lit("Perú")).alias("countries"), "last_page", F.when(F.col("n_nationkey") % 2 == 0, "last_week").alias("date"))
    return ur.listing_frontier(jobs).select("n_nationkey", "page", "url")


@query("x16_resolve_redirects", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'offer-' || (o_orderkey + 1) END AS canonical, o_orderkey % 4 = 2 AS gone, CASE WHEN o_orderkey % 4 = 3 THEN o_orderkey % 9 + 1 ELSE 1 END AS page FROM orders""")
def x16_resolve_redirects(spark, folder):
    k = F.col("o_orderkey")
    base = F.lit("https://jobs.example.com/job_offers/offer-")
    url = F.concat(base, k.cast("string"))
    final = F.array(url, F.concat(base, (k + 1).cast("string")), F.lit("https://jobs.example.com/users/sign_in"), F.concat(url, F.lit("?page="), (k % 9 + 1).cast("string")))[(k % 4).cast("int")]
    return table(spark, folder, "orders").select("o_orderkey", ur.resolve_redirect(url, final).alias("r")).select("o_orderkey", "r.canonical", "r.gone", "r.page")


