"""Dedupe, crawl audit, enrichment, request log, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import crawl as cr
from vacantia.plans.derived import CARDS, OFFERS, PAGE_LOG, REQUESTS, cards, offers, page_log, requests, table
from vacantia.plans.registry import query
from vacantia.streaming import jobs


@query("r1_dedupe_first", f"WITH {CARDS} SELECT slug, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page, pos) AS rn FROM cards_v) WHERE rn = 1")
def r1_dedupe_first(spark, folder):
    return cr.dedupe_first(cards(spark, folder), "slug", ["page", "pos"])


@query("r2_new_per_page", f"WITH {PAGE_LOG} SELECT page, cards, new, cards - new AS duplicates, sum(new) OVER (ORDER BY page) AS offers_so_far FROM page_log_v")
def r2_new_per_page(spark, folder):
    return cr.new_per_page(cards(spark, folder))


RUNS = PAGE_LOG + """,
runs_v AS (SELECT r_regionkey AS run, row_number() OVER (PARTITION BY r_regionkey ORDER BY page) AS page, CASE WHEN r_regionkey = 1 AND page > 40 THEN 0 ELSE cards END AS cards,
  CASE WHEN r_regionkey = 2 AND page > 30 THEN 0 ELSE new END AS new, CASE WHEN r_regionkey = 3 THEN 70 ELSE 2000 END AS last_page, CASE WHEN r_regionkey = 4 AND page > 60 THEN 'blocked' ELSE 'ok' END AS outcome
  FROM page_log_v, region)"""


@query("r3_stop_reason", f"""
WITH {RUNS},
marked AS (SELECT *, CASE WHEN outcome <> 'ok' THEN outcome WHEN cards = 0 THEN 'empty' WHEN page >= last_page THEN 'last_page' WHEN page >= 400 THEN 'max_pages'
  WHEN count(*) FILTER (WHERE new = 0) OVER (PARTITION BY run ORDER BY page ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN 'no_new' END AS reason FROM runs_v WHERE page <= 400),
stop AS (SELECT run, min(page) AS page, arg_min(reason, page) AS reason FROM marked WHERE reason IS NOT NULL GROUP BY run)
SELECT m.run, s.page, s.reason, count(*) FILTER (WHERE m.cards > 0) AS pages, sum(m.new) AS offers FROM marked m JOIN stop s ON m.run = s.run AND m.page <= s.page GROUP BY 1, 2, 3""")
def r3_stop_reason(spark, folder):
    """Five crawls of the same listing that stop for different reasons (one per region)."""
    from pyspark.sql import Window

    numbered = page_log(spark, folder)
    runs = table(spark, folder, "region").select(F.col("r_regionkey").alias("run"))
    log = numbered.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run")).join(runs, "run")
    original = F.col("_page")
    log = log.withColumnRenamed("page", "_page").withColumns({
        "page": F.row_number().over(Window.partitionBy("run").orderBy("_page")),
        "cards": F.when((F.col("run") == 1) & (original > 40), 0).otherwise(F.col("cards")), "new": F.when((F.col("run") == 2) & (original > 30), 0).otherwise(F.col("new")),
        "last_page": F.when(F.col("run") == 3, 70).otherwise(2000), "outcome": F.when((F.col("run") == 4) & (original > 60), "blocked").otherwise("ok")})
    return cr.stop_reason(log, by=["run"], outcome="outcome")


DETAILS = """details_v AS (SELECT 'offer-' || o_orderkey AS slug, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Detalle ' || o_orderpriority END AS description,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS salary_min FROM orders WHERE o_orderstatus <> 'P')"""


def details(spark, folder):
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").where(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit("offer-"), k.cast("string")).alias("slug"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Detalle "), "o_orderpriority")).alias("description"),
        F.when(k % 10 != 0, F.floor("o_totalprice").cast("bigint")).alias("salary_min"))


DETAIL_COLUMNS = ("description", "salary_min")


def enriched(spark, folder, **kw):
    base = offers(spark, folder).select("slug", "offer_id", F.lit("listado").alias("description"), "salary_min")
    return cr.enrich(base, details(spark, folder), fields=DETAIL_COLUMNS, **kw)


@query("j1_enrich", f"""
WITH {OFFERS}, {DETAILS}
SELECT o.slug, o.offer_id, coalesce(nullif(d.description, ''), 'listado') AS description, coalesce(d.salary_min, o.salary_min) AS salary_min,
  CASE WHEN d.slug IS NOT NULL THEN nullif(d.description, '') IS NOT NULL OR d.salary_min IS NOT NULL END AS enriched
FROM offers_v o LEFT JOIN details_v d ON o.slug = d.slug""")
def j1_enrich(spark, folder):
    return enriched(spark, folder)


@query("j1_enrich_limited", f"""
WITH {OFFERS}, {DETAILS}, targets AS (SELECT slug FROM offers_v ORDER BY offer_id LIMIT 500)
SELECT o.slug, o.offer_id, coalesce(nullif(d.description, ''), 'listado') AS description, coalesce(d.salary_min, o.salary_min) AS salary_min,
  CASE WHEN d.slug IS NOT NULL THEN nullif(d.description, '') IS NOT NULL OR d.salary_min IS NOT NULL END AS enriched
FROM offers_v o LEFT JOIN (SELECT * FROM details_v SEMI JOIN targets USING (slug)) d ON o.slug = d.slug""")
def j1_enrich_limited(spark, folder):
    """Only the first 500 offers are enriched; every offer is kept."""
    return enriched(spark, folder, order=["offer_id"], limit=500)


@query("g0_crawl_stats", f"""
WITH {OFFERS}, {DETAILS}, {PAGE_LOG},
l AS (SELECT count(*) FILTER (WHERE cards > 0) AS pages, count(*) FILTER (WHERE outcome = 'error') AS errors, max(CASE WHEN page = 1 THEN total END) AS total_reported,
  max(CASE WHEN page = 1 THEN last_page END) AS last_page, sum(requests) AS requests, round(sum(seconds), 1) AS duration_s FROM page_log_v),
c AS (SELECT count(*) AS cards, count(DISTINCT slug) AS offers FROM cards_v),
d AS (SELECT count(*) FILTER (WHERE ok) AS enriched, count(*) FILTER (WHERE NOT ok) AS failed FROM (SELECT nullif(description, '') IS NOT NULL OR salary_min IS NOT NULL AS ok FROM details_v SEMI JOIN offers_v USING (slug)))
SELECT pages, offers, cards - offers AS duplicates, enriched, errors + failed AS errors, 'PARTIAL' AS status, false AS blocked, total_reported, last_page, requests, duration_s FROM l, c, d""")
def g0_crawl_stats(spark, folder):
    return cr.crawl_stats(cards(spark, folder), page_log(spark, folder), enriched(spark, folder))


@query("g7_per_page_measure", f"""
WITH {PAGE_LOG} SELECT arg_min(cards, page) FILTER (WHERE has_next) AS per_page, max(last_page) AS last_page FROM page_log_v""")
def g7_per_page_measure(spark, folder):
    return cr.per_page_measure(page_log(spark, folder))


@query("h1_hourly_budget", f"""
WITH {REQUESTS}, w AS (SELECT event_id, us, count(*) OVER t AS demand, min(us) OVER t AS oldest FROM requests_v WINDOW t AS (PARTITION BY key ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
SELECT event_id, demand, demand > 1 AS over_budget, CASE WHEN demand > 1 THEN CAST(ceil((oldest + 3600000000 - us) / 60000000.0) AS BIGINT) END AS next_slot_min FROM w""")
def h1_hourly_budget(spark, folder):
    return cr.hourly_budget(requests(spark, folder).select("key", "event_id", "ts"), max_per_hour=1).select("event_id", "demand", "over_budget", "next_slot_min")


@query("h2_spacing_violations", f"""
WITH {REQUESTS} SELECT event_id, gap_us FROM (SELECT event_id, us - lag(us) OVER (PARTITION BY event_type ORDER BY us) AS gap_us FROM requests_v) WHERE gap_us < 60000000""")
def h2_spacing_violations(spark, folder):
    """Requests less than a minute after the previous one of the same endpoint."""
    log = requests(spark, folder).select(F.col("event_type").alias("key"), "event_id", "ts")
    return cr.spacing_violations(log, min_gap_s=60.0).select("event_id", "gap_us")


@query("h3_attempt_outcomes", f"""
WITH {REQUESTS},
t AS (SELECT request_id, attempt, retry_after * 5 AS retry_after, CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN NULL ELSE status END AS status,
  epoch_us(date_trunc('day', ts)) + CAST((attempt * 3.5 + event_id % 5) * 1000000 AS BIGINT) AS us FROM requests_v),
p AS (SELECT *, lag(us) OVER a AS prev, lag(status) OVER a AS pstatus, lag(retry_after) OVER a AS pafter FROM t WINDOW a AS (PARTITION BY request_id ORDER BY attempt)),
l AS (SELECT request_id, count(*) AS attempts, max(attempt) AS n,
  count(*) FILTER (WHERE prev IS NOT NULL AND (pstatus IS NULL OR pstatus IN (429, 500, 503)) AND us - prev < 1000000 * CASE WHEN pstatus IS NOT NULL AND pafter IS NOT NULL THEN greatest(pafter, 2.0) ELSE 2.0 * pow(2.0, attempt - 1) END) AS early_retries
  FROM p GROUP BY request_id)
SELECT l.request_id, attempts, t.status AS final_status, early_retries,
  CASE WHEN t.status IS NULL THEN 'error' WHEN t.status IN (429, 500, 503) AND retry_after > 300 AND n < 4 THEN 'blocked' WHEN t.status = 429 THEN 'blocked' WHEN t.status IN (500, 503) THEN 'error' ELSE 'ok' END AS outcome
FROM l JOIN t ON t.request_id = l.request_id AND t.attempt = l.n""")
def h3_attempt_outcomes(spark, folder):
    """Attempts a few seconds apart, some of them lost to network errors."""
    log = requests(spark, folder).withColumns({
        "status": F.when((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0), None).otherwise(F.col("status")), "retry_after": F.col("retry_after") * 5,
        "ts": F.expr("date_trunc('day', ts) + make_dt_interval(0, 0, 0, cast(attempt * 3.5 + event_id % 5 as decimal(18, 6)))")})
    return cr.attempt_outcomes(log)


@query("h4_stream_budget", f"""
WITH RECURSIVE {REQUESTS}, n AS (SELECT key, event_id, us, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS i FROM requests_v),
run AS (
  SELECT key, event_id, us, i, true AS admitted, [us] AS recent FROM n WHERE i = 1
  UNION ALL
  SELECT n.key, n.event_id, n.us, n.i, len(list_filter(run.recent, lambda t: t > n.us - 3600000000)) < 1,
    CASE WHEN len(list_filter(run.recent, lambda t: t > n.us - 3600000000)) < 1 THEN list_append(list_filter(run.recent, lambda t: t > n.us - 3600000000), n.us)
      ELSE list_filter(run.recent, lambda t: t > n.us - 3600000000) END
  FROM run JOIN n ON n.key = run.key AND n.i = run.i + 1),
w AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 AS mark FROM events)
SELECT event_id AS request_id, admitted, len(recent) AS used, CASE WHEN NOT admitted THEN CAST(ceil((recent[1] + 3600000000 - us) / 60000000.0) AS BIGINT) END AS next_slot_min
FROM run, w WHERE us // 1000 * 1000 + 1000 <= mark""")
def h4_stream_budget(spark, folder):
    """Exact admission with one request per hour and user, as a stateful stream over the event files; what the watermark (a day behind) has passed."""
    events = jobs.read_stream(spark, folder, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("request_id"), "ts")
    done = jobs.run_available(jobs.stream_budget(events, max_per_hour=1, late="1 day"))
    return done.select("request_id", "admitted", "used", "next_slot_min")


@query("h5_stream_offers", """
WITH b AS (SELECT 'user-' || user_id AS slug, event_type, epoch_us(ts) // 86400000000 * 86400000000 AS bucket_us, min(event_id) AS event_id FROM events GROUP BY ALL),
w AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 86400000000 AS mark FROM events)
SELECT slug, event_type, event_id FROM b, w WHERE bucket_us + 86400000000 <= mark""")
def h5_stream_offers(spark, folder):
    """First-wins dedupe of arriving cards per day: the smallest event of a user's events of one type."""
    slug = F.concat_ws("/", F.concat(F.lit("user-"), F.col("user_id").cast("string")), "event_type")
    stream = jobs.read_stream(spark, folder, "events").select(slug.alias("slug"), "ts", "event_id")
    kept = jobs.run_available(jobs.stream_offers(stream, order=["event_id"], horizon="1 day", late="1 day"))
    return kept.select(F.substring_index("slug", "/", 1).alias("slug"), F.substring_index("slug", "/", -1).alias("event_type"), "event_id")


@query("h6_stream_page_stats", """
WITH b AS (SELECT epoch_us(ts) // 600000000 * 600000000 AS bucket_us, count(*) AS cards, count(*) FILTER (WHERE event_type = 'signup') AS new, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1),
w AS (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 AS mark FROM events)
SELECT bucket_us, cards, new, errors FROM b, w WHERE bucket_us + 600000000 <= mark""")
def h6_stream_page_stats(spark, folder):
    """Per ten minutes; a bucket is emitted once the watermark (ten minutes behind the newest event) passes it."""
    stream = jobs.read_stream(spark, folder, "events").select(
        "ts", (F.col("event_type") == "signup").alias("new"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"))
    done = jobs.run_available(jobs.stream_page_stats(stream))
    return done.select(cr.micros(F.col("bucket_start")).alias("bucket_us"), "cards", "new", "errors")
