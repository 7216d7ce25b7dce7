"""Job-board views over the star-schema tables: no table holds offers, so both engines derive them.

Every view is a projection, an equality join or a bounded grouping of its table, so it grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.operators.crawl import new_per_page

DAY_ONE = "1995-01-01"


def spread(df: DataFrame, by: Column) -> DataFrame:
    """`df` partitioned by `by` over all shuffle partitions. Rendering and parsing pages is much work on
    little data, which adaptive execution would otherwise merge into a few tasks by its size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(value: str) -> Column:
    return F.lit(value).cast("date")


TODAY = "2001-06-15"


def offers(spark: SparkSession, folder: str) -> DataFrame:
    """One offer per order, placed by customer segment, nation and region."""
    t = lambda name: table(spark, folder, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = t("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    paid = F.col("o_orderkey") % 3 != 0
    posted = F.col("o_orderdate").cast("date")
    return joined.select(
        F.concat(F.lit("offer-"), F.col("o_orderkey").cast("string")).alias("slug"), F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
        F.col("c_name").alias("company"), F.concat(F.lit("company-"), F.col("c_custkey").cast("string")).alias("company_slug"),
        F.concat_ws(", ", "c_mktsegment", "n_name", "r_name").alias("location_text"), F.col("c_mktsegment").alias("comuna"), F.col("n_name").alias("region"),
        F.col("r_name").alias("country"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("area_path"),
        F.when(F.col("o_orderstatus") == "F", "full_time").when(F.col("o_orderstatus") == "O", "part_time").otherwise("contractor").alias("employment_type"),
        F.when(paid, F.floor(F.col("o_totalprice") * 0.8)).cast("bigint").alias("salary_min"), F.when(paid, F.floor("o_totalprice")).cast("bigint").alias("salary_max"),
        F.when(paid, "CLP").alias("salary_currency"), posted.alias("posted_at"), F.date_add(posted, 90).alias("valid_through"), F.col("o_orderkey").alias("offer_id"))


OFFERS = f"""offers_v AS (
  SELECT 'offer-' || o_orderkey AS slug, o_orderpriority || ' ' || c_mktsegment AS title, c_name AS company, 'company-' || c_custkey AS company_slug,
    c_mktsegment || ', ' || n_name || ', ' || r_name AS location_text, c_mktsegment AS comuna, n_name AS region, r_name AS country,
    r_name || '/' || n_name || '/' || c_mktsegment AS area_path,
    CASE o_orderstatus WHEN 'F' THEN 'full_time' WHEN 'O' THEN 'part_time' ELSE 'contractor' END AS employment_type,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice * 0.8) AS BIGINT) END AS salary_min,
    CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary_max,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'CLP' END AS salary_currency,
    CAST(o_orderdate AS DATE) AS posted_at, CAST(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS DATE) AS valid_through, o_orderkey AS offer_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cards(spark: SparkSession, folder: str) -> DataFrame:
    """One card per line item: the listing page is the ship day, the position orders cards within it."""
    page = F.datediff(F.col("l_shipdate").cast("date"), day(DAY_ONE))
    return table(spark, folder, "lineitem").select(
        page.alias("page"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("offer-"), F.col("l_orderkey").cast("string")).alias("slug"))


CARDS = f"""cards_v AS (
  SELECT date_diff('day', DATE '{DAY_ONE}', CAST(l_shipdate AS DATE)) AS page, l_orderkey * 8 + l_linenumber AS pos, 'offer-' || l_orderkey AS slug FROM lineitem)"""

#: page_log_v: what a crawl of those pages logs; every 50th request fails, page 1 announces the last page.
PAGE_LOG = CARDS + """,
firsts_v AS (SELECT page, count(*) AS new FROM (SELECT slug, min(page) AS page FROM cards_v GROUP BY slug) GROUP BY page),
page_log_v AS (
  SELECT c.page, c.cards, coalesce(f.new, 0) AS new, 2000 AS last_page, 30000 AS total, CASE WHEN c.page % 50 = 0 THEN 'error' ELSE 'ok' END AS outcome,
    1 + c.page % 3 AS requests, c.cards * 0.5 AS seconds, c.page < 2400 AS has_next
  FROM (SELECT page, count(*) AS cards FROM cards_v GROUP BY page) c LEFT JOIN firsts_v f ON c.page = f.page)"""


def page_log(spark: SparkSession, folder: str) -> DataFrame:
    page = F.col("page")
    return new_per_page(cards(spark, folder)).select(
        "page", "cards", "new", F.lit(2000).alias("last_page"), F.lit(30000).alias("total"), F.when(page % 50 == 0, "error").otherwise("ok").alias("outcome"),
        (1 + page % 3).alias("requests"), (F.col("cards") * 0.5).alias("seconds"), (page < 2400).alias("has_next"))


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """One company per supplier."""
    nation = table(spark, folder, "nation")
    return table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("company-"), F.col("s_suppkey").cast("string")).alias("slug"), F.col("s_name").alias("name"), F.col("n_name").alias("location"),
        F.floor(F.abs("s_acctbal") / 100).cast("bigint").alias("active_offers"))


COMPANIES = """companies_v AS (
  SELECT 'company-' || s_suppkey AS slug, s_name AS name, n_name AS location, CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS active_offers
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

STATUS = {"signup": 200, "view": 200, "click": 503, "purchase": 429, "error": 500}


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One request per event; a logical request is a user's events of one day, numbered as attempts."""
    from pyspark.sql import Window

    rows = table(spark, folder, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), "event_id", "ts", "event_type", "value",
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("request_id"))
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATUS.items()])
    number = F.row_number().over(Window.partitionBy("request_id").orderBy("ts", "event_id")) - 1
    return rows.withColumns({"attempt": number, "status": status, "retry_after": F.when(F.col("event_type") == "purchase", F.col("value"))})


REQUESTS = f"""requests_v AS (
  SELECT 'user-' || user_id AS key, event_id, ts, event_type, value, user_id || '-' || strftime(ts, '%Y%m%d') AS request_id,
    row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS attempt,
    CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in STATUS.items())} END AS status,
    CASE WHEN event_type = 'purchase' THEN value END AS retry_after, epoch_us(ts) AS us FROM events)"""


def pick(key: Column, values: list) -> Column:
    """The value at ``key % len(values)``: how a key renders one of several spellings."""
    return F.array(*[F.lit(v) for v in values])[(key % len(values)).cast("int")]


def pick_sql(key: str, values: list) -> str:
    """The same in SQL."""
    def literal(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return f"list_extract([{', '.join(map(literal, values))}], {key} % {len(values)} + 1)"


# ---- rendered pages -----------------------------------------------------------------------------
def listing_pages(spark: SparkSession, folder: str, per_page: int = 15) -> DataFrame:
    """Result pages of at most `per_page` cards rendered from the offers, as a site would serve them."""
    money = lambda c: F.replace(F.format_number(F.col(c), 0), F.lit(","), F.lit("."))
    salary = F.when(F.col("salary_min").isNotNull(), F.concat(
        F.lit('<span class="tag-primary">CLP $'), money("salary_min"), F.lit(" - $"), money("salary_max"), F.lit("</span>"))).otherwise("")
    label = F.element_at(F.create_map(*map(F.lit, ("full_time", "Jornada Completa", "part_time", "Jornada Parcial", "contractor", "Freelance / Por contrato"))), F.col("employment_type"))
    card = F.concat(
        F.lit('<div class="card job-offer-card" data-scroll-restore-slug="'), "slug", F.lit('"><form action="/job_offers/'), "slug", F.lit('/save_later"></form><a href="/job_offers/'), "slug",
        F.lit('?ref=list"><h2 class="job-offer-card__title">\n  '), "title", F.lit('</h2></a><p class="item-title">'), "company",
        F.lit('</p><div class="item-subtitle"><span class="break-words">'), "location_text", F.lit("</span><span>Hace "), (F.col("offer_id") % 30).cast("string"),
        F.lit(' días</span></div><span class="tag-navy">'), label, F.lit('</span><span class="tag-navy">Remoto</span>'), salary, F.lit("</div>"))
    number = F.floor(F.col("offer_id") / per_page)
    grouped = spread(offers(spark, folder).withColumn("page_id", number), F.col("page_id")).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col("offer_id").alias("o"), card.alias("html")))).alias("cards"))
    nav = F.concat(F.lit('<nav class="pagination pagination-nav"><a aria-label="Página '), (F.col("page_id") + 2).cast("string"), F.lit('" href="?page='), (F.col("page_id") + 2).cast("string"),
                   F.lit('">n</a><span aria-current="page">'), (F.col("page_id") + 1).cast("string"), F.lit('</span><a aria-label="Página siguiente" href="#">&gt;</a></nav>'))
    return grouped.select(
        "page_id", (F.col("page_id") + 1).cast("int").alias("page"), F.lit("2026-09-24T12:00:00+00:00").alias("fetched_at"),
        F.concat(
            F.lit('<html lang="es"><body><turbo-frame id="job_offers_results"><p class="job-offers-results-count"><b>'), F.replace(F.format_number(F.col("page_id") + 1000, 0), F.lit(","), F.lit(".")),
            F.lit("</b> ofertas</p>"), F.array_join(F.transform("cards", lambda c: c["html"]), "\n"), nav, F.lit("</turbo-frame></body></html>")).alias("html"))


def detail_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One detail page per part: JSON-LD in several salary shapes plus the visible page."""
    key = F.col("p_partkey")
    low, high = F.floor(F.col("p_retailprice") * 100).cast("bigint"), F.floor(F.col("p_retailprice") * 200).cast("bigint")
    s = lambda c: c.cast("string")
    shapes = [
        F.concat(F.lit('{"currency":"CLP","value":{"minValue":'), s(low), F.lit(',"maxValue":'), s(high), F.lit(',"unitText":"MONTH"}}')),
        F.concat(F.lit('{"value":{"value":'), s(low), F.lit("}}")), F.concat(F.lit('{"value":'), s(low), F.lit(".0}")),
        F.concat(F.lit('{"value":"$'), F.replace(F.format_number(low, 0), F.lit(","), F.lit(".")), F.lit('"}')), F.concat(F.lit('[{"value":{"minValue":'), s(low), F.lit("}}]")),
        F.concat(F.lit('{"minValue":'), s(high), F.lit(',"maxValue":'), s(low), F.lit("}")), F.lit('{"value":true}'),
    ]
    shape = F.array(*shapes)[(key % len(shapes)).cast("int")]
    ld = F.concat(
        F.lit('{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"x"},{"@type":["JobPosting"],"title":"'), "p_name", F.lit('","description":"\\u003cp\\u003e'), "p_type",
        F.lit(" &amp;amp; "), "p_brand", F.lit('\\u003c/p\\u003e\\u003cul\\u003e\\u003cli\\u003e'), "p_name", F.lit('\\u003c/li\\u003e\\u003c/ul\\u003e","datePosted":"2026-09-'), F.lpad(s(key % 30 + 1), 2, "0"),
        F.lit('T10:00:00-03:00","validThrough":"'), F.when(key % 5 == 0, "2026-13-45").otherwise("2026-12-22"), F.lit('","baseSalary":'), shape, F.lit(',"identifier":{"@type":"PropertyValue","value":'),
        s(key), F.lit('},"employmentType":"FULL_TIME","hiringOrganization":{"name":"'), "p_brand", F.lit('","sameAs":"https://jobs.example.com/companies/'),
        F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit('","identifier":{"value":"11.111.111-0"}}}]}'))
    visible = F.concat(
        F.lit('<div class="card"><div class="job-offer-show-title"><h1>'), "p_name", F.lit(" "), s(key), F.lit('</h1></div><span class="break-words">Ñuñoa, Chile</span><span class="tag-navy">Híbrido</span><div class="item-subtitle"><span>'),
        F.col("p_size").cast("string"), F.lit(' vacantes</span></div></div><h3>Requerimientos</h3><div><div data-text-toggle-target="fullText"><p>'), "p_type", F.lit("</p><ul><li>"), "p_brand", F.lit("</li><li>"),
        F.col("p_size").cast("string"), F.lit("</li></ul></div></div>"))
    block = F.when(key % 7 == 3, F.lit('<script type="application/ld+json">{broken</script>')).otherwise("")
    return spread(table(spark, folder, "part"), key).select(
        key.alias("page_id"), F.concat(F.lit("part-"), s(key)).alias("slug"),
        F.concat(F.lit('<html lang="es"><head>'), block, F.when(key % 11 == 0, "").otherwise(F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))), F.lit("</head><body>"), visible, F.lit("</body></html>")).alias("html"))
