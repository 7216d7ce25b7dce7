"""Sources, sinks and contracts: round trips of the derived offers through written files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.operators import quality as qu
from vacantia.operators import search as se
from vacantia.plans.answer_queries import QUEUE, queue
from vacantia.plans.derived import OFFERS, TODAY, day, offers, table
from vacantia.plans.registry import query
from vacantia.plans.search_queries import FOUND, FULL
from vacantia.schemas import FIELDS
from vacantia.session import work_folder
from vacantia.sources import readers as rd
from vacantia.sources import writers as wr


def records(spark, folder) -> DataFrame:
    """Offer records with the characters that break naive files."""
    k = F.col("offer_id")
    title = F.when(k % 4 == 0, F.concat(F.lit("=1+"), "title")).when(k % 4 == 1, F.concat(F.lit('"Ñandú", '), "title")).otherwise(F.col("title"))
    text = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit("línea\n"), "location_text")).when(k % 5 == 2, F.concat(F.lit("u\u2028v \x07"), "comuna"))
    return offers(spark, folder).select(
        "slug", title.alias("title"), "company", "location_text", "region", "comuna", "country", F.lit("https://jobs.example.com").alias("url"), text.alias("description"), "salary_min", "salary_max",
        F.col("posted_at").alias("published_at"), "valid_through")


def shown(df: DataFrame) -> DataFrame:
    return df.select("slug", "title", "company", F.md5(F.coalesce("description", F.lit("-"))).alias("description_md5"), "salary_min", "salary_max", "published_at", "external_id")


RECORD = "CASE offer_id % 4 WHEN 0 THEN {q}'=1+' || title WHEN 1 THEN '\"Ñandú\", ' || title ELSE title END AS title, company, md5(coalesce(CASE offer_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'línea' || chr(10) || location_text WHEN 2 THEN 'u' || chr(8232) || 'v ' || comuna END, '-')) AS description_md5, salary_min, salary_max, CAST(posted_at AS VARCHAR) AS published_at, CAST(NULL AS VARCHAR) AS external_id"


@query("s1_read_offers_jsonl", f"WITH {OFFERS} SELECT slug, {RECORD.format(q='')} FROM offers_v")
def s1_read_offers_jsonl(spark, folder):
    path = f"{work_folder(spark)}/offers.jsonl"
    wr.write_jsonl(records(spark, folder), path)
    return shown(rd.read_offers_jsonl(spark, path)[0])


@query("k1_write_jsonl", f"WITH {OFFERS} SELECT slug, '{','.join(FIELDS)}' AS keys FROM offers_v")
def k1_write_jsonl(spark, folder):
    """The written lines themselves: every key present, in the fixed order."""
    path = f"{work_folder(spark)}/offers.jsonl"
    wr.write_jsonl(records(spark, folder), path)
    keys = F.array_join(F.regexp_extract_all("value", F.lit('[{,]"([a-z_]+)":'), F.lit(1)), ",")
    return spark.read.text(path).select(F.get_json_object("value", "$.slug").alias("slug"), keys.alias("keys"))


@query("k2_write_csv", f"WITH {OFFERS} SELECT chr(65279) || '{','.join(FIELDS)}' AS header, count(*) FILTER (WHERE offer_id % 4 = 0) AS quoted, 0 AS formulas FROM offers_v")
def k2_write_csv(spark, folder):
    """The written text: mark and header, formula cells behind a quote mark, none left bare."""
    path = f"{work_folder(spark)}/offers.csv"
    wr.write_csv(records(spark, folder), path)
    line = F.col("value")
    lines = spark.read.text(path).select(F.when(F.contains(line, F.lit("slug,title")), line).alias("h"), line.rlike(",'=1\\+").alias("q"), line.rlike(",=1\\+").alias("f"))
    # The text reader drops the mark at the start of a file, so it is looked for in the bytes.
    mark = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.hex(F.substring("content", 1, 3)).alias("mark")).where(F.col("mark") != "")
    marked = mark.agg(F.when(F.min(F.col("mark") == "EFBBBF"), "\ufeff").otherwise("")).scalar()
    counted = lines.agg(F.max("h").alias("h"), F.count_if("q").alias("quoted"), F.count_if("f").alias("formulas"))
    return counted.select(F.concat(marked, F.ltrim(F.replace("h", F.lit("\ufeff"), F.lit("")))).alias("header"), "quoted", "formulas")


@query("s1_skipped_lines", "SELECT count(*) FILTER (WHERE o_orderkey % 3 = 1) AS skipped FROM orders")
def s1_skipped_lines(spark, folder):
    """A third of the lines is no JSON object, a third is blank."""
    path = f"{work_folder(spark)}/mixed.jsonl"
    k = F.col("o_orderkey")
    line = F.when(k % 3 == 0, F.concat(F.lit('{"slug":"o-'), k.cast("string"), F.lit('"}'))).when(k % 3 == 1, F.concat(F.lit("{bad "), k.cast("string"))).otherwise("  ")
    table(spark, folder, "orders").select(line.alias("value")).write.text(path)
    return rd.read_offers_jsonl(spark, path)[1]


@query("s2_read_offers_csv", f"WITH {OFFERS} SELECT slug, {RECORD.format(q=chr(39) * 3 + chr(39) + ' || ')} FROM offers_v")
def s2_read_offers_csv(spark, folder):
    """Files of two shapes in one input: UTF-8 with a mark, and Windows-1252 with semicolons, columns turned round."""
    base = work_folder(spark)
    rows = records(spark, folder)
    # The line separator U+2028 has no place in Windows-1252, so such rows go to the first folder.
    wide = F.coalesce(F.contains("description", F.lit("\u2028")), F.lit(False)) | F.col("slug").endswith("0")
    wr.write_csv(rows.where(wide), f"{base}/marked")
    other = wr.formula_safe(wr.offer_columns(rows.where(~wide)))
    other.select(*reversed(other.columns)).write.options(header=True, sep=";", encoding="ISO-8859-1", nullValue="", emptyValue="", quote='"', escape='"').csv(f"{base}/plain")
    return shown(rd.read_offers_csv(spark, f"{base}/*"))


@query("s3_read_offers_envelope", f"WITH {OFFERS} SELECT slug, title, salary_min FROM offers_v")
def s3_read_offers_envelope(spark, folder):
    """Result documents of fifteen offers each, in the three accepted shapes."""
    path = f"{work_folder(spark)}/documents"
    page = F.floor(F.col("offer_id") / 15)
    item = F.to_json(F.struct("slug", "title", "salary_min"))
    lists = offers(spark, folder).groupBy(page.alias("page")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("items"))
    shape = F.when(F.col("page") % 3 == 0, F.col("items")).when(F.col("page") % 3 == 1, F.concat(F.lit('{"data":{"results":'), "items", F.lit("}}"))).otherwise(F.concat(F.lit('{"items":'), "items", F.lit("}")))
    # One file per shape and task would hold many documents; each line is one document here.
    lists.select(shape.alias("value")).write.text(path)
    docs = spark.read.text(path)
    return rd.offers_in_documents(docs).select("slug", "title", "salary_min")


@query("s4_read_targets_txt", """
SELECT slug, min(ord) AS ord FROM (SELECT 'offer_' || l_orderkey AS slug, l_orderkey * 8 + l_linenumber AS ord FROM lineitem WHERE l_linenumber <> 3) GROUP BY slug""")
def s4_read_targets_txt(spark, folder):
    """A listing of links with comments and bad lines -> targets, the first of each slug."""
    path = f"{work_folder(spark)}/targets.txt"
    n = F.col("l_linenumber")
    o = (F.col("l_orderkey") * 8 + n).cast("string")
    url = F.concat(F.lit("https://jobs.example.com/job_offers/offer_"), F.col("l_orderkey").cast("string"), F.lit("?ord="), o)
    line = F.when(n == 3, F.concat(F.lit("# "), url)).otherwise(F.concat(F.lit("  "), url, F.lit(" ")))
    table(spark, folder, "lineitem").select(line.alias("value")).write.text(path)
    rows = rd.read_targets_txt(spark, path).withColumn("ord", F.regexp_extract("url", "ord=([0-9]+)", 1).cast("bigint"))
    return rd.targets_from_rows(rows, order=["ord"]).select("slug", "ord")


@query("s7_targets_from_rows", """
WITH t AS (SELECT o_orderkey AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'c_' || o_custkey WHEN 1 THEN 'c_' || o_custkey ELSE NULL END AS slug, CASE WHEN o_orderkey % 3 = 1 THEN 'Cargo' ELSE o_orderpriority END AS title FROM orders)
SELECT slug, arg_min(title, ord) AS title, min(ord) AS ord FROM t WHERE slug IS NOT NULL GROUP BY slug ORDER BY min(ord) LIMIT 300""")
def s7_targets_from_rows(spark, folder):
    k = F.col("o_orderkey")
    customer = F.col("o_custkey").cast("string")
    rows = table(spark, folder, "orders").select(
        k.alias("ord"), F.when(k % 3 == 0, F.concat(F.lit("c_"), customer)).otherwise("no valid slug").alias("Slug"),
        F.when(k % 3 == 1, F.concat(F.lit("/job_offers/c_"), customer, F.lit("#x"))).alias("LINK"), F.when(k % 3 == 1, " ").otherwise(F.col("o_orderpriority")).alias("Title"), F.lit("Cargo").alias("cargo"))
    return rd.targets_from_rows(rows, order=["ord"], limit=300).select("slug", "title", "ord")


@query("s5_read_pages", "SELECT page_id, url, md5(html) AS html_md5, CAST(NULL AS INT) AS status FROM pages")
def s5_read_pages(spark, folder):
    return rd.read_pages(spark, f"{folder}/pages.parquet").select("page_id", "url", F.md5("html").alias("html_md5"), "status")


@query("k3_write_offers", f"WITH {OFFERS} SELECT 'csv' AS format, count(*) AS n, count(salary_min) AS paid, count(DISTINCT slug) AS slugs FROM offers_v UNION ALL SELECT 'ndjson', count(*), count(salary_min), count(DISTINCT slug) FROM offers_v")
def k3_write_offers(spark, folder):
    base = work_folder(spark)
    for suffix in ("csv", "ndjson"):
        wr.write_offers(records(spark, folder), f"{base}/o.{suffix}")
    both = rd.read_offers_csv(spark, f"{base}/o.csv").withColumn("format", F.lit("csv")).unionByName(rd.read_offers_jsonl(spark, f"{base}/o.ndjson")[0].withColumn("format", F.lit("ndjson")))
    return both.groupBy("format").agg(F.count("*").alias("n"), F.count("salary_min").alias("paid"), F.count_distinct("slug").alias("slugs"))


@query("k4_flatten_for_csv", f"""
WITH {OFFERS} SELECT slug, title, CASE WHEN salary_min IS NOT NULL THEN 'CLP ' || salary_min END AS salary, salary_currency, salary_min, salary_max, CAST(NULL AS VARCHAR) AS salary_period, comuna || '; ' || region AS labels, posted_at AS posted_at_approx FROM offers_v""")
def k4_flatten_for_csv(spark, folder):
    salary = F.when(F.col("salary_min").isNotNull(), F.struct(
        F.concat(F.lit("CLP "), F.col("salary_min").cast("string")).alias("raw"), F.col("salary_currency").alias("currency"), F.col("salary_min").alias("min"), F.col("salary_max").alias("max"),
        F.lit(None).cast("string").alias("period")))
    none = F.lit(None).cast("string")
    rows = offers(spark, folder).select(
        "slug", none.alias("url"), "title", "company", F.col("location_text").alias("location"), salary.alias("salary"), "employment_type", none.alias("modality"), F.array("comuna", "region").alias("labels"),
        none.alias("posted_ago"), F.col("posted_at").alias("posted_at_approx"))
    return wr.flatten_for_csv(rows, "job_search").select("slug", "title", "salary", "salary_currency", "salary_min", "salary_max", "salary_period", "labels", "posted_at_approx")


@query("k5_to_envelope", f"""
WITH {OFFERS}, {FOUND}, r AS (SELECT *, row_number() OVER (ORDER BY hits DESC, posted_at DESC, slug) AS rank FROM found)
SELECT 2 AS schema_version, 'job_search' AS kind, (SELECT count(*) FROM found) AS total, (SELECT string_agg(slug, ';' ORDER BY rank) FROM r WHERE rank <= 20) AS slugs, (SELECT count(*) > 20 FROM found) AS has_more,
  CASE WHEN (SELECT count(*) FROM found) = 0 THEN 1 ELSE 0 END AS warnings""")
def k5_to_envelope(spark, folder):
    page = se.search_page(offers(spark, folder), FULL, day(TODAY), limit=20)
    doc = wr.to_envelope("job_search", page.items.select("rank", "slug", "title"), page.meta, order=["rank"])
    schema = "struct<schema_version:int,kind:string,data:struct<total:bigint,has_more:boolean,results:array<struct<slug:string,title:string>>>,warnings:array<string>>"
    parsed = doc.select(F.from_json("document", schema).alias("d"))
    return parsed.select("d.schema_version", "d.kind", "d.data.total", F.nullif(F.array_join("d.data.results.slug", ";"), F.lit("")).alias("slugs"), "d.data.has_more", F.size("d.warnings").alias("warnings"))


@query("k6_write_review_queue", f"WITH {QUEUE} SELECT 'form-' || conv_id AS slug, CASE WHEN ok THEN filled ELSE 0 END AS answers, CASE WHEN ok THEN n ELSE 0 END AS fields_detected FROM r")
def k6_write_review_queue(spark, folder):
    path = f"{work_folder(spark)}/queue"
    wr.write_review_queue(queue(spark, folder), path)
    back = spark.read.schema("slug string, answers map<string,string>, fields_detected int").json(path)
    return back.select("slug", F.size(F.map_keys("answers")).alias("answers"), "fields_detected")


@query("q1_contract_report", f"""
WITH {OFFERS}, c AS (SELECT count(*) FILTER (WHERE offer_id % 9 = 0) AS modality, count(*) FILTER (WHERE offer_id % 7 = 0) AS slug FROM offers_v)
SELECT 'enum:employment_type' AS rule, 0 AS violations UNION ALL SELECT 'enum:modality', modality FROM c UNION ALL SELECT 'enum:salary_currency', 0 UNION ALL SELECT 'slug', slug FROM c
UNION ALL SELECT 'missing:url', 1 UNION ALL SELECT 'unknown:offer_id', 1 UNION ALL SELECT 'type:posted_at', 1""")
def q1_contract_report(spark, folder):
    k = F.col("offer_id")
    rows = offers(spark, folder).select(
        F.when(k % 7 == 0, F.upper("slug")).otherwise(F.col("slug")).alias("slug"), "title", "employment_type", F.when(k % 9 == 0, "en casa").otherwise("remote").alias("modality"), "salary_currency", "posted_at", "offer_id")
    text = T.StringType()
    expected = T.StructType([T.StructField(n, text) for n in ("slug", "title", "employment_type", "modality", "salary_currency", "posted_at", "url")])
    return qu.contract_report(rows, expected, slug="slug")
