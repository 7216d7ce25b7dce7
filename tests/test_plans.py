"""What the physical plans may not hold, whatever the query."""

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if not n.startswith(("h4", "h5", "h6"))))
def test_no_cross_joins_and_no_row_udfs(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from vacantia.operators import search as S

    offers = spark.read.parquet(f"{FOLDER}/orders.parquet").select(
        F.col("o_orderkey").alias("slug"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("employment_type"), F.lit("Chile").alias("country"),
        F.col("o_totalprice").alias("salary_min"), F.col("o_totalprice").alias("salary_max"), F.lit("CLP").alias("salary_currency"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    query = S.SearchQuery(job_types=("other",), min_salary=1000)
    plan = S.search_offers(offers, query, F.lit("2026-01-01").cast("date"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,other)" in plan and "GreaterThanOrEqual(o_totalprice" in plan
    assert "o_custkey" not in plan and "o_orderdate" not in plan


def test_dedupe_shuffles_once_and_combines_first(spark):
    from vacantia.operators import crawl as C

    cards = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr("l_orderkey slug", "l_linenumber page", "l_partkey pos")
    plan = C.dedupe_first(cards, "slug", ["page", "pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_min_by" in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["x5_merge_posting", "x8_extract_search_page", "x10_extract_companies", "x11_extract_company_page"])
def test_one_parse_a_page_and_no_page_comes_back(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
