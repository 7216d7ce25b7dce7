import datetime
import json

import pytest
from pyspark.sql import functions as F

from vacantia.operators import jsonld as J


def page(*objs):
    return "<html><head>" + "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in objs) + "</head></html>"


def job(**extra):
    return {"@type": "JobPosting", "title": "Cargo", "description": "<p>hola</p>", **extra}


def details(spark, htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id int, html string").coalesce(1)
    return {r.page_id: r for r in J.extract_detail(df).collect()}


SALARIES = [
    ({"value": {"minValue": 500000, "maxValue": 900000}}, (500000, 900000)), ({"value": {"value": 700000}}, (700000, None)),
    ({"value": 1200000}, (1200000, None)), ({"value": 1200000.0}, (1200000, None)), ({"value": "1.200.000"}, (1200000, None)),
    ({"value": "$ 800.000 a $ 1.000.000"}, (800000, None)), ([{"value": {"minValue": 600000}}], (600000, None)), ([], (None, None)),
    ({"minValue": 400000, "maxValue": 450000}, (400000, 450000)), (950000, (950000, None)),
    ({"value": {"minValue": 900000, "maxValue": 500000}}, (500000, 900000)), ({"value": {"minValue": 0, "maxValue": 0}}, (None, None)),
    ({"value": {"value": {"weird": 1}}}, (None, None)), ({"value": True}, (None, None)), (None, (None, None)),
    ([None, "", {"value": 5}], (5, None)), ({"value": None, "minValue": 3}, (3, None)), ("950.000", (950000, None)),
]
IDENTIFIERS = [
    ({"@type": "PropertyValue", "value": "123"}, "123"), ({"value": 123}, "123"), ("456", "456"), ([{"value": "789"}], "789"),
    ({"value": None}, None), ({"value": {"x": 1}}, None), (True, None), (12, "12"), ([0, "", "x"], "x"), ({"value": True}, None),
]


def test_salary_and_identifier_shapes(spark):
    got = details(spark, [page(job(**({} if s is None else {"baseSalary": s}))) for s, _ in SALARIES])
    assert [(got[i].salary_min, got[i].salary_max) for i in range(len(SALARIES))] == [e for _, e in SALARIES]
    assert {r.description for r in got.values()} == {"hola"}
    got = details(spark, [page(job(identifier=v)) for v, _ in IDENTIFIERS])
    assert [got[i].external_id for i in range(len(IDENTIFIERS))] == [e for _, e in IDENTIFIERS]


def test_page_shapes(spark):
    d = datetime.date
    htmls = [
        "<html><body>sin datos</body></html>", "", None, page({"@type": "BreadcrumbList"}),
        '<script type="application/ld+json">{not json</script>' + page(job(datePosted="2026-09-01")),
        page({"@graph": [{"@type": "Organization"}, job(**{"@type": ["JobPosting"], "datePosted": "2026-09-05"})]}),
        page(job(identifier="1"), job(identifier="2")),
        page([[job(identifier="9")]]), page(job(datePosted="2026-09-23T10:00:00-03:00", validThrough="2026-13-45")),
        '<script type="application/ld+json">{"@type":"JobPosting","description":"a\nb","datePosted":"2026-09-02"} trailing</script>'
        + page(job(datePosted="2026-09-03")),
        '<SCRIPT TYPE="application/ld+json">\n{"@type":"JobPosting","description":"a\nb"}\n</SCRIPT>',
        page(job(description={"raro": 1})), page(job(hiringOrganization={"identifier": {"value": "11.111.111-0"}})),
    ]
    got = details(spark, htmls)
    assert sorted(got) == [4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert (got[4].published_at, got[5].published_at, got[6].external_id, got[7].external_id) == (d(2026, 9, 1), d(2026, 9, 5), "1", "9")
    assert (got[8].published_at, got[8].valid_through) == (d(2026, 9, 23), None)
    assert got[9].published_at == d(2026, 9, 3)
    assert got[10].description == "a b" and got[11].description is None and got[12].external_id is None


def test_objects_in_page_order(spark):
    html = page({"n": 1, "@graph": [{"n": 2, "@graph": [{"n": 3}]}, [{"n": 4}]]}, [{"n": 5}, 7, {"n": 6}])
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = J.jsonld_objects(df).selectExpr("pos", "variant_get(ld, '$.n', 'int') n").orderBy("pos").collect()
    assert [(r.pos, r.n) for r in rows] == [(i, i + 1) for i in range(6)]


def test_any_depth(spark):
    def nested(n, kind):
        body = '{"@type":"JobPosting","title":"deep"}'
        for i in range(n):
            body = f'{{"@type":"W{i}","@graph":[{body}]}}' if kind == "graph" else f"[1,{body}]"
        return f'<script type="application/ld+json">{body}</script>'

    pages = spark.createDataFrame([(k, n, nested(n, k)) for k in ("graph", "list") for n in (0, 1, 2, 3, 4, 9, 40)], "kind string, n int, html string")
    got = {(r.kind, r.n): r.c for r in J.jsonld_objects(pages).groupBy("kind", "n").agg(F.count("*").alias("c")).collect()}
    assert got == {(k, n): (n + 1 if k == "graph" else 1) for k in ("graph", "list") for n in (0, 1, 2, 3, 4, 9, 40)}
