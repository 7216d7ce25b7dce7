import collections
import json

import pytest
from pyspark.sql import functions as F

from vacantia.operators import quality as Q
from vacantia.schemas import FIELDS, KINDS, OFFER
from vacantia.sources import readers as R
from vacantia.sources import writers as W


def offers(spark):
    rows = [("a-1", "=SUM(1)", "Ñandú, \"S.A.\"", 5, "2026-01-02", "línea 1\nlínea 2"), ("b-2", "x\u0007y", None, None, None, "-lista"), ("c-3", "@t", "", 7, None, None)]
    return spark.createDataFrame(rows, "slug string, title string, company string, salary_min bigint, published_at string, description string").coalesce(1)


def text_of(path):
    return "".join(p.read_bytes().decode() for p in sorted(path.glob("part-*")))


def test_jsonl_round_trip(spark, tmp_path):
    out = tmp_path / "o.jsonl"
    W.write_offers(offers(spark), str(out))
    lines = [json.loads(x) for x in text_of(out).splitlines()]
    assert [list(x) for x in lines] == [list(FIELDS)] * 3 and lines[1]["title"] == "xy" and "Ñandú" in text_of(out)
    back, skipped = R.read_offers_jsonl(spark, str(out))
    assert back.schema.fieldNames() == list(FIELDS) and skipped.first().skipped == 0
    assert [(r.slug, r.company, r.salary_min) for r in back.orderBy("slug").collect()] == [("a-1", 'Ñandú, "S.A."', 5), ("b-2", None, None), ("c-3", None, 7)]


def test_csv_round_trip(spark, tmp_path):
    out = tmp_path / "o.csv"
    W.write_offers(offers(spark), str(out))
    text = text_of(out)
    assert text.startswith("﻿slug,title,") and "'=SUM(1)" in text and "'@t" in text and "'-lista" in text
    rows = {r.slug: r for r in R.read_offers_csv(spark, str(out)).collect()}
    assert rows["a-1"].description == "línea 1\nlínea 2" and rows["a-1"].company == 'Ñandú, "S.A."' and rows["a-1"].salary_min == 5
    assert rows["b-2"].company is None and rows["c-3"].salary_min == 7 and R.read_offers_csv(spark, str(out)).schema.simpleString() == OFFER.simpleString()
    with pytest.raises(ValueError):
        W.write_offers(offers(spark), str(tmp_path / "o.xlsx"))


def test_jsonl_tolerance(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"slug":"a","title":"u v"}\n\n   \nnot json\n[1]\n{"slug":"b","company":""}\n', encoding="utf-8")
    back, skipped = R.read_offers_jsonl(spark, str(f))
    assert [(r.slug, r.title, r.company) for r in back.orderBy("slug").collect()] == [("a", "u v", None), ("b", None, None)] and skipped.first().skipped == 2


@pytest.mark.parametrize("encoding,sep", [("utf-8", ","), ("utf-8-sig", ";"), ("cp1252", "\t"), ("utf-16", ";")])
def test_csv_shapes(spark, tmp_path, encoding, sep):
    f = tmp_path / "x.csv"
    f.write_bytes(f'Slug{sep}"TITULO, x"{sep}Empresa{sep}Cargo\na-1{sep}"q""{sep}"{sep}Ñu{sep}Año\n'.encode(encoding))
    rows = R.read_rows_csv(spark, str(f)).collect()
    assert [r.asDict() for r in rows] == [{"slug": "a-1", "titulo, x": f'q"{sep}', "empresa": "Ñu", "cargo": "Año"}]
    got = R.targets_from_rows(R.read_rows_csv(spark, str(f)).withColumn("n", F.lit(1)), order=["n"]).first()
    assert (got.slug, got.title, got.company) == ("a-1", "Año", "Ñu")


def test_csv_files_of_different_shape(spark, tmp_path):
    """Encoding, mark, delimiter and header belong to the file, not to the folder."""
    (tmp_path / "a.csv").write_bytes("slug,title\na,\"Ñandú, x\"\n".encode())
    (tmp_path / "b.csv").write_bytes("\r\nTitle;Slug;company\r\nÑu;b;\"dos\r\nlíneas\"\r\n\r\nsola\r\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes("title\tslug\nč\tc\n".encode("utf-16"))
    (tmp_path / "d.csv").write_bytes("slug;title\nd;ñ\n".encode("utf-8-sig"))
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "f.csv").write_bytes(b"slug,title\n")
    rows = R.read_rows_csv(spark, str(tmp_path), ["slug", "title", "company", "absent"]).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([
        ("a", "Ñandú, x", None, None), ("b", "Ñu", "dos\r\nlíneas", None), (None, "sola", None, None), ("c", "č", None, None), ("d", "ñ", None, None)], key=str)
    assert sorted(R.read_rows_csv(spark, str(tmp_path)).columns) == ["company", "slug", "title"]
    offers = R.read_offers_csv(spark, str(tmp_path))
    assert offers.schema.simpleString() == OFFER.simpleString() and {r.slug: r.title for r in offers.collect()} == {"a": "Ñandú, x", "b": "Ñu", "": "sola", "c": "č", "d": "ñ"}


def test_large_csv_files_are_split(spark, tmp_path):
    """Lines without open quotes are read by several tasks, each file's header once; names with blanks and signs."""
    body = "".join(f'{i};"Ñu; {i}";{"x" * 50}\n' for i in range(3000))
    (tmp_path / "big file [1].csv").write_bytes(("slug;title;more\n" + body).encode("cp1252"))
    (tmp_path / "big2.csv").write_text("slug;title;more\n" + body, encoding="utf-8")
    (tmp_path / "spans.csv").write_text('slug;title\nq;"a ""b""\nc"\n', encoding="utf-8")
    (tmp_path / "head.csv").write_text('"slug";"ti\ntle"\nh;x\n', encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = R.read_rows_csv(spark, str(tmp_path), ["slug", "title"])
        assert rows.rdd.getNumPartitions() > 8
        got = collections.Counter((r.slug, r.title) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = collections.Counter({(str(i), f"Ñu; {i}"): 2 for i in range(3000)})
    assert got == want + collections.Counter({("q", 'a "b"\nc'): 1, ("h", None): 1})


def test_sniff():
    assert [R.sniff_delimiter(h) for h in ('a,b;c', 'a;b', '"a;b;c",d', 'a\tb', 'a', 'a;b;c,d')] == [",", ";", ",", "\t", ",", ";"]


@pytest.mark.parametrize("doc", ['[{"slug":"a"},5,{"slug":"b"}]', '{"data":{"results":[{"slug":"a"},{"slug":"b"}]}}', '{"items":[{"slug":"a"},{"slug":"b"}]}', '{"data":{"items":[{"slug":"a"},{"slug":"b"}]}}'])
def test_envelope_reader(spark, tmp_path, doc):
    f = tmp_path / "x.json"
    f.write_text(doc)
    assert [r.slug for r in R.read_offers_envelope(spark, str(f)).collect()] == ["a", "b"]


def test_envelope_reader_refuses(spark, tmp_path):
    f = tmp_path / "x.json"
    f.write_text('{"data": 3}')
    with pytest.raises(Exception, match="expected a list of offers"):
        R.read_offers_envelope(spark, str(f)).collect()


def test_targets(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("# c\n\nhttps://jobs.example.com/job_offers/a-1?x\r\n b_2 \nno slug here\n")
    assert [r.url for r in R.read_targets_txt(spark, str(f)).collect()] == ["https://jobs.example.com/job_offers/a-1?x", "b_2", "no slug here"]
    rows = spark.createDataFrame([(1, "bad slug!", "/job_offers/z", "T  1"), (2, "z", None, "T2"), (3, "y", None, None), (4, None, None, None)], "n int, Slug string, LINK string, Cargo string")
    assert [(r.slug, r.title) for r in R.targets_from_rows(rows, order=["n"]).orderBy("n").collect()] == [("z", "T 1"), ("y", "")]
    assert [r.slug for r in R.targets_from_rows(rows, order=["n"], limit=1).collect()] == ["z"]


def test_pages(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>")], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "p"))
    assert R.read_pages(spark, str(tmp_path / "p")).first().html == "<p>"
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.html").write_text("<p>\nx")
    assert R.read_pages(spark, str(tmp_path / "raw"), raw=True).first().html == "<p>\nx"


def test_envelope_and_flat_csv(spark):
    items = spark.createDataFrame([(2, "b", None), (1, "a", ["x", "y"])], "rank int, slug string, labels array<string>")
    meta = spark.createDataFrame([(1, 0, ["n", "n"])], "page int, offset int, notes array<string>")
    doc = json.loads(W.to_envelope("job_search", items, meta, order=["rank"], warnings=F.array(F.lit("w"), F.lit("n"))).first()[0])
    assert doc == {"schema_version": 2, "kind": "job_search", "data": {"page": 1, "offset": 0, "results": [{"slug": "a", "labels": ["x", "y"]}, {"slug": "b", "labels": None}]}, "warnings": ["w", "n"]}
    empty = json.loads(W.to_envelope("company_list", items.limit(0), meta, order=["rank"]).first()[0])
    assert empty["warnings"] == ["n", KINDS["company_list"][1]]
    later = json.loads(W.to_envelope("company_list", items.limit(0), meta.withColumn("page", F.lit(2)), order=["rank"]).first()[0])
    assert later["warnings"] == ["n"]
    with pytest.raises(ValueError):
        W.to_envelope("nope", items)
    err = json.loads(spark.range(1).select(W.error_envelope(F.lit("BLOCKED"), F.lit(4), F.lit("m"), F.lit(None).cast("string"))).first()[0])
    assert err == {"schema_version": 2, "kind": "error", "error": {"code": "BLOCKED", "exit_code": 4, "message": "m", "hint": None}}
    jobs = spark.sql("select 's' slug, 'u' url, 't' title, 'c' company, 'l' location, named_struct('raw','r','currency','CLP','min',1L,'max',2L,'period','month') salary, "
                     "'other' employment_type, 'remote' modality, array('a','b') labels, 'x' posted_ago, date'2026-01-01' posted_at_approx")
    flat = W.flatten_for_csv(jobs, "job_list").first()
    assert len(flat) == 15 and flat.labels == "a; b" and flat.salary_min == 1 and flat.salary == "r"
    with pytest.raises(ValueError):
        W.flatten_for_csv(jobs, "job")


def test_contract(spark):
    df = spark.createDataFrame([("a", "remote", True, None, 1), ("B", "x", False, None, None)], "slug string, modality string, has_more boolean, next_page int, next_offset int")
    from pyspark.sql import types as T

    expected = T.StructType([*[f for f in df.schema.fields if f.name != "has_more"], T.StructField("title", T.StringType())])
    got = {r.rule: r.violations for r in Q.contract_report(df, expected).collect()}
    assert got == {"enum:modality": 1, "slug": 1, "paging": 1, "missing:title": 1, "unknown:has_more": 1}
    pages = spark.createDataFrame([("company", "<h1>x"), ("company", '<h1>x<turbo-frame id="company_job_offers_results">'), ("search", "captcha"), ("job", "x")], "kind string, html string")
    assert sorted(tuple(r) for r in Q.anchor_report(pages).na.fill("-").collect()) == [
        ("company", "-", "ok", 1), ("company", "turbo-frame#company_job_offers_results", "site_changed", 1),
        ("job", "JSON-LD JobPosting or .job-offer-show-title h1", "site_changed", 1), ("search", "turbo-frame#job_offers_results", "blocked", 1)]


def test_work_folder_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from vacantia import session

    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.work_folder(Cluster())
    Context.master = "local[4]"
    assert session.work_folder(Cluster()).startswith("/tmp/spark-")


def test_jsonl_lines_are_parsed_once(spark, tmp_path):
    (tmp_path / "o.jsonl").write_bytes(b'{"slug":"a","salary_min":1}\r\n{"slug":"b"}\r\r\n\n  \r\n{"slug":"c"}\r{bad\r\n[1]')
    offers, skipped = R.read_offers_jsonl(spark, str(tmp_path / "o.jsonl"))
    plan = offers._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and "regexp_replace" not in plan
    assert sorted((r.slug, r.salary_min) for r in offers.collect()) == [("a", 1), ("b", None), ("c", None)]
    assert skipped.first().skipped == 2


def test_control_characters_named_one_by_one(spark):
    from vacantia.functions.text import CONTROL_CHARS, plain_text

    points = "".join(chr(p) for p in range(0x300))
    kept = "".join(c for c in points if c in "\t\n" or not (c < " " or "\x7f" <= c <= "\x9f"))
    assert spark.createDataFrame([(points,)], "v string").select(plain_text(F.col("v")).alias("v")).first().v == kept
    assert "-" not in CONTROL_CHARS  # a class without ranges is a table to Java
