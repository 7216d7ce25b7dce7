"""Pages whose character references were cut: HTML5 reads some names without a semicolon, and so must the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

PAGE = (
    '<html><head><title>{0}</title></head><body><nav><ul><li><a href="/a">{0}</a></li></ul></nav><div class="ad">ad {0}</div>'
    "<article><h1>{0}</h1><p>a &amp; b</p></article><footer>&copy; x &middot; y</footer></body></html>")
CUTS = ["one&amp;&amp", "two&quot", "three&am", "four&a", "five&", "six&amp;quot;", "seven &copy", "eight&amp ; x", "nine &middot"]


@pytest.mark.parametrize("name", ["p5_scrub_pages", "x0_element_table", "x6_html_to_text"])
def test_cut_references(spark, tmp_path, name):
    rows = [(i, f"https://example.org/{i}", PAGE.format(cut)) for i, cut in enumerate(CUTS)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    assert got == sorted(cursor.fetchall()) and len(got) == len(CUTS)
