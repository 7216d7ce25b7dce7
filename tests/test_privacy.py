import pytest
from pyspark.sql import functions as F

from vacantia.operators import privacy as P


def test_value_rules(evaluate):
    cases = {
        "foto https://lh3.googleusercontent.com/a/b?x y": "foto SCRUBBED y", "/rails/active_storage/blobs/abc.pdf z": "/rails/active_storage/SCRUBBED z",
        "www.LinkedIn.com/in/paz-x/": "www.LinkedIn.com/in/SCRUBBED/", "/x?page=2&token=abc&X-Amz-Date=1": "/x?page=2&token=SCRUBBED&X-Amz-Date=SCRUBBED",
        "a" * 16 + "--" + "b" * 16: "SCRUBBED", "mail paz.p@example.co.uk.": "mail SCRUBBED.",
        "Oferta 19000000020 RUT 11.111.111-0 y +56 9 0000 0003": "Oferta 19000000020 RUT SCRUBBED y SCRUBBED", "1.234.567-k": "SCRUBBED",
        "paz%40example.com": "SCRUBBED", "100% seguro": "100% seguro", "a%20b": "a%20b", "nada": "nada", "": "", None: None,
    }
    assert evaluate(P.mask_patterns, list(cases)) == list(cases.values())


def test_redact(spark):
    df = spark.createDataFrame([("remember_user_token=abc; x secreto-largo y secreto-largo-2 corto", ["secreto-largo", "secreto-largo-2", "corto"])], "t string, s array<string>")
    assert df.select(P.redact_secrets(F.col("t"), F.col("s"))).first()[0] == "remember_user_token=***; x *** y *** corto"


def variants(spark, name, email):
    df = spark.createDataFrame([(name, email)], "n string, e string")
    return df.select(P.identity_variants(F.col("n"), F.col("e"))).first()[0]


def test_variants(spark):
    got = variants(spark, "José Ñúñez del Río", "jose.nunez@example.org")
    assert {"jose nunez del rio", "jose.nunez@example.org", "jose.nunez", "jose-nunez-del-rio", "jose_nunez_del_rio", "josenunezdelrio", "jose", "nunez", "rio"} <= set(got)
    assert "del" not in got and got == sorted(got, key=lambda s: (-len(s), s))
    assert variants(spark, None, "jp@example.org") == ["jp@example.org"] and variants(spark, None, None) == []


def masked(spark, name, email, texts):
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "owner int, i int, text string")
    people = spark.createDataFrame([(1, name, email)], "owner int, name string, email string")
    rows = P.with_identity(docs, people, "owner").withColumn("masked", P.mask_identity(F.col("text"), F.col("identity")))
    return [(r.masked, r.leaked) for r in P.leak_audit(rows, text="masked").orderBy("i").collect()]


def test_identity_masking(spark):
    texts = ["Analista Anaís", "ANA INIGUEZ!", "cv_ana.pdf", "por Íñiguez y Iñiguez.", "Ana  Íñiguez", "p?n=I%C3%B1iguez", "éAna", "éAna", "sin datos ñ", ""]
    assert masked(spark, "Ana Íñiguez", None, texts) == [
        ("Analista Anaís", False), ("SCRUBBED!", False), ("cv_SCRUBBED.pdf", False), ("por SCRUBBED y SCRUBBED.", False), ("SCRUBBED", False),
        ("p?n=I%C3%B1iguez", True), ("éAna", False), ("éAna", False), ("sin datos ñ", False), ("", False)]
    assert masked(spark, "Karl Strauss", "k.s+x@example.org", ["STRAUß", "k.s+x@example.org", "kxs"]) == [("SCRUBBED", False), ("SCRUBBED", False), ("kxs", False)]
    assert masked(spark, None, None, ["Ana"]) == [("Ana", False)]
    rare = ["ⒶⓃⒶ y \U0001d400na, Ana", "ＡＮＡ", "Ŝtrauﬀ ana"]
    assert masked(spark, "Ana Strauff", None, rare) == [("SCRUBBED y SCRUBBED, SCRUBBED", False), ("SCRUBBED", False), ("SCRUBBED SCRUBBED", False)]


def test_places_and_spellings_agree(spark):
    """Masking by places in the folded text gives what the pattern of all spellings gives, on random mixtures."""
    import random

    rng = random.Random(17)
    parts = ["Ana", "ÁNA", "ana íñiguez", "IÑIGUEZ", "I\u0303n", "ß", "ﬁ", " ", "  ", "-", "é", "x", "1", "ⒶⓃⒶ", "\U0001d400na", "가", "ñ", ".", "ana-iniguez", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    docs = spark.createDataFrame([(1, t) for t in texts], "owner int, text string")
    people = spark.createDataFrame([(1, "Ana Íñiguez", "ana@example.org")], "owner int, name string, email string")
    rows = P.with_identity(docs, people, "owner").select("text", P.mask_identity(F.col("text"), F.col("identity")).alias("a"), P.mask_spellings(F.col("text"), F.col("identity")).alias("b")).collect()
    assert len(rows) == 600 and sum(r.a != r.text for r in rows) > 200
    assert [r for r in rows if r.a != r.b] == []


def test_files(spark):
    rows = [(1, 5, "b.PDF"), (1, 2, "a.doc"), (1, 9, "a.doc"), (2, 1, "b.PDF"), (1, 70000, "c.rtf")]
    df = spark.createDataFrame(rows, "doc_id int, pos int, name string")
    assert sorted((r.doc_id, r.pos, r.alias) for r in P.pseudonymise_files(df).collect()) == [
        (1, 2, "cv-1.doc"), (1, 5, "cv-2.pdf"), (1, 9, "cv-1.doc"), (1, 70000, "cv-3.rtf"), (2, 1, "cv-1.pdf")]


def scrub(spark, html, path="/profile/cvs", name="Paz Íñiguez", email="paz@example.com"):
    df = spark.createDataFrame([(1, html, path, name, email)], "page_id int, html string, path string, name string, email string")
    return P.scrub_pages(df).first()


def test_scrub_structure(spark):
    html = (
        '<!DOCTYPE html><html><head><meta name="csrf-token" content="abc"><script>var paz=1</script><!-- Paz -->'
        '<script type="application/ld+json">{"@type":"X","paz@example.com":1,"a":"ok <b>","b":"de paz@example.com & <x>","c":["Iñiguez"]}</script>'
        '<script type="application/ld+json">{bad Paz</script></head><body class="card--paz x"><button aria-label="Avatar de Otra Persona">o</button>'
        '<div data-user-id="77" nonce="n">Hola PAZ INIGUEZ &amp; Cía, Otra Persona</div><input name="q" value="v"><textarea>nota</textarea>'
        '<p>Mi CV.pdf</p><a download="Mi CV.pdf" title="otro.DOCX">a</a><a download="cv" href="/x?n=%C3%8D%C3%B1iguez">b</a><path d="M 1.111.111-1z"></path></body></html>')
    row = scrub(spark, html)
    out = row.scrubbed
    for gone in ("Paz", "PAZ", "guez", "Otra", "abc", "77", "nota", "<!--", "var", 'value="v"', "Mi CV", "otro"):
        assert gone not in out.replace('"paz@example.com":1', ""), gone
    for kept in ("<!DOCTYPE html>", 'content="SCRUBBED"', "<script></script>", '"a":"ok <b>"', '"b":"de SCRUBBED \\u0026 \\u003cx\\u003e"', '"c":["SCRUBBED"]',
                 'class="card--SCRUBBED x"', 'aria-label="Avatar de SCRUBBED"', "Hola SCRUBBED &amp; Cía, SCRUBBED", "<textarea>SCRUBBED</textarea>", "<p>cv-1.pdf</p>",
                 'download="cv-1.pdf"', 'title="cv-2.docx"', 'download="SCRUBBED"', 'd="M 1.111.111-1z"'):
        assert kept in out, (kept, out)
    assert row.leaked and row.locations == ["text in <script>"]


def test_scrub_public_page(spark):
    html = '<form><input name="q" value="contador"><textarea>nota</textarea><input name="authenticity_token" value="zz"></form><p>Oferta 19000000020</p>'
    row = scrub(spark, html, path="/saved_jobs", name=None, email=None)
    assert 'value="contador"' in row.scrubbed and "<textarea>nota</textarea>" in row.scrubbed and "zz" not in row.scrubbed and "19000000020" in row.scrubbed
    assert (row.leaked, row.locations) == (False, [])


@pytest.mark.parametrize("html,locations", [
    ("<p>ANA INIGUEZ</p>", ["text in <p>"]), ('<a title="por iñiguez">x</a>', ["attribute title on <a>"]), ('<a href="/p?n=I%C3%B1iguez">x</a>', ["attribute href on <a>"]),
    ('<div data-ana-x="1"></div>', [P.MARKUP]), ('<div data-ana="Ana"></div>', [P.MARKUP]), ("<p>Analista</p><p>Anaís</p>", []),
])
def test_audit(spark, html, locations):
    df = spark.createDataFrame([(html, "Ana Íñiguez")], "html string, name string").withColumn(
        "identity", P.identity_patterns(P.identity_variants(F.col("name"), F.lit(None).cast("string"))))
    assert P.audit_pages(df).first().locations == locations


def test_join_moves_names_not_patterns(spark):
    """Patterns of every person in a broadcast relation do not fit a driver: they are made behind the join."""
    docs = spark.createDataFrame([(1, "Ana")], "owner int, text string")
    people = spark.createDataFrame([(1, "Ana Íñiguez", "ana@example.org")], "owner int, name string, email string")
    plan = P.with_identity(docs, people, "owner").select(P.mask_identity(F.col("text"), F.col("identity")))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join LeftOuter")
    assert "identity" in above and "regexp_extract_all" not in below and "transform" not in below
