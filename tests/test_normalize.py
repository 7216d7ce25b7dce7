import datetime

from pyspark.sql import functions as F

from vacantia.functions import normalize as N
from vacantia.functions import urls as U

def today():
    return F.lit("2026-09-24").cast("date")



def test_regions(evaluate):
    same = list(N.REGIONS)
    assert evaluate(N.norm_region, same) == same
    assert evaluate(N.norm_region, ["Región " + r for r in same]) == same
    assert evaluate(N.norm_region, [r.upper() for r in same]) == same
    cases = {
        "Region Metropolitana": "Metropolitana", "REGIÓN DE VALPARAÍSO": "Valparaíso", "Región del Maule": "Maule",
        "Región de la Araucanía": "La Araucanía", "Región de Los Ríos": "Los Ríos", "Región de Ñuble": "Ñuble",
        "Región del Biobío": "Bío Bío", "Región del Libertador General Bernardo O'Higgins": "O'Higgins",
        "Región de Aysén del General Carlos Ibáñez del Campo": "Aysén",
        "Región de Magallanes y de la Antártica Chilena": "Magallanes y Antártica Chilena",
        "Región Metropolitana de Santiago": "Metropolitana", "R.Metropolitana": "Metropolitana",
        "R. Metropolitana": "Metropolitana", "R Maule": "Maule", "R.M.": "Metropolitana", "RM": "Metropolitana",
        "Bíobío": "Bío Bío", "Araucanía": "La Araucanía", "Aisén": "Aysén", "Tarapaca": "Tarapacá",
        "  Los   Lagos ": "Los Lagos", "Región de Coquimbo": "Coquimbo",
        "Región": None, "Rancagua": None, "Santiago": None, "Chile": None, "Lima": None, "": None, None: None,
    }
    assert evaluate(N.norm_region, list(cases)) == list(cases.values())


def test_locations(evaluate):
    cases = {
        "Las Condes, Santiago, Región Metropolitana, Chile": ("Metropolitana", "Las Condes", "Chile"),
        "Rancagua, Cachapoal, O'Higgins, Chile": ("O'Higgins", "Rancagua", "Chile"),
        "Valdivia, Los Ríos, Chile": ("Los Ríos", "Valdivia", "Chile"),
        "Concepción, Concepción, Región del Biobío, Chile": ("Bío Bío", "Concepción", "Chile"),
        "Región de Valparaíso, Chile": ("Valparaíso", None, "Chile"), "Chile": (None, None, "Chile"),
        "Miraflores, Lima, Perú": ("Lima", "Miraflores", "Perú"), "Providencia, Santiago": ("Santiago", "Providencia", None),
        "Medellín, Antioquia, Colombia": ("Antioquia", "Medellín", "Colombia"), "Ñuñoa": (None, "Ñuñoa", None),
        "": (None, None, None), None: (None, None, None),
    }
    assert [tuple(r) for r in evaluate(N.parse_location, list(cases))] == list(cases.values())


def test_tags(evaluate):
    cases = [
        (["Jornada Completa", "Presencial"], ("Jornada Completa", "Presencial")),
        (["Remoto", "Jornada Parcial"], ("Jornada Parcial", "Remoto")), (["Híbrido"], (None, "Híbrido")),
        (["Jornada Completa"], ("Jornada Completa", None)), (["Turnos", "Otro"], ("Turnos", "Otro")), ([], (None, None)),
    ]
    assert [tuple(r) for r in evaluate(N.split_tags, [c[0] for c in cases], "array<string>")] == [c[1] for c in cases]
    labels = [["30 horas", "PRACTICAS", "hibrido"], ["Otro", "Jornada completa"], []]
    assert [tuple(r) for r in evaluate(N.label_types, labels, "array<string>")] == [
        ("intern", "hybrid"), ("other", None), (None, None)]


def test_salary(evaluate):
    rows = evaluate(N.parse_salary, ["CLP $650.000 - $850.000", "COP $2.150.000,00 - $2.150.000,00", "CLP $700.000", "A convenir", "", None])
    assert [tuple(r) if r else None for r in rows] == [
        ("CLP $650.000 - $850.000", "CLP", 650000, 850000, None),
        ("COP $2.150.000,00 - $2.150.000,00", "COP", 2150000, 2150000, None),
        ("CLP $700.000", "CLP", 700000, 700000, None), ("A convenir", None, None, None, None), None, None]


def test_age_and_status(evaluate):
    d = datetime.date
    assert evaluate(lambda c: N.posted_at(c, today()), ["Hace menos de 1 hora", "Hace 3 horas", "Hace 1 día", "Hace 2 meses", "ayer", None]) == [
        d(2026, 9, 24), d(2026, 9, 24), d(2026, 9, 23), d(2026, 7, 26), None, None]
    assert evaluate(lambda c: N.offer_status(c.cast("date"), today()), ["2026-09-23", "2026-09-24", None]) == ["expired", "open", "open"]


def test_countries(evaluate):
    assert evaluate(N.normalize_country, ["peru", " MÉXICO ", "Francia"]) == ["Perú", "México", None]
    assert evaluate(N.country_code, ["cl", "Brasil", "x"]) == ["CL", "BR", None]
    rows = evaluate(N.normalize_countries, [["peru", "", "PERÚ", "chile"], [""], ["x"], None], "array<string>")
    assert [(r.countries, r.error) for r in rows] == [
        (["Perú", "Chile"], None), ([], "empty"), ([None], "unknown country"), (["Chile"], None)]


def test_company_facts(evaluate):
    rows = evaluate(N.company_tags, [["Banca", "51 - 200 empleados"], ["1.000+ empleados"], []], "array<string>")
    assert [tuple(r) for r in rows] == [("Banca", "51 - 200 empleados"), (None, "1.000+ empleados"), (None, None)]
    assert evaluate(N.offer_count, ["1.029 ofertas activas", "1 oferta activa", "Sin ofertas activas", "x"]) == [1029, 1, 0, None]


def test_role_pills_are_composed(evaluate):
    assert evaluate(N.role_pills, [["n\u0303andu\u0301 ", None], None], "array<string>")[0].pills == ["\u00f1and\u00fa", None]


def test_role_pills(evaluate):
    rows = evaluate(N.role_pills, [[" analista "], ["a", ""], ["a,b"], ["x" * 51], ["y" * 50] * 11], "array<string>")
    assert [r.violation for r in rows] == [None, "empty role", "role holds a comma", "role too long", "roles too long together"]
    assert rows[0].pills == ["analista"]


def test_slug_grammars(evaluate):
    cases = {
        "/job_offers/cargo-demo": "cargo-demo", "https://x/job_offers/x-y-z": "x-y-z", "/job_offers/x?ref=1": "x",
        "/job_offers/x/save_later": "x", "/job_offers/..": None, "/job_offers/%2e%2e": None, "/companies/e": None,
        "/job_offers?page=2": None, "": None, None: None, "/job_offers/a+b": None, "/job_offers/%C3%B1u": "ñu",
    }
    assert evaluate(U.slug_from_href, list(cases)) == list(cases.values())
    cases = {
        "analista-1": "analista-1", "https://jobs.example.com/job_offers/analista-1/?x=1": "analista-1",
        "http://jobs.example.com/job_offers/a": None, "https://other.example.com/job_offers/a": None,
        "https://jobs.example.com/companies/a": None, "Mayus": None, "a" * 201: None, " b-2 ": "b-2",
    }
    assert evaluate(U.slug_from_input, list(cases)) == list(cases.values())
    assert evaluate(lambda c: U.slug_from_input(c, "company"), ["home", "acme"]) == [None, "acme"]
    assert evaluate(U.slug_from_link, ["/job_offers/a/", "/job_offers/a/save_later", "//evil.example/job_offers/a"]) == ["a", None, None]
    assert evaluate(U.listed_slug, ["https://z/job_offers/Ab_1?x", "Ab_1", "no slug", "-x"]) == ["Ab_1", "Ab_1", None, None]


def test_urls(evaluate):
    assert evaluate(U.build_url, ["a~b", "ñ", ".."]) == [
        "https://jobs.example.com/job_offers/a~b", "https://jobs.example.com/job_offers/%C3%B1", None]
    assert evaluate(lambda c: U.build_url(c, "apply"), ["a-1"]) == ["https://jobs.example.com/job_offers/a-1?tab=apply"]
    base = "https://jobs.example.com/job_offers"
    assert evaluate(U.url_refusal, [base, base + "?page=2&sort_by=x", base + "?Locale%5B%5D=es", "http://jobs.example.com/", "https://x.example/"]) == [
        None, "param", "param", "host", "host"]
    assert evaluate(lambda c: U.redirect_allowed(c, F.lit("/a")), ["/a", "/job_offers", "/job_offers/x", "/job_offers/x/y", "/users"]) == [
        True, True, True, False, False]


def test_redirects(spark):
    base = "https://jobs.example.com/job_offers/"
    df = spark.createDataFrame([(base + "a", base + "a"), (base + "a", base + "b?page=3"), (base + "a", "https://jobs.example.com/users/sign_in")], "u string, f string")
    rows = [r[0] for r in df.select(U.resolve_redirect(F.col("u"), F.col("f"))).collect()]
    assert [(r.canonical, r.gone, r.page) for r in rows] == [(None, False, 1), ("b", False, 3), (None, True, 1)]


def test_frontier(spark):
    runs = spark.createDataFrame([(["Chile", "Perú"], 2, "last_week")], "countries array<string>, last_page int, date string")
    assert [r.url for r in U.listing_frontier(runs).orderBy("page").collect()] == [
        "https://jobs.example.com/job_offers?countries%5B%5D=Chile&countries%5B%5D=Per%C3%BA&worldwide=1&date=last_week",
        "https://jobs.example.com/job_offers?countries%5B%5D=Chile&countries%5B%5D=Per%C3%BA&worldwide=1&date=last_week&page=2"]
