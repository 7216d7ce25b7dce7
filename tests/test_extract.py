import datetime
import json

import pytest
from pyspark.sql import functions as F

from vacantia.operators import extract as X
from vacantia.operators import html as H

D = datetime.date


def today():
    return F.lit("2026-09-24").cast("date")


def df(spark, *htmls, **extra):
    rows = [{"page_id": i, "html": h, "page": 1, "slug": "cargo-demo", "fetched_at": "2026-09-24T12:00:00+00:00", **{k: v[i] for k, v in extra.items()}} for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id int, html string, page int, slug string, fetched_at string" + (", status int" if "status" in extra else "")).coalesce(1)


def card(slug, title="Cargo", *, href=None, company="Empresa", location="Ñuñoa, Santiago, Región Metropolitana, Chile", tags=("Jornada Completa", "Híbrido"),
         age="Hace 2 días", salary=None, attr=True):
    return (f'<div class="card job-offer-card"{f" data-scroll-restore-slug={chr(34)}{slug}{chr(34)}" if attr else ""}>'
            + f'<form action="/job_offers/{slug}/save_later"></form>' + (f'<a href="{href}">' if href else "<a>")
            + f'<h2 class="job-offer-card__title">\n {title}\n</h2></a><p class="item-title">{company}</p>'
            + f'<div class="item-subtitle"><span class="break-words">{location}</span><span>{age}</span></div>'
            + "".join(f'<span class="tag tag-navy">{t}</span>' for t in tags) + (f'<span class="tag-primary">{salary}</span>' if salary else "") + "</div>")


def search(cards, total="273", nav=True, extra=""):
    links = '<nav class="pagination-nav"><a aria-label="Página 2" href="?page=2">2</a><a aria-label="Página 19" href="?page=19">19</a><span aria-current="page">1</span><a aria-label="Página siguiente" href="?page=2">&gt;</a></nav>'
    return (f'<html lang="es"><body>{extra}<turbo-frame id="job_offers_results"><p class="job-offers-results-count"><b>{total}</b> ofertas</p>'
            + "".join(cards) + (links if nav else "") + '</turbo-frame><footer><a href="?page=99">x</a></footer></body></html>')


def test_tree_rules():
    nodes = H.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>x<p>y<br>z<div>q</p></div><td>")
    lis = [n.text() for n in nodes if n.tag == "li"]
    assert lis == ["a", "b c", "c", "d"]
    assert [n.text() for n in nodes if n.tag == "p"] == ["x", "y z"]
    deep = H.parse("<b>" * 5000 + "x")
    assert deep[0].text() == "x" and deep[0].end == 5000
    assert H.rich_text(H.parse("<section><p>a<br>b</p><ul><li>x <i>y</i></li><li>z</li></ul><script>no</script>tail</section>")[0]) == "a\nb\n- x y\n- z\n\ntail"


def test_lenient_cards(spark):
    html = "".join([card("a-1", href="/job_offers/a-1?x=1"), card("b-2", attr=True), '<div class="job-offer-card"></div>', card("a-1", href="/job_offers/a-1"),
                    card("x", href="/job_offers/..", attr=False)])
    rows = X.extract_cards(df(spark, html, None)).orderBy("pos").collect()
    assert [r.slug for r in rows] == ["a-1", "b-2", "a-1"]
    r = rows[0]
    assert (r.title, r.company, r.region, r.comuna, r.country, r.workday, r.modality, r.posted_relative, r.url) == (
        "Cargo", "Empresa", "Metropolitana", "Ñuñoa", "Chile", "Jornada Completa", "Híbrido", "Hace 2 días", "https://jobs.example.com/job_offers/a-1")


def test_listing_meta(spark):
    nav = '<span class="job-offers-results-count"><b>1.828</b></span><nav class="pagination"><a href="/j?page=2">2</a><a href="/j?x=1&page=122">l</a></nav><a href="?page=500">z</a>'
    rows = X.extract_listing_meta(df(spark, nav, '<a href="?page=7">z</a>', "<p>x</p>")).orderBy("page_id").collect()
    assert [(r.total, r.last_page) for r in rows] == [(1828, 122), (None, 7), (None, None)]


def test_search_page(spark):
    area = '<input id="locations" value="1021,5" data-initial-area-options="[{&quot;id&quot;:1021,&quot;display_path&quot;:&quot;Chile&quot;,&quot;area_type_label&quot;:&quot;País&quot;}]">'
    pills = '<a class="similar-role-suggestion-pill" data-role-name=" Contador "></a>' * 2 + '<a class="similar-role-suggestion-pill" data-role-name="Auditor"></a>'
    good = search([card("a-1", salary="CLP $650.000 - $850.000"), card("b-2", company="", tags=("30 horas",), age="")], extra=area + pills)
    pages = [good, search([card("Bad Slug")]), search([card("c-3", title="")]), search([]), search([], total="0", nav=False), "<html><title>Just a moment</title></html>",
             "<html></html>", search([card("a")], total="muchas")]
    out = X.extract_search_page(df(spark, *pages), today())
    report = out.pages.orderBy("page_id").collect()
    assert [r.violation for r in report] == [
        None, "div.job-offer-card[data-scroll-restore-slug] (a job slug)", "h2.job-offer-card__title", "div.job-offer-card[data-scroll-restore-slug]", None, "blocked",
        "turbo-frame#job_offers_results", ".job-offers-results-count b (an integer)"]
    assert (report[0].total, report[0].last_page, report[0].has_next, report[0].related_roles) == (273, 19, True, ["Contador", "Auditor"])
    assert tuple(report[0].effective_location) == (1021, "Chile", "País")
    assert (report[4].total, report[4].last_page, report[4].has_next) == (0, 1, False)
    rows = out.rows.orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.slug) for r in rows] == [(0, "a-1"), (0, "b-2")]
    assert (rows[0].salary.min, rows[0].employment_type, rows[0].modality, rows[0].posted_at_approx) == (650000, "full_time", "hybrid", D(2026, 9, 22))
    assert (rows[1].company, rows[1].salary, rows[1].employment_type, rows[1].labels, rows[1].posted_ago) == (None, None, None, ["30 horas"], None)


LD = {
    "@type": "JobPosting", "title": "LD title", "description": "<p>Cargo: x</p><p>Texto</p><ul><li>uno</li></ul>", "datePosted": "2026-09-23", "validThrough": "2026-09-20T00:00",
    "employmentType": ["PART_TIME"], "workHours": " 40 ", "baseSalary": {"currency": "CLP", "value": {"minValue": "500000", "maxValue": 900000.5, "unitText": "MONTH"}},
    "jobLocation": [{"address": {"addressLocality": "Ñuñoa", "addressCountry": {"name": "Chile"}}}], "identifier": {"value": "30814"}, "directApply": True,
    "hiringOrganization": {"name": "Acme", "sameAs": "https://jobs.example.com/companies/home", "identifier": {"value": "11.111.111-0"}},
}
CRUMBS = {"@type": "BreadcrumbList", "itemListElement": [{"position": 3, "item": {"@id": "https://jobs.example.com/companies/acme"}}]}
DOM = ('<div class="card"><div class="job-offer-show-title"><h1>Analista</h1><a href="/companies/dom-co">Dom Co</a></div><span class="break-words">Ñuñoa, Chile</span>'
       '<span class="tag-navy">Presencial</span><span class="tag-primary">CLP $1.000</span><div class="item-subtitle"><span>3 vacantes</span><span>Hace 3 horas</span></div></div>'
       '<h3>Descripción</h3><!-- x -->\n<div><div data-text-toggle-target="short">no</div><div data-text-toggle-target="fullText"><p>Uno</p><p>Dos</p></div></div>'
       '<h3>Requerimientos</h3><div><div data-text-toggle-target="fullText"><ul><li>a</li><li>b</li></ul></div></div>')


def ld(*objs):
    return "".join(f'<script type="application/ld+json">{json.dumps(o)}</script>' for o in objs)


def test_postings(spark):
    pages = [f"<html>{ld(CRUMBS, LD)}{DOM}</html>", f"<html>{DOM}</html>", f"<html>{ld(LD)}</html>", "<html>captcha</html>", "<html>x</html>"]
    rows = X.extract_postings(df(spark, *pages), today()).orderBy("page_id").collect()
    both, dom, only_ld = rows[:3]
    assert (both.title, both.company, both.company_slug, both.location, both.employment_type, both.modality, both.vacancies) == (
        "Analista", "Acme", "acme", "Ñuñoa, Chile", "part_time", "on_site", 3)
    assert tuple(both.salary) == ("CLP $1.000", "CLP", 500000, 900000, "month") and tuple(both.address) == ("Ñuñoa", None, "Chile")
    assert (both.offer_id, both.date_posted, both.valid_through, both.status, both.direct_apply, both.work_hours) == (30814, D(2026, 9, 23), D(2026, 9, 20), "expired", True, "40")
    assert (both.description_text, both.requirements_text, both.posted_at_approx, both.warning) == ("Uno\n\nDos", "- a\n- b", D(2026, 9, 24), None)
    assert (dom.company, dom.company_slug, tuple(dom.salary), dom.status) == ("Dom Co", "dom-co", ("CLP $1.000", "CLP", 1000, 1000, None), "open") and dom.warning
    assert (only_ld.title, only_ld.description_text, only_ld.company_slug, only_ld.location) == ("LD title", "Texto\n- uno", None, None)
    assert [r.violation for r in rows[3:]] == ["blocked", ".job-offer-show-title h1 (or a JSON-LD JobPosting)"]
    assert [r.description_text for r in X.extract_sections(df(spark, pages[0])).collect()] == ["Uno\n\nDos"]


def test_companies(spark):
    c = ('<a class="company-card" href="/companies/acme"><h3 class="company-card__name">Acme</h3><p class="company-card__location"><span>Lima</span></p><div class="company-card__tags">'
         '<span class="tag-navy">Banca</span><span class="tag-navy">11 - 50 empleados</span></div><p class="company-card__offers">2 ofertas activas</p>'
         '<p class="company-card__offer-locations"><span>Lima <strong>+ 7 más</strong></span></p></a>')
    page = lambda inner: f'<turbo-frame id="companies_marketplace_results"><b class="text-primary">2.152</b><div class="company-card loading-company"></div>{inner}</turbo-frame>'
    out = X.extract_companies(df(spark, page(c), page('<a class="company-card" href="/companies/home">x</a>'), "<p>"))
    assert [r.violation for r in out.pages.orderBy("page_id").collect()] == [None, 'a.company-card[href^="/companies/"] (a company slug)', "turbo-frame#companies_marketplace_results"]
    r = out.rows.collect()
    assert len(r) == 1 and (r[0].slug, r[0].name, r[0].location, r[0].sector, r[0].size, r[0].active_offers, r[0].offer_locations) == (
        "acme", "Acme", "Lima", "Banca", "11 - 50 empleados", 2, ["Lima"])
    profile = ('<ol class="breadcrumb__list text-caption"><span>›</span></ol><h1>Acme</h1><div class="text-caption text-gray"><span>Lima</span></div>'
               '<div id="section-job-offers"><h2 class="subsection-header">29 ofertas activas</h2></div><turbo-frame id="company_job_offers_results">' + card("a-1")
               + '<nav class="pagination-nav"><a aria-label="Página siguiente"></a></nav></turbo-frame>')
    out = X.extract_company_page(df(spark, profile), today())
    p = out.pages.first()
    assert (p.name, p.location, p.active_offers, p.has_more, p.next_page, p.violation) == ("Acme", "Lima", 29, True, 2, None)
    assert [r.slug for r in out.rows.collect()] == ["a-1"]


def test_private_lists(spark):
    apps = ('<header><a href="/job_offers/menu">m</a></header><ul><li><a href="/job_offers/a-1">Ver</a><h3>Analista</h3><p class="item-title">Acme</p><time>Postulaste hace 3 días</time>'
            '<span class="badge-status">En revisión</span></li><li><a href="/job_offers/b-2">Contador</a><a href="/job_offers/b-2/save_later">s</a><span class="tag-green">Visto</span>'
            '<span class="tag-navy">Remoto</span></li></ul>')
    fallback = '<div class="application-list"><div class="application-row"><h4>Chofer</h4><p>12/09/2026</p></div></div>'
    rows = X.extract_applications(df(spark, apps, fallback)).orderBy("page_id", "pos").collect()
    assert [(r.slug, r.title, r.company, r.applied_at_text, r.status_text) for r in rows] == [
        ("a-1", "Analista", "Acme", "Postulaste hace 3 días", "En revisión"), ("b-2", "Contador", None, None, "Visto"), (None, "Chofer", None, "12/09/2026", None)]
    links = X.harvest_offer_links(df(spark, apps)).orderBy("pos").collect()
    assert [(r.slug, r.title) for r in links] == [("a-1", "Ver"), ("b-2", "Contador")]
    cvs = '<nav><p>menu.pdf</p></nav><div class="cv-card"><p>Mi CV.pdf</p><p>copia.doc</p><small>Actualizado ayer</small></div>'
    other = '<div class="cv-item"><h3>Mi perfil</h3><i>subido hoy</i></div>'
    rows = X.extract_cv_metadata(df(spark, cvs, other)).orderBy("page_id").collect()
    assert [(r.name, r.updated_at_text) for r in rows] == [("Mi CV.pdf", "Actualizado ayer"), ("Mi perfil", "subido hoy")]


def test_outcomes(spark):
    anon = '<html lang="es-CL"><header id="main-header"><a class="x" href="/users/sign_in">in</a></header></html>'
    pages = df(spark, anon, "<html lang=en>", "x", "x", "cf-chl", "x", status=[200, 200, 404, 500, 503, 302])
    rows = X.classify_pages(pages, private=F.col("page_id") == 0).orderBy("page_id").collect()
    assert [(r.outcome, r.exit_code) for r in rows] == [("AUTH_REQUIRED", 2), ("OK", 0), ("NOT_FOUND", 3), ("NETWORK", 4), ("BLOCKED", 4), ("SITE_CHANGED", 5)]
    assert [r.locale_warning for r in rows[:2]] == [None, "page language is en"]


def test_json_bodies(spark):
    j = "application/json; charset=utf-8"
    bodies = spark.createDataFrame([
        (1, json.dumps({"areas": [{"id": 1, "name": "Santiago", "display_path": "Chile/Santiago", "offer_count": 5, "visitor_country_match": True}]}), j),
        (2, json.dumps({"areas": [{"id": 1}]}), j), (3, "{}", j), (4, "<p>captcha", "text/html"), (5, '{"areas":[]}', j)], "page_id int, body string, content_type string").coalesce(1)
    out = X.read_json_api(bodies, "areas")
    assert [(r.page_id, r.name, r.offer_count) for r in out.rows.collect()] == [(1, "Santiago", 5)]
    assert [r.violation for r in out.pages.orderBy("page_id").collect()] == [None, "areas without id, name or display_path", "areas response without its list", "blocked", None]
    hits = spark.createDataFrame([(1, '{"results":[{"hits":[{"query":"a","popularity":3},{"popularity":1},{"query":"b"}]}]}', j)], "page_id int, body string, content_type string")
    assert [(r.query, r.popularity) for r in X.read_json_api(hits, "suggestions").rows.collect()] == [("a", 3), ("b", None)]
    similar = spark.createDataFrame([(1, '{"items":["x"," ","y"],"resolved_name":"X"}', j)], "page_id int, body string, content_type string")
    assert [r.role for r in X.read_json_api(similar, "similar").rows.collect()] == ["x", "y"]


def test_private_lists(spark):
    cards = ('<body><header><a href="/job_offers/menu">m</a></header><div class="job-offer-card" data-scroll-restore-slug="a-1"><h2 class="job-offer-card__title">Uno</h2>'
             '<p class="item-title">E</p></div><div class="job-offer-card" data-scroll-restore-slug="b-2"></div><a href="/job_offers/c-3">Tres</a></body>')
    links = '<a href="/job_offers/c-3"><h3>Tres</h3> ver</a><a href="/job_offers/c-3">otra</a><a href="/job_offers/d-4"> </a><a href="/job_offers/e-5/save_later">x</a><a href="/job_offers/f-6">Seis</a>'
    gone = '<header id="main-header"><a href="/users/sign_in">Entrar</a></header>' + cards
    nav = '<nav class="pagination-nav"><a aria-label="Página 3">3</a><a aria-label="Página siguiente">s</a></nav>' + links
    pages = df(spark, cards, links, gone, nav, "", None)
    out = X.extract_private_list(pages, "saved_jobs", F.lit("2026-01-01").cast("date"))
    rows = out.rows.orderBy("page_id", "pos").collect()
    first = pages.orderBy("page_id").first().page_id
    assert [(r.page_id - first, r.slug, r.title, r.company) for r in rows] == [
        (0, "a-1", "Uno", "E"), (1, "c-3", "Tres", None), (1, "f-6", "Seis", None), (3, "c-3", "Tres", None), (3, "f-6", "Seis", None)]
    facts = [(r.last_page, r.has_next, r.violation) for r in out.pages.orderBy("page_id").collect()]
    assert facts == [(1, False, None), (1, False, None), (1, False, "AUTH_REQUIRED"), (3, True, None), (1, False, None), (1, False, None)]
    assert {r.page_id - first for r in X.extract_private_list(pages, "applications").rows.collect()} == {0, 1, 3}
    with pytest.raises(ValueError):
        X.extract_private_list(pages, "inbox")
    with pytest.raises(ValueError):
        X.extract_private_list(pages, "saved_jobs")
