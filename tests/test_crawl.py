import pytest
from pyspark.sql import functions as F

from vacantia.functions import robots
from vacantia.operators import crawl as C

LIST = "https://jobs.example.com/job_offers"


def allowed(evaluate, text, *urls, agent="my-crawler/1.0", status=200):
    return evaluate(lambda c: robots.robots_allowed(c, text, agent, status=status), list(urls))


def test_robots(evaluate):
    text = ("User-agent: *\nAllow: /\nDisallow: /profile\nDisallow: /job_offers/*/recommendations\n"
            "Disallow: /*?sort_by=\nDisallow: /*&locale=\n")
    assert allowed(evaluate, text, LIST, LIST + "/a", LIST + "/a/recommendations", LIST + "?sort_by=x", LIST + "?page=2&locale=en",
                   "https://jobs.example.com/profile") == [True, True, False, False, False, False]
    assert allowed(evaluate, "User-agent: *\nAllow: /\nDisallow: /job_offers\n", LIST) == [False]
    assert allowed(evaluate, "User-agent: *\nDisallow: /job_offers\nAllow: /job_offers?countries\n", LIST) == [False]
    assert allowed(evaluate, "User-agent: *\nAllow: /job_offers\nDisallow: /job_offers/*/recommendations\n", LIST) == [True]
    assert allowed(evaluate, "User-agent: *\nAllow: /\n\nUser-agent: my-crawler\nDisallow: /\n", LIST) == [False]
    assert allowed(evaluate, "User-agent: *\nDisallow: /\n\nUser-agent: my-crawler\nAllow: /job_offers\n", LIST) == [True]
    dollar = "User-agent: *\nDisallow: /*.pdf$\nDisallow:\n"
    assert allowed(evaluate, dollar, "https://jobs.example.com/f/x.pdf", "https://jobs.example.com/f/x.pdf?d=1", LIST) == [False, True, True]
    assert allowed(evaluate, "", LIST) == [True]
    assert [allowed(evaluate, "", LIST, status=s)[0] for s in (403, 404, 503)] == [False, True, False]
    assert allowed(evaluate, "User-agent: *\nDisallow: /a%20b\n", "https://jobs.example.com/a%20b/c") == [False]
    assert robots.crawl_delay("User-agent: *\nCrawl-delay: 5\nAllow: /\n", "x/1") == 5.0


def cards(spark, *pages):
    return spark.createDataFrame(
        [(p + 1, i, s) for p, page in enumerate(pages) for i, s in enumerate(page)], "page int, pos int, slug string")


def test_dedupe_first(spark):
    df = cards(spark, ["a", "a", "b"], ["b", None, "c", None])
    rows = sorted((r.page, r.pos, r.slug or "") for r in C.dedupe_first(df, "slug", ["page", "pos"]).collect())
    assert rows == [(1, 0, "a"), (1, 2, "b"), (2, 1, ""), (2, 2, "c"), (2, 3, "")]


def test_new_per_page_and_running_total(spark):
    df = cards(spark, ["a", "a", "b"], ["b"], ["c", "a"])
    rows = C.new_per_page(df).orderBy("page").collect()
    assert [(r.page, r.cards, r.new, r.duplicates, r.offers_so_far) for r in rows] == [(1, 3, 2, 1, 2), (2, 1, 0, 1, 2), (3, 2, 1, 1, 3)]
    many = spark.range(1, 1001).select(F.col("id"), (F.col("id") % 7).alias("v"))
    got = C.running_total(many, "id", "v", "t", width=4).orderBy("id").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.t == total


def log(spark, rows, last=None):
    return spark.createDataFrame(
        [(i + 1, c, n, last if i == 0 else 99, o) for i, (c, n, o) in enumerate(rows)],
        "page int, cards int, new int, last_page int, outcome string")


@pytest.mark.parametrize("rows,last,cap,expected", [
    ([(3, 3, "ok"), (0, 0, "ok"), (3, 3, "ok")], None, None, (2, "empty", 1, 3)),
    ([(3, 3, "ok"), (2, 2, "ok"), (3, 3, "ok")], 2, None, (2, "last_page", 2, 5)),
    ([(3, 3, "ok")] * 5, None, 4, (4, "max_pages", 4, 12)),
    ([(3, 3, "ok"), (3, 0, "ok"), (3, 0, "ok"), (3, 0, "ok"), (3, 1, "ok")], None, None, (4, "no_new", 4, 3)),
    ([(3, 3, "ok"), (0, 0, "blocked"), (3, 3, "ok")], None, None, (2, "blocked", 1, 3)),
    ([(3, 3, "ok")] * 2, None, None, (None, None, 2, 6)),
])
def test_stop_reason(spark, rows, last, cap, expected):
    row = C.stop_reason(log(spark, rows, last), max_pages=cap, outcome="outcome").collect()
    assert [tuple(r) for r in row] == [expected]


def test_stop_reason_per_run(spark):
    df = log(spark, [(3, 3, "ok"), (0, 0, "ok")]).withColumn("run", F.lit("a")).unionByName(
        log(spark, [(3, 3, "ok"), (1, 1, "ok")], 2).withColumn("run", F.lit("b")))
    assert sorted(tuple(r) for r in C.stop_reason(df, by=["run"]).collect()) == [("a", 2, "empty", 1, 3), ("b", 2, "last_page", 2, 4)]


def test_enrich_and_stats(spark):
    offers = spark.createDataFrame([("a", 1, "old", None), ("b", 2, None, 5), ("c", 3, None, None)],
                                   "slug string, pos int, description string, salary_min bigint")
    details = spark.createDataFrame([("a", "", 7), ("b", "new", None), ("c", "", None)], "slug string, description string, salary_min bigint")
    fields = ("description", "salary_min")
    rows = C.enrich(offers, details, fields=fields).orderBy("slug").collect()
    assert [(r.slug, r.description, r.salary_min, r.enriched) for r in rows] == [
        ("a", "old", 7, True), ("b", "new", 5, True), ("c", None, None, False)]
    limited = C.enrich(offers, details, fields=fields, order=["pos"], limit=1).orderBy("slug").collect()
    assert [r.enriched for r in limited] == [True, None, None]
    page_log = spark.createDataFrame([(1, 3, "ok", 30, 2, 1, 1.5), (2, 1, "error", None, None, 4, 2.0)],
                                     "page int, cards int, outcome string, total int, last_page int, requests int, seconds double")
    row = C.crawl_stats(cards(spark, ["a", "a", "b"], ["c"]), page_log, C.enrich(offers, details, fields=fields)).first()
    assert row.asDict() == {"pages": 2, "offers": 3, "duplicates": 1, "enriched": 2, "errors": 2, "status": "PARTIAL", "blocked": False,
                            "total_reported": 30, "last_page": 2, "requests": 5, "duration_s": 3.5}


def test_budget_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [("k" if rng.random() < 0.6 else f"k{rng.randrange(3)}", i, rng.randrange(5 * 3600 * 10) / 10) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, i int, s double").withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("bigint")))
    got = {r.i: r for r in C.hourly_budget(df, max_per_hour=20).collect()}
    assert len(got) == len(rows)
    for key, i, s in rows:
        window = [t for k, _, t in rows if k == key and s - 3600 < t <= s]
        assert got[i].demand == len(window)
        assert got[i].over_budget == (len(window) > 20)
    gaps = {r.i: r.gap_us for r in C.spacing_violations(df, min_gap_s=5).collect()}
    for key in {k for k, _, _ in rows}:
        times = sorted((t, i) for k, i, t in rows if k == key)
        close = [(round((b - a) * 1e6)) for (a, _), (b, _) in zip(times, times[1:]) if b - a < 5]
        assert sorted(close) == sorted(v for i, v in gaps.items() if dict((j, k) for k, j, _ in rows)[i] == key)


def test_attempt_outcomes(spark):
    rows = [("a", 0, 503, None, 0), ("a", 1, 200, None, 2), ("b", 0, 429, None, 0), ("b", 1, 429, None, 1), ("c", 0, 503, 400.0, 0),
            ("d", 0, 404, None, 0), ("e", 0, 500, None, 0), ("e", 1, 500, None, 3)]
    df = spark.createDataFrame(rows, "request_id string, attempt int, status int, retry_after double, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: tuple(r)[1:] for r in C.attempt_outcomes(df).collect()}
    assert got == {"a": (2, 200, "ok", 0), "b": (2, 429, "blocked", 1), "c": (1, 503, "blocked", 0), "d": (1, 404, "http_error", 0),
                   "e": (2, 500, "error", 0)}


def test_backoff_and_network_errors(spark):
    rows = [("f", 0, 503, None, 0.0), ("f", 1, 503, None, 2.5), ("f", 2, 200, None, 5.5), ("g", 0, None, None, 0.0), ("g", 1, None, None, 1.0),
            ("h", 4, 500, 400.0, 0.0), ("i", 0, 503, 9.0, 0.0), ("i", 1, 200, None, 8.0)]
    df = spark.createDataFrame(rows, "request_id string, attempt int, status int, retry_after double, s double").withColumn("ts", F.timestamp_millis((F.col("s") * 1000).cast("bigint")))
    got = {r.request_id: tuple(r)[1:] for r in C.attempt_outcomes(df).collect()}
    assert got == {"f": (3, 200, "ok", 1), "g": (2, None, "error", 1), "h": (1, 500, "error", 0), "i": (2, 200, "ok", 1)}


def test_hourly_budget_with_ties_and_a_busy_hour(spark):
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["a", None]), rng.randrange(9000) * 500_000) for _ in range(800)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, key string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r.i: r for r in C.hourly_budget(df, max_per_hour=100).collect()}
    assert len(got) == len(rows)
    for i, (key, us) in enumerate(rows):
        inside = [t for k, t in rows if k == key and us - 3_600_000_000 < t <= us]
        assert got[i].demand == len(inside)
        assert got[i].next_slot_min == (-(-(min(inside) + 3_600_000_000 - us) // 60_000_000) if len(inside) > 100 else None)


def test_hourly_budget_when_moments_span_partitions(spark):
    """More partitions than moments: one moment, one key and one hour lie in many of them."""
    import random

    rng = random.Random(9)
    hour = 3_600_000_000
    times = [0, 1, hour - 1, hour, hour + 1, 2 * hour, 2 * hour + 1]
    rows = [("hot", rng.choice(times)) for _ in range(900)] + [("a", t) for t in times for _ in range(3)] + [("z", 5)] * 40 + [("none", None)] * 4
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, key string, us bigint").withColumn("ts", F.timestamp_micros("us"))
    before = {name: spark.conf.get(name) for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r for r in C.hourly_budget(df, max_per_hour=100).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(got) == len(rows)
    for i, (key, us) in enumerate(rows):
        inside = [t for k, t in rows if k == key and t is not None and us - hour < t <= us] if us is not None else []
        assert got[i].demand == (len(inside) if us is not None else None)
        assert got[i].next_slot_min == (-(-(min(inside) + hour - us) // 60_000_000) if len(inside) > 100 else None)


def test_robots_by_host(spark):
    """Every host has its own file; the join gives what the one-host expression gives."""
    texts = {
        "a.example": ("User-agent: *\nDisallow: /p*q$\nDisallow: /x\nAllow: /x/y\n", 200), "b.example": ("User-agent: bot\nDisallow:\n", 200), "c.example": ("User-agent: *\nDisallow: /\n", 404),
        "d.example": ("", 503), "e.example": (None, 200), "f.example": ("User-agent: *\nDisallow: /\nUser-agent: bot\nAllow: /ok\nDisallow: /\n", 200), "g.example": ("", 403)}
    files = spark.createDataFrame([(h, s, t) for h, (t, s) in texts.items()] + [("h.example", None, None)], "host string, status int, body string")
    paths = ["", "/", "/x", "/x/y", "/p1q", "/p1q?z", "/ok/1", "/x%2Fy"]
    urls = spark.createDataFrame([(f"https://{h.upper()}{p}",) for h in (*texts, "h.example", "z.example") for p in paths], "url string")
    got = {r.url: r.allowed for r in robots.robots_verdicts(urls, robots.robots_table(files, "bot/2.0")).collect()}
    assert len(got) == 9 * len(paths) and all(got[f"https://Z.EXAMPLE{p}"] is None and got[f"https://H.EXAMPLE{p}"] is False for p in paths)
    for host, (text, status) in texts.items():
        each = [f"https://{host.upper()}{p}" for p in paths]
        want = [r.o for r in spark.createDataFrame(list(enumerate(each)), "i int, u string").select("i", robots.robots_allowed(F.col("u"), text or "", "bot/2.0", status=status).alias("o")).orderBy("i").collect()]
        assert [got[u] for u in each] == want, host


def test_robots_of_many_rules(spark):
    """Random rules with wildcards, end marks and equal heads: the join gives what the one-host expression gives."""
    import random

    rng = random.Random(21)
    parts = ["/a", "/b", "/a/b", "*", "$", "/ñ", "/a$b", "?q="]
    texts = {f"h{k}.example": "User-agent: *\n" + "".join(f"{rng.choice(['Allow', 'Disallow'])}: {''.join(rng.choice(parts) for _ in range(rng.randrange(0, 4)))}\n" for _ in range(rng.randrange(0, 30))) for k in range(6)}
    paths = ["", "/", *("".join(rng.choice(["/a", "/b", "/ñ", "/a$b", "?q=1", "x"]) for _ in range(rng.randrange(1, 5))) for _ in range(40))]
    paths = ["/" + p.lstrip("/") for p in paths]
    urls = spark.createDataFrame([(f"https://{h}{p}", "z", k) for h in texts for k, p in enumerate(paths * 2)] + [(None, "z", 0)], "url string, host string, closed int")
    files = spark.createDataFrame([(h, 200, t) for h, t in texts.items()], "host string, status int, body string")
    judged = robots.robots_verdicts(urls, robots.robots_table(files, "bot"))
    rows = judged.collect()
    assert judged.columns == [*urls.columns, "allowed"] and len(rows) == urls.count()
    got = {r.url: r.allowed for r in rows}
    assert got[None] is None
    for host, text in texts.items():
        each = [f"https://{host}{p}" for p in paths]
        want = [r.o for r in spark.createDataFrame(list(enumerate(each)), "i int, u string").select("i", robots.robots_allowed(F.col("u"), text, "bot").alias("o")).orderBy("i").collect()]
        assert [got[u] for u in each] == want, host
