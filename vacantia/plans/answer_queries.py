"""Form questions, prefill, review queue, CV profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators import answers as an
from vacantia.plans.derived import pick, pick_sql, table
from vacantia.plans.registry import query

LABELS = [
    "Renta esperada", "¿Cuál es tu sueldo actual?", "Correo electrónico", "Ingresa tu clave", "Comenta tu experiencia en remuneraciones", "¿Tienes disponibilidad?", "Comuna de residencia",
    "¿Cuál es tu título?", "Nivel de inglés", "¿Algo más?", "Cuéntanos sobre ti", "Licencia de conducir", "Describe tus tareas", "Edad",
]
TARGETS = [
    "salary", "salary_other", "contact", "credential", "experiencia", "availability", "comuna", "titulo", "idioma", None, "cover_letter", "licencia", None, "edad",
]
KINDS = ["text", "textarea", "number", "select"]
N = len(LABELS)
QUESTIONS = f"q AS (SELECT conv_id, turn, conv_id % 3 AS owner, {pick_sql('(conv_id * 7 + turn)', LABELS)} AS label, {pick_sql('(conv_id * 7 + turn)', TARGETS)} AS target, {pick_sql('(conv_id + turn // 2)', KINDS)} AS kind FROM conversations WHERE role = 'user')"


def questions(spark, folder) -> DataFrame:
    """Form fields: every user turn asks one question; the conversation is the form."""
    k, t = F.col("conv_id"), F.col("turn")
    return table(spark, folder, "conversations").where(F.col("role") == "user").select(
        k.alias("conv_id"), t.alias("turn"), (k % 3).alias("owner"), F.concat(F.lit("form-"), k.cast("string")).alias("slug"), t.alias("pos"), F.concat(F.lit("q"), t.cast("string")).alias("name"),
        pick(k * 7 + t, LABELS).alias("label"), pick(k + F.floor(t / 2), KINDS).alias("kind"), F.when(t % 5 == 4, 6).alias("max_length"), "text")


ANSWER_FILES = {
    0: '{"profile":{"titulo":"Ingeniería Comercial","comuna":"Ñuñoa, Santiago","experiencia":"Seis años en análisis","edad":"<edad>"},"fixed":{"salary":"1.500.000","availability":"Inmediata"},"per_question":{"sueldo ACTUAL":"1.200.000","correo":"p@example.org","_x":"y"}}',
    1: '{"profile":{"idioma":"Inglés medio","licencia":"Clase B"},"fixed":{"salary":"a convenir","cover_letter":"Soy puntual","generic":"Con gusto"},"per_question":{"titulo":"Abogada","clave":"secreto"}}',
    2: '{"profile":null,"fixed":{"salary":900000},"per_question":{"<p>":"x","edad":["1"]}}',
}


def answer_files(spark, folder) -> DataFrame:
    """The answers of each owner, one file per owner that asks anything."""
    k = F.col("owner")
    body = F.when(k == 0, ANSWER_FILES[0]).when(k == 1, ANSWER_FILES[1]).otherwise(ANSWER_FILES[2])
    return questions(spark, folder).select("owner").distinct().select("owner", body.alias("body"))


@query("a0_load_answers", """
SELECT owner, CASE owner WHEN 0 THEN 'comuna=Ñuñoa, Santiago;experiencia=Seis años en análisis;titulo=Ingeniería Comercial' WHEN 1 THEN 'idioma=Inglés medio;licencia=Clase B' ELSE '' END AS profile,
  CASE owner WHEN 0 THEN 'sueldo actual=1.200.000;correo=p@example.org' WHEN 1 THEN 'titulo=Abogada;clave=secreto' ELSE '' END AS per_question,
  CASE owner WHEN 0 THEN 'availability=Inmediata;salary=1.500.000' WHEN 1 THEN 'cover_letter=Soy puntual;generic=Con gusto;salary=a convenir' ELSE 'salary=900000' END AS fixed,
  CAST(NULL AS VARCHAR) AS error FROM (SELECT DISTINCT conv_id % 3 AS owner FROM conversations WHERE role = 'user')""")
def a0_load_answers(spark, folder):
    loaded = an.load_answers(answer_files(spark, folder))
    flat = lambda entries: F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return loaded.select("owner", flat(F.array_sort(F.map_entries("profile"))).alias("profile"), flat(F.col("per_question")).alias("per_question"),
                         flat(F.array_sort(F.map_entries("fixed"))).alias("fixed"), "error")


SQL_RULES = "\n".join(f"WHEN regexp_matches(n, '(^|[^a-z0-9])(?:{'|'.join(k)})') THEN '{t}'" for k, t in an.RULES)
PAY = an.PAY_TOPIC.replace(r"(?<![a-z0-9])", "(^|[^a-z0-9])").replace("(?![a-z0-9])", "($|[^a-z0-9])")


def starts(pattern: str) -> str:
    return pattern.replace(r"(?<![a-z0-9])", "(^|[^a-z0-9])")


@query("a1_classify_question", rf"""
WITH {QUESTIONS}, v AS (SELECT c.conv_id, c.turn, trim(regexp_replace(strip_accents(lower(q.label || ' ' || c.text)), '\s+', ' ', 'g')) AS n FROM conversations c JOIN q ON c.conv_id = q.conv_id AND c.turn = q.turn)
SELECT conv_id, turn, CASE WHEN regexp_matches(n, '{an.CREDENTIAL}') THEN 'credential' WHEN regexp_matches(n, '{an.CONTACT}') THEN 'contact'
  WHEN regexp_matches(n, '{PAY}') AND NOT regexp_matches(n, '{starts(an.PAY_EXPERIENCE)}') AND (regexp_matches(n, '{starts(an.PAY_NOT_EXPECTED)}') OR NOT regexp_matches(n, '{starts(an.PAY_EXPECTATION)}')) THEN 'salary_other'
  WHEN regexp_matches(n, '{PAY}') AND NOT regexp_matches(n, '{starts(an.PAY_EXPERIENCE)}') THEN 'salary'
  {SQL_RULES} WHEN regexp_matches(n, '{PAY}') THEN 'salary_other' END AS target FROM v""")
def a1_classify_question(spark, folder):
    """Every user turn, whole text, behind one of the usual questions."""
    return questions(spark, folder).select("conv_id", "turn", an.classify_question(F.concat_ws(" ", "label", "text")).alias("target"))


VALUE = """CASE WHEN target = 'credential' THEN ''
  WHEN owner = 0 AND label = '¿Cuál es tu sueldo actual?' THEN '1.200.000' WHEN owner = 0 AND target = 'contact' THEN 'p@example.org' WHEN owner = 1 AND target = 'titulo' THEN 'Abogada' WHEN target = 'contact' THEN ''
  WHEN target = 'salary' THEN CASE owner WHEN 0 THEN '1500000' WHEN 1 THEN '' ELSE '900000' END WHEN target = 'salary_other' THEN ''
  WHEN owner = 0 AND target = 'titulo' THEN 'Ingeniería Comercial' WHEN owner = 0 AND target = 'comuna' THEN 'Ñuñoa, Santiago' WHEN owner = 0 AND target = 'experiencia' THEN 'Seis años en análisis'
  WHEN owner = 0 AND target = 'availability' THEN 'Inmediata' WHEN owner = 1 AND target = 'idioma' THEN 'Inglés medio' WHEN owner = 1 AND target = 'licencia' THEN 'Clase B' WHEN owner = 1 AND target = 'cover_letter' THEN 'Soy puntual'
  WHEN kind = 'textarea' THEN CASE owner WHEN 1 THEN 'Con gusto' ELSE 'Puedo ampliar esta información en una entrevista.' END ELSE '' END"""


@query("a2_answer_for", f"WITH {QUESTIONS} SELECT conv_id, turn, {VALUE} AS answer FROM q")
def a2_answer_for(spark, folder):
    files = an.load_answers(answer_files(spark, folder)).select("owner", F.struct("profile", "per_question", "fixed").alias("answers"))
    asked = questions(spark, folder).join(files, "owner")
    return asked.select("conv_id", "turn", an.answer_for(F.col("label"), F.col("kind"), F.col("answers"), fill_generic=True).alias("answer"))


@query("j8_per_question_match", f"""
WITH {QUESTIONS} SELECT conv_id, turn, CASE WHEN owner = 0 AND label = '¿Cuál es tu sueldo actual?' THEN 'sueldo actual' WHEN owner = 0 AND target = 'contact' THEN 'correo' WHEN owner = 1 AND target = 'titulo' THEN 'titulo'
  WHEN owner = 1 AND target = 'credential' THEN 'clave' END AS matched FROM q""")
def j8_per_question_match(spark, folder):
    """The first per-question key, in file order, that the label contains."""
    from vacantia.functions.folding import let, normalize

    files = an.load_answers(answer_files(spark, folder)).select("owner", "per_question")
    first = let(normalize(F.col("label")), lambda n: F.try_element_at(F.filter("per_question", lambda e: F.contains(n, e["key"])), F.lit(1))["key"])
    return questions(spark, folder).join(files, "owner").select("conv_id", "turn", first.alias("matched"))


PREFILL = f"""{QUESTIONS}, a AS (SELECT *, CASE WHEN target = 'credential' OR kind = 'select' THEN NULL ELSE {VALUE} END AS v, CASE WHEN turn % 5 = 4 THEN 6 WHEN kind = 'number' THEN 20 ELSE 2000 END AS lim FROM q),
p AS (SELECT conv_id, turn, label, nullif(CASE WHEN kind = 'number' THEN CASE WHEN regexp_matches(v, '^[0-9]+$') AND length(v) <= lim THEN v ELSE '' END WHEN length(v) <= lim THEN v
  WHEN substr(v, lim + 1, 1) = ' ' OR regexp_matches(left(v, lim), '\\s$') THEN rtrim(left(v, lim)) WHEN contains(left(v, lim), ' ') THEN rtrim(regexp_extract(left(v, lim), '^(.*\\S)\\s+\\S*$', 1)) ELSE left(v, lim) END, '') AS value FROM a
  WHERE kind <> 'select' AND target IS DISTINCT FROM 'credential')""".replace("\\\\", "\\")


def prefilled(spark, folder) -> DataFrame:
    return an.prefill(questions(spark, folder), an.load_answers(answer_files(spark, folder)), fill_generic=True)


@query("a3_prefill", f"WITH {PREFILL} SELECT conv_id, turn, value FROM p")
def a3_prefill(spark, folder):
    return prefilled(spark, folder).select("conv_id", "turn", "value")


def queue(spark, folder) -> DataFrame:
    k = F.col("conv_id")
    targets = table(spark, folder, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns")).select(
        F.concat(F.lit("form-"), k.cast("string")).alias("slug"), F.lit("T").alias("title"), F.lit("C").alias("company"), F.when(k % 10 == 9, False).when(k % 10 != 8, True).alias("opened"))
    return an.review_queue(targets, prefilled(spark, folder))


QUEUE = f"""{PREFILL}, c AS (SELECT DISTINCT conv_id FROM conversations), f AS (SELECT conv_id, count(value) AS filled, count(*) - count(value) AS blank, count(*) AS n,
  string_agg(label, ';' ORDER BY turn) FILTER (WHERE value IS NULL) AS left_blank FROM p GROUP BY conv_id),
r AS (SELECT c.conv_id, CASE WHEN c.conv_id % 10 = 9 THEN 'NOT_OPENED' WHEN c.conv_id % 10 = 8 THEN 'FORM_NOT_FOUND' ELSE 'READY_FOR_REVIEW' END AS status, c.conv_id % 10 < 8 AND f.n IS NOT NULL AS ok, f.* EXCLUDE (conv_id)
  FROM c LEFT JOIN f USING (conv_id))"""


@query("a4_review_queue", f"""
WITH {QUEUE} SELECT 'form-' || conv_id AS slug, status, CASE WHEN ok THEN filled ELSE 0 END AS answers, CASE WHEN ok THEN coalesce(left_blank, '') ELSE '' END AS left_blank, CASE WHEN ok THEN n ELSE 0 END AS fields_detected,
  'https://jobs.example.com/job_offers/form-' || conv_id || '?tab=apply' AS url FROM r""")
def a4_review_queue(spark, folder):
    return queue(spark, folder).select("slug", F.substring_index("status", " ", 1).alias("status"), F.size(F.map_keys("answers")).alias("answers"),
                                       F.array_join("left_blank", ";").alias("left_blank"), "fields_detected", "url")


@query("g6_queue_summary", f"""
WITH {QUEUE} SELECT count(*) FILTER (WHERE status = 'READY_FOR_REVIEW') AS opened, sum(CASE WHEN ok THEN filled ELSE 0 END) AS answers_typed, count(*) FILTER (WHERE status = 'FORM_NOT_FOUND') AS no_form,
  count(*) FILTER (WHERE status = 'NOT_OPENED') AS failed FROM r""")
def g6_queue_summary(spark, folder):
    return an.queue_summary(queue(spark, folder))


@query("r16_unique_labels", """
SELECT o_orderkey AS pos, CASE WHEN n > 1 THEN o_orderpriority || ' (' || n || ')' ELSE o_orderpriority END AS unique_label
FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)""")
def r16_unique_labels(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("record"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("label"))
    return an.unique_labels(rows).select("pos", "unique_label")


@query("r16_mixed_labels", """
WITH t AS (SELECT o_custkey AS record, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 'x (2)' ELSE 'x' END AS label FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY record, label ORDER BY pos) AS n FROM t),
f AS (SELECT record, min(pos) FILTER (WHERE label = 'x (2)') AS literal, min(pos) FILTER (WHERE label = 'x' AND n = 2) AS second FROM r GROUP BY record)
SELECT r.record, pos, CASE
  WHEN label = 'x' AND n = 1 THEN 'x' WHEN label = 'x' THEN 'x (' || n + CASE WHEN literal < second THEN 1 ELSE 0 END || ')'
  WHEN second IS NULL OR literal < second THEN CASE WHEN n = 1 THEN 'x (2)' ELSE 'x (2) (' || n || ')' END ELSE 'x (2) (' || n + 1 || ')' END AS unique_label
FROM r JOIN f USING (record)""")
def r16_mixed_labels(spark, folder):
    """Records where every fourth label is the literal name of a repeat, before or after that repeat comes."""
    k = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("record"), k.alias("pos"), F.when(k % 4 == 0, "x (2)").otherwise("x").alias("label"))
    return an.unique_labels(rows).select("record", "pos", "unique_label")


CV_TEXT = """d AS (SELECT doc_id, lang, source, regexp_extract(text, '^([^\\n]*)', 1) AS line, text FROM documents)""".replace("\\\\", "\\")


@query("a5_cv_profile", f"""
WITH {CV_TEXT}, s AS (SELECT *, trim(regexp_replace(line || ' y más', '\\s+', ' ', 'g')) AS s FROM d)
SELECT doc_id, CASE WHEN length(s) <= 600 THEN s ELSE regexp_extract(left(s, 600), '^(.+) [^ ]*$', 1, 's') END AS experiencia, 'Título ' || source AS titulo, 'Comuna ' || source AS comuna, 'Español nativo, ' || lang AS idioma FROM s""".replace("\\\\", "\\"))
def a5_cv_profile(spark, folder):
    """CVs that hold a whole document: its first line is the summary, the rest comes under another heading."""
    line = F.regexp_extract("text", r"^([^\n]*)", 1)
    cv = F.concat(
        F.lit("Nombre\n\nPerfil profesional\n\n"), line, F.lit("\n  y más\nEducación\r\nTítulo profesional: Título  "), "source", F.lit("\nComuna - Comuna "), "source",
        F.lit("\nIdiomas: Español nativo, "), "lang", F.lit("; sin ruso\n"), "text")
    found = table(spark, folder, "documents").select("doc_id", an.cv_profile(cv).alias("p"))
    return found.select("doc_id", *[F.try_element_at("p", F.lit(k)).alias(k) for k in ("experiencia", "titulo", "comuna", "idioma")])


@query("a6_merge_profile", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Propio' ELSE source END AS titulo, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Ñuñoa' END AS comuna,
  CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'comuna' ELSE 'comuna;titulo' END ELSE CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'titulo' END END AS seeded FROM documents""")
def a6_merge_profile(spark, folder):
    k = F.col("doc_id")
    user = F.create_map(F.lit("titulo"), F.when(k % 3 == 0, "Propio").otherwise(""), F.lit("comuna"), F.when(k % 2 == 0, "").otherwise("Ñuñoa"))
    cv = F.create_map(F.lit("titulo"), F.col("source"), F.lit("comuna"), F.col("lang"), F.lit("otro"), F.lit("x"))
    merged = table(spark, folder, "documents").select("doc_id", an.merge_profile(user, cv).alias("m"))
    return merged.select("doc_id", F.try_element_at("m.profile", F.lit("titulo")).alias("titulo"), F.try_element_at("m.profile", F.lit("comuna")).alias("comuna"), F.array_join("m.seeded", ";").alias("seeded"))
