import json

import pytest
from pyspark.sql import functions as F

from vacantia.operators import answers as A

ANSWERS = {
    "profile": {"experiencia": "6 años en análisis.", "comuna": "Ñuñoa", "_help": "x", "edad": "<edad>", "licencia": " ", "idioma": ["x"], "titulo": True},
    "fixed": {"salary": "1.500.000", "availability": "Inmediata", "generic": "Puedo contarlo."},
    "per_question": {"Sueldo ACTUAL": "1.200.000", "correo": "paz@example.com", "clave": "secreto", "<x>": "y"},
}


def answers(spark, doc=ANSWERS):
    return A.load_answers(spark.createDataFrame([(1, json.dumps(doc) if not isinstance(doc, str) else doc)], "owner int, body string"))


def test_load(spark):
    row = answers(spark).first()
    assert row.profile == {"experiencia": "6 años en análisis.", "comuna": "Ñuñoa"}
    assert [tuple(e) for e in row.per_question] == [("sueldo actual", "1.200.000"), ("correo", "paz@example.com"), ("clave", "secreto")]
    assert row.error is None
    assert answers(spark, "{bad").first().error == "not valid JSON"
    assert answers(spark, "[1]").first().error == "the answers file must be a JSON object"
    assert answers(spark, {"profile": [1]}).first().error == "'profile' must be an object of text answers"
    empty = answers(spark, {"profile": None}).first()
    assert (empty.profile, empty.per_question, empty.error) == ({}, [], None)
    numbers = answers(spark, {"fixed": {"salary": 1500000, "z": 1, "a": 2}}).first()
    assert numbers.fixed == {"salary": "1500000", "z": "1", "a": "2"}


def test_classify(evaluate):
    groups = {
        "credential": ["Contraseña", "Password", "Ingresa tu clave", "PIN", "Código 2FA", "Código de verificación", "Ingresa el código de 6 dígitos",
                       "Código enviado a tu correo", "Token", "Security code", "One-time password", "Enter your one time code"],
        "contact": ["RUT", "Correo electrónico", "Número de celular"],
        "salary": ["Indique su pretensión de renta líquida", "Pretensiones de renta", "¿Cuánto quieres ganar?", "Renta esperada",
                   "¿Cuál es tu aspiración salarial?", "¿Qué sueldo líquido esperas?"],
        "salary_other": ["¿Cuál es tu sueldo actual?", "¿Cuál fue tu último sueldo líquido?", "Indica tu renta bruta esperada", "Pretensión de renta bruta", "Renta",
                         "Sueldo", "Manejo de liquidaciones de sueldo"],
        "experiencia": ["Comenta tu experiencia en remuneraciones y liquidación de sueldos", "Describe tu experiencia en el área de remuneraciones", "¿En qué área?"],
        "availability": ["¿Cuál es tu disponibilidad?"], "licencia": ["¿Tienes licencia de conducir?"], "comuna": ["Comuna de residencia"],
        None: ["¿Cómo mejorarías la rentabilidad de un producto?", "Código postal", "Describe tus tareas", ""],
    }
    for target, labels in groups.items():
        assert evaluate(A.classify_question, labels) == [target] * len(labels), target


def fill(spark, rows, **kw):
    fields = spark.createDataFrame([(1, "s", i, n, l, k, m) for i, (n, l, k, m) in enumerate(rows)],
                                   "owner int, slug string, pos int, name string, label string, kind string, max_length int")
    return {r.pos: r.value for r in A.prefill(fields, answers(spark), **kw).collect()}


def test_prefill(spark):
    rows = [("q1", "Renta esperada", "number", None), ("q2", "¿Cuál es tu sueldo actual?", "text", None), ("q3", "Correo", "text", None), ("q4", "Teléfono", "textarea", None),
            ("q5", "Ingresa tu clave", "text", None), ("q6", "Cuéntanos algo", "textarea", None), ("q7", "Experiencia", "text", 6), ("q8", "Renta esperada", "number", 3),
            ("q9", "Renta bruta", "textarea", None), ("password", "x", "text", None), ("q11", "Comuna", "select", None), ("q12", "Comuna", "text", 0), ("q13", "Otra", "text", None)]
    got = fill(spark, rows)
    assert got == {0: "1500000", 1: "1.200.000", 2: "paz@example.com", 3: None, 5: None, 6: "6 años", 7: None, 8: None, 11: "Ñuñoa", 12: None}
    generic = fill(spark, rows, fill_generic=True)
    assert generic[5] == "Puedo contarlo." and generic[3] is None and generic[8] is None and generic[12] is None


def test_queue(spark):
    assert spark.range(1).select(A.unique_in_record(F.array(*map(F.lit, ["a", "a", "", "a (2)", "", "a"])))).first()[0] == ["a", "a (2)", "(no label)", "a (2) (2)", " (2)", "a (3)"]
    pre = spark.createDataFrame([("s", 0, "L", "n0", "v0"), ("s", 1, "L", "n1", "v1"), ("s", 2, "", "n2", None)], "slug string, pos int, label string, name string, value string")
    targets = spark.createDataFrame([("s", "T", "C", True), ("u", "T", "C", None), ("w", "T", "C", False)], "slug string, title string, company string, opened boolean")
    queue = A.review_queue(targets, pre)
    rows = {r.slug: r for r in queue.collect()}
    assert rows["s"].answers == {"L": "v0", "L (2)": "v1"} and rows["s"].left_blank == ["n2"] and rows["s"].fields_detected == 3
    assert rows["s"].status.startswith("READY") and rows["u"].status.startswith("FORM_NOT_FOUND") and rows["w"].status.startswith("NOT_OPENED")
    assert rows["u"].answers == {} and tuple(A.queue_summary(queue).first()) == (1, 2, 1, 1)
    labels = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, ""), (2, 1, "a")], "record int, pos int, label string")
    assert sorted((r.record, r.pos, r.unique_label) for r in A.unique_labels(labels).collect()) == [(1, 1, "a"), (1, 2, "a (2)"), (1, 3, "(no label)"), (2, 1, "a")]


CV = """Paz Prueba
paz.prueba@example.com | +56 900000000

Resumen:
Analista comercial con 6 años de experiencia en Empresa Demo 01 SpA.
Foco en pricing y reportería.
Experiencia
Empresa Demo 01 SpA - Analista (2020 - hoy)

Título profesional: Ingeniería Comercial
Comuna: Comuna Demo
Idiomas: Español nativo, Inglés avanzado
"""


def test_cv(evaluate):
    cases = {
        CV: {"experiencia": "Analista comercial con 6 años de experiencia en Empresa Demo 01 SpA. Foco en pricing y reportería.", "titulo": "Ingeniería Comercial",
             "comuna": "Comuna Demo", "idioma": "Español nativo, Inglés avanzado"},
        "Perfil profesional\r\n\r\nIngeniera en control de gestión.\n\nEducación\nUniversidad Demo": {"experiencia": "Ingeniera en control de gestión."},
        "Resumen\nComuna: Comuna Demo\n": {"comuna": "Comuna Demo"},
        "Perfil de LinkedIn: https://example.com/paz": {}, "": {}, "   \n\n": {}, None: {},
        "Idiomas: No": {}, "Idiomas: ninguno": {}, "Idioma: sin inglés": {}, "Languages: not applicable": {}, "Inglés: No": {},
        "Idioma(s): Español nativo; Inglés intermedio": {"idioma": "Español nativo; Inglés intermedio"},
        "Idiomas: Español nativo, Inglés: no": {"idioma": "Español nativo"}, "Idiomas: Español nativo; sin inglés": {"idioma": "Español nativo"},
    }
    assert evaluate(A.cv_profile, list(cases)) == list(cases.values())
    long = evaluate(A.cv_profile, ["Summary: " + "palabra " * 200])[0]["experiencia"]
    assert len(long) <= 600 and long.endswith("palabra")


def test_merge(spark):
    df = spark.sql("select map('titulo', 'A', 'comuna', '') u, map('titulo', 'B', 'comuna', 'C', 'idioma', 'D', 'otro', 'E') c")
    row = df.select(A.merge_profile(F.col("u"), F.col("c")).alias("m")).first().m
    assert row.profile == {"titulo": "A", "comuna": "C", "idioma": "D"} and row.seeded == ["comuna", "idioma"]


def test_unique_labels_step_around_taken_names(spark):
    import random

    random.seed(3)
    pool = ["x", "x (2)", "x (2) (2)", "x (3)", "", "(no label)", " (2)", "y", "y (02)"]
    records = {1: ["x", "x", "x (2)"], 2: ["x (2)", "x", "x"], 3: [random.choice(pool) for _ in range(60)], 4: ["", "(no label)", ""], 5: ["y"] * 5}
    numbers = [f"x ({n})" for n in range(12)] + ["x (4) (2)", "x (99999999999999999999)"]
    records |= {k: [random.choice(["x", "x", "x", *numbers]) for _ in range(random.randrange(1, 50))] for k in range(6, 40)}
    records |= {40: ["(no label)", "", ""], 41: [None, ""], 42: ["x"] * 10 + [f"x ({n})" for n in range(9, 30)] + ["x"] * 30}
    rows = [(record, pos, label) for record, labels in records.items() for pos, label in enumerate(labels)]
    got = {(r.record, r.pos): r.unique_label for r in A.unique_labels(spark.createDataFrame(rows, "record int, pos int, label string")).collect()}
    for record, labels in records.items():
        taken = []
        for label in labels:
            name, n = label or "(no label)", 2
            while name in taken:
                name, n = f"{label or ''} ({n})", n + 1
            taken.append(name)
        assert [got[record, i] for i in range(len(labels))] == taken
