"""Form questions -> the user's own answers, and the profile read from a CV text. Nothing is invented: a
question stays blank unless a rule or an explicit entry names a value the user gave."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.folding import let, normalize, normalize_literal
from vacantia.functions.text import clip_collapsed, clip_form, digits_only
from vacantia.functions.urls import build_url
from vacantia.operators.crawl import running_total
from vacantia.session import written

# ---- fixed values: question rules, headings and texts the results must equal ---------------------
PROFILE_KEYS = ("titulo", "experiencia", "comuna", "idioma", "edad", "licencia", "movilizacion")
NO_LABEL = "(no label)"
DEFAULT_GENERIC = "Puedo ampliar esta información en una entrevista."
WORD = r"(?<![a-z0-9])"
PAY_TOPIC = WORD + (
    r"(?:rentas?|sueldos?|salari(?:o|os|al|ales)|remuneracion(?:es)?|pretension(?:es)?|liquid[oa]s?|brut[oa]s?|"
    r"cuanto quieres ganar|expectativas? economicas?)(?![a-z0-9])")
PAY_EXPECTATION = WORD + r"(?:expectativa|pretension|aspiracion|esperas|esperad[oa]|cuanto quieres ganar|renta esperada)"
PAY_EXPERIENCE = WORD + r"(?:experiencia|manejo|conocimiento|calculo|area de|describ|coment)"
PAY_NOT_EXPECTED = WORD + r"(?:actual|ultim|brut)"
RULES = (
    (("disponibilidad", "cuando podrias", "cuando puede", "fecha de inicio", "incorporacion", "ingreso inmediato"), "availability"),
    (("carta", "presentacion", "motivacion", "por que te interesa", "por que deberiamos", "cuentanos sobre ti", "mensaje"), "cover_letter"),
    (("titulo", "profesion", "carrera", "estudios", "formacion", "grado", "tecnico o profesional", "nivel educacional"), "titulo"),
    (("experiencia", "anos en el", "trayectoria", "desempenado", "te has desempenado", "area"), "experiencia"),
    (("edad", "cuantos anos tienes", "que edad"), "edad"),
    (("licencia",), "licencia"),
    (("ingles", "idioma", "portugues"), "idioma"),
    (("comuna", "residencia", "donde vives", "vivienda", "resides", "sector", "ubicacion", "direccion"), "comuna"),
    (("movilizacion", "vehiculo", "auto propio", "locomocion"), "movilizacion"),
)
CREDENTIAL = (
    r"password|passwd|\bpwd\b|contrasena|\bclave\b|\bpin\b|\botp\b|2fa|codigo de verificacion|codigo de [0-9]|codigo enviado|\btoken|"
    r"security code|one[- ]time|\bcvv\b|\bcvc\b")
CONTACT = r"\brut\b|\bdni\b|pasaporte|correo|e-?mail|telefono|celular|whatsapp"
PLACEHOLDER = r"(?s)^<[^<>]*>$"
FILLABLE = ("text", "number", "textarea")
MAX_LENGTH = {"text": 255, "number": 20, "textarea": 2000}
READY = 'READY_FOR_REVIEW — review and click "Enviar postulación" yourself'
FORM_NOT_FOUND = "FORM_NOT_FOUND — no application form on the page (not logged in, closed offer, or it applies on another site); nothing was typed"
NOT_OPENED = "NOT_OPENED — nothing was filled; open the offer yourself if you want to apply"
MAX_SUMMARY = 600
MAX_LINE = 120
SUMMARY_HEADING = (
    r"(?imud)^[ \t]*(?:resumen(?:[ \t]+profesional)?|perfil(?:[ \t]+profesional)?|extracto|(?:professional[ \t]+)?summary|profile|"
    r"about[ \t]+me|acerca[ \t]+de[ \t]+m[ií])[ \t]*(?::|$)")
LINES = {
    "titulo": r"(?imud)^[ \t]*(?:t[ií]tulo(?:[ \t]+profesional)?|profesi[oó]n)[ \t]*[:\-][ \t]*(\S.*)$",
    "comuna": r"(?imud)^[ \t]*(?:comuna|residencia|direcci[oó]n|ciudad)[ \t]*[:\-][ \t]*(\S.*)$",
    "idioma": r"(?imud)^[ \t]*(?:idioma(?:s|\(s\))?|languages?)[ \t]*[:\-][ \t]*(\S.*)$",
}
NEGATION = r"\b(?:no|ningun[oa]?s?|sin|not|none|nada)\b"
LABEL_VALUE = r"^\p{L}[^:\n]{0,30}:[ \t]*\S"
SECTION_HEADINGS = (
    "experiencia", "experiencia laboral", "experiencia profesional", "educación", "formación", "formación académica", "estudios", "habilidades",
    "competencias", "conocimientos", "idiomas", "certificaciones", "cursos", "referencias", "contacto", "datos personales", "logros", "experience",
    "work experience", "education", "skills", "languages", "certifications", "references", "contact",
)


# ---- the answers file ---------------------------------------------------------------------------
def _section(doc: Column, body: Column, name: str, fold_keys: bool) -> Column:
    """Usable entries of one section in file order: a key keeps its first place and its last value."""
    texts = F.map_entries(F.from_json(F.get_json_object(body, f"$.{name}"), "map<string,string>"))
    kinds = F.try_variant_get(doc, f"$.{name}", "map<string,variant>")
    trimmed = F.transform(texts, lambda e: F.struct(
        F.btrim(e["key"]).alias("key"), F.btrim(e["value"]).alias("value"),
        F.schema_of_variant(F.try_element_at(kinds, e["key"])).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE)").alias("scalar")))
    usable = F.filter(trimmed, lambda e: F.coalesce(e["scalar"], F.lit(False)) & (e["key"] != "") & ~e["key"].startswith("_")
                      & ~e["key"].rlike(PLACEHOLDER) & (e["value"] != "") & ~e["value"].rlike(PLACEHOLDER))
    keyed = F.filter(F.transform(usable, lambda e: F.struct((normalize(e["key"]) if fold_keys else e["key"]).alias("key"), e["value"].alias("value"))), lambda e: e["key"] != "")

    def last_values(entries: Column) -> Column:
        names = F.transform(entries, lambda e: e["key"])
        firsts = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
        return F.transform(firsts, lambda e: F.struct(
            e["key"].alias("key"), F.element_at(F.filter(entries, lambda o: o["key"] == e["key"]), -1)["value"].alias("value")))

    return let(F.coalesce(keyed, F.array().cast("array<struct<key:string,value:string>>")), last_values)


def load_answers(df: DataFrame, *, body: str = "body") -> DataFrame:
    """Answer files (one JSON text per row) -> `profile` and `fixed` maps, `per_question` entries in file
    order, `error` when the file or a section has the wrong shape."""
    doc = F.try_parse_json(F.col(body))
    kind = lambda name: F.schema_of_variant(F.variant_get(doc, f"$.{name}", "variant"))
    wrong = [F.when(~kind(n).rlike("^(OBJECT|VOID)"), f"'{n}' must be an object of text answers") for n in ("profile", "per_question", "fixed")]
    error = F.when(doc.isNull(), "not valid JSON").when(~F.schema_of_variant(doc).startswith("OBJECT"), "the answers file must be a JSON object")
    return df.select(
        *[c for c in df.columns if c != body], F.map_from_entries(_section(doc, F.col(body), "profile", False)).alias("profile"),
        _section(doc, F.col(body), "per_question", True).alias("per_question"), F.map_from_entries(_section(doc, F.col(body), "fixed", False)).alias("fixed"),
        F.coalesce(error, *wrong).alias("error"))


# ---- questions ----------------------------------------------------------------------------------
def is_credential(label: Column) -> Column:
    return F.coalesce(normalize(label).rlike(CREDENTIAL), F.lit(False))


def _rule_target(n: Column) -> Column:
    """Pay logic, then the first rule with a keyword that starts a word."""
    about_pay, experience = n.rlike(PAY_TOPIC), n.rlike(PAY_EXPERIENCE)
    chain = F.when(about_pay & ~experience & (n.rlike(PAY_NOT_EXPECTED) | ~n.rlike(PAY_EXPECTATION)), "salary_other").when(about_pay & ~experience, "salary")
    for keywords, target in RULES:
        chain = chain.when(n.rlike(f"{WORD}(?:{'|'.join(keywords)})"), target)
    return chain.when(about_pay, "salary_other")


def classify_question(label: Column) -> Column:
    """``credential``, ``contact``, ``salary``, ``salary_other``, ``availability``, ``cover_letter``, a profile
    key, or NULL when no rule knows the question."""

    def target(n: Column) -> Column:
        return F.when(n.rlike(CREDENTIAL), "credential").when(n.rlike(CONTACT), "contact").otherwise(_rule_target(n))

    return let(normalize(label), target)


def answer_for(label: Column, kind: Column, answers: Column, *, fill_generic: bool = False) -> Column:
    """The answer to a question, '' to leave it blank. `answers` is ``struct(profile, per_question, fixed)``.

    Order: credentials never; the first per-question key in the label; contact fields never; expected pay
    in digits only; other pay never; the value a rule names; the generic sentence on opt-in, and only in
    text areas.
    """

    def answered(n: Column) -> Column:
        explicit = F.try_element_at(F.filter(answers["per_question"], lambda e: F.contains(n, e["key"])), F.lit(1))["value"]

        def by_rule(target: Column) -> Column:
            value = F.when(target.isin("availability", "cover_letter"), F.try_element_at(answers["fixed"], target)).otherwise(
                F.try_element_at(answers["profile"], target))
            generic = F.when(kind == "textarea", F.coalesce(F.nullif(F.try_element_at(answers["fixed"], F.lit("generic")), F.lit("")), F.lit(DEFAULT_GENERIC)))
            filled = F.coalesce(F.nullif(value, F.lit("")), generic if fill_generic else F.lit(None).cast("string"), F.lit(""))
            return F.when(target == "salary", digits_only(F.try_element_at(answers["fixed"], F.lit("salary")))).when(
                target == "salary_other", "").otherwise(filled)

        return F.when(F.coalesce(n, F.lit("")) == "", "").when(n.rlike(CREDENTIAL), "").when(explicit.isNotNull(), explicit).when(
            n.rlike(CONTACT), "").otherwise(let(_rule_target(n), by_rule))

    return let(normalize(label), answered)


def prefill(fields: DataFrame, answers: DataFrame, *, owner: str = "owner", fill_generic: bool = False) -> DataFrame:
    """Form fields of each owner with `value` (NULL: left blank).

    Fields that cannot be typed into and credential fields are dropped. A number needs digits within the
    limit; text is clipped to the field's limit or 255 / 20 / 2000 characters.
    """
    who = answers.select(owner, F.struct("profile", "per_question", "fixed").alias("_answers"))
    usable = fields.where(F.col("kind").isin(*FILLABLE) & ~is_credential(F.col("name")) & ~is_credential(F.col("label")))
    raw = F.btrim(F.coalesce(answer_for(F.col("label"), F.col("kind"), F.col("_answers"), fill_generic=fill_generic), F.lit("")))
    default = reduce(lambda c, k: c.when(F.col("kind") == k, MAX_LENGTH[k]), list(MAX_LENGTH)[1:], F.when(F.col("kind") == "text", MAX_LENGTH["text"]))
    limit = F.coalesce(F.nullif(F.col("max_length"), F.lit(0)), default)
    number = F.when(F.col("_raw").rlike("^[0-9]+$") & (F.length("_raw") <= limit), F.col("_raw")).otherwise("")
    value = F.when(F.col("kind") == "number", number).otherwise(clip_form(F.col("_raw"), limit))
    return (
        usable.join(who, owner, "left").withColumn("_raw", raw).withColumn("value", F.nullif(value, F.lit(""))).drop("_raw", "_answers")
    )


def unique_in_record(labels: Column) -> Column:
    """Labels of one record with repeats as ``label (2)``, ``label (3)`` …, whatever else is taken."""

    def add(taken: Column, label: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.when(n > 1, F.concat(label, F.lit(" ("), n.cast("string"), F.lit(")"))).when(
            label == "", NO_LABEL).otherwise(label))
        return F.concat(taken, F.slice(F.array_except(tries, taken), 1, 1))

    return F.aggregate(labels, F.array().cast("array<string>"), add)


#: A name that a repeat of another label may take: that label, and its number.
_NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]+)\)$"
_KEY = ["_record", "_label"]


def _passed_over(own: Column, children: Column) -> Column:
    """Of a label's literal names `children` (``number, rank``, by number): ``(number, child, passed)``.

    The repeats of a label take its numbers in turn. When they come to a number, the repeat whose turn it is passes it over if the
    literal has come before it, that is if fewer repeats came before the literal (`rank`) than have had their turn.
    """
    turn = lambda state, c: c["number"] - 1 - state["passed"] > F.greatest(c["rank"] - own, F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("passed"), F.lit("").alias("marks"))

    def step(state: Column, c: Column) -> Column:
        return F.when(turn(state, c), F.struct((state["passed"] + 1).alias("passed"), F.concat(state["marks"], F.lit("1")).alias("marks"))).otherwise(
            F.struct(state["passed"].alias("passed"), F.concat(state["marks"], F.lit("0")).alias("marks")))

    return let(F.split(F.aggregate(children, start, step)["marks"], ""), lambda marks: F.transform(
        children, lambda c, i: F.struct(c["number"].alias("number"), c["child"].alias("child"), (F.get(marks, i) == "1").alias("passed"))))


def unique_labels(df: DataFrame, *, record: str = "record", label: str = "label", pos: str = "pos") -> DataFrame:
    """Row form of :func:`unique_in_record` for records of any size, in `pos` order (integers, unique in a record).

    The k-th repeat of a label takes the k-th of the numbers 2, 3 … that no literal label such as ``x (2)`` has taken
    before it. Rows are ranked within their label by a blocked running count, which also ranks the first row of each literal among
    the repeats it competes with; what is passed over is decided on the different labels only, outer labels first, and counted by a second running
    count. A record or label with any share of the rows is split; what must fit one row is a label's list of different literal names.
    A null label counts as empty.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    text = F.coalesce(F.col(names[df.columns.index(label)]), F.lit(""))
    rows = plain.select("*", F.coalesce(F.col(names[df.columns.index(record)]).cast("string"), F.lit("\0")).alias("_record"), text.alias("_label"), F.col(names[df.columns.index(pos)]).alias("_pos"))
    base = F.when(F.col("_label") == "", NO_LABEL).otherwise(F.col("_label"))
    labels = written(rows.groupBy(*_KEY).agg(F.min("_pos").alias("_first")), "labels")
    number = F.regexp_extract("_label", _NUMBERED, 2).try_cast("bigint")
    literals = labels.select("_record", F.regexp_extract("_label", _NUMBERED, 1).alias("_parent"), F.col("_label").alias("_child"), number.alias("_number"), F.col("_first").alias("_pos")).where("_number is not null")
    links = literals.join(labels.select("_record", F.col("_label").alias("_parent")), ["_record", "_parent"]).withColumnRenamed("_parent", "_label")
    events = rows.withColumns({"_one": F.lit(1), "_number": F.lit(None).cast("bigint"), "_child": F.lit(None).cast("string")}).unionByName(
        links.withColumn("_one", F.lit(0)), allowMissingColumns=True)
    ranked = written(running_total(events, "_pos", "_one", "_rank", by=_KEY), "ranked")
    children = written(
        ranked.where("_one = 0").groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct(F.col("_number").alias("number"), F.col("_rank").alias("rank"), F.col("_child").alias("child")))).alias("_children")),
        "children")
    # the empty label and its stand-in share one name
    first_of_name = F.min("_first").over(Window.partitionBy("_record", base))
    outer = labels.withColumn("_own", (F.col("_first") == first_of_name).cast("int")).join(children.select("_record", F.inline("_children")).select("_record", F.col("child").alias("_label")), _KEY, "left_anti")
    level = written(outer.select(*_KEY, "_own"), "level")
    owners, gaps = level, None
    while True:
        scanned = written(level.join(children, _KEY).select(*_KEY, _passed_over(F.col("_own"), F.col("_children")).alias("_scanned")), "scanned")
        if not scanned.take(1):
            break
        level = scanned.select("_record", F.inline("_scanned")).select("_record", F.col("child").alias("_label"), F.col("passed").cast("int").alias("_own"))
        # the i-th number passed over (from 0) comes before every repeat from the (number - i - 1)-th on
        passed = F.transform(F.filter("_scanned", lambda c: c["passed"]), lambda c, i: c["number"] - i - 1)
        found = scanned.select(*_KEY, F.explode(passed).alias("_from")).groupBy(*_KEY, "_from").agg(F.count("*").alias("_gap"))
        owners, gaps = owners.union(level), found if gaps is None else gaps.union(found)
    # a label's first row keeps its name, unless a repeat of another label has it
    turns = ranked.where("_one = 1").join(owners, _KEY).withColumn("_turn", F.col("_rank") - F.col("_own")).select(*names, *_KEY, "_turn")
    if gaps is not None:
        gaps = written(gaps, "gaps")
        split = turns.join(gaps.select(*_KEY).distinct().withColumn("_gapped", F.lit(True)), _KEY, "left")
        both = split.where("_gapped").select(*names, *_KEY, "_turn", (2 * F.col("_turn") + 1).alias("_at"), F.lit(0).cast("bigint").alias("_gap")).unionByName(
            gaps.select(*_KEY, (2 * F.col("_from")).alias("_at"), "_gap"), allowMissingColumns=True)
        counted = running_total(both, "_at", "_gap", "_over", by=_KEY).where("_turn is not null")
        turns = split.where("_gapped is null").select(*names, *_KEY, "_turn", F.lit(0).cast("bigint").alias("_over")).unionByName(counted.select(*names, *_KEY, "_turn", "_over"))
    else:
        turns = turns.withColumn("_over", F.lit(0))
    numbered = F.concat("_label", F.lit(" ("), (F.col("_turn") + 1 + F.col("_over")).cast("string"), F.lit(")"))
    return turns.select(*names, F.when(F.col("_turn") == 0, base).otherwise(numbered)).toDF(*df.columns, "unique_label")


def review_queue(targets: DataFrame, prefilled: DataFrame, *, slug: str = "slug", pos: str = "pos") -> DataFrame:
    """One review record per target (one application form each): answers map, labels left blank, fields
    detected, status. `targets` has ``opened`` (false: could not be opened, NULL: no form on the page)."""
    # One form holds at most a few dozen fields, so the lists below are bounded by the form.
    forms = prefilled.groupBy(slug).agg(F.array_sort(F.collect_list(F.struct(pos, "label", "name", "value"))).alias("_fields"))
    filled = F.filter("_fields", lambda f: f["value"].isNotNull())
    blank = F.filter("_fields", lambda f: f["value"].isNull())
    names = unique_in_record(F.transform(filled, lambda f: f["label"]))
    usable = F.col("opened") & F.col("_fields").isNotNull()
    none = F.array().cast("array<string>")
    return targets.join(forms, slug, "left").select(
        slug, "title", "company", build_url(F.col(slug), "apply").alias("url"),
        F.when(usable, F.map_from_arrays(names, F.transform(filled, lambda f: f["value"]))).otherwise(F.create_map().cast("map<string,string>")).alias("answers"),
        F.when(usable, F.transform(blank, lambda f: F.coalesce(F.nullif(f["label"], F.lit("")), f["name"]))).otherwise(none).alias("left_blank"),
        F.when(usable, F.size("_fields")).otherwise(0).alias("fields_detected"),
        F.when(F.col("opened"), READY).when(F.col("opened").isNull(), FORM_NOT_FOUND).otherwise(NOT_OPENED).alias("status"))


def queue_summary(records: DataFrame) -> DataFrame:
    """One row: opened, answers typed, no form, failed."""
    status = F.col("status")
    return records.agg(
        F.count_if(status.startswith("READY")).alias("opened"), F.coalesce(F.sum(F.size(F.map_keys("answers"))), F.lit(0)).alias("answers_typed"),
        F.count_if(status.startswith("FORM_NOT_FOUND")).alias("no_form"), F.count_if(status.startswith("NOT_OPENED")).alias("failed"))


# ---- the CV -------------------------------------------------------------------------------------
def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _summary(text: Column) -> Column:
    """The lines under a summary heading up to a blank line or the next heading, clipped; '' without."""
    after = F.regexp_extract(text, SUMMARY_HEADING + r"([\s\S]*)", 1)
    headings = sorted({normalize_literal(h) for h in SECTION_HEADINGS})

    most_letters = max(sum(c.isalpha() for c in h) for h in headings)

    def is_heading(line: Column) -> Column:
        # Folding keeps every ASCII letter, so a line with more of them than any heading need not be folded.
        short = F.length(F.regexp_replace(line, "[^A-Za-z]+", "")) <= most_letters
        bare = F.btrim(F.regexp_replace(normalize(line), ":+$", ""))
        return line.rlike(LABEL_VALUE) | F.when(short, bare.isin(*headings)).otherwise(False)

    def collected(lines: Column) -> Column:
        size = F.size(lines)
        filled = F.array_position(F.transform(lines, lambda s: s != ""), F.lit(True)).cast("int")

        def up_to_blank(first: Column) -> Column:
            """The lines before the first blank one that follows text."""
            later = F.slice(lines, F.greatest(first, F.lit(1)), size)
            blank = F.array_position(later, F.lit("")).cast("int")
            return F.when((first > 0) & (blank > 0), F.slice(lines, F.lit(1), first + blank - 2)).otherwise(lines)

        def up_to_heading(block: Column) -> Column:
            stops = F.transform(block, lambda s, i: (s != "") & (i > 0) & is_heading(s))
            return let(F.array_position(stops, F.lit(True)).cast("int"), lambda stop: F.when(stop > 0, F.slice(block, F.lit(1), stop - 1)).otherwise(block))

        kept = let(let(filled, up_to_blank), up_to_heading)
        return clip_collapsed(F.array_join(F.filter(kept, lambda s: s != ""), " "), MAX_SUMMARY)

    return F.when(text.rlike(SUMMARY_HEADING), let(F.transform(F.split(after, "\n"), _strip), collected)).otherwise("")


def _languages(value: Column) -> Column:
    """The languages line without negated items; wording kept when nothing is negated."""
    items = F.filter(F.transform(F.split(value, r"[,;/|•]"), _strip), lambda s: s != "")

    def kept(all_items: Column) -> Column:
        fine = F.filter(all_items, lambda s: ~normalize(s).rlike(NEGATION))
        return F.when(F.size(fine) == F.size(all_items), clip_collapsed(value, MAX_LINE)).otherwise(clip_collapsed(F.array_join(fine, ", "), MAX_LINE))

    return let(items, kept)


def cv_profile(text: Column) -> Column:
    """Profile keys found in a CV text as a map: only what is written there."""

    def found(t: Column) -> Column:
        line = {k: _strip(F.regexp_extract(t, p, 1)) for k, p in LINES.items()}
        entries = F.array(
            F.struct(F.lit("experiencia").alias("key"), _summary(t).alias("value")), F.struct(F.lit("titulo").alias("key"), clip_collapsed(line["titulo"], MAX_LINE).alias("value")),
            F.struct(F.lit("comuna").alias("key"), clip_collapsed(line["comuna"], MAX_LINE).alias("value")), F.struct(F.lit("idioma").alias("key"), let(line["idioma"], _languages).alias("value")))
        return F.map_from_entries(F.filter(entries, lambda e: e["value"] != ""))

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), found)


def merge_profile(user: Column, cv: Column) -> Column:
    """``struct(profile, seeded)``: the CV fills only keys the user left empty; `seeded` lists them."""
    taken = F.map_filter(cv, lambda k, v: k.isin(*PROFILE_KEYS) & (v != "") & (F.coalesce(F.try_element_at(user, k), F.lit("")) == ""))
    merged = F.map_zip_with(user, taken, lambda k, u, c: F.coalesce(c, u))
    return F.struct(merged.alias("profile"), F.array_sort(F.map_keys(taken)).alias("seeded"))
