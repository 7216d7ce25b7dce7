"""JSON-LD blocks of captured pages as variants: no Python, no fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let
from vacantia.functions.text import parse_date_any, html_to_text, to_int

# ---- fixed values -------------------------------------------------------------------------------
LD_BLOCK = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
NESTING = 3


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def is_number(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _flat(v: Column, depth: int) -> Column:
    """The objects in `v`, depth first: list items in place, the items of ``@graph`` after their holder."""
    none = F.array().cast("array<variant>")

    def of_object(x: Column) -> Column:
        if not depth:
            return F.array(x)
        graph = F.try_variant_get(x, '$["@graph"]', "array<variant>")
        return let(graph, lambda g: F.when(g.isNull(), F.array(x)).otherwise(F.concat(F.array(x), F.flatten(F.transform(g, lambda i: _flat(i, depth - 1))))))

    def of_list(x: Column) -> Column:
        return F.flatten(F.transform(_get(x, "$", "array<variant>"), lambda i: _flat(i, depth - 1))) if depth else none

    def typed(s: Column) -> Column:
        return F.when(s["kind"].startswith("OBJECT"), of_object(s["v"])).when(s["kind"].startswith("ARRAY"), of_list(s["v"])).otherwise(none)

    return let(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), typed)


def _walked(v: Column, most: Column) -> Column:
    """The same objects of a value nested to any depth: a list of values still to be looked at, the first of which is
    replaced by what it holds. Each step is paid for by a character of the block, of which there are `most`."""
    none = F.array().cast("array<variant>")
    start = F.struct(F.array(v).alias("todo"), none.alias("done"))

    def step(acc: Column, _: Column) -> Column:
        def open_up(head: Column) -> Column:
            rest = F.slice(acc["todo"], F.lit(2), F.greatest(F.lit(0), F.size(acc["todo"]) - 1))
            graph = F.coalesce(F.try_variant_get(head, '$["@graph"]', "array<variant>"), none)
            items = F.when(is_object(head), graph).when(is_list(head), _get(head, "$", "array<variant>")).otherwise(none)
            return F.struct(F.concat(items, rest).alias("todo"), F.when(is_object(head), F.array_append(acc["done"], head)).otherwise(acc["done"]).alias("done"))

        return F.when(F.size(acc["todo"]) == 0, acc).otherwise(let(acc["todo"][0], open_up))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["done"]


def parse_block(body: Column) -> Column:
    """One block as a variant, NULL when malformed. Raw control characters, which may sit inside strings,
    become spaces only when the block does not parse without that; anything after the value is an error."""

    def whole(text: Column) -> Column:
        return let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), lambda wrapped: F.when(
            _get(wrapped, "$[1]", "variant").isNull(), _get(wrapped, "$[0]", "variant")))

    return F.coalesce(whole(body), whole(F.regexp_replace(body, r"[\x00-\x1f]", " ")))


def jsonld_objects(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """Every JSON-LD object: the columns of `pages` but `html`, ``pos`` in page order, ``ld`` (variant)."""
    others = [c for c in pages.columns if c != html]
    return pages.where(F.contains(F.col(html), F.lit("ld+json"))).select(*others, F.posexplode(page_objects(F.col(html))).alias("pos", "ld"))


def page_objects(html: Column) -> Column:
    """All JSON-LD objects of one page as an array, for jobs that stay one row per page."""
    return block_objects(page_blocks(html))


def page_blocks(html: Column) -> Column:
    """The texts of a page's JSON-LD blocks: all of the page that a job on its objects has to carry along."""
    return F.regexp_extract_all(html, F.lit(LD_BLOCK), F.lit(1))


def block_objects(blocks: Column) -> Column:
    """The objects of :func:`page_blocks`."""

    def objects(block: Column) -> Column:
        # without a list in a list, and with one @graph at most, nothing is nested deeper than NESTING
        graphs = F.size(F.split(block, '"@graph"')) > 2
        deep = graphs | block.rlike(r"[\[,]\s*\[") | block.rlike(r"\\u0040graph|@\\u")
        return let(parse_block(F.btrim(block)), lambda v: F.when(v.isNull(), F.array().cast("array<variant>")).when(deep, _walked(v, F.length(block))).otherwise(_flat(v, NESTING)))

    return F.flatten(F.transform(blocks, objects))


def all_of_type(objects: Column, kind: str) -> Column:
    """The objects whose ``@type`` is `kind`, or a list holding it."""

    def matches(o: Column) -> Column:
        scalar = _get(o, '$["@type"]', "string") == kind
        listed = F.array_contains(_get(o, '$["@type"]', "array<string>"), kind)
        return F.coalesce(listed, scalar, F.lit(False))

    return F.filter(objects, matches)


def of_type(objects: Column, kind: str) -> Column:
    """The first object of a type."""
    return F.try_element_at(all_of_type(objects, kind), F.lit(1))


def text_at(v: Column, path: str) -> Column:
    """A string value at `path`; other types are NULL."""
    found = _get(v, path, "variant")
    return F.when(is_text(found), _get(v, path, "string"))


def lenient_int(v: Column) -> Column:
    """A number or a text holding one, else NULL (booleans, objects, lists)."""
    number = F.bround(_get(v, "$", "decimal(38,6)")).cast("bigint")
    return F.when(is_number(v), number).when(is_text(v), to_int(_get(v, "$", "string")))


def lenient_salary(base: Column) -> Column:
    """``baseSalary`` in any shape -> struct(min, max), positive only, swapped when reversed."""

    def amounts(bs: Column) -> Column:
        inner = F.variant_get(bs, "$.value", "variant")
        inner = F.when(F.is_variant_null(inner), None).otherwise(inner)
        value = F.when(is_object(bs), F.coalesce(inner, F.when(
            F.variant_get(bs, "$.minValue", "variant").isNotNull() | F.variant_get(bs, "$.maxValue", "variant").isNotNull(), bs))).otherwise(bs)
        low = F.coalesce(_not_null(F.variant_get(value, "$.minValue", "variant")), F.variant_get(value, "$.value", "variant"))
        nested = is_object(value)
        return F.struct(
            F.when(nested, lenient_int(low)).otherwise(lenient_int(value)).alias("a"),
            F.when(nested, lenient_int(F.variant_get(value, "$.maxValue", "variant"))).alias("b"),
        )

    def ordered(m: Column) -> Column:
        low, high = F.when(m["a"] > 0, m["a"]), F.when(m["b"] > 0, m["b"])
        swap = high < low
        return F.struct(F.when(swap, high).otherwise(low).alias("min"), F.when(swap, low).otherwise(high).alias("max"))

    def first_filled(b: Column) -> Column:
        filled = F.filter(_get(b, "$", "array<variant>"), lambda x: ~F.is_variant_null(x) & ~F.to_json(x).isin('""', "{}", "[]"))
        return F.when(is_list(b), F.try_element_at(filled, F.lit(1))).otherwise(b)

    return let(let(let(base, first_filled), amounts), ordered)


def _not_null(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), v)


def identifier(v: Column) -> Column:
    """``identifier`` as object, list or scalar -> its text; booleans and objects are NULL."""
    falsy = ("null", "false", '""', "0", "{}", "[]")

    def first_filled(v: Column) -> Column:
        filled = F.filter(_get(v, "$", "array<variant>"), lambda x: ~F.to_json(x).isin(*falsy))
        return F.when(is_list(v), F.try_element_at(filled, F.lit(1))).otherwise(v)

    value = let(let(v, first_filled), lambda x: F.when(is_object(x), F.variant_get(x, "$.value", "variant")).otherwise(x))
    return let(value, lambda x: F.nullif(F.btrim(F.when(is_text(x) | (F.schema_of_variant(x) == "BIGINT"), _get(x, "$", "string"))), F.lit("")))


def extract_detail(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """The fields a detail page adds, from its first JobPosting: one row per page with one, NULL where the
    page gives nothing. The employer's own identifiers are never read."""
    others = [c for c in pages.columns if c != html]
    # Exploding the first posting drops pages without one and computes it once.
    first = F.slice(all_of_type(page_objects(F.col(html)), "JobPosting"), 1, 1)
    found = pages.where(F.contains(F.col(html), F.lit("ld+json"))).select(*others, F.explode(first).alias("_job"))
    j = F.col("_job")
    salary = lenient_salary(F.variant_get(j, "$.baseSalary", "variant"))
    return found.withColumn("_salary", salary).select(
        *others, F.nullif(html_to_text(text_at(j, "$.description")), F.lit("")).alias("description"),
        F.col("_salary.min").alias("salary_min"), F.col("_salary.max").alias("salary_max"),
        parse_date_any(text_at(j, "$.datePosted")).alias("published_at"),
        parse_date_any(text_at(j, "$.validThrough")).alias("valid_through"),
        identifier(F.variant_get(j, "$.identifier", "variant")).alias("external_id"),
    )
