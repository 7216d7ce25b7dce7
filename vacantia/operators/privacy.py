"""Personal data: value masking, identity masking, fail-closed leak audit, page scrubbing.

Masking searches the folded text, whose places are those of the original one wherever each character folds to
one; other text is masked by a pattern in which every letter stands for all characters that fold to it. Nothing leaves the JVM. The audit then looks at the *folded* text, independently of the masking, and
withholds whatever still matches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import HANGUL, _folded, fold, fold_tables, is_ascii, let, literal_map
from vacantia.functions.urls import unquote
from vacantia.operators.crawl import running_total
from vacantia.operators.html import VOID, Sel, element_table, first_of, first_text, parse

# ---- fixed values: masks, patterns and names the results must equal ------------------------------
MASK = "SCRUBBED"
REDACTED = "***"
AVATAR_PREFIX = "Avatar de"
MARKUP = "markup outside text and attribute values"
PARTICLES = ("del", "las", "los", "das", "dos", "van", "von", "der", "den")
SEPARATORS = ("-", "_", ".", "")
PATTERNS = (
    ("//", r"""(?i)(?:https?:)?//[^\s"'<>]*?(?:googleusercontent|licdn)\.com[^\s"'<>]*""", MASK),
    ("/rails/active_storage/", r"""(/rails/active_storage/)[^\s"'<>]*""", "$1" + MASK),
    ("/", r"""(?i)(linkedin\.com/in/)[^\s"'<>/?#]+""", "$1" + MASK),
    ("=", r"""(?i)([?&;](?:X-Amz-[A-Za-z-]+|sig|signature|token|authenticity_token)=)[^&#\s"'<>]*""", "$1" + MASK),
    ("--", r"[A-Za-z0-9+/_=-]{16,}--[A-Za-z0-9+/_=-]{16,}", MASK),
    ("@", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", MASK),
    ("-", r"\b\d{1,2}\.?\d{3}\.?\d{3}-[\dkK]\b", MASK),
    ("9", r"(?<!\d)(?:\+?56\s?)?9\s?\d{4}\s?\d{4}(?!\d)", MASK),
)
SECRET_ATTRS = (
    "nonce", "signed-stream-name", "data-google-one-tap-csrf-token-value", "data-amplitude-user-id-value",
    "data-amplitude-device-id-value",
)
SECRET_META = ("csrf-token", "csp-nonce")
PERSONAL_ATTR = "user|e-?mail|phone|rut|avatar"
STRUCTURAL_ATTRS = ("class", "d")
FILE_CORE = r"(?i)^[^\s/\\.](?:[^/\\\n]{0,250}[^\s/\\])?\.(pdf|docx?|odt|rtf)$"
COOKIES = ("_portal_de_empleos_session", "remember_user_token")
MIN_SECRET = 8
MIN_IDENTITY = 3
EDGE = r"[\p{L}\p{N}]"


# ---- value masking ------------------------------------------------------------------------------
def _rules_once(value: Column) -> Column:
    """The ordered rules; each is tried only on rows that hold the literal its matches cannot do without."""
    masked = value
    for needle, pattern, replacement in PATTERNS:
        masked = let(masked, _guarded(needle, pattern, replacement))
    return masked


def _guarded(needle: str, pattern: str, replacement: str) -> Callable[[Column], Column]:
    return lambda v: F.when(F.contains(v, F.lit(needle)), F.regexp_replace(v, pattern, replacement)).otherwise(v)


def clean_value(value: Column, mask_more: Callable[[Column], Column] | None = None) -> Column:
    """The value rules, then `mask_more`; a percent-encoded value is also checked decoded."""
    once = (lambda v: mask_more(_rules_once(v))) if mask_more else _rules_once

    def decoded(cleaned: Column) -> Column:
        def choose(plain: Column) -> Column:
            return let(once(plain), lambda again: F.when(again != plain, again).otherwise(cleaned))

        return F.when(F.contains(cleaned, F.lit("%")), let(unquote(cleaned), lambda plain: F.when(
            plain != cleaned, choose(plain)).otherwise(cleaned))).otherwise(cleaned)

    return let(once(value), decoded)


def mask_patterns(value: Column) -> Column:
    """Avatar URLs, blob paths, profile handles, signed parameters and blobs, e-mails, RUTs, phones."""
    return clean_value(value)


def redact_secrets(text: Column, secrets: Column, *, cookies: Sequence[str] = COOKIES) -> Column:
    """Cookie pairs and every known secret of the row (8 characters or more, longest first) as ``***``."""
    pairs = F.regexp_replace(text, f"({'|'.join(cookies)})=[^;\\s'\"]+", f"$1={REDACTED}")
    usable = F.filter(F.array_distinct(secrets), lambda s: F.length(s) >= MIN_SECRET)
    longest = F.transform(F.array_sort(F.transform(usable, lambda s: F.struct((-F.length(s)).alias("n"), s.alias("s")))), lambda o: o["s"])
    return F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), pairs, lambda acc, s: F.replace(acc, s, F.lit(REDACTED)))


# ---- identities ---------------------------------------------------------------------------------
def identity_variants(name: Column, email: Column) -> Column:
    """Every folded string a person may appear as, longest first: the name, its ``- _ .`` and joined
    slugs, its words (particles and one- or two-letter words left out), the e-mail and its local part."""

    def of_name(n: Column) -> Column:
        words = F.regexp_extract_all(n, F.lit(EDGE + "+"), F.lit(0))
        slugs = F.array(*[F.array_join(words, sep) for sep in SEPARATORS])
        return F.concat(F.array(n), slugs, F.filter(words, lambda w: ~w.isin(*PARTICLES)))

    none = F.array().cast("array<string>")
    from_name = F.when(F.coalesce(name, F.lit("")) != "", let(fold(name), of_name)).otherwise(none)
    from_email = F.when(F.coalesce(email, F.lit("")) != "", let(fold(email), lambda e: F.array(e, F.substring_index(e, "@", 1)))).otherwise(none)
    return sort_variants(F.concat(from_name, from_email))


def sort_variants(variants: Column) -> Column:
    kept = F.filter(F.array_distinct(variants), lambda v: F.length(v) >= MIN_IDENTITY)
    return F.transform(F.array_sort(F.transform(kept, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda o: o["v"])


def _is_common(char: str) -> bool:
    """Latin letters with marks and full-width forms; what else folds to ASCII is rare (circled, mathematical)."""
    return char < "\u0250" or "\u1e00" <= char <= "\u1eff" or "\uff00" <= char <= "\uffef"


def _runs(chars: list[str]) -> str:
    """Characters as the inside of a class, runs as ranges."""
    out: list[list[int]] = []
    for point in sorted(map(ord, chars)):
        if out and point == out[-1][1] + 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


@lru_cache(maxsize=None)
def _letter_classes(rare: bool) -> tuple[dict[str, str], dict[str, str]]:
    """Folded letter, digit or letter pair -> a pattern for everything that folds to it; and letter or digit
    -> the inside of a character class of everything a spelling of it may start with. With `rare`, also for
    characters that hardly ever occur (a much larger pattern)."""
    source, target, expansions, _ = fold_tables(True)
    same: dict[str, list[str]] = {}
    for char, plain in zip(source, target):
        if plain.isascii() and plain.isalnum() and (rare or _is_common(char)):
            same.setdefault(plain, []).append(char)

    def letter(plain: str) -> str:
        """Latin-1 spellings as a flat set; the rest is only looked at for characters beyond Latin-1."""
        near, far = [c for c in same.get(plain, []) if c <= "\xff"], [c for c in same.get(plain, []) if c > "\xff"]
        return plain + _runs(near) + (f"[[^\\x00-\\xff]&&[{_runs(far)}]]" if far else "")

    sets = {c: letter(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789"}
    single = {c: f"[{inside}]\\p{{M}}*+" for c, inside in sets.items()}
    pairs: dict[str, list[str]] = {}
    for char, plain in expansions.items():
        if plain in ("ss", "ff", "fi", "fl", "st", "ij", "dz", "lj", "nj"):
            pairs.setdefault(plain, []).append(char)
    wide = single | {p: f"(?:{single[p[0]]}{single[p[1]]}|[{_runs(chars)}]\\p{{M}}*+)" for p, chars in pairs.items()}
    first = {c: inside + _runs([x for p, chars in pairs.items() if p[0] == c for x in chars]) for c, inside in sets.items()}
    return wide, first


@lru_cache(maxsize=None)
def _rare_chars() -> str:
    source, target, _, _ = fold_tables(True)
    return f"[[^\\x00-\\xff]&&[{_runs([c for c, t in zip(source, target) if t.isascii() and t.isalnum() and not _is_common(c)])}]]"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")


def _bounded_pattern(alternatives: Column, starts: Column, marks: bool) -> Column:
    """The alternatives on letter/digit boundaries; NULL when there are none. `starts` are the insides of
    character classes for their first characters: most positions of a text fail on that one class."""
    before = rf"(?<!{EDGE}\p{{M}}{{0,4}})" if marks else f"(?<!{EDGE})"
    return F.when(F.size(alternatives) > 0, F.concat(
        F.lit("(?=["), F.array_join(F.array_distinct(starts), ""), F.lit(f"]){before}(?:"), F.array_join(alternatives, "|"), F.lit(f")(?!{EDGE})")))


def identity_patterns(variants: Column) -> Column:
    """``struct(variants, folded, ascii)``: patterns for folded text and for ASCII text. The pattern of all spellings is some
    forty times as long and is made where a text needs it."""
    spaced = lambda v: F.array_join(F.transform(F.split(v, " "), _escaped), r"\s+")

    def built(known: Column) -> Column:
        near = _bounded_pattern(F.transform(known, spaced), F.transform(known, lambda v: _escaped(F.left(v, F.lit(1)))), False)
        return F.struct(known.alias("variants"), near.alias("folded"), F.concat(F.lit("(?i)"), near).alias("ascii"))

    return let(variants, built)


def wide_pattern(variants: Column, *, rare: bool) -> Column:
    """The variants in every spelling that folds to them, for text as it is."""
    wide, first = _letter_classes(rare)
    classes, firsts = literal_map(wide), literal_map(first)
    token = F.lit(r"(?s)" + "|".join(k for k in wide if len(k) == 2) + "|.")

    def widened(variant: Column) -> Column:
        pieces = F.regexp_extract_all(variant, token, F.lit(0))
        return F.array_join(F.transform(pieces, lambda p: F.coalesce(
            F.try_element_at(classes, p), F.when(p == " ", r"\s+").otherwise(F.concat(_escaped(p), F.lit(r"\p{M}*+"))))), "")

    heads = F.transform(variants, lambda v: let(F.left(v, F.lit(1)), lambda h: F.coalesce(F.try_element_at(firsts, h), _escaped(h))))
    return _bounded_pattern(F.transform(variants, widened), heads, True)


def with_identity(docs: DataFrame, people: DataFrame, owner: str, *, name: str = "name", email: str = "email") -> DataFrame:
    """`docs` with the patterns of their owner as `identity` (NULL without one). One equality join that moves names and
    addresses only: the patterns, many times their size, are built by the tasks that hold the documents."""
    owners = people.select(F.col(owner), F.struct(F.col(name).alias("name"), F.col(email).alias("email")).alias("_owner"))
    known = F.col("_owner").isNotNull()
    joined = docs.join(owners, owner, "left")
    return joined.withColumn("identity", F.when(known, identity_patterns(identity_variants(F.col("_owner.name"), F.col("_owner.email"))))).drop("_owner")


@lru_cache(maxsize=None)
def _uneven_chars() -> str:
    """Characters that fold to none, to several, or from no letter to a letter: with none of these, a text and its folded
    form have the same places and the same ends of words."""
    source, target, expansions, _ = fold_tables(True)
    word = lambda c: unicodedata.category(c)[0] in "LN"
    uneven = [*source[len(target) :], *expansions, *(c for c, plain in zip(source, target, strict=False) if word(c) != word(plain))]
    near = _runs([c for c in uneven if c <= "\xff"])
    return f"[{near}[[^\\x00-\\xff]&&[{_runs([c for c in uneven if c > chr(0xff)])}{chr(HANGUL[0])}-{chr(HANGUL[1])}]]]"


def _mask_places(text: Column, folded: Column, pattern: Column) -> Column:
    """`text` with the mask wherever the pattern matches its `folded` form, which has the same places."""
    pieces, hits = F.split(folded, pattern, -1), F.regexp_extract_all(folded, pattern, F.lit(0))
    both = F.filter(F.arrays_zip(pieces.alias("piece"), hits.alias("hit")), lambda x: x["hit"].isNotNull())
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        out = F.concat(state["out"], F.substring(text, state["at"], F.length(x["piece"])), F.lit(MASK))
        return F.struct((state["at"] + F.length(x["piece"]) + F.length(x["hit"])).alias("at"), out.alias("out"))

    return F.aggregate(both, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"], F.length(text))))


def mask_spellings(text: Column, identity: Column) -> Column:
    """:func:`mask_identity` by a pattern of all spellings: longer to match, but a shallow expression that fits into the
    lambdas over a page's values."""

    def rest(common: Column) -> Column:
        """Spellings in rare characters are left to a second, larger pattern that hardly any row needs."""
        needed = common.rlike(_rare_chars()) & leaks(common, identity)
        return F.when(needed, F.regexp_replace(common, wide_pattern(identity["variants"], rare=True), F.lit(MASK))).otherwise(common)

    wide = F.when(leaks(text, identity), let(F.regexp_replace(text, wide_pattern(identity["variants"], rare=False), F.lit(MASK)), rest)).otherwise(text)
    masked = F.when(is_ascii(text), F.regexp_replace(text, identity["ascii"], F.lit(MASK))).otherwise(wide)
    return F.when(identity["folded"].isNull(), text).otherwise(masked)


def mask_identity(text: Column, identity: Column) -> Column:
    """Every spelling of the identity as the mask, whatever its case and accents; other text unchanged.

    ASCII text is masked as it is. Other text is searched in its folded form, with a pattern as short as the name; the places
    found are those of the text itself, unless it holds characters that fold to none or several. Only such text needs the
    pattern of all spellings.
    """

    def searched(folded: Column) -> Column:
        even = ~text.rlike(_uneven_chars())
        return F.when(~F.rlike(folded, identity["folded"]), text).when(even, _mask_places(text, folded, identity["folded"]))

    by_place = let(_folded(text, casefold=True), searched)
    masked = F.when(is_ascii(text), F.regexp_replace(text, identity["ascii"], F.lit(MASK))).otherwise(F.coalesce(by_place, mask_spellings(text, identity)))
    return F.when(identity["folded"].isNull(), text).otherwise(masked)


def leaks(text: Column, identity: Column) -> Column:
    """Whether any variant survives in a text, compared folded."""
    return F.coalesce(F.rlike(_folded(text, casefold=True), identity["folded"]), F.lit(False))


def leak_audit(docs: DataFrame, *, text: str = "text", identity: str = "identity") -> DataFrame:
    """`docs` with `leaked`: a variant survives in the text or in its percent-decoded form."""
    body, who = F.col(text), F.col(identity)
    return docs.withColumn("leaked", leaks(body, who) | (F.contains(body, F.lit("%")) & leaks(unquote(body), who)))


def release(audited: DataFrame) -> DataFrame:
    """Only the rows that passed the audit."""
    return audited.where(~F.col("leaked")).drop("leaked")


def pseudonymise_files(df: DataFrame, *, doc: str = "doc_id", pos: str = "pos", name: str = "name") -> DataFrame:
    """File names as ``cv-N.ext``, N by first appearance in the document; the same name keeps its N."""
    firsts = df.groupBy(doc, name).agg(F.min(pos).alias("_first")).withColumn("_one", F.lit(1))
    numbered = running_total(firsts, "_first", "_one", "_n", by=[doc]).drop("_one", "_first")
    extension = F.lower(F.regexp_extract(F.btrim(name), FILE_CORE, 1))
    return df.join(numbered, [doc, name]).withColumn("alias", F.concat(F.lit("cv-"), F.col("_n").cast("string"), F.lit("."), extension)).drop("_n")


# ---- page scrubbing -----------------------------------------------------------------------------
TOKEN = pa.struct([("pre", pa.string()), ("value", pa.string()), ("raw", pa.string()), ("slot", pa.string()),
                   ("tag", pa.string()), ("attr", pa.string()), ("name", pa.string())])
TOKEN_DDL = "array<struct<pre:string,value:string,raw:string,slot:string,tag:string,attr:string,name:string>>"
_JSON_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?', re.S)


class _Tokens(HTMLParser):
    """A page as literal markup (`pre`) alternating with values that may hold personal data."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.pre = ""
        self.raw_in = ""
        self.json = False

    def _value(self, value: str, slot: str, **where: str) -> None:
        self.out.append({"pre": self.pre, "value": value, "slot": slot, **where})
        self.pre = ""

    def handle_decl(self, decl: str) -> None:
        self.pre += f"<!{decl}>"

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}
        self.pre += f"<{tag}"
        for key, value in attrs:
            self.pre += f" {key}"
            if value is not None:
                self.pre += '="'
                self._value(value, "attr", tag=tag, attr=key, name=given.get("name", ""))
                self.pre = '"'
        self.pre += ">"
        if tag not in VOID:
            self.raw_in = tag
            self.json = given.get("type", "").strip().lower() == "application/ld+json"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.raw_in = ""
        self.pre += f"</{tag}>"

    def handle_data(self, data: str) -> None:
        if self.raw_in == "script":
            self._script(data)
        else:
            self._value(data, "raw" if self.raw_in == "style" else "text", tag=self.raw_in)

    def _script(self, body: str) -> None:
        """JSON-LD string values one by one; any other script, or a malformed one, loses its body."""
        try:
            json.loads(body if self.json else "", strict=False)
        except ValueError:
            return
        done = 0
        for found in _JSON_STRING.finditer(body):
            if found[2] is None:
                self.pre += body[done:found.start()]
                literal = f'"{found[1]}"'
                self._value(json.loads(literal, strict=False), "json", raw=literal)
                done = found.end()
        self.pre += body[done:]


def page_tokens(html: str | None) -> list[dict]:
    parser = _Tokens()
    parser.feed(html or "")
    parser.close()
    return [*parser.out, {"pre": parser.pre, "slot": "end"}]


VALUE = pa.struct([("place", pa.string()), ("value", pa.string())])
VALUE_DDL = "array<struct<place:string,value:string>>"


def page_values(html: str | None) -> list[dict]:
    """Every text and attribute value of a page with where it stands."""
    found = []
    for node in parse(html or ""):
        found += [{"place": f"text in <{node.tag}>", "value": c} for c in node.children if isinstance(c, str)]
        found += [{"place": f"attribute {k} on <{node.tag}>", "value": v} for k, v in node.attrs.items()]
    return found


def _per_page(df: DataFrame, html: str, out: str, ddl: str, kind: pa.DataType, fn: Callable[[str | None], list[dict]]) -> DataFrame:
    """`df` with `out`, the list `fn` makes of each page, in Arrow batches."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = pa.array([fn(page) for page in part.column(html).to_pylist()], pa.list_(kind))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*names, out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{kept}, {out} {ddl}")


HEADER_KEEP = (Sel("name", cls="header-dropdown-name"), Sel("email", cls="header-dropdown-email"), Sel("avatar", attr="aria-label", prefix=AVATAR_PREFIX))


def _attribute(t: Column, profile: Column, clean: Callable[[Column], Column], mask: Callable[[Column], Column], file: Callable[[Column, Column], Column]) -> Column:
    value, name = t["value"], F.lower(t["attr"])
    core = F.btrim(value)
    secret_meta = (t["tag"] == "meta") & (name == "content") & F.lower(t["name"]).isin(*SECRET_META)
    own_input = (t["tag"] == "input") & (name == "value") & (profile | (t["name"] == "authenticity_token"))
    return (
        F.when((name == "aria-label") & value.startswith(AVATAR_PREFIX), f"{AVATAR_PREFIX} {MASK}")
        .when(name.isin(*SECRET_ATTRS) | name.rlike(PERSONAL_ATTR) | secret_meta | own_input, MASK)
        .when(core.rlike(FILE_CORE), file(value, core)).when((name == "download") & (core != ""), MASK)
        .when(name.isin(*STRUCTURAL_ATTRS), mask(value)).otherwise(clean(value))
    )


def _takes_number(t: Column, profile: Column) -> Column:
    """Whether a token is a file name that gets a number (no earlier rule replaces it)."""
    name = F.lower(t["attr"])
    masked = name.isin(*SECRET_ATTRS) | name.rlike(PERSONAL_ATTR) | ((t["tag"] == "input") & (name == "value") & (profile | (t["name"] == "authenticity_token"))) | (
        (t["tag"] == "meta") & (name == "content") & F.lower(t["name"]).isin(*SECRET_META))
    file = F.btrim(t["value"]).rlike(FILE_CORE)
    in_text = t["slot"].isin("text", "raw") & ~(profile & (t["tag"] == "textarea"))
    return F.coalesce(file & (in_text | ((t["slot"] == "attr") & ~masked)), F.lit(False))


def scrub_pages(pages: DataFrame, *, html: str = "html", path: str = "path", name: str = "name", email: str = "email") -> DataFrame:
    """Pages with personal data masked: adds `scrubbed`, `locations` and `leaked`.

    The owner's identity comes from the `name` / `email` columns and from the page header. Secret and
    personal attributes, form values on profile paths, scripts other than JSON-LD and comments go;
    every other value gets the value rules and the identity mask. The result is then read again and any
    surviving variant is reported in `locations` (never the text itself) with `leaked` set.
    """
    carry = list(pages.columns)
    headed = element_table(pages, HEADER_KEEP, html=html, carry=carry)
    hits = F.col("hits")
    label = first_of(hits, "avatar")["attrs"]
    avatar = F.nullif(F.btrim(F.regexp_replace(F.substr(F.try_element_at(label, F.lit("aria-label")), F.lit(len(AVATAR_PREFIX) + 1)), r"\s+", " ")), F.lit(""))
    header_name = F.coalesce(first_text(hits, "name"), avatar)
    none = F.lit(None).cast("string")
    variants = sort_variants(F.concat(
        identity_variants(F.col(name), F.col(email)), identity_variants(header_name, first_text(hits, "email")), identity_variants(avatar, none)))
    known = headed.select(*carry, variants.alias("_variants")).withColumn("identity", identity_patterns(F.col("_variants"))).drop("_variants")
    tokenised = _per_page(known, html, "_tokens", TOKEN_DDL, TOKEN, page_tokens)
    route = F.substring_index(F.col(path), "?", 1)
    profile = (route == "/profile") | route.startswith("/profile/")
    files = F.array_distinct(F.transform(F.filter(F.col("_tokens"), lambda t: _takes_number(t, F.col("_profile"))), lambda t: F.btrim(t["value"])))
    prepared = tokenised.withColumn("_profile", profile)
    who = F.col("identity")
    mask = lambda v: mask_spellings(v, who)
    clean = lambda v: clean_value(v, mask)

    def rendered(t: Column, names: Column) -> Column:
        def file(value: Column, core: Column) -> Column:
            alias = F.concat(F.lit("cv-"), F.array_position(names, core).cast("string"), F.lit("."), F.lower(F.regexp_extract(core, FILE_CORE, 1)))
            return F.replace(value, core, alias)

        text = F.when(F.col("_profile") & (t["tag"] == "textarea"), F.when(t["value"] != "", MASK).otherwise("")).when(
            F.btrim(t["value"]).rlike(FILE_CORE), file(t["value"], F.btrim(t["value"]))).otherwise(clean(t["value"]))
        escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        quoted = lambda v: F.replace(F.replace(v, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        as_json = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
            F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", "$1"), "<", r"\\u003c"), ">", r"\\u003e"), "&", r"\\u0026")
        attribute = _attribute(t, F.col("_profile"), clean, mask, lambda _, core: file(core, core))
        shown = (
            F.when(t["slot"] == "text", escaped(text)).when(t["slot"] == "raw", text).when(t["slot"] == "attr", quoted(attribute))
            .when(t["slot"] == "json", let(clean(t["value"]), lambda v: F.when(v == t["value"], t["raw"]).otherwise(as_json(v)))).otherwise("")
        )
        return F.concat(t["pre"], shown)

    markup = let(files, lambda names: F.transform(F.col("_tokens"), lambda t: rendered(t, names)))
    result = prepared.withColumn("scrubbed", F.array_join(markup, "")).drop("_tokens", "_profile")
    return audit_pages(result, html="scrubbed").drop("identity")


def audit_pages(pages: DataFrame, *, html: str = "html", identity: str = "identity") -> DataFrame:
    """Adds `locations` (where a variant survives: texts, attribute values also percent-decoded, else the
    raw markup) and `leaked`."""
    valued = _per_page(pages, html, "_values", VALUE_DDL, VALUE, page_values)
    who = F.col(identity)
    hit = F.filter("_values", lambda v: leaks(v["value"], who) | (F.contains(v["value"], F.lit("%")) & leaks(unquote(v["value"]), who)))
    places = F.array_distinct(F.transform(hit, lambda v: F.when(leaks(v["place"], who), MARKUP).otherwise(v["place"])))
    found = valued.withColumn("_places", places).drop("_values")
    locations = F.when((F.size("_places") == 0) & leaks(F.col(html), who), F.array(F.lit(MARKUP))).otherwise(F.col("_places"))
    return found.withColumn("locations", locations).withColumn("leaked", F.size("locations") > 0).drop("_places")
