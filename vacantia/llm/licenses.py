"""License scan: ordered signature rules over the words of a text. DataFrame functions only.

A cheap gate on the raw text leaves the few rows that can hold a license mention. Their words (A-Z lower-cased) are
joined by single blanks, the rule keywords among them pick the rules to try, and each rule's regular expression marks
its matches in place, so a detection is an interval of words. A detection that lies inside another one is dropped; of
equal intervals the rule of higher priority stays, then the earlier rule.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.folding import let
from vacantia.llm.common import lower_ascii

_WORDS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_BETWEEN = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_V = r"(?: v(?:er(?:sion)?)?)? ?"
_OPEN, _SHUT = "\x01", "\x02"

#: Phrases that give their label wherever their words stand in order.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label | keyword | names, as regular expressions over normalised words | SPDX identifier, as words
LICENSES = [tuple(x.strip() for x in line.split("|", 2)) for line in rf"""
agpl-3.0 | affero | (?:gnu )?affero general public licen[sc]e(?:{_V}3(?: 0)?)? ; agpl 3 0(?: only| or later)?
agpl-1.0 | affero | affero general public licen[sc]e{_V}1(?: 0)? ; agpl 1 0(?: only| or later)?
agpl | agpl | agpl(?:v3| v3| 3)? ; agpl
gpl-1.0 | gnu | gnu general public licen[sc]e{_V}1(?: 0)? ; gpl 1 0(?: only| or later)?
gpl-2.0 | gnu | gnu general public licen[sc]e{_V}2(?: 0)? ; gpl 2 0(?: only| or later)?
gpl-3.0 | gnu | gnu general public licen[sc]e{_V}3(?: 0)? ; gpl 3 0(?: only| or later)?
gpl-any | gnu | gnu (?:general public licen[sc]e|gpl) ; gpl
gpl-2.0 | gpl | (?:gnu )?gpl ?v? ?2(?: 0)? ; gpl 2 0
gpl-3.0 | gpl | (?:gnu )?gpl ?v? ?3(?: 0)? ; gpl 3 0
gpl-2.0 | gplv2 | gplv2(?: or later)? ; gplv2
gpl-3.0 | gplv3 | gplv3(?: or later)? ; gplv3
lgpl-2.0 | library | gnu library general public licen[sc]e(?:{_V}2(?: 0)?)? ; lgpl 2 0(?: only| or later)?
lgpl-2.1 | lesser | gnu lesser general public licen[sc]e{_V}2 1 ; lgpl 2 1(?: only| or later)?
lgpl-3.0 | lesser | gnu lesser general public licen[sc]e{_V}3(?: 0)? ; lgpl 3 0(?: only| or later)?
lgpl | lesser | (?:gnu )?lesser general public licen[sc]e ; lgpl
lgpl | lgpl | (?:gnu )?lgpl(?: ?v? ?(?:2 1|2|3)(?: 0)?)? ; lgpl
gfdl | documentation | gnu free documentation licen[sc]e(?:{_V}1 [123])? ; gfdl 1 [123](?: only| or later)?
apache-1.0 | apache | apache (?:software )?licen[sc]e{_V}1 0 ; apache 1 0
apache-1.1 | apache | apache (?:software )?licen[sc]e{_V}1 1 ; apache 1 1
apache-2.0 | apache | apache (?:software )?licen[sc]e{_V}2(?: 0)? ; apache 2 0
apache-any | apache | apache (?:software )?licen[sc]e ; apache
mit | mit | (?:the )?mit licen[sc]e ; mit
mit-0 | mit | mit no attribution(?: licen[sc]e)? ; mit 0
mit-style | mit | mit (?:style|like) licen[sc]e ; mit style
x11 | x11 | x11 licen[sc]e ; x11
expat | expat | expat licen[sc]e ; expat
isc | isc | isc licen[sc]e ; isc
bsd-1-clause | bsd | (?:bsd 1 clause|1 clause bsd)(?: licen[sc]e)? ; bsd 1 clause
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: licen[sc]e)? ; bsd 2 clause
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)? ; bsd 3 clause
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)? ; bsd 4 clause
0bsd | 0bsd | (?:zero clause bsd|0bsd)(?: licen[sc]e)? ; 0bsd
bsd-any | bsd | bsd (?:style )?licen[sc]e ; bsd
mpl-1.0 | mozilla | mozilla public licen[sc]e{_V}1 0 ; mpl 1 0
mpl-1.1 | mozilla | mozilla public licen[sc]e{_V}1 1 ; mpl 1 1
mpl-2.0 | mozilla | mozilla public licen[sc]e{_V}2(?: 0)? ; mpl 2 0
mpl-any | mozilla | mozilla public licen[sc]e ; mpl
epl-1.0 | eclipse | eclipse public licen[sc]e{_V}1(?: 0)? ; epl 1 0
epl-2.0 | eclipse | eclipse public licen[sc]e{_V}2(?: 0)? ; epl 2 0
epl-any | eclipse | eclipse public licen[sc]e ; epl
edl-1.0 | eclipse | eclipse distribution licen[sc]e(?:{_V}1 0)? ; edl 1 0
cddl-1.0 | cddl | cddl(?:{_V}1 0)? ; cddl 1 0
cddl-1.1 | cddl | cddl{_V}1 1 ; cddl 1 1
cddl | common | common development and distribution licen[sc]e ; cddl
cpl-1.0 | common | common public licen[sc]e(?:{_V}1 0)? ; cpl 1 0
cpal-1.0 | attribution | common public attribution licen[sc]e(?:{_V}1 0)? ; cpal 1 0
ipl-1.0 | ibm | ibm public licen[sc]e(?:{_V}1 0)? ; ipl 1 0
eupl-1.1 | union | european union public licen[sc]e{_V}1 1 ; eupl 1 1
eupl-1.2 | union | european union public licen[sc]e(?:{_V}1 2)? ; eupl 1 2
artistic-1.0 | artistic | artistic licen[sc]e{_V}1(?: 0)? ; artistic 1 0
artistic-2.0 | artistic | artistic licen[sc]e{_V}2(?: 0)? ; artistic 2 0
artistic-any | artistic | (?:perl )?artistic licen[sc]e ; artistic
bsl-1.0 | boost | boost software licen[sc]e(?:{_V}1 0)? ; bsl 1 0
busl-1.1 | business | business source licen[sc]e(?:{_V}1 1)? ; busl 1 1
sspl-1.0 | server | server side public licen[sc]e(?:{_V}1(?: 0)?)? ; sspl 1 0
elastic-2.0 | elastic | elastic licen[sc]e(?:{_V}2(?: 0)?)? ; elastic 2 0
polyform-nc | polyform | polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)? ; polyform noncommercial 1 0 0
polyform-sb | polyform | polyform small business(?: licen[sc]e)?(?: 1 0 0)? ; polyform small business 1 0 0
unlicense | unlicense | (?:the )?unlicense ; unlicense
wtfpl | wtfpl | wtfpl(?: v? ?2)? ; wtfpl
zlib | zlib | zlib(?: libpng)? licen[sc]e ; zlib
libpng | libpng | (?:libpng licen[sc]e|png reference library licen[sc]e) ; libpng(?: 2 0)?
openssl | openssl | openssl licen[sc]e ; openssl
curl | curl | curl licen[sc]e ; curl
python-2.0 | python | python (?:software foundation )?licen[sc]e(?:{_V}2(?: 0)?)? ; python 2 0
psf-2.0 | psf | psf licen[sc]e(?: agreement)? ; psf 2 0
php-3.0 | php | php licen[sc]e(?:{_V}3(?: 0| 01)?)? ; php 3 0(?:1)?
ruby | ruby | ruby licen[sc]e ; ruby
vim | vim | vim licen[sc]e ; vim
postgresql | postgresql | postgresql licen[sc]e ; postgresql
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[sc]e ; ncsa
w3c | w3c | w3c (?:software notice and |software )?licen[sc]e ; w3c
unicode | unicode | unicode (?:data files and software )?licen[sc]e ; unicode (?:3 0|dfs 2016)
ofl-1.1 | sil | sil open font licen[sc]e(?:{_V}1 1)? ; ofl 1 1
ofl-1.0 | sil | sil open font licen[sc]e{_V}1 0 ; ofl 1 0
afl-3.0 | academic | academic free licen[sc]e(?:{_V}[123](?: [01])?)? ; afl [123] [01]
osl-3.0 | open | open software licen[sc]e(?:{_V}[123](?: [01])?)? ; osl [123] [01]
odbl-1.0 | database | open (?:data commons open )?database licen[sc]e(?:{_V}1 0)? ; odbl 1 0
odc-by | commons | open data commons attribution licen[sc]e(?:{_V}1 0)? ; odc by 1 0
pddl-1.0 | dedication | (?:open data commons )?public domain dedication and licen[sc]e ; pddl 1 0
ms-pl | microsoft | microsoft public licen[sc]e ; ms pl
ms-rl | microsoft | microsoft reciprocal licen[sc]e ; ms rl
apsl-2.0 | apple | apple public source licen[sc]e(?:{_V}[12](?: [012])?)? ; apsl [12] [012]
qpl-1.0 | q | q public licen[sc]e(?:{_V}1 0)? ; qpl 1 0
sleepycat | sleepycat | sleepycat licen[sc]e ; sleepycat
upl-1.0 | permissive | universal permissive licen[sc]e(?:{_V}1 0)? ; upl 1 0
blueoak-1.0.0 | oak | blue oak model licen[sc]e(?: 1 0 0)? ; blueoak 1 0 0
cecill-2.1 | cecill | cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?(?:{_V}[12](?: [01])?)? ; cecill 2 1
beerware | beerware | beerware licen[sc]e ; beerware
json | json | json licen[sc]e ; json
ecl-2.0 | educational | educational community licen[sc]e(?:{_V}[12](?: 0)?)? ; ecl 2 0
naist-2003 | naist | naist licen[sc]e ; naist 2003
zpl-2.1 | zope | zope public licen[sc]e(?:{_V}[12] [01])? ; zpl 2 1
mulan-2.0 | mulan | mulan (?:permissive software |psl )licen[sc]e(?:{_V}2)? ; mulanpsl 2 0
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: [ms])?(?: licen[sc]e)? ; openrail
openrail | rail | responsible ai licen[sc]e|(?:bigscience )?rail licen[sc]e(?: 1 0)? ; rail 1 0
ogl-3.0 | government | open government licen[sc]e(?:{_V}[123](?: 0)?)? ; ogl uk [123] 0
etalab-2.0 | ouverte | licence ouverte(?: open licence)?(?: etalab)?(?:{_V}2 0)? ; etalab 2 0
cc0-1.0 | cc0 | cc0(?: 1 0(?: universal)?)? ; cc0 1 0
cc0-1.0 | creative | creative commons (?:zero|cc0)(?: 1 0(?: universal)?)? ; cc0 1 0
cc-by-nc-sa | cc | cc by nc sa(?: [1234] [05])? ; cc by nc sa [1234] [05]
cc-by-nc-nd | cc | cc by nc nd(?: [1234] [05])? ; cc by nc nd [1234] [05]
cc-by-nc | cc | cc by nc(?: [1234] [05])? ; cc by nc [1234] [05]
cc-by-nd | cc | cc by nd(?: [1234] [05])? ; cc by nd [1234] [05]
cc-by-sa | cc | cc by sa(?: [1234] [05])? ; cc by sa [1234] [05]
cc-by-4.0 | cc | cc by 4 0 ; cc by 4 0
cc-by-3.0 | cc | cc by 3 0 ; cc by 3 0
cc-by-2.0 | cc | cc by 2 [05] ; cc by 2 [05]
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? ; creative nc sa
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? ; creative nc nd
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? ; creative nc
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? ; creative nd
cc-by-sa | creative | creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? ; creative sa
cc-by | creative | creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[sc]e)? ; creative by
cc-any | creative | creative commons licen[sc]e ; creative commons
public-domain | domain | (?:in|into|to|released to|dedicated to) the public domain ; public domain
proprietary | rights | all rights reserved ; licenseref proprietary
proprietary | proprietary | (?:proprietary (?:and|or) confidential|proprietary licen[sc]e) ; licenseref proprietary
""".strip().splitlines()]

#: Kinds of signatures made from a license, strongest first: priority, confidence, pattern around a name.
KINDS = {
    "spdx": (3, 1.0, "spdx licen[sc]e identifier {spdx}"),
    "notice": (2, 0.95, "(?:(?:is|are|was|been) )?(?:licen[sc]ed|released|distributed|published|available|provided|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:{name})"),
    "name": (1, 0.7, "(?:{name})"),
}


def rules() -> list[dict]:
    """The signatures in order: label, keyword, priority, confidence and pattern; about three for each license."""
    out = []
    for label, keyword, rest in LICENSES:
        name, spdx = (x.strip() for x in rest.rsplit(";", 1))
        for priority, confidence, pattern in KINDS.values():
            text = pattern.format(name=name, spdx=spdx)
            out.append({"o": len(out), "label": label, "keyword": "spdx" if "spdx" in text else keyword, "priority": priority, "confidence": confidence, "pattern": f"(?<= )({text})(?= )"})
    return out


#: One of these stands in the lower-cased raw text of any detection (of the short "cc", as a word before "by" or "0").
GATE = ("licen", "spdx", "gpl", "commons", "bsd", "wtfpl", "cddl", "openrail", "cecill", "reserved", "domain", "polyform", "attribution", "proprietary")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def _gate(text: Column) -> Column:
    """Whether a text can hold a phrase or a signature: their separators may be anything, so words are sought alone."""
    low = F.lower(text)
    found = low.contains("cc") & low.rlike(r"cc(?:0|[^0-9a-z]+by)")
    for part in GATE:
        found = found | low.contains(part)
    return found


def _places(norm: Column) -> Column:
    """Count, first and last word of each phrase's places, whether they overlap or not."""

    def place(phrase: str, label: str) -> Column:
        def found(p: Column) -> Column:
            last = _spaces(norm) - _spaces(F.element_at(p, -1)) - 1
            return F.when(F.size(p) > 1, F.struct(F.lit(label).alias("label"), (F.size(p) - 1).alias("n"), (_spaces(p[0]) - 1).alias("first"), last.alias("last")))

        return let(F.split(norm, f"(?<= )(?={phrase} )"), found)

    return F.array_compact(F.array(*[place(*x) for x in PHRASES.items()]))


def _detections(norm: Column) -> Column:
    """All intervals of words that a tried rule matches."""
    schema = "array<struct<o:int,label:string,keyword:string,priority:int,confidence:double,pattern:string>>"
    table = F.from_json(F.lit(json.dumps(rules())), schema)
    keys = "|".join(sorted({r["keyword"] for r in rules()}))

    def found(rule: Column) -> Column:
        marked = F.split(F.regexp_replace(norm, rule.pattern, f"{_OPEN}$1{_SHUT}"), " ")

        def intervals(w: Column) -> Column:
            def places(mark: Column) -> Column:
                return F.filter(F.transform(w, lambda x, i: F.when(mark(x), i)), lambda i: i.isNotNull())

            both = F.arrays_zip(places(lambda x: x.startswith(_OPEN)).alias("s"), places(lambda x: x.endswith(_SHUT)).alias("e"))
            return F.transform(both, lambda z: F.struct((z.s - 1).alias("first"), (z.e - 1).alias("last"), rule.label.alias("label"), rule.priority.alias("priority"), rule.confidence.alias("confidence"), rule.o.alias("rule")))

        return let(marked, intervals)

    def tried(words: Column) -> Column:
        return F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(words, r.keyword)), found))

    return let(F.array_distinct(F.regexp_extract_all(norm, F.lit(f"(?<= )({keys})(?= )"), 1)), tried)


def _surviving(found: Column) -> Column:
    """`found` without intervals inside another one: in order of start, longest first, only a new end survives."""
    ranked = F.array_sort(F.transform(found, lambda d: F.struct(d["first"].alias("first"), (-d["last"]).alias("neg"), (-d.priority).alias("weak"), d.rule.alias("rule"), d.label.alias("label"), d.confidence.alias("confidence"))))
    start = F.struct(F.lit(-1).alias("end"), F.slice(ranked, 1, 0).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        new = -d.neg > acc.end
        return F.struct(F.greatest(acc.end, -d.neg).alias("end"), F.when(new, F.array_append(acc.kept, d)).otherwise(acc.kept).alias("kept"))

    kept = let(ranked, lambda r: F.aggregate(r, F.struct(F.lit(-1).alias("end"), F.slice(r, 1, 0).alias("kept")), step).kept)
    return F.transform(kept, lambda d: F.struct(d["first"].alias("first"), (-d.neg).alias("last"), d.label.alias("label"), d.confidence.alias("confidence")))


def scan(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, ``n_words``, ``phrases`` (label, n, first, last), ``detections`` (first, last, label, confidence).

    Positions are word numbers from 0. Null and blank texts have no words and empty lists; texts are read whole, rows
    are judged one by one (so repeated rows repeat), and extra columns are not carried.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(F.translate(text, _OPEN + _SHUT, "  ")), _BETWEEN, " ")), F.lit(" "))
    both = let(norm, lambda n: F.struct(_places(n).alias("phrases"), let(_detections(n), _surviving).alias("detections")))
    found = docs.select(*carry, F.regexp_count(text, F.lit(_WORDS)).cast("bigint").alias("n_words"), F.when(_gate(text), both).alias("_f"))
    return found.select(
        *carry, "n_words", *[F.coalesce(F.col(f"_f.{c}"), F.array().cast(found.schema["_f"].dataType[c].dataType)).alias(c) for c in ("phrases", "detections")],
    )


def summary(found: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One line for each row of `scan`: how many places, where, which labels, and how sure."""
    places, hits = F.col("phrases"), F.col("detections")
    base = F.array_sort(F.array_distinct(F.transform(places, lambda p: p.label)))
    labels = F.array_sort(F.array_union(base, F.transform(hits, lambda d: d.label)))
    return found.select(
        *carry, "n_words",
        F.aggregate(places, F.lit(0).cast("bigint"), lambda a, p: a + p.n).alias("n_base"),
        F.array_min(F.transform(places, lambda p: p["first"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform(places, lambda p: p["last"])).cast("bigint").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(hits, lambda d: d.confidence)), F.lit(0.0)), F.when(F.size(places) > 0, 0.6).otherwise(0.0)).alias("score"),
    )
