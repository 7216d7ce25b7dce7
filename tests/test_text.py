import datetime
import html

import pytest
from pyspark.sql import functions as F

from vacantia.functions import folding, text


def python_fold(value, casefold):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return plain.casefold() if casefold else plain.lower()


SAMPLES = ["Bío Bío", "ÑUÑOA  x", "Straße ½ ﬁn", "école Ⅷ", "", "x y\x1cz", "ĲŁØ ŉ ǅ", "𝐀nalista", "日本 ㍿ ﷺ"]


def test_fold_matches_per_character_definition(evaluate):
    assert evaluate(folding.fold, SAMPLES) == [" ".join(python_fold(s, True).split()) for s in SAMPLES]
    assert evaluate(folding.normalize, SAMPLES) == [" ".join(python_fold(s, False).split()) for s in SAMPLES]
    assert evaluate(folding.fold, [None]) == [None]


def test_fold_whole_plane(evaluate):
    points = [chr(p) for p in range(1, 0x3000) if p != 0x3A3]
    assert evaluate(lambda c: folding._folded(c, True), points) == [python_fold(p, True) for p in points]


def test_key(evaluate):
    assert evaluate(folding.key, ["Bío Bío", "O'Higgins", None, "ß1"]) == ["biobio", "ohiggins", None, "1"]


def test_normalize_space(evaluate):
    assert evaluate(folding.normalize_space, [" a  b\n", " ", None]) == ["a b", "", None]


def test_forms_are_fold_normalize_and_key(evaluate):
    values = [*SAMPLES, None, "".join(chr(p) + "a" for p in range(1, 0x3100) if p != 0x3A3), "Ĳ ß\u2003\u2028ẞ\x85K", "plain  Text\t"]
    of = lambda fn: evaluate(fn, values)
    assert [tuple(f) for f in of(folding.forms)] == list(zip(of(folding.fold), of(folding.normalize), of(folding.key), strict=True))
    assert of(folding.normalize_space) == [None if v is None else " ".join(v.split()) for v in values]


def test_spaces_of_many_tasks_are_quick(spark):
    """On many threads of one JVM it takes a few times as long as the plainest pattern, not eight times."""
    import time

    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(800)), lambda i: F.concat(F.lit("palabra\n"), i.cast("string"))), " ")
    df = spark.range(0, 2000, 1, 8).select(F.concat(words, F.col("id").cast("string")).alias("v")).persist()
    df.count()

    def best(column) -> float:
        def run() -> float:
            start = time.perf_counter()
            df.select(F.md5(column).alias("m")).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        return min(run() for _ in range(4))

    plain = best(F.regexp_replace("v", "[ \n]+", " "))
    assert best(folding.normalize_space(F.col("v"))) < 4 * plain + 0.2
    df.unpersist()


@pytest.mark.parametrize("value,expected", [
    ("2026-09-23", "2026-09-23"), ("2026-09-23T10:00:00-03:00", "2026-09-23"), ("23/09/26", "2026-09-23"),
    ("23/09/2026", "2026-09-23"), ("23/09/26 12:00", "2026-09-23"), ("2026-02-30", None), ("hace 2 días", None),
    ("", None), (None, None), ("20260923", None), ("3/9/26", "2026-09-03"), ("31/02/2026", None), ("01/01/70", "1970-01-01"),
    ("01/01/26 25:00", None), ("2026-13-45", None),
])
def test_parse_date_any(evaluate, value, expected):
    assert evaluate(text.parse_date_any, [value]) == [datetime.date.fromisoformat(expected) if expected else None]


def test_to_int(evaluate):
    cases = {
        "1.200.000": 1200000, "$1.200.000": 1200000, "1,200,000": 1200000, "1.200.000,50": 1200000, "1200000.0": 1200000,
        "1828": 1828, "Entre 800.000 y 1.000.000": 800000, "sin dato": None, "": None, None: None, "x 5.": 5,
    }
    assert evaluate(text.to_int, list(cases)) == list(cases.values())
    assert evaluate(text.whole_int, ["273", "1.828", "1.8", "12 x", ""]) == [273, 1828, None, None, None]
    assert evaluate(text.to_amount, ["650.000", "2.150.000,00"]) == [650000, 2150000]
    assert evaluate(text.digits_only, ["1.500.000", "a convenir", None]) == ["1500000", "", ""]


def test_entities_match_html5(evaluate):
    cases = ["a &amp;lt; b", "&aacute;&nbsp;&#233;&#xE9;", "&copy 2020 &notit; &bogus; &", "&#128;&#0;&#x110000;&#55296;", "x",
             "&NotEqualTilde;&fjlig;", "&#x41&#66 &ampx", "a && b &#; &#x;", "&#13;&#1;", "&amp;amp;"]
    assert evaluate(text.decode_entities, cases) == [html.unescape(c) for c in cases]


def test_html_to_text(evaluate):
    markup = "<p>Uno&nbsp;&amp; dos<br/>tres</p>\n\n<ul><li class='x'>a</li><LI>b</LI></ul><i>x</i>y"
    assert evaluate(text.html_to_text, [markup, "  ", None]) == ["Uno & dos\ntres\n- a\n- b\nx y", "", ""]


def test_clips(evaluate):
    assert evaluate(lambda c: text.clip_collapsed(c, 9), ["uno  dos tres", "unodostres4", "corto"]) == ["uno dos", "unodostre", "corto"]
    form = lambda c: text.clip_form(c, F.lit(7))
    assert evaluate(form, ["uno dos tres", "uno  doscientos", "abcdefghij", "uno dos", "uno do stres", ""]) == [
        "uno dos", "uno", "abcdefg", "uno dos", "uno do", ""]


def test_strip_control_chars(spark):
    df = spark.sql("select 'a\\u0007b\\tc' s, array('x\\u009by', null) a, named_struct('t', 'p\\u007f', 'n', 1) st, 5 n")
    row = text.strip_control_chars(df).first()
    assert (row.s, row.a, row.st.t, row.st.n, row.n) == ("ab\tc", ["xy", None], "p", 1, 5)


def test_fold_beyond_the_first_planes(evaluate):
    import unicodedata

    from vacantia.functions.folding import fold

    words = ["한국어 각 가 힣", "\U0002F800\U0002FA1D", "ｶﾞﾞ", "Ünïcödé ﬁ", "가b각"]
    plain = [" ".join("".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).casefold().split()) for w in words]
    assert evaluate(fold, words) == plain
