"""The registered query of each operator, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, language, licenses, linededup, packing, pii, quality, repeats, simhash, tokenfile, urls, variants, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of 3-word shingles and the groups linked at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, folder, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("bits")[0])), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words found in the documents."""
    found = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_NORMAL = r"trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"
CHECKS["op8_decontaminate"] = f"""
WITH items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, string_split({_NORMAL}, ' ') AS w FROM benchmark WHERE {_NORMAL} <> ''
), windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items)
), texts AS (
  SELECT doc_id, CASE WHEN {_NORMAL} = '' THEN [] ELSE string_split({_NORMAL}, ' ') END AS w FROM documents
), sizes AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts), sizes WHERE i + n - 1 <= len(w)
), found AS (
  SELECT doc_id, item, g.n, i FROM grams g JOIN windows v ON v.n = g.n AND v.t = g.t
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op3_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes covered by 400-byte strings that start more than once; and places in shorter repeats, which stay."""
    found = repeats.find_repeats(table(spark, folder, "documents"), shared=256)
    share = F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", share.alias("removed_share"), "n_shared", "spans")


@query
def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality counts, the base rule, and risk-controlled cutoffs fitted on the labels."""
    found = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed").alias("failed"))


def _quality_sql(risk: float = 0.02, delta: float = 0.05) -> str:
    """The counts, the base rule and the certified cutoffs; the binomial tail by the log-gamma function."""
    ratios = ", ".join(f"CASE WHEN {bottom} > 0 THEN {top} / {bottom}::DOUBLE ELSE 0.0 END AS r_{name}" for name, (top, bottom) in quality.RATIOS.items())
    grid = ", ".join(f"('{name}', {cut}::DOUBLE)" for name, cuts in quality.GRID.items() for cut in cuts)
    value = "CASE ratio " + " ".join(f"WHEN '{name}' THEN r_{name}" for name in quality.RATIOS) + " END"
    n_cells, p = sum(map(len, quality.GRID.values())), risk / len(quality.RATIOS)
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, unnest(l) AS a, generate_subscripts(l, 1) AS i, l FROM (SELECT doc_id, regexp_extract_all(x, '[^ 	-
]+') AS l FROM t)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, l[i:i + 2]) AS n FROM w WHERE i + 2 <= len(l)),
r AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, lang, len(regexp_extract_all(x, '[^ 	-
]+'))::BIGINT AS n_words, length(regexp_replace(x, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
    (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols, (length(x) - length(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals,
    (length(x) - length(replace(x, '!', '')))::BIGINT AS n_exclamations, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^ 	-
]')) AS ls FROM t) t LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {ratios} FROM m),
good AS (SELECT f.* FROM f JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed),
grid(ratio, cutoff) AS (VALUES {grid}),
tried AS (SELECT lang, ratio, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k FROM good, grid GROUP BY ALL),
strata AS (SELECT greatest(1, count(DISTINCT coalesce(lang, chr(0)))) AS s FROM good),
terms AS (SELECT *, unnest(range(0, k + 1)) AS j FROM tried),
tails AS (SELECT lang, ratio, cutoff, n, k, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r}))) AS tail FROM terms GROUP BY ALL),
cuts AS (SELECT lang, ratio, min(cutoff) AS cutoff FROM tails, strata WHERE tail <= {delta!r} / ({n_cells} * s) GROUP BY ALL),
failing AS (SELECT doc_id, string_agg(ratio, ',' ORDER BY ratio) AS failed FROM f JOIN cuts ON f.lang IS NOT DISTINCT FROM cuts.lang WHERE {value} > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed FROM f LEFT JOIN failing USING (doc_id)
"""


CHECKS["op6_quality"] = _quality_sql()


@query
def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and signatures."""
    return licenses.summary(licenses.scan(table(spark, folder, "documents")))


@query
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data spans."""
    return pii.summary(pii.find(table(spark, folder, "documents")))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated multi-line chunks, and repeated passages of over 50 words, removed; what stays of each document."""
    found = linededup.dedupe_passages(table(spark, folder, "documents"), words=50)
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select("doc_id", "n_removed_lines", F.length(text).cast("bigint").alias("n_kept_chars"), F.md5(text).alias("kept_md5"))


CHECKS["op10_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM lines
), rolled AS (
  SELECT *, coalesce((lag(h) OVER o * 31 + h) % 3 = 0, false) AS c, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1 AS is_last FROM hashed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), ended AS (
  SELECT *, (c AND NOT coalesce(lag(c) OVER (PARTITION BY doc_id ORDER BY i), false)) OR is_last AS e FROM rolled
), numbered AS (
  SELECT *, coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
    sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ended
), chunk AS (
  SELECT doc_id, min(i) AS first, max(i) AS last FROM numbered GROUP BY doc_id, k HAVING count(*) > 1 AND sum(w) > 0
), worded AS (
  SELECT doc_id, i, w, upto FROM numbered WHERE w > 0
), ahead AS (
  SELECT s.doc_id, s.i AS first, e.i AS last FROM worded s ASOF JOIN (SELECT doc_id, i, upto FROM worded) e ON s.doc_id = e.doc_id AND e.upto >= s.upto - s.w + 51
), back AS (
  SELECT e.doc_id, s.i AS first, e.i AS last FROM worded e ASOF JOIN (SELECT doc_id, i, upto - w AS before FROM worded) s ON s.doc_id = e.doc_id AND s.before <= e.upto - 51
), spans AS (
  SELECT * FROM chunk UNION SELECT * FROM ahead UNION SELECT * FROM back
), texts AS (
  SELECT s.doc_id, s.first, s.last, array_to_string(list_slice(str_split(d.text, chr(10)), s.first + 1, s.last + 1), chr(10)) AS t FROM spans s JOIN documents d USING (doc_id)
), again AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, first) AS n FROM texts) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM again
), kept AS (
  SELECT l.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, length(coalesce(k.text, ''))::BIGINT AS n_kept_chars, md5(coalesce(k.text, '')) AS kept_md5 FROM documents d LEFT JOIN kept k USING (doc_id)
"""


@query
def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages by cross-parsing, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    learned = language.training_sample(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs, learned)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_phrases")


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Optimal length buckets and token-budget batches."""
    return packing.pack(table(spark, folder, "documents"))


@query
def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts for page urls."""
    return urls.judge(table(spark, folder, "pages"))


@query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings projected on up to 16 whitened components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written to files in the order of documents, and read back."""
    files = tokenfile.write_ids(table(spark, folder, "documents"))
    return tokenfile.read_documents(spark, files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Spelling variants of frequent words, with every 199th run of a document misspelt."""
    words = variants.count_words(table(spark, folder, "documents"), drop_every=199)
    return variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


CHECKS["op13_variants"] = r"""
WITH RECURSIVE codes AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS code FROM (SELECT unnest(range(256))::BIGINT AS i)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), counted AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run
), summed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(c >> 8, code[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM counted, codes
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word FROM summed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), less AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places
), masked AS (
  SELECT word, n, i, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) AS mask FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.mask = b.mask AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word
  UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk(word, root) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, walk.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word JOIN formed e ON e.word = walk.root WHERE e.form IS NULL
"""
