"""Masking, identities, leak audit, page scrubbing."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.operators import privacy as pr
from vacantia.plans.derived import table
from vacantia.plans.registry import query

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"


@query("p1_mask_patterns", rf"""
WITH a AS (SELECT doc_id, text || ' RUT 12.345.678-k https://lh3.googleusercontent.com/a?b=1 /x?token=abc ' || '+56 9 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || ' 1234' AS text FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?:https?:)?//[^\s"''<>]*?(?:googleusercontent|licdn)\.com[^\s"''<>]*', 'SCRUBBED', 'gi'), '([?&;](?:token)=)[^&#\s"''<>]*', '\1SCRUBBED', 'gi'),
  '[A-Za-z0-9+/_=-]{{16,}}--[A-Za-z0-9+/_=-]{{16,}}', 'SCRUBBED', 'g') AS text FROM a)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{EMAIL}', 'SCRUBBED', 'g'), '\b[0-9]{{1,2}}\.?[0-9]{{3}}\.?[0-9]{{3}}-[0-9kK]\b', 'SCRUBBED', 'g'),
  '(^|[^0-9])(?:\+?56\s?)?9\s?[0-9]{{4}}\s?[0-9]{{4}}($|[^0-9])', '\1SCRUBBED\2', 'g')) AS masked_md5, regexp_matches(text, '{EMAIL}') AS had_email FROM b""")
def p1_mask_patterns(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.concat(
        "text", F.lit(" RUT 12.345.678-k https://lh3.googleusercontent.com/a?b=1 /x?token=abc +56 9 "), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit(" 1234")).alias("text"))
    return docs.select("doc_id", F.md5(pr.mask_patterns(F.col("text"))).alias("masked_md5"), F.col("text").rlike(EMAIL).alias("had_email"))


def people(spark, folder):
    """Customers as people: a name with accents, a particle and their number, and an e-mail address."""
    k = F.col("c_custkey").cast("string")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("owner_id"), F.concat(F.lit("José del Ñandú"), k).alias("name"), F.concat(F.lit("p"), k, F.lit("@example.org")).alias("email"))


@query("p2_identity_variants", """
SELECT c_custkey AS owner_id, unnest(list_distinct(['jose del nandu' || c_custkey, 'jose-del-nandu' || c_custkey, 'jose_del_nandu' || c_custkey, 'jose.del.nandu' || c_custkey, 'josedelnandu' || c_custkey, 'jose',
  'nandu' || c_custkey, 'p' || c_custkey || '@example.org']) || CASE WHEN length('p' || c_custkey) >= 3 THEN ['p' || c_custkey] ELSE [] END) AS variant FROM customer""")
def p2_identity_variants(spark, folder):
    return people(spark, folder).select("owner_id", F.explode(pr.identity_variants(F.col("name"), F.col("email"))).alias("variant"))


def owned_documents(spark, folder):
    """Whole documents that name their owner in three spellings."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("JOSÉ DEL ÑANDÚ"), k, F.lit(": "), "text", F.lit(" (cv_jose-del-nandu"), k, F.lit(".pdf) Nandu"), k, F.lit("x p"), k, F.lit("@example.org"))
    return table(spark, folder, "documents").select("doc_id", F.col("doc_id").alias("owner_id"), text.alias("text"))


@query("p3_mask_identity", """
SELECT doc_id, md5(CASE WHEN c_custkey IS NULL THEN 'JOSÉ DEL ÑANDÚ' || doc_id || ': ' || text || ' (cv_jose-del-nandu' || doc_id || '.pdf) Nandu' || doc_id || 'x p' || doc_id || '@example.org'
  ELSE 'SCRUBBED: ' || text || ' (cv_SCRUBBED.pdf) Nandu' || doc_id || 'x SCRUBBED' END) AS masked_md5 FROM documents LEFT JOIN customer ON c_custkey = doc_id""")
def p3_mask_identity(spark, folder):
    docs = pr.with_identity(owned_documents(spark, folder), people(spark, folder), "owner_id")
    return docs.select("doc_id", F.md5(pr.mask_identity(F.col("text"), F.col("identity"))).alias("masked_md5"))


@query("p4_leak_audit", """
SELECT doc_id, c_custkey IS NOT NULL AND (doc_id % 3 = 0 OR doc_id % 7 = 0) AS leaked FROM documents LEFT JOIN customer ON c_custkey = doc_id""")
def p4_leak_audit(spark, folder):
    k = F.col("doc_id")
    s = k.cast("string")
    text = F.concat("text", F.when(k % 3 == 0, F.concat(F.lit(" Ñandú"), s)).otherwise(""), F.when(k % 7 == 0, F.concat(F.lit(" ?n=%C3%91andu"), s)).otherwise(""), F.lit(" josefina"))
    docs = table(spark, folder, "documents").select("doc_id", k.alias("owner_id"), text.alias("text"))
    return pr.leak_audit(pr.with_identity(docs, people(spark, folder), "owner_id")).select("doc_id", "leaked")


@query("p4_release", """
SELECT doc_id FROM documents LEFT JOIN customer ON c_custkey = doc_id WHERE NOT (c_custkey IS NOT NULL AND doc_id % 3 = 0)""")
def p4_release(spark, folder):
    k = F.col("doc_id")
    docs = table(spark, folder, "documents").select("doc_id", k.alias("owner_id"), F.concat("text", F.when(k % 3 == 0, F.concat(F.lit(" Ñandú"), k.cast("string"))).otherwise("")).alias("text"))
    return pr.release(pr.leak_audit(pr.with_identity(docs, people(spark, folder), "owner_id"))).select("doc_id")


@query("p5_scrub_pages", rf"""
SELECT page_id, length(html) - length(replace(html, '<p>', '')) AS p_tags, 0 AS scripts, 0 AS comments, 1 AS files, page_id % 5 = 0 AS leaked,
  '<div data-user-id="SCRUBBED">SCRUBBED <a download="cv-1.pdf" href="/p?n=SCRUBBED">SCRUBBED</a><input name="authenticity_token" value="SCRUBBED"></div>'
    || CASE WHEN page_id % 5 = 0 THEN '<i data-nandu' || page_id || '-x="1"></i>' ELSE '' END AS added,
  md5(regexp_replace(regexp_replace(regexp_replace(html, '{EMAIL}', 'SCRUBBED', 'g'), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&(?:copy|middot|quot|amp);?|&[#a-zA-Z0-9]+;', '', 'g'), '[^a-z ]', '', 'g')) AS words_md5 FROM pages""")
def p5_scrub_pages(spark, folder):
    """Whole pages with an owner's data added in text, attributes, a script, a comment and a file name; every
    fifth also carries a name in an attribute *name*, which only the audit can catch."""
    k = F.col("page_id")
    s = k.cast("string")
    extra = F.concat(
        F.lit('<div data-user-id="7">José Ñandú'), s, F.lit(' <a download="Mi CV.pdf" href="/p?n=%C3%91and%C3%BA'), s, F.lit('">p'), s, F.lit("@example.org</a><!-- nandu"), s,
        F.lit(' --><input name="authenticity_token" value="t"></div>'), F.when(k % 5 == 0, F.concat(F.lit("<i data-nandu"), s, F.lit('-x="1"></i>'))).otherwise(""))
    pages = table(spark, folder, "pages").select(
        "page_id", F.concat("html", extra).alias("html"), F.lit("/job_offers").alias("path"), F.concat(F.lit("José Ñandú"), s).alias("name"), F.concat(F.lit("p"), s, F.lit("@example.org")).alias("email"))
    out = F.col("scrubbed")
    count = lambda needle: (F.length(out) - F.length(F.replace(out, F.lit(needle), F.lit("")))).cast("bigint")
    at = F.instr(out, '<div data-user-id=')
    bare = F.regexp_replace(F.left(out, at - 1), r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>|&[#a-zA-Z0-9]+;", "")
    return pr.scrub_pages(pages).select(
        "page_id", F.substr(out, at).alias("added"), F.md5(F.regexp_replace(bare, "[^a-z ]", "")).alias("words_md5"), count("<p>").alias("p_tags"), count("track(").alias("scripts"), count("<!--").alias("comments"), (count("cv-1.pdf") / 8).cast("bigint").alias("files"), "leaked")


@query("p6_pseudonymise_files", """
WITH f AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, 'CV ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '.PDF' ELSE '.doc' END AS name FROM orders),
n AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS n FROM f GROUP BY doc_id, name)
SELECT doc_id, pos, 'cv-' || n || CASE WHEN name LIKE '%.PDF' THEN '.pdf' ELSE '.doc' END AS alias FROM f JOIN n USING (doc_id, name)""")
def p6_pseudonymise_files(spark, folder):
    name = F.concat(F.lit("CV "), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", ".PDF").otherwise(".doc"))
    files = table(spark, folder, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), name.alias("name"))
    return pr.pseudonymise_files(files).select("doc_id", "pos", "alias")


@query("p7_redact_secrets", r"""
SELECT doc_id, md5(regexp_replace(text, 'token = "[0-9a-f]{8,}"', 'token = "***"', 'g') || ' remember_user_token=***; ok') AS redacted_md5, regexp_matches(text, 'token = "') AS had_secret FROM documents""")
def p7_redact_secrets(spark, folder):
    """Every document is a log entry; the secrets known for it are the tokens it was issued."""
    secrets = F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{8,})"'), F.lit(1))
    line = F.concat("text", F.lit(" remember_user_token=abc"), F.col("doc_id").cast("string"), F.lit("; ok"))
    return table(spark, folder, "documents").select("doc_id", F.md5(pr.redact_secrets(line, secrets)).alias("redacted_md5"), F.contains("text", F.lit('token = "')).alias("had_secret"))
