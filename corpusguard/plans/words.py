"""Queries that meet very many words or globs with the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.functions.matching import with_globs
from corpusguard.operators import keywords, scan
from corpusguard.plans.registry import FILES_SQL, files, query, table
from corpusguard.plans.scans import LINES_SQL

RELATED_SQL = (
    LINES_SQL
    + """, findings AS (SELECT path || ':' || line AS id, lower(text || '  ' || split_part(path, '/', 2)) AS text, 'IOC-' || line % 50 AS ioc FROM lines),
    words AS (SELECT DISTINCT item_id, lower(unnest(list_filter(regexp_split_to_array(text, '[\\s,./\\\\]+'), lambda w: length(w) > 3))) AS word FROM benchmark),
    related AS (
        SELECT id, 'AV-' || item_id AS vector FROM findings JOIN words ON contains(findings.text, word)
        UNION SELECT id, 'AV-' || item_id FROM findings JOIN benchmark ON ioc = 'IOC-' || item_id % 97
    )"""
)


def _findings_and_vectors(spark, sf_dir):
    """Every line as a finding, every benchmark item as a vector with its words and an indicator."""
    lines = scan.lines_of(files(spark, sf_dir))
    findings = lines.select(
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("description"),
        F.split("path", "/")[1].alias("category"), F.array(F.concat(F.lit("IOC-"), (F.col("line") % 50).cast("string"))).alias("ioc_ids"),
    )
    item = F.col("item_id")
    vectors = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("AV-"), item.cast("string")).alias("vector"), F.array("text").alias("artifacts"), F.lit(None).cast("array<string>").alias("patterns"),
        F.array(F.concat(F.lit("IOC-"), (item % 97).cast("string"))).alias("iocs"),
    )
    return findings, vectors


@query(f"WITH {RELATED_SQL} SELECT id, vector FROM related")
def vectors_related(spark, sf_dir):
    return keywords.vectors_related(*_findings_and_vectors(spark, sf_dir))


@query(f"WITH {RELATED_SQL} SELECT 'AV-' || item_id AS vector, count(id) AS findings FROM benchmark LEFT JOIN related ON vector = 'AV-' || item_id GROUP BY item_id")
def vectors_hit(spark, sf_dir):
    findings, vectors = _findings_and_vectors(spark, sf_dir)
    return keywords.vectors_hit(keywords.vectors_related(findings, vectors), vectors, each_once=True)


SYNERGY_SQL = (
    FILES_SQL
    + """, code AS (SELECT path AS id, lower(replace(content, ' ', '-')) AS text, doc_id % 9 = 0 AS confirmed FROM files),
    flaws AS (SELECT item_id, lower('Flaw in (' || split_part(text, ' ', 1) || '-' || split_part(text, ' ', 2) || '), ' || split_part(text, ' ', 3) || '/' || split_part(text, ' ', 4) || ': ' || text) AS text FROM benchmark),
    components AS (
        SELECT DISTINCT trim(w, '.:,()') AS component FROM (SELECT unnest(regexp_split_to_array(text, '\\s+')) AS w FROM flaws) WHERE (contains(w, '/') OR contains(w, '-')) AND trim(w, '.:,()') <> ''
    ), named AS (SELECT id, any_value(confirmed) AS confirmed, min(component) AS component FROM code JOIN components ON contains(code.text, component) GROUP BY id),
    related AS (SELECT component, item_id FROM (SELECT DISTINCT component FROM named) JOIN flaws ON contains(flaws.text, component))"""
)


def _synergy(spark, sf_dir):
    """Documents as code whose words are joined by hyphens, and flaws of components named by the first words of benchmark items."""
    rows = files(spark, sf_dir)
    code = rows.select(
        F.col("path").alias("id"), F.regexp_replace(F.col("content").cast("string"), " ", "-").alias("snippet"), F.lit(None).cast("string").alias("description"),
        F.when(F.col("doc_id") % 9 == 0, "CONFIRMED").otherwise("MEDIUM").alias("confidence"),
    )
    words = F.split("text", " ")
    word = lambda n: F.coalesce(F.get(words, F.lit(n)), F.lit(""))
    flaw = F.concat(F.lit("Flaw in ("), word(0), F.lit("-"), word(1), F.lit("), "), word(2), F.lit("/"), word(3), F.lit(": "), "text")
    flaws = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("F"), F.col("item_id").cast("string")).alias("id"), flaw.alias("description"))
    return keywords.dependency_synergy(code, flaws)


@query(
    f"""WITH {SYNERGY_SQL}, n AS (SELECT component, count(*) AS n_related FROM related GROUP BY component)
    SELECT id, component, n_related, CASE WHEN confirmed THEN 'CONFIRMED' ELSE 'HIGH' END AS confidence FROM named JOIN n USING (component)"""
)
def dependency_synergy(spark, sf_dir):
    return _synergy(spark, sf_dir)[0]


@query(f"WITH {SYNERGY_SQL} SELECT id, 'F' || item_id AS related_id FROM named JOIN related USING (component) WHERE confirmed")
def dependency_related(spark, sf_dir):
    """The flaws related to the confirmed findings."""
    named, related = _synergy(spark, sf_dir)
    return keywords.related_to(named.where("confidence = 'CONFIRMED'"), related)


@query(
    f"""WITH {FILES_SQL} SELECT path, 'D' || doc_id AS ioc_id FROM files
    UNION ALL SELECT path, 'S-' || split_part(path, '/', 2) FROM files WHERE regexp_matches(path, '(\\.php|\\.js|/.e_[0-9]*\\.md)$')
    UNION ALL SELECT path, 'deep' FROM files WHERE regexp_matches(path, '1.\\.(txt|log)$')"""
)
def glob_table(spark, sf_dir):
    """A glob for each document and each source, and one for all."""
    rows = files(spark, sf_dir).select("doc_id", "path", F.split("path", "/")[1].alias("source"))
    own = rows.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("ioc_id"), F.concat(F.lit("**/"), F.regexp_extract("path", r"([^/.]+)\.[a-z]+$", 1), F.lit(".*")).alias("glob"))
    of_source = rows.select(F.concat(F.lit("S-"), "source").alias("ioc_id"), F.concat(F.lit("src/"), "source", F.lit("/*.{php,js}|src/"), "source", F.lit("/?e_*.md")).alias("glob")).distinct()
    deep = spark.createDataFrame([("deep", "src/**/*1?.{txt,log}")], "ioc_id string, glob string")
    return with_globs(rows.select("path"), F.col("path"), own.union(of_source).union(deep))
