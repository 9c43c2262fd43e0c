"""Queries about findings at their lines: what rules meet in code, outside comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.operators import findings, scan
from corpusguard.plans.registry import ORACLE_SQL, PLANTED_SQL, planted, query
from corpusguard.plans.scans import LOOKING, _quoted

_RULES = ", ".join(f"('{i}', '{s}', '{c}', '{w}', {_quoted(LOOKING.get(i, (p, ''))[0])}, {_quoted(LOOKING.get(i, (p, ''))[1])})" for i, s, c, p, w in scan.RULES)


def _met(text: str) -> str:
    """How many matches of a rule a text has."""
    return f"CASE WHEN unless = '' THEN len(regexp_extract_all({text}, pattern, 0, 'i')) ELSE len(list_filter(regexp_extract_all({text}, pattern, 1, 'i'), lambda x: NOT regexp_matches(x, unless, 'i'))) END"


#: Matches line by line: all of a line's but those after a comment's mark.
SCANNED_SQL = (
    PLANTED_SQL
    + f""", patterns AS (SELECT * FROM (VALUES {_RULES}) AS v(rule_id, severity, category, weakness, pattern, unless)),
    numbered AS (SELECT path, doc_id, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10)))))::INTEGER + 1 AS line FROM planted),
    counted AS (SELECT path, line, text, rule_id, severity, category, weakness, {_met('text')} - CASE WHEN contains(text, '//') THEN {_met("substr(text, instr(text, '//') + 2)")} ELSE 0 END AS n FROM numbered, patterns),
    scanned AS (
        SELECT path, rule_id, severity, category, line, substr(trim(text, E' \\t\\r'), 1, 120) AS snippet, CASE WHEN weakness = '' THEN '' ELSE weakness END AS cwe_id, unnest(range(n)) AS nth FROM counted WHERE n > 0
    ), located AS (
        SELECT *, 'SCAN-' || substr(sha256('scan:' || rule_id || ':' || path || ':' || line), 1, 12) AS id, sha256(rule_id || ':' || path || ':' || line || ':' || substr(snippet, 1, 50)) AS fingerprint FROM scanned
    )"""
)

# the scan of scans.py
ORACLE_SQL["rule_scan"] = f"WITH {SCANNED_SQL} SELECT path, rule_id, severity, category, line, snippet, cwe_id FROM scanned"


def _located(spark, sf_dir):
    return findings.unified(scan.rule_scan(planted(spark, sf_dir)), "scan")


@query(f"WITH {SCANNED_SQL} SELECT id, rule_id, severity, category, cwe_id, path, line, snippet, fingerprint FROM located")
def located_findings(spark, sf_dir):
    """What the scan finds, as findings with line and snippet."""
    return _located(spark, sf_dir).select("id", "rule_id", "severity", "category", "cwe_id", "path", "line", "snippet", "fingerprint")


@query(f"WITH {SCANNED_SQL} SELECT fingerprint, count(*) AS times, min(path) AS path, min(line) AS line FROM located GROUP BY fingerprint")
def located_dedupe(spark, sf_dir):
    """A rule that meets a line twice, or lines that begin alike at one place, are one finding."""
    rows = _located(spark, sf_dir)
    first = findings.deduplicated(rows.withColumn("seq", F.xxhash64("id")))
    times = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("times"))
    return first.join(times, "fingerprint").select("fingerprint", "times", "path", "line")


@query(
    f"""WITH {SCANNED_SQL}, b AS (SELECT id, path, line, 'scan' AS source FROM located UNION ALL SELECT 'R' || id, path, line, 'runtime' FROM located WHERE severity = 'CRITICAL'),
    s AS (SELECT path, line, list_sort(list(DISTINCT source)) AS sources FROM b GROUP BY path, line)
    SELECT id, path, line, array_to_string(list_filter(sources, lambda x: x <> source), ',') AS others, CASE WHEN len(sources) > 1 THEN 'CONFIRMED' ELSE 'MEDIUM' END AS confidence FROM b JOIN s USING (path, line)"""
)
def located_corroboration(spark, sf_dir):
    """Two sources confirm each other where they meet on a line, not elsewhere in the file."""
    sources = F.when(F.col("severity") == "CRITICAL", F.array(F.lit("scan"), F.lit("runtime"))).otherwise(F.array(F.lit("scan")))
    rows = _located(spark, sf_dir).withColumn("source", F.explode(sources))
    rows = rows.withColumn("id", F.when(F.col("source") == "runtime", F.concat(F.lit("R"), "id")).otherwise(F.col("id")))
    return findings.corroborated(rows).select("id", "path", "line", F.array_join("corroborated_by", ",").alias("others"), "confidence")
