"""Queries about sensitive data as findings, standards of findings, policies of directories, and reports of other tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.catalogs import files as file_catalog
from corpusguard.catalogs import rules as catalog
from corpusguard.operators import findings, investigation, manifest, scan
from corpusguard.plans.registry import ORACLE_SQL, PLANTED_SQL, files, planted, query
from corpusguard.plans.scans import LINES_SQL, UNIFIED_SQL, _findings, _quoted
from corpusguard.sources import interop

LUHN_SQL = (
    "list_sum(list_transform(range(len(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[i + 1]::INTEGER WHEN digits[i + 1]::INTEGER > 4 THEN digits[i + 1]::INTEGER * 2 - 9 ELSE digits[i + 1]::INTEGER * 2 END)) % 10 = 0"
)


def _plain(pattern: str) -> str:
    """A pattern for an engine without lookaround, which the one that uses it has for digits around nine."""
    return pattern.replace(r"(?<!\d)(\d{9})(?!\d)", r"(?:^|\D)(\d{9})(?:\D|$)")


#: Every match of every kind; one whose text lies in a match of an earlier kind on its line gives way, as do cards that fail the check digit.
SENSITIVE_SQL = (
    LINES_SQL
    + ", kinds AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{t}', '{c}', '{s}', {str(h).lower()}, {_quoted(_plain(p))})" for i, (t, c, s, h, p) in enumerate(catalog.SENSITIVE))
    + """) AS v(rank, data_type, category, severity, hipaa, pattern)), every_match AS (
        SELECT path, line, text, rank, data_type, category, severity, hipaa, unnest(regexp_extract_all(text, pattern, 1, 'i')) AS value FROM lines, kinds
    ), checked AS (
        SELECT *, list_reverse(string_split(regexp_replace(value, '[^0-9]', '', 'g'), '')) AS digits FROM every_match
    ), valid AS (SELECT * FROM checked WHERE NOT starts_with(data_type, 'credit_card') OR """
    + LUHN_SQL
    + """), sensitive AS (
        SELECT path, line, data_type, category, severity, hipaa, length(value)::INTEGER AS length
        FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid e WHERE e.path = v.path AND e.line = v.line AND e.rank < v.rank AND contains(e.value, v.value))
    )"""
)


def _sensitive(spark, sf_dir):
    return scan.sensitive_scan(scan.lines_of(files(spark, sf_dir)))


@query(f"WITH {SENSITIVE_SQL} SELECT path, line, data_type, category, severity, hipaa, length FROM sensitive")
def sensitive_findings(spark, sf_dir):
    """Every match of sensitive data."""
    return _sensitive(spark, sf_dir).drop("column", "snippet")


@query(
    f"""WITH {SENSITIVE_SQL} SELECT path, line, data_type AS rule_id, 'Sensitive data: ' || data_type AS title, severity, 'sensitive_' || lower(category) AS category, hipaa,
        CASE severity WHEN 'CRITICAL' THEN 'conclusive' WHEN 'HIGH' THEN 'suspicious' WHEN 'MEDIUM' THEN 'suspicious' ELSE 'informational' END AS conclusiveness,
        'Review ' || data_type || ' exposure in ' || path || ':' || line || '. Redact or protect.' AS recommendation FROM sensitive"""
)
def sensitive_investigated(spark, sf_dir):
    return investigation.from_sensitive(_sensitive(spark, sf_dir)).select("path", "line", "rule_id", "title", "severity", "category", "hipaa", "conclusiveness", "recommendation")


def _cases(column: str, values: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v) if isinstance(v, str) else v}" for k, v in values.items()) + f" ELSE {default} END"


@query(
    f"""WITH {UNIFIED_SQL}, t AS (SELECT id, {_cases('rule_id', catalog.TECHNIQUES)} AS technique, ({_cases('rule_id', catalog.SCORES)})::DOUBLE AS score FROM findings)
    SELECT id, technique, {_cases('technique', catalog.TECHNIQUE_NAMES)} AS technique_name, score FROM t"""
)
def finding_standards(spark, sf_dir):
    return findings.with_standards(_findings(spark, sf_dir)).select("id", "technique", "technique_name", "score")


#: Weaknesses with a mitigation, as a weakness table has them.
MITIGATIONS = [("CWE-94", "Code Injection", "Do not build code from input."), ("89", "SQL Injection", "Bind values."), ("CWE-502", "Deserialization of Untrusted Data", None), ("CWE-78", None, "Do not call a shell.")]


@query(
    f"""WITH {UNIFIED_SQL}, f AS (SELECT id, rule_id, severity, {_cases('rule_id', catalog.WEAKNESSES, "''")} AS cwe FROM findings),
    k AS (SELECT * FROM (VALUES ('CWE-94', 'Code Injection', 'Do not build code from input.'), ('CWE-89', 'SQL Injection', 'Bind values.'), ('CWE-502', 'Deserialization of Untrusted Data', NULL), ('CWE-78', NULL, 'Do not call a shell.')) v(cwe, name, mitigation))
    SELECT id, coalesce(name, '') AS cwe_name, CASE WHEN severity = 'HIGH' THEN 'Look at ' || rule_id ELSE coalesce(mitigation, '') END AS recommendation FROM f LEFT JOIN k USING (cwe)"""
)
def weakness_backfill(spark, sf_dir):
    """Names of weaknesses, and what to do about them where the finding does not say."""
    rows = findings.enriched(_findings(spark, sf_dir)).drop("cwe_name").withColumn("recommendation", F.when(F.col("severity") == "HIGH", F.concat(F.lit("Look at "), "rule_id")).otherwise(""))
    table = spark.createDataFrame(MITIGATIONS, "cwe_id string, name string, mitigation string")
    return findings.with_weaknesses(rows, table).select("id", "cwe_name", "recommendation")


def _static(spark, sf_dir):
    """Results of a static analyser made from lines: rules are the first words that they hold."""
    words = [word for word, _ in catalog.STATIC_CATEGORIES] + ["system", "directory"]
    lines = scan.lines_of(planted(spark, sf_dir)).where(F.col("text") != "")
    rule = F.coalesce(*[F.when(F.lower("text").contains(w), w) for w in words], F.concat(F.lit("line-"), (F.col("line") % 7).cast("string")))
    level = F.get(F.array(*map(F.lit, ["error", "warning", "note", "none", "odd"])), (F.length("text") % 5).cast("int"))
    return lines.select(rule.alias("rule_id"), level.alias("level"), F.col("path").alias("uri"), F.col("line").alias("start_line"), F.substring("text", 1, 90).alias("message"), F.lit("").alias("cwe_id"))


STATIC_WORDS = [word for word, _ in catalog.STATIC_CATEGORIES] + ["system", "directory"]
STATIC_SQL = (
    PLANTED_SQL
    + ", l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10)))))::INTEGER + 1 AS line FROM planted), r AS (SELECT path, line, CASE "
    + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in STATIC_WORDS)
    + " ELSE 'line-' || line % 7 END AS rule_id, ['HIGH', 'MEDIUM', 'LOW', 'INFO', 'MEDIUM'][length(text) % 5 + 1] AS severity, substr(text, 1, 90) AS message FROM l WHERE text <> ''), t AS (SELECT *, lower(rule_id || ' ' || message) AS said FROM r)"
)


@query(
    f"""WITH {STATIC_SQL}, u AS (
        SELECT *, CASE {' '.join(f"WHEN contains(said, '{w}') THEN '{c}'" for w, c in catalog.STATIC_CATEGORIES)} ELSE 'security' END AS category,
            coalesce({_cases('rule_id', catalog.STATIC_RULE_TECHNIQUES)}, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(said, '{w}')" for w in ws) + f" THEN '{t}'" for ws, t in catalog.STATIC_TECHNIQUES)} END) AS technique FROM t
    ) SELECT path, line, rule_id, severity, category, technique, {_cases('technique', catalog.TECHNIQUE_NAMES)} AS technique_name,
        nullif(({_cases('severity', file_catalog.SEVERITY_SCORES)})::DOUBLE, 0) AS score, '[Static] ' || message AS title FROM u"""
)
def static_findings(spark, sf_dir):
    """Every line as the result of a static analyser, with category, technique and score."""
    return findings.from_static_sarif(_static(spark, sf_dir), "static").select("path", "line", "rule_id", "severity", "category", "technique", "technique_name", "score", "title")


SARIF_FIELDS = {
    "rule_id": "$.ruleId", "level": "$.level", "message": "$.message.text", "uri": "$.locations[0].physicalLocation.artifactLocation.uri", "start_line": "$.locations[0].physicalLocation.region.startLine",
    "snippet": "$.locations[0].physicalLocation.region.snippet.text", "end_line": "$.locations[0].physicalLocation.region.endLine", "category": "$.properties.category",
    "technique": "$.properties.mitre_attack.technique_id", "score": "$.properties.cvss.base_score", "cwe": "$.taxa[0].id", "confidence": "$.properties.confidence", "others": "$.properties.corroborated_by[0]",
}


@query(
    f"""WITH {STATIC_SQL}, u AS (
        SELECT *, CASE {' '.join(f"WHEN contains(said, '{w}') THEN '{c}'" for w, c in catalog.STATIC_CATEGORIES)} ELSE 'security' END AS category,
            coalesce({_cases('rule_id', catalog.STATIC_RULE_TECHNIQUES)}, CASE {' '.join('WHEN ' + ' OR '.join(f"contains(said, '{w}')" for w in ws) + f" THEN '{t}'" for ws, t in catalog.STATIC_TECHNIQUES)} END) AS technique FROM t
    ) SELECT rule_id, CASE severity WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END AS level, '[Static] ' || message AS message, path AS uri, line::VARCHAR AS start_line,
        message AS snippet, CASE WHEN line % 2 = 0 THEN (line + 1)::VARCHAR END AS end_line, category, technique, CASE severity WHEN 'HIGH' THEN '8.0' WHEN 'MEDIUM' THEN '5.5' WHEN 'LOW' THEN '3.0' END AS score,
        CASE WHEN line % 3 = 0 THEN '79' END AS cwe, 'HIGH' AS confidence, CASE WHEN line % 5 = 0 THEN 'runtime' END AS others FROM u"""
)
def sarif_full_export(spark, sf_dir):
    """The same results exported whole, and read again from the JSON."""
    n = F.col("line")
    rows = findings.from_static_sarif(_static(spark, sf_dir), "static").withColumns({
        "line_end": F.when(n % 2 == 0, n + 1).otherwise(0), "cwe_id": F.when(n % 3 == 0, "CWE-79").otherwise(""), "cwe_name": F.lit("Cross-site Scripting"),
        "corroborated_by": F.when(n % 5 == 0, F.array(F.lit("runtime"))).otherwise(F.array().cast("array<string>")),
    })
    sarif = rows.select(interop.sarif_full_result(rows).alias("sarif"))
    return sarif.select(*[F.get_json_object("sarif", path).alias(name) for name, path in SARIF_FIELDS.items()])


TYPED_SQL = (
    PLANTED_SQL
    + """, typed AS (SELECT path, CASE WHEN doc_id % 6 = 0 AND doc_id % 4 = 0 THEN 'png' WHEN doc_id % 5 = 4 THEN 'gzip' WHEN contains(content, '<?php') OR contains(content, '<?=') THEN 'php'
        WHEN regexp_matches(content, '<!doctype html|<html', 'i') THEN 'html' WHEN content = '' THEN 'empty' ELSE 'txt' END AS label, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext_label FROM planted),
    matched AS (SELECT *, CASE ext_label WHEN 'php' THEN label = 'php' WHEN 'html' THEN label = 'html' WHEN 'txt' THEN label IN ('txt', 'empty') WHEN 'js' THEN label = 'txt' WHEN 'md' THEN label = 'txt' ELSE true END AS is_match FROM typed)"""
)


@query(
    f"""WITH {TYPED_SQL} SELECT path, label, ext_label, is_match, CASE WHEN is_match THEN 'none' WHEN label = 'php' AND ext_label <> 'php' THEN 'critical' WHEN label IN ('zip', 'html') THEN 'suspicious' ELSE 'info' END AS mismatch_severity FROM matched"""
)
def content_types_of_all(spark, sf_dir):
    """All extensions of the catalog; some files begin with the bytes of an image or an archive."""
    n = F.col("doc_id")
    head = F.when((n % 6 == 0) & (n % 4 == 0), F.unhex(F.lit("89504E47"))).when(n % 5 == 4, F.unhex(F.lit("1F8B08"))).otherwise(F.unhex(F.lit("")))
    return findings.content_types(planted(spark, sf_dir).withColumn("content", F.concat(head, "content")))


@query(
    f"""WITH {PLANTED_SQL}, g AS (SELECT path FROM planted WHERE path LIKE '%.php'), s AS (SELECT DISTINCT split_part(path, '/', 2) AS source FROM planted)
    SELECT 'src/' || split_part(g.path, '/', 2) AS directory, 'forbidden_file' AS type, 'CRITICAL' AS severity, g.path, 'Size: ' || octet_length(encode(content)) || ' bytes' AS detail
    FROM g JOIN planted ON g.path = planted.path
    UNION ALL SELECT 'src/' || source, 'missing_htaccess', 'HIGH', 'src/' || source || '/.htaccess', '' FROM s WHERE source[-1:]::INTEGER % 3 = 0
    UNION ALL SELECT 'src/' || source, 'htaccess_tampered', 'CRITICAL', 'src/' || source || '/.htaccess', 'missing engine off' FROM s WHERE source[-1:]::INTEGER % 3 = 1"""
)
def directory_policies(spark, sf_dir):
    """A policy for each source: no ``.php`` below, and a guard that turns the engine off; a third have none and a third an altered one."""
    rows = planted(spark, sf_dir).select("path", "content")
    sources = rows.select(F.regexp_extract("path", "^(src/[^/]+)/", 1).alias("directory")).distinct()
    last = F.substring("directory", -1, 1).cast("int") % 3
    text = F.when(last == 2, "php_flag engine off\n").otherwise("Allow from all\n")
    guards = sources.where(last != 0).select(F.concat("directory", F.lit("/.htaccess")).alias("path"), text.cast("binary").alias("content"))
    policies = sources.select("directory", F.array(F.lit(".php")).alias("forbidden"), F.lit(True).alias("guarded"), F.lit("engine off").alias("must_contain"))
    return scan.critical_directories(rows.unionByName(guards), policies)


@query(f"WITH {PLANTED_SQL} SELECT path, doc_id % 4 < 3 AND NOT (doc_id % 4 = 2 AND doc_id % 6 = 5) AS scanned FROM named_files".replace("named_files", "(SELECT doc_id, path || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/.user.ini' WHEN 2 THEN '' ELSE '.bin' END AS path FROM planted)"))
def sensitive_scannable(spark, sf_dir):
    """Which files the scan for sensitive data reads, by their names."""
    n = F.col("doc_id") % 4
    path = F.concat("path", F.when(n == 1, "/.user.ini").when(n == 3, ".bin").otherwise(""))
    return planted(spark, sf_dir).select(path.alias("path"), scan.sensitive_scannable(path).alias("scanned"))


@query(
    f"""WITH {PLANTED_SQL}, a AS (SELECT path, contains(content, '<?php') OR contains(content, '<?=') AS code FROM (SELECT path, encode(content)[1:16384] AS head, content FROM planted))
    SELECT 'poisoned_logs' AS field, 'php_code_in_log_file' AS anomaly, path FROM a WHERE code AND path LIKE '%.log' AND path IN (SELECT path FROM planted WHERE octet_length(encode(content)) <= 16000)"""
)
def anomaly_paths(spark, sf_dir):
    """The paths that the anomaly report lists as logs with code, of files of 16,000 bytes at most, whose head is all of them."""
    rows = planted(spark, sf_dir).where(F.length("content") <= 16_000)
    return manifest.anomaly_paths(manifest.manifest(rows)).where("field = 'poisoned_logs'")


# the reports of scans.py over the same matches
ORACLE_SQL["pii_report"] = f"WITH {SENSITIVE_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS key, {k} AS value, count(*) AS n FROM sensitive GROUP BY {k}" for k in ("data_type", "category", "severity"))
ORACLE_SQL["hipaa_summary"] = f"WITH {SENSITIVE_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE hipaa) AS hipaa, CASE WHEN count(*) = 0 THEN 0.0 ELSE round(100.0 * count(*) FILTER (WHERE hipaa) / count(*), 1) END::DOUBLE AS percent FROM sensitive"
