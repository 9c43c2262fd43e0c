"""Queries about investigations: indicators, findings of other tools, database artifacts, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.catalogs import rules as catalog
from corpusguard.functions import columns as C
from corpusguard.functions.session import new_folder
from corpusguard.operators import diff, findings, investigation, manifest, rollup, scan, web
from corpusguard.plans.registry import FILES_SQL, PLANTED_SQL, SNAPSHOTS_SQL, files, planted, query, snapshots, table
from corpusguard.plans.reports import NAMED_SQL, _named
from corpusguard.plans.scans import HITS_SQL, LINES_SQL, UNIFIED_SQL, _findings, _quoted
from corpusguard.plans.snapshots import FIRST_CATEGORY
from corpusguard.sources import interop, sinks

PLANTED_LINES_SQL = PLANTED_SQL + ", l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10)))))::INTEGER + 1 AS line FROM planted)"


def _matches_sql(patterns, named: str, shown: str, size: int) -> str:
    """A row for each match of patterns that stay within a line; what looks behind is matched instead."""
    values = ", ".join(f"({_quoted(n)}, {_quoted(p.replace('(?<![\\w$>:\\\\])', '(?:^|[^\\w$>:\\\\])'))})" for n, p in patterns)
    return f"""WITH {PLANTED_LINES_SQL}, p AS (SELECT * FROM (VALUES {values}) v({named}, pattern)), m AS (
        SELECT path, {named}, line, trim(text)[1:{size}] AS {shown}, unnest(range(len(regexp_extract_all(text, '(?i)' || pattern)))) FROM l, p
    ) SELECT path, {named}, line, {shown} FROM m"""


@query(_matches_sql(catalog.DANGEROUS_PATTERNS, "type", "snippet", 80))
def dangerous_calls(spark, sf_dir):
    return investigation.dangerous_calls(planted(spark, sf_dir))


IOC_PATTERNS = {"IOC-PASS": r"hunter2\w+", "IOC-REQ": r"\$_(?:GET|POST)", "IOC-CFG": r"auto_(?:prepend|append)_file"}


@query(_matches_sql(IOC_PATTERNS.items(), "ioc_id", "text", 120))
def ioc_content(spark, sf_dir):
    return investigation.content_indicators(planted(spark, sf_dir), IOC_PATTERNS)


@query(f"WITH {FILES_SQL} SELECT path, 'IOC-H' AS ioc_id, sha256(content) AS sha256 FROM files WHERE path LIKE 'src/src1/%' AND regexp_matches(path, '\\.(php|js)$')")
def ioc_hashes(spark, sf_dir):
    return investigation.hash_indicators(files(spark, sf_dir), {"IOC-H": "src/src1/*.{php,js}"})


def _images(spark, sf_dir):
    rows = planted(spark, sf_dir)
    return rows.withColumn("path", F.when(F.col("doc_id") % 4 < 2, F.concat("path", F.lit(".jpg"))).otherwise(F.col("path")))


@query(f"WITH {PLANTED_SQL} SELECT path || '.jpg' AS path FROM planted WHERE doc_id % 4 < 2 AND contains(content, '<?')")
def ioc_polyglot(spark, sf_dir):
    return investigation.polyglot_images(_images(spark, sf_dir))


@query(
    f"""WITH {PLANTED_LINES_SQL}
    SELECT path, 'A' AS ioc_id, 'file_exists' AS method, 0 AS line, '' AS detail FROM planted WHERE path LIKE '%.php'
    UNION ALL SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1), 'B', 'directory_exists', 0, '' FROM planted WHERE regexp_matches(path, '^src/src1[0-9]*/')
    UNION ALL SELECT path, 'C', 'file_content', line, trim(text)[1:120] FROM l WHERE regexp_matches(text, 'hunter2\\w+', 'i')
    UNION ALL SELECT path, 'D', 'file_location', 0, 'src3' FROM planted WHERE path LIKE 'src/src3/%' AND path LIKE '%.php'
    UNION ALL SELECT path, 'F', 'hash_compare', 0, sha256(content) FROM planted WHERE path LIKE 'src/src2/%' AND path LIKE '%.js'"""
)
def ioc_dispatch(spark, sf_dir):
    catalogue = [
        {"id": "A", "method": "file_exists", "value": "**/*.php"}, {"id": "B", "method": "directory_exists", "value": "src/src1*"}, {"id": "C", "method": "regex", "value": r"hunter2\w+"},
        {"id": "D", "method": "file_location", "value": {"src3": [".php"]}}, {"id": "E", "method": "content_check"}, {"id": "F", "method": "hash_compare", "value": "src/src2/*.js"},
        {"id": "G", "method": "structure_validation"},
    ]
    return investigation.indicators(planted(spark, sf_dir), catalogue)


MATCHES_SQL = FILES_SQL + ", matches AS (SELECT path AS target, ['php_webshell', 'Big_Exploit_x', 'plain', 'SuspiciousCodeSignature'][(doc_id % 4 + 1)::INTEGER] AS rule FROM files)"


def _matches(spark, sf_dir):
    rule = F.get(F.array(*map(F.lit, ["php_webshell", "Big_Exploit_x", "plain", "SuspiciousCodeSignature"])), (F.col("doc_id") % 4).cast("int"))
    return files(spark, sf_dir).select(F.col("path").alias("target"), rule.alias("rule"))


@query(f"WITH {MATCHES_SQL} SELECT 'YARA-' || substr(sha256('yara:YARA-' || rule || ':' || target || ':0'), 1, 12) AS id, 'YARA-' || rule AS rule_id, 'HIGH' AS severity, 'HIGH' AS confidence, target AS path, 'T1505.003' AS technique FROM matches")
def normalize_signatures(spark, sf_dir):
    return investigation.from_signatures(_matches(spark, sf_dir)).select("id", "rule_id", "severity", "confidence", "path", "technique")


@query(f"WITH {MATCHES_SQL} SELECT rule AS rule_id, target AS path, 'external_tool' AS source, 'HIGH' AS severity, 'suspicious' AS conclusiveness FROM matches")
def signatures_investigated(spark, sf_dir):
    return investigation.signatures_investigated(_matches(spark, sf_dir)).select("rule_id", "path", "source", "severity", "conclusiveness")


@query(f"WITH {MATCHES_SQL} SELECT count(*) AS matches, count(*) FILTER (WHERE rule IN ('php_webshell', 'SuspiciousCodeSignature')) AS critical, count(*) FILTER (WHERE rule IN ('php_webshell', 'Big_Exploit_x')) AS high FROM matches")
def signature_tiers(spark, sf_dir):
    return investigation.signature_tiers(_matches(spark, sf_dir))


DEPENDENCY_SQL = (
    FILES_SQL
    + """, d AS (SELECT CASE WHEN doc_id % 11 <> 0 THEN path END AS path, doc_id, unnest(CASE WHEN doc_id % 4 = 0 THEN [9.1, 2.5] WHEN doc_id % 7 = 0 THEN [9.1] ELSE [0.0] END)::DOUBLE AS given, CASE doc_id % 3 WHEN 0 THEN 'CVE-2024-' || doc_id % 100 WHEN 1 THEN 'GHSA-' || doc_id % 50 ELSE 'generic-secret' END AS rule_id,
        CASE WHEN doc_id % 5 = 0 THEN 'CRITICAL' WHEN doc_id % 5 = 1 THEN 'INFO' ELSE ['HIGH', 'MEDIUM', 'LOW', 'INFO'][(doc_id % 4 + 1)::INTEGER] END AS severity FROM files),
    dependencies AS (SELECT path, rule_id, severity, CASE WHEN rule_id LIKE 'generic%' THEN 'secret_exposure' ELSE 'dependency_vulnerability' END AS category,
        CASE WHEN rule_id LIKE 'generic%' THEN '' ELSE rule_id END AS cve_id, CASE WHEN rule_id LIKE 'generic%' THEN 'T1552.001' ELSE 'T1195.001' END AS technique,
        CASE WHEN given > 0 THEN given WHEN rule_id LIKE 'generic%' THEN NULL ELSE CASE severity WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 8.0 WHEN 'MEDIUM' THEN 5.5 WHEN 'LOW' THEN 3.0 ELSE 0.0 END END::DOUBLE AS score FROM d)"""
)


def _dependencies(spark, sf_dir):
    """Results of a dependency scanner: some without a path, some twice with another score."""
    n = F.col("doc_id")
    rule = F.when(n % 3 == 0, F.concat(F.lit("CVE-2024-"), (n % 100).cast("string"))).when(n % 3 == 1, F.concat(F.lit("GHSA-"), (n % 50).cast("string"))).otherwise("generic-secret")
    level = F.get(F.array(*map(F.lit, ["error", "warning", "note", "none"])), (n % 4).cast("int"))
    given = F.when(n % 5 == 0, "critical").when(n % 5 == 1, "UNKNOWN").when(n % 5 == 2, "unheard of")
    rows = files(spark, sf_dir).select(
        rule.alias("rule_id"), level.alias("level"), F.lit("").alias("message"), F.when(n % 11 != 0, F.col("path")).alias("uri"), F.lit(0).alias("start_line"), F.lit("").alias("cwe_id"),
        given.alias("given_severity"), F.explode(F.when(n % 4 == 0, F.array(F.lit(9.1), F.lit(2.5))).otherwise(F.array(F.when(n % 7 == 0, 9.1)))).alias("given_score"),
    )
    return investigation.from_dependencies(rows)


@query(f"WITH {DEPENDENCY_SQL} SELECT path, rule_id, severity, category, cve_id, technique, score FROM dependencies")
def normalize_dependencies(spark, sf_dir):
    return _dependencies(spark, sf_dir).select("path", "rule_id", "severity", "category", "cve_id", "technique", "score")


@query(f"WITH {DEPENDENCY_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE cve_id <> '') AS cves, count(*) FILTER (WHERE cve_id = '') AS secrets, count(DISTINCT nullif(cve_id, '')) AS distinct_cves FROM dependencies")
def dependency_split(spark, sf_dir):
    return investigation.dependency_split(_dependencies(spark, sf_dir))


INVESTIGATED_SQL = UNIFIED_SQL + ", investigated AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 'conclusive' WHEN 'HIGH' THEN 'suspicious' ELSE 'informational' END AS conclusiveness FROM findings)"


def _investigated(spark, sf_dir):
    rows = scan.rule_hits(planted(spark, sf_dir)).select("*", F.lit(1).alias("line"), F.col("category").alias("snippet"), F.lit("").alias("cwe_id"))
    return investigation.investigation(rows, "scan")


@query(f"WITH {INVESTIGATED_SQL} SELECT id, severity, conclusiveness FROM investigated")
def investigated_findings(spark, sf_dir):
    return _investigated(spark, sf_dir).select("id", "severity", "conclusiveness")


@query(
    f"""WITH {INVESTIGATED_SQL}, c AS (SELECT count(*) FILTER (WHERE conclusiveness = 'conclusive') AS conclusive, count(*) FILTER (WHERE conclusiveness = 'suspicious') AS suspicious,
        count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) AS total FROM investigated)
    SELECT *, CASE WHEN conclusive > 0 OR critical > 0 THEN 'CRITICAL' WHEN suspicious >= 3 OR high >= 3 THEN 'HIGH' WHEN suspicious >= 1 OR high >= 1 OR medium >= 3 THEN 'MEDIUM' WHEN total > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk FROM c"""
)
def investigation_risk(spark, sf_dir):
    return investigation.risk(_investigated(spark, sf_dir))


@query(
    f"""WITH {NAMED_SQL}, c AS (SELECT path, 'user_ini' AS rule_id, CASE WHEN regexp_matches(content, 'auto_(?:prepend|append)_file', 'i') THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM named WHERE doc_id % 3 = 2
        UNION ALL SELECT path, 'htaccess_directive', 'CRITICAL' FROM named WHERE doc_id % 3 = 1 AND regexp_matches(content, 'php_value\\s+auto_(?:prepend|append)_file|php_flag\\s+engine\\s+on', 'i'))
    SELECT 'CONFIG_CHECK-' || substr(sha256('config_check:' || rule_id || ':' || path || ':0'), 1, 12) AS id, rule_id, path, severity, 'config_tamper' AS category, 'conclusive' AS conclusiveness FROM c"""
)
def config_findings(spark, sf_dir):
    return investigation.config_findings(scan.config_checks(_named(spark, sf_dir))).select("id", "rule_id", "path", "severity", "category", "conclusiveness")


DATABASE_SQL = (
    FILES_SQL
    + """, named AS (SELECT doc_id, content, ['site/app.db', 'edocs/x.db', 'site/store.sqlite3', 'temp/y.sqlite', 'site/page.php'][(doc_id % 5 + 1)::INTEGER] AS top FROM files),
    artifacts AS (SELECT 'd' || doc_id || '/' || top AS path, CASE doc_id % 5 WHEN 0 THEN 'known_database' ELSE 'unexpected_database' END AS type,
        CASE doc_id % 5 WHEN 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, octet_length(encode(content)) AS size_bytes FROM named WHERE doc_id % 5 IN (0, 2))"""
)


def _databases(spark, sf_dir):
    top = F.get(F.array(*map(F.lit, ["site/app.db", "edocs/x.db", "site/store.sqlite3", "temp/y.sqlite", "site/page.php"])), (F.col("doc_id") % 5).cast("int"))
    rows = files(spark, sf_dir).withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), top))
    return investigation.database_artifacts(rows, ["app.db"])


@query(f"WITH {DATABASE_SQL} SELECT path, type, severity, size_bytes FROM artifacts")
def database_artifacts(spark, sf_dir):
    return _databases(spark, sf_dir)


@query(f"WITH {DATABASE_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, coalesce(bool_or(type = 'known_database'), false) AS has_known FROM artifacts")
def database_report(spark, sf_dir):
    return investigation.database_report(_databases(spark, sf_dir))


TYPES_SQL = "types AS (SELECT path, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext_label, CASE WHEN contains(content, '<?php') OR contains(content, '<?=') THEN 'php' WHEN content = '' THEN 'empty' ELSE 'txt' END AS label FROM planted)"
EXPECTED = {".php": ["php"], ".html": ["html"], ".txt": ["txt", "empty"]}


@query(
    f"""WITH {UNIFIED_SQL}, {TYPES_SQL}, m AS (SELECT path, label, CASE ext_label WHEN 'php' THEN label <> 'php' WHEN 'html' THEN label <> 'html' WHEN 'txt' THEN label NOT IN ('txt', 'empty') ELSE false END AS bad FROM types)
    SELECT id, label AS content_label, bad AS content_mismatch FROM findings JOIN m USING (path)"""
)
def content_enrichment(spark, sf_dir):
    types = findings.content_types(planted(spark, sf_dir), EXPECTED)
    return investigation.with_content_types(_findings(spark, sf_dir), types).select("id", "content_label", "content_mismatch")


@query(
    f"""WITH {PLANTED_SQL}, {TYPES_SQL} SELECT path, CASE WHEN ext_label IN ('txt') AND label = 'php' THEN 'critical' WHEN ext_label = 'html' AND label = 'php' THEN 'suspicious' WHEN label = 'php' THEN 'suspicious' ELSE 'info' END AS severity
    FROM types WHERE ext_label <> label"""
)
def mismatch_override(spark, sf_dir):
    rows = findings.content_types(planted(spark, sf_dir), EXPECTED).where("ext_label <> label")
    return rows.select("path", investigation.mismatch_severity(F.col("ext_label"), F.col("label"), F.lit(0.4)).alias("severity"))


VECTORS = {"V1": {"iocs": ["IOC-1"], "words": []}, "V2": {"iocs": [], "words": ["injection", "sec"]}, "V3": {"iocs": ["IOC-9"], "words": ["nowhere"]}}
ASSESSED_SQL = UNIFIED_SQL + ", met AS (SELECT DISTINCT fingerprint, 'V1' AS vector FROM findings WHERE severity = 'CRITICAL' UNION SELECT fingerprint, 'V2' FROM findings WHERE category LIKE '%injection%')"


def _assessed(spark, sf_dir):
    iocs = F.when(F.col("severity") == "CRITICAL", F.array(F.lit("IOC-1"))).otherwise(F.array(F.lit("IOC-2")))
    return investigation.vectors_assessed(_findings(spark, sf_dir).withColumn("ioc_ids", iocs), VECTORS)


@query(f"WITH {ASSESSED_SQL} SELECT fingerprint, vector FROM met")
def vectors_assessed(spark, sf_dir):
    return _assessed(spark, sf_dir)


@query(f"WITH {ASSESSED_SQL} SELECT 3::BIGINT AS assessed, count(DISTINCT vector) AS hit FROM met")
def vector_summary(spark, sf_dir):
    return investigation.vector_summary(_assessed(spark, sf_dir), VECTORS)


@query(
    f"""WITH {PLANTED_SQL}, m AS (SELECT path, array_to_string(list_filter([CASE WHEN regexp_matches(content, 'eval\\s*\\(') THEN 'eval' END, CASE WHEN regexp_matches(content, 'base64_decode\\s*\\(') THEN 'base64' END,
        CASE WHEN regexp_matches(content, '<\\?php', 'i') THEN 'php' END], lambda x: x IS NOT NULL), ',') AS markers FROM planted WHERE doc_id % 2 = 0) SELECT path, markers FROM m WHERE markers <> ''"""
)
def export_checks(spark, sf_dir):
    rows = planted(spark, sf_dir).select("path", F.col("content").cast("string").alias("text"), F.when(F.col("doc_id") % 2 == 0, "text/csv").otherwise("application/x-php").alias("mime"))
    return investigation.export_checks(rows).select("path", "markers")


@query(
    f"""WITH {UNIFIED_SQL}, r AS (SELECT category, severity, CASE WHEN category LIKE '%rce%' THEN '' ELSE 'Review ' || category END AS recommendation FROM findings)
    SELECT category, recommendation, ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity))] AS severity, count(*) AS n
    FROM r WHERE recommendation <> '' GROUP BY category, recommendation"""
)
def recommendations(spark, sf_dir):
    advice = F.when(F.col("category").contains("rce"), "").otherwise(F.concat(F.lit("Review "), "category"))
    return investigation.recommendations(_findings(spark, sf_dir).withColumn("recommendation", advice))


@query(
    f"""WITH {UNIFIED_SQL}, s AS (SELECT path, max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) - 1)::INTEGER AS max_rank, count(DISTINCT rule_id) AS n_signals FROM findings GROUP BY path)
    SELECT path, max_rank, n_signals, row_number() OVER (ORDER BY max_rank DESC, n_signals DESC, path) AS place FROM s WHERE max_rank = 4"""
)
def ranked_files(spark, sf_dir):
    return investigation.ranked_files(rollup.suspicious_files(_findings(spark, sf_dir))).select("path", "max_rank", "n_signals", "place")


@query(
    f"""WITH {UNIFIED_SQL}, c AS (SELECT 'category' AS key, category AS value, count(*) AS n FROM findings GROUP BY category UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY severity)
    SELECT key, value, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS place FROM c"""
)
def most_common(spark, sf_dir):
    return investigation.most_common(rollup.counts_by(_findings(spark, sf_dir), "category", "severity")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {UNIFIED_SQL} SELECT id, rule_id, severity, path FROM findings")
def findings_sink(spark, sf_dir):
    """The findings as written and read back."""
    rows, folder = _findings(spark, sf_dir), new_folder(spark, "findings")
    sinks.save_findings(rows, folder)
    return spark.read.schema(rows.schema).json(folder).select("id", "rule_id", "severity", "path")


@query(
    f"""WITH {FILES_SQL}, m AS (SELECT path, sha256(content) AS sha256, octet_length(encode(content)) AS size FROM files),
    p AS (SELECT sha256(path)[1:4] AS part, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path || ':' || sha256)) AS digest, count(*) AS files, sum(size) AS bytes FROM m GROUP BY 1)
    SELECT sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes, sha256(string_agg(digest, chr(10) ORDER BY part)) AS package_sha256, 'case-1' AS case_id FROM p"""
)
def evidence_package(spark, sf_dir):
    """The metadata of an evidence package as written and read back."""
    return sinks.save_evidence(manifest.manifest(files(spark, sf_dir), with_entropy=False), new_folder(spark, "evidence"), case_id="case-1")


@query(f"WITH {UNIFIED_SQL}, c AS (SELECT id, coalesce(CASE rule_id {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in catalog.WEAKNESSES.items())} END, '') AS cwe FROM findings) SELECT id, CASE WHEN cwe = '' THEN '' ELSE cwe || coalesce(': ' || CASE cwe {' '.join(f'WHEN {_quoted(k)} THEN {_quoted(v)}' for k, v in catalog.WEAKNESS_NAMES.items())} END, '') END AS weakness FROM c")
def weakness_display(spark, sf_dir):
    rows = findings.enriched(_findings(spark, sf_dir))
    return rows.select("id", C.weakness_shown(F.col("cwe_id"), F.col("cwe_name")).alias("weakness"))


@query(f"WITH {FILES_SQL} SELECT path, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (doc_id % 20) || '.' || (doc_id % 7) || '.' || doc_id END AS version FROM files")
def archive_version(spark, sf_dir):
    n = F.col("doc_id")
    number = F.concat_ws(".", (n % 20).cast("string"), (n % 7).cast("string"), n.cast("string"))
    name = F.when(n % 3 == 0, F.concat(F.lit("other_"), number, F.lit(".zip"))).otherwise(F.concat(F.lit("/in/app_v"), number, F.lit(".zip")))
    return files(spark, sf_dir).select("path", C.archive_version(name, "app_v").alias("version"))


@query(f"WITH {FILES_SQL}, w AS (SELECT path, ['89', 'cwe-79', ' CWE-22 ', '', 'none'][(doc_id % 5 + 1)::INTEGER] AS raw, ['sql injection', 'Reflected XSS', 'command exec', 'weak hash', 'nothing'][(doc_id % 5 + 1)::INTEGER] AS rule FROM files) SELECT path, CASE WHEN regexp_replace(raw, '[^0-9]', '', 'g') = '' THEN '' ELSE 'CWE-' || regexp_replace(raw, '[^0-9]', '', 'g') END AS cwe_id, CASE rule WHEN 'sql injection' THEN 'injection' WHEN 'Reflected XSS' THEN 'xss' WHEN 'command exec' THEN 'rce' WHEN 'weak hash' THEN 'crypto' ELSE 'other' END AS category FROM w")
def weakness_ids(spark, sf_dir):
    at = lambda *names: F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 5).cast("int"))
    rule = at("sql injection", "Reflected XSS", "command exec", "weak hash", "nothing")
    return files(spark, sf_dir).select("path", C.weakness_id(at("89", "cwe-79", " CWE-22 ", "", "none")).alias("cwe_id"), findings.keyword_category(rule).alias("category"))


@query(f"WITH {UNIFIED_SQL} SELECT id, CASE severity WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 8.0 WHEN 'MEDIUM' THEN 5.5 WHEN 'LOW' THEN 3.0 ELSE 0.0 END::DOUBLE AS score FROM findings")
def severity_scores(spark, sf_dir):
    return _findings(spark, sf_dir).select("id", investigation.representative_score(F.col("severity")).alias("score"))


@query(
    f"""WITH {PLANTED_SQL}, {TYPES_SQL} SELECT path, CASE WHEN label = 'php' AND ext_label <> 'php' THEN 'CRITICAL' ELSE 'LOW' END AS severity, 'content_type' AS category, 0 AS line FROM types
    WHERE CASE ext_label WHEN 'php' THEN label <> 'php' WHEN 'html' THEN label <> 'html' WHEN 'txt' THEN label NOT IN ('txt', 'empty') ELSE false END"""
)
def mismatch_findings(spark, sf_dir):
    return findings.from_mismatches(findings.content_types(planted(spark, sf_dir), EXPECTED)).select("path", "severity", "category", "line")


SARIF_SQL = FILES_SQL + """, results AS (SELECT path, doc_id, 'r' || doc_id % 7 AS rule_id, ['error', 'warning', 'note', 'none'][(doc_id % 4 + 1)::INTEGER] AS level, 'Possible sql issue ' || doc_id % 3 AS message,
    CASE WHEN doc_id % 6 = 5 THEN '' ELSE path END AS uri, CASE WHEN doc_id % 6 = 5 THEN 0 ELSE (doc_id % 90 + 10)::INTEGER END AS start_line,
    CASE WHEN doc_id % 3 = 0 THEN 'CWE-' || (doc_id % 80 + 1) WHEN doc_id % 3 = 1 THEN 'CWE-79' ELSE '' END AS cwe_id FROM files)"""


def _documents(spark, sf_dir):
    """A document of the interchange format for each file: one result, a rule, notes of the run."""
    n, lit = F.col("doc_id"), F.lit
    text = lambda c: F.struct(c.alias("text"))
    taxa = F.when(n % 3 == 0, F.array(F.struct((n % 80 + 1).cast("string").alias("id"), F.struct(lit("cwe").alias("name")).alias("toolComponent"))))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct((n % 90 + 10).cast("int").alias("startLine")).alias("region")).alias("physicalLocation"))
    level = F.get(F.array(*map(lit, ["error", "warning", "note", "none"])), (n % 4).cast("int"))
    result = F.struct(
        F.concat(lit("r"), (n % 7).cast("string")).alias("ruleId"), level.alias("level"), text(F.concat(lit("Possible sql issue "), (n % 3).cast("string"))).alias("message"), taxa.alias("taxa"),
        F.when(n % 3 == 1, F.struct(lit("79").alias("cwe"))).alias("properties"), F.when(n % 6 != 5, F.array(place)).alias("locations"),
    )
    rule = F.struct(F.concat(lit("r"), (n % 7).cast("string")).alias("id"), F.concat(lit("Rule "), (n % 7).cast("string")).alias("name"))
    notes = F.array(F.struct(text(F.when(n % 9 == 0, "broken file").otherwise("")).alias("message")))
    run = F.struct(
        F.struct(F.struct(lit("scan").alias("name"), F.array(rule).alias("rules")).alias("driver")).alias("tool"), F.array(result, result).alias("results"),
        F.array(F.struct(F.struct(F.concat(lit("extra/"), "path").alias("uri")).alias("location"))).alias("artifacts"), F.array(F.struct(notes.alias("toolExecutionNotifications"))).alias("invocations"),
    )
    return interop.parse_sarif(files(spark, sf_dir).select(F.col("path").alias("file"), F.to_json(F.struct(F.array(run).alias("runs"))).alias("json")))


@query(f"WITH {SARIF_SQL} SELECT path AS file, rule_id, level, message, uri, start_line, cwe_id FROM results, range(2)")
def sarif_minimal(spark, sf_dir):
    """All results of all documents, with the minimal location and the weakness from either place."""
    return interop.sarif_results(_documents(spark, sf_dir), 0, "minimal").drop("run", "pos")


@query(f"WITH {SARIF_SQL} SELECT path AS file, rule_id, uri FROM results")
def sarif_first_results(spark, sf_dir):
    return interop.sarif_results(_documents(spark, sf_dir), 1).select("file", "rule_id", "uri")


@query(f"WITH {SARIF_SQL} SELECT path AS file, rule_id, 'Rule ' || rule_id[2:] AS name FROM results")
def sarif_rules(spark, sf_dir):
    return interop.sarif_rules(_documents(spark, sf_dir))


@query(f"WITH {SARIF_SQL} SELECT path AS file, 'broken file' AS error FROM results WHERE doc_id % 9 = 0")
def sarif_errors(spark, sf_dir):
    return interop.sarif_errors(_documents(spark, sf_dir))


@query(f"WITH {SARIF_SQL} SELECT path AS file, 'extra/' || path AS uri FROM results UNION ALL SELECT path, path FROM results WHERE doc_id % 6 <> 5")
def sarif_all_files(spark, sf_dir):
    return interop.sarif_files(_documents(spark, sf_dir))


@query(f"WITH {SARIF_SQL} SELECT path AS file, regexp_replace(uri, '^/+', '') AS uri FROM results WHERE uri <> ''")
def sarif_processed(spark, sf_dir):
    """Named steps in order; one of them is not known."""
    return interop.post_processed(interop.sarif_results(_documents(spark, sf_dir)), ["located", "unheard of", "relative", "distinct"]).select("file", "uri")


@query(
    f"""WITH {SARIF_SQL} SELECT 'SEMGREP-' || substr(sha256('semgrep:' || rule_id || ':' || uri || ':' || start_line), 1, 12) AS id, CASE level WHEN 'error' THEN 'HIGH' WHEN 'warning' THEN 'MEDIUM' WHEN 'note' THEN 'LOW' ELSE 'INFO' END AS severity,
    'other' AS category, cwe_id, uri AS path, start_line AS line FROM results"""
)
def sarif_findings(spark, sf_dir):
    return findings.from_sarif(interop.sarif_results(_documents(spark, sf_dir), 1), "semgrep").select("id", "severity", "category", "cwe_id", "path", "line")


@query(
    f"""WITH {UNIFIED_SQL}, s AS (SELECT source, unnest(CASE WHEN source = 'scan' THEN [1, 2] ELSE [1] END) AS copy FROM (SELECT *, 'scan' AS source FROM findings))
    SELECT 'scan' AS source, count(*) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS corroborated FROM findings UNION ALL SELECT 'runtime', count(*), count(*) FROM findings WHERE severity = 'CRITICAL'"""
)
def counts_by_source(spark, sf_dir):
    sources = F.when(F.col("severity") == "CRITICAL", F.array(F.lit("scan"), F.lit("runtime"))).otherwise(F.array(F.lit("scan")))
    rows = _findings(spark, sf_dir).withColumn("source", F.explode(sources)).withColumn("line", F.abs(F.hash("rule_id")) + 1)
    return investigation.counts_by_source(findings.corroborated(rows))


@query(rf"WITH {LINES_SQL} SELECT path, line FROM lines WHERE regexp_matches(text, '@|\(\d{{3}}\)|\+1\d{{10}}|\d{{4}}[\s\-]?\d{{4}}[\s\-]?\d{{4}}|\d{{3}}[\-]\d{{2}}[\-]\d{{4}}|AKIA|BEGIN.{{0,10}}PRIVATE|password|passwd|pwd|\$hostname|\$db|\$username|aws_secret|eyJ[A-Za-z0-9_\-]{{10}}|dob|birth|mrn|medical.record|patient_name|first_name|last_name|patientName|firstName|lastName|[A-Za-z0-9+/]{{50}}|[0-9a-fA-F]{{32}}', 'i')")
def gated_lines(spark, sf_dir):
    """The lines that the quick gate lets pass."""
    return scan.gated(scan.lines_of(files(spark, sf_dir))).select("path", "line")


@query(
    f"WITH {HITS_SQL}, r AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{s}', '{c}')" for i, s, c, _, _ in scan.RULES) + ") v(rule_id, severity, category)) "
    "SELECT r.rule_id, r.severity, r.category, count(path) AS files FROM r LEFT JOIN hits ON r.rule_id = hits.rule_id GROUP BY r.rule_id, r.severity, r.category"
)
def rule_catalog(spark, sf_dir):
    """The rules as a table, each with the number of files that meet it, none included."""
    met = scan.rule_hits(planted(spark, sf_dir)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("files"))
    return scan.rule_table(spark).join(met, "rule_id", "left").select("rule_id", "severity", "category", F.coalesce("files", F.lit(0)).alias("files"))


@query(f"WITH {FILES_SQL} SELECT path, doc_id % 3 = 0 AS null_byte FROM files")
def binary_strategies(spark, sf_dir):
    """Contents with a NUL byte, by the strategy of that name."""
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("content", 1, 40), F.unhex(F.lit("00")), "content")).otherwise(F.col("content"))
    return files(spark, sf_dir).select("path", C.BINARY_STRATEGIES["null_byte"](content).alias("null_byte"))


@query(
    f"""WITH {NAMED_SQL}, d AS (SELECT path, content || chr(10) || ' php_flag engine on' || chr(10) || 'Options none' AS content FROM named WHERE doc_id % 3 = 1),
    l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10)))))::INTEGER + 1 AS line FROM d)
    SELECT path, line, trim(text) AS directive FROM l WHERE regexp_matches(text, 'php_value\\s+auto_(?:prepend|append)_file|php_flag\\s+engine\\s+on|AddType\\s+application/x-httpd-php|SetHandler\\s+application/x-httpd-php', 'i')"""
)
def directive_lines(spark, sf_dir):
    added = F.lit("\n php_flag engine on\nOptions none").cast("binary")
    return scan.directive_lines(_named(spark, sf_dir).withColumn("content", F.concat("content", added)))


ADDRESSES = {"::1": True, "::": True, "fe80::1": True, "fd00:1::2": True, "ff02::1": True, "2001:4860:4860::8888": False, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False, "2a00:1450::1": False, "8.8.8.8": False}


@query(f"SELECT event_id, {list(ADDRESSES.values())}[(event_id % {len(ADDRESSES)} + 1)::INTEGER] AS internal FROM events")
def internal_addresses_v6(spark, sf_dir):
    ip = F.get(F.array(*map(F.lit, ADDRESSES)), (F.col("event_id") % len(ADDRESSES)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", web.internal_address_v6(ip).alias("internal"))


@query(
    f"""WITH {FILES_SQL}, f AS (SELECT regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext, octet_length(encode(content)) AS size, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS n FROM files),
    c AS (SELECT *, CASE ext {' '.join(f"WHEN '{e}' THEN '{n}'" for e, n in FIRST_CATEGORY.items())} ELSE 'other' END AS category FROM f)
    SELECT 'extension' AS key, ext AS value, count(*) AS files, sum(size)::BIGINT AS bytes, sum(n)::BIGINT AS lines FROM c GROUP BY ext UNION ALL SELECT 'category', category, count(*), sum(size)::BIGINT, sum(n)::BIGINT FROM c GROUP BY category
    UNION ALL SELECT 'total', '', count(*), sum(size)::BIGINT, sum(n)::BIGINT FROM c"""
)
def content_profile(spark, sf_dir):
    return manifest.content_profile(files(spark, sf_dir))


SYMBOLS_SQL = LINES_SQL + ", symbols AS (SELECT path, 'C' || line % 3 AS class, CASE WHEN line % 5 = 0 THEN NULL ELSE 'f' || line END AS function, length(text) AS body_lines, line % 11 AS complexity FROM lines)"


@query(
    f"""WITH {SYMBOLS_SQL} SELECT path, count(function) AS functions, count(DISTINCT class) AS classes, sum(complexity) FILTER (WHERE function IS NOT NULL)::BIGINT AS complexity,
    max(complexity) FILTER (WHERE function IS NOT NULL) AS largest, round(avg(body_lines) FILTER (WHERE function IS NOT NULL), 3) AS mean_body FROM symbols GROUP BY path"""
)
def symbol_complexity(spark, sf_dir):
    line = F.col("line")
    name = F.when(line % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("f"), line.cast("string")))
    rows = scan.lines_of(files(spark, sf_dir)).select("path", F.concat(F.lit("C"), (line % 3).cast("string")).alias("class"), name.alias("function"), F.length("text").alias("body_lines"), (line % 11).alias("complexity"))
    return manifest.symbol_complexity(rows)


@query(f"WITH {LINES_SQL} SELECT path, 'k' || length(text) % 4 AS kind, count(*) AS n FROM lines GROUP BY ALL")
def token_kinds(spark, sf_dir):
    rows = scan.lines_of(files(spark, sf_dir))
    return manifest.token_kinds(rows.select("path", F.concat(F.lit("k"), (F.length("text") % 4).cast("string")).alias("kind")))


@query(f"WITH {SNAPSHOTS_SQL} SELECT path, status, CASE WHEN status IN ('added', 'removed') OR path LIKE '%.php' THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM diff WHERE status <> 'identical'")
def validation_findings(spark, sf_dir):
    reference, target = map(diff.hashed, snapshots(spark, sf_dir))
    return diff.validation_findings(diff.baseline_diff(reference, target)).select("path", "status", "severity")


LADDER = ["edocs2/a.phar", "x/run.sh", "y/.htaccess", "hooks.php", "database.php", "z/readme.md", "edocs/h.php", "e/.h.php", "0123456789abcdef0123456789abcdef.txt", "edocs/plain.txt"]
ADDED = ["CRITICAL", "HIGH", "CRITICAL", "CRITICAL", "CRITICAL", "MEDIUM", "CRITICAL", "CRITICAL", "MEDIUM", "MEDIUM"]
CHANGED = ["MEDIUM", "MEDIUM", "CRITICAL", "CRITICAL", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "MEDIUM", "MEDIUM"]
TAGS = ["", "", "", "", "", "", "php_in_data_dir", "hidden_php", "hash_named", ""]
LADDER_SQL = FILES_SQL + f", ladder AS (SELECT doc_id, {LADDER}[(doc_id % 10 + 1)::INTEGER] AS name, {ADDED}[(doc_id % 10 + 1)::INTEGER] AS added, {CHANGED}[(doc_id % 10 + 1)::INTEGER] AS modified, {TAGS}[(doc_id % 10 + 1)::INTEGER] AS tag FROM files)"


def _ladder(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", F.get(F.array(*map(F.lit, LADDER)), (F.col("doc_id") % 10).cast("int")).alias("path"))


@query(f"WITH {LADDER_SQL} SELECT doc_id, name AS path, added, modified FROM ladder")
def change_severities(spark, sf_dir):
    """All rungs of the ladders for added and modified files."""
    path = F.col("path")
    return _ladder(spark, sf_dir).select("doc_id", "path", diff.addition_severity(path).alias("added"), diff.modification_severity(path).alias("modified"))


@query(f"WITH {LADDER_SQL} SELECT name AS path, 'added' AS status, tag FROM ladder WHERE tag <> ''")
def change_tags(spark, sf_dir):
    return diff.suspicious_changes(_ladder(spark, sf_dir).select("path", F.lit("added").alias("status"), F.lit(10).alias("size")))
