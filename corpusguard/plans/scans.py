"""Queries about findings: scans, deduplication, enrichment, correlation and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.catalogs import rules as catalog
from corpusguard.functions import columns as C
from corpusguard.functions.session import checkpointed
from corpusguard.operators import diff, findings, rollup, scan
from corpusguard.plans.registry import FILES_SQL, PLANTED_SQL, files, planted, query, snapshots, table
from corpusguard.sources import interop

#: Rules whose patterns look around, in a form for engines that cannot: the pattern, and what its group must not hold.
LOOKING = {
    "SEC003": (r"(?:^|[^\w>:]|(?:^|[^-])>|(?:^|[^:]):)(?:exec|system|passthru|shell_exec|popen|proc_open)\s*\(\s*\$", ""),
    "SEC020": (r"\$_(?:GET|POST|REQUEST|COOKIE)\s*\[.*\]([^\]\n]*)", "htmlspecialchars|htmlentities|filter_|intval|escape|sanitize"),
    "SEC021": (r".*session_start\s*\(\s*\)(.*)", "session_regenerate_id"),
    "SEC063": (r"\bKint::|\\Kint\\|kint-php|(?:^|[^a-zA-Z_])d\(\s*\$|Kint\\Renderer", ""),
    "SEC075": (r"(?:echo|print)\s+.*(?:messenger|thread|message_body|conversation)(.*)", "htmlspecialchars"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_sql(rules, base: str = PLANTED_SQL, files: str = "planted") -> str:
    values = ", ".join(f"('{i}', '{s}', '{c}', {_quoted(LOOKING.get(i, (p, ''))[0])}, {_quoted(LOOKING.get(i, (p, ''))[1])})" for i, s, c, p, _ in rules)
    return (
        base
        + f""", patterns AS (SELECT * FROM (VALUES {values}) AS v(rule_id, severity, category, pattern, unless)), hits AS (
            SELECT path, doc_id, rule_id, severity, category FROM {files}, patterns WHERE CASE WHEN unless = '' THEN regexp_matches(content, pattern, 'i')
                ELSE len(list_filter(regexp_extract_all(content, pattern, 1, 'i'), lambda x: NOT regexp_matches(x, unless, 'i'))) > 0 END
        )"""
    )


HITS_SQL = hits_sql(scan.RULES)
WEBSHELL_RULES = [r for r in scan.RULES if r[0].startswith("WEB")]


def _hits(spark, sf_dir):
    return scan.rule_hits(planted(spark, sf_dir))


@query(f"WITH {HITS_SQL} SELECT path, rule_id FROM hits")
def rule_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("path", "rule_id")


@query(None)
def rule_scan(spark, sf_dir):
    return scan.rule_scan(planted(spark, sf_dir))


@query(f"WITH {hits_sql(WEBSHELL_RULES)} SELECT path, rule_id FROM hits")
def webshell_scan(spark, sf_dir):
    return scan.rule_hits(planted(spark, sf_dir), WEBSHELL_RULES).select("path", "rule_id")


@query(
    f"""WITH {HITS_SQL} SELECT count(*) AS total, count(DISTINCT path) AS files, count(*) FILTER (WHERE severity = 'INFO') AS info, count(*) FILTER (WHERE severity = 'LOW') AS low,
    count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical FROM hits"""
)
def scan_rollup(spark, sf_dir):
    return scan.scan_rollup(_hits(spark, sf_dir))


@query(f"WITH {PLANTED_SQL} SELECT path, 'hook_save' AS name FROM planted WHERE doc_id % 17 = 0")
def hook_allowlist(spark, sf_dir):
    return scan.functions_outside(planted(spark, sf_dir), ["hook_load", "hook_every_page"])


@query(f"WITH {PLANTED_SQL} SELECT path, 'SELECT' AS verb, 'SELECT name FROM users WHERE id = 1' AS snippet FROM planted WHERE doc_id % 23 = 0")
def sql_strings(spark, sf_dir):
    return scan.sql_strings(planted(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT path, 'IOC-1' AS ioc_id FROM files WHERE path LIKE '%.php' UNION ALL SELECT path, 'IOC-2' FROM files WHERE path LIKE 'src/src1/%' AND (path LIKE '%.log' OR path LIKE '%.md')")
def ioc_paths(spark, sf_dir):
    return scan.path_indicators(files(spark, sf_dir), {"IOC-1": "**/*.php", "IOC-2": "src/src1/*.{log,md}"})


@query(f"WITH {FILES_SQL} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, 'IOC-3' AS ioc_id FROM files WHERE regexp_matches(path, '^src/src1[0-9]*/')")
def ioc_dirs(spark, sf_dir):
    return scan.directory_indicators(files(spark, sf_dir), {"IOC-3": "src/src1*"})


@query(f"WITH {FILES_SQL} SELECT path, split_part(path, '/', 2) AS directory FROM files WHERE split_part(path, '/', 2) IN ('src0', 'src3') AND (path LIKE '%.php' OR path LIKE '%.js')")
def ioc_location(spark, sf_dir):
    return scan.location_indicators(files(spark, sf_dir), {"src0": [".php", ".js"], "src3": [".php", ".js"]})


@query(f"WITH {FILES_SQL} SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files WHERE path NOT LIKE 'src/src2/%'")
def critical_dirs(spark, sf_dir):
    rows = files(spark, sf_dir)
    guard = rows.where(F.col("path").startswith("src/src2/")).select("doc_id", F.lit("src/src2/.htaccess").alias("path"), "content")
    return scan.unguarded_directories(rows.unionByName(guard))


LINES_SQL = FILES_SQL + ", lines AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10)))))::INTEGER + 1 AS line FROM files)"


def _sensitive_sql(pattern: str, group: int = 0) -> str:
    return f"WITH {LINES_SQL} SELECT path, line, unnest(regexp_extract_all(text, {_quoted(pattern)}, {group})) AS value FROM lines"


@query(_sensitive_sql(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"))
def pii_email(spark, sf_dir):
    return scan.sensitive_matches(scan.lines_of(files(spark, sf_dir)), "email")


@query(_sensitive_sql(r"(\(\d{3}\)\s?\d{3}[.\-]\d{4}|\b\d{3}[.\-]\d{3}[.\-]\d{4}\b|\+1\d{10}\b)"))
def pii_phone(spark, sf_dir):
    return scan.sensitive_matches(scan.lines_of(files(spark, sf_dir)), "phone")


@query(_sensitive_sql(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"))
def pii_ip(spark, sf_dir):
    return scan.sensitive_matches(scan.lines_of(files(spark, sf_dir)), "ip_address")


@query(
    f"""WITH {LINES_SQL}, c AS (SELECT path, line, unnest(regexp_extract_all(text, '\\b4\\d{{3}}[\\s\\-]?\\d{{4}}[\\s\\-]?\\d{{4}}[\\s\\-]?\\d{{4}}\\b')) AS value FROM lines),
    d AS (SELECT path, line, value, list_reverse(string_split(regexp_replace(value, '[^0-9]', '', 'g'), '')) AS digits FROM c)
    SELECT path, line, value, list_sum(list_transform(range(len(digits)), lambda i: CASE WHEN i % 2 = 0 THEN digits[i + 1]::INTEGER WHEN digits[i + 1]::INTEGER > 4 THEN digits[i + 1]::INTEGER * 2 - 9 ELSE digits[i + 1]::INTEGER * 2 END)) % 10 = 0 AS valid FROM d"""
)
def pii_card_luhn(spark, sf_dir):
    found = scan.sensitive_matches(scan.lines_of(files(spark, sf_dir)), "credit_card_visa")
    return found.withColumn("valid", C.luhn(F.regexp_replace("value", "[^0-9]", "")))


@query(None)
def pii_scan(spark, sf_dir):
    return scan.sensitive_scan(scan.lines_of(files(spark, sf_dir)))


@query(None)
def pii_udtf(spark, sf_dir):
    """The scan as SQL states it."""
    scan.register_sensitive(spark)
    scan.lines_of(files(spark, sf_dir)).createOrReplaceTempView("scanned_lines")
    return spark.sql("SELECT path, line, found.* FROM scanned_lines, LATERAL sensitive_data(text) AS found")


@query(None)
def pii_report(spark, sf_dir):
    return rollup.sensitive_report(scan.sensitive_scan(scan.lines_of(files(spark, sf_dir))))


@query(None)
def hipaa_summary(spark, sf_dir):
    return rollup.privacy_summary(scan.sensitive_scan(scan.lines_of(files(spark, sf_dir))))


UNIFIED_SQL = (
    HITS_SQL
    + """, findings AS (
        SELECT 'SCAN-' || substr(sha256('scan:' || rule_id || ':' || path || ':1'), 1, 12) AS id, rule_id, severity, category, path, 1 AS line,
            sha256(rule_id || ':' || path || ':1:' || category) AS fingerprint FROM hits
    )"""
)


def _findings(spark, sf_dir):
    rows = _hits(spark, sf_dir).select("*", F.lit(1).alias("line"), F.col("category").alias("snippet"), F.lit("").alias("cwe_id"))
    return findings.unified(rows, "scan")


@query(f"WITH {UNIFIED_SQL} SELECT id, rule_id, severity, path, fingerprint FROM findings")
def normalize_findings(spark, sf_dir):
    return _findings(spark, sf_dir).select("id", "rule_id", "severity", "path", "fingerprint")


@query(
    f"""WITH {UNIFIED_SQL}, twice AS (SELECT *, 1 AS seq FROM findings UNION ALL SELECT *, 2 FROM findings WHERE severity = 'HIGH')
    SELECT fingerprint, min(seq) AS seq FROM twice GROUP BY fingerprint"""
)
def fingerprint_dedupe(spark, sf_dir):
    # a finding that two tools report, in one pass
    times = F.when(F.col("severity") == "HIGH", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    both = _findings(spark, sf_dir).withColumn("seq", F.explode(times))
    return findings.deduplicated(both).select("fingerprint", "seq")


@query(f"WITH {UNIFIED_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY path, rule_id) AS n FROM findings) SELECT id, 'INV-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS seq_id FROM n")
def sequential_ids(spark, sf_dir):
    return findings.numbered(_findings(spark, sf_dir), "path", "rule_id").select("id", "seq_id")


def _lookup_sql(values: dict, column: str = "rule_id") -> str:
    cases = " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {column} {cases} END"


@query(f"WITH {UNIFIED_SQL} SELECT id, {_lookup_sql(catalog.TECHNIQUES)} AS technique, {_lookup_sql(catalog.SCORES)}::DOUBLE AS score FROM findings")
def mitre_prefix_lookup(spark, sf_dir):
    return findings.enriched(_findings(spark, sf_dir)).select("id", "technique", "score")


@query(f"WITH {UNIFIED_SQL}, c AS (SELECT id, coalesce({_lookup_sql(catalog.WEAKNESSES)}, '') AS cwe_id FROM findings) SELECT id, cwe_id, coalesce({_lookup_sql(catalog.WEAKNESS_NAMES, 'cwe_id')}, '') AS cwe_name FROM c")
def cwe_backfill(spark, sf_dir):
    return findings.enriched(_findings(spark, sf_dir)).select("id", "cwe_id", "cwe_name")


@query(
    f"""WITH {UNIFIED_SQL}, m AS (SELECT fingerprint, list_filter([CASE WHEN category LIKE '%rce%' OR rule_id LIKE 'WEB%' THEN 'exec' END, CASE WHEN category LIKE '%injection%' THEN 'inject' END,
        CASE WHEN category LIKE '%persist%' OR category LIKE '%tamper%' THEN 'persist' END], lambda v: v IS NOT NULL) AS vectors FROM findings)
    SELECT fingerprint, array_to_string(vectors, ',') AS vectors FROM m WHERE len(vectors) > 0"""
)
def attack_vectors(spark, sf_dir):
    met = findings.vectors_met(_findings(spark, sf_dir), {"exec": ["rce", "web0"], "inject": ["injection"], "persist": ["persist", "tamper"]})
    return met.select("fingerprint", F.array_join("vectors", ",").alias("vectors"))


@query(
    f"""WITH {UNIFIED_SQL}, both_ AS (SELECT id, path, 'scan' AS source FROM findings UNION ALL SELECT 'R' || id, path, 'runtime' FROM findings WHERE severity = 'CRITICAL'),
    s AS (SELECT path, list_sort(list(DISTINCT source)) AS sources FROM both_ GROUP BY path)
    SELECT id, CASE WHEN len(sources) > 1 THEN CASE source WHEN 'scan' THEN 'runtime' ELSE 'scan' END ELSE '' END AS others, CASE WHEN len(sources) > 1 THEN 'CONFIRMED' ELSE 'MEDIUM' END AS confidence
    FROM both_ JOIN s USING (path)"""
)
def corroboration(spark, sf_dir):
    sources = F.when(F.col("severity") == "CRITICAL", F.array(F.lit("scan"), F.lit("runtime"))).otherwise(F.array(F.lit("scan")))
    rows = _findings(spark, sf_dir).withColumn("source", F.explode(sources))
    found = findings.corroborated(rows.withColumn("id", F.when(F.col("source") == "runtime", F.concat(F.lit("R"), "id")).otherwise(F.col("id"))))
    return found.select("id", F.array_join("corroborated_by", ",").alias("others"), "confidence")


@query(
    f"""WITH {UNIFIED_SQL}, c AS (SELECT * FROM findings WHERE severity IN ('CRITICAL', 'HIGH')), r AS (SELECT * FROM findings WHERE severity = 'CRITICAL' AND length(path) % 2 = 0),
    n AS (SELECT rule_id, count(DISTINCT id) AS n FROM c GROUP BY rule_id), m AS (SELECT rule_id, count(DISTINCT id) AS n FROM r GROUP BY rule_id)
    SELECT id, rule_id, m.n AS n_related FROM c JOIN m USING (rule_id) UNION ALL SELECT 'R' || id, rule_id, n.n FROM r JOIN n USING (rule_id)"""
)
def runtime_static_link(spark, sf_dir):
    rows = checkpointed(_findings(spark, sf_dir).select("id", "rule_id", "severity", "path"))
    runtime = rows.where("severity = 'CRITICAL' AND length(path) % 2 = 0").withColumn("id", F.concat(F.lit("R"), "id"))
    return findings.linked_by_rule(rows.where("severity IN ('CRITICAL', 'HIGH')"), runtime)


#: Symbols of every file: classes of 60 lines, methods of 12, classes inside methods with a method each, and functions around classes and between them.
SYMBOLS = [("K", None, 64, 1, 59), ("K", "m", 16, 1, 11), ("I", None, 16, 4, 7), ("I", "n", 16, 5, 6), (None, "all", 1 << 20, 1, (1 << 20) - 1), (None, "free", 64, 62, 63)]


@query(
    f"""WITH {LINES_SQL}, s AS ("""
    + " UNION ALL ".join(
        f"SELECT path, {f"'{c}'" if c else 'NULL'} AS class, {f"'{f}' || (line // {n})" if f else 'NULL'} AS function, line, line + {size} AS end_line FROM lines WHERE line % {n} = {at}" for c, f, n, at, size in SYMBOLS
    )
    + """), f AS (SELECT path, line, unnest(range(CASE WHEN line % 7 = 0 THEN 2 ELSE 1 END)) AS copy FROM lines WHERE regexp_matches(text, '[@0-9]')),
    c AS (SELECT f.path, f.line, max_by(s.class, (s.line, -s.end_line)) AS class FROM f JOIN s ON f.path = s.path AND f.line BETWEEN s.line AND s.end_line WHERE s.class IS NOT NULL AND s.function IS NULL GROUP BY f.path, f.line),
    m AS (SELECT f.path, f.line, max_by((s.class, s.function), (s.line, -s.end_line)) AS m FROM f JOIN s ON f.path = s.path AND f.line BETWEEN s.line AND s.end_line WHERE s.class IS NOT NULL AND s.function IS NOT NULL GROUP BY f.path, f.line),
    o AS (SELECT f.path, f.line, max_by(s.function, (s.line, -s.end_line)) AS function FROM f JOIN s ON f.path = s.path AND f.line BETWEEN s.line AND s.end_line WHERE s.class IS NULL GROUP BY f.path, f.line)
    SELECT f.path, f.line, copy, c.class AS class, CASE WHEN c.class IS NULL THEN o.function WHEN m.m[1] = c.class THEN m.m[2] ELSE '' END AS function
    FROM f LEFT JOIN c ON f.path = c.path AND f.line = c.line LEFT JOIN m ON f.path = m.path AND f.line = m.line LEFT JOIN o ON f.path = o.path AND f.line = o.line"""
)
def enclosing_symbol(spark, sf_dir):
    """Classes in methods of classes around lines with digits or ``@``, every seventh of which is found twice."""
    rows = scan.lines_of(files(spark, sf_dir))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("line") % 7 == 0, 1).otherwise(0).cast("long")))
    marks = rows.where(F.col("text").rlike("[@0-9]")).select("path", "line", copies.alias("copy"))
    name = lambda x: F.lit(x).cast("string")
    symbols = [
        F.when(F.col("line") % n == at, F.struct(name(c).alias("class"), (F.concat(F.lit(f), F.floor(F.col("line") / n).cast("string")) if f else name(None)).alias("function"), (F.col("line") + size).alias("end_line")))
        for c, f, n, at, size in SYMBOLS
    ]
    spans = rows.select("path", "line", F.inline(F.array_compact(F.array(*symbols))))
    return findings.with_symbols(marks, spans).drop("complexity")


@query(
    f"""WITH {PLANTED_SQL}, l AS (SELECT path, CASE WHEN contains(content, '<?php') OR contains(content, '<?=') THEN 'php' WHEN content = '' THEN 'empty' ELSE 'txt' END AS label, regexp_extract(path, '\\.([a-z]+)$', 1) AS ext_label FROM planted),
    m AS (SELECT *, (CASE ext_label WHEN 'php' THEN label = 'php' WHEN 'html' THEN label = 'html' WHEN 'txt' THEN label IN ('txt', 'empty') ELSE true END) AS is_match FROM l)
    SELECT path, label, ext_label, is_match, CASE WHEN is_match THEN 'none' WHEN label = 'php' AND ext_label <> 'php' THEN 'critical' ELSE 'info' END AS mismatch_severity FROM m"""
)
def content_type_mismatch(spark, sf_dir):
    return findings.content_types(planted(spark, sf_dir), {".php": ["php"], ".html": ["html"], ".txt": ["txt", "empty"]})


@query(f"WITH {UNIFIED_SQL}, s AS (SELECT unnest(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL']) AS severity) SELECT severity, count(id) AS n FROM s LEFT JOIN findings USING (severity) GROUP BY severity")
def severity_counts(spark, sf_dir):
    return rollup.severity_counts(_findings(spark, sf_dir))


@query(f"WITH {UNIFIED_SQL} SELECT category, id FROM findings QUALIFY row_number() OVER (PARTITION BY category ORDER BY list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) DESC, path, line, rule_id) <= 500")
def capped_by_category(spark, sf_dir):
    """The findings of each category that a report shows: 500."""
    return rollup.capped_by_category(_findings(spark, sf_dir)).select("category", "id")


@query(f"WITH {UNIFIED_SQL} SELECT 'severity' AS key, severity AS value, count(*) AS n FROM findings GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM findings GROUP BY category")
def counts_grouping_sets(spark, sf_dir):
    return rollup.counts_by(_findings(spark, sf_dir), "severity", "category")


@query(
    f"""WITH {UNIFIED_SQL}, c AS (SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) AS total FROM findings)
    SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN high >= 3 THEN 'HIGH' WHEN high >= 1 OR medium >= 3 THEN 'MEDIUM' WHEN total > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk FROM c"""
)
def risk_level(spark, sf_dir):
    return rollup.risk_level(_findings(spark, sf_dir))


@query(
    f"""WITH {UNIFIED_SQL} SELECT path, max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity) - 1)::INTEGER AS max_rank, count(DISTINCT rule_id) AS n_signals,
        array_to_string(list_transform(list_sort(list(DISTINCT (5 - list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) || 'scan:' || rule_id))[1:10], lambda x: x[2:]), ',') AS signals
    FROM findings GROUP BY path HAVING max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) = 5"""
)
def suspicious_files(spark, sf_dir):
    rows = rollup.suspicious_files(_findings(spark, sf_dir))
    return rows.select("path", "max_rank", "n_signals", F.array_join("signals", ",").alias("signals"))


TACTIC_ROWS = ", ".join(f"({_quoted(t)}, '{x}')" for t, xs in catalog.TACTICS.items() for x in xs)


@query(
    f"""WITH {UNIFIED_SQL}, t AS (SELECT * FROM (VALUES {TACTIC_ROWS}) v(tactic, technique)), f AS (SELECT {_lookup_sql(catalog.TECHNIQUES)} AS technique, count(*) AS n FROM findings GROUP BY 1)
    SELECT tactic, sum(coalesce(n, 0))::BIGINT AS n, count(n) AS techniques_met FROM t LEFT JOIN f USING (technique) GROUP BY tactic"""
)
def tactic_matrix(spark, sf_dir):
    return rollup.tactic_matrix(findings.enriched(_findings(spark, sf_dir)))


def _sarif(spark, sf_dir):
    """Documents of the interchange format made from findings, one for each severity and path."""
    rows = _findings(spark, sf_dir).withColumn("bucket", F.concat("severity", F.lit("-"), "path"))
    return interop.parse_sarif(interop.sarif_document(rows, "bucket"))


@query(f"WITH {UNIFIED_SQL} SELECT rule_id, path AS uri, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END AS level, 1 AS start_line FROM findings")
def sarif_flatten(spark, sf_dir):
    return interop.sarif_results(_sarif(spark, sf_dir)).select("rule_id", "uri", "level", "start_line")


@query(f"WITH {UNIFIED_SQL} SELECT DISTINCT path AS uri, severity FROM findings")
def sarif_files(spark, sf_dir):
    return interop.sarif_files(_sarif(spark, sf_dir)).select("uri", F.substring_index("file", "-", 1).alias("severity")).distinct()


@query(
    f"""WITH {UNIFIED_SQL} SELECT id, json_object('ruleId', rule_id, 'level', CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END,
        'message', json_object('text', rule_id), 'locations', json_array(json_object('physicalLocation', json_object('artifactLocation', json_object('uri', path), 'region', json_object('startLine', 1)))))::VARCHAR AS sarif FROM findings"""
)
def sarif_export(spark, sf_dir):
    return _findings(spark, sf_dir).select("id", interop.sarif_result().alias("sarif"))


@query(
    f"""WITH {FILES_SQL} SELECT path AS name, CASE WHEN doc_id % 10 = 0 THEN 'MISSING_CHECKSUM' WHEN doc_id % 10 = 1 THEN 'MISSING_FILE' WHEN doc_id % 7 = 0 THEN 'MISMATCH' ELSE 'VERIFIED' END AS state FROM files"""
)
def checksum_states(spark, sf_dir):
    reference, target = snapshots(spark, sf_dir)
    named = lambda df: df.select(F.col("path").alias("name"), F.sha2("content", 256).alias("sha256"))
    return interop.verified(named(target), named(reference))


@query(
    f"""WITH {FILES_SQL}, m AS (SELECT split_part(path, '/', 2) AS archive, CASE WHEN doc_id % 50 = 0 THEN '../' || path ELSE path END AS member, octet_length(encode(content)) AS size FROM files),
    t AS (SELECT archive, bool_or(member LIKE '../%' OR size > 20000) AS refused FROM m GROUP BY archive)
    SELECT archive, member, CASE WHEN member LIKE '../%' THEN 'unsafe_name' WHEN size > 20000 THEN 'too_large' WHEN refused THEN 'quarantined' ELSE 'ok' END AS verdict FROM m JOIN t USING (archive)"""
)
def archive_guard(spark, sf_dir):
    rows = files(spark, sf_dir)
    member = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    members = rows.select(F.split("path", "/")[1].alias("archive"), F.lit(1 << 40).alias("archive_size"), member.alias("member"), F.length("content").cast("long").alias("size"))
    return interop.archive_guard(members, max_member=20000)


@query(f"WITH {FILES_SQL} SELECT min(regexp_extract(path, '^(.*)/[^/]*$', 1)) AS root FROM files WHERE path LIKE '%\\_7%.js' ESCAPE '\\' AND regexp_matches(path, '_7\\.js$')")
def root_inference(spark, sf_dir):
    return interop.root_directory(files(spark, sf_dir).withColumn("path", F.regexp_replace("path", r"[a-z]+_(\d+)\.js$", "marker_$1.js")), ["marker_7.js"])


@query(
    """SELECT 'suite' || conv_id % 5 AS suite, 'conversation ' || conv_id AS test, CASE WHEN turn % 4 = 3 THEN 'failed' ELSE 'passed' END AS status, length(text) AS duration_ms FROM conversations WHERE conv_id % 6 <> 5
    UNION ALL SELECT NULL, NULL, 'parse_error', NULL FROM (SELECT DISTINCT conv_id, turn // 64 FROM conversations WHERE conv_id % 6 = 5)"""
)
def runtime_results(spark, sf_dir):
    """Reports of conversations as test suites; every sixth report is cut short."""
    rows = table(spark, sf_dir, "conversations")
    result = F.struct(F.when(F.col("turn") % 4 == 3, "failed").otherwise("passed").alias("status"), F.length("text").cast("long").alias("duration"))
    tests = rows.groupBy("conv_id", F.floor(F.col("turn") / 64).alias("part")).agg(F.collect_list(result).alias("results"))
    spec = F.struct(F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), F.array(F.struct("results")).alias("tests"))
    suite = F.struct(F.concat(F.lit("suite"), (F.col("conv_id") % 5).cast("string")).alias("title"), F.array(spec).alias("specs"))
    report = F.concat(F.lit("report:\n"), F.to_json(F.struct(F.array(suite).alias("suites"))))
    reports = tests.select(F.when(F.col("conv_id") % 6 == 5, F.substring(report, 1, 40)).otherwise(report).alias("json"))
    return interop.runtime_results(reports)


def _signature_output(spark, sf_dir):
    """``file, line, text``: the lines of the documents in the form that a signature scanner prints."""
    lines = scan.lines_of(files(spark, sf_dir)).where(F.trim("text") != "")
    found = F.concat(F.lit("0x"), F.col("line").cast("string"), F.lit(":$a: "), "text")
    return lines.select(F.col("path").alias("file"), "line", F.when(F.col("line") % 3 == 1, F.concat(F.lit("Rule "), F.trim("text"))).otherwise(found).alias("text"))


@query(
    f"""WITH {LINES_SQL}, h AS (SELECT path, line, text, sum(CASE WHEN trim(text) <> '' AND line % 3 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS g FROM lines WHERE trim(text) <> '')
    SELECT path AS file, count(*) FILTER (WHERE line % 3 <> 1) AS n FROM h WHERE g > 0 GROUP BY path, g"""
)
def signature_text(spark, sf_dir):
    return interop.signature_matches(_signature_output(spark, sf_dir)).select("file", F.size("strings").cast("long").alias("n"))


@query(
    f"""WITH {LINES_SQL}, h AS (SELECT path, line, trim(text) AS text, max(CASE WHEN line % 3 = 1 THEN line END) OVER (PARTITION BY path ORDER BY line) AS header_line FROM lines WHERE trim(text) <> '')
    SELECT h.path AS file, h.header_line, 'Rule' AS rule, t.text AS target, CASE WHEN h.line <> h.header_line THEN h.line END AS line, CASE WHEN h.line <> h.header_line THEN '0x' || h.line END AS "offset",
        CASE WHEN h.line <> h.header_line THEN '$a' END AS identifier, CASE WHEN h.line <> h.header_line THEN substr(h.text, 1, 200) END AS data
    FROM h JOIN h t ON h.path = t.path AND h.header_line = t.line"""
)
def signature_strings(spark, sf_dir):
    """Every line of a document as signature output: each third a header, the others what it found."""
    return interop.signature_strings(_signature_output(spark, sf_dir))


def flagship(spark, sf_dir):
    """Which changed files look worst: diff, scan of the delta, deduplicated findings, suspicious files."""
    reference, target = snapshots(spark, sf_dir)
    changed = diff.delta(diff.baseline_diff(diff.hashed(reference), diff.hashed(target)))
    rows = diff.restricted(planted(spark, sf_dir), changed)
    rules = findings.unified(scan.rule_scan(rows), "scan")
    sensitive = findings.from_sensitive(scan.sensitive_scan(scan.lines_of(rows)))
    first = findings.deduplicated(rules.unionByName(sensitive).withColumn("seq", F.xxhash64("id")))
    return rollup.suspicious_files(first)


@query(None)
def suspicious_changed_files(spark, sf_dir):
    return flagship(spark, sf_dir)
