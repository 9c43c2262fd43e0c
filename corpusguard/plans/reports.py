"""Queries about configuration, upgrades, runtime tests and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.catalogs import rules as catalog
from corpusguard.functions import columns as C
from corpusguard.functions.session import new_folder
from corpusguard.operators import diff, findings, rollup, scan
from corpusguard.plans.registry import FILES_SQL, PLANTED_SQL, SNAPSHOTS_SQL, files, planted, query, snapshots, table
from corpusguard.plans.scans import LINES_SQL, UNIFIED_SQL, _findings
from corpusguard.plans.snapshots import ENTROPY_SQL

NAMED_SQL = PLANTED_SQL + ", named AS (SELECT doc_id, content, 'app' || doc_id || CASE doc_id % 3 WHEN 0 THEN '/Upgrade.php' WHEN 1 THEN '/.htaccess' ELSE '/.user.ini' END AS path FROM planted)"


def _named(spark, sf_dir):
    """The planted files under names that some rules are about."""
    name = F.when(F.col("doc_id") % 3 == 0, "/Upgrade.php").when(F.col("doc_id") % 3 == 1, "/.htaccess").otherwise("/.user.ini")
    return planted(spark, sf_dir).withColumn("path", F.concat(F.lit("app"), F.col("doc_id").cast("string"), name))


#: Lines for upgrade files: the remainder of doc_id by the divisor 0 adds the line, some of it in comments.
UPGRADE_LINES = [(4, 'if (!$done) return; // exit'), (9, '# unlink($old)'), (10, '/* die */ unlink($old); unlink($new);'), (12, 'x(); // return'), (15, '  eval($patch); /* exit')]

UPGRADE_SQL = (
    NAMED_SQL.replace(" ELSE '/.user.ini'", " ELSE ['/.user.ini', '/UPGRADE.php'][(doc_id % 2 + 1)::INTEGER]")
    + ", upgrading AS (SELECT path, content || " + " || ".join(f"CASE WHEN doc_id % {n} = 0 THEN chr(10) || '{line}' ELSE '' END" for n, line in UPGRADE_LINES) + " AS content FROM named)"
    + ", rules AS (SELECT * FROM (VALUES "
    + ", ".join("('{}', '{}', '{}', {}, '{}')".format(i, s, c, "[" + ", ".join(f"'{n}'" for n in names) + "]", p.replace("'", "''")) for i, s, c, names, p in catalog.UPGRADE_RULES)
    + """) AS v(rule_id, severity, category, names, pattern)),
    numbered AS (SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(len(string_split(content, chr(10)))))::INTEGER + 1 AS line FROM upgrading),
    plain AS (SELECT path, line, trim(text) AS evidence, regexp_replace(regexp_replace(text, '/[*].*?([*]/|$)', '', 'g'), '(//|#).*$', '\\1') AS code FROM numbered),
    upgrade_hits AS (
        SELECT path, rule_id, severity, category, line, substr(evidence, 1, 150) AS evidence, unnest(range(len(regexp_extract_all(code, pattern, 0, 'i')))) AS nth FROM plain, rules
        WHERE list_contains(list_transform(names, lambda n: lower(n)), lower(list_last(string_split(path, '/'))))
    )"""
)


def _upgrading(spark, sf_dir):
    """The named files, some names in capitals, with lines of upgrade code in and out of comments."""
    path = F.when((F.col("doc_id") % 3 == 2) & (F.col("doc_id") % 2 == 1), F.regexp_replace("path", "/[.]user[.]ini$", "/UPGRADE.php")).otherwise(F.col("path"))
    added = [F.when(F.col("doc_id") % n == 0, F.lit("\n" + line)).otherwise(F.lit("")) for n, line in UPGRADE_LINES]
    return _named(spark, sf_dir).withColumns({"path": path, "content": F.concat(F.col("content").cast("string"), *added).cast("binary")})


@query(f"WITH {UPGRADE_SQL} SELECT path, rule_id, severity, category, line, evidence FROM upgrade_hits")
def upgrade_scan(spark, sf_dir):
    return scan.upgrade_hits(_upgrading(spark, sf_dir))


@query(
    f"""WITH {UPGRADE_SQL} SELECT count(*) AS total, count(DISTINCT path) AS files, """
    + ", ".join(f"coalesce(bool_or(category = '{k}'), false) AS {k}" for k in ("upgrade_hijack", "file_deletion_bypass", "persistence_injection", "skip_logic"))
    + " FROM upgrade_hits"
)
def upgrade_report(spark, sf_dir):
    return scan.upgrade_report(scan.upgrade_hits(_upgrading(spark, sf_dir)))


@query(
    f"""WITH {NAMED_SQL} SELECT path, 'user_ini' AS "check", CASE WHEN regexp_matches(content, 'auto_(?:prepend|append)_file', 'i') THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM named WHERE doc_id % 3 = 2
    UNION ALL SELECT path, 'htaccess_directive', 'CRITICAL' FROM named WHERE doc_id % 3 = 1 AND regexp_matches(content, 'php_value\\s+auto_(?:prepend|append)_file|php_flag\\s+engine\\s+on', 'i')"""
)
def config_integrity(spark, sf_dir):
    return scan.config_checks(_named(spark, sf_dir))


@query(f"WITH {NAMED_SQL} SELECT list_last(string_split(path, '/')) AS name, min(path) AS path, min_by(sha256(content), path) AS sha256 FROM named GROUP BY 1")
def tracked_files(spark, sf_dir):
    return scan.first_candidates(_named(spark, sf_dir), ["Upgrade.php", ".htaccess", ".user.ini"])


@query(f"WITH {ENTROPY_SQL} SELECT path, entropy FROM e JOIN files USING (path) WHERE length(content) >= 100 AND entropy > 4.2")
def obfuscation_entropy(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("content", F.concat(F.lit("<?php").cast("binary"), "content", F.lit("?>").cast("binary")))
    return scan.obfuscated(rows, threshold=4.2)


@query(f"WITH {LINES_SQL} SELECT path, line, unnest(regexp_extract_all(text, 'token = \"([0-9a-f]{{40}})\"', 1)) AS value FROM lines")
def credential_token_scan(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})"'), F.lit(1))
    return scan.lines_of(files(spark, sf_dir)).select("path", "line", F.explode(found).alias("value"))


@query(f"WITH {SNAPSHOTS_SQL} SELECT path, status FROM diff WHERE status <> 'identical'")
def stored_baseline_check(spark, sf_dir):
    """The diff against a baseline that was written as one version among two, and read back by its partition."""
    folder = new_folder(spark, "baseline")
    reference, target = map(diff.hashed, snapshots(spark, sf_dir))
    diff.save_baseline(reference, "1", folder)
    diff.save_baseline(target, "2", folder)
    return diff.baseline_diff(diff.load_baseline(spark, "1", folder), target).where("status <> 'identical'").select("path", "status")


@query(
    f"""WITH {UNIFIED_SQL} SELECT id, row_number() OVER (ORDER BY list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'], severity), path, rule_id) AS place FROM findings"""
)
def findings_sorted(spark, sf_dir):
    rows = _findings(spark, sf_dir).withColumn("_down", -C.severity_rank(F.col("severity")))
    return findings.numbered(rows, "_down", "path", "rule_id", prefix="").select("id", F.col("seq_id").cast("long").alias("place"))


@query(
    f"""WITH {UNIFIED_SQL} SELECT category, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
    count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) FILTER (WHERE severity = 'INFO') AS info, count(*) AS total FROM findings GROUP BY category"""
)
def report_sections(spark, sf_dir):
    return rollup.severity_matrix(_findings(spark, sf_dir))


TESTS_SQL = """tests AS (SELECT ['admin', 'export', 'upgrade'][(conv_id % 3 + 1)::INTEGER] AS suite, ['cookie', 'CSV', 'cron', 'other'][(turn % 4 + 1)::INTEGER] || ' ' || conv_id || '-' || turn AS test,
    CASE WHEN (conv_id + turn) % 4 = 0 THEN 'failed' WHEN (conv_id + turn) % 4 = 1 THEN 'skipped' ELSE 'passed' END AS status FROM conversations)"""


def _tests(spark, sf_dir):
    """Turns of conversations as runtime tests."""
    at = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    conv, turn = F.col("conv_id"), F.col("turn")
    name = F.concat(at(["cookie", "CSV", "cron", "other"], turn % 4), F.lit(" "), conv.cast("string"), F.lit("-"), turn.cast("string"))
    status = F.when((conv + turn) % 4 == 0, "failed").when((conv + turn) % 4 == 1, "skipped").otherwise("passed")
    return table(spark, sf_dir, "conversations").select(at(["admin", "export", "upgrade"], conv % 3).alias("suite"), name.alias("test"), status.alias("status"))


@query(f"WITH {TESTS_SQL} SELECT suite, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM tests GROUP BY suite")
def runtime_outcomes(spark, sf_dir):
    return rollup.outcomes(_tests(spark, sf_dir))


@query(
    f"""WITH {TESTS_SQL} SELECT suite || '/' || test AS path, CASE WHEN suite = 'admin' AND contains(test, 'cookie') THEN 'SEC071' WHEN suite = 'export' AND contains(test, 'CSV') THEN 'SEC070'
        WHEN suite = 'upgrade' AND contains(test, 'cron') THEN 'SEC063' ELSE 'RUNTIME' END AS rule_id FROM tests WHERE status = 'failed'"""
)
def runtime_findings(spark, sf_dir):
    return findings.from_runtime(_tests(spark, sf_dir)).select("path", "rule_id")


@query(f"WITH {UNIFIED_SQL} SELECT id, CASE WHEN regexp_matches(path, '\\.(php|js|md)$') THEN 'CRITICAL' ELSE severity END AS severity FROM findings WHERE rule_id LIKE 'WEB%'")
def signature_mismatch(spark, sf_dir):
    rows = _findings(spark, sf_dir).where(F.col("rule_id").startswith("WEB"))
    mismatches = files(spark, sf_dir).select("path", (~F.col("path").rlike(r"\.(php|js|md)$")).alias("is_match"))
    return findings.escalated(rows, mismatches).select("id", "severity")


@query(
    f"""WITH {FILES_SQL}, t AS (SELECT path, doc_id, unnest(list_distinct(regexp_split_to_array(lower(content), '[^a-z0-9/_@.-]+'))) AS token FROM files), p AS (SELECT * FROM t WHERE regexp_matches(token, '[/-]') AND length(token) > 3)
    SELECT token, count(DISTINCT path) AS files FROM p WHERE doc_id % 2 = 1 AND token IN (SELECT token FROM p WHERE doc_id % 2 = 0) GROUP BY token"""
)
def dependency_link(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("text", F.col("content").cast("string"))
    return findings.dependency_links(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"))


@query("SELECT doc_id, ['HIGH', 'MEDIUM', 'LOW', 'INFO', 'CRITICAL'][(doc_id % 5 + 1)::INTEGER] AS severity FROM documents")
def severity_alias(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ["error", " Warning", "note", "none", "critical"])), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", C.severity_named(name).alias("severity"))


CREDENTIAL_SQL = (
    FILES_SQL
    + """, c AS (SELECT doc_id, 'app' || doc_id || '/database.php' AS path, '<?php' || chr(10) || '$db = "x";' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '$extra' || doc_id % 5 || ' = 1;' ELSE '' END
        || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'eval($x);' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '$mysqli->query($mysqli);' ELSE '' END AS content FROM files)"""
)


@query(
    f"""WITH {CREDENTIAL_SQL} SELECT path, 'unexpected_variable' AS "check", 'HIGH' AS severity, 'extra' || doc_id % 5 AS detail FROM c WHERE doc_id % 2 = 0
    UNION ALL SELECT path, 'forbidden_pattern', 'CRITICAL', 'execution' FROM c WHERE doc_id % 3 = 0
    UNION ALL SELECT path, 'suspicious_connection', 'HIGH', '' FROM c WHERE doc_id % 7 = 0 UNION ALL SELECT path, 'arbitrary_sql', 'CRITICAL', '' FROM c WHERE doc_id % 7 = 0"""
)
def credential_files(spark, sf_dir):
    number = F.col("doc_id")
    extra = F.when(number % 2 == 0, F.concat(F.lit("\n$extra"), (number % 5).cast("string"), F.lit(" = 1;"))).otherwise("")
    content = F.concat(F.lit('<?php\n$db = "x";'), extra, F.when(number % 3 == 0, "\neval($x);").otherwise(""), F.when(number % 7 == 0, "\n$mysqli->query($mysqli);").otherwise(""))
    rows = files(spark, sf_dir).select(F.concat(F.lit("app"), number.cast("string"), F.lit("/database.php")).alias("path"), content.cast("binary").alias("content"))
    return scan.credential_file_checks(rows)
