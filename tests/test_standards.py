"""Standards of findings, policies of directories, reports of other tools: awkward rows."""

import json
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.operators import findings, investigation, manifest, scan, web
from corpusguard.sources import interop


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_standards_by_exact_rule(spark):
    raw = spark.createDataFrame([("SEC001",), ("SEC001x",), (None,), ("WEB004",), ("SEC001",)], "rule_id string")
    assert rows(findings.with_standards(raw)) == sorted(
        [("SEC001", "T1190", 9.8, "Exploit Public-Facing Application")] * 2 + [("SEC001x", None, None, None), (None, None, None, None), ("WEB004", "T1505.003", None, "Server Software Component: Web Shell")], key=str
    )
    assert set(findings.catalog.TECHNIQUES.values()) | {t for _, t in findings.catalog.STATIC_TECHNIQUES} <= set(findings.catalog.TECHNIQUE_NAMES)


def test_weaknesses_fill_what_is_empty(spark):
    raw = spark.createDataFrame([(1, "CWE-79", ""), (2, "79", None), (3, "cwe-79", "mine"), (4, "", ""), (5, None, None), (6, "CWE-1", "")], "n int, cwe_id string, recommendation string")
    known = spark.createDataFrame([("79", "XSS", "Encode."), ("CWE-79", "Xss again", None), ("", "none", "none"), (None, "none", "none")], "cwe_id string, name string, mitigation string")
    found = findings.with_weaknesses(raw, known).select("n", "cwe_name", "recommendation")
    assert rows(found) == [(1, "XSS", "Encode."), (2, "XSS", "Encode."), (3, "XSS", "mine"), (4, "", ""), (5, "", ""), (6, "", "")]
    assert rows(findings.with_weaknesses(raw.drop("recommendation"), known.where("false")).select("n", "recommendation")) == [(i, "") for i in range(1, 7)]


def test_static_results(spark):
    raw = spark.createDataFrame(
        [("a.sqli", "error", "p", 3, "Injection"), ("ssrf", "warning", None, None, None), ("x", "none", "p", 0, "plain"), ("y", None, "p", 1, "An upload by exec"), ("a.sqli", "error", "p", 3, "Injection")],
        "rule_id string, level string, uri string, start_line int, message string",
    ).withColumn("cwe_id", F.lit("89"))
    found = findings.from_static_sarif(raw, "static").select("rule_id", "severity", "category", "technique", "score", "confidence", "cwe_id", "path", "line")
    assert rows(found) == sorted(
        [("a.sqli", "HIGH", "injection", "T1190", 8.0, "HIGH", "CWE-89", "p", 3)] * 2
        + [("ssrf", "MEDIUM", "ssrf", "T1090", 5.5, "HIGH", "CWE-89", None, None), ("x", "INFO", "security", None, None, "HIGH", "CWE-89", "p", 0), ("y", "MEDIUM", "rce", "T1059.004", 5.5, "HIGH", "CWE-89", "p", 1)],
        key=str,
    )


def test_whole_sarif_results(spark):
    least = spark.createDataFrame([("R", "HIGH", "t", "f", "s", "LOW", "c")], "rule_id string, severity string, title string, fingerprint string, source string, confidence string, category string")
    text = least.select(interop.sarif_full_result(least)).first()[0]
    assert json.loads(text) == {"ruleId": "R", "level": "error", "message": {"text": "t"}, "fingerprints": {"finding/v1": "f"}, "properties": {"source": "s", "confidence": "LOW", "category": "c"}}
    full = least.selectExpr(
        "*", "'long' AS description", "'p' AS path", "3 AS line", "4 AS line_end", "1 AS column_start", "0 AS column_end", "'x' AS snippet", "'CWE-79' AS cwe_id", "'XSS' AS cwe_name", "'T1' AS technique",
        "'' AS technique_name", "7.5D AS score", "'CVE-1' AS cve_id", "array('b') AS corroborated_by", "array() AS related_ids", "'php' AS content_label", "false AS content_mismatch",
    )
    found = json.loads(full.select(interop.sarif_full_result(full)).first()[0])
    assert found["locations"] == [{"physicalLocation": {"artifactLocation": {"uri": "p", "uriBaseId": "%SRCROOT%"}, "region": {"startLine": 3, "endLine": 4, "startColumn": 1, "snippet": {"text": "x"}}}}]
    assert found["taxa"] == [{"toolComponent": {"name": "CWE"}, "id": "79", "name": "XSS"}] and found["message"] == {"text": "long"}
    assert found["properties"] == {"source": "s", "confidence": "LOW", "category": "c", "cwe": "CWE-79", "mitre_attack": {"technique_id": "T1"}, "cvss": {"base_score": 7.5}, "cve": "CVE-1", "corroborated_by": ["b"], "content_label": "php", "content_mismatch": False}
    no_line = full.withColumn("line", F.lit(0))
    assert "region" not in json.loads(no_line.select(interop.sarif_full_result(no_line)).first()[0])["locations"][0]["physicalLocation"]


def test_labels_of_contents(spark):
    contents = {
        "a.png": b"\x89PNG\r\n", "b.php": b"\x89PNG", "c.gz": b"\x1f\x8b\x08", "d.tar": b"\0" * 257 + b"ustar", "e.js": b"var x;", "f.css": b"<?php", "g.txt": b"", "h.md": b"# x", "i.db": b"SQLite format 3\0", "j.zip": b"PK\x03\x04",
        "k.xyz": b"MZ", "l": b"x", "m.php": b"plain", "n.webp": b"RIFF1234WEBP", "o.phar": b"PK\x03\x04", "p.svg": b"<svg/>", "q.jpg": b"PK\x03\x04",
    }
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in contents.items()] + [("z.php", None)], "path string, content binary")
    found = {r.path: (r.label, r.is_match, r.mismatch_severity) for r in findings.content_types(files).collect()}
    assert {p for p, x in found.items() if not x[1]} == {"b.php", "f.css", "m.php", "q.jpg", "z.php"}
    assert found["f.css"] == ("php", False, "critical") and found["q.jpg"] == ("zip", False, "suspicious") and found["b.php"] == ("png", False, "info") and found["n.webp"][0] == "webp" and found["d.tar"][0] == "tar"
    assert len(catalog.EXPECTED_LABELS) == 48


def test_policies_of_directories(spark):
    files = spark.createDataFrame(
        [("up/a.txt", b"x"), ("up/deep/b.php", b"1234"), ("up/b.phpx", b""), ("up/.htaccess", b"engine off"), ("temp/x", b""), ("temp/sub/.htaccess", b"engine off"), ("mod/.htaccess", b"on"), ("mod/.htaccess", b"engine off"), ("free/c.php", b""), ("top.php", b""), ("a/up/d.php", None)],
        "path string, content binary",
    )
    policies = spark.createDataFrame(
        [("up", [".php", ".phtml"], True, "engine off"), ("temp", None, True, None), ("mod", [], True, "engine off"), ("none", [".php"], True, ""), ("free", [".php"], False, "x"), (None, [".php"], True, "")], "directory string, forbidden array<string>, guarded boolean, must_contain string"
    )
    assert rows(scan.critical_directories(files, policies)) == [
        ("free", "forbidden_file", "CRITICAL", "free/c.php", "Size: 0 bytes"), ("mod", "htaccess_tampered", "CRITICAL", "mod/.htaccess", "missing engine off"),
        ("temp", "missing_htaccess", "HIGH", "temp/.htaccess", ""), ("up", "forbidden_file", "CRITICAL", "up/deep/b.php", "Size: 4 bytes"),
    ]
    assert rows(scan.critical_directories(files, policies.where("false"))) == [] == rows(scan.critical_directories(files.where("false"), policies))


def test_names_that_are_scanned(spark):
    names = [".htaccess", "x/.ENV", ".user.ini", "a.user.ini", "a.b.PHP", "php", ".php", "a.tar.gz", "a.php.gz", "b.", "..php", "c.txt", "", "a.env", "..."]
    def of_path(name):
        last = name.rsplit("/", 1)[-1].lower()
        suffixes = PurePosixPath(last).suffixes if last.strip(".") else []
        return last in catalog.SCANNABLE_DOT_FILES or "".join(suffixes) in catalog.SCANNABLE or bool(suffixes) and suffixes[-1] in catalog.SCANNABLE
    found = spark.createDataFrame([(n,) for n in names], "path string").select("path", scan.sensitive_scannable(F.col("path")).alias("s"))
    assert {r.path: r.s for r in found.collect()} == {n: of_path(n) for n in names}


def test_sensitive_data_as_findings(spark):
    raw = spark.createDataFrame([("p", 2, "ssn", "PII", s, True, "x") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], "path string, line int, data_type string, category string, severity string, hipaa boolean, snippet string")
    found = investigation.from_sensitive(raw)
    assert {(r.severity, r.conclusiveness) for r in found.collect()} == {("CRITICAL", "conclusive"), ("HIGH", "suspicious"), ("MEDIUM", "suspicious"), ("LOW", "informational")}
    assert {(r.title, r.category, r.recommendation) for r in found.collect()} == {("Sensitive data: ssn", "sensitive_pii", "Review ssn exposure in p:2. Redact or protect.")}


def test_lists_of_anomalies_are_arguments(spark):
    files = spark.createDataFrame([("up/own.xyz", bytearray(b"x")), ("drop/a.php", bytearray(b"x")), ("c2.php", bytearray(b"x"))], "path string, content binary")
    found = lambda **lists: {r.path: r.a for r in files.select("path", manifest.anomalies(F.col("path"), F.col("content"), lists=lists).alias("a")).collect()}
    mine = found(names=["own.xyz"], upload_dirs=["drop"], forbidden=[".xyz"])
    assert mine["up/own.xyz"] == ["anomalous_extension", "suspicious_filename"] and mine["drop/a.php"] == ["php_in_upload_directory"]
    assert found()["up/own.xyz"] == [] and manifest.manifest(files, lists={"names": ["own.xyz"]}).where("size(anomalies) > 0").count() == 1
    with pytest.raises(ValueError, match="no such lists"):
        found(odd=[])


def test_paths_of_anomalies(spark):
    raw = spark.createDataFrame([("a", ["phar_archive", "odd"]), ("b", ["phar_archive"]), ("b", ["phar_archive"]), ("c", []), ("d", None)], "path string, anomalies array<string>")
    assert rows(manifest.anomaly_paths(raw)) == [("phar_files", "phar_archive", "a"), ("phar_files", "phar_archive", "b"), ("unrouted", "odd", "a")]


@pytest.mark.parametrize("html, want", [(None, None), ("", None), (web.PAYLOAD, "raw"), ('&lt;script&gt;alert("probe")&lt;/script&gt;', "encoded"), ("<script>alert(1)</script>", None)])
def test_reflections(spark, html, want):
    found = web.reflected(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [r.reflection for r in found] == ([want] if want else [])
