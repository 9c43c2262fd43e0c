"""Investigations: indicators by their method, findings of other tools, database artifacts, and what they add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.catalogs import rules as rule_catalog
from corpusguard.functions import columns as C
from corpusguard.functions.matching import glob_matcher
from corpusguard.operators import findings, scan


def dangerous_calls(files: DataFrame) -> DataFrame:
    """``path, type, line, snippet``: calls and constructs of code that are dangerous by themselves, outside comments.

    Told by patterns and not by a syntax tree: a call inside a string literal counts too.
    """
    rules = [(kind, "INFO", "code", pattern, "") for kind, pattern in rule_catalog.DANGEROUS_PATTERNS]
    return scan.rule_scan(files, rules, 80).select("path", F.col("rule_id").alias("type"), "line", "snippet")


def content_indicators(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``path, ioc_id, line, text``: every match of each indicator's pattern, comments included, its line cut at 120 characters."""
    rules = [(i, "HIGH", "ioc", p, "") for i, p in patterns.items()]
    return scan.rule_scan(files, rules, 120, comments=True).select("path", F.col("rule_id").alias("ioc_id"), "line", F.col("snippet").alias("text"))


def hash_indicators(files: DataFrame, globs: dict[str, str]) -> DataFrame:
    """``path, ioc_id, sha256``: the digests of the files that each indicator lists."""
    met = glob_matcher(files.sparkSession, globs.items())(F.col("path"))
    return files.select("path", "content", F.explode(met).alias("ioc_id")).select("path", "ioc_id", F.sha2("content", 256).alias("sha256"))


def polyglot_images(files: DataFrame) -> DataFrame:
    """``path``: files with the extension of an image and code in their content."""
    code = F.decode("content", "ISO-8859-1").contains("<?")
    return files.where(C.extension(F.col("path")).isin(catalog.IMAGE_EXTENSIONS) & code).select("path")


def indicators(files: DataFrame, catalogue: list[dict]) -> DataFrame:
    """``path, ioc_id, method, line, detail`` of indicators ``{id, method, value}``, each by its method.

    Methods: ``file_exists`` and ``directory_exists`` (globs), ``file_content`` and
    ``regex`` (patterns), ``file_location`` (directory to extensions), ``content_check``
    (images with code) and ``hash_compare`` (globs). One pass serves all indicators of a
    method; others are another operator's and are left out.
    """
    by = {}
    for entry in catalogue:
        by.setdefault({"regex": "file_content"}.get(entry["method"], entry["method"]), {})[entry["id"]] = entry.get("value")

    def shaped(df: DataFrame, method: str, line: str = "0", detail: str = "''", path: str = "path", ioc: str = "ioc_id") -> DataFrame:
        return df.selectExpr(f"{path} AS path", f"{ioc} AS ioc_id", f"'{method}' AS method", f"CAST({line} AS INT) AS line", f"{detail} AS detail")

    parts = []
    if "file_exists" in by:
        parts.append(shaped(scan.path_indicators(files, by["file_exists"]), "file_exists"))
    if "directory_exists" in by:
        parts.append(shaped(scan.directory_indicators(files, by["directory_exists"]), "directory_exists", path="dir"))
    if "file_content" in by:
        parts.append(shaped(content_indicators(files, by["file_content"]), "file_content", "line", "text"))
    for ioc, forbidden in by.get("file_location", {}).items():
        parts.append(shaped(scan.location_indicators(files, forbidden), "file_location", detail="directory", ioc=f"'{ioc}'"))
    for ioc in by.get("content_check", {}):
        parts.append(shaped(polyglot_images(files), "content_check", ioc=f"'{ioc}'"))
    if "hash_compare" in by:
        parts.append(shaped(hash_indicators(files, by["hash_compare"]), "hash_compare", detail="sha256"))
    return reduce(DataFrame.unionByName, parts)


def investigation(rows: DataFrame, source: str, conclusiveness: Column | None = None) -> DataFrame:
    """Findings of an investigation: those of :func:`findings.unified` with how conclusive they are.

    By default a critical finding is conclusive, a high one suspicious, any other informational.
    """
    own = C.looked_up(F.col("severity"), {"CRITICAL": "conclusive", "HIGH": "suspicious"}, "informational")
    return findings.unified(rows, source).withColumn("conclusiveness", own if conclusiveness is None else conclusiveness)


def from_signatures(matches: DataFrame) -> DataFrame:
    """Signature matches ``(rule, target)`` as findings of high severity and confidence, with the default technique."""
    rows = matches.select(F.concat(F.lit("YARA-"), F.coalesce("rule", F.lit("UNKNOWN"))).alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("malware").alias("category"), F.coalesce("target", F.lit("")).alias("path"), F.lit(0).alias("line"), F.lit("").alias("snippet"), F.lit("").alias("cwe_id"))
    return findings.unified(rows, "yara", confidence="HIGH").withColumn("technique", F.lit("T1505.003"))


def from_sensitive(found: DataFrame) -> DataFrame:
    """Sensitive data as findings of an investigation; critical matches are conclusive, high and medium ones suspicious."""
    place = F.concat_ws(":", "path", F.col("line").cast("string"))
    rows = found.select(
        F.col("data_type").alias("rule_id"), "severity", F.concat(F.lit("sensitive_"), F.lower("category")).alias("category"), "path", "line", "snippet", F.lit("").alias("cwe_id"),
        F.concat(F.lit("Sensitive data: "), "data_type").alias("title"), F.concat(F.lit("Review "), "data_type", F.lit(" exposure in "), place, F.lit(". Redact or protect.")).alias("recommendation"), "hipaa",
    )
    conclusive = C.looked_up(F.col("severity"), {"CRITICAL": "conclusive", "HIGH": "suspicious", "MEDIUM": "suspicious"}, "informational")
    return findings.unified(rows, "sensitive_data", title=F.col("title"), keep=("recommendation", "hipaa")).withColumn("conclusiveness", conclusive)


def signatures_investigated(matches: DataFrame) -> DataFrame:
    """Signature matches as findings of an investigation: suspicious, whatever the rule."""
    rows = matches.select(F.coalesce("rule", F.lit("?")).alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("malware").alias("category"), F.coalesce("target", F.lit("")).alias("path"), F.lit(0).alias("line"), F.lit("").alias("snippet"), F.lit("").alias("cwe_id"))
    return investigation(rows, "external_tool", F.lit("suspicious"))


def signature_tiers(matches: DataFrame) -> DataFrame:
    """One row: signature matches, critical ones by exact name, high ones by a word in the name."""
    lower = F.lower("rule")
    high = reduce(lambda a, b: a | b, [lower.contains(w) for w in rule_catalog.HIGH_SIGNATURE_WORDS])
    return matches.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("rule").isin(rule_catalog.CRITICAL_SIGNATURES)).alias("critical"), F.count_if(high).alias("high"))


def from_dependencies(rows: DataFrame) -> DataFrame:
    """Results ``(rule_id, level, message, uri, start_line, cwe_id, given_severity, given_score)`` of a dependency scanner as findings.

    Vulnerability ids make a dependency finding with a score, given or by severity; all
    others are exposed secrets.
    """
    known = {s: s for s in catalog.SEVERITIES} | {"UNKNOWN": "INFO"}
    by_level = C.looked_up(F.col("level"), {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"}, "MEDIUM")
    is_cve = F.col("rule_id").rlike("^(?:CVE|GHSA)-")
    shaped = rows.select(
        "rule_id", F.coalesce(C.looked_up(F.upper("given_severity"), known), by_level).alias("severity"), F.when(is_cve, "dependency_vulnerability").otherwise("secret_exposure").alias("category"),
        F.col("uri").alias("path"), F.col("start_line").alias("line"), F.col("message").alias("snippet"), "cwe_id", "given_score",
    )
    found = findings.unified(shaped, "trivy", confidence="CONFIRMED", keep=("given_score",))
    given = F.coalesce(F.col("given_score"), F.lit(0.0))
    score = F.when(given > 0, given).when(is_cve, representative_score(F.col("severity")))
    return found.select("*", F.when(is_cve, F.col("rule_id")).otherwise("").alias("cve_id"), score.alias("score"), F.when(is_cve, "T1195.001").otherwise("T1552.001").alias("technique")).drop("given_score")


def representative_score(severity: Column) -> Column:
    """A score that stands for a severity."""
    return C.literal_map({k: float(v) for k, v in catalog.SEVERITY_SCORES.items()})[severity]


def dependency_split(rows: DataFrame) -> DataFrame:
    """One row: dependency findings, vulnerabilities and secrets among them, distinct vulnerability ids."""
    cve = F.col("cve_id") != ""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(cve).alias("cves"), F.count_if(~cve).alias("secrets"), F.countDistinct(F.when(cve, F.col("cve_id"))).alias("distinct_cves"))


def config_findings(checks: DataFrame) -> DataFrame:
    """Rows of :func:`scan.config_checks` or :func:`scan.credential_file_checks` as conclusive findings of tampering."""
    detail = F.col("detail") if "detail" in checks.columns else F.lit("")
    rows = checks.select(F.col("check").alias("rule_id"), "severity", F.lit("config_tamper").alias("category"), "path", F.lit(0).alias("line"), detail.alias("snippet"), F.lit("").alias("cwe_id"))
    return investigation(rows, "config_check", F.when(F.col("severity").isin("CRITICAL", "HIGH"), "conclusive").otherwise("suspicious"))


def database_artifacts(files: DataFrame, known: list[str], expected: tuple[str, ...] = ("edocs", "temp")) -> DataFrame:
    """``path, type, severity, size_bytes``: database files known from attacks, and others outside the places where they are expected."""
    path, named = F.col("path"), C.filename(F.col("path")).isin(known)
    odd = C.extension(path).isin(".db", ".sqlite", ".sqlite3") & ~reduce(lambda a, b: a | b, [path.contains(e) for e in expected])
    rows = files.select("path", F.when(named, "known_database").when(odd, "unexpected_database").alias("type"), F.when(named, "CRITICAL").otherwise("HIGH").alias("severity"), F.length("content").cast("long").alias("size_bytes"))
    return rows.where("type IS NOT NULL")


def database_report(artifacts: DataFrame) -> DataFrame:
    """One row: artifacts, by severity, and whether one is known from attacks."""
    return artifacts.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"), F.coalesce(F.bool_or(F.col("type") == "known_database"), F.lit(False)).alias("has_known"))


def with_content_types(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Findings with the content type of their file, and whether it contradicts the extension."""
    told = types.select(F.col("path").alias("_path"), F.col("label").alias("content_label"), (~F.col("is_match")).alias("content_mismatch"))
    joined = rows.join(told, F.col("path") == F.col("_path"), "left").drop("_path")
    return joined.withColumn("content_mismatch", F.coalesce("content_mismatch", F.lit(False)))


def mismatch_severity(ext_label: Column, label: Column, score: Column) -> Column:
    """The severity of a content type that contradicts the extension: pairs known from attacks first, then by kind."""
    pair = C.literal_map({f"{a}/{b}": s for (a, b), s in rule_catalog.MISMATCH_PAIRS.items()})[F.concat_ws("/", ext_label, label)]
    general = F.when(label.isin(rule_catalog.ACTIVE_LABELS + rule_catalog.DATABASE_LABELS) | (score >= 0.5), "suspicious").otherwise("info")
    return F.when((F.coalesce(ext_label, F.lit("")) == "") | (F.coalesce(label, F.lit("")) == ""), "none").otherwise(F.coalesce(pair, general))


def vectors_assessed(rows: DataFrame, vectors: dict[str, dict]) -> DataFrame:
    """``fingerprint, vector``: attack vectors ``{iocs, words}`` of findings: a common indicator, or a word in title or category."""
    text = F.lower(F.concat_ws(" ", "title", "category"))
    met = []
    for name, v in vectors.items():
        test = F.arrays_overlap("ioc_ids", F.array(*map(F.lit, v.get("iocs") or [""])))
        met.append(F.when(reduce(lambda a, w: a | text.contains(w), [w for w in v.get("words", []) if len(w) > 3], test), name))
    return rows.select("fingerprint", F.explode(F.filter(F.array(*met), lambda x: x.isNotNull())).alias("vector")).distinct()


def vector_summary(met: DataFrame, vectors: dict) -> DataFrame:
    """One row: how many vectors were assessed, and how many were hit."""
    return met.agg(F.lit(len(vectors)).cast("long").alias("assessed"), F.countDistinct("vector").alias("hit"))


def risk(rows: DataFrame) -> DataFrame:
    """One row: counters of findings with a conclusiveness, and the risk level that they give."""
    is_ = lambda c, v: F.count_if(F.col(c) == v).alias(v.lower())
    row = rows.agg(*[is_("conclusiveness", v) for v in ("conclusive", "suspicious")], *[is_("severity", v) for v in ("CRITICAL", "HIGH", "MEDIUM")], F.count(F.lit(1)).alias("total"))
    high = (F.col("suspicious") >= 3) | (F.col("high") >= 3)
    medium = (F.col("suspicious") >= 1) | (F.col("high") >= 1) | (F.col("medium") >= 3)
    level = F.when((F.col("conclusive") > 0) | (F.col("critical") > 0), "CRITICAL").when(high, "HIGH").when(medium, "MEDIUM").when(F.col("total") > 0, "LOW").otherwise("CLEAN")
    return row.withColumn("risk", level)


def export_checks(texts: DataFrame, kind: str = "mime") -> DataFrame:
    """Rows of ``texts(text, mime)`` that hold code although they are no code files: all columns and ``markers``."""
    marks = {"eval": r"eval\s*\(", "base64": r"base64_decode\s*\(", "php": r"(?i)<\?php"}
    found = F.filter(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in marks.items()]), lambda x: x.isNotNull())
    return texts.where(~F.col(kind).contains("php")).withColumn("markers", F.array_join(found, ",")).where("markers <> ''")


def counts_by_source(corroborated: DataFrame) -> DataFrame:
    """``source, n, corroborated``: findings of each source, and those that another source confirms."""
    return corroborated.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("corroborated_by") > 0).alias("corroborated"))


def recommendations(rows: DataFrame) -> DataFrame:
    """``category, recommendation, severity, n``: distinct non-empty recommendations by category, with their worst severity."""
    kept = rows.where(F.coalesce("recommendation", F.lit("")) != "")
    worst = F.max_by("severity", C.severity_rank(F.col("severity")))
    return kept.groupBy("category", "recommendation").agg(worst.alias("severity"), F.count(F.lit(1)).alias("n")).orderBy("category", "recommendation")


def ranked_files(suspicious: DataFrame) -> DataFrame:
    """Suspicious files numbered from the worst: by severity, then signals, then path."""
    rows = suspicious.withColumns({"_rank": -F.col("max_rank"), "_signals": -F.col("n_signals")})
    return findings.numbered(rows, "_rank", "_signals", "path", prefix="").withColumn("place", F.col("seq_id").cast("long")).drop("_rank", "_signals", "seq_id")


def most_common(counts: DataFrame) -> DataFrame:
    """Counts ``(key, value, n)`` with their ``place`` within each key: the most common first, ties by value."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "value")))
