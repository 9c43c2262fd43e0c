"""Baseline diffs of two snapshots, and findings about what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.functions import columns as C


def hashed(files: DataFrame) -> DataFrame:
    """``path, hash, size`` (and ``modified_at`` if there is one): what a diff shuffles in place of contents."""
    times = ["modified_at"] if "modified_at" in files.columns else []
    return files.where(~C.skipped(F.col("path"))).select("path", F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size"), *times)


def baseline_diff(reference: DataFrame, target: DataFrame) -> DataFrame:
    """``path, status, ref_hash, tgt_hash, size`` of two hashed snapshots, by a full outer join on the path; and ``modified_at`` of the target if it tells."""
    times = ["modified_at"] if "modified_at" in target.columns else []
    a = reference.select("path", F.col("hash").alias("ref_hash"))
    b = target.select("path", F.col("hash").alias("tgt_hash"), "size", *times)
    status = F.when(F.col("ref_hash").isNull(), "added").when(F.col("tgt_hash").isNull(), "removed").when(F.col("ref_hash") == F.col("tgt_hash"), "identical").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"), "ref_hash", "tgt_hash", "size", *times)


def delta(diff: DataFrame) -> DataFrame:
    """The paths that scans need to read: added and modified, without expected additions."""
    return diff.where((F.col("status") == "modified") | ((F.col("status") == "added") & ~expected_addition(F.col("path")))).select("path")


def restricted(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files on the given paths; the narrow side decides before contents are scanned."""
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def expected_addition(path: Column) -> Column:
    found = F.lit(False)
    for prefix in catalog.EXPECTED_ADDITIONS:
        found = found | path.startswith(prefix)
    return found


def addition_severity(path: Column) -> Column:
    lower = F.lower(path)
    return (
        F.when(lower.rlike(r"\.(php|phtml|phar|php5|php7)$"), "CRITICAL").when(lower.endswith(".js"), "HIGH").when(lower.rlike(r"\.(sh|bash|bat|cmd|ps1)$"), "HIGH")
        .when(lower.contains(".htaccess") | lower.contains(".user.ini"), "CRITICAL").otherwise("MEDIUM")
    )


def modification_severity(path: Column) -> Column:
    lower = F.lower(path)
    name = C.filename(lower)
    critical = name.isin("hooks.php", "upgrade.php", "authentication.php", "auth_functions.php") | name.contains(".htaccess") | name.contains(".user.ini")
    return F.when(critical, "CRITICAL").when(name.isin("database.php", "webdav.php", "webdav_module.xml"), "MEDIUM").when(lower.endswith(".php"), "HIGH").otherwise("MEDIUM")


def modification_advice(path: Column) -> Column:
    """What to do about a modified file, by its name."""
    lower = F.lower(path)
    name = C.filename(lower)
    return (
        F.when(name == "hooks.php", "A file of hooks was changed: a first place for code that is to stay.").when(name == "upgrade.php", "The upgrade was changed: what it installs may be compromised.")
        .when(name.isin("authentication.php", "auth_functions.php"), "Authentication was changed: credentials may be at risk.").when(name.contains(".htaccess"), "Look for files that are prepended to others.")
        .when(name.contains(".user.ini"), "Look for settings that run code.").when(name == "database.php", "Expected to differ: it holds local credentials.")
        .when(name.isin("webdav.php", "webdav_module.xml"), "Expected to differ: it is of one installation.").when(lower.endswith(".php"), "Code was changed: verify it by hand.")
        .otherwise("Find out whether the change is intended.")
    )


def diff_findings(diff: DataFrame) -> DataFrame:
    """A finding for each unexpected change, with its message and what to do about it; a time of change stays if the diff has one."""
    path, status = F.col("path"), F.col("status")
    changed = diff.where(status.isin("removed", "modified") | ((status == "added") & ~expected_addition(path)))
    severity = F.when(status == "added", addition_severity(path)).when(status == "modified", modification_severity(path)).otherwise("HIGH")
    short = lambda c: F.concat(F.substring(c, 1, 12), F.lit("..."))
    message = (
        F.when(status == "added", "The file is not in the reference.").when(status == "removed", "The file of the reference is missing.")
        .otherwise(F.concat(F.lit("Hash mismatch: reference "), short("ref_hash"), F.lit(", target "), short("tgt_hash")))
    )
    advice = F.when(status == "added", "Verify its origin.").when(status == "removed", "Verify that it was meant to go.").otherwise(modification_advice(path))
    times = ["modified_at"] if "modified_at" in diff.columns else []
    return changed.select("path", "status", severity.alias("severity"), "ref_hash", "tgt_hash", "size", message.alias("message"), advice.alias("recommendation"), *times)


def validation_findings(diff: DataFrame) -> DataFrame:
    """Findings against a stored baseline: every added file is high, whatever it is; others as in :func:`diff_findings`."""
    severity = F.when(F.col("status") == "added", "HIGH").otherwise(F.col("severity"))
    return diff_findings(diff).withColumn("severity", severity)


def suspicious_changes(diff: DataFrame, large: int = 50_000) -> DataFrame:
    """A row for each suspicious tag of an added or modified file."""
    path, name, ext = F.lower("path"), F.lower(C.filename(F.col("path"))), C.extension(F.col("path"))
    tags = {
        "php_in_data_dir": ext.isin(".php", ".phtml") & C.in_dirs(path, catalog.UPLOAD_DIRS),
        "hidden_php": name.startswith(".") & (ext == ".php"),
        "large_php": (ext == ".php") & (F.col("size") > large),
        "hash_named": name.rlike(r"^[0-9a-f]{32,}"),
    }
    changed = diff.where(F.col("status").isin("added", "modified"))
    found = F.filter(F.array(*[F.when(c, n) for n, c in tags.items()]), lambda x: x.isNotNull())
    return changed.select("path", "status", F.explode(found).alias("tag"))


def save_baseline(hashes: DataFrame, version: str, folder: str) -> None:
    """Writes a baseline as the partition of its version."""
    hashes.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(folder)


def load_baseline(spark, version: str, folder: str) -> DataFrame:
    """Reads a baseline; only its partition is listed."""
    return spark.read.parquet(folder).where(F.col("version") == version).drop("version")


def rollup(diff: DataFrame) -> DataFrame:
    """One row: counts by status, and whether nothing unexpected changed."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "identical")]
    unexpected = F.count_if(F.col("status").isin("removed", "modified") | ((F.col("status") == "added") & ~expected_addition(F.col("path"))))
    return diff.agg(*counts, (unexpected == 0).alias("is_clean"))


def audit_summary(diff: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files by status, the delta, findings by severity, and a sentence that says so."""
    status = F.col("status")
    files = diff.agg(*[F.count_if(status == s).alias(s) for s in ("added", "removed", "modified", "identical")], F.count_if((status == "modified") | ((status == "added") & ~expected_addition(F.col("path")))).alias("delta"))
    found = findings.agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("CRITICAL", "HIGH")])
    row = files.crossJoin(found)  # one row each
    sentence = F.format_string(
        "%d added, %d removed, %d modified, %d identical; %d findings in %d files, %d critical, %d high", "added", "removed", "modified", "identical", "findings", "delta", "critical", "high"
    )
    return row.withColumn("summary", sentence)
