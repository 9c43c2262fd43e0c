"""Roll-ups of findings: counts, risk, suspicious files and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.catalogs import rules as rule_catalog
from corpusguard.functions import columns as C
from corpusguard.functions.ranges import first_of_group
from corpusguard.functions.session import checkpointed


def severity_counts(findings: DataFrame) -> DataFrame:
    """A row for each severity, zeros included."""
    levels = findings.sparkSession.createDataFrame([(s,) for s in catalog.SEVERITIES], "severity string")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by(findings: DataFrame, *keys: str) -> DataFrame:
    """``key, value, n`` for several attributes in one pass."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    return findings.select(each).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def risk_level(findings: DataFrame) -> DataFrame:
    """One row: the counters of the ladder and the level they give."""
    is_ = lambda s: F.count_if(F.col("severity") == s)
    counters = findings.agg(is_("CRITICAL").alias("critical"), is_("HIGH").alias("high"), is_("MEDIUM").alias("medium"), F.count(F.lit(1)).alias("total"))
    level = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") >= 3, "HIGH").when((F.col("high") >= 1) | (F.col("medium") >= 3), "MEDIUM").when(F.col("total") > 0, "LOW").otherwise("CLEAN")
    return counters.withColumn("risk", level)


def suspicious_files(findings: DataFrame, mismatches: DataFrame | None = None, max_signals: int = 10) -> DataFrame:
    """Files with signals of two sources, a critical one or a content-type mismatch, with their strongest signals."""
    rank = C.severity_rank(F.col("severity"))
    signals = checkpointed(findings.groupBy("path", "source", "rule_id").agg(F.max(rank).alias("rank")).withColumn("name", F.concat_ws(":", "source", "rule_id")))
    # the sources of a path are few; of its signals no task holds more than are shown
    rows = signals.groupBy("path").agg(F.max("rank").alias("max_rank"), F.count(F.lit(1)).alias("n_signals"), F.sort_array(F.collect_set("source")).alias("sources"))
    strongest = first_of_group(signals, "path", max_signals, F.desc("rank"), "name")
    strongest = strongest.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("down"), "name"))), lambda x: x["name"]).alias("signals"))
    rows = rows.join(strongest, "path")
    if mismatches is None:
        rows = rows.withColumn("mismatch", F.lit(False))
    else:
        bad = mismatches.where(~F.col("is_match")).select("path").distinct().withColumn("bad", F.lit(True))
        rows = rows.join(bad, "path", "full_outer").withColumn("mismatch", F.coalesce("bad", F.lit(False))).drop("bad")
        empty = F.array().cast("array<string>")
        rows = rows.select("path", F.coalesce("max_rank", F.lit(0)).alias("max_rank"), F.coalesce("n_signals", F.lit(0)).alias("n_signals"), F.coalesce("sources", empty).alias("sources"), F.coalesce("signals", empty).alias("signals"), "mismatch")
    return rows.where((F.size("sources") >= 2) | (F.col("max_rank") == 4) | F.col("mismatch"))


def capped_by_category(findings: DataFrame, most: int = 500) -> DataFrame:
    """The ``most`` findings of each category that are most severe, ties by path, line and rule: what a report shows."""
    return first_of_group(findings, "category", most, F.desc(C.severity_rank(F.col("severity"))), "path", "line", "rule_id")


def tactic_matrix(findings: DataFrame) -> DataFrame:
    """Findings by tactic and technique, zeros included; findings need a ``technique``."""
    pairs = [(t, x) for t, xs in rule_catalog.TACTICS.items() for x in xs]
    matrix = findings.sparkSession.createDataFrame(pairs, "tactic string, technique string")
    counts = findings.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))
    return matrix.join(counts, "technique", "left").groupBy("tactic").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.count_if(F.col("n") > 0).alias("techniques_met"))


def sensitive_report(found: DataFrame) -> DataFrame:
    """``key, value, n`` of sensitive data by type, category and severity."""
    return counts_by(found, "data_type", "category", "severity")


def privacy_summary(found: DataFrame) -> DataFrame:
    """One row: findings, those that count for health privacy, and their percentage."""
    row = found.agg(F.count(F.lit(1)).alias("total"), F.count_if("hipaa").alias("hipaa"))
    return row.withColumn("percent", C.percent(F.col("hipaa"), F.col("total")))


def corpus_metrics(texts: DataFrame, name: str) -> DataFrame:
    """One row: files, characters, bytes and words of a corpus."""
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    return texts.agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(words).alias("words")).select(F.lit(name).alias("corpus"), "*")


def corpus_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """``metric, a, b, delta, percent`` of two one-row metric tables."""
    metrics = ["files", "chars", "bytes", "words"]
    both = a.select(*[F.col(m).alias(f"a_{m}") for m in metrics]).crossJoin(F.broadcast(b.select(*[F.col(m).alias(f"b_{m}") for m in metrics])))  # one row each
    rows = both.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("a"), F.col(f"b_{m}").alias("b")) for m in metrics])))
    return rows.withColumn("delta", F.col("b") - F.col("a")).withColumn("percent", C.percent(F.col("b") - F.col("a"), F.col("a"), 2))


def severity_matrix(findings: DataFrame) -> DataFrame:
    """A report table: findings of each category by severity."""
    per = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(catalog.SEVERITIES)]
    return findings.groupBy("category").agg(*per, F.count(F.lit(1)).alias("total"))


def outcomes(tests: DataFrame) -> DataFrame:
    """Passed, failed and skipped runtime tests by suite."""
    s = F.col("status")
    return tests.groupBy("suite").agg(F.count_if(s == "passed").alias("passed"), F.count_if(s == "failed").alias("failed"), F.count_if(s.isin("skipped", "pending")).alias("skipped"))
