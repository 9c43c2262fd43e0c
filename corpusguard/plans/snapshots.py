"""Queries about files: manifests, diffs and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.functions import columns as C
from corpusguard.operators import chunks, diff, manifest, rollup
from corpusguard.plans.registry import FILES_SQL, PLANTED_SQL, SNAPSHOTS_SQL, files, planted, query, snapshots
from corpusguard.sources import sinks


def _diff(spark, sf_dir):
    reference, target = snapshots(spark, sf_dir)
    return diff.baseline_diff(diff.hashed(reference), diff.hashed(target))


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


FIRST_CATEGORY: dict = {}
for _name, _extensions in catalog.CATEGORIES.items():
    for _e in _extensions:
        FIRST_CATEGORY.setdefault(_e, _name)

EXT_SQL = "regexp_extract(path, '(\\.[a-z]+)$', 1)"


@query(f"WITH {SNAPSHOTS_SQL} SELECT path, status, ref_hash, tgt_hash, size FROM diff")
def baseline_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"WITH {SNAPSHOTS_SQL} SELECT path FROM diff WHERE status IN ('added', 'modified')")
def baseline_delta(spark, sf_dir):
    return diff.delta(_diff(spark, sf_dir))


@query(
    f"""WITH {SNAPSHOTS_SQL} SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed,
    count(*) FILTER (WHERE status = 'modified') AS modified, count(*) FILTER (WHERE status = 'identical') AS identical,
    count(*) FILTER (WHERE status <> 'identical') = 0 AS is_clean FROM diff"""
)
def audit_rollup(spark, sf_dir):
    return diff.rollup(_diff(spark, sf_dir))


@query(
    f"""WITH {SNAPSHOTS_SQL} SELECT path, status, ref_hash, tgt_hash, size,
    CASE WHEN status = 'added' THEN CASE WHEN path LIKE '%.php' THEN 'CRITICAL' WHEN path LIKE '%.js' THEN 'HIGH' ELSE 'MEDIUM' END
         WHEN status = 'removed' OR path LIKE '%.php' THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    CASE status WHEN 'added' THEN 'The file is not in the reference.' WHEN 'removed' THEN 'The file of the reference is missing.'
        ELSE 'Hash mismatch: reference ' || ref_hash[1:12] || '..., target ' || tgt_hash[1:12] || '...' END AS message,
    CASE WHEN status = 'added' THEN 'Verify its origin.' WHEN status = 'removed' THEN 'Verify that it was meant to go.' WHEN path LIKE '%.php' THEN 'Code was changed: verify it by hand.'
        ELSE 'Find out whether the change is intended.' END AS recommendation
    FROM diff WHERE status <> 'identical'"""
)
def diff_findings(spark, sf_dir):
    return diff.diff_findings(_diff(spark, sf_dir))


@query(f"WITH {SNAPSHOTS_SQL} SELECT path, status, 'large_php' AS tag FROM diff WHERE status IN ('added', 'modified') AND path LIKE '%.php' AND size > 3000")
def snapshot_suspicious(spark, sf_dir):
    return diff.suspicious_changes(_diff(spark, sf_dir), large=3000)


@query(
    f"""WITH {FILES_SQL} SELECT path, list_last(string_split(path, '/')) AS filename, {EXT_SQL} AS extension, 2 AS depth FROM files"""
)
def path_parts(spark, sf_dir):
    return manifest.path_parts(files(spark, sf_dir)).select("path", "filename", "extension", "depth")


@query(f"WITH {FILES_SQL} SELECT path, octet_length(encode(content)) AS size_bytes, sha256(content) AS sha256, md5(content) AS md5 FROM files")
def manifest_hashes(spark, sf_dir):
    rows = files(spark, sf_dir)
    return rows.select("path", F.length("content").cast("long").alias("size_bytes"), C.hash_of(F.col("content"), "sha256").alias("sha256"), C.hash_of(F.col("content"), "md5").alias("md5"))


@query(
    f"""WITH {FILES_SQL}, e AS (SELECT path, {EXT_SQL} AS extension FROM files)
    SELECT path, {_case("extension", FIRST_CATEGORY, "other")} AS category, {_case("extension", catalog.LANGUAGES, "")} AS language,
    {_case("extension", catalog.MIME_TYPES, "application/octet-stream")} AS mime_type FROM e"""
)
def file_category(spark, sf_dir):
    ext = C.extension(F.col("path"))
    return files(spark, sf_dir).select("path", C.category(ext).alias("category"), C.language(ext).alias("language"), C.mime_type(ext).alias("mime_type"))


ENTROPY_SQL = (
    FILES_SQL
    + """, bytes AS (
        SELECT path, unnest(regexp_extract_all(hex(encode(content)), '..')) AS b FROM files
    ), counts AS (SELECT path, b, count(*) AS n FROM bytes GROUP BY path, b), totals AS (SELECT path, sum(n) AS t FROM counts GROUP BY path),
    e AS (SELECT path, CASE WHEN t < 50 THEN 0.0 ELSE round(-sum(n / t * log2(n / t)), 4) END AS entropy FROM counts JOIN totals USING (path) GROUP BY path, t)"""
)


@query(f"WITH {ENTROPY_SQL} SELECT files.path, coalesce(entropy, 0.0) AS entropy FROM files LEFT JOIN e ON files.path = e.path")
def entropy(spark, sf_dir):
    return files(spark, sf_dir).select("path", manifest.byte_entropy(F.col("content")).alias("entropy"))


@query(f"WITH {ENTROPY_SQL} SELECT CASE WHEN entropy > 4.6 THEN 'suspicious' WHEN entropy > 4.2 THEN 'elevated' ELSE 'normal' END AS assessment, count(*) AS n FROM e GROUP BY 1")
def entropy_assessment(spark, sf_dir):
    rows = files(spark, sf_dir).select(C.entropy_assessment(manifest.byte_entropy(F.col("content")), 4.6, 4.2).alias("assessment"))
    return rows.groupBy("assessment").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ENTROPY_SQL} SELECT path, entropy FROM e WHERE entropy > 0 ORDER BY entropy DESC, path LIMIT 20")
def top_entropy(spark, sf_dir):
    rows = files(spark, sf_dir).select("path", manifest.byte_entropy(F.col("content")).alias("entropy"))
    return rows.where("entropy > 0").orderBy(F.desc("entropy"), "path").limit(20)


@query(f"WITH {FILES_SQL} SELECT path, octet_length(encode(content)) AS size_bytes FROM files ORDER BY 2 DESC, path LIMIT 20")
def top_largest(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.length("content").cast("long").alias("size_bytes")).orderBy(F.desc("size_bytes"), "path").limit(20)


@query(
    f"""WITH {FILES_SQL} SELECT {EXT_SQL} AS extension, count(*) AS files, sum(octet_length(encode(content)))::BIGINT AS bytes,
    round(sum(octet_length(encode(content))) / count(*), 3) AS mean_bytes FROM files GROUP BY 1"""
)
def directory_profile(spark, sf_dir):
    rows = files(spark, sf_dir).select(C.extension(F.col("path")).alias("extension"), F.length("content").alias("size_bytes"))
    return manifest.directory_profile(rows)


@query(
    f"""WITH {FILES_SQL}, e AS (SELECT {EXT_SQL} AS extension FROM files), c AS (SELECT extension, {_case("extension", FIRST_CATEGORY, "other")} AS category FROM e)
    SELECT 'extension' AS key, extension AS value, count(*) AS n FROM c GROUP BY extension UNION ALL SELECT 'category', category, count(*) FROM c GROUP BY category"""
)
def manifest_breakdowns(spark, sf_dir):
    ext = C.extension(F.col("path"))
    return manifest.breakdowns(files(spark, sf_dir).select(ext.alias("extension"), C.category(ext).alias("category")), "extension", "category")


FLAGGED_SQL = (
    PLANTED_SQL
    + """, placed AS (
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'uploads/' WHEN 1 THEN '.user.ini/' ELSE '' END || path || CASE doc_id % 9 WHEN 0 THEN '.php.jpg' WHEN 1 THEN '.phar' WHEN 2 THEN '-wal' ELSE '' END AS path, content
        FROM planted
    ), x AS (SELECT path, content, CASE doc_id % 9 WHEN 0 THEN '.jpg' WHEN 1 THEN '.phar' ELSE regexp_extract(path, '(\\.[^./]+)$', 1) END AS ext FROM placed),
    flagged AS (
        SELECT path, list_sort(list_filter([
            CASE WHEN ext = '.phar' THEN 'anomalous_extension' END, CASE WHEN path LIKE '%-wal' THEN 'sqlite_sidecar_active_writes' END,
            CASE WHEN ext IN ('.php', '.phar') AND path LIKE 'uploads/%' THEN 'php_in_upload_directory' END,
            CASE WHEN ext = '.jpg' AND contains(content, '<?php') AND octet_length(encode(split_part(content, '<?php', 1))) + 5 <= 8192 THEN 'polyglot_php_in_image' END, CASE WHEN ext = '.phar' THEN 'phar_archive' END,
            CASE WHEN ext = '.log' AND contains(content, '<?php') AND octet_length(encode(split_part(content, '<?php', 1))) + 5 <= 16384 THEN 'php_code_in_log_file' END, CASE WHEN path LIKE '%.php.jpg' THEN 'double_extension_php' END
        ], lambda v: v IS NOT NULL)) AS anomalies FROM x
    )"""
)


def _flagged(spark, sf_dir):
    rows = planted(spark, sf_dir)
    top = F.when(F.col("doc_id") % 4 == 0, "uploads/").when(F.col("doc_id") % 4 == 1, ".user.ini/").otherwise("")
    end = F.when(F.col("doc_id") % 9 == 0, ".php.jpg").when(F.col("doc_id") % 9 == 1, ".phar").when(F.col("doc_id") % 9 == 2, "-wal").otherwise("")
    rows = rows.withColumn("path", F.concat(top, "path", end))
    return rows.select("path", manifest.anomalies(F.col("path"), F.col("content")).alias("anomalies"))


@query(f"WITH {FLAGGED_SQL} SELECT path, array_to_string(anomalies, ',') AS anomalies FROM flagged")
def anomaly_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).withColumn("anomalies", F.array_join("anomalies", ","))


@query(f"WITH {FLAGGED_SQL}, a AS (SELECT path, unnest(anomalies) AS anomaly FROM flagged) SELECT {_case('anomaly', catalog.ANOMALY_ROUTES, 'unrouted')} AS field, count(DISTINCT path) AS n_files, min(path) AS first_path FROM a GROUP BY 1")
def anomaly_routing(spark, sf_dir):
    return manifest.anomaly_routing(_flagged(spark, sf_dir))


@query(f"WITH {FLAGGED_SQL}, a AS (SELECT unnest(anomalies) AS anomaly FROM flagged) SELECT anomaly, count(*) AS n FROM a GROUP BY anomaly")
def anomaly_counts(spark, sf_dir):
    return manifest.anomaly_counts(_flagged(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT path, doc_id % 3 = 0 OR (content <> '' AND length(regexp_replace(content[1:8192], '[^\\x00-\\x06\\x0E-\\x1A\\x1C-\\x1F\\x7F]', '', 'g')) > 0.3 * length(content[1:8192])) AS is_binary FROM files")
def binary_detect(spark, sf_dir):
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("content"), F.unhex(F.lit("00")))).otherwise(F.col("content"))
    short = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("00")), content)).otherwise(content)
    return files(spark, sf_dir).select("path", C.is_binary(short).alias("is_binary"))


METRICS_SQL = (
    FILES_SQL
    + f""", marked AS (SELECT path, {EXT_SQL} AS ext, content || CASE doc_id % 3 WHEN 0 THEN chr(10) || '// one' WHEN 1 THEN chr(10) || '# two' ELSE chr(10) || '/* three */' END AS content FROM files),
    l AS (SELECT path, ext, trim(unnest(string_split(content, chr(10))), E' \\t\\r\\x0b\\x0c') AS line, CASE WHEN contains(content, '/* ') OR contains(content, '<!--') THEN 1 ELSE 0 END AS _ FROM marked),
    k AS (SELECT path, line, CASE WHEN line = '' THEN 'blank' WHEN ext = '.php' AND (line LIKE '//%' OR line LIKE '#%' OR contains(line, '/*')) THEN 'comment'
        WHEN ext = '.js' AND (line LIKE '//%' OR contains(line, '/*')) THEN 'comment' ELSE 'code' END AS kind FROM l)"""
)


METRICS_OF_FILES_SQL = f"WITH {METRICS_SQL} SELECT path, count(*) AS lines, count(*) FILTER (WHERE kind = 'blank') AS blank, count(*) FILTER (WHERE kind = 'comment') AS comments, count(*) FILTER (WHERE kind = 'code') AS code, sum(len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')))::BIGINT AS words, max(length(line)) AS longest, sum(length(line))::BIGINT AS stripped_chars FROM k GROUP BY path"


@query(METRICS_OF_FILES_SQL)
def text_metrics(spark, sf_dir):
    return manifest.text_metrics(_marked(spark, sf_dir))


def _marked(spark, sf_dir):
    """The files with a line of comment at their ends."""
    added = F.when(F.col("doc_id") % 3 == 0, "\n// one").when(F.col("doc_id") % 3 == 1, "\n# two").otherwise("\n/* three */")
    return files(spark, sf_dir).withColumn("content", F.concat("content", added.cast("binary")))


@query(METRICS_OF_FILES_SQL)
def text_metrics_of_chunks(spark, sf_dir):
    """The same of files in pieces of 700 bytes."""
    return chunks.text_metrics(chunks.chunked(_marked(spark, sf_dir), 700))


@query(f"WITH {ENTROPY_SQL} SELECT path, entropy FROM e")
def entropy_of_chunks(spark, sf_dir):
    """Entropies of files in pieces of 700 bytes; empty files have no row."""
    return chunks.entropy_of(chunks.byte_counts(chunks.chunked(files(spark, sf_dir), 700)))


@query(None)
def manifest_full(spark, sf_dir):
    return manifest.manifest(files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT path FROM files WHERE {EXT_SQL} IN ('.php', '.js', '.html', '.txt', '.log', '.md') AND octet_length(encode(content)) <= 2000")
def scannable_files(spark, sf_dir):
    from corpusguard.operators.scan import scannable

    return files(spark, sf_dir).where(scannable(F.col("path"), F.length("content"), 2000)).select("path")


@query(None)
def hash_algorithms(spark, sf_dir):
    return files(spark, sf_dir).select("path", *[C.hash_of(F.col("content"), a).alias(a) for a in C.HASHES])


@query(
    f"""WITH {FILES_SQL}, s AS (SELECT path, octet_length(encode(content)) AS n FROM files)
    SELECT path, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM s"""
)
def human_size(spark, sf_dir):
    return files(spark, sf_dir).select("path", C.human_size(F.length("content").cast("long")).alias("size"))


@query("SELECT part.p_partkey AS id, CASE WHEN p_size >= 9 THEN 'CRITICAL' WHEN p_size >= 7 THEN 'HIGH' WHEN p_size >= 4 THEN 'MEDIUM' WHEN p_size >= 0.1 THEN 'LOW' ELSE 'INFO' END AS severity FROM part")
def cvss_severity(spark, sf_dir):
    from corpusguard.plans.registry import table

    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.severity_of_score(F.col("p_size")).alias("severity"))


WORDS_SQL = "sum(len(list_filter(regexp_split_to_array(content, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')))"


@query(
    f"""WITH {FILES_SQL}, a AS (SELECT count(*) AS files, sum(length(content)) AS chars, sum(octet_length(encode(content))) AS bytes, {WORDS_SQL} AS words FROM files WHERE doc_id % 10 <> 0),
    b AS (SELECT count(*) AS files, sum(length(content)) AS chars, sum(octet_length(encode(content))) AS bytes, {WORDS_SQL} AS words FROM files WHERE doc_id % 10 <> 1),
    m AS (SELECT 'files' AS metric, a.files AS a, b.files AS b FROM a, b UNION ALL SELECT 'chars', a.chars, b.chars FROM a, b UNION ALL SELECT 'bytes', a.bytes, b.bytes FROM a, b
        UNION ALL SELECT 'words', a.words, b.words FROM a, b)
    SELECT metric, a::BIGINT AS a, b::BIGINT AS b, (b - a)::BIGINT AS delta, round(100.0 * (b - a) / a, 2) AS percent FROM m"""
)
def corpus_delta(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("text", F.col("content").cast("string"))
    parts = [rollup.corpus_metrics(rows.where(f"doc_id % 10 <> {k}"), str(k)) for k in (0, 1)]
    return rollup.corpus_delta(*parts)


@query(
    f"""WITH {FILES_SQL}, m AS (SELECT sha256(path)[1:4] AS part, path || ':' || sha256(content) AS line FROM files), p AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM m GROUP BY part)
    SELECT sum(n)::BIGINT AS files, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest FROM p"""
)
def corpus_digest(spark, sf_dir):
    rows = files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("size_bytes"))
    return sinks.package_digest(rows).select("files", F.col("package_sha256").alias("digest"))


@query(
    f"""WITH {SNAPSHOTS_SQL}, c AS (SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'modified') AS modified,
        count(*) FILTER (WHERE status = 'identical') AS identical, count(*) FILTER (WHERE status IN ('added', 'modified')) AS delta FROM diff), f AS (SELECT count(*) AS findings,
        count(*) FILTER (WHERE path LIKE '%.php' AND status = 'added') AS critical, count(*) FILTER (WHERE (path LIKE '%.js' AND status = 'added') OR (path LIKE '%.php' AND status = 'modified') OR status = 'removed') AS high FROM diff WHERE status <> 'identical')
    SELECT c.*, f.*, added || ' added, ' || removed || ' removed, ' || modified || ' modified, ' || identical || ' identical; ' || findings || ' findings in ' || delta || ' files, ' || critical || ' critical, ' || high || ' high' AS summary FROM c, f"""
)
def audit_summary(spark, sf_dir):
    compared = _diff(spark, sf_dir)
    return diff.audit_summary(compared, diff.diff_findings(compared))


@query(f"WITH {FILES_SQL} SELECT count(*) AS files, sum(octet_length(encode(content)))::BIGINT AS bytes, max(octet_length(encode(content))) AS largest, count(DISTINCT sha256(content)) AS distinct_contents FROM files")
def manifest_totals(spark, sf_dir):
    return manifest.totals(files(spark, sf_dir).select("path", F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256")))


SKIPPED = {0: ".git/config/", 1: "a/node_modules/b/", 2: "edocs/", 3: "modules/x/", 4: "src/"}
PLACED_SQL = FILES_SQL + f", placed AS (SELECT doc_id, {list(SKIPPED.values())}[(doc_id % 5 + 1)::INTEGER] || 'f' || doc_id || '.php' AS path FROM files)"


def _placed(spark, sf_dir):
    top = F.get(F.array(*map(F.lit, SKIPPED.values())), (F.col("doc_id") % 5).cast("int"))
    return files(spark, sf_dir).withColumn("path", F.concat(top, F.lit("f"), F.col("doc_id").cast("string"), F.lit(".php")))


@query(f"WITH {PLACED_SQL} SELECT path, doc_id % 5 IN (0, 1) AS skipped, doc_id % 5 IN (0, 2, 3) AS expected FROM placed")
def path_filters(spark, sf_dir):
    """Which paths manifests and diffs leave out, and which additions are expected."""
    return _placed(spark, sf_dir).select("path", C.skipped(F.col("path")).alias("skipped"), diff.expected_addition(F.col("path")).alias("expected"))
