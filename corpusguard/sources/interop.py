"""Documents of other tools as tables, and findings as theirs."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.functions import columns as C
from corpusguard.functions.ranges import first_of_group, last_known

#: The part of a SARIF document that the operators read.
SARIF = """
    runs array<struct<
        tool: struct<driver: struct<name: string, rules: array<struct<id: string, name: string>>>>,
        artifacts: array<struct<location: struct<uri: string>>>,
        invocations: array<struct<toolExecutionNotifications: array<struct<message: struct<text: string>>>>>,
        results: array<struct<
            ruleId: string, level: string, message: struct<text: string>, properties: struct<cwe: string>,
            taxa: array<struct<id: string, toolComponent: struct<name: string>>>,
            locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int, startColumn: int, endColumn: int>>>>
        >>
    >>
"""


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SARIF).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def parse_sarif(documents: DataFrame, column: str = "json") -> DataFrame:
    """A column of SARIF texts as its runs; other columns stay."""
    return documents.withColumn("runs", F.from_json(column, SARIF)["runs"]).drop(column)


def _full_location(place: Column) -> list[Column]:
    region = place["region"]
    names = (("startLine", "start_line"), ("endLine", "end_line"), ("startColumn", "start_column"), ("endColumn", "end_column"))
    return [*_minimal_location(place)[:1], *[F.coalesce(region[k], F.lit(0)).alias(n) for k, n in names]]


def _minimal_location(place: Column) -> list[Column]:
    return [F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("uri"), F.coalesce(place["region"]["startLine"], F.lit(0)).alias("start_line")]


#: What is told of a result's first location, by name; add to it to register another.
LOCATION_STRATEGIES = {"full": _full_location, "minimal": _minimal_location}
#: Steps over result tables by name; add to it to register one. Names and order of those built in.
POST_PROCESSORS = {
    "located": lambda rows: rows.where("uri <> ''"),
    "relative": lambda rows: rows.withColumn("uri", F.regexp_replace("uri", r"^(?:file:)?/+", "")),
    "distinct": lambda rows: rows.dropDuplicates([c for c in ("rule_id", "uri", "start_line", "message") if c in rows.columns]),
}


def post_processed(rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` after the named steps in the given order; names that nobody registered are skipped."""
    for name in names:
        if name in POST_PROCESSORS:
            rows = rows.transform(POST_PROCESSORS[name])
    return rows


def sarif_results(documents: DataFrame, max_results: int = 0, strategy: str = "full") -> DataFrame:
    """A row per result, with its first location by the ``strategy`` and its weakness; ``max_results`` keeps the first of each file (0: all)."""
    rows = documents.select("file", F.posexplode("runs").alias("run", "r")).select("file", "run", F.posexplode("r.results").alias("pos", "x"))
    if max_results:
        rows = first_of_group(rows, "file", max_results, "run", "pos")
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    taxon = F.get(F.filter("x.taxa", lambda t: (F.lower(t["toolComponent"]["name"]) == "cwe") & (F.coalesce(t["id"], F.lit("")) != "")), F.lit(0))["id"]
    return rows.select(
        "file", "run", "pos", F.coalesce("x.ruleId", F.lit("")).alias("rule_id"), F.coalesce("x.level", F.lit("warning")).alias("level"), F.coalesce("x.message.text", F.lit("")).alias("message"),
        *LOCATION_STRATEGIES[strategy](place), C.weakness_id(F.coalesce(taxon, F.col("x.properties.cwe"))).alias("cwe_id"),
    )


def sarif_rules(documents: DataFrame) -> DataFrame:
    return documents.select("file", F.explode("runs").alias("r")).select("file", F.explode("r.tool.driver.rules").alias("x")).select("file", F.col("x.id").alias("rule_id"), F.col("x.name").alias("name"))


def sarif_errors(documents: DataFrame) -> DataFrame:
    rows = documents.select("file", F.explode("runs").alias("r")).select("file", F.explode("r.invocations").alias("i")).select("file", F.explode("i.toolExecutionNotifications").alias("n"))
    return rows.select("file", F.col("n.message.text").alias("error")).where("error <> ''")


def sarif_files(documents: DataFrame) -> DataFrame:
    """``file, uri``: the distinct files that a document names as artifacts or in results."""
    runs = documents.select("file", F.explode("runs").alias("r"))
    artifacts = F.transform("r.artifacts", lambda a: a["location"]["uri"])
    none = F.array().cast("array<string>")
    places = lambda x: F.transform(x["locations"], lambda p: p["physicalLocation"]["artifactLocation"]["uri"])
    results = F.flatten(F.transform("r.results", lambda x: F.coalesce(places(x), none)))
    both = F.concat(F.coalesce(artifacts, none), F.coalesce(results, none))
    return runs.select("file", F.explode(both).alias("uri")).where("uri <> ''").distinct()


def sarif_result(line: Column = None) -> Column:
    """A finding as a SARIF result object; a region only where the line is known, empty fields left out."""
    where = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), where.alias("region")).alias("physicalLocation"))
    tags = F.when(F.col("cwe_id") != "", F.struct(F.col("cwe_id").alias("cwe")))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), C.looked_up(F.col("severity"), catalog.SARIF_LEVELS, "warning").alias("level"),
            F.struct(F.col("title").alias("text")).alias("message"), F.array(location).alias("locations"), tags.alias("properties"),
        )
    )


def sarif_full_result(findings: DataFrame) -> Column:
    """A finding as a whole SARIF result object: what the findings have no column for, or null, zero and empty values, is left out.

    Read are ``rule_id, severity, title, fingerprint, source, confidence, category`` and, where
    they are, ``description, path, line, line_end, column_start, column_end, snippet, cwe_id,
    cwe_name, technique, technique_name, score, cve_id, corroborated_by, related_ids, content_label, content_mismatch``.
    """
    has = lambda name: F.col(name) if name in findings.columns else F.lit(None)
    text = lambda name: F.nullif(has(name).cast("string"), F.lit(""))
    number = lambda name: F.when(has(name).cast("int") > 0, has(name).cast("int"))
    listed = lambda name: F.when(F.size(F.col(name)) > 0, F.col(name)) if name in findings.columns else F.lit(None).cast("array<string>")
    snippet = F.when(text("snippet").isNotNull(), F.struct(text("snippet").alias("text")))
    region = F.struct(number("line").alias("startLine"), number("line_end").alias("endLine"), number("column_start").alias("startColumn"), number("column_end").alias("endColumn"), snippet.alias("snippet"))
    place = F.struct(F.struct(text("path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.when(number("line").isNotNull(), region).alias("region"))
    weakness = F.struct(F.struct(F.lit("CWE").alias("name")).alias("toolComponent"), F.regexp_replace(text("cwe_id"), "^CWE-", "").alias("id"), text("cwe_name").alias("name"))
    technique = F.struct(text("technique").alias("technique_id"), text("technique_name").alias("technique_name"))
    properties = F.struct(
        text("source").alias("source"), text("confidence").alias("confidence"), text("category").alias("category"), text("cwe_id").alias("cwe"),
        F.when(text("technique").isNotNull(), technique).alias("mitre_attack"), F.when(has("score").isNotNull(), F.struct(has("score").cast("double").alias("base_score"))).alias("cvss"),
        text("cve_id").alias("cve"), listed("corroborated_by").alias("corroborated_by"), listed("related_ids").alias("related_ids"),
        text("content_label").alias("content_label"), F.when(text("content_label").isNotNull(), has("content_mismatch").cast("boolean")).alias("content_mismatch"),
    )
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), C.looked_up(F.col("severity"), catalog.SARIF_LEVELS, "warning").alias("level"), F.struct(F.coalesce(text("description"), text("title"), F.lit("")).alias("text")).alias("message"),
            F.struct(text("fingerprint").alias("finding/v1")).alias("fingerprints"), F.when(text("path").isNotNull(), F.array(F.struct(place.alias("physicalLocation")))).alias("locations"),
            F.when(text("cwe_id").isNotNull(), F.array(weakness)).alias("taxa"), properties.alias("properties"),
        )
    )


def sarif_document(findings: DataFrame, by: str) -> DataFrame:
    """``file, json``: a SARIF document for each value of ``by``, with its results in path and line order."""
    ordered = F.sort_array(F.collect_list(F.struct("path", "line", "rule_id", sarif_result().alias("json"))))
    rows = findings.groupBy(F.col(by).cast("string").alias("file")).agg(ordered.alias("rs"))
    results = F.array_join(F.transform("rs", lambda r: r["json"]), ",")
    return rows.select("file", F.concat(F.lit('{"runs":[{"tool":{"driver":{"name":"scan"}},"results":['), results, F.lit("]}]}")).alias("json"))


def runtime_results(reports: DataFrame, column: str = "json") -> DataFrame:
    """``suite, test, status, duration_ms``: runtime test results from report texts; text before the first brace is ignored.

    A report that is null or cannot be parsed, or names no suites, gives one row with
    status ``parse_error``. Suites, specs and tests without any below them give none.
    """
    schema = "suites array<struct<title: string, specs: array<struct<title: string, tests: array<struct<results: array<struct<status: string, duration: bigint>>>>>>>>"
    parsed = reports.select(F.from_json(F.regexp_replace(column, r"(?s)^[^{]*", ""), schema)["suites"].alias("suites"))
    result = "struct<suite: string, test: string, status: string, duration_ms: bigint>"
    of_test = lambda s, p, t: F.transform(t["results"], lambda r: F.struct(s["title"].alias("suite"), p["title"].alias("test"), r["status"].alias("status"), r["duration"].alias("duration_ms")))
    none = F.array().cast(f"array<{result}>")
    of_spec = lambda s, p: F.flatten(F.transform(p["tests"], lambda t: F.coalesce(of_test(s, p, t), none)))
    of_suite = lambda s: F.flatten(F.transform(s["specs"], lambda p: F.coalesce(of_spec(s, p), none)))
    results = F.flatten(F.transform("suites", lambda s: F.coalesce(of_suite(s), none)))
    error = F.array(F.struct(F.lit(None).cast("string").alias("suite"), F.lit(None).cast("string").alias("test"), F.lit("parse_error").alias("status"), F.lit(None).cast("bigint").alias("duration_ms")))
    return parsed.select(F.inline(F.when(F.col("suites").isNull(), error).otherwise(results)))


def signature_strings(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """``file, header_line, rule, target, line, offset, identifier, data`` of ``lines(file, line, text)`` of signature output.

    A header line (``rule target``) owns the ``0x`` lines after it, each
    ``offset:identifier:data`` with 200 characters of data at most; a match without such lines is one row
    with nulls. A header without a target owns nothing, nor do lines before the first header, and ``0x`` lines of
    fewer parts are left out. Output of any size is read in ranges of lines.
    """
    text = F.trim("text")
    rows = lines.select("file", "line", text.alias("text")).where("text <> ''")
    words = F.split("text", r"\s+", 2)
    header = F.struct(F.col("line").alias("line"), F.when(F.size(words) == 2, words[0]).alias("rule"), F.get(words, F.lit(1)).alias("target"))
    rows = last_known(rows, "file", "line", F.when(~F.col("text").startswith("0x"), header), "header", ranges).where("header.rule IS NOT NULL")
    parts = F.split("text", ":", 3)
    own = F.col("header.line") == F.col("line")
    shown = [F.trim(parts[0]).alias("offset"), F.trim(F.get(parts, F.lit(1))).alias("identifier"), F.substring(F.trim(F.get(parts, F.lit(2))), 1, 200).alias("data")]
    found = rows.where(own | (F.size(parts) == 3)).select("file", F.col("header.line").alias("header_line"), "header.rule", "header.target", F.when(~own, F.struct("line", *shown)).alias("s"))
    return found.select("file", "header_line", "rule", "target", "s.*")


def signature_matches(lines: DataFrame, ranges: int | None = None) -> DataFrame:
    """``file, rule, target, strings``: the matches of :func:`signature_strings`, each with the data of its lines in their order."""
    rows = signature_strings(lines, ranges)
    found = rows.groupBy("file", "header_line").agg(F.first("rule").alias("rule"), F.first("target").alias("target"), F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "data")))).alias("found"))
    return found.select("file", "rule", "target", F.transform("found", lambda x: x["data"]).alias("strings"))


def first_mitigation(raw: Column) -> Column:
    """The first description in ``::PHASE:...:DESCRIPTION:text::``."""
    return F.trim(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)DESCRIPTION:(.*?)(?:::|$)", 1))


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """A weakness table from CSV: deprecated and empty ids go, descriptions end at 500 characters, the last row of an id stays."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_at", F.monotonically_increasing_id())
    rows = rows.where((F.col("Status") != "Deprecated") & (F.coalesce("CWE-ID", F.lit("")) != ""))
    last = rows.groupBy(C.weakness_id(F.col("CWE-ID")).alias("cwe_id")).agg(F.max_by(F.struct("Name", "Description", "Potential Mitigations"), "_at").alias("r"))
    return last.select("cwe_id", F.col("r.Name").alias("name"), F.substring("r.Description", 1, 500).alias("description"), first_mitigation(F.col("r.`Potential Mitigations`")).alias("mitigation"))


def verified(hashes: DataFrame, sidecar: DataFrame) -> DataFrame:
    """``name, state`` of files ``(name, sha256)`` against recorded digests ``(name, sha256)``."""
    both = hashes.select("name", F.col("sha256").alias("have")).join(sidecar.select("name", F.lower("sha256").alias("want")), "name", "full_outer")
    state = F.when(F.col("have").isNull(), "MISSING_FILE").when(F.col("want").isNull(), "MISSING_CHECKSUM").when(F.col("have") == F.col("want"), "VERIFIED").otherwise("MISMATCH")
    return both.select("name", state.alias("state"))


def archive_guard(members: DataFrame, max_member: int = 500 << 20, max_ratio: float = 100.0) -> DataFrame:
    """``archive, member, verdict`` of ``members(archive, archive_size, member, size)``: one bad member refuses its archive."""
    unsafe = F.col("member").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")
    totals = members.groupBy("archive").agg((F.sum("size") / F.greatest(F.max("archive_size"), F.lit(1)) > max_ratio).alias("bomb"), F.max((unsafe | (F.col("size") > max_member)).cast("int")).alias("refused"))
    verdict = F.when(unsafe, "unsafe_name").when(F.col("size") > max_member, "too_large").when(F.col("bomb"), "ratio").when(F.col("refused") == 1, "quarantined").otherwise("ok")
    return members.join(totals, "archive").select("archive", "member", verdict.alias("verdict"))


def archive_members(archives: DataFrame, max_member: int = 500 << 20, max_ratio: float = 100.0) -> DataFrame:
    """``archive, archive_size, member, size, content`` of ``archives(path, content)``: ZIP and TAR files, opened in the tasks.

    Sizes come from the directory, before anything is decompressed: members over
    ``max_member`` bytes have a null content, and so do all members of an archive whose
    directory promises more than ``max_ratio`` times its size. A member that is larger
    than it says, encrypted or damaged has a null content too; an archive that cannot be
    read has one row with a null member. Members leave a task one by one.
    """

    def directory(data: io.BytesIO):
        """Members as (name, size, opener)."""
        if zipfile.is_zipfile(data):
            archive = zipfile.ZipFile(data)
            return [(i.filename, i.file_size, lambda i=i: archive.open(i)) for i in archive.infolist() if not i.is_dir()]
        data.seek(0)
        archive = tarfile.open(fileobj=data)
        return [(m.name, m.size, lambda m=m: archive.extractfile(m)) for m in archive if m.isfile()]

    def content_of(opener, size: int) -> bytes | None:
        try:
            with opener() as f:
                content = f.read(size + 1)
            return content if len(content) <= size else None
        except (RuntimeError, NotImplementedError, zipfile.BadZipFile, zlib.error, tarfile.TarError, EOFError, OSError):
            return None

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    members = directory(io.BytesIO(content))
                except (zipfile.BadZipFile, tarfile.TarError, EOFError, zlib.error):
                    members = [(None, None, None)]
                bomb = sum(size or 0 for _, size, _ in members) > max_ratio * max(1, len(content))
                for name, size, opener in members:
                    data = None if bomb or size is None or size > max_member else content_of(opener, size)
                    row = {"archive": path, "archive_size": len(content), "member": name, "size": size, "content": data}
                    yield pa.RecordBatch.from_pylist([row], schema=kinds)

    kinds = pa.schema([("archive", pa.string()), ("archive_size", pa.int64()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
    return archives.select("path", "content").mapInArrow(opened, "archive string, archive_size long, member string, size long, content binary")


def root_directory(paths: DataFrame, markers: list[str]) -> DataFrame:
    """One row: the shallowest directory (two levels at most) that holds a marker file, else the top."""
    depth = F.size(F.split("path", "/")) - 1
    found = paths.where(C.filename(F.col("path")).isin(markers) & (depth <= 2)).select(F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("dir"), depth.alias("depth"))
    return found.agg(F.coalesce(F.min_by("dir", F.struct("depth", "dir")), F.lit("")).alias("root"))
