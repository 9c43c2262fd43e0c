"""Manifests: identity, hashes, entropy and anomalies of every file, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.functions import columns as C

#: Bytes that are counted at once; the counter takes eight for each.
COUNTED = 1 << 20


def _entropy(content) -> float:
    data = np.frombuffer(content, np.uint8)
    n = sum((np.bincount(data[at : at + COUNTED], minlength=256) for at in range(0, len(data), COUNTED)), np.zeros(256, np.int64))
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum() + 0.0)


def byte_entropy(content: Column, least: int = 50, head: int | None = None, digits: int = 4) -> Column:
    """Shannon entropy of the bytes, in Arrow batches; zero below ``least`` bytes.

    A histogram in the task costs a pass over the bytes; exploding them would cost a row each. Contents are read
    where they lie in the batch, so that a worker holds a batch once.
    """

    @F.arrow_udf("double")
    def compute(batch: pa.Array) -> pa.Array:
        found = np.zeros(len(batch))
        for i, value in enumerate(batch):
            held = value.as_buffer()
            if held is not None and held.size >= max(1, least):
                found[i] = _entropy(held if head is None else held.slice(0, min(head, held.size)))
        return pa.array(found)

    return F.round(compute(content), digits)


def path_parts(files: DataFrame) -> DataFrame:
    path = F.col("path")
    return files.withColumn("filename", C.filename(path)).withColumn("extension", C.extension(path)).withColumn("depth", F.size(F.split(path, "/")) - 1)


#: What the checks of anomalies go by unless they are given lists of their own.
ANOMALY_LISTS = {
    "names": catalog.SUSPICIOUS_NAMES, "forbidden": catalog.FORBIDDEN_EXTENSIONS, "upload_dirs": catalog.UPLOAD_DIRS, "databases": catalog.SQLITE_EXTENSIONS,
    "scripts": catalog.PHP_EXTENSIONS, "images": catalog.IMAGE_EXTENSIONS, "keys": catalog.KEY_EXTENSIONS,
}


def anomalies(path: Column, content: Column, entropy: Column | None = None, lists: Mapping[str, Sequence[str]] | None = None) -> Column:
    """The sorted names of all anomalies of a file; ``lists`` takes the place of those of ``ANOMALY_LISTS`` that it names."""
    if unknown := set(lists or ()) - set(ANOMALY_LISTS):
        raise ValueError(f"no such lists: {sorted(unknown)}")
    of = {k: [*v] for k, v in (ANOMALY_LISTS | dict(lists or {})).items()}
    name, ext, lower = F.lower(C.filename(path)), C.extension(path), F.lower(path)
    upload = C.in_dirs(lower, of["upload_dirs"])

    def head(size: int) -> Column:
        return F.decode(F.substring(content, 1, size), "ISO-8859-1")

    parts = F.split(C.filename(path), r"\.")
    checks = {
        "suspicious_filename": name.isin(of["names"]),
        "anomalous_extension": ext.isin(of["forbidden"]),
        "hidden_php_file": name.startswith(".") & ext.isin(".php", ".inc"),
        "user_ini_persistence": name == ".user.ini",
        "htaccess_in_upload_dir": (name == ".htaccess") & upload,
        "sqlite_file_in_webroot": ext.isin(of["databases"]),
        "sqlite_sidecar_active_writes": name.rlike("-(journal|wal|shm)$"),
        "php_in_upload_directory": ext.isin([*of["scripts"], ".inc"]) & upload,
        "polyglot_php_in_image": ext.isin(of["images"]) & head(8192).rlike(r"<\?php|<\? "),
        "phar_archive": ext == ".phar",
        "phar_magic_in_non_phar": (ext != ".phar") & head(4096).contains("__HALT_COMPILER()"),
        "certificate_in_webroot": ext.isin(of["keys"]),
        "php_code_in_log_file": (ext == ".log") & head(16384).rlike(r"<\?php|<\?="),
        "double_extension_php": (F.size(parts) >= 3) & F.concat(F.lit("."), F.lower(F.get(parts, F.size(parts) - 2))).isin(of["scripts"]),
    }
    if entropy is not None:
        checks["high_entropy_php"] = (C.entropy_assessment(entropy) == "suspicious") & ext.isin(".php", ".inc")
    return F.sort_array(F.filter(F.array(*[F.when(c, n) for n, c in checks.items()]), lambda x: x.isNotNull()))


def manifest(files: DataFrame, with_entropy: bool = True, lists: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """The manifest of ``files(path, content)``: one narrow row per file; contents are not shuffled. ``lists`` is for the anomalies."""
    ext = F.col("extension")
    rows = path_parts(files.where(~C.skipped(F.col("path"))))
    rows = rows.withColumn("size_bytes", F.length("content").cast("long")).withColumn("is_binary", C.is_binary(F.col("content")))
    entropy = F.lit(0.0)
    if with_entropy:
        rows = rows.withColumn("entropy", F.when(F.col("is_binary") | (F.col("size_bytes") > catalog.ENTROPY_LIMIT), 0.0).otherwise(byte_entropy(F.col("content"))))
        entropy = F.col("entropy")
    return rows.select(
        "path", "filename", "extension", "size_bytes", "is_binary",
        F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"),
        C.mime_type(ext).alias("mime_type"), C.category(ext).alias("category"), C.language(ext).alias("language"),
        entropy.alias("entropy"), C.entropy_assessment(entropy).alias("entropy_assessment"), anomalies(F.col("path"), F.col("content"), entropy, lists).alias("anomalies"),
    )


def breakdowns(rows: DataFrame, *keys: str) -> DataFrame:
    """``key, value, n``: counts by each of several columns in one pass."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.nullif(F.col(k), F.lit("")), F.lit("(none)")).alias("value")) for k in keys]))
    return rows.select(each).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def anomaly_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("anomalies").alias("anomaly")).groupBy("anomaly").agg(F.count(F.lit(1)).alias("n"))


def anomaly_routing(rows: DataFrame) -> DataFrame:
    """How many files each field of the anomaly report lists; anomalies without a field count as unrouted."""
    each = rows.select("path", F.explode("anomalies").alias("anomaly"))
    field = C.looked_up(F.col("anomaly"), catalog.ANOMALY_ROUTES, "unrouted")
    return each.groupBy(field.alias("field")).agg(F.countDistinct("path").alias("n_files"), F.min("path").alias("first_path"))


def anomaly_paths(rows: DataFrame) -> DataFrame:
    """``field, anomaly, path``: the path lists of the anomaly report, a row for each entry; anomalies without a field are ``unrouted``."""
    each = rows.select("path", F.explode("anomalies").alias("anomaly"))
    return each.select(C.looked_up(F.col("anomaly"), catalog.ANOMALY_ROUTES, "unrouted").alias("field"), "anomaly", "path").distinct()


def totals(manifest: DataFrame) -> DataFrame:
    """One row: files, bytes, the largest size and distinct contents."""
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("size_bytes"), F.lit(0)).alias("largest"), F.countDistinct("sha256").alias("distinct_contents"))


def text_metrics(files: DataFrame) -> DataFrame:
    """Per file: lines, blank, comment and code lines, words and lengths; what begins a comment goes by the extension."""

    def measure(text: str, extension: str) -> tuple:
        markers = catalog.COMMENT_MARKERS.get(extension, ())
        single = tuple(m for m in markers if m not in ("/*", "<!--"))
        lines, words, longest, total, within = text.split("\n"), 0, 0, 0, None
        kinds = {"blank": 0, "comment": 0, "code": 0}
        for line in lines:
            s = line.strip(" \t\r\x0b\x0c")
            words += len(s.split())
            longest, total = max(longest, len(s)), total + len(s)
            if s and within is None:
                within = next((end for begin, end in (("/*", "*/"), ("<!--", "-->")) if begin in markers and begin in s), None)
            kind = "blank" if not s else "comment" if within or single and s.startswith(single) else "code"
            kinds[kind] += 1
            if s and within and within in s:
                within = None
        return len(lines), *kinds.values(), words, longest, total

    names = ("lines", "blank", "comments", "code", "words", "longest", "stripped_chars")

    @F.pandas_udf("struct<" + ",".join(f"{n}:long" for n in names) + ">")
    def compute(content: pd.Series, extension: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(b.decode("utf-8", "replace"), e) for b, e in zip(content, extension)], columns=names)

    return files.select("path", compute("content", C.extension(F.col("path"))).alias("m")).select("path", "m.*")


def directory_profile(rows: DataFrame) -> DataFrame:
    """Files, bytes and mean size by extension."""
    n, size = F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    return rows.groupBy("extension").agg(n, size).withColumn("mean_bytes", F.round(F.col("bytes") / F.col("files"), 3))


def content_profile(files: DataFrame) -> DataFrame:
    """``key, value, files, bytes, lines``: a corpus by extension, by category and in all, in one pass over the contents."""
    ext = C.extension(F.col("path"))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = F.when(F.length("content") > 0, F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1)).otherwise(0)
    rows = files.select(F.length("content").alias("size"), lines.alias("n"), ext.alias("ext"), C.category(ext).alias("category"))
    keys = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("extension", F.col("ext")), ("category", F.col("category")), ("total", F.lit("")))]))
    return rows.select("size", "n", keys).groupBy("key", "value").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum("n").alias("lines"))


def token_kinds(tokens: DataFrame) -> DataFrame:
    """``path, kind, n``: tokens ``(path, kind)`` of a parser by kind."""
    return tokens.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def symbol_complexity(symbols: DataFrame) -> DataFrame:
    """Per path: functions, classes, total and largest complexity, and the mean body of ``symbols(path, class, function, body_lines, complexity)``."""
    is_function = F.col("function").isNotNull()
    return symbols.groupBy("path").agg(
        F.count_if(is_function).alias("functions"), F.countDistinct("class").alias("classes"), F.sum(F.when(is_function, F.col("complexity"))).alias("complexity"),
        F.max(F.when(is_function, F.col("complexity"))).alias("largest"), F.round(F.avg(F.when(is_function, F.col("body_lines"))), 3).alias("mean_body"),
    )
