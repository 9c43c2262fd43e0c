"""What an investigation leaves behind: manifests, findings and evidence packages as tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.functions import columns as C
from corpusguard.sources.tree import local_path


def save_manifest(manifest: DataFrame, folder: str) -> None:
    """The manifest as Parquet, a part of its files to each of the session's partitions."""
    manifest.write.mode("errorifexists").parquet(folder)


def save_findings(findings: DataFrame, folder: str) -> None:
    """Findings as JSON lines, the most severe first: files in the order of their names, rows in the order of the files."""
    ranked = findings.withColumn("_down", -C.severity_rank(F.col("severity")))
    order = ["_down", *[c for c in ("path", "line", "rule_id") if c in findings.columns]]
    ranked.repartitionByRange(*order).sortWithinPartitions(*order).drop("_down").write.mode("errorifexists").json(folder)


def package_digest(manifest: DataFrame) -> DataFrame:
    """One row: files, bytes and a digest of all paths with their digests, in order, by 65,536 sub-digests."""
    line = F.concat_ws(":", "path", "sha256")
    parts = manifest.groupBy(F.substring(F.sha2("path", 256), 1, 4).alias("part")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"), F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"])  # 65,536 at most
    return parts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(ordered, "\n"), 256).alias("package_sha256"))


def save_evidence(manifest: DataFrame, folder: str, **about: str) -> DataFrame:
    """Writes ``manifest``, ``anomalies`` (files that have any) and ``metadata`` with the package's digest; returns the metadata.

    The metadata is made from the manifest as written, so that it vouches for what is stored.
    """
    save_manifest(manifest, f"{folder}/manifest")
    stored = manifest.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")
    anomalies = stored.where(F.size("anomalies") > 0).select("path", "anomalies")
    anomalies.write.mode("errorifexists").json(f"{folder}/anomalies")
    metadata = package_digest(stored).select("*", *[F.lit(v).alias(k) for k, v in about.items()])
    metadata.write.mode("errorifexists").json(f"{folder}/metadata")
    return manifest.sparkSession.read.schema(metadata.schema).json(f"{folder}/metadata")


def save_tree(files: DataFrame, root: str) -> int:
    """``files(path, content)`` as files below ``root``, a folder that the executors share; their number.

    Each is written beside ``root``, in a folder of its task (tasks in one folder wait for each other), and
    moved to its place, so that a task that runs again, or a reader meanwhile, finds whole files. Paths that lead out of the folder are an error;
    null contents are empty files; of rows with one path the last written stays.
    """
    root = local_path(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, made = os.path.join(f"{root}.aside", uuid.uuid4().hex), set()
        os.makedirs(own)
        aside = os.path.join(own, "file")
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = path.split("/")
                if path.startswith("/") or ".." in parts or "" in parts:
                    raise ValueError(f"not a path below a folder: {path}")
                place = os.path.join(root, *parts)
                if (folder := os.path.dirname(place)) not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(aside, "wb") as f:
                    f.write(content or b"")
                os.replace(aside, place)
            made.clear()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        os.rmdir(own)

    return files.select("path", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
