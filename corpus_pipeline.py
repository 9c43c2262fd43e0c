"""The training-data pipeline over ``documents``; part of the subpackage ``llm``.

Each stage takes the documents that its predecessor kept and the folder of the tables,
and returns documents; ``run`` writes what a stage keeps as Parquet to the folder that
all executors share and reads it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm import byte_bpe, decontaminate, line_runs, simhash, toxicity
from corpusguard.llm.runtime import shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below 0.5; the model learns from the labels and these documents.

    Null and empty texts score like any others; all rows of an id that goes go, and a null id stays. Without labels nothing goes.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of two lines and more; ``n_chars`` follows the text.

    Null texts stay null; a document of which nothing is left goes, one that had no words stays.
    """
    kept = line_runs.drop_later_runs(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, by five-word shingles.

    That with the smallest id stays, with all its rows; texts without words are one class.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts stay, and without a benchmark all do."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents left, with a check that they decode to the text; null and empty texts have no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    decoded = F.sha2(byte_bpe.decode(F.col("ids"), path), 256)
    return encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), decoded.alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level BPE", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
