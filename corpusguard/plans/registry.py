"""Registration of queries, and the tables that they derive from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that states its result."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Planted code: the remainder of doc_id by the divisor 0 adds the line. Documents hold none of their own.
PLANTED = [
    (5, '<?php eval($_POST["x"]); ?>'), (7, 'password = "hunter2hunter2"'), (11, 'auto_prepend_file = "/tmp/x.php"'), (13, 'system($_GET["c"]);'),
    (17, 'function hook_save($a) { return unserialize($a); }'), (19, 'display_errors = 1'), (23, '$q = "SELECT name FROM users WHERE id = 1";'), (29, 'RewriteRule ^a http://x.test/'),
]

FILES_SQL = """
    files AS (
        SELECT doc_id, coalesce(text, '') AS content,
            'src/' || source || '/' || lang || '_' || doc_id || ['.php', '.js', '.html', '.txt', '.log', '.md'][(doc_id % 6 + 1)::INTEGER] AS path
        FROM documents
    )"""

PLANTED_SQL = (
    FILES_SQL
    + ", planted AS (SELECT doc_id, path, content"
    + "".join(f" || CASE WHEN doc_id % {n} = 0 THEN chr(10) || '{line}' ELSE '' END" for n, line in PLANTED)
    + " AS content FROM files)"
)

SNAPSHOTS_SQL = (
    FILES_SQL
    + """, ref AS (SELECT path, sha256(content) AS hash FROM files WHERE doc_id % 10 <> 0),
    tgt AS (
        SELECT path, sha256(content || CASE WHEN doc_id % 7 = 0 THEN ' patched' ELSE '' END) AS hash,
            octet_length(encode(content || CASE WHEN doc_id % 7 = 0 THEN ' patched' ELSE '' END)) AS size
        FROM files WHERE doc_id % 10 <> 1
    ), diff AS (
        SELECT coalesce(ref.path, tgt.path) AS path,
            CASE WHEN ref.path IS NULL THEN 'added' WHEN tgt.path IS NULL THEN 'removed' WHEN ref.hash = tgt.hash THEN 'identical' ELSE 'modified' END AS status,
            ref.hash AS ref_hash, tgt.hash AS tgt_hash, size
        FROM ref FULL JOIN tgt ON ref.path = tgt.path
    )"""
)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, content``: the documents as files."""
    docs = table(spark, sf_dir, "documents")
    ext = F.get(F.array(*map(F.lit, [".php", ".js", ".html", ".txt", ".log", ".md"])), (F.col("doc_id") % 6).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), ext)
    return docs.select("doc_id", path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with lines of code added by their numbers."""
    rows = files(spark, sf_dir)
    added = [F.when(F.col("doc_id") % n == 0, F.lit("\n" + line)).otherwise(F.lit("")) for n, line in PLANTED]
    return rows.withColumn("content", F.concat(F.col("content").cast("string"), *added).cast("binary"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the files: some added, some removed, some patched."""
    rows = files(spark, sf_dir)
    patched = F.when(F.col("doc_id") % 7 == 0, F.concat(F.col("content"), F.lit(" patched").cast("binary"))).otherwise(F.col("content"))
    return rows.where("doc_id % 10 <> 0"), rows.where("doc_id % 10 <> 1").withColumn("content", patched)
