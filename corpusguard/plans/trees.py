"""Queries over file trees that the documents are written to: batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusguard.catalogs import files as catalog
from corpusguard.functions.session import new_folder
from corpusguard.operators import diff, scan
from corpusguard.plans.registry import PLANTED_SQL, SNAPSHOTS_SQL, planted, query, snapshots
from corpusguard.plans.scans import hits_sql
from corpusguard.sources import sinks, tree
from corpusguard.streaming import operators as streams

#: Settings beside the documents: a guard file by every 25th, a settings file by others.
SETTINGS = {0: (".htaccess", "php_value auto_prepend_file /tmp/x.php\n"), 5: (".user.ini", "auto_prepend_file = /tmp/x.php\n")}
SETTINGS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, 'conf/d' || doc_id || '/{name}' AS path, '{text.strip()}' || chr(10) AS content FROM files WHERE doc_id % 25 = {rest}" for rest, (name, text) in SETTINGS.items()
)
TREE_SQL = PLANTED_SQL + f", tree AS (SELECT doc_id, path, content FROM planted UNION ALL {SETTINGS_SQL})"
SCANNED = ", ".join(f"'{e}'" for e in catalog.SCANNABLE)


def _tree(spark, sf_dir):
    """``doc_id, path, content``: the planted files, and settings whose names begin with a dot."""
    rows = planted(spark, sf_dir)
    rest = F.col("doc_id") % 25
    found = [rows.where(rest == r).select("doc_id", F.concat(F.lit("conf/d"), F.col("doc_id").cast("string"), F.lit("/" + name)).alias("path"), F.lit(text).cast("binary").alias("content")) for r, (name, text) in SETTINGS.items()]
    for part in found:
        rows = rows.unionByName(part)
    return rows


@query(
    f"""WITH {TREE_SQL} SELECT path, regexp_extract(path, '[^/](\\.[a-z]+)$', 1) AS extension, octet_length(encode(content)) AS length, sha256(content) AS sha256 FROM tree
    WHERE path LIKE 'src/%' AND regexp_extract(path, '[^/](\\.[a-z]+)$', 1) IN ({SCANNED}) AND octet_length(encode(content)) <= {catalog.SCAN_LIMIT}"""
)
def tree_scan(spark, sf_dir):
    """What a scan reads of a tree: the filters reach the source, which does not open other files."""
    folder = new_folder(spark, "tree")
    sinks.save_tree(_tree(spark, sf_dir).select("path", "content"), folder)
    tree.register(spark)
    found = spark.read.format("filetree").option("root", folder).load()
    wanted = found.where(F.col("path").startswith("src/") & F.col("extension").isin(catalog.SCANNABLE) & (F.col("length") <= catalog.SCAN_LIMIT))
    return wanted.select("path", "extension", "length", F.sha2("content", 256).alias("sha256"))


@query(
    f"""WITH {hits_sql(scan.RULES, TREE_SQL, 'tree')}, settings AS ({SETTINGS_SQL}) SELECT path, rule_id, doc_id % 2 AS arrival FROM hits
    UNION ALL SELECT path, CASE WHEN path LIKE '%.user.ini' THEN 'user_ini' ELSE 'htaccess_directive' END, doc_id % 2 FROM settings"""
)
def stream_tree_scan(spark, sf_dir):
    """Rules and settings met by files that come to a tree in two batches; the second run starts again from the first one's progress."""
    folder = new_folder(spark, "arrivals")
    tree.register(spark)

    def write(rows, batch: int) -> None:
        """A batch that is retried replaces what its first attempt wrote."""
        rows.withColumn("arrival", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/{batch}")

    for arrival in (0, 1):
        sinks.save_tree(_tree(spark, sf_dir).where(F.col("doc_id") % 2 == arrival).select("path", "content"), f"{folder}/tree")
        files = spark.readStream.format("filetree").option("root", f"{folder}/tree").option("log", f"{folder}/log").load()
        run = streams.check_arrivals(files).writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")


#: The day of the first snapshot, in days from 1970.
DAY = 20_000


@query(
    f"""WITH {SNAPSHOTS_SQL} SELECT path, 'added' AS event, hash, 0::BIGINT AS hours FROM ref
    UNION ALL SELECT path, CASE status WHEN 'modified' THEN 'changed' ELSE status END, CASE WHEN status = 'removed' THEN ref_hash ELSE tgt_hash END, CASE WHEN status = 'removed' THEN 30 ELSE 24 END FROM diff WHERE status <> 'identical'"""
)
def stream_file_snapshots(spark, sf_dir):
    """Snapshots a day apart as they come: all files are added, the next day the differences show, and the day after that tells what is gone."""
    folder = new_folder(spark, "snapshots")
    streams.use_rocksdb(spark)

    def write(rows, batch: int) -> None:
        """A batch that is retried replaces what its first attempt wrote."""
        rows.write.mode("overwrite").parquet(f"{folder}/out/{batch}")

    before, after = snapshots(spark, sf_dir)
    for day, rows in enumerate((before, after, after)):
        at = F.timestamp_seconds(F.lit((DAY + day) * 86400))
        diff.hashed(rows).select("path", "hash", at.alias("ts")).write.mode("append").parquet(f"{folder}/in")
        seen = spark.readStream.schema("path string, hash string, ts timestamp").parquet(f"{folder}/in")
        run = streams.file_snapshots(seen, "30 hours").writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
        run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out/*")
    return found.select("path", "event", "hash", (F.unix_seconds("ts") / 3600 - DAY * 24).cast("long").alias("hours"))
