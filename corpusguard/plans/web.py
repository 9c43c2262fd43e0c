"""Queries about pages and requests, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions.session import new_folder
from corpusguard.operators import web
from corpusguard.plans.registry import query, table
from corpusguard.streaming import operators as streams

LINKS_SQL = """
    links AS (
        SELECT page_id, url, unnest(regexp_extract_all(html, '\\s(?:href|src|action)\\s*=\\s*["'']([^"'']*)["'']', 1, 'i')) AS link FROM pages
    ), resolved AS (
        SELECT page_id, link, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link WHEN link LIKE '//%' THEN regexp_extract(url, '^([^:]*:)', 1) || link
            WHEN link LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || link ELSE regexp_extract(url, '^([^?#]*/)', 1) || link END AS resolved
        FROM links WHERE NOT regexp_matches(link, '^(data|javascript):', 'i')
    )"""


@query(f"WITH {LINKS_SQL} SELECT page_id, link, resolved FROM resolved")
def page_links(spark, sf_dir):
    return web.page_links(table(spark, sf_dir, "pages"))


@query(
    f"""WITH {LINKS_SQL}, e AS (SELECT DISTINCT regexp_extract(url, '^([^?#]*)', 1) AS path, regexp_extract(url, '^([a-z]+):', 1) AS category FROM pages),
    d AS (SELECT DISTINCT regexp_extract(url, '^([^?#]*)', 1) AS path FROM pages WHERE page_id % 3 <> 0), m AS (SELECT e.*, d.path IS NOT NULL AS met FROM e LEFT JOIN d USING (path)),
    r AS (SELECT coalesce(category, '(total)') AS category, count(*) AS expected, count(*) FILTER (WHERE met) AS discovered FROM m GROUP BY ROLLUP (category))
    SELECT category, expected, discovered, round(discovered * 1000 / expected) / 10 AS percent FROM r"""
)
def crawl_coverage(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("path", F.regexp_extract("url", "^([^?#]*)", 1))
    expected = pages.select(F.regexp_extract("url", "^([a-z]+):", 1).alias("category"), "path")
    return web.coverage(expected, pages.where("page_id % 3 <> 0").select("path"))


@query("SELECT page_id, 'debug_var_dump' AS \"check\" FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, 'php_fatal' FROM pages WHERE page_id % 11 = 0")
def page_checks(spark, sf_dir):
    added = F.concat(F.when(F.col("page_id") % 7 == 0, "var_dump($x)").otherwise(""), F.when(F.col("page_id") % 11 == 0, "Fatal error: x").otherwise(""))
    return web.page_checks(table(spark, sf_dir, "pages").withColumn("html", F.concat("html", added)))


@query("""SELECT page_id, 'raw' AS reflection FROM pages WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'encoded' FROM pages WHERE page_id % 5 = 1""")
def reflected_payloads(spark, sf_dir):
    """Every fifth page gives a payload back as it was sent, another fifth encoded."""
    encoded = web.PAYLOAD.replace("<", "&lt;").replace(">", "&gt;")
    shown = F.when(F.col("page_id") % 5 == 0, web.PAYLOAD).when(F.col("page_id") % 5 == 1, encoded).otherwise("")
    return web.reflected(table(spark, sf_dir, "pages").withColumn("html", F.concat("html", shown)))


def _requests(events: DataFrame) -> DataFrame:
    """Events as requests: errors are failures, purchases are posts, every tenth user calls an external host."""
    domain = F.when(F.col("user_id") % 10 == 0, "cdn.other.test").otherwise("app.site.test")
    url = F.concat(F.lit("https://"), domain, F.lit("/"), "event_type")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", url.alias("url"),
        F.when(F.col("event_type") == "purchase", "POST").otherwise("GET").alias("method"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
    )


SUMMARY_SQL = "count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS posts, count(*) FILTER (WHERE user_id % 10 = 0) AS external, count(*) FILTER (WHERE event_type = 'error') AS errors"


@query(f"SELECT user_id, {SUMMARY_SQL} FROM events GROUP BY user_id")
def request_summary(spark, sf_dir):
    return web.request_summary(_requests(table(spark, sf_dir, "events")), "site.test", F.col("user_id"))


@query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages WHERE url NOT LIKE '%.example.com/%' GROUP BY 1 HAVING NOT regexp_matches(host, '\\.example\\.com$')")
def external_hosts(spark, sf_dir):
    return web.external_hosts(table(spark, sf_dir, "pages"), r"\.example\.com$")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'host' ELSE 'ok' END AS verdict FROM pages")
def url_hygiene(spark, sf_dir):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("gopher"), "url")).when(F.col("page_id") % 5 == 1, F.lit("http:///path")).otherwise(F.concat(F.lit(" "), "url"))
    return table(spark, sf_dir, "pages").select("page_id", web.url_hygiene(url).alias("verdict"))


@query(
    """WITH a AS (SELECT event_id, (event_id * 7919) % 256 AS a, (event_id * 31) % 256 AS b FROM events)
    SELECT event_id, a IN (0, 10, 127) OR a >= 224 OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) AS internal FROM a"""
)
def internal_addresses(spark, sf_dir):
    part = lambda k: ((F.col("event_id") * k) % 256).cast("string")
    ip = F.concat_ws(".", part(7919), part(31), F.lit("1"), F.lit("2"))
    return table(spark, sf_dir, "events").select("event_id", web.internal_address(ip).alias("internal"))


@query("SELECT 'u' || user_id % 3 AS url, 'powered_by' AS \"check\", count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT 'u' || user_id % 3, 'server_version', count(*) FROM events WHERE event_type = 'click' GROUP BY 1")
def header_checks(spark, sf_dir):
    kind = F.col("event_type")
    headers = F.create_map(
        F.lit("x-content-type-options"), F.lit("nosniff"), F.lit("x-frame-options"), F.lit("DENY"),
        F.lit("x-powered-by"), F.when(kind == "view", "PHP/8").otherwise(""), F.lit("server"), F.when(kind == "click", "nginx/1.2").otherwise("nginx"),
    )
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("url"), headers.alias("headers"))
    return web.header_checks(rows).groupBy("url", "check").agg(F.count(F.lit(1)).alias("n"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns its output table."""
    spark = stream.sparkSession
    folder = new_folder(spark, "stream")

    def write(rows: DataFrame, batch: int) -> None:
        """A batch that is retried replaces what its first attempt wrote."""
        rows.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={batch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.drop("batch") if mode != "complete" else found


@query(f"SELECT date_trunc('hour', ts)::TIMESTAMP AS \"start\", {SUMMARY_SQL} FROM events GROUP BY 1")
def stream_request_windows(spark, sf_dir):
    rows = _drained(streams.request_windows(_requests(_stream(spark, sf_dir)), "site.test"), "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "total", "posts", "external", "errors")


@query(
    f"""WITH w AS (SELECT *, user_id % 7 = 0 AS late, unnest([date_trunc('hour', ts) + INTERVAL 30 MINUTE * (extract(minute FROM ts) // 30), date_trunc('hour', ts) + INTERVAL 30 MINUTE * (extract(minute FROM ts) // 30 - 1)]) AS start FROM events),
    m AS (SELECT max(ts) FILTER (WHERE user_id % 7 <> 0) - INTERVAL 2 HOUR AS first, max(ts) - INTERVAL 2 HOUR AS final FROM events)
    SELECT start::TIMESTAMP AS start, {SUMMARY_SQL} FROM w, m WHERE (NOT late OR start + INTERVAL 1 HOUR > first) AND start + INTERVAL 1 HOUR <= final GROUP BY start"""
)
def stream_sliding_windows(spark, sf_dir):
    """Windows of an hour every half hour, given out when they end; every seventh user's events come in a second batch, too late for most windows."""
    folder, events = new_folder(spark, "stream"), table(spark, sf_dir, "events")

    def write(rows: DataFrame, batch: int) -> None:
        """A batch that is retried replaces what its first attempt wrote."""
        rows.write.mode("overwrite").parquet(f"{folder}/out/{batch}")

    for late in (False, True):
        events.where((F.col("user_id") % 7 == 0) == late).write.mode("append").parquet(f"{folder}/in")
        windows = streams.request_windows(_requests(spark.readStream.schema(events.schema).parquet(f"{folder}/in")), "site.test", slide="30 minutes")
        run = windows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(write).start()
        run.awaitTermination()
    found = spark.read.parquet(f"{folder}/out/*")
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "total", "posts", "external", "errors")


@query(
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM e),
    w AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM s GROUP BY user_id, n)
    SELECT user_id, start, "end", events FROM w WHERE "end" <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"""
)
def stream_sessions(spark, sf_dir):
    """Sessions that had ended when the stream did: two hours before its last event at the latest."""
    rows = _drained(streams.user_sessions(_requests(_stream(spark, sf_dir))), "append")
    return rows.select("user_id", *[F.col(f"session_window.{b}").cast("timestamp_ntz").alias(b) for b in ("start", "end")], "events")


@query("SELECT DISTINCT user_id || '|https://' || CASE WHEN user_id % 10 = 0 THEN 'cdn.other.test' ELSE 'app.site.test' END || '/' || event_type AS fingerprint FROM events")
def stream_dedupe(spark, sf_dir):
    rows = _requests(_stream(spark, sf_dir)).withColumn("fingerprint", F.concat_ws("|", "user_id", "url"))
    return _drained(streams.first_seen(rows), "append").select("fingerprint")


@query("SELECT 'u' || user_id AS path, max_by(event_type, (ts, event_type)) AS hash FROM events GROUP BY user_id")
def stream_file_state(spark, sf_dir):
    """The state of every path after the stream: the last of its events."""
    rows = _stream(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").alias("hash"), F.col("ts").cast("timestamp").alias("ts"))
    events = _drained(streams.file_events(rows), "append")
    return events.groupBy("path").agg(F.max_by("hash", F.struct("ts", "hash")).alias("hash"))
