"""Queries that apply the operators to the given tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.llm import byte_bpe, decontaminate, exact_dedup, filter_audit, host_boilerplate, line_hash_dedup, line_runs, merkle, packing, simhash, spelling, toxicity, wordpiece
from corpusguard.llm.runtime import table


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(byte_bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica with altered, missing and added records."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"))
    altered = F.when(F.col("page_id") % 41 == 7, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    replica = pages.where("page_id % 97 <> 5").withColumn("html", altered)
    added = pages.where("page_id % 89 = 3").withColumn("page_id", F.col("page_id") + 1_000_000_000)
    return merkle.fixity_audit(pages, replica.unionByName(added), "host", "page_id", ("url", "html")).drop("branch")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_hash_dedup.repeated_units(table(spark, sf_dir, "documents")).drop("tag")


def op6_line_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_runs.drop_later_runs(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.length("text").cast("long").alias("n_left"), F.sha2("text", 256).alias("text_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_boilerplate.main_text(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=199))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_merkle_fixity, op2_token_counts, op3_exact_dedup, op4_decontamination, op5_line_hash_dedup, op6_line_run_dedup, op7_html_extraction,
        op8_simhash_near_dedup, op9_byte_bpe, op10_toxicity, op11_spelling_variants, op12_best_fit_packing, op13_filter_audit,
    )
}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        ), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op1_merkle_fixity": r"""
        WITH a AS (
            SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS archive, url, html FROM pages
        ), b AS (
            SELECT page_id, archive, url, CASE WHEN page_id % 41 = 7 THEN html || ' ' ELSE html END AS html FROM a WHERE page_id % 97 <> 5
            UNION ALL SELECT page_id + 1000000000, archive, url, html FROM a WHERE page_id % 89 = 3
        ), ha AS (
            SELECT page_id, archive, sha256(length(url) || ':' || url || length(html) || ':' || html) AS h FROM a
        ), hb AS (
            SELECT page_id, archive, sha256(length(url) || ':' || url || length(html) || ':' || html) AS h FROM b
        )
        SELECT coalesce(ha.archive, hb.archive) AS archive, coalesce(ha.page_id, hb.page_id) AS pos,
            CASE WHEN hb.h IS NULL THEN 'missing' WHEN ha.h IS NULL THEN 'extra' ELSE 'altered' END AS status,
            ha.h AS primary_hash, hb.h AS replica_hash
        FROM ha FULL JOIN hb ON ha.archive = hb.archive AND ha.page_id = hb.page_id
        WHERE ha.h IS DISTINCT FROM hb.h
    """,
    "op5_line_hash_dedup": r"""
        WITH s AS (
            SELECT doc_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS number
            FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D.!?](?:[^\x20\x09-\x0D.!?]|[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D.!?\p{Lu}])*[.!?]*|[\x20\x09-\x0D.!?]+') AS pieces
                FROM documents
            )
        ), p AS (
            SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                trim(lower(regexp_replace(piece, '[\x20\x09-\x0D]+', ' ', 'g'))) AS normal
            FROM s
        ), u AS (
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1 AS unit, start, start + length(piece) AS "end",
                len(string_split(normal, ' ')) AS n_words, normal
            FROM p WHERE regexp_matches(piece, '[^\x20\x09-\x0D.!?]')
        ), f AS (
            SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(unit) OVER w AS keep_unit FROM u WINDOW w AS (PARTITION BY normal ORDER BY doc_id, unit)
        ), c AS (
            SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS chain FROM f WHERE doc_id <> keep_id OR unit <> keep_unit
        ), r AS (
            SELECT *, min(unit) OVER (PARTITION BY doc_id, chain) AS run, sum(CASE WHEN n_words >= 3 THEN n_words ELSE 0 END) OVER (PARTITION BY doc_id, chain) AS run_words FROM c
        )
        SELECT doc_id, unit::INTEGER AS unit, start::INTEGER AS start, "end"::INTEGER AS "end", n_words::INTEGER AS n_words, run::INTEGER AS run,
            run_words::BIGINT AS run_words, keep_id, keep_unit::INTEGER AS keep_unit
        FROM r WHERE run_words >= 25
    """,
    "op6_line_run_dedup": r"""
        WITH s AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number
            FROM documents
        ), l AS (SELECT *, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS normal FROM s),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number) AS place FROM l WHERE normal <> ''),
        w AS (SELECT *, lead(normal) OVER (PARTITION BY doc_id ORDER BY place) AS following FROM k),
        f AS (
            SELECT *, row_number() OVER (PARTITION BY normal, following ORDER BY doc_id, place) > 1 AS later FROM w WHERE following IS NOT NULL
        ), long AS (
            SELECT *, row_number() OVER (PARTITION BY normal ORDER BY doc_id, place) > 1 AS later FROM k WHERE len(string_split(normal, ' ')) >= 25
        ), gone AS (
            SELECT doc_id, place FROM f WHERE later UNION SELECT doc_id, place + 1 FROM f WHERE later UNION SELECT doc_id, place FROM long WHERE later
        ),
        kept AS (
            SELECT l.doc_id, l.number, l.line, l.normal, g.place IS NOT NULL AS gone
            FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.number = k.number LEFT JOIN gone g ON k.doc_id = g.doc_id AND k.place = g.place
        ), texts AS (
            SELECT doc_id, coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY number), '') AS text,
                bool_or(gone) AS cut, bool_or(normal <> '' AND NOT gone) AS words
            FROM kept GROUP BY doc_id
        )
        SELECT doc_id, length(text) AS n_left, sha256(text) AS text_sha256 FROM texts WHERE words OR NOT cut
    """,
    "op13_filter_audit": r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
        ), f AS (
            SELECT doc_id, part,
                CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
            FROM w
        ), l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS quality, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
        c AS (
            SELECT part, fails, count(*) AS n, coalesce(sum(quality), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
        ), o AS (
            SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
        ), s AS (
            SELECT filter_order, step, filter_order[step] AS filter, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5
        ), r AS (
            SELECT part, filter_order, step, filter, fails = filter AS alone, contains(fails, filter) AS fails_here,
                earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN 'x' ELSE earlier END || ']') AS gone, n, good, toxic
            FROM c, s
        ), a AS (
            SELECT part, filter_order, step, filter, sum(CASE WHEN NOT fails_here AND NOT gone THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN fails_here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails_here AND gone THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails_here AND NOT gone THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN fails_here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
            FROM r GROUP BY part, filter_order, step, filter
        )
        SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
            unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
        FROM a
    """,
}
