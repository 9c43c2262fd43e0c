"""Findings related by words: to attack vectors, and code to the dependencies that it uses."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusguard.functions.matching import blocks, keyword_automaton, with_keywords, words_in
from corpusguard.functions.session import checkpointed


def vector_words(vectors: DataFrame) -> DataFrame:
    """``vector, keyword`` of ``vectors(vector, artifacts, patterns)``: words of more than three characters of both lists, in lower case."""
    none = F.array().cast("array<string>")
    texts = F.concat(F.coalesce("artifacts", none), F.coalesce("patterns", none))
    words = F.flatten(F.transform(F.array_compact(texts), lambda t: F.split(t, r"[\s,./\\]+")))
    return vectors.select("vector", F.explode(F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 3), F.lower))).alias("keyword"))


def vectors_related(findings: DataFrame, vectors: DataFrame) -> DataFrame:
    """``id, vector``: attack vectors whose words a finding's title, description or category holds, or with which it shares an indicator.

    ``findings(id, title, description, category, ioc_ids)``, ``vectors(vector, artifacts,
    patterns, iocs)``; words are met as substrings, whatever their number, by one
    automaton, and indicators by equality. Each pair is given once; null fields hold nothing.
    """
    found = _hits(findings, vectors)
    if found is None:
        return findings.select("id", F.lit(None).cast("string").alias("vector")).where("false")
    rows, repeated = found
    pairs = rows.select("id", "copy", F.explode("vectors").alias("vector"))
    once = pairs.where("NOT copy").select("id", "vector")
    return once.union(pairs.where("copy").select("id", "vector").distinct()) if repeated else once


def _hits(findings: DataFrame, vectors: DataFrame) -> tuple[DataFrame, bool] | None:
    """``id, vectors, copy``: the vectors of each finding by tables of words and indicators in its task, and whether its pairs may come twice; None without vectors.

    Pairs are many more than findings: those of an id with one row, met by one table, leave their task once and are not
    shuffled. Ids of several rows, or all rows where the vectors make several tables, may give a pair twice.
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "description", "category")]))
    iocs = vectors.select("vector", F.explode("iocs").alias("keyword")).where("keyword IS NOT NULL")
    keys = vector_words(vectors).select("vector", "keyword", F.lit(True).alias("word")).union(iocs.select("vector", "keyword", F.lit(False))).where("vector IS NOT NULL")
    rows = findings.select("id", F.struct(text.alias("text"), "ioc_ids").alias("held"))
    found = [rows.select("id", _table_of(findings.sparkSession, block)(F.col("held")).alias("vectors")) for block in blocks(keys.distinct(), "keyword")]
    if not found:
        return None
    if len(found) > 1:
        return reduce(DataFrame.union, found).withColumn("copy", F.lit(True)), True
    several = checkpointed(findings.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_id"), F.lit(True).alias("copy")))
    n = several.count()
    if not n:
        return found[0].withColumn("copy", F.lit(False)), False
    joined = found[0].join(F.broadcast(several) if n <= 200_000 else several, F.col("id").eqNullSafe(F.col("_id")), "left")
    return joined.select("id", "vectors", F.coalesce("copy", F.lit(False)).alias("copy")), True


def _table_of(spark: SparkSession, keys: list):
    """A function on columns ``struct<text, ioc_ids>``: the vectors of which it holds a word or an indicator, each once."""
    words, iocs = {}, {}
    for row in keys:
        (words if row.word else iocs).setdefault(row.keyword, []).append(row.vector)
    shared = spark.sparkContext.broadcast((keyword_automaton(words), words, iocs))

    @F.arrow_udf("array<string>")
    def met(held: pa.Array) -> pa.Array:
        automaton, words, iocs = shared.value
        found = []
        for at in range(0, len(held), 256):
            part = held.slice(at, 256)
            rows = []
            for text, ids in zip(part.field("text").to_pylist(), part.field("ioc_ids").to_pylist()):
                vectors = set()
                for word in words_in(automaton, text):
                    vectors.update(words[word])
                for ioc in ids or ():
                    vectors.update(iocs.get(ioc, ()))
                rows.append(list(vectors))
            found.append(pa.array(rows, pa.list_(pa.string())))
        return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.string()))

    return met


def vectors_hit(related: DataFrame, vectors: DataFrame, each_once: bool = False) -> DataFrame:
    """A report table: each vector with the number of findings ``(id, vector)`` that hit it, none included.

    With ``each_once`` no pair is there twice, as :func:`vectors_related` gives them: tasks count them and no pair is shuffled.
    """
    count = F.count if each_once else F.countDistinct
    hits = related.groupBy("vector").agg(count("id").alias("findings"))
    return vectors.select("vector").distinct().join(hits, "vector", "left").select("vector", F.coalesce("findings", F.lit(0)).alias("findings"))


def vulnerable_components(vulnerabilities: DataFrame) -> DataFrame:
    """``keyword``: words of the descriptions with a slash or a hyphen in them, in lower case and without marks around them."""
    words = F.filter(F.split(F.lower("description"), r"\s+"), lambda w: w.contains("/") | w.contains("-"))
    trimmed = F.transform(words, lambda w: F.regexp_replace(w, r"^[.:,()]+|[.:,()]+$", ""))
    return vulnerabilities.select(F.explode(F.array_distinct(trimmed)).alias("keyword")).where("keyword <> ''").distinct()


def dependency_synergy(code: DataFrame, vulnerabilities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings in code that name a vulnerable component, and the vulnerabilities of each such component.

    ``code(id, snippet, description, confidence)`` and ``vulnerabilities(id,
    description)``. The first table is ``id, component, n_related, confidence`` of code findings
    whose snippet or description holds a component as a substring: of several the
    smallest, the number of vulnerabilities whose description holds it, and
    the confidence that follows. The second is ``component, related_id``: what is related to all findings of a
    component, so that no product of both sides is built; :func:`related_to` joins it to chosen findings.
    """
    components = checkpointed(vulnerable_components(vulnerabilities))
    text = F.lower(F.concat_ws("\n", F.coalesce("snippet", F.lit("")), F.coalesce("description", F.lit(""))))
    named = with_keywords(code.select("id", "confidence", text.alias("text")), F.col("text"), components, "component").drop("text")
    first = checkpointed(named.groupBy("id").agg(F.min("component").alias("component"), F.first("confidence").alias("confidence")))
    used = first.select(F.col("component").alias("keyword")).distinct()
    related = with_keywords(vulnerabilities.select(F.col("id").alias("related_id"), F.lower("description").alias("text")), F.col("text"), used, "component").select("component", "related_id")
    counts = related.groupBy("component").agg(F.countDistinct("related_id").alias("n_related"))
    confidence = F.when(F.col("confidence") == "CONFIRMED", F.col("confidence")).otherwise("HIGH")
    return first.join(counts, "component").select("id", "component", "n_related", confidence.alias("confidence")), related.distinct()


def related_to(chosen: DataFrame, related: DataFrame) -> DataFrame:
    """``id, related_id`` of chosen findings ``(id, component)``; the number of rows is that of the chosen findings' relations."""
    return chosen.select("id", "component").join(related, "component").select("id", "related_id")
