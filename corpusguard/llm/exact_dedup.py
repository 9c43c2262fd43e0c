"""Exact deduplication by content hash, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import SPACE, broadcast_if_small, text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits of the text, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=content_hash) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays.

    Texts are equal when they are identical after each run of ASCII white space became
    one space; null counts as empty. Rows are grouped by the 128-bit hash, and inside a
    group by the bytes themselves, so that texts whose hashes collide stay apart. The
    smallest id of a group stays.

    The only shuffle of texts comes after a map-side aggregation: each task sends a text
    once, however often it has it, and a group that holds a third of all rows arrives as
    one row from each task. The verdicts go back to the rows by the 128-bit hash and
    SHA-256 together, and not by bytes: bytes are compared where the groups are made, and
    two texts of one group-hash would have to share both digests to swap verdicts. That
    join has no aggregate above it, so that adaptive execution splits a hot hash.

    Defined cases: a row whose id is null stays only where no row of its group has an
    id; rows that repeat an id are one document and get the same verdict, and
    ``group_size`` counts rows; an empty table gives an empty result; other columns are
    ignored whatever their names.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the
    normalised text in UTF-8).
    """
    keyed = docs.select(F.col(id_col).alias("_id"), F.regexp_replace(text_or_empty(text_col), SPACE, " ").alias("_norm"))
    keyed = keyed.select("_id", "_norm", hashed(F.col("_norm")).alias("_hash"))
    sha = F.unhex(F.sha2(F.col("_norm"), 256)).alias("_sha")
    groups = keyed.groupBy("_hash", "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("_hash", sha, "keep_id", "group_size")
    rows = keyed.select("_id", "_hash", sha)
    return rows.join(groups, ["_hash", "_sha"]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without the rows that :func:`exact_duplicates` drops.

    Defined cases as there: of rows that repeat an id all stay or go; a row without an id
    stays where no row of its group has one, and then all such rows do; null and empty
    texts are one group; other columns stay, whatever their names. What goes is joined in
    a broadcast where it is small, so that texts need no second shuffle.
    """
    verdicts = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("_goes"), "kept")
    goes = broadcast_if_small(verdicts.groupBy("_goes").agg(F.max("kept").alias("kept")).where("NOT kept").select("_goes"))
    return docs.join(goes, docs[id_col].eqNullSafe(goes["_goes"]), "left_anti")
