"""Deduplication of repeated runs of lines by a suffix array over line ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusguard.llm.runtime import SPACE, broadcast_if_small, fresh_names, text_or_empty
from corpusguard.llm.suffix_array import longest_earlier


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, SPACE, " "))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at the given places among their lines with words."""

    def cut(text: str | None, places) -> str | None:
        if text is None:
            return None
        places, at, kept = set(places), -1, []
        for line in text.split("\n"):
            spoken = line.strip(" \t\n\r\x0b\x0c") != ""
            at += spoken
            if not (spoken and at in places):
                kept.append(line)
        return "\n".join(kept)

    return pd.Series([cut(t, g) for t, g in zip(texts, gone)], dtype=object)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, tag, at, name, n_words``: the lines with words of each row, their places among these, and their 128-bit ids.

    ``tag`` tells rows with one id and different texts apart.
    """
    text = text_or_empty(text_col)
    spoken = F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != "")
    named = F.transform(spoken, lambda x: F.struct(F.unhex(F.md5(x)).alias("name"), F.regexp_count(x, F.lit(" ")).alias("n")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tag"), F.posexplode(named).alias("at", "line"))
    return rows.select("doc", "tag", "at", "line.name", (F.col("line.n") + 1).alias("n_words"))


def _order() -> Column:
    return F.struct(F.col("doc").isNull().alias("last"), "doc", "tag", "at")


def later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 25) -> DataFrame:
    """``doc, tag, at, length, fresh``: the maximal runs of lines that occur earlier, in the order of ids and lines.

    A run is the longest from its line on that stands in one piece in an earlier place;
    those inside the run that begins a line before are left out. It has ``min_lines`` lines
    or more, or begins with one of ``min_words`` words. A run never crosses the end of a
    document. ``fresh`` is its first line that no run before it has.
    """
    found = longest_earlier(_lines(docs, id_col, text_col), ["doc", "tag"], _order(), ("n_words",))
    found = found.where((F.col("length") >= min_lines) | (F.col("n_words") >= min_words))
    before = Window.partitionBy("doc", "tag").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(F.col("at") + F.col("length")).over(before), F.lit(0))
    found = found.withColumn("reached", reached).where(F.col("at") + F.col("length") > F.col("reached"))
    return found.select("doc", "tag", "at", "length", F.greatest("at", "reached").alias("fresh"))


def later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 25) -> DataFrame:
    """One row per document that loses lines: ``doc, tag`` and ``gone``, the sorted places of the lines of :func:`later_runs`."""
    runs = later_runs(docs, id_col, text_col, min_lines, min_words)
    covered = runs.select("doc", "tag", F.explode(F.sequence("fresh", F.col("at") + F.col("length") - 1)).alias("at"))
    return covered.groupBy("doc", "tag").agg(F.sort_array(F.collect_list("at")).alias("gone"))


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 25) -> DataFrame:
    """One row per maximal later run: ``id_col``, ``first_line`` and ``n_lines``, counted over the lines with words.

    Runs of a document may overlap where each occurs earlier and both together do not.
    Defined cases as in :func:`drop_later_runs`.
    """
    runs = later_runs(docs, id_col, text_col, min_lines, min_words)
    return runs.select(F.col("doc").alias(id_col), F.col("at").alias("first_line"), F.col("length").alias("n_lines"))


def drop_later_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_words: int = 25) -> DataFrame:
    """``docs`` with all its columns, their texts without the later copies of repeated runs of lines.

    Lines are equal when they are after white space is made single spaces and trimmed;
    lines without words are no part of runs and stay. Documents that lose lines and have
    no words left go; others keep their remaining lines unchanged. What goes is joined to
    the texts in a broadcast where its size is within the bound; only beyond it are texts
    shuffled.

    Defined cases: null and empty texts have no lines and stay as they are; a null id
    ranks last; rows with one id and one text are one document's lines twice over, so
    that their own repeats count as in any other document, with one verdict for both; an
    empty table gives an empty result; other columns stay, whatever their names.
    """
    own_doc, own_tag, own_gone, left = fresh_names(docs, "doc", "tag", "gone", "left")
    gone = later_lines(docs, id_col, text_col, min_lines, min_words)
    gone = broadcast_if_small(gone.select(F.col("doc").alias(own_doc), F.col("tag").alias(own_tag), F.col("gone").alias(own_gone)), F.size(own_gone) * 8 + 64)
    same = docs[id_col].cast("long").eqNullSafe(gone[own_doc]) & (F.xxhash64(text_or_empty(docs[text_col])) == gone[own_tag])
    joined = docs.join(gone, same, "left")
    cut = F.col(own_gone).isNotNull()
    joined = joined.withColumn(left, _without(F.when(cut, docs[text_col]), F.col(own_gone)))
    joined = joined.where(~cut | (_normal(F.col(left)) != "")).withColumn(text_col, F.when(cut, F.col(left)).otherwise(docs[text_col]))
    return joined.select(*docs.columns)
