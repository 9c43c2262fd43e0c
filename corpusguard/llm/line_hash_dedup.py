"""Substring deduplication by hashing sentences, lines or paragraphs."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusguard.llm.runtime import fresh_names, map_texts, text_or_empty

_WORD, _LOW, _SPACE = r"[^\x20\x09-\x0D.!?]", r"[^\x20\x09-\x0D.!?\p{Lu}]", r"[\x20\x09\x0B-\x0D]"
#: What is a unit: a sentence ends at its full stop, at the line's end and before a word with a capital.
UNITS = {
    "sentence": regex.compile(rf"{_WORD}(?:{_WORD}|{_SPACE}+{_LOW})*+[.!?]*"),
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(rf"{_SPACE}*+[^\x20\x09-\x0D][^\n]*(?:\n{_SPACE}*+[^\x20\x09-\x0D][^\n]*)*"),
}
_UNIT = pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("digest", pa.binary())])


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence") -> DataFrame:
    """``id_col, tag, unit, start, end, n_words, digest`` of every unit that has words, numbered within its text.

    ``start`` and ``end`` are offsets in code points of the original text; the digest is
    128 bits of the unit in lower case with its white space made single spaces. ``tag``
    is the 64-bit hash of the text and tells rows with one id apart.
    """

    def start():
        def split(text: str) -> list[dict]:
            found = []
            for m in UNITS[unit].finditer(text):
                words = m[0].encode("utf-8").split()
                if words:
                    normal = b" ".join(words).decode("utf-8").lower().encode("utf-8")
                    found.append({"unit": len(found), "start": m.start(), "end": m.end(), "n_words": len(words), "digest": hashlib.md5(normal).digest()})
            return found

        def tag(text: str) -> int:
            value = xxhash.xxh64_intdigest(text.encode("utf-8"), 42)
            return value - (1 << 64) if value >> 63 else value

        return lambda texts: [list(map(tag, texts)), list(map(split, texts))]

    rows = map_texts(docs, id_col, text_or_empty(text_col), {"tag": pa.int64(), "units": pa.list_(_UNIT)}, start)
    return rows.select(id_col, "tag", F.inline("units"))


#: Units of fewer words hold a run together but add nothing to its size.
COUNTED_WORDS = 3


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = 25) -> DataFrame:
    """One row per unit to remove: later occurrences of units in runs of ``min_words`` words and more.

    A map-side combined aggregate finds the first occurrence of each digest that occurs
    twice, ranked by id and position; the units come back to it by digest in a join that
    adaptive execution can split, so that a unit which a third of all documents share is
    no task's burden. Later occurrences that follow one another in a document are a run.
    Units are as short as sentences, since passages begin and end within lines; the size
    of a run and not that of a unit decides what goes, since short sentences and lines
    recur in unrelated documents by chance (any unit in 45 % of those of sf0.1, runs of 10
    words in 18 %). Units of one or two words, as in shouted text, recur so often that
    chance makes runs of them: they count for nothing. Only digests and offsets are shuffled.

    Defined cases: null and empty texts have no units; a null id ranks last; rows that
    repeat an id with another text are documents of their own; of rows that repeat both,
    none loses a unit to the other, which whole-text deduplication is for; an empty table
    gives an empty result; other columns are ignored whatever their names.

    Returns ``id_col``, ``tag``, ``unit`` (its number), ``start``, ``end``, ``n_words``,
    ``run`` (the number of the run's first unit), ``run_words`` (those counted), ``keep_id`` and
    ``keep_unit`` (the occurrence that stays).
    """
    found = units(docs, id_col, text_col, unit)
    order = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("tag"), F.col("unit"))
    first = found.groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("final")).where("first <> final").select("digest", "first")
    later = found.join(first, "digest").where(~order.eqNullSafe(F.col("first")))
    document = Window.partitionBy(id_col, "tag")
    later = later.withColumn("chain", F.col("unit") - F.dense_rank().over(document.orderBy("unit")))
    run = Window.partitionBy(id_col, "tag", "chain")
    later = later.withColumns({"run": F.min("unit").over(run), "run_words": F.sum(F.when(F.col("n_words") >= COUNTED_WORDS, F.col("n_words")).otherwise(0)).over(run)}).where(F.col("run_words") >= min_words)
    return later.select(id_col, "tag", "unit", "start", "end", "n_words", "run", "run_words", F.col("first.id").alias("keep_id"), F.col("first.unit").alias("keep_unit"))


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(text: str | None, spans) -> str | None:
        if text is None or spans is None:
            return text
        kept, at = [], 0
        for start, end in sorted((s["start"], s["end"]) for s in spans):
            whole_lines = text[start - 1 : start] in ("", "\n") and text[end : end + 1] in ("", "\n")
            kept.append(text[at:start])
            at = end + whole_lines
        kept.append(text[at:])
        return "".join(kept)

    return pd.Series([cut(t, s) for t, s in zip(texts, spans)], dtype=object)


def drop_repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_words: int = 25) -> DataFrame:
    """``docs`` with the runs of :func:`repeated_units` cut out of their texts, all other columns as they are.

    A run that fills whole lines takes its line end with it. Defined cases as there; null
    texts stay null, and a document whose whole text goes stays with an empty one.
    """
    own_id, own_tag, cut = fresh_names(docs, "id", "tag", "cut")
    runs = repeated_units(docs, id_col, text_col, unit, min_words).groupBy(id_col, "tag", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy(F.col(id_col).alias(own_id), F.col("tag").alias(own_tag)).agg(F.collect_list(F.struct("start", "end")).alias(cut))
    same = docs[id_col].cast("long").eqNullSafe(spans[own_id]) & (F.xxhash64(text_or_empty(docs[text_col])) == spans[own_tag])
    return docs.join(spans, same, "left").withColumn(text_col, _without(docs[text_col], F.col(cut))).select(*docs.columns)
