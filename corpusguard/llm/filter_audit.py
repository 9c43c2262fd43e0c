"""Audits how the filters of a corpus interact, over every order in which they may be applied."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import SPACE, stored, text_or_empty

#: What a step of an order counts; each is a field of 64 bits of the packed number.
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
FIELD = 64


def text_failures(text: Column, min_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10, signs: str = "[#$%&*|]") -> dict[str, Column]:
    """The filters that look at one text: too few words, too many repeated ones, too many capitals, any of the signs."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < min_words, "B": 100 * distinct < distinct_percent * n, "C": 100 * capitals > upper_percent * F.length(text), "D": text.rlike(signs)}


def document_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``id_col, part, mask, quality, toxic``: bit ``i`` of ``mask`` is set where a document fails filter ``i`` of ``ABCDE``.

    E fails a document whose text an earlier id has, anywhere in the table; texts meet as
    SHA-256, with the smallest id by a map-side combined aggregate, and go back by a join
    on texts that have several ids.
    """
    known = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("quality"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(part_col).alias("part"), text_or_empty(text_col).alias("text"))
    bits = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    narrow = stored(texts.select("id", "part", bits.cast("int").alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copies = narrow.join(first, "digest", "left").join(known, F.col("id") == F.col("_id"), "left")
    mask = F.col("bits") + F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    return copies.select(F.col("id").alias(id_col), "part", mask.cast("int").alias("mask"), F.coalesce("quality", F.lit(False)).alias("quality"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def steps(filters: str) -> list[tuple[str, int, int, int]]:
    """``(order, step, bit of its filter, bits of the filters before it)`` of every step of every order."""
    found = []
    for order in permutations(filters):
        before = 0
        for number, letter in enumerate(order, 1):
            bit = 1 << filters.index(letter)
            found.append(("".join(order), number, bit, before))
            before |= bit
    return found


def packed_outcomes(mask: int, quality: bool, toxic: bool, plan: list[tuple[str, int, int, int]]) -> int:
    """One document's outcome at every step of every order, as a number with a field for each count of each step."""
    fields = bytearray(FIELD // 8 * len(COUNTS) * len(plan))
    for at, (_, _, bit, before) in enumerate(plan):
        fails, earlier = bool(mask & bit), bool(mask & before)
        removed = fails and not earlier
        outcome = (not fails and not earlier, removed, fails and earlier, mask == bit, removed and quality, removed and toxic)
        fields[FIELD // 8 * len(COUNTS) * at : FIELD // 8 * len(COUNTS) * (at + 1) : FIELD // 8] = bytes(outcome)
    return int.from_bytes(fields, "little")


def filter_audit(masks: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """``part, filter_order, step`` with counts of every step of every order of the filters, zeros included.

    ``masks`` has ``part, mask, quality, toxic``. The outcomes of a mask at all steps are one
    wide number; the numbers of a part's documents are summed and the sum is taken apart. A field has
    64 bits and a table fewer rows than that, so no field runs into the next. Equal masks of a
    part are counted first, map-side, and their number is multiplied by the count: a part sends at most four
    rows a mask to its task, however many documents it has.

    Defined cases: a null part is the empty string, null flags are false; a null mask is no failure;
    repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    classes = masks.groupBy(text_or_empty("part").alias("part"), F.coalesce("mask", F.lit(0)).alias("mask"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("quality", "toxic")))
    plan = steps(filters)
    width = FIELD // 8
    orders, numbers = [order for order, *_ in plan], [number for _, number, *_ in plan]

    def unpack(key: tuple, rows: pa.Table) -> pa.Table:
        total = 0
        for row in rows.to_pylist():
            total += row["n"] * packed_outcomes(row["mask"], row["quality"], row["toxic"], plan)
        data = total.to_bytes(width * len(COUNTS) * len(plan), "little")
        fields = [int.from_bytes(data[i : i + width], "little") for i in range(0, len(data), width)]
        columns = {name: fields[i :: len(COUNTS)] for i, name in enumerate(COUNTS)}
        all_orders = dict.fromkeys((bit for _, _, bit, _ in plan), 0)
        for (_, _, bit, _), removed in zip(plan, columns["removed"]):
            all_orders[bit] += removed
        shapley = [all_orders[bit] for _, _, bit, _ in plan]
        part = pa.array([key[0].as_py()] * len(plan), pa.string())
        return pa.table({"part": part, "filter_order": orders, "step": pa.array(numbers, pa.int32()), **{k: pa.array(v, pa.int64()) for k, v in columns.items()}, "shapley": pa.array(shapley, pa.int64())})

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return classes.agg(F.count(F.lit(1)).alias("n")).groupBy("part").applyInArrow(unpack, schema)
