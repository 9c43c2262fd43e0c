"""Suffix intervals of token sequences by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusguard.llm.runtime import stored


def ranked(groups: DataFrame, *keys: str) -> DataFrame:
    """``groups`` with ``rank``: in key order, the sum of ``n`` over all rows before.

    A range partitioning sorts the keys; running sums inside each range, and the sums of
    the ranges before it, make the ranks, so that no task orders them all. There are as
    many ranges as the session has shuffle partitions, fewer where adaptive execution
    finds them small.
    """
    placed = stored(groups.repartitionByRange(*keys).withColumn("range", F.spark_partition_id()))
    sums = placed.groupBy("range").agg(F.sum("n").alias("sum"))  # a row for each range
    base = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("n").over(Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(base.select("range", "base")), "range")
    return placed.withColumn("rank", F.col("base") + F.col("inside")).drop("range", "inside", "base")


def repeated_prefixes(tokens: DataFrame, text: list[str], order: Column, depth: int, space: tuple[str, ...] = (), repeated: Column | None = None) -> DataFrame:
    """The suffixes whose first ``depth`` tokens also begin another suffix of their space.

    ``tokens`` has the columns ``text`` (which sequence), ``space`` (within which
    sequences are compared), ``at`` (the place in the sequence) and ``name`` (the token's
    id). Suffixes are sorted to the depth that matters. Token ids are the ranks at depth
    1; each round pairs the rank of a suffix with that of the suffix ``k`` places on,
    counts the pairs with map-side combining, and ranks the distinct ones. Suffixes of
    one rank are an interval of the suffix array whose longest common prefix is the
    round's depth or more. Only suffixes of intervals that are ``repeated`` (two and
    more suffixes, unless a condition is given) enter the next round: a longer prefix
    does not repeat where a shorter one does not. The last round overlaps its halves, so
    that any depth is met exactly.

    Returns ``space``, ``text``, ``at``, ``rank`` (the first place of the interval),
    ``n`` (its suffixes) and ``first`` (the smallest ``order`` in it).
    """
    repeated = F.col("n") > 1 if repeated is None else repeated
    counted = [F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("final")]
    kept = [*space, *text, "at"]

    def narrowed(rows: DataFrame, keys: list[str]) -> DataFrame:
        groups = ranked(rows.groupBy(*keys).agg(*counted).where(repeated), *keys)
        return stored(rows.join(groups, keys).select(*kept, F.col("rank").alias("name"), "n", "first"))

    active, reached = narrowed(tokens.select(*kept, "name"), [*space, "name"]), 1
    while reached < depth:
        step = min(reached, depth - reached)
        ahead = Window.partitionBy(*text).orderBy("at").rangeBetween(step, step)
        pairs = active.withColumn("next", F.first("name").over(ahead)).where("next IS NOT NULL")
        active = narrowed(pairs.select(*kept, "name", "next"), [*space, "name", "next"])
        reached += step
    return active.withColumnRenamed("name", "rank")


def longest_earlier(tokens: DataFrame, text: list[str], order: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """For each suffix the longest prefix that an earlier one begins with as well: ``text, at, length`` and ``extra`` columns.

    Prefix doubling names the prefixes of 1, 2, 4, ... tokens until none repeats. The
    longest common prefixes are then found from the longest doubling down: suffixes that
    share a prefix (an interval of the suffix array, named by its first suffix) are
    divided by the next 2^k tokens. In each part of two and more the later suffixes go on
    with the longer prefix, and so does a copy of the first one, as their witness; it
    stays in the interval itself, where it may meet an earlier one at a shorter length and
    stands for those that went on. Rounds are twice the logarithm of the longest repeat;
    each is a join by place, an aggregate with map-side combining and a join back. The
    rows of each round are those whose first token repeats, and a witness for each part.
    """
    place = [*text, "at"]
    counted = [F.count(F.lit(1)).alias("n")]

    def narrowed(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
        groups = ranked(rows.groupBy(*keys).agg(*counted).where("n > 1"), *keys)
        return rows.join(groups, keys).select(*kept, F.col("rank").alias("name"))

    # rows that repeat a place are one
    base = stored(narrowed(tokens, ["name"], [*place, *extra]).dropDuplicates(place))
    levels, span = [base.select(*place, "name")], 1
    while True:
        ahead = Window.partitionBy(*text).orderBy("at").rangeBetween(span, span)
        pairs = levels[-1].withColumn("next", F.first("name").over(ahead)).where("next IS NOT NULL")
        longer = stored(narrowed(pairs, ["name", "next"], place))
        if longer.isEmpty():
            break
        levels.append(longer)
        span *= 2

    state = base.select(*place, F.lit(0).alias("length"), F.lit(None).cast(base.select(order.alias("o")).schema["o"].dataType).alias("name"), F.lit(False).alias("witness"))
    while levels:
        names = levels.pop().select(*[F.col(c).alias(f"{c}_") for c in text], F.col("at").alias("at_"), F.col("name").alias("next"))
        same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in text]
        rows = state.join(names, [*same, F.col("at") + F.col("length") == F.col("at_")], "left").select(*state.columns, "next")
        parts = rows.where("next IS NOT NULL").groupBy("length", "name", "next").agg(*counted, F.min(order).alias("first")).where("n > 1")
        parts = parts.select(F.col("length").alias("length_"), F.col("name").alias("name_"), F.col("next").alias("next_"), "first")
        met = (F.col("length") == F.col("length_")) & F.col("name").eqNullSafe(F.col("name_")) & (F.col("next") == F.col("next_"))
        rows = rows.join(parts, met, "left")
        stays = F.struct("length", "name", "witness")
        leads = order.eqNullSafe(F.col("first"))
        goes = F.struct((F.col("length") + span).alias("length"), F.col("first").alias("name"), (F.col("witness") | leads).alias("witness"))
        after = F.when(F.col("first").isNull(), F.array(stays)).when(leads, F.array(stays, goes)).otherwise(F.array(goes))
        state = stored(rows.select(*place, F.explode(after).alias("s")).select(*place, "s.*"))
        span //= 2
    found = state.where("NOT witness AND length > 0").select(*place, "length")
    if not extra:
        return found
    values = base.select(*[F.col(c).alias(f"{c}_") for c in place], *extra)
    return found.join(values, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in place]).select(*place, "length", *extra)
