"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import checkpointed


def _ends(*pairs: tuple[str, str]) -> Column:
    """A row ``a, b`` for each pair of columns."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in pairs]))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges(a, b)``.

    Alternates large-star and small-star steps until the edges no longer change. Each
    step is a map-side combined minimum per node and one join, so that a node with very
    many neighbours is one row in the aggregate and a splittable key in the join. The
    edges of each round are checkpointed; nothing but a count and a checksum comes to
    the driver.
    """
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    ordered = checkpointed(ordered)
    # a node keeps its smallest neighbour and hands it to the others, so that a group in which nodes know many of few others shrinks at once
    lowest = ordered.groupBy("u").agg(F.min("v").alias("m"))
    others = ordered.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    state, edges = None, checkpointed(lowest.select("u", F.col("m").alias("v")).union(others).distinct())
    for _ in range(max_rounds):
        both = edges.select(_ends(("u", "v"), ("v", "u")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(_ends(("u", "m"), ("v", "m"))).where("a > b")
        edges = checkpointed(small.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(_ends(("u", "v"), ("v", "v"))).select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
