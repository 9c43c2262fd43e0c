"""Merkle fixity audit of record archives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.runtime import broadcast_if_small, stored

#: Children of a tree node, a power of two: each node hashes at most so many.
FANOUT = 64


def record_digest(*fields: str) -> Column:
    """SHA-256 of a record: each field as its length, a colon and its text; null as ``-``."""
    parts = [F.when(F.col(f).isNull(), "-").otherwise(F.concat(F.length(F.col(f).cast("string")), F.lit(":"), F.col(f).cast("string"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def _leaves(records: DataFrame, archive: str, position: str, fields: tuple[str, ...]) -> DataFrame:
    """``archive, pos, hash``: the hash of each position of one replica."""
    rows = records.select(F.coalesce(F.col(archive).cast("string"), F.lit("")).alias("archive"), F.col(position).cast("long").alias("pos"), record_digest(*fields).alias("digest"))
    # records at one position add up, so that any number of repeats is one row from each task
    lanes = [F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)")) for at in (1, 16)]
    met = rows.groupBy("archive", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"), *[x.alias(f"s{i}") for i, x in enumerate(lanes)])
    many = F.sha2(F.concat_ws(":", F.col("n").cast("string"), "low", "high", F.col("s0").cast("string"), F.col("s1").cast("string")), 256)
    return met.select("archive", "pos", F.when(F.col("n") == 1, F.col("low")).otherwise(many).alias("hash"))


def parents(level: DataFrame) -> DataFrame:
    """The level above a level ``archive, node, hash`` of a tree: each node hashes its children in order."""
    children = level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("of"))
    joined = F.array_join(F.transform("of", lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["hash"])), ",")
    return children.select("archive", F.col("up").alias("node"), F.sha2(joined, 256).alias("hash"))


def tree(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The levels ``archive, node, hash`` of the trees of one replica, leaves first, roots last; each is stored."""
    levels = [leaves]
    for _ in range(height):
        levels.append(stored(parents(levels[-1])))
    return levels


def children(level: DataFrame, bad: DataFrame) -> DataFrame:
    """``archive, node, hash, branch``: the nodes of a level below the nodes ``(archive, node, branch)`` of the one above it."""
    upper = bad.select(F.col("archive").alias("up_archive"), F.col("node").alias("up_node"), "branch")
    met = level.join(upper, (F.col("archive") == F.col("up_archive")) & (F.floor(F.col("node") / FANOUT) == F.col("up_node")))
    return met.select("archive", "node", "hash", "branch")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``archive, node, a, b, branch``: nodes ``archive, node, hash, branch`` that the sides hash otherwise, or that one side lacks."""
    left, right = (side.select("archive", "node", F.col("hash").alias(name), F.col("branch").alias(f"branch_{name}")) for side, name in ((a, "a"), (b, "b")))
    met = left.join(right, ["archive", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return met.select("archive", "node", "a", "b", F.array_append(F.coalesce("branch_a", "branch_b"), F.col("node").cast("string")).alias("branch"))


def fixity_audit(primary: DataFrame, replica: DataFrame, archive: str, position: str, fields: tuple[str, ...]) -> DataFrame:
    """One row for each record of two replicas of archives that differs.

    Each replica builds trees of its own, one for each archive over the order of its records: a leaf is the SHA-256 of the
    record at a position, and a node covers an ordered range of positions, 64 times
    longer on each level, and hashes its children in order. Only roots meet at first, a row for each archive and side.
    Where they differ, the children of differing nodes are fetched from either side and
    compared, level by level, down to the records: what is compared is in proportion to
    the damage and the height, and all else is never aligned. Differing nodes are broadcast to the levels
    if their size allows it, so that a level is shuffled only where much of it is damaged. Nodes have 64 children at most
    however large an archive is. Only positions and hashes are shuffled.

    Defined cases: records that repeat a position are hashed together, with their
    number; a null position is one position before all others, a null archive is the
    archive ``''``, a null field differs from an empty one; two empty replicas agree;
    other columns are ignored whatever their names.

    Returns ``archive``, ``pos``, ``status`` (altered, missing, extra: in the replica),
    ``primary_hash``, ``replica_hash`` and ``branch`` (the nodes from the root down).
    """
    sides = [stored(_leaves(df, archive, position, fields)) for df in (primary, replica)]
    bounds = [leaves.agg(F.min("pos"), F.max("pos")).first() for leaves in sides]
    low = min((b[0] for b in bounds if b[0] is not None), default=0) - 1  # a null position takes the place before the first
    high = max((b[1] for b in bounds if b[1] is not None), default=0)
    height = max(1, math.ceil(math.log(max(high - low + 1, 2), FANOUT)))
    trees = [tree(leaves.select("archive", F.coalesce(F.col("pos") - low, F.lit(0)).alias("node"), "hash"), height) for leaves in sides]
    none = F.array().cast("array<string>")
    bad = differing(*(levels.pop().withColumn("branch", none) for levels in trees))
    for _ in range(height):
        nodes = broadcast_if_small(bad.select("archive", "node", "branch"), F.length("archive") + 16 * F.size("branch") + 32)
        bad = differing(*(children(levels.pop(), nodes) for levels in trees))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("altered")
    at = F.when(F.col("node") > 0, F.col("node") + low)
    return bad.select("archive", at.alias("pos"), status.alias("status"), F.col("a").alias("primary_hash"), F.col("b").alias("replica_hash"), F.array_join("branch", "/").alias("branch"))
