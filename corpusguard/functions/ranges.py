"""What follows in order, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusguard.functions.session import checkpointed


def last_known(rows: DataFrame, group: str, order: str, value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with the last value that is not null up to each row of its ``group`` in ``order``, its own included.

    The rows are cut into ranges of (group, order), as many as the session has shuffle
    partitions, so that a group with very many rows lies in several. Each range carries
    values forward by itself; what it takes over is the last value of the ranges before
    it, a row for each range, which are ordered alone. The placement is checkpointed, so
    that a lost executor cannot change it. Rows with a null group are a group of their own.
    """
    placed = rows.withColumn(name, value)
    placed = placed.repartitionByRange(ranges, group, order) if ranges else placed.repartitionByRange(group, order)
    placed = checkpointed(placed.withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy("_range", group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.where(F.col(name).isNotNull()).groupBy("_range").agg(F.max_by(F.struct(F.col(group).alias("group"), F.col(name).alias("value")), F.struct(F.col(group), F.col(order))).alias("end"))
    ends = placed.select("_range").distinct().join(ends, "_range", "left")  # a row for each range
    before = ends.select("_range", F.last("end", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    taken = F.when(F.col("_before.group").eqNullSafe(F.col(group)), F.col("_before.value"))
    carried = placed.withColumn(name, F.last(name, ignorenulls=True).over(here)).join(F.broadcast(before), "_range", "left")
    return carried.withColumn(name, F.coalesce(name, taken)).select(*rows.columns, name)


def first_of_group(rows: DataFrame, group: str, most: int, *order: Column | str) -> DataFrame:
    """The first ``most`` rows of each group in ``order``; Spark keeps no more than these of a group in any task before the shuffle and after it."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")
