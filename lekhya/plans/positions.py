"""Distributed numbering: consecutive positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.plans.lineage import cut


def positions(df: DataFrame, group: list[str], order: list[Column], salt: list[str], buckets: int = 64, name: str = "position") -> DataFrame:
    """Number the rows of each ``group`` 0, 1, 2, ... in ``name`` without putting a group into one task.

    A group is split into ``buckets`` salted parts by a hash of the columns ``salt``; rows are numbered inside a part
    by ``order`` and shifted by the sizes of the parts before it, of which there are at most ``buckets`` a group. The
    numbering is a function of the rows alone, so a recomputed task gives the same numbers. Rows with null groups form
    a group of their own; exact repeats get different numbers in arbitrary order.
    """
    salted = df.withColumn("__bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int"))
    keys = [*group, "__bucket"]
    sizes = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*(F.col(k).alias(f"__s_{k}") for k in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    ranked = salted.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    match = [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]
    joined = ranked.join(shifts, match, "left")
    return joined.withColumn(name, (F.col("__row") + F.col("__shift")).cast("long")).drop("__bucket", "__row", "__shift", *(f"__s_{k}" for k in keys))


def ordered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number all rows 0, 1, 2, ... by ``order`` in ``name``: a range-partitioned sort, then each partition shifted by the sizes of those before it.

    The sorted rows are written once, so that row numbers and shifts see the same partitions; partition sizes (one row
    per partition) are collected.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("__part", F.shiftright("__id", 33)))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect())
    shifts, total = [], 0
    for part, n in sizes:
        shifts.append((part, total))
        total += n
    held = df.sparkSession.createDataFrame(shifts, "__part long, __shift long")
    row = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(held), "__part").withColumn(name, row + F.col("__shift")).drop("__id", "__part", "__shift")
