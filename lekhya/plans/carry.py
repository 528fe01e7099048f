"""Looking back along an order within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order values of a block; a group is looked through block by block, never as a whole.
WIDTH = 10_000


def looked_back(df: DataFrame, group: str, order: str, previous: dict[str, str] | None = None, known: dict[str, str] | None = None, width: int = WIDTH) -> DataFrame:
    """``df`` with, per group in ``order`` (an integer, unique in its group): ``previous`` {name: column}, the value one row before, and ``known`` {name: column}, the last value so far that isn't null.

    A window runs over blocks of ``width`` order values; what a block hands on is one row per block, aggregated in
    each task and carried over in a window of blocks, of which a group has its order span over ``width``. Null groups
    are one group. The first row of a group has null as previous value.
    """
    previous, known = previous or {}, known or {}
    blocked = df.withColumn("__b", F.floor(F.col(order) / width))
    inner = Window.partitionBy(group, "__b").orderBy(order)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    at = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in known.values()}
    # a struct around a value keeps a null of the last row
    handed = blocked.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__gb")).agg(
        *(F.max_by(F.struct(c), order)[c].alias(f"__p_{n}") for n, c in previous.items()), *(F.max_by(c, at[c]).alias(f"__k_{n}") for n, c in known.items()), F.count(F.lit(1)).alias("__n")
    )
    blocks = Window.partitionBy("__g").orderBy("__gb")
    carried = handed.select(
        "__g", "__gb", *(F.lag(f"__p_{n}").over(blocks).alias(f"__c_{n}") for n in previous), *(F.last(f"__k_{n}", ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__c_{n}") for n in known)
    )
    own = blocked.withColumn("__first", F.row_number().over(inner) == 1)
    for n, c in previous.items():
        own = own.withColumn(f"__i_{n}", F.lag(c).over(inner))
    for n, c in known.items():
        own = own.withColumn(f"__i_{n}", F.last(c, ignorenulls=True).over(so_far))
    joined = own.join(carried, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__gb")))
    told = {n: F.when(F.col("__first"), F.col(f"__c_{n}")).otherwise(F.col(f"__i_{n}")) for n in previous} | {n: F.coalesce(f"__i_{n}", f"__c_{n}") for n in known}
    return joined.select(*(F.col(c) for c in df.columns if c not in told), *(c.alias(n) for n, c in told.items()))
