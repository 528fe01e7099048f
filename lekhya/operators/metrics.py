"""Retrieval metrics per question and their averages by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.functions import text as tx

NAMES = ["hit1", "hitk", "precisionk", "recallk", "mrrk", "completek"]


def split_label(c: Column) -> Column:
    """The split as written, ``unassigned`` for null and empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unassigned"))


def required_source(items: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, required): the source key an item requires, ``source`` of the item first and else that of its metadata by display name; none for ``both``, blanks and unknown names."""
    names = registry.groupBy(F.col("act_name").alias("__named")).agg(F.min("source").alias("__key"))
    own = items.select("id", F.nullif("source", F.lit("")).alias("__own"), F.col("metadata.source").alias("__named")).distinct().join(names, "__named", "left")
    told = F.coalesce("__own", "__key")
    return own.select("id", F.when(told != "both", told).alias("required")).distinct()


def qualified(items: DataFrame) -> DataFrame:
    """(id, source, number): the sections an item asks for with their sources."""
    listed = items.select("id", F.explode("required_sections").alias("s")).filter("coalesce(s.source, '') <> '' and coalesce(s.dafa, '') <> ''")
    return listed.select("id", "s.source", tx.section_number(F.col("s.dafa")).alias("number")).distinct()


def targets(items: DataFrame, required: DataFrame) -> DataFrame:
    """(id, source, number) each item asks for: its qualified sections, or, when it has none, its bare labels with the source it requires, null where it requires none. Out-of-scope items ask for nothing."""
    out = (F.coalesce("category", F.lit("")) == "out_of_scope") | (F.coalesce("answerability", F.lit("")) == "out_of_scope")
    asking = items.filter(~out)
    exact = qualified(asking)
    bare = asking.select("id", F.explode("required_dafas").alias("d")).filter("coalesce(d, '') <> ''").select("id", tx.section_number(F.col("d")).alias("number")).distinct()
    bare = bare.join(exact.select("id").distinct(), "id", "left_anti").join(required.select("id", F.col("required").alias("source")), "id", "left")
    return exact.unionByName(bare)


def per_question(items: DataFrame, wanted: DataFrame, retrieved: DataFrame) -> DataFrame:
    """hit1, hitk, precisionk, recallk, mrrk and completek of every item, rounded half-even to four digits.

    ``wanted`` (id, source, number), a null source accepting any, another only itself; ``retrieved`` (id, rank, source, number), one row
    per section of a result, already cut at k. Items without targets have nulls and ``skipped``; items with targets
    but without results have zeros. Precision divides by the results returned; recall counts distinct targets.
    """
    n_targets = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("n_targets"))
    met = retrieved.withColumnRenamed("source", "have").join(wanted, ["id", "number"]).filter(F.col("source").isNull() | (F.col("source") == F.col("have")))
    covered = met.groupBy("id").agg(F.count_distinct("number", F.coalesce("source", F.lit(""))).alias("n_covered"), F.min("rank").alias("first"), F.count_distinct("rank").alias("n_matching"))
    returned = retrieved.groupBy("id").agg(F.count_distinct("rank").alias("n_returned"), F.min("rank").alias("top"))
    joined = items.join(n_targets, "id", "left").join(covered, "id", "left").join(returned, "id", "left")
    asked = F.col("n_targets").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    told = lambda c: F.when(asked, tx.rounded(c))
    return joined.select(
        *items.columns,
        told(F.when(F.col("first") == F.col("top"), 1.0).otherwise(0.0)).alias("hit1"),
        told(F.when(zero("n_matching") > 0, 1.0).otherwise(0.0)).alias("hitk"),
        told(F.when(zero("n_returned") > 0, zero("n_matching") / zero("n_returned")).otherwise(0.0)).alias("precisionk"),
        told(zero("n_covered") / F.col("n_targets")).alias("recallk"),
        told(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrrk"),
        told(F.when(zero("n_covered") == F.col("n_targets"), 1.0).otherwise(0.0)).alias("completek"),
        (~asked).alias("skipped"),
    )


def by_scope(rows: DataFrame, scope: str, measures: dict[str, Column], all_name: str = "combined") -> DataFrame:
    """``measures`` for each value of ``scope`` and for all rows, in one pass of grouping sets."""
    grouped = rows.withColumn("__scope", F.col(scope)).rollup("__scope").agg(F.grouping("__scope").alias("__all"), *(c.alias(k) for k, c in measures.items()))
    return grouped.select(F.when(F.col("__all") == 1, F.lit(all_name)).otherwise(F.col("__scope")).alias("scope"), *measures)


def mean(c: str) -> Column:
    return tx.rounded(F.avg(c))


def primary(scoped: DataFrame) -> DataFrame:
    """The ``test`` scope if it has evaluated rows, else ``combined``."""
    has_test = F.max((F.col("scope") == "test") & (F.col("n_evaluated") > 0)).over(Window.partitionBy())  # a handful of scopes
    return scoped.withColumn("__test", has_test).filter(F.col("scope") == F.when(F.col("__test"), "test").otherwise("combined")).drop("__test")
