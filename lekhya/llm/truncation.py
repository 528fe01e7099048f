"""Problem 1: texts cut off before they were finished.

Method: a stack automaton over each text's structural characters (unclosed quotes, brackets and markup, broken
multibyte sequences and escapes) and missing terminators against the baseline of each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.llm.terminals import judged, text_end, word_ends
from lekhya.sources import table


def ends(rows: DataFrame, text: str, keys: list[str], baseline: list[str]) -> DataFrame:
    """Each row's ``keys``, ``baseline`` columns, end state and ``is_cut``.

    Null, empty and blank texts are state ``empty`` and not cut. Repeated rows are judged alike, each on its own row.
    Other columns are dropped, so extra columns can't clash. Texts of any length are read whole.
    """
    own = rows.select(*dict.fromkeys([*keys, *baseline]), F.col(text).alias("__text"))
    stated = own.withColumn("__end", text_end(F.col("__text"))).select("*", "__end.*").withColumn("n_chars", F.length("__text")).drop("__text", "__end")
    return judged(stated, word_ends(own, "__text"), baseline)


def reasonings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = None
    for name in ("correctness_results", "groundedness_results"):
        one = table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), "result_id", "export_source", "reasoning")
        both = one if both is None else both.unionByName(one)
    return both


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    judgedrows = ends(reasonings(spark, sf_dir), "reasoning", ["table_name", "result_id"], ["table_name", "export_source"])
    return judgedrows.filter("is_cut").select("table_name", "result_id")


def p1_truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table and export_source: rows, cut rows, their share, and how the cut ones end."""
    judgedrows = ends(reasonings(spark, sf_dir), "reasoning", ["table_name", "result_id"], ["table_name", "export_source"])
    counts = {f"n_{s}": F.count_if(F.col("is_cut") & (F.col("state") == s)) for s in ("broken", "ellipsis", "open", "bare")}
    return judgedrows.groupBy("table_name", "export_source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("is_cut").alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("int")), 6).alias("cut_share"), *(c.alias(k) for k, c in counts.items())
    )
