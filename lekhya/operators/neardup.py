"""Near-duplicate texts: exact set-similarity join on word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.functions import text as tx

WORDS, SIMILARITY = 5, 0.8
#: Texts from which a shingle is dealt to several tasks, and how many.
HOT, SALTS = 1000, 16


def shingles(words: Column, n: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the runs of n words; a shorter text is one run, an empty one none."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(n)), " ")))
    return F.when(F.size(words) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def classes(rows: DataFrame, key: str, text: str, threshold: float = SIMILARITY) -> DataFrame:
    """(key, class_id, n_copies, n_links) per row: the smallest key with the same words, how many rows have them, and how many different texts are at least ``threshold`` similar by Jaccard.

    Equal texts are compared once. Of each text's shingles only the size - ceil(threshold size) + 1 rarest can be the
    first ones a similar text shares, so only these are joined, and no link is lost. Texts without words are a class
    of their own.
    """
    told = rows.select(key, tx.terms(F.col(text)).alias("__w")).select(key, F.array_join("__w", " ").alias("__norm"), shingles(F.col("__w")).alias("__g"))
    reps = told.filter("__norm <> ''").groupBy("__norm").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("n_copies"), F.first("__g").alias("__g"))
    each = reps.select("class_id", F.size("__g").alias("__m"), F.explode("__g").alias("gram"))
    df = each.groupBy("gram").agg(F.count(F.lit(1)).alias("__df")).filter("__df > 1")
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy(F.coalesce("__df", F.lit(1)), "gram"))
    prefix = each.join(df, "gram", "left").withColumn("__n", nth).filter((F.col("__n") <= F.col("__m") - F.ceil(F.col("__m") * threshold) + 1) & F.col("__df").isNotNull()).select("gram", "class_id", "__m", "__df")
    # a gram of many texts is dealt to SALTS parts on one side and stands in all of them on the other
    hot = F.col("__df") > HOT
    one = prefix.select("gram", F.when(hot, F.pmod(F.xxhash64("class_id"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt"), F.col("class_id").alias("a"), F.col("__m").alias("ma"))
    other = prefix.select("gram", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"), F.col("class_id").alias("b"), F.col("__m").alias("mb"))
    fit = (F.col("ma") >= threshold * F.col("mb")) & (F.col("mb") >= threshold * F.col("ma"))  # texts too unlike in size can't be similar
    pairs = one.join(other, ["gram", "salt"]).filter((F.col("a") < F.col("b")) & fit).select("a", "b").distinct()
    grams = reps.select("class_id", "__g")
    full = pairs.join(grams.select(F.col("class_id").alias("a"), F.col("__g").alias("ga")), "a").join(grams.select(F.col("class_id").alias("b"), F.col("__g").alias("gb")), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    near = full.filter(common >= threshold * (F.size("ga") + F.size("gb") - common))
    links = near.select(F.col("a").alias("class_id")).unionByName(near.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    joined = told.select(key, "__norm").join(reps.select("__norm", "class_id", "n_copies"), "__norm", "left").join(links, "class_id", "left")
    return joined.select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
