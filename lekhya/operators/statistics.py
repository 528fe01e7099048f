"""Paired statistics: mean differences, rank sums, exact and approximate p-values, Holm, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Non-zero pairs up to which the null distribution is exact.
EXACT = 50
SEED, RESAMPLES = 17, 1000


def differences(scores: DataFrame, chosen: str) -> DataFrame:
    """(baseline, id, diff): score of ``chosen`` minus that of each other strategy on the same id; ``scores`` (id, strategy, score) has one row per pair."""
    rows = scores.filter("score is not null").select("id", "strategy", "score")
    mine = rows.filter(F.col("strategy") == chosen).select("id", F.col("score").alias("__c"))
    return rows.filter(F.col("strategy") != chosen).join(mine, "id").select(F.col("strategy").alias("baseline"), "id", F.round(F.col("__c") - F.col("score"), 9).alias("diff"))


def rank_sums(diffs: DataFrame) -> DataFrame:
    """Per baseline: pairs, mean difference, wins, losses, sums of average ranks of both signs, ties' cubes, rank-biserial. Zero differences rank nowhere.

    Ranks come from counts of each absolute difference, so a window sees a row per distinct value, not per pair.
    """
    counts = diffs.groupBy("baseline", F.abs("diff").alias("size")).agg(F.count_if(F.col("diff") > 0).alias("pos"), F.count_if(F.col("diff") < 0).alias("neg"), F.count(F.lit(1)).alias("n"), F.sum("diff").alias("total"))
    below = Window.partitionBy("baseline").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    live = F.when(F.col("size") > 0, F.col("n")).otherwise(0)
    ranked = counts.withColumn("__m", live).withColumn("rank", F.coalesce(F.sum("__m").over(below), F.lit(0)) + (F.col("__m") + 1) / 2)
    sums = ranked.groupBy("baseline").agg(
        F.sum("n").alias("n_pairs"), (F.sum("total") / F.sum("n")).alias("mean_diff"), F.sum("pos").alias("wins"), F.sum("neg").alias("losses"), F.sum(F.col("pos") * F.col("rank")).alias("r_plus"), F.sum(F.col("neg") * F.col("rank")).alias("r_minus"), F.sum(F.col("__m") * F.col("__m") * F.col("__m") - F.col("__m")).alias("tie_cubes")
    )
    whole = F.col("r_plus") + F.col("r_minus")
    return sums.withColumn("rank_biserial", F.when(whole > 0, (F.col("r_plus") - F.col("r_minus")) / whole))


def signed_rank_p(n: int, r_plus: float, r_minus: float, tie_cubes: float) -> float:
    """Two-sided p of the signed-rank test: the untied exact null up to EXACT pairs, a half statistic rounded up, else the normal approximation with the tied variance."""
    if n == 0:
        return 1.0
    w = min(r_plus, r_minus)
    if n <= EXACT:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return min(1.0, 2.0 * float(ways[: math.ceil(w) + 1].sum()) / 2.0**n)
    variance = n * (n + 1) * (2 * n + 1) / 24 - tie_cubes / 48
    return min(1.0, math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * variance)))


@F.pandas_udf(T.DoubleType())
def p_value(n: pd.Series, plus: pd.Series, minus: pd.Series, cubes: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(n, plus, minus, cubes)])


def holm(rows: DataFrame, p: str, family: list[str]) -> DataFrame:
    """``rows`` with ``p_holm``: step-down adjusted within each family, a running maximum, at most 1."""
    order = Window.partitionBy(*family).orderBy(p, *[c for c in rows.columns if c not in family and c != p][:1])
    n = F.count(F.lit(1)).over(Window.partitionBy(*family))
    stepped = rows.withColumn("__s", (n - F.row_number().over(order) + 1) * F.col(p))
    return stepped.withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


#: Pairs drawn for at a time.
PAIRS = 2048
#: Chances that a pair comes at most 0, 1, 2, ... times, for 64-bit draws.
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]) * 2.0**64).clip(0, 2.0**64 - 2048).astype(np.uint64)


def multiplicities(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """How often each pair (a 64-bit hash) comes in each resample: Poisson draws of mean 1 by a mix of the hash and the resample's number."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.int64).view(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, x ^ (x >> np.uint64(31)), side="right").astype(np.float64)


def bootstrap(diffs: DataFrame, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(baseline, low, high): percentile interval of 95 % of the mean difference.

    Poisson resampling: every pair draws its multiplicity in every resample from a hash of its id and the resample's
    number, a block of pairs at once, so a resample needs no shuffle of pairs; partial sums per resample are all that
    moves. Same ids, same seed, same interval.
    """

    def draw(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for baseline, own in batch.groupby("baseline"):
                held = sums.setdefault(baseline, np.zeros((2, resamples)))
                for i in range(0, len(own), PAIRS):
                    k = multiplicities(own["h"].to_numpy()[i : i + PAIRS], resamples)
                    held += np.stack([own["diff"].to_numpy()[i : i + PAIRS] @ k, k.sum(axis=0)])
        for baseline, (total, n) in sums.items():
            yield pd.DataFrame({"baseline": baseline, "resample": np.arange(resamples), "total": total, "n": n})

    part = diffs.select("baseline", "diff", F.xxhash64("id", "baseline", F.lit(seed)).alias("h")).mapInPandas(draw, "baseline string, resample long, total double, n double")
    means = part.groupBy("baseline", "resample").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").withColumn("mean", F.col("total") / F.col("n"))
    return means.groupBy("baseline").agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
