"""Paired statistics of one export against the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekhya.operators import statistics
from lekhya.operators.registry import query
from lekhya.operators.summary_queries import LATEST, latest

CHOSEN = "chunk_hybrid"
DIFFS = f"(SELECT b.export_source AS baseline, b.question_id AS id, round(c.score - b.score, 9) AS diff FROM {LATEST.format('correctness_results')} b JOIN {LATEST.format('correctness_results')} c ON b.question_id = c.question_id AND c.export_source = '{CHOSEN}' WHERE b.export_source <> '{CHOSEN}' AND b.score IS NOT NULL AND c.score IS NOT NULL)"


def diffs(t):
    scores = latest(t, "correctness_results").select(F.col("question_id").alias("id"), F.col("export_source").alias("strategy"), "score")
    return statistics.differences(scores, CHOSEN)


@query(f"SELECT baseline, count(*) AS n_pairs, round(avg(diff), 6) AS mean_diff, count(*) FILTER (WHERE diff > 0) AS wins, count(*) FILTER (WHERE diff < 0) AS losses FROM {DIFFS} GROUP BY baseline")
def paired_diff(t):
    return statistics.rank_sums(diffs(t)).select("baseline", "n_pairs", F.round("mean_diff", 6).alias("mean_diff"), "wins", "losses")


@query(f"""
SELECT baseline, sum(rank) FILTER (WHERE diff > 0) AS r_plus, sum(rank) FILTER (WHERE diff < 0) AS r_minus, round((sum(rank) FILTER (WHERE diff > 0) - sum(rank) FILTER (WHERE diff < 0)) / sum(rank), 6) AS rank_biserial FROM (
  SELECT baseline, diff, rank() OVER (PARTITION BY baseline ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY baseline, abs(diff)) - 1) / 2 AS rank FROM {DIFFS} WHERE diff <> 0) GROUP BY baseline""")
def rank_biserial(t):
    nz = lambda c: F.when(F.col(c) > 0, F.col(c)).alias(c)
    found = statistics.rank_sums(diffs(t)).filter(F.col("wins") + F.col("losses") > 0)
    both = (F.col("wins") > 0) & (F.col("losses") > 0)
    return found.select("baseline", nz("r_plus"), nz("r_minus"), F.when(both, F.round("rank_biserial", 6)).alias("rank_biserial"))


# exact counts of rank sums up to 50 pairs, else the normal approximation with the error function as a series
@query(f"""
WITH RECURSIVE d AS {DIFFS}, ranked AS (SELECT baseline, diff, rank() OVER (PARTITION BY baseline ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY baseline, abs(diff)) - 1) / 2 AS rank FROM d WHERE diff <> 0),
cubes AS (SELECT baseline, sum(m * m * m - m) AS c FROM (SELECT baseline, abs(diff) AS a, count(*) AS m FROM d WHERE diff <> 0 GROUP BY baseline, a) GROUP BY baseline),
sums AS (SELECT baseline, count(*) AS n, coalesce(sum(rank) FILTER (WHERE diff > 0), 0) AS plus, coalesce(sum(rank) FILTER (WHERE diff < 0), 0) AS minus FROM ranked GROUP BY baseline),
t AS (SELECT b.baseline, b.n_pairs, b.mean_diff, coalesce(n, 0) AS n, least(plus, minus) AS w, n * (n + 1) * (2 * n + 1) / 24 - c / 48 AS variance FROM (SELECT baseline, count(*) AS n_pairs, round(avg(diff), 6) AS mean_diff FROM d GROUP BY baseline) b LEFT JOIN sums USING (baseline) LEFT JOIN cubes USING (baseline)),
ways AS (SELECT baseline, 0 AS r, n, list_transform(range(0, n * (n + 1) // 2 + 1), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ways FROM t WHERE n BETWEEN 1 AND 50
  UNION ALL SELECT baseline, r + 1, n, list_transform(range(1, len(ways) + 1), lambda i: ways[i] + CASE WHEN i > r + 1 THEN ways[i - r - 1] ELSE 0.0::DOUBLE END) FROM ways WHERE r < n),
series AS (SELECT baseline, 0 AS k, x, x AS term, x AS total FROM (SELECT baseline, abs(w - n * (n + 1) / 4) / sqrt(2 * variance) AS x FROM t WHERE n > 50) UNION ALL SELECT baseline, k + 1, x, term * 2 * x * x / (2 * k + 3), total + term * 2 * x * x / (2 * k + 3) FROM series WHERE k < 300),
p AS (SELECT t.baseline, n_pairs, mean_diff, CASE WHEN t.n = 0 THEN 1.0 WHEN t.n <= 50 THEN least(1.0, 2 * list_sum(ways.ways[1:CAST(ceil(t.w) AS INTEGER) + 1]) / pow(2.0, t.n)) ELSE least(1.0, greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-x * x) * total)) END AS p FROM t LEFT JOIN ways ON ways.baseline = t.baseline AND ways.r = t.n LEFT JOIN series s ON s.baseline = t.baseline AND s.k = 300)
SELECT 'correctness' AS metric, baseline, n_pairs, mean_diff, round(p, 6) AS p, round(least(1.0, max(stepped) OVER (ORDER BY p, baseline ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, baseline) + 1) * p AS stepped FROM p)""")
def wilcoxon_holm(t):
    """p-values of the signed-rank test with Holm's adjustment over the baselines."""
    rows = statistics.rank_sums(diffs(t)).withColumn("p", statistics.p_value(F.col("wins") + F.col("losses"), "r_plus", "r_minus", "tie_cubes")).withColumn("metric", F.lit("correctness"))
    adjusted = statistics.holm(rows.select("metric", "baseline", "n_pairs", F.round("mean_diff", 6).alias("mean_diff"), "p"), "p", ["metric"])
    return adjusted.select("metric", "baseline", "n_pairs", "mean_diff", F.round("p", 6).alias("p"), F.round("p_holm", 6).alias("p_holm"))


@query()
def bootstrap_ci(t):
    return statistics.bootstrap(diffs(t))
