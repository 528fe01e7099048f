"""Chunks of all documents by each strategy, near-duplicate questions, windows of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from lekhya.operators import chunking, neardup
from lekhya.operators.registry import query
from lekhya.operators.text_queries import CLEAN, WS, terms


def of(t, strategy: str):
    return chunking.chunked(t("documents"), "doc_id", "text", strategy)


@query()
def chunk_recursive(t):
    return of(t, "recursive")


@query()
def chunk_semantic(t):
    return of(t, "semantic")


@query()
def chunk_hybrid(t):
    return of(t, "hybrid")


@query(f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS chunk_no, part AS text, CAST(length(part) AS BIGINT) AS n_chars FROM (
  SELECT doc_id, i, regexp_replace(parts[i], '^{WS}+|{WS}+$', '', 'g') AS part FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
      SELECT doc_id, string_split(regexp_replace({CLEAN}, '(?m)^((?:दफा\\s*)?[०-९0-9]+[क-हA-Za-z]?[.)])', chr(30) || '\\1', 'g'), chr(30)) AS parts FROM documents))) WHERE part <> ''""".replace("\\\\", "\\"))
def chunk_section(t):
    return of(t, "section").select("doc_id", "chunk_no", "text", "n_chars")


@query()
def chunk_strategy_stats(t):
    """Number, mean, least and greatest length and merged share per strategy."""
    every = reduce(lambda a, b: a.unionByName(b), (of(t, s).withColumn("strategy", F.lit(s)) for s in chunking.STRATEGIES))
    return every.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_chunks"), F.bround(F.avg("n_chars"), 2).alias("avg_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.bround(100.0 * F.count_if("is_merged") / F.count(F.lit(1)), 2).alias("merged_share"))


_Q = f"(SELECT id, words, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS grams, array_to_string(words, ' ') AS norm FROM (SELECT DISTINCT id, {terms('question')} AS words FROM eval_items))"


@query(f"""
WITH q AS {_Q}, r AS (SELECT norm, min(id) AS class_id, count(*) AS n_copies, any_value(grams) AS grams FROM q WHERE norm <> '' GROUP BY norm),
l AS (SELECT a.norm, count(*) AS n FROM r a JOIN r b ON a.norm <> b.norm AND len(list_intersect(a.grams, b.grams)) >= 0.8 * len(list_distinct(list_concat(a.grams, b.grams))) GROUP BY a.norm)
SELECT q.id, coalesce(r.class_id, q.id) AS class_id, coalesce(r.n_copies, 1) AS n_copies, coalesce(l.n, 0) AS n_links FROM q LEFT JOIN r USING (norm) LEFT JOIN l USING (norm)""")
def near_duplicate_questions(t):
    """Each item's class of equal questions and the number of other texts that share four fifths of its five-word shingles."""
    return neardup.classes(t("eval_items").select("id", "question").distinct(), "id", "question")


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS n_users, max(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY 1, 2""")
def event_windows(t):
    """Hourly tumbling windows of the events, the batch twin of the streaming aggregation."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    found = t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("n_users"), F.max(k).alias("max_k"))
    return found.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "n_users", "max_k")
