"""Metrics of the stored search results against the sections each item asks for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekhya.functions import text as tx
from lekhya.operators import metrics
from lekhya.operators.registry import query
from lekhya.operators.text_queries import number

BASE = "(SELECT DISTINCT id, coalesce(nullif(split, ''), 'unassigned') AS split FROM eval_items)"
# written from the reference: source of the item, else the key of its metadata's display name; 'both', blank and unknown require none
REQUIRED = "(SELECT DISTINCT id, CASE WHEN coalesce(source, '') <> '' THEN nullif(source, 'both') ELSE (SELECT min(r.source) FROM corpus_registry r WHERE r.act_name = e.metadata.source) END AS required FROM eval_items e)"
ASKING = "(SELECT * FROM eval_items WHERE category IS DISTINCT FROM 'out_of_scope' AND answerability IS DISTINCT FROM 'out_of_scope')"
QUALIFIED = f"(SELECT DISTINCT id, s.source AS source, {number('s.dafa')} AS number FROM (SELECT id, unnest(required_sections) AS s FROM {ASKING}) WHERE coalesce(s.source, '') <> '' AND coalesce(s.dafa, '') <> '')"
WANTED = f"(SELECT * FROM {QUALIFIED} UNION ALL SELECT b.id, q.required AS source, b.number FROM (SELECT DISTINCT id, {number('d')} AS number FROM (SELECT id, unnest(required_dafas) AS d FROM {ASKING}) WHERE coalesce(d, '') <> '') b JOIN {REQUIRED} q USING (id) WHERE b.id NOT IN (SELECT id FROM {QUALIFIED}))"
LISTED = "(SELECT question_id, rank, chunk_id, dafa, metadata.source AS source FROM (SELECT *, row_number() OVER (PARTITION BY question_id, rank ORDER BY search_id) AS n FROM search_results WHERE rank <= 5) WHERE n = 1)"
RETRIEVED = f"(SELECT DISTINCT id, rank, source, {number('coalesce(d, chr(32))')} AS number FROM (SELECT r.question_id AS id, r.rank, coalesce(r.source, c.source) AS source, unnest(CASE WHEN len(c.dafa_list) > 0 THEN c.dafa_list ELSE [r.dafa] END) AS d FROM {LISTED} r LEFT JOIN chunks c USING (chunk_id)))"
PER_QUESTION = f"""
wanted AS {WANTED}, retrieved AS {RETRIEVED}, nt AS (SELECT id, count(*) AS n_targets FROM wanted GROUP BY id),
met AS (SELECT r.id, r.rank, w.number, w.source FROM retrieved r JOIN wanted w ON r.id = w.id AND r.number = w.number AND (w.source IS NULL OR w.source = r.source)),
cov AS (SELECT id, count(DISTINCT (number, coalesce(source, ''))) AS nc, min(rank) AS first, count(DISTINCT rank) AS nm FROM met GROUP BY id), ret AS (SELECT id, count(DISTINCT rank) AS nr, min(rank) AS top FROM retrieved GROUP BY id),
pq AS (SELECT b.id, b.split, CASE WHEN nt.id IS NOT NULL THEN (coalesce(first = top, false))::INT::DOUBLE END AS hit1, CASE WHEN nt.id IS NOT NULL THEN (coalesce(nm, 0) > 0)::INT::DOUBLE END AS hitk,
  CASE WHEN nt.id IS NOT NULL THEN round_even(coalesce(nm / nr, 0.0), 4) END AS precisionk, CASE WHEN nt.id IS NOT NULL THEN round_even(coalesce(nc, 0) / n_targets, 4) END AS recallk,
  CASE WHEN nt.id IS NOT NULL THEN round_even(coalesce(1.0::DOUBLE / first, 0.0), 4) END AS mrrk, CASE WHEN nt.id IS NOT NULL THEN (coalesce(nc, 0) = n_targets)::INT::DOUBLE END AS completek, nt.id IS NULL AS skipped
  FROM {BASE} b LEFT JOIN nt USING (id) LEFT JOIN cov USING (id) LEFT JOIN ret USING (id))"""


def top_five(t):
    """One result of each question and rank up to five, the first loaded."""
    rows = t("search_results").filter("rank <= 5").select("question_id", "rank", "search_id", "chunk_id", "dafa", "metadata")
    return rows.groupBy("question_id", "rank").agg(F.min_by(F.struct("chunk_id", "dafa", "metadata"), "search_id").alias("r")).select("question_id", "rank", "r.*")


def questions_rated(t):
    items = t("eval_items").select("id", metrics.split_label(F.col("split")).alias("split")).distinct()
    listed = top_five(t)
    chunks = t("chunks").select("chunk_id", F.col("source").alias("chunk_source"), "dafa_list")
    labels = F.when(F.size("dafa_list") > 0, F.col("dafa_list")).otherwise(F.array("dafa"))
    each = listed.select("question_id", "rank", "chunk_id", "dafa", F.col("metadata.source").alias("own")).join(chunks, "chunk_id", "left")
    retrieved = each.select(F.col("question_id").alias("id"), "rank", F.coalesce("own", "chunk_source").alias("source"), F.explode(labels).alias("d")).select("id", "rank", "source", tx.section_number(F.coalesce("d", F.lit(" "))).alias("number")).distinct()
    return metrics.per_question(items, metrics.targets(t("eval_items"), metrics.required_source(t("eval_items"), t("corpus_registry"))), retrieved)


@query(f"WITH {PER_QUESTION} SELECT * FROM pq")
def retrieval_metrics(t):
    return questions_rated(t)


_MEANS = ", ".join(f"round_even(avg({c}), 4) AS {c}" for c in metrics.NAMES)
BY_SPLIT = f"(SELECT CASE WHEN grouping(split) = 1 THEN 'combined' ELSE split END AS scope, {_MEANS}, count(*) FILTER (WHERE NOT skipped) AS n_evaluated, count(*) FILTER (WHERE skipped) AS n_skipped FROM pq GROUP BY GROUPING SETS ((split), ()))"


def by_split(t):
    means = {c: metrics.mean(c) for c in metrics.NAMES} | {"n_evaluated": F.count_if(~F.col("skipped")), "n_skipped": F.count_if("skipped")}
    return metrics.by_scope(questions_rated(t), "split", means)


@query(f"WITH {PER_QUESTION} SELECT * FROM {BY_SPLIT} WHERE n_evaluated > 0")
def metrics_by_split(t):
    """Averages by split and over all; splits without an evaluated item don't appear."""
    return by_split(t).filter("n_evaluated > 0")


@query(f"WITH {PER_QUESTION}, s AS {BY_SPLIT} SELECT * FROM s WHERE scope = (SELECT CASE WHEN max((scope = 'test' AND n_evaluated > 0)::INT) = 1 THEN 'test' ELSE 'combined' END FROM s)")
def primary_split(t):
    return metrics.primary(by_split(t))


@query(f"WITH {PER_QUESTION} SELECT split, count(*) AS n_items, count(*) FILTER (WHERE skipped) AS n_skipped, count(*) FILTER (WHERE NOT skipped) AS n_evaluated FROM pq GROUP BY split")
def skipped_counts(t):
    return questions_rated(t).groupBy("split").agg(F.count(F.lit(1)).alias("n_items"), F.count_if("skipped").alias("n_skipped"), F.count_if(~F.col("skipped")).alias("n_evaluated"))


@query(f"WITH {PER_QUESTION}, m AS (SELECT r.metadata.retrieval_mode AS mode, pq.* FROM (SELECT DISTINCT question_id, metadata FROM search_results WHERE rank = 1) r JOIN pq ON pq.id = r.question_id) SELECT mode, {_MEANS}, count(*) AS n FROM (SELECT DISTINCT mode, {', '.join(['id', *metrics.NAMES])} FROM m) GROUP BY mode")
def cross_strategy_metrics(t):
    """Averages per retrieval mode of each question's first result."""
    moded = t("search_results").filter("rank = 1").select(F.col("question_id").alias("id"), F.col("metadata.retrieval_mode").alias("mode")).distinct()
    return moded.join(questions_rated(t), "id").groupBy("mode").agg(*(metrics.mean(c).alias(c) for c in metrics.NAMES), F.count(F.lit(1)).alias("n"))


@query(f"SELECT id, required AS required_source FROM {REQUIRED}")
def required_source(t):
    """The source key an item requires: the item's own, else that of its metadata's display name; none for ``both``, blanks and unknown names."""
    return metrics.required_source(t("eval_items"), t("corpus_registry")).withColumnRenamed("required", "required_source")


@query(f"""
WITH r AS {RETRIEVED}, q AS {QUALIFIED.replace(ASKING, 'eval_items')} SELECT m.id, array_to_string(list_sort(list(DISTINCT w.source || ' ' || w.number)), '|') AS covered FROM r m JOIN q w ON m.id = w.id AND m.number = w.number AND m.source = w.source GROUP BY m.id""")
def covered_targets(t):
    """The qualified targets that some result of the question covers."""
    listed = top_five(t)
    chunks = t("chunks").select("chunk_id", F.col("source").alias("chunk_source"), "dafa_list")
    labels = F.when(F.size("dafa_list") > 0, F.col("dafa_list")).otherwise(F.array("dafa"))
    have = listed.select(F.col("question_id").alias("id"), "chunk_id", "dafa", F.col("metadata.source").alias("own")).join(chunks, "chunk_id", "left").select("id", F.coalesce("own", "chunk_source").alias("source"), F.explode(labels).alias("d"))
    numbered = have.select("id", "source", tx.section_number(F.coalesce("d", F.lit(" "))).alias("number")).distinct()
    met = numbered.join(metrics.qualified(t("eval_items")), ["id", "source", "number"])
    return met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("source", F.lit(" "), "number"))), "|").alias("covered"))
