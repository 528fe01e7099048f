"""Summaries of judged answers, context assembly, profiles of the benchmark, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lekhya.functions import text as tx
from lekhya.operators import metrics
from lekhya.operators.metric_queries import BASE
from lekhya.operators.registry import query
from lekhya.operators.retrieval_queries import QTERMS
from lekhya.operators import lexical
from lekhya.operators.text_queries import number, spaced, terms

FACTS = "(SELECT DISTINCT id, coalesce(nullif(split, ''), 'unassigned') AS split, coalesce(category, 'unknown') AS category, coalesce(difficulty, 'unknown') AS difficulty, coalesce(legal_domain, 'unknown') AS domain, answerability FROM eval_items)"
LATEST = "(SELECT question_id, export_source, result_id, score, generated_answer FROM (SELECT *, row_number() OVER (PARTITION BY question_id, export_source ORDER BY loaded_at DESC, result_id DESC) AS n FROM {}) WHERE n = 1)"


def facts(t):
    """One row per item with its reporting dimensions, ``unknown`` for nulls."""
    unknown = lambda c, name: F.coalesce(c, F.lit("unknown")).alias(name)
    return t("eval_items").select("id", metrics.split_label(F.col("split")).alias("split"), unknown("category", "category"), unknown("difficulty", "difficulty"), unknown("legal_domain", "domain"), "answerability").distinct()


def latest(t, name):
    """Judgements without reloads: the last loaded of each question and export, picked by an aggregate that combines in each task."""
    rows = t(name).select("question_id", "export_source", "result_id", "score", "loaded_at", "generated_answer")
    return rows.groupBy("question_id", "export_source").agg(F.max_by(F.struct("result_id", "score", "generated_answer"), F.struct("loaded_at", "result_id")).alias("r")).select("question_id", "export_source", "r.*")


def judged(t, name):
    return latest(t, name).join(facts(t), F.col("question_id") == F.col("id"), "left")


_J = lambda name: f"(SELECT * FROM {LATEST.format(name)} r LEFT JOIN {FACTS} f ON f.id = r.question_id)"
JC, JG = _J("correctness_results"), _J("groundedness_results")


@query(f"SELECT CASE WHEN grouping(split) = 1 THEN 'combined' ELSE split END AS scope, round_even(avg(score), 4) AS average_score, count(score) AS n_evaluated FROM {JC} WHERE score IS NOT NULL GROUP BY GROUPING SETS ((split), ())")
def answer_scores_by_split(t):
    return metrics.by_scope(judged(t, "correctness_results").filter("score is not null"), "split", {"average_score": metrics.mean("score"), "n_evaluated": F.count("score")})


@query(f"SELECT split, count(*) AS n FROM {BASE} GROUP BY split")
def split_census(t):
    return t("eval_items").select("id", metrics.split_label(F.col("split")).alias("split")).distinct().groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _sets(*columns: str) -> str:
    return ", ".join(f"({c})" for c in columns) + ", ()"


def scoped(rows, columns: list[str], measures: dict):
    """``measures`` by each column in turn and over all rows, long: (dimension, value, ...), by grouping sets."""
    grouped = rows.groupingSets([[F.col(c)] for c in columns] + [[]], *(F.col(c) for c in columns)).agg(F.grouping_id(*columns).alias("__g"), *(c.alias(k) for k, c in measures.items()))
    n = len(columns)
    level = {(2**n - 1) ^ (1 << (n - 1 - i)): c for i, c in enumerate(columns)}
    dimension = F.lit("all")
    value = F.lit("all")
    for g, c in level.items():
        dimension, value = F.when(F.col("__g") == g, c).otherwise(dimension), F.when(F.col("__g") == g, F.col(c)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), *measures)


def _dims(*columns: str) -> str:
    return "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in columns) + " ELSE 'all' END AS dimension, CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN {c}" for c in columns) + " ELSE 'all' END AS value"


@query(f"SELECT {_dims('difficulty', 'category')}, count(*) AS n, round_even(avg(score), 4) AS average_score FROM {JC} GROUP BY GROUPING SETS ({_sets('difficulty', 'category')})")
def correctness_summary(t):
    return scoped(judged(t, "correctness_results"), ["difficulty", "category"], {"n": F.count(F.lit(1)), "average_score": metrics.mean("score")})


@query(f"SELECT {_dims('category')}, count(*) AS n, round_even(avg(score), 4) AS average_score, count(*) FILTER (WHERE score < 0.6) AS n_risk FROM {JG} GROUP BY GROUPING SETS ({_sets('category')})")
def groundedness_summary(t):
    return scoped(judged(t, "groundedness_results"), ["category"], {"n": F.count(F.lit(1)), "average_score": metrics.mean("score"), "n_risk": F.count_if(F.col("score") < 0.6)})


@query(f"SELECT {_dims('domain', 'category')}, count(*) AS n, round_even(avg(score), 4) AS average_score, count(*) FILTER (WHERE score < 0.6) AS n_low FROM {JC} GROUP BY GROUPING SETS ({_sets('domain', 'category')})")
def score_by_domain(t):
    return scoped(judged(t, "correctness_results"), ["domain", "category"], {"n": F.count(F.lit(1)), "average_score": metrics.mean("score"), "n_low": F.count_if(F.col("score") < 0.6)})


_REL = "(SELECT r.question_id, count(*) AS n_returned, count(*) FILTER (WHERE list_contains(list_transform(e.required_sections, lambda x: x.source), r.metadata.source)) AS n_relevant, avg(r.score) AS score FROM search_results r JOIN (SELECT DISTINCT id, required_sections FROM eval_items) e ON e.id = r.question_id GROUP BY r.question_id)"


@query(f"SELECT {_dims('category')}, count(*) AS n, round_even(avg(n_relevant / n_returned), 4) AS relevant_ratio, round_even(avg((n_relevant > 0)::INT), 4) AS hit_rate, count(*) FILTER (WHERE q.score < 0.5) AS n_poor FROM {_REL} q JOIN {FACTS} f ON f.id = q.question_id GROUP BY GROUPING SETS ({_sets('category')})")
def retrieval_relevance_summary(t):
    """Results from a source the item asks for, as ratio, hit rate and by category; poor below a mean score of one half."""
    items = t("eval_items").select(F.col("id").alias("question_id"), "required_sections").distinct()
    relevant = F.coalesce(F.array_contains("required_sections.source", F.col("metadata.source")), F.lit(False))
    per = t("search_results").join(items, "question_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("n_returned"), F.count_if(relevant).alias("n_relevant"), F.avg("score").alias("score"))
    rows = per.join(facts(t), F.col("question_id") == F.col("id"))
    return scoped(rows, ["category"], {"n": F.count(F.lit(1)), "relevant_ratio": tx.rounded(F.avg(F.col("n_relevant") / F.col("n_returned"))), "hit_rate": tx.rounded(F.avg((F.col("n_relevant") > 0).cast("int"))), "n_poor": F.count_if(F.col("score") < 0.5)})


_MEANS = f"(SELECT export_source, 'correctness' AS metric, round_even(avg(score), 4) AS mean FROM {LATEST.format('correctness_results')} GROUP BY 1 UNION ALL SELECT export_source, 'groundedness', round_even(avg(score), 4) FROM {LATEST.format('groundedness_results')} GROUP BY 1)"


def metric_means(t):
    one = lambda name, metric: latest(t, name).groupBy("export_source").agg(metrics.mean("score").alias("mean")).withColumn("metric", F.lit(metric))
    return one("correctness_results", "correctness").unionByName(one("groundedness_results", "groundedness"))


@query(f"SELECT export_source, metric, mean FROM {_MEANS}")
def single_metric_means(t):
    return metric_means(t).select("export_source", "metric", "mean")


@query(f"""
SELECT export_source, overall, CASE WHEN overall >= 0.8 THEN 'excellent' WHEN overall >= 0.6 THEN 'good' WHEN overall >= 0.4 THEN 'fair' ELSE 'poor' END AS band, repeat('#', CAST(floor(overall * 20) AS INTEGER)) || repeat('.', 20 - CAST(floor(overall * 20) AS INTEGER)) AS bar
FROM (SELECT export_source, round_even(avg(mean), 6) AS overall FROM {_MEANS} GROUP BY export_source)""")
def quality_band(t):
    """Overall score, the mean of the available metric means, with its band and a bar of 20 cells."""
    overall = metric_means(t).groupBy("export_source").agg(F.bround(F.avg("mean"), 6).alias("overall"))
    band = F.when(F.col("overall") >= 0.8, "excellent").when(F.col("overall") >= 0.6, "good").when(F.col("overall") >= 0.4, "fair").otherwise("poor")
    cells = F.floor(F.col("overall") * 20).cast("int")
    return overall.select("export_source", "overall", band.alias("band"), F.concat(F.repeat(F.lit("#"), cells), F.repeat(F.lit("."), 20 - cells)).alias("bar"))


#: Metrics of a run report.
REPORTED = ("correctness", "groundedness", "relevance", "retrieval_relevance")


@query(f"SELECT export_source, max(mean) FILTER (WHERE metric = 'correctness') AS correctness, max(mean) FILTER (WHERE metric = 'groundedness') AS groundedness, max(mean) FILTER (WHERE metric = 'relevance') AS relevance, max(mean) FILTER (WHERE metric = 'retrieval_relevance') AS retrieval_relevance FROM {_MEANS} GROUP BY export_source")
def strategy_pivot(t, metrics=REPORTED):
    """Mean of each reported metric by export; null for a metric without results."""
    return metric_means(t).groupBy("export_source").pivot("metric", list(metrics)).agg(F.first("mean"))


@query(f"""SELECT export_source || repeat(' ', 18 - length(export_source)) || ' | ' || coalesce(printf('%.4f', max(mean) FILTER (WHERE metric = 'correctness')), '—') || ' | ' || coalesce(printf('%.4f', max(mean) FILTER (WHERE metric = 'groundedness')), '—') AS line FROM {_MEANS} GROUP BY export_source""")
def report_lines(t):
    """Fixed-width report lines, a dash for what is missing."""
    cell = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("—"))
    wide = strategy_pivot(t)
    return wide.select(F.concat(F.rpad("export_source", 18, " "), F.lit(" | "), F.when(F.col("correctness").isNull(), "—").otherwise(cell("correctness")), F.lit(" | "), F.when(F.col("groundedness").isNull(), "—").otherwise(cell("groundedness"))).alias("line"))


_PART = "'[' || array_to_string(list_filter([act_name, bhag, parichhed, 'दफा ' || coalesce(dafa, 'Unknown')], lambda x: coalesce(x, '') <> ''), ' | ') || ']' || chr(10) || string_agg(text, chr(10) ORDER BY rank, search_id)"


@query(f"""
SELECT question_id, string_agg(part, chr(10) || chr(10) ORDER BY coalesce(act_name, ''), coalesce(bhag, ''), coalesce(parichhed, ''), coalesce(dafa, '')) AS context, count(*) AS n_parts FROM (
  SELECT question_id, act_name, bhag, parichhed, dafa, {_PART} AS part FROM (SELECT search_id, question_id, rank, dafa, text, metadata.act_name AS act_name, metadata.bhag AS bhag, metadata.parichhed AS parichhed FROM search_results) GROUP BY question_id, act_name, bhag, parichhed, dafa) GROUP BY question_id""")
def context_assembly(t):
    """Results of each question grouped by act, part, chapter and section, headed, in key order."""
    keys = ["act_name", "bhag", "parichhed", "dafa"]
    rows = t("search_results").select("search_id", "question_id", "rank", "dafa", "text", "metadata.act_name", "metadata.bhag", "metadata.parichhed")
    parts = rows.groupBy("question_id", *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "search_id", "text"))), lambda x: x["text"]), "\n").alias("texts"))  # of one question
    head = F.array_join(F.filter(F.array(*keys[:3], F.concat(F.lit("दफा "), F.coalesce("dafa", F.lit("Unknown")))), lambda x: F.coalesce(x, F.lit("")) != ""), " | ")
    part = F.struct(*(F.coalesce(k, F.lit("")).alias(k) for k in keys), F.concat(F.lit("["), head, F.lit("]\n"), "texts").alias("part"))
    return parts.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_parts"))


_BUDGET = 2000


@query(f"""
SELECT question_id, CAST(count(*) FILTER (WHERE over = 0) AS BIGINT) AS n_kept, CAST(coalesce(sum(n) FILTER (WHERE over = 0), 0) AS BIGINT) AS n_chars, bool_or(over > 0) AS is_truncated FROM (
  SELECT question_id, n, max((total > {_BUDGET})::INT) OVER (PARTITION BY question_id ORDER BY rank, search_id ROWS UNBOUNDED PRECEDING) AS over FROM (
    SELECT question_id, rank, search_id, length(text) AS n, sum(length(text)) OVER (PARTITION BY question_id ORDER BY rank, search_id ROWS UNBOUNDED PRECEDING) AS total FROM search_results)) GROUP BY question_id""")
def context_budget(t):
    """The results taken in order until the next one would exceed the budget of characters."""
    w = Window.partitionBy("question_id").orderBy("rank", "search_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = t("search_results").select("question_id", "rank", "search_id", F.length("text").alias("n")).withColumn("total", F.sum("n").over(w)).withColumn("over", F.max((F.col("total") > _BUDGET).cast("int")).over(w))
    return rows.groupBy("question_id").agg(F.count_if(F.col("over") == 0).alias("n_kept"), F.coalesce(F.sum(F.when(F.col("over") == 0, F.col("n"))), F.lit(0)).cast("long").alias("n_chars"), F.bool_or(F.col("over") > 0).alias("is_truncated"))


_CENSUS = "(SELECT f.*, i.source FROM " + FACTS + " f JOIN (SELECT id, coalesce(min(source), 'unknown') AS source FROM eval_items GROUP BY id) i USING (id))"


@query(f"SELECT {_dims('category', 'domain', 'difficulty', 'source')}, count(*) AS n, round_even(100.0 * count(*) / (SELECT count(*) FROM {_CENSUS}), 1) AS percent FROM {_CENSUS} GROUP BY GROUPING SETS ({_sets('category', 'domain', 'difficulty', 'source')})")
def distribution_census(t):
    """Items and their percentage by category, domain, difficulty and source."""
    sources = t("eval_items").groupBy("id").agg(F.coalesce(F.min("source"), F.lit("unknown")).alias("source"))
    rows = facts(t).join(sources, "id")
    counted = scoped(rows, ["category", "domain", "difficulty", "source"], {"n": F.count(F.lit(1))})
    total = counted.filter("dimension = 'all'").select(F.col("n").alias("__all"))
    return counted.join(F.broadcast(total)).select("dimension", "value", "n", F.bround(100.0 * F.col("n") / F.col("__all"), 1).alias("percent"))


_LEVELS = ["easy", "medium", "hard", "unknown"]


def _matrix(rows: str, column: str, values: list[str]) -> str:
    return f"SELECT {rows}, " + ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS {v}" for v in values) + f", count(*) AS total FROM {FACTS} GROUP BY {rows}"


def matrix(t, rows: str, column: str, values: list[str]):
    """Counts of ``column`` values by ``rows`` with zeros, and row totals over all values."""
    return facts(t).groupBy(rows).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values), F.count(F.lit(1)).alias("total"))


@query(_matrix("domain", "difficulty", _LEVELS))
def domain_difficulty_matrix(t):
    return matrix(t, "domain", "difficulty", _LEVELS)


@query(_matrix("category", "difficulty", _LEVELS))
def category_difficulty_matrix(t):
    return matrix(t, "category", "difficulty", _LEVELS)


_DOMAINS = ["family", "contract", "property", "inheritance", "protection_order", "tort"]


@query(_matrix("category", "domain", _DOMAINS))
def category_domain_matrix(t):
    return matrix(t, "category", "domain", _DOMAINS)


@query("""
SELECT CAST(b AS BIGINT) AS n_sections, count(n) AS n_items, (SELECT round_even(avg(len(required_sections)), 4) FROM (SELECT DISTINCT id, required_sections FROM eval_items)) AS mean_sections
FROM (SELECT unnest(range(0, (SELECT max(len(required_sections)) FROM eval_items) + 1)) AS b) LEFT JOIN (SELECT DISTINCT id, len(required_sections) AS n FROM eval_items) ON n = b GROUP BY b""")
def zero_filled_histogram(t):
    """Items by the number of sections they ask for, with zeros up to the most, and the mean."""
    sizes = t("eval_items").select("id", F.size("required_sections").alias("n")).distinct()
    stats = sizes.agg(F.max("n").alias("most"), F.bround(F.avg("n"), 4).alias("mean_sections"))
    bins = stats.select(F.explode(F.sequence(F.lit(0), F.col("most"))).alias("b"), "mean_sections")
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("n_items"))
    return bins.join(counts, F.col("n") == F.col("b"), "left").select(F.col("b").cast("long").alias("n_sections"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "mean_sections")


_TARGETS = f"(SELECT DISTINCT id, s.source AS source, {number('s.dafa')} AS number FROM (SELECT id, unnest(required_sections) AS s FROM eval_items) WHERE s.source IS NOT NULL AND s.dafa IS NOT NULL)"


def qualified(t):
    each = t("eval_items").select("id", F.explode("required_sections").alias("s")).filter("s.source is not null and s.dafa is not null")
    return each.select("id", "s.source", tx.section_number(F.col("s.dafa")).alias("number")).distinct()


@query(f"""
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_items, count(*) - count(DISTINCT id) AS n_repeats, count(DISTINCT id) FILTER (WHERE answerability = 'answerable') AS n_answerable, count(DISTINCT id) FILTER (WHERE category = 'out_of_scope') AS n_out_of_scope,
  count(DISTINCT id) FILTER (WHERE len(required_sections) > 0) AS n_with_evidence, (SELECT count(DISTINCT (source, number)) FROM {_TARGETS}) AS n_targets, count(*) FILTER (WHERE trim(coalesce(question, '')) = '') AS n_blank_questions,
  count(DISTINCT id) FILTER (WHERE answerability = 'answerable' AND coalesce(len(required_sections), 0) = 0) AS n_warnings FROM eval_items""")
def dataset_audit(t):
    distinct = lambda c: F.count_distinct(F.when(c, F.col("id")))
    answerable, size = F.col("answerability") == "answerable", F.size("required_sections")
    counted = t("eval_items").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_items"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("n_repeats"), distinct(answerable).alias("n_answerable"), distinct(F.col("category") == "out_of_scope").alias("n_out_of_scope"),
        distinct(size > 0).alias("n_with_evidence"), F.count_if(F.trim(F.coalesce("question", F.lit(""))) == "").alias("n_blank_questions"), distinct(answerable & (F.coalesce(size, F.lit(0)) <= 0)).alias("n_warnings"),
    )
    return counted.join(qualified(t).agg(F.count_distinct("source", "number").alias("n_targets")))


_PROVISIONS = f"(SELECT DISTINCT source, {number('d')} AS number FROM (SELECT source, unnest(dafa_list) AS d FROM chunks) WHERE d IS NOT NULL)"


def provisions(t):
    return t("chunks").select("source", F.explode("dafa_list").alias("d")).filter("d is not null").select("source", tx.section_number(F.col("d")).alias("number")).distinct()


@query(f"SELECT source, number, count(DISTINCT id) AS n_questions, coalesce(array_to_string(list_sort(list(DISTINCT id) FILTER (WHERE id IS NOT NULL)), '|'), '') AS ids FROM {_PROVISIONS} LEFT JOIN {_TARGETS} USING (source, number) GROUP BY source, number")
def provision_coverage(t):
    joined = provisions(t).join(qualified(t), ["source", "number"], "left")
    return joined.groupBy("source", "number").agg(F.count_distinct("id").alias("n_questions"), F.array_join(F.array_sort(F.collect_set("id")), "|").alias("ids"))


@query(f"SELECT count(*) AS n_provisions, count(*) FILTER (WHERE n > 0) AS n_covered, count(*) FILTER (WHERE n = 0) AS n_uncovered, round_even(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 2) AS percent FROM (SELECT source, number, count(DISTINCT id) AS n FROM {_PROVISIONS} LEFT JOIN {_TARGETS} USING (source, number) GROUP BY source, number)")
def coverage_totals(t):
    per = provision_coverage(t)
    covered = F.col("n_questions") > 0
    return per.agg(F.count(F.lit(1)).alias("n_provisions"), F.count_if(covered).alias("n_covered"), F.count_if(~covered).alias("n_uncovered"), F.bround(100.0 * F.count_if(covered) / F.count(F.lit(1)), 2).alias("percent"))


_EVIDENCE = f"(SELECT DISTINCT id, term FROM (SELECT id, unnest({terms('ground_truth')}) AS term FROM eval_items))"


@query(f"SELECT id, count(*) AS n_tokens, count(e.term) AS n_leaked, round_even(count(e.term) / count(*), 4) AS share, count(e.term) / count(*) >= 0.65 AS is_flagged FROM {QTERMS} q LEFT JOIN {_EVIDENCE} e USING (id, term) GROUP BY id")
def lexical_leakage(t):
    """Share of a question's words that its gold evidence holds too; flagged from 65 %."""
    asked = lexical.query_terms(t("eval_items").select("id", "question").distinct(), "id", "question")
    evidence = t("eval_items").select("id", F.explode(tx.terms(F.col("ground_truth"))).alias("term")).distinct().withColumn("hit", F.lit(1))
    share = F.count("hit") / F.count(F.lit(1))
    return asked.join(evidence, ["id", "term"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("hit").alias("n_leaked"), tx.rounded(share).alias("share"), (share >= 0.65).alias("is_flagged"))


@query(f"SELECT coalesce(nullif({spaced('drafter')}, ''), 'unknown') AS drafter, count(DISTINCT id) AS n FROM eval_items GROUP BY 1")
def drafter_census(t):
    return t("eval_items").groupBy(F.coalesce(F.nullif(tx.spaced(F.col("drafter")), F.lit("")), F.lit("unknown")).alias("drafter")).agg(F.count_distinct("id").alias("n"))
