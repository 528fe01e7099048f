"""Judge output, answers and resumption over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekhya.operators import judging, metrics
from lekhya.operators.registry import query
from lekhya.operators.summary_queries import FACTS, JC, facts, judged
from lekhya.operators.text_queries import spaced

_SNAP = "CASE WHEN score IS NOT NULL THEN list_min(list_transform([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[], lambda s: {'d': abs(s - least(greatest(score, 0.0::DOUBLE), 1.0::DOUBLE)), 's': s})).s END"


@query(f"SELECT result_id, score AS raw_score, {_SNAP} AS score FROM correctness_results")
def score_snap(t):
    return t("correctness_results").select("result_id", F.col("score").alias("raw_score"), judging.snapped(F.col("score")).alias("score"))


_CAND = r"regexp_extract(reasoning, '(?s)\{.*\}', 0)"
_FIX = rf'''regexp_replace(translate({_CAND}, '“”', '""'), ',\s*([}}\]])', '\1', 'g')'''
_CUT = r"""regexp_extract(reasoning, '"score"\s*:\s*([0-9.]+)', 1)"""


def _json(c: str, field: str) -> str:
    return f"CASE WHEN json_valid({c}) THEN json_extract_string({c}, '$.{field}') END"


@query(f"""
SELECT result_id, CASE state WHEN 'parsed' THEN CAST({_json('c', 'score')} AS DOUBLE) WHEN 'repaired' THEN CAST({_json('f', 'score')} AS DOUBLE) WHEN 'salvaged' THEN CAST(s AS DOUBLE) ELSE 0.0 END AS score, state,
  CASE state WHEN 'parsed' THEN {_json('c', 'reasoning')} WHEN 'repaired' THEN {_json('f', 'reasoning')} WHEN 'salvaged' THEN '[truncated response] ' || trim(regexp_extract(reasoning, '(?s)"reasoning"\\s*:\\s*"(.*?)(?:"|$)', 1)) ELSE 'Failed to parse' END AS reasoning
FROM (SELECT *, CASE WHEN {_json('c', 'score')} IS NOT NULL THEN 'parsed' WHEN {_json('f', 'score')} IS NOT NULL THEN 'repaired' WHEN try_cast(s AS DOUBLE) IS NOT NULL THEN 'salvaged' ELSE 'failed' END AS state
  FROM (SELECT result_id, reasoning, {_CAND} AS c, {_FIX} AS f, {_CUT} AS s FROM groundedness_results))""")
def json_salvage(t):
    return t("groundedness_results").select("result_id", judging.parsed(F.col("reasoning")).alias("p")).select("result_id", "p.score", "p.state", "p.reasoning")


@query("SELECT question_id, CAST(count(*) AS BIGINT) AS n, array_to_string(list_sort(list(rank::VARCHAR ORDER BY rank) FILTER (WHERE rank >= 0 AND rank < n_all)), '|') AS kept FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS n_all FROM search_results) GROUP BY question_id")
def index_sanitise(t):
    """Ranks taken as indices: those within the number of results stay."""
    raw = t("search_results").groupBy("question_id").agg(F.array_sort(F.collect_list("rank")).alias("raw"), F.count(F.lit(1)).alias("n"))  # of one question
    return raw.select("question_id", "n", F.array_join(F.array_sort(judging.sane_indices(F.col("raw"), F.col("n")).cast("array<string>")), "|").alias("kept"))


@query("SELECT question_id, array_to_string(CASE WHEN count(*) FILTER (WHERE semantic_score IS NULL) > 0 THEN range(0, count(*)) ELSE list(rank - 1 ORDER BY rank, search_id) END, '|') AS indices FROM search_results GROUP BY question_id")
def legacy_indices(t):
    """Stored indices, or 0..n-1 where a stored one is missing."""
    per = t("search_results").groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("semantic_score").isNull()).alias("missing"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "search_id"))), lambda x: (x["rank"] - 1).cast("long")).alias("stored"))
    return per.select("question_id", F.array_join(F.coalesce(F.when(F.col("missing") == 0, F.col("stored")), F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)), F.array().cast("array<bigint>")), "|").alias("indices"))


_NORM = spaced("coalesce(generated_answer, '')")
_REF = "|".join(judging.REFUSALS)
_OUT = "(answerability = 'out_of_scope' OR category = 'out_of_scope')"
_MORE = "|".join([*judging.REFUSALS, *judging.MORE_REFUSALS]).replace("'", "''")


@query(f"SELECT result_id, n <> '' AND NOT starts_with(n, 'error') AND regexp_matches(n, '(?i){_REF}') AS is_refusal, n <> '' AND NOT starts_with(n, 'error') AND regexp_matches(n, '(?i){_MORE}') AS is_refusal_extended FROM (SELECT result_id, {_NORM} AS n FROM correctness_results)")
def refusal_flags(t):
    a = F.col("generated_answer")
    return t("correctness_results").select("result_id", judging.refuses(a, judging.REFUSALS).alias("is_refusal"), judging.refuses(a, [*judging.REFUSALS, *judging.MORE_REFUSALS]).alias("is_refusal_extended"))


def _compliance(pattern: str, where: str) -> str:
    return f"""
SELECT CASE WHEN grouping(split) = 1 THEN 'combined' ELSE split END AS scope, count(*) AS n, count(*) FILTER (WHERE refused) AS n_refused, round_even(avg(refused::INT), 4) AS rate FROM (
  SELECT split, n <> '' AND NOT starts_with(n, 'error') AND regexp_matches(n, '(?i){pattern}') AS refused FROM (SELECT split, {_NORM} AS n FROM {JC} WHERE {where})) GROUP BY GROUPING SETS ((split), ())"""


def compliance(t, patterns, out):
    rows = judged(t, "correctness_results").filter(out).withColumn("refused", judging.refuses(F.col("generated_answer"), patterns))
    return metrics.by_scope(rows, "split", {"n": F.count(F.lit(1)), "n_refused": F.count_if("refused"), "rate": F.bround(F.avg(F.col("refused").cast("int")), 4)}).filter("n > 0")


@query(f"SELECT * FROM ({_compliance(_REF, _OUT)}) WHERE n > 0")
def refusal_compliance(t):
    """Refusals by the fixed patterns among the answers to items that answerability or category puts out of scope, by split and over all."""
    return compliance(t, judging.REFUSALS, _OUT)


@query(f"SELECT * FROM ({_compliance(_MORE, _OUT)}) WHERE n > 0")
def refusal_compliance_extended(t):
    """The same by the fixed patterns and ours."""
    return compliance(t, [*judging.REFUSALS, *judging.MORE_REFUSALS], _OUT)


_VALID = "NOT (coalesce(category, '') = 'out_of_scope' OR coalesce(answerability, '') = 'out_of_scope') AND trim(coalesce(generated_answer, '')) <> '' AND NOT starts_with(upper(trim(coalesce(generated_answer, ''))), 'ERROR')"


@query(f"SELECT result_id FROM correctness_results r LEFT JOIN {FACTS} f ON f.id = r.question_id WHERE {_VALID}")
def valid_answers(t):
    return judging.valid_answers(t("correctness_results").join(facts(t), F.col("question_id") == F.col("id"), "left")).select("result_id")


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE category = 'out_of_scope') AS n_out_by_category, count(*) FILTER (WHERE category = 'out_of_scope' OR answerability <> 'answerable') AS n_out_by_either, count(*) FILTER (WHERE {_VALID}) AS n_valid FROM correctness_results r LEFT JOIN {FACTS} f ON f.id = r.question_id")
def scope_policy(t):
    rows = t("correctness_results").join(facts(t), F.col("question_id") == F.col("id"), "left")
    out = F.col("category") == "out_of_scope"
    counts = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(out).alias("n_out_by_category"), F.count_if(out | (F.col("answerability") != "answerable")).alias("n_out_by_either"))
    return counts.join(judging.valid_answers(rows).agg(F.count(F.lit(1)).alias("n_valid")))


@query("SELECT export_source, count(*) AS n, count(*) FILTER (WHERE contains(coalesce(reasoning, ''), 'Failed to parse') OR contains(coalesce(reasoning, ''), 'Evaluation error')) AS n_judge_errors, count(*) FILTER (WHERE starts_with(upper(trim(coalesce(generated_answer, ''))), 'ERROR')) AS n_answer_errors, count(*) FILTER (WHERE score IS NULL) AS n_unscored FROM correctness_results GROUP BY export_source")
def error_rows(t):
    failed = lambda: F.coalesce("reasoning", F.lit("")).contains(judging.FAILURES[0]) | F.coalesce("reasoning", F.lit("")).contains(judging.FAILURES[1])
    return t("correctness_results").groupBy("export_source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed()).alias("n_judge_errors"), F.count_if(F.upper(F.trim(F.coalesce("generated_answer", F.lit("")))).startswith("ERROR")).alias("n_answer_errors"), F.count_if(F.col("score").isNull()).alias("n_unscored")
    )


@query("SELECT result_id, sha256('Question:' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || 'Reference answer:' || chr(10) || coalesce(ground_truth, '') || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(generated_answer, '') || chr(10) || chr(10) || 'Score 0 to 1 as JSON.') AS prompt_sha256 FROM correctness_results")
def judge_prompts(t):
    return t("correctness_results").select("result_id", F.sha2(judging.prompt(judging.PROMPTS["correctness"], ["question", "ground_truth", "generated_answer"]), 256).alias("prompt_sha256"))


_PROMPT = "'Question:' || chr(10) || coalesce(question, '') || chr(10) || chr(10) || 'Reference answer:' || chr(10) || coalesce(ground_truth, '') || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(generated_answer, '') || chr(10) || chr(10) || 'Score 0 to 1 as JSON.'"


@query(f"SELECT result_id, ([0.0, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[])[length({_PROMPT}) % 6 + 1] AS score, 'parsed' AS state, CAST(NULL AS VARCHAR) AS error FROM correctness_results")
def judged_by_stub(t):
    """Every correctness prompt through the batched client with the deterministic judge, the replies parsed."""
    rows = t("correctness_results").select("result_id", judging.prompt(judging.PROMPTS["correctness"], ["question", "ground_truth", "generated_answer"]).alias("prompt"))
    replies = judging.asked(rows, "result_id", "prompt", judging.stub_judge)
    return replies.select("result_id", judging.parsed(F.col("reply")).alias("p"), "error").select("result_id", judging.snapped(F.col("p.score")).alias("score"), F.col("p.state").alias("state"), "error")


#: Tables of judged results, a metric each; as many as there are.
METRIC_TABLES = ("correctness_results", "groundedness_results")


@query("SELECT DISTINCT id FROM eval_items WHERE category IS DISTINCT FROM 'out_of_scope' AND id NOT IN (SELECT question_id FROM correctness_results WHERE score IS NOT NULL INTERSECT SELECT question_id FROM groundedness_results WHERE score IS NOT NULL)")
def resume_anti_join(t, tables=METRIC_TABLES):
    """Items in scope still to judge: those not done in every metric of ``tables``."""
    items = t("eval_items").filter(F.coalesce("category", F.lit("")) != "out_of_scope").select("id").distinct()
    return items.join(judging.done_in_all([t(name) for name in tables]), "id", "left_anti")


@query("SELECT r.result_id, e.category, e.difficulty FROM correctness_results r LEFT JOIN (SELECT DISTINCT ON (id) id, category, difficulty FROM eval_items ORDER BY id, created_at DESC NULLS LAST, category DESC NULLS LAST, difficulty DESC NULLS LAST) e ON e.id = r.question_id")
def result_item_lookup(t):
    """Facts of each result's item, of an id's rows the one made last (of rows made at once the greatest), as a later one replaces an earlier one."""
    order = F.struct(F.col("created_at").isNotNull(), "created_at", F.col("category").isNotNull(), "category", F.col("difficulty").isNotNull(), "difficulty")
    items = t("eval_items").groupBy(F.col("id").alias("question_id")).agg(F.max_by(F.struct("category", "difficulty"), order).alias("f")).select("question_id", "f.*")
    return t("correctness_results").join(items, "question_id", "left").select("result_id", "category", "difficulty")
