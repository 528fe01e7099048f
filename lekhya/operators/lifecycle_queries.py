"""Corpus admission, manifests, staleness and reuse checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.operators.registry import query

# Conversion artifacts that a source must not hold.
ARTIFACTS = ["ऐनकको", "र्दफा", "संशकोध", "कारबाी", "पीमडलिे", "तकोकीएकको"]


def occurrences(c: Column, part: str) -> Column:
    """How often ``part`` stands in the text, without overlaps."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part)))) / len(part)).cast("long")


def admission_errors(registry: DataFrame, texts: DataFrame, artifacts: list[str] = ARTIFACTS) -> DataFrame:
    """(source, error) of a corpus: duplicate keys, sources without text, blank sources, artifacts with their counts.

    ``registry`` (source), ``texts`` (source, text). An empty result admits the corpus.
    """
    sizes = texts.groupBy("source").agg(F.max(F.length(F.trim("text"))).alias("longest"), *(F.sum(occurrences(F.col("text"), a)).alias(f"a{i}") for i, a in enumerate(artifacts)))
    known = registry.groupBy("source").agg(F.count(F.lit(1)).alias("n")).join(sizes, "source", "left")
    found = [F.when(F.col("n") > 1, "duplicate source key"), F.when(F.col("longest").isNull(), "missing"), F.when(F.col("longest") == 0, "empty")]
    found += [F.when(F.col(f"a{i}") > 0, F.concat(F.lit(f"artifact {a} occurs "), F.col(f"a{i}").cast("string"))) for i, a in enumerate(artifacts)]
    return known.select("source", F.explode(F.array_compact(F.array(*found))).alias("error"))


def require_admitted(errors: DataFrame) -> None:
    """Raise with the first errors unless there is none."""
    if rows := errors.orderBy("source", "error").limit(20).collect():
        raise ValueError("corpus not admitted: " + "; ".join(f"{r.source}: {r.error}" for r in rows))


def _admission(texts: str, artifacts: list[str]) -> str:
    each = [f"CAST((length(text) - length(replace(text, '{a}', ''))) / {len(a)} AS BIGINT)" for a in artifacts]
    return f"""
WITH s AS (SELECT source, max(length(trim(text))) AS longest, {', '.join(f'sum({o}) AS a{i}' for i, o in enumerate(each))} FROM ({texts}) GROUP BY source),
k AS (SELECT source, n, longest, {', '.join(f'a{i}' for i in range(len(artifacts)))} FROM (SELECT source, count(*) AS n FROM corpus_registry GROUP BY source) LEFT JOIN s USING (source))
SELECT * FROM (SELECT source, unnest([CASE WHEN n > 1 THEN 'duplicate source key' END, CASE WHEN longest IS NULL THEN 'missing' END, CASE WHEN longest = 0 THEN 'empty' END, {', '.join(f"CASE WHEN a{i} > 0 THEN 'artifact {a} occurs ' || a{i}::BIGINT END" for i, a in enumerate(artifacts))}]) AS error FROM k) WHERE error IS NOT NULL"""


@query(_admission("SELECT act_ref AS source, text FROM documents WHERE act_ref IS NOT NULL", ARTIFACTS))
def corpus_admission(t):
    """Acts of the registry without documents, blank ones, and artifacts in their documents."""
    return admission_errors(t("corpus_registry").select("source"), t("documents").filter("act_ref is not null").select(F.col("act_ref").alias("source"), "text"))


#: Signs that no source may hold in a corpus of consistent characters.
STRAY_SIGNS = ["\u200b", "\u200d", "\u00ad", "\u00a0", "\ufffd", "|"]


@query(_admission("SELECT metadata.source AS source, text FROM search_results WHERE metadata.source IS NOT NULL", STRAY_SIGNS))
def retrieved_text_admission(t):
    """The same audit of the retrieved texts of each act, for stray signs."""
    return admission_errors(t("corpus_registry").select("source"), t("search_results").filter("metadata.source is not null").select("metadata.source", "text"), STRAY_SIGNS)


def fingerprint(c: Column) -> Column:
    """An order-free fingerprint of a group's texts: the sum of 60 bits of their MD5 sums; partial sums combine, so a hot group is no task's burden."""
    return F.sum(F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")


_FP = "CAST(sum(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR)"


def manifest(texts: DataFrame, source: str = "source") -> DataFrame:
    """Per source: number of texts, bytes and fingerprint."""
    return texts.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), fingerprint(F.col("text")).alias("fingerprint"))


def manifest_diff(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """(source, status): ``added``, ``removed``, ``changed`` or ``same``, by full outer join."""
    r, c = recorded.select("source", F.col("fingerprint").alias("__r")), current.select("source", F.col("fingerprint").alias("__c"))
    status = F.when(F.col("__r").isNull(), "added").when(F.col("__c").isNull(), "removed").when(F.col("__r") != F.col("__c"), "changed").otherwise("same")
    return r.join(c, "source", "full").select("source", status.alias("status"))


_MAN = lambda where: f"(SELECT source, count(*) AS n_texts, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, {_FP} AS fingerprint FROM chunks {where} GROUP BY source)"


@query(f"SELECT * FROM {_MAN('')}")
def index_manifest(t):
    return manifest(t("chunks"))


@query(f"SELECT source, CASE WHEN r.fingerprint IS NULL THEN 'added' WHEN c.fingerprint IS NULL THEN 'removed' WHEN r.fingerprint <> c.fingerprint THEN 'changed' ELSE 'same' END AS status FROM {_MAN('WHERE NOT incomplete')} r FULL JOIN {_MAN('')} c USING (source)")
def index_staleness(t):
    """Sources whose complete chunks alone aren't the whole index."""
    return manifest_diff(manifest(t("chunks").filter("not incomplete")), manifest(t("chunks")))


@query("SELECT count(*) AS chunk_count, round_even(avg(length(text)), 2) AS avg_chars, CAST(min(length(text)) AS BIGINT) AS min_chars, CAST(max(length(text)) AS BIGINT) AS max_chars, count(*) FILTER (WHERE is_merged) AS multi_dafa FROM chunks")
def index_stats(t):
    n = F.length("text")
    return t("chunks").agg(F.count(F.lit(1)).alias("chunk_count"), F.bround(F.avg(n), 2).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"), F.count_if("is_merged").alias("multi_dafa"))


@query("SELECT (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(DISTINCT chunk_id) FROM chunks) AS n_ids, (SELECT count(*) FROM chunks WHERE text IS NULL OR length(text) <> char_count) AS n_bad_lengths, (SELECT count(*) FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM corpus_registry r WHERE r.source = c.source)) AS n_unregistered")
def index_verification(t):
    c = t("chunks")
    own = c.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("chunk_id").alias("n_ids"), F.count_if(F.col("text").isNull() | (F.length("text") != F.col("char_count"))).alias("n_bad_lengths"))
    return own.join(c.join(t("corpus_registry").select("source").distinct(), "source", "left_anti").agg(F.count(F.lit(1)).alias("n_unregistered")))


@query("SELECT question_id, count(DISTINCT metadata.retrieval_mode) = 1 AND count(DISTINCT rank) <= 5 AND count(*) FILTER (WHERE text IS NULL OR trim(text) = '') = 0 AS is_reusable FROM search_results GROUP BY question_id")
def reuse_check(t):
    """Whether a question's stored results share one mode, at most five ranks, and all have text."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    return t("search_results").groupBy("question_id").agg(((F.count_distinct("metadata.retrieval_mode") == 1) & (F.count_distinct("rank") <= 5) & (F.count_if(blank) == 0)).alias("is_reusable"))


@query("SELECT r.result_id FROM correctness_results r JOIN (SELECT question_id, max(retrieved_at) AS retrieved_at FROM search_results GROUP BY question_id) s USING (question_id) WHERE r.evaluated_at < s.retrieved_at")
def stale_judgements(t):
    """Judgements older than the results they were derived from, which were retrieved anew since."""
    retrieved = t("search_results").groupBy("question_id").agg(F.max("retrieved_at").alias("retrieved"))
    return t("correctness_results").join(retrieved, "question_id").filter("evaluated_at < retrieved").select("result_id")


@query("""
WITH f AS (SELECT source, count(*) AS n, 'fresh' AS origin FROM chunks GROUP BY source), o AS (SELECT act_ref AS source, count(*) AS n, 'existing' AS origin FROM documents WHERE act_ref IS NOT NULL GROUP BY act_ref)
SELECT * FROM f UNION ALL SELECT * FROM o WHERE source NOT IN (SELECT source FROM f)""")
def summary_union(t):
    """Fresh counts of the chunked acts, existing ones of the others."""
    fresh = t("chunks").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("fresh"))
    old = t("documents").filter("act_ref is not null").groupBy(F.col("act_ref").alias("source")).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit("existing"))
    return fresh.unionByName(old.join(fresh.select("source"), "source", "left_anti"))


@query("SELECT export_source, count(DISTINCT sha256(coalesce(question, '') || chr(31) || coalesce(ground_truth, ''))) AS n_prompts, CAST(sum(CAST('0x' || substr(md5(coalesce(question, '') || chr(31) || coalesce(ground_truth, '')), 1, 15) AS BIGINT)::HUGEINT) AS VARCHAR) AS fingerprint FROM correctness_results GROUP BY export_source")
def dataset_fingerprints(t):
    both = F.concat(F.coalesce("question", F.lit("")), F.lit("\x1f"), F.coalesce("ground_truth", F.lit("")))
    return t("correctness_results").groupBy("export_source").agg(F.count_distinct(F.sha2(both, 256)).alias("n_prompts"), fingerprint(both).alias("fingerprint"))
