"""Lexical and dense search, fusion, routing and diversification over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lekhya.functions import text as tx
from lekhya.operators import dense, lexical, retrieval, routing
from lekhya.operators.registry import query
from lekhya.operators.text_queries import number, spaced, terms

_STOP = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
ITEMS = "(SELECT DISTINCT id, question, source FROM eval_items)"
POSTINGS = f"(SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest({terms('text')}) AS term FROM chunks) GROUP BY term, chunk_id)"
LENGTHS = f"(SELECT chunk_id, CAST(len({terms('text')}) AS BIGINT) AS dl FROM chunks)"
_TYPE = "CASE WHEN regexp_matches(question, 'दफा\\s*[०-९0-9]+|(?i:section)\\s*[०-९0-9]+') THEN 'section_lookup' WHEN regexp_matches(question, 'परिभाषा|भनेको के|के हो|अर्थ के|(?i:what is)|(?i:define)') THEN 'definition' ELSE 'general' END"
_CONTEXT = "CASE {kind} " + " ".join("WHEN '%s' THEN ['%s']" % (kind, "', '".join(words)) for kind, words in lexical.CONTEXT_STOP_WORDS.items()) + " END"
QTERMS = f"(SELECT DISTINCT id, term FROM (SELECT id, unnest({terms('question')}) AS term FROM {ITEMS}) WHERE term NOT IN ({_STOP}))"
BM25 = f"""
posted AS {POSTINGS}, sized AS {LENGTHS}, stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term), asked AS {QTERMS},
bm AS (SELECT id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN posted USING (term) JOIN df USING (term) JOIN sized USING (chunk_id) CROSS JOIN stats GROUP BY id, chunk_id)"""


def items(t):
    return t("eval_items").select("id", "question", "source").distinct()


@query(f"SELECT term, chunk_id, tf FROM {POSTINGS}")
def postings(t):
    return lexical.postings(t("chunks"), "chunk_id", "text")


@query(f"SELECT chunk_id, dl, n_docs, round(avgdl, 6) AS avgdl FROM {LENGTHS} CROSS JOIN (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM {LENGTHS})")
def doc_length_stats(t):
    sized = lexical.lengths(t("chunks"), "chunk_id", "text")
    return sized.join(F.broadcast(sized.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"))))


@query(f"SELECT DISTINCT id, term FROM (SELECT id, question, unnest({terms('question')}) AS term FROM {ITEMS}) WHERE term NOT IN ({_STOP}) AND NOT list_contains({_CONTEXT.format(kind=_TYPE)}, term)")
def stopword_filtered_terms(t):
    """Terms of each question without the stop words of all questions and of its kind."""
    return lexical.query_terms(items(t), "id", "question", context=routing.query_type(F.col("question")))


@query(f"WITH {BM25} SELECT * FROM (SELECT id, chunk_id, score, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm) WHERE rank <= 5")
def bm25_topk(t):
    return lexical.best(lexical.query_terms(items(t), "id", "question"), lexical.weighted(t("chunks"), "chunk_id", "text"), "id", "chunk_id", 5)


@query(f"WITH {BM25} SELECT r.question_id AS id, r.chunk_id, coalesce(bm.score, 0.0) AS score FROM (SELECT DISTINCT question_id, chunk_id FROM search_results) r LEFT JOIN bm ON bm.id = r.question_id AND bm.chunk_id = r.chunk_id")
def bm25_point_score(t):
    """The BM25 score of every retrieved pair, 0 without a common term."""
    pairs = t("search_results").select(F.col("question_id").alias("id"), "chunk_id").distinct()
    return lexical.pair_scores(pairs, lexical.query_terms(items(t), "id", "question"), lexical.weighted(t("chunks"), "chunk_id", "text"), "id", "chunk_id")


_DOT = "list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


@query(f"""
SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, d.vec_id, round({_DOT}, 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def dense_topk(t):
    """Nearest vectors of every hundredth vector among all."""
    vectors = t("embeddings")
    return dense.top_k(vectors.filter("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 5)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def vector_norms(t):
    v = F.col("embedding")
    return t("embeddings").select("vec_id", F.round(F.sqrt(dense.dot(v, v)), 5).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY search_id) AS n FROM search_results) WHERE n = 1)"


def first_loaded(t):
    """search_results without reloaded rows: the first of each question and chunk, picked by an aggregate that combines in each task."""
    rows = t("search_results").withColumn("source", F.col("metadata.source")).drop("text", "dafa")
    return rows.groupBy("question_id", "chunk_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("question_id", "chunk_id"))), "search_id").alias("r")).select("question_id", "chunk_id", "r.*")




@query(f"""
SELECT question_id, search_id, round(CASE WHEN hs - ls <= 1e-9 THEN 1.0 ELSE (semantic_score - ls) / (hs - ls) END, 6) AS semantic_scaled, round(CASE WHEN hk - lk <= 1e-9 THEN 1.0 ELSE (keyword_score - lk) / (hk - lk) END, 6) AS keyword_scaled FROM (
  SELECT *, min(semantic_score) OVER w AS ls, max(semantic_score) OVER w AS hs, min(keyword_score) OVER w AS lk, max(keyword_score) OVER w AS hk FROM search_results WINDOW w AS (PARTITION BY question_id))""")
def score_minmax(t):
    one = lambda c: F.round(retrieval.minmax(F.col(c), ["question_id"]), 6)
    return t("search_results").select("question_id", "search_id", one("semantic_score").alias("semantic_scaled"), one("keyword_score").alias("keyword_scaled"))


@query(f"""
WITH r AS {_FIRST}
SELECT question_id, chunk_id FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY semantic_score DESC, chunk_id) AS n FROM r WHERE semantic_score IS NOT NULL) WHERE n <= 3
UNION SELECT question_id, chunk_id FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY keyword_score DESC, chunk_id) AS n FROM r WHERE keyword_score IS NOT NULL) WHERE n <= 3""")
def candidate_union(t):
    """The three best by meaning and the three best by words of each question, as one set."""
    first = first_loaded(t)
    best = lambda c: lexical.top(first.filter(F.col(c).isNotNull()), "question_id", "chunk_id", 3, c).select("question_id", "chunk_id")
    return best("semantic_score").unionByName(best("keyword_score")).distinct()


@query(f"SELECT id, {_TYPE} AS query_type, m AS mode, CASE m WHEN 'faiss_only' THEN 1.0 WHEN 'bm25_only' THEN 0.0 ELSE CASE {_TYPE} WHEN 'section_lookup' THEN 0.3 WHEN 'definition' THEN 0.6 ELSE 0.55 END END::DOUBLE AS alpha FROM {ITEMS} CROSS JOIN (SELECT unnest(['hybrid', 'faiss_only', 'bm25_only', 'routed_hybrid']) AS m)")
def adaptive_alpha(t):
    kind = routing.query_type(F.col("question"))
    moded = items(t).select("id", kind.alias("query_type"), F.explode(F.array(*map(F.lit, routing.MODES))).alias("mode"))
    return moded.withColumn("alpha", routing.alpha(F.col("mode"), F.col("query_type")))


_REQUIRED = f"(SELECT DISTINCT id, {number('d')} AS number, min(p) OVER (PARTITION BY id, {number('d')}) - 1 AS mention_rank FROM (SELECT DISTINCT id, unnest(required_dafas) AS d, generate_subscripts(required_dafas, 1) AS p FROM eval_items) WHERE d IS NOT NULL)"
_SECTIONS = f"(SELECT DISTINCT chunk_id, {number('d')} AS number FROM (SELECT chunk_id, unnest(CASE WHEN len(dafa_list) > 0 THEN dafa_list ELSE [dafa] END) AS d FROM chunks) WHERE d IS NOT NULL)"


def required_numbers(t):
    named = t("eval_items").select("id", F.posexplode("required_dafas").alias("p", "d")).filter("d is not null")
    return named.select("id", "p", tx.section_number(F.col("d")).alias("number")).groupBy("id", "number").agg(F.min("p").alias("mention_rank"))


def chunk_numbers(t):
    labels = F.when(F.size("dafa_list") > 0, F.col("dafa_list")).otherwise(F.array("dafa"))
    return t("chunks").select("chunk_id", F.explode(labels).alias("d")).filter("d is not null").select("chunk_id", tx.section_number(F.col("d")).alias("number")).distinct()


@query(f"SELECT id, chunk_id, CAST(min(mention_rank) AS INTEGER) AS mention_rank, round(greatest(0.80, 1.0 - 0.05 * min(mention_rank)), 6)::DOUBLE AS score FROM {_REQUIRED} JOIN {_SECTIONS} USING (number) GROUP BY id, chunk_id")
def section_seed(t):
    return retrieval.all_seeds(required_numbers(t), chunk_numbers(t), "id", "chunk_id")


_BOOST = f"(SELECT r.search_id, max(CASE WHEN q.number IS NOT NULL THEN 1.0 ELSE 0.0 END) AS boost FROM search_results r LEFT JOIN {_SECTIONS} s USING (chunk_id) LEFT JOIN {_REQUIRED} q ON q.id = r.question_id AND q.number = s.number GROUP BY r.search_id)"


def boosts(t):
    """1 for a result whose chunk holds a section the question asks for, else 0."""
    asked = required_numbers(t).select(F.col("id").alias("question_id"), "number", F.lit(1.0).alias("hit"))
    pairs = t("search_results").select("search_id", "question_id", "chunk_id").join(chunk_numbers(t), "chunk_id", "left").join(asked, ["question_id", "number"], "left")
    return pairs.groupBy("search_id").agg(F.max(F.coalesce("hit", F.lit(0.0))).alias("boost"))


@query(f"SELECT search_id, boost::DOUBLE AS boost FROM {_BOOST}")
def section_boost(t):
    return boosts(t)


@query(f"""
SELECT search_id, query_type, round(CASE mode WHEN 'semantic_only' THEN s WHEN 'bm25_only' THEN k ELSE CASE WHEN query_type = 'section_lookup' AND boost > 0 THEN 0.15 * s + 0.25 * k + 0.60 ELSE a * s + (1 - a) * k + 0.10 * boost END END, 8)::DOUBLE AS score FROM (
  SELECT r.search_id, r.metadata.retrieval_mode AS mode, coalesce(semantic_score, 0) AS s, coalesce(keyword_score, 0) AS k, boost, {_TYPE} AS query_type, CASE {_TYPE} WHEN 'section_lookup' THEN 0.3 WHEN 'definition' THEN 0.6 ELSE 0.55 END AS a
  FROM search_results r JOIN {ITEMS} i ON i.id = r.question_id JOIN {_BOOST} USING (search_id))""")
def hybrid_fusion(t):
    """The fused score of every result from its stored semantic and keyword scores."""
    mode = F.when(F.col("mode") == "semantic_only", "faiss_only").otherwise(F.col("mode"))
    rows = t("search_results").select("search_id", "question_id", F.col("metadata.retrieval_mode").alias("mode"), "semantic_score", "keyword_score").join(items(t).select(F.col("id").alias("question_id"), "question"), "question_id").join(boosts(t), "search_id")
    kind = routing.query_type(F.col("question"))
    return rows.select("search_id", kind.alias("query_type"), F.round(retrieval.fused(mode, kind, F.col("semantic_score"), F.col("keyword_score"), F.col("boost")), 8).alias("score"))


@query("""
SELECT question_id, source, chunk_id, search_id, score FROM (
  SELECT question_id, coalesce(metadata.source, '') AS source, chunk_id, search_id, score, row_number() OVER (PARTITION BY question_id, coalesce(metadata.source, ''), chunk_id ORDER BY score DESC NULLS LAST, search_id) AS n FROM search_results) WHERE n = 1""")
def variant_max_merge(t):
    """The best row of each question, source and chunk, reloads included."""
    rows = t("search_results").select("question_id", F.coalesce("metadata.source", F.lit("")).alias("source"), "chunk_id", "search_id", "score")
    return retrieval.merged(rows, ["question_id", "source", "chunk_id"], ["search_id"])


@query(f"""
WITH r AS {_FIRST}
SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS depth FROM r) c JOIN {ITEMS} i ON i.id = c.question_id WHERE depth <= 4 AND c.metadata.source = i.source) WHERE rank <= 2""")
def post_filtered_topk(t):
    """The source filter after the candidate cut: four candidates, those of the item's source, of these two."""
    deep = lexical.top(first_loaded(t), "question_id", "chunk_id", 4).select("question_id", "chunk_id", "score", F.col("metadata.source").alias("have"))
    kept = deep.join(items(t).select(F.col("id").alias("question_id"), "source"), "question_id").filter(F.col("have") == F.col("source"))
    return lexical.top(kept.select("question_id", "chunk_id", "score"), "question_id", "chunk_id", 2)


_ROUTED = "(SELECT id, list_distinct(list_transform(required_sections, lambda x: x.source)) AS sources FROM (SELECT DISTINCT id, required_sections FROM eval_items))"


@query(f"""
WITH r AS {_FIRST}, p AS (
  SELECT question_id, chunk_id, coalesce(metadata.source, '') AS source, score, coalesce(len(sources), 0) AS n, coalesce(list_contains(sources, metadata.source), false) AS routed,
    row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS g, row_number() OVER (PARTITION BY question_id, coalesce(metadata.source, '') ORDER BY score DESC, chunk_id) AS s
  FROM r JOIN {_ROUTED} ON id = question_id)
SELECT * FROM (SELECT question_id, chunk_id, source, score, CAST(g AS INTEGER) AS global_rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN g = 1 OR n < 2 THEN 0 WHEN routed AND s <= greatest(1, 3 // n) THEN 1 ELSE 2 END, g) AS INTEGER) AS rank FROM p) WHERE rank <= 3""")
def diversified_topk(t):
    """The best three of each question, balanced over the sources it asks for."""
    routed = t("eval_items").select(F.col("id").alias("question_id"), F.array_distinct("required_sections.source").alias("sources")).distinct()
    ranked = first_loaded(t).select("question_id", "chunk_id", F.coalesce("metadata.source", F.lit("")).alias("source"), "score").join(routed, "question_id")
    found = retrieval.diversified(ranked, "question_id", "chunk_id", F.size("sources"), F.coalesce(F.array_contains("sources", F.col("source")), F.lit(False)), 3)
    return found.select("question_id", "chunk_id", "source", "score", "global_rank", "rank")


@query(f"""
SELECT r.search_id, r.question_id, r.rank, r.chunk_id, array_to_string(c.dafa_list, '|') AS dafa_list, coalesce(r.metadata.source, c.source) AS source, coalesce(r.metadata.act_name, c.act_name) AS act_name, c.bhag, c.parichhed
FROM search_results r JOIN chunks c USING (chunk_id)""")
def result_enrichment(t):
    c = t("chunks").select("chunk_id", F.array_join("dafa_list", "|").alias("dafa_list"), F.col("source").alias("s"), F.col("act_name").alias("a"), "bhag", "parichhed")
    return t("search_results").join(c, "chunk_id").select("search_id", "question_id", "rank", "chunk_id", "dafa_list", F.coalesce("metadata.source", "s").alias("source"), F.coalesce("metadata.act_name", "a").alias("act_name"), "bhag", "parichhed")


_DEPTH = "CAST(least(greatest(5 * CASE WHEN wide THEN 12 ELSE 6 END, 5), n) AS BIGINT)"


@query(f"SELECT id, n_sources, {_DEPTH} AS depth FROM (SELECT DISTINCT id, CAST(len(list_distinct(list_transform(required_sections, lambda x: x.source))) AS BIGINT) AS n_sources, n_sources > 1 AS wide FROM eval_items) CROSS JOIN (SELECT count(*) AS n FROM chunks)")
def search_depth(t):
    """Over-fetch depth of each question, wide when it asks for several sources."""
    n = t("chunks").count()
    wide = t("eval_items").select("id", F.size(F.array_distinct("required_sections.source")).cast("long").alias("n_sources")).distinct()
    return wide.select("id", "n_sources", retrieval.search_depth(5, n, F.col("n_sources") > 1).cast("long").alias("depth"))


NORM = spaced("coalesce(question, '')")


def _score(source: str) -> str:
    named = {
        "muluki_ain": "contains(norm, 'मुलुकी देवानी') OR contains(norm, 'देवानी संहिता')",
        "domestic_violence": "contains(norm, 'घरेलु हिंसा') AND (contains(norm, 'ऐन') OR contains(norm, 'कसूर र सजाय'))",
    }[source]
    return " + ".join([f"CASE WHEN {named} THEN 100 ELSE 0 END", *(f"CASE WHEN contains(norm, '{p}') THEN {w} ELSE 0 END" for s, p, w in routing.PROFILE if s == source)])


_SCORED = f"(SELECT id, norm, {_score('muluki_ain')} AS m, {_score('domestic_violence')} AS d FROM (SELECT id, {NORM} AS norm FROM {ITEMS}))"


@query(f"SELECT id, CAST(m AS BIGINT) AS score_muluki_ain, CAST(d AS BIGINT) AS score_domestic_violence, CAST((m >= 100)::INT + (d >= 100)::INT AS BIGINT) AS n_explicit FROM {_SCORED}")
def route_scores(t):
    r = routing.routes(items(t), "id", "question")
    return r.select("id", "score_muluki_ain", "score_domestic_violence", F.size("explicit").cast("long").alias("n_explicit"))


def _phrases(source: str) -> str:
    listed = ", ".join(f"'{p}'" for s, p, _ in routing.PROFILE if s == source)
    return f"array_to_string(list_filter([{listed}], lambda p: contains(norm, p)), '|')"


@query(f"SELECT id, {_phrases('muluki_ain')} AS muluki_ain, {_phrases('domestic_violence')} AS domestic_violence FROM {_SCORED}")
def matched_phrases(t):
    """The profile phrases of each source that a question holds."""
    norm = tx.spaced(F.col("question"))
    return items(t).select("id", *(F.array_join(routing.matched(norm, s), "|").alias(s) for s in routing.SOURCES))


_CUES = " OR ".join(f"contains(norm, '{c}')" for c in routing.BOTH_CUES)
_RTYPE = f"CASE WHEN m >= 3 AND d >= 3 OR {_CUES} THEN 'multi_source' WHEN m >= 3 OR d >= 3 THEN 'single_source' ELSE 'global' END"


@query(f"SELECT route_type, CASE WHEN route_type = 'single_source' THEN CASE WHEN m >= 3 THEN 'muluki_ain' ELSE 'domestic_violence' END ELSE 'muluki_ain|domestic_violence' END AS sources, id, route_type = 'multi_source' AS diversify FROM (SELECT *, {_RTYPE} AS route_type FROM {_SCORED})")
def route_type(t):
    return routing.routes(items(t), "id", "question").select("id", "route_type", F.array_join("sources", "|").alias("sources"), "diversify")


@query(f"""
SELECT id, mode, CASE WHEN (m >= 100)::INT + (d >= 100)::INT = 1 AND route_type <> 'multi_source' THEN CASE WHEN m >= 100 THEN 'muluki_ain' ELSE 'domestic_violence' END
  WHEN mode = 'routed_hybrid' AND route_type = 'single_source' THEN CASE WHEN m >= 3 THEN 'muluki_ain' ELSE 'domestic_violence' END END AS must
FROM (SELECT *, {_RTYPE} AS route_type FROM {_SCORED}) CROSS JOIN (SELECT unnest(['hybrid', 'faiss_only', 'bm25_only', 'routed_hybrid']) AS mode)""")
def source_constraint(t):
    r = routing.routes(items(t), "id", "question").withColumn("mode", F.explode(F.array(*map(F.lit, routing.MODES))))
    return r.select("id", "mode", routing.constraint(F.col("mode")).alias("must"))


def _sections_sql(text: str) -> str:
    every = rf"list_transform(regexp_extract_all(lower(translate({text}, '०१२३४५६७८९', '0123456789')), '(?:दफा|section)\s*([0-9]+(?:[क-हa-z]\b|[क-ह](?:[^\x{{0900}}-\x{{0963}}]|$))?)', 1), lambda x: regexp_extract(x, '^[0-9]+[क-हa-z]?', 0))"
    return f"list_filter({every}, lambda x, i: list_position({every}, x) = i)"


@query(f"SELECT doc_id, CAST(len({_sections_sql('text')}) AS BIGINT) AS n_sections, array_to_string({_sections_sql('text')}, '|') AS sections FROM documents")
def mentioned_sections(t):
    found = routing.mentioned_sections(F.col("text"))
    return t("documents").select("doc_id", F.size(found).cast("long").alias("n_sections"), F.array_join(found, "|").alias("sections"))


_V = spaced("question")
_VN = f"translate({_V}, '०१२३४५६७८९', '0123456789')"


@query(f"""
SELECT id, variant FROM (SELECT DISTINCT id, question AS variant FROM eval_items UNION SELECT id, {_VN} FROM eval_items UNION SELECT id, regexp_replace({_VN}, '^(?:कृपया[^,]*,|please tell me:|जानकारी पाऊँ:)\\s*', '') FROM eval_items)""")
def query_variants(t):
    return items(t).select("id", F.explode(routing.variants(F.col("question"))).alias("variant")).distinct()


_FOUND = _sections_sql("question")
_MD5 = "(SELECT {keys}, ((instr('0123456789abcdef', md5(term)[1]) - 1) * 16 + instr('0123456789abcdef', md5(term)[2]) - 1) % 64 AS slot, sum(CASE WHEN md5(term)[3] < '8' THEN 1 ELSE -1 END) AS w FROM (SELECT {keys}, unnest({terms}) AS term FROM {rows}) GROUP BY {keys}, slot)"


def _planned(mode: str) -> str:
    """Plan and variants of every question as SQL."""
    return f"""
it AS (SELECT id, coalesce(min(question), '') AS question FROM eval_items WHERE id IS NOT NULL GROUP BY id),
rt AS (SELECT *, {_RTYPE} AS route_type FROM {_SCORED.replace(ITEMS, 'it')}),
plan AS (SELECT id, question, {_TYPE} AS kind, {_FOUND} AS numbers, route_type = 'multi_source' AND {mode == 'routed_hybrid'} AS diversify, CASE WHEN route_type = 'single_source' THEN CASE WHEN m >= 3 THEN ['muluki_ain'] ELSE ['domestic_violence'] END ELSE ['muluki_ain', 'domestic_violence'] END AS sources,
  CASE WHEN (m >= 100)::INT + (d >= 100)::INT = 1 AND route_type <> 'multi_source' THEN CASE WHEN m >= 100 THEN 'muluki_ain' ELSE 'domestic_violence' END WHEN {mode == 'routed_hybrid'} AND route_type = 'single_source' THEN CASE WHEN m >= 3 THEN 'muluki_ain' ELSE 'domestic_violence' END END AS must FROM it JOIN rt USING (id)),
specs AS (SELECT DISTINCT id, variant, NULL AS forced FROM (SELECT id, question AS variant FROM plan UNION SELECT id, {_VN} FROM plan UNION SELECT id, regexp_replace({_VN}, '^(?:कृपया[^,]*,|please tell me:|जानकारी पाऊँ:)\\s*', '') FROM plan) UNION ALL SELECT id, question, unnest(sources) FROM plan WHERE diversify)"""


def _searched(mode: str) -> str:
    """The whole search as SQL over all pairs."""
    depth = f"least((SELECT count(*) FROM chunks), 5 * CASE WHEN diversify OR must IS NOT NULL THEN 12 ELSE 6 END)"
    semantic = "cosine" if mode in ("faiss_only", "bm25_only") else "CASE WHEN max(cosine) OVER w - min(cosine) OVER w <= 1e-9 THEN 1.0 ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) END"
    alpha = "CASE kind WHEN 'section_lookup' THEN 0.3 WHEN 'definition' THEN 0.6 ELSE 0.55 END"
    score = {"faiss_only": "coalesce(cosine, 0.0)", "bm25_only": "kw"}.get(mode, f"CASE WHEN kind = 'section_lookup' AND boost > 0 THEN 0.15 * sem + 0.25 * kw + 0.60 ELSE {alpha}::DOUBLE * sem + (1 - {alpha}::DOUBLE) * kw + 0.10 * boost END")
    pool = "SELECT id, variant, chunk_id FROM near" + ("" if mode == "faiss_only" else " UNION SELECT id, variant, chunk_id FROM words")
    seeded = "" if mode in ("faiss_only", "bm25_only") else """
UNION ALL SELECT id, chunk_id, source, score, 0 FROM (SELECT p.id, n.chunk_id, c.source, p.must, round(greatest(0.80::DOUBLE, 1.0::DOUBLE - 0.05::DOUBLE * (min(p.place) - 1)), 6) AS score FROM (SELECT id, must, unnest(numbers) AS number, generate_subscripts(numbers, 1) AS place FROM plan WHERE kind = 'section_lookup') p JOIN own n USING (number) JOIN chunks c USING (chunk_id) GROUP BY p.id, n.chunk_id, c.source, p.must) WHERE must IS NULL OR source = must"""
    return f"""
WITH {_planned(mode)}, qv AS (SELECT DISTINCT s.id, s.variant, p.kind, {depth} AS depth FROM specs s JOIN plan p USING (id)), own AS {_SECTIONS},
posted AS {POSTINGS}, sized AS {LENGTHS}, stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized), df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
asked AS (SELECT DISTINCT id, variant, term FROM (SELECT id, variant, kind, unnest({terms('variant')}) AS term FROM qv) WHERE term NOT IN ({_STOP}) AND NOT list_contains({_CONTEXT.format(kind='kind')}, term)),
bm AS (SELECT id, variant, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM asked JOIN posted USING (term) JOIN df USING (term) JOIN sized USING (chunk_id) CROSS JOIN stats GROUP BY id, variant, chunk_id),
words AS (SELECT * FROM (SELECT b.*, depth, row_number() OVER (PARTITION BY id, variant ORDER BY bm25 DESC, chunk_id) AS r FROM bm b JOIN qv USING (id, variant)) WHERE r <= depth),
cw AS {_MD5.format(keys='chunk_id', terms=terms('text'), rows='chunks')}, qw AS {_MD5.format(keys='id, variant', terms=terms('variant'), rows='qv')},
cn AS (SELECT chunk_id, sum(w * w) AS n FROM cw GROUP BY chunk_id), qn AS (SELECT id, variant, sum(w * w) AS n FROM qw GROUP BY id, variant), dots AS (SELECT id, variant, chunk_id, sum(q.w * c.w) AS dot FROM qw q JOIN cw c USING (slot) GROUP BY id, variant, chunk_id),
near AS (SELECT * FROM (SELECT id, variant, chunk_id, depth, cosine, row_number() OVER (PARTITION BY id, variant ORDER BY cosine DESC, chunk_id) AS r FROM (
  SELECT qv.id, qv.variant, c.chunk_id, depth, CASE WHEN coalesce(qn.n, 0) * coalesce(cn.n, 0) = 0 THEN 0.0 ELSE round(coalesce(dot, 0) / (sqrt(qn.n::DOUBLE) * sqrt(cn.n::DOUBLE)), 6) END AS cosine FROM qv CROSS JOIN chunks c LEFT JOIN dots d ON d.id = qv.id AND d.variant = qv.variant AND d.chunk_id = c.chunk_id LEFT JOIN qn ON qn.id = qv.id AND qn.variant = qv.variant LEFT JOIN cn ON cn.chunk_id = c.chunk_id)) WHERE r <= depth),
pool AS ({pool}),
scaled AS (SELECT *, {semantic} AS s0, CASE WHEN max(b) OVER w - min(b) OVER w <= 1e-9 THEN 1.0 ELSE (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) END AS kw FROM (SELECT p.*, n.cosine, coalesce(bm.bm25, 0.0) AS b FROM pool p LEFT JOIN near n USING (id, variant, chunk_id) LEFT JOIN bm USING (id, variant, chunk_id)) WINDOW w AS (PARTITION BY id, variant)),
found AS (SELECT id, chunk_id, source, round({score}, 6) AS score, 1 AS origin FROM (SELECT s.*, c.source, p.kind, p.must, x.forced, CASE WHEN s.cosine IS NULL THEN 0.0 ELSE coalesce(s0, 0.0) END AS sem, CASE WHEN list_has_any(p.numbers, (SELECT list(number) FROM own WHERE own.chunk_id = c.chunk_id)) THEN 1.0 ELSE 0.0 END AS boost
  FROM scaled s JOIN chunks c USING (chunk_id) JOIN specs x USING (id, variant) JOIN plan p USING (id)) WHERE (forced IS NULL OR source = forced) AND (must IS NULL OR source = must) {seeded}),
best AS (SELECT f.*, p.sources, p.diversify FROM (SELECT *, row_number() OVER (PARTITION BY id, source, chunk_id ORDER BY score DESC, origin) AS x FROM found) f JOIN plan p USING (id) WHERE x = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS r, row_number() OVER (PARTITION BY id, source ORDER BY score DESC, chunk_id) AS s, CASE WHEN diversify THEN len(sources) ELSE 1 END AS n_sources FROM best)
SELECT id, rank, chunk_id, source, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY CASE WHEN r = 1 OR n_sources < 2 THEN 0 WHEN list_contains(sources, source) AND s <= greatest(1, 5 // n_sources) THEN 1 ELSE 2 END, r) AS INTEGER) AS rank FROM placed) WHERE rank <= 5"""


@query(f"WITH {_planned('routed_hybrid')} SELECT id, variant, forced FROM specs")
def source_variants(t):
    """What a routed search looks up: variants, and the question for each source of a diversified route."""
    return retrieval.variant_specs(retrieval.planned(items(t).select("id", "question"), "routed_hybrid", 5, 1))


@query(_searched("hybrid"))
def retrieve_hybrid(t):
    return retrieval.search(items(t), t("chunks"), "hybrid")


@query(_searched("routed_hybrid"))
def retrieve_routed_hybrid(t):
    return retrieval.search(items(t), t("chunks"), "routed_hybrid")


@query(_searched("faiss_only"))
def retrieve_dense(t):
    return retrieval.search(items(t), t("chunks"), "faiss_only")


@query(_searched("bm25_only"))
def retrieve_bm25(t):
    return retrieval.search(items(t), t("chunks"), "bm25_only")


@query(f"""
WITH {BM25}, top AS (SELECT * FROM (SELECT id, chunk_id, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 60)
SELECT id, CAST(count(*) AS BIGINT) AS n_candidates, round(max(score), 6) AS best FROM top GROUP BY id""")
def bm25_candidates(t):
    """How many of the at most 60 keyword candidates each question has, and the best score."""
    found = lexical.best(lexical.query_terms(items(t), "id", "question"), lexical.weighted(t("chunks"), "chunk_id", "text"), "id", "chunk_id", 60)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n_candidates"), F.round(F.max("score"), 6).alias("best"))
