"""Scoring, fusion, merging and diversification of candidates; the whole search as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lekhya.functions import text as tx
from lekhya.operators import lexical, meetings, routing
from lekhya.plans import cut

K, FLAT = 5, 1e-9


def search_depth(k: Column | int, n: Column | int, wide: Column) -> Column:
    """Over-fetch: 12 k for a diversified or constrained search, else 6 k; at least k, at most the corpus."""
    k, n = (F.lit(x) if isinstance(x, int) else x for x in (k, n))
    return F.least(F.greatest(k * F.when(wide, 12).otherwise(6), k), n)


def minmax(c: Column, over: list[str]) -> Column:
    """``c`` scaled to 0..1 over its group; all 1 when the group has no span."""
    w = Window.partitionBy(*over)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high - low <= FLAT, 1.0).otherwise((c - low) / (high - low))


def fused(mode: Column, kind: Column, semantic: Column, keyword: Column, boost: Column) -> Column:
    """Raw semantic score, keyword score, the boosted section form, or the alpha mix with a tenth of the boost."""
    a = routing.alpha(mode, kind)
    semantic, keyword, boost = (F.coalesce(x, F.lit(0.0)) for x in (semantic, keyword, boost))
    return F.when(mode == "faiss_only", semantic).when(mode == "bm25_only", keyword).when((kind == "section_lookup") & (boost > 0), 0.15 * semantic + 0.25 * keyword + 0.60).otherwise(a * semantic + (1 - a) * keyword + 0.10 * boost)


def merged(candidates: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """The best-scored row of each ``by``, the first in ``tie`` order among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *tie)
    return candidates.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def diversified(ranked: DataFrame, qkey: str, key: str, n_sources: Column, is_routed: Column, k: int = K) -> DataFrame:
    """First k of each query, balanced over its routed sources: the best stays first, then up to max(1, k // n) a routed source, then the rest in order. With fewer than two routed sources the plain order holds."""
    r = F.row_number().over(Window.partitionBy(qkey).orderBy(F.desc("score"), F.asc(key)))
    s = F.row_number().over(Window.partitionBy(qkey, "source").orderBy(F.desc("score"), F.asc(key)))
    quota = F.greatest(F.lit(1), F.floor(F.lit(k) / n_sources))
    placed = ranked.withColumn("__r", r).withColumn("__s", s)
    phase = F.when((F.col("__r") == 1) | (n_sources < 2), 0).when(is_routed & (F.col("__s") <= quota), 1).otherwise(2)
    order = Window.partitionBy(qkey).orderBy("__phase", "__r")
    return placed.withColumn("__phase", phase).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("__r", "global_rank").drop("__s", "__phase")


def seeds(mentions: DataFrame, sections: DataFrame, qkey: str, key: str) -> DataFrame:
    """Exact section matches: ``mentions`` (qkey, mention_rank from 0, number) on ``sections`` (key, number); first mention counts, score max(0.80, 1 - 0.05 rank)."""
    hit = mentions.join(sections, "number").groupBy(qkey, key).agg(F.min("mention_rank").alias("mention_rank"))
    return hit.withColumn("score", F.round(F.greatest(F.lit(0.80), 1.0 - 0.05 * F.col("mention_rank")), 6))


#: Queries or texts of a list at most, where classes of them are paired.
MEMBERS = 512


def classed(rows: DataFrame, key: str, *label: str) -> tuple[DataFrame, DataFrame]:
    """(class, label...) of the distinct sets of labels, and (class, members): the keys that have such a set, in lists of about ``MEMBERS`` at most."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*label))).alias("labels")).withColumn("class", F.xxhash64("labels"))
    sizes = cut(sets.groupBy("class").agg(F.first("labels").alias("labels"), F.ceil(F.count(F.lit(1)) / MEMBERS).alias("lists")))
    dealt = sets.select(key, "class").join(sizes.select("class", "lists"), "class").groupBy("class", F.pmod(F.xxhash64(key), F.col("lists"))).agg(F.collect_list(key).alias("members"))
    return sizes.select("class", F.explode("labels").alias("label")).select("class", "label.*"), dealt.select("class", "members")


def all_seeds(mentions: DataFrame, sections: DataFrame, qkey: str, key: str) -> DataFrame:
    """``seeds``, where every pair is a row of the result: sets of labels recur, so what is joined, scored and shuffled are
    pairs of sets, and their members unfold to rows only where these are written."""
    (asked, askers), (own, owners) = classed(mentions, qkey, "number", "mention_rank"), classed(sections, key, "number")
    pairs = seeds(asked.withColumnRenamed("class", "q"), own.withColumnRenamed("class", "t"), "q", "t")
    lists = pairs.join(askers.toDF("q", "qs"), "q").join(owners.toDF("t", "ts"), "t").drop("q", "t")
    dealt = cut(lists.repartition(16 * mentions.sparkSession.sparkContext.defaultParallelism))  # small as input, so it would go to few tasks
    return dealt.select(F.explode("qs").alias(qkey), "ts", "mention_rank", "score").select(qkey, F.explode("ts").alias(key), "mention_rank", "score")


def first_of_sections(sections: DataFrame, k: int) -> DataFrame:
    """(chunk_id, number) of ``sections`` (chunk_id, source, number) that can be among the k best seeds of all or of a routed source.

    Behind the k smallest chunk_id of a number, a chunk has k others before it that score at least as much, so no result loses a row.
    """
    ids = F.array_distinct(F.array_sort(F.flatten(F.collect_list("ids"))))
    of_source = sections.groupBy("number", "source", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).agg(F.slice(F.array_sort(F.collect_set("chunk_id")), 1, k).alias("ids"))
    of_source = of_source.groupBy("number", "source").agg(F.slice(ids, 1, k).alias("ids"))
    of_all = of_source.groupBy("number").agg(F.slice(ids, 1, k).alias("ids"))
    kept = of_source.filter(F.col("source").isin(*routing.SOURCES)).select("number", "ids").unionByName(of_all)
    return kept.select("number", F.explode("ids").alias("chunk_id")).distinct()


def variant_specs(plan: DataFrame) -> DataFrame:
    """(id, variant, forced): what is looked up for each question of ``plan`` (id, question, sources, diversify): its variants, and the question again for each source of a diversified route, whose other results are left out."""
    told = plan.withColumn("__q", F.coalesce("question", F.lit("")))
    plain = told.select("id", F.explode(routing.variants(F.col("__q"))).alias("variant"), F.lit(None).cast("string").alias("forced"))
    conditioned = told.filter("diversify").select("id", F.col("__q").alias("variant"), F.explode("sources").alias("forced"))
    return plain.unionByName(conditioned).distinct()


def planned(questions: DataFrame, mode: str, k: int, n: int) -> DataFrame:
    """A row per question (id not null, the smallest text of an id): route, constraint, kind, mentioned sections and depth of the search."""
    asked = questions.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("question").alias("question"))
    routed = routing.routes(asked.select(F.struct("id", "question").alias("row"), "question"), "row", "question").withColumn("must", routing.constraint(F.lit(mode))).select("row.*", "*")
    text = F.coalesce("question", F.lit(""))
    told = routed.withColumn("kind", routing.query_type(text)).withColumn("numbers", routing.mentioned_sections(text)).withColumn("diversify", F.col("diversify") & F.lit(mode == "routed_hybrid"))
    return told.withColumn("depth", search_depth(k, n, F.col("diversify") | F.col("must").isNotNull())).select("id", "question", "kind", "numbers", "must", "depth", "sources", "diversify")


def search(questions: DataFrame, chunks: DataFrame, mode: str, k: int = K) -> DataFrame:
    """The whole search of ``questions`` (id, question) over ``chunks`` in one plan: id, rank, chunk_id, source, score.

    Each variant of a question, and the question for each source of a diversified route, is searched (once where the terms are the same): dense candidates
    (hashed stand-in vectors) and keyword candidates are cut at the over-fetch depth, scaled over the candidates of that
    variant, fused, and filtered by source. The best row of a chunk counts, exact section seeds included; multi-source
    routes are diversified. Unknown modes raise. Null and empty questions have no keyword candidates; an empty corpus
    gives no rows. Null ids are left out.
    """
    if mode not in routing.MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    texts = chunks.withColumn("chunk_id", F.col("chunk_id").cast("long"))
    n = texts.count()
    plan = cut(planned(questions.select("id", "question"), mode, k, n))
    terms = tx.terms(F.col("variant"))
    same = F.xxhash64(F.array_sort(terms), "kind", "depth", "numbers")  # texts of the same terms find the same
    specs = cut(variant_specs(plan).join(plan.select("id", "kind", "depth", "numbers"), "id").withColumn("qid", same))
    classes = cut(specs.dropDuplicates(["qid"]).select("qid", terms.alias("terms"), lexical.asked_terms(F.col("variant"), context=F.col("kind")).alias("asked"), F.array() if mode == "faiss_only" else "numbers", "depth", "kind").toDF("qid", "terms", "asked", "numbers", "depth", "kind"))
    labels = F.when(F.size("dafa_list") > 0, F.col("dafa_list")).otherwise(F.array("dafa"))
    known = cut(texts.select("chunk_id", "source", F.array_compact(F.array_distinct(F.transform(labels, tx.section_number))).alias("own"), tx.terms(F.col("text")).alias("terms")))
    scored = cut(meetings.scored(classes, known.select("chunk_id", "terms", F.col("own").alias("numbers"), "source"), mode, k))
    full = scored.join(known.select("chunk_id", "source"), "chunk_id").join(specs.select("id", "qid", "forced").distinct(), "qid").filter(F.col("forced").isNull() | (F.col("source") == F.col("forced"))).join(plan.select("id", "must"), "id")
    found = full.filter(F.col("must").isNull() | (F.col("source") == F.col("must"))).select("id", "chunk_id", "source", "score", F.lit(1).alias("origin"))
    if mode in ("hybrid", "routed_hybrid"):
        mentions = plan.filter("kind = 'section_lookup'").select("id", F.posexplode("numbers").alias("mention_rank", "number"))
        direct = seeds(mentions, first_of_sections(known.select("chunk_id", "source", F.explode("own").alias("number")), k), "id", "chunk_id").join(known.select("chunk_id", "source"), "chunk_id").join(plan.select("id", "must"), "id")
        found = found.unionByName(direct.filter(F.col("must").isNull() | (F.col("source") == F.col("must"))).select("id", "chunk_id", "source", "score", F.lit(0).alias("origin")))
    best = merged(found, ["id", "source", "chunk_id"], ["origin"]).join(plan.select("id", "sources", "diversify"), "id")
    n_sources = F.when(F.col("diversify"), F.size("sources")).otherwise(F.lit(1))
    return diversified(best, "id", "chunk_id", n_sources, F.array_contains(F.col("sources"), F.col("source")), k).select("id", "rank", "chunk_id", "source", "score")
