"""BM25 over postings kept as ordinary tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.functions import text as tx
from lekhya.plans import cut

K1, B = 1.5, 0.75
#: Queries or texts of a block.
BLOCK = 1024
#: Nepali and English function words left out of queries.
STOP_WORDS = tuple("र वा को का की के मा ले लाई छ हो पनि भने यो त्यो अनि तथा the of and or a an in is to for".split())


#: More words left out by what a question asks for: they say which kind it is, not what it is about.
CONTEXT_STOP_WORDS = {"section_lookup": tuple("दफा section के कुन which".split()), "definition": tuple("भनेको के हो अर्थ परिभाषा what define definition meaning".split()), "general": tuple("कसरी कहिले how when".split())}


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf): counted in each task before the shuffle."""
    return texts.select(key, F.explode(tx.terms(F.col(text))).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def lengths(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.size(tx.terms(F.col(text))).cast("long").alias("dl"))


def asked_terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, context: Column | None = None) -> Column:
    """The distinct terms of a query without stop words, and without those of its ``context`` (``CONTEXT_STOP_WORDS``) if one is given."""
    more = None
    for name, words in CONTEXT_STOP_WORDS.items() if context is not None else ():
        more = F.when(context == name, F.array(*map(F.lit, words))) if more is None else more.when(context == name, F.array(*map(F.lit, words)))
    terms = F.array_distinct(tx.terms(text))
    if more is not None:
        terms = F.array_except(terms, F.coalesce(more, F.array().cast("array<string>")))
    return F.filter(terms, lambda x: ~x.isin(*stop_words))


def query_terms(queries: DataFrame, key: str, text: str, stop_words: tuple[str, ...] = STOP_WORDS, context: Column | None = None) -> DataFrame:
    """(key, term): ``asked_terms`` of each query."""
    return queries.select(key, F.explode(asked_terms(F.col(text), stop_words, context)).alias("term")).distinct()


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weighted(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, weight): each posting with its BM25 weight, so that a score is a sum of weights. Corpus statistics are one row."""
    posted = postings(texts, key, text)
    sized = lengths(texts, key, text)
    stats = sized.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    part = idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return posted.join(df, "term").join(sized, key).join(F.broadcast(stats)).select("term", key, part.alias("weight"))


def pair_scores(pairs: DataFrame, asked: DataFrame, weights: DataFrame, qkey: str, key: str) -> DataFrame:
    """(qkey, key, score) of given pairs, 0 without a common term, rounded to six digits."""
    part = pairs.join(asked, qkey).join(weights, [key, "term"]).groupBy(qkey, key).agg(F.round(F.sum("weight"), 6).alias("score"))
    return pairs.join(part, [qkey, key], "left").select(qkey, key, F.coalesce("score", F.lit(0.0)).alias("score"))


def best(asked: DataFrame, weights: DataFrame, qkey: str, key: str, k: int, block: int = BLOCK, written: bool = False) -> DataFrame:
    """The k best of each query by score, ties by key, with ``rank`` from 1; only pairs with a common term.

    Blocks of queries meet blocks of texts. A meeting adds the weights of a block's postings for all its queries at once
    and keeps k a query, so frequent terms cost additions in memory, and what is shuffled is k rows per query and block.
    The result is exact. Both inputs are counted and read again, so they are written once unless they are ``written``.
    """
    if not written:
        asked, weights = cut(asked), cut(weights)

    def blocked(rows: DataFrame, by: str, **lists: str) -> DataFrame:
        """Blocks of ``block`` keys, a partition each, so that meetings are as many tasks as there are."""
        n = max(1, -(-rows.select(by).distinct().count() // block))
        dealt = rows.withColumn("b", F.pmod(F.xxhash64(by), F.lit(n))).repartition(n, "b")
        return dealt.groupBy("b").agg(*(F.collect_list(c).alias(name) for name, c in lists.items())).drop("b")

    texts, queries = blocked(weights, key, keys=key, terms="term", weights="weight"), blocked(asked, qkey, ids=qkey, asked="term")
    kinds = asked.schema[qkey].dataType, weights.schema[key].dataType

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, scores = met(*(batch.column(c)[i].values for c in ("ids", "asked", "keys", "terms", "weights")), k)
                if len(scores):
                    yield pa.RecordBatch.from_arrays([ids, keys, pa.array(scores)], names=[qkey, key, "score"])

    schema = T.StructType([T.StructField(qkey, kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType())])
    return top(queries.crossJoin(texts).mapInArrow(meet, schema), qkey, key, k)  # of blocks


#: Cells of the score table a meeting holds at a time.
CELLS = 1 << 22


def met(ids: pa.Array, asked: pa.Array, keys: pa.Array, terms: pa.Array, weights: pa.Array, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(query, text, score) of the k best of each query, ties by key: ``ids`` and ``asked`` are the queries' terms, ``keys``, ``terms`` and ``weights`` the postings."""
    names, query = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    texts, place = np.unique(np.asarray(keys), return_inverse=True)
    coded = terms.dictionary_encode()
    order = np.argsort(codes := np.asarray(coded.indices), kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    place, weight = place[order], np.asarray(weights)[order]
    at = pc.fill_null(pc.index_in(asked, coded.dictionary), -1).to_numpy()
    query, at = query[at >= 0], at[at >= 0]
    order = np.argsort(query, kind="stable")
    query, at = query[order], at[order]
    rows = max(1, CELLS // max(1, len(texts)))
    found = []
    for b in range(0, len(names), rows):
        low, high = np.searchsorted(query, (b, b + rows))
        n = min(rows, len(names) - b)
        width = ends[at[low:high] + 1] - ends[at[low:high]]
        postings = np.repeat(ends[at[low:high]] - np.cumsum(width) + width, width) + np.arange(width.sum())
        cells = np.repeat(query[low:high] - b, width) * len(texts) + place[postings]
        total = np.round(np.bincount(cells, weights=weight[postings], minlength=n * len(texts)), 6).reshape(n, len(texts))
        if len(texts) > k:
            kth = np.partition(total, len(texts) - k, axis=1)[:, len(texts) - k]
            q, t = np.nonzero((total >= kth[:, None]) & (total > 0))
        else:
            q, t = np.nonzero(total > 0)
        s = total[q, t]
        order = np.lexsort((texts[t], -s, q))
        q, t, s = q[order], t[order], s[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        found.append((q[first] + b, t[first], s[first]))
    q, t, s = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    return pa.array(names[q], ids.type), pa.array(texts[t], keys.type), s


def top(scored: DataFrame, qkey: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query by score, ties by key, with ``rank`` from 1."""
    order = Window.partitionBy(qkey).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
