"""Exact inner-product search, in blocks."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.functions import text as tx

#: Vectors of a block: queries and vectors meet block by block, never row by row.
BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """``v`` at length one; a null vector stays null, a zero one zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def _blocks(vectors: DataFrame, key: str, vector: str, name: str, size: int) -> DataFrame:
    n = vectors.count()
    parts = max(1, -(-n // size))
    return vectors.filter(F.col(vector).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("__b")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias(name)).select(name)


def top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k nearest other vectors of each query by inner product, exact.

    Blocks of queries meet blocks of vectors; each meeting is one matrix product that keeps k a query, so what is
    shuffled is k rows per query and block. Scores are rounded to six digits, ties go to the smaller key.
    """
    pairs = _blocks(queries, key, vector, "q", block).crossJoin(_blocks(vectors, key, vector, "d", block))  # of blocks

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, d in zip(batch["q"], batch["d"]):
                qi, di = np.array([x["id"] for x in q]), np.array([x["id"] for x in d])
                s = np.round(np.array([x["v"] for x in q], dtype=np.float64) @ np.array([x["v"] for x in d], dtype=np.float64).T, 6)
                s[qi[:, None] == di[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(di, s.shape), -s), axis=1)[:, : k]
                kept = np.take_along_axis(s, order, axis=1)
                out = pd.DataFrame({"query_id": np.repeat(qi, order.shape[1]), key: di[order].ravel(), "score": kept.ravel()})
                yield out[np.isfinite(out["score"])]

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField(key, T.LongType()), T.StructField("score", T.DoubleType())])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return pairs.mapInPandas(meet, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


HASHED_WIDTH = 64


@functools.lru_cache(maxsize=1 << 16)
def slot(term: str) -> tuple[int, float]:
    """Slot and sign of a term by its MD5 sum."""
    digest = hashlib.md5(term.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
    return digest[0] % HASHED_WIDTH, 1.0 if digest[1] < 128 else -1.0


def counts(words: list[str]) -> np.ndarray:
    """Signed term counts by slot."""
    slots = [slot(w) for w in words]
    return np.bincount([b for b, _ in slots], weights=[s for _, s in slots], minlength=HASHED_WIDTH) if slots else np.zeros(HASHED_WIDTH)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        out = []
        for words in lists:
            v = counts(words)
            n = float(np.sqrt(v @ v))
            out.append(v / n if n else v)
        yield pd.Series(out)


def hashed_vector(c: Column) -> Column:
    """A deterministic stand-in for a text encoder: signed term counts at length one, a term's slot and sign by its MD5 sum; zero for null texts and texts without terms."""
    return _hashed(tx.terms(F.coalesce(c, F.lit(""))))


@F.pandas_udf(T.BinaryType())
def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed term counts of a list of terms, 32-bit whole numbers: the stand-in vector before it is brought to length one."""
    for lists in batches:
        yield pd.Series([counts(words).astype(np.int32).tobytes() for words in lists])
