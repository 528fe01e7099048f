"""Candidates of composed searches: a block of queries meets all texts in one task, which keeps what may still count."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.operators import dense, lexical, routing

#: Queries of a block at most; queries and texts whose scores are a table at a time, small enough for the caches.
BLOCK, ROWS, TEXTS = 1 << 15, 512, 2048
#: A term is added as part of a matrix product, not posting by posting, if this share of the cells is touched by it.
DENSE = 0.003
#: What a cosine of at most a few hundred slots, or a weight, may lose in single precision: absolute and relative, a sum of weights once for each.
LOST, LOST_EACH = 1e-5, 1.2e-7
#: Postings of passed texts that are remembered until the weights of the rows kept are added exactly.
STORED = 1 << 23
KINDS = ("section_lookup", "definition", "general")
FLAT = 1e-9


def hashed(c: Column) -> Column:
    return F.transform(c, lambda x: F.xxhash64(x))


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero, as SQL rounds."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def scored(classes: DataFrame, texts: DataFrame, mode: str, k: int) -> DataFrame:
    """(qid, chunk_id, score): of the candidates of each query, the ``k`` best of all and the ``k`` best of each of ``routing.SOURCES``.

    ``classes`` is (qid, terms, asked, numbers, depth, kind), ``texts`` is (chunk_id, terms, numbers, source); ``terms`` are all
    words, ``asked`` the distinct ones that count for BM25. Each text passes once by every block of queries, so what is shuffled is
    the texts for each block, and rows of results only. The result is exact.
    """
    n, avgdl = texts.agg(F.count(F.lit(1)), F.avg(F.size("terms"))).first()
    spark = texts.sparkSession
    q = classes.count()
    tasks = spark.sparkContext.defaultParallelism
    blocks = max(1, min(tasks, -(-q // ROWS)), tasks * -(-q // (tasks * BLOCK)) if q > tasks * BLOCK else 0)  # all tasks end together
    none, empty = F.lit(None).cast("binary"), F.array().cast("array<long>")
    side = F.coalesce(*(F.when(F.col("source") == s, i) for i, s in enumerate(routing.SOURCES)), F.lit(-1))
    kind = F.coalesce(*(F.when(F.col("kind") == s, i) for i, s in enumerate(KINDS)))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    df = texts.select(F.explode(hashed(F.array_distinct("terms"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n"))
    known = df.select(everywhere, F.lit(0).alias("part"), "key", empty.alias("terms"), none.alias("vec"), empty.alias("numbers"), "n", F.lit(0).alias("kind"))
    queries = classes.select(F.pmod("qid", F.lit(blocks)).cast("int").alias("b"), F.lit(1), "qid", hashed(F.col("asked")), dense.counted(F.col("terms")), hashed(F.col("numbers")), F.col("depth").cast("int"), kind)
    passing = texts.select("chunk_id", hashed(F.col("terms")).alias("terms"), dense.counted(F.col("terms")).alias("vec"), hashed(F.col("numbers")).alias("numbers"), side.alias("side"))
    passing = passing.select(everywhere, F.lit(2), "chunk_id", "terms", "vec", "numbers", "side", F.lit(0))
    met = known.union(queries).union(passing).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "part")
    return met.mapInArrow(_meeting(mode, k, n, avgdl), "qid long, chunk_id long, score double")


def _meeting(mode: str, k: int, n: int, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, meeting = None, None
        for batch in batches:
            b, part = (batch.column(c).to_numpy() for c in ("b", "part"))
            ends = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (part[1:] != part[:-1])) + 1), len(b)] if len(b) else [0]
            for low, high in zip(ends, ends[1:]):
                if b[low] != at:
                    if meeting:
                        yield from meeting.results()
                    at, meeting = b[low], Meeting(mode, k, n, avgdl)
                meeting.take(part[low], batch.slice(low, high - low))
        if meeting:
            yield from meeting.results()

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values."""
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy()


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _ranges(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from ``low``, ``width`` each, behind one another."""
    starts = np.cumsum(width) - width
    return np.repeat(low - starts, width) + np.arange(starts[-1] + width[-1] if len(width) else 0)


def _coded(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of ``values`` in sorted ``known``, -1 for others."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _first(q: np.ndarray) -> np.ndarray:
    """Rank from 0 within equal neighbours of sorted ``q``."""
    return np.arange(len(q)) - np.searchsorted(q, q)


def _reaching(x: np.ndarray, limit: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells of ``x`` that reach the limit of their row; ``flags`` is room for them."""
    there = np.greater_equal(x, limit[:, None].astype(x.dtype), out=flags[: x.size].reshape(x.shape)).reshape(-1)
    whole = len(there) // 8 * 8
    at = (np.flatnonzero(there[:whole].view(np.uint64) != 0)[:, None] * 8 + np.arange(8)).reshape(-1)  # few reach it, so eight are looked at at once
    return np.divmod(np.concatenate([at[there[at]], whole + np.flatnonzero(there[whole:])]), x.shape[1])


class Kept:
    """The best rows of each query of a table so far, as columns q, key, score and more; ``limit`` is what a row must reach, -inf while any may.

    Scores may be less than exact by the share ``slack`` of them until they are settled at last.
    """

    def __init__(self, depth: np.ndarray, more: int, slack: np.ndarray | None = None):
        self.slack = slack
        self.depth, self.rows, self.pending, self.n = depth, [np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * (1 + more)], [], 0
        self.limit = np.full(len(depth), -np.inf)

    def add(self, *columns: np.ndarray) -> None:
        self.pending.append(columns)
        self.n += len(columns[0])
        if 2 * self.n > len(self.rows[0]):
            self.settle()

    def settle(self, last: bool = False) -> None:
        """Rows under the limit go; equal ones at the limit are told apart by key only at last, or where they are many and exact."""
        if not (self.n or last):
            return
        rows = [np.concatenate(x) for x in zip(self.rows, *self.pending)]
        place = (rows[0] << 48) - np.rint(rows[2] * 1e6).astype(np.int64)  # scores have six digits
        order = np.lexsort((rows[1], place)) if last else np.argsort(place)
        q = rows[0][order]
        rank = _first(q)
        at = order[rank == self.depth[q] - 1]
        self.limit[rows[0][at]] = rows[2][at] if self.slack is None else rows[2][at] * (1 - 2 * self.slack[rows[0][at]]) - 4e-6
        kept = order[rank < self.depth[q]] if last else order[rows[2][order] >= self.limit[q]]
        self.rows, self.pending, self.n = [x[kept] for x in rows], [], 0
        if self.slack is None and not last and self.crowded():
            self.settle(True)

    def crowded(self) -> bool:
        """More rows stay than twice those that count, as many are equal."""
        return len(self.rows[0]) > 2 * self.depth.sum()


class Meeting:
    """A block of queries and the texts that pass by."""

    def __init__(self, mode: str, k: int, n: int, avgdl: float):
        self.mode, self.k, self.n, self.avgdl = mode, k, n, avgdl
        self.parts: tuple[list, list, list] = [], [], []
        self.waiting, self.size = 0, TEXTS
        self.tables: list | None = None
        self.room = np.empty((2, ROWS * TEXTS), np.float32)
        self.flags = np.empty(ROWS * TEXTS, bool)
        self.stored: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.passed_by = 0

    def take(self, part: int, rows: pa.RecordBatch) -> None:
        self.parts[part].append(rows)
        if part == 2:
            self.waiting += rows.num_rows
            if self.waiting >= self.size:
                self.meet()

    def begin(self) -> None:
        known = pa.Table.from_batches(self.parts[0]) if self.parts[0] else None
        keys, dfs = (known.column(c).to_numpy() for c in ("key", "n")) if known else (np.zeros(0, np.int64),) * 2
        order = np.argsort(keys)
        keys, dfs = keys[order], dfs[order]
        asked = pa.Table.from_batches(self.parts[1]).combine_chunks().to_batches()[0]
        self.ids, self.depth, self.kind = (asked.column(c).to_numpy() for c in ("key", "n", "kind"))
        q = len(self.ids)
        width, terms = _lists(asked.column("terms"))
        at = _coded(terms, keys)
        used, code = np.unique(at[at >= 0], return_inverse=True)
        self.terms, df = keys[used], dfs[used].astype(np.float64)
        self.query, self.code = np.repeat(np.arange(q), width)[at >= 0], code
        self.idf = np.log(1 + (self.n - df + 0.5) / (df + 0.5))
        slack = LOST_EACH * (np.bincount(self.query, minlength=q) + 4)
        self.heavy = np.bincount(code, minlength=len(used)) / q * df / self.n > DENSE
        self.column = np.cumsum(self.heavy) - 1
        width, numbers = _lists(asked.column("numbers"))
        self.number_names, number = np.unique(numbers, return_inverse=True)
        self.numbers = np.unique(np.repeat(np.arange(q), width) * max(1, len(self.number_names)) + number)
        self.vectors, self.norm, self.unit = self.read(asked)
        self.tables = [(low, min(q, low + ROWS), Kept(self.depth[low : low + ROWS], 4), Kept(self.depth[low : low + ROWS], 3, slack[low : low + ROWS])) for low in range(0, q, ROWS)]
        self.parts[0].clear()

    def meet(self) -> None:
        """All queries meet the waiting texts."""
        if not self.parts[1]:
            self.parts[2].clear()
            return
        if self.tables is None:
            self.begin()
        for rows in pa.Table.from_batches(self.parts[2]).combine_chunks().to_batches():
            for low in range(0, rows.num_rows, self.size):
                self.passed(rows.slice(low, self.size))
        self.parts[2].clear()
        self.waiting = 0

    @staticmethod
    def read(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of whole numbers, their lengths, and the vectors at length one in single precision."""
        vectors = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.int32).reshape(rows.num_rows, -1).astype(np.float64)
        norm = np.sqrt((vectors * vectors).sum(1))
        return vectors, norm, (vectors / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)

    def passed(self, texts: pa.RecordBatch) -> None:
        """All queries meet ``texts``: cells are told in single precision, and those that may count once more exactly."""
        keys, side = texts.column("key").to_numpy(), texts.column("n").to_numpy()
        n = len(keys)
        dl, words = _lists(texts.column("terms"))
        code = _coded(words, self.terms)
        cell, tf = np.unique(np.repeat(np.arange(n), dl)[code >= 0] * len(self.terms) + code[code >= 0], return_counts=True)
        place, code = np.divmod(cell, max(1, len(self.terms)))
        weight = self.idf[code] * tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * dl[place] / self.avgdl))
        held = np.bincount(place, minlength=n)
        often = self.heavy[code]
        matrix = np.zeros((int(self.heavy.sum()), n), np.float32)
        matrix[self.column[code[often]], place[often]] = weight[often]
        order = np.argsort(code, kind="stable")
        order = order[~often[order]]
        ends, posted, added = np.searchsorted(code[order], np.arange(len(self.terms) + 1)).astype(np.int32), place[order].astype(np.int32), weight[order].astype(np.float32)
        own_width, own = _lists(texts.column("numbers"))
        own, own_starts = _coded(own, self.number_names), _starts(own_width)
        vectors, norm, unit = self.read(texts)
        turned = np.ascontiguousarray(unit.T)

        def boost(q: np.ndarray, t: np.ndarray) -> np.ndarray:
            found = np.zeros(len(q))
            pair = np.repeat(np.arange(len(q)), own_width[t])
            number = own[_ranges(own_starts[t], own_width[t])]
            pair, number = pair[number >= 0], number[number >= 0]
            found[pair[np.isin(q[pair] * len(self.number_names) + number, self.numbers)]] = 1
            return found

        for low, high, near, lexis in self.tables:
            table = high - low
            close = np.matmul(self.unit[low:high], turned, out=self.room[0, : table * n].reshape(table, n))
            limit = near.limit - LOST
            if not len(near.rows[0]) and n > (k := int(near.depth.max())):
                limit = np.partition(close, n - k, axis=1)[:, n - k] - 2 * LOST
            q, t = _reaching(close, limit, self.flags)
            length = self.norm[low + q] * norm[t]
            dot = np.einsum("ij,ij->i", self.vectors[low + q], vectors[t])
            cosine = rounded(np.divide(dot, length, out=np.zeros(len(q)), where=length > 0))
            sure = cosine >= near.limit[q]
            q, t, cosine = q[sure], t[sure], cosine[sure]
            if self.mode == "faiss_only":
                if len(q):
                    near.add(q, keys[t], cosine, np.zeros(len(q)), np.full(len(q), -1.0), side[t].astype(np.float64), np.zeros(len(q)))
                continue

            if len(q):
                near.add(q, keys[t], cosine, np.zeros(len(q)), self.passed_by + t, side[t].astype(np.float64), boost(low + q, t))
            a, z = np.searchsorted(self.query, (low, high))
            query, term = self.query[a:z] - low, self.code[a:z]
            dense_one = self.heavy[term]
            there = np.zeros((table, len(matrix)), np.float32)
            there[query[dense_one], self.column[term[dense_one]]] = 1
            total = np.matmul(there, matrix, out=self.room[1, : table * n].reshape(table, n))
            query, term = query[~dense_one], term[~dense_one]
            width = ends[term + 1] - ends[term]
            held_here = np.flatnonzero(width)
            query, term, width = query[held_here], term[held_here], width[held_here]
            postings = _ranges(ends[term], width)
            np.add.at(total.reshape(-1), np.repeat(query * n, width) + posted.take(postings), added.take(postings))
            limit = lexis.limit
            if not len(lexis.rows[0]) and n > (k := int(lexis.depth.max())):
                limit = np.partition(total, n - k, axis=1)[:, n - k] * (1 - 2 * lexis.slack) - 4e-6
            q, t = _reaching(total, np.maximum(limit, 1e-30), self.flags)
            if len(q):
                lexis.add(q, keys[t], total[q, t].astype(np.float64), self.passed_by + t, side[t].astype(np.float64), boost(low + q, t))
        if self.mode != "faiss_only":
            self.stored.append((held, code.astype(np.int32), weight))
            self.passed_by += n
            if sum(len(x[1]) for x in self.stored) > STORED or any(lexis.crowded() for *_, lexis in self.tables):
                self.add_exactly()

    def add_exactly(self) -> None:
        """The weights of all rows kept are added in double precision, once each; the texts are forgotten then."""
        held, code, weight = (np.concatenate(x) for x in zip(*self.stored))
        starts, local = _starts(held), np.zeros(len(self.terms), np.int32)
        for low, high, near, lexis in self.tables:
            a, z = np.searchsorted(self.query, (low, high))
            used, column = np.unique(self.code[a:z], return_inverse=True)
            local[used] = np.arange(1, len(used) + 1)
            asked = np.zeros((high - low, len(used) + 1), bool)
            asked[self.query[a:z] - low, column + 1] = True
            for kept, score in ((near, 3), (lexis, 2)):
                kept.settle()
                new = np.flatnonzero(kept.rows[score + 1] >= 0)
                for part in np.array_split(new, len(new) // 4096 + 1):
                    q, t = kept.rows[0][part], kept.rows[score + 1][part].astype(np.int64)
                    width = held[t]
                    at = _ranges(starts[t], width)
                    hit = np.flatnonzero(asked.reshape(-1)[np.repeat(q * asked.shape[1], width) + local[code[at]]])
                    kept.rows[score][part] = rounded(np.bincount(np.repeat(np.arange(len(q)), width)[hit], weight[at[hit]], minlength=len(q)))
                kept.rows[score + 1][new] = -1
                if kept.crowded():
                    kept.settle(True)
            local[used] = 0
        self.stored, self.passed_by = [], 0

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            self.meet()
        if self.stored:
            self.add_exactly()
        for low, _, near, lexis in self.tables or ():
            near.settle(True)
            lexis.settle(True)
            q, key, cosine, bm25, _, side, boost = near.rows
            if self.mode != "faiss_only":
                wq, wkey, wbm25, _, wside, wboost = lexis.rows
                q, key, cosine = np.concatenate([q, wq]), np.concatenate([key, wkey]), np.concatenate([cosine, np.full(len(wq), np.nan)])
                bm25, side, boost = np.concatenate([bm25, wbm25]), np.concatenate([side, wside]), np.concatenate([boost, wboost])
                order = np.lexsort((np.isnan(cosine), key, q))  # a row with its cosine first
                once = np.ones(len(q), bool)
                once[1:] = (np.diff(q[order]) != 0) | (np.diff(key[order]) != 0)
                q, key, cosine, bm25, side, boost = (x[order[once]] for x in (q, key, cosine, bm25, side, boost))
            if not len(q):
                continue
            keyword = self.spread(q, bm25)
            semantic = self.spread(q, cosine) if self.mode in ("hybrid", "routed_hybrid") else cosine
            score = rounded(self.fused(self.kind[low + q], np.nan_to_num(semantic), keyword, boost))
            order = np.lexsort((key, -score, q))
            q, key, side, score = q[order], key[order], side[order], score[order]
            kept = _first(q) < self.k
            for s in range(len(routing.SOURCES)):
                at = np.flatnonzero(side == s)
                kept[at[_first(q[at]) < self.k]] = True
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[low + q[kept]]), pa.array(key[kept]), pa.array(score[kept])], names=["qid", "chunk_id", "score"])

    @staticmethod
    def spread(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``x`` scaled to 0..1 over each query's rows that have one; 1 without a span."""
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        width = np.diff(np.append(starts, len(q)))
        least, most = (np.repeat(f.reduceat(x, starts), width) for f in (np.fmin, np.fmax))
        span = most - least
        scaled = np.divide(x - least, span, out=np.ones(len(x)), where=~(span <= FLAT))
        return np.where(np.isnan(x), np.nan, scaled)

    def fused(self, kind: np.ndarray, semantic: np.ndarray, keyword: np.ndarray, boost: np.ndarray) -> np.ndarray:
        """``retrieval.fused`` in numpy."""
        if self.mode in ("faiss_only", "bm25_only"):
            return semantic if self.mode == "faiss_only" else keyword
        a = np.choose(kind, routing.ALPHAS)
        return np.where((kind == 0) & (boost > 0), 0.15 * semantic + 0.25 * keyword + 0.60, a * semantic + (1 - a) * keyword + 0.10 * boost)
