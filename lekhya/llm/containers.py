"""Problem 7: filling containers of fixed capacity.

Method: large-item matching. Items above a third of the capacity go at most two to a container, by greedy matching of
each with the largest that still fits; smaller items best-fit the remaining gaps, largest first. The matching runs
over counts by size, of which there are at most ``capacity``, so it is global however many items there are; items then
find their container by their size and their number among the items of that size.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.llm.pieces import limits
from lekhya.llm.tokens import FOLDER, MODEL, with_tokens
from lekhya.plans import cut, positions
from lekhya.sources import table


#: Runs broadcast at a time (24 bytes each, so at most 48 MB); more go in parts, each to the items of its sizes.
SENT_RUNS = 2_000_000


class Packing:
    """A packing of ``counts`` (size to number of items) into containers of ``capacity``, as runs.

    A run (size, first, n, container) says: the items of that size numbered first to first + n - 1 lie in the
    containers numbered container to container + n - 1, one each. Every step empties a size or a class of gaps, so
    there are at most about capacity squared runs, whatever the number of items.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
        self.used = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int]] = []
        self.gaps: dict[int, list[list[int]]] = {}
        self.gap_sizes: list[int] = []
        self.containers = 0
        self._match_large()
        self._fit_small()

    def _place(self, size: int, n: int, container: int) -> None:
        self.runs.append((size, self.used[size], n, container))
        self.used[size] += n
        self.left[size] -= n

    def _open(self, gap: int, container: int, n: int) -> None:
        if gap not in self.gaps:
            self.gaps[gap] = []
            insort(self.gap_sizes, gap)
        self.gaps[gap].append([container, n])

    def _match_large(self) -> None:
        """Largest first, each with the largest other item above a third of the capacity that fits."""
        large = sorted(s for s in self.left if 3 * s > self.capacity)
        for i in range(len(large) - 1, -1, -1):
            size = large[i]
            while n := self.left[size]:
                at = bisect_right(large, self.capacity - size, 0, i + 1) - 1
                while at >= 0 and not self.left[large[at]]:
                    at -= 1
                if at < 0 or (large[at] == size and n == 1):
                    at -= at >= 0
                    while at >= 0 and not self.left[large[at]]:
                        at -= 1
                if at < 0:
                    self._place(size, n, self.containers)
                    self._open(self.capacity - size, self.containers, n)
                    self.containers += n
                    break
                mate = large[at]
                pairs = n // 2 if mate == size else min(n, self.left[mate])
                self._place(size, pairs, self.containers)
                self._place(mate, pairs, self.containers)
                self._open(self.capacity - size - mate, self.containers, pairs)
                self.containers += pairs

    def _fit_small(self) -> None:
        """Largest first, each into the smallest gap that holds it; when none does, new containers open."""
        for size in sorted((s for s in self.left if 3 * s <= self.capacity), reverse=True):
            while n := self.left[size]:
                at = bisect_left(self.gap_sizes, size)
                if at == len(self.gap_sizes):
                    each = self.capacity // size
                    opened = max(1, n // each)
                    self._open(self.capacity, self.containers, opened)
                    self.containers += opened
                    continue
                gap = self.gap_sizes[at]
                spans = self.gaps[gap]
                container, width = spans[-1]
                taken = min(n, width)
                self._place(size, taken, container)
                if taken == width:
                    spans.pop()
                    if not spans:
                        del self.gaps[gap]
                        self.gap_sizes.pop(at)
                else:
                    spans[-1] = [container + taken, width - taken]
                if gap > size:
                    self._open(gap - size, container, taken)


def packed(items: DataFrame, capacity: int, size: str = "tokens", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``items`` (``keys`` and ``size``) as pieces: ``keys``, piece_no, ``size``, offset, container_id.

    An item above the capacity is split into full pieces and a rest (offset is where a piece begins, in the same
    unit); no other item is split. Items of size 0 or null take no room and no container and are left out. Repeated
    rows are separate items. Sizes are collected as counts by size: at most ``capacity`` rows.
    """
    sized = items.select(*keys, F.col(size).cast("long").alias("__size")).filter("__size > 0")
    whole = F.floor((F.col("__size") - 1) / capacity)
    pieces = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), whole.cast("int")))).select(
        *keys, "piece_no", F.when(F.col("piece_no") < whole, F.lit(capacity)).otherwise(F.col("__size") - whole * capacity).cast("long").alias(size), (F.col("piece_no").cast("long") * capacity).alias("offset")
    )
    pieces = cut(pieces)
    counts = {r[0]: r[1] for r in pieces.groupBy(size).count().collect()}
    packing = Packing(counts, capacity)
    runs = np.array(sorted(packing.runs), dtype=np.int64).reshape(-1, 4)
    numbered = positions(pieces, [size], [F.xxhash64(*keys), *(F.col(k) for k in keys), F.col("piece_no")], [*keys, "piece_no"])
    placed = None
    for own in np.array_split(runs, max(1, -(-len(runs) // SENT_RUNS))):  # runs of the same size may stand in two parts: their numbers differ
        part = _contained(numbered, own, size)
        placed = part if placed is None else placed.unionByName(part)
    return placed.select(*keys, "piece_no", size, "offset", "container_id")


def _contained(numbered: DataFrame, runs: np.ndarray, size: str) -> DataFrame:
    """Of the items ``numbered`` by size those that ``runs`` (sorted) place, with their container_id."""
    starts = runs[:, 0] * (1 << 44) + runs[:, 1]
    held = numbered.sparkSession.sparkContext.broadcast((starts, runs[:, 2], runs[:, 3]))  # SENT_RUNS rows at most

    @F.pandas_udf(T.LongType())
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        begin, width, first = held.value
        for sizes, numbers in batches:
            item = sizes.to_numpy() * (1 << 44) + numbers.to_numpy()
            at = np.maximum(np.searchsorted(begin, item, side="right") - 1, 0)
            past = item - begin[at] if len(begin) else np.full(len(item), -1)
            inside = (past >= 0) & (past < width[at]) if len(begin) else np.zeros(len(item), dtype=bool)
            yield pd.Series(np.where(inside, first[at] + past, 0) if len(begin) else past, dtype="Int64").mask(~inside)

    low, high = (int(runs[0, 0]), int(runs[-1, 0])) if len(runs) else (0, -1)
    return numbered.filter(F.col(size).between(low, high)).withColumn("container_id", container(F.col(size), F.col("position"))).filter("container_id IS NOT NULL")


def p7_containers(spark: SparkSession, sf_dir: str, folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    capacity, _ = limits(spark, sf_dir, "document_container")
    documents = with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", folder, model).select("doc_id", "tokens")
    return packed(documents, capacity)


def p7_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, the least number any packing needs, fill, and how full the containers are."""
    capacity, _ = limits(spark, sf_dir, "document_container")
    fills = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    least = F.ceil(F.sum("used") / capacity)
    return fills.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("tokens"), least.alias("least_containers"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"), F.max("used").alias("max_used"),
        F.count_if(F.col("used") == capacity).alias("n_full"),
    )
