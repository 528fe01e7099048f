"""Problem 6: cutting oversized texts at natural boundaries.

Method: pointer doubling. Every boundary is joined to its farthest legal successor, the overlap included; squaring the
successor table then derives all greedy cuts in about log2(pieces) steps, over all boundaries of a batch of texts at
once. The tables live in numpy arrays inside Arrow batches, so no text is shuffled: the join of boundaries with
boundaries stays within a text, and a text is one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.sources import table

HARD, SPACE, SENTENCE = 0, 1, 2
KINDS = np.array(["hard", "space", "sentence"])

# Sentence ends and line breaks as given for this data.
_SENTENCE_END = re.compile(r"[।?!]+[\"”’)\]}]*\s*|\s*\n\s*")
_BLANKS = re.compile(r"\s+")
_SENTENCE_SIGN, _BLANK = re.compile(r"[।?!\n]"), re.compile(r"\s")
_MARKS = re.compile(r"[ऀ-ःऺ-ॏ॑-ॗॢॣ̀-ͯ‌‍︀-️]")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``text`` may be cut, ascending, each the start of what follows, with the kind of boundary.

    After a sentence end or line break (with the blanks behind it), after other blanks, and, for stretches without
    either, before any character that doesn't combine with the one before it. The end of the text counts as a
    sentence end.
    """
    n = len(text)
    kind = np.zeros(n + 1, dtype=np.int8)
    for m in _MARKS.finditer(text):
        kind[m.start()] = -1
    for m in _BLANKS.finditer(text):
        kind[m.end()] = SPACE
    for m in _SENTENCE_END.finditer(text):
        kind[m.end()] = SENTENCE
    kind[n] = SENTENCE
    places = np.flatnonzero(kind >= 0)
    places = places[places > 0]
    return places, kind[places]


def successors(places: np.ndarray, kinds: np.ndarray, offset: np.ndarray, first: np.ndarray, last: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For each boundary its farthest legal successor: the piece that starts ``overlap`` before it must end within ``limit``.

    Of the boundaries in reach the coarsest kind wins, and of that kind the farthest. All are indexes into the
    concatenated boundaries of many texts; ``offset`` shifts each text's places so that one sorted array serves all.
    ``first`` marks the virtual start of a text, whose piece has no overlap but must be longer than one; ``last`` is
    each text's final index.
    """
    shifted = places + offset
    reach = np.where(first, shifted + limit, shifted - overlap + limit)
    best = np.full(len(places), -1, dtype=np.int64)
    for kind in (HARD, SPACE, SENTENCE):
        own = np.flatnonzero((kinds >= kind) & ~first)
        at = np.searchsorted(shifted[own], reach, side="right") - 1
        found = np.where(at >= 0, own[np.maximum(at, 0)], -1)
        ahead = (found > np.arange(len(places))) & (found <= last) & (places[found] > overlap)
        best = np.where(ahead, found, best)
    end = shifted[last] <= reach
    best = np.where(end, last, best)
    return np.where(best < 0, np.minimum(np.arange(len(places)) + 1, last), best)


def reached(successor: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marks of all boundaries on the chains from ``starts``, by squaring the successor table.

    After k rounds ``table`` leads 2**k steps on and ``on`` holds the first 2**k boundaries of each chain.
    """
    on = np.zeros(len(successor), dtype=bool)
    on[starts] = True
    step = successor
    while True:
        ahead = step[np.flatnonzero(on)]
        if on[ahead].all():
            return on
        on[ahead] = True
        step = step[step]


def stretched(texts: list[str], limit: int, sign: re.Pattern) -> np.ndarray:
    """Which texts have a stretch of more than ``limit`` characters without ``sign``.

    The same chains without overlap: each sign is joined to the farthest one behind a piece within the limit, the
    table is squared, and a text is stretched if its chain has to leave a sign behind which none is in reach.
    """
    places, owners, offset, firsts = [], [], [], []
    shift = total = 0
    for i, text in enumerate(texts):
        own = [-1, *(m.start() for m in sign.finditer(text)), len(text)]
        places.append(np.array(own, dtype=np.int64))
        owners.append(np.full(len(own), i))
        offset.append(np.full(len(own), shift))
        firsts.append(total)
        total += len(own)
        shift += len(text) + 2 * limit + 4
    out = np.zeros(len(texts), dtype=bool)
    if not total:
        return out
    owner, shifted = np.concatenate(owners), np.concatenate(places) + np.concatenate(offset)
    last = np.array([*firsts[1:], total])[owner] - 1
    here = np.arange(total)
    farthest = np.minimum(np.searchsorted(shifted, shifted + 1 + limit, side="right") - 1, last)
    stuck = (farthest <= here) & (here < last)
    on = reached(np.where(stuck, here + 1, farthest), np.array(firsts))
    out[owner[on & stuck]] = True
    return out


def cut_kinds(texts: list[str], limit: int) -> list[str]:
    """Coarsest sign every stretch of ``limit`` characters has: ``sentence``, ``space`` or else ``hard``."""
    return KINDS[np.where(stretched(texts, limit, _BLANK), HARD, np.where(stretched(texts, limit, _SENTENCE_SIGN), SPACE, SENTENCE))].tolist()


def cuts(texts: list[str], limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(index of text, start, end, kind of the boundary at the end) of every piece of all texts, in order."""
    places, kinds, texts_of, offset, firsts, lasts = [], [], [], [], [], []
    shift = total = 0
    for i, text in enumerate(texts):
        p, k = boundaries(text)
        places += [np.zeros(1, dtype=np.int64), p]
        kinds += [np.zeros(1, dtype=np.int8), k]
        n = len(p) + 1
        texts_of.append(np.full(n, i))
        offset.append(np.full(n, shift))
        firsts.append(total)
        total += n
        lasts.append(np.full(n, total - 1))
        shift += len(text) + 2 * limit + 1  # no reach crosses into the next text
    if not total:
        return []
    at, kind, owner, off, last = map(np.concatenate, (places, kinds, texts_of, offset, lasts))
    first = np.zeros(total, dtype=bool)
    first[firsts] = True
    on = reached(successors(at, kind, off, first, last, limit, overlap), np.array(firsts))
    chosen = np.flatnonzero(on)
    previous = np.concatenate([[0], chosen[:-1]])
    piece = ~first[chosen]
    begin = np.where(first[previous], 0, at[previous] - overlap)[piece]
    ends = chosen[piece]
    return list(zip(owner[ends].tolist(), begin.tolist(), at[ends].tolist(), KINDS[kind[ends]].tolist()))


def _cutter(limit: int, overlap: int, wanted: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each Arrow batch's pieces; the last column is the text, the others (keys) go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows = cuts(texts, limit, overlap)
            index = pa.array([r[0] for r in rows], pa.int64())
            keys = [pc.take(batch.column(i), index) for i in range(batch.num_columns - 1)]
            kinds = cut_kinds(texts, limit)
            number = np.arange(len(rows)) - np.searchsorted([r[0] for r in rows], [r[0] for r in rows]) if rows else []
            columns = {
                "piece_no": pa.array(number, pa.int32()),
                "start": pa.array([r[1] for r in rows], pa.int32()),
                "end": pa.array([r[2] for r in rows], pa.int32()),
                "boundary": pa.array([r[3] for r in rows], pa.string()),
                "cut_kind": pa.array([kinds[r[0]] for r in rows], pa.string()),
                "piece": pa.array([texts[r[0]][r[1] : r[2]] for r in rows] if wanted else [None] * len(rows), pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*keys, *columns.values()], names=[*batch.schema.names[:-1], *columns])

    return run


def split_oversized(rows: DataFrame, keys: list[str], text: str, limit: int, overlap: int, with_text: bool = True) -> DataFrame:
    """Pieces of every text longer than ``limit`` characters: ``keys``, piece_no from 0, start, end, boundary, cut_kind, piece.

    Consecutive pieces share exactly ``overlap`` characters: a piece begins ``overlap`` before the end of the one
    before it, so the first piece and the later ones without their first ``overlap`` characters give back the text.
    A cut takes the farthest sentence end or line break in reach, else the farthest blank, else the farthest place
    between whole characters (a run of combining signs longer than a piece is cut anywhere). Null, empty and short
    texts give no piece; repeated rows give the same pieces each. Other columns are dropped. ``cut_kind`` is one per
    text: ``hard`` if some stretch without blanks exceeds the limit, else ``space`` if some stretch without sentence
    end or line break does, else ``sentence``.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    own = rows.filter(F.length(text) > limit).select(*keys, F.col(text).alias("__text"))
    fields = [own.schema[k] for k in keys]
    more = [T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("boundary", "cut_kind", "piece"))]
    return own.mapInArrow(_cutter(limit, overlap, with_text), T.StructType([*fields, *more]))


def limits(spark: SparkSession, sf_dir: str, kind: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").filter(F.col("item_kind") == kind).first()
    return row.max_size, row.overlap_size


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "search_results"), ["search_id", "dafa"], "text", *limits(spark, sf_dir, "search_result_text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_oversized(table(spark, sf_dir, "search_results"), ["search_id"], "text", *limits(spark, sf_dir, "search_result_text"), with_text=False)
    return found.filter("piece_no = 0").select("search_id", "cut_kind")
