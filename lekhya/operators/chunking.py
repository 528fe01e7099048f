"""Four ways to chunk texts. Three are ordered folds over one text, run in Arrow batches; sections are pure SQL."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.functions import text as tx
from lekhya.operators.dense import HASHED_WIDTH, slot

SIZE, OVERLAP, SMALLEST, SIMILAR, LARGEST = 900, 150, 100, 0.75, 1600
# Marks in order of preference.
SEPARATORS = ("\n\n", "\n", "।", " ")
TAIL_MARKS = "।\n "
_UNIT_MARK, _NONBLANK = re.compile("[।;, ]"), re.compile(r"\S")
_SENTENCES = re.compile(r"(?<=।)\s+|\r?\n+")
_SECTION = re.compile(r"^(?:दफा\s*)?\d+(?:[क-हA-Za-z])?[.)]", re.M)


#: A chunk as the stretches of text it is made of; all are cut out once, at the end.
Spans = list[tuple[int, int]]


def _sliced(text: str, chunks: list[Spans]) -> list[str]:
    return ["".join(text[a:b] for a, b in spans) for spans in chunks]


def _reaches(text: str, begin: int, end: int, size: int, separators: tuple[str, ...]) -> list[Spans]:
    """Chunks of ``text[begin:end]``: from where one begins it reaches the farthest end of a part that keeps it within ``size``, found among the ends of all parts by bisection.

    A part too long alone is cut by the next separator, and its last chunk reaches on into the parts behind.
    """
    if end - begin <= size:
        return [[(begin, end)]] if text[begin:end].strip() else []
    if not separators:
        return [[(i, min(i + size, end))] for i in range(begin, end, size) if text[i : min(i + size, end)].strip()]
    mark, finer = separators[0], separators[1:]
    places = [m.start() for m in re.compile(re.escape(mark)).finditer(text, begin, end)]
    starts, ends = [begin, *(p + len(mark) for p in places)], [*places, end]
    chunks: list[Spans] = []
    at = 0
    while at < len(ends):
        own = [[(starts[at], ends[at])]] if ends[at] - starts[at] <= size else _reaches(text, starts[at], ends[at], size, finer)
        if starts[at] == ends[at] or not own:  # nothing begins with an empty part
            at += 1
            continue
        *whole, last = own
        room = size - sum(b - a for a, b in last)
        to = bisect_right(ends, ends[at] + room, at) - 1
        if to > at:
            last = [*last[:-1], (last[-1][0], ends[to])] if last[-1][1] == ends[at] else [*last, (ends[at], ends[to])]
        chunks += [*whole, last]
        at = max(to, at) + 1
    return [c for c in chunks if any(text[a:b].strip() for a, b in c)]


def packed(text: str, size: int = SIZE, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: parts at the first separator, as many to a piece as fit; a part too long alone by the next separator, its last piece staying open for what follows. Without separators left, plain slices. Blank pieces are dropped."""
    return _sliced(text, _reaches(text, 0, len(text), size, separators))


def tail(previous: str, size: int = OVERLAP) -> str:
    """What a chunk repeats of the one before: its last ``size`` characters behind their last danda, else line break, else space."""
    end = previous[-size:]
    at = next((i for m in TAIL_MARKS if (i := end.rfind(m)) > 0), -1)
    return end[at + 1 :].strip() if at > 0 else end


def overlapped(chunks: list[str], glue: str) -> list[str]:
    return [t + glue + c if (t := tail(p)) else c for p, c in zip(["", *chunks], chunks)] if chunks else []


def units(text: str, size: int = SIZE) -> list[str]:
    """Sentences; one too long is cut behind its last mark up to the size, hard when that leaves less than half."""
    breaks = [(m.start(), m.end()) for m in _SENTENCES.finditer(text)]
    marks = [m.start() for m in _UNIT_MARK.finditer(text)]
    cuts: Spans = []
    for begin, end in zip([0, *(e for _, e in breaks)], [*(b for b, _ in breaks), len(text)]):
        end = begin + len(text[begin:end].rstrip())
        while (begin := _nonblank(text, begin, end)) < end:
            nearest = bisect_right(marks, begin + size) - 1
            behind = marks[nearest] + 1 if nearest >= 0 and marks[nearest] - begin >= size // 2 else begin + size
            to = end if end - begin <= size else behind
            cuts.append((begin, to))
            begin = to
    return [u for a, b in cuts if (u := text[a:b].strip())]


def _nonblank(text: str, begin: int, end: int) -> int:
    return m.start() if (m := _NONBLANK.search(text, begin, end)) else end


def vector(text: str) -> np.ndarray:
    """Signed term counts, the stand-in for an encoder."""
    slots = [slot(w) for w in text.lower().split()]
    return np.bincount([b for b, _ in slots], weights=[s for _, s in slots], minlength=HASHED_WIDTH) if slots else np.zeros(HASHED_WIDTH)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / n) if n else 0.0


def grouped(parts: list[str], size: int = SIZE, similar: float = SIMILAR) -> list[str]:
    """Units joined left to right by spaces while the next one is as similar as ``similar`` to the group's centroid and fits."""
    out: list[str] = []
    total = np.zeros(HASHED_WIDTH)
    for part in parts:
        v = vector(part)
        v = v / n if (n := float(np.sqrt(v @ v))) else v
        if out and len(out[-1]) + 1 + len(part) <= size and cosine(v, total) >= similar:
            out[-1] += " " + part
            total = total + v
        else:
            out.append(part)
            total = v
    return out


def coalesced(groups: list[str], smallest: int = SMALLEST, size: int = SIZE) -> list[str]:
    """Groups shorter than ``smallest`` joined to the one before, else to the one after, where that fits.

    Told from the lengths alone: a group continues the run before it when both fit together and either the run is
    still too short or the group is.
    """
    begins: list[int] = []
    length, short = 0, False
    for i, n in enumerate(map(len, groups)):
        if begins and (short or n < smallest) and length + 1 + n <= size:
            length += 1 + n
            short = short and length < smallest
        else:
            begins.append(i)
            length, short = n, n < smallest
    return [" ".join(groups[a:b]) for a, b in zip(begins, [*begins[1:], len(groups)])]


def recursive(text: str) -> list[str]:
    return overlapped(packed(text), "\n")


def semantic(text: str) -> list[str]:
    return overlapped(coalesced(grouped(units(text))), "\n\n")


def sections(text: str) -> list[str]:
    starts = [m.start() for m in _SECTION.finditer(text)]
    return [s for a, b in zip([0, *starts], [*starts, len(text)]) if (s := text[a:b].strip())]


def hybrid(text: str, largest: int = LARGEST, similar: float = SIMILAR) -> list[str]:
    """Sections, neighbours merged while similar and within ``largest``, longer ones packed."""
    out: list[str] = []
    for s in sections(text):
        if out and len(out[-1]) + 1 + len(s) <= largest and cosine(vector(out[-1]), vector(s)) >= similar:
            out[-1] += "\n" + s
        else:
            out.append(s)
    return [p for s in out for p in (packed(s) if len(s) > largest else [s])]


def cleaned(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.replace("‍", "").replace("‌", ""))


def _listed(chunker: Callable[[str], list[str]]):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([chunker(cleaned(t)) if t else [] for t in texts])

    return listed


def section_parts(text: Column) -> Column:
    """Sections of a text JVM-side: split before each header that begins a line, trimmed, blank parts dropped."""
    parts = F.split(tx.cleaned(text), "(?mU)(?=" + tx.SECTION_HEADER.removeprefix("(?mU)") + ")")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


STRATEGIES: dict[str, Callable[[Column], Column]] = {"recursive": lambda c: _listed(recursive)(c), "semantic": lambda c: _listed(semantic)(c), "section": section_parts, "hybrid": lambda c: _listed(hybrid)(c)}


def chunked(texts: DataFrame, key: str, text: str, strategy: str) -> DataFrame:
    """(key, chunk_no from 1, text, n_chars, labels) by a strategy; unknown strategies raise, null and blank texts give no chunk."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    each = texts.select(key, F.posexplode(STRATEGIES[strategy](F.col(text))).alias("pos", "text"))
    labels = tx.section_labels(F.col("text"))
    return each.select(key, (F.col("pos") + 1).alias("chunk_no"), "text", F.length("text").cast("long").alias("n_chars"), F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise("Unknown").alias("label"), (F.size(labels) > 1).alias("is_merged"))
