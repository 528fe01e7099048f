"""Problem 9: long exact spans shared between records.

Method: a compressed FM-index per shard. Text is routed to shards so that any two places with a common span meet in
one: winnowed anchors (the least hash of the k-grams in each window of the span length) pick the same k-gram in both
records. Each shard indexes the segments around its anchors and streams them against the index: backward search over
wavelet matrices computes their matching statistics, the intervals that reach the threshold are reported, and places in
one range share a class. An anchor with more places than a shard holds is split: its windows are told apart by hash, one
place of each is indexed, and all places are streamed against that index in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.llm.fmindex import SEPARATOR, FMIndex
from lekhya.llm.pieces import limits
from lekhya.plans import cut
from lekhya.sources import table

#: Characters of an anchor.
ANCHOR = 50
#: Segments of a shard: with 350 characters each about 1.4 million characters, some 250 MB while its index is built.
SHARD = 4096
#: An anchor that stands at more places than this, repeats within one text included, and in different texts, is split.
HOT = SHARD // 2
#: The segments around anchors are cut from the texts where they are scanned, if so many anchors at most are met again (some 30 MB to each executor); else texts and anchors are joined by a shuffle.
SENT = 1_000_000
#: Characters hashed in one go.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACE_BITS = 22


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit polynomial hash of every k-gram."""
    n = len(codes)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, dtype=np.uint64)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(7)) * powers)])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - k, _UNBASE, dtype=np.uint64)]))
        h = (sums[k:] - sums[:-k]) * back
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xCA9B0DC6B3F1B7A5)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return h ^ (h >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, in linear time."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=values.dtype)
    padded = np.full(-(-n // width) * width, _NEVER, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[str], least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of text, place, hash) of the anchors: in every window of ``least`` characters its least k-gram by hash.

    Of equal ones the first counts; in a text that repeats itself so much that this picks more than an eighth of its
    places, a pick instead stays as long as it is a least one. Either way all of a window's least ones have one hash.
    """
    lengths = np.array([len(t) for t in texts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    hashes = gram_hashes(codepoints("".join(texts)), k)
    total = int(lengths.sum())
    width = least - k + 1
    key = (hashes >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
    lowest = sliding_least(key, width)
    inside = np.zeros(max(total, 1), dtype=bool)
    for b, n in zip(begins.tolist(), lengths.tolist()):
        if n >= least:
            inside[b : b + n - least + 1] = True
    windows = np.flatnonzero(inside[: len(lowest)])
    picked = (lowest[windows] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.concatenate([[True], picked[1:] != picked[:-1]]) if len(picked) else np.zeros(0, dtype=bool)
    windows, picked = windows[new], picked[new]
    owner = np.searchsorted(begins, picked, side="right") - 1
    dense = np.bincount(owner, minlength=len(texts)) * 8 > np.maximum(lengths, 1)
    if dense.any():
        kept = [picked[~dense[owner]]]
        for i in np.flatnonzero(dense).tolist():
            kept.append(_sparse(hashes[begins[i] : begins[i] + lengths[i] - k + 1], width) + begins[i])
        picked = np.sort(np.concatenate(kept))
        owner = np.searchsorted(begins, picked, side="right") - 1
    return owner, picked - begins[owner], hashes[picked].view(np.int64)


def _sparse(hashes: np.ndarray, width: int) -> np.ndarray:
    """Picks of one repetitive text: the last pick stays while it is a least one of the window, else the last least one follows."""
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    lowest = sliding_least((hashes & ~mask) | (mask - np.arange(len(hashes), dtype=np.uint64)), width)
    last, least = (mask - (lowest & mask)).astype(np.int64).tolist(), (lowest & ~mask).tolist()
    value, picks, at = (hashes & ~mask).tolist(), [], -1
    for window, (place, low) in enumerate(zip(last, least)):
        if at < window or value[at] != low:
            at = place
            picks.append(at)
    return np.array(picks, dtype=np.int64)


FOUND_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("anchors", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType()))]
)


def _anchoring(least: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per text of at least ``least`` characters: id, digest, length, anchors and their places."""

    def listed(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        owner, place, h = anchors(texts, least, k)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass")) for t in texts]), pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(h)), pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))),
            ],
            names=FOUND_SCHEMA.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t is None or len(t) < least:
                    continue
                if size and size + len(t) > CHUNK:
                    yield listed(ids, texts)
                    ids, texts, size = [], [], 0
                if len(t) > (1 << _PLACE_BITS):
                    yield _long(i, t)
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield listed(ids, texts)

    def _long(i: int, t: str) -> pa.RecordBatch:
        """A text too long for one go: overlapping parts, each window in one of them, so the anchors are the same."""
        step = (1 << _PLACE_BITS) - least + 1
        parts = [(b, *anchors([t[b : b + (1 << _PLACE_BITS)]], least, k)[1:]) for b in range(0, len(t) - least + 1, step)]
        both = {(int(p) + b, int(h)) for b, places, hs in parts for p, h in zip(places, hs)}
        both = sorted(both)
        ends = pa.array([0, len(both)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(t.encode("utf-8", "surrogatepass"))]), pa.array([len(t)], pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array([h for _, h in both], pa.int64())), pa.ListArray.from_arrays(ends, pa.array([p for p, _ in both], pa.int32())),
            ],
            names=FOUND_SCHEMA.names,
        )

    return run


SEGMENT_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("anchor", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("is_hot", T.BooleanType())])


def _segmenting(least: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The union of all windows of ``least`` characters around each listed anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, listed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for x in listed:
                    b = max(0, x["place"] + k - least)
                    rows.append((doc, x["anchor"], b, text[b : x["place"] + least], x["is_hot"]))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))], names=SEGMENT_SCHEMA.names)

    return run


#: Spans (set_id null) and memberships (begin and end null) of texts in sets of texts that share windows.
FINDING_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("set_id", T.LongType())])


class Streamed:
    """Segments under one index, as codes."""

    def __init__(self, segments: list[str]):
        self.lengths = np.array([len(s) for s in segments], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) if segments else np.zeros(0, np.int64)
        raw = codepoints("\0".join(segments) + "\0").astype(np.int64)
        behind = self.starts + self.lengths
        inside = np.ones(len(raw), dtype=bool)
        inside[behind] = False
        self.alphabet, codes = np.unique(raw[inside], return_inverse=True)
        self.codes = np.zeros(len(raw), dtype=np.int64)
        self.codes[inside] = codes + 1
        self.codes[behind] = SEPARATOR


def islands(owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of overlapping or touching intervals of each owner."""
    if not len(owner):
        return owner, begin, end
    order = np.lexsort((end, begin, owner))
    owner, begin, end = owner[order], begin[order], end[order]
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    group = np.cumsum(first) - 1
    base = group * (int(end.max()) + 2)  # so that one running maximum serves all owners
    reach = np.maximum.accumulate(end + base)
    new = np.concatenate([[True], begin[1:] + base[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return owner[at], begin[at], np.maximum.reduceat(end, at)


def matches(docs: np.ndarray, begins: np.ndarray, segments: list[str], least: int, name: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Findings (doc, begin, end, set) of segments of records: the merged intervals of at least ``least`` characters that another record's segments hold (set -1), and the sets of records that share a window of that length (begin and end -1).

    All segments are indexed, then streamed from their ends. Places whose windows are equal have one class; classes
    with the same records are one set, named by ``name`` and a number.
    """
    none = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    if not len(segments):
        return none
    own = Streamed(segments)
    index = FMIndex(own.codes, np.repeat(docs, own.lengths + 1), int(own.lengths.max()))
    of, place, length, low = index.statistics(own.codes, own.starts, own.lengths, least)
    if not len(of):
        return none
    doc = docs[of]
    at = begins[of] + place
    spans = islands(doc, at, at + length)
    pairs = np.unique(np.stack([index.classes(least)[low], doc], axis=1), axis=0)
    members, sets = distinct_sets(pairs[:, 0], pairs[:, 1])
    gone = np.full(len(members), -1, dtype=np.int64)
    return tuple(np.concatenate(x) for x in ((spans[0], members), (spans[1], gone), (spans[2], gone), (np.full(len(spans[0]), -1, dtype=np.int64), (np.int64(name) << 32) + sets)))


def distinct_sets(classes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, number of its set) of the distinct sets of records among ``classes``; both sorted by class, then doc."""
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(classes)]]))
    seen: dict[bytes, int] = {}
    members, numbers = [], []
    for b, n in zip(starts.tolist(), sizes.tolist()):
        key = docs[b : b + n].tobytes()
        if key not in seen:
            seen[key] = len(seen)
            members.append(docs[b : b + n])
            numbers.append(np.full(n, seen[key], dtype=np.int64))
    return np.concatenate(members), np.concatenate(numbers)


def _findings(doc: np.ndarray, begin: np.ndarray, end: np.ndarray, sets: np.ndarray) -> pa.Table:
    some = lambda x, kind: pa.array(x, kind, mask=x < 0) if len(x) else pa.array([], kind)
    return pa.table([pa.array(doc, pa.int64()), some(begin, pa.int32()), some(end, pa.int32()), pa.array(sets, pa.int64(), mask=sets == -1)], names=FINDING_SCHEMA.names)


def _sharding(least: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, shard: pa.Table) -> pa.Table:
        doc, begin = shard.column("doc_id").to_numpy(), shard.column("begin").to_numpy().astype(np.int64)
        return _findings(*matches(doc, begin, shard.column("segment").to_pylist(), least, key[0].as_py()))

    return run


WINDOW_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("window", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("text", T.StringType())])


def _windowing(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every window of ``least`` characters of the segments with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, begin, segment in zip(*(batch.column(i).to_pylist() for i in range(3))):
                h = gram_hashes(codepoints(segment), least).view(np.int64)
                at = np.arange(len(h))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), doc), pa.int64()), pa.array(h), pa.array(begin + at, pa.int32()), pa.array([segment[i : i + least] for i in at.tolist()], pa.string())], names=WINDOW_SCHEMA.names)

    return run


def _verifying(least: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """Windows (right) streamed against the index of one window of each hash (left): those found are equal to it, and not only by hash."""

    def run(key: tuple, indexed: pa.Table, streamed: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], f) for f in (pa.int64(), pa.int32(), pa.int32(), pa.int64())], names=FINDING_SCHEMA.names)
        if not indexed.num_rows or not streamed.num_rows:
            return empty
        left = dict(zip(indexed.column("window").to_pylist(), indexed.column("text").to_pylist()))
        own = Streamed(list(left.values()))
        index = FMIndex(own.codes, np.repeat(np.arange(len(left)), own.lengths + 1), least)
        texts = streamed.column("text").to_pylist()
        raw = codepoints("".join(texts)).astype(np.int64).reshape(-1, least)
        at = np.minimum(np.searchsorted(own.alphabet, raw), len(own.alphabet) - 1)
        known = (own.alphabet[at] == raw).all(axis=1)
        low, high = index.search(at + 1)
        mine = {w: c for w, c in zip(left, index.classes(least)[index.search(own.codes[own.starts[:, None] + np.arange(least)])[0]].tolist())}
        of = index.classes(least)[np.minimum(low, index.n - 1)]
        window = streamed.column("window").to_pylist()
        equal = np.flatnonzero(known & (high > low) & (of == np.array([mine.get(w, -1) for w in window])))
        doc, begin = streamed.column("doc_id").to_numpy()[equal], streamed.column("begin").to_numpy().astype(np.int64)[equal]
        return _findings(doc, begin, begin + least, np.array(window, dtype=np.int64)[equal])

    return run


class Shared:
    """Spans of at least ``least`` characters that different records of ``documents`` (doc_id bigint, text) share.

    ``members``: (doc_id, rep, n_chars, copies) of the texts long enough; identical texts have one representative and
    are compared once. ``found``: (doc_id, begin, end, set_id) of representatives: rows without set_id are merged
    shared intervals, rows without begin say that the text belongs to a set of texts that share a window; texts are
    linked when they share a set, and no pair is listed before ``pairs``. Rows with both come from split anchors. Null
    and shorter texts share nothing. Ids must be unique.
    """

    def __init__(self, documents: DataFrame, least: int, k: int = ANCHOR, hot: int = HOT, shard: int = SHARD, sent: int = SENT):
        rows = documents.select("doc_id", "text")
        anchored = cut(rows.mapInArrow(_anchoring(least, k), FOUND_SCHEMA))
        reps = anchored.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        self.members = cut(anchored.select("doc_id", "digest", "n_chars").join(reps, "digest").select("doc_id", "rep", "n_chars", "copies"))
        own = anchored.join(self.members.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
        places = own.select("doc_id", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("places").alias("place"))).alias("x")).select("doc_id", "x.anchor", "x.place")
        held = places.groupBy("anchor").agg(F.min("doc_id").alias("__low"), F.max("doc_id").alias("__high"), F.count(F.lit(1)).alias("__n")).filter("__low < __high")
        met = places.join(held.select("anchor", (F.col("__n") > hot).alias("is_hot")), "anchor")
        listed = cut(met.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "is_hot")).alias("listed")))  # of one text
        sizes = listed.select(F.explode("listed.is_hot").alias("h")).agg(F.count(F.lit(1)), F.count_if("h")).first()
        segments = rows.join(F.broadcast(listed) if sizes[0] <= sent else listed, "doc_id").select("doc_id", "text", "listed").mapInArrow(_segmenting(least, k), SEGMENT_SCHEMA)
        shards = max(1, -(-(sizes[0] - sizes[1]) // shard))
        cold = segments.filter(~F.col("is_hot")).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        found = cold.groupBy("shard").applyInArrow(_sharding(least), FINDING_SCHEMA)
        self.found = cut(found.unionByName(self._split(segments.filter("is_hot"), least, shard)) if sizes[1] else found)

    def _split(self, segments: DataFrame, least: int, shard: int) -> DataFrame:
        """The findings of split anchors. One window of each hash that several texts hold, pre-aggregated in each task, is indexed; all windows are streamed against the index of their hash's shard, dealt to as many parts as they need."""
        windows = cut(segments.select("doc_id", "begin", "segment").mapInArrow(_windowing(least), WINDOW_SCHEMA).select("doc_id", "window", "begin").distinct())
        texts = segments.select("doc_id", "begin", "segment").mapInArrow(_windowing(least), WINDOW_SCHEMA)
        several = windows.groupBy("window").agg(F.min("doc_id").alias("__low"), F.max("doc_id").alias("__high"), F.count(F.lit(1)).alias("n")).filter("__low < __high")
        several = cut(several.select("window", "n"))
        kinds, most = several.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
        n_shards, parts = max(1, -(-kinds // shard)), max(1, -(-most // shard))
        to_shard = F.pmod(F.xxhash64("window"), F.lit(n_shards)).alias("shard")
        held = texts.join(several.select("window"), "window")
        # names of their own, as both sides come from the same windows
        indexed = held.groupBy("window").agg(F.min("text").alias("text")).select(to_shard, F.col("window").alias("window"), "text", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        streamed = held.select(to_shard, "window", "text", "doc_id", "begin", F.pmod(F.xxhash64("doc_id", "begin"), F.lit(parts)).cast("int").alias("part"))
        return indexed.groupBy("shard", "part").cogroup(streamed.groupBy("shard", "part")).applyInArrow(_verifying(least), FINDING_SCHEMA)

    def sets(self) -> DataFrame:
        """(set_id, doc_id): which texts share a window."""
        return self.found.filter(F.col("set_id").isNotNull()).select("set_id", "doc_id").distinct()

    def rep_pairs(self) -> DataFrame:
        """(a, b), a < b: different texts that share a span."""
        first, second = self.sets().withColumnRenamed("doc_id", "a"), self.sets().withColumnRenamed("doc_id", "b")
        return first.join(second, "set_id").filter("a < b").select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), the smaller first: every pair of records that share a span, copies included."""
        member = self.members.select("doc_id", "rep")
        a, b = member.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), member.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
        between = self.rep_pairs().join(a, "a").join(b, "b").select("x", "y")
        copies = self.members.filter("copies > 1").select("doc_id", "rep")
        within = copies.select(F.col("doc_id").alias("x"), "rep").join(copies.select(F.col("doc_id").alias("y"), "rep"), "rep").filter("x < y").select("x", "y")
        return between.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def spans(self) -> DataFrame:
        """(rep, begin, end): the merged shared intervals of each text. The intervals of one text are merged in one task, some at each of its anchors."""
        whole = self.members.filter("doc_id = rep and copies > 1").select("doc_id", F.lit(0).alias("begin"), F.col("n_chars").cast("int").alias("end"))
        each = self.found.filter(F.col("begin").isNotNull()).select("doc_id", "begin", "end").unionByName(whole).distinct()
        ahead = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
        opened = each.withColumn("__new", (F.col("begin") > F.coalesce(F.max("end").over(ahead), F.lit(-1))).cast("int"))
        running = Window.partitionBy("doc_id").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
        return opened.withColumn("__island", F.sum("__new").over(running)).groupBy(F.col("doc_id").alias("rep"), "__island").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("__island")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, _ = limits(spark, sf_dir, "shared_span_min")
    return Shared(table(spark, sf_dir, "documents"), least).pairs()


def p9_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: class_id of its text (the smallest doc_id with it), copies of it, characters, shared characters, their share, spans, the longest, and how many texts hold the window of it that most texts hold (1 for none other). No pair of documents is listed."""
    least, _ = limits(spark, sf_dir, "shared_span_min")
    documents = table(spark, sf_dir, "documents")
    shared = Shared(documents, least)
    counted = shared.spans().groupBy("rep").agg(F.sum(F.col("end") - F.col("begin")).alias("n_shared"), F.count(F.lit(1)).alias("n_spans"), F.max(F.col("end") - F.col("begin")).alias("longest"))
    sizes = shared.sets().groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    widest = shared.sets().join(sizes, "set_id").groupBy(F.col("doc_id").alias("rep")).agg(F.max("n").alias("most_texts"))
    known = shared.members.join(counted, "rep", "left").join(widest, "rep", "left").select("doc_id", "rep", "copies", "n_shared", "n_spans", "longest", "most_texts")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return documents.select("doc_id", size.alias("n_chars")).join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n_chars", zero("n_shared"), F.round(F.when(F.col("n_shared") > 0, F.col("n_shared") / F.col("n_chars")).otherwise(0.0), 6).alias("shared_share"), zero("n_spans"), zero("longest"),
        F.coalesce("most_texts", F.lit(1)).cast("long").alias("most_texts"),
    )
