"""Problem 5: splits that keep related records together.

Method: an incremental, persisted component table. New ties are contracted to ties between component roots, roots hook
onto smaller neighbours, and pointer jumping flattens the hooks; existing components keep their split, new ones fill
the deficits of the splits, and merges of components with different splits are quarantined.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekhya.plans import cut, positions, shared_folder
from lekhya.sources import table
from lekhya.sources.files import exists, publish, read_published

STATE = "id string, group_id string, split string, status string"
KEYS = "key string, id string"
MOVES = "r string, p string"
#: Edges that one task leads through its rounds in memory; more go through rounds of Spark joins until so few are left.
HELD_EDGES = 250_000


def stars(ties: DataFrame, member: str, key: str) -> DataFrame:
    """Ties (member, key) as edges (u, v) between members: each member of a key with the key's smallest one.

    Linear in the ties however many members a key has; the smallest member is pre-aggregated in each task, and the
    join back to the members is one that adaptive execution splits when a key is hot. Nulls on either side tie nothing.
    """
    pairs = ties.filter(F.col(member).isNotNull() & F.col(key).isNotNull()).select(F.col(member).alias("u"), F.col(key).alias("__key")).distinct()
    least = pairs.groupBy("__key").agg(F.min("u").alias("v"))
    return pairs.join(least, "__key").filter("u <> v").select("u", "v").distinct()


def moved(hooks: DataFrame) -> DataFrame:
    """Hooks (r, p), p smaller than r, led four steps on: pointer jumping, twice."""
    for _ in range(2):
        nexts = hooks.select(F.col("r").alias("__r"), F.col("p").alias("__p"))
        hooks = hooks.join(nexts, F.col("p") == F.col("__r"), "left").select("r", F.coalesce("__p", "p").alias("p"))
    return hooks


def jumped(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n vertices the smallest of its component: every root hooks onto its smallest neighbour, pointers jump until they stand, edges contract to the roots."""
    to = np.arange(n)
    while len(u):
        np.minimum.at(to, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(ahead := to[to], to):
            to = ahead
        u, v = to[u], to[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return to


def _jump_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        ends = [np.concatenate([np.asarray(b.column(i).to_pylist(), dtype=object) for b in held]) for i in (0, 1)]
        names, codes = np.unique(np.concatenate(ends), return_inverse=True)
        u, v = np.split(codes, 2)
        to = jumped(u, v, len(names))
        off = np.flatnonzero(to != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[off].tolist(), pa.string()), pa.array(names[to[off]].tolist(), pa.string())], names=["r", "p"])


def moves(edges: DataFrame, held: int = HELD_EDGES) -> DataFrame:
    """(r, p): where each vertex of ``edges`` (u, v) that isn't the smallest of its component moves, namely to that smallest one.

    Each round every vertex with a smaller neighbour hooks onto the smallest one, pointer jumping leads the hooks on,
    and the edges are contracted to the ends of the moves, until none is left. A chain longer than the jumps stays
    connected, as its edges are contracted like all others. While more than ``held`` edges are left a round is a set
    of Spark joins; the last ones go through the same rounds in the memory of one task, whose size that bounds.
    """
    straight = lambda e: cut(e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges, rounds = straight(edges), []
    while edges.count() > held:
        rounds.append(cut(moved(edges.groupBy(F.col("u").alias("r")).agg(F.min("v").alias("p")))))
        ends = rounds[-1].select(F.col("r").alias("__r"), F.col("p").alias("__p"))
        for side, other in (("u", "v"), ("v", "u")):
            edges = edges.join(ends, F.col(side) == F.col("__r"), "left").select(F.coalesce("__p", side).alias(side), other)
        edges = straight(edges)
    whole = cut(edges.select("u", "v").coalesce(1).mapInArrow(_jump_task, MOVES))
    for step in reversed(rounds):  # a vertex that moved in one round is in no later one
        later = whole.select(F.col("r").alias("__r"), F.col("p").alias("__p"))
        whole = cut(step.join(later, F.col("p") == F.col("__r"), "left").select("r", F.coalesce("__p", "p").alias("p")).unionByName(whole))
    return whole


def placed(rows: DataFrame, at: str, to: DataFrame) -> DataFrame:
    """``rows`` with ``at`` led to where ``to`` (r, p) moves it."""
    led = to.select(F.col("r").alias("__r"), F.col("p").alias("__p"))
    return rows.join(led, F.col(at) == F.col("__r"), "left").withColumn(at, F.coalesce("__p", at)).drop("__r", "__p")


def components(ids: DataFrame, edges: DataFrame, held: int = HELD_EDGES) -> DataFrame:
    """(id, group_id) of every id: group_id is the smallest id its ties reach. Ids without ties are their own group; ends of edges that aren't ids are kept out of the result but pass ties on."""
    return placed(ids.select("id").distinct().withColumn("group_id", F.col("id")), "group_id", moves(edges, held))


def allotment(sizes: list[tuple[int, int]], have: dict[str, int], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, from, to): of the groups of each size, those numbered [from, to) go to the split.

    Sizes descend; the groups of one size are dealt to the splits in proportion to what each still lacks of its share
    of all records, the remainder to those that lack most.
    """
    total = sum(have.values()) + sum(s * n for s, n in sizes)
    lacks = {k: shares[k] * total - have.get(k, 0) for k in sorted(shares)}
    out = []
    for size, count in sorted(sizes, reverse=True):
        open_ = {k: max(v, 0.0) for k, v in lacks.items()}
        whole = sum(open_.values())
        dealt = {k: int(count * v / whole) if whole else 0 for k, v in open_.items()}
        for _ in range(count - sum(dealt.values())):
            k = max(lacks, key=lambda x: (lacks[x] - dealt[x] * size, x))
            dealt[k] += 1
        at = 0
        for k, n in dealt.items():
            lacks[k] -= n * size
            if n:
                out.append((size, k, at, at + n))
                at += n
    return out


def changed(state: DataFrame | None, ids: DataFrame, edges: DataFrame, targets: DataFrame, held: int = HELD_EDGES) -> DataFrame:
    """The rows (id, group_id, split, status) that ``ids`` and ``edges`` (u, v) change in the component table ``state``, an earlier one or None.

    Ties are contracted to ties between the roots of their ends, so old ties are never read again. Changed are the new
    ids and all members of the old groups that a tie touches. See ``assign`` for what they become.
    """
    spark = ids.sparkSession
    fresh = ids.select("id").filter(F.col("id").isNotNull()).distinct()
    if state is None:
        old, roots = spark.createDataFrame([], STATE), edges.select("u", "v")
    else:
        old = state
        fresh = fresh.join(old.select("id"), "id", "left_anti")
        ends = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
        known = cut(old.select("id", "group_id").join(ends, "id", "left_semi")).select(F.col("id").alias("r"), F.col("group_id").alias("p"))
        roots = placed(placed(edges.select("u", "v"), "u", known), "v", known)
    roots = cut(roots.filter(F.col("u").isNotNull() & F.col("v").isNotNull()))
    to = moves(roots, held)
    touched = roots.select(F.col("u").alias("g")).unionByName(roots.select(F.col("v").alias("g"))).distinct()
    was = old.join(touched, F.col("group_id") == F.col("g"), "left_semi").select("id", "group_id", F.col("split").alias("__split"), F.col("status").alias("__status"), F.lit(True).alias("__held"))
    new = fresh.select("id", F.col("id").alias("group_id"), F.lit(None).cast("string").alias("__split"), F.lit(None).cast("string").alias("__status"), F.lit(False).alias("__held"))
    grouped = cut(placed(was.unionByName(new), "group_id", to))
    facts = grouped.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("__size"), F.min("__split").alias("__low"), F.max("__split").alias("__high"), F.count_if("__held").alias("__held"), F.count_if(F.col("__status") == "quarantined").alias("__doubt")
    )
    facts = cut(facts.withColumn("__state", F.when((F.col("__doubt") > 0) | (F.col("__low") != F.col("__high")), "quarantined").when(F.col("__held") > 0, "kept").otherwise("new")))
    shares = {r.split: r.target_share for r in targets.select("split", "target_share").collect()}
    # a row per split: what the splits hold, less what quarantine takes, with what joins
    have = {r.k: r.n for r in old.filter(F.col("split").isNotNull()).groupBy(F.col("split").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()} if state is not None else {}
    if have:
        lost = grouped.join(facts.filter("__state = 'quarantined'").select("group_id"), "group_id", "left_semi").filter("__split IS NOT NULL").groupBy(F.col("__split").alias("k")).agg((-F.count(F.lit(1))).alias("n"))
        joined = facts.filter("__state = 'kept'").groupBy(F.col("__low").alias("k")).agg(F.sum(F.col("__size") - F.col("__held")).alias("n"))
        for r in lost.unionByName(joined).collect():
            have[r.k] = have.get(r.k, 0) + r.n
    groups = facts.filter("__state = 'new'").select("group_id", "__size")
    sizes = [(r.k, r.n) for r in groups.groupBy(F.col("__size").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()]
    plan = spark.createDataFrame(allotment(sizes, have, shares), "__s long, __to_split string, __from long, __to long")
    numbered = positions(groups, ["__size"], [F.xxhash64("group_id"), F.col("group_id")], ["group_id"])
    dealt = numbered.join(plan, (F.col("__size") == F.col("__s")) & (F.col("position") >= F.col("__from")) & (F.col("position") < F.col("__to"))).select("group_id", "__to_split")
    decided = facts.join(dealt, "group_id", "left").select("group_id", "__state", F.when(F.col("__state") == "kept", F.col("__low")).when(F.col("__state") == "new", F.col("__to_split")).alias("split"))
    status = F.when((F.col("__state") == "kept") & ~F.col("__held"), "joined").otherwise(F.col("__state"))
    return grouped.join(decided, "group_id").select("id", "group_id", "split", status.alias("status"))


def assign(state: DataFrame | None, ids: DataFrame, edges: DataFrame, targets: DataFrame, held: int = HELD_EDGES) -> DataFrame:
    """The new component table (id, group_id, split, status) after ``ids`` and ``edges`` (u, v) join ``state``.

    ``state`` is an earlier result or None; a row keeps its status until a tie touches its group. A touched group that
    holds old records of one split keeps it (``kept``, its new members ``joined``); a group without old records fills
    deficits (``new``); a group whose old records have different splits is ``quarantined``: split null until someone
    decides, group_id merged. Repeated ids count once, null ids are dropped; empty inputs give an empty table. Targets
    are shares per split and are collected (a handful of rows); so are the distinct group sizes with their counts, at
    most sqrt(2n) of them for n records.
    """
    rows = changed(state, ids, edges, targets, held)
    if state is None:
        return rows
    rows = cut(rows)
    return state.select("id", "group_id", "split", "status").join(rows.select("id"), "id", "left_anti").unionByName(rows)


class ComponentTable:
    """A component table kept in ``folder`` as a log: each update writes the rows it changed and the keys it met first.

    ``update`` takes the new records and their ties (id, key) only. A tie by a key that an earlier update met leads to
    the record that met it, so neither old ties nor old records are read again but where a tie touches their group;
    what is written is as large as what changed. ``current`` takes the last row of each id; every COMPACT updates the
    log is written out as one part, so that it stays short. The list of parts is published last, so an update that dies
    leaves the table as it was; whoever opens the folder later goes on from there.
    """

    COMPACT = 8

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, []
        if exists(spark, f"{folder}/log"):
            self.log = [r.part for r in read_published(spark, f"{folder}/log").orderBy("nth").collect()]  # at most COMPACT + 1 names

    def _read(self, kind: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}-{part}").withColumn("__v", F.lit(v)) for v, part in enumerate(self.log)]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    def current(self) -> DataFrame | None:
        """(id, group_id, split, status) of every id, or None before the first update."""
        if not self.log:
            return None
        rows = self._read("rows", STATE)
        if len(self.log) == 1:
            return rows.drop("__v")
        last = rows.groupBy("id").agg(F.max_by(F.struct("group_id", "split", "status"), "__v").alias("__last"))
        return last.select("id", "__last.*")

    def keys(self) -> DataFrame:
        return self._read("keys", KEYS).drop("__v") if self.log else self.spark.createDataFrame([], KEYS)

    def update(self, ids: DataFrame, ties: DataFrame, targets: DataFrame, held: int = HELD_EDGES) -> DataFrame:
        """The rows that ``ids`` and their ``ties`` (id, key) changed, written to the log. Nulls tie nothing."""
        pairs = cut(ties.filter(F.col("id").isNotNull() & F.col("key").isNotNull()).select("id", "key").distinct())
        least = cut(pairs.groupBy("key").agg(F.min("id").alias("v")).join(self.keys().select("key", F.col("id").alias("w")), "key", "left"))
        edges = pairs.join(least.select("key", "v"), "key").select(F.col("id").alias("u"), "v").unionByName(least.filter(F.col("w").isNotNull()).select(F.col("v").alias("u"), F.col("w").alias("v")))
        part = self._write(changed(self.current(), ids, edges.filter("u <> v").distinct(), targets, held), least.filter(F.col("w").isNull()).select("key", F.col("v").alias("id")))
        self._publish([*self.log, part])
        if len(self.log) > self.COMPACT:
            self._publish([self._write(self.current(), self.keys())])
        return self.spark.read.schema(STATE).parquet(f"{self.folder}/rows-{part}")

    def _write(self, rows: DataFrame, keys: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/rows-{part}")
        keys.write.parquet(f"{self.folder}/keys-{part}")
        return part

    def _publish(self, log: list[str]) -> None:
        publish(self.spark.createDataFrame(list(enumerate(log)), "nth int, part string").coalesce(1), f"{self.folder}/log")
        self.log = log


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def section_numbers(label: Column) -> Column:
    """All numbers of a section label in either digit script, a letter right behind it included, leading zeros dropped."""
    ascii_digits = F.lower(F.translate(label, "०१२३४५६७८९", "0123456789"))
    found = F.regexp_extract_all(ascii_digits, F.lit(r"([0-9]+(?:[क-हa-z](?![ऀ-ॣa-z]))?)"), 1)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")))


def ties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All eval_items ids, and their ties (id, key) by drafter and by the sections of their first results."""
    items = table(spark, sf_dir, "eval_items")
    ids = items.select("id").filter(F.col("id").isNotNull()).distinct()
    drafter = F.lower(trimmed(F.col("drafter")))
    by_drafter = items.filter(drafter != "").select("id", F.concat(F.lit("d "), drafter).alias("key"))
    first = table(spark, sf_dir, "search_results").filter((F.col("rank") == 1) & F.col("metadata.source").isNotNull())
    sections = first.select(F.col("question_id").alias("id"), F.col("metadata.source").alias("source"), F.explode(section_numbers(F.col("dafa"))).alias("number"))
    by_section = sections.join(ids, "id", "left_semi").select("id", F.concat(F.lit("s "), "source", F.lit(" "), "number").alias("key"))
    return ids, by_drafter.unionByName(by_section)


def grown(spark: SparkSession, sf_dir: str, steps: int = 1) -> ComponentTable:
    """The component table of all items, written in the shared folder in ``steps`` updates by the time items were made, equally long."""
    ids, tied = ties(spark, sf_dir)
    targets = table(spark, sf_dir, "split_targets")
    kept = ComponentTable(spark, shared_folder(spark, "components"))
    if steps == 1:
        kept.update(ids, tied, targets)
        return kept
    made = table(spark, sf_dir, "eval_items").filter(F.col("id").isNotNull()).groupBy("id").agg(F.coalesce(F.min(F.unix_timestamp("created_at")), F.lit(0)).alias("at"))
    low, high = made.agg(F.min("at"), F.max("at")).first()
    part = F.least(F.floor((F.col("at") - F.lit(low or 0)) * steps / F.lit(max(1, (high or 0) - (low or 0)))), F.lit(steps - 1))
    dated = cut(made.select("id", part.alias("part")))
    tied = cut(tied.join(dated, "id"))
    for i in range(steps):
        kept.update(dated.filter(F.col("part") == i).select("id"), tied.filter(F.col("part") == i).select("id", "key"), targets)
    return kept


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = grown(spark, sf_dir).current()
    large = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group_id")
    return grouped.join(large, "group_id").select(F.col("id").alias("question_id"), "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id with its group and split, all assigned in one go."""
    return grown(spark, sf_dir).current()


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in two updates of the table: items made in the first half of the time span, then the others on top. A group that joins records of different splits is quarantined."""
    return grown(spark, sf_dir, 2).current()


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, groups and share per split against its target."""
    given = p5_splits(spark, sf_dir)
    counts = given.groupBy("split").agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("group_id").alias("n_groups"))
    share = F.col("n_items") / F.sum("n_items").over(Window.partitionBy())
    return counts.withColumn("share", F.round(share, 6)).join(table(spark, sf_dir, "split_targets"), "split", "left").select("split", "n_items", "n_groups", "share", "target_share")
