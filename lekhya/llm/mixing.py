"""Problem 8: mixing sources to target weights.

Method: Sainte-Laguë apportionment. Blocks of equal tokens are allocated to the sources by the highest quotients
weight / (2 blocks + 1), then each source's blocks to its shards in the same way, which gives every shard an integer
quota; the records of a shard then fill it in seeded order, whole records rather than blocks of tokens, repeating
records only when a shard is used up.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lekhya.llm.tokens import FOLDER, MODEL, with_tokens
from lekhya.plans import cut
from lekhya.sources import table

SEED = 20240229
#: Tokens of a block.
BLOCK = 512
#: Tokens a shard holds on average, and shards a source has at most; shards are collected as (source, shard, tokens).
SHARD, SHARDS = 1 << 22, 1024


def sainte_lague(weights: dict, seats: int, most: dict | None = None) -> dict:
    """``seats`` dealt by the highest quotients weight / (2 s + 1), at most ``most[k]`` to k; ties go to the smaller key.

    The bulk is dealt at once from a divisor that seats nobody too many, the rest one by one from a heap.
    """
    weights = {k: w for k, w in weights.items() if w > 0}
    whole, most = math.fsum(weights.values()), most or {}
    dealt = {k: min(max(0, int(w / whole * seats - len(weights) / 2)), most.get(k, seats)) for k, w in weights.items()} if whole else {}
    queue = [(-weights[k] / (2 * n + 1), k) for k, n in dealt.items() if n < most.get(k, seats)]
    heapq.heapify(queue)
    for _ in range(seats - sum(dealt.values())):
        if not queue:
            break
        _, k = heapq.heappop(queue)
        dealt[k] += 1
        if dealt[k] < most.get(k, seats):
            heapq.heappush(queue, (-weights[k] / (2 * dealt[k] + 1), k))
    return dealt


def total_blocks(have: dict[str, int], shares: dict[str, float], repeats: dict[str, int], block: int) -> int:
    """The most blocks of which every source can give its share within its repeats."""
    wanted = [k for k, s in shares.items() if s > 0]
    return min((int(have.get(k, 0) * repeats[k] / shares[k] / block) for k in wanted), default=0)


def mixed(records: DataFrame, targets: DataFrame, key: str, source: str, tokens: str, blocks: int | None = None, block: int = BLOCK, shard: int = SHARD, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: ``key``, ``source``, ``tokens``, repeat_no (from 1), one row for every use of a record.

    ``targets`` (source, target_share, max_repeats) is collected (a row per source), as are the sizes of the shards (at
    most ``shards`` rows per source, whatever the size of the data). ``blocks`` fixes the size of the
    mix; left out, it is the largest at which every source with a share can meet it. A shard takes records in seeded
    order until its quota is reached to within half a record, each at most max_repeats times and none twice before
    all of its shard came once. Sources without target, null sources and records of 0 tokens aren't used; a target
    source without records makes the default mix empty. Equal keys are ordered together and may repeat as separate
    records.
    """
    spark = records.sparkSession
    wanted = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.select("source", "target_share", "max_repeats").collect()}
    shares, repeats = {k: v[0] for k, v in wanted.items()}, {k: v[1] for k, v in wanted.items()}
    own = cut(records.filter(F.col(source).isin(list(wanted)) & (F.col(tokens) > 0)).select(key, F.col(source).alias("source"), F.col(tokens).cast("long").alias("tokens")))
    have = {r.source: r.n for r in own.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    n_shards = {k: min(shards, max(1, -(-n // shard))) for k, n in have.items()}
    widths = spark.createDataFrame(list(n_shards.items()), "source string, __shards long")
    order = F.xxhash64(F.lit(seed), F.col(key))
    sharded = own.join(F.broadcast(widths), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.col("__shards"))).drop("__shards")  # widths: a row per target source
    parts = {(r.source, r.shard): r.n for r in sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("n")).collect()}
    seats = sainte_lague(shares, total_blocks(have, shares, repeats, block) if blocks is None else blocks)
    quotas, by_source = [], defaultdict(dict)
    for p, t in parts.items():
        by_source[p[0]][p] = t
    for k, n in seats.items():
        of = by_source[k]
        dealt = sainte_lague(of, n, {p: t * repeats[k] // block for p, t in of.items()})
        short = n - sum(dealt.values())
        # the rest of a block that no shard can hold whole goes to the shards with most left, in tokens
        quota = {p: b * block for p, b in dealt.items()}
        lack = short * block
        for p in sorted(of, key=lambda p: (quota.get(p, 0) - of[p] * repeats[k], p)):
            more = min(lack, of[p] * repeats[k] - quota.get(p, 0))
            quota[p] = quota.get(p, 0) + more
            lack -= more
        quotas += [(k, p[1], q, of[p], repeats[k]) for p, q in quota.items()]
    plan = spark.createDataFrame(quotas, "source string, shard long, __quota long, __size long, __most long")
    before = F.sum("tokens").over(Window.partitionBy("source", "shard").orderBy(order, key, "tokens").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2
    uses = F.least(F.greatest(F.ceil((F.col("__quota") - F.col("__at")) / F.col("__size")), F.lit(0)), F.col("__most"))
    taken = sharded.withColumn("__at", before).join(plan, ["source", "shard"]).withColumn("__uses", uses.cast("int")).filter("__uses > 0")
    return taken.select(key, "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("__uses"))).alias("repeat_no"))


def p8_mix(spark: SparkSession, sf_dir: str, folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    documents = with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", folder, model).drop("text")
    return mixed(documents, table(spark, sf_dir, "mix_targets"), "doc_id", "source", "tokens")


def p8_share_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: records, uses, tokens, share reached and target, most repeats used and allowed."""
    mix = p8_mix(spark, sf_dir)
    sums = mix.groupBy("source").agg(F.count_distinct("doc_id").alias("n_records"), F.count(F.lit(1)).alias("n_uses"), F.sum("tokens").alias("tokens"), F.max("repeat_no").alias("most_repeats"))
    shares = sums.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))  # a row per source
    return table(spark, sf_dir, "mix_targets").join(shares, "source", "left").select("source", "target_share", F.coalesce("share", F.lit(0.0)).alias("share"), "n_records", "n_uses", "tokens", "most_repeats", "max_repeats")
