"""Terminal contexts: how surely a word ends a sentence, counted over whole corpora, and the verdict on bare ends."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.llm.structure import FINAL_MARKS, end_of
from lekhya.plans import cut

END_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("state", "open_signs", "last_word", "before_last")])

#: Parts a last word's bare ends are dealt to when they meet its verdict.
SALTS = 16
#: A bare end counts as finished when its word is at least this surely sentence-final.
FINISHED = 0.5


@F.pandas_udf(END_SCHEMA)
def text_end(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        ends = [end_of(t) for t in texts]
        yield pd.DataFrame(ends, columns=["state", "open_signs", "last_word", "before_last"])


WORD_SCHEMA = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_final", T.LongType())])
_MARKS = frozenset(FINAL_MARKS)
_SIGNS = "\"“”‘’()[]{}<>,;:।॥.?!`*"

#: Distinct tokens a task counts before it hands its partial counts on.
HELD_TOKENS = 200_000


def _counted(tokens: Counter[str]) -> pa.RecordBatch:
    counts: dict[str, list[int]] = {}
    for token, n in tokens.items():
        if "..." not in token and (word := token.strip(_SIGNS)):
            held = counts.setdefault(word, [0, 0])
            held[0] += n
            held[1] += n * (token.rstrip("\"”’)}]*_`")[-1:] in _MARKS)
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([n for n, _ in counts.values()], pa.int64()), pa.array([f for _, f in counts.values()], pa.int64())], names=["word", "n", "n_final"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text and (words := text.split()):
                tokens.update(words[:-1])
                if words[-1][-1] in FINAL_MARKS:
                    tokens[words[-1]] += 1
        if len(tokens) > HELD_TOKENS:
            yield _counted(tokens)
            tokens.clear()
    yield _counted(tokens)


def word_ends(texts: DataFrame, text: str) -> DataFrame:
    """For each word of all ``texts``: how often it stands (``n``) and how often right before a sentence-final mark (``n_final``).

    Counted in each task before one shuffle of (word, n, n_final). The last word of a text counts only when a mark
    ends it, and one before an ellipsis never, so a cut text doesn't teach its own stump.
    """
    counted = texts.select(text).mapInArrow(_count_words, WORD_SCHEMA)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_final").alias("n_final"))


def surety(n: Column, n_final: Column) -> Column:
    """Share of a word's uses that end a sentence, doubted by two uses that don't; 0 for a word never seen elsewhere, such as a stump."""
    return F.coalesce(n_final / (n + 2), F.lit(0.0))


def judged(ends: DataFrame, words: DataFrame, baseline: list[str]) -> DataFrame:
    """``ends`` (with ``state`` and ``last_word``) with ``is_cut``.

    broken, ellipsis and open ends are cut, marked and closed ends and empty texts aren't. A bare end is finished if
    its last word ends sentences elsewhere with surety p and the group leaves out marks at rate b: odds p/(1-p)
    times b/(1-b) against one half. A group is the ``baseline`` columns and the script of the last word; b is its
    share of sure words among its bare ends, smoothed by one of each. ``p_final`` is null but for bare ends.
    """
    ends = cut(ends)  # two readers; the automaton runs once
    bare = ends.filter("state = 'bare'")
    script = F.when(F.col("last_word").rlike("[\u0900-\u097f]"), "deva").otherwise("other")
    # common last words are aggregated before the join and salted behind it, so no word is a hot key
    last = bare.groupBy(*baseline, "last_word").agg(F.count(F.lit(1)).alias("__times")).withColumn("__script", script)
    known = last.join(words.select(F.col("word").alias("last_word"), "n", "n_final"), "last_word", "left").withColumn("p_final", surety(F.col("n"), F.col("n_final")))
    known = cut(known)
    group = [*baseline, "__script"]
    rates = known.groupBy(*group).agg(((F.sum(F.when(F.col("p_final") >= FINISHED, F.col("__times")).otherwise(0)) + 1) / (F.sum("__times") + 2)).alias("__rate"))
    rates = rates.select(*(F.col(c).alias(f"__r_{c}") for c in group), "__rate")
    rated = known.join(rates, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in group], "left")
    p, b = F.col("p_final"), F.greatest(F.least(F.coalesce(F.col("__rate"), F.lit(0.5)), F.lit(0.8)), F.lit(0.1))
    verdicts = rated.select(*(F.col(c).alias(f"__v_{c}") for c in (*baseline, "last_word")), "p_final", ((p * b) >= (1 - p) * (1 - b)).alias("__finished"))
    verdicts = verdicts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = bare.withColumn("__of", F.pmod(F.xxhash64(*ends.columns), F.lit(SALTS)).cast("int"))
    match = [F.col("last_word") == F.col("__v_last_word"), F.col("__of") == F.col("__salt"), *(F.col(c).eqNullSafe(F.col(f"__v_{c}")) for c in baseline)]
    told = salted.join(verdicts, match, "left").select(*ends.columns, "p_final", (~F.col("__finished")).alias("is_cut"))
    others = ends.filter("state <> 'bare'").select(*ends.columns, F.lit(None).cast("double").alias("p_final"), F.col("state").isin("broken", "ellipsis", "open").alias("is_cut"))
    return others.unionByName(told)
