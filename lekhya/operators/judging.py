"""Judge output: tolerant parsing, score levels, refusals, and the client interface."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.functions import text as tx

# Score levels, refusal patterns, error notices.
LEVELS = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
REFUSALS = [
    "उत्तर दिन सकिँदैन", "उत्तर दिन असमर्थ", "दायराभित्र पर्दैन", "स्रोत(?:मा|हरूमा).*उल्लेख छैन", "कानूनी सन्दर्भ(?:मा)?.*(?:उपलब्ध|समावेश) छैन", "उपलब्ध गराइएको.*(?:उत्तर|जानकारी).*(?:छैन|दिन सकिँदैन)",
    "जानकारी उपलब्ध छैन", "cannot answer", "outside (?:the )?scope", "not (?:available|covered) in (?:the )?(?:provided )?(?:context|sources)", "insufficient (?:context|information)",
]
#: Patterns of ours for refusals the fixed list misses.
MORE_REFUSALS = ["सन्दर्भमा छैन", "थाहा छैन", "असमर्थ छु", "सक्दिनँ", "सकिनँ", "दायराबाहिर", "unable to", "can't help", "do not let me answer"]
FAILURES = ["Failed to parse", "Evaluation error"]


def snapped(score: Column) -> Column:
    """The level nearest to the score clamped to 0..1; the lower of two as near; null for null."""
    clamped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    levels = F.array(*map(F.lit, LEVELS))
    return F.when(score.isNotNull(), F.array_min(F.transform(levels, lambda s: F.struct(F.abs(s - clamped).alias("d"), s.alias("s"))))["s"])


def refuses(answer: Column, patterns: list[str]) -> Column:
    """Whether an answer holds a refusal pattern; empty answers and error notices don't refuse."""
    norm = tx.spaced(F.coalesce(answer, F.lit("")))
    return (norm != "") & ~norm.startswith("error") & norm.rlike("(?i)" + "|".join(patterns))


def candidate(raw: Column) -> Column:
    """The outermost JSON object of a reply, code fences, brackets of a list around it and other text left out; empty without one."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def repaired(c: Column) -> Column:
    """Curly quotes straightened, commas before a closing bracket dropped."""
    return F.regexp_replace(F.translate(c, "“”", '""'), r",\s*([}\]])", "$1")


def relaxed(c: Column) -> Column:
    """A literal of Python as JSON: quotes of keys and strings made double, double ones inside escaped away, True, False and None in JSON's words."""
    inner = F.regexp_replace(F.translate(repaired(c), '"', "’"), r"(?<=[{\[,:])\s*'|'\s*(?=[}\],:])", '"')
    for python, json in (("True", "true"), ("False", "false"), ("None", "null")):
        inner = F.regexp_replace(inner, rf"(?<=[\[,:])\s*{python}\s*(?=[}}\],])", json)
    return inner


def parsed(raw: Column) -> Column:
    """(score, reasoning, indices, state) of a judge's reply: ``parsed``, ``repaired``, ``relaxed`` from a Python literal, ``salvaged`` from a cut object, or ``failed`` with score 0. Of a list of objects the first counts."""
    schema = "score double, reasoning string, relevant_chunk_indices array<int>"
    options = {"mode": "PERMISSIVE"}
    plain, fixed = F.from_json(candidate(raw), schema, options), F.from_json(repaired(candidate(raw)), schema, options)
    loose = F.from_json(relaxed(candidate(raw)), schema, options)
    first = F.from_json(repaired(F.regexp_extract(raw, r"(?s)\{[^{}]*\}", 0)), schema, options)
    cut_score = F.regexp_extract(raw, r'"score"\s*:\s*([0-9.]+)', 1)
    cut_reason = F.regexp_extract(raw, r'(?s)"reasoning"\s*:\s*"(.*?)(?:"|$)', 1)
    none = F.array().cast("array<int>")
    pick = lambda p, state: F.struct(p["score"].alias("score"), p["reasoning"].alias("reasoning"), F.coalesce(p["relevant_chunk_indices"], none).alias("indices"), F.lit(state).alias("state"))
    saved = F.struct(cut_score.try_cast("double").alias("score"), F.concat(F.lit("[truncated response] "), F.trim(cut_reason)).alias("reasoning"), none.alias("indices"), F.lit("salvaged").alias("state"))
    failed = F.struct(F.lit(0.0).alias("score"), F.lit(FAILURES[0]).alias("reasoning"), none.alias("indices"), F.lit("failed").alias("state"))
    return F.when(plain["score"].isNotNull(), pick(plain, "parsed")).when(fixed["score"].isNotNull(), pick(fixed, "repaired")).when(first["score"].isNotNull(), pick(first, "repaired")).when(loose["score"].isNotNull(), pick(loose, "relaxed")).when(cut_score.try_cast("double").isNotNull(), saved).otherwise(failed)


def sane_indices(indices: Column, n: Column) -> Column:
    """Indices within 0..n-1, order and repeats kept."""
    return F.filter(indices, lambda i: (i >= 0) & (i < n))


def valid_answers(rows: DataFrame) -> DataFrame:
    """Rows with a scope and an answer: not out of scope by category or answerability, not blank, no error notice."""
    answer = F.trim(F.coalesce("generated_answer", F.lit("")))
    out = (F.coalesce("category", F.lit("")) == "out_of_scope") | (F.coalesce("answerability", F.lit("")) == "out_of_scope")
    return rows.filter(~out & (answer != "") & ~F.upper(answer).startswith("ERROR"))


def done_in_all(results: list[DataFrame]) -> DataFrame:
    """(id): questions with a score in each of the result tables, one a metric."""
    scored = [r.filter("score is not null").select(F.col("question_id").alias("id")).distinct() for r in results]
    done = scored[0]
    for one in scored[1:]:
        done = done.join(one, "id", "left_semi")
    return done


# Prompts of ours; any template with the same fields can take their place.
PROMPTS = {
    "correctness": "Question:\n{question}\n\nReference answer:\n{ground_truth}\n\nAnswer:\n{generated_answer}\n\nScore 0 to 1 as JSON.",
    "relevance": "Question:\n{question}\n\nAnswer:\n{generated_answer}\n\nDoes the answer address the question? Score 0 to 1 as JSON.",
    "groundedness": "Sources:\n{context_summary}\n\nAnswer:\n{generated_answer}\n\nIs every claim supported by the sources? Score 0 to 1 as JSON.",
    "retrieval_relevance": "Question:\n{question}\n\nResults:\n{results}\n\nWhich results help to answer? Give score 0 to 1 and relevant_chunk_indices as JSON.",
}


def prompt(template: str, fields: list[str]) -> Column:
    """A template with its {fields} filled from columns, empty for nulls."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + f + "}") for f in fields if "{" + f + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(f for f in fields if rest.startswith("{" + f + "}", at))
        parts += [F.lit(rest[:at]), F.coalesce(F.col(name), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


class Pacer:
    """At least ``seconds`` between starts, per worker process."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, None

    def wait(self) -> None:
        if self.last is not None and (rest := self.last + self.seconds - self.clock()) > 0:
            self.sleep(rest)
        self.last = self.clock()


def asked(rows: DataFrame, key: str, text: str, call: Callable[[str], str], pace: float = 0.0, tries: int = 3, tasks: int = 8) -> DataFrame:
    """(key, reply, error) of ``call`` on every text, in batches on the workers; ``call`` is any client function.

    A call that raises is tried again up to ``tries`` times; then the reply is null and the error told. With a ``pace``
    the whole job starts no more than one call in so many seconds on average: rows are dealt to ``tasks`` partitions, each of which
    leaves ``tasks`` times the pace between its own starts, the first after its share of that, however many run at once.
    """
    wait = pace * tasks
    rows = rows.repartition(tasks, key) if pace else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pacer = Pacer(wait)
        if wait and (at := TaskContext.get()):
            pacer.last = pacer.clock() - wait + at.partitionId() * pace
        for batch in batches:
            replies, errors = [], []
            for one in batch[text]:
                reply, error = None, None
                for _ in range(tries):
                    pacer.wait()
                    try:
                        reply, error = call(one), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{FAILURES[1]}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pd.DataFrame({key: batch[key], "reply": replies, "error": errors})

    schema = T.StructType([rows.schema[key], T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])
    return rows.select(key, text).mapInPandas(run, schema)


def stub_judge(text: str) -> str:
    """A deterministic judge for tests: a level from the text's length."""
    return '{"score": %.1f, "reasoning": "length %d"}' % (LEVELS[len(text) % len(LEVELS)], len(text))
