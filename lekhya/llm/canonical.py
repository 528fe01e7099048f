"""Problem 4: one consistent character form.

Method: compatibility normalisation and deletion of ignorable characters, then a Viterbi search through each token's
lattice of look-alike characters under script-consistent character n-gram scores counted over the whole corpus.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.sources import table

# Classes of signs and sign sequences that look alike, each with the scripts they belong to implicit in their characters.
LOOK_ALIKES = [
    ["A", "А", "Α"], ["B", "В", "Β"], ["C", "С", "Ϲ"], ["E", "Е", "Ε"], ["H", "Н", "Η"], ["I", "І", "Ι"], ["J", "Ј"], ["K", "К", "Κ"], ["M", "М", "Μ"], ["N", "Ν"], ["O", "О", "Ο"], ["P", "Р", "Ρ"], ["S", "Ѕ"], ["T", "Т", "Τ"], ["X", "Х", "Χ"], ["Y", "Υ", "Ү"], ["Z", "Ζ"],
    ["a", "а", "α"], ["c", "с", "ϲ"], ["d", "ԁ"], ["e", "е"], ["g", "ɡ"], ["h", "һ"], ["i", "і", "ι"], ["j", "ј"], ["l", "ӏ"], ["n", "ո"], ["o", "о", "ο", "օ"], ["p", "р", "ρ"], ["q", "ԛ"], ["s", "ѕ"], ["u", "ս", "υ"], ["v", "ѵ", "ν"], ["w", "ԝ"], ["x", "х", "χ"], ["y", "у", "γ"],
    ["।", "|", "ǀ", "∣"], ["॥", "||", "।।"], ["ः", ":", "꞉"], ["०", "০", "੦", "૦", "௦", "౦", "೦", "൦"],
    ["आ", "अा"], ["ओ", "अाे", "अो", "आे"], ["औ", "अाै", "अौ", "आै"], ["ऐ", "एे"], ["ई", "र्इ"], ["ऊ", "उू"], ["ो", "ाे"], ["ौ", "ाै"],
    ["१", "੧"], ["२", "੨"], ["३", "੩"], ["४", "੪"],
]

# Signs that compatibility normalisation would rewrite although they are proper signs of their own.
KEPT = frozenset("…№™½¼¾²³¹ªº‥℃℉µ")
# Look-alikes that compatibility normalisation would turn into signs that look otherwise.
LUNATE = frozenset("ϲϹ")
# Signs that only stand in for others here; text is never rewritten to them.
NEVER_MEANT = frozenset("ǀ∣꞉") | LUNATE
_KEPT_ALL = KEPT | LUNATE
_KEPT_RUNS = regex.compile("([" + "".join(sorted(_KEPT_ALL)) + "]+)")
#: Sequences rewritten only towards the first sign of their class: the others aren't spellings of any script.
_SEQUENCES = {alt: group[0] for group in LOOK_ALIKES for alt in group if len(alt) > 1}
_CHARS = {alt: [x for x in group if len(x) == 1] for group in LOOK_ALIKES for alt in group if len(alt) == 1}

#: Signs of which one at least is in every text that may need a change: any but printable ASCII without '|', tabs and line
#: breaks. ``plain`` leaves texts of those alone and their tokens have no lattice, so skipping them loses nothing.
SUSPICIOUS = regex.compile(r"[^\t\n\r\x20-\x7b\x7d\x7e]")
ALPHABET_END = 0x2000  # n-grams, counted or looked up, hold characters below this; everything else is one class
_TOKENS = regex.compile(r"\S+")
_BOUND, _FAR = "\x02", "\x03"
#: A look-alike replaces a sign only when it scores better by this much (natural logarithm).
MARGIN = 1.0
#: Distinct tokens a task holds before it hands its counts on.
HELD_TOKENS = 200_000


#: Blanks, breaks, controls and ignorable characters that ``plain`` rewrites.
_ODD = regex.compile(r"[^\P{Zs} ]|[\p{Cf}\p{Default_Ignorable_Code_Point}\u2028\u2029\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufe00-\ufe0f]")


def plain(text: str) -> str:
    """Compatibility-normalised, canonically composed text with plain spaces and without ignorable characters; letter case, digits, blanks and line breaks stay."""
    if text.isascii():
        return _spaced(text)
    if unicodedata.is_normalized("NFKC", text) and not _ODD.search(text):
        return text
    return _rewritten(text)


def _rewritten(text: str) -> str:
    out = []
    for run in _KEPT_RUNS.split(text):
        if run and run[0] in _KEPT_ALL:
            out.append(run)
        elif run:
            out.append(_spaced(unicodedata.normalize("NFKC", _spaced(run))))
    return unicodedata.normalize("NFC", "".join(out))


def _spaced(run: str) -> str:
    if run.isascii():
        return regex.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", run)
    run = regex.sub(r"\p{Zs}", " ", regex.sub(r"[  \u0085]", "\n", run))
    return regex.sub(r"[\p{Cf}\p{Default_Ignorable_Code_Point}︀-️\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]+", "", run)


def script(c: str) -> str:
    """Coarse script of a character: letters and marks by script, signs and digits ``-`` where any script uses them."""
    o = ord(c)
    if c in "।॥":
        return "-"
    if 0x900 <= o <= 0x97F:
        return "deva"
    if not (c.isalnum() or unicodedata.category(c)[0] == "M"):
        return "-"
    if o < 0x80:
        return "-" if c.isdigit() else "latn"
    return unicodedata.name(c, "? ?").split()[0].lower()[:8] if o >= 0x250 else "latn"


def classed(token: str) -> str:
    """``token`` in the alphabet of the n-grams."""
    return "".join(c if ord(c) < ALPHABET_END else _FAR for c in token)


class Scores:
    """Character trigram scores, interpolated with bigrams, and the cost of mixing scripts in a token."""

    MIXED = 6.0

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.before: Counter[str] = Counter()
        for g, n in grams.items():
            self.before[g[:-1]] += n
        self.memo: dict[str, float] = {}

    def step(self, context: str, c: str) -> float:
        gram = context[-2:] + c
        if (known := self.memo.get(gram)) is None:
            if len(self.memo) > HELD_TOKENS:
                self.memo.clear()
            as_met, gram = gram, classed(gram)
            tri = (self.grams.get(gram, 0) + 0.02) / (self.before.get(gram[:-1], 0) + 8)
            pair = gram[1:]
            bi = (self.grams.get(pair, 0) + 0.02) / (self.before.get(pair[:-1], 0) + 20)
            self.memo[as_met] = known = math.log(0.75 * tri + 0.25 * bi)
        return known

    def best(self, token: str, home: frozenset[str]) -> str:
        """The token's best path through its look-alike lattice, or the token itself unless the path wins by MARGIN."""
        steps = self.lattice(token)
        if all(len(s) == 1 for s in steps):
            return token
        main = self.main_script(token, steps, home)
        paths: dict[str, tuple[float, str]] = {_BOUND * 2: (0.0, "")}
        for options in [*steps, [_BOUND]]:
            reached: dict[str, tuple[float, str]] = {}
            for context, (score, path) in paths.items():
                for option in options:
                    s, ctx = score, context
                    for c in option:
                        s += self.step(ctx, c) - self.mixing(c, main)
                        ctx = (ctx + c)[-2:]
                    if ctx not in reached or s > reached[ctx][0]:
                        reached[ctx] = (s, path + option)
            paths = reached
        score, path = max(paths.values())
        found = path.rstrip(_BOUND)
        return found if found != token and score > self.of(token, main) + MARGIN else token

    def of(self, token: str, main: str) -> float:
        score, context = 0.0, _BOUND * 2
        for c in token + _BOUND:
            score += self.step(context, c) - self.mixing(c, main)
            context = (context + c)[-2:]
        return score

    def mixing(self, c: str, main: str) -> float:
        return self.MIXED if c != _BOUND and (s := script(c)) != "-" and main and s != main else 0.0

    @staticmethod
    def main_script(token: str, steps: list[list[str]], home: frozenset[str]) -> str:
        """The script of most letters that look like no other script's; without such letters the script at home in the text that can spell most of the token."""
        sure = Counter(s for c in token if c not in _CHARS and (s := script(c)) != "-")
        every = Counter(s for options in steps for s in {script(o[0]) for o in options} if s != "-" and s in home)
        own = Counter(script(c) for c in token)
        return max(sure or every, key=lambda s: ((sure or every)[s], own[s], s), default="")

    @staticmethod
    def lattice(token: str) -> list[list[str]]:
        steps, i = [], 0
        while i < len(token):
            for width in (3, 2):
                if (target := _SEQUENCES.get(token[i : i + width])) and len(token[i : i + width]) == width:
                    steps.append([token[i : i + width], target])
                    i += width
                    break
            else:
                steps.append([token[i], *(x for x in _CHARS.get(token[i], ()) if x != token[i] and x not in NEVER_MEANT)])
                i += 1
        return steps


def home_scripts(text: str) -> frozenset[str]:
    """Scripts of the text's letters that look like no other script's, besides Devanagari and Latin, which are always at home."""
    return frozenset({"deva", "latn"} | {script(c) for c in set(text) if c not in _CHARS} - {"-"})


def canonical(text: str, scores: Scores, memo: dict[tuple[str, frozenset[str]], str]) -> str:
    """``text`` in consistent form: plain, then each token by its best look-alike path."""
    body = plain(text)
    home = home_scripts(body)

    def settle(m) -> str:
        token = m[0]
        if token.isascii() and "|" not in token:
            return token
        if (found := memo.get((token, home))) is None:
            if len(memo) > HELD_TOKENS:
                memo.clear()
            found, met = token, set()
            while found not in met:  # a changed token may have another main script
                met.add(found)
                found = scores.best(found, home)
            memo[token, home] = found
        return found

    return unicodedata.normalize("NFC", _TOKENS.sub(settle, body))


GRAM_SCHEMA = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])


def _gram_batch(tokens: Counter[str]) -> pa.RecordBatch:
    grams: Counter[str] = Counter()
    for token, n in tokens.items():
        padded = _BOUND * 2 + classed(token) + _BOUND
        for i in range(2, len(padded)):
            grams[padded[i - 2 : i + 1]] += n
            grams[padded[i - 1 : i + 1]] += n
    return pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array(list(grams.values()), pa.int64())], names=["gram", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                tokens.update(text.split())
        if len(tokens) > HELD_TOKENS:
            yield _gram_batch(tokens)
            tokens.clear()
    yield _gram_batch(tokens)


def grams(texts: DataFrame, text: str, least: int = 1) -> DataFrame:
    """Counts of the character bigrams and trigrams of all tokens of all texts, pre-aggregated in each task."""
    return texts.select(text).mapInArrow(_count_grams, GRAM_SCHEMA).groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def model(texts: DataFrame, text: str) -> dict[str, int]:
    """All grams of the corpus: bounded by its alphabet, as characters from ALPHABET_END on are one class."""
    return {r.gram: r.n for r in grams(texts, text).toLocalIterator()}


def _canonicaliser(counts) -> Callable:
    @F.pandas_udf(T.StringType())
    def settled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores, memo = Scores(counts.value), {}
        for texts in batches:
            yield pd.Series([canonical(t, scores, memo) if t and SUSPICIOUS.search(t) else t for t in texts], dtype=object)

    return settled


def consistent(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``text`` as stored, ``canonical_text`` and ``is_changed``, one row per row.

    A null text stays null and unchanged, as does an empty one; the form of a text depends only on the text and the
    corpus counts, so repeated rows agree. Other columns are dropped. Texts without a suspicious sign skip the search.
    """
    own = rows.select(*keys, F.col(text).alias("__text"))
    counts = own.sparkSession.sparkContext.broadcast(model(own, "__text"))
    found = own.withColumn("canonical_text", _canonicaliser(counts)("__text"))
    return found.select(*keys, F.col("__text").alias(text), "canonical_text", (~F.col("__text").eqNullSafe(F.col("canonical_text"))).alias("is_changed"))


def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = table(spark, sf_dir, "search_results").select(F.lit("search_results").alias("table_name"), F.col("search_id").alias("row_id"), "text")
    asked = table(spark, sf_dir, "correctness_results").select(F.lit("correctness_results").alias("table_name"), F.col("result_id").alias("row_id"), F.col("question").alias("text"))
    return search.unionByName(asked)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_canonical(spark, sf_dir).filter("is_changed").select("table_name", "row_id")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent(p4_rows(spark, sf_dir), ["table_name", "row_id"], "text")
