"""Problem 2: records of evaluation splits that the training split also holds, exactly or almost.

Method: hashes of the word n-grams of the evaluation records, and least hashes of their single words and of trigrams
within words for texts that are reordered or respelled, are partitioned by hash, the training records are scanned for
hits, and the agreement with and containment in each training record hit is computed over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.llm.canonical import LOOK_ALIKES, plain
from lekhya.llm.memo import remembered
from lekhya.plans import cut
from lekhya.sources import table

#: Words of a gram: a pair with a fifth of its words changed, well spread, still shares some three-word grams.
GRAM = 3
#: Least share of an evaluation record's three-word grams of which no pair is lost by looking up its rarest ones.
CONTAINMENT = 0.3
#: Of the three-word grams looked up so many must hit.
HITS = 3
#: Bands and least hashes in a band of the two kinds of single tokens, whose order doesn't count: words, and character
#: trigrams within words. Texts are compared that meet in MEETINGS bands. Texts of agreement 0.8 share two thirds of their
#: tokens of one kind, so a band of r holds them with probability q = (2/3)**r and they are compared with 1 - (1 - q)**b -
#: b q (1 - q)**(b - 1): 0.998 by words, 0.994 by trigrams, more the more they agree. Texts that share a fifth of their
#: trigrams are with one in a hundred thousand.
BANDS = {"w": (60, 5), "c": (80, 6)}
MEETINGS = 2
#: Least agreement (see ``agreement``) of an overlap.
AGREEMENT = 0.8

# Devanagari signs that writers interchange, to the one they are compared by.
SPELLINGS = {"ी": "ि", "ू": "ु", "ई": "इ", "ऊ": "उ", "ँ": "ं", "ब": "व", "श": "स", "ष": "स", "ञ": "न", "ङ": "न", "ण": "न", "़": "", "्": "", "ः": ""}
_FOLD = str.maketrans({alt: group[0] for group in LOOK_ALIKES for alt in group if len(alt) == 1} | dict(zip("०१२३४५६७८९", "0123456789")))
_SPELL = str.maketrans(SPELLINGS)
_WORD = re.compile(r"[^\W_]+")
_SIGNS = re.compile(r"[^\w\sऀ-ॣ]+|[_।॥:|]")

def normal(text: str | None) -> str:
    """Words compared by: canonical characters, folded case, digits, look-alikes and interchangeable spellings, no signs."""
    folded = plain(text or "").lower().translate(_FOLD)
    return " ".join(_SIGNS.sub(" ", folded).translate(_SPELL).split())


def word_grams(norm: str, n: int = GRAM) -> list[int]:
    """Distinct 64-bit hashes of the word n-grams; a shorter text is one gram, an empty one none."""
    words = norm.split()
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    return [h - (1 << 64) if h >> 63 else h for h in dict.fromkeys(map(xxhash.xxh3_64_intdigest, grams))]


def _trigrams(words: Counter) -> Counter:
    return Counter(f" {w} "[i : i + 3] for w in words.elements() for i in range(len(w)))


@remembered
def _counted(norm: str) -> tuple[Counter, Counter]:
    words = Counter(norm.split())
    return words, _trigrams(words)


def token_hashes(norm: str) -> tuple[list[int], list[int]]:
    """64-bit hashes of the words and of the character trigrams within words, each occurrence a token of its own."""
    words, signs = _counted(norm)
    kinds = (("w", words), ("c", signs))
    digests = [[xxhash.xxh3_64_intdigest(f"{kind} {token} {nth}") for token, n in tokens.items() for nth in range(n)] for kind, tokens in kinds]
    return tuple([h - (1 << 64) if h >> 63 else h for h in x] for x in digests)


#: Tokens hashed in one go.
_HELD = 4096
_FACTORS = {kind: (np.random.default_rng(20240607 + i).integers(0, 1 << 32, size=(2, b * r, 1), dtype=np.uint64) | np.uint64(1)).astype(np.uint32) for i, (kind, (b, r)) in enumerate(BANDS.items())}


def bands(tokens: list[int], kind: str) -> np.ndarray:
    """One 64-bit key a band: a mix of the least 32-bit hashes of all tokens under the functions of the band, the same for the same tokens in any order."""
    n_bands, width = BANDS[kind]
    factor, shift = _FACTORS[kind]
    own = (np.array(tokens, dtype=np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    least = np.full(n_bands * width, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(own), _HELD):
        mixed = own[None, i : i + _HELD] * factor
        mixed ^= mixed >> np.uint32(15)
        mixed *= factor
        mixed += shift
        least = np.minimum(least, mixed.min(axis=1))
    keys = np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(kind))
    for column in least.reshape(n_bands, width).T:
        keys = (keys ^ column) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


SKETCH_SCHEMA = T.StructType([T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(SKETCH_SCHEMA)
def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for norms in batches:
        told = [token_hashes(x) for x in norms]
        yield pd.DataFrame({"grams": [word_grams(x) for x in norms], "bands": [np.concatenate([bands(t, kind) for t, kind in zip(tokens, BANDS)]) for tokens in told]})


@F.pandas_udf(T.StringType())
def normals(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([normal(t) for t in texts], dtype=object)


def _dice(a: Counter, b: Counter) -> float:
    whole = a.total() + b.total()
    if len(a) > len(b):
        a, b = b, a
    return 2 * sum(min(n, b[t]) for t, n in a.items() if t in b) / whole if whole else 0.0


def agreement(a: str, b: str) -> float:
    """Share of two normal texts that agrees, whatever its order: the larger Dice coefficient of their words and of their character trigrams within words."""
    if a == b:
        return 1.0
    (words, signs), (other_words, other_signs) = _counted(a), _counted(b)
    return max(_dice(words, other_words), _dice(signs, other_signs))


def containment(a: str, b: str) -> float:
    """Share of the three-word grams of a that b holds."""
    own, other = set(word_grams(a)), set(word_grams(b))
    return len(own & other) / len(own) if own else 0.0


@F.pandas_udf(T.StructType([T.StructField("agreement", T.DoubleType()), T.StructField("containment", T.DoubleType())]))
def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for a, b in batches:
        scores = [agreement(x, y) for x, y in zip(a, b)]
        yield pd.DataFrame({"agreement": scores, "containment": [containment(x, y) if s >= AGREEMENT else 0.0 for s, x, y in zip(scores, a, b)]})


def split_class(split: Column) -> Column:
    """``train``, ``eval`` or null for no split, however the split's name is written."""
    name = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    return F.when(name == "train", "train").when(name.isin("development", "dev", "validation", "test"), "eval")


def linked(records: DataFrame, theta: float = CONTAINMENT, least: float = AGREEMENT) -> tuple[DataFrame, DataFrame]:
    """Members (id, class, text) of each text and the agreeing texts (eval_text, train_text, agreement, containment) of ``records`` (id, text, class).

    Texts that normalise alike are one text, named by a 128-bit hash, so a group of copies costs as much as one. An
    evaluation text and a training text are compared when they share a key of one of two kinds, both partitioned by
    hash. Word three-grams: of an evaluation text's m grams the m - ceil(theta m) + HITS that are rarest in training are
    looked up; any text that holds a share theta of the grams holds HITS of these (or all it must), so no such pair is lost
    and formulaic grams that a third of all rows share aren't joined. Bands of least hashes over single words and over trigrams within
    words, whatever their order: see BANDS for what they find. A key is 64 bits; texts whose keys collide are compared
    by their words like all others.
    """
    rows = records.filter(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("class").isNotNull()).select("id", "class", "text").distinct()
    told = rows.select("id", "class", normals("text").alias("norm")).filter("norm <> ''")
    told = cut(told.select("id", "class", "norm", F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("h2")).distinct())
    members = told.select("id", "class", F.struct("h", "h2").alias("text"))
    texts = told.groupBy("h", "h2").agg(F.first("norm").alias("norm"), F.bool_or(F.col("class") == "train").alias("train"), F.bool_or(F.col("class") == "eval").alias("eval"))
    sketched = cut(texts.select("h", "train", "eval", sketches("norm").alias("s")).select("h", "train", "eval", "s.*"))

    def keyed(side: str, kind: str) -> DataFrame:
        return sketched.filter(side).select(F.col("h").alias(f"{side}_h"), F.size(kind).alias("m"), F.explode(kind).alias("key"))

    train_grams = keyed("train", "grams").select("train_h", "key")
    frequency = train_grams.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    held = keyed("eval", "grams").join(frequency, "key", "left")
    ranked = held.withColumn("nth", F.row_number().over(Window.partitionBy("eval_h").orderBy(F.coalesce("df", F.lit(0)), "key")))
    need = F.greatest(F.ceil(F.col("m") * theta - 1e-9), F.lit(1))
    ranked = ranked.withColumn("least", F.least(need, F.lit(HITS)))
    looked_up = ranked.filter((F.col("nth") <= F.col("m") - need + F.col("least")) & F.col("df").isNotNull()).select("eval_h", "key", "least")
    hits = looked_up.join(train_grams, "key").groupBy("eval_h", "train_h").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).filter("n >= least").select("eval_h", "train_h")
    met = keyed("eval", "bands").select("eval_h", "key").join(keyed("train", "bands").select("train_h", "key"), "key").groupBy("eval_h", "train_h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MEETINGS).select("eval_h", "train_h")
    pairs = hits.unionByName(met).distinct()
    side = lambda of, name: told.filter(F.col("class") == of).groupBy("h", "h2").agg(F.first("norm").alias(name)).select(F.col("h").alias(f"{of}_h"), F.struct("h", "h2").alias(f"{of}_text"), name)
    both = pairs.join(side("eval", "a"), "eval_h").join(side("train", "b"), "train_h").withColumn("s", compared("a", "b"))
    return members, cut(both.select("eval_text", "train_text", "s.*").filter(F.col("agreement") >= least))


def cross_overlaps(records: DataFrame, theta: float = CONTAINMENT, least: float = AGREEMENT) -> DataFrame:
    """Overlaps (eval_id, train_id, agreement, containment) of ``records`` (id, text, class), class ``train`` or ``eval``.

    A record may have several texts; the best pair of texts counts. Null, empty and sign-only texts, null ids and null
    classes overlap with nothing; repeated rows count once. See ``linked`` for which texts are compared.
    """
    members, agreed = linked(records, theta, least)
    by = {c: members.filter(F.col("class") == c).select(F.col("id").alias(f"{c}_id"), F.col("text").alias(f"{c}_text")) for c in ("train", "eval")}
    pairs = agreed.join(by["eval"], "eval_text").join(by["train"], "train_text").filter("eval_id <> train_id")
    return pairs.groupBy("eval_id", "train_id").agg(F.max("agreement").alias("agreement"), F.max("containment").alias("containment"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    classes = items.select("id", split_class(F.col("split")).alias("class")).filter(F.col("class").isNotNull()).distinct()
    asked = table(spark, sf_dir, "correctness_results").select(F.col("question_id").alias("id"), F.col("question").alias("text"))
    return items.select("id", F.col("question").alias("text")).unionByName(asked).distinct().join(classes, "id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_overlaps(questions(spark, sf_dir))
    return found.select(F.least("eval_id", "train_id").alias("question_id_a"), F.greatest("eval_id", "train_id").alias("question_id_b")).distinct()


def p2_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: items, items that training also holds, their share, how many hold it word for word, and training texts and records in agreement.

    Counted by the sizes of the texts' classes: copies are never expanded into pairs. An item whose questions differ
    in their words counts its training texts and records once a text.
    """
    items = table(spark, sf_dir, "eval_items").filter(split_class(F.col("split")) == "eval").select(F.col("id").alias("eval_id"), F.lower(F.regexp_replace("split", r"(?U)\s", "")).alias("split"), "source").distinct()
    members, agreed = linked(questions(spark, sf_dir))
    copies = members.filter("class = 'train'").groupBy(F.col("text").alias("train_text")).agg(F.count(F.lit(1)).alias("n"))
    by_text = agreed.join(copies, "train_text").groupBy("eval_text").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_records"), F.max(F.col("agreement") >= 1).alias("is_exact"))
    found = members.filter("class = 'eval'").select(F.col("id").alias("eval_id"), F.col("text").alias("eval_text")).join(by_text, "eval_text").groupBy("eval_id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_records").alias("n_records"), F.max("is_exact").alias("is_exact"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = items.join(found, "eval_id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_items"), F.count("n_texts").alias("n_overlapping"), F.count_if(F.col("is_exact")).alias("n_exact"), zero("n_texts"), zero("n_records"))
    return counted.withColumn("overlap_share", F.round(F.col("n_overlapping") / F.col("n_items"), 6))
