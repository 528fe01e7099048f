"""Source routing of questions by explicit names and a lexical profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.functions import text as tx

# The frozen lexical profile (source, phrase, weight), the cues that ask for both sources, the weight of an explicit name.
PROFILE = [
    ("domestic_violence", "घरेलु हिंसा", 5), ("domestic_violence", "घरेलु सम्बन्ध", 4), ("domestic_violence", "पीडक", 3), ("domestic_violence", "संरक्षणात्मक आदेश", 4), ("domestic_violence", "आर्थिक यातना", 4),
    ("domestic_violence", "मानसिक यातना", 4), ("domestic_violence", "शारीरिक यातना", 4), ("domestic_violence", "यौनजन्य यातना", 4), ("domestic_violence", "दाइजो", 3), ("domestic_violence", "आर्थिक स्रोतबाट वञ्चित", 4),
    ("domestic_violence", "रासायनिक पदार्थ", 3), ("muluki_ain", "सम्बन्ध विच्छेद", 5), ("muluki_ain", "अंशबण्डा", 5), ("muluki_ain", "अपुताली", 5), ("muluki_ain", "उत्तराधिकार", 4), ("muluki_ain", "करार", 4),
    ("muluki_ain", "संरक्षकत्व", 4), ("muluki_ain", "धर्मपुत्र", 4), ("muluki_ain", "धर्मपुत्री", 4), ("muluki_ain", "नाबालकलाई जिम्मा", 4), ("muluki_ain", "दीर्घकालीन जिम्मा", 4), ("muluki_ain", "मानाचामल", 4),
    ("muluki_ain", "खान-लाउन", 3), ("muluki_ain", "खान लाउन", 3), ("muluki_ain", "रोजगारी गर्न रोक", 3),
]
SOURCES = ["muluki_ain", "domestic_violence"]
BOTH_CUES = ["दुवै ऐन", "दुबै ऐन", "दुवै कानून", "दुबै कानून", "दुवै कानुन", "दुबै कानुन"]
EXPLICIT_WEIGHT, SIGNAL = 100, 3
#: Weight of meaning for section_lookup, definition and general questions.
ALPHAS = (0.3, 0.6, 0.55)
MODES = ["hybrid", "faiss_only", "bm25_only", "routed_hybrid"]


def explicit_sources(norm: Column) -> Column:
    """Sources a question names, in registry order."""
    named = [
        F.when(norm.contains("मुलुकी देवानी") | norm.contains("देवानी संहिता"), "muluki_ain"),
        F.when(norm.contains("घरेलु हिंसा") & (norm.contains("ऐन") | norm.contains("कसूर र सजाय")), "domestic_violence"),
    ]
    return F.array_compact(F.array(*named))


def matched(norm: Column, source: str) -> Column:
    """Profile phrases of a source that the question contains, in profile order."""
    return F.array_compact(F.array(*(F.when(norm.contains(p), p) for s, p, _ in PROFILE if s == source)))


def score(norm: Column, source: str) -> Column:
    named = F.when(F.array_contains(explicit_sources(norm), source), EXPLICIT_WEIGHT).otherwise(0)
    return sum((F.when(norm.contains(p), w).otherwise(0) for s, p, w in PROFILE if s == source), named)


def routes(questions: DataFrame, key: str, text: str) -> DataFrame:
    """Route of each question: score_<source>, explicit and signalled sources, route_type, sources, diversify.

    Phrases are a fixed list, so the theta join with the profile is unrolled into one codegen projection per question.
    """
    norm = F.col("__norm")
    base = questions.select(key, tx.spaced(F.coalesce(F.col(text), F.lit(""))).alias("__norm"))
    scored = base.select(key, "__norm", explicit_sources(norm).alias("explicit"), *(score(norm, s).cast("long").alias(f"score_{s}") for s in SOURCES))
    signalled = F.array_compact(F.array(*(F.when(F.col(f"score_{s}") >= SIGNAL, s) for s in SOURCES)))
    told = scored.withColumn("signalled", signalled).withColumn("asks_both", F.greatest(*(F.col("__norm").contains(c) for c in BOTH_CUES)))
    both = F.array(*map(F.lit, SOURCES))
    multi, all_two, single, named = (F.size("explicit") > 1) | (F.size("signalled") > 1), F.col("asks_both"), F.size("signalled") == 1, F.size("explicit") == 1
    chosen = F.filter(both, lambda s: F.array_contains(F.col("explicit"), s) | F.array_contains(F.col("signalled"), s))
    typed = told.withColumn("route_type", F.when(multi | all_two, "multi_source").when(single | named, "single_source").otherwise("global"))
    sources = F.when(multi, chosen).when(all_two, both).when(single, F.col("signalled")).when(named, F.col("explicit")).otherwise(both)
    return typed.withColumn("sources", sources).withColumn("diversify", (F.col("route_type") == "multi_source") & (F.size("sources") > 1)).drop("__norm")


def constraint(mode: Column) -> Column:
    """The source every result must have: the one explicitly named, else the inferred one of a routed search."""
    explicit = F.when((F.size("explicit") == 1) & ~F.col("diversify"), F.element_at("explicit", 1))
    inferred = F.when((mode == "routed_hybrid") & (F.col("route_type") == "single_source") & (F.size("sources") == 1), F.element_at("sources", 1))
    return F.coalesce(explicit, inferred)


def query_type(c: Column) -> Column:
    """``section_lookup`` for a numbered section, ``definition`` for what something is or means, else ``general``."""
    return F.when(c.rlike(r"दफा\s*[०-९0-9]+|(?i)section\s*[०-९0-9]+"), "section_lookup").when(c.rlike(r"परिभाषा|भनेको के|के हो|अर्थ के|(?i)what is|define"), "definition").otherwise("general")


def alpha(mode: Column, kind: Column) -> Column:
    return F.when(mode == "faiss_only", 1.0).when(mode == "bm25_only", 0.0).when(kind == "section_lookup", ALPHAS[0]).when(kind == "definition", ALPHAS[1]).otherwise(ALPHAS[2])


def mentioned_sections(c: Column) -> Column:
    """Section numbers a question mentions, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(tx.ascii_digits(c)), F.lit(r"(?:दफा|section)\s*([0-9]+(?:[क-हa-z](?![ऀ-ॣa-z]))?)"), 1), lambda x: x))


def variants(c: Column) -> Column:
    """The question, its spaced form with ASCII digits, and it without a leading courtesy; each once."""
    norm = tx.ascii_digits(tx.spaced(c))
    return F.array_distinct(F.array(c, norm, F.regexp_replace(norm, r"^(?:कृपया[^,]*,|please tell me:|जानकारी पाऊँ:)\s*", "")))
