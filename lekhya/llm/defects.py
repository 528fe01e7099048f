"""Problem 3: broken prompt and response pairs.

Method: each response is compressed by zstandard with its prompt as raw-content dictionary, so that what the prompt
already says costs nothing; refusals and languages are told by dictionaries; truncation by the end automaton and the
terminal contexts of all answers.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lekhya.llm.memo import remembered
from lekhya.llm.terminals import judged, text_end, word_ends
from lekhya.sources import table

# Placeholders and notices that say nothing, as folded text.
PLACEHOLDERS = {"n/a", "na", "n.a", "null", "none", "nil", "nan", "undefined", "empty", "tbd", "todo", "[]", "{}", "()", "उत्तर", "जवाफ", "answer", "response", "output", "no answer", "no response", "no content", "उत्तर छैन", "जवाफ छैन", "खाली"}
ERROR_NOTICE = re.compile(r"^\W*(?:fatal |internal |server |api |http )*(?:error|exception|traceback|failed|failure|timeout|timed out|त्रुटि)\b", re.I)
# Words of machines and signs of code, by which the clauses of a long notice are told from those of an answer.
MACHINE_TALK = re.compile(r"\b(?:errno|exception|traceback|timeout|timed out|upstream|server|gateway|connection|api|https?|retry|retries|try again|rate limit|quota|unavailable|stack|null|no content|response|request|generat\w+|model|tokens?|unexpected|invalid|unknown|went wrong|occurred|could not be (?:parsed|read|loaded))\b|सर्भर|(?:फेरि|पुनः) प्रयास", re.I)
MACHINE_WORD = re.compile(r"[_/\\{}<>=@#]|\w[(:]\w|[a-z][.][a-z]|\(\)|^[\"']?\d+[\"',:)]*$")

# Clauses by which a whole answer declines, by language.
DECLINES = [
    # Nepali
    r"थाहा (?:छैन|भएन)", r"(?:दिन|भन्न|गर्न|लगाउन|बताउन|पुग्न)\s*(?:म\s*)?(?:सक्दिनँ|सक्दैन|सकिनँ|सकिएन|सकिँदैन|मिलेन|मिल्दैन|सम्भव (?:भएन|छैन)|असमर्थ (?:छु|छौँ))", r"असमर्थ (?:छु|छौँ)", r"राय दिनु उचित देखि(?:एन|न्न)",
    r"निष्कर्षमा पुग्न", r"सामग्रीमा (?:भेटिएन|छैन)", r"कार्यक्षेत्र\s*भन्दा बाहिर", r"अंशले यो कुरा छुँदैनन्", r"पर्याप्त (?:आधार|जानकारी|सन्दर्भ)\s*(?:न|छैन)", r"उपलब्ध\s.{0,30}सन्दर्भमा छैन", r"(?:जवाफ|उत्तर) (?:दिन्न|दिँदिनँ|उपलब्ध छैन)",
    r"(?:दिन|भन्न|गर्न|बताउन|खुलाउन|उत्तर) (?:नसक्ने|अस्वीकार)", r"(?:जानकारी|आधार|सामग्री|विवरण|सन्दर्भ) (?:मसँग )?(?:छैन|पाइएन|भेटिएन|पुग्दैन)",
    # Hindi
    r"(?:नहीं|न) (?:दे|बता|कह|कर) (?:सकता|सकती|सकते|पाऊँगा|पाऊँगी|पाया)", r"असमर्थ (?:हूँ|हैं)", r"(?:मुझे|मेरे पास) .{0,40}(?:नहीं|पता नहीं)", r"जानकारी (?:उपलब्ध )?नहीं", r"संभव नहीं", r"दायरे से बाहर", r"उत्तर नहीं",
    r"(?:जवाब|उत्तर|सलाह) देने (?:में असमर्थ|से इनकार)", r"क्षमा (?:करें|कीजिए).{0,60}नहीं",
    # French, German, Spanish, Portuguese, Italian, Russian
    r"\bje ne (?:peux|puis|sais) pas\b", r"\bne (?:peux|peut|pouvons) pas répondre\b", r"\bich (?:kann|weiß|darf) (?:das |dies |diese frage |es )?(?:leider )?nicht\b", r"\bkann (?:ich|diese frage).{0,40}nicht (?:beantworten|beantwortet|helfen)\b", r"\bno (?:puedo|sé|podemos) (?:responder|ayudar|contestar|decir)?", r"\bnão (?:posso|sei|podemos) (?:responder|ajudar|dizer)?",
    r"\bnon (?:posso|so|possiamo) (?:rispondere|aiutare|dire)?", r"\bне (?:могу|можем|знаю) (?:ответить|помочь|сказать)?",
    # English
    r"\b(?:i|we)(?: am| are|'m|'re) (?:unable|not able)\b", r"\b(?:i|we) (?:can ?not|can't|could not|couldn't|won't|will not|do not|don't) (?:help|answer|assist|provide|give|have|know|say|determine|comment)\b", r"do(?:es)? not let me answer", r"\bno answer (?:can|could) be given\b",
    r"\b(?:i|we) (?:must|have to|need to|will have to) (?:refuse|decline|leave)\b", r"\bcannot be answered\b", r"\b(?:against|violates?) (?:my|our|the) (?:guidelines|policy|policies)\b", r"\bno (?:basis|information|material) (?:to|for|on which)\b", r"\bas an ai\b", r"\bnot (?:in a position|permitted|allowed) to (?:answer|say|help|advise)\b",
    r"\bhave to decline\b", r"\bmust (?:decline|leave this)\b", r"\b(?:outside|beyond) (?:my|the|our) (?:scope|competence|remit)\b", r"\bnot (?:enough|sufficient) (?:material|context|information)\b", r"\bunable to (?:answer|give|help|provide|assist)\b", r"\bnot (?:available|found) in the (?:context|provided|supplied)",
]
# Courtesies around a refusal, which answer nothing either.
COURTESIES = [
    r"सोध्न सक्नुहुन्छ", r"परामर्श लिनुहोस्", r"भए पठाउनुहोला", r"सोध्नुभएकोमा धन्यवाद", r"^(?:क्षमा गर्नुहोला|माफ गर्नुहोस्|माफ पाऊँ|खेद छ|हेर्नुहोस्|कृपया|धन्यवाद)\W*$", r"सल्लाह लिनुहोस्",
    r"\bconsult (?:a|your) (?:lawyer|attorney|professional)\b", r"\b(?:try|ask) another question\b", r"\bthank you for asking\b", r"^(?:i am|i'm) sorry\W*$", r"^(?:unfortunately|however|sorry|regrettably|please)\W*$", r"\bसलाह लें\b", r"^(?:क्षमा करें|माफ़ करें|खेद है)\W*$",
    r"^(?:दफा|धारा|section)\s*\S{1,6}\s*(?:सम्बन्धमा|के सम्बन्धमा|के संबंध में)?\W*$", r"^regarding section\s*\S{1,6}$",
]
OUT_OF_SCOPE = re.compile(r"दायरा\s*बाहिर|(?:कानूनी )?आधार राखिएको छैन|कार्यक्षेत्र\s*भन्दा बाहिर|दायरे से बाहर|out[- ]of[- ]scope|outside the scope|not (?:covered|included|available) (?:in|by)", re.I)
# Letters of each script, at least a language a script.
SCRIPTS = {
    k: re.compile(v)
    for k, v in {
        "deva": r"[ऄ-ह]", "latn": r"[a-zß-öø-ɏ]", "cyrl": r"[Ѐ-ӿ]", "arab": r"[ء-يٮ-ۓ]", "el": r"[Ͱ-Ͽ]", "he": r"[א-ת]", "bn": r"[অ-হ]", "pa": r"[ਅ-ਹ]", "gu": r"[અ-હ]", "ta": r"[அ-ஹ]", "te": r"[అ-హ]", "kn": r"[ಅ-ಹ]",
        "ml": r"[അ-ഹ]", "si": r"[අ-ෆ]", "th": r"[ก-ฮ]", "bo": r"[ཀ-ཬ]", "my": r"[က-ဪ]", "ja": r"[ぁ-ヿ]", "ko": r"[가-힣]", "zh": r"[一-鿿]",
    }.items()
}
# Frequent function words by language, with the script they are written in.
FUNCTION_WORDS = {
    code: (of, frozenset(words.split()))
    for code, of, words in [
        ("en", "latn", "the of and to in is are was were be been that it its for on with as by at from this which or an not may must shall will would can has have had if any his her their they he she who what when where there these those than then but no such all each every under within after before into about between"),
        ("fr", "latn", "le la les des du un une et est sont dans pour par sur avec qui que ne pas au aux ce cette ces il elle ils elles se son sa ses leur ou où mais si être été peut doit sans sous entre après avant"),
        ("de", "latn", "der die das den dem des ein eine einer eines und ist sind war in im zu zum zur für von mit auf nicht sich wird werden kann muss oder aber wenn als auch bei nach vor über unter durch dass es er sie"),
        ("es", "latn", "el los las del un una y es son en para por con que no se su sus al lo como más pero si puede debe sin sobre entre este esta estos fue ser ha han cuando donde"),
        ("pt", "latn", "o os as do da dos das um uma e é são em no na nos nas para por com que não se seu sua ao como mais mas pode deve sem sobre entre este esta foi ser quando onde"),
        ("it", "latn", "il lo gli i del della dei delle un una e è sono in nel nella per con che non si suo sua al alla come più ma se può deve senza su tra questo questa ed"),
        ("nl", "latn", "de het een en is zijn van in op te voor met dat die niet aan er om ook als maar bij door over naar uit wordt worden kan moet of"),
        ("id", "latn", "yang dan di ke dari untuk dengan ini itu tidak adalah pada oleh atau dalam akan dapat harus juga sebagai karena jika"),
        ("ru", "cyrl", "и в не на что с по как это из к у за от для о он она они но или же бы был была были может должен если при"),
        ("uk", "cyrl", "і в не на що з по як це із до у за від для про він вона вони але або ж би був була були може повинен якщо при та є"),
        ("ar", "arab", "في من على إلى عن مع هذا هذه التي الذي أن لا ما هو هي كان كانت أو و قد كل بعد قبل بين إذا"),
        ("ur", "arab", "کے کی کا میں سے اور ہے ہیں نہیں یہ وہ اس کو پر بھی ایک تھا تھی تھے جو لیے کر سکتا"),
        ("fa", "arab", "در از به با که این آن را است می برای بر یا تا هم نیست باید شود اگر"),
        ("hi", "deva", "है हैं था थे थी का की के में से और नहीं यह वह उस इस अगर यदि जब हर तो लिए गई गया गए जाए जाता जाती होगा होगी हो सकता सकती सकते करना करने कोई पर भी एक साल महीने बाद भीतर अपनी अपना अपने किसी को ने या मुझे मैं आप हम उनके उसके इसके ही कर दिया"),
        ("mr", "deva", "आहे आहेत होता होते नाही आणि किंवा हा ही हे त्या या मध्ये साठी पासून करणे असेल शकतो शकते काही जर तर पण"),
        ("ne", "deva", "तर तैपनि छ छन् छु छौँ हो हुन् हुन्छ हुनेछ हुँदैन छैन छैनन् भयो भएन थियो थिए र वा पनि यो त्यो यी ती भने भन्ने अनि तथा मात्र बमोजिम अनुसार सम्बन्धी लागि मलाई हामी तपाईं म कुनै हरेक एउटा कि के को"),
    ]
}
# Case, plural and verb endings of Nepali.
NEPALI_ENDING = re.compile(r".(?:हरू|हरूले|हरूको|हरूलाई|को|ले|लाई|बाट|सँग|देखि|सम्म|भित्र|पछि|अगावै|पर्छ|पर्ने|सक्छ|सक्ने|गर्न|दिन|न्छ|न्छन्|नेछ|दैन|ँदैन|इन्छ|एको|कोमा|एमा|एका|एन|इन|िनँ|छौँ|नुहोस्|नुहोला|ोला)$")

_LETTERS = [re.compile("[ऀ-ॿ]"), re.compile("[a-z]"), re.compile("[а-я]")]


def _by_script(patterns: list[str]) -> list[tuple[re.Pattern, re.Pattern]]:
    """Each script's letters with the patterns that hold some outside of escapes, so that a clause is searched for those of its scripts only."""
    bare = {p: re.sub(r"\\.|\(\?\w*:", "", p) for p in patterns}
    found = [(letters, [p for p in patterns if letters.search(bare[p])]) for letters in _LETTERS]
    return [(letters, re.compile("|".join(own), re.I)) for letters, own in found if own]


_DECLINE, _COURTESY = _by_script(DECLINES), _by_script(COURTESIES)


def _searched(kind: list[tuple[re.Pattern, re.Pattern]], clause: str) -> re.Match | None:
    return next((m for letters, pattern in kind if letters.search(clause) and (m := pattern.search(clause))), None)


_CLAUSES = re.compile(r"[।॥?!;\n]+|[.](?=\s|$)")
_TURN = re.compile(r"(?:,\s*|\s)(?:but|however|nevertheless|nonetheless|still|yet|तर|तैपनि|तथापि|लेकिन|परन्तु|किन्तु|फिर भी)[\s,]+")
_GAPS = re.compile(r"\s+")
_INVISIBLE = regex.compile(r"\p{Cf}+")

#: An answer only gives back the question when its residual is at most this share of its own compressed size.
COPY_RESIDUAL = 0.45
#: Clauses of at least so many words that neither decline nor are courtesies are an answer.
ANSWER_WORDS = 4


@remembered
def fold(text: str | None) -> str:
    """Compatibility-normalised lower-case text without invisible signs, blanks single and trimmed; null is empty."""
    folded = unicodedata.normalize("NFKC", text or "").lower()
    if not folded.isascii():
        folded = _INVISIBLE.sub("", folded)
    return _GAPS.sub(" ", folded).strip()


def is_empty(folded: str) -> bool:
    core = folded.strip(" :.-—–…'\"`*_")
    return not any(c.isalnum() for c in core) or core in PLACEHOLDERS or is_notice(folded)


def is_notice(folded: str) -> bool:
    """Whether the text starts as an error notice and no clause of it, however long, says anything but machine talk, such as a trace."""
    start = ERROR_NOTICE.match(folded)
    if not start:
        return False
    clauses = [c.split() for c in _CLAUSES.split(folded[start.end() :])]
    return all(len(words) < ANSWER_WORDS or MACHINE_TALK.search(" ".join(words)) or 5 * sum(bool(MACHINE_WORD.search(w)) for w in words) >= len(words) for words in clauses)


def says_more(part: str) -> bool:
    return len(part.split()) >= ANSWER_WORDS and not _searched(_DECLINE, part) and not _searched(_COURTESY, part)


def is_refusal(folded: str) -> bool:
    """Whether the answer as a whole declines: some clause does, and neither another clause nor what follows a "but" behind the declining phrase says more than a courtesy."""
    declined = False
    for clause in _CLAUSES.split(folded):
        clause = clause.strip(" ,:-—'\"")
        if not clause:
            continue
        if found := _searched(_DECLINE, clause):
            if any(map(says_more, _TURN.split(clause[found.end() :])[1:])):
                return False
            declined = True
        elif len(clause.split()) >= ANSWER_WORDS and not _searched(_COURTESY, clause):
            return False
    return declined


class _Signs(dict):
    def __missing__(self, o: int) -> int:
        self[o] = o if o < 128 else o - 0x900 + 128 if 0x900 <= o < 0x980 else o * 31 % 251
        return self[o]


_SIGNS = _Signs()


def signs(text: str) -> bytes:
    """One byte a character, Devanagari behind ASCII, so that a match of zstandard is one of characters: in UTF-8 the shared lead bytes of a script pass for likeness."""
    return text.translate(_SIGNS).encode("latin-1")


def copy_residual(question: str, answer: str) -> float:
    """Compressed size of the answer given the question over its size alone: near 0 for a copy of the question or of a part of it, near 1 for unrelated text, however short."""
    if not question:
        return 1.0
    body = signs(answer)
    prompt = zstandard.ZstdCompressionDict(signs(question), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    given = len(zstandard.ZstdCompressor(dict_data=prompt, **plain).compress(body))
    alone = len(zstandard.ZstdCompressor(**plain).compress(body))
    return max(0, given - 9) / max(1, alone - 9)


@remembered
def language(folded: str) -> str:
    """Code of the main language, or empty when the text has too few letters or too few known words to tell.

    The script with most letters decides first. Scripts of several languages are told apart by function words, those
    of Devanagari also by the case and verb endings that Nepali joins to its words.
    """
    counts, letters = {}, sum(map(str.isalpha, folded))
    if letters < 8:
        return ""
    for name, pattern in SCRIPTS.items():  # the commonest first; a majority needs no more counting
        counts[name] = len(pattern.findall(folded))
        if 2 * counts[name] > letters:
            break
    main = max(counts, key=lambda k: counts[k])
    if main not in ("deva", "latn", "cyrl", "arab"):
        return main
    words = re.findall(r"[^\W\d_]+" if main != "deva" else r"[ऀ-ॣ]+", folded)
    hits = {code: sum(w in known for w in words) for code, (of, known) in FUNCTION_WORDS.items() if of == main}
    if main == "deva":
        hits["ne"] += sum(bool(NEPALI_ENDING.search(w)) for w in words if w not in FUNCTION_WORDS["ne"][1])
        if max(n for k, n in hits.items() if k != "ne") <= 2 * hits["ne"]:
            return "ne"
    best = max(hits, key=lambda k: (hits[k], k in ("ne", "en")))
    return best if hits[best] >= max(1, len(words) // 12) else ("ne" if main == "deva" else "en" if main == "latn" and len(words) < 12 else "")


PAIR_SCHEMA = T.StructType(
    [T.StructField("is_empty", T.BooleanType()), T.StructField("is_refusal", T.BooleanType()), T.StructField("residual", T.DoubleType()), T.StructField("other_language", T.BooleanType())]
)


@F.pandas_udf(PAIR_SCHEMA)
def pair_state(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for questions, answers, truths in batches:
        rows = []
        for question, answer, truth in zip(questions, answers, truths):
            q, a = fold(question), fold(answer)
            if is_empty(a):
                rows.append((True, False, 1.0, False))
                continue
            declines = is_refusal(a)
            substance = bool(fold(truth)) and not OUT_OF_SCOPE.search(truth) and not is_refusal(fold(truth))
            lq, la = language(q), language(a)
            rows.append((False, declines and substance, copy_residual(q, a), bool(lq and la and lq != la) and not declines))
        yield pd.DataFrame(rows, columns=["is_empty", "is_refusal", "residual", "other_language"])


def pair_defects(rows: DataFrame, key: str, question: str, answer: str, truth: str, baseline: list[str]) -> DataFrame:
    """``key``, ``defect`` (null for a sound pair), ``residual`` and the answer's end state, one row per row.

    The first of empty, refusal, copy, truncated and language that fits counts. A null or blank answer is empty; with
    a null question neither copy nor language can be; a null or blank ground truth has no substance, so a refusal is
    no defect there. Other columns are dropped.
    """
    own = rows.select(F.col(key), *(F.col(c).alias(f"__b_{c}") for c in baseline), F.col(question).alias("__q"), F.col(answer).alias("__a"), F.col(truth).alias("__t"))
    stated = own.withColumn("__s", pair_state("__q", "__a", "__t")).withColumn("__end", text_end(F.col("__a")))
    flat = stated.select(key, *(f"__b_{c}" for c in baseline), "__s.*", "__end.*")
    known = own.select(F.col("__a").alias("__text")).unionByName(own.select(F.col("__t").alias("__text")))
    ends = judged(flat, word_ends(known, "__text"), [f"__b_{c}" for c in baseline])
    defect = (
        F.when(F.col("is_empty"), "empty").when(F.col("is_refusal"), "refusal").when(F.col("residual") <= COPY_RESIDUAL, "copy").when(F.col("is_cut"), "truncated").when(F.col("other_language"), "language")
    )
    return ends.select(key, defect.alias("defect"), F.round("residual", 4).alias("residual"), F.col("state").alias("end_state"), "p_final")


def correctness_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(table(spark, sf_dir, "correctness_results"), "result_id", "question", "generated_answer", "ground_truth", ["export_source"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correctness_pairs(spark, sf_dir).filter(F.col("defect").isNotNull()).select("result_id", "defect")


def p3_defect_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share by export_source and defect type (``sound`` for none)."""
    rows = table(spark, sf_dir, "correctness_results")
    found = pair_defects(rows, "result_id", "question", "generated_answer", "ground_truth", ["export_source"]).join(rows.select("result_id", "export_source"), "result_id")
    counts = found.groupBy("export_source", F.coalesce("defect", F.lit("sound")).alias("defect")).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy("export_source").agg(F.sum("n_rows").alias("n_all"))
    return counts.join(totals, "export_source").select("export_source", "defect", "n_rows", F.round(F.col("n_rows") / F.col("n_all"), 6).alias("share"))
