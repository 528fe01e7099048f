import random
import unicodedata

from pyspark.sql import functions as F

from lekhya.llm import canonical as can
from lekhya.llm import defects, truncation
from lekhya.llm.structure import end_of, open_stack

DONE = "पहिलो वाक्य सकियो। दोस्रो वाक्य पनि यहाँ सकिन्छ।"


def test_automaton_states():
    states = {
        "पूरा भयो।": "marked", "It ends here.": "marked", '{"score": 0.4, "reasoning": "It ends here."}': "closed", "It ends (section 12)": "closed", "It ends. Score: 0.8": "closed", "सकियो। अङ्क: ०.६": "closed", "“It ends here”": "closed",
        "यो प्रमाण�": "broken", "tail \\u09": "broken", "tail &am": "broken", "and then …": "ellipsis", "and then...": "ellipsis", "It says (see the": "open", "plain tail": "bare", "": "empty", "  \n​": "empty",
    }
    assert {t: end_of(t).state for t in states} == states
    assert end_of(None).state == "empty"
    assert [s for s, _ in open_stack('a (b [c] “d <b>e "f')] == ["(", "“", "<b", '"']
    assert open_stack("a) b] c}") == []
    assert end_of("x " * 200_000 + "(y").state == "open"


def test_open_quotes_braces_and_tags_decide():
    cut_off = ['He said "', 'It ends. He said "the plain tail', '{"reasoning": "It ends. The plain tail', '“It ends. A plain tail', "It ends. <b>A plain tail", '{"score": 0.4, "reasoning": "It ends', "It says «a plain tail", "`code tail", '{"score": 0.8']
    assert [t for t in cut_off if end_of(t).state != "open"] == []
    whole = {'He said "so"': "closed", 'A 12" pipe': "bare", "First<br>second line": "bare", "<p>A plain tail": "bare", '“It ends here.': "marked", '"a" <b>c</b> {d} tail': "bare", "a} ” tail": "bare"}
    assert {t: end_of(t).state for t in whole} == whole


def test_percents_and_ampersands_that_close_words_and_scores():
    whole = {"It is correct. Score: 90%": "closed", "जवाफ सही छ। अंक: 80%": "closed", "handled by R&D": "bare", "AT&T": "bare", "a share in %": "bare", "The total is 3.": "marked", '"The total is 3."': "closed"}
    assert {t: end_of(t).state for t in whole} == whole
    torn = ["tail &am", "x &#12", "AT&amp;T and AT&am", "see http://a.b/c%E", "a%20b%2", "R&", "x &", "tail \\u09"]
    assert [t for t in torn if end_of(t).state != "broken"] == []


def test_signs_left_open_behind_a_final_mark():
    cut_off = ['{"score": 1, "reason": "ok.', "<b>Correct.", "He said “yes and.", "It says (see section 5."]
    assert [t for t in cut_off if end_of(t).state != "open"] == []
    assert [t for t in ("“It ends here.", "(It ends here.", "in the ‘90s it was.", "a) It ends.") if end_of(t).state != "marked"] == []


def test_long_citations_and_words():
    assert end_of(f"It ends ({'see section 5 ' * 40})").state == "closed"
    assert end_of("x " + "y" * 5000).last_word == "y" * 5000


def test_open_quote_outweighs_a_final_word(spark):
    texts = [DONE] * 30 + ["पहिलो वाक्य सकियो। उनले “दोस्रो वाक्य पनि यहाँ सकिन्छ"]
    assert [r.id for r in truncation.ends(rows(spark, texts), "body", ["id"], ["source"]).filter("is_cut").collect()] == [30]


def rows(spark, texts, **more):
    return spark.createDataFrame([(i, "s", t, 0) for i, t in enumerate(texts)], "id long, source string, body string, state int")


def test_truncation_by_terminal_context(spark):
    texts = [DONE] * 30 + ["पहिलो वाक्य सकियो। दोस्रो वाक्य पनि यहाँ सकिन्छ", "पहिलो वाक्य सकियो। दोस्रो वाक्य", "पहिलो वाक्य सकियो। दोस्रो वा", None, "", "पहिलो (हेर्नुहोस् यहाँ"]
    got = {r.id: r.is_cut for r in truncation.ends(rows(spark, texts), "body", ["id"], ["source"]).collect()}
    assert {i for i, c in got.items() if c} == {31, 32, 35} and len(got) == len(texts)


def test_truncation_empty_table_and_repeats(spark):
    empty = truncation.ends(rows(spark, [DONE]).limit(0), "body", ["id"], ["source"])
    assert empty.count() == 0
    twice = rows(spark, [DONE, "कटेको पाठ य"])
    assert truncation.ends(twice.unionAll(twice), "body", ["id"], ["source"]).filter("is_cut").count() == 2


def test_defects(spark):
    q = "कुन निकायमा निवेदन दिन सकिन्छ भनी खोलामा बस्ने विपक्षी पीडितले सोधेको अवस्थामा के गर्नुपर्छ?"
    gt = "दफा ३: सम्बन्धित किसानले दर्ता गर्नुपर्छ।"
    fine = "दफा ३ बमोजिम सम्बन्धित किसानले कार्यालयमा तीन महिनाभित्र दर्ता गर्नुपर्छ।"
    cases = [
        (None, gt, "empty"), ("​ \n", gt, "empty"), ("N/A", gt, "empty"), ("ERROR 503 (no content)", gt, "empty"), ("उत्तर:", gt, "empty"),
        ("माफ पाऊँ, मलाई यसबारे थाहा छैन।", gt, "refusal"), ("माफ पाऊँ, मलाई यसबारे थाहा छैन।", "यो विषय सङ्कलित ऐनहरूको दायराबाहिर छ।", None), ("I am unable to help; please consult a lawyer.", gt, "refusal"),
        ("रकम कति हो थाहा छैन; तैपनि " + fine, gt, None), ("माफ पाऊँ, मलाई यसबारे थाहा छैन।", None, None), (q, gt, "copy"), ("प्रश्न: " + q, gt, "copy"), (q + " " + " ".join([fine] * 3), gt, None),
        (fine[:-12], gt, "truncated"), (fine[:-1], gt, None), (fine, gt, None), ("Every written petitioner may inspect the ancestral contract ownership for ten weeks.", gt, "language"), ("हो, पाइन्छ।", gt, None),
    ]
    data = [(i, q, a, t, "s") for i, (a, t, _) in enumerate(cases)] + [(100 + i, q, f"{fine} {i} पटक दर्ता गर्नुपर्छ।", gt, "s") for i in range(30)]
    df = spark.createDataFrame(data, "result_id long, question string, generated_answer string, ground_truth string, state string")
    got = {r.result_id: r.defect for r in defects.pair_defects(df, "result_id", "question", "generated_answer", "ground_truth", ["state"]).collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: d for i, (_, _, d) in enumerate(cases)}
    assert all(got[100 + i] is None for i in range(30))
    assert defects.pair_defects(df.limit(0), "result_id", "question", "generated_answer", "ground_truth", ["state"]).count() == 0


def test_long_refusals_and_notices():
    ramble = "about the several kinds of ancestral property that a widow and the married daughters of a joint family hold together in the hills and in the plains of the eastern districts"
    refusals = [f"I am unable to answer the question {ramble}.", f"As for the question {ramble}, we do not know.", f"{'पैतृक सम्पत्ति सम्बन्धी यो प्रश्नमा ' * 6}मलाई थाहा छैन।"]
    assert [r for r in refusals if len(r) <= 160 or not defects.is_refusal(defects.fold(r))] == []
    answers = ["I do not know the exact fee, but the farmer must register within three months.", f"I do not know {ramble}, but the farmer must register within three months.", "रकम कति हो थाहा छैन, तर किसानले तीन महिनाभित्र दर्ता गर्नुपर्छ।"]
    assert [a for a in answers if defects.is_refusal(defects.fold(a))] == []
    assert defects.is_refusal(defects.fold("I am unable to answer this, but you may consult a lawyer."))
    trace = "Traceback (most recent call last):\n" + "".join(f'  File "/app/judge_{i}.py", line {i}, in call_model\n    reply = client.create(model=name, text=prompt)\n' for i in range(9)) + "ValueError: bad reply"
    java = "Exception in thread main java.lang.IllegalStateException: closed\n" + "".join(f"\tat org.apache.spark.Task{i}.run(Task.java:{i})\n" for i in range(9))
    assert min(len(trace), len(java)) > 300 and defects.is_empty(defects.fold(trace)) and defects.is_empty(defects.fold(java))
    assert not defects.is_empty(defects.fold(f"Error of law is a ground of appeal. The farmer may appeal within thirty days {ramble}."))
    assert not defects.is_empty(defects.fold(trace + ". The farmer must register the land at the office within three months."))


def test_parts_of_the_question_are_copies_at_every_length():
    q = "In Vigohe the private creditor holds its agricultural inventory copy, whose consent is needed for the pending sale of the eastern pond?".lower()
    assert all(defects.copy_residual(q, q[:n]) <= defects.COPY_RESIDUAL for n in (25, 35, 45, 60, 90, len(q)))
    assert all(defects.copy_residual(q, a) > 0.6 for a in ("yes, it may.", "हो, पाइन्छ।", "the court decides within ten weeks."))


def test_notices_are_judged_alike_at_every_length():
    assert all(defects.is_empty(defects.fold(t)) for t in ("Error: upstream call timed out", "Error: could not generate a response", "Error: " + "upstream call timed out; " * 40))
    assert not any(defects.is_empty(defects.fold(t)) for t in ("Error: the farmer must register the land.", "Error: " + "the farmer must register the land; " * 40))


def test_languages():
    told = {
        "The farmer must register the land in the office.": "en", "Le créancier doit être informé par le tribunal dans les dix jours.": "fr", "Der Gläubiger muss von dem Gericht informiert werden.": "de", "El acreedor debe ser informado por el tribunal.": "es", "Должник не может продать дом.": "ru",
        "债权人必须在十天内收到通知书": "zh", "किसानले कार्यालयमा तीन महिनाभित्र दर्ता गर्नुपर्छ।": "ne", "किसान को तीन महीने के भीतर कार्यालय में दर्ज करना होगा।": "hi", "हो": "", "123": "",
    }
    assert {t: defects.language(defects.fold(t)) for t in told} == told


def test_copy_residual_orders_texts():
    q = "In Vigohe the private creditor holds its agricultural inventory copy, whose consent is needed?"
    assert defects.copy_residual(q, q) < 0.2
    assert defects.copy_residual(q, q.replace("creditor", "director")) < defects.COPY_RESIDUAL
    assert defects.copy_residual(q, "Every communal dependant may challenge the northern verdict papers after nineteen long weeks of waiting.") > 0.6
    assert defects.copy_residual("", "x") == 1.0


BASE = ["नियमित रूपमा दर्ता गर्नुपर्छ।", "निःशुल्क राहत १०४ दिनअगावै।", "आदेश दिनेछ Act Register।", "दुःखपूर्वक सूचना Notice Board।", "जानकारी पाऊँ: सडक", "Señal Vañor code 407", "सम्बन्धी कागजात Schedule C।", "औजार साटेमा बाँडफाँट।"] * 40


def test_canonical_forms(spark):
    changed = {
        "निःशुल्क": "नि:शुल्क", "आदेश": "अादेश", "दिनेछ।": "दिनेछ|", "१०४ दिनअगावै": "१০४ दिनअगावै", "Act": "Aсt", "Señal": "Sen\u0303al", "Notice Board": "Ｎｏｔｉｃｅ Board", "दर्ता गर्नुपर्छ": "दर्ता\u2007गर्नुपर्छ", "राहत": "रा\u200bहत", "औजार": "अौजार", "सडक": "स\u00adडक",
    }
    texts = BASE + [b for b in changed.values()]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(9990, None, "x"), (9991, "", "x"), (9992, "a" * 100_000 + " क", "x")], "id long, t string, canonical_text string")
    got = {r.id: r for r in can.consistent(df.select("id", "t"), ["id"], "t").collect()}
    assert not any(got[i].is_changed for i in range(len(BASE)))
    for i, (want, bad) in enumerate(changed.items()):
        assert got[len(BASE) + i].canonical_text == want, (bad, got[len(BASE) + i].canonical_text)
    assert got[9990].canonical_text is None and not got[9990].is_changed and not got[9991].is_changed and not got[9992].is_changed
    assert can.consistent(df.limit(0), ["id"], "t").count() == 0


def test_stray_bars_behind_latin_words_and_digits(spark):
    words = ["Copy", "Vañor", "Réseau", "(Code 407)"]
    texts = [f"PDF {w}।" for w in words] * 40 + [f"PDF {w}|" for w in words]
    got = can.consistent(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t").filter("is_changed").collect()
    assert {r.id: r.canonical_text for r in got} == {160 + i: texts[i] for i in range(4)}


def test_model_holds_every_gram(spark):
    n = 250  # distinct letters, so more than 400,000 distinct grams
    letters = [chr(0x1200 + i) for i in range(n)]
    texts = ["".join(a + b + c for c in letters[: n // 5]) for a in letters for b in letters[: n // 5]]
    want = can.Counter()
    for w in texts:
        p = "\x02\x02" + w + "\x02"
        for i in range(2, len(p)):
            want[p[i - 2 : i + 1]] += 1
            want[p[i - 1 : i + 1]] += 1
    assert len(want) > 400_000 and can.model(spark.createDataFrame([(t,) for t in texts], "t string"), "t") == want


def test_no_skipped_text_changes():
    scores = can.Scores({"\x02\x02" + x: 10**6 for group in can.LOOK_ALIKES for x in group})  # every rewriting is tempting
    around = ["{}", "a{}", "{}a", "क{}", "{}क", "e{}ñ", "अ{}", "{}े"]
    texts = [a.format(c) for c in map(chr, range(0x30000)) if not 0xD800 <= ord(c) < 0xE000 for a in around[: 8 if ord(c) < 0x3000 else 1]]
    assert not [t for t in texts if not can.SUSPICIOUS.search(t) and can.canonical(t, scores, {}) != t]
    ascii_signs = [chr(c) for c in range(0x20, 0x7F)] + list("\t\n\r")
    assert not [t for t in (x + y for x in ascii_signs for y in ascii_signs) if not can.SUSPICIOUS.search(t) and can.canonical(t, scores, {}) != t]


def test_signs_beyond_the_alphabet_score_as_they_are_counted():
    counted = can._gram_batch(can.Counter({"“कर”": 100}))
    scores = can.Scores(dict(zip(*(c.to_pylist() for c in counted.columns))))
    assert scores.step("\x02\x02", "“") == scores.step("\x02\x02", "”") > -1


def test_sequences_that_look_like_one_sign(spark):
    texts = ["उसलाई दिनेछ॥"] * 40 + ["उसलार्इ दिनेछ||", "उसलाई दिनेछ।।"]
    got = can.consistent(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t").filter("is_changed").collect()
    assert {r.id: r.canonical_text for r in got} == {40: texts[0], 41: texts[0]}


def test_rounds_end_in_a_form_that_stays():
    random.seed(3)
    scores = can.Scores({"".join(random.choice("aаcсоo|।अआा\x02") for _ in range(random.choice([2, 3]))): random.randrange(1000) for _ in range(600)})
    for _ in range(400):
        word = "".join(random.choice("aаcсоo|।अआाे") for _ in range(random.randrange(1, 9)))
        once = can.canonical(word, scores, {})
        assert can.canonical(once, scores, {}) == once or can.canonical(can.canonical(once, scores, {}), scores, {}) in (word, once)


def test_texts_in_plain_form_are_told_at_once():
    for c in map(chr, range(0x30000)):
        if not 0xD800 <= ord(c) < 0xE000:
            text = f"क{c} é"
            assert can.plain(text) == can._rewritten(text), hex(ord(c))


def test_disguised_texts_come_back():
    random.seed(1)
    counts = can.Counter()
    for t in BASE:
        for w in t.split():
            p = "\x02\x02" + w + "\x02"
            for i in range(2, len(p)):
                counts[p[i - 2 : i + 1]] += 1
                counts[p[i - 1 : i + 1]] += 1
    scores = can.Scores(counts)
    disguises = {"।": "|", "ः": ":", "०": "০੦", "A": "А", "a": "а", "e": "е", "o": "о", "c": "с", "आ": ["अा"], "औ": ["अौ"], " ": "\u2003\u00a0", "C": "Ｃ", "B": "Ｂ"}
    for _ in range(300):
        text = random.choice(BASE)
        bad = "".join(random.choice(disguises[c]) if c in disguises and random.random() < 0.4 else c + random.choice(["", "", "", "\u200b", "\u00ad"]) for c in text)
        got = can.canonical(unicodedata.normalize(random.choice(["NFC", "NFD"]), bad), scores, {})
        assert got == text and can.canonical(got, scores, {}) == got and unicodedata.is_normalized("NFC", got)


def test_other_scripts_stay(spark):
    texts = BASE + ["Привет мир", "кот", "αβγ δοκιμή"]
    got = can.consistent(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t")
    assert got.filter(F.col("is_changed")).count() == 0
