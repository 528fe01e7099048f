import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lekhya.operators import dense, lexical, meetings, neardup, retrieval, routing


def test_dense_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, v array<float>")
    got = dense.top_k(df.filter("id % 100 = 0"), df, "id", "v", 4, block=64).collect()
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    for q in (0, 100, 200):
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[q, i], i))[:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert dense.top_k(df.limit(0), df, "id", "v", 4).count() == 0


def test_hashed_vectors_have_length_one(spark):
    got = spark.createDataFrame([("क ख",), ("",), (None,)], "x string").select(dense.hashed_vector(F.col("x")).alias("v")).collect()
    assert np.isclose(np.linalg.norm(got[0].v), 1) and not any(got[1].v) and not any(got[2].v)


def test_bm25_prefers_rare_terms(spark):
    texts = spark.createDataFrame([(1, "क ख"), (2, "क ग"), (3, "क क"), (4, None)], "chunk_id long, text string")
    asked = lexical.query_terms(spark.createDataFrame([("q", "ग क र")], "id string, question string"), "id", "question")
    assert {r.term for r in asked.collect()} == {"ग", "क"}
    got = lexical.best(asked, lexical.weighted(texts, "chunk_id", "text"), "id", "chunk_id", 5).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r["rank"])][0] == 2 and len(got) == 3


def test_minmax_without_span(spark):
    got = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0)], "g string, s double").select("g", retrieval.minmax(F.col("s"), ["g"]).alias("m")).collect()
    assert sorted(r.m for r in got) == [0.0, 1.0, 1.0, 1.0]


def loop(results, sources, k):
    """Plain selection: best first, then heads of routed sources under quota, then the rest."""
    if len(sources) < 2:
        return [r[0] for r in results[:k]]
    chosen, quota = results[:1], max(1, k // len(sources))
    while len(chosen) < k:
        heads = [next((r for r in results if r[1] == s and r not in chosen), None) for s in sources if sum(c[1] == s for c in chosen) < quota]
        heads = [h for h in heads if h]
        if not heads:
            break
        chosen.append(max(heads, key=lambda r: r[2]))
    return [r[0] for r in (chosen + [r for r in results if r not in chosen])[:k]]


def test_diversified_equals_the_loop(spark):
    random.seed(2)
    rows, want = [], {}
    for q in range(60):
        n = random.randint(0, 3)
        sources = [f"s{i}" for i in range(n)]
        results = sorted(((i, f"s{random.randint(0, 3)}", random.random()) for i in range(random.randint(0, 9))), key=lambda r: -r[2])
        rows += [(q, i, s, v, sources) for i, s, v in results]
        want[q] = loop(results, sources, 5)
    df = spark.createDataFrame(rows, "q long, id long, source string, score double, sources array<string>")
    got = retrieval.diversified(df, "q", "id", F.size("sources"), F.array_contains("sources", F.col("source")), 5).collect()
    for q, ids in want.items():
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r["rank"])] == ids


def test_routes(spark):
    asked = [("a", "देवानी संहिता को करार"), ("b", "घरेलु हिंसा ऐन अनि अंशबण्डा"), ("c", "दुवै ऐन मा के छ"), ("d", "केही छैन"), ("e", None)]
    got = {r.id: r for r in routing.routes(spark.createDataFrame(asked, "id string, question string"), "id", "question").collect()}
    assert got["a"].route_type == "single_source" and got["a"].sources == ["muluki_ain"] and got["a"].score_muluki_ain == 104
    assert got["b"].route_type == got["c"].route_type == "multi_source" and got["c"].diversify
    assert got["d"].route_type == got["e"].route_type == "global"


def test_search_modes(spark):
    chunks = spark.createDataFrame([(i, f"दफा {i} को पाठ शब्द{i} साझा", "s1" if i % 2 else "s2", str(i), [str(i)]) for i in range(1, 30)], "chunk_id int, text string, source string, dafa string, dafa_list array<string>")
    asked = spark.createDataFrame([("q1", "दफा ७ मा शब्द७ के हो"), ("q2", None)], "id string, question string")
    for mode in routing.MODES:
        got = retrieval.search(asked, chunks, mode).collect()
        ranks = [r["rank"] for r in got if r.id == "q1"]
        assert sorted(ranks) == [1, 2, 3, 4, 5]
    top = [r for r in retrieval.search(asked, chunks, "hybrid").collect() if r.id == "q1" and r["rank"] == 1]
    assert top[0].chunk_id == 7
    with pytest.raises(ValueError):
        retrieval.search(asked, chunks, "other")
    assert retrieval.search(asked, chunks.limit(0), "hybrid").count() == 0


def test_near_duplicates_equal_brute_force(spark):
    random.seed(5)
    base = [" ".join(random.choice("abcdefgh") + str(random.randint(0, 40)) for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = random.choice(base).split()
        for _ in range(random.choice([0, 0, 1, 2])):
            words[random.randrange(30)] = "zz"
        rows.append((f"r{i:03}", " ".join(words)))
    rows += [("n1", None), ("n2", ""), ("n3", "short one"), ("n4", "short one")]
    got = {r.id: r for r in neardup.classes(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.split() else set()
    texts = {t: sh(t) for _, t in rows if t}
    for i, t in rows:
        links = sum(1 for u, g in texts.items() if t and u != t and len(g & texts[t]) >= 0.8 * len(g | texts[t]))
        assert got[i].n_links == links
        assert got[i].class_id == (min(k for k, u in rows if u == t) if t else i)


def test_hot_shingles_lose_no_link(spark, monkeypatch):
    random.seed(7)
    base = [f"w{i}" for i in range(20)]
    texts = []
    for _ in range(60):
        words = base[:]
        for i in random.sample(range(20), random.randint(0, 2)):
            words[i] = f"x{random.randrange(3)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    whole = {tuple(r) for r in neardup.classes(rows, "id", "t").collect()}
    monkeypatch.setattr(neardup, "HOT", 2)
    assert {tuple(r) for r in neardup.classes(rows, "id", "t").collect()} == whole and any(r[3] for r in whole)


def test_variants_and_contexts(spark):
    chunks = spark.createDataFrame([(i, f"{w} ऐन", [str(i)], str(i), s) for i, (w, s) in enumerate([("दर्ता", "muluki_ain"), ("पीडक", "domestic_violence"), ("करार", "muluki_ain"), ("दाइजो", "domestic_violence")], 1)], "chunk_id int, text string, dafa_list array<string>, dafa string, source string")
    asked = spark.createDataFrame([("a", "कृपया भन्नुहोस्, करार पीडक दुवै ऐन"), ("b", None), ("c", ""), (None, "करार")], "id string, question string")
    plan = retrieval.planned(asked, "routed_hybrid", 5, 4)
    specs = {(r.id, r.forced) for r in retrieval.variant_specs(plan).collect()}
    assert {("a", None), ("a", "muluki_ain"), ("a", "domestic_violence")} <= specs and all(i is not None for i, _ in specs)
    got = retrieval.search(asked, chunks, "routed_hybrid", 2).collect()
    assert {r.id for r in got} <= {"a", "b", "c"} and sum(r.id == "a" for r in got) == 2
    assert retrieval.search(asked, chunks.limit(0), "bm25_only", 2).count() == 0
    with pytest.raises(ValueError):
        retrieval.search(asked, chunks, "other")


def test_plan_reads_the_questions_once(spark):
    asked = spark.createDataFrame([("a", "करार के हो"), ("a", None), ("b", "दफा ५"), (None, "x")], "id string, question string")
    plan = retrieval.planned(asked, "routed_hybrid", 5, 100)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.question, r.kind, r.must, r.depth) for r in plan.collect()) == [("a", "करार के हो", "definition", "muluki_ain", 60), ("b", "दफा ५", "section_lookup", None, 30)]


def plainly(classes, texts, mode, k):
    """Scores of the candidates of every query by the plain rule, over all pairs at once: {(qid, chunk_id): score} of the rows that count."""
    n, avgdl = len(texts), np.mean([len(x[1]) for x in texts])
    df = {w: sum(w in x[1] for x in texts) for w in {w for x in texts for w in x[1]}}
    part = [{w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * x[1].count(w) * 2.5 / (x[1].count(w) + 1.5 * (0.25 + 0.75 * len(x[1]) / avgdl)) for w in set(x[1])} for x in texts]
    vectors = np.array([dense.counts(x[1]) for x in texts])
    norms = np.sqrt((vectors * vectors).sum(1))
    found = {}
    for qid, terms, asked, numbers, depth, kind in classes:
        v = dense.counts(terms)
        cosine = dict(zip((x[0] for x in texts), np.round(vectors @ v / np.maximum(norms * np.sqrt(v @ v), 1e-9), 6).tolist()))
        words = {x[0]: round(sum(p[w] for w in asked if w in p), 6) for x, p in zip(texts, part) if any(w in p for w in asked)}
        near = sorted(cosine, key=lambda i: (-cosine[i], i))[:depth]
        pool = set(near) | (set(sorted(words, key=lambda i: (-words[i], i))[:depth]) if mode != "faiss_only" else set())
        spread = lambda x: {i: 1.0 if max(x.values()) - min(x.values()) <= 1e-9 else (s - min(x.values())) / (max(x.values()) - min(x.values())) for i, s in x.items()}
        sem, kw = spread({i: cosine[i] for i in near}), spread({i: words.get(i, 0.0) for i in pool})
        own = {x[0]: x for x in texts}
        score = {}
        for i in pool:
            hit, a = bool(set(own[i][2]) & set(numbers)), {"section_lookup": 0.3, "definition": 0.6, "general": 0.55}[kind]
            s = sem.get(i, 0.0)
            mixed = 0.15 * s + 0.25 * kw[i] + 0.6 if kind == "section_lookup" and hit else a * s + (1 - a) * kw[i] + 0.1 * hit
            score[i] = round({"faiss_only": cosine[i], "bm25_only": kw[i]}.get(mode, mixed), 6)
        ranked = sorted(score, key=lambda i: (-score[i], i))
        best = set(ranked[:k]).union(*([i for i in ranked if own[i][3] == s][:k] for s in routing.SOURCES))
        found |= {(qid, i): score[i] for i in best}
    return found


def met_and_plain(spark, mode):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["w0", "w1", "w2"] * 20
    texts = [(i, [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 12))], [str(rnd.randint(1, 9))], rnd.choice([*routing.SOURCES, "other", None])) for i in range(1600)]
    asked = [[rnd.choice([*vocabulary, "unheard"]) for _ in range(rnd.randint(0, 8))] for _ in range(530)]
    classes = [(j, x, sorted(set(x) - {"w2"}), [str(rnd.randint(1, 9))] * (j % 2), 30 if j % 3 else 12, rnd.choice(["section_lookup", "definition", "general"])) for j, x in enumerate(asked)]
    got = meetings.scored(
        spark.createDataFrame(classes, "qid long, terms array<string>, asked array<string>, numbers array<string>, depth int, kind string"),
        spark.createDataFrame(texts, "chunk_id long, terms array<string>, numbers array<string>, source string"), mode, 5,
    )
    got = {(r.qid, r.chunk_id): r.score for r in got.collect()}
    assert len(got) <= 15 * len(classes)  # all that is shuffled
    want = plainly(classes, texts, mode, 5)
    assert got.keys() == want.keys() and np.allclose([got[x] for x in want], list(want.values()), atol=2e-6)


def alone(classes, texts, mode, k):
    """The scores a meeting gives without Spark around it, and the meeting."""
    number = {w: i for i, w in enumerate(sorted({w for x in texts for w in (*x[1], *x[2])} | {w for x in classes for w in (*x[2], *x[3])}))}
    told = lambda words: [number[w] for w in words]
    vec = lambda words: dense.counts(words).astype(np.int32).tobytes()
    df = {w: sum(w in x[1] for x in texts) for w in {w for x in texts for w in x[1]}}
    parts = [
        [(number[w], [], None, [], n, 0) for w, n in df.items()],
        [(qid, told(asked), vec(terms), told(numbers), depth, meetings.KINDS.index(kind)) for qid, terms, asked, numbers, depth, kind in classes],
        [(i, told(terms), vec(terms), told(numbers), routing.SOURCES.index(s) if s in routing.SOURCES else -1, 0) for i, terms, numbers, s in texts],
    ]
    types = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int32()
    meeting = meetings.Meeting(mode, k, len(texts), np.mean([len(x[1]) for x in texts]))
    for part, rows in enumerate(parts):
        for low in range(0, len(rows), 100):
            meeting.take(part, pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[low : low + 100]), types)], names=["key", "terms", "vec", "numbers", "n", "kind"]))
    return {(q, i): s for batch in meeting.results() for q, i, s in zip(*(batch.column(c).to_pylist() for c in ("qid", "chunk_id", "score")))}, meeting


@pytest.mark.parametrize("mode", routing.MODES)
def test_cells_are_told_in_single_precision_and_rows_kept_exactly(monkeypatch, mode):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["w0", "w1"] * 15
    texts = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 9))], [str(rnd.randint(1, 4))], rnd.choice([*routing.SOURCES, "other"])) for i in range(450)]
    texts += [(1000 - i, ["w3", "w4"], ["1"], "muluki_ain") for i in range(300)]  # equal, so told apart by key
    asked = [[rnd.choice(words) for _ in range(rnd.randint(0, 7))] for _ in range(70)] + [["w3"], ["w3", "w4"], []]
    classes = [(j, x, sorted(set(x) - {"w2"}), [str(rnd.randint(1, 4))] * (j % 2), 20 if j % 3 else 8, rnd.choice(meetings.KINDS)) for j, x in enumerate(asked)]
    for name, size in (("ROWS", 16), ("TEXTS", 64), ("STORED", 500)):
        monkeypatch.setattr(meetings, name, size)
    got, meeting = alone(classes, texts, mode, 5)
    want = plainly(classes, texts, mode, 5)
    assert got.keys() == want.keys() and np.allclose([got[x] for x in want], list(want.values()), atol=2e-6)
    assert meeting.room.dtype == np.float32 and not meeting.stored


def test_hybrid_meetings_equal_the_plain_rule(spark):
    met_and_plain(spark, "hybrid")


def test_routed_meetings_equal_the_plain_rule(spark):
    met_and_plain(spark, "routed_hybrid")


def test_keyword_meetings_equal_the_plain_rule(spark):
    met_and_plain(spark, "bm25_only")


def test_first_of_sections_loses_no_best_seed(spark):
    rnd = random.Random(3)
    sections = spark.createDataFrame([(i, rnd.choice([*routing.SOURCES, "other"]), str(rnd.randint(1, 4))) for i in range(400)], "chunk_id long, source string, number string")
    mentions = spark.createDataFrame([(f"q{j}", r, str(n)) for j in range(20) for r, n in enumerate(rnd.sample(range(1, 6), 3))], "id string, mention_rank int, number string")
    few = retrieval.first_of_sections(sections, 5)
    assert few.count() <= 4 * 15
    for source in (None, *routing.SOURCES):
        tops = []
        for some in (sections.select("chunk_id", "number"), few):
            seeded = retrieval.seeds(mentions, some, "id", "chunk_id").join(sections.select("chunk_id", "source"), "chunk_id").filter(F.lit(source is None) | (F.col("source") == source))
            tops.append(sorted((r.id, r["rank"], r.chunk_id, r.score) for r in lexical.top(seeded, "id", "chunk_id", 5).collect()))
        assert tops[0] == tops[1]


def test_all_seeds_shuffle_sets_not_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MEMBERS", 50)
    mentions = spark.createDataFrame([(f"q{j}", r, str((j + r) % 7)) for j in range(300) for r in range(1 + j % 3)], "id string, mention_rank int, number string")
    sections = spark.createDataFrame([(i, str((i + r) % 7)) for i in range(400) for r in range(1 + i % 2)], "chunk_id long, number string")
    plain = lambda df: sorted((r.id, r.chunk_id, r.mention_rank, r.score) for r in df.select("id", "chunk_id", "mention_rank", "score").collect())
    got = retrieval.all_seeds(mentions, sections, "id", "chunk_id")
    assert got.dtypes == retrieval.seeds(mentions, sections, "id", "chunk_id").dtypes
    assert plain(got) == plain(retrieval.seeds(mentions, sections, "id", "chunk_id"))
    unfolded = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(ts" in unfolded and not any(x in unfolded for x in ("Join", "Aggregate", "Repartition"))  # rows of the result meet no shuffle
