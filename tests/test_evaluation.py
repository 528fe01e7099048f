import math

import pytest
from pyspark.sql import functions as F

from lekhya.operators import judging, lifecycle_queries, metrics, statistics


def test_metric_edges(spark):
    items = spark.createDataFrame([(i, "test") for i in ("a", "b", "c", "d")], "id string, split string")
    wanted = spark.createDataFrame([("a", "s1", "5"), ("a", "s2", "5"), ("b", None, "7"), ("d", "s1", "1")], "id string, source string, number string")
    got = spark.createDataFrame([("a", 1, "s3", "5"), ("a", 2, "s1", "5"), ("a", 3, "s1", "5"), ("b", 1, "x", "7"), ("c", 1, "x", "7")], "id string, rank int, source string, number string")
    rows = {r.id: r for r in metrics.per_question(items, wanted, got).collect()}
    a = rows["a"]
    assert (a.hit1, a.hitk, a.precisionk, a.recallk, a.mrrk, a.completek) == (0.0, 1.0, 0.6667, 0.5, 0.5, 0.0)
    assert (rows["b"].hit1, rows["b"].completek) == (1.0, 1.0)
    assert rows["c"].skipped and rows["c"].hitk is None
    assert (rows["d"].hitk, rows["d"].precisionk, rows["d"].mrrk, rows["d"].skipped) == (0.0, 0.0, 0.0, False)


def test_scopes_and_published_identity(spark):
    rows = spark.createDataFrame([("development", 55 / 103)] * 103 + [("test", 145 / 217)] * 217, "split string, hit double")
    got = {r.scope: r.m for r in metrics.by_scope(rows, "split", {"m": metrics.mean("hit")}).collect()}
    assert got == {"development": 0.534, "test": 0.6682, "combined": 0.625}


def test_splits_null_and_empty(spark):
    got = spark.createDataFrame([(None,), ("",), ("test",)], "s string").select(metrics.split_label(F.col("s")).alias("s")).collect()
    assert [r.s for r in got] == ["unassigned", "unassigned", "test"]


def test_snapped(spark):
    values = [1.7, -1.0, 0.1, 0.3, 0.5, 0.7, 0.9, None]
    got = [r.s for r in spark.createDataFrame([(v,) for v in values], "x double").select(judging.snapped(F.col("x")).alias("s")).collect()]
    assert got == [min(judging.LEVELS, key=lambda s: (abs(s - min(1.0, max(0.0, v))), s)) if v is not None else None for v in values]


def test_parsed(spark):
    replies = ['```json\n{"score": 0.8, "reasoning": "ok"}\n```', '{“score”: 0.4, "reasoning": "a",}', '{"score": 0.6, "reasoning": "cut in the mid', "nonsense", None, '{"score": 1, "relevant_chunk_indices": [0, 9]}']
    got = [r.p for r in spark.createDataFrame([(r,) for r in replies], "x string").select(judging.parsed(F.col("x")).alias("p")).collect()]
    assert [(g.score, g.state) for g in got[:4]] == [(0.8, "parsed"), (0.4, "repaired"), (0.6, "salvaged"), (0.0, "failed")]
    assert got[2].reasoning == "[truncated response] cut in the mid" and got[4].state == "failed" and got[5].indices == [0, 9]


def test_parsed_lists_and_python_literals(spark):
    replies = ["{'score': 0.8, 'reasoning': 'it\\'s \"so\"', 'relevant_chunk_indices': [0, 2]}", "[{'score': 0.6, 'reasoning': None}]", '[{"score": 0.4, "reasoning": "a"}, {"score": 1.0, "reasoning": "b"}]']
    got = [r.p for r in spark.createDataFrame([(r,) for r in replies], "x string").select(judging.parsed(F.col("x")).alias("p")).collect()]
    assert [g.score for g in got] == [0.8, 0.6, 0.4] and got[0].indices == [0, 2] and got[1].state == "relaxed"


def test_required_sources_and_targets(spark):
    schema = "id string, source string, metadata struct<source:string>, category string, answerability string, required_sections array<struct<source:string,dafa:string>>, required_dafas array<string>"
    rows = [
        ("own", "s1", ("Act Two",), "x", "answerable", [], ["५"]), ("named", None, ("Act Two",), "x", "answerable", [], ["6"]), ("both", "both", ("Act Two",), "x", "answerable", [], ["7"]), ("unknown", "", ("No Act",), "x", None, [], ["8"]),
        ("exact", "s1", (None,), "x", None, [("s2", "9")], ["9"]), ("out", "s1", (None,), "out_of_scope", None, [], ["1"]), ("out2", "s1", (None,), "x", "out_of_scope", [("s1", "1")], []),
    ]
    items = spark.createDataFrame(rows, schema)
    registry = spark.createDataFrame([("s1", "Act One"), ("s2", "Act Two")], "source string, act_name string")
    required = metrics.required_source(items, registry)
    assert {r.id: r.required for r in required.collect()} == {"own": "s1", "named": "s2", "both": None, "unknown": None, "exact": "s1", "out": "s1", "out2": "s1"}
    assert {tuple(r) for r in metrics.targets(items, required).collect()} == {("own", "s1", "5"), ("named", "s2", "6"), ("both", None, "7"), ("unknown", None, "8"), ("exact", "s2", "9")}


def test_calls_of_all_tasks_keep_one_pace(spark):
    import time

    rows = spark.createDataFrame([(i, "t") for i in range(12)], "k long, t string")
    got = judging.asked(rows, "k", "t", lambda _: repr(time.time()), pace=0.05, tasks=3).collect()
    starts = sorted(float(r.reply) for r in got)
    assert len(starts) == 12 and starts[-1] - starts[0] >= 0.05 * 3 * (max(12 // 3, 4) - 1) * 0.9


def test_bootstrap_draws_are_poisson():
    k = statistics.multiplicities(spark_hashes(), 400)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and abs((k == 0).mean() - math.exp(-1)) < 0.01
    assert (k == statistics.multiplicities(spark_hashes(), 400)).all()


def spark_hashes():
    import numpy as np

    return np.random.default_rng(1).integers(-(2**63), 2**63 - 1, size=1500)


def test_refusals_and_indices(spark):
    answers = ["I cannot answer this", "ERROR: cannot answer", "", None, "यस प्रश्नको उत्तर दिन असमर्थ छु", "माफ गर्नुहोस्, यो जानकारी उपलब्ध कानूनी सन्दर्भमा छैन।"]
    df = spark.createDataFrame([(a,) for a in answers], "x string")
    assert [r[0] for r in df.select(judging.refuses(F.col("x"), judging.REFUSALS)).collect()] == [True, False, False, False, True, False]
    assert df.select(judging.refuses(F.col("x"), judging.MORE_REFUSALS)).collect()[5][0]
    assert spark.sql("select array(-1, 0, 2, 3) a").select(judging.sane_indices(F.col("a"), F.lit(3))).first()[0] == [0, 2]


def test_asked_retries_and_reports(spark):
    def client(text):
        if "bad" in text:
            raise RuntimeError("no")
        return judging.stub_judge(text)

    rows = judging.asked(spark.createDataFrame([(1, "good"), (2, "bad")], "k long, t string"), "k", "t", client).orderBy("k").collect()
    assert rows[0].error is None and rows[1].reply is None and rows[1].error.startswith("Evaluation error")


def test_pacer():
    now, slept = [0.0], []
    pacer = judging.Pacer(12, lambda: now[0], slept.append)
    pacer.wait()
    now[0] = 5.0
    pacer.wait()
    assert slept == [7.0]


def test_prompt(spark):
    row = spark.createDataFrame([("{b}", None)], "a string, b string").select(judging.prompt("x {a} y {b}.", ["a", "b"]).alias("p")).first()
    assert row.p == "x {b} y ."


def test_admission(spark):
    registry = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "source string")
    texts = spark.createDataFrame([("a", "fine"), ("c", " "), ("d", "x ऐनकको y ऐनकको")], "source string, text string")
    errors = lifecycle_queries.admission_errors(registry, texts)
    assert {(r.source, r.error) for r in errors.collect()} == {("a", "duplicate source key"), ("b", "missing"), ("c", "empty"), ("d", "artifact ऐनकको occurs 2")}
    with pytest.raises(ValueError):
        lifecycle_queries.require_admitted(errors)
    lifecycle_queries.require_admitted(errors.limit(0))


def test_manifest_diff(spark):
    old = lifecycle_queries.manifest(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("c", "w")], "source string, text string"))
    new = lifecycle_queries.manifest(spark.createDataFrame([("a", "x"), ("b", "Y"), ("d", "z")], "source string, text string"))
    assert {r.source: r.status for r in lifecycle_queries.manifest_diff(old, new).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}


def test_signed_rank_values():
    n, wins = 35, 27
    plus, minus = wins * (n + 1) / 2, (n - wins) * (n + 1) / 2
    assert math.isclose(2 * statistics.signed_rank_p(n, plus, minus, n**3 - n) / 1, 2 * statistics.signed_rank_p(n, minus, plus, n**3 - n))
    assert statistics.signed_rank_p(0, 0, 0, 0) == 1.0
    assert statistics.signed_rank_p(3, 6, 0, 0) == 0.25
    assert round(statistics.signed_rank_p(53, 23 * 27, 30 * 27, 53**3 - 53), 6) == 0.336289


def test_holm_and_rank_sums(spark):
    rows = spark.createDataFrame([("m", "a", 0.01), ("m", "b", 0.04), ("m", "c", 0.03)], "metric string, baseline string, p double")
    got = {r.baseline: round(r.p_holm, 6) for r in statistics.holm(rows, "p", ["metric"]).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.06}
    scores = spark.createDataFrame([(i, "new", s) for i, s in enumerate([0.8, 0.6, 0.4, 1.0])] + [(i, "old", s) for i, s in enumerate([0.4, 0.6, 0.6, 0.6])] + [(9, "new", None)], "id long, strategy string, score double")
    r = statistics.rank_sums(statistics.differences(scores, "new")).first()
    assert (r.n_pairs, r.wins, r.losses, r.r_plus, r.r_minus) == (4, 2, 1, 5.0, 1.0) and math.isclose(r.rank_biserial, 4 / 6)


def test_bootstrap_covers_the_mean(spark):
    diffs = spark.createDataFrame([("b", i, (i % 5 - 1) / 10) for i in range(200)], "baseline string, id long, diff double")
    a, b = (statistics.bootstrap(diffs, 200).first() for _ in range(2))
    assert a == b and a.low < 0.1 < a.high and a.high - a.low < 0.08
