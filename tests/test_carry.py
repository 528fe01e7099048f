import random

from lekhya.plans.carry import looked_back


def test_looked_back_equals_the_loop(spark):
    random.seed(7)
    rows = [(g, i, random.choice([None, "a", "b", "c"])) for g in ("x", "y", None) for i in random.sample(range(300), 80)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    got = {(r.g, r.i): (r.prev, r.seen) for r in looked_back(df, "g", "i", {"prev": "v"}, {"seen": "v"}, width=7).collect()}
    for g in ("x", "y", None):
        before = seen = None
        for _, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            seen = v if v is not None else seen
            assert got[g, i] == (before, seen)
            before = v
    assert looked_back(df.limit(0), "g", "i", {"prev": "v"}).count() == 0
