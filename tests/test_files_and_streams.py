import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lekhya.plans.positions import ordered, positions
from lekhya.sources import files
from lekhya.streaming import incremental


def test_texts_json_and_manifest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("पहिलो\nदोस्रो", encoding="utf-8")
    assert files.whole_texts(spark, str(tmp_path / "a.txt")).first().text == "पहिलो\nदोस्रो"
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y"}]))
    assert [r.n for r in files.json_array(spark, str(tmp_path / "a.json"), "id string, n int").orderBy("id").collect()] == [1, None]
    assert files.optional_json(spark, str(tmp_path / "none.json"), "id string").count() == 0
    before = files.file_manifest(spark, str(tmp_path / "a.txt")).collect()
    (tmp_path / "a.txt").write_text("other")
    after = files.file_manifest(spark, str(tmp_path / "a.txt"))
    assert not files.manifest_matches(spark.createDataFrame(before), after) and files.manifest_matches(after, after)


def test_publish_index_and_freshness(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "क ख"), (2, "क")], "chunk_id long, text string")
    path = str(tmp_path / "index")
    index = files.read_index(spark, path, chunks)
    assert index["postings"].count() == 3 and index["vectors"].count() == 2
    files.publish(chunks, path + "/postings2")
    files.publish(chunks.limit(1), path + "/postings2")
    assert files.read_published(spark, path + "/postings2").count() == 1
    with pytest.raises(Exception):
        files.read_index(spark, str(tmp_path / "missing"))
    old, new = tmp_path / "old", tmp_path / "new"
    old.write_text("1")
    import os

    os.utime(old, (1, 1))
    new.write_text("2")
    with pytest.raises(ValueError):
        files.require_fresh(spark, str(old), str(new))
    files.write_json(chunks, str(tmp_path / "out"))
    files.text_report(chunks.select(F.col("text").alias("line")), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 2


def test_publishing_swaps_one_pointer(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, path)
    seen = []
    for n in (3, 2, 1):
        files.publish(spark.range(n), path)
        seen.append(files.published(spark, path))
        assert files.read_published(spark, path).count() == n
    assert spark.read.parquet(seen[1]).count() == 2 and not files.exists(spark, seen[0])
    (tmp_path / "table" / "v99999999999999999999-torn").mkdir()  # a writer that died before the pointer moved
    assert files.read_published(spark, path).count() == 1


def test_only_a_broken_index_is_rebuilt(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(1, "क ख"), (2, "क")], "chunk_id long, text string")
    path = str(tmp_path / "index")
    files.write_index(chunks, path)
    for f in Path(files.published(spark, path + "/lengths")).glob("part-*"):
        f.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        files.read_index(spark, path)
    assert files.read_index(spark, path, chunks)["lengths"].count() == 2
    monkeypatch.setattr(files, "read_published", lambda *_: (_ for _ in ()).throw(ConnectionError("no network")))
    with pytest.raises(ConnectionError):
        files.read_index(spark, path, chunks)


def test_positions(spark):
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(200)], "g int, x int")
    got = positions(rows, ["g"], [F.col("x")], ["x"], buckets=5).collect()
    for g in (0, 1, 2, None):
        own = sorted(r.position for r in got if r.g == g)
        assert own == list(range(len(own)))
    assert [r.x for r in ordered(rows, ["x"]).orderBy("position").collect()] == list(range(200))
    assert ordered(rows.limit(0), ["x"]).count() == 0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    folder = str(tmp_path / "events")
    rows = [(i, 1704067200 + i * 60, "abc"[i % 3], float(i)) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "event_id long, s long, kind string, value double").select("event_id", F.timestamp_seconds("s").alias("ts"), "kind", "value")
    df.coalesce(1).write.parquet(folder)
    stream = incremental.windows(incremental.files(spark, folder, df.schema), "ts", "kind", "value")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.window_start, r.kind): (r.n, r.total) for r in spark.table("w").collect()}
    batch = df.dropDuplicates(["event_id"]).groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("t")).collect()
    assert got == {(r.w.start, r.kind): (r.n, r.t) for r in batch}
    results, check = str(tmp_path / "results"), str(tmp_path / "check")
    for _ in range(2):
        incremental.resumed(incremental.files(spark, folder, df.schema), "event_id", lambda d: d.select("event_id", F.lit(1).alias("score")), results, check).awaitTermination(120)
        df.limit(5).coalesce(1).write.mode("append").parquet(folder)
    assert spark.read.parquet(results).count() == 300
