"""Streams over files that come one after another, against the same rows in batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import usage
from tessera.streaming import feeds

SCHEMA = "event_id long, ts timestamp, agent string, user_id long, tool string, value double"
T0 = dt.datetime(2024, 1, 1)


def at(event_id, minutes, user, tool, value=1.0):
    return (event_id, T0 + dt.timedelta(minutes=minutes), f"agent{user}", user, tool, value)


ROWS = [
    [at(1, 0, 1, "view"), at(2, 1, 2, "view"), at(3, 2, 1, "purchase"), at(1, 0, 1, "view")],
    [at(4, 10, 2, "purchase"), at(5, 11, 1, "purchase"), at(6, 12, 1, "view"), at(3, 2, 1, "purchase")],
    [at(7, 90, 1, "error"), at(8, 91, 1, "view"), at(9, 92, 1, "purchase")],
    [at(10, 900, 3, "view")],
    [at(11, 901, 3, "view")],
]


@pytest.fixture
def stream(spark, tmp_path):
    for k, rows in enumerate(ROWS):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")

    def run(df, sink=None, name="out"):
        w = df.writeStream.option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True)
        w = w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{tmp_path}/{name}")
        q = w.start()
        assert q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/{name}")

    return calls, run, tmp_path


def all_rows(spark):
    return spark.createDataFrame([r for rows in ROWS for r in rows], SCHEMA).distinct()


def test_once(stream):
    calls, run, _ = stream
    assert sorted(r["event_id"] for r in run(feeds.once(calls)).collect()) == list(range(1, 12))


def test_sessions(spark, stream):
    calls, run, _ = stream
    got = {(r["agent"], r["n_calls"], r["n_errors"]) for r in run(feeds.sessions(calls, delay="1 minute")).collect()}
    # the sessions of the last agent aren't over
    assert got == {("agent1", 6, 0), ("agent2", 2, 0), ("agent1", 3, 1)}


def test_paired_equals_batch(spark, stream):
    calls, run, _ = stream
    got = run(feeds.paired(calls, "view", "purchase"))
    want = usage.paired(all_rows(spark), "view", "purchase")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("event_id", "start_id", "us").collect()))


def test_late_calls_of_pairs(spark, tmp_path):
    """A call within the delay still pairs in a later trigger; one beyond it is dropped, once the mark of a trigger before the last is past it."""
    parts = [[at(1, 100, 1, "view"), at(2, 100, 2, "view")], [at(4, 95, 2, "view")], [at(3, 60, 1, "purchase"), at(5, 101, 1, "purchase"), at(6, 102, 2, "purchase")], [at(7, 20, 1, "view")], [at(8, 103, 1, "purchase")]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = feeds.paired(calls, "view", "purchase", delay="10 minutes").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
    assert q.awaitTermination(120)
    # 3 and 7 come too late; 4 comes late, but is taken as the younger of its user's two views
    assert sorted((r["event_id"], r["start_id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(5, 1), (6, 4)]


def test_replayable(spark, stream):
    calls, run, folder = stream
    run(calls, feeds.replayable(f"{folder}/out"))
    n = spark.read.parquet(f"{folder}/out").count()
    assert n == sum(map(len, ROWS))
    feeds.replayable(f"{folder}/out")(spark.read.schema(SCHEMA).parquet(f"{folder}/out/batch=1"), 99)
    feeds.replayable(f"{folder}/out")(spark.read.schema(SCHEMA).parquet(f"{folder}/out/batch=1"), 99)
    assert spark.read.parquet(f"{folder}/out").where("batch = 99").count() == spark.read.parquet(f"{folder}/out").where("batch = 1").count()


def test_latest(spark, stream):
    calls, _, folder = stream
    q = calls.writeStream.option("checkpointLocation", f"{folder}/s").trigger(availableNow=True).foreachBatch(feeds.latest(f"{folder}/top", ["ts", "event_id"], 3)).start()
    assert q.awaitTermination(120)
    last = max(int(p.name) for p in (folder / "top").iterdir())
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{folder}/top/{last}").collect()) == [9, 10, 11]


def test_pulled(spark):
    changes = spark.createDataFrame([(1, 1, True), (2, 2, False), (3, 3, True)], "id long, seq long, ok boolean")
    seen = spark.createDataFrame([(1,)], "mark long")
    put_off = spark.createDataFrame([(9, 0, True)], "id long, seq long, ok boolean")
    now, later = feeds.pulled(changes, seen, put_off, F.col("ok"))
    assert sorted(r["id"] for r in now.collect()) == [3, 9]
    assert [r["id"] for r in later.collect()] == [2]
