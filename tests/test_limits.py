"""Limits in batch and as a stream, a backfill that resumes, pulls of deltas."""

import random
from datetime import date, datetime, timedelta

import pytest

from tessera.operators import sync
from tessera.streaming import limits

SCHEMA = "identity string, id long, ts timestamp, texts long"


def made(n=200):
    r, at = random.Random(9), datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        at += timedelta(milliseconds=r.randint(0, 4000))
        rows.append((r.choice(["a", "b", None]), k, at, r.randint(0, 5)))
    return rows


def expected(rows, window=20_000, most=4, texts=9):
    granted, out = {}, {}
    for who, k, at, n in sorted(rows, key=lambda r: (r[2], r[1])):
        if who is None:
            continue
        ms = int(at.timestamp() * 1000)
        live = [g for g in granted.get(who, []) if g[0] > ms - window]
        ok = len(live) < most and sum(g[1] for g in live) + n <= texts
        out[k] = (ok, 0 if ok else max(1, -(-(live[0][0] + window - ms) // 1000)) if live else 1)
        granted[who] = live + [(ms, n)] * ok
    return out


def test_decisions(spark):
    rows = made()
    got = {r.id: (r.allowed, r.retry_after) for r in limits.decisions(spark.createDataFrame(rows, SCHEMA), 20_000, 4, 9).collect()}
    assert got == expected(rows) and len({ok for ok, _ in got.values()}) == 2
    assert limits.decide([], 5, 10, 1000, 3, 9) == ([], False, 1)


def test_limited_stream(spark, tmp_path):
    """State goes over triggers, and is cleared by its timer."""
    rows = made(120)
    for k in range(4):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        calls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = limits.limited(calls, "0 seconds", 20_000, 4, 9).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.set(key, before)
    got = {r.id: (r.allowed, r.retry_after) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == expected(rows)


def test_backfill_resumes(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(10 * k + i,) for i in range(4)], "id long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    tries = []

    def run(fails):
        def fill(batch):
            tries.append(1)
            if fails(len(tries), batch):
                raise RuntimeError("not now")
            return batch.selectExpr("id", "id * 2 AS twice")

        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = limits.backfill(rows, fill, f"{tmp_path}/out", f"{tmp_path}/check", attempts=2)
        q.awaitTermination(120)

    with pytest.raises(Exception, match="not now"):
        run(lambda n, _: n == 1 or n > 2)  # the first try fails, its second doesn't; the next trigger fails for good
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    run(lambda n, _: False)
    assert sorted((r.id, r.twice) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(10 * k + i, 20 * k + 2 * i) for k in range(3) for i in range(4)]


def test_pulls(spark):
    day = lambda k: date(2024, 1, k)
    table = lambda rows: spark.createDataFrame(rows, "id long, updated_on date, value string")
    local = lambda rows: spark.createDataFrame(rows, "id long, updated_on date, value string, dirty boolean")
    remote = table([(1, day(1), "r1"), (2, day(5), "r2"), (3, day(6), "r3")])
    mine = local([(1, day(1), "l1", False), (2, day(2), "l2", False), (3, day(2), "l3", True)])
    values = lambda p: sorted((r.id, r.value, r.dirty) for r in p.rows.collect())
    p = sync.pull(remote, mine, day(4), day(9))
    assert (p.mode, p.mark, [r.id for r in p.held.collect()], values(p)) == ("delta", day(4), [3], [(1, "l1", False), (2, "r2", False), (3, "l3", True)])
    p = sync.pull(remote, mine, day(6), day(9))
    assert (p.mode, p.mark, p.held.count(), len(values(p))) == ("current", day(6), 0, 3)
    p = sync.pull(remote, mine.where("id < 3"), day(6), day(9))
    assert (p.mode, p.mark, values(p)) == ("full", day(9), [(1, "r1", False), (2, "r2", False), (3, "r3", False)])
    p = sync.pull(remote, mine.limit(0), None, day(9))
    assert (p.mode, p.mark, len(values(p))) == ("full", day(9), 3)
    assert sync.pull(remote.limit(0), mine.limit(0), None, day(9)).rows.count() == 0


def test_misses(spark):
    log = spark.createDataFrame([("p", 1, "miss", "a"), ("p", 2, "clear", None), ("p", 3, "miss", "b"), ("p", 4, "miss", "b"), ("p", 5, "hit", "b"), ("q", 1, "miss", "a")], "project_id string, at long, kind string, query string")
    assert sorted(tuple(r) for r in limits.open_misses(log).collect()) == [("p", "b", 2, 4), ("q", "a", 1, 1)]
