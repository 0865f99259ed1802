"""Limits of requests over a sliding window, as a stream with state and timers and in batch; a backfill that resumes; misses of a log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# The window in milliseconds, and the requests and texts that it may hold.
WINDOW_MS, MAX_REQUESTS, MAX_TEXTS = 60_000, 60, 600
DECISION = "identity string, id long, allowed boolean, retry_after long"


def decide(granted: list[tuple[int, int]], at: int, texts: int, window_ms: int, max_requests: int, max_texts: int) -> tuple[list[tuple[int, int]], bool, int]:
    """What is granted (at, texts) after a request, whether it is, and seconds to wait if not. A refused request leaves no trace, so it puts nothing off."""
    live = [g for g in granted if g[0] > at - window_ms]
    if len(live) < max_requests and sum(n for _, n in live) + texts <= max_texts:
        return [*live, (at, texts)], True, 0
    return live, False, max(1, -(-(live[0][0] + window_ms - at) // 1000)) if live else 1


def requests(calls: DataFrame, *more: str) -> DataFrame:
    """identity, id, at (milliseconds) and texts of requests (identity, id, ts, texts); those of nobody are left out."""
    own = calls.where("identity is not null")
    return own.select(F.col("identity").cast("string").alias("identity"), F.col("id").cast("long").alias("id"), F.unix_millis("ts").alias("at"), F.col("texts").cast("long").alias("texts"), *more)


def decisions(calls: DataFrame, window_ms: int = WINDOW_MS, max_requests: int = MAX_REQUESTS, max_texts: int = MAX_TEXTS) -> DataFrame:
    """DECISION of every request in the order of time, then id. A task reads its identities one after the other and holds only what one has been granted in its window."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        identity, granted = None, []
        for f in frames:
            rows = []
            for who, id_, at, texts in f.itertuples(index=False):
                if who != identity:
                    identity, granted = who, []
                granted, allowed, wait = decide(granted, at, texts, window_ms, max_requests, max_texts)
                rows.append((who, id_, allowed, wait))
            yield pd.DataFrame(rows, columns=["identity", "id", "allowed", "retry_after"])

    return requests(calls).repartition("identity").sortWithinPartitions("identity", "at", "id").mapInPandas(part, DECISION)


class Limiter(StatefulProcessor):
    """A list of what each identity was granted, cleared by a timer once its window is over."""

    def __init__(self, window_ms: int, max_requests: int, max_texts: int):
        self.limits = window_ms, max_requests, max_texts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.granted = handle.getListState("granted", "at long, texts long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        granted = [tuple(map(int, g)) for g in self.granted.get()] if self.granted.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples(index=False):
            granted, allowed, wait = decide(granted, int(r.at), int(r.texts), *self.limits)
            out.append((key[0], int(r.id), allowed, wait))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if granted:
            self.granted.put(granted)
            self.handle.registerTimer(max(granted[-1][0], timers.getCurrentWatermarkInMs()) + self.limits[0])
        else:
            self.granted.clear()
        yield pd.DataFrame(out, columns=["identity", "id", "allowed", "retry_after"])

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.granted.clear()
        return iter(())

    def close(self) -> None:
        pass


def limited(calls: DataFrame, delay: str = "1 minute", window_ms: int = WINDOW_MS, max_requests: int = MAX_REQUESTS, max_texts: int = MAX_TEXTS) -> DataFrame:
    """decisions() of a stream. Requests of a trigger are put in order of time; those later than `delay` behind the newest are dropped, others that come in a later trigger than younger ones are decided then.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    r = requests(calls.withWatermark("ts", delay), "ts")
    return r.groupBy("identity").transformWithStateInPandas(statefulProcessor=Limiter(window_ms, max_requests, max_texts), outputStructType=DECISION, outputMode="append", timeMode="EventTime")


def backfill(rows: DataFrame, fill: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Fills all rows of a stream that are there now, a trigger after the other, each tried up to `attempts` times.

    The checkpoint holds how far it came: a run that fails goes on there the next
    time, and a trigger that is done again replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for attempt in range(1, attempts + 1):
            try:
                fill(batch).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")
                return
            except Exception:
                if attempt == attempts:
                    raise

    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start()


def open_misses(log: DataFrame) -> DataFrame:
    """project_id, query, n, last: the misses of a log (project_id, at, kind, query) since its project was last cleared, by query."""
    marks = log.where("kind in ('miss', 'clear')").groupBy("project_id").agg(F.max(F.when(F.col("kind") == "clear", F.col("at"))).alias("cleared"))
    rows = log.where("kind = 'miss'").join(marks, "project_id").where("cleared is null or at > cleared")
    return rows.groupBy("project_id", "query").agg(F.count("*").alias("n"), F.max("at").alias("last"))
