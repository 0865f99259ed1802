"""Streams of calls (event_id, ts, agent, user_id, tool, value; ts a timestamp). Each function takes and gives a streaming DataFrame or is a sink for foreachBatch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Calls without those that an at-least-once sender sent again within `delay`."""
    return calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def sessions(calls: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """agent, start, end, n_calls, n_errors, total of every session, once the watermark has passed its end."""
    s = calls.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "agent")
    s = s.agg(F.count("*").alias("n_calls"), F.count_if(F.col("tool") == "error").alias("n_errors"), F.sum("value").alias("total"))
    return s.select("agent", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_calls", "n_errors", "total")


def paired(calls: DataFrame, start: str, stop: str, forget_ms: int = 3_600_000, delay: str = "1 minute") -> DataFrame:
    """event_id, start_id, us: each stop with the call just before it (of these two tools, by one user) if that was a start.

    Calls later than `delay` behind the newest of earlier triggers (but the last) are dropped. A user's state is one start. It is forgotten when the watermark is forget_ms past it. Calls of a trigger are put in
    order of time; a call that comes in a later trigger than a younger one is taken as the younger.
    """

    def pair(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = tuple(state.get) if state.exists else None
        rows = []
        c = pd.concat(list(batches)).sort_values(["us", "event_id"])
        for event_id, tool, us in zip(c["event_id"], c["tool"], c["us"], strict=True):
            if tool == start:
                open_ = (int(event_id), int(us))
            elif open_:
                rows.append((int(event_id), open_[0], int(us) - open_[1]))
                open_ = None
        if open_:
            state.update(open_)
            state.setTimeoutTimestamp(max(open_[1] // 1000, state.getCurrentWatermarkMs()) + forget_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=["event_id", "start_id", "us"])

    c = calls.withWatermark("ts", delay).where(F.col("tool").isin(start, stop)).withColumn("us", F.unix_micros("ts"))
    schema, state = "event_id long, start_id long, us long", "start_id long, us long"
    return c.groupBy("user_id").applyInPandasWithState(pair, schema, state, "append", "EventTimeTimeout")


def replayable(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder for each trigger: one that runs again after a crash replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch_id}")

    return write


def latest(folder: str, order: list[str], k: int = 50) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the k newest rows so far, as the newest folder; a trigger that runs again starts from the one before it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder.rstrip('/')}/{batch_id - 1}").unionByName(batch)
        rows.orderBy(*[F.desc(c) for c in order]).limit(k).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{batch_id}")

    return write


def pulled(changes: DataFrame, seen: DataFrame, deferred: DataFrame, ready) -> tuple[DataFrame, DataFrame]:
    """What a pull takes in now, and what it puts off: changes above the last mark and those put off before, split by `ready`.

    seen: one row (mark). deferred: rows put off by earlier pulls, with the columns of changes. The mark can go on past
    rows that are put off, for they come again from `deferred`.
    """
    new = changes.join(F.broadcast(seen), changes["seq"] > F.coalesce(seen["mark"], F.lit(-1))).select(*changes.columns)
    all_ = new.unionByName(deferred).dropDuplicates(["id", "seq"])
    ok = F.coalesce(ready, F.lit(False))
    return all_.where(ok), all_.where(~ok)
