"""A local copy of remote records, brought up to date by what changed since a mark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Pull:
    """mode: current (nothing to do), delta or full. rows: the new local copy. held: ids of remote changes put off behind local edits. mark: from where the next pull starts."""

    mode: str
    rows: DataFrame
    held: DataFrame
    mark: object


def pull(remote: DataFrame, local: DataFrame, mark, now) -> Pull:
    """The local copy after a pull from remote (id, updated_on, ...); local has a column `dirty` besides.

    Counts come first: without changes since the mark and with as many records on
    both sides the copy is current; with fewer changes than it has records only
    those are read; else all. A record with a local edit is left as it is and its
    remote change held back; as long as any is, the mark stays, so that the change
    comes again. Without a mark or a local record everything is read. A full pull
    keeps local records that the remote lacks only if they are dirty.
    """
    columns = remote.columns
    have = local.count()
    changed, total = remote.agg(F.count_if(F.col("updated_on") > F.lit(mark)) if mark is not None else F.lit(0), F.count("*")).first()
    known = mark is not None and have > 0
    none = remote.select("id").limit(0)
    if known and changed == 0 and total == have:
        return Pull("current", local, none, mark)
    delta = known and 0 < changed < have
    taken = remote.where(F.col("updated_on") > F.lit(mark)) if delta else remote
    dirty = local.where("dirty").select("id")
    held = taken.join(dirty, "id", "left_semi").select("id")
    applied = taken.join(dirty, "id", "left_anti").select(*columns, F.lit(False).alias("dirty"))
    kept = (local if delta else local.where("dirty")).join(applied.select("id"), "id", "left_anti").select(*columns, "dirty")
    return Pull("delta" if delta else "full", applied.unionByName(kept), held, mark if not held.isEmpty() else now)


def unsynced(events: DataFrame, after: int | None, limit: int = 500) -> DataFrame:
    """The next batch of events to send: at most `limit` behind the last id that was, in the order of ids."""
    rows = events if after is None else events.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)
