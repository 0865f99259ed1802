"""Usage analytics: drift, trends, health, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scores


def behavioural_drift(calls: DataFrame, split: str, least: int = 5) -> DataFrame:
    """agent, drift: Jensen-Shannon divergence (0 to 1) of its add-one-smoothed tool shares before and after `split`."""
    before = F.col("ts") < F.lit(split).cast("timestamp_ntz")
    c = calls.groupBy("agent", "tool").agg(F.sum(F.when(before, 1).otherwise(0)).alias("a"), F.sum(F.when(before, 0).otherwise(1)).alias("b"))
    agents = c.groupBy("agent").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")).where((F.col("n_a") >= least) & (F.col("n_b") >= least))
    size = F.broadcast(c.select("tool").distinct().agg(F.count("*").alias("size")))  # one row

    def part(a, b):
        p, q = (a + 1) / (F.col("n_a") + F.col("size")), (b + 1) / (F.col("n_b") + F.col("size"))
        m = (p + q) / 2
        return 0.5 * p * F.log(p / m) + 0.5 * q * F.log(q / m)

    # the tools that an agent never called all give the same part
    seen = c.join(agents, "agent").crossJoin(size)
    sums = seen.groupBy("agent", "n_a", "n_b", "size").agg(F.sum(part(F.col("a"), F.col("b"))).alias("seen"), F.count("*").alias("n"))
    drift = F.col("seen") + (F.col("size") - F.col("n")) * part(F.lit(0), F.lit(0))
    return sums.select("agent", (drift / F.log(F.lit(2.0))).alias("drift"))


def semantic_drift(changes: DataFrame) -> DataFrame:
    """id, n_changes, instability 1 - 1/d over the d different trimmed values that it has had."""
    return changes.groupBy("id").agg(F.count("*").alias("n_changes"), (1 - 1 / F.count_distinct(F.trim("value"))).alias("instability"))


def top_tools(calls: DataFrame, k: int = 3) -> DataFrame:
    c = calls.groupBy("agent", "tool").count()
    w = W.partitionBy("agent")
    c = c.withColumn("share", F.col("count") / F.sum("count").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("count"), "tool")))
    return c.where(F.col("place") <= k).select("agent", "tool", "place", "share")


def rate_limited(calls: DataFrame, n: int = 3, seconds: int = 3600) -> DataFrame:
    """Calls that come when their user has already made n in the window before."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    return calls.withColumn("_at", at).withColumn("recent", F.count("*").over(w)).where(F.col("recent") > n).select("event_id", "recent")


def paired(calls: DataFrame, start: str, stop: str) -> DataFrame:
    """Each stop event with the nearest earlier start of its user, if nothing else stopped between."""
    c = calls.where(F.col("tool").isin(start, stop))
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    c = c.withColumn("_tool", F.lag("tool").over(w)).withColumn("_ts", F.lag("ts").over(w)).withColumn("start_id", F.lag("event_id").over(w))
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))
    return c.where((F.col("tool") == stop) & (F.col("_tool") == start)).select("event_id", "start_id", us.alias("us"))
