"""Sessions, agents, misses, archives, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where there is no whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def session_metrics(calls: DataFrame, session: list[str], hit: str, miss: str, create: str, verify: str, violate: str) -> DataFrame:
    """A row for each session: calls, hits and misses of recall, hit rate, created, created per verified, violations, duration in microseconds."""
    n = lambda tool: F.count_if(F.col("tool") == tool)
    us = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    out = calls.groupBy(*session).agg(
        F.count("*").alias("calls"), n(hit).alias("hits"), n(miss).alias("misses"), n(create).alias("created"), n(verify).alias("verified"), n(violate).alias("violations"), (us(F.max) - us(F.min)).alias("duration_us")
    )
    out = out.withColumn("hit_rate", ratio(F.col("hits"), F.col("hits") + F.col("misses")))
    return out.withColumn("create_to_verify", F.when(F.col("verified") > 0, F.col("created") / F.col("verified")).otherwise(F.col("created").cast("double")))


def agent_metrics(sessions: DataFrame) -> DataFrame:
    """A row for each agent: sessions, mean hit rate and duration, created, violations, and a score of 100: 40 for hits, 30 for no violations, 30 for ten records created."""
    out = sessions.groupBy("agent").agg(
        F.count("*").alias("sessions"), F.avg("hit_rate").alias("hit_rate"), F.avg("duration_us").alias("duration_us"), F.sum("created").alias("created"), F.sum("violations").alias("violations"), F.sum("calls").alias("calls")
    )
    clean = 1 - F.least(F.col("violations") / F.greatest("calls", F.lit(1)), F.lit(1.0))
    score = F.floor(40 * F.col("hit_rate") + 30 * clean + 30 * F.least(F.col("created") / 10, F.lit(1.0)) + 0.5)
    return out.withColumn("score", score)


def compliance(checks: DataFrame, agents: DataFrame) -> DataFrame:
    """agent, checked, violations, percent compliant; 100 for agents without checks."""
    c = checks.groupBy("agent").agg(F.count("*").alias("checked"), F.count_if("violation").alias("violations"))
    out = agents.select("agent").distinct().join(c, "agent", "left").fillna(0, ["checked", "violations"])
    return out.withColumn("percent", F.coalesce(100 * F.try_divide(F.col("checked") - F.col("violations"), F.col("checked")), F.lit(100.0)))


# The parts of the overall drift. (Coordination weighs nothing.)
SEMANTIC, BEHAVIOURAL, MOST_AGENTS = 0.7, 0.3, 20


def overall_drift(semantic: DataFrame, behavioural: DataFrame) -> DataFrame:
    """One row: mean instability, mean drift of the agents with most calls (MOST_AGENTS at most), and their weighted sum."""
    top = behavioural.orderBy(F.desc("calls"), "agent").limit(MOST_AGENTS).agg(F.coalesce(F.avg("drift"), F.lit(0.0)).alias("behavioural"))
    mean = semantic.agg(F.coalesce(F.avg("instability"), F.lit(0.0)).alias("semantic"))
    out = mean.crossJoin(F.broadcast(top))  # one row each
    return out.withColumn("drift", SEMANTIC * F.col("semantic") + BEHAVIOURAL * F.col("behavioural"))


def missed(queries: DataFrame, limit: int) -> DataFrame:
    """pattern, n, last of the most frequent missed queries, lower-cased and trimmed."""
    p = queries.select(F.lower(F.trim("text")).alias("pattern"), "at").where("pattern <> ''")
    return p.groupBy("pattern").agg(F.count("*").alias("n"), F.max("at").alias("last")).orderBy(F.desc("n"), "pattern").limit(limit)


def suggestions(patterns: DataFrame) -> DataFrame:
    """Patterns by their first word: n, confidence (1 from ten misses on), most frequent pattern."""
    word = F.element_at(F.split("pattern", "[ \\t\\n]+"), 1)
    top = F.max_by("pattern", F.struct("n", "pattern"))
    return patterns.groupBy(word.alias("word")).agg(F.sum("n").alias("n"), top.alias("pattern")).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10))


def usage_stats(records: DataFrame, stale_days: Column) -> DataFrame:
    """A row for each project: records, accesses, mean accesses (2 places), records never used though older than a week."""
    out = records.groupBy("project_id").agg(F.count("*").alias("n"), F.sum("accesses").alias("accesses"), F.count_if((F.col("accesses") == 0) & stale_days).alias("never_used"))
    return out.withColumn("mean", F.round(F.col("accesses") / F.col("n"), 2))


def pending_stats(records: DataFrame) -> DataFrame:
    """Pending records of each agent: all, and those of high, medium and low confidence."""
    c = F.col("confidence")
    return records.where("status = 'pending'").groupBy("agent").agg(F.count("*").alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"), F.count_if(c < 0.5).alias("low"))


def evaluation(answers: DataFrame) -> DataFrame:
    """accuracy and recall of (kind, correct, found) rows by kind, and over all (kind null)."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return answers.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("n"), share("correct").alias("accuracy"), share("found").alias("recall"))


def allocation(strata: DataFrame, n: int) -> DataFrame:
    """stratum, take: n rows dealt to strata in proportion to their size, the rest to the largest remainders. A row a stratum, so few."""
    total = strata.agg(F.sum("size").alias("total"))
    s = strata.crossJoin(F.broadcast(total)).withColumn("exact", n * F.col("size") / F.col("total")).withColumn("floor", F.floor("exact"))
    rest = F.lit(n) - F.sum("floor").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("exact") - F.col("floor"), 12)), "stratum"))
    return s.withColumn("rest", rest).withColumn("place", place).select("stratum", F.least("size", F.col("floor") + (F.col("place") <= F.col("rest")).cast("int")).alias("take"))


def watermark(rows: DataFrame, by: str) -> DataFrame:
    """by, the last id before the first that failed (null if that is the first)."""
    stop = rows.where("not ok").groupBy(by).agg(F.min("id").alias("_stop"))
    out = rows.join(stop, by, "left")
    return out.groupBy(by).agg(F.max(F.when(F.col("_stop").isNull() | (F.col("id") < F.col("_stop")), F.col("id"))).alias("watermark"))
