"""Retrieval: legs, fusion, re-ordering, budgets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import dates, scores, text
from tessera.functions.trigrams import resemblances

from .ordering import numbered
from .storage import cut

K = 60


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its source has fewer splits than that; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def trigram_leg(records: DataFrame, query: str, least: float = 0.15, least_word: float = 0.4) -> DataFrame:
    """id, sim of live records whose key or value resembles the query as a whole, or some extent of it does. The live filter stands below the rank."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, best = (np.maximum(*x) for x in zip(*(resemblances(batch.column(k).to_pylist(), query) for k in (1, 2)), strict=True))
            found = (whole > least) | (best > least_word)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found)), pa.array(best[found])], names=["id", "sim"])

    live = records.where("status = 'live'").select(F.col("id").cast("long").alias("id"), F.lower("key").alias("key"), F.lower("value").alias("value"))
    return spread(live).mapInArrow(part, "id long, sim double")


#: So many rows of ids are sent to all tasks.
MAX_SENT = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows; ties can make candidates many."""
    return F.broadcast(df) if df.limit(MAX_SENT + 1).count() <= MAX_SENT else df


def vector_leg(vectors: DataFrame, query: list[float], least: float = 0.3, records: DataFrame | None = None) -> DataFrame:
    """vec_id, sim of vectors closer to the query than `least`; with records, of live ones only."""
    if records is not None:
        vectors = vectors.join(records.where("status = 'live'").select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col("vec_id").alias("id"), text.cosine(F.col("embedding"), q).alias("sim")).where(F.col("sim") > least)


def ranks(leg: DataFrame, candidates: DataFrame, ties_share: bool) -> DataFrame:
    """id, place of the candidates in a leg, counted over all of it without a sort of it. Their different similarities are few, ties or not."""
    key = F.struct("sim") if ties_share else F.struct("sim", (-F.col("id")).alias("n"))
    leg = leg.withColumn("_k", key)
    own = leg.join(candidates, "id", "left_semi")
    marks = F.broadcast(own.agg(F.sort_array(F.collect_set("_k")).alias("_marks")))  # one row, of few candidates
    before = leg.crossJoin(marks).select(F.size(F.filter("_marks", lambda m: m < F.col("_k"))).alias("_below")).groupBy("_below").agg(F.count("*").alias("_n"))
    nth = own.crossJoin(marks).select("id", (F.array_position("_marks", F.col("_k")) - 1).alias("_nth"))
    return nth.join(F.broadcast(before), F.col("_below") > F.col("_nth"), "left").groupBy("id").agg((1 + F.coalesce(F.sum("_n"), F.lit(0))).alias("place"))


def fuse(legs: list[DataFrame], limit: int, ties_share: bool = True) -> DataFrame:
    """Reciprocal-rank fusion of (id, sim) legs: the `limit` best ids by the sum of 1 / (K + rank).

    The first `limit` rows of a leg have at least 1 / (K + limit) each, and n legs
    give at most n / (K + rank) to a row of that best rank. So only rows that some
    leg has within n * limit + (n - 1) * K are candidates; their exact ranks in all
    legs follow by counting.
    """
    most = len(legs) * limit + (len(legs) - 1) * K
    legs = [cut(leg.select("id", "sim"), "leg") for leg in legs]
    best = []
    for leg in legs:
        last = leg.orderBy(F.desc("sim")).limit(most).agg(F.min("sim").alias("_last"))
        first = leg.join(F.broadcast(last), F.col("sim") >= F.col("_last")).select("id")
        best.append(first if ties_share else leg.orderBy(F.desc("sim"), "id").limit(most).select("id"))
    candidates = sent(cut(reduce(DataFrame.unionByName, best).distinct(), "candidates"))
    placed = reduce(DataFrame.unionByName, [ranks(leg, candidates, ties_share) for leg in legs])
    return placed.groupBy("id").agg(F.sum(1 / (K + F.col("place"))).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def hybrid(records: DataFrame, vectors: DataFrame, query: str, embedding: list[float], limit: int = 20) -> DataFrame:
    """Both legs fused, then weighed by evidence."""
    top = F.broadcast(fuse([trigram_leg(records, query), vector_leg(vectors, embedding, records=records)], limit * 2))  # at most 2 * limit rows
    live = records.where("status = 'live'").select("id", "type", "evidence")
    out = live.join(top, "id").withColumn("score", F.col("score") * scores.evidence_weight(F.col("evidence")))
    return out.orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def within_budget(ranked: DataFrame, by: str, order: list, budget: int, keep_first: bool = False) -> DataFrame:
    """Rows of each group up to the first that would go over the budget of tokens."""
    out = numbered(ranked, [by], order, "tokens")
    return out.where((F.col("running") <= budget) | (F.lit(keep_first) & (F.col("place") == 1))).drop("place", "size")


def tfidf(records: DataFrame, query: list[str]) -> DataFrame:
    """id, score: tf * idf summed over the query's tokens, repeated ones too."""
    spark, known = records.sparkSession, F.array(*[F.lit(t) for t in sorted(set(query))])
    words = records.select("id", F.filter(F.split(F.lower("value"), "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    # texts are split once; only the query's tokens stay
    words = cut(words.select("id", F.size("w").alias("n"), F.filter("w", lambda w: F.array_contains(known, w)).alias("w")).where("n > 0"), "tokens")
    wanted = F.broadcast(spark.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "token string, times long"))
    total = words.agg(F.count("*").alias("total"))
    hit = words.select("id", "n", F.explode("w").alias("token")).groupBy("id", "n", "token").count().join(wanted, "token")
    df = hit.groupBy("token").agg(F.count("*").alias("df"))  # a row for each token of the query
    out = hit.join(F.broadcast(df), "token").crossJoin(F.broadcast(total))  # one row
    score = F.col("times") * F.col("count") / F.col("n") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1)
    return out.groupBy("id").agg(F.sum(score).alias("score"))


# The verdict's thresholds.
MIN_TOP, MIN_Z, MIN_CANDIDATES = 0.80, 2.1, 5


def relevance(leg: DataFrame) -> DataFrame:
    """One row: n, top, mean, z (by the population's deviation) of a leg's scores, and the reason to keep or drop the leg."""
    s = leg.agg(F.count("sim").alias("n"), F.max("sim").alias("top"), F.avg("sim").alias("mean"), F.stddev_pop("sim").alias("sd"))
    s = s.withColumn("z", F.when(F.col("sd") > 1e-9, (F.col("top") - F.col("mean")) / F.col("sd")).otherwise(0.0)).drop("sd").fillna(0)
    reason = F.when(F.col("top") >= MIN_TOP, "strong-top-score").when((F.col("n") >= MIN_CANDIDATES) & (F.col("z") >= MIN_Z), "stands-out")
    return s.withColumn("reason", reason.when(F.col("n").between(1, MIN_CANDIDATES - 1), "too-few-candidates").otherwise("flat-and-low"))


def gated(leg: DataFrame) -> DataFrame:
    """The leg, or nothing of it where its scores are flat and low."""
    verdict = relevance(leg).where(F.col("reason").isin("strong-top-score", "stands-out")).select(F.lit(True).alias("_kept"))
    return leg.crossJoin(F.broadcast(verdict)).drop("_kept")  # one row or none


def scored_query(records: DataFrame, vectors: DataFrame, query: str, embedding: list[float], limit: int = 5, least: float = 0.3) -> DataFrame:
    """id, semantic, text of live records: all whose vector is closer than `least`, and the newest 2 * limit that hold the query in key or value, with 1 for that."""
    near = vector_leg(vectors, embedding, least, records).select("id", F.col("sim").alias("semantic"))
    low = F.lit(query.lower())
    holding = records.where((F.col("status") == "live") & (F.contains(F.lower("key"), low) | F.contains(F.lower("value"), low)))
    newest = holding.select("id", "updated_on").orderBy(F.desc("updated_on"), "id").limit(2 * limit).select("id", F.lit(1.0).alias("text"))
    return near.join(F.broadcast(newest), "id", "left").unionByName(newest.join(near, "id", "left_anti").withColumn("semantic", F.lit(0.0))).fillna(0.0, ["text"])


def pooled(vectors: DataFrame, by: str) -> DataFrame:
    """by, n, place, x: the mean vector of each group, scaled to length 1, a row a place; a mean of zeros stays. Sums by place don't gather a group's vectors."""
    each = vectors.select(by, F.posexplode("embedding").alias("place", "x"))
    mean = each.groupBy(by, "place").agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("x"))
    length = mean.groupBy(by).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_length"))
    return mean.join(length, by).select(by, "n", "place", F.coalesce(F.try_divide(F.col("x"), F.col("_length")), F.col("x")).alias("x"))


# Fixed value: how much nearness in time adds to a score at most.
TEMPORAL_WEIGHT = 0.5


def ranked(scored: DataFrame, query: str | None, as_of: str = scores.AS_OF, limit: int | None = None) -> DataFrame:
    """id, score of scored records (id, semantic, text, confidence, updated_on, created_on, referenced, relative), the best of each id, in order.

    A query that asks for a time adds up to half for nearness of the record's date
    (that it names, else means, else was made on) to the query's date, or to now if
    it names none; then being fresh counts no more besides.
    """
    asks, now = dates.temporal(F.lit(query)), F.lit(as_of).cast("date")
    to = dates.target(F.lit(query), now)
    base = scores.composite(F.col("semantic"), F.col("text"), F.col("confidence"), scores.days_since(F.col("updated_on"), as_of), ~(asks & to.isNull()))
    near = scores.proximity(F.coalesce("referenced", "relative", "created_on"), F.coalesce(to, now.cast("timestamp_ntz")))
    s = scored.select("id", "updated_on", (base * F.when(asks, 1 + TEMPORAL_WEIGHT * near).otherwise(1.0)).alias("score"))
    s = s.groupBy("id").agg(F.max("score").alias("score"), F.max("updated_on").alias("updated_on"))
    out = s.orderBy(F.desc(F.round("score", 10)), F.desc("updated_on"), "id").select("id", "score")
    return out if limit is None else out.limit(limit)


def reordered(pool: DataFrame, query: str, as_of: str = scores.AS_OF) -> DataFrame:
    """id, place, score of a pool (id, place from 0, referenced, relative), the few best of a recall, in the order for a query that asks for a time; for others in their own. Records without a date of their own get nothing more."""
    asks, now = dates.temporal(F.lit(query)), F.lit(as_of).cast("date")
    to = F.coalesce(dates.target(F.lit(query), now), now.cast("timestamp_ntz"))
    own = F.coalesce("referenced", "relative")
    score = 1 / (1 + F.col("place")) * F.when(asks, 1 + TEMPORAL_WEIGHT * scores.proximity(own, to)).otherwise(1.0)
    return pool.select("id", "place", score.alias("score")).orderBy(F.desc(F.round("score", 10)), "place")
