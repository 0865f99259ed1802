"""Quality of records: similar and contradicting pairs, scores, health, audit, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scores, text

from . import graph
from .recall import spread
from .setjoin import hashed, sharing
from .storage import cut

# The types that a brief needs, and those whose values should read as orders.
CRITICAL = ["anti_pattern", "lesson", "pattern", "execution", "convention"]
IMPERATIVE_TYPES = ["convention", "anti_pattern", "lesson"]
IMPERATIVE = "(?<![A-Za-z0-9_])(ALWAYS|NEVER|MUST|DO NOT|STOP|AVOID|REQUIRE|ENSURE|USE)(?![A-Za-z0-9_])"


def near_duplicates(records: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs of live records of one type whose words of key and value have a Jaccard similarity of at least `least`."""
    live = spread(records.where("status = 'live'").select("id", "type", "key", "value"))  # texts are split behind this
    sets = live.select("id", F.col("type").alias("by"), text.word_set(F.concat_ws(" ", "key", "value")).alias("s"))
    return sharing(hashed(sets), least, of_union=True)


#: Elements of a block of keys, whose sets are small: less than other sets have, as a project's pairs are many and spread over more tasks so.
KEYS = 1_000_000


def similar_keys(records: DataFrame, more_than: float = 0.5, limit: int = 20) -> DataFrame:
    """The pairs of a project whose keys resemble each other most by trigrams."""
    keys = spread(records.select("id", F.col("project_id").alias("by"), "key"))
    pairs = sharing(hashed(keys.select("id", "by", text.trigrams(F.col("key")).alias("s"))), more_than, of_union=True, block=KEYS)
    return pairs.where(F.col("similarity") > more_than + 1e-12).orderBy(F.desc("similarity"), "a", "b").limit(limit)


def contradictions(records: DataFrame, least: float = 0.25, positive: list[str] | None = None, negative: list[str] | None = None) -> DataFrame:
    """Pairs of one type that share words (a share `least` of the larger set) while one speaks for and the other against."""
    spaced = F.array_distinct(F.filter(F.split(F.lower("value"), "[ \\t\\n\\r\\f]+"), lambda w: F.length(w) > 2))
    r = spread(records.select("id", "type", "value"))
    r = r.select("id", F.col("type").alias("by"), text.has_any(F.col("value"), positive or text.POSITIVE).alias("left"), text.has_any(F.col("value"), negative or text.NEGATIVE).alias("right"), spaced.alias("s"))
    pairs = sharing(hashed(r.where(F.col("left") | F.col("right"))), least, of_union=False)  # a record without markers contradicts nothing
    # two records that speak for and against come both ways
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").alias("overlap")).distinct()


# The markers of the consistency score, fewer than those of contradictions().
CONSISTENT_POSITIVE, CONSISTENT_NEGATIVE = ["always", "must", "should", "required", "use"], ["never", "avoid", "must not", "do not", "dont"]


# Shares of common words from which guidance is of one subject, and over which it repeats; one marker more against.
SAME_SUBJECT, REPEATED = 0.3, 0.4
AGAINST = [*text.NEGATIVE, "disallowed"]


def convention_checks(candidates: DataFrame, conventions: DataFrame) -> DataFrame:
    """id, status, convention, overlap of every candidate, against its project's conventions in the order of their ids.

    The first convention of the same subject that says for what the candidate says
    against (or the other way round) makes a violation, or the first whose words it
    repeats under another key a warning, whichever comes first; else it is
    compliant. Candidates are on the left of the join of word sets, conventions on
    the right.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower("value"), "[^a-z0-9\\s]", " "), "\\s+"), lambda w: F.length(w) > 1)
    row = lambda df, side: df.select("id", F.col("project_id").alias("by"), "key", "value", F.lit(side == "left").alias("left"), F.lit(side == "right").alias("right"))
    rows = spread(row(candidates, "left").unionByName(row(conventions.where("type = 'convention'"), "right")))
    rows = hashed(rows.select("id", "by", "key", "left", "right", text.has_any(F.col("value"), text.POSITIVE).alias("pos"), text.has_any(F.col("value"), AGAINST).alias("neg"), words.alias("s")))
    pairs = sharing(rows.drop("key", "pos", "neg"), SAME_SUBJECT, of_union=True).select(F.col("a").alias("new"), F.col("b").alias("old"), "similarity")
    of = lambda k, side: rows.where(F.col(side)).select(F.col("id").alias(k), F.col("key").alias(f"{k}_key"), F.col("pos").alias(f"{k}_pos"), F.col("neg").alias(f"{k}_neg"))
    met = pairs.join(of("new", "left"), "new").join(of("old", "right"), "old")
    status = F.when(F.expr("(old_pos and new_neg) or (old_neg and new_pos)"), "violation").when((F.col("similarity") > REPEATED + 1e-12) & (F.col("old_key") != F.col("new_key")), "warning")
    first = met.withColumn("status", status).where("status is not null").groupBy("new").agg(F.min_by(F.struct("status", "old", "similarity"), "old").alias("f"))
    first = first.select(F.col("new").alias("id"), "f.status", F.col("f.old").alias("convention"), F.col("f.similarity").alias("overlap"))
    return candidates.select("id").join(first, "id", "left").select("id", F.coalesce("status", F.lit("compliant")).alias("status"), "convention", "overlap")


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5)


def quality(records: DataFrame) -> DataFrame:
    """id, project_id, completeness, freshness, consistency, usefulness (25 each at most) and their total."""
    filled = lambda c: F.when(F.size(c) > 0, 5).otherwise(0)
    complete = filled("conditions") + filled("examples") + filled("tags") + F.when(F.col("n_refs") > 0, 5).otherwise(0) + F.when(F.col("path").isNotNull(), 5).otherwise(0)
    fresh = F.greatest(F.lit(0), rounded(25 * (1 - F.least(scores.days_since(F.col("updated_on")) / 180, F.lit(1.0)))))
    useful = rounded(F.col("confidence") * 15) + F.least(rounded(F.length("value") / 20), F.lit(10))
    pairs = contradictions(records, 0.3, CONSISTENT_POSITIVE, CONSISTENT_NEGATIVE).where("overlap > 0.3 + 1e-12")
    blamed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("blamed", F.lit(True))
    out = records.select("id", "project_id", "status", complete.alias("completeness"), fresh.alias("freshness"), useful.alias("usefulness"))
    out = out.join(blamed, "id", "left").withColumn("consistency", F.when(F.col("blamed"), 0).otherwise(25)).drop("blamed")
    return out.withColumn("total", F.col("completeness") + F.col("freshness") + F.col("consistency") + F.col("usefulness"))


def health(scored: DataFrame) -> DataFrame:
    """A row for each project: n, health (mean, rounded), numbers of excellent, good, fair and poor live records, and the five worst."""
    live = scored.where("status = 'live'")
    grade = scores.quality_grade(F.col("total"))
    counts = [F.count_if(grade == g).alias(g) for g in ("excellent", "good", "fair", "poor")]
    # totals are few (at most 101), so the ids of each are cut before they are put together
    place = F.row_number().over(W.partitionBy("project_id", "total").orderBy("id"))
    ranked = live.select("project_id", "total", "id", place.alias("n")).where("n <= 5").groupBy("project_id", "total").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    worst = ranked.groupBy("project_id").agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("total", "ids"))), lambda x: x["ids"])), 1, 5).alias("worst"))
    return live.groupBy("project_id").agg(F.count("*").alias("n"), rounded(F.avg("total")).alias("health"), *counts).join(worst, "project_id")


def archivable(records: DataFrame, scored: DataFrame, days: int = 60, at_most: int = 20) -> DataFrame:
    """Live records that are old, long unused and poor."""
    old = records.where((scores.days_since(F.col("created_on")) >= days) & (scores.days_since(F.col("updated_on")) >= days) & (F.col("status") == "live"))
    return old.select("id").join(scored.where(F.col("total") <= at_most).select("id", "total"), "id")


def decayed(records: DataFrame, days: int = 180, accesses: int = 2, at_least: float = 0.8) -> DataFrame:
    """id, decay of live records that a sweep archives: old, hardly used, decayed."""
    age = scores.days_since(F.col("updated_on"))
    old = records.where((F.col("status") == "live") & (age >= days) & (F.col("accesses") <= accesses))
    return old.select("id", scores.decay(age, scores.decay_rate(F.col("type")), F.col("accesses")).alias("decay")).where(F.col("decay") >= at_least)


def audit(records: DataFrame) -> DataFrame:
    """A row for each project: coverage (20 for each critical type it has), share of imperative values, score."""
    ordered = F.col("type").isin(IMPERATIVE_TYPES)
    has = [F.max((F.col("type") == t).cast("int")) for t in CRITICAL]
    imperative = F.coalesce(F.try_divide(F.count_if(ordered & F.col("value").rlike(IMPERATIVE)), F.count_if(ordered)), F.lit(0.0))
    out = records.groupBy("project_id").agg((20 * sum(has[1:], has[0])).alias("coverage"), imperative.alias("imperative"))
    return out.withColumn("score", rounded(0.6 * F.col("coverage") + 0.4 * 100 * F.col("imperative")))


def risks(records: DataFrame, edges: DataFrame) -> DataFrame:
    """id, impact, risk, level of records that others depend on."""
    r = graph.impact(edges).join(records, "id").select("id", "impact", scores.risk(F.col("impact"), F.col("confidence"), scores.days_since(F.col("updated_on"))).alias("risk"))
    return r.withColumn("level", scores.risk_level(F.col("risk")))


def risk_report(records: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """The `top` riskiest, beside the numbers of orphans and of high or critical risks."""
    r = cut(risks(records, edges), "risks")
    n_high = r.agg(F.count_if(F.col("level").isin("high", "critical")).alias("n_high"))
    n_orphans = graph.orphans(records, edges).agg(F.count("*").alias("n_orphans"))
    first = r.orderBy(F.desc(F.round("risk", 9)), "id").limit(top)
    return first.crossJoin(F.broadcast(n_high)).crossJoin(F.broadcast(n_orphans))  # a row each
