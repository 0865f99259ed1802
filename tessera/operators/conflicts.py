"""Conflicts between two records: the open ones with both sides and their authors, and what settling them leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .team import merged_text

#: Fixed value: the name of an author who isn't known.
UNKNOWN = "Unknown"


def open_conflicts(conflicts: DataFrame, records: DataFrame, users: DataFrame) -> DataFrame:
    """The unresolved conflicts (conflict_id, a, b, reason, created_on) whose records both exist, with key, value, author and day of each; newest first.

    records: id, key, value, updated_by, updated_on. users: user_id, full_name,
    email. An author without a name goes by the first part of the address.
    """
    name = F.coalesce("full_name", F.get(F.split("email", "@"), F.lit(0)))
    authors = users.select("user_id", name.alias("name"))

    def side(k: str) -> DataFrame:
        own = records.join(authors, records["updated_by"] == authors["user_id"], "left")
        return own.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("key", "value")], F.coalesce("name", F.lit(UNKNOWN)).alias(f"{k}_updated_by"), F.col("updated_on").alias(f"{k}_updated_on"))

    out = conflicts.where("not resolved").select("conflict_id", "a", "b", "reason", "created_on").join(side("a"), "a").join(side("b"), "b")
    return out.orderBy(F.desc("created_on"), "conflict_id")


def settled(conflicts: DataFrame, records: DataFrame, strategy: str) -> DataFrame:
    """conflict_id, kept, removed, value, outcome of the open conflicts that can be settled now, by keep_newer, keep_older or auto_merge.

    Of equally new records the first side is the newer. auto_merge keeps the newer
    record with the words of both, as far as both changed since the conflict's base
    (or the older one). A conflict that lacks a record is settled without anything
    kept (gone). One whose record is in an earlier open conflict waits, as that may
    remove it.
    """
    if strategy not in ("keep_newer", "keep_older", "auto_merge"):
        raise ValueError(f"no strategy {strategy!r}")
    open_ = conflicts.where("not resolved").withColumn("_turn", F.struct("created_on", "conflict_id"))
    first = open_.select(F.explode(F.array("a", "b")).alias("id"), "_turn").groupBy("id").agg(F.min("_turn").alias("_first"))
    turn = lambda k: first.select(F.col("id").alias(k), F.col("_first").alias(f"_{k}"))
    ready = open_.join(turn("a"), "a").join(turn("b"), "b").where("_turn = _a and _turn = _b").select("conflict_id", "a", "b", "base")
    side = lambda k: records.select(F.col("id").alias(k), F.struct("id", "value", "updated_on").alias(f"{k}_r"))
    both = ready.join(side("a"), "a", "left").join(side("b"), "b", "left")
    newer_first = F.col("a_r.updated_on") >= F.col("b_r.updated_on")
    newer, older = (F.when(newer_first == yes, F.col("a_r")).otherwise(F.col("b_r")) for yes in (True, False))
    both = both.select("conflict_id", "base", F.col("a_r.value").alias("left"), F.col("b_r.value").alias("right"), newer.alias("newer"), older.alias("older"), (F.col("a_r").isNull() | F.col("b_r").isNull()).alias("gone"))
    kept, removed = ("older", "newer") if strategy == "keep_older" else ("newer", "older")
    value = F.col(f"{kept}.value")
    if strategy == "auto_merge":
        le, r, b = F.coalesce("left", F.lit("")), F.coalesce("right", F.lit("")), F.coalesce("base", F.col("older.value"), F.lit(""))
        one = F.when((le == r) | (r == b), le).when(le == b, r)
        both = both.withColumn("one", one)
        both = both.withColumn("both", merged_text(F.when(F.col("one").isNull(), le), F.when(F.col("one").isNull(), r)))
        value = F.coalesce(F.nullif(F.coalesce("one", "both"), F.lit("")), F.col("newer.value"))
    there = lambda c: F.when(~F.col("gone"), c)
    return both.select("conflict_id", there(F.col(f"{kept}.id")).alias("kept"), there(F.col(f"{removed}.id")).alias("removed"), there(value).alias("value"), F.when(F.col("gone"), "gone").otherwise("settled").alias("outcome"))
