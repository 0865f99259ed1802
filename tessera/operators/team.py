"""Joins of a team's records: chunks, files, members, branches, federation, imports, merges."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import sequences, text


def chunk_recall(chunks: DataFrame, records: DataFrame, query: list[float], limit: int, least: float = 0.3) -> DataFrame:
    """memory_id, chunk_index, similarity: the best chunk over `least` of each live record, the best records first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    live = records.where("status = 'live'").select(F.col("id").alias("memory_id"))
    hit = chunks.withColumn("sim", text.cosine(F.col("embedding"), q)).where(F.col("sim") > least).select("memory_id", "chunk_index", "sim")
    best = hit.groupBy("memory_id").agg(F.max_by(F.struct("chunk_index", "sim"), F.struct("sim", -F.col("chunk_index"))).alias("b"))
    return best.join(live, "memory_id", "left_semi").select("memory_id", "b.chunk_index", F.col("b.sim").alias("similarity")).orderBy(F.desc("similarity"), "memory_id").limit(limit)


# The order of types among equal file matches.
PRIORITY = ["anti_pattern", "convention", "lesson", "pattern", "decision", "architecture", "entity", "preference", "execution", "operational", "environment"]


def file_recall(records: DataFrame, files: list[str], limit: int = 10) -> DataFrame:
    """id, score of live records on the files: 3 for the same path, 2 for a folder over a file, 1 for a path within one of the given."""
    p = F.col("path")
    under = lambda whole, folder: whole.startswith(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/")))
    each = [F.when(p == f, 3).when(under(F.lit(f), p), 2).when(under(p, F.lit(f)), 1).otherwise(0) for f in files]
    score = F.greatest(*each, F.lit(0))
    place = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("type"))
    out = records.where("status = 'live'").select("id", score.alias("score"), F.when(place == 0, len(PRIORITY) + 1).otherwise(place).alias("priority")).where("score > 0")
    return out.orderBy(F.desc("score"), "priority", "id").limit(limit)


def pre_check(records: DataFrame, task: str, files: list[str], types: list[str], limit: int = 20) -> DataFrame:
    """id, hits of records that warn of a task: those with most of its words (three letters and more), then those whose path and a file hold each other."""
    words = sorted({w for w in task.lower().split() if len(w) > 2})
    r = records.where(F.col("type").isin(types) & (F.col("status") == "live"))
    body = F.lower(F.concat_ws(" ", "key", "value"))
    hits = reduce(Column.__add__, [body.contains(w).cast("int") for w in words], F.lit(0))
    by_words = r.select("id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(limit)
    near = reduce(Column.__or__, [F.col("path").contains(f) | F.lit(f).contains(F.col("path")) for f in files], F.lit(False))
    by_files = r.where(near).select("id", F.lit(0).alias("hits"))
    return by_words.unionByName(by_files).groupBy("id").agg(F.max("hits").alias("hits"))


def visible(records: DataFrame, owners: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """The records of projects that the user owns or is an active member of."""
    mine = owners.where(F.col("user") == user).select("project_id").unionByName(members.where((F.col("user") == user) & F.col("active")).select("project_id"))
    return records.join(mine.distinct(), "project_id", "left_semi")


def resolved(keys: DataFrame, local: DataFrame, overrides: DataFrame, shared: DataFrame) -> DataFrame:
    """key, value, source: the local value, else the override, else the shared one; keys known nowhere have none."""
    named = lambda df, name: df.select("key", F.col("value").alias(name))
    out = keys.join(named(local, "l"), "key", "left").join(named(overrides, "o"), "key", "left").join(named(shared, "s"), "key", "left")
    source = F.when(F.col("l").isNotNull(), "local").when(F.col("o").isNotNull(), "override").when(F.col("s").isNotNull(), "federated")
    return out.select("key", F.coalesce("l", "o", "s").alias("value"), source.alias("source")).where("source is not null")


def outdated(local: DataFrame, shared: DataFrame) -> DataFrame:
    """id of local copies whose shared record is newer."""
    newer = shared.select("id", F.col("updated_on").alias("_shared"))
    return local.join(newer, "id").where(F.col("_shared") > F.col("updated_on")).select("id")


def pulled(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """The remote rows, but local dirty rows and local rows that the remote lacks as they are."""
    dirty = local.where("dirty")
    taken = remote.join(dirty.select(*keys), keys, "left_anti")
    kept = local.where("not dirty").join(remote.select(*keys), keys, "left_anti")
    return taken.unionByName(dirty.select(*remote.columns)).unionByName(kept.select(*remote.columns))


@F.pandas_udf(StringType())
def merged_text(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([sequences.merged(a, b) for a, b in zip(left, right, strict=True)], dtype=object)


def three_way(base: DataFrame, left: DataFrame, right: DataFrame, scalars: list[str], texts: list[str] = (), arrays: list[str] = ()) -> DataFrame:
    """id, merged columns, conflicts, strategy: for each scalar column the side that changed; where both did, the left one and its name among the conflicts; the higher confidence.

    A text that one side changed is that side's, one that both changed holds the
    words of both in order (an absent text is empty). An array holds the left's
    elements, then the right's others. Rows that one side lacks take the other's
    values. A side's null is no value. strategy: partial if there are conflicts.
    """
    every = [*scalars, *texts, *arrays, "confidence"]
    side = lambda df, n: df.select("id", *[F.col(c).alias(f"{c}_{n}") for c in every])
    out = side(left, "l").join(side(right, "r"), "id", "full").join(side(base, "b"), "id", "left")
    merged, clash = [], []
    for c in scalars:
        le, r, b = F.col(f"{c}_l"), F.col(f"{c}_r"), F.col(f"{c}_b")
        left_same, right_same = le.isNull() | le.eqNullSafe(b), r.isNull() | r.eqNullSafe(b)
        merged.append(F.when(le.eqNullSafe(r) | right_same, F.coalesce(le, r)).when(left_same, r).otherwise(le).alias(c))
        clash.append(F.when(~le.eqNullSafe(r) & ~left_same & ~right_same, F.lit(c)))
    for c in texts:
        le, r, b = (F.coalesce(f"{c}_{n}", F.lit("")) for n in "lrb")
        one = F.when((le == r) | (r == b), le).when(le == b, r)
        both = F.when(one.isNull(), F.lit(True))  # only what both sides changed goes to be aligned
        text = F.coalesce(one, merged_text(F.when(both, le), F.when(both, r)))
        merged.append(F.when(F.coalesce(f"{c}_l", f"{c}_r").isNotNull(), text).alias(c))
    for c in arrays:
        none = F.array().cast("array<string>")
        union = F.array_union(F.coalesce(f"{c}_l", none), F.coalesce(f"{c}_r", none))
        merged.append(F.when(F.coalesce(f"{c}_l", f"{c}_r").isNotNull(), union).alias(c))
    confidence = F.greatest(F.coalesce("confidence_l", "confidence_b", F.lit(1.0)), F.coalesce("confidence_r", "confidence_b", F.lit(1.0)))
    conflicts = F.array_compact(F.array(*clash)) if clash else F.array().cast("array<string>")
    return out.select("id", *merged, confidence.alias("confidence"), conflicts.alias("conflicts")).withColumn("strategy", F.when(F.size("conflicts") > 0, "partial").otherwise("clean"))


def field_diff(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """id, field, change of every field that two versions of a record differ in: added, removed or modified."""
    both = old.select("id", *[F.col(f).alias(f"_{f}") for f in fields]).join(new.select("id", *fields), "id")
    change = lambda a, b: F.when(a.eqNullSafe(b), None).when(a.isNull(), "added").when(b.isNull(), "removed").otherwise("modified")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), change(F.col(f"_{f}"), F.col(f)).alias("change")) for f in fields])
    return both.select("id", F.explode(rows).alias("x")).where("x.change is not null").select("id", "x.field", "x.change")


def imported(base: DataFrame, rows: DataFrame, strategy: str) -> DataFrame:
    """key, value, tags, action of importing rows (the first of equal keys): skip keeps a known key, overwrite replaces it, merge takes the longer value and all tags."""
    first = rows.groupBy("key").agg(F.min_by(F.struct("value", "tags"), "position").alias("n"))
    known = base.select("key", F.col("value").alias("_v"), F.col("tags").alias("_t"))
    d = first.join(known, "key", "left").select("key", "n.value", "n.tags", "_v", "_t")
    new = F.col("_v").isNull()
    if strategy == "skip":
        value, tags, action = F.coalesce("_v", "value"), F.when(new, F.col("tags")).otherwise(F.col("_t")), "skipped"
    elif strategy == "overwrite":
        value, tags, action = F.col("value"), F.col("tags"), "overwritten"
    else:
        value = F.when(new | (F.length("value") > F.length("_v")), F.col("value")).otherwise(F.col("_v"))
        none = F.array().cast("array<string>")
        tags, action = F.array_union(F.coalesce("_t", none), F.coalesce("tags", none)), "merged"
    return d.select("key", value.alias("value"), tags.alias("tags"), F.when(new, "new").otherwise(action).alias("action"))


def consolidated(survivors: DataFrame, victims: DataFrame) -> DataFrame:
    """Survivors (id, victim) with the longer value, the higher confidence and all tags of both."""
    v = victims.select(F.col("id").alias("victim"), F.col("value").alias("_v"), F.col("tags").alias("_t"), F.col("confidence").alias("_c"))
    none = F.array().cast("array<string>")
    longer = F.when(F.length("_v") > F.length("value"), F.col("_v")).otherwise(F.col("value"))
    return survivors.join(v, "victim").select("id", longer.alias("value"), F.greatest("confidence", "_c").alias("confidence"), F.array_sort(F.array_union(F.coalesce("tags", none), F.coalesce("_t", none))).alias("tags"))


def redirected(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (victim, id): a victim's edges are its survivor's, without loops and repeats."""
    of = merges.select(F.col("victim"), F.col("id").alias("_to"))
    out = edges.join(of.withColumnRenamed("victim", "src").withColumnRenamed("_to", "_s"), "src", "left").join(of.withColumnRenamed("victim", "dst").withColumnRenamed("_to", "_d"), "dst", "left")
    return out.select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst")).where("src <> dst").distinct()


def first_template(files: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """path, template: the first template whose pattern fits a path."""
    fits = F.coalesce(*[F.when(F.col("path").rlike(pattern), F.lit(name)) for name, pattern in templates])
    return files.select("path", fits.alias("template")).where("template is not null")


def by_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """id of records whose path isn't among the files."""
    return records.where(F.col("path").isNotNull()).join(files.select("path"), "path", "left_anti").select("id")


def composite_rank(scored: DataFrame, limit: int) -> DataFrame:
    """The best row of each id by score, then newest, then id."""
    best = scored.groupBy("id").agg(F.max_by(F.struct("score", "updated_on"), F.struct("score", "updated_on")).alias("b")).select("id", "b.score", "b.updated_on")
    return best.orderBy(F.desc(F.round("score", 9)), F.desc("updated_on"), "id").limit(limit)


def packed_brief(sections: DataFrame, by: str, budget: int) -> DataFrame:
    """by, names of the sections that fit the budget, in order of place; one too large is passed over and later ones still come in. A row has few sections."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names"))
    step = lambda s, x: F.when(s["used"] + x["tokens"] <= budget, F.struct((s["used"] + x["tokens"]).alias("used"), F.array_append(s["names"], x["name"]).alias("names"))).otherwise(s)
    ordered = sections.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "name", F.col("tokens").cast("long").alias("tokens")))).alias("l"))
    out = ordered.select(by, F.aggregate("l", zero, step).alias("s"))
    return out.select(by, "s.used", F.array_join("s.names", ",").alias("names"))


def reverted(records: DataFrame, versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, value, version: wanted records (id, version) at that version's value, as a version after the last."""
    last = versions.groupBy("id").agg(F.max("version").alias("last"))
    old = versions.join(wanted, ["id", "version"]).select("id", "value")
    return records.select("id").join(old, "id").join(last, "id").select("id", "value", (F.col("last") + 1).alias("version"))
