"""Writes as transforms: upserts, deletes, versions, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordering import numbered


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], keep: list[str], seq: str) -> DataFrame:
    """The latest row of each key by seq; the columns `keep` stay those of its first row. Both have the same columns."""
    all_ = base.unionByName(delta)
    w = W.partitionBy(*keys)
    for c in keep:
        all_ = all_.withColumn(c, F.first(c).over(w.orderBy(seq).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return all_.withColumn("_n", F.row_number().over(w.orderBy(F.desc(seq)))).where("_n = 1").drop("_n")


def without(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def versions(changes: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values differ from the version before (null-safe), numbered from 1."""
    w = W.partitionBy(by).orderBy(*order)
    same = F.row_number().over(w) > 1
    for v in values:
        same = same & F.lag(v).over(w).eqNullSafe(F.col(v))
    return changes.withColumn("_same", same).where("not _same").drop("_same").withColumn("version", F.row_number().over(w))


def export_lines(records: DataFrame) -> DataFrame:
    """The lines of a document for each project and type: project_id, type, place (from 1, by key and id) and line."""
    lines = records.select("project_id", "type", "key", "id", F.concat(F.lit("- "), F.col("key")).alias("line"))
    return numbered(lines, ["project_id", "type"], ["key", "id"]).select("project_id", "type", "place", "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """A folder of text files for each project and type, whose lines in the order of the files' names are the document."""
    ordered = lines.repartitionByRange("project_id", "type", "place").sortWithinPartitions("project_id", "type", "place")
    ordered.select("project_id", "type", "line").write.partitionBy("project_id", "type").text(path)
