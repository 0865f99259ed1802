"""Joins of records with records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_references(references: DataFrame, records: DataFrame) -> DataFrame:
    """References to records that are missing or not live."""
    return references.join(records.where("status = 'live'").select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def merge_branch(main: DataFrame, branch: DataFrame, force: bool = False) -> DataFrame:
    """id and what merging does with it: new (main has no such record), same, or conflict; with force the branch's value replaces the other. Null values are values."""
    m = main.select("id", F.col("value").alias("_main"), F.lit(True).alias("_known"))
    differs = "replaced" if force else "conflict"
    action = F.when(F.col("_known").isNull(), "new").when(F.col("_main").eqNullSafe(F.col("value")), "same").otherwise(differs)
    return branch.join(m, "id", "left").select("id", action.alias("action"))
