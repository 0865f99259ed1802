"""Secrets and personal data in records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def warnings(records: DataFrame) -> DataFrame:
    """id, found (names), high and medium (how many of secrets, of personal data) of records with something found."""
    both = records.select("id", text.sensitive(F.col("value"), text.SECRETS).alias("s"), text.sensitive(F.col("value"), text.PERSONAL).alias("p"))
    out = both.select("id", F.array_join(F.concat("s", "p"), ",").alias("found"), F.size("s").cast("long").alias("high"), F.size("p").cast("long").alias("medium"))
    return out.where("high + medium > 0")


def gate(records: DataFrame) -> DataFrame:
    """records with `accepted`: no secret is in the value; a null value has none."""
    return records.withColumn("accepted", F.coalesce(F.size(text.sensitive(F.col("value"), text.SECRETS)) == 0, F.lit(True)))
