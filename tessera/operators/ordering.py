"""Places and running sums in large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import cut


def numbered(rows: DataFrame, by: list[str], order: list, add: str | None = None) -> DataFrame:
    """rows with place (from 1) in their group, size of the group and, given a column to add, its running sum.

    Rows are sorted into ranges, so one group may span many tasks; only the
    ranges' sizes are summed up group by group. `order` must tell rows apart;
    rows equal in all of it stay in one range. A null in `by` is a group.
    """
    ranges = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    amount = F.coalesce(F.col(add), F.lit(0)) if add else F.lit(0)
    sizes = ranges.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.sum(amount).alias("_sum"))
    group = W.partitionBy(*[f"_{c}" for c in by])
    before = group.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    starts = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_range").alias("_of"), "_n", "_sum").select(
        *[f"_{c}" for c in by], "_of", F.sum("_n").over(group).alias("size"), F.coalesce(F.sum("_n").over(before), zero).alias("_rows"), F.coalesce(F.sum("_sum").over(before), zero).alias("_before")
    )
    same = F.col("_range") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = W.partitionBy(*by, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = ranges.join(starts, same).withColumn("place", F.col("_rows") + F.row_number().over(within.rowsBetween(W.unboundedPreceding, 0)))
    if add:
        out = out.withColumn("running", F.col("_before") + F.sum(amount).over(within))
    return out.drop("_range", "_of", "_rows", "_before", *[f"_{c}" for c in by])
