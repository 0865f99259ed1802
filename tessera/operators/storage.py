"""Tables cut off from their lineage, in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Whole texts go to Python in batches of about so many bytes; Spark's own 64 MB stand several times in an executor's memory.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); where it is unset and all runs on this machine, as in tests, a folder of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        place = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table into the shared folder and read it back: later steps restart from there, not from the source.

    The write's shuffle files go when it has ended. Batches to Python have BATCH_BYTES meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    own = {CLEAN_UP: "true", BATCH: str(BATCH_BYTES)}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)
