"""An archive of records in the shared folder: runs appear whole, expire by partition, and the newest copy of a key counts.

A run writes into a staging folder, which then moves under its day of expiry at
once, so readers see all of a run or nothing. What is restored is noted, not
taken out: a copy older than its key's last restoring is gone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: days that a copy is kept.
RETENTION_DAYS = 365
KEY = ["project_id", "key"]
ENTRY = "project_id string, key string, record string, reason string, archived_at timestamp"
RESTORED = "project_id string, key string, restored_at timestamp"


class Archive:
    def __init__(self, spark: SparkSession, folder: str, retention_days: int = RETENTION_DAYS):
        self.spark, self.folder, self.retention_days = spark, folder.rstrip("/"), retention_days

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _days(self) -> list[str]:
        """Days of expiry that have copies."""
        top = self._path("copies")
        return sorted(x.getPath().getName().removeprefix("expires_on=") for x in self._files().listStatus(top)) if self._files().exists(top) else []

    def _publish(self, rows: DataFrame, *place: str) -> None:
        run, files = uuid.uuid4().hex, self._files()
        rows.write.parquet(f"{self.folder}/staging/{run}")
        files.mkdirs(self._path(*place))
        if not files.rename(self._path("staging", run), self._path(*place, f"run={run}")):
            raise OSError(f"a run of the archive could not be moved to {'/'.join(place)}")

    def add(self, records: DataFrame, reason: str, at: str) -> None:
        """Archives a copy of each record (project_id, key and any other columns)."""
        moment = F.lit(at).cast("timestamp")
        day = self.spark.range(1).select(F.date_add(moment.cast("date"), self.retention_days).cast("string")).first()[0]
        self._publish(records.select(*KEY, F.to_json(F.struct(*records.columns)).alias("record"), F.lit(reason).alias("reason"), moment.alias("archived_at")), "copies", f"expires_on={day}")

    def _restored(self) -> DataFrame:
        known = self._files().exists(self._path("restored"))
        rows = self.spark.read.schema(RESTORED).option("recursiveFileLookup", "true").parquet(f"{self.folder}/restored") if known else self.spark.createDataFrame([], RESTORED)
        return rows.groupBy(*KEY).agg(F.max("restored_at").alias("restored_at"))

    def copies(self) -> DataFrame:
        """ENTRY and expires_on of every copy that was not restored since."""
        days = self._days()
        if not days:
            return self.spark.createDataFrame([], f"{ENTRY}, expires_on date")
        each = [self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(f"{self.folder}/copies/expires_on={d}").withColumn("expires_on", F.lit(d).cast("date")) for d in days]
        rows = each[0]
        for x in each[1:]:
            rows = rows.unionByName(x)
        return rows.join(self._restored(), KEY, "left").where("restored_at is null or archived_at > restored_at").drop("restored_at")

    def newest(self) -> DataFrame:
        """The newest copy of each key; of several of one moment the greatest record."""
        return self.copies().groupBy(*KEY).agg(F.max_by(F.struct("record", "reason", "archived_at", "expires_on"), F.struct("archived_at", "record")).alias("c")).select(*KEY, "c.*")

    def restore(self, keys: DataFrame, at: str) -> DataFrame:
        """The newest copies of keys (project_id, key), which are no longer archived then."""
        from tessera.operators.storage import cut

        back = cut(self.newest().join(keys.select(*KEY).distinct(), KEY, "left_semi"), "restored")
        self._publish(back.select(*KEY, F.lit(at).cast("timestamp").alias("restored_at")), "restored")
        return back

    def purge(self, as_of: str) -> DataFrame:
        """Removes the copies that expired before a day, whole partitions of them. Returns project_id and how many went."""
        from tessera.operators.storage import cut

        past = [d for d in self._days() if d < as_of]
        gone = cut(self.copies().where(F.col("expires_on") < F.lit(as_of).cast("date")).groupBy("project_id").agg(F.count("*").alias("n")), "purged")
        for d in past:
            self._files().delete(self._path("copies", f"expires_on={d}"), True)
        return gone
