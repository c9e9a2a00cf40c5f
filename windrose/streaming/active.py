"""Active systems kept up to date by a stream of fixes, with the near-duplicate rule across ids.

A batch adds its fixes to the snapshot of the one before: of each id the newest stays, what is too old goes, and the rule
(newest first; a system within 12 hours and 150 km of one that stays is left out) is applied to all that is left, as
systems.deduplicated does for a table, so that chains of near systems, across any border, end as they would if all fixes
had come at once. Snapshots hold what was left out too: it comes back when what it was near to has gone.

A snapshot's name is its batch's number. A batch that is run again after a restart begins from the same snapshot as at
first and replaces its own, so fixes are neither lost nor counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import systems
from ..operators.joins import keep_last
from ..operators.lineage import cut


class ActiveSystems:
    """``folder``: where snapshots stand, one that all executors share. ``schema`` has storm_id, time, latitude, longitude."""

    def __init__(self, spark: SparkSession, folder: str, schema, *, hours: float = 72.0, future: float = 2.0, near_hours: float = 12.0, near_km: float = 150.0):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.hours, self.future, self.near_hours, self.near_km = hours, future, near_hours, near_km
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshots(self) -> list[int]:
        """Numbers of the batches whose snapshots are whole."""
        if not self.fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-") and self.fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def _held(self, batch: int | None) -> DataFrame:
        return self.spark.createDataFrame([], self.schema) if batch is None else self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch-{batch}")

    def update(self, fixes: DataFrame, batch: int, now: Column | None = None) -> None:
        """Takes a batch in: for foreachBatch. ``now`` is the batch's clock, by default the newest fix of all."""
        before = max((n for n in self.snapshots() if n < batch), default=None)
        held = self._held(before)
        rows = cut(held.unionByName(fixes.select(*held.columns)).where("time IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL"))
        generic = F.col("storm_id").isNull() | F.upper(F.trim(F.coalesce("storm_id", F.lit("")))).isin("", "UNKNOWN")
        newest = keep_last(rows.where(~generic), ["storm_id"], [F.col("time"), F.col("latitude"), F.col("longitude")])
        whole = newest.unionByName(rows.where(generic).distinct())
        clock = F.broadcast(rows.agg(F.max("time").alias("_now"))) if now is None else F.broadcast(self.spark.range(1).select(now.alias("_now")))  # one row
        seconds = lambda c: F.col(c).cast("timestamp").cast("double")
        age = (seconds("_now") - seconds("time")) / 3600
        left = whole.withColumn("_one", F.lit(1)).join(clock.withColumn("_one", F.lit(1)), "_one").where(age.between(-self.future, self.hours)).select(*held.columns)
        left.write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        for old in self.snapshots():
            if before is not None and old < before:
                self.fs.delete(self._path(f"{self.folder}/batch-{old}"), True)

    def current(self) -> DataFrame:
        """The systems that stay, of the newest whole snapshot."""
        return systems.deduplicated(self._held(max(self.snapshots(), default=None)), hours=self.near_hours, km=self.near_km)

    def follow(self, stream: DataFrame, *, checkpoint: str, every: str | None = None):
        """Runs on a stream of fixes; the query."""
        from .cycles import run_cycles

        return run_cycles(stream, lambda frame, number: self.update(frame, number), checkpoint=checkpoint, every=every)
