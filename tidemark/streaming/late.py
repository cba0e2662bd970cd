"""Totals over late and out-of-order events as a stream: versioned state by key, deltas out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import late

_STATE = "key string, stated_day date, first struct<unknown:boolean,arrived_at:timestamp_ntz,record_id:bigint>, accepted_at timestamp_ntz"
_INDEX = "bucket int, version int"
_DELTAS = "key string, period string, late boolean, delta int"


class DifferentialTotals:
    """State and deltas are tables under ``folder``. The state lies in ``buckets`` by a hash of the key; a batch reads and
    rewrites only the buckets it touches, each as a version of that batch, and an index says which version of a bucket
    holds. Running a batch again overwrites its own versions and nothing else; versions that neither this batch's index nor
    the one before names are deleted."""

    def __init__(self, spark: SparkSession, folder: str, lateness_days: int = late.LATENESS_DAYS, buckets: int = 64) -> None:
        self.spark, self.folder, self.lateness_days, self.buckets = spark, folder, lateness_days, buckets

    def _places(self, facts: DataFrame, name: str) -> DataFrame:
        last = late.versions(facts, self.lateness_days).filter("last")
        return last.select("key", late.place(F.col("period"), F.col("late")).alias(name))

    def _index(self, batch_id: int) -> dict[int, int]:
        """Version that holds of each bucket after a batch; no more entries than buckets."""
        if batch_id < 0:
            return {}
        return {r["bucket"]: r["version"] for r in self.spark.read.schema(_INDEX).parquet(f"{self.folder}/index/version={batch_id}").collect()}

    def _path(self, bucket: int, version: int) -> str:
        return f"{self.folder}/state/version={version}/bucket={bucket}"

    def _forget(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """batch: what ``late.facts`` takes. Batches are numbered from 0 without gaps."""
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        late.facts(batch).write.mode("overwrite").parquet(f"{self.folder}/facts/version={batch_id}")
        new = self.spark.read.schema(_STATE).parquet(f"{self.folder}/facts/version={batch_id}")
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        index = self._index(batch_id - 1)
        paths = [self._path(b, index[b]) for b in touched if b in index]
        old = self.spark.read.schema(_STATE).parquet(*paths) if paths else self.spark.createDataFrame([], _STATE)
        merged = old.unionByName(new).groupBy("key", "stated_day").agg(F.min("first").alias("first"), F.min("accepted_at").alias("accepted_at"))
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/state/version={batch_id}")
        keys = new.select("key").distinct()
        now = self._places(merged.join(keys, "key", "left_semi"), "now")
        was = self._places(old.join(keys, "key", "left_semi"), "was")
        late.retractions(was.join(now, "key", "full"), ["key"]).write.mode("overwrite").parquet(f"{self.folder}/deltas/version={batch_id}")
        holds = {**index, **{b: batch_id for b in touched}}
        self.spark.createDataFrame(list(holds.items()), _INDEX).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/index/version={batch_id}")
        for b, version in self._index(batch_id - 2).items():
            if index.get(b) != version:
                self._forget(self._path(b, version))

    def deltas(self) -> DataFrame:
        return self.spark.read.schema(_DELTAS).parquet(f"{self.folder}/deltas/version=*")

    def totals(self) -> DataFrame:
        return late.totals(self.deltas())

    def beyond_cut_off(self) -> DataFrame:
        return late.beyond_cut_off(self.deltas())
