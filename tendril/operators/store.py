"""Results kept by request, of which a re-run replaces only what it touches.

Results lie in ``buckets`` partitions by a hash of their request.  A re-run of some
items matches those, merges the answers with what the touched partitions hold
(an item's new result, else its old one, else a stub) and overwrites these
partitions only, in one commit; files of the others stay as they are.  Each row has
the ``version`` of the run that made it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.operators.results import merge_results, subset
from tendril.sources.shared import written


@dataclass
class ResultStore:
    path: str
    key: list[str] = field(default_factory=lambda: ["request_id", "number"])
    buckets: int = 64

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key[0]), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, **options: str) -> None:
        # One file a bucket; a request's rows are together.
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").options(**options).mode("overwrite").parquet(self.path)

    def save(self, results: DataFrame, version: int = 1) -> None:
        """A full run: whatever was there goes."""
        self._write(self._placed(results.withColumn("version", F.lit(version))), partitionOverwriteMode="static")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop("bucket")

    def rerun(self, items: DataFrame, numbers: DataFrame, match: Callable[[DataFrame], DataFrame]) -> int:
        """Match the items that ``numbers`` (the key) names anew; the version
        they got.  Items that weren't in the store and aren't named become stubs
        if their partition is touched."""
        spark = items.sparkSession
        held = spark.read.parquet(self.path)
        asked = subset(items, numbers, self.key)
        # At most as many numbers as there are buckets.
        touched = [r.bucket for r in self._placed(asked.select(*self.key)).select("bucket").distinct().collect()]
        version = (held.agg(F.max("version")).first()[0] or 0) + 1
        if not touched:
            return version
        new = match(asked).withColumn("version", F.lit(version))
        old = held.filter(F.col("bucket").isin(touched)).select(*new.columns)
        own = self._placed(items.select(*self.key)).filter(F.col("bucket").isin(touched)).drop("bucket")
        merged = merge_results(own, old, new, self.key)
        # What is read must be whole before its files are replaced.
        self._write(self._placed(written(merged)), partitionOverwriteMode="dynamic")
        return version
