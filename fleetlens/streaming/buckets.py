"""Keyed tables that change in small steps: hash buckets, of which a batch reads and writes only some.

Every batch that changes a bucket writes it anew under its own number; a list with one row per
bucket says which batch wrote the current version. A batch starts from the list of the batch before
it and leaves its own, so one that is repeated replaces only what it wrote itself, and readers of
earlier batches are not disturbed.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.sources.storage import exists

BUCKET = "bucket"
_LIST = "bucket int, batch long"


class BucketedTable:
    """The table under ``root``, in buckets by a hash of ``key``."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: T.StructType, buckets: int):
        self.spark, self.root, self.key, self.schema, self.buckets = spark, root, key, schema, buckets

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, key: str | None = None) -> set[int]:
        """Buckets that hold the keys of these rows: no more numbers than there are buckets."""
        column = F.col(key or self.key).cast(self.schema[self.key].dataType)
        found = rows.where(column.isNotNull()).select(self.bucket_of(column).alias(BUCKET)).distinct()
        return {r[0] for r in found.collect()}

    def versions(self, batch: int) -> dict[int, int]:
        """For every bucket with rows, the batch that wrote what ``batch`` left."""
        rows = self.spark.read.schema(_LIST).parquet(f"{self.root}/lists/batch={batch}").select("bucket", "batch")
        return {r.bucket: r.batch for r in rows.collect()}

    def read(self, batch: int, touched: Iterable[int] | None = None) -> DataFrame:
        """What ``batch`` left, of the ``touched`` buckets only if they are given."""
        versions = self.versions(batch)
        wanted = versions if touched is None else sorted(set(touched) & set(versions))
        paths = [f"{self.root}/rows/batch={versions[b]}/{BUCKET}={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame, batch: int, touched: Iterable[int] | None = None) -> None:
        """Leave ``rows`` as the new content of the ``touched`` buckets (all, if not given)."""
        kept = {}
        if touched is not None:
            gone = set(touched)
            kept = {b: v for b, v in self.versions(batch - 1).items() if b not in gone}
        path, written = f"{self.root}/rows/batch={batch}", []
        if touched is None or gone:
            placed = rows.select(*self.schema.fieldNames(), self.bucket_of(F.col(self.key)).alias(BUCKET))
            placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
            whole = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
            written = [r[0] for r in self.spark.read.schema(whole).parquet(path).select(BUCKET).distinct().collect()]
        rows_of_list = [*kept.items(), *((b, batch) for b in written)]
        # One row per bucket at most.
        listed = self.spark.createDataFrame(rows_of_list, _LIST).coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.root}/lists/batch={batch}")

    def last_batch(self) -> int:
        """The last batch that left a list; -1 is the state before the first one."""
        number = -1
        while exists(self.spark, f"{self.root}/lists/batch={number + 1}/_SUCCESS"):
            number += 1
        return number
