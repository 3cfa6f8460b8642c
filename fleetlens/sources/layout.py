"""Tables laid out in buckets on disk, so that few keys, or few changes, read few files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.history import asset_history, diff_to_audit
from fleetlens.schemas import AUDIT_COLUMNS, AUDIT_LOG
from fleetlens.sources.storage import stored
from fleetlens.sources.tables import numbered_audit

BUCKET = "bucket"
LOG_BUCKETS = 64
_BUCKET_FIELD = T.StructField(BUCKET, T.IntegerType())


def bucket_of(key: str, buckets: int) -> Column:
    """Number of the bucket of a key; NULL has one like any other value."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def _buckets(rows: DataFrame) -> list[int]:
    """The different buckets of rows: no more than there are buckets."""
    return [r[0] for r in rows.select(BUCKET).distinct().collect()]


# --- the change log by tag -----------------------------------------------------------------------


def append_audit_by_tag(
    rows: DataFrame, path: str, order: list[str], start: int | None = None, as_of: datetime | None = None, buckets: int = LOG_BUCKETS
) -> None:
    """``append_audit`` to a log that lies in buckets of ``asset_tag``."""
    numbered = numbered_audit(rows, path, order, start, as_of)
    placed = numbered.select("audit_id", *AUDIT_COLUMNS, bucket_of("asset_tag", buckets))
    placed.write.mode("append").partitionBy(BUCKET).parquet(path)


def history_by_tag(spark: SparkSession, path: str, tags: DataFrame, buckets: int = LOG_BUCKETS) -> DataFrame:
    """``asset_history`` of a batch of tags, which reads the buckets of these tags only."""
    wanted = stored(tags.where(F.col("asset_tag").isNotNull()).select("asset_tag", bucket_of("asset_tag", buckets)).distinct(), "tags")
    log = spark.read.schema(T.StructType([*AUDIT_LOG, _BUCKET_FIELD])).parquet(path)
    return asset_history(log.where(F.col(BUCKET).isin(_buckets(wanted))).drop(BUCKET), wanted)


# --- versions of a table -------------------------------------------------------------------------


def store_version(df: DataFrame, root: str, version: int, key: str, fields: list[str], buckets: int = LOG_BUCKETS) -> None:
    """Write a version in buckets of ``key``, with a digest per bucket that does not depend on the order of rows.

    The digest is the number of rows and two sums of row hashes over key and ``fields``, 128 bits
    apart from the number.
    """
    path = f"{root}/v{version:06d}"
    df.withColumn(BUCKET, bucket_of(key, buckets)).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(T.StructType([*df.schema, _BUCKET_FIELD])).parquet(f"{path}/rows")
    # A NULL and a missing value hash alike, so which fields are NULL is hashed as well.
    cells = [*fields, *[F.col(f).isNull() for f in fields]]
    hashes = [F.xxhash64(F.lit(seed), key, *cells).cast("decimal(20,0)") for seed in (1, 2)]
    digest = [F.sum(h).alias(f"digest_{i}") for i, h in enumerate(hashes)]
    written.groupBy(BUCKET).agg(F.count("*").alias("rows"), *digest).write.parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, root: str, old: int, new: int) -> list[int]:
    """Buckets whose digests differ between two versions."""
    marks = ["rows", "digest_0", "digest_1"]
    sides = [spark.read.parquet(f"{root}/v{v:06d}/digests").select(BUCKET, F.struct(*marks).alias(n)) for v, n in ((old, "a"), (new, "b"))]
    # One row per bucket and side.
    return _buckets(sides[0].join(sides[1], BUCKET, "full").where(~F.col("a").eqNullSafe(F.col("b"))))


def diff_versions(
    spark: SparkSession, root: str, old: int, new: int, key: str, fields: list[str], changed_by: str, as_of: datetime | Column
) -> DataFrame:
    """``diff_to_audit`` of two stored versions, which reads and joins only the buckets that differ."""
    touched = changed_buckets(spark, root, old, new)
    sides = []
    for version in (old, new):
        path = f"{root}/v{version:06d}"
        held = _buckets(spark.read.parquet(f"{path}/digests").where(F.col(BUCKET).isin(touched)))
        sides.append(spark.read.parquet(*[f"{path}/rows/{BUCKET}={b}" for b in held]) if held else None)
    # A side without any of these buckets is empty.
    whole = next((s for s in sides if s is not None), None)
    if whole is None:
        whole = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in (key, *fields)]))
    before, after = [whole.limit(0) if s is None else s for s in sides]
    return diff_to_audit(before, after, key, fields, changed_by, as_of)
