"""Reading, appending, copying and replacing stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.cells import all_of, log_text
from fleetlens.operators.ordering import assign_ids
from fleetlens.schemas import AUDIT_COLUMNS, AUDIT_LOG
from fleetlens.sources.storage import exists, stored

_VERSIONS = T.StructType(
    [T.StructField("version", T.LongType(), False), T.StructField("path", T.StringType(), False)]
)


def load_table(
    spark: SparkSession, source: str | None = None, schema: T.StructType | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """A whole stored table: a path in any format Spark reads, or a name in the catalog.

    With a schema no file is opened to infer one. ``fmt="table"`` takes a catalog name, and
    ``fmt="jdbc"`` needs only options; give it ``partitionColumn`` and bounds to read in parallel.
    """
    if fmt == "table":
        return spark.table(source)
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(source) if source else reader.load()


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)


def append_rows(new: DataFrame, path: str) -> None:
    new.write.mode("append").parquet(path)


def backup_snapshot(df: DataFrame, root: str, name: str, ts: datetime) -> str:
    """Copy under a time-stamped name; an existing copy is never overwritten."""
    path = f"{root}/{name}_backup_{ts:%Y%m%d_%H%M%S}"
    df.write.mode("errorifexists").parquet(path)
    return path


def replace_table(df: DataFrame, root: str, version: int) -> str:
    """Write a new version and then point to it.

    ``df`` may read the version it replaces: old files stay, and a job that fails half-way leaves
    the pointer where it was.
    """
    path = f"{root}/v{version:06d}"
    df.write.mode("errorifexists").parquet(path)
    pointer = df.sparkSession.createDataFrame([(version, path)], _VERSIONS)
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """The version that ``replace_table`` pointed to last."""
    versions = spark.read.schema(_VERSIONS).parquet(f"{root}/versions")
    path = versions.agg(F.max_by("path", "version")).first()[0]
    return spark.read.parquet(path)


def insert_select_distinct(source: DataFrame, columns: list[str], path: str) -> None:
    """Append the distinct combinations of ``columns``."""
    source.select(*columns).distinct().write.mode("append").parquet(path)


def insert_absent(
    source: DataFrame, columns: list[str], key: list[str], path: str, id_name: str | None = None
) -> DataFrame:
    """Append one row per ``key`` that the table at ``path`` lacks, and return what was appended.

    Of several rows with the same key the smallest counts; NULL in a key is a value like any other.
    With ``id_name`` the new rows get ids behind the largest one, in the order of their keys. A second
    run over the same source appends nothing.
    """
    spark = source.sparkSession
    others = [c for c in columns if c not in key]
    smallest = F.min(F.struct(*others)) if others else F.count("*")
    rows = source.groupBy(*key).agg(smallest.alias("_row"))
    start = 1
    if exists(spark, path):
        stored_rows = spark.read.parquet(path)
        held = stored_rows.select(*[F.col(c).alias(f"_held_{c}") for c in key])
        rows = rows.join(held, all_of([F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key]), "left_anti")
        start = next_id(stored_rows, id_name) if id_name else 1
    rows = rows.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in columns])
    fresh = stored(assign_ids(rows, key, start, id_name) if id_name else rows, "absent")
    fresh.write.mode("append").parquet(path)
    return fresh


def to_log_rows(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Old and new values as text, with missing log columns filled by NULL."""
    kinds = {f.name: f.dataType for f in rows.schema}
    columns = [F.col(c) for c in extra or []]
    for name in AUDIT_COLUMNS:
        if name not in kinds:
            columns.append(F.lit(None).cast(AUDIT_LOG[name].dataType).alias(name))
        elif name in ("old_value", "new_value"):
            columns.append(log_text(name, isinstance(kinds[name], T.BooleanType)).alias(name))
        else:
            columns.append(F.col(name))
    return rows.select(*columns)


def append_audit(
    rows: DataFrame, path: str, order: list[str], start: int | None = None, as_of: datetime | None = None
) -> None:
    """Append change records with ids in the order of ``order`` (unique together).

    Ids go on behind the largest of the log unless ``start`` is given. ``as_of`` stands in for a
    time of change that is missing; without it such a record is refused.
    """
    numbered = numbered_audit(rows, path, order, start, as_of)
    numbered.select("audit_id", *AUDIT_COLUMNS).write.mode("append").parquet(path)


def numbered_audit(
    rows: DataFrame, path: str, order: list[str], start: int | None = None, as_of: datetime | None = None
) -> DataFrame:
    """What ``append_audit`` appends to the log at ``path``."""
    extra = [c for c in order if c not in AUDIT_COLUMNS]
    if start is None:
        spark = rows.sparkSession
        start = next_id(spark.read.schema(AUDIT_LOG).parquet(path), "audit_id") if exists(spark, path) else 1
    rows = to_log_rows(rows, extra)
    if as_of is not None:
        rows = rows.withColumn("changed_at", F.coalesce("changed_at", F.lit(as_of).cast("timestamp_ntz")))
    elif not rows.where("changed_at IS NULL").isEmpty():
        raise ValueError("records without changed_at need as_of")
    return assign_ids(rows, order, start, "audit_id")


def next_id(df: DataFrame, name: str) -> int:
    """One more than the largest id of a table, 1 for an empty one."""
    return (df.agg(F.max(name)).first()[0] or 0) + 1
