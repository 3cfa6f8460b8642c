"""Tables kept in the shared folder, so that a lost executor never changes a result."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; local sessions without one get their own."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="fleetlens-")
    return _local_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path; all tables of one application share a folder that may go when it has ended."""
    return f"{shared_folder(spark)}/fleetlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once and read it back.

    Later uses read columns from files instead of running the plan again, the lineage is cut,
    and Spark knows the true size of the table when it picks a join.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever store it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing will read any more.

    Spark drops shuffle files when the driver has collected what refers to them, so that is asked
    for too. Tables that were not stored are left alone.
    """
    for table in tables:
        path = table.__dict__.get("_stored_path")
        if path:
            spark = table.sparkSession
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
