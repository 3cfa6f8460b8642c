"""Adding and renaming columns only where needed, so that a repeated run changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_flag_column(df: DataFrame, name: str = "is_loaner", default: bool = False) -> DataFrame:
    """A non-NULL flag with a default, if the column is not there yet."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def add_nullable_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def rename_if_present(df: DataFrame, old: str = "notes", new: str = "checkout_notes") -> DataFrame:
    return df.withColumnRenamed(old, new) if old in df.columns and new not in df.columns else df
