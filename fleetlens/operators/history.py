"""The change log: what changed between two snapshots, and what happened to a device."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.cells import any_of, log_text
from fleetlens.operators.browse import lookup
from fleetlens.operators.loans import as_of_column
from fleetlens.schemas import AUDIT_COLUMNS


def log_rows(
    df: DataFrame,
    asset_tag: Column,
    action: Column,
    field: Column,
    old: Column,
    new: Column,
    by: Column,
    at: Column,
    extra: list[str] = (),
) -> DataFrame:
    """One log row per row of ``df``."""
    return df.select(
        *extra,
        action.alias("action_type"),
        asset_tag.alias("asset_tag"),
        field.alias("field_name"),
        old.cast("string").alias("old_value"),
        new.cast("string").alias("new_value"),
        by.alias("changed_by"),
        at.alias("changed_at"),
        F.lit(None).cast("string").alias("notes"),
    )


def diff_to_audit(
    old: DataFrame,
    new: DataFrame,
    key: str,
    fields: list[str],
    changed_by: str,
    as_of: datetime | Column,
    prefix: str = "",
) -> DataFrame:
    """Field-level log between two snapshots that are unique on ``key``.

    A changed row logs the fields that really differ; a new or deleted row logs all of them, so the
    log can be replayed.
    """
    kinds = {f.name: f.dataType for f in new.schema}

    def packed(df: DataFrame, name: str) -> DataFrame:
        texts = [log_text(f, isinstance(kinds[f], T.BooleanType)).alias(f) for f in fields]
        return df.select(key, F.struct(*texts).alias(name))

    pairs = packed(old, "_old").join(packed(new, "_new"), key, "full")
    action = (
        F.when(F.col("_old").isNull(), "CREATE").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.col(f"_old.{f}").alias("old_value"), F.col(f"_new.{f}").alias("new_value")
            )
            for f in fields
        ]
    )
    changed = pairs.where(any_of([~F.col(f"_old.{f}").eqNullSafe(F.col(f"_new.{f}")) for f in fields]) | (action != "UPDATE"))
    flat = changed.select(key, action.alias("_action"), F.inline(cells)).where(
        (F.col("_action") != "UPDATE") | ~F.col("old_value").eqNullSafe(F.col("new_value"))
    )
    return log_rows(
        flat,
        F.concat(F.lit(prefix), F.col(key).cast("string")),
        F.col("_action"),
        F.col("field"),
        F.col("old_value"),
        F.col("new_value"),
        F.lit(changed_by),
        as_of_column(as_of),
    )


def asset_history(audit: DataFrame, tags: DataFrame) -> DataFrame:
    """The log of a batch of assets, newest first."""
    return lookup(audit, tags, "asset_tag", ["audit_id"]).orderBy(
        "asset_tag", F.desc("changed_at"), F.desc("audit_id")
    )


def newest_audit(audit: DataFrame, n: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("changed_at"), F.desc("audit_id")).limit(n).select("audit_id", *AUDIT_COLUMNS)
