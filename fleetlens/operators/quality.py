"""Data-quality operators: what the declared keys and constraints say about the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.cells import all_of, is_blank, not_blank, under
from fleetlens.operators.collation import group_under, join_under
from fleetlens.operators.skew import join_checked
from fleetlens.schemas import NO_LOCATION_DATA, SOME_LOCATION_DATA
from fleetlens.sources.storage import stored


class QualityError(ValueError):
    """Raised by a gate, with counts."""


def blank_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_blank(column))


def blank_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(is_blank(column)).alias("null_count"))


def duplicate_keys(
    df: DataFrame, keys: list[str], include_empty: bool = False, collation: str | None = None
) -> DataFrame:
    """Keys that occur more than once. NULL keys never count, ``''`` only with ``include_empty``."""
    present = [F.col(k).isNotNull() if include_empty else not_blank(under(k, collation)) for k in keys]
    counted = group_under(df.where(all_of(present)), keys, collation, F.count("*").alias("duplicate_count"))
    return counted.where("duplicate_count > 1")


def duplicate_key_count(df: DataFrame, keys: list[str], include_empty: bool = False) -> DataFrame:
    return duplicate_keys(df, keys, include_empty).agg(F.count("*").alias("duplicate_keys"))


def duplicate_rows(
    df: DataFrame,
    keys: list[str],
    spread_by: list[str],
    order: list[str],
    include_empty: bool = True,
    collation: str | None = None,
) -> DataFrame:
    """All rows whose key is not unique. Only keys are counted; wide rows meet the stored key list."""
    repeated = stored(duplicate_keys(df.select(*keys), keys, include_empty, collation).select(*keys), "keys")
    return join_under(df, repeated, keys, "left_semi", collation, spread_by).orderBy(*order)


def fk_orphans(child: DataFrame, parent: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Child rows whose key is set but has no parent row; ``key`` is the parent's primary key."""
    known = parent.where(F.col(key).isNotNull()).select(key)
    return join_checked(child.where(F.col(key).isNotNull()), known, [key], "left_anti", spread_by)


def missing_location_review(inv: DataFrame, n: int = 100) -> DataFrame:
    """Unlinked rows with the reason, rows with a site first."""
    nothing = "site_name IS NULL AND room_number IS NULL AND room_name IS NULL"
    reason = F.when(F.expr(nothing), NO_LOCATION_DATA).otherwise(SOME_LOCATION_DATA)
    return (
        inv.where("location_id IS NULL")
        .select("inventory_id", "site_name", "room_number", "room_name", reason.alias("reason"))
        .orderBy(F.when(F.col("site_name").isNotNull(), 0).otherwise(1), "site_name", "room_number", "inventory_id")
        .limit(n)
    )


def open_loan_violations(loans: DataFrame) -> DataFrame:
    """Devices with more than one open loan."""
    return (
        loans.where("checkin_date IS NULL")
        .groupBy("inventory_id")
        .agg(F.count("*").alias("open_loans"))
        .where("open_loans > 1")
    )


def conformance(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per column of the schema: NULLs where none are allowed, and texts over their length."""
    counts, rows = [], []
    for field in schema:
        name, limit = field.name, field.metadata.get("max_length")
        nulls = F.lit(0).cast("long") if field.nullable else F.count_if(F.col(name).isNull())
        long = F.count_if(F.length(name) > limit) if limit else F.lit(0).cast("long")
        counts += [nulls.alias(f"n_{name}"), long.alias(f"l_{name}")]
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"n_{name}").alias("null_count"),
                F.col(f"l_{name}").alias("too_long_count"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def column_report(df: DataFrame) -> DataFrame:
    """Name, type and nullability of each column, with its NULLs and longest text."""
    counts, rows = [], []
    for field in df.schema:
        name, text = field.name, isinstance(field.dataType, T.StringType)
        counts += [
            F.count_if(F.col(name).isNull()).alias(f"n_{name}"),
            (F.max(F.length(name)) if text else F.lit(None)).cast("long").alias(f"l_{name}"),
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(field.nullable).alias("is_nullable"),
                F.col(f"n_{name}").alias("null_count"),
                F.col(f"l_{name}").alias("longest_text"),
            )
        )
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns: {', '.join(missing)}")


def require_tables(tables: dict[str, DataFrame], names: list[str]) -> None:
    missing = [n for n in names if n not in tables]
    if missing:
        raise QualityError(f"missing tables: {', '.join(missing)}")


def check_counts(
    df: DataFrame, not_blank_columns: list[str] = (), unique: list[str] = (), include_empty: bool = True
) -> DataFrame:
    """One row per check: blanks of a column, or repeated values of a single-column key."""
    parts = []
    if not_blank_columns:
        blanks = df.agg(*[F.count_if(is_blank(c)).alias(c) for c in not_blank_columns])
        rows = [F.struct(F.lit(f"blank {c}").alias("check_name"), F.col(c).alias("failures")) for c in not_blank_columns]
        parts.append(blanks.select(F.inline(F.array(*rows))))
    for key in unique:
        repeated = duplicate_keys(df, [key], include_empty)
        parts.append(repeated.agg(F.lit(f"repeated {key}").alias("check_name"), F.count("*").alias("failures")))
    return reduce(DataFrame.unionByName, parts)


def require(
    df: DataFrame, not_blank_columns: list[str] = (), unique: list[str] = (), include_empty: bool = True
) -> None:
    """Stop with counts if a column has blanks or a single-column key repeats."""
    failed = check_counts(df, not_blank_columns, unique, include_empty).where("failures > 0")
    # one row per check
    problems = [f"{r.failures} rows or values: {r.check_name}" for r in failed.collect()]
    if problems:
        raise QualityError("cannot proceed: " + "; ".join(problems))
