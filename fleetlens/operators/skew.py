"""Joins against a side that is unique on the key, safe when one key holds much of the other side.

A side is broadcast only after it was measured. Beyond the limit the keys that fill more than one
shuffle partition are cut into shares, and their single partner row is copied to each share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.cells import all_of
from fleetlens.sources.storage import shuffle_partitions, stored

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame) -> bool:
    """Measure rows and bytes of ``df``: one aggregation, cheap on a stored table."""
    width = F.lit(0)
    for field in df.schema:
        if isinstance(field.dataType, T.StringType):
            width = width + F.lit(8) + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.lit(8) + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
        else:
            width = width + F.lit(8)
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def hot_keys(df: DataFrame, on: list[str], parts: int) -> DataFrame:
    """Keys with more than 1/``parts`` of the rows, and into how many shares to cut each.

    There can be no more than ``parts`` such keys, so the result is safe to broadcast.
    """
    counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    return counts.where(F.col("_rows") * parts > total).select(
        *[F.col(c).alias(f"_hot_{c}") for c in on],
        F.ceil(F.col("_rows") * parts / total).cast("int").alias("_shares"),
    )


def join_unique(
    fact: DataFrame, dim: DataFrame, on: list[str], how: str, spread_by: list[str]
) -> DataFrame:
    """``fact`` joined to ``dim``, which holds at most one row per ``on``.

    ``how`` is inner, left, left_semi or left_anti. ``spread_by`` are fact columns that vary within
    a key; the share of a row is a hash of them, so a repeated task finds the same share. One pass
    over the key columns finds the hot keys; without any, this is a plain join. If ``spread_by`` adds
    nothing to the key, its rows could not be told apart, and no pass is made.
    """
    if how in ("inner", "left_semi"):
        fact = fact.where(all_of([F.col(c).isNotNull() for c in on]))
    if set(spread_by) <= set(on):
        return fact.join(dim, on, how)
    hot = stored(hot_keys(fact, on, shuffle_partitions(fact.sparkSession)), "hot")
    if hot.isEmpty():
        return fact.join(dim, on, how)

    def with_shares(side: DataFrame) -> DataFrame:
        same = all_of([F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in on])
        return side.join(F.broadcast(hot), same, "left")

    share = F.pmod(F.xxhash64(*spread_by), F.col("_shares").cast("long"))
    shared = with_shares(fact).select(*fact.columns, F.coalesce(share, F.lit(0)).cast("int").alias("_share"))
    numbers = F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)
    copies = with_shares(dim).select(*dim.columns, F.explode(numbers).alias("_share"))
    return shared.join(copies, [*on, "_share"], how).drop("_share")


def join_checked(
    fact: DataFrame, dim: DataFrame, on: list[str], how: str, spread_by: list[str]
) -> DataFrame:
    """Like ``join_unique``, with a broadcast of ``dim`` when its measured size allows it."""
    if fits_broadcast(dim):
        return fact.join(F.broadcast(dim), on, how)
    return join_unique(fact, dim, on, how, spread_by)
