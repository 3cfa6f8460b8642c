"""Counting reports over the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import is_blank, joined_key, not_blank, percent_text, under
from fleetlens.operators.collation import group_under
from fleetlens.operators.ordering import AT, PIECE, cut_pieces
from fleetlens.schemas import EQUIPMENT_CHECK, ROOM_NAME_REPORT
from fleetlens.sources.storage import stored

# A text in one cell, with room for the rows around it.
CELL_BYTES = 1 << 30


def side_by_side(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """One-row tables with different columns as one row."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.sum(c).alias(c) for c in columns])


def inventory_profile(
    inv: DataFrame, nonblank_only: bool = False, approx: bool = False, collation: str | None = None
) -> DataFrame:
    """Totals, distinct counts and blank counts.

    Sites, rooms and locations come from one small pre-aggregation by (site, room); only the asset
    tags need a wide distinct, done on that column alone.
    """
    tag = under("asset_tag", collation)
    rows = inv.where(not_blank(tag)) if nonblank_only else inv
    rooms = rows.groupBy("site_name", "room_number").agg(
        F.count("*").alias("_n"), F.count_if(is_blank(tag)).alias("_blank_tags")
    )
    site, room = under("site_name", collation), under("room_number", collation)
    places = rooms.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        F.count_distinct(site).alias("unique_sites"),
        F.count_distinct(room).alias("unique_rooms"),
        F.count_distinct(under(joined_key("site_name", "room_number"), collation)).alias("unique_locations"),
        F.coalesce(F.sum("_blank_tags"), F.lit(0)).alias("null_asset_tags"),
        F.coalesce(F.sum(F.when(is_blank(site), F.col("_n"))), F.lit(0)).alias("null_sites"),
        F.coalesce(F.sum(F.when(is_blank(room), F.col("_n"))), F.lit(0)).alias("null_rooms"),
    )
    tags = F.approx_count_distinct(tag) if approx else F.count_distinct(tag)
    columns = [
        "total_records", "unique_assets", "unique_sites", "unique_rooms", "unique_locations",
        "null_asset_tags", "null_sites", "null_rooms",
    ]
    return side_by_side([places, rows.agg(tags.alias("unique_assets"))], columns)


def site_summary(inv: DataFrame, collation: str | None = None) -> DataFrame:
    """Rooms, rows and untagged rows per site."""
    rooms = inv.groupBy("site_name", "room_number", "room_name").agg(
        F.count("*").alias("_n"), F.count_if(is_blank(under("asset_tag", collation))).alias("_blank")
    )
    return group_under(
        rooms,
        ["site_name"],
        collation,
        F.count_distinct(under("room_number", collation)).alias("unique_rooms"),
        F.sum("_n").alias("total_records"),
        F.sum("_blank").alias("records_without_assets"),
    ).orderBy(under("site_name", collation))


def room_name_frequency(inv: DataFrame, collation: str | None = None) -> DataFrame:
    names = inv.groupBy("room_name").agg(
        F.count("*").alias("_n"), F.count_if(is_blank(under("asset_tag", collation))).alias("_blank")
    )
    counts = [F.sum("_n").alias("count"), F.sum("_blank").alias("null_asset_count")]
    return (
        group_under(names, ["room_name"], collation, *counts)
        .select(F.lit(ROOM_NAME_REPORT).alias("analysis"), "room_name", "count", "null_asset_count")
        .orderBy(F.desc("count"), under("room_name", collation))
    )


def asset_type_distribution(inv: DataFrame, min_count: int = 5) -> DataFrame:
    """Types with more than ``min_count`` rows; the share of untagged rows is text.

    Tags are grouped first, so a type with a third of all rows is spread by its tags.
    """
    tags = (
        inv.where(not_blank("asset_type"))
        .groupBy("asset_type", "asset_tag")
        .agg(F.count("*").alias("_n"))
    )
    types = tags.groupBy("asset_type").agg(
        F.sum("_n").alias("total_records"),
        F.count("asset_tag").alias("unique_assets"),
        F.coalesce(F.sum(F.when(is_blank("asset_tag"), F.col("_n"))), F.lit(0)).alias("null_asset_count"),
    )
    return (
        types.where(F.col("total_records") > min_count)
        .withColumn("null_percentage", percent_text(F.col("null_asset_count"), F.col("total_records")))
        .orderBy(F.desc("total_records"), "asset_type")
    )


def null_patterns(inv: DataFrame) -> DataFrame:
    """Unlinked rows by which location fields are set."""

    def status(name: str) -> Column:
        return F.when(F.col(name).isNull(), "NULL").otherwise("NOT NULL").alias(f"{name}_status")

    fields = ["site_name", "room_number", "room_name"]
    return (
        inv.where("location_id IS NULL")
        .groupBy(*[status(f) for f in fields])
        .agg(F.count("*").alias("record_count"))
        .orderBy(F.desc("record_count"), *[f"{f}_status" for f in fields])
    )


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_records"),
        F.count(column).alias(f"records_with_{column}"),
        F.count_if(F.col(column).isNull()).alias(f"records_missing_{column}"),
    )


def equipment_location_check(eq: DataFrame) -> DataFrame:
    return eq.agg(
        F.lit(EQUIPMENT_CHECK).alias("check_type"),
        F.count("*").alias("total_records"),
        F.count_if(F.col("location_id").isNull()).alias("missing_location"),
    )


def table_counts(named: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several tables in one row."""
    return side_by_side([df.agg(F.count("*").alias(n)) for n, df in named.items()], list(named))


def total_items(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_items"))


def group_concat_ordered(df: DataFrame, by: list[str], value: str, order: list[str], sep: str = ",") -> DataFrame:
    """The values of each group as one text in the given order, which must be unique within a group.

    The rows are sorted over all tasks; each piece makes the text of its part of a group, and the few
    texts of a group are then put together. A group whose text no cell can hold is an error.
    """
    rows = df.where(F.col(value).isNotNull()).select(*dict.fromkeys([*by, value, *order]))
    items = F.array_sort(F.collect_list(F.struct(AT, value)))
    text = F.array_join(F.transform(items, lambda item: item[value]), sep)
    parts = stored(cut_pieces(rows, [*by, *order]).groupBy(PIECE, *by).agg(text.alias("_text")), "texts")
    sizes = parts.groupBy(*by).agg(F.sum(F.octet_length("_text") + F.lit(len(sep.encode()))).alias("_size"))
    too_long = sizes.where(F.col("_size") > CELL_BYTES).select(*by).first()
    if too_long is not None:
        raise ValueError(f"the text of {too_long.asDict()} is too long for one cell")
    in_turn = F.array_sort(F.collect_list(F.struct(PIECE, "_text")))
    return parts.groupBy(*by).agg(F.array_join(F.transform(in_turn, lambda part: part["_text"]), sep).alias(value))
