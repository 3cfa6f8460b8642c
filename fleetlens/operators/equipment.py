"""The equipment table: one cleaned row per asset tag, linked to a location."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import clean_timestamp, laptop_name, loaner_flag, not_blank
from fleetlens.operators.locations import find_locations
from fleetlens.operators.quality import duplicate_keys
from fleetlens.operators.skew import join_checked
from fleetlens.schemas import EQUIPMENT, MIGRATION_USER
from fleetlens.sources.storage import stored

NO_TYPE = "asset_type is missing"
REPEATED_TAG = "asset_tag is not unique"


def build_equipment(
    inv: DataFrame,
    loc: DataFrame,
    as_of: datetime,
    exact_names: bool = False,
    case_sensitive: bool = False,
    fold_keys: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Equipment, and the tagged rows that cannot become equipment with the reason.

    Only the tags are shuffled to find repeated ones; the wide rows then meet the short list of
    repeated tags and the locations.
    """
    tagged = inv.where(not_blank("asset_tag"))
    repeated = stored(
        duplicate_keys(tagged.select("asset_tag"), ["asset_tag"]).select("asset_tag", F.lit(True).alias("_repeated")),
        "tags",
    )
    marked = join_checked(tagged, repeated, ["asset_tag"], "left", ["inventory_id"])
    reason = F.when(F.col("_repeated"), REPEATED_TAG).when(F.col("asset_type").isNull(), NO_TYPE)
    judged = marked.withColumn("_reason", reason)

    rejected = judged.where("_reason IS NOT NULL").select(
        "inventory_id", "asset_tag", F.col("_reason").alias("reason")
    )
    good = find_locations(
        judged.where("_reason IS NULL"), loc, ["location_id"], ["inventory_id"], fold_keys
    )
    equipment = good.select(
        "asset_tag",
        "site_name",
        "room_number",
        "room_name",
        F.col("_loc_location_id").alias("location_id"),
        laptop_name("asset_type", exact_names, case_sensitive).alias("asset_type"),
        "model",
        "serial_number",
        "assigned_to",
        clean_timestamp("date_assigned").alias("date_assigned"),
        clean_timestamp("date_decommissioned").alias("date_decommissioned"),
        loaner_flag("asset_type", "notes", case_sensitive).alias("is_loaner"),
        "notes",
        F.lit(as_of).cast("timestamp_ntz").alias("last_updated"),
        F.lit(MIGRATION_USER).alias("last_updated_by"),
    )
    return equipment.select(*EQUIPMENT.fieldNames()), rejected


