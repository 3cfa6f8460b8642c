"""The whole move from a raw inventory to locations, linked inventory and equipment."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.taxonomy import NINE_RULES
from fleetlens.operators.equipment import build_equipment
from fleetlens.operators.locations import assign_location, build_locations, reconcile_locations
from fleetlens.operators.quality import require, require_columns
from fleetlens.operators.reports import coverage, inventory_profile, side_by_side, table_counts
from fleetlens.operators.tidy import add_flag_column, add_nullable_column
from fleetlens.sources.storage import stored


@dataclass
class Migration:
    profile: DataFrame
    locations: DataFrame
    inventory: DataFrame
    equipment: DataFrame
    rejected: DataFrame
    reconciliation: DataFrame
    coverage: DataFrame
    counts: DataFrame


def migrate(
    inv: DataFrame, as_of: datetime, taxonomy=NINE_RULES, strict: bool = False, case_sensitive: bool = False
) -> Migration:
    """Profile, check, build and verify. ``strict`` stops on blank or repeated tags.

    The linked inventory is written once, because equipment and checks read it again.
    """
    require_columns(inv, ["inventory_id", "asset_tag", "asset_type", "site_name", "room_number", "room_name"])
    inv = add_flag_column(add_nullable_column(inv, "location_id", "long"))
    if strict:
        require(inv, not_blank_columns=["asset_tag"], unique=["asset_tag"])
    locations = stored(build_locations(inv, taxonomy, "all", case_sensitive), "locations")
    linked = stored(assign_location(inv, locations), "inventory")
    equipment, rejected = build_equipment(linked, locations, as_of, case_sensitive=case_sensitive)
    return Migration(
        profile=inventory_profile(inv),
        locations=locations,
        inventory=linked,
        equipment=equipment,
        rejected=rejected,
        reconciliation=reconcile_locations(linked, locations),
        coverage=coverage(linked, "location_id"),
        counts=side_by_side(
            [
                equipment.agg(F.count("*").alias("equipment_count"), F.count_if("is_loaner").alias("loaner_count")),
                table_counts({"locations_count": locations}),
            ],
            ["equipment_count", "locations_count", "loaner_count"],
        ),
    )
