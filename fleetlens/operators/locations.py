"""The location dimension: build it, link devices to it, check it, count by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import UNKNOWN, joined_key, key_or_unknown, under
from fleetlens.functions.taxonomy import NINE_RULES, room_category
from fleetlens.operators.collation import group_under, join_under
from fleetlens.operators.ordering import assign_ids
from fleetlens.operators.skew import join_checked
from fleetlens.schemas import LOCATION_CHECK, LOCATION_FIELDS
from fleetlens.sources.tables import next_id

Rules = list[tuple[list[str], str]]
_KEYS = ["_site", "_room"]


def _with_keys(df: DataFrame, fold_keys: bool) -> DataFrame:
    return df.withColumn("_site", key_or_unknown("site_name", fold_keys)).withColumn(
        "_room", key_or_unknown("room_number", fold_keys)
    )


def _kept(inv: DataFrame, keep: str) -> DataFrame:
    if keep == "any_field":
        return inv.where("site_name IS NOT NULL OR room_number IS NOT NULL OR room_name IS NOT NULL")
    if keep == "room_number":
        return inv.where(F.col("room_number").isNotNull())
    if keep == "all":
        return inv
    raise ValueError(f"keep must be any_field, room_number or all, not {keep!r}")


def _rooms(inv: DataFrame, taxonomy: Rules, keep: str, case_sensitive: bool, fold_keys: bool) -> DataFrame:
    """One row per (site, room) of the inventory with name and category, and its keys."""
    site, room = key_or_unknown("site_name"), key_or_unknown("room_number")
    rooms = (
        _with_keys(_kept(inv, keep), fold_keys)
        .groupBy(*_KEYS)
        .agg(F.min(site).alias("site_name"), F.min(room).alias("room_number"), F.min("room_name").alias("_name"))
    )
    return rooms.select(
        *_KEYS,
        "site_name",
        "room_number",
        F.coalesce("_name", F.lit(UNKNOWN)).alias("room_name"),
        room_category("_name", taxonomy, case_sensitive).alias("room_type"),
    )


def build_locations(
    inv: DataFrame,
    taxonomy: Rules = NINE_RULES,
    keep: str = "all",
    case_sensitive: bool = False,
    fold_keys: bool = False,
    start: int = 1,
) -> DataFrame:
    """One row per (site, room) of the inventory, with an id and a room category.

    A room with several names gets the smallest one; ``location_conflicts`` lists such rooms.
    """
    named = _rooms(inv, taxonomy, keep, case_sensitive, fold_keys).drop(*_KEYS)
    return assign_ids(named, ["site_name", "room_number"], start, "location_id")


def new_locations(
    loc: DataFrame,
    inv: DataFrame,
    taxonomy: Rules = NINE_RULES,
    keep: str = "all",
    case_sensitive: bool = False,
    fold_keys: bool = False,
) -> DataFrame:
    """The rooms of the inventory that ``loc`` lacks, with ids that go on behind its largest one."""
    known = _with_keys(loc, fold_keys).select(*_KEYS)
    fresh = _rooms(inv, taxonomy, keep, case_sensitive, fold_keys).join(known, _KEYS, "left_anti").drop(*_KEYS)
    return assign_ids(fresh, ["site_name", "room_number"], next_id(loc, "location_id"), "location_id")


def refill_locations(loc: DataFrame, inv: DataFrame, **how) -> DataFrame:
    """``loc`` as it is, and the rooms that it lacks: a second run over the same inventory adds nothing.

    Takes what ``build_locations`` takes. Rooms that are known keep id, name and category.
    """
    return loc.select("location_id", *LOCATION_FIELDS).unionByName(new_locations(loc, inv, **how))


def category_preview(
    inv: DataFrame, taxonomy: Rules = NINE_RULES, keep: str = "room_number", case_sensitive: bool = False
) -> DataFrame:
    """Distinct raw rooms with the category they would get."""
    return (
        _kept(inv, keep)
        .select("site_name", "room_number", "room_name")
        .distinct()
        .withColumn("proposed_category", room_category("room_name", taxonomy, case_sensitive))
        .orderBy("site_name", "room_number", "room_name")
    )


def location_conflicts(inv: DataFrame) -> DataFrame:
    """Rooms that occur under more than one name."""
    return (
        inv.groupBy(
            key_or_unknown("site_name").alias("site_name"), key_or_unknown("room_number").alias("room_number")
        )
        .agg(F.count_distinct(key_or_unknown("room_name")).alias("n_names"))
        .where("n_names > 1")
    )


def find_locations(
    rows: DataFrame, loc: DataFrame, columns: list[str], spread_by: list[str], fold_keys: bool = False
) -> DataFrame:
    """``rows`` plus ``columns`` of the location with the same site and room, or NULLs."""
    dim = _with_keys(loc, fold_keys).select(*_KEYS, *[F.col(c).alias(f"_loc_{c}") for c in columns])
    return join_checked(_with_keys(rows, fold_keys), dim, _KEYS, "left", spread_by).drop(*_KEYS)


def assign_location(
    inv: DataFrame, loc: DataFrame, reset: bool = False, fold_keys: bool = False
) -> DataFrame:
    """Set location_id by site and room. Unmatched rows keep their id, or lose it with ``reset``."""
    found = find_locations(inv, loc, ["location_id"], ["inventory_id"], fold_keys)
    old = F.lit(None).cast("long") if reset or "location_id" not in inv.columns else F.col("location_id")
    columns = [c for c in inv.columns if c != "location_id"]
    linked = found.select(*columns, F.coalesce("_loc_location_id", old).alias("location_id"))
    return linked.select(*inv.columns) if "location_id" in inv.columns else linked


def location_exists(candidates: DataFrame, loc: DataFrame, collation: str | None = None) -> DataFrame:
    """For each candidate (site, room): is it there, and under which id. NULL is no room.

    Under a collation candidates that are equal are asked once; of several locations the smallest id.
    """
    key = ["site_name", "room_number"]
    wanted = candidates.select(*key).distinct()
    known = loc.select(*key, "location_id")
    if collation is not None:
        wanted = group_under(wanted, key, collation, F.lit(1).alias("_one")).select(*key)
        known = group_under(known, key, collation, F.min("location_id").alias("location_id"))
    return join_under(wanted, known, key, "left", collation, key).select(
        *key, F.col("location_id").isNotNull().alias("exists"), "location_id"
    )


def deletable_locations(loc: DataFrame, inv: DataFrame) -> DataFrame:
    """Locations that no inventory row uses."""
    used = inv.where("location_id IS NOT NULL").select("location_id").distinct()
    return loc.join(used, "location_id", "left_anti")


def location_list(loc: DataFrame, collation: str | None = None) -> DataFrame:
    by = [under("site_name", collation), under("room_number", collation)]
    return loc.select("location_id", *LOCATION_FIELDS).orderBy(*by, *["location_id"] * bool(collation))


def room_types(loc: DataFrame, collation: str | None = None) -> DataFrame:
    types = loc.select("room_type").distinct()
    if collation is not None:
        types = group_under(types, ["room_type"], collation, F.lit(1).alias("_one")).select("room_type")
    return types.orderBy(under("room_type", collation))


def devices_per_location(rows: DataFrame, *sums) -> DataFrame:
    """Counts per location_id, combined before the shuffle, so a crowded location costs nothing."""
    return rows.where("location_id IS NOT NULL").groupBy("location_id").agg(
        F.count("*").alias("_devices"), *sums
    )


def by_site_type(loc: DataFrame, inv: DataFrame, how: str = "inner") -> DataFrame:
    """Devices per site and room type. ``left`` counts an empty location as one."""
    counted = loc.join(devices_per_location(inv), "location_id", how)
    weight = F.coalesce("_devices", F.lit(1))
    return (
        counted.groupBy("site_name", "room_type")
        .agg(F.sum(weight).alias("equipment_count"))
        .orderBy("site_name", "room_type")
    )


def locations_by_type(loc: DataFrame) -> DataFrame:
    return (
        loc.groupBy("room_type")
        .agg(
            F.count("*").alias("location_count"),
            F.count_distinct(joined_key("site_name", "room_number")).alias("unique_locations"),
        )
        .orderBy(F.desc("location_count"), "room_type")
    )


def equipment_by_type(eq: DataFrame, loc: DataFrame) -> DataFrame:
    """Devices and loaners per room type."""
    loaners = F.sum(F.col("is_loaner").cast("long")).alias("_loaners")
    return (
        loc.join(devices_per_location(eq, loaners), "location_id")
        .groupBy("room_type")
        .agg(F.sum("_devices").alias("equipment_count"), F.sum("_loaners").alias("loaner_count"))
        .orderBy(F.desc("equipment_count"), "room_type")
    )


def with_location(
    inv: DataFrame, loc: DataFrame, how: str = "inner", key: list[str] | None = None
) -> DataFrame:
    """Inventory rows with the fields of their location (site, room and name come from there)."""
    own = inv.drop("site_name", "room_number", "room_name", "room_type")
    return join_checked(own, loc, ["location_id"], how, key or ["inventory_id"])


def location_review(inv: DataFrame, loc: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` linked rows by site and room, for a look at the result."""
    own = inv.select("inventory_id", "site_name", "room_number", "room_name", "location_id")
    dim = loc.select(
        "location_id", "room_type", F.col("site_name").alias("_site"), F.col("room_number").alias("_room")
    )
    return (
        join_checked(own, dim, ["location_id"], "inner", ["inventory_id"])
        .orderBy("_site", "_room", "inventory_id")
        .limit(n)
        .select("inventory_id", "site_name", "room_number", "room_name", "location_id", "room_type")
    )


def reconcile_locations(inv: DataFrame, loc: DataFrame) -> DataFrame:
    """Distinct (site, room) in the source next to the number of locations built."""
    source = (
        inv.select(key_or_unknown("site_name").alias("s"), key_or_unknown("room_number").alias("r"))
        .distinct()
        .select(F.concat_ws("-", "s", "r").alias("k"))
        .agg(F.count_distinct("k").alias("original_location_count"), F.lit(0).alias("new_location_count"))
    )
    built = loc.agg(F.lit(0).alias("original_location_count"), F.count("*").alias("new_location_count"))
    return (
        source.unionByName(built)
        .agg(
            F.sum("original_location_count").alias("original_location_count"),
            F.sum("new_location_count").alias("new_location_count"),
        )
        .select(F.lit(LOCATION_CHECK).alias("check_type"), "*")
    )


def backfill_location(eq: DataFrame, inv: DataFrame, loc: DataFrame) -> DataFrame:
    """Set location_id of equipment through the inventory row with the same tag.

    A tag on several inventory rows takes the smallest location id found for it.
    """
    links = inv.where("asset_tag IS NOT NULL").groupBy(
        "asset_tag", key_or_unknown("site_name").alias("site_name"), key_or_unknown("room_number").alias("room_number")
    ).agg(F.lit(1).alias("_one"))
    found = find_locations(links, loc, ["location_id"], ["asset_tag"])
    by_tag = found.groupBy("asset_tag").agg(F.min("_loc_location_id").alias("_new_id"))
    filled = eq.join(by_tag, "asset_tag", "left").withColumn(
        "location_id", F.coalesce("_new_id", "location_id")
    )
    return filled.select(*eq.columns)


