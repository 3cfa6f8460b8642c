"""Counts that are kept up by the changes of a batch instead of being counted again.

Two small tables are kept: devices and loan devices per location, and locations per site and room
type. A batch of flag changes (C6) or of location changes (C4) turns into signed differences, taken
from its log and from the rows that the log names; adding them up gives the counts after the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import location_ref
from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored

_BY_ROOM = ["site_name", "room_type"]


def device_counts(inv: DataFrame) -> DataFrame:
    """location_id (NULL: none), devices, loaners."""
    return inv.groupBy("location_id").agg(
        F.count("*").alias("devices"), F.coalesce(F.sum(F.col("is_loaner").cast("long")), F.lit(0)).alias("loaners")
    )


def location_counts(loc: DataFrame) -> DataFrame:
    """site_name, room_type, locations."""
    return loc.groupBy(*_BY_ROOM).agg(F.count("*").alias("locations"))


def flag_deltas(audit: DataFrame, devices: DataFrame) -> DataFrame:
    """Differences of ``device_counts`` from the log of ``toggle_loaner``.

    Flips of one tag add up to what they changed in the end. Of ``devices`` (asset_tag, location_id)
    only the rows of tags that changed are joined.
    """

    def as_number(value: str) -> Column:
        return F.when(F.col(value) == "True", 1).otherwise(0)

    flips = audit.where((F.col("field_name") == "is_loaner") & F.col("asset_tag").isNotNull())
    net = flips.groupBy("asset_tag").agg(F.sum(as_number("new_value") - as_number("old_value")).alias("_net"))
    net = stored(net.where("_net <> 0"), "net")
    places = join_checked(devices.select("asset_tag", "location_id"), net, ["asset_tag"], "inner", ["location_id"])
    return places.groupBy("location_id").agg(F.lit(0).cast("long").alias("devices"), F.sum("_net").alias("loaners"))


def location_deltas(audit: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of ``location_counts`` from the log of ``apply_location_changes``.

    Only locations that the log names are looked at, as they were before and as they are after.
    """
    named = stored(audit.select(F.col("asset_tag").alias("_ref")).distinct(), "named")
    sides = []
    for loc, sign in ((before, -1), (after, 1)):
        rows = loc.select(location_ref("location_id").alias("_ref"), *_BY_ROOM)
        rows = join_checked(rows, named, ["_ref"], "left_semi", ["_ref"])
        sides.append(rows.groupBy(*_BY_ROOM).agg((F.count("*") * sign).alias("locations")))
    return sides[0].unionByName(sides[1])


def add_deltas(counts: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Counts with differences added; what nothing is left of goes."""
    keys = ["location_id"] if "location_id" in counts.columns else _BY_ROOM
    sums = [c for c in counts.columns if c not in keys]
    rows = counts
    for delta in deltas:
        rows = rows.unionByName(delta)
    # The first sum says whether anything is left.
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).where(F.col(sums[0]) != 0)


def kept_by_room(loc: DataFrame, devices: DataFrame, places: DataFrame) -> DataFrame:
    """site_name, room_type, locations, devices and loaners from kept counts, without the inventory."""
    held = loc.join(devices, "location_id").groupBy(*_BY_ROOM).agg(F.sum("devices").alias("devices"), F.sum("loaners").alias("loaners"))
    return places.join(held, _BY_ROOM, "left").select(
        *_BY_ROOM, "locations", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("devices", "loaners")]
    )
