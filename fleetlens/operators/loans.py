"""Which loan devices are free, which are out, and which are late."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import display, is_blank, overdue
from fleetlens.operators.skew import fits_broadcast, join_checked, join_unique
from fleetlens.schemas import CHECKED_OUT_COLUMNS
from fleetlens.sources.storage import stored


def as_of_column(as_of: datetime | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def open_loans(loans: DataFrame) -> DataFrame:
    return loans.where("checkin_date IS NULL")


def join_devices(opened: DataFrame, devices: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """Stored open loans with their devices. Few loans travel to the devices; many are shuffled."""
    if fits_broadcast(opened):
        return devices.join(F.broadcast(opened), on)
    return join_unique(opened, devices, on, "inner", spread_by)


def available_loaners(inv: DataFrame, loans: DataFrame, skip_decommissioned: bool = False) -> DataFrame:
    """Loan devices without an open loan. Decommissioned ones count unless told otherwise.

    The few devices that are out are collected first, so the inventory is read once and not shuffled.
    """
    out = stored(open_loans(loans).select("inventory_id").distinct(), "out")
    free = join_checked(inv.where("is_loaner"), out, ["inventory_id"], "left_anti", ["inventory_id"])
    free = free.select(*inv.columns)
    return free.where(is_blank("date_decommissioned")) if skip_decommissioned else free


def checked_out_loaners(inv: DataFrame, loans: DataFrame) -> DataFrame:
    """Open loans with their device, one row per open loan."""
    devices = inv.where("is_loaner").withColumnRenamed("notes", "inventory_notes")
    opened = stored(open_loans(loans), "open")
    return join_devices(opened, devices, ["inventory_id"], ["checkout_id"]).select(*CHECKED_OUT_COLUMNS)


def active_loans(
    eq: DataFrame, loans: DataFrame, loc: DataFrame | None, as_of: datetime | Column
) -> DataFrame:
    """Loans not returned yet, late ones marked with 1.

    With ``loc`` the home and current rooms are shown; without it ``eq`` may be the inventory.
    """
    late = overdue("expected_return_date", as_of_column(as_of)).cast("int").alias("is_overdue")
    device = [F.col("asset_tag"), F.col("asset_type"), F.col("model"), F.col("serial_number")]
    if loc is not None:
        device += [F.col("site_name").alias("home_site"), F.col("room_number").alias("home_room"), F.col("room_name").alias("home_room_name")]
    out = stored(loans.where("actual_return_date IS NULL"), "open")
    columns = ["loan_id", "asset_tag", "asset_type", "model", "serial_number"]
    shown = join_devices(out, eq.select(*device), ["asset_tag"], ["loan_id"])
    if loc is not None:
        rooms = loc.select(
            F.col("location_id").alias("temporary_location_id"),
            F.col("site_name").alias("current_site"),
            F.col("room_number").alias("current_room"),
            F.col("room_name").alias("current_room_name"),
        )
        shown = join_checked(shown, rooms, ["temporary_location_id"], "left", ["loan_id"])
        columns += ["home_site", "home_room", "home_room_name", "current_site", "current_room", "current_room_name"]
    columns += ["loaned_to", "checkout_date", "expected_return_date", "checkout_notes", "checked_out_by"]
    return shown.select(*columns, late)


def loan_status(inv: DataFrame, loans: DataFrame) -> DataFrame:
    """All loan devices with status, holder and dates, as shown to people; one row per open loan.

    Open loans are stored once, without what is not shown, and each device meets its own.
    """
    opened = open_loans(loans).select("inventory_id", "user_name", "checkout_date", "expected_return_date", "checkout_notes")
    opened = stored(opened.withColumn("_out", F.lit(True)), "open")
    devices = inv.where("is_loaner").select("inventory_id", "asset_tag", "asset_type", "model", "serial_number")
    both = devices.join(F.broadcast(opened) if fits_broadcast(opened) else opened, "inventory_id", "left")
    out = F.col("_out").isNotNull()

    def if_out(shown: Column, free: str) -> Column:
        return F.when(out, shown).otherwise(free)

    def day(name: str) -> Column:
        return if_out(F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit("N/A")), "N/A").alias(name)

    return both.select(
        "inventory_id",
        *[display(c).alias(c) for c in ("asset_tag", "asset_type", "model", "serial_number")],
        if_out(F.lit("Checked Out"), "Available").alias("status"),
        if_out(display("user_name", "N/A"), "N/A").alias("current_user"),
        day("checkout_date"),
        day("expected_return_date"),
        if_out(display("checkout_notes"), "").alias("notes"),
    )


def open_checkout_device(loans: DataFrame, inv: DataFrame, keys: DataFrame) -> DataFrame:
    """For a batch of checkout ids: device, borrower and tag of those that are still open."""
    wanted = open_loans(loans).join(keys.select("checkout_id").distinct(), "checkout_id", "left_semi")
    wanted = stored(wanted.select("checkout_id", "inventory_id", "user_name"), "open")
    return join_devices(wanted, inv.select("inventory_id", "asset_tag"), ["inventory_id"], ["checkout_id"])
