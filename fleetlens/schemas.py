"""Declared schemas. String lengths sit in the field metadata and are checked as data quality."""

from __future__ import annotations

from pyspark.sql import types as T


# Labels that stand in results.
MIGRATION_USER = "Migration Script"
ROOM_NAME_REPORT = "Room Type Analysis"
LOCATION_CHECK = "Location Migration Check"
EQUIPMENT_CHECK = "Equipment Location Check"
NO_LOCATION_DATA = "All location fields are NULL"
SOME_LOCATION_DATA = "Has some location data"


def _text(name: str, length: int | None = None, required: bool = False) -> T.StructField:
    meta = {"max_length": length} if length else {}
    return T.StructField(name, T.StringType(), not required, meta)


def _long(name: str, required: bool = False) -> T.StructField:
    return T.StructField(name, T.LongType(), not required)


def _time(name: str, required: bool = False) -> T.StructField:
    return T.StructField(name, T.TimestampNTZType(), not required)


def _flag(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType(), False)


IMPORT_REQUIRED = ["manufacturer", "model_number", "hardware_type", "serial_number"]
IMPORT_OPTIONAL = ["assigned_to", "room_name", "date_assigned", "date_decommissioned"]
IMPORT_COLUMNS = IMPORT_REQUIRED + IMPORT_OPTIONAL
IMPORT_ALIASES = {"location": "room_name"}

LOCATION_FIELDS = ["site_name", "room_number", "room_name", "room_type"]

INVENTORY = T.StructType(
    [
        _long("inventory_id", True),
        _text("site_name", 100),
        _text("room_number", 50),
        _text("room_name", 100),
        _text("asset_tag", 100),
        _text("asset_type", 100),
        _text("model", 255),
        _text("serial_number", 100),
        _text("notes"),
        _text("assigned_to", 255),
        _text("date_assigned"),
        _text("date_decommissioned"),
        _long("location_id"),
        _flag("is_loaner"),
    ]
)

LOCATIONS = T.StructType(
    [
        _long("location_id", True),
        _text("site_name", 100, True),
        _text("room_number", 50, True),
        _text("room_name", 100, True),
        _text("room_type", 50, True),
    ]
)

LOANER_CHECKOUTS = T.StructType(
    [
        _long("checkout_id", True),
        _long("inventory_id", True),
        _text("user_name", 100, True),
        _time("checkout_date", True),
        _time("expected_return_date"),
        _time("checkin_date"),
        _text("checkout_notes", 500),
    ]
)

# The columns of the list of devices that are out, in their order.
CHECKED_OUT_COLUMNS = [
    "inventory_id", "site_name", "room_number", "room_name", "asset_tag", "asset_type", "model", "serial_number",
    "inventory_notes", "assigned_to", "date_assigned", "date_decommissioned", "location_id", "is_loaner",
    "checkout_id", "user_name", "checkout_date", "expected_return_date", "checkout_notes",
]

# The columns of a page of devices, in their order.
PAGE_COLUMNS = [
    "inventory_id", "site_name", "room_number", "room_name", "room_type", "asset_tag", "asset_type", "model",
    "serial_number", "notes", "assigned_to", "date_assigned", "date_decommissioned", "is_loaner",
]

EQUIPMENT = T.StructType(
    [
        _text("asset_tag", 100, True),
        _text("site_name", 100),
        _text("room_number", 50),
        _text("room_name", 100),
        _long("location_id"),
        _text("asset_type", 100, True),
        _text("model", 255),
        _text("serial_number", 100),
        _text("assigned_to", 255),
        _time("date_assigned"),
        _time("date_decommissioned"),
        _flag("is_loaner"),
        _text("notes"),
        _time("last_updated", True),
        _text("last_updated_by", 100),
    ]
)

# The rules of the equipment table for the columns that a raw inventory row brings along.
EQUIPMENT_RULES = T.StructType(
    [f for f in EQUIPMENT if f.name in INVENTORY.fieldNames() and isinstance(f.dataType, T.StringType)]
)

EQUIPMENT_LOANS = T.StructType(
    [
        _long("loan_id", True),
        _text("asset_tag", 100, True),
        _text("loaned_to", 255, True),
        _time("checkout_date", True),
        _time("expected_return_date", True),
        _time("actual_return_date"),
        _long("original_location_id"),
        _long("temporary_location_id"),
        _text("checkout_notes"),
        _text("return_notes"),
        _text("checked_out_by", 255, True),
        _text("checked_in_by", 255),
        _time("created_date", True),
        _text("created_by", 100, True),
        _time("last_updated", True),
        _text("last_updated_by", 100, True),
    ]
)

AUDIT_LOG = T.StructType(
    [
        _long("audit_id", True),
        _text("action_type", 10, True),
        _text("asset_tag", 100, True),
        _text("field_name", 100, True),
        _text("old_value"),
        _text("new_value"),
        _text("changed_by", 255, True),
        _time("changed_at", True),
        _text("notes"),
    ]
)
AUDIT_COLUMNS = [f.name for f in AUDIT_LOG if f.name != "audit_id"]

LOAN_COMMANDS = T.StructType(
    [
        _long("command_id", True),
        _time("command_ts", True),
        _text("kind", 10, True),
        _long("inventory_id"),
        _long("checkout_id"),
        _text("user_name"),
        _time("expected_return_date"),
        _text("notes"),
    ]
)

# `given` lists the fields a command carries: a field given as NULL differs from one left out.
LOCATION_COMMANDS = T.StructType(
    [
        _long("command_id", True),
        _time("command_ts", True),
        _text("kind", 10, True),
        _long("location_id"),
        *[_text(name) for name in LOCATION_FIELDS],
        T.StructField("given", T.ArrayType(T.StringType())),
        _text("changed_by"),
    ]
)

TOGGLE_COMMANDS = T.StructType(
    [
        _long("command_id", True),
        _time("command_ts", True),
        _text("asset_tag"),
        _text("changed_by"),
    ]
)
