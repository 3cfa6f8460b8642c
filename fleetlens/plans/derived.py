"""Device tables derived from the generic test tables.

Each is one SELECT in the part of SQL that Spark and DuckDB share, so both engines start from the
same rows. ``{orders}`` and the like stand for the input tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2024, 1, 20)
AS_OF_SQL = "TIMESTAMP '2024-01-20 00:00:00'"

_ROOM_NAME = """
    CASE WHEN k % 101 = 0 OR c % 59 = 0 THEN NULL
         WHEN k % 211 = 0 THEN 'Office Annex'
         WHEN c % 12 = 0 THEN 'Cubicle' WHEN c % 12 = 1 THEN 'Corner Office'
         WHEN c % 12 = 2 THEN 'Conference' WHEN c % 12 = 3 THEN 'Storage'
         WHEN c % 12 = 4 THEN 'Server Closet' WHEN c % 12 = 5 THEN 'IT Desk'
         WHEN c % 12 = 6 THEN 'Restroom' WHEN c % 12 = 7 THEN 'Kitchen'
         WHEN c % 12 = 8 THEN 'Break Area' WHEN c % 12 = 9 THEN 'Hallway'
         WHEN c % 12 = 10 THEN 'office storage' ELSE 'Lobby' END"""

_ASSET_TYPE = """
    CASE WHEN k % 9 = 0 THEN 'Laptop' WHEN k % 9 = 1 THEN '14" Laptop'
         WHEN k % 9 = 2 THEN 'Loaner Laptop' WHEN k % 9 = 3 THEN 'Desktop'
         WHEN k % 9 = 4 THEN 'Monitor' WHEN k % 9 = 5 THEN 'Dock'
         WHEN k % 9 = 6 THEN 'Printer' WHEN k % 9 = 7 THEN '' ELSE NULL END"""

_NOTES = "CASE WHEN k % 13 = 0 THEN 'Loaner pool' WHEN k % 17 = 0 THEN 'temporary desk' ELSE NULL END"

_DATE_ASSIGNED = "CASE WHEN k % 7 = 0 THEN '' WHEN k % 11 = 0 THEN 'n/a' ELSE day_text END"

_DEVICES = """
    SELECT o_orderkey AS k, o_custkey AS c, c_name, c_mktsegment, n_name, o_orderpriority, o_orderstatus,
           substr(CAST(o_orderdate AS STRING), 1, 10) AS day_text
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""

INVENTORY = f"""
SELECT k + 1 AS inventory_id,
       CASE WHEN k % 101 = 0 OR c % 61 = 0 THEN NULL ELSE n_name END AS site_name,
       CASE WHEN k % 101 = 0 OR c % 53 = 0 THEN NULL ELSE concat('R', c % 36) END AS room_number,
       {_ROOM_NAME} AS room_name,
       CASE WHEN k % 50 = 0 THEN NULL WHEN k % 50 = 1 THEN ''
            WHEN k % 97 = 5 THEN concat('AT', k - 1) ELSE concat('AT', k) END AS asset_tag,
       {_ASSET_TYPE} AS asset_type,
       o_orderpriority AS model,
       concat('SN', k - k % 2) AS serial_number,
       {_NOTES} AS notes,
       c_name AS assigned_to,
       {_DATE_ASSIGNED} AS date_assigned,
       CASE WHEN o_orderstatus = 'F' THEN day_text ELSE '' END AS date_decommissioned,
       CAST(NULL AS BIGINT) AS location_id,
       (k % 9 = 2 OR k % 13 = 0) AS is_loaner
FROM ({_DEVICES}) devices"""

# A device sheet in the older column set; the header says "location" where the tables say room_name.
SHEET = f"""
SELECT c_mktsegment AS manufacturer, o_orderpriority AS model_number, {_ASSET_TYPE} AS hardware_type,
       concat('SN', k - k % 2) AS serial_number, c_name AS assigned_to, {_ROOM_NAME} AS location,
       {_DATE_ASSIGNED} AS date_assigned,
       CASE WHEN o_orderstatus = 'F' THEN day_text ELSE '' END AS date_decommissioned, k + 1 AS inventory_id
FROM ({_DEVICES}) devices"""

LOANS = """
SELECT event_id AS checkout_id, event_id - event_id % 3 + 1 AS inventory_id, concat('user', user_id) AS user_name,
       ts AS checkout_date,
       CASE WHEN event_id % 10 = 0 THEN NULL WHEN value < 50 THEN ts + INTERVAL 1 DAY
            ELSE ts + INTERVAL 14 DAY END AS expected_return_date,
       CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE ts + INTERVAL 2 DAY END AS checkin_date,
       CAST(NULL AS STRING) AS checkout_notes
FROM {events}"""

EQUIPMENT_LOANS = """
SELECT event_id AS loan_id, concat('AT', event_id - event_id % 3) AS asset_tag, concat('user', user_id) AS loaned_to,
       ts AS checkout_date,
       CASE WHEN value < 50 THEN ts + INTERVAL 1 DAY ELSE ts + INTERVAL 14 DAY END AS expected_return_date,
       CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE ts + INTERVAL 2 DAY END AS actual_return_date,
       CAST(NULL AS BIGINT) AS original_location_id,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 900 + 1 END AS temporary_location_id,
       event_type AS checkout_notes, CAST(NULL AS STRING) AS return_notes,
       concat('desk', event_id % 5) AS checked_out_by, CAST(NULL AS STRING) AS checked_in_by,
       ts AS created_date, 'desk' AS created_by, ts AS last_updated, 'desk' AS last_updated_by
FROM {events}"""

AUDIT_LOG = """
SELECT event_id AS audit_id,
       CASE WHEN event_type = 'signup' THEN 'CREATE' WHEN event_type = 'error' THEN 'DELETE'
            WHEN event_type = 'click' THEN 'CHECKOUT' WHEN event_type = 'view' THEN 'CHECKIN'
            ELSE 'UPDATE' END AS action_type,
       concat('AT', event_id - event_id % 3) AS asset_tag,
       'status' AS field_name,
       CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) AS STRING) END AS old_value,
       CASE WHEN event_type = 'error' THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) + 1 AS STRING) END AS new_value,
       concat('user', user_id) AS changed_by, ts AS changed_at, CAST(NULL AS STRING) AS notes
FROM {events}"""

LOAN_COMMANDS = """
SELECT event_id AS command_id, ts AS command_ts,
       CASE WHEN event_type = 'click' THEN 'CHECKOUT' ELSE 'CHECKIN' END AS kind,
       event_id - event_id % 3 + 1 AS inventory_id, CAST(NULL AS BIGINT) AS checkout_id,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE concat('user', user_id) END AS user_name,
       ts + INTERVAL 7 DAY AS expected_return_date, CAST(NULL AS STRING) AS notes
FROM {events} WHERE event_type IN ('click', 'view')"""

TOGGLE_COMMANDS = """
SELECT event_id AS command_id, ts AS command_ts, concat('AT', event_id - event_id % 3) AS asset_tag,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('user', user_id) END AS changed_by
FROM {events}"""

# Every event asks for a change of a room: new rooms of a few keys, renames, and removals.
LOCATION_COMMANDS = """
SELECT event_id AS command_id, ts AS command_ts,
       CASE WHEN event_type = 'signup' THEN 'CREATE' WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPDATE' END AS kind,
       CASE WHEN event_type = 'signup' THEN NULL ELSE event_id % 900 + 1 END AS location_id,
       CASE WHEN event_type = 'signup' THEN concat('NEW_', user_id % 7) ELSE NULL END AS site_name,
       CASE WHEN event_type = 'signup' THEN concat('N', event_id % 40) ELSE NULL END AS room_number,
       CASE WHEN event_type = 'error' OR event_id % 23 = 0 THEN NULL
            ELSE concat('Room ', CAST(floor(value / 40) AS BIGINT)) END AS room_name,
       CASE WHEN event_type = 'signup' THEN 'Workspace' WHEN event_type = 'view' THEN 'Storage' ELSE NULL END AS room_type,
       concat('user', user_id) AS changed_by
FROM {events}"""

# Rooms without devices.
VACANT = """
SELECT concat('Vacant ', s_nationkey) AS site_name, concat('V', s_suppkey) AS room_number, 'Spare Room' AS room_name,
       'Other' AS room_type
FROM {supplier}"""

# Check-ins that name a loan instead of a device; most loans are named several times.
LOAN_RETURNS = """
SELECT event_id AS command_id, ts AS command_ts, 'CHECKIN' AS kind, CAST(NULL AS BIGINT) AS inventory_id,
       event_id - event_id % 3 + user_id % 3 AS checkout_id, CAST(NULL AS STRING) AS user_name,
       CAST(NULL AS TIMESTAMP) AS expected_return_date, CAST(NULL AS STRING) AS notes
FROM {events}"""

# Checkouts, and check-ins that name a device or a loan by the command that makes it; twelve commands per device.
LOAN_HANDLES = """
SELECT 10000000 + event_id AS command_id, ts AS command_ts, CASE WHEN event_type IN ('click', 'signup') THEN 'CHECKOUT' ELSE 'CHECKIN' END AS kind,
       CASE WHEN event_type IN ('click', 'signup') OR event_id % 5 = 0 THEN event_id - event_id % 12 + 2 END AS inventory_id,
       CASE WHEN event_type IN ('click', 'signup') OR event_id % 5 = 0 THEN NULL
            ELSE 10000000 + event_id - event_id % 12 + user_id % 12 END AS checkout_id,
       concat('user', user_id) AS user_name, ts + INTERVAL 7 DAY AS expected_return_date, CAST(NULL AS STRING) AS notes
FROM {events}"""

# Every event moves a room to a number of its own.
LOCATION_MOVES = """
SELECT event_id AS command_id, ts AS command_ts, 'UPDATE' AS kind, event_id % 900 + 1 AS location_id,
       CASE WHEN event_type = 'view' THEN NULL ELSE concat('MOVED_', user_id % 5) END AS site_name,
       concat('M', event_id) AS room_number, CAST(NULL AS STRING) AS room_name, CAST(NULL AS STRING) AS room_type,
       concat('user', user_id) AS changed_by
FROM {events}"""

# Rooms named by the commands that make them, twelve commands to a group. A group fights over four rooms of its own, and
# some want a room that stays taken; the first groups also move two stored locations.
LOCATION_HANDLES = """
SELECT command_id, command_ts, kind, CASE WHEN kind = 'CREATE' THEN NULL WHEN of_stored THEN stored_id ELSE made_id END AS location_id,
       CASE WHEN kind = 'DELETE' OR event_type = 'view' AND kind = 'UPDATE' THEN NULL WHEN wants_taken THEN concat('Vacant ', s_nationkey)
            WHEN kind = 'CREATE' OR event_type = 'purchase' OR of_stored THEN concat('G', g) END AS site_name,
       CASE WHEN kind = 'DELETE' OR event_type = 'view' AND kind = 'UPDATE' THEN NULL WHEN wants_taken THEN concat('V', s_suppkey)
            ELSE concat('r', (user_id + event_id) % 4) END AS room_number,
       CASE WHEN kind = 'CREATE' OR event_type = 'view' AND event_id % 7 > 0 THEN concat('Name ', user_id % 3) END AS room_name,
       CASE WHEN kind = 'CREATE' THEN 'Other' END AS room_type, concat('user', user_id) AS changed_by
FROM (SELECT event_id, event_type, user_id, g, s_suppkey, s_nationkey, ts AS command_ts, 10000000 + event_id AS command_id,
             CASE WHEN event_type = 'signup' OR event_id % 12 < 2 THEN 'CREATE' WHEN event_type = 'error' THEN 'DELETE'
                  ELSE 'UPDATE' END AS kind,
             user_id % 4 = 0 AND event_id < 600 AS of_stored, 2 * g + 1 + user_id % 2 AS stored_id,
             10000000 + 12 * g + user_id % 5 AS made_id, s_suppkey IS NOT NULL AND user_id % 5 = 0 AND event_type <> 'view' AS wants_taken
      FROM (SELECT *, CAST((event_id - event_id % 12) / 12 AS BIGINT) AS g FROM {events}) e LEFT JOIN {supplier} ON s_suppkey = g) rows"""

_SPELLED = """CASE WHEN inventory_id % 3 = 0 THEN upper({0}) WHEN inventory_id % 5 = 0 THEN {0} || ' '
         WHEN inventory_id % 7 = 0 THEN lower({0}) ELSE {0} END AS {0}"""

# The inventory as several people typed it.
MIXED = f"""
SELECT inventory_id, {', '.join(_SPELLED.format(c) for c in ("site_name", "room_number", "room_name", "asset_tag", "asset_type"))},
       model, {', '.join(_SPELLED.format(c) for c in ("serial_number", "notes", "assigned_to"))},
       date_assigned, date_decommissioned, location_id, is_loaner
FROM ({INVENTORY}) inventory"""

NEEDS = {
    "inventory": (INVENTORY, ["orders", "customer", "nation"]),
    "mixed": (MIXED, ["orders", "customer", "nation"]),
    "sheet": (SHEET, ["orders", "customer", "nation"]),
    "vacant": (VACANT, ["supplier"]),
    "loans": (LOANS, ["events"]),
    "equipment_loans": (EQUIPMENT_LOANS, ["events"]),
    "audit_log": (AUDIT_LOG, ["events"]),
    "loan_commands": (LOAN_COMMANDS, ["events"]),
    "toggle_commands": (TOGGLE_COMMANDS, ["events"]),
    "location_commands": (LOCATION_COMMANDS, ["events"]),
    "loan_returns": (LOAN_RETURNS, ["events"]),
    "location_moves": (LOCATION_MOVES, ["events"]),
    "loan_handles": (LOAN_HANDLES, ["events"]),
    "location_handles": (LOCATION_HANDLES, ["events", "supplier"]),
}


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    text, tables = NEEDS[name]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def derived_sql(name: str) -> str:
    """The same table as text over views named like the tables."""
    text, tables = NEEDS[name]
    return text.format(**{t: t for t in tables})
