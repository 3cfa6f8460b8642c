"""The loan views under fixed names, for users who write SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from fleetlens.schemas import CHECKED_OUT_COLUMNS

#: The views by name. They are looked up anew by each query, so a later checkout shows in them.
VIEWS = {
    "available_loaners": """
SELECT * FROM {inventory} i
WHERE is_loaner AND NOT EXISTS (SELECT 1 FROM {loans} o WHERE o.checkin_date IS NULL AND o.inventory_id = i.inventory_id)""",
    "checked_out_loaners": f"""
SELECT {', '.join(CHECKED_OUT_COLUMNS)}
FROM (SELECT *, notes AS inventory_notes FROM {{inventory}} WHERE is_loaner)
JOIN (SELECT * FROM {{loans}} WHERE checkin_date IS NULL) USING (inventory_id)""",
    "loan_status": """
SELECT i.inventory_id, coalesce(i.asset_tag, '') AS asset_tag, coalesce(i.asset_type, '') AS asset_type,
       coalesce(i.model, '') AS model, coalesce(i.serial_number, '') AS serial_number,
       if(o.inventory_id IS NULL, 'Available', 'Checked Out') AS status, coalesce(o.user_name, 'N/A') AS current_user,
       coalesce(date_format(o.checkout_date, 'yyyy-MM-dd'), 'N/A') AS checkout_date,
       coalesce(date_format(o.expected_return_date, 'yyyy-MM-dd'), 'N/A') AS expected_return_date,
       coalesce(o.checkout_notes, '') AS notes
FROM {inventory} i LEFT JOIN (SELECT * FROM {loans} WHERE checkin_date IS NULL) o ON o.inventory_id = i.inventory_id
WHERE i.is_loaner""",
    "active_loans": """
SELECT o.loan_id, e.asset_tag, e.asset_type, e.model, e.serial_number, e.site_name AS home_site, e.room_number AS home_room,
       e.room_name AS home_room_name, l.site_name AS current_site, l.room_number AS current_room,
       l.room_name AS current_room_name, o.loaned_to, o.checkout_date, o.expected_return_date, o.checkout_notes,
       o.checked_out_by, CAST(coalesce(o.expected_return_date < {as_of}, false) AS INT) AS is_overdue
FROM {equipment_loans} o JOIN {equipment} e ON e.asset_tag = o.asset_tag
LEFT JOIN {locations} l ON l.location_id = o.temporary_location_id WHERE o.actual_return_date IS NULL""",
}


def register_views(
    spark: SparkSession,
    as_of: datetime | None = None,
    inventory: str = "inventory",
    loans: str = "loaner_checkouts",
    equipment: str = "equipment",
    equipment_loans: str = "equipment_loans",
    locations: str = "locations",
) -> None:
    """Temp views over tables or views of these names. ``as_of`` stands in for the time of the query."""
    now = f"TIMESTAMP_NTZ '{as_of}'" if as_of else "localtimestamp()"
    names = {"inventory": inventory, "loans": loans, "equipment": equipment, "equipment_loans": equipment_loans, "locations": locations}
    for name, text in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {text.format(**names, as_of=now)}")
