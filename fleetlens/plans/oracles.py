"""The registered queries once more, as plain SQL over the same input tables."""

from __future__ import annotations

from fleetlens.plans.derived import AS_OF_SQL, NEEDS, derived_sql

ORACLES: dict[str, str] = {}


# Room categories, written out here so that the operator's own rules are checked.
_NINE = """CASE WHEN {0} {1} '%Cubicle%' THEN 'Workspace' WHEN {0} {1} '%Office%' THEN 'Workspace'
  WHEN {0} {1} '%Conference%' THEN 'Meeting Space' WHEN {0} {1} '%Storage%' THEN 'Storage'
  WHEN {0} {1} '%Server%' THEN 'IT Infrastructure' WHEN {0} {1} '%IT%' THEN 'IT Infrastructure'
  WHEN {0} {1} '%Restroom%' OR {0} {1} '%Toilet%' THEN 'Facilities'
  WHEN {0} {1} '%Kitchen%' OR {0} {1} '%Break%' THEN 'Common Area'
  WHEN {0} {1} '%Corridor%' OR {0} {1} '%Hallway%' THEN 'Circulation' ELSE 'Other' END"""
_FOUR = """CASE WHEN {0} {1} '%Cubicle%' THEN 'Cubicle' WHEN {0} {1} '%Office%' THEN 'Office'
  WHEN {0} {1} '%Storage%' THEN 'Storage' WHEN {0} {1} '%Server%' THEN 'Server Room' ELSE 'Other' END"""


def _category(column: str, rules: str, like: str = "ILIKE") -> str:
    return rules.format(column, like)


_SITE, _ROOM = "coalesce(site_name, 'Unknown')", "coalesce(room_number, 'Unknown')"
_LAPTOP = """CASE WHEN asset_type ILIKE '%laptop%'
    THEN regexp_replace(replace(replace(asset_type, '"', ''), ' ', ''), 'laptop', ' Laptop', 'gi') ELSE asset_type END"""
_LAPTOP_TRIMMED = f"CASE WHEN asset_type ILIKE '%laptop%' THEN trim({_LAPTOP}) ELSE asset_type END"
_FLAG = "(coalesce(lower(asset_type) = 'loaner laptop', false) OR coalesce(notes ILIKE '%loaner%', false))"


def _locations(rules, keep: str = "true", like: str = "ILIKE") -> str:
    return f"""
SELECT row_number() OVER (ORDER BY s, r) AS location_id, s AS site_name, r AS room_number,
       coalesce(n, 'Unknown') AS room_name, {_category("n", rules, like)} AS room_type
FROM (SELECT {_SITE} AS s, {_ROOM} AS r, min(room_name) AS n FROM inventory WHERE {keep} GROUP BY 1, 2) rooms"""


_STEPS = {
    "locations": (["inventory"], _locations(_NINE)),
    "spelled": (
        ["locations"],
        """
SELECT location_id, if(location_id % 2 = 0, lower(site_name), site_name) AS site_name,
       if(location_id % 2 = 0, lower(room_number), room_number) AS room_number,
       if(location_id % 2 = 0, lower(room_name), room_name) AS room_name,
       if(location_id % 2 = 0, lower(room_type), room_type) AS room_type FROM locations""",
    ),
    "early_rooms": (["inventory"], _locations(_NINE, "is_loaner")),
    "located": (
        ["inventory", "locations"],
        f"""
SELECT i.* REPLACE (l.location_id AS location_id) FROM inventory i
LEFT JOIN locations l ON coalesce(i.site_name, 'Unknown') = l.site_name
  AND coalesce(i.room_number, 'Unknown') = l.room_number""",
    ),
    "repeated": (
        ["inventory"],
        "SELECT asset_tag FROM inventory WHERE asset_tag <> '' GROUP BY asset_tag HAVING count(*) > 1",
    ),
    "equipment": (
        ["located", "repeated"],
        f"""
SELECT asset_tag, site_name, room_number, room_name, location_id, {_LAPTOP_TRIMMED} AS asset_type, model,
       serial_number, assigned_to, TRY_CAST(nullif(date_assigned, '') AS TIMESTAMP) AS date_assigned,
       TRY_CAST(nullif(date_decommissioned, '') AS TIMESTAMP) AS date_decommissioned, {_FLAG} AS is_loaner, notes,
       {AS_OF_SQL} AS last_updated, 'Migration Script' AS last_updated_by
FROM located WHERE asset_tag <> '' AND asset_type IS NOT NULL AND asset_tag NOT IN (SELECT asset_tag FROM repeated)""",
    ),
    "open_loans": (["loans"], "SELECT * FROM loans WHERE checkin_date IS NULL"),
    "available": (
        ["located", "open_loans"],
        "SELECT * FROM located WHERE is_loaner AND inventory_id NOT IN (SELECT inventory_id FROM open_loans)",
    ),
    "checked_out": (
        ["located", "open_loans"],
        """
SELECT i.inventory_id, site_name, room_number, room_name, asset_tag, asset_type, model, serial_number,
       i.notes AS inventory_notes, assigned_to, date_assigned, date_decommissioned, location_id, is_loaner, checkout_id, user_name,
       checkout_date, expected_return_date, checkout_notes
FROM located i JOIN open_loans o ON o.inventory_id = i.inventory_id WHERE is_loaner""",
    ),
    # Loan commands, all naming devices. A device is out after a CHECKOUT and in after a CHECKIN.
    "device_state": (
        ["inventory", "open_loans"],
        """
SELECT inventory_id, asset_tag, is_loaner, inventory_id IN (SELECT inventory_id FROM open_loans) AS is_out
FROM inventory""",
    ),
    "judged": (
        ["loan_commands", "device_state"],
        """
SELECT c.*, asset_tag, is_out,
       CASE WHEN kind = 'CHECKOUT' AND coalesce(user_name, '') = '' THEN 'Missing required fields'
            WHEN kind = 'CHECKOUT' AND NOT coalesce(is_loaner, false) THEN 'Item is not available for checkout'
            WHEN asset_tag IS NULL AND is_out IS NULL THEN 'Invalid checkout or already checked in' END AS early
FROM loan_commands c LEFT JOIN device_state d ON d.inventory_id = c.inventory_id""",
    ),
    "decided": (
        ["judged"],
        """
SELECT *, kind <> coalesce(lag(kind) OVER line, CASE WHEN is_out THEN 'CHECKOUT' ELSE 'CHECKIN' END) AS ok
FROM judged WHERE early IS NULL
WINDOW line AS (PARTITION BY inventory_id ORDER BY command_ts, command_id)""",
    ),
    "spans": (
        ["decided"],
        """
SELECT *, lead(command_ts) OVER (PARTITION BY inventory_id ORDER BY command_ts, command_id) AS until
FROM decided WHERE ok""",
    ),
    "fresh": (
        ["spans", "loans"],
        """
SELECT (SELECT max(checkout_id) FROM loans) + row_number() OVER (ORDER BY command_ts, command_id) AS checkout_id,
       inventory_id, user_name, command_ts AS checkout_date, expected_return_date, until AS checkin_date,
       notes AS checkout_notes, asset_tag
FROM spans WHERE kind = 'CHECKOUT'""",
    ),
    "returned": (
        ["open_loans", "judged"],
        """
SELECT o.* REPLACE (r.at AS checkin_date), r.asset_tag FROM open_loans o
LEFT JOIN (SELECT inventory_id, asset_tag, min(command_ts) AS at FROM judged
           WHERE early IS NULL AND kind = 'CHECKIN' GROUP BY ALL) r ON r.inventory_id = o.inventory_id""",
    ),
    "new_loans": (
        ["loans", "returned", "fresh"],
        """
SELECT * FROM loans WHERE checkin_date IS NOT NULL
UNION ALL SELECT * EXCLUDE (asset_tag) FROM returned
UNION ALL SELECT * EXCLUDE (asset_tag) FROM fresh""",
    ),
    "first_returns": (
        ["loan_returns", "open_loans", "inventory"],
        """
SELECT checkout_id, min(command_ts) AS at, arg_min(command_id, command_ts) AS command_id
FROM loan_returns JOIN open_loans o USING (checkout_id) JOIN inventory i ON i.inventory_id = o.inventory_id
WHERE checkout_id <> 0 GROUP BY checkout_id""",  # id 0 counts as missing
    ),
    "moved": (
        ["location_moves", "rooms"],
        """
SELECT m.*, coalesce(last_value(m.site_name IGNORE NULLS) OVER before, l.site_name) AS prev_site,
       coalesce(last_value(m.room_number IGNORE NULLS) OVER before, l.room_number) AS prev_room
FROM location_moves m JOIN rooms l USING (location_id)
WINDOW before AS (PARTITION BY location_id ORDER BY command_ts, command_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
    # Loans named by their commands, one command of each device after the other. State: NULL in, -1 out by stored
    # loans, else the command of the loan.
    "handle_line": (
        ["loan_handles", "inventory"],
        """
SELECT c.*, coalesce(c.inventory_id, m.inventory_id) AS device, i.inventory_id IS NOT NULL AS known,
       row_number() OVER (PARTITION BY coalesce(c.inventory_id, m.inventory_id) ORDER BY c.command_ts, c.command_id) AS n
FROM loan_handles c LEFT JOIN (SELECT command_id, inventory_id FROM loan_handles WHERE kind = 'CHECKOUT') m ON c.checkout_id = m.command_id
LEFT JOIN inventory i ON i.inventory_id = coalesce(c.inventory_id, m.inventory_id)""",
    ),
    "handle_steps": (
        ["handle_line", "open_loans"],
        """
SELECT * FROM (
WITH RECURSIVE walk AS (
  SELECT device, CAST(0 AS BIGINT) AS n, CASE WHEN device IN (SELECT inventory_id FROM open_loans) THEN -1 END AS state,
         CAST(NULL AS BIGINT) AS command_id, false AS ok
  FROM (SELECT DISTINCT device FROM handle_line WHERE known) devices
  UNION ALL
  SELECT l.device, l.n,
         CASE WHEN l.kind = 'CHECKOUT' THEN coalesce(w.state, l.command_id)
              WHEN l.checkout_id IS NULL OR l.checkout_id = w.state THEN NULL ELSE w.state END,
         l.command_id,
         CASE WHEN l.kind = 'CHECKOUT' THEN w.state IS NULL WHEN l.checkout_id IS NULL THEN w.state IS NOT NULL
              ELSE coalesce(l.checkout_id = w.state, false) END
  FROM walk w JOIN handle_line l ON l.device = w.device AND l.n = w.n + 1)
SELECT * FROM walk WHERE n > 0) steps""",
    ),
    "handle_ok": (
        ["handle_steps", "handle_line"],
        """
SELECT l.*, lead(l.command_ts) OVER (PARTITION BY l.device ORDER BY l.n) AS until,
       row_number() OVER (PARTITION BY l.device, l.kind ORDER BY l.n) AS turn
FROM handle_line l JOIN (SELECT command_id FROM handle_steps WHERE ok) s USING (command_id)""",
    ),
    # Toggle commands
    "tag_flags": (
        ["inventory"],
        """
SELECT asset_tag, count(*) AS devices, bool_or(is_loaner) AS flag FROM inventory
WHERE asset_tag <> '' GROUP BY asset_tag""",
    ),
    "flips": (
        ["toggle_commands", "tag_flags"],
        """
SELECT c.*, flag, row_number() OVER (PARTITION BY asset_tag ORDER BY command_ts, command_id) AS n
FROM toggle_commands c JOIN tag_flags f USING (asset_tag) WHERE devices = 1""",
    ),
    "rooms": (
        ["locations", "vacant"],
        """
SELECT * FROM locations UNION ALL
SELECT (SELECT max(location_id) FROM locations) + row_number() OVER (ORDER BY room_number) AS location_id, * FROM vacant""",
    ),
    # Rooms named by their commands, one command of each group after the other; the state lists the rooms of the group.
    "room_line": (
        ["location_handles"],
        """
SELECT *, (command_id - 10000000) // 12 AS g,
       row_number() OVER (PARTITION BY (command_id - 10000000) // 12 ORDER BY command_ts, command_id) AS n
FROM location_handles""",
    ),
    "room_steps": (
        ["room_line", "rooms", "located"],
        """
SELECT * FROM (
WITH RECURSIVE walk AS (
  SELECT g, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS command_id, CAST(NULL AS VARCHAR) AS reason,
         list({'id': r.location_id, 'site': r.site_name, 'room': r.room_number, 'name': r.room_name, 'type': r.room_type})
           FILTER (r.location_id IS NOT NULL) AS state,
         CAST(NULL AS STRUCT(id BIGINT, site VARCHAR, room VARCHAR, "name" VARCHAR, "type" VARCHAR)) AS cur
  FROM (SELECT DISTINCT g FROM room_line) LEFT JOIN supplier ON s_suppkey = g
  LEFT JOIN rooms r ON (r.location_id IN (2 * g + 1, 2 * g + 2) AND g < 50) OR (r.site_name = 'Vacant ' || s_nationkey AND r.room_number = 'V' || s_suppkey)
  GROUP BY g
  UNION ALL
  SELECT g, n, command_id, reason,
         CASE WHEN reason IS NOT NULL THEN state
              WHEN kind = 'DELETE' THEN list_filter(state, lambda r: r.id <> location_id)
              ELSE list_append(list_filter(coalesce(state, []), lambda r: r.id <> id), {'id': id, 'site': to_site, 'room': to_room,
                   'name': coalesce(room_name, cur.name), 'type': coalesce(room_type, cur.type)}) END,
         cur
  FROM (
    SELECT *, CASE WHEN kind = 'CREATE' THEN CASE WHEN taken THEN 'Location already exists' END
                   WHEN cur IS NULL THEN 'Location not found'
                   WHEN kind = 'DELETE' THEN CASE WHEN location_id IN (SELECT i.location_id FROM located i WHERE i.location_id IS NOT NULL)
                     THEN 'Cannot delete location that has inventory items assigned to it' END
                   WHEN coalesce(site_name, room_number, room_name, room_type) IS NULL THEN 'No fields to update'
                   WHEN taken THEN 'Location already exists' END AS reason
    FROM (
      SELECT *, len(list_filter(coalesce(state, []), lambda r: r.site = to_site AND r.room = to_room AND r.id <> id)) > 0 AS taken
      FROM (
        SELECT *, coalesce(site_name, cur.site) AS to_site, coalesce(room_number, cur.room) AS to_room
        FROM (
          SELECT l.*, w.state, CASE WHEN l.kind = 'CREATE' THEN l.command_id ELSE l.location_id END AS id,
                 list_filter(coalesce(w.state, []), lambda r: r.id = l.location_id)[1] AS cur
          FROM walk w JOIN room_line l ON l.g = w.g AND l.n = w.n + 1)))))
SELECT * FROM walk) steps""",
    ),
    "room_ends": (
        ["room_steps"],
        """
SELECT unnest(state) AS r FROM (SELECT g, arg_max(state, n) AS state FROM room_steps GROUP BY g) ends""",
    ),
    # Location commands: new rooms only compete with each other, updates keep site and room.
    "removable": (
        ["rooms", "located"],
        """
SELECT location_id FROM rooms
WHERE location_id NOT IN (SELECT location_id FROM located WHERE location_id IS NOT NULL)""",
    ),
    "removals": (
        ["location_commands", "removable"],
        """
SELECT location_id, min(command_ts) AS gone_at FROM location_commands SEMI JOIN removable USING (location_id)
WHERE kind = 'DELETE' GROUP BY location_id""",
    ),
    "loc_judged": (
        ["location_commands", "rooms", "removable", "removals"],
        """
SELECT c.*, l.location_id IS NOT NULL AS found, l.site_name AS old_site, l.room_number AS old_room,
       l.room_name AS old_name, l.room_type AS old_type,
       CASE WHEN c.kind = 'CREATE' AND c.room_name IS NULL THEN 'Missing required field: room_name'
            WHEN c.kind = 'CREATE' AND row_number() OVER (PARTITION BY c.kind, c.site_name, c.room_number, c.room_name IS NULL
                                                         ORDER BY c.command_ts, c.command_id) > 1
              THEN 'Location already exists'
            WHEN c.kind = 'CREATE' THEN NULL
            WHEN l.location_id IS NULL OR c.command_ts > gone_at THEN 'Location not found'
            WHEN c.kind = 'UPDATE' AND c.room_name IS NULL AND c.room_type IS NULL THEN 'No fields to update'
            WHEN c.kind = 'DELETE' AND gone_at IS NULL
              THEN 'Cannot delete location that has inventory items assigned to it' END AS reason
FROM location_commands c LEFT JOIN rooms l USING (location_id) LEFT JOIN removals r USING (location_id)""",
    ),
    "loc_final": (
        ["rooms", "loc_judged"],
        """
SELECT l.* REPLACE (coalesce(n, l.room_name) AS room_name, coalesce(t, l.room_type) AS room_type)
FROM rooms l LEFT JOIN (
  SELECT location_id, arg_max(room_name, command_ts) FILTER (room_name IS NOT NULL) AS n,
         arg_max(room_type, command_ts) FILTER (room_type IS NOT NULL) AS t
  FROM loc_judged WHERE kind = 'UPDATE' AND reason IS NULL GROUP BY location_id) u USING (location_id)""",
    ),
    "loc_created": (
        ["rooms", "loc_judged"],
        """
SELECT (SELECT max(location_id) FROM rooms) + row_number() OVER (ORDER BY command_ts, command_id) AS location_id,
       site_name, room_number, room_name, room_type, changed_by, command_ts
FROM loc_judged WHERE kind = 'CREATE' AND reason IS NULL""",
    ),
    "loc_steps": (
        ["loc_judged"],
        """
SELECT *, coalesce(last_value(room_name IGNORE NULLS) OVER before, old_name) AS prev_name,
       coalesce(last_value(room_type IGNORE NULLS) OVER before, old_type) AS prev_type
FROM loc_judged WHERE kind = 'UPDATE' AND reason IS NULL
WINDOW before AS (PARTITION BY location_id ORDER BY command_ts, command_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    ),
}


def _with(final: str, *roots: str) -> str:
    """Put the needed derived tables in front of ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _STEPS[name][0] if name in _STEPS else []:
            visit(need)
        order.append(name)

    for root in roots:
        visit(root)
    parts = [f"{n} AS ({(derived_sql(n) if n in NEEDS else _STEPS[n][1]).strip()})" for n in order]
    return f"WITH {', '.join(parts)} {final.strip()}"


def _add(name: str, final: str, *roots: str) -> None:
    ORACLES[name] = _with(final, *roots) if roots else final.strip()


# --- sources and sinks ---------------------------------------------------------------------------
_add("load_table", "SELECT * FROM orders")
_add("append_rows", "SELECT * FROM inventory", "inventory")
_add("backup_snapshot", "SELECT * FROM inventory", "inventory")
_add("replace_table", "SELECT * FROM inventory WHERE is_loaner", "inventory")
_add(
    "append_audit",
    f"""
SELECT * EXCLUDE (stamp) REPLACE (row_number() OVER (ORDER BY action_type = 'UPDATE', stamp, audit_id) AS audit_id, stamp AS changed_at)
FROM (SELECT *, CASE WHEN action_type = 'UPDATE' AND audit_id % 2 <> 0 THEN {AS_OF_SQL} ELSE changed_at END AS stamp FROM audit_log) stamped""",
    "audit_log",
)
_add("insert_select_distinct", "SELECT DISTINCT site_name, room_number, room_name FROM inventory", "inventory")
_MALFORMED = "(inventory_id % 3 = 2 AND (inventory_id % 41 = 7 OR inventory_id % 43 = 8))"
_LINE = "concat_ws(',', {})".format(
    ", ".join(f"coalesce({c}, '')" for c in "manufacturer model_number hardware_type serial_number assigned_to location date_assigned date_decommissioned".split())
)
_add(
    "import_accepted",
    f"""
SELECT manufacturer, model_number, nullif(hardware_type, '') AS hardware_type, serial_number, assigned_to, location AS room_name,
       nullif(date_assigned, '') AS date_assigned, nullif(date_decommissioned, '') AS date_decommissioned
FROM sheet WHERE date_assigned <> 'n/a' AND NOT {_MALFORMED}""",
    "sheet",
)
_add(
    "import_rejected",
    f"""
SELECT if({_MALFORMED}, NULL, serial_number) AS serial_number,
       CASE WHEN inventory_id % 3 = 2 AND inventory_id % 43 = 8
              THEN 'wrong number of cells: ' || array_to_string(string_split({_LINE}, ',')[1:3], ',')
            WHEN {_MALFORMED} THEN 'wrong number of cells: ' || {_LINE} || ',more'
            ELSE 'unreadable date_assigned: n/a' END AS reason
FROM sheet WHERE date_assigned = 'n/a' OR {_MALFORMED}""",
    "sheet",
)
_add(
    "import_summary",
    f"""
SELECT count(*) FILTER (date_assigned <> 'n/a' AND NOT {_MALFORMED}) AS success_count,
       count(*) FILTER (date_assigned = 'n/a' OR {_MALFORMED}) AS error_count FROM sheet""",
    "sheet",
)
_add("peek", "SELECT 5 AS drawn_rows, 0 AS foreign_rows")
_add("sample_random", "SELECT 5 AS drawn_rows, 0 AS foreign_rows")
_add("required_columns", "SELECT 'hardware_type, serial_number' AS missing_columns, count(*) AS rows FROM sheet", "sheet")

# --- projections, filters and cell functions -----------------------------------------------------
_add(
    "projection_with_label",
    "SELECT 'Device notes' AS check_type, inventory_id, notes AS inventory_notes FROM inventory",
    "inventory",
)
_add(
    "any_location_field",
    "SELECT * FROM inventory WHERE coalesce(site_name, room_number, room_name) IS NOT NULL",
    "inventory",
)
_add("equals_given", "SELECT * FROM locations WHERE room_type = 'Workspace'", "locations")
_add(
    "key_lookup",
    "SELECT * FROM inventory WHERE inventory_id IN (SELECT inventory_id FROM open_loans)",
    "inventory",
    "open_loans",
)
_add("loaner_flag_rows", "SELECT * FROM inventory WHERE is_loaner", "inventory")
_add(
    "loaner_candidates",
    """
SELECT asset_type, asset_tag, site_name, room_number, room_name, assigned_to, notes FROM inventory
WHERE regexp_matches(asset_type, 'laptop|loaner', 'i') OR regexp_matches(notes, 'loaner|temp', 'i')""",
    "inventory",
)
_add(
    "inventory_search",
    """
SELECT * FROM sheet WHERE contains(lower(concat_ws(chr(9), coalesce(manufacturer, ''), coalesce(model_number, ''),
  coalesce(hardware_type, ''), coalesce(serial_number, ''), coalesce(assigned_to, ''), coalesce(location, ''),
  coalesce(date_assigned, ''), coalesce(date_decommissioned, ''))), 'office')""",
    "sheet",
)
_add(
    "inventory_filter",
    """
SELECT * FROM sheet WHERE manufacturer ILIKE '%build%' AND hardware_type ILIKE '%laptop%'
  AND TRY_CAST(date_assigned AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'""",
    "sheet",
)
_add(
    "loan_filter",
    """
SELECT * FROM loans WHERE user_name ILIKE '%user1%'
  AND CAST(checkout_date AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
  AND CAST(expected_return_date AS DATE) <= DATE '2024-01-25'""",
    "loans",
)
_add(
    "cell_functions",
    f"""
SELECT inventory_id, {_LAPTOP_TRIMMED} AS laptop_name, {_LAPTOP} AS laptop_name_exact,
       TRY_CAST(nullif(date_assigned, '') AS TIMESTAMP) AS assigned_at,
       strftime(TRY_CAST(date_assigned AS DATE), '%Y-%m-%d') AS assigned_day, {_FLAG} AS loaner,
       coalesce(site_name, '') || coalesce(room_number, '') AS room_key,
       {_SITE} || ' - ' || {_ROOM} AS label, 'LOC_' || inventory_id AS ref,
       CASE WHEN is_loaner THEN 'True' ELSE 'False' END AS flag_text, NOT is_loaner AS not_loaner,
       coalesce(notes, 'N/A') AS shown_notes
FROM inventory""",
    "inventory",
)
_add(
    "tidy_columns",
    """
SELECT * EXCLUDE (location), location AS room_name, false AS is_loaner, CAST(NULL AS BIGINT) AS location_id
FROM sheet""",
    "sheet",
)

# --- locations -----------------------------------------------------------------------------------
_add("build_locations", "SELECT * FROM locations", "locations")
_add(
    "build_locations_four_rules",
    _locations(_FOUR, "coalesce(site_name, room_number, room_name) IS NOT NULL"),
    "inventory",
)
_add("build_locations_case_sensitive", _locations(_NINE, "room_number IS NOT NULL", "LIKE"), "inventory")
_add(
    "category_preview",
    f"""
SELECT DISTINCT site_name, room_number, room_name, {_category("room_name", _NINE)} AS proposed_category
FROM inventory WHERE room_number IS NOT NULL""",
    "inventory",
)
_add("assign_location", "SELECT inventory_id, asset_tag, location_id FROM located", "located")
_add(
    "location_conflicts",
    f"""
SELECT {_SITE} AS site_name, {_ROOM} AS room_number, count(DISTINCT coalesce(room_name, 'Unknown')) AS n_names
FROM inventory GROUP BY 1, 2 HAVING count(DISTINCT coalesce(room_name, 'Unknown')) > 1""",
    "inventory",
)
_add(
    "location_exists",
    """
SELECT DISTINCT i.site_name, i.room_number, l.location_id IS NOT NULL AS "exists", l.location_id
FROM inventory i LEFT JOIN locations l ON l.site_name = i.site_name AND l.room_number = i.room_number""",
    "inventory",
    "locations",
)
_add("deletable_locations", "SELECT * FROM rooms SEMI JOIN removable USING (location_id)", "rooms", "removable")
_add(
    "location_list",
    "SELECT *, row_number() OVER (ORDER BY site_name, room_number, location_id) AS position FROM locations",
    "locations",
)
_add(
    "room_types",
    "SELECT *, row_number() OVER (ORDER BY room_type) AS position FROM (SELECT DISTINCT room_type FROM locations) kinds",
    "locations",
)
_add(
    "locations_by_site_type_left",
    """
SELECT l.site_name, l.room_type, count(*) AS equipment_count
FROM rooms l LEFT JOIN located i ON i.location_id = l.location_id GROUP BY 1, 2""",
    "rooms",
    "located",
)
_add(
    "locations_by_site_type_inner",
    """
SELECT l.site_name, l.room_type, count(*) AS equipment_count
FROM locations l JOIN located i ON i.location_id = l.location_id GROUP BY 1, 2""",
    "locations",
    "located",
)
_add(
    "locations_by_type",
    """
SELECT room_type, count(*) AS location_count, count(DISTINCT site_name || room_number) AS unique_locations
FROM locations GROUP BY room_type""",
    "locations",
)
_add(
    "equipment_by_type",
    """
SELECT room_type, count(*) AS equipment_count, count(*) FILTER (is_loaner) AS loaner_count
FROM equipment JOIN locations USING (location_id) GROUP BY room_type""",
    "equipment",
    "locations",
)
_add(
    "inventory_with_location",
    "SELECT i.* EXCLUDE (site_name, room_number, room_name), l.* EXCLUDE (location_id) FROM located i JOIN locations l USING (location_id)",
    "located",
    "locations",
)
_add(
    "location_review",
    """
SELECT inventory_id, i.site_name, i.room_number, i.room_name, location_id, room_type
FROM located i JOIN locations l USING (location_id) ORDER BY l.site_name, l.room_number, inventory_id LIMIT 100""",
    "located",
    "locations",
)
_add(
    "reconcile_locations",
    f"""
SELECT 'Location Migration Check' AS check_type,
       (SELECT count(DISTINCT {_SITE} || '-' || {_ROOM}) FROM inventory) AS original_location_count,
       (SELECT count(*) FROM locations) AS new_location_count""",
    "inventory",
    "locations",
)
_add(
    "backfill_location",
    """
SELECT e.asset_tag, min(i.location_id) AS location_id FROM equipment e JOIN located i ON i.asset_tag = e.asset_tag
GROUP BY e.asset_tag""",
    "equipment",
    "located",
)

# --- equipment and the whole migration -----------------------------------------------------------
_add("equipment_build", "SELECT * FROM equipment", "equipment")
_add(
    "equipment_rejects",
    """
SELECT inventory_id, asset_tag, CASE WHEN asset_tag IN (SELECT asset_tag FROM repeated) THEN 'asset_tag is not unique'
       ELSE 'asset_type is missing' END AS reason
FROM inventory WHERE asset_tag <> '' AND (asset_type IS NULL OR asset_tag IN (SELECT asset_tag FROM repeated))""",
    "inventory",
    "repeated",
)
_add(
    "equipment_location_check",
    """
SELECT 'Equipment Location Check' AS check_type, count(*) AS total_records, count(*) - count(location_id) AS missing_location
FROM equipment""",
    "equipment",
)
_COUNTS = """
SELECT (SELECT count(*) FROM equipment) AS equipment_count, (SELECT count(*) FROM locations) AS locations_count,
       (SELECT count(*) FROM equipment WHERE is_loaner) AS loaner_count"""
_add("migration_counts", _COUNTS, "equipment", "locations")

# --- pages, sorts and samples --------------------------------------------------------------------
_PAGE = """
SELECT inventory_id, l.site_name, l.room_number, l.room_name, room_type, asset_tag, asset_type, model, serial_number, notes,
       assigned_to, date_assigned, date_decommissioned, is_loaner
FROM {inv} i {join} JOIN locations l ON l.location_id = i.location_id {where}
ORDER BY l.site_name NULLS FIRST, l.room_number NULLS FIRST, asset_tag NULLS FIRST, inventory_id LIMIT 25 OFFSET {offset}"""
_add("inventory_page", _PAGE.format(inv="located", join="", where="", offset=50), "located", "locations")
_add(
    "inventory_page_of_type",
    _PAGE.format(inv="located", join="", where="WHERE room_type = 'Workspace'", offset=25),
    "located",
    "locations",
)
_add("inventory_page_unlocated", _PAGE.format(inv="inventory", join="LEFT", where="", offset=0), "inventory", "locations")
_add(
    "inventory_page_numbers",
    """
SELECT count(*) AS total_items, 2 AS page, 25 AS per_page, (count(*) + 24) // 25 AS total_pages
FROM located JOIN locations USING (location_id) WHERE room_type = 'Workspace'""",
    "located",
    "locations",
)
_add(
    "keyset_page",
    "SELECT * FROM sheet WHERE serial_number > 'SN1' ORDER BY serial_number, inventory_id LIMIT 35",
    "sheet",
)
_add(
    "keyset_page_with_tie",
    """
SELECT * FROM sheet WHERE (serial_number, inventory_id) > ('SN1000', 1001)
ORDER BY serial_number, inventory_id LIMIT 35""",
    "sheet",
)
_BOUNDARY = "(SELECT coalesce(max(s), '') FROM (SELECT serial_number AS s FROM sheet ORDER BY s NULLS FIRST LIMIT 105) f)"
_add(
    "keyset_page_numbered",
    f"SELECT * FROM sheet WHERE serial_number > {_BOUNDARY} ORDER BY serial_number, inventory_id LIMIT 35",
    "sheet",
)
_add("page_boundary", f"SELECT {_BOUNDARY} AS boundary", "sheet")
_add("total_items", "SELECT count(location_id) AS total_items FROM located", "located")
_add(
    "sort_by_text",
    "SELECT *, row_number() OVER (ORDER BY coalesce(assigned_to, '') DESC, inventory_id) AS position FROM sheet",
    "sheet",
)
_add(
    "sort_by_date",
    """
SELECT *, row_number() OVER (ORDER BY coalesce(TRY_CAST(date_assigned AS DATE), DATE '1970-01-01'), inventory_id) AS position
FROM sheet""",
    "sheet",
)
_add(
    "newest_assigned",
    """
SELECT * FROM sheet
ORDER BY coalesce(TRY_CAST(date_assigned AS DATE), DATE '1970-01-01') DESC, inventory_id LIMIT 50""",
    "sheet",
)
_add("sample_deterministic", "SELECT * FROM inventory ORDER BY md5('7:' || inventory_id) LIMIT 5", "inventory")
_SAMPLE = """
SELECT asset_tag, e.site_name, e.room_number, e.room_name, room_type, asset_type, assigned_to, is_loaner, notes
FROM equipment e {join} JOIN locations USING (location_id) ORDER BY md5('{seed}:' || asset_tag) LIMIT 5"""
_add("migrated_sample", _SAMPLE.format(join="", seed=7), "equipment", "locations")
_add("migrated_sample_left", _SAMPLE.format(join="LEFT", seed=11), "equipment", "locations")

# --- loans ---------------------------------------------------------------------------------------
_add("available_loaners", "SELECT * FROM available", "available")
_add("available_in_service", "SELECT * FROM available WHERE coalesce(date_decommissioned, '') = ''", "available")
_add("checked_out_loaners", "SELECT * FROM checked_out", "checked_out")
_add("checked_out_view", "SELECT * FROM checked_out", "checked_out")
_LATE = f"CASE WHEN expected_return_date < {AS_OF_SQL} THEN 1 ELSE 0 END AS is_overdue"
_add(
    "active_loans",
    f"""
SELECT loan_id, asset_tag, asset_type, model, serial_number, e.site_name AS home_site, e.room_number AS home_room,
       e.room_name AS home_room_name, l.site_name AS current_site, l.room_number AS current_room,
       l.room_name AS current_room_name, loaned_to, checkout_date, expected_return_date, checkout_notes, checked_out_by, {_LATE}
FROM equipment_loans JOIN equipment e USING (asset_tag) LEFT JOIN locations l ON l.location_id = temporary_location_id
WHERE actual_return_date IS NULL""",
    "equipment_loans",
    "equipment",
    "locations",
)
_add(
    "active_loans_inventory",
    f"""
SELECT loan_id, asset_tag, asset_type, model, serial_number, loaned_to, checkout_date, expected_return_date,
       checkout_notes, checked_out_by, {_LATE}
FROM equipment_loans JOIN inventory USING (asset_tag) WHERE actual_return_date IS NULL""",
    "equipment_loans",
    "inventory",
)
_add(
    "loan_status",
    """
SELECT inventory_id, coalesce(asset_tag, '') AS asset_tag, coalesce(asset_type, '') AS asset_type,
       coalesce(model, '') AS model, coalesce(serial_number, '') AS serial_number, 'Available' AS status,
       'N/A' AS current_user, 'N/A' AS checkout_date, 'N/A' AS expected_return_date, '' AS notes FROM available
UNION ALL
SELECT inventory_id, coalesce(asset_tag, ''), coalesce(asset_type, ''), coalesce(model, ''),
       coalesce(serial_number, ''), 'Checked Out', coalesce(user_name, 'N/A'),
       coalesce(strftime(checkout_date, '%Y-%m-%d'), 'N/A'), coalesce(strftime(expected_return_date, '%Y-%m-%d'), 'N/A'),
       coalesce(checkout_notes, '') FROM checked_out""",
    "available",
    "checked_out",
)
_add(
    "open_checkout_device",
    """
SELECT checkout_id, inventory_id, user_name, asset_tag FROM open_loans JOIN inventory USING (inventory_id)
WHERE user_name LIKE 'user1%'""",
    "open_loans",
    "inventory",
)

_add(
    "views_by_sql",
    """
SELECT asset_type, count(*) FILTER (status = 'free') AS free, count(*) FILTER (status = 'out') AS out,
       count(*) FILTER (status = 'late') AS late
FROM (SELECT asset_type, 'free' AS status FROM available UNION ALL SELECT asset_type, 'out' FROM checked_out
      UNION ALL SELECT asset_type, 'late' FROM equipment_loans JOIN equipment USING (asset_tag)
      WHERE actual_return_date IS NULL AND expected_return_date < """
    + AS_OF_SQL
    + """) rows GROUP BY asset_type""",
    "available",
    "checked_out",
    "equipment_loans",
    "equipment",
)

# --- reports and quality -------------------------------------------------------------------------
_PROFILE = """
SELECT count(*) AS total_records, count(DISTINCT asset_tag) AS unique_assets, count(DISTINCT site_name) AS unique_sites,
       count(DISTINCT room_number) AS unique_rooms,
       count(DISTINCT coalesce(site_name, '') || coalesce(room_number, '')) AS unique_locations,
       count(*) FILTER (coalesce(asset_tag, '') = '') AS null_asset_tags,
       count(*) FILTER (coalesce(site_name, '') = '') AS null_sites,
       count(*) FILTER (coalesce(room_number, '') = '') AS null_rooms FROM inventory"""
_add("inventory_profile", _PROFILE, "inventory")
_add("inventory_profile_tagged", f"{_PROFILE} WHERE asset_tag <> ''", "inventory")
_add(
    "site_summary",
    """
SELECT site_name, count(DISTINCT room_number) AS unique_rooms, count(*) AS total_records,
       count(*) FILTER (coalesce(asset_tag, '') = '') AS records_without_assets FROM inventory GROUP BY site_name""",
    "inventory",
)
_add(
    "room_name_frequency",
    """
SELECT 'Room Type Analysis' AS analysis, room_name, count(*) AS count,
       count(*) FILTER (coalesce(asset_tag, '') = '') AS null_asset_count FROM inventory GROUP BY room_name""",
    "inventory",
)
_add(
    "asset_type_distribution",
    """
SELECT asset_type, total_records, unique_assets, null_asset_count,
       rtrim(rtrim(printf('%.2f', round(null_asset_count / total_records * 100, 2)), '0'), '.') || '%' AS null_percentage
FROM (SELECT asset_type, count(*) AS total_records, count(DISTINCT asset_tag) AS unique_assets,
             count(*) FILTER (coalesce(asset_tag, '') = '') AS null_asset_count
      FROM inventory WHERE asset_type <> '' GROUP BY asset_type HAVING count(*) > 5) types""",
    "inventory",
)
_add(
    "null_patterns",
    """
SELECT if(site_name IS NULL, 'NULL', 'NOT NULL') AS site_name_status,
       if(room_number IS NULL, 'NULL', 'NOT NULL') AS room_number_status,
       if(room_name IS NULL, 'NULL', 'NOT NULL') AS room_name_status, count(*) AS record_count
FROM inventory WHERE location_id IS NULL GROUP BY 1, 2, 3""",
    "inventory",
)
_add(
    "location_coverage",
    """
SELECT count(*) AS total_records, count(location_id) AS records_with_location_id,
       count(*) - count(location_id) AS records_missing_location_id FROM located""",
    "located",
)
_add("table_counts", _COUNTS, "equipment", "locations")
_add(
    "tags_per_room",
    """
SELECT site_name, room_number, string_agg(asset_tag, ',' ORDER BY asset_tag, inventory_id) AS asset_tag
FROM inventory WHERE asset_tag <> '' GROUP BY site_name, room_number""",
    "inventory",
)
_add("blank_keys", "SELECT * FROM inventory WHERE coalesce(asset_tag, '') = ''", "inventory")
_add("blank_key_count", "SELECT count(*) AS null_count FROM inventory WHERE coalesce(asset_tag, '') = ''", "inventory")
_DUPES = """
SELECT asset_tag, count(*) AS duplicate_count FROM inventory WHERE {where} GROUP BY asset_tag HAVING count(*) > 1"""
_add("duplicate_keys", _DUPES.format(where="asset_tag <> ''"), "inventory")
_add("duplicate_keys_with_empty", _DUPES.format(where="asset_tag IS NOT NULL"), "inventory")
_add(
    "duplicate_key_count",
    f"SELECT count(*) AS duplicate_keys FROM ({_DUPES.format(where='asset_tag IS NOT NULL')}) d",
    "inventory",
)
_add(
    "duplicate_locations",
    """
SELECT site_name, room_number, count(*) AS duplicate_count FROM inventory WHERE site_name <> '' AND room_number <> ''
GROUP BY 1, 2 HAVING count(*) > 1""",
    "inventory",
)
_add(
    "duplicate_assets",
    f"""
SELECT inventory_id, asset_tag, site_name, room_number, room_name, asset_type, model, serial_number, assigned_to, notes
FROM inventory WHERE asset_tag IN (SELECT asset_tag FROM ({_DUPES.format(where="asset_tag IS NOT NULL")}) d)""",
    "inventory",
)
_add(
    "fk_orphans",
    """
SELECT loan_id, temporary_location_id AS location_id FROM equipment_loans
WHERE temporary_location_id IS NOT NULL AND temporary_location_id NOT IN (SELECT location_id FROM locations)""",
    "equipment_loans",
    "locations",
)
_add(
    "missing_location_review",
    """
SELECT inventory_id, site_name, room_number, room_name,
       if(coalesce(site_name, room_number, room_name) IS NULL, 'All location fields are NULL', 'Has some location data') AS reason
FROM inventory WHERE location_id IS NULL
ORDER BY site_name IS NULL, site_name, room_number NULLS FIRST, inventory_id LIMIT 100""",
    "inventory",
)
_add(
    "open_loan_violations",
    "SELECT inventory_id, count(*) AS open_loans FROM open_loans GROUP BY inventory_id HAVING count(*) > 1",
    "open_loans",
)
_LENGTHS = {
    "asset_tag": 100, "site_name": 100, "room_number": 50, "room_name": 100, "asset_type": 100, "model": 255,
    "serial_number": 100, "assigned_to": 255, "notes": None,
}
_add(
    "conformance",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name,
 {f"count(*) - count({c})" if c in ("asset_tag", "asset_type") else "count(*) FILTER (false)"} AS null_count,
 {f"count(*) FILTER (length({c}) > {n})" if n else "count(*) FILTER (false)"} AS too_long_count FROM inventory"""
        for c, n in _LENGTHS.items()
    ),
    "inventory",
)
# Columns by table: ! marks those that must be set, numbers are the longest texts.
_DECLARED = {
    "inventory": ("located", """inventory_id! site_name:100 room_number:50 room_name:100 asset_tag:100 asset_type:100 model:255
        serial_number:100 notes assigned_to:255 date_assigned date_decommissioned location_id is_loaner!"""),
    "locations": ("locations", "location_id! site_name!:100 room_number!:50 room_name!:100 room_type!:50"),
    "loaner_checkouts": ("loans", """checkout_id! inventory_id! user_name!:100 checkout_date! expected_return_date checkin_date
        checkout_notes:500"""),
    "equipment": ("equipment", """asset_tag!:100 site_name:100 room_number:50 room_name:100 location_id asset_type!:100 model:255
        serial_number:100 assigned_to:255 date_assigned date_decommissioned is_loaner! notes last_updated! last_updated_by:100"""),
    "equipment_loans": ("equipment_loans", """loan_id! asset_tag!:100 loaned_to!:255 checkout_date! expected_return_date!
        actual_return_date original_location_id temporary_location_id checkout_notes return_notes checked_out_by!:255
        checked_in_by:255 created_date! created_by!:100 last_updated! last_updated_by!:100"""),
    "audit_log": ("audit_log", """audit_id! action_type!:10 asset_tag!:100 field_name!:100 old_value new_value changed_by!:255
        changed_at! notes"""),
}


def _declared(label: str, table: str, columns: str) -> list[str]:
    parts = []
    for word in columns.split():
        name, _, length = word.partition(":")
        column = name.rstrip("!")
        nulls = f"count(*) - count({column})" if name.endswith("!") else "0 * count(*)"
        long = f"count(*) FILTER (length({column}) > {length})" if length else "0 * count(*)"
        parts.append(f"SELECT '{label}' AS table_name, '{column}' AS column_name, {nulls} AS null_count, {long} AS too_long_count FROM {table}")
    return parts


_add(
    "conformance_of_tables",
    " UNION ALL ".join(part for label, (table, columns) in _DECLARED.items() for part in _declared(label, table, columns)),
    *[table for table, _ in _DECLARED.values()],
)
_add("view_after_checkout", "SELECT inventory_id FROM available WHERE inventory_id % 2 <> 0", "available")
_ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
_add(
    "column_report",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS data_type, true AS is_nullable,
 count(*) - count({c}) AS null_count, {f"max(length({c}))" if kind == "string" else "NULL"} AS longest_text FROM orders"""
        for c, kind in _ORDERS.items()
    ),
)
_add(
    "quality_gate",
    """
SELECT 'blank asset_tag' AS check_name, count(*) AS failures FROM inventory WHERE coalesce(asset_tag, '') = ''
UNION ALL SELECT 'blank site_name', count(*) FROM inventory WHERE coalesce(site_name, '') = ''
UNION ALL SELECT 'blank asset_type', count(*) FROM inventory WHERE coalesce(asset_type, '') = ''
UNION ALL SELECT 'repeated asset_tag', count(*) FROM (
  SELECT asset_tag FROM inventory WHERE asset_tag IS NOT NULL GROUP BY asset_tag HAVING count(*) > 1) a
UNION ALL SELECT 'repeated inventory_id', count(*) FROM (
  SELECT inventory_id FROM inventory GROUP BY inventory_id HAVING count(*) > 1) b""",
    "inventory",
)
_add(
    "device_ids",
    "SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS inventory_id, o_orderkey, o_orderdate FROM orders",
)

# --- changes and their log -----------------------------------------------------------------------
_add(
    "asset_history",
    "SELECT * FROM audit_log WHERE asset_tag IN (SELECT asset_tag FROM inventory WHERE is_loaner AND asset_tag IS NOT NULL)",
    "audit_log",
    "inventory",
)
_add("newest_audit", "SELECT * FROM audit_log ORDER BY changed_at DESC, audit_id DESC LIMIT 100", "audit_log")
_add(
    "snapshot_diff",
    f"""
SELECT CASE WHEN was AND kept THEN 'UPDATE' WHEN was THEN 'DELETE' ELSE 'CREATE' END AS action_type,
       CAST(inventory_id AS VARCHAR) AS asset_tag, field_name, if(was, old_value, NULL) AS old_value,
       if(kept, new_value, NULL) AS new_value, 'Migration Script' AS changed_by, {AS_OF_SQL} AS changed_at,
       CAST(NULL AS VARCHAR) AS notes
FROM (
  SELECT inventory_id, 'asset_type' AS field_name, asset_type AS old_value, {_LAPTOP_TRIMMED} AS new_value FROM located
  UNION ALL
  SELECT inventory_id, 'location_id', NULL, CAST(location_id AS VARCHAR) FROM located
  UNION ALL
  SELECT inventory_id, 'is_loaner', if(is_loaner, 'True', 'False'), if(is_loaner, 'True', 'False') FROM located) cells
JOIN (SELECT inventory_id, inventory_id % 37 <> 5 AS was, coalesce(asset_tag, '') <> '' AS kept FROM located) sides USING (inventory_id)
WHERE (was OR kept) AND (NOT was OR NOT kept OR old_value IS DISTINCT FROM new_value)""",
    "located",
)
_add("loan_commands_loans", "SELECT * FROM new_loans", "new_loans")
_add(
    "loan_handles_loans",
    """
SELECT * FROM loans WHERE checkin_date IS NOT NULL
UNION ALL
SELECT o.* REPLACE (r.command_ts AS checkin_date) FROM open_loans o
LEFT JOIN (SELECT device, command_ts FROM handle_ok WHERE kind = 'CHECKIN' AND turn = 1) r ON r.device = o.inventory_id
UNION ALL
SELECT command_id, device, user_name, command_ts, expected_return_date, until, notes FROM handle_ok WHERE kind = 'CHECKOUT'""",
    "loans",
    "open_loans",
    "handle_ok",
)
_add(
    "loan_handles_rejected",
    """
SELECT command_id, CASE WHEN kind = 'CHECKOUT' THEN 'Item is not available for checkout'
                        ELSE 'Invalid checkout or already checked in' END AS reason
FROM loan_handles WHERE command_id NOT IN (SELECT command_id FROM handle_ok)""",
    "loan_handles",
    "handle_ok",
)
_add("loan_command_stream_loans", "SELECT * FROM new_loans", "new_loans")
_add(
    "loan_commands_audit",
    """
SELECT action_type, asset_tag, 'status' AS field_name, old_value, new_value, changed_by, changed_at, CAST(NULL AS VARCHAR) AS notes
FROM (
  SELECT 'CHECKOUT' AS action_type, asset_tag, 'available' AS old_value, 'checked out' AS new_value,
         user_name AS changed_by, checkout_date AS changed_at FROM fresh
  UNION ALL
  SELECT 'CHECKIN', asset_tag, 'checked out', 'available', user_name, checkin_date FROM fresh WHERE checkin_date IS NOT NULL
  UNION ALL
  SELECT 'CHECKIN', asset_tag, 'checked out', 'available', user_name, checkin_date FROM returned
  WHERE checkin_date IS NOT NULL) rows""",
    "fresh",
    "returned",
)
_add(
    "loan_commands_rejected",
    """
SELECT command_id, early AS reason FROM judged WHERE early IS NOT NULL
UNION ALL
SELECT command_id, if(kind = 'CHECKOUT', 'Item is not available for checkout', 'Invalid checkout or already checked in')
FROM decided WHERE NOT ok""",
    "judged",
    "decided",
)
_add(
    "toggle_loaner_inventory",
    """
SELECT inventory_id, asset_tag, CASE WHEN coalesce(k, 0) % 2 = 1 THEN NOT is_loaner ELSE is_loaner END AS is_loaner
FROM inventory LEFT JOIN (SELECT asset_tag, count(*) AS k FROM flips GROUP BY asset_tag) f USING (asset_tag)""",
    "inventory",
    "flips",
)
_add(
    "toggle_loaner_audit",
    """
SELECT 'UPDATE' AS action_type, asset_tag, 'is_loaner' AS field_name, if(flag = (n % 2 = 1), 'True', 'False') AS old_value,
       if(flag = (n % 2 = 1), 'False', 'True') AS new_value, coalesce(changed_by, 'system') AS changed_by,
       command_ts AS changed_at, CAST(NULL AS VARCHAR) AS notes FROM flips""",
    "flips",
)
_add(
    "toggle_loaner_rejected",
    """
SELECT command_id, if(devices IS NULL, 'Asset not found', 'Asset tag is not unique') AS reason
FROM toggle_commands LEFT JOIN tag_flags USING (asset_tag) WHERE coalesce(devices, 0) <> 1""",
    "toggle_commands",
    "tag_flags",
)
_add(
    "location_changes",
    """
SELECT * FROM loc_final WHERE location_id NOT IN (SELECT location_id FROM removals)
UNION ALL SELECT * EXCLUDE (changed_by, command_ts) FROM loc_created""",
    "loc_final",
    "loc_created",
    "removals",
)
_add(
    "location_changes_audit",
    """
SELECT action_type, asset_tag, field_name, old_value, new_value, changed_by, changed_at, CAST(NULL AS VARCHAR) AS notes
FROM (
  SELECT 'CREATE' AS action_type, 'LOC_' || location_id AS asset_tag, 'location' AS field_name, NULL AS old_value,
         site_name || ' - ' || room_number AS new_value, changed_by, command_ts AS changed_at FROM loc_created
  UNION ALL
  SELECT 'DELETE', 'LOC_' || location_id, 'location', old_site || ' - ' || old_room, NULL, changed_by, command_ts
  FROM loc_judged WHERE kind = 'DELETE' AND reason IS NULL
  UNION ALL
  SELECT 'UPDATE', 'LOC_' || location_id, 'room_name', prev_name, room_name, changed_by, command_ts
  FROM loc_steps WHERE room_name <> prev_name
  UNION ALL
  SELECT 'UPDATE', 'LOC_' || location_id, 'room_type', prev_type, room_type, changed_by, command_ts
  FROM loc_steps WHERE room_type <> prev_type) rows""",
    "loc_created",
    "loc_judged",
    "loc_steps",
)
_add("location_changes_rejected", "SELECT command_id, reason FROM loc_judged WHERE reason IS NOT NULL", "loc_judged")

_add(
    "loan_returns_loans",
    """
SELECT l.* REPLACE (coalesce(l.checkin_date, r.at) AS checkin_date)
FROM loans l LEFT JOIN first_returns r USING (checkout_id)""",
    "loans",
    "first_returns",
)
_add(
    "loan_returns_rejected",
    """
SELECT command_id, if(checkout_id = 0, 'Missing checkout_id', 'Invalid checkout or already checked in') AS reason
FROM loan_returns WHERE checkout_id = 0 OR command_id NOT IN (SELECT command_id FROM first_returns)""",
    "loan_returns",
    "first_returns",
)
_add(
    "location_moves",
    """
SELECT l.* REPLACE (coalesce(s, l.site_name) AS site_name, coalesce(n, l.room_number) AS room_number)
FROM rooms l LEFT JOIN (
  SELECT location_id, arg_max(site_name, command_ts) FILTER (site_name IS NOT NULL) AS s,
         arg_max(room_number, command_ts) AS n FROM moved GROUP BY location_id) m USING (location_id)""",
    "rooms",
    "moved",
)
_add(
    "location_moves_audit",
    """
SELECT 'UPDATE' AS action_type, 'LOC_' || location_id AS asset_tag, field_name, old_value, new_value, changed_by,
       command_ts AS changed_at, CAST(NULL AS VARCHAR) AS notes
FROM (SELECT *, 'site_name' AS field_name, prev_site AS old_value, site_name AS new_value FROM moved
      UNION ALL SELECT *, 'room_number', prev_room, room_number FROM moved) steps
WHERE new_value <> old_value""",
    "moved",
)
_add(
    "location_handles",
    """
SELECT * FROM rooms WHERE location_id > 100
UNION ALL
SELECT r.id, r.site, r.room, r.name, r.type FROM room_ends WHERE r.id <= 100 OR r.id >= 10000000""",
    "rooms",
    "room_ends",
)
_add(
    "location_handles_audit",
    """
SELECT kind AS action_type, 'LOC_' || CASE WHEN kind = 'CREATE' THEN l.command_id ELSE location_id END AS asset_tag, x.f AS field_name,
       x.o AS old_value, x.n AS new_value, changed_by, command_ts AS changed_at, CAST(NULL AS VARCHAR) AS notes
FROM (
  SELECT l.*, unnest(CASE
    WHEN kind = 'CREATE' THEN [{'f': 'location', 'o': NULL, 'n': site_name || ' - ' || room_number}]
    WHEN kind = 'DELETE' THEN [{'f': 'location', 'o': cur.site || ' - ' || cur.room, 'n': NULL}]
    ELSE list_filter([{'f': 'site_name', 'o': cur.site, 'n': site_name}, {'f': 'room_number', 'o': cur.room, 'n': room_number},
                      {'f': 'room_name', 'o': cur.name, 'n': room_name}, {'f': 'room_type', 'o': cur.type, 'n': room_type}],
                     lambda c: c.o <> c.n) END) AS x
  FROM room_line l JOIN room_steps s USING (command_id) WHERE reason IS NULL) l""",
    "room_line",
    "room_steps",
)
_add("location_handles_rejected", "SELECT command_id, reason FROM room_steps WHERE reason IS NOT NULL", "room_steps")
ORACLES["loan_stream_repeats_loans"] = ORACLES["loan_handles_loans"]
_add(
    "refill_locations",
    """
SELECT * FROM early_rooms UNION ALL
SELECT (SELECT max(location_id) FROM early_rooms) + row_number() OVER (ORDER BY site_name, room_number), site_name, room_number, room_name, room_type
FROM locations l WHERE NOT EXISTS (SELECT 1 FROM early_rooms e WHERE e.site_name = l.site_name AND e.room_number = l.room_number)""",
    "locations",
    "early_rooms",
)
_add(
    "insert_absent",
    """
SELECT row_number() OVER (ORDER BY early DESC, site_name NULLS FIRST, room_number NULLS FIRST) AS room_id, site_name, room_number, room_name
FROM (
  SELECT site_name, room_number, bool_or(is_loaner) AS early, first(room_name ORDER BY is_loaner DESC, room_name NULLS FIRST) AS room_name
  FROM inventory GROUP BY site_name, room_number) rooms""",
    "inventory",
)

# --- keys under a collation ----------------------------------------------------------------------
_add("collated_equals", "SELECT * FROM mixed WHERE rtrim(site_name) COLLATE NOCASE = 'france'", "mixed")
_add(
    "collated_lookup",
    """
SELECT * FROM mixed
WHERE rtrim(asset_tag) COLLATE NOCASE IN (SELECT asset_tag FROM inventory WHERE is_loaner AND asset_tag IS NOT NULL)""",
    "mixed",
    "inventory",
)
_add(
    "collated_assign_location",
    """
SELECT inventory_id, m.site_name, m.room_number, s.location_id FROM mixed m
LEFT JOIN spelled s ON rtrim(coalesce(m.site_name, 'Unknown')) COLLATE NOCASE = s.site_name
  AND rtrim(coalesce(m.room_number, 'Unknown')) COLLATE NOCASE = s.room_number""",
    "mixed",
    "spelled",
)
_add(
    "collated_duplicate_rows",
    """
SELECT inventory_id, asset_tag, site_name, serial_number FROM (
  SELECT *, count(*) OVER (PARTITION BY lower(rtrim(serial_number)), lower(rtrim(site_name))) AS n FROM mixed
  WHERE serial_number IS NOT NULL AND site_name IS NOT NULL) keyed
WHERE n > 1""",
    "mixed",
)
_add(
    "collated_duplicate_keys",
    """
SELECT min(asset_tag) AS asset_tag, count(*) AS duplicate_count FROM mixed WHERE asset_tag IS NOT NULL
GROUP BY rtrim(asset_tag) COLLATE NOCASE HAVING count(*) > 1""",
    "mixed",
)
_add(
    "collated_location_exists",
    """
SELECT w.site_name, w.room_number, s.location_id IS NOT NULL AS exists, s.location_id
FROM (SELECT min(site_name) AS site_name, min(room_number) AS room_number FROM mixed
      GROUP BY rtrim(site_name) COLLATE NOCASE, rtrim(room_number) COLLATE NOCASE) w
LEFT JOIN spelled s ON rtrim(w.site_name) COLLATE NOCASE = s.site_name AND rtrim(w.room_number) COLLATE NOCASE = s.room_number""",
    "mixed",
    "spelled",
)
_add(
    "collated_inventory_profile",
    """
SELECT count(*) AS total_records, count(DISTINCT lower(rtrim(asset_tag))) AS unique_assets,
       count(DISTINCT lower(rtrim(site_name))) AS unique_sites, count(DISTINCT lower(rtrim(room_number))) AS unique_rooms,
       count(DISTINCT lower(rtrim(coalesce(site_name, '') || coalesce(room_number, '')))) AS unique_locations,
       count(*) FILTER (rtrim(coalesce(asset_tag, '')) = '') AS null_asset_tags,
       count(*) FILTER (rtrim(coalesce(site_name, '')) = '') AS null_sites,
       count(*) FILTER (rtrim(coalesce(room_number, '')) = '') AS null_rooms FROM mixed""",
    "mixed",
)
_add(
    "collated_site_summary",
    """
SELECT min(site_name) AS site_name, count(DISTINCT lower(rtrim(room_number))) AS unique_rooms, count(*) AS total_records,
       count(*) FILTER (rtrim(coalesce(asset_tag, '')) = '') AS records_without_assets FROM mixed GROUP BY rtrim(site_name) COLLATE NOCASE""",
    "mixed",
)
_add(
    "collated_room_name_frequency",
    """
SELECT 'Room Type Analysis' AS analysis, min(room_name) AS room_name, count(*) AS count,
       count(*) FILTER (rtrim(coalesce(asset_tag, '')) = '') AS null_asset_count FROM mixed GROUP BY rtrim(room_name) COLLATE NOCASE""",
    "mixed",
)
_add(
    "collated_location_list",
    """
SELECT row_number() OVER (ORDER BY site_name COLLATE NOCASE, room_number COLLATE NOCASE, location_id) AS position, * FROM spelled""",
    "spelled",
)
_add(
    "collated_room_types",
    """
SELECT row_number() OVER (ORDER BY lower(room_type)) AS position, room_type
FROM (SELECT min(room_type) AS room_type FROM spelled GROUP BY room_type COLLATE NOCASE) types""",
    "spelled",
)
_add(
    "collated_page",
    """
SELECT row_number() OVER (ORDER BY lower(site_name), lower(room_number), lower(rtrim(asset_tag)) NULLS FIRST, inventory_id) AS position, *
FROM (
  SELECT inventory_id, s.site_name, s.room_number, s.room_name, s.room_type, asset_tag, asset_type, model, serial_number, notes,
         assigned_to, date_assigned, date_decommissioned, is_loaner
  FROM located JOIN spelled s USING (location_id) WHERE s.room_type COLLATE NOCASE = 'workspace'
  ORDER BY lower(s.site_name), lower(s.room_number), lower(rtrim(asset_tag)) NULLS FIRST, inventory_id LIMIT 25 OFFSET 75) rows""",
    "located",
    "spelled",
)
_add(
    "collated_keyset_page",
    """
SELECT * FROM mixed WHERE lower(rtrim(serial_number)) > 'sn1000' OR (lower(rtrim(serial_number)) = 'sn1000' AND inventory_id > 1001)
ORDER BY lower(rtrim(serial_number)), inventory_id LIMIT 35""",
    "mixed",
)
_add(
    "collated_sort",
    """
SELECT row_number() OVER (ORDER BY lower(rtrim(coalesce(assigned_to, ''))) DESC, inventory_id) AS position, * FROM mixed""",
    "mixed",
)

# --- stored layouts ------------------------------------------------------------------------------
_PAGE_ORDER = "site_name NULLS FIRST, room_number NULLS FIRST, asset_tag NULLS FIRST, inventory_id"
_NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY {_PAGE_ORDER}) AS n, count(*) OVER () AS total FROM inventory)"
_add("deep_page", f"SELECT * EXCLUDE (n, total), n - 1200 AS position FROM {_NUMBERED} WHERE n > 1200 AND n <= 1225", "inventory")
_BOUNDARY = """
SELECT coalesce(max(serial_number), '') AS boundary FROM (
  SELECT serial_number FROM sheet ORDER BY serial_number NULLS FIRST, inventory_id LIMIT 1201) first_rows"""
_add("deep_boundary", _BOUNDARY, "sheet")
_add("directory_boundary", _BOUNDARY, "sheet")
_add(
    "directory_page",
    f"""
SELECT * EXCLUDE (n, total, page), row_number() OVER (ORDER BY n) AS position
FROM (SELECT *, (n + 24) // 25 AS page FROM {_NUMBERED}) WHERE page = ((total + 24) // 25 + 1) // 2""",
    "inventory",
)
_add(
    "directory_numbers",
    "SELECT count(*) AS total_items, 3 AS page, 25 AS per_page, (count(*) + 24) // 25 AS total_pages FROM inventory",
    "inventory",
)
_add(
    "profile_of_sketches",
    f"""
SELECT measure, exact_count, true AS is_close FROM (UNPIVOT ({_PROFILE}) ON COLUMNS(*) INTO NAME measure VALUE exact_count)""",
    "inventory",
)
_add(
    "schema_gate",
    """
SELECT unnest(['missing columns: asset_tag, is_loaner', 'missing tables: locations, loans']) AS message, count(*) AS rows FROM sheet""",
    "sheet",
)
_add(
    "asset_history_by_tag",
    """
SELECT * FROM (SELECT * REPLACE (row_number() OVER (ORDER BY audit_id) AS audit_id) FROM audit_log) log
WHERE asset_tag IN (SELECT asset_tag FROM inventory WHERE room_name = 'Office Annex' AND asset_tag IS NOT NULL)""",
    "audit_log",
    "inventory",
)
_add(
    "version_diff",
    f"""
SELECT if(gone, 'DELETE', 'UPDATE') AS action_type, CAST(inventory_id AS VARCHAR) AS asset_tag, c.f AS field_name, c.o AS old_value,
       if(gone, NULL, c.n) AS new_value, 'Migration Script' AS changed_by, {AS_OF_SQL} AS changed_at, CAST(NULL AS VARCHAR) AS notes
FROM (
  SELECT inventory_id, coalesce(room_name = 'Office Annex', false) AS gone,
         unnest([{{'f': 'assigned_to', 'o': assigned_to, 'n': if(notes = 'temporary desk', 'desk', assigned_to)}},
                 {{'f': 'asset_type', 'o': asset_type, 'n': asset_type}},
                 {{'f': 'is_loaner', 'o': if(is_loaner, 'True', 'False'), 'n': if(is_loaner, 'True', 'False')}}]) AS c
  FROM inventory) cells
WHERE gone OR c.o IS DISTINCT FROM c.n""",
    "inventory",
)
_add(
    "kept_counts_by_room",
    """
SELECT f.site_name, f.room_type, count(DISTINCT f.location_id) AS locations, count(inventory_id) AS devices,
       count(*) FILTER (flag) AS loaners
FROM (SELECT location_id, site_name, room_type FROM loc_final WHERE location_id NOT IN (SELECT location_id FROM removals)
      UNION ALL SELECT location_id, site_name, room_type FROM loc_created) f
LEFT JOIN (
  SELECT inventory_id, location_id, CASE WHEN coalesce(k, 0) % 2 = 1 THEN NOT is_loaner ELSE is_loaner END AS flag
  FROM located LEFT JOIN (SELECT asset_tag, count(*) AS k FROM flips GROUP BY asset_tag) t USING (asset_tag)) d USING (location_id)
GROUP BY f.site_name, f.room_type""",
    "loc_final",
    "loc_created",
    "removals",
    "located",
    "flips",
)
