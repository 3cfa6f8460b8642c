"""The registered queries: each runs one operator over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.functions import cells
from fleetlens.functions.taxonomy import FOUR_RULES
from fleetlens.operators import browse, history, kept_counts, loans, locations, quality, reports, sketches, tidy
from fleetlens.operators.directory import PageDirectory
from fleetlens.operators.equipment import build_equipment
from fleetlens.operators.loan_changes import apply_loan_commands
from fleetlens.operators.location_changes import apply_location_changes
from fleetlens.operators.ordering import assign_ids, number_in_order
from fleetlens.operators.toggles import toggle_loaner
from fleetlens.plans.derived import AS_OF
from fleetlens.plans.migration import migrate
from fleetlens.plans.prepared import Tables, tables
from fleetlens.plans.views import register_views
from fleetlens.sources import layout
from fleetlens.sources import tables as store
from fleetlens.sources.imports import check_required, import_rows, read_import
from fleetlens.sources.storage import new_path, stored
from fleetlens.streaming.loan_commands import loan_command_stream, start_state, stream_loans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEARCH_COLUMNS = [
    "manufacturer", "model_number", "hardware_type", "serial_number", "assigned_to", "location", "date_assigned",
    "date_decommissioned",
]


def query(body: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[body.__name__] = lambda spark, sf_dir: body(tables(spark, sf_dir))
    return body


# --- sources and sinks ---------------------------------------------------------------------------


@query
def load_table(t):
    return store.load_table(t.spark, f"{t.sf_dir}/orders.parquet")


def _drawn(rows, source):
    """How many rows were drawn, and how many of them the source does not have."""
    rows = stored(rows, "drawn")
    foreign = rows.exceptAll(source).agg(F.count("*").alias("foreign_rows"))
    return reports.side_by_side([rows.agg(F.count("*").alias("drawn_rows")), foreign], ["drawn_rows", "foreign_rows"])


@query
def peek(t):
    return _drawn(store.peek(t.inventory, 5), t.inventory)


@query
def append_rows(t):
    path = new_path(t.spark, "appended")
    store.append_rows(t.inventory.where("is_loaner"), path)
    store.append_rows(t.inventory.where("NOT is_loaner"), path)
    return store.load_table(t.spark, path, t.inventory.schema)


@query
def backup_snapshot(t):
    root = new_path(t.spark, "backup")
    path = store.backup_snapshot(t.inventory, root, "inventory", datetime(2024, 1, 20, 12, 30, 5))
    return store.load_table(t.spark, path, t.inventory.schema)


@query
def replace_table(t):
    root = new_path(t.spark, "versions")
    store.replace_table(t.inventory, root, 1)
    store.replace_table(store.current_table(t.spark, root).where("is_loaner"), root, 2)
    return store.current_table(t.spark, root)


@query
def append_audit(t):
    """Two appends, the second with times that are missing."""
    path = new_path(t.spark, "audit")
    log = t.derived("audit_log").withColumn("command_id", F.col("audit_id")).drop("audit_id")
    store.append_audit(log.where("action_type <> 'UPDATE'"), path, ["changed_at", "command_id"])
    late = log.where("action_type = 'UPDATE'").withColumn("changed_at", F.when(F.col("command_id") % 2 == 0, F.col("changed_at")))
    store.append_audit(late, path, ["changed_at", "command_id"], as_of=AS_OF)
    return store.load_table(t.spark, path, schemas.AUDIT_LOG)


@query
def insert_select_distinct(t):
    path = new_path(t.spark, "rooms")
    columns = ["site_name", "room_number", "room_name"]
    store.insert_select_distinct(t.inventory, columns, path)
    return t.spark.read.parquet(path)


@query
def insert_absent(t):
    """Three runs over data that grows, the last one with nothing new."""
    path = new_path(t.spark, "dimension")
    columns, key = ["site_name", "room_number", "room_name"], ["site_name", "room_number"]
    for rows in (t.inventory.where("is_loaner"), t.inventory, t.inventory):
        store.insert_absent(rows, columns, key, path, "room_id")
    return t.spark.read.parquet(path)


def _imported(t):
    return import_rows(read_import(t.spark, t.sheet_paths))


@query
def import_accepted(t):
    return _imported(t)[0].select(*schemas.IMPORT_COLUMNS)


@query
def import_rejected(t):
    return _imported(t)[1].select("serial_number", "reason")


@query
def import_summary(t):
    return _imported(t)[2]


# --- projections, filters and cell functions -----------------------------------------------------


@query
def projection_with_label(t):
    return t.inventory.select(F.lit("Device notes").alias("check_type"), "inventory_id", F.col("notes").alias("inventory_notes"))


@query
def any_location_field(t):
    return browse.has_any(t.inventory, ["site_name", "room_number", "room_name"])


@query
def equals_given(t):
    return browse.equals_given(t.locations, room_type="Workspace", site_name=None)


@query
def key_lookup(t):
    keys = t.loans.where("checkin_date IS NULL").select("inventory_id")
    return browse.lookup(t.inventory, keys, "inventory_id", ["inventory_id"])


@query
def loaner_flag_rows(t):
    return t.inventory.where("is_loaner")


@query
def loaner_candidates(t):
    return browse.loaner_candidates(t.inventory)


@query
def inventory_search(t):
    return browse.search(t.derived("sheet"), SEARCH_COLUMNS, "Office")


@query
def inventory_filter(t):
    return browse.filter_inventory(
        t.derived("sheet"),
        {"manufacturer": "build", "hardware_type": "laptop"},
        {"date_assigned": ("1996-01-01", "1998-12-31")},
    )


@query
def loan_filter(t):
    return browse.filter_inventory(
        t.loans,
        {"user_name": "user1"},
        {"checkout_date": ("2024-01-03", "2024-01-20"), "expected_return_date": (None, "2024-01-25")},
    )


@query
def cell_functions(t):
    return t.inventory.select(
        "inventory_id",
        cells.laptop_name("asset_type").alias("laptop_name"),
        cells.laptop_name("asset_type", exact=True).alias("laptop_name_exact"),
        cells.clean_timestamp("date_assigned").alias("assigned_at"),
        cells.clean_date_text("date_assigned").alias("assigned_day"),
        cells.loaner_flag("asset_type", "notes").alias("loaner"),
        cells.joined_key("site_name", "room_number").alias("room_key"),
        cells.location_label(cells.key_or_unknown("site_name"), cells.key_or_unknown("room_number")).alias("label"),
        cells.location_ref("inventory_id").alias("ref"),
        cells.log_text("is_loaner", True).alias("flag_text"),
        (~F.col("is_loaner")).alias("not_loaner"),
        cells.display("notes", "N/A").alias("shown_notes"),
    )


@query
def tidy_columns(t):
    devices = tidy.add_nullable_column(tidy.add_flag_column(t.derived("sheet"), "is_loaner"), "location_id", "long")
    return tidy.rename_if_present(devices, "location", "room_name")


# --- locations -----------------------------------------------------------------------------------


@query
def build_locations(t):
    return locations.build_locations(t.inventory)


@query
def build_locations_four_rules(t):
    return locations.build_locations(t.inventory, FOUR_RULES, "any_field")


@query
def build_locations_case_sensitive(t):
    return locations.build_locations(t.inventory, keep="room_number", case_sensitive=True)


@query
def refill_locations(t):
    """Filled from the loan devices first and from all devices later."""
    first = stored(locations.build_locations(t.inventory.where("is_loaner")), "first")
    return locations.refill_locations(first, t.inventory)


@query
def category_preview(t):
    return locations.category_preview(t.inventory)


@query
def assign_location(t):
    return locations.assign_location(t.inventory, t.locations).select("inventory_id", "asset_tag", "location_id")


@query
def location_conflicts(t):
    return locations.location_conflicts(t.inventory)


@query
def location_exists(t):
    return locations.location_exists(t.inventory, t.locations)


@query
def deletable_locations(t):
    return locations.deletable_locations(t.rooms, t.located)


@query
def location_list(t):
    return number_in_order(locations.location_list(t.locations))


@query
def room_types(t):
    return number_in_order(locations.room_types(t.locations))


@query
def locations_by_site_type_left(t):
    return locations.by_site_type(t.rooms, t.located, "left")


@query
def locations_by_site_type_inner(t):
    return locations.by_site_type(t.locations, t.located, "inner")


@query
def locations_by_type(t):
    return locations.locations_by_type(t.locations)


@query
def equipment_by_type(t):
    return locations.equipment_by_type(t.equipment, t.locations)


@query
def inventory_with_location(t):
    return locations.with_location(t.located, t.locations)


@query
def location_review(t):
    return locations.location_review(t.located, t.locations)


@query
def reconcile_locations(t):
    return locations.reconcile_locations(t.inventory, t.locations)


@query
def backfill_location(t):
    bare = t.equipment.withColumn("location_id", F.lit(None).cast("long"))
    return locations.backfill_location(bare, t.inventory, t.locations).select("asset_tag", "location_id")


# --- equipment and the whole migration -----------------------------------------------------------


@query
def equipment_build(t):
    return build_equipment(t.inventory, t.locations, AS_OF)[0]


@query
def equipment_rejects(t):
    return build_equipment(t.inventory, t.locations, AS_OF)[1]


@query
def equipment_location_check(t):
    return reports.equipment_location_check(t.equipment)


@query
def migration_counts(t):
    return migrate(t.inventory, AS_OF).counts


# --- pages, sorts and samples --------------------------------------------------------------------


@query
def inventory_page(t):
    return browse.inventory_page(t.located, t.locations, page=3, with_total=False)[0]


@query
def inventory_page_of_type(t):
    return browse.inventory_page(t.located, t.locations, page=2, room_type="Workspace", with_total=False)[0]


@query
def inventory_page_numbers(t):
    return browse.inventory_page(t.located, t.locations, page=2, room_type="Workspace")[1]


@query
def inventory_page_unlocated(t):
    return browse.inventory_page(t.inventory, t.locations, page=1, include_unlocated=True, with_total=False)[0]


@query
def keyset_page(t):
    return browse.keyset_page(t.derived("sheet"), after="SN1")


@query
def keyset_page_with_tie(t):
    return browse.keyset_page(t.derived("sheet"), after="SN1000", after_id=1001)


@query
def keyset_page_numbered(t):
    return browse.numbered_keyset_page(t.derived("sheet"), page=4)


@query
def page_boundary(t):
    return browse.page_boundary(t.derived("sheet"), "serial_number", 105, "inventory_id")


PAGE_ORDER = ["site_name", "room_number", "asset_tag", "inventory_id"]


@query
def deep_page(t):
    """Behind the depth to which a page is a top-k."""
    return number_in_order(browse.page_of(t.inventory, PAGE_ORDER, 1200, 25, top_k_depth=100))


@query
def deep_boundary(t):
    return browse.page_boundary(t.derived("sheet"), "serial_number", 1201, "inventory_id", top_k_depth=100)


def _directory(t):
    return PageDirectory.build(t.inventory, PAGE_ORDER, new_path(t.spark, "pages"))


@query
def directory_page(t):
    """The page in the middle, whatever the number of pages."""
    pages = _directory(t)
    middle = (pages.numbers(1).first().total_pages + 1) // 2
    return number_in_order(pages.page(middle))


@query
def directory_numbers(t):
    return _directory(t).numbers(3)


@query
def directory_boundary(t):
    sheet = t.derived("sheet").select("serial_number", "inventory_id")
    return PageDirectory.build(sheet, ["serial_number", "inventory_id"], new_path(t.spark, "serials")).boundary("serial_number", 1201)


@query
def total_items(t):
    return reports.total_items(t.located.where("location_id IS NOT NULL"))


@query
def sort_by_text(t):
    return number_in_order(browse.sort_by(t.derived("sheet"), "assigned_to", ["inventory_id"], desc=True))


@query
def sort_by_date(t):
    return number_in_order(browse.sort_by(t.derived("sheet"), "date_assigned", ["inventory_id"], is_date=True))


@query
def newest_assigned(t):
    return browse.sort_by(t.derived("sheet"), "date_assigned", ["inventory_id"], desc=True, is_date=True).limit(50)


@query
def sample_deterministic(t):
    return browse.sample_rows(t.inventory, 5, 7, "inventory_id")


@query
def sample_random(t):
    tagged = t.inventory.where(cells.not_blank("asset_tag"))
    return _drawn(browse.sample_rows(tagged, 5, 7), tagged)


@query
def migrated_sample(t):
    return browse.migrated_sample(t.equipment, t.locations, 5, 7, "asset_tag")


@query
def migrated_sample_left(t):
    return browse.migrated_sample(t.equipment, t.locations, 5, 11, "asset_tag", "left")


# --- keys under a collation ----------------------------------------------------------------------


def _spelled_locations(t):
    """The locations, every second one in small letters."""
    small = F.col("location_id") % 2 == 0
    return t.locations.withColumns({c: F.when(small, F.lower(c)).otherwise(F.col(c)) for c in schemas.LOCATION_FIELDS})


@query
def collated_equals(t):
    return browse.equals_given(t.derived("mixed"), cells.CASE_BLIND, site_name="France ", asset_type=None)


@query
def collated_lookup(t):
    keys = t.inventory.where("is_loaner").select("asset_tag")
    return browse.lookup(t.derived("mixed"), keys, "asset_tag", ["inventory_id"], cells.CASE_BLIND)


@query
def collated_assign_location(t):
    linked = locations.assign_location(t.derived("mixed"), _spelled_locations(t), fold_keys=True)
    return linked.select("inventory_id", "site_name", "room_number", "location_id")


@query
def collated_duplicate_rows(t):
    columns = ["inventory_id", "asset_tag", "site_name", "serial_number"]
    rows = t.derived("mixed").select(*columns)
    return quality.duplicate_rows(rows, ["serial_number", "site_name"], ["inventory_id"], ["inventory_id"], collation=cells.CASE_BLIND)


@query
def collated_duplicate_keys(t):
    return quality.duplicate_keys(t.derived("mixed"), ["asset_tag"], include_empty=True, collation=cells.CASE_BLIND)


@query
def collated_location_exists(t):
    return locations.location_exists(t.derived("mixed"), _spelled_locations(t), cells.CASE_BLIND)


@query
def collated_inventory_profile(t):
    return reports.inventory_profile(t.derived("mixed"), collation=cells.CASE_BLIND)


@query
def collated_site_summary(t):
    return reports.site_summary(t.derived("mixed"), cells.CASE_BLIND)


@query
def collated_room_name_frequency(t):
    return reports.room_name_frequency(t.derived("mixed"), cells.CASE_BLIND)


@query
def collated_location_list(t):
    return number_in_order(locations.location_list(_spelled_locations(t), cells.CASE_BLIND))


@query
def collated_room_types(t):
    return number_in_order(locations.room_types(_spelled_locations(t), cells.CASE_BLIND))


@query
def collated_page(t):
    rows = browse.inventory_page(
        t.located, _spelled_locations(t), page=4, room_type="WORKSPACE", with_total=False, collation=cells.CASE_BLIND
    )[0]
    return number_in_order(rows)


@query
def collated_keyset_page(t):
    return browse.keyset_page(t.derived("mixed"), after="sn1000", after_id=1001, collation=cells.CASE_BLIND)


@query
def collated_sort(t):
    return number_in_order(browse.sort_by(t.derived("mixed"), "assigned_to", ["inventory_id"], desc=True, collation=cells.CASE_BLIND))


# --- loans ---------------------------------------------------------------------------------------


@query
def available_loaners(t):
    return loans.available_loaners(t.located, t.loans)


@query
def available_in_service(t):
    return loans.available_loaners(t.located, t.loans, skip_decommissioned=True)


@query
def checked_out_loaners(t):
    return loans.checked_out_loaners(t.located, t.loans)


@query
def checked_out_view(t):
    _views(t)
    return t.spark.table("checked_out_loaners")


@query
def active_loans(t):
    return loans.active_loans(t.equipment, t.derived("equipment_loans"), t.locations, AS_OF)


@query
def active_loans_inventory(t):
    return loans.active_loans(t.inventory, t.derived("equipment_loans"), None, AS_OF)


@query
def loan_status(t):
    return loans.loan_status(t.located, t.loans)


@query
def open_checkout_device(t):
    return loans.open_checkout_device(t.loans, t.inventory, t.loans.where("user_name LIKE 'user1%'"))


def _views(t):
    named = {
        "v_inventory": t.located, "v_loans": t.loans, "v_equipment": t.equipment, "v_equipment_loans": t.derived("equipment_loans"),
        "v_locations": t.locations,
    }
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    register_views(t.spark, AS_OF, *named)


@query
def views_by_sql(t):
    _views(t)
    return t.spark.sql(
        """
        SELECT asset_type, count_if(status = 'free') AS free, count_if(status = 'out') AS out,
               count_if(status = 'late') AS late
        FROM (SELECT asset_type, 'free' AS status FROM available_loaners
              UNION ALL SELECT asset_type, 'out' FROM checked_out_loaners
              UNION ALL SELECT asset_type, 'late' FROM active_loans WHERE is_overdue = 1)
        GROUP BY asset_type"""
    )


@query
def view_after_checkout(t):
    """The view shows loans that came after it was registered."""
    _views(t)
    new = t.located.where("is_loaner AND inventory_id % 2 = 0").selectExpr(
        "-inventory_id AS checkout_id", "inventory_id", "'late' AS user_name", f"timestamp_ntz'{AS_OF}' AS checkout_date",
        "CAST(NULL AS TIMESTAMP_NTZ) AS expected_return_date", "CAST(NULL AS TIMESTAMP_NTZ) AS checkin_date", "CAST(NULL AS STRING) AS checkout_notes",
    )
    t.loans.unionByName(new).createOrReplaceTempView("v_loans")
    return t.spark.table("available_loaners").select("inventory_id")


# --- reports and quality -------------------------------------------------------------------------


@query
def inventory_profile(t):
    return reports.inventory_profile(t.inventory)


@query
def inventory_profile_tagged(t):
    return reports.inventory_profile(t.inventory, nonblank_only=True)


@query
def profile_of_sketches(t):
    """Estimates from stored sketches, those of loan devices and of others, next to the exact counts."""
    path = new_path(t.spark, "sketches")
    for rows in (t.inventory.where("is_loaner"), t.inventory.where("NOT is_loaner")):
        sketches.profile_sketches(rows, ["site_name"]).write.mode("append").parquet(path)
    found = sketches.profile_of_sketches(t.spark.read.parquet(path))
    exact = reports.inventory_profile(t.inventory)
    sides = [df.unpivot([], df.columns, "measure", name) for df, name in ((found, "estimate"), (exact, "exact_count"))]
    close = F.abs(F.col("estimate") - F.col("exact_count")) <= sketches.relative_error() * F.col("exact_count")
    return sides[0].join(sides[1], "measure").select("measure", "exact_count", close.alias("is_close"))


@query
def site_summary(t):
    return reports.site_summary(t.inventory)


@query
def room_name_frequency(t):
    return reports.room_name_frequency(t.inventory)


@query
def asset_type_distribution(t):
    return reports.asset_type_distribution(t.inventory)


@query
def null_patterns(t):
    return reports.null_patterns(t.inventory)


@query
def location_coverage(t):
    return reports.coverage(t.located, "location_id")


@query
def table_counts(t):
    return reports.table_counts(
        {
            "equipment_count": t.equipment,
            "locations_count": t.locations,
            "loaner_count": t.equipment.where("is_loaner"),
        }
    )


@query
def tags_per_room(t):
    tagged = t.inventory.where(cells.not_blank("asset_tag"))
    return reports.group_concat_ordered(tagged, ["site_name", "room_number"], "asset_tag", ["asset_tag", "inventory_id"])


@query
def blank_keys(t):
    return quality.blank_rows(t.inventory, "asset_tag")


@query
def blank_key_count(t):
    return quality.blank_count(t.inventory, "asset_tag")


@query
def duplicate_keys(t):
    return quality.duplicate_keys(t.inventory, ["asset_tag"])


@query
def duplicate_keys_with_empty(t):
    return quality.duplicate_keys(t.inventory, ["asset_tag"], include_empty=True)


@query
def duplicate_key_count(t):
    return quality.duplicate_key_count(t.inventory, ["asset_tag"], include_empty=True)


@query
def duplicate_locations(t):
    return quality.duplicate_keys(t.inventory, ["site_name", "room_number"])


@query
def duplicate_assets(t):
    columns = ["inventory_id", "asset_tag", "site_name", "room_number", "room_name", "asset_type", "model", "serial_number", "assigned_to", "notes"]
    return quality.duplicate_rows(
        t.inventory.select(*columns), ["asset_tag"], ["inventory_id"], ["asset_tag", "site_name", "room_number", "inventory_id"]
    )


@query
def fk_orphans(t):
    rows = t.derived("equipment_loans").select("loan_id", F.col("temporary_location_id").alias("location_id"))
    return quality.fk_orphans(rows, t.locations, "location_id", ["loan_id"])


@query
def missing_location_review(t):
    return quality.missing_location_review(t.inventory)


@query
def open_loan_violations(t):
    return quality.open_loan_violations(t.loans)


@query
def conformance(t):
    return quality.conformance(t.inventory, schemas.EQUIPMENT_RULES)


@query
def conformance_of_tables(t):
    """All declared tables against their whole schemas."""
    found = [
        ("inventory", t.located, schemas.INVENTORY), ("locations", t.locations, schemas.LOCATIONS),
        ("loaner_checkouts", t.loans, schemas.LOANER_CHECKOUTS), ("equipment", t.equipment, schemas.EQUIPMENT),
        ("equipment_loans", t.derived("equipment_loans"), schemas.EQUIPMENT_LOANS), ("audit_log", t.derived("audit_log"), schemas.AUDIT_LOG),
    ]
    parts = [quality.conformance(df, schema).select(F.lit(name).alias("table_name"), "*") for name, df, schema in found]
    return reduce(DataFrame.unionByName, parts)


@query
def required_columns(t):
    """A table that lacks columns, with its rows, as a gate reports it."""
    lacking = t.derived("sheet").drop("hardware_type", "serial_number")
    missing = check_required(lacking.columns)
    return lacking.agg(F.lit(", ".join(missing)).alias("missing_columns"), F.count("*").alias("rows"))


@query
def schema_gate(t):
    """What stops a run that needs columns and tables which are not there, and the rows it would have run on."""
    sheet = t.derived("sheet")
    stops = []
    for check in (
        lambda: quality.require_columns(sheet, ["serial_number", "asset_tag", "is_loaner"]),
        lambda: quality.require_tables({"inventory": t.inventory}, ["inventory", "locations", "loans"]),
        lambda: quality.require_columns(sheet, ["serial_number"]),
    ):
        try:
            check()
        except quality.QualityError as problem:
            stops.append(F.lit(str(problem)))
    return sheet.agg(F.count("*").alias("rows")).select(F.explode(F.array(*stops)).alias("message"), "rows")


@query
def column_report(t):
    return quality.column_report(t.raw("orders"))


@query
def quality_gate(t):
    return quality.check_counts(t.inventory, ["asset_tag", "site_name", "asset_type"], ["asset_tag", "inventory_id"])


@query
def device_ids(t):
    devices = t.raw("orders").select("o_orderkey", "o_orderdate")
    return assign_ids(devices, ["o_orderdate", "o_orderkey"], name="inventory_id")


# --- changes and their log -----------------------------------------------------------------------


@query
def asset_history(t):
    return history.asset_history(t.derived("audit_log"), t.inventory.where("is_loaner"))


@query
def asset_history_by_tag(t):
    path = new_path(t.spark, "log")
    log = t.derived("audit_log").withColumnRenamed("audit_id", "event")
    layout.append_audit_by_tag(log, path, ["event"])
    return layout.history_by_tag(t.spark, path, t.inventory.where("room_name = 'Office Annex'"))


@query
def version_diff(t):
    """Two stored versions, of which the later lacks a few devices and has others in new hands."""
    root, fields = new_path(t.spark, "versions"), ["assigned_to", "asset_type", "is_loaner"]
    later = t.inventory.where("room_name <> 'Office Annex' OR room_name IS NULL")
    later = later.withColumn("assigned_to", F.when(F.col("notes") == "temporary desk", "desk").otherwise(F.col("assigned_to")))
    for version, rows in ((1, t.inventory), (2, later)):
        layout.store_version(rows, root, version, "inventory_id", fields)
    return layout.diff_versions(t.spark, root, 1, 2, "inventory_id", fields, "Migration Script", AS_OF)


@query
def newest_audit(t):
    return history.newest_audit(t.derived("audit_log"))


@query
def snapshot_diff(t):
    old = t.inventory.where("inventory_id % 37 <> 5")  # the others are new
    new = t.located.where(cells.not_blank("asset_tag")).withColumn("asset_type", cells.laptop_name("asset_type"))
    return history.diff_to_audit(
        old, new, "inventory_id", ["asset_type", "location_id", "is_loaner"], "Migration Script", AS_OF
    )


def _loan_changes(t):
    return apply_loan_commands(t.inventory, t.loans, t.derived("loan_commands"))


@query
def loan_commands_loans(t):
    return _loan_changes(t)[0]


@query
def loan_commands_audit(t):
    return _loan_changes(t)[1]


@query
def loan_commands_rejected(t):
    return _loan_changes(t)[2]


@query
def loan_command_stream_loans(t):
    state, incoming = new_path(t.spark, "stream-state"), new_path(t.spark, "stream-in")
    start_state(t.inventory, t.loans, state)
    t.derived("loan_commands").write.parquet(incoming)
    loan_command_stream(t.spark, incoming, state).awaitTermination()
    return stream_loans(t.spark, state)


@query
def loan_stream_repeats_loans(t):
    """Three arrivals one after the other, of which each brings a tenth of what came so far once more."""
    state, incoming = new_path(t.spark, "stream-state"), new_path(t.spark, "stream-in")
    start_state(t.inventory.withColumn("is_loaner", F.lit(True)), t.loans, state)
    commands = t.derived("loan_handles")
    low, high = commands.agg(F.min("command_id"), F.max("command_id")).first()
    turn = F.floor((F.col("command_id") - low) * 3 / (high - low + 1))
    for now in range(3):
        again = commands.where((turn <= now) & (F.col("command_id") % 10 == 3))
        commands.where(turn == now).unionByName(again).write.mode("append").parquet(incoming)
        loan_command_stream(t.spark, incoming, state, ids_from_commands=True).awaitTermination()
    return stream_loans(t.spark, state)


def _loan_returns(t):
    commands = t.derived("loan_returns").withColumn("expected_return_date", F.col("expected_return_date").cast("timestamp_ntz"))
    return apply_loan_commands(t.inventory, t.loans, commands)


@query
def loan_returns_loans(t):
    return _loan_returns(t)[0]


@query
def loan_returns_rejected(t):
    return _loan_returns(t)[2]


def _loan_handles(t):
    """All devices may be lent here, so that most checkouts have something to do."""
    lent = t.inventory.withColumn("is_loaner", F.lit(True))
    return apply_loan_commands(lent, t.loans, t.derived("loan_handles"), ids_from_commands=True)


@query
def loan_handles_loans(t):
    return _loan_handles(t)[0]


@query
def loan_handles_rejected(t):
    return _loan_handles(t)[2]


@query
def toggle_loaner_inventory(t):
    return toggle_loaner(t.inventory, t.derived("toggle_commands"))[0].select("inventory_id", "asset_tag", "is_loaner")


@query
def toggle_loaner_audit(t):
    return toggle_loaner(t.inventory, t.derived("toggle_commands"))[1]


@query
def toggle_loaner_rejected(t):
    return toggle_loaner(t.inventory, t.derived("toggle_commands"))[2]


def _location_changes(t):
    return apply_location_changes(t.rooms, t.located, t.location_commands("location_commands"))


@query
def location_changes(t):
    return _location_changes(t)[0]


@query
def location_changes_audit(t):
    return _location_changes(t)[1]


@query
def location_changes_rejected(t):
    return _location_changes(t)[2]


@query
def location_moves(t):
    return apply_location_changes(t.rooms, t.located, t.location_commands("location_moves"))[0]


@query
def location_moves_audit(t):
    return apply_location_changes(t.rooms, t.located, t.location_commands("location_moves"))[1]


def _location_handles(t):
    return apply_location_changes(t.rooms, t.located, t.location_commands("location_handles"), ids_from_commands=True)


@query
def location_handles(t):
    return _location_handles(t)[0]


@query
def location_handles_audit(t):
    return _location_handles(t)[1]


@query
def location_handles_rejected(t):
    return _location_handles(t)[2]


@query
def kept_counts_by_room(t):
    """Counts kept up over a batch of location changes and a batch of flips."""
    devices, places = stored(kept_counts.device_counts(t.located), "devices"), stored(kept_counts.location_counts(t.rooms), "places")
    after, room_log, _ = _location_changes(t)
    after = stored(after, "after")
    flip_log = toggle_loaner(t.located, t.derived("toggle_commands"))[1]
    devices = kept_counts.add_deltas(devices, kept_counts.flag_deltas(flip_log, t.located))
    places = kept_counts.add_deltas(places, kept_counts.location_deltas(room_log, t.rooms, after))
    return kept_counts.kept_by_room(after, devices, places)
