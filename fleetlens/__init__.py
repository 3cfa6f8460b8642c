"""Device inventory and loan analytics as DataFrame operators."""

from fleetlens.operators.browse import (
    distinct_sorted,
    equals_given,
    filter_inventory,
    has_any,
    inventory_page,
    keyset_page,
    loaner_candidates,
    lookup,
    migrated_sample,
    numbered_keyset_page,
    page_boundary,
    page_of,
    sample_rows,
    search,
    sort_by,
)
from fleetlens.operators.directory import PageDirectory
from fleetlens.operators.equipment import build_equipment
from fleetlens.operators.history import asset_history, diff_to_audit, newest_audit
from fleetlens.operators.kept_counts import add_deltas, device_counts, flag_deltas, kept_by_room, location_counts, location_deltas
from fleetlens.operators.loan_changes import apply_loan_commands
from fleetlens.operators.loans import (
    active_loans,
    available_loaners,
    checked_out_loaners,
    loan_status,
    open_checkout_device,
    open_loans,
)
from fleetlens.operators.location_changes import apply_location_changes
from fleetlens.operators.locations import (
    assign_location,
    backfill_location,
    build_locations,
    by_site_type,
    category_preview,
    deletable_locations,
    equipment_by_type,
    location_conflicts,
    location_exists,
    location_list,
    location_review,
    locations_by_type,
    new_locations,
    reconcile_locations,
    refill_locations,
    room_types,
    with_location,
)
from fleetlens.operators.ordering import assign_ids
from fleetlens.operators.quality import (
    QualityError,
    blank_count,
    blank_rows,
    check_counts,
    column_report,
    conformance,
    duplicate_key_count,
    duplicate_keys,
    duplicate_rows,
    fk_orphans,
    missing_location_review,
    open_loan_violations,
    require,
    require_columns,
    require_tables,
)
from fleetlens.operators.reports import (
    asset_type_distribution,
    coverage,
    equipment_location_check,
    group_concat_ordered,
    inventory_profile,
    null_patterns,
    room_name_frequency,
    site_summary,
    table_counts,
    total_items,
)
from fleetlens.operators.sketches import profile_of_sketches, profile_sketches
from fleetlens.operators.tidy import add_flag_column, add_nullable_column, rename_if_present
from fleetlens.operators.toggles import toggle_loaner
from fleetlens.plans.migration import Migration, migrate
from fleetlens.plans.views import register_views
from fleetlens.sources.imports import check_required, import_rows, read_import
from fleetlens.sources.layout import append_audit_by_tag, diff_versions, history_by_tag, store_version
from fleetlens.sources.tables import (
    append_audit,
    append_rows,
    backup_snapshot,
    current_table,
    insert_absent,
    insert_select_distinct,
    load_table,
    next_id,
    peek,
    replace_table,
)
from fleetlens.streaming.loan_commands import loan_command_stream, start_state, stream_loans

