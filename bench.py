"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the number of local cores. Stored tables
(locations, linked inventory, equipment, the text sheet) are built first and reported as
``setup``; each query then runs once to warm up and three more times, of which the median counts.
A query that takes longer than ten seconds is timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fleetlens.plans.catalog import QUERIES
from fleetlens.plans.prepared import tables
from fleetlens.session import local_session

HEADLINE = [
    # reports
    "inventory_profile", "site_summary", "asset_type_distribution", "null_patterns", "room_name_frequency",
    # locations and equipment
    "build_locations", "assign_location", "locations_by_site_type_inner", "equipment_by_type", "location_conflicts",
    "reconcile_locations", "equipment_build", "migration_counts",
    # browsing
    "inventory_page", "inventory_page_numbers", "keyset_page", "inventory_search", "inventory_filter", "loaner_candidates",
    # loans and history
    "available_loaners", "checked_out_loaners", "active_loans", "loan_status", "asset_history", "newest_audit",
    # quality
    "duplicate_assets", "fk_orphans", "conformance", "quality_gate", "tags_per_room",
    # imports and changes
    "import_accepted", "snapshot_diff", "toggle_loaner_inventory", "loan_commands_loans", "location_changes",
]
LONG = 10.0


def run(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "fleetlens-bench")
    names = sys.argv[1:] or HEADLINE

    start = time.perf_counter()
    prepared = tables(spark, sf_dir)
    _ = prepared.locations, prepared.located, prepared.equipment, prepared.sheet_paths
    setup = time.perf_counter() - start

    seconds = {}
    for name in names:
        times = [run(QUERIES[name], spark, sf_dir)]
        rounds = 1 if times[0] > LONG else 3
        times = [run(QUERIES[name], spark, sf_dir) for _ in range(rounds)]
        seconds[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "setup": round(setup, 3),
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
