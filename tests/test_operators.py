"""Operators on small literal tables: the cases the whole-table checks cannot single out."""

from datetime import datetime

import pytest

from fleetlens import schemas
from fleetlens.functions.cells import CASE_BLIND
from fleetlens.functions.taxonomy import FOUR_RULES
from fleetlens.operators import browse, history, loans, locations, quality, reports, skew, sketches, tidy
from fleetlens.operators.directory import PageDirectory
from fleetlens.operators.equipment import build_equipment
from fleetlens.plans.migration import migrate
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 20)


def devices(spark, *rows):
    full = []
    for n, row in enumerate(rows):
        full.append({f.name: None for f in schemas.INVENTORY} | dict(inventory_id=n + 1, is_loaner=False) | row)
    return spark.createDataFrame([tuple(r[f.name] for f in schemas.INVENTORY) for r in full], schemas.INVENTORY)


def room(site, number, name=None, **more):
    return dict(site_name=site, room_number=number, room_name=name, **more)


def test_room_with_two_names(spark):
    inv = devices(spark, room("S", "R1"), room("S", "R1", "Office"), room(None, None), room("S", "R2"))
    loc = {(r.site_name, r.room_number): r for r in locations.build_locations(inv).collect()}
    assert loc["S", "R1"].room_name == "Office" and loc["S", "R1"].room_type == "Workspace"
    assert loc["S", "R2"].room_name == "Unknown" and loc["S", "R2"].room_type == "Other"
    assert sorted(r.location_id for r in loc.values()) == [1, 2, 3]
    assert [tuple(r) for r in locations.location_conflicts(inv).collect()] == [("S", "R1", 2)]


def test_row_filters_of_the_location_build(spark):
    inv = devices(spark, room(None, None), room(None, None, "Hall"), room("S", None), room("S", "R"))
    counts = {k: locations.build_locations(inv, FOUR_RULES, k).count() for k in ("all", "any_field", "room_number")}
    assert counts == {"all": 3, "any_field": 3, "room_number": 1}
    assert locations.build_locations(devices(spark, room(None, None)), keep="any_field").count() == 0
    with pytest.raises(ValueError):
        locations.build_locations(inv, keep="some")


def test_every_row_finds_its_location(spark):
    inv = devices(spark, room(None, "R"), room("S", None), room("S", "R"), room(None, None))
    loc = locations.build_locations(inv)
    assert locations.assign_location(inv, loc).where("location_id IS NULL").count() == 0
    report = locations.reconcile_locations(inv, loc).first()
    assert report.original_location_count == report.new_location_count == 4


def test_unmatched_rows_keep_or_lose_their_id(spark):
    inv = devices(spark, room("S", "R", location_id=9), room("X", "Y", location_id=8))
    loc = locations.build_locations(inv.where("site_name = 'S'"))
    kept = {r.site_name: r.location_id for r in locations.assign_location(inv, loc).collect()}
    reset = {r.site_name: r.location_id for r in locations.assign_location(inv, loc, reset=True).collect()}
    assert kept == {"S": 1, "X": 8} and reset == {"S": 1, "X": None}


def test_folded_keys(spark):
    inv = devices(spark, room("North", "R1"), room("NORTH ", "r1"))
    assert locations.build_locations(inv).count() == 2
    folded = locations.build_locations(inv, fold_keys=True)
    assert folded.count() == 1
    assert locations.assign_location(inv, folded, fold_keys=True).where("location_id = 1").count() == 2


def test_empty_location_counts_as_one_only_in_the_left_form(spark):
    inv = devices(spark, room("S", "R", location_id=1))
    loc = spark.createDataFrame([(1, "S", "R", "x", "Other"), (2, "S", "Q", "x", "Storage")], schemas.LOCATIONS)
    left = {r.room_type: r.equipment_count for r in locations.by_site_type(loc, inv, "left").collect()}
    inner = {r.room_type: r.equipment_count for r in locations.by_site_type(loc, inv, "inner").collect()}
    assert left == {"Other": 1, "Storage": 1} and inner == {"Other": 1}


def test_equipment_rejects(spark):
    inv = devices(
        spark,
        dict(asset_tag="A", asset_type="Dock"), dict(asset_tag="B", asset_type="Dock"),
        dict(asset_tag="B", asset_type="Dock"), dict(asset_tag="C"), dict(asset_tag=""), dict(),
    )
    equipment, rejected = build_equipment(inv, locations.build_locations(inv), AS_OF)
    assert [r.asset_tag for r in equipment.collect()] == ["A"]
    assert sorted((r.inventory_id, r.reason) for r in rejected.collect()) == [
        (2, "asset_tag is not unique"), (3, "asset_tag is not unique"), (4, "asset_type is missing"),
    ]
    assert equipment.columns == schemas.EQUIPMENT.fieldNames()


def test_two_open_loans_of_one_device(spark):
    inv = devices(spark, dict(is_loaner=True, asset_tag="T"), dict(is_loaner=True, asset_tag="U"))
    rows = [(n, 1, f"u{n}", AS_OF, None, None, None) for n in (1, 2)] + [(3, 2, "u3", AS_OF, None, AS_OF, None)]
    out = spark.createDataFrame(rows, schemas.LOANER_CHECKOUTS)
    assert [r.asset_tag for r in loans.available_loaners(inv, out).collect()] == ["U"]
    assert loans.checked_out_loaners(inv, out).count() == 2
    assert [tuple(r) for r in quality.open_loan_violations(out).collect()] == [(1, 2)]
    status = loans.loan_status(inv, out)
    assert sorted((r.status, r.current_user) for r in status.collect()) == [("Available", "N/A"), ("Checked Out", "u1"), ("Checked Out", "u2")]


@pytest.mark.parametrize("rows", [skew.BROADCAST_ROWS, 0])
def test_free_and_out_make_up_all_loaners(spark, monkeypatch, rows):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", rows)
    inv = spark.range(1, 301).select(
        *[(F.col("id") if f.name == "inventory_id" else F.col("id") % 3 == 0 if f.name == "is_loaner" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.INVENTORY]
    )
    open_for = F.when(F.col("id") % 3 == 0, 3).otherwise(F.col("id"))
    out = spark.range(200).select(
        F.col("id").alias("checkout_id"), open_for.cast("long").alias("inventory_id"), F.lit("u").alias("user_name"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("checkout_date"), F.lit(None).cast("timestamp_ntz").alias("expected_return_date"),
        F.when(F.col("id") % 2 == 0, F.lit(AS_OF)).cast("timestamp_ntz").alias("checkin_date"), F.lit(None).cast("string").alias("checkout_notes"),
    )
    free = {r.inventory_id for r in loans.available_loaners(inv, out).collect()}
    gone = [r.inventory_id for r in loans.checked_out_loaners(inv, out).collect()]
    assert free.isdisjoint(gone)
    assert free | set(gone) == set(range(3, 301, 3))
    assert len(gone) == out.where("checkin_date IS NULL AND inventory_id % 3 = 0 AND inventory_id > 0").count()


def test_diff_replays_the_change(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, None, False)], "k long, x string, f boolean")
    new = spark.createDataFrame([(1, "a", False), (2, None, None), (4, None, True)], "k long, x string, f boolean")
    log = history.diff_to_audit(old, new, "k", ["x", "f"], "me", AS_OF, "K")
    state = {(r.k, c): ({True: "True", False: "False"}.get(r[c], r[c])) for r in old.collect() for c in ("x", "f")}
    for r in log.collect():
        key = (int(r.asset_tag[1:]), r.field_name)
        assert state.get(key) == r.old_value
        if r.action_type == "DELETE":
            del state[key]
        else:
            state[key] = r.new_value
    assert state == {(r.k, c): ({True: "True", False: "False"}.get(r[c], r[c])) for r in new.collect() for c in ("x", "f")}
    assert sorted(r.action_type for r in log.collect()) == ["CREATE"] * 2 + ["DELETE"] * 2 + ["UPDATE"] * 2


def test_gates(spark):
    inv = devices(spark, dict(asset_tag="A"), dict(asset_tag="A"), dict(asset_tag=""), dict())
    with pytest.raises(quality.QualityError, match="2 rows or values: blank asset_tag; 1 rows or values: repeated asset_tag"):
        quality.require(inv, ["asset_tag"], ["asset_tag"])
    quality.require(inv.where("inventory_id = 1"), ["asset_tag"], ["asset_tag"])
    with pytest.raises(quality.QualityError, match="missing columns: colour"):
        quality.require_columns(inv, ["asset_tag", "colour"])
    with pytest.raises(quality.QualityError, match="missing tables: loans"):
        quality.require_tables({"inventory": inv}, ["inventory", "loans"])


def test_folded_duplicates(spark):
    inv = devices(spark, dict(asset_tag="a1"), dict(asset_tag="A1 "), dict(asset_tag="A2"))
    assert quality.duplicate_keys(inv, ["asset_tag"]).count() == 0
    assert [tuple(r) for r in quality.duplicate_keys(inv, ["asset_tag"], collation=CASE_BLIND).collect()] == [("A1 ", 2)]


def test_conformance(spark):
    inv = devices(spark, dict(asset_tag="x" * 101, site_name="S"), dict(room_number="9" * 51, asset_type="t"))
    got = {r.column_name: (r.null_count, r.too_long_count) for r in quality.conformance(inv, schemas.EQUIPMENT_RULES).collect()}
    assert got["asset_tag"] == (1, 1) and got["room_number"] == (0, 1) and got["asset_type"] == (1, 0)


def test_column_report(spark):
    got = [tuple(r) for r in quality.column_report(devices(spark, dict(asset_tag="T12"), dict())).collect()]
    assert ("location_id", "bigint", True, 2, None) in got and ("is_loaner", "boolean", False, 0, None) in got
    assert ("asset_tag", "string", True, 1, 3) in got


def test_tidy_columns_twice(spark):
    df = spark.createDataFrame([(1, "n")], "id int, notes string")

    def once(d):
        return tidy.rename_if_present(tidy.add_nullable_column(tidy.add_flag_column(d), "location_id", "long"))

    assert once(df).columns == once(once(df)).columns == ["id", "checkout_notes", "is_loaner", "location_id"]


def test_deep_page_equals_shallow_page(spark, monkeypatch):
    df = spark.range(500).select((F.col("id") * 7 % 50).alias("a"), "id")
    shallow = [tuple(r) for r in browse.page_of(df, ["a", "id"], 120, 25).collect()]
    boundary = browse.page_boundary(df.select(F.col("id").cast("string").alias("s"), "id"), "s", 120, "id").first()[0]
    monkeypatch.setattr(browse, "TOP_K_DEPTH", 10)
    assert [tuple(r) for r in browse.page_of(df, ["a", "id"], 120, 25).collect()] == shallow
    assert len(shallow) == 25
    assert browse.page_boundary(df.select(F.col("id").cast("string").alias("s"), "id"), "s", 120, "id").first()[0] == boundary


def test_keyset_pages(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["b", "a", "a", None, "", "c", "b"])], "inventory_id long, serial_number string")
    strict = [r.inventory_id for r in browse.keyset_page(df, "a", 1).collect()]
    assert strict == [0]
    after = [(r.serial_number, r.inventory_id) for r in browse.keyset_page(df, "a", 5, after_id=1).collect()]
    assert after == [("a", 2), ("b", 0), ("b", 6), ("c", 5)]
    # A page edge inside a group of equal keys skips the rest of the group, as NULL and '' are never shown.
    assert browse.page_boundary(df, "serial_number", 3, "inventory_id").first()[0] == "a"
    assert [r.serial_number for r in browse.numbered_keyset_page(df, 2, 3).collect()] == ["b", "b", "c"]
    assert browse.page_boundary(df, "serial_number", 0, "inventory_id").first()[0] == ""


def test_sorting_of_missing_values(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "b"), (2, None, None), (3, "1969-01-01", "a")], "id int, d string, t string")
    assert [r.id for r in browse.sort_by(df, "d", ["id"], is_date=True).collect()] == [3, 2, 1]
    assert [r.id for r in browse.sort_by(df, "t", ["id"]).collect()] == [2, 3, 1]
    assert [r.id for r in browse.sort_by(df, "t", ["id"], desc=True).collect()] == [1, 3, 2]


def test_open_ranges_and_search(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "Bob"), (2, None, None), (3, "2024-03-01", "ann")], "id int, d string, t string")
    assert [r.id for r in browse.filter_inventory(df, {"t": "B"}, {"d": ("2024-01-02", None)}).collect()] == [1]
    assert browse.filter_inventory(df, {"t": ""}, {"d": (None, None)}).count() == 3
    assert [r.id for r in browse.search(df, ["d", "t"], "AN").collect()] == [3]
    assert browse.search(df, ["d", "t"], "").count() == 3


def test_samples(spark):
    df = spark.range(100)
    assert browse.sample_rows(df, 5, 3).count() == 5
    chosen = [sorted(r.id for r in browse.sample_rows(d, 5, 3, "id").collect()) for d in (df, df.repartition(7))]
    assert chosen[0] == chosen[1]


def test_page_numbers(spark):
    inv = devices(spark, *[room("S", "R", location_id=1) for _ in range(26)], room("S", "Q"))
    loc = spark.createDataFrame([(1, "S", "R", "x", "Other")], schemas.LOCATIONS)
    rows, meta = browse.inventory_page(inv, loc, 2)
    assert rows.count() == 1 and tuple(meta.first()) == (26, 2, 25, 2)
    rows, meta = browse.inventory_page(inv, loc, 2, include_unlocated=True)
    assert rows.count() == 2 and tuple(meta.first()) == (27, 2, 25, 2)
    assert tuple(browse.inventory_page(inv, loc, 1, room_type="none")[1].first()) == (0, 1, 25, 0)


def test_crowded_group_is_one_text(spark):
    """One group spans many pieces, and still gives what a plain aggregate would."""
    df = spark.range(0, 5000, 1, 8).select((F.col("id") % 10 == 0).alias("g"), F.col("id").cast("string").alias("t"), "id")
    got = {r.g: r.t for r in reports.group_concat_ordered(df, ["g"], "t", ["id"]).collect()}
    assert got == {g: ",".join(str(v) for v in range(5000) if (v % 10 == 0) == g) for g in (False, True)}


def test_text_beyond_a_cell_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reports, "CELL_BYTES", 10)
    df = spark.createDataFrame([("a", "12345", 1), ("a", "12345", 2), ("b", "1", 3)], "g string, t string, n int")
    with pytest.raises(ValueError, match="'g': 'a'"):
        reports.group_concat_ordered(df, ["g"], "t", ["n"])


def test_approximate_profile(spark):
    inv = devices(spark, *[dict(asset_tag=f"T{n}") for n in range(50)])
    exact, rough = reports.inventory_profile(inv).first(), reports.inventory_profile(inv, approx=True).first()
    assert exact.unique_assets == 50 and abs(rough.unique_assets - 50) <= 5
    assert reports.inventory_profile(inv.where("inventory_id < 0")).first().total_records == 0


def test_migration(spark):
    inv = devices(
        spark,
        room("S", "R", "Office", asset_tag="A", asset_type='14" Laptop', date_assigned="2024-01-02"),
        room("S", "R", None, asset_tag="B", asset_type="Loaner Laptop", date_assigned="n/a"),
        room(None, None, None, asset_tag=""),
    )
    result = migrate(inv.drop("location_id", "is_loaner"), AS_OF)
    assert tuple(result.counts.first()) == (2, 2, 1)
    assert tuple(result.coverage.first()) == (3, 3, 0)
    assert result.reconciliation.first().new_location_count == 2
    assert result.profile.first().total_records == 3
    types = {r.asset_tag: (r.asset_type, r.date_assigned, r.is_loaner) for r in result.equipment.collect()}
    assert types == {"A": ("14 Laptop", datetime(2024, 1, 2), False), "B": ("Loaner Laptop", None, True)}
    with pytest.raises(quality.QualityError):
        migrate(inv, AS_OF, strict=True)


# --- keys under a collation, stored layouts -------------------------------------------------------


def spelled(spark):
    rows = [room("Lab", "R1", "a", asset_tag="T1"), room("LAB ", "r1", "A", asset_tag="t1 "), room("lab", "R2", asset_tag="  "), room(None, "R1", asset_tag=None)]
    return devices(spark, *rows, room("Yard", "R1", "b ", asset_tag=""))


def test_one_switch_for_case_and_trailing_spaces(spark):
    inv = spelled(spark)
    assert browse.equals_given(inv, site_name="LAB").count() == 0
    assert browse.equals_given(inv, CASE_BLIND, site_name="LAB").count() == 3
    keys = devices(spark, dict(asset_tag="T1 "), dict(asset_tag="t1"))
    found = browse.lookup(inv, keys, "asset_tag", ["inventory_id"], CASE_BLIND).collect()
    assert sorted(r.asset_tag for r in found) == ["T1", "t1 "]
    profile = reports.inventory_profile(inv, collation=CASE_BLIND).first()
    assert tuple(profile) == (5, 2, 2, 2, 5, 3, 1, 0)
    assert tuple(reports.inventory_profile(inv).first())[1:5] == (4, 4, 3, 5)
    assert [tuple(r) for r in reports.site_summary(inv, CASE_BLIND).collect()] == [(None, 1, 1, 1), ("LAB ", 2, 3, 1), ("Yard", 1, 1, 1)]
    assert [tuple(r)[1:] for r in reports.room_name_frequency(inv, CASE_BLIND).collect()] == [(None, 2, 2), ("A", 2, 0), ("b ", 1, 1)]
    twice = quality.duplicate_rows(inv, ["site_name", "room_number"], ["inventory_id"], ["inventory_id"], collation=CASE_BLIND)
    assert [r.inventory_id for r in twice.collect()] == [1, 2]
    loc = locations.build_locations(inv.where("inventory_id IN (1, 5)"))
    asked = {(r.site_name, r.room_number): r.exists for r in locations.location_exists(inv, loc, CASE_BLIND).collect()}
    assert asked == {("LAB ", "R1"): True, ("lab", "R2"): False, (None, "R1"): False, ("Yard", "R1"): True}
    assert browse.distinct_sorted(inv, "site_name", CASE_BLIND).count() == 3
    order = [r.inventory_id for r in browse.sort_by(inv, "site_name", ["inventory_id"], collation=CASE_BLIND).collect()]
    assert order == [4, 1, 2, 3, 5]
    pages = [[r.inventory_id for r in browse.page_of(inv, ["site_name", "inventory_id"], 1, 3, CASE_BLIND, depth).collect()] for depth in (0, 100)]
    assert pages == [[1, 2, 3]] * 2
    assert [r.inventory_id for r in browse.keyset_page(inv, "LAB", 5, 1, "site_name", collation=CASE_BLIND).collect()] == [2, 3, 5]


def test_a_refilled_dimension_keeps_its_ids(spark):
    first = devices(spark, room("S", "R1", "Office"), room("S", "R3"))
    grown = devices(spark, room("S", "R1", "Other name"), room("S", "R2"), room(None, None), room("A", "R9"), room("S", "R3"))
    loc = locations.build_locations(first)
    once = locations.refill_locations(loc, grown)
    assert {tuple(r)[:4] for r in once.collect()} == {
        (1, "S", "R1", "Office"), (2, "S", "R3", "Unknown"), (3, "A", "R9", "Unknown"), (4, "S", "R2", "Unknown"), (5, "Unknown", "Unknown", "Unknown")
    }
    assert sorted(map(tuple, locations.refill_locations(once, grown).collect())) == sorted(map(tuple, once.collect()))
    whole = {tuple(r)[1:3] for r in locations.build_locations(first.unionByName(grown)).collect()}
    assert {tuple(r)[1:3] for r in once.collect()} == whole
    assert locations.refill_locations(loc.where("false"), first).count() == 2
    folded = locations.refill_locations(loc, devices(spark, room("s ", "r1"), room("T", "R1")), fold_keys=True)
    assert folded.count() == 3


@pytest.mark.parametrize("per_page", [1, 7, 25])
def test_pages_by_directory(spark, tmp_path, per_page):
    inv = devices(spark, *[room(f"S{i * 7 % 5}", None if i % 4 else "R", asset_tag=f"T{i % 9}") for i in range(60)])
    order = ["site_name", "room_number", "asset_tag", "inventory_id"]
    pages = PageDirectory.build(inv, order, str(tmp_path / "p"), 6)
    whole = [r.inventory_id for r in inv.orderBy(*order).collect()]
    for page in (1, 2, 60 // per_page, 60 // per_page + 1, 100_000):
        assert [r.inventory_id for r in pages.page(page, per_page).collect()] == whole[(page - 1) * per_page : page * per_page]
    numbers = pages.numbers(100_000, per_page).first()
    assert (numbers.total_items, numbers.total_pages) == (60, -(-60 // per_page))
    plan = pages.page(3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Exchange" not in plan
    tags = [r.asset_tag for r in inv.orderBy(*order).collect()]
    assert pages.boundary("asset_tag", 10).first()[0] == tags[9] and pages.boundary("asset_tag", 900).first()[0] == tags[-1]
    assert pages.boundary("asset_tag", 0).first()[0] == ""
    # What lies in other pieces is never opened.
    for file in (tmp_path / "p/rows").glob("_piece=*/*.parquet"):
        if file.parent.name != "_piece=0":
            file.write_bytes(b"not a table")
            (file.parent / f".{file.name}.crc").unlink()
    assert [r.inventory_id for r in pages.page(1, 3).collect()] == whole[:3]


def test_pages_of_nothing(spark, tmp_path):
    pages = PageDirectory.build(devices(spark, dict()).where("false"), ["inventory_id"], str(tmp_path / "p"))
    assert pages.page(1).count() == 0 and pages.numbers(1).first().total_items == 0


def test_sketches_are_united(spark):
    inv = devices(spark, *[room(f"S{i % 3}", f"R{i % 50}", asset_tag=f"T{i % 700}" if i % 7 else None) for i in range(2000)])
    parts = sketches.profile_sketches(inv.where("inventory_id <= 1000"), ["site_name"]).unionByName(
        sketches.profile_sketches(inv.where("inventory_id > 1000"), ["site_name"])
    )
    exact, found = reports.inventory_profile(inv).first(), sketches.profile_of_sketches(parts).first()
    assert found.asDict().keys() == exact.asDict().keys()
    for name, value in exact.asDict().items():
        assert abs(found[name] - value) <= sketches.relative_error() * value
    by_site = sketches.profile_of_sketches(parts, ["site_name"]).collect()
    assert sorted((r.site_name, r.total_records) for r in by_site) == [("S0", 667), ("S1", 667), ("S2", 666)]
