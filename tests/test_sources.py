"""Reading sheets and keeping tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.operators.quality import QualityError
from fleetlens.sources import layout, storage, tables
from fleetlens.sources.imports import check_required, import_rows, read_import

HEADER = "manufacturer,model_number,hardware_type,serial_number,assigned_to,location,date_assigned,date_decommissioned"


def write(path, lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_three_good_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["Dell,L1,Laptop,A1,John,Main,2024-01-14,", "HP,P6,Desktop,X7,Jane,Side,1/2/2024,", "Lenovo,X1,Laptop,D4,,,2024-01-10,"])
    accepted, rejected, summary = import_rows(read_import(spark, path))
    rows = {r.serial_number: r for r in accepted.collect()}
    assert rows["D4"].assigned_to is None and rows["D4"].room_name is None
    assert rows["X7"].date_assigned == "2024-01-02" and rows["A1"].room_name == "Main"
    assert rejected.count() == 0
    assert tuple(summary.first()) == (3, 0)


def test_bad_row_is_named_and_stops_no_other(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["D,m,t,A1,,,2024-01-14,", "D,m,t,A2,,,soon,", "D,m,t,A3,,,,never"])
    accepted, rejected, summary = import_rows(read_import(spark, path))
    assert [r.serial_number for r in accepted.collect()] == ["A1"]
    assert sorted((r.source_row, r.reason) for r in rejected.collect()) == [
        (3, "unreadable date_assigned: soon"),
        (4, "unreadable date_decommissioned: never"),
    ]
    assert tuple(summary.first()) == (1, 2)


def test_counting_reads_each_date_once(spark):
    rows = [("A1", "2024-01-14", ""), ("A2", "soon", None), ("A3", None, "1/2/2024"), ("A4", "n/a", "never")]
    sheet = spark.createDataFrame(rows, "serial_number string, date_assigned string, date_decommissioned string")
    sheet = sheet.select("*", *[F.lit("x").alias(c) for c in schemas.IMPORT_COLUMNS if c not in sheet.columns])
    summary = import_rows(sheet)[2]
    assert tuple(summary.first()) == (2, 2)
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyyMMdd") == 2 and "date_format" not in plan


def test_missing_values_on_request(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["D,m,t,A1,,,,", ",m,t,A2,,,,"])
    df = read_import(spark, path)
    assert import_rows(df)[0].count() == 2
    assert [r.reason for r in import_rows(df, required_values=True)[1].collect()] == ["missing manufacturer"]


def test_missing_columns(spark, tmp_path):
    assert check_required(["manufacturer", "serial_number"]) == ["model_number", "hardware_type"]
    path = write(tmp_path / "a.csv", ["x,y"], "manufacturer,serial_number")
    with pytest.raises(QualityError, match="Missing required columns: model_number, hardware_type"):
        read_import(spark, path)


def test_absent_optional_columns(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["D,m,t,A1"], "manufacturer,model_number,hardware_type,serial_number")
    row = import_rows(read_import(spark, path))[0].first()
    assert row.room_name is None and row.date_assigned is None


def test_row_numbers_of_split_files(spark, tmp_path):
    for name, n in [("a", 900), ("b", 40)]:
        write(tmp_path / f"{name}.csv", [f"maker,model,type,{name}{i},someone {i},room,2024-01-01," for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_import(spark, str(tmp_path))
        rows = df.select("serial_number", "source_row").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 940
    assert all(r.source_row == int(r.serial_number[1:]) + 2 for r in rows)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.replace_table(spark.range(5), root, 1)
    tables.replace_table(tables.current_table(spark, root).where("id > 2"), root, 2)
    assert tables.current_table(spark, root).count() == 2
    with pytest.raises(Exception, match="exists"):
        tables.replace_table(spark.range(1), root, 2)
    assert tables.current_table(spark, root).count() == 2


def test_backup_is_never_overwritten(spark, tmp_path):
    when = datetime(2024, 1, 20, 12, 30, 5)
    path = tables.backup_snapshot(spark.range(3), str(tmp_path), "inv", when)
    assert path.endswith("inv_backup_20240120_123005")
    with pytest.raises(Exception, match="exists"):
        tables.backup_snapshot(spark.range(3), str(tmp_path), "inv", when)


def test_audit_ids_go_on(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = spark.createDataFrame(
        [("UPDATE", "T1", "is_loaner", True, None, "ann", datetime(2024, 1, d)) for d in (2, 1)],
        "action_type string, asset_tag string, field_name string, old_value boolean, new_value boolean, changed_by string, changed_at timestamp_ntz",
    )
    tables.append_audit(rows, path, ["changed_at"])
    tables.append_audit(rows, path, ["changed_at"])
    got = sorted((r.audit_id, r.changed_at.day, r.old_value, r.new_value) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, "True", None), (2, 2, "True", None), (3, 1, "True", None), (4, 2, "True", None)]


def test_audit_time_is_filled_in(spark, tmp_path):
    rows = spark.createDataFrame([("UPDATE", "T1", "x", "ann", None)], "action_type string, asset_tag string, field_name string, changed_by string, changed_at timestamp_ntz")
    with pytest.raises(ValueError, match="as_of"):
        tables.append_audit(rows, str(tmp_path / "a"), ["asset_tag"])
    tables.append_audit(rows, str(tmp_path / "a"), ["asset_tag"], as_of=datetime(2024, 1, 2))
    assert spark.read.parquet(str(tmp_path / "a")).first().changed_at == datetime(2024, 1, 2)


def test_broken_rows_and_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("manufacturer,model_number,hardware_type,serial_number,date_assigned\nDell,X,Laptop,S1,20240105\nDell,X\nHP,Y,Dock,S2,2024-01-05,more,cells\n")
    (tmp_path / "b.csv").write_text('serial_number,manufacturer,hardware_type,location,model_number,date_assigned\nS3,Dell,"Laptop, big",R1,Z,"Jan 5, 2024"\n')
    df = read_import(spark, str(tmp_path))
    accepted, rejected, summary = import_rows(df)
    assert sorted((r.serial_number, r.manufacturer, r.hardware_type, r.room_name, r.date_assigned) for r in accepted.collect()) == [
        ("S1", "Dell", "Laptop", None, "2024-01-05"), ("S3", "Dell", "Laptop, big", "R1", "2024-01-05"),
    ]
    assert sorted((r.source_row, r.reason) for r in rejected.collect()) == [
        (3, "wrong number of cells: Dell,X"), (4, "wrong number of cells: HP,Y,Dock,S2,2024-01-05,more,cells"),
    ]
    assert tuple(summary.first()) == (2, 2)


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert folder == named.rstrip("/") if named else folder
    kept = storage.stored(spark.range(4), "check")
    assert kept.inputFiles()[0].replace("file://", "").startswith(folder)


def test_next_id_of_nothing(spark):
    assert tables.next_id(spark.range(0), "id") == 1


def test_load_from_paths_and_names(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.json(path)
    assert tables.load_table(spark, path, fmt="json").count() == 3
    spark.range(4).createOrReplaceTempView("four")
    assert tables.load_table(spark, "four", fmt="table").count() == 4


# --- dimensions that are filled again, buckets ----------------------------------------------------


def test_only_absent_keys_are_inserted(spark, tmp_path):
    path, kind = str(tmp_path / "dim"), "site string, room string, name string, more int"
    first = spark.createDataFrame([("S", "1", "b", 1), ("S", "1", "a", 2), (None, "1", "x", 3)], kind)
    grown = spark.createDataFrame([("S", "1", "new name", 1), ("S", None, "y", 1), ("A", "9", None, 1), (None, "1", "z", 1)], kind)
    columns, key = ["site", "room", "name"], ["site", "room"]
    assert tables.insert_absent(first, columns, key, path, "id").count() == 2
    assert tables.insert_absent(grown, columns, key, path, "id").count() == 2
    assert tables.insert_absent(grown, columns, key, path, "id").count() == 0
    rows = {(r.site, r.room): (r.id, r.name) for r in spark.read.parquet(path).collect()}
    assert rows == {(None, "1"): (1, "x"), ("S", "1"): (2, "a"), ("A", "9"): (3, None), ("S", None): (4, "y")}
    other = str(tmp_path / "keys")
    tables.insert_absent(first, key, key, other)
    tables.insert_absent(grown, key, key, other)
    assert spark.read.parquet(other).count() == 4


def log_of(spark, tags):
    rows = [(i, "UPDATE", tag, "status", None, "x", "ann", datetime(2024, 1, 1 + i % 20), None) for i, tag in enumerate(tags)]
    kind = "event int, action_type string, asset_tag string, field_name string, old_value string, new_value string, changed_by string, changed_at timestamp_ntz, notes string"
    return spark.createDataFrame(rows, kind)


def test_history_reads_the_buckets_of_its_tags(spark, tmp_path):
    path, tags = str(tmp_path / "log"), [f"T{i % 40}" for i in range(200)] + [None, "T7"]
    layout.append_audit_by_tag(log_of(spark, tags[:100]).coalesce(1), path, ["event"], buckets=16)
    layout.append_audit_by_tag(log_of(spark, tags[100:]).coalesce(1), path, ["event"], buckets=16)
    wanted = spark.createDataFrame([("T7",), ("T7",), (None,), ("none",)], "asset_tag string")
    found = layout.history_by_tag(spark, path, wanted, buckets=16)
    rows = found.collect()
    assert len(rows) == 6 and {r.asset_tag for r in rows} == {"T7"}
    assert [r.changed_at for r in rows] == sorted((r.changed_at for r in rows), reverse=True)
    every = spark.read.parquet(path)
    assert every.count() == 202 and sorted(r.audit_id for r in every.collect()) == list(range(1, 203))
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()


def test_versions_differ_in_few_buckets(spark, tmp_path):
    root, kind = str(tmp_path / "v"), "id int, name string, flag boolean, other int"
    old = [(i, f"n{i}", i % 2 == 0, i) for i in range(300)]
    new = [r for r in old if r[0] != 5] + [(900, None, False, 1)]
    new = [(i, "changed" if i == 77 else n, f, o + 1) for i, n, f, o in new]
    new = [(i, n, None if i == 80 else f, o) for i, n, f, o in new]
    fields = ["name", "flag"]
    for version, rows in ((1, old), (2, new[::-1]), (3, new)):
        layout.store_version(spark.createDataFrame(rows, kind).repartition(version), root, version, "id", fields, buckets=50)
    touched = layout.changed_buckets(spark, root, 1, 2)
    assert 1 <= len(touched) <= 4 and layout.changed_buckets(spark, root, 2, 3) == []
    args = ("id", fields, "me", datetime(2024, 1, 20))
    found = layout.diff_versions(spark, root, 1, 2, *args)
    whole = layout.diff_to_audit(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind), *args)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) and found.count() == 6
    # What the equal buckets hold is never opened.
    for folder in (tmp_path / "v").glob("v*/rows/bucket=*"):
        if int(folder.name.split("=")[1]) not in touched:
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"not a table")
            for file in folder.glob(".*.crc"):
                file.write_bytes(b"crc\x00")
    assert layout.diff_versions(spark, root, 1, 2, *args).count() == 6
    assert layout.diff_versions(spark, root, 2, 3, *args).count() == 0
