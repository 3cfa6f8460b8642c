"""The command stream ends where one batch over the same commands ends, and touches only what it must."""

from datetime import timedelta

import pytest

from fleetlens import schemas
from fleetlens.operators.loan_changes import apply_loan_commands
from fleetlens.streaming import loan_commands
from fleetlens.streaming.buckets import BucketedTable
from fleetlens.streaming.loan_commands import LoanState, loan_command_stream, start_state, stream_loans
from tests.test_changes import START, inventory


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def append(spark, cmds, path):
    spark.createDataFrame(cmds, schemas.LOAN_COMMANDS).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def fleet(spark, tmp_path):
    """Devices, loans of which one is open, random commands, and folders for state and arrivals."""
    inv = inventory(spark, [(i, f"T{i}", i != 4, None) for i in range(1, 6)])
    loans = spark.createDataFrame([(1, 1, "old", START, None, None, None), (2, 2, "old", START, None, START, None)], schemas.LOANER_CHECKOUTS)
    cmds = []
    for n in range(45):
        kind = "CHECKOUT" if n * 7 % 5 < 3 else "CHECKIN"
        named = 1000 + n - n % 4 if kind == "CHECKIN" and n % 3 else None
        cmds.append((1000 + n, START + timedelta(hours=n), kind, None if named else n * 3 % 6 + 1, named, f"u{n}", None, None))
    return inv, loans, cmds, str(tmp_path / "state"), str(tmp_path / "in")


def test_three_files_in_three_batches(spark, fleet):
    """One start reads two files one by one, the next one finds the third and what was sent before."""
    inv, loans, cmds, state, incoming = fleet
    start_state(inv, loans, state, 4)
    for parts in ((cmds[:15], cmds[15:30] + cmds[3:6]), (cmds[30:] + cmds[10:20] + cmds[40:],)):
        for part in parts:
            append(spark, part, incoming)
        loan_command_stream(spark, incoming, state, files_per_batch=1, ids_from_commands=True).awaitTermination()

    whole, audit, rejected = apply_loan_commands(inv, loans, spark.createDataFrame(cmds, schemas.LOAN_COMMANDS), ids_from_commands=True)
    assert rows(stream_loans(spark, state)) == rows(whole)
    assert rows(spark.read.parquet(f"{state}/audit").drop("batch")) == rows(audit)
    assert rows(spark.read.parquet(f"{state}/rejected").drop("batch")) == rows(rejected) and rejected.count() > 0
    # The list by loan says the same as the open loans.
    kept = LoanState(spark, state)
    last = kept.open.last_batch()
    assert last >= 2
    assert rows(kept.places.read(last)) == rows(kept.open.read(last).select("checkout_id", "inventory_id"))


def test_devices_alone_without_ids_from_commands(spark, fleet):
    inv, loans, cmds, state, incoming = fleet
    cmds = [(*c[:3], c[0] * 3 % 6 + 1, None, *c[5:]) for c in cmds]
    start_state(inv, loans, state)
    for part in (cmds[:20], cmds[20:]):
        append(spark, part, incoming)
        loan_command_stream(spark, incoming, state).awaitTermination()
    whole, audit, _ = apply_loan_commands(inv, loans, spark.createDataFrame(cmds, schemas.LOAN_COMMANDS))
    assert rows(stream_loans(spark, state)) == rows(whole)
    assert rows(spark.read.parquet(f"{state}/audit").drop("batch")) == rows(audit)


def test_a_command_of_long_ago_still_counts(spark, fleet):
    inv, loans, _, state, incoming = fleet
    start_state(inv, loans, state, 4)
    late = (2, START - timedelta(days=400), "CHECKOUT", 3, None, "late", None, None)
    for cmd in ((1, START, "CHECKOUT", 2, None, "u", None, None), late):
        append(spark, [cmd], incoming)
        loan_command_stream(spark, incoming, state).awaitTermination()
    assert {r.user_name for r in stream_loans(spark, state).collect()} == {"old", "u", "late"}


def test_ten_commands_read_ten_buckets_at_most(spark, tmp_path, monkeypatch):
    inv = inventory(spark, [(i, f"T{i}", True, None) for i in range(400)])
    loans = spark.createDataFrame([(i, i, "old", START, None, None, None) for i in range(0, 400, 2)], schemas.LOANER_CHECKOUTS)
    state, incoming, seen = str(tmp_path / "state"), str(tmp_path / "in"), []
    start_state(inv, loans, state, 100)

    def watched(devices, opened, commands, **more):
        seen.append((len(devices.inputFiles()), len(opened.inputFiles()), commands.count()))
        return apply_loan_commands(devices, opened, commands, **more)

    monkeypatch.setattr(loan_commands, "apply_loan_commands", watched)
    by_device = [(500 + i, START + timedelta(days=1, hours=i), "CHECKOUT", i * 42 + 1, None, "new", None, None) for i in range(5)]
    by_loan = [(600 + i, START + timedelta(days=1, hours=i), "CHECKIN", None, i * 38, None, None, None) for i in range(1, 6)]
    append(spark, by_device + by_loan, incoming)
    loan_command_stream(spark, incoming, state).awaitTermination()
    devices, opened, commands = seen[0]
    assert commands == 10 and devices <= 10 and opened <= 10
    assert len(list((tmp_path / "state/devices/rows/batch=-1").glob("bucket=*"))) > 90
    assert len(list((tmp_path / "state/open/rows/batch=0").glob("bucket=*"))) <= 10
    now = stream_loans(spark, state)
    assert now.where("checkin_date IS NULL").count() == 200 and now.where("checkout_id >= 399").count() == 5


def test_buckets_keep_what_is_not_touched(spark, tmp_path):
    kind = schemas.T.StructType([schemas.LOANER_CHECKOUTS["checkout_id"], schemas.LOANER_CHECKOUTS["user_name"]])
    table = BucketedTable(spark, str(tmp_path), "checkout_id", kind, 8)
    first = spark.createDataFrame([(i, "a") for i in range(50)], kind)
    table.write(first, -1)
    touched = table.buckets_of(spark.createDataFrame([(3, "x"), (3, "y"), (11, "z")], kind))
    assert 1 <= len(touched) <= 2
    for _ in range(2):  # a repeated batch leaves the same
        table.write(table.read(-1, touched).where("checkout_id <> 3"), 0, touched)
    assert rows(table.read(0)) == rows(first.where("checkout_id <> 3")) and rows(table.read(-1)) == rows(first)
    table.write(table.read(0).where("false"), 1, range(8))
    assert table.read(1).count() == 0 and table.last_batch() == 1
    table.write(first.where("false"), 2, set())
    assert table.read(2).count() == 0
