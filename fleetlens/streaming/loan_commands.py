"""Loan commands as a stream of files: every micro-batch moves the stored state one step.

The state lies in hash buckets: devices and open loans by device, and a list of open loans by loan,
for check-ins that name one. A batch reads and writes only the buckets that its commands touch, so
it costs as much as its commands do, however large the fleet is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.loan_changes import IN, apply_loan_commands
from fleetlens.operators.loans import open_loans
from fleetlens.schemas import INVENTORY, LOAN_COMMANDS, LOANER_CHECKOUTS
from fleetlens.sources.storage import forget, stored
from fleetlens.streaming.buckets import BucketedTable

#: Buckets per table; a batch with fewer commands than these leaves most of the state alone.
BUCKETS = 64
#: For how many days after its first arrival a command is known again.
REMEMBERED_DAYS = 7

_NEXT_ID = "next_id long"
_DEVICES = T.StructType([INVENTORY[c] for c in ("inventory_id", "asset_tag", "is_loaner")])
_PLACES = T.StructType([LOANER_CHECKOUTS[c] for c in ("checkout_id", "inventory_id")])
_ARRIVED = "_arrived"


class LoanState:
    """The stored tables under ``state_dir``."""

    def __init__(self, spark: SparkSession, state_dir: str, buckets: int | None = None):
        if buckets is None:
            buckets = spark.read.schema("buckets int").parquet(f"{state_dir}/layout").first()[0]
        self.spark, self.dir, self.buckets = spark, state_dir, buckets
        self.devices = BucketedTable(spark, f"{state_dir}/devices", "inventory_id", _DEVICES, buckets)
        self.open = BucketedTable(spark, f"{state_dir}/open", "inventory_id", LOANER_CHECKOUTS, buckets)
        #: Device of each open loan.
        self.places = BucketedTable(spark, f"{state_dir}/places", "checkout_id", _PLACES, buckets)

    def devices_named(self, commands: DataFrame, batch: int) -> set[int]:
        """Buckets of all devices that the commands are about, after ``batch``."""
        by_loan = commands.where((F.col("kind") == IN) & F.col("checkout_id").isNotNull()).select("checkout_id").distinct()
        places = self.places.read(batch, self.places.buckets_of(by_loan))
        of_loans = places.join(by_loan, "checkout_id", "left_semi")
        return self.open.buckets_of(commands) | self.open.buckets_of(of_loans)

    def move_places(self, before: DataFrame, after: DataFrame, batch: int) -> None:
        """Bring the list by loan up to date with the open loans of some buckets before and after ``batch``."""
        ids = ["checkout_id", "inventory_id"]
        sides = before.select(*ids, F.lit(-1).alias("n")).unionByName(after.select(*ids, F.lit(1).alias("n")))
        moved = stored(sides.groupBy(*ids).agg(F.sum("n").alias("n")).where("n <> 0"), "moved")
        touched = self.places.buckets_of(moved)
        old = self.places.read(batch - 1, touched).join(moved.where("n < 0"), ids, "left_anti")
        self.places.write(old.unionByName(moved.where("n > 0").select(*ids)), batch, touched)
        forget(moved)


def start_state(inv: DataFrame, loans: DataFrame, state_dir: str, buckets: int = BUCKETS) -> None:
    """Write the state before the first command."""
    spark = inv.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").write.parquet(f"{state_dir}/layout")
    state = LoanState(spark, state_dir, buckets)
    state.devices.write(inv, -1)
    state.open.write(open_loans(loans), -1)
    state.places.write(open_loans(loans), -1)
    loans.where("checkin_date IS NOT NULL").write.parquet(f"{state_dir}/closed/batch=-1")
    following = loans.agg((F.coalesce(F.max("checkout_id"), F.lit(0)) + 1).alias("next_id"))
    following.coalesce(1).write.parquet(f"{state_dir}/ids/batch=-1")


def loan_command_stream(
    spark: SparkSession,
    in_dir: str,
    state_dir: str,
    files_per_batch: int | None = None,
    ids_from_commands: bool = False,
    remember_days: int = REMEMBERED_DAYS,
) -> StreamingQuery:
    """Run all waiting command files against the state under ``state_dir``.

    A batch starts from what its predecessor left and writes its own folders, so a repeated batch
    replaces only its own output. Closed loans are written once and never read again. Commands of
    one batch are ordered by time; a later batch finds the state already moved. With
    ``ids_from_commands`` check-ins may name loans of the same batch by their command.

    A command counts once: Spark's state store knows the ids of all commands that arrived in the
    last ``remember_days`` of file time, over all batches and restarts, so a file, or a command, that is
    sent again has no effect. Time of arrival is the time of the file, so a command that was given
    long ago is not dropped for it. Files that are older than that against the newest one are not
    read, as Spark's file source has it.
    """

    def put(df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{state_dir}/{name}/batch={batch}")

    def step(arrived: DataFrame, batch: int) -> None:
        session = arrived.sparkSession
        state = LoanState(session, state_dir)
        # Stored at once: reading them twice would ask the state store twice.
        commands = stored(arrived.drop(_ARRIVED), "commands")
        if commands.isEmpty():  # Spark forgets old ids in batches without data
            for table in (state.open, state.places):
                table.write(table.read(batch - 1, ()), batch, ())
            return put(session.read.schema(_NEXT_ID).parquet(f"{state_dir}/ids/batch={batch - 1}"), "ids", batch)
        touched = state.devices_named(commands, batch - 1)
        devices, opened = state.devices.read(-1, touched), state.open.read(batch - 1, touched)
        next_id = session.read.schema(_NEXT_ID).parquet(f"{state_dir}/ids/batch={batch - 1}").first()[0]
        loans, audit, rejected = apply_loan_commands(
            devices, opened, commands, first_id=next_id, ids_from_commands=ids_from_commands
        )
        loans = stored(loans, "loans")

        put(loans.where("checkin_date IS NOT NULL"), "closed", batch)
        put(audit, "audit", batch)
        put(rejected, "rejected", batch)
        # greatest() passes over NULLs
        put(loans.agg(F.greatest(F.max("checkout_id") + 1, F.lit(next_id)).alias("next_id")).coalesce(1), "ids", batch)
        state.move_places(opened, open_loans(loans), batch)
        state.open.write(open_loans(loans), batch, touched)
        forget(commands, loans)

    reader = spark.readStream.schema(LOAN_COMMANDS).option("maxFileAge", f"{remember_days}d")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    arrived = reader.parquet(in_dir).select("*", F.col("_metadata.file_modification_time").alias(_ARRIVED))
    return (
        arrived.withWatermark(_ARRIVED, f"{remember_days} days")
        .dropDuplicatesWithinWatermark(["command_id"])
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{state_dir}/progress")
        .trigger(availableNow=True)
        .start()
    )


def stream_loans(spark: SparkSession, state_dir: str, last_batch: int | None = None) -> DataFrame:
    """All loans after ``last_batch`` (the last one): those closed so far and those still open."""
    state = LoanState(spark, state_dir)
    if last_batch is None:
        last_batch = state.open.last_batch()
    by_batch = T.StructType([*LOANER_CHECKOUTS.fields, T.StructField("batch", T.LongType())])
    closed = spark.read.schema(by_batch).parquet(f"{state_dir}/closed")
    closed = closed.where(F.col("batch") <= last_batch).select(*LOANER_CHECKOUTS.fieldNames())
    return closed.unionByName(state.open.read(last_batch))
