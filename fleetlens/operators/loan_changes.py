"""Applying batches of checkout and check-in commands.

Commands count in the order (command_ts, command_id). After any well-formed command the state of a
device depends only on the kind of that command: it is out after a CHECKOUT, accepted or not, and in
after a CHECKIN. So a command is accepted exactly if the command before it, or the stored state,
left the device in the opposite state.

A CHECKIN names a device, which returns everything open on it, or a stored loan by ``checkout_id``,
which returns that loan. A device with several stored open loans is in again once all of them came
back one by one or a CHECKIN named the device; these first returns are settled before the rule
above takes over.

With ``ids_from_commands`` a new loan has the id of the command that makes it, so a CHECKIN can name
a loan made earlier in the same batch, and it makes no difference where a log is cut into batches.
Between two returns of the whole device, the first CHECKOUT counts; a loan that is then named makes
room for the next CHECKOUT behind that, and so on. Jumps of doubled length follow these chains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import is_blank
from fleetlens.operators.history import log_rows
from fleetlens.operators.loans import open_loans
from fleetlens.operators.ordering import assign_ids, cut_pieces, plain, reached, running_last
from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored
from fleetlens.sources.tables import next_id

# The reasons given with a rejected command.
UNKNOWN_COMMAND = "Unknown command"
MISSING_FIELDS = "Missing required fields"
MISSING_CHECKOUT = "Missing checkout_id"
NOT_AVAILABLE = "Item is not available for checkout"
NOT_OUT = "Invalid checkout or already checked in"
DUE_TOO_EARLY = "Return date is before the checkout"

OUT, IN = "CHECKOUT", "CHECKIN"


def _well_formed(cmds: DataFrame, require_due: bool) -> DataFrame:
    """Add ``reason`` for commands that are wrong whatever the state is."""
    kind = F.coalesce("kind", F.lit(""))
    no_device = F.col("inventory_id").isNull() | (F.col("inventory_id") == 0)
    no_loan = F.col("checkout_id").isNull() | (F.col("checkout_id") == 0)
    reason = (
        F.when(~kind.isin(OUT, IN), UNKNOWN_COMMAND)
        .when((kind == OUT) & (no_device | is_blank("user_name")), MISSING_FIELDS)
        .when((kind == IN) & no_loan & no_device, MISSING_CHECKOUT)
    )
    if require_due:
        early = F.col("expected_return_date") < F.date_trunc("day", "command_ts").cast("timestamp_ntz")
        reason = reason.when((kind == OUT) & (F.col("expected_return_date").isNull() | early), DUE_TOO_EARLY)
    named = F.when((kind == IN) & ~no_loan, F.col("checkout_id")).alias("_loan")
    return cmds.select("*", reason.alias("reason"), named, F.struct("command_ts", "command_id").alias("_when"))


def _batch_loans(cmds: DataFrame, ids_from_commands: bool) -> DataFrame:
    """_loan and _device of the loans that commands of the batch ask for, if those can be named."""
    made = cmds.where(F.col("kind") == OUT) if ids_from_commands else cmds.where("false")
    return made.select(F.col("command_id").alias("_loan"), F.col("inventory_id").alias("_device"))


def _device_facts(cmds: DataFrame, inv: DataFrame, opened: DataFrame) -> DataFrame:
    """One row per device named in the batch: its tag, its flag, and when its stored loans are back.

    ``_back`` is the moment the device is first in again, NULL if it never is or if it starts in.
    """
    of_device = (F.col("kind") == IN) & F.col("_loan").isNull() & F.col("_made").isNull()
    first_plain_in = F.min(F.when(of_device, F.col("_when")))
    asked = stored(
        cmds.groupBy("inventory_id").agg(first_plain_in.alias("_first_in")).where("inventory_id IS NOT NULL"),
        "asked",
    )
    devices = join_checked(
        inv.select("inventory_id", "asset_tag", "is_loaner"), asked, ["inventory_id"], "inner", ["inventory_id"]
    )
    # Every stored open loan of these devices, with the first command that names it.
    named = cmds.where("_loan IS NOT NULL").groupBy(F.col("_loan").alias("checkout_id")).agg(
        F.min("_first_named").alias("_named_at")
    )
    per_loan = join_checked(
        opened.select("checkout_id", "inventory_id"), asked.select("inventory_id"), ["inventory_id"], "left_semi",
        ["checkout_id"],
    ).join(named, "checkout_id", "left")
    per_device = per_loan.groupBy("inventory_id").agg(
        F.count("*").alias("_open"),
        F.when(F.count("_named_at") == F.count("*"), F.max("_named_at")).alias("_last_named"),
    )
    # least() passes over NULLs
    return devices.join(per_device, "inventory_id", "left").select(
        "inventory_id",
        "asset_tag",
        "is_loaner",
        F.coalesce("_open", F.lit(0)).alias("_open"),
        F.when(F.col("_open") > 0, F.least("_first_in", "_last_named")).alias("_back"),
        F.when(F.col("_open") > 0, F.col("_first_in")).alias("_first_in"),
    )


def _decide_by_loan(line: DataFrame, still_out: Column) -> DataFrame:
    """Add ``_ok`` where some check-ins name a loan of the batch (``_made``, the command that makes it)."""
    out = (F.col("kind") == OUT) & ~still_out
    whole = (F.col("kind") == IN) & F.col("_made").isNull()
    event = F.when(out | whole, F.struct((F.col("kind") == OUT).alias("out"), "command_id"))
    line = running_last(line, ["inventory_id"], {"_prev": event})
    line = running_last(line, ["inventory_id"], {"_next": event, "_whole": F.when(whole, F.col("_when"))}, backwards=True)
    line = stored(line, "line")

    # The first command that names a loan before the whole device comes back ends it.
    made = line.where(out).select(F.col("command_id").alias("_made"), F.col("_when").alias("_from"), F.col("_whole").alias("_until"))
    names = line.where("_made IS NOT NULL").select("_made", "_when", "command_id", F.col("_next").alias("_then"))
    inside = (F.col("_when") > F.col("_from")) & (F.col("_until").isNull() | (F.col("_when") < F.col("_until")))
    ends = names.join(made, "_made").where(inside).groupBy("_made").agg(F.min_by(F.struct("command_id", "_then"), "_when").alias("_end"))
    ends = stored(ends, "ends")
    jumps = ends.where("_end._then.out").select(F.col("_made").alias("command_id"), F.col("_end._then.command_id").alias("_to"))
    heads = line.where(out & ~F.coalesce(F.col("_prev.out"), F.lit(False))).select("command_id")
    taken = stored(reached(heads, stored(jumps, "jumps")).distinct(), "taken")

    ended = taken.join(ends.withColumnRenamed("_made", "command_id"), "command_id").select(F.col("_end.command_id").alias("command_id"))
    unnamed = taken.join(ends.select(F.col("_made").alias("command_id")), "command_id", "left_anti")
    whole_back = line.where(out & F.col("_whole").isNotNull()).join(unnamed, "command_id", "left_semi")
    whole_back = whole_back.select(F.col("_whole.command_id").alias("command_id"))
    good = taken.unionByName(ended).unionByName(whole_back).distinct().withColumn("_good", F.lit(True))
    decided = join_checked(line, stored(good, "good"), ["command_id"], "left", ["_when"])
    return decided.withColumn("_ok", F.coalesce("_good", F.lit(False)) | (still_out & whole)).drop("_prev", "_next", "_whole", "_good")


def apply_loan_commands(
    inv: DataFrame,
    loans: DataFrame,
    cmds: DataFrame,
    require_due: bool = False,
    first_id: int | None = None,
    ids_from_commands: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New loans table, log rows and rejected commands.

    ``first_id`` numbers the new loans; with ``ids_from_commands`` they are numbered by their
    commands, whose ids must then differ from those of all loans.
    """
    opened = open_loans(loans)
    checked = _well_formed(cmds, require_due)
    malformed = checked.where("reason IS NOT NULL").select("command_id", "reason")

    # A CHECKIN by loan belongs to the device of that loan; the first one per loan may count.
    fine = checked.where("reason IS NULL").drop("reason")
    by_name = fine.where("_loan IS NOT NULL")
    named = by_name.groupBy("_loan").agg(F.min("_when").alias("_first_named"))
    named = stored(
        named.join(opened.select(F.col("checkout_id").alias("_loan"), "inventory_id"), "_loan", "left")
        .join(_batch_loans(fine, ids_from_commands), "_loan", "left")
        .select(
            "_loan", "_first_named", F.coalesce("inventory_id", "_device").alias("inventory_id"),
            F.when(F.col("inventory_id").isNull() & F.col("_device").isNotNull(), F.col("_loan")).alias("_made"),
        ),
        "named",
    )
    by_loan = join_checked(by_name.drop("inventory_id"), named, ["_loan"], "left", ["command_id"])
    by_loan = by_loan.withColumn("_loan", F.when(F.col("_made").isNull(), F.col("_loan")))
    unknown_loan = by_loan.where("inventory_id IS NULL").select("command_id", F.lit(NOT_OUT).alias("reason"))
    placed = stored(
        fine.where("_loan IS NULL").withColumn("_made", F.lit(None).cast("long")).unionByName(by_loan.where("inventory_id IS NOT NULL"), allowMissingColumns=True),
        "placed",
    )
    facts = stored(_device_facts(placed, inv, opened), "devices")
    rows = join_checked(placed, facts, ["inventory_id"], "left", ["command_id"])

    # Returns of stored loans by name, unless the device came back before.
    in_time = F.col("_back").isNull() | (F.col("_when") <= F.col("_back"))
    returns = F.col("_loan").isNotNull()
    known = F.col("_open").isNotNull()
    good_return = returns & (F.col("_when") == F.col("_first_named")) & in_time & known
    ends_loan = good_return & (F.col("_when") == F.col("_back"))
    barred = (F.col("kind") == OUT) & ~F.coalesce("is_loaner", F.lit(False))
    settled = (
        F.when(barred, NOT_AVAILABLE)
        .when(returns & ~good_return, NOT_OUT)
        .when(good_return & ~F.coalesce(ends_loan, F.lit(False)), "")
        .when(~returns & (F.col("kind") == IN) & ~known, NOT_OUT)
    )
    rows = stored(rows.withColumn("_settled", settled), "settled")
    settled_rejects = rows.where("_settled <> ''").select("command_id", F.col("_settled").alias("reason"))

    # What is left follows the rule: accepted if the state before is the opposite one.
    pieces = cut_pieces(rows.where("_settled IS NULL"), ["inventory_id", "command_ts", "command_id"])
    # Before its stored loans are back a device is out, whatever commands came first.
    still_out = F.coalesce((F.col("_open") > 0) & (F.col("_back").isNull() | (F.col("_when") <= F.col("_back"))), F.lit(False))
    if ids_from_commands:
        decided = _decide_by_loan(pieces, still_out)
    else:
        ordered = running_last(pieces, ["inventory_id"], {"_before": F.col("kind")})
        state = F.coalesce("_before", F.when(F.col("_open") > 0, OUT).otherwise(IN))
        decided = ordered.withColumn("_ok", F.when(still_out, F.col("kind") == IN).otherwise(F.col("kind") != state))
    decided = stored(decided, "decided")
    state_rejects = decided.where("NOT _ok").select(
        "command_id", F.when(F.col("kind") == OUT, NOT_AVAILABLE).otherwise(NOT_OUT).alias("reason")
    )

    # New loans: an accepted CHECKOUT ends with the next accepted command of its device.
    spans = running_last(
        decided.where("_ok"), ["inventory_id"],
        {"_next": F.when(F.col("kind") == IN, F.col("command_ts"))}, backwards=True,
    )
    taken = plain(spans).where(F.col("kind") == OUT)
    fresh = taken.select(
        "command_ts", "command_id", "inventory_id", "user_name", F.col("command_ts").alias("checkout_date"),
        "expected_return_date", F.col("_next").alias("checkin_date"), F.col("notes").alias("checkout_notes"),
        "asset_tag",
    )
    if ids_from_commands:
        fresh = fresh.withColumn("checkout_id", F.col("command_id"))
    else:
        first_id = next_id(loans, "checkout_id") if first_id is None else first_id
        fresh = assign_ids(fresh, ["command_ts", "command_id"], first_id, "checkout_id")

    # Stored loans: returned by name, or with the device by its first plain CHECKIN.
    one_by_one = rows.where(good_return).select(F.col("_loan").alias("checkout_id"), F.col("command_ts").alias("_named_ts"))
    with_device = facts.where("_open > 0 AND _first_in IS NOT NULL AND _first_in = _back").select(
        "inventory_id", F.col("_back.command_ts").alias("_device_ts")
    )
    tags = facts.select("inventory_id", "asset_tag")
    touched = opened.join(one_by_one, "checkout_id", "left")
    touched = join_checked(touched, with_device, ["inventory_id"], "left", ["checkout_id"])
    touched = touched.withColumn("checkin_date", F.coalesce("_named_ts", "_device_ts"))
    new_loans = (
        loans.where("checkin_date IS NOT NULL")
        .unionByName(touched.select(*loans.columns))
        .unionByName(fresh.select(*loans.columns))
    )

    closed = join_checked(touched.where("checkin_date IS NOT NULL"), tags, ["inventory_id"], "left", ["checkout_id"])
    ended = closed.select("asset_tag", "user_name", "checkin_date").unionByName(
        fresh.where("checkin_date IS NOT NULL").select("asset_tag", "user_name", "checkin_date")
    )
    status = F.lit("status")
    away, home = F.lit("checked out"), F.lit("available")
    tag, user = F.col("asset_tag"), F.col("user_name")
    audit = log_rows(fresh, tag, F.lit(OUT), status, home, away, user, F.col("checkout_date")).unionByName(
        log_rows(ended, tag, F.lit(IN), status, away, home, user, F.col("checkin_date"))
    )
    rejected = malformed.unionByName(unknown_loan).unionByName(settled_rejects).unionByName(state_rejects)
    return new_loans, audit, rejected
