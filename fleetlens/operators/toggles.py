"""Flipping the loaner flag of devices in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import is_blank, log_text
from fleetlens.operators.history import log_rows
from fleetlens.operators.ordering import cut_pieces, number_within, plain
from fleetlens.operators.skew import join_checked
from fleetlens.sources.storage import stored

# The reasons given with a rejected command.
NOT_FOUND = "Asset not found"
AMBIGUOUS = "Asset tag is not unique"


def toggle_loaner(inv: DataFrame, cmds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New inventory, log and rejected commands.

    A tag flipped k times changes only if k is odd; the k-th flip starts from the stored flag or its
    opposite. Both follow from a count and a row number per tag.
    """
    asked = stored(
        cmds.where(~is_blank("asset_tag")).groupBy("asset_tag").agg(F.count("*").alias("_flips")), "tags"
    )
    rows = join_checked(inv.select("inventory_id", "asset_tag", "is_loaner"), asked, ["asset_tag"], "inner", ["inventory_id"])
    known = stored(
        rows.groupBy("asset_tag").agg(
            F.count("*").alias("_devices"),
            F.min("inventory_id").alias("inventory_id"),
            F.bool_or("is_loaner").alias("_flag"),
            F.max("_flips").alias("_flips"),
        ),
        "flags",
    )
    judged = join_checked(cmds, known.drop("inventory_id", "_flips"), ["asset_tag"], "left", ["command_id"])
    reason = F.when(F.col("_devices").isNull(), NOT_FOUND).when(F.col("_devices") > 1, AMBIGUOUS)
    judged = stored(judged.withColumn("reason", reason), "toggles")
    rejected = judged.where("reason IS NOT NULL").select("command_id", "reason")

    flips = judged.where("reason IS NULL").drop("reason", "_devices")
    numbered = plain(
        number_within(cut_pieces(flips, ["asset_tag", "command_ts", "command_id"]), ["asset_tag"], "_n")
    )
    before = F.when(F.col("_n") % 2 == 1, F.col("_flag")).otherwise(~F.col("_flag"))
    audit = log_rows(
        numbered,
        F.col("asset_tag"),
        F.lit("UPDATE"),
        F.lit("is_loaner"),
        log_text(before, True),
        log_text(~before, True),
        F.coalesce("changed_by", F.lit("system")),
        F.col("command_ts"),
    )
    odd = known.where("_devices = 1 AND _flips % 2 = 1").select("inventory_id", F.lit(True).alias("_flip"))
    flipped = join_checked(inv, odd, ["inventory_id"], "left", ["inventory_id"])
    new_inv = flipped.withColumn(
        "is_loaner", F.when(F.col("_flip"), ~F.col("is_loaner")).otherwise(F.col("is_loaner"))
    ).select(*inv.columns)
    return new_inv, audit, rejected
