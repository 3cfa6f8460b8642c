"""Balanced shards: the smallest largest shard over ordered groups that may not be torn apart.

Equal texts share a group, and so a shard. Groups are ordered by the hash of their text; a group
is one of ``GROUPS`` hash ranges, so the table of group sizes has a fixed bound whatever the
corpus holds, and the search for the cuts runs on that table. Rows never leave the executors.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordering import cut_pieces, number_within
from fleetlens.sources.storage import stored

GROUP_BITS = 16
GROUPS = 1 << GROUP_BITS
ROW_BYTES = 16


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which consecutive groups of these sizes fit into ``shards``."""
    ends = [0, *accumulate(sizes)]
    low, high = max([0, *sizes, -(-ends[-1] // shards)]), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _needed(ends, 0, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def _needed(ends: list[int], start: int, capacity: int, most: int) -> int:
    """Shards that greedy filling needs from group ``start`` on (``most + 1`` if more than ``most``)."""
    used, last = 0, len(ends) - 1
    while start < last and used <= most:
        start = bisect_right(ends, ends[start] + capacity) - 1
        used += 1
    return used


def cut_groups(sizes: list[int], shards: int) -> list[int]:
    """First group of each shard after the first, under the smallest possible largest shard.

    Many cuts reach that optimum when one group is large. Each shard then ends as near as it can
    to an equal part of what is left, as long as the rest still fits.
    """
    ends, capacity = [0, *accumulate(sizes)], smallest_capacity(sizes, shards)
    cuts, start, last = [], 0, len(sizes)
    for left in range(shards, 1, -1):
        goal = ends[start] + (ends[last] - ends[start]) / left
        end = min(bisect_right(ends, goal) - 1, last)
        if end < last and ends[end + 1] - goal < goal - ends[end]:
            end += 1
        full = bisect_right(ends, ends[start] + capacity) - 1
        end = max(start, min(end, full))
        if _needed(ends, end, capacity, left - 1) > left - 1:
            end = full
        cuts.append(end)
        start = end
    return cuts


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and place of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 bytes of the text plus ``ROW_BYTES``. A null text counts as empty, and is in
    the group of the empty text. Rows that are repeated, or lack an id, are sharded like any other;
    within a shard slots follow doc_id (nulls first). An empty table gives an empty result. Other
    columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            (F.octet_length(whole) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(whole), 64 - GROUP_BITS).cast("int").alias("_group"),
        ),
        "sizes",
    )
    # At most GROUPS rows, whatever the size of the corpus.
    found = dict(rows.groupBy("_group").agg(F.sum("size")).collect())
    cuts = cut_groups([found.get(g, 0) for g in range(GROUPS)], shards)
    placed = rows.select("doc_id", "size", "text_crc32", _shard_of(F.col("_group"), cuts).alias("shard"))
    numbered = number_within(cut_pieces(placed, ["shard", "doc_id", "text_crc32"]), ["shard"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _shard_of(group: Column, cuts: list[int]) -> Column:
    passed = [(group >= F.lit(c)).cast("int") for c in cuts]
    return sum(passed, F.lit(0)).cast("int")
