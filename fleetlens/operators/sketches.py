"""The inventory profile from stored sketches, which are united without reading the devices again.

A part of the inventory (a site, a day's import) is kept as one small row: its counts, and for each
distinct count a HyperLogLog sketch of 2^``bits`` registers. Any parts can be put together later.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.cells import is_blank, joined_key

BITS = 12
COUNTED = {"total_records": None, "null_asset_tags": "asset_tag", "null_sites": "site_name", "null_rooms": "room_number"}
DISTINCT = ["unique_assets", "unique_sites", "unique_rooms", "unique_locations"]


def relative_error(bits: int = BITS, deviations: float = 4.0) -> float:
    """The relative error that an estimate from united sketches exceeds about once in 16,000 times."""
    return deviations * 1.04 / math.sqrt(1 << bits)


def profile_sketches(inv: DataFrame, by: list[str], bits: int = BITS) -> DataFrame:
    """One row per value of ``by``: counts and sketches, combined inside the tasks before the shuffle."""
    values = [F.col("asset_tag"), F.col("site_name"), F.col("room_number"), joined_key("site_name", "room_number")]
    counts = [F.count("*") if c is None else F.count_if(is_blank(c)) for c in COUNTED.values()]
    # Several sketches in one grouping only share a shuffle of one small row per task and value.
    rows = inv.select(*[F.col(c).alias(f"_by_{c}") for c in by], *[v.alias(n) for v, n in zip(values, DISTINCT, strict=True)], "asset_tag", "site_name", "room_number")
    sketches = [F.hll_sketch_agg(n, F.lit(bits)).alias(n) for n in DISTINCT]
    found = rows.groupBy(*[f"_by_{c}" for c in by]).agg(*[c.alias(n) for c, n in zip(counts, COUNTED, strict=True)], *sketches)
    return found.withColumnsRenamed({f"_by_{c}": c for c in by})


def profile_of_sketches(parts: DataFrame, by: list[str] = ()) -> DataFrame:
    """The columns of ``inventory_profile`` for all parts together, or per value of ``by``.

    Distinct counts are estimates within ``relative_error``.
    """
    united = [F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in DISTINCT]
    sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in COUNTED]
    return parts.groupBy(*by).agg(*sums, *united).select(*by, "total_records", *DISTINCT, *list(COUNTED)[1:])
