"""Device tables for the registered queries: derived on each use, or built once and stored."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.equipment import build_equipment
from fleetlens.operators.locations import assign_location, build_locations
from fleetlens.operators.ordering import assign_ids
from fleetlens.plans.derived import AS_OF, derive
from fleetlens.schemas import LOCATION_FIELDS
from fleetlens.sources.storage import new_path, stored
from fleetlens.sources.tables import next_id

_SEEN: dict[tuple[str, str], Tables] = {}


class Tables:
    """The tables a query may start from.

    Locations, the linked inventory and the equipment are stored tables in real use, so they are
    built once per session and input folder.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        return derive(self.spark, self.sf_dir, name)

    @property
    def inventory(self) -> DataFrame:
        return self.derived("inventory")

    @property
    def loans(self) -> DataFrame:
        return self.derived("loans")

    @cached_property
    def locations(self) -> DataFrame:
        return stored(build_locations(self.inventory), "locations")

    @cached_property
    def located(self) -> DataFrame:
        return stored(assign_location(self.inventory, self.locations), "located")

    @cached_property
    def equipment(self) -> DataFrame:
        return stored(build_equipment(self.located, self.locations, AS_OF)[0], "equipment")

    @cached_property
    def sheet_paths(self) -> list[str]:
        """Sheets in two orders of columns, and one in which some rows have too many or too few cells."""
        sheet, paths = self.derived("sheet"), [new_path(self.spark, f"sheet{i}") for i in range(3)]
        columns = [c for c in sheet.columns if c != "inventory_id"]
        sheet.where("inventory_id % 3 = 0").select(*columns).write.option("header", True).csv(paths[0])
        sheet.where("inventory_id % 3 = 1").select(*reversed(columns)).write.option("header", True).csv(paths[1])
        line = F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
        ragged = F.when(F.col("inventory_id") % 41 == 7, F.concat(line, F.lit(",more"))).otherwise(line)
        ragged = F.when(F.col("inventory_id") % 43 == 8, F.substring_index(line, ",", 3)).otherwise(ragged)
        plain = sheet.where("inventory_id % 3 = 2").select(ragged.alias(",".join(columns)))
        plain.write.options(header=True, sep="\u0001", escapeQuotes=False).csv(paths[2])
        return paths

    @cached_property
    def rooms(self) -> DataFrame:
        """The locations and more rooms, which no device is in."""
        vacant = assign_ids(self.derived("vacant"), ["room_number"], next_id(self.locations, "location_id"), "location_id")
        return stored(self.locations.unionByName(vacant), "rooms")

    def location_commands(self, name: str) -> DataFrame:
        given = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in LOCATION_FIELDS]))
        return self.derived(name).withColumn("given", given)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SEEN:
        _SEEN[key] = Tables(spark, sf_dir)
    return _SEEN[key]
