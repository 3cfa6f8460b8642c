"""Pages of any depth from rows that are stored in order once.

The rows are sorted over all tasks and written in pieces, and a directory with one row per piece
says how many rows come before it and with which key it begins. A page, its place among all pages,
and the key at any place are then found by reading the directory and one or two pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.browse import PAGE_SIZE, order_under, page_numbers

PIECE, AT = "_piece", "_at"
_ROW_BITS = 33


class PageDirectory:
    """Ordered rows under ``path``, as ``build`` has written them."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.pieces = spark.read.parquet(f"{path}/directory")
        # Files without rows, which hold the types.
        kinds = spark.read.parquet(f"{path}/columns").schema
        self.rows = spark.read.schema(kinds).parquet(f"{path}/rows")
        self.columns = [c for c in kinds.fieldNames() if c not in (PIECE, AT)]

    @staticmethod
    def build(rows: DataFrame, order: list[str], path: str, pieces: int | None = None, collation: str | None = None) -> PageDirectory:
        """Sort ``rows`` by ``order`` (unique together, but for columns under the collation) and write them."""
        spark = rows.sparkSession
        by = order_under(rows, order, collation)
        ranged = rows.repartitionByRange(pieces, *by) if pieces else rows.repartitionByRange(*by)
        placed = ranged.sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
        place = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        placed = placed.select(*rows.columns, place.alias(AT), F.shiftright("_id", _ROW_BITS).alias(PIECE))
        placed.write.partitionBy(PIECE).parquet(f"{path}/rows")
        spark.createDataFrame([], placed.schema).coalesce(1).write.parquet(f"{path}/columns")
        written = spark.read.schema(placed.schema).parquet(f"{path}/rows")
        first = F.min_by(F.struct(*order), AT).alias("first_key")
        sizes = written.groupBy(PIECE).agg(F.count("*").alias("rows"), first)
        # One row per piece.
        before = F.sum("rows").over(Window.orderBy(PIECE)) - F.col("rows")
        sizes.select(PIECE, "rows", before.alias("before"), "first_key").coalesce(1).write.parquet(f"{path}/directory")
        return PageDirectory(spark, path)

    def total(self) -> DataFrame:
        return self.pieces.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total_items"))

    def numbers(self, page: int, per_page: int = PAGE_SIZE) -> DataFrame:
        """The numbers for the page footer, from the directory alone."""
        return page_numbers(self.total(), page, per_page)

    def between(self, first: int, last: int) -> DataFrame:
        """Rows ``first``..``last`` (counted from 0, ``last`` not included), in order, with their number as ``_at``."""
        # As many pieces as so few rows lie in.
        hit = self.pieces.where((F.col("before") < last) & (F.col("before") + F.col("rows") > first)).collect()
        found = self.rows.where(F.col(PIECE).isin([r[PIECE] for r in hit]))
        starts = F.lit(None).cast("long")
        for r in hit:
            starts = F.when(F.col(PIECE) == r[PIECE], F.lit(r["before"])).otherwise(starts)
        numbered = found.select(*self.columns, (starts + F.col(AT)).alias(AT))
        return numbered.where((F.col(AT) >= first) & (F.col(AT) < last)).orderBy(AT).limit(last - first)

    def page(self, page: int, per_page: int = PAGE_SIZE) -> DataFrame:
        """A page in order; empty behind the last one."""
        return self.between((page - 1) * per_page, page * per_page).select(*self.columns)

    def boundary(self, column: str, offset: int) -> DataFrame:
        """The value of ``column`` in the last of the first ``offset`` rows (of all, if fewer), ``''`` if there is none."""
        last = min(offset, self.total().first()[0])
        row = self.between(max(last - 1, 0), last)
        return row.agg(F.coalesce(F.max(column), F.lit("")).alias("boundary"))
