"""Importing device sheets: header-bearing text files, checked row by row."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.cells import clean_date_text, is_blank, read_date
from fleetlens.operators.quality import QualityError
from fleetlens.operators.skew import join_checked
from fleetlens.schemas import IMPORT_ALIASES, IMPORT_COLUMNS, IMPORT_OPTIONAL, IMPORT_REQUIRED
from fleetlens.sources.storage import stored

DATE_COLUMNS = ["date_assigned", "date_decommissioned"]
# Number of the first data row: the header is row 1 of its sheet.
FIRST_DATA_ROW = 2
MALFORMED = "wrong number of cells: "


def check_required(columns: list[str], required: list[str] = IMPORT_REQUIRED) -> list[str]:
    """Required columns that are missing."""
    return [c for c in required if c not in columns]


def read_headers(spark: SparkSession, path: str | list[str]) -> dict[str, list[str]]:
    """The header line of every sheet, with the files that have it."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    # One line per file, like the list of the files themselves.
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("line")).collect()
    headers: dict[str, list[str]] = {}
    for row in sorted(first):
        headers.setdefault(row.line.removeprefix("\ufeff"), []).append(row.file)
    return headers


def read_import(
    spark: SparkSession, path: str | list[str], aliases: dict[str, str] = IMPORT_ALIASES
) -> DataFrame:
    """Read sheets, each under its own header; absent optional columns are NULL.

    ``source_row`` is the row's number in its file, where the header is row 1. Files are split over
    many tasks: rows are numbered inside each split, and a table with one row per split says how
    many rows stand before it. A row with more or fewer cells than its header is kept as text in
    ``malformed``.
    """
    sheets = [_read_sheets(spark, files, header, aliases) for header, files in read_headers(spark, path).items()]
    if not sheets:
        raise QualityError("No sheet has a header")
    raw = reduce(DataFrame.unionByName, sheets)
    # Split positions are only good within one read, so the text is read once and kept as columns.
    placed = stored(raw.withColumn("_at", F.monotonically_increasing_id()), "sheet")
    splits = placed.groupBy("source_file", "_block").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    line = Window.partitionBy("source_file").orderBy("_block")
    before = stored(
        splits.select("source_file", "_block", "_first", (F.sum("_rows").over(line) - F.col("_rows")).alias("_before")),
        "splits",
    )
    numbered = join_checked(placed, before, ["source_file", "_block"], "inner", ["_at"])
    return numbered.select(
        *IMPORT_COLUMNS,
        (F.col("_before") + F.col("_at") - F.col("_first") + FIRST_DATA_ROW).alias("source_row"),
        "source_file",
        "malformed",
    )


def _read_sheets(spark: SparkSession, files: list[str], header: str, aliases: dict[str, str]) -> DataFrame:
    """Sheets with the same header line."""
    found = next(csv.reader([header]), [])
    names = [aliases.get(c.strip(), c.strip()) for c in found]
    missing = check_required(names)
    if missing:
        raise QualityError(
            f"Missing required columns: {', '.join(missing)}. Found columns: {', '.join(found)}. Sheet: {files[0]}"
        )
    twice = sorted({n for n in names if n in IMPORT_COLUMNS and names.count(n) > 1})
    if twice:
        raise QualityError(f"Columns given twice: {', '.join(twice)}. Sheet: {files[0]}")
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed", "columnPruning": False}
    raw = spark.read.schema(T.StructType([*fields, T.StructField("malformed", T.StringType())])).options(**options).csv(files)
    cells = [F.col(f"c{names.index(c)}").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in IMPORT_COLUMNS]
    place = [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block")]
    return raw.select(*cells, *place, "malformed")


def _date_problem(column: str) -> Column:
    unreadable = ~is_blank(F.trim(column)) & read_date(column).isNull()
    return F.when(unreadable, F.concat(F.lit(f"unreadable {column}: "), F.col(column)))


def import_rows(df: DataFrame, required_values: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted rows, rejected rows with the reason, and both counts. One bad row stops no other.

    An empty cell is a missing value, in every column. A row with the wrong number of cells is rejected
    for that alone, as its cells cannot be told apart.
    """
    checks = [_date_problem(c) for c in DATE_COLUMNS]
    if required_values:
        checks += [F.when(is_blank(c), F.lit(f"missing {c}")) for c in IMPORT_REQUIRED]
    reason = F.nullif(F.concat_ws("; ", *checks), F.lit(""))
    if "malformed" in df.columns:
        reason = F.when(F.col("malformed").isNotNull(), F.concat(F.lit(MALFORMED), F.col("malformed"))).otherwise(reason)
    judged = df.withColumn("reason", reason)

    place = [c for c in ("source_file", "source_row") if c in df.columns]
    texts = [c for c in IMPORT_COLUMNS if c not in DATE_COLUMNS]
    accepted = judged.where("reason IS NULL").select(
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in texts],
        *[clean_date_text(c).alias(c) for c in DATE_COLUMNS],
        *place,
    )
    serial = F.when(F.col("malformed").isNull(), F.col("serial_number")) if "malformed" in df.columns else F.col("serial_number")
    rejected = judged.where("reason IS NOT NULL").select(*place, serial.alias("serial_number"), "reason")
    # The reason stands in one place of the plan, so each date is read once.
    summary = judged.agg(F.count("*").alias("rows"), F.count("reason").alias("error_count")).select(
        (F.col("rows") - F.col("error_count")).alias("success_count"), "error_count"
    )
    return accepted, rejected, summary


