"""Searching, filtering, sorting, paging and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.cells import all_of, any_of, contains, day_of, text_or_empty, under
from fleetlens.operators.collation import group_under, join_under
from fleetlens.operators.locations import devices_per_location, with_location
from fleetlens.operators.ordering import assign_ids
from fleetlens.operators.skew import join_checked
from fleetlens.schemas import PAGE_COLUMNS
from fleetlens.sources.storage import stored

PAGE_SIZE = 25
KEYSET_PAGE_SIZE = 35
# A top-k keeps offset + page rows per task; beyond this depth rows are numbered over all tasks.
TOP_K_DEPTH = 100_000


def equals_given(df: DataFrame, collation: str | None = None, **wanted) -> DataFrame:
    """Equality on each column whose value was given; ``collation`` holds for texts."""
    return df.where(all_of([under(c, collation if isinstance(v, str) else None) == v for c, v in wanted.items() if v is not None]))


def lookup(df: DataFrame, keys: DataFrame, on: str, spread_by: list[str], collation: str | None = None) -> DataFrame:
    """Rows for a batch of keys."""
    wanted = stored(group_under(keys.where(F.col(on).isNotNull()), [on], collation, F.lit(1).alias("_one")).select(on), "keys")
    return join_under(df, wanted, [on], "left_semi", collation, spread_by)


def has_any(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(any_of([F.col(c).isNotNull() for c in columns]))


def loaner_candidates(inv: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Devices whose type or notes suggest that they are lent out.

    The id comes last in the order, so that rows without a tag do not all sort in one task.
    """
    hits = [contains("asset_type", w, case_sensitive) for w in ("Laptop", "Loaner")]
    hits += [contains("notes", w, case_sensitive) for w in ("loaner", "temp", "temporary")]
    columns = ["asset_type", "asset_tag", "site_name", "room_number", "room_name", "assigned_to", "notes"]
    return inv.where(any_of(hits)).orderBy("asset_type", "asset_tag", "inventory_id").select(*columns)


def search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows whose visible cells hold the term, case ignored. Empty cells take part as empty text."""
    text = F.concat_ws("\t", *[text_or_empty(c) for c in columns])
    return df.where(F.lower(text).contains(term.lower()))


def filter_inventory(
    df: DataFrame, contains_text: dict[str, str] | None = None, between: dict[str, tuple] | None = None
) -> DataFrame:
    """Substring per column and inclusive day ranges; an end that is None is open."""
    tests: list[Column] = [contains(c, t) for c, t in (contains_text or {}).items() if t]
    for column, (low, high) in (between or {}).items():
        day = day_of(column)
        if low is not None:
            tests.append(day >= F.lit(low).cast("date"))
        if high is not None:
            tests.append(day <= F.lit(high).cast("date"))
    return df.where(all_of(tests))


def sort_by(
    df: DataFrame, column: str, tie: list[str], desc: bool = False, is_date: bool = False, collation: str | None = None
) -> DataFrame:
    """Order by one column: missing dates as the epoch, missing text as empty.

    ``tie`` orders rows of equal value by something unique; without it a value that many rows share,
    such as a missing date, would be sorted in one task.
    """
    if is_date:
        value = F.coalesce(day_of(column), F.lit("1970-01-01").cast("date"))
    else:
        value = under(text_or_empty(column), collation)
    return df.orderBy(value.desc() if desc else value.asc(), *tie)


def distinct_sorted(df: DataFrame, column: str, collation: str | None = None) -> DataFrame:
    if collation is None:
        return df.select(column).distinct().orderBy(column)
    spelled = group_under(df.select(column).distinct(), [column], collation, F.lit(1).alias("_one"))
    return spelled.select(column).orderBy(under(column, collation))


def page_of(
    df: DataFrame, order: list[str], offset: int, n: int, collation: str | None = None, top_k_depth: int = TOP_K_DEPTH
) -> DataFrame:
    """Rows ``offset``..``offset + n`` in ascending ``order``, which must be unique; exact at any depth.

    Far down, only the order columns are sorted and stored, to find where the page begins; the
    wide rows are then filtered from there on. Under a collation the last column of ``order`` must
    tell rows apart that the others do not.
    """
    sorted_by = order_under(df, order, collation)
    if offset + n <= top_k_depth:
        return df.orderBy(*sorted_by).offset(offset).limit(n)
    keys = assign_ids(df.select(*[c.alias(name) for c, name in zip(sorted_by, order, strict=True)]), order, 0, "_row")
    begin = keys.where(F.col("_row") == offset).drop("_row").first()
    if begin is None:
        return df.limit(0)
    return df.where(not_before(sorted_by, list(begin))).orderBy(*sorted_by).limit(n)


def order_under(df: DataFrame, order: list[str], collation: str | None) -> list[Column]:
    """The columns of ``order``, texts under the collation."""
    return [under(c, collation if isinstance(df.schema[c].dataType, T.StringType) else None) for c in order]


def not_before(order: list[Column], values: list) -> Column:
    """True for rows at or behind ``values``, where NULL comes first."""
    at = F.lit(True)
    for column, value in reversed(list(zip(order, values, strict=True))):
        behind = column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))
        at = behind | (column.eqNullSafe(F.lit(value)) & at)
    return at


def inventory_page(
    inv: DataFrame,
    loc: DataFrame,
    page: int = 1,
    per_page: int = PAGE_SIZE,
    room_type: str | None = None,
    include_unlocated: bool = False,
    with_total: bool = True,
    collation: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """A page of linked devices by site, room and tag, and the numbers for the page footer.

    The total needs no join of the rows: devices are counted per location first.
    """
    places = equals_given(loc, collation, room_type=room_type)
    how = "left" if include_unlocated and room_type is None else "inner"
    rows = with_location(inv, places, how).select(*PAGE_COLUMNS)
    order = ["site_name", "room_number", "asset_tag", "inventory_id"]
    shown = page_of(rows, order, (page - 1) * per_page, per_page, collation)
    if not with_total:
        return shown, None
    if how == "left":
        total = inv.agg(F.count("*").alias("total_items"))
    else:
        total = places.join(devices_per_location(inv), "location_id").agg(
            F.coalesce(F.sum("_devices"), F.lit(0)).alias("total_items")
        )
    return shown, page_numbers(total, page, per_page)


def page_numbers(total: DataFrame, page: int, per_page: int) -> DataFrame:
    return total.select(
        "total_items",
        F.lit(page).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total_items") / per_page).alias("total_pages"),
    )


def page_boundary(df: DataFrame, column: str, offset: int, tie: str, top_k_depth: int = TOP_K_DEPTH) -> DataFrame:
    """Largest value among the first ``offset`` rows by ``column``, ``''`` if there is none."""
    if offset <= top_k_depth:
        first = df.select(column).orderBy(column).limit(offset)
    else:
        first = assign_ids(df.select(column, tie), [column, tie], 0, "_row").where(F.col("_row") < offset)
    return first.agg(F.coalesce(F.max(column), F.lit("")).alias("boundary"))


def keyset_page(
    df: DataFrame,
    after: str = "",
    per_page: int = KEYSET_PAGE_SIZE,
    after_id: int | None = None,
    column: str = "serial_number",
    tie: str = "inventory_id",
    collation: str | None = None,
) -> DataFrame:
    """The next rows after a key.

    Strict mode (no ``after_id``) skips rows that share the key of the last row shown. With
    ``after_id`` the pair (key, id) decides and nothing is skipped.
    """
    key = under(column, collation)
    beyond = key > after
    if after_id is not None:
        beyond = beyond | ((key == after) & (F.col(tie) > after_id))
    return df.where(beyond).orderBy(key, tie).limit(per_page)


def numbered_keyset_page(df: DataFrame, page: int, per_page: int = KEYSET_PAGE_SIZE) -> DataFrame:
    """A page by number in strict mode: the key behind the pages before, then the next rows."""
    after = page_boundary(df, "serial_number", (page - 1) * per_page, "inventory_id").first()[0]
    return keyset_page(df, after, per_page)


def sample_rows(df: DataFrame, n: int, seed: int = 0, key: str | None = None) -> DataFrame:
    """``n`` random rows. With a ``key`` the choice depends only on the key and the seed."""
    lot = F.rand(seed) if key is None else F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_lot", lot).orderBy("_lot").limit(n).drop("_lot")


def migrated_sample(
    eq: DataFrame, loc: DataFrame, n: int = 5, seed: int = 0, key: str | None = None, how: str = "inner"
) -> DataFrame:
    """Random equipment rows with their room type. The sample is drawn before the join."""
    wanted = eq if how == "left" else eq.where("location_id IS NOT NULL")
    columns = ["asset_tag", "site_name", "room_number", "room_name", "location_id", "asset_type", "assigned_to", "is_loaner", "notes"]
    if how != "left":
        wanted = join_checked(wanted, loc.select("location_id"), ["location_id"], "left_semi", ["asset_tag"])
    drawn = sample_rows(wanted.select(*columns), n, seed, key)
    joined = drawn.join(loc.select("location_id", "room_type"), "location_id", how)
    return joined.select(
        "asset_tag", "site_name", "room_number", "room_name", "room_type", "asset_type", "assigned_to", "is_loaner", "notes"
    )


