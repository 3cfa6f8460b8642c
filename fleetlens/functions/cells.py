"""Column expressions on single cells: blanks, keys, dates, names and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"

#: Texts that differ in case or in spaces at the end are equal, and are sorted as equals.
CASE_BLIND = "UTF8_LCASE_RTRIM"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def under(column: Column | str, collation: str | None) -> Column:
    """A text column that is compared, grouped, joined and sorted under ``collation`` from here on."""
    c = _c(column)
    return c if collation is None else F.collate(c, collation)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_blank(column: Column | str) -> Column:
    """NULL or the empty string."""
    c = _c(column)
    return c.isNull() | (c == "")


def not_blank(column: Column | str) -> Column:
    c = _c(column)
    return c.isNotNull() & (c != "")


def key_or_unknown(column: Column | str, fold: bool = False) -> Column:
    """Location key part with a default. ``fold`` ignores case and trailing spaces."""
    c = F.coalesce(_c(column), F.lit(UNKNOWN))
    return F.lower(F.rtrim(c)) if fold else c


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(_c(column).cast("string"), F.lit(""))


def joined_key(*columns: Column | str, sep: str = "") -> Column:
    """Concatenation in which NULL counts as empty text."""
    return F.concat_ws(sep, *[text_or_empty(c) for c in columns])


def contains(column: Column | str, text: str, case_sensitive: bool = False) -> Column:
    """Literal substring test; NULL stays NULL."""
    c = _c(column)
    if case_sensitive:
        return c.contains(text)
    return F.lower(c).contains(text.lower())


def clean_timestamp(column: Column | str) -> Column:
    """Text to timestamp; empty and unreadable text become NULL."""
    return F.nullif(_c(column), F.lit("")).try_cast("timestamp_ntz")


DATE_FORMATS = (
    "M/d/yyyy", "yyyy/M/d", "yyyyMMdd", "MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy",
    "d-MMM-yyyy", "M-d-yyyy", "M/d/yy", "yyyy.M.d",
)


def read_date(column: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Readable dates, anything else NULL."""
    c = F.nullif(F.trim(_c(column)), F.lit(""))
    # Eight digits are a day without marks, not the year that a cast would take them for.
    iso = F.when(~c.rlike("^[0-9]{5,}$"), c.try_cast("date"))
    # No format fits a text without digits, and each that is tried in vain costs an exception.
    parsed = [iso, *[F.try_to_date(c, fmt) for fmt in formats]]
    return F.when(c.rlike("[0-9]"), F.coalesce(*parsed))


def clean_date_text(column: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Readable dates as ``yyyy-MM-dd`` text, anything else NULL."""
    return F.date_format(read_date(column, formats), "yyyy-MM-dd")


def day_of(column: Column | str) -> Column:
    """Date part of a timestamp or of ISO text."""
    return F.substring(_c(column).cast("string"), 1, 10).try_cast("date")


def laptop_name(column: Column | str, exact: bool = False, case_sensitive: bool = False) -> Column:
    """Names holding "laptop" lose quotes and inner spaces and get one space before "Laptop".

    ``exact`` keeps the leading space that a plain ``Laptop`` gets from this rule.
    """
    c = _c(column)
    bare = F.regexp_replace(c, '[" ]', "")
    spaced = F.regexp_replace(bare, "Laptop" if case_sensitive else "(?i)laptop", " Laptop")
    return F.when(contains(c, "Laptop", case_sensitive), spaced if exact else F.trim(spaced)).otherwise(c)


def loaner_flag(
    asset_type: Column | str, notes: Column | str, case_sensitive: bool = False
) -> Column:
    """True for the type "Loaner Laptop" and for notes that mention a loaner."""
    kind = _c(asset_type)
    named = kind == "Loaner Laptop" if case_sensitive else F.lower(kind) == "loaner laptop"
    return F.coalesce(named, F.lit(False)) | F.coalesce(
        contains(notes, "loaner", case_sensitive), F.lit(False)
    )


def percent_text(part: Column, whole: Column) -> Column:
    """``0%``, ``12.5%``, ``33.33%``: two decimals without trailing zeros."""
    share = F.when(whole > 0, F.round(part.cast("double") / whole * 100, 2)).otherwise(F.lit(0.0))
    digits = F.regexp_replace(F.format_string("%.2f", share), r"\.?0+$", "")
    return F.concat(digits, F.lit("%"))


def overdue(due: Column | str, as_of: Column) -> Column:
    """Strictly before ``as_of``; no due date is never overdue."""
    return F.coalesce(_c(due) < as_of, F.lit(False))


def log_text(column: Column | str, boolean: bool = False) -> Column:
    """A value as the change log spells it; NULL stays NULL."""
    c = _c(column)
    if boolean:
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def display(column: Column | str, fallback: str = "") -> Column:
    return F.coalesce(_c(column).cast("string"), F.lit(fallback))


def location_label(site: Column | str, room: Column | str) -> Column:
    """``site - room``."""
    return F.concat(_c(site), F.lit(" - "), _c(room))


def location_ref(location_id: Column | str) -> Column:
    return F.concat(F.lit("LOC_"), _c(location_id).cast("string"))
