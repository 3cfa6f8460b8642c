"""Room categories: ordered rules on the room name, the first match decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.cells import any_of, contains

# The words that decide a category, in the order they are tried.
NINE_RULES = [
    (["Cubicle"], "Workspace"),
    (["Office"], "Workspace"),
    (["Conference"], "Meeting Space"),
    (["Storage"], "Storage"),
    (["Server"], "IT Infrastructure"),
    (["IT"], "IT Infrastructure"),
    (["Restroom", "Toilet"], "Facilities"),
    (["Kitchen", "Break"], "Common Area"),
    (["Corridor", "Hallway"], "Circulation"),
]
FOUR_RULES = [
    (["Cubicle"], "Cubicle"),
    (["Office"], "Office"),
    (["Storage"], "Storage"),
    (["Server"], "Server Room"),
]
OTHER = "Other"


def room_category(
    room_name: Column | str, rules: list[tuple[list[str], str]] = NINE_RULES, case_sensitive: bool = False
) -> Column:
    """Category of a room; NULL and unmatched names are ``Other``."""
    category = None
    for words, label in rules:
        hit = any_of([contains(room_name, w, case_sensitive) for w in words])
        category = F.when(hit, label) if category is None else category.when(hit, label)
    return category.otherwise(OTHER)
