"""Cell functions on the awkward values."""

from datetime import datetime

from fleetlens.functions import cells
from fleetlens.functions.taxonomy import FOUR_RULES, NINE_RULES, room_category
from pyspark.sql import functions as F


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def texts(spark, make, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[1] for r in df.select("i", make("x")).orderBy("i").collect()]


def test_blank(spark):
    assert texts(spark, cells.is_blank, [None, "", " ", "a"]) == [True, True, False, False]
    assert texts(spark, cells.not_blank, [None, "", " ", "a"]) == [False, False, True, True]


def test_nine_rules(spark):
    names = ["Kitchen", "IT Desk", None, "Office Storage", "Toilet", "Corridor", "Break", "Lobby", "conference"]
    assert texts(spark, room_category, names) == [
        "IT Infrastructure", "IT Infrastructure", "Other", "Workspace", "Facilities", "Circulation", "Common Area",
        "Other", "Meeting Space",
    ]


def test_nine_rules_case_sensitive(spark):
    names = ["Kitchen", "IT Desk", None, "office storage"]
    got = texts(spark, lambda c: room_category(c, NINE_RULES, True), names)
    assert got == ["Common Area", "IT Infrastructure", "Other", "Other"]


def test_four_rules(spark):
    got = texts(spark, lambda c: room_category(c, FOUR_RULES), ["Office Storage", "Server Closet", "Kitchen", ""])
    assert got == ["Office", "Server Room", "Other", "Other"]


def test_laptop_names(spark):
    names = ['14" Laptop', "Laptop", "Loaner Laptop", "Dell 5 laptop", "Dock", None]
    assert texts(spark, cells.laptop_name, names) == ["14 Laptop", "Laptop", "Loaner Laptop", "Dell5 Laptop", "Dock", None]
    exact = texts(spark, lambda c: cells.laptop_name(c, exact=True), names)
    assert exact == ["14 Laptop", " Laptop", "Loaner Laptop", "Dell5 Laptop", "Dock", None]
    sensitive = texts(spark, lambda c: cells.laptop_name(c, case_sensitive=True), names)
    assert sensitive[3] == "Dell 5 laptop"


def test_percent_text(spark):
    df = spark.createDataFrame([(0, 0, 5), (1, 1, 8), (2, 5, 5), (3, 1, 3), (4, 0, 0), (5, 1, 10)], "i int, a long, b long")
    got = [r[0] for r in df.orderBy("i").select(cells.percent_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["0%", "12.5%", "100%", "33.33%", "0%", "10%"]


def test_dates(spark):
    values = ["2024-01-14", "", "n/a", None, "1/2/2024", "2024/3/4", " 2024-05-06 ", "2024-01-14 10:11:12"]
    assert texts(spark, cells.clean_date_text, values) == [
        "2024-01-14", None, None, None, "2024-01-02", "2024-03-04", "2024-05-06", "2024-01-14",
    ]
    stamps = texts(spark, cells.clean_timestamp, values[:4])
    assert stamps == [datetime(2024, 1, 14), None, None, None]


def test_overdue(spark):
    as_of = F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")
    dues = [datetime(2024, 1, 20), None, datetime(2024, 1, 19, 23, 59, 59)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dues)], "i int, d timestamp_ntz")
    assert [r[0] for r in df.orderBy("i").select(cells.overdue("d", as_of)).collect()] == [False, False, True]


def test_keys(spark):
    df = spark.createDataFrame([("A", "1B"), ("A1", "B"), (None, "X")], "s string, r string")
    assert df.select(cells.joined_key("s", "r")).distinct().count() == 2
    assert df.select(cells.joined_key("s", "r", sep="-")).distinct().count() == 3
    assert one(spark, cells.key_or_unknown("x"), None) == "Unknown"
    assert one(spark, cells.key_or_unknown("x", fold=True), "North  ") == "north"


def test_log_and_display_texts(spark):
    assert one(spark, cells.log_text("x", True), True, "boolean") == "True"
    assert one(spark, cells.log_text("x", True), None, "boolean") is None
    assert one(spark, cells.log_text("x"), 5, "long") == "5"
    assert one(spark, cells.display("x", "N/A"), None) == "N/A"
    assert one(spark, cells.location_ref("x"), 7, "long") == "LOC_7"
    assert one(spark, cells.loaner_flag(F.lit("LOANER laptop"), "x"), None) is True
    assert one(spark, cells.loaner_flag(F.lit(None).cast("string"), "x"), "a Loaner") is True
    assert one(spark, cells.loaner_flag(F.lit(None).cast("string"), "x", True), "a Loaner") is False
