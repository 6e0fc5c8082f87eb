import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from autolens.functions import names, scalars


def values(spark, function, items, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, " + schema)
    rows = df.select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_parse_number(spark):
    items = ["1,234.50", "$5", " 10% ", "-3", "+.5", "1e3", "$ 7", "1d", "1f", "0x1", "abc", "", "NaN", "1 2", None]
    assert values(spark, scalars.parse_number, items) == [
        1234.5, 5.0, 10.0, -3.0, 0.5, 1000.0, 7.0, None, None, None, None, None, None, None, None
    ]


def test_parse_boolean(spark):
    items = ["Yes", " no", "T", "f", "1", "0", "ON", "off\t", "maybe", "", None]
    assert values(spark, scalars.parse_boolean, items) == [
        True, False, True, False, True, False, True, False, None, None, None
    ]


def test_parse_date(spark):
    day = dt.datetime(2024, 1, 5)
    items = {
        "2024-01-05": day, "2024/1/5": day, " 1/5/2024 ": day, "13/01/2024": dt.datetime(2024, 1, 13),
        "1/13/24": dt.datetime(2024, 1, 13), "5/6/71": dt.datetime(1971, 5, 6),
        "2024-01-05T10:30:00Z": dt.datetime(2024, 1, 5, 10, 30), "2024-01-05 10:30": dt.datetime(2024, 1, 5, 10, 30),
        "1/5/2024 3:07 PM": dt.datetime(2024, 1, 5, 15, 7), "1/5/2024 12:07:09 am": dt.datetime(2024, 1, 5, 0, 7, 9),
        "Jan 5, 2024": day, "5 January 2024": day, "5-Jan-2024": day, "January 2024": dt.datetime(2024, 1, 1),
        "Sept 3rd, 2023": dt.datetime(2023, 9, 3), "31.12.2023": dt.datetime(2023, 12, 31),
        "2024-03": dt.datetime(2024, 3, 1), "10:30": None, "20240105": None, "2024-02-30": None,
        "02/30/2024": None, "hello": None, "x 2024-01-05": None, "99/99/9999": None, "": None,
    }
    assert values(spark, scalars.parse_date, list(items)) == list(items.values())


def test_finite(spark):
    items = [1.5, float("nan"), float("inf"), float("-inf"), None, -0.0]
    result = values(spark, scalars.finite, items, "v double")
    assert result == [1.5, None, None, None, None, 0.0]
    assert math.copysign(1, result[-1]) == 1


def test_display_number(spark):
    items = [1234567890.0, 2.5e6, 1234.0, 999.4, 120.0, 7.0, 0.456, -3500.0, None, float("nan")]
    assert values(spark, scalars.display_number, items, "v double") == [
        "1.23B", "2.50M", "1.23K", "999", "120", "7", "0.46", "-3.50K", "N/A", "N/A"
    ]


def test_display_percent(spark):
    assert values(spark, scalars.display_percent, [12.34, 0.0, None], "v double") == ["12.3%", "0.0%", "N/A"]


def test_correlation_labels(spark):
    items = [0.7, -0.4, 0.2, 0.1, 0.0, None]
    assert values(spark, scalars.correlation_strength, items, "v double") == [
        "strong", "moderate", "weak", "very weak", "very weak", None
    ]
    assert values(spark, scalars.correlation_direction, items, "v double") == [
        "positive", "negative", "positive", "positive", "none", None
    ]


def test_shorten(spark):
    assert values(spark, lambda c: scalars.shorten(c, 6), ["abcdef", "abcdefg", None]) == ["abcdef", "abc...", None]


def test_priority_band(spark):
    items = [95.0, 70.0, 50.0, 30.0, 10.0, None, 0.0]
    assert values(spark, scalars.priority_band, items, "v double") == [
        "critical", "important", "supporting", "optional", "low", "supporting", "supporting"
    ]


def test_elapsed_days_floors(spark):
    rows = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 23:00:00' AS a, timestamp_ntz'2024-01-03 01:00:00' AS b"
    )
    assert rows.select(scalars.elapsed_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_labels(spark):
    row = spark.sql("SELECT timestamp_ntz'2024-03-09 10:11:12.5' AS t").select(
        scalars.month_label(F.col("t")), scalars.year_label(F.col("t")), scalars.iso_timestamp(F.col("t")),
        scalars.month_start(F.col("t")),
    ).first()
    assert list(row) == ["2024-03", "2024", "2024-03-09T10:11:12.500000", dt.date(2024, 3, 1)]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("id", True), ("order_id", True), ("idx", False), ("user_id_2", True), ("paid", False), ("Invoice No", True),
     ("Order ID", True), ("o_orderkey", False), ("uuid", True)],
)
def test_identifier_names(name, expected):
    assert names.is_identifier_name(name) is expected


def test_name_classes():
    assert names.is_metric_name("Total Sales") and not names.is_metric_name("colour")
    assert names.is_date_name("Monday") and not names.is_date_name("region")
    assert names.is_geo_name("Country")
    assert names.is_average_name("avg_price") and names.is_class_target_name("Churned")


def test_unique_names():
    assert names.unique_names([" a  b ", "A B", "a b", "", None, "c"]) == [
        "a b", "A B_1", "a b_2", "column", "None", "c"
    ]
    assert names.unique_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
