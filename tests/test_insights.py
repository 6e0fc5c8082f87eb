import datetime as dt

import pytest
from pyspark.sql import functions as F

from autolens.functions import constants as K
from autolens.operators.column_types import infer_types
from autolens.operators.filters import apply_filters
from autolens.operators.kpis import Kpi
from autolens.operators.charts import ChartSpec
from autolens.plans import analysis, insights
from autolens.plans.dashboard import TableSpec, dashboard


@pytest.fixture(scope="module")
def sales(spark):
    rows = []
    for i in range(60):
        month = i % 6 + 1
        region = "North" if i % 4 else ("South" if i % 8 else "West")
        revenue = 100.0 * month + (5000.0 if i == 59 else 0.0)
        rows.append((dt.datetime(2024, month, 1 + i % 20), region, revenue, revenue * 0.5, None if i < 6 else i))
    return spark.createDataFrame(rows, "day timestamp_ntz, region string, revenue double, cost double, extra int")


@pytest.fixture(scope="module")
def messages(sales):
    types = infer_types(sales)
    return [r["message"] for r in analysis.insights(sales, types).orderBy("seq").collect()]


def test_dataset_facts(messages):
    assert messages[0] == "Dataset contains 60 rows and 5 columns (3 numerical, 1 categorical, 1 date)."
    assert messages[1] == "Overall missing-value rate is 2.0% of all cells."


def test_category_facts(messages):
    assert messages[2] == "In 'region', 'North' is the dominant category (75.0% of records, 3 categories total)."
    assert messages[3] == "Values in 'region' are highly concentrated: 'North' alone accounts for 75.0%."
    assert messages[4].startswith("Highest 'revenue' by 'region' is 'North' at ")
    assert messages[5].startswith("Lowest 'revenue' by 'region' is ")
    assert messages[6] == "Top 3 'region' values contribute 100.0% of total 'revenue'."


def test_numeric_facts(messages):
    assert "'revenue' averages 433.33"[:20] in " ".join(messages)
    assert any(m.startswith("'revenue' is right-skewed (skewness=") for m in messages)
    assert "Total 'revenue' across the dataset is 26.00K." in messages


def test_correlation_trend_and_outlier_facts(messages):
    assert "Strongest relationship is between 'revenue' and 'cost' (Pearson r=1.0, strong positive)." in messages
    assert "Best month for 'revenue' is 2024-06 (11.00K)." in messages
    assert "Worst month for 'revenue' is 2024-01 (1.00K)." in messages
    assert "'revenue' increased by 1000.0% from the first to the latest period." in messages
    assert "Detected 1 unusual values in 'revenue' (1.7% via iqr). Outliers were flagged, not removed." in messages


def test_order_numbers_and_cap(sales):
    types = infer_types(sales)
    rows = analysis.insights(sales, types, limit=5).collect()
    assert [r["seq"] for r in rows] == [1, 2, 3, 4, 5]


def test_repeated_messages_keep_the_first(spark):
    facts = spark.createDataFrame(
        [(2, [1.0], "b", "s", 1.0, "same"), (1, [1.0], "a", "s", 1.0, "same"), (3, [1.0], "c", "s", None, "other"), (3, [2.0], "c", "s", None, " ")],
        insights.SHAPE,
    )
    rows = insights.insight_package([facts, None]).collect()
    assert [(r["seq"], r["type"], r["message"]) for r in rows] == [(1, "a", "same"), (2, "c", "other")]
    assert K.MAX_INSIGHTS == 40


def test_declining_metric_and_weak_correlations(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, m, 1), float(10 - m), float((m * 7) % 5)) for m in range(1, 9)], "d timestamp_ntz, a double, b double"
    )
    texts = [r["message"] for r in analysis.insights(df, infer_types(df)).collect()]
    assert "'a' declined by 77.8% from the first to the latest period." in texts
    assert len([t for t in texts if "orrelation" in t or "relationship" in t]) == 1


def test_sections(sales):
    sections = analysis.analyze(sales)
    assert set(sections) == {
        "dataset_summary", "quality", "numerical_analysis", "outliers", "business_metrics", "categorical_summary",
        "categorical_distribution", "date_analysis", "date_counts", "correlations", "strong_correlations", "trends",
        "trend_points", "important_columns",
    }
    assert sections["quality"].first()["missing_values"] == 6
    assert analysis.primary_metric(sections) == "revenue"


def test_sections_of_odd_tables(spark):
    only_text = spark.createDataFrame([("a",), ("b",), ("a",)], "c string")
    assert set(analysis.analyze(only_text)) == {
        "dataset_summary", "quality", "categorical_summary", "categorical_distribution", "important_columns"
    }
    assert analysis.insights(only_text, infer_types(only_text)).count() == 4
    one_number = spark.createDataFrame([(1.5,), (2.5,)], "x double")
    assert "correlations" not in analysis.analyze(one_number)
    assert analysis.insights(one_number, infer_types(one_number)).count() == 4


def test_dashboard_uses_the_filtered_view(sales):
    types = infer_types(sales)
    board = dashboard(
        sales, types, {"region": ["North"]}, [Kpi("n", None, "count"), Kpi("total", "revenue", "sum")],
        [ChartSpec("bar", "region", "revenue"), ChartSpec("line", "day", "revenue"), ChartSpec("box", "region", "cost")],
        [TableSpec(("revenue", "cost"), "region", "mean"), TableSpec(("day", "revenue"))],
    )
    view = apply_filters(sales, {"region": ["North"]})
    assert (board.rows, board.original_rows) == (45, 60)
    assert [r["value"] for r in board.kpis.collect()] == [45.0, view.agg(F.sum("revenue")).first()[0]]
    assert [r["region"] for r in board.charts[0].collect()] == ["North"]
    assert board.tables[0].count() == 1 and board.tables[1].columns == ["day", "revenue"]
    facts = board.facts().collect()
    assert 0 < len(facts) <= 25 and "45 rows" in facts[0]["message"]
    board.close()
    default = dashboard(sales, types)
    assert [r["name"] for r in default.kpis.collect()] == ["Total Records", "Total revenue", "Avg revenue", "Unique region"]
    default.close()
