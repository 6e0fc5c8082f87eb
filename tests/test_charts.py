import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from autolens.operators import charts, distributions, filters, grouping, kpis, sampling
from autolens.operators.column_types import infer_types


@pytest.fixture(scope="module")
def many(spark):
    """50 groups of text, one of them null, one holding a third of the rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("x"),
        (F.col("id") % 97 + 0.5).alias("y"), (F.col("id") % 5).alias("n"),
    )


@pytest.mark.parametrize("how", ["sum", "count"])
def test_top_and_other_make_the_total(many, how):
    rows = grouping.top_groups(many, "x", "y", how, top_n=8).collect()
    assert len(rows) == 9 and rows[-1]["x"] == "Other" and rows[-1]["is_other"]
    total = many.agg(F.sum("y") if how == "sum" else F.count("y")).first()[0]
    assert sum(r["value"] for r in rows) == pytest.approx(total)


def test_other_is_not_confused_with_a_group_of_that_name(spark):
    df = spark.createDataFrame([("Other", 10.0), ("a", 5.0), ("b", 1.0), (None, 7.0)], "x string, y double")
    rows = [(r["x"], r["value"], r["is_other"]) for r in grouping.top_groups(df, "x", "y", top_n=2).collect()]
    assert rows == [("Other", 10.0, False), (None, 7.0, False), ("Other", 6.0, True)]


def test_null_group_counts_as_a_group(many):
    assert grouping.group_aggregate(many, "x", "y").where("x is null").count() == 1
    assert grouping.top_groups(many, "x").where("x is null").count() <= 1


def test_no_other_for_zero_and_no_key_for_other_types(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("c", -1.0)], "x string, y double")
    assert grouping.top_groups(df, "x", "y", top_n=1).count() == 1
    numeric = spark.range(10).select((F.col("id") % 5).alias("x"), F.col("id").alias("y"))
    rows = grouping.top_groups(numeric, "x", "y", top_n=2).collect()
    assert [(r["x"], r["value"], r["is_other"]) for r in rows] == [(4, 13, False), (3, 11, False), (None, 21, True)]


def test_text_values_are_numbers_or_dropped(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", "zz"), ("c", "2.5")], "k string, v string")
    assert {r["k"]: r["value"] for r in grouping.group_aggregate(df, "k", "v").collect()} == {"a": 1.0, "c": 2.5}
    assert {r["k"]: r["value"] for r in grouping.group_aggregate(df, "k", "v", "count").collect()} == {"a": 2, "b": 1, "c": 1}


def test_pooled_and_summed_other(spark):
    df = spark.createDataFrame([("a", 9.0), ("b", 1.0), ("b", 3.0), ("c", 1.0)], "x string, y double")
    pooled = grouping.top_groups(df, "x", "y", "mean", top_n=1).where("is_other").first()["value"]
    summed = grouping.top_groups(df, "x", "y", "mean", top_n=1, other="summed").where("is_other").first()["value"]
    assert pooled == pytest.approx(5 / 3) and summed == 3.0


def test_category_extremes_with_many_categories(many):
    row = grouping.category_extremes(many, ["x", "n"], "y").where("column = 'x'").first()
    known = many.where("x is not null").groupBy("x").agg(F.sum("y").alias("v")).orderBy(F.desc("v")).collect()
    assert (row["top_key"], row["bottom_value"], row["n_groups"]) == ("hot", known[-1]["v"], len(known))
    assert row["top3_share"] == pytest.approx(100 * sum(r["v"] for r in known[:3]) / sum(r["v"] for r in known))


def test_line_buckets_long_axes(spark):
    df = spark.range(200).select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id))").alias("d"), F.lit(1.0).alias("v"))
    rows = grouping.line_series(df, "d", "v").collect()
    assert len(rows) == 7 and sum(r["value"] for r in rows) == 200
    assert len(grouping.line_series(df.limit(100), "d", "v").collect()) == 4
    assert grouping.line_series(df, "d", "v", grain="day").count() == 200
    assert grouping.line_series(df, "d", "v", grain="raw", points=120).count() == 120
    assert [r["value"] for r in grouping.line_series(df, "d", "v", grain="year").collect()] == [200.0]
    with pytest.raises(ValueError):
        grouping.line_series(df, "d", "v", grain="week")
    years = spark.range(200).select(F.expr("timestamp_ntz'1900-01-01 00:00:00' + make_interval(0, int(id))").alias("d"), F.lit(1.0).alias("v"))
    assert sum(r["value"] for r in grouping.line_series(years, "d", "v").collect()) == 200


def test_histogram_counts_every_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.sqrt("id")).alias("v"), F.lit(4.0).alias("k"), F.lit(None).cast("double").alias("none"))
    rows = distributions.histogram(df, ["v", "k", "none"]).orderBy("column", "bin").collect()
    v = [r for r in rows if r["column"] == "v"]
    values = [i**0.5 for i in range(1000) if i % 10]
    counts, edges = np.histogram(values, bins=30)
    assert [r["count"] for r in v] == counts.tolist()
    assert [r["lower"] for r in v] == pytest.approx(edges[:-1].tolist())
    assert [(r["bin"], r["count"]) for r in rows if r["column"] == "k"] == [(0, 1000)]
    assert not [r for r in rows if r["column"] == "none"]


def test_box_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in list(range(20)) + [100]] + [("b", 1.0), (None, 5.0)], "x string, y double")
    rows = {r["x"]: r for r in distributions.box_statistics(df, "y", "x").collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["a"]["q25"], rows["a"]["median"], rows["a"]["q75"]) == (5.0, 10.0, 15.0)
    assert (rows["a"]["whisker_low"], rows["a"]["whisker_high"], rows["a"]["outliers"]) == (0.0, 19.0, 1)
    assert distributions.box_statistics(df, "y").first()["count"] == 23


def test_box_keeps_the_thirty_largest_groups(spark):
    df = spark.range(2000).select(F.concat(F.lit("g"), F.floor(F.sqrt("id"))).alias("x"), F.col("id").alias("y"))
    rows = distributions.box_statistics(df, "y", "x").collect()
    assert len(rows) == 30 and {r["x"] for r in rows} == {f"g{i}" for i in range(15, 45)}


def test_samples(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 7).alias("v"))
    one = sampling.stable_sample(df.repartition(3), 500, ["id"]).collect()
    two = sampling.stable_sample(df.repartition(11), 500, ["id"]).collect()
    assert len(one) == 500 and sorted(one) == sorted(two)
    assert sampling.stable_sample(df, 500).count() == 500
    assert sampling.stable_sample(df, 50000).count() == 20000
    hot = df.select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    assert sampling.stable_sample(hot, 500, ["k"]).count() == 500
    flagged = df.withColumn("flag", F.col("id") < 30)
    kept = sampling.anomaly_plot_rows(flagged, "flag", 100)
    assert kept.where("flag").count() == 30 and kept.count() == 130


def test_sample_is_uniform_over_copies(spark):
    df = spark.range(30000).select((F.col("id") % 3 == 0).alias("hot"))
    assert 0.25 < sampling.stable_sample(df, 3000).where("hot").count() / 3000 < 0.42


def test_scatter_drops_incomplete_pairs(spark):
    df = spark.createDataFrame([("1", 2.0, "r"), ("x", 3.0, "r"), ("4", None, "s")], "a string, b double, c string")
    assert [tuple(r) for r in sampling.scatter_points(df, "a", "b", "c").collect()] == [(1.0, 2.0, "r")]


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "a int, b int")
    same = spark.createDataFrame([(2, 2), (1, None), (None, 1)], "a int, b int").repartition(3)
    other = spark.createDataFrame([(2, 2), (1, None), (1, None)], "a int, b int")
    prints = [sampling.fingerprint(d).first()["fingerprint"] for d in (df, same, other)]
    assert prints[0] == prints[1] != prints[2]


def test_filters(spark):
    rows = [(dt.datetime(2024, 1, d, h), v, s, b) for d, h, v, s, b in
            [(1, 0, 5, "a", True), (2, 9, 7, "b", False), (2, 0, 5, "c", None), (3, 0, 8, "5", True)]]
    rows.append((None, None, None, None))
    df = spark.createDataFrame(rows, "d timestamp_ntz, n int, s string, b boolean")

    def count(state, **options):
        return filters.apply_filters(df, state, **options).count()

    assert count({}) == 5 and count({"nowhere": 1, "n": None, "s": []}) == 5
    assert count({"d": ("2024-01-01", "2024-01-02")}) == 2
    assert count({"d": ("2024-01-01", "2024-01-02")}, inclusive_day=True) == 3
    assert count({"d": (None, dt.date(2024, 1, 2))}) == 2 and count({"d": (dt.datetime(2024, 1, 2, 1), None)}) == 2
    assert count({"n": [5, 8]}) == 3 and count({"n": ["5", "x"]}) == 2 and count({"n": 5.0}) == 2
    assert count({"s": [5]}) == 1 and count({"s": "a"}) == 1
    assert count({"b": True}) == 2 and count({"b": ["False", "maybe"]}) == 1
    assert count({"n": 5, "s": ["a", "b"]}) == 1


def test_filter_reaches_the_scan(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    view = filters.apply_filters(orders, {"o_orderstatus": ["F"], "o_totalprice": 100})
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "EqualTo(o_totalprice,100.0)" in plan


def test_filter_options(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("s"), F.expr("date'2024-01-01' + int(id % 10)").alias("d"))
    rows = filters.filter_options(df, ["d", "s", "missing"]).collect()
    assert [(r["min"], r["max"]) for r in rows if r["type"] == "date"] == [("2024-01-01", "2024-01-10")]
    assert len([r for r in rows if r["type"] == "categorical"]) == 100


def test_kpis(spark):
    df = spark.createDataFrame([("a", 1.0, "1"), ("b", 3.0, "x"), (None, None, "4"), ("a", 8.0, None)], "c string, v double, t string")
    specs = [kpis.Kpi("rows", None, "count"), kpis.Kpi("c", "c", "count"), kpis.Kpi("u", "c", "nunique"), kpis.Kpi("m", "v", "median"),
             kpis.Kpi("t", "t", "sum"), kpis.Kpi("avg", "v", "mean"), kpis.Kpi("max", "v", "max"), kpis.Kpi("gone", "zz", "sum"), kpis.Kpi("odd", "v", "other")]
    rows = kpis.compute_kpis(df, specs).collect()
    assert [r["value"] for r in rows] == [4.0, 3.0, 2.0, 3.0, 5.0, 4.0, 8.0, None, 12.0]
    assert rows[7]["display"] == "N/A" and rows[0]["display"] == "4"
    empty = kpis.compute_kpis(df.where("false"), [kpis.Kpi("rows", None, "count"), kpis.Kpi("s", "v", "sum")]).collect()
    assert [r["value"] for r in empty] == [None, None]


def test_grouped_table_drops_null_keys(spark):
    df = spark.createDataFrame([("b", 1, 2.0), ("a", 2, None), (None, 3, 4.0), ("b", 5, 6.0)], "k string, n int, v double")
    rows = [tuple(r) for r in grouping.grouped_table(df, "k", ["k", "n", "v"], "sum").collect()]
    assert rows == [("a", 2, None), ("b", 6, 8.0)]
    assert grouping.grouped_table(df, "k", ["k"], "sum").count() == 4


def test_chart_specs(many):
    for kind in ("bar", "column", "pie", "donut", "map"):
        assert charts.chart_data(many, charts.ChartSpec(kind, "x", "y")).count() > 0
    assert charts.chart_data(many, charts.ChartSpec("table", columns=("y", "zz"))).columns == ["y"]
    assert charts.chart_data(many, charts.ChartSpec("heatmap")).count() == 4
    assert charts.chart_data(many, charts.ChartSpec("histogram", "y")).count() == 30
    assert charts.chart_data(many, charts.ChartSpec("scatter", "y", "n")).count() == 3000
    assert charts.chart_data(many, charts.ChartSpec("bar", "nowhere", "y")) is None
    assert charts.chart_data(many, charts.ChartSpec("spiral", "x", "y")) is None


def test_chart_datasets(many):
    small = many.withColumn("f", F.col("n") > 2)
    tables = charts.chart_datasets(small, infer_types(small), "detailed")
    assert set(tables) == {"aggregates", "histogram", "box", "scatter", "heatmap", "table"}
    total = tables["aggregates"].where("chart = 'bar' and dimension = 'x' and metric = 'y'").agg(F.sum("value")).first()[0]
    assert total == pytest.approx(small.agg(F.sum("y")).first()[0])


def test_eligibility(many):
    rows = {r["column"]: r for r in kpis.eligibility(many, infer_types(many)).collect()}
    assert rows["x"]["can_group"] and not rows["x"]["can_pie"] and rows["x"]["can_filter"]
    assert rows["y"]["can_measure"] and not rows["y"]["can_group"]


def test_fingerprint_of_a_map(spark):
    one = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT NULL")
    two = spark.sql("SELECT map('b', 2, 'a', 1) AS m UNION ALL SELECT NULL")
    assert sampling.fingerprint(one).first() == sampling.fingerprint(two).first()
    assert sampling.fingerprint(one).first() != sampling.fingerprint(two.where("m is not null")).first()
