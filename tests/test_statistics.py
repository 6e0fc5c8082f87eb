import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from autolens.operators import correlation, gram, moments, outliers, statistics, trends


@pytest.fixture(scope="module")
def numbers(spark):
    generator = np.random.default_rng(7)
    n = 500
    pdf = pd.DataFrame({
        "a": generator.normal(10, 3, n), "skewed": generator.exponential(2, n), "whole": generator.integers(0, 50, n).astype(float),
        "constant": 3.0, "gap": generator.normal(0, 1, n),
    })
    pdf["b"] = pdf["a"] * 2 + generator.normal(0, 1, n)
    pdf.loc[pdf.index % 7 == 0, "gap"] = None
    pdf.loc[pdf.index % 5 == 0, "whole"] = None
    return pdf, spark.createDataFrame(pdf)


def test_moments_match_pandas(numbers):
    pdf, df = numbers
    found = {r["column"]: r for r in moments.moments(df, list(pdf.columns)).collect()}
    for c in pdf.columns:
        s = pdf[c]
        assert found[c]["count"] == s.count() and found[c]["missing"] == s.isna().sum()
        for name, value in (("mean", s.mean()), ("std", s.std()), ("variance", s.var()), ("skewness", s.skew()), ("sum", s.sum())):
            assert found[c][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (c, name)


def test_numerical_analysis_quantiles(numbers):
    pdf, df = numbers
    found = {r["column"]: r for r in statistics.analyze_numerical(df, ["a", "gap"]).collect()}
    for c in ("a", "gap"):
        for name, p in statistics.QUANTILES.items():
            assert found[c][name] == pytest.approx(pdf[c].quantile(p), rel=1e-12)


def test_skewness_of_few_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    found = {r["column"]: r for r in moments.moments(df, ["a", "b"]).collect()}
    assert found["a"]["skewness"] is None and found["b"]["count"] == 0 and found["b"]["sum"] is None
    assert [r["column"] for r in statistics.analyze_numerical(df, ["a", "b"]).collect()] == ["a"]


def test_correlation_is_pairwise_complete(numbers):
    pdf, df = numbers
    wanted = pdf.corr()
    pairs = correlation.pair_correlations(df, list(pdf.columns)).collect()
    found = {(r["column_1"], r["column_2"]): r["r"] for r in pairs}
    assert all("constant" not in pair for pair in found) and len(found) == 10
    for (a, b), r in found.items():
        assert r == pytest.approx(wanted.loc[a, b], abs=1e-10)


def test_correlation_constant_on_common_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, 9.0)], "a double, b double")
    assert correlation.pair_correlations(df, ["a", "b"]).collect() == []


def test_copies_are_skipped_but_multiples_are_not(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") * -3.0).alias("c"))
    rows = correlation.correlations(df, ["a", "b", "c"]).collect()
    assert [(r["column_1"], r["column_2"], r["correlation"], r["direction"]) for r in rows] == [
        ("a", "c", -1.0, "negative"), ("b", "c", -1.0, "negative")
    ]


def test_large_offset_does_not_cost_accuracy(spark):
    generator = np.random.default_rng(1)
    x = generator.normal(0, 1, 400)
    pdf = pd.DataFrame({"x": 1e9 + x, "y": -1e9 + x + generator.normal(0, 1, 400)})
    r = correlation.pair_correlations(spark.createDataFrame(pdf), ["x", "y"]).first()["r"]
    assert r == pytest.approx(pdf.corr().loc["x", "y"], abs=1e-6)


def test_all_columns_or_the_first_forty(spark):
    df = spark.range(200).select(*[F.rand(i).alias(f"c{i}") for i in range(45)])
    assert correlation.pair_correlations(df, df.columns).count() == 990
    assert correlation.pair_correlations(df, df.columns, limit=40).count() == 780


def test_outliers(spark):
    values = [float(v) for v in range(20)] + [500.0, None]
    df = spark.createDataFrame([(v, 5.0 if i else 5000.0, 1.0, 1.0 if i < 7 else None) for i, v in enumerate(values)],
                               "v double, z double, k double, few double")
    found = {r["column"]: r for r in outliers.outlier_counts(df, ["v", "z", "k", "few"]).collect()}
    assert set(found) == {"v", "z", "k"}
    q1, q3 = np.quantile([v for v in values if v is not None], [0.25, 0.75])
    assert found["v"]["method"] == "iqr" and found["v"]["count"] == 1
    assert found["v"]["lower"] == pytest.approx(q1 - 1.5 * (q3 - q1)) and found["v"]["upper"] == pytest.approx(q3 + 1.5 * (q3 - q1))
    assert found["z"]["method"] == "zscore" and found["z"]["count"] == 1
    assert found["k"]["method"] == "none" and found["k"]["count"] == 0 and found["k"]["lower"] is None
    flagged = outliers.flag_outliers(df, ["v", "few"])
    assert flagged.where("v_outlier").count() == 1 and flagged.where("few_outlier").count() == 0
    assert [r["column"] for r in outliers.analyze_outliers(df, ["v", "k"]).collect()] == ["v"]


def test_categorical(spark):
    df = spark.createDataFrame([("b", True), ("a", True), ("a", None), ("b", False), (None, False)], "c string, f boolean")
    row = {r["column"]: r for r in statistics.categorical_summary(df, ["c", "f"]).collect()}
    assert (row["c"]["dominant_category"], row["c"]["dominant_count"], row["c"]["dominant_percentage"]) == ("a", 2, 50.0)
    assert (row["f"]["dominant_category"], row["f"]["n_categories"]) == ("false", 2)
    shares = statistics.categorical_distribution(df, ["c", "f"]).groupBy("column").sum("percentage").collect()
    assert [r[1] for r in shares] == [100.0, 100.0]


def months(spark, sums, start=2020):
    rows = [(dt.datetime(start + i // 12, i % 12 + 1, 15), v) for i, v in enumerate(sums) if v is not None]
    return spark.createDataFrame(rows, "d timestamp_ntz, v double")


def test_trend_ties_and_change(spark):
    row = trends.trend_summary(months(spark, [5.0, 9.0, 9.0, 2.0, 2.0]), "d", ["v"]).first()
    assert (row["best_period"], row["worst_period"]) == ("2020-02", "2020-04")
    assert row["pct_change_first_to_last"] == pytest.approx(-60.0)


def test_trend_first_month_zero_and_single_month(spark):
    assert trends.trend_summary(months(spark, [0.0, 4.0]), "d", ["v"]).first()["pct_change_first_to_last"] is None
    assert trends.trend_summary(months(spark, [4.0]), "d", ["v"]).collect() == []
    assert trends.trend_points(months(spark, [4.0]), "d", ["v"]).collect() == []


def test_trend_keeps_last_36_months_and_gaps(spark):
    values = [float(i) for i in range(40)]
    values[37] = None
    points = trends.trend_points(months(spark, values), "d", ["v"]).orderBy("period").collect()
    assert len(points) == 36 and points[-1]["period"] == "2023-04" and "2023-02" not in {p["period"] for p in points}


def test_all_null_month_is_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 3.0), (dt.datetime(2024, 2, 1), None)], "d timestamp_ntz, v double")
    row = trends.trend_summary(df, "d", ["v"]).first()
    assert row["worst_period"] == "2024-02" and row["worst_value"] == 0.0


def test_monthly_series_fills_gaps(spark):
    rows = trends.monthly_series(months(spark, [1.0, None, None, 4.0]), "d", "v").orderBy("idx").collect()
    assert [(r["idx"], r["value"]) for r in rows] == [(0, 1.0), (1, 0.0), (2, 0.0), (3, 4.0)]


def test_forecast_follows_a_line(spark):
    rows = trends.forecast_linear(months(spark, [10.0 + 2 * i for i in range(24)]), "d", "v").orderBy("period").collect()
    assert [r["period"] for r in rows] == [f"2022-{m:02d}-01" for m in range(1, 7)]
    assert [r["value"] for r in rows] == pytest.approx([10.0 + 2 * i for i in range(24, 30)])
    assert all(r["upper"] - r["lower"] == pytest.approx(0, abs=1e-6) for r in rows)


def test_forecast_against_numpy(spark):
    generator = random.Random(4)
    y = np.array([100 + i + generator.gauss(0, 5) for i in range(13)])
    df = months(spark, y.tolist())
    t = np.arange(13)
    slope, intercept = np.polyfit(t, y, 1)
    deviation = np.std(y - (intercept + slope * t))
    rows = trends.forecast_linear(df, "d", "v").orderBy("period").collect()
    assert len(rows) == 3
    for i, r in enumerate(rows):
        centre = intercept + slope * (13 + i)
        assert r["value"] == pytest.approx(centre) and r["upper"] == pytest.approx(centre + 1.96 * deviation)
    s, c = np.polyfit(t[:10], y[:10], 1)
    error = y[10:] - (c + s * t[10:])
    row = trends.forecast_metrics(df, "d", "v").first()
    assert row["mae"] == pytest.approx(np.abs(error).mean()) and row["rmse"] == pytest.approx(np.sqrt((error**2).mean()))
    assert row["r2"] == pytest.approx(1 - (error**2).sum() / ((y[10:] - y[10:].mean()) ** 2).sum())


@pytest.mark.parametrize(("n", "horizon"), [(5, 0), (6, 3), (16, 4), (24, 6), (60, 6)])
def test_forecast_horizon(spark, n, horizon):
    assert trends.forecast_linear(months(spark, [float(i % 7) for i in range(n)], 2010), "d", "v").count() == horizon


def test_dates(spark):
    df = months(spark, [1.0] * 30)
    row = statistics.analyze_dates(df, ["d"]).first()
    assert (row["earliest"], row["latest"]) == ("2020-01-15T00:00:00", "2022-06-15T00:00:00") and row["time_span_days"] == 882
    counts = statistics.date_counts(df, ["d"]).collect()
    assert len([r for r in counts if r["granularity"] == "month"]) == 24
    assert {r["period"]: r["count"] for r in counts if r["granularity"] == "year"} == {"2020": 12, "2021": 12, "2022": 6}


def test_business_metrics_and_important_columns(spark):
    df = spark.createDataFrame([(1.0, 10.0, 0.5, 3.0, "x"), (2.0, 20.0, 0.7, 900.0, "y")], "plain double, sales double, tax_rate double, other double, c string")
    columns = ["plain", "sales", "tax_rate", "other"]
    rows = statistics.business_metrics(df, columns).collect()
    assert [(r["column"], r["preferred_aggregation"]) for r in rows] == [
        ("sales", "sum"), ("tax_rate", "mean"), ("other", "mean"), ("plain", "mean")
    ]
    result = statistics.important_columns(
        moments.moments(df, columns), statistics.categorical_summary(df, ["c"]), ["d"] * 6, ["i"], columns, ["c"], k_dates=5
    )
    assert [(r["kind"], r["column"]) for r in result.where("kind <> 'date'").orderBy("kind", "rank").collect()] == [
        ("categorical", "c"), ("identifier", "i"), ("numerical", "sales"), ("numerical", "tax_rate"),
        ("numerical", "other"), ("numerical", "plain"),
    ]
    assert result.where("kind = 'date'").count() == 5


def test_many_pairs_by_matrix_products(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = rng.normal(1e6, 3, (3000, 26)) + rng.normal(0, 3, (3000, 1))
    values[rng.random(values.shape) < 0.3] = np.nan
    pdf = pd.DataFrame(values, columns=[f"a.{i}" for i in range(26)])
    pdf["gone"] = np.nan
    pdf["same"] = 4.0
    half = np.arange(3000) % 2
    pdf["first"] = np.where(half, rng.normal(size=3000), np.nan)
    pdf["second"] = np.where(half, 7.0, rng.normal(size=3000))  # constant where `first` is there
    pdf["other"] = np.where(half, np.nan, rng.normal(size=3000))  # never together with `first`
    df = spark.createDataFrame(pdf).repartition(5)
    varying = [c for c in pdf.columns if c not in ("gone", "same")]
    want = pdf[varying].corr()
    expected = {
        (a, b): want.loc[a, b] for i, a in enumerate(varying) for b in varying[i + 1 :]
        if (a, b) not in (("first", "second"), ("first", "other"))
    }
    for side in (1024, 10):  # one scan, or one for each two groups of columns
        monkeypatch.setattr(gram, "COLUMNS_PER_SIDE", side)
        got = {(r["column_1"], r["column_2"]): r["r"] for r in correlation.pair_correlations(df, list(pdf.columns)).collect()}
        assert got.keys() == expected.keys()
        assert all(abs(got[k] - r) < 1e-9 for k, r in expected.items())
    assert correlation.pair_correlations(df.limit(0), list(pdf.columns)).collect() == []
