"""Descriptive statistics per semantic type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col, is_average_name, is_metric_name, name_in
from ..functions.scalars import as_ntz, elapsed_days, iso_timestamp, month_label
from .frequency import modes, summarize_counts, top_values, value_counts
from .moments import moments
from .quantiles import approximate_quantiles, quantiles
from .staging import stage
from .local import local_table

QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.50, "q75": 0.75, "q95": 0.95}


def analyze_numerical(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Count, centre, spread, bias-corrected skewness and five quantiles per column."""
    find = approximate_quantiles if approx else quantiles
    quants = find(df, columns, QUANTILES).drop("n")
    return (
        moments(df, columns)
        .where("count > 0")
        .select("column", "count", "missing", "mean", "min", "max", "std", "variance", "skewness", "sum")
        .join(F.broadcast(quants), "column")  # one row per column
    )


def categorical_summary(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Number of categories and the dominant one with its count and share."""
    counts = counts if counts is not None else stage(value_counts(df, columns))
    frequent = modes(df, counts, columns)  # one row per column
    return summarize_counts(counts).join(F.broadcast(frequent), "column").select(
        "column",
        F.col("nunique").alias("n_categories"),
        F.col("mode").alias("dominant_category"),
        F.col("mode_count").alias("dominant_count"),
        (100.0 * F.col("mode_count") / F.col("non_null")).alias("dominant_percentage"),
    )


def categorical_distribution(
    df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None, k: int = K.CHART_CATEGORIES
) -> DataFrame:
    """The k most frequent categories per column with their share."""
    counts = counts if counts is not None else stage(value_counts(df, columns))
    totals = summarize_counts(counts).select("column", "non_null")
    return (
        top_values(df, counts, k, columns)
        .join(F.broadcast(totals), "column")  # one row per column
        .select("column", "rank", "value", "count", (100.0 * F.col("count") / F.col("non_null")).alias("percentage"))
    )


def _date_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    dates = df.select(*[as_ntz(col(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    named = [F.when(F.col("d") == f"d{i}", c) for i, c in enumerate(columns)]
    return (
        dates.unpivot([], [f"d{i}" for i in range(len(columns))], "d", "at")
        .where(F.col("at").isNotNull())
        .select(F.coalesce(*named).alias("column"), "at")
    )


def analyze_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Earliest, latest and days between, per date column."""
    return _date_rows(df, columns).groupBy("column").agg(
        iso_timestamp(F.min("at")).alias("earliest"),
        iso_timestamp(F.max("at")).alias("latest"),
        elapsed_days(F.min("at"), F.max("at")).alias("time_span_days"),
    )


def date_counts(df: DataFrame, columns: Sequence[str], months: int = K.DATE_MONTHS) -> DataFrame:
    """Rows per year, and per month for the last `months` that have rows.

    `(column, granularity, period, count)`; empty periods are not filled in.
    """
    monthly = (
        _date_rows(df, columns)
        .groupBy("column", month_label(F.col("at")).alias("month"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    latest = Window.partitionBy("column").orderBy(F.desc("month"))
    recent = (
        monthly.withColumn("age", F.row_number().over(latest))
        .where(F.col("age") <= months)
        .select("column", F.lit("month").alias("granularity"), F.col("month").alias("period"), "count")
    )
    years = (
        monthly.groupBy("column", F.substring_index("month", "-", 1).alias("period"))
        .agg(F.sum("count").alias("count"))
        .select("column", F.lit("year").alias("granularity"), "period", "count")
    )
    return recent.unionByName(years)


def business_metrics(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Preferred aggregation, mean and sum per numerical column, ranked metric-like first, then by |sum|."""
    stats = stats if stats is not None else moments(df, columns)
    metric = name_in(F.col("column"), [c for c in columns if is_metric_name(c)])
    average = name_in(F.col("column"), [c for c in columns if is_average_name(c)])
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column"))
    total = F.abs(F.coalesce("sum", F.lit(0.0)))
    # One row per column of the table.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("is_metric_like"), F.desc(total), position)
    return (
        stats.select(
            "column",
            F.when(metric & ~average, "sum").otherwise("mean").alias("preferred_aggregation"),
            "mean",
            F.coalesce("sum", F.lit(0.0)).alias("sum"),
            metric.alias("is_metric_like"),
        )
        .withColumn("rank", F.row_number().over(order))
        .orderBy("rank")
    )


def important_columns(
    stats: DataFrame, categories: DataFrame, dates: Sequence[str], identifiers: Sequence[str],
    numerical: Sequence[str], categorical: Sequence[str], k: int | None = None, k_dates: int | None = None,
) -> DataFrame:
    """`(kind, rank, column)`: numerical, categorical, date and identifier columns by importance.

    `k` cuts the numerical and the categorical ranking, `k_dates` the date columns.

    Numerical columns come metric-like first, then by |mean| + |std|; categories
    with 2 to 60 values come in ascending number of values.
    """
    def position(names: Sequence[str]):
        return F.array_position(F.array(*[F.lit(c) for c in names]), F.col("column"))

    spark = stats.sparkSession
    parts = []
    if numerical:
        metric = name_in(F.col("column"), [c for c in numerical if is_metric_name(c)])
        weight = F.abs(F.coalesce("mean", F.lit(0.0))) + F.abs(F.coalesce("std", F.lit(0.0)))
        parts.append(
            stats.where("count > 0").select(
                F.lit("numerical").alias("kind"), "column",
                F.struct((~metric).alias("a"), (-weight).alias("b"), position(numerical).alias("c")).alias("key"),
            )
        )
    if categorical:
        parts.append(
            categories.where(F.col("n_categories").between(2, 2 * K.CHART_CATEGORIES)).select(
                F.lit("categorical").alias("kind"), "column",
                F.struct(
                    F.lit(False).alias("a"), F.col("n_categories").cast("double").alias("b"),
                    position(categorical).alias("c"),
                ).alias("key"),
            )
        )
    named = [("date", i, c) for i, c in enumerate(dates[:k_dates])]
    named += [("identifier", i, c) for i, c in enumerate(identifiers)]
    result = local_table(spark, [(kind, i + 1, c) for kind, i, c in named], "kind string, rank int, column string"
    )
    for part in parts:
        # One row per column of the table.
        order = Window.partitionBy("kind").orderBy("key")
        ranked = part.withColumn("rank", F.row_number().over(order))
        if k is not None:
            ranked = ranked.where(F.col("rank") <= k)
        result = result.unionByName(ranked.select("kind", "rank", "column"))
    return result
