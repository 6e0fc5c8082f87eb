"""Histogram bins and box statistics computed where the rows are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from .grouping import numeric_value
from .quantiles import quantiles
from .local import local_table, pinned

QUARTILES = {"q25": 0.25, "median": 0.50, "q75": 0.75}


def histogram(df: DataFrame, columns: Sequence[str], bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """`(column, bin, lower, upper, count)`: equal-width bins, empty ones included.

    The last bin holds the maximum. A first scan finds the ranges, a second one
    counts; `bins` rows per column and task are shuffled.
    """
    values = {c: numeric_value(df, c) for c in columns}
    ranges = df.agg(
        *[F.min(v).alias(f"lo{i}") for i, v in enumerate(values.values())],
        *[F.max(v).alias(f"hi{i}") for i, v in enumerate(values.values())],
    ).first()
    frame = []
    cells = {}
    for i, (c, v) in enumerate(values.items()):
        low, high = ranges[f"lo{i}"], ranges[f"hi{i}"]
        if low is None:
            continue
        width = (high - low) / bins
        count = bins if width > 0 else 1
        frame.append((i, c, low, width, count))
        place = F.least(F.floor((v - low) / F.lit(width)), F.lit(count - 1)) if width > 0 else F.lit(0)
        # `least` passes over nulls.
        cells[f"b{i}"] = F.when(v.isNotNull(), place).cast("int")
    layout = local_table(df.sparkSession, frame, "i int, column string, low double, width double, bins int"
    ).select("i", "column", "low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    if not cells:
        counts = layout.select("i", "bin", F.lit(0).cast("bigint").alias("count"))
    else:
        counts = (
            df.select(*[e.alias(n) for n, e in cells.items()])
            .unpivot([], list(cells), "b", "bin")
            .where(F.col("bin").isNotNull())
            .groupBy("b", "bin")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.substring("b", 2, 9).cast("int").alias("i"), "bin", "count")
        )
    # Both sides have at most `bins` rows per column.
    return layout.join(F.broadcast(counts), ["i", "bin"], "left").select(
        "column", "bin",
        (F.col("low") + F.col("width") * F.col("bin")).alias("lower"),
        (F.col("low") + F.col("width") * (F.col("bin") + 1)).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def largest_groups(df: DataFrame, x: str, k: int = K.CHART_CATEGORIES) -> DataFrame:
    """The rows of the k groups with most rows; null groups are dropped."""
    keyed = df.where(col(x).isNotNull())
    # Found once, for all the passes that read the rows.
    top = pinned(keyed.groupBy(col(x)).count().orderBy(F.desc("count"), col(x).asc()).limit(k)).select(col(x))
    return keyed.join(F.broadcast(top) if k <= K.CHART_CATEGORIES else top, x, "left_semi")


def box_statistics(df: DataFrame, y: str, x: str | None = None, k: int = K.CHART_CATEGORIES) -> DataFrame:
    """Quartiles, whiskers, mean and outliers of y, per group of x (the k largest).

    Whiskers end at the outermost values within 1.5 interquartile ranges.
    """
    value = numeric_value(df, y)
    if x is None:
        rows = df.select(F.lit("all").alias("x"), value.alias("y"))
    else:
        rows = largest_groups(df.select(col(x).alias("x"), value.alias("y")).where("y is not null"), "x", k)
    rows = rows.where(F.col("y").isNotNull())
    quarts = quantiles(rows, ["y"], QUARTILES, by=["x"], max_groups=k)
    spread = F.col("q75") - F.col("q25")
    bounds = quarts.select(
        F.col("x").alias("bx"), "q25", "median", "q75",
        (F.col("q25") - 1.5 * spread).alias("low"), (F.col("q75") + 1.5 * spread).alias("high"),
    )
    inside = F.col("y").between(F.col("low"), F.col("high"))
    # A row for each of the k groups, which is broadcast while Spark finds it small.
    return (
        rows.join(bounds, F.col("x") == F.col("bx"))
        .groupBy("x", "q25", "median", "q75")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.avg("y").alias("mean"),
            F.min(F.when(inside, F.col("y"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
        )
        .select(
            F.col("x").alias(x or "group"), "count", "mean", "whisker_low", "q25", "median", "q75",
            "whisker_high", "outliers",
        )
    )


def box_tables(df: DataFrame, metrics: Sequence[str], x: str | None = None, k: int = K.CHART_CATEGORIES) -> DataFrame:
    """`box_statistics` of several metrics at once: `(metric, key, count, mean, ...)`.

    The groups are the k with the most rows, for all metrics the same; every pass reads
    all metrics.
    """
    names = [f"m{i}" for i in range(len(metrics))]
    values = [numeric_value(df, m).alias(n) for m, n in zip(metrics, names)]
    rows = df.select((col(x) if x else F.lit("all")).alias("x"), *values)
    if x:
        rows = largest_groups(rows, "x", k)
    quarts = quantiles(rows, names, QUARTILES, by=["x"], max_groups=k)
    spread = F.col("q75") - F.col("q25")
    bounds = pinned(quarts).select(
        F.col("x").alias("bx"), F.col("column").alias("bm"), "q25", "median", "q75",
        (F.col("q25") - 1.5 * spread).alias("low"), (F.col("q75") + 1.5 * spread).alias("high"),
    )
    inside = F.col("y").between(F.col("low"), F.col("high"))
    metric = F.element_at(F.array(*[F.lit(m) for m in metrics]), F.substring("m", 2, 9).cast("int") + 1)
    # A row for each metric and group.
    return (
        rows.unpivot(["x"], names, "m", "y").where("y is not null")
        .join(bounds, (F.col("x") == F.col("bx")) & (F.col("m") == F.col("bm")))
        .groupBy("m", "x", "q25", "median", "q75")
        .agg(
            F.count(F.lit(1)).alias("count"), F.avg("y").alias("mean"),
            F.min(F.when(inside, F.col("y"))).alias("whisker_low"), F.max(F.when(inside, F.col("y"))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"),
        )
        .select(
            metric.alias("metric"), F.col("x").cast("string").alias("key"), "count", "mean", "whisker_low", "q25", "median",
            "q75", "whisker_high", "outliers",
        )
    )
