"""Outlier fences, counts and row flags. Outliers are never removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import finite
from .moments import moments
from .quantiles import quantiles
from .local import collected, local_table


def fences(stats: DataFrame, quarts: DataFrame) -> DataFrame:
    """`(column, n, method, lower, upper)`; one row per column with enough values.

    Quartile fences, or three standard deviations around the mean where the
    quartiles coincide.
    """
    spread = F.col("q75") - F.col("q25")
    usable_std = F.col("std") > 0
    return (
        stats.select("column", "count", "mean", "std")
        .join(F.broadcast(quarts.select("column", "q25", "q75")), "column")
        .where(F.col("count") >= K.OUTLIER_MIN_VALUES)
        .select(
            "column",
            F.col("count").alias("n"),
            F.when(spread > 0, "iqr").when(usable_std, "zscore").otherwise("none").alias("method"),
            F.when(spread > 0, F.col("q25") - 1.5 * spread)
            .when(usable_std, F.col("mean") - 3 * F.col("std")).alias("lower"),
            F.when(spread > 0, F.col("q75") + 1.5 * spread)
            .when(usable_std, F.col("mean") + 3 * F.col("std")).alias("upper"),
            "mean", "std",
        )
    )


def outlier_counts(
    df: DataFrame, columns: Sequence[str],
    stats: DataFrame | None = None, quarts: DataFrame | None = None,
) -> DataFrame:
    """`(column, n, method, lower, upper, count, percentage)` for every column with 8 values or more."""
    if not columns:
        return local_table(df.sparkSession, [], "column string, n bigint, method string, lower double, upper double, count bigint, percentage double"
        )
    stats = stats if stats is not None else moments(df, columns)
    quarts = quarts if quarts is not None else quantiles(df, columns, {"q25": 0.25, "q75": 0.75})
    bounds, table = collected(fences(stats, quarts))
    table = table.drop("mean", "std")
    found = [_flag(r).cast("bigint") for r in bounds]
    if not bounds:
        return table.select("*", F.lit(0).cast("bigint").alias("count"), F.lit(0.0).alias("percentage"))
    pairs = [
        F.struct(F.lit(r["column"]).alias("column"), F.coalesce(F.sum(f), F.lit(0)).alias("count"))
        for r, f in zip(bounds, found)
    ]
    counts = df.agg(F.array(*pairs).alias("c")).select(F.inline("c"))
    return table.join(F.broadcast(counts), "column").select(
        "*", (100.0 * F.col("count") / F.col("n")).alias("percentage")
    )


def _flag(bound):
    """Outlier test of one column as an expression; the z-score test is on the ratio."""
    v = finite(col(bound["column"]))
    if bound["method"] == "iqr":
        return (v < bound["lower"]) | (v > bound["upper"])
    if bound["method"] == "zscore":
        return (F.abs(v - bound["mean"]) / bound["std"]) > 3
    return F.lit(False)


def analyze_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that have outliers."""
    return outlier_counts(df, columns).where("count > 0")


def flag_outliers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The table with a boolean `<column>_outlier` per column; null values are not outliers."""
    bounds = fences(moments(df, columns), quantiles(df, columns, {"q25": 0.25, "q75": 0.75})).collect()
    flags = {r["column"]: _flag(r) for r in bounds}
    return df.select(
        "*",
        *[F.coalesce(flags.get(c, F.lit(False)), F.lit(False)).alias(f"{c}_outlier") for c in columns],
    )
