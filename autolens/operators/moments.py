"""Numeric moments of many columns in one scan and one tiny shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.scalars import finite
from .local import local_table

# Aggregates per job; wider aggregations would leave generated code behind.
COLUMNS_PER_PASS = 40


def sample_skewness(n: Column, skew: Column, variance: Column) -> Column:
    """Bias-corrected skewness from the population form; 0 for a constant column."""
    corrected = skew * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(variance == 0, 0.0).otherwise(corrected))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(column, count, missing, sum, mean, min, max, std, variance, skewness)` per column.

    Sample standard deviation and variance; NaN and infinities count as missing.
    """
    result = None
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = _moments(df, columns[start : start + COLUMNS_PER_PASS])
        result = part if result is None else result.unionByName(part)
    return result if result is not None else _moments(df, [])


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if not columns:
        return local_table(
            df.sparkSession, [],
            "column string, count bigint, missing bigint, sum double, mean double, min double, "
            "max double, std double, variance double, skewness double",
        )
    # Flat aggregates over plain columns; anything else leaves the generated code.
    values = df.select(*[finite(col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    sums = []
    for i in range(len(columns)):
        sums += [
            F.count(f"v{i}").alias(f"n{i}"), F.sum(f"v{i}").alias(f"sum{i}"),
            F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}"),
            F.var_samp(f"v{i}").alias(f"var{i}"), F.skewness(f"v{i}").alias(f"skew{i}"),
        ]
    row = values.agg(F.count(F.lit(1)).alias("rows"), *sums)
    structs = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"n{i}").alias("count"),
            (F.col("rows") - F.col(f"n{i}")).alias("missing"),
            F.col(f"sum{i}").alias("sum"),
            F.try_divide(f"sum{i}", f"n{i}").alias("mean"),
            F.col(f"min{i}").alias("min"),
            F.col(f"max{i}").alias("max"),
            F.sqrt(f"var{i}").alias("std"),
            F.col(f"var{i}").alias("variance"),
            sample_skewness(F.col(f"n{i}").cast("double"), F.col(f"skew{i}"), F.col(f"var{i}")).alias("skewness"),
        )
        for i, name in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))
