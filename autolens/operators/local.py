"""Small driver-side tables (one row per column, group or bucket) as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(),
    "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()),
}


def local_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """`rows` under a `name type, name type` schema.

    Goes through Arrow, which needs no Python worker and no task per row.
    """
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    columns = [
        pa.array([row[i] for row in rows], type=_TYPES[kind]) for i, (_, kind) in enumerate(fields)
    ]
    return spark.createDataFrame(pa.table(columns, names=[name for name, _ in fields]))


def pinned(df: DataFrame) -> DataFrame:
    """A small result (rows per column, pair or month) computed now, so that the tables
    derived from it do not scan the data again."""
    return collected(df)[1].coalesce(1)


def collected(df: DataFrame) -> tuple[list[dict], DataFrame]:
    """Run `df` once: its rows on the driver and the same rows as a local table."""
    table = df.toArrow()
    return table.to_pylist(), df.sparkSession.createDataFrame(table, df.schema)
