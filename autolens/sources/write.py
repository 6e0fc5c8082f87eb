"""Sinks: tables as CSV, JSON or parquet, and a whole analysis as one folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col
from ..functions.scalars import iso_timestamp

# The sections an analysis summary consists of.
SUMMARY_SECTIONS = [
    "dataset_summary", "cleaning_report", "cleaning_actions", "quality", "important_columns",
    "strong_correlations", "business_metrics", "trends", "trend_points", "insights", "ml",
]


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header, one file per partition; white space around cells stays."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(**options).csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, timestamps and dates as ISO text."""
    def ready(name: str, data_type: T.DataType) -> Column:
        c = col(name)
        if isinstance(data_type, (T.DoubleType, T.FloatType)):
            return F.when(F.abs(c) < float("inf"), c).alias(name)
        if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
            return iso_timestamp(c).alias(name)
        return c.alias(name)

    return df.select(*[ready(f.name, f.dataType) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; nulls are kept as fields."""
    json_ready(df).write.option("ignoreNullFields", False).json(path)


def write_report(sections: Mapping[str, DataFrame], path: str, fmt: str = "json") -> list[str]:
    """Write every section to its own folder under `path`; returns the folders."""
    folders = []
    for name, table in sections.items():
        folder = f"{path.rstrip('/')}/{name}"
        if fmt == "json":
            write_json(table, folder)
        elif fmt == "csv":
            write_csv(table, folder)
        else:
            table.write.format(fmt).save(folder)
        folders.append(folder)
    return folders


def write_summary(sections: Mapping[str, DataFrame], path: str, fmt: str = "json") -> list[str]:
    """The sections of an analysis that make up its summary."""
    return write_report({k: v for k, v in sections.items() if k in SUMMARY_SECTIONS}, path, fmt)
