"""Sort the columns of a table by Spark type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.names import col
from ..functions.scalars import clean_value

_SCALAR = (
    T.NumericType, T.StringType, T.CharType, T.VarcharType, T.BooleanType,
    T.DateType, T.TimestampType, T.TimestampNTZType,
)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_date(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType))


def is_boolean(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.BooleanType)


def is_integer(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.IntegralType)


def is_supported(data_type: T.DataType) -> bool:
    """Arrays, maps, structs and binary have no analysis defined on them."""
    return isinstance(data_type, _SCALAR)


def columns_where(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def supported_columns(df: DataFrame) -> list[str]:
    return columns_where(df, is_supported)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN means "missing" in every operator; Spark would sort it above all numbers."""
    return df.select(*[clean_value(f.name, f.dataType, col(f.name)) for f in df.schema.fields])
