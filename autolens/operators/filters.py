"""Interactive filters and the options offered for them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import as_ntz
from . import schema as S
from .frequency import top_values, value_counts
from .local import local_table


def _moment(value: Any) -> Column:
    """A date bound as midnight of that day, a timestamp as it is."""
    if isinstance(value, (dt.date, dt.datetime)):
        return F.lit(value.isoformat()).cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def in_range(c: Column, start: Any, end: Any, inclusive_day: bool = False) -> Column:
    """Closed interval; either end may be None. Null dates are outside.

    An end date means its midnight, so later rows of that day drop out unless
    `inclusive_day` is set.
    """
    condition = c.isNotNull()
    if start is not None:
        condition = condition & (c >= _moment(start).cast("timestamp_ntz"))
    if end is not None:
        stop = _moment(end)
        condition = condition & (
            (c < stop + F.expr("interval 1 day")) if inclusive_day else (c <= stop)
        )
    return condition


def equals_any(c: Column, data_type: T.DataType, values: Sequence[Any]) -> Column:
    """IN with the values brought to the column's type, so that pushdown works
    and `5` matches 5.0; a value that does not fit the type matches nothing."""
    if S.is_text(data_type):
        return c.isin([str(v) for v in values])
    if S.is_boolean(data_type):
        words = {"true": True, "false": False}
        return c.isin([words[str(v).lower()] for v in values if str(v).lower() in words] or [None])
    if S.is_numeric(data_type):
        # As literals of the column's own type: `0.1` is a FLOAT for a FLOAT column and an
        # exact decimal for a DECIMAL one, and the filter reaches the scan.
        known = [n for v in values if (n := _number(v, data_type)) is not None]
        return c.isin(*[F.lit(n).try_cast(data_type) for n in known]) if known else F.lit(False) & c.isNotNull()
    return c.isin(*[F.lit(str(v)).try_cast(data_type) for v in values])


def _number(value: Any, data_type: T.DataType) -> str | None:
    """The number as text, to be cast to the column's type; None if it cannot be one of its values."""
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    if not number.is_finite():
        return None
    if S.is_integer(data_type) or isinstance(data_type, T.DecimalType):
        # A cast would round to a value that was not asked for.
        places = getattr(data_type, "scale", 0)
        if number.normalize().as_tuple().exponent < -places:
            return None
    return str(int(number)) if S.is_integer(data_type) else f"{number:f}"


def predicate(df: DataFrame, state: Mapping[str, Any], inclusive_day: bool = False) -> Column | None:
    """The conjunction of all active filters; unknown columns and None are ignored.

    Date columns take a `(start, end)` pair, any column a list (empty: no filter)
    or a single value.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    result = None
    for name, value in state.items():
        if name not in fields or value is None:
            continue
        data_type = fields[name]
        if isinstance(value, (list, tuple, set)):
            values = list(value)
            if S.is_date(data_type) and len(values) == 2:
                part = in_range(col(name), values[0], values[1], inclusive_day)
            elif not values:
                continue
            else:
                part = equals_any(col(name), data_type, values)
        else:
            part = equals_any(col(name), data_type, [value])
        result = part if result is None else result & part
    return result


def apply_filters(df: DataFrame, state: Mapping[str, Any], inclusive_day: bool = False) -> DataFrame:
    condition = predicate(df, state, inclusive_day)
    return df if condition is None else df.where(condition)


def filter_options(df: DataFrame, columns: Sequence[str], limit: int = K.FILTER_VALUES) -> DataFrame:
    """`(column, type, rank, value, count, min, max)`: the range of date columns, and
    the `limit` most frequent values of all others."""
    known = [c for c in columns if c in df.columns]
    dates = [c for c in known if S.is_date(df.schema[c].dataType)]
    others = [c for c in known if c not in dates]
    shape = "column string, type string, rank int, value string, count bigint, min string, max string"
    result = local_table(df.sparkSession, [], shape)
    if dates:
        ranges = [
            F.struct(
                F.lit(c).alias("column"),
                F.min(as_ntz(col(c))).cast("date").cast("string").alias("min"),
                F.max(as_ntz(col(c))).cast("date").cast("string").alias("max"),
            )
            for c in dates
        ]
        result = result.unionByName(
            df.agg(F.array(*ranges).alias("r")).select(F.inline("r")).where("min is not null")
            .withColumn("type", F.lit("date")),
            allowMissingColumns=True,
        )
    if others:
        result = result.unionByName(
            top_values(df, value_counts(df, others), limit).withColumn("type", F.lit("categorical")),
            allowMissingColumns=True,
        )
    return result
