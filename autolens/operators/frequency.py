"""The value-frequency table: a count per column and value that answers distinct
counts, missing counts, modes, top-k lists and parse ratios for all columns at once.

`groupBy(column, value)` combines on the map side, so a value that fills a third
of the table costs one row per task, and the pairs spread over all reducers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.names import col, name_in
from ..functions.scalars import parse_number, strip
from .local import collected, pinned
from .staging import stage

# Longer strings are grouped by their SHA-256 with the facts we need of them, so
# that whole texts are looked at but not shuffled.
LONG_TEXT = 256
# A long string that is mostly white space may still be a date.
LONG_PROBE = 64
# So much of a string is kept to put equally frequent ones in order.
START = 32


def _family(data_type: T.DataType) -> str:
    """Columns of a family are counted together, in their own type."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, T.DoubleType):
        return "double"
    if isinstance(data_type, (T.CharType, T.VarcharType)):
        return "string"
    return data_type.simpleString()


def families(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The columns by family, in table order."""
    result: dict[str, list[str]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            result.setdefault(_family(f.dataType), []).append(f.name)
    return result


def family_rows(df: DataFrame, columns: Sequence[str], family: str) -> tuple[DataFrame, Column]:
    """`(v, value)` with a row per cell, and the name of the column that `v` stands for."""
    values = []
    for i, c in enumerate(columns):
        v = col(c).cast(family)
        if family in ("double", "float"):
            v = F.when(~F.isnan(v), v + F.lit(0.0).cast(family))
        values.append(v.alias(f"v{i}"))
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("v", 2, 9).cast("int") + 1)
    rows = df.select(*values).unpivot([], [f"v{i}" for i in range(len(columns))], "v", "value")
    return rows, name


def _counted(df: DataFrame, columns: Sequence[str], family: str) -> DataFrame:
    """Counts of one family; text for display is made of the distinct values only."""
    rows, name = family_rows(df, columns, family)
    keys: list[Column] = [F.col("v")]
    value = F.col("value")
    if family == "string":
        is_long = F.length(value) > LONG_TEXT
        stripped = strip(value)
        facts = F.struct(
            F.length(value).alias("length"),
            parse_number(value).isNotNull().alias("numeric"),
            stripped.rlike(K.DATE_SEPARATOR_PATTERN).alias("separator"),
            F.when(F.length(stripped) <= LONG_PROBE, stripped).alias("probe"),
            F.substring(value, 1, START).alias("start"),
        )
        keys += [
            F.when(is_long, F.sha2(value, 256)).otherwise(value).alias("value"),
            F.when(is_long, facts).alias("long"),
        ]
    else:
        keys.append(value)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    long = counted["long"] if family == "string" else None
    nothing = {"length": "int", "numeric": "boolean", "separator": "boolean", "probe": "string", "start": "string"}
    return counted.select(
        name.alias("column"),
        value.cast("string").alias("value"),
        *[
            (long[k] if long is not None else F.lit(None).cast(t)).alias(f"long_{k}")
            for k, t in nothing.items()
        ],
        "n",
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`(column, value, long_length, long_numeric, long_separator, long_probe, long_start, n)`; null is a value.

    The `long_*` fields are set only where `value` is a digest; `top_values` gives the
    strings themselves. Columns of one type
    share a scan and a shuffle, so numbers and times travel as such and not as text.
    """
    parts = [_counted(df, names, family) for family, names in families(df, columns).items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def summarize_counts(counts: DataFrame) -> DataFrame:
    """`(column, non_null, missing, nunique)` from a frequency table."""
    present = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("non_null"),
        F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("missing"),
        F.count("value").alias("nunique"),
    )


def modes(df: DataFrame, counts: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """`(column, mode, mode_count)`: the most frequent value, the smallest of equals."""
    return top_values(df, counts, 1, columns).select(
        "column", F.col("value").alias("mode"), F.col("count").alias("mode_count")
    )


def top_values(df: DataFrame, counts: DataFrame, k: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The k most frequent values per column of `df`, computed now; ties in value order.

    `rank <= k` on a row number lets Spark cut each partition to k rows per column
    before the shuffle. Long strings are known by digest and first characters. Equally
    frequent values are put in order by these first, and a long one comes first of those
    that agree so far: if none gets among the k, the others are right. A column where one
    does is settled with the strings themselves, fetched from `df` for the digests that may
    still win.
    """
    present = counts.where(F.col("value").isNotNull())
    if columns is not None:
        present = present.where(name_in(F.col("column"), columns))
    is_long = F.col("long_length").isNotNull()
    present = present.select(
        "column", "value", "n", is_long.alias("is_long"), F.coalesce("long_start", F.substring("value", 1, START)).alias("start")
    )

    def first_k(rows: DataFrame, *order: Column) -> DataFrame:
        by = Window.partitionBy("column").orderBy(F.desc("n"), *order)
        return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("column", "rank", "value", F.col("n").alias("count"), "is_long")

    rows, winners = collected(first_k(present, F.asc("start"), F.desc("is_long"), F.asc("value")))
    long = sorted({r["column"] for r in rows if r["is_long"]})
    winners = winners.drop("is_long")
    if not long:
        return winners
    possible = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("start"))
    open_rows = stage(present.where(name_in(F.col("column"), long)).withColumn("place", F.rank().over(possible)).where(F.col("place") <= k))
    cells, name = family_rows(df, long, "string")
    digests = open_rows.where("is_long").select("column", F.col("value").alias("digest"), "n")
    texts = (
        cells.where(F.length("value") > LONG_TEXT)
        .select(name.alias("column"), "value", F.sha2("value", 256).alias("digest"))
        .join(digests, ["column", "digest"])
        .groupBy("column", "digest", "n").agg(F.first("value").alias("value"))
    )
    strings = open_rows.where("NOT is_long").select("column", "value", "n").unionByName(texts.select("column", "value", "n"))
    settled = pinned(first_k(strings.withColumn("is_long", F.lit(True)), F.asc("value")).drop("is_long"))
    return winners.where(~name_in(F.col("column"), long)).unionByName(settled)


def distinct_rows(df: DataFrame) -> DataFrame:
    """One row `(rows, distinct_rows, missing_cells)`; nulls are equal, NaN is null.

    Long strings are compared by digest. The grouping combines on the map side, so
    a row with very many copies costs one record per task, and since copies share
    their nulls the same grouping also counts the missing cells.
    """
    keys = [_row_key(f.name, f.dataType).alias(f"k{i}") for i, f in enumerate(df.schema.fields)]
    names = [f"k{i}" for i in range(len(keys))]
    nulls = sum((F.col(k).isNull().cast("bigint") for k in names), F.lit(0).cast("bigint"))
    copies = F.col("copies")
    return (
        df.select(*keys)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum(copies), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("distinct_rows"),
            F.coalesce(F.sum(copies * nulls), F.lit(0)).alias("missing_cells"),
        )
    )


def _row_key(name: str, data_type: T.DataType) -> Column:
    c = col(name)
    if isinstance(data_type, T.StringType):
        # A digest has 64 characters and a plain value at most 63: no mix-up.
        return F.when(F.length(c) > 63, F.sha2(c, 256)).otherwise(c)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(data_type, T.MapType):
        return F.sort_array(F.map_entries(c))
    return c
