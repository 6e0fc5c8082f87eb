"""Column profile and dataset summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import as_ntz, elapsed_days, iso_timestamp
from . import schema as S
from .column_types import approximate_statistics, column_types, infer_types, of_type
from .frequency import distinct_rows, modes, summarize_counts, top_values, value_counts
from .moments import moments
from .outliers import outlier_counts
from .quantiles import quantiles
from .staging import stage
from .local import local_table, pinned

QUARTILES = {"q25": 0.25, "median": 0.50, "q75": 0.75}


def profile_counts(
    df: DataFrame, types: dict[str, str], counts: DataFrame | None = None, approx: bool = False
) -> DataFrame:
    """Missing and distinct values of every column, and the mode of categories.

    With `approx=True` distinct values are estimated, and only categories are counted
    value by value.
    """
    usable = S.supported_columns(df)
    categories = of_type(types, "categorical", "boolean")
    if approx:
        summary = approximate_statistics(df, usable).select("column", "non_null", "missing", "nunique")
        counts = value_counts(df, categories) if categories else None
    else:
        counts = counts if counts is not None else stage(value_counts(df, usable))
        summary = summarize_counts(counts)
    rows = F.greatest(F.col("non_null") + F.col("missing"), F.lit(1))
    if counts is None:
        frequent = local_table(df.sparkSession, [], "column string, mode string, mode_count bigint")
    else:
        frequent = modes(df, counts, categories)  # one row per column
    return summary.join(F.broadcast(frequent), "column", "left").select(
        "column",
        F.col("missing").alias("missing_count"),
        (100.0 * F.col("missing") / rows).alias("missing_percentage"),
        F.col("nunique").alias("unique_count"),
        (100.0 * F.col("nunique") / rows).alias("unique_percentage"),
        "mode",
    )


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range, mean, deviation, quartiles and number of outliers."""
    stats = pinned(moments(df, columns))
    quarts = quantiles(df, columns, QUARTILES).drop("n")
    outliers = outlier_counts(df, columns, stats, quarts).select(
        "column", F.col("count").alias("outlier_count")
    )
    return (
        stats.where("count > 0")
        .select("column", "min", "max", "mean", "std")
        .join(F.broadcast(quarts), "column", "left")
        .join(F.broadcast(outliers), "column", "left")
    )


def profile_categorical(
    df: DataFrame, columns: list[str], counts: DataFrame | None = None, k: int = K.PROFILE_TOP_VALUES
) -> DataFrame:
    """The k most frequent values per column with their share of non-null rows."""
    counts = counts if counts is not None else stage(value_counts(df, columns))
    totals = summarize_counts(counts).select("column", "non_null")
    return (
        top_values(df, counts, k, columns)
        .join(F.broadcast(totals), "column")
        .select(
            "column", "rank", "value", "count",
            (100.0 * F.col("count") / F.col("non_null")).alias("percentage"),
        )
    )


def profile_date(df: DataFrame, columns: list[str]) -> DataFrame:
    """Earliest and latest date and the days between."""
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(as_ntz(col(c))).alias("lo"),
            F.max(as_ntz(col(c))).alias("hi"),
        )
        for c in columns
    ]
    if not parts:
        return local_table(df.sparkSession, [], "column string, minimum_date string, maximum_date string, date_range_days bigint"
        )
    return (
        df.agg(F.array(*parts).alias("d"))
        .select(F.inline("d"))
        .where("lo is not null")
        .select(
            "column",
            iso_timestamp(F.col("lo")).alias("minimum_date"),
            iso_timestamp(F.col("hi")).alias("maximum_date"),
            elapsed_days(F.col("lo"), F.col("hi")).alias("date_range_days"),
        )
    )


def profile(df: DataFrame, types: dict[str, str] | None = None, approx: bool = False) -> DataFrame:
    """One wide row per column: type, missing, distinct, range, centre, spread, mode."""
    counts = None
    if not types and not approx:
        # The distinct numbers need a count of all values, which also settles the types.
        counts = stage(value_counts(df, S.supported_columns(df)))
        types = {r["column"]: r["inferred_type"] for r in column_types(df, counts).collect()}
    types = types or infer_types(df, approx)
    listing = local_table(df.sparkSession, [(i, f.name, f.dataType.simpleString(), types[f.name]) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string, inferred_type string",
    )
    numeric = [c for c in of_type(types, "numerical") if S.is_numeric(df.schema[c].dataType)]
    dates = [c for c in of_type(types, "date") if S.is_date(df.schema[c].dataType)]
    # Every table joined here has at most one row per column of `df`.
    result = listing.join(F.broadcast(profile_counts(df, types, counts, approx)), "column", "left")
    result = result.join(F.broadcast(profile_numeric(df, numeric)), "column", "left")
    result = result.join(F.broadcast(profile_date(df, dates)), "column", "left")
    return result.withColumn(
        "note",
        F.when(F.col("inferred_type") == "identifier", K.IDENTIFIER_NOTE),
    )


def dataset_summary(
    df: DataFrame, types: dict[str, str] | None = None, found: DataFrame | None = None
) -> DataFrame:
    """One row: rows, columns, columns per semantic type, missing cells, duplicate rows.

    `found` is the result of `quality`, if it is known already.
    """
    types = types or infer_types(df)
    found = found if found is not None else _size(df)
    return found.select(
        "rows",
        "columns",
        *[
            F.lit(len(of_type(types, t))).cast("bigint").alias(f"{t}_variables")
            for t in K.SEMANTIC_TYPES
        ],
        "missing_values",
        "duplicate_rows",
    )


def _size(df: DataFrame) -> DataFrame:
    """One row `(rows, columns, missing_values, duplicate_rows)`."""
    return distinct_rows(df).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.col("missing_cells").alias("missing_values"),
        (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"),
    )


def column_facts(df: DataFrame) -> DataFrame:
    """`(column, rows, missing, constant)` in one scan.

    A column is constant when its least value equals its greatest, or it has none:
    no distinct count is needed.
    """
    fields = df.schema.fields
    values, sums = [], []
    for i, f in enumerate(fields):
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        values.append(c.alias(f"v{i}"))
        sums.append(F.count(f"v{i}").alias(f"n{i}"))
        if S.is_supported(f.dataType):
            sums += [F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}")]
    row = df.select(*values).agg(F.count(F.lit(1)).alias("rows"), *sums)
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            "rows",
            (F.col("rows") - F.col(f"n{i}")).alias("missing"),
            (
                F.col(f"lo{i}").eqNullSafe(F.col(f"hi{i}")) if S.is_supported(f.dataType) else F.lit(False)
            ).alias("constant"),
        )
        for i, f in enumerate(fields)
    ]
    return row.select(F.inline(F.array(*cells)))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value."""
    return column_facts(df).where("constant").select("column")


def missing_counts(df: DataFrame) -> DataFrame:
    """`(column, rows, missing)`; NaN counts as missing."""
    return column_facts(df).select("column", "rows", "missing")


def quality(df: DataFrame) -> DataFrame:
    """One row: size, missing cells and their share, duplicate rows, constant columns."""
    constants = {r["column"] for r in constant_columns(df).collect()}
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    return pinned(_size(df)).select(
        "rows",
        "columns",
        "missing_values",
        (100.0 * F.col("missing_values") / cells).alias("missing_percentage"),
        "duplicate_rows",
        F.lit(", ".join(c for c in df.columns if c in constants)).alias("constant_columns"),
    )
