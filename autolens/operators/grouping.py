"""Grouped aggregates: top groups with the rest as "Other", grouped tables,
category totals and line series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import as_ntz, finite, month_start, to_number
from . import schema as S
from .local import pinned
from .quantiles import quantiles

OTHER = "Other"


def numeric_value(df: DataFrame, name: str) -> Column:
    """A column as a number; text that is not a number becomes null."""
    if S.is_text(df.schema[name].dataType):
        return to_number(col(name))
    return finite(col(name))


def _aggregate_column(how: str, y: Column) -> Column:
    if how == "mean":
        return F.avg(y)
    if how == "min":
        return F.min(y)
    if how == "max":
        return F.max(y)
    if how == "count":
        return F.count(y)
    if how == "nunique":
        return F.count_distinct(y)
    return F.sum(y)


def _xy(df: DataFrame, x: str, y: str | None, how: str) -> DataFrame:
    """`(x, y)` with the rows that have no y dropped; y is 1 when rows are counted."""
    if y is None or (how == "count" and y == x):
        return df.select(col(x).alias("x"), F.lit(1).alias("y"))
    # Counting needs the values as they are, anything else needs numbers.
    value = col(y) if how in ("count", "nunique") else numeric_value(df, y)
    return df.select(col(x).alias("x"), value.alias("y")).where(F.col("y").isNotNull())


def _grouped(rows: DataFrame, how: str, keys: Sequence[str], max_groups: int | None = None) -> DataFrame:
    if how == "median":
        return quantiles(rows, ["y"], {"value": 0.5}, by=keys, max_groups=max_groups).select(*keys, "value")
    return rows.groupBy(*keys).agg(_aggregate_column(how, F.col("y")).alias("value"))


def group_aggregate(df: DataFrame, x: str, y: str | None = None, how: str = "sum") -> DataFrame:
    """`(x, value)`: one aggregate per group; a null x is a group of its own."""
    if y is None:
        how = "count"
    return _grouped(_xy(df, x, y, how), how, ["x"]).select(F.col("x").alias(x), "value")


def top_groups(
    df: DataFrame, x: str, y: str | None = None, how: str = "sum",
    top_n: int = K.CHART_CATEGORIES, other: str = "pooled",
) -> DataFrame:
    """`(x, value, is_other)`: the largest groups, and the rest in one row with `is_other`.

    The rest is called "Other" for a text x and has no key for other types.
    `other="pooled"` aggregates the remaining rows together; `"summed"` adds up
    the remaining group values whatever the aggregation. They agree for sums and
    counts. A rest of zero is left out.
    """
    if y is None:
        how = "count"
    rows = _xy(df, x, y, how)
    groups = _grouped(rows, how, ["x"])
    # At most top_n rows: chosen per partition, merged on the driver side.
    top = groups.orderBy(F.desc("value"), F.asc("x")).limit(top_n)
    kept = top.select(F.col("x").alias("x"), "value", F.lit(False).alias("is_other"))
    data_type = df.schema[x].dataType
    label = F.lit(OTHER) if S.is_text(data_type) else F.lit(None).cast(data_type)
    keys = F.broadcast(top.select(F.col("x").alias("top_x"), F.lit(True).alias("is_top")))

    def rest_of(table: DataFrame) -> DataFrame:
        return table.join(keys, F.col("x").eqNullSafe(F.col("top_x")), "left").where(F.col("is_top").isNull())

    if how in ("sum", "count") or other == "summed":
        rest = rest_of(groups).agg(F.sum("value").alias("value"))
    else:
        pooled = rest_of(rows).select(F.lit(OTHER).alias("x"), "y")
        rest = _grouped(pooled, how, ["x"], max_groups=1).select("value")
    rest = rest.where(F.col("value").isNotNull() & (F.col("value") != 0)).select(
        label.alias("x"), "value", F.lit(True).alias("is_other")
    )
    return kept.unionByName(rest).select(F.col("x").alias(x), "value", "is_other").orderBy(
        "is_other", F.desc("value"), F.asc(x) if x.isidentifier() else F.asc(f"`{x}`")
    )


def geo_breakdown(
    df: DataFrame, x: str, y: str | None = None, how: str = "sum", top_n: int = K.CHART_CATEGORIES
) -> DataFrame:
    """`(x, value, is_other)`: the `top_n` largest places and all others in one row; without y,
    rows per place that is known."""
    return top_groups(df if y else df.where(col(x).isNotNull()), x, y, how, top_n)


def grouped_table(
    df: DataFrame, by: str, columns: Sequence[str], how: str, limit: int | None = None
) -> DataFrame:
    """One aggregate of every numeric column per key, in key order; the first `limit` keys.

    Null keys are dropped. Without a numeric column the rows themselves are shown. With a
    limit the keys are chosen first, so that medians are found for those only.
    """
    numeric = [c for c in columns if c != by and S.is_numeric(df.schema[c].dataType)]
    if not numeric:
        return detail_table(df, columns, limit=limit)
    keyed = df.where(col(by).isNotNull())
    if limit is not None and how == "median":
        first = pinned(keyed.select(col(by).alias("_key")).distinct().orderBy("_key").limit(limit))
        keyed = keyed.join(F.broadcast(first), col(by) == F.col("_key"), "left_semi")
    if how == "median":
        cells = quantiles(keyed, numeric, {"v": 0.5}, by=[by])
        result = cells.groupBy(col(by)).agg(
            *[F.max(F.when(F.col("column") == c, F.col("v"))).alias(c) for c in numeric]
        )
    else:
        result = keyed.groupBy(col(by)).agg(
            *[_aggregate_column(how, col(c)).alias(c) for c in numeric]
        )
    result = result.orderBy(col(by))
    return result if limit is None else result.limit(limit)


def detail_table(
    df: DataFrame, columns: Sequence[str] = (), order_by: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """The wanted columns of the rows, of the first `limit` rows; unknown columns are
    ignored, and without a known one all are shown."""
    wanted = [c for c in columns if c in df.columns] or df.columns
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    shown = ordered.select(*[col(c) for c in wanted])
    return shown if limit is None else shown.limit(limit)


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest `by`."""
    return df.orderBy(col(by).desc(), *[col(t).asc() for t in ties]).limit(k)


def category_totals(df: DataFrame, categories: Sequence[str], metric: str) -> DataFrame:
    """`(column, key, value)`: the metric's total per category, for all category columns at once.

    The table is scanned once; rows without key or metric are dropped.
    """
    labels = [f"d{i}" for i in range(len(categories))]
    names = F.array(*[F.lit(c) for c in categories])
    return (
        df.select(
            numeric_value(df, metric).alias("v"),
            *[col(c).cast("string").alias(d) for c, d in zip(categories, labels)],
        )
        .where(F.col("v").isNotNull())
        .unpivot(["v"], labels, "d", "key")
        .where(F.col("key").isNotNull())
        .groupBy("d", "key")
        .agg(F.sum("v").alias("value"))
        .select(F.element_at(names, F.substring("d", 2, 9).cast("int") + 1).alias("column"), "key", "value")
    )


def category_extremes(df: DataFrame, categories: Sequence[str], metric: str) -> DataFrame:
    """Highest and lowest category, its share and the share of the top three, per column.

    Only running aggregates and three rows per column leave the reducers, so a
    column with very many categories is no bottleneck.
    """
    totals = category_totals(df, categories, metric)
    key, value = F.col("key"), F.col("value")
    ends = totals.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("value").alias("total"),
        F.min_by("key", F.struct(-value, key)).alias("top_key"),
        F.max("value").alias("top_value"),
        F.max_by("key", F.struct(-value, key)).alias("bottom_key"),
        F.min("value").alias("bottom_value"),
    )
    order = Window.partitionBy("column").orderBy(F.desc("value"), F.asc("key"))
    best = (
        totals.withColumn("rank", F.row_number().over(order))
        .where("rank <= 3")
        .groupBy("column")
        .agg(F.sum("value").alias("top3"))
    )
    total = F.col("total")
    return ends.join(F.broadcast(best), "column").select(  # one row per column
        "column", "n_groups", "total", "top_key", "top_value",
        F.when(total != 0, 100.0 * F.col("top_value") / total).otherwise(0.0).alias("top_share"),
        "bottom_key", "bottom_value",
        F.when((F.col("n_groups") >= 3) & (total != 0), 100.0 * F.col("top3") / total).alias("top3_share"),
    )


GRAINS = ("raw", "day", "month", "year")


def line_series(
    df: DataFrame, x: str, y: str | None = None, how: str = "sum", grain: str = "month",
    points: int | None = None,
) -> DataFrame:
    """`(x, value)` in x order.

    A date axis is bucketed to `grain` (`raw`, or the first date of each `day`, `month` or
    `year`), whatever the number of points; rows without a date are left out. With `points` only the so many
    points of highest value are shown, and for a text x the rest as "Other".
    """
    if grain not in GRAINS:
        raise ValueError(f"Unknown grain: {grain}")
    if S.is_date(df.schema[x].dataType):
        df = df.where(col(x).isNotNull())
        if grain != "raw":
            df = df.withColumn(x, F.trunc(as_ntz(col(x)), grain) if grain != "day" else as_ntz(col(x)).cast("date"))
    if points is None:
        return group_aggregate(df, x, y, how).orderBy(col(x))
    chosen = top_groups(df, x, y, how, top_n=points, other="summed")
    if not S.is_text(df.schema[x].dataType):
        chosen = chosen.where(~F.col("is_other"))
    return chosen.orderBy(col(x)).select(col(x), "value")


def dimension_metrics(
    df: DataFrame, categories: Sequence[str], dates: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """`(dimension, key, metric, value)`: every category and month against every metric.

    One scan; each row is repeated per dimension (at most fourteen) and combined on
    the map side before the shuffle.
    """
    dimensions = [(c, col(c).cast("string")) for c in categories]
    dimensions += [(d, F.date_format(month_start(col(d)), "yyyy-MM")) for d in dates]
    labels = [f"d{i}" for i in range(len(dimensions))]
    names = F.array(*[F.lit(n) for n, _ in dimensions])
    is_date = F.array(*[F.lit(i >= len(categories)) for i in range(len(dimensions))])
    values = [f"m{i}" for i in range(len(metrics))]
    index = F.substring("d", 2, 9).cast("int") + 1
    return (
        df.select(
            *[numeric_value(df, m).alias(v) for m, v in zip(metrics, values)],
            *[c.alias(d) for (_, c), d in zip(dimensions, labels)],
        )
        .unpivot(values, labels, "d", "key")
        .groupBy("d", "key")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.sum(v).alias(v) for v in values])
        .select(
            F.element_at(names, index).alias("dimension"),
            F.element_at(is_date, index).alias("is_date"),
            "key",
            F.inline(
                F.array(
                    F.struct(F.lit(None).cast("string").alias("metric"), F.col("rows").cast("double").alias("value")),
                    *[F.struct(F.lit(m).alias("metric"), F.col(v).alias("value")) for m, v in zip(metrics, values)],
                )
            ),
        )
        .where(~(F.col("is_date") & F.col("key").isNull()))
    )
