"""Monthly trends, gap-free monthly series and the linear forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import finite, month_label, month_start
from .local import pinned


def monthly_sums(df: DataFrame, date: str, metrics: Sequence[str]) -> DataFrame:
    """Sums of the metrics per month, `(metric, month, value)`.

    Both trend tables derive from it; the months of a calendar are few enough to pin.
    """
    return pinned(_long(_metric_sums(df, date, metrics), metrics))


def _metric_sums(df: DataFrame, date: str, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums per month, wide: one row per group and month that has rows."""
    dated = df.where(col(date).isNotNull())
    return dated.groupBy(*[col(b) for b in by], month_start(col(date)).alias("month")).agg(
        *[F.coalesce(F.sum(finite(col(m))), F.lit(0.0)).alias(f"m{i}") for i, m in enumerate(metrics)]
    )


def _long(sums: DataFrame, metrics: Sequence[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(m).alias("metric"), F.col(f"m{i}").alias("value")) for i, m in enumerate(metrics)
    ]
    return sums.select("month", F.inline(F.array(*pairs))).select("metric", "month", "value")


def trend_points(
    df: DataFrame, date: str, metrics: Sequence[str], sums: DataFrame | None = None,
    months: int | None = K.TREND_MONTHS,
) -> DataFrame:
    """The last `months` monthly sums of each metric: `(metric, period, value)`; all with None."""
    rows = sums if sums is not None else monthly_sums(df, date, metrics)
    latest = Window.partitionBy("metric").orderBy(F.desc("month"))  # calendar months only
    return (
        rows.withColumn("age", F.row_number().over(latest))
        .withColumn("months", F.count(F.lit(1)).over(Window.partitionBy("metric")))
        .where((F.lit(months is None) | (F.col("age") <= F.lit(months))) & (F.col("months") >= 2))
        .select("metric", month_label(F.col("month")).alias("period"), "value")
    )


def trend_summary(
    df: DataFrame, date: str, metrics: Sequence[str], sums: DataFrame | None = None
) -> DataFrame:
    """Best and worst month and the change from the first to the last, per metric.

    The earliest month wins a tie. The change is relative to |first| and null
    where the first month is 0. Metrics with fewer than two months are left out.
    """
    rows = sums if sums is not None else monthly_sums(df, date, metrics)
    label, value = month_label(F.col("month")), F.col("value")
    first, last = F.min_by("value", "month"), F.max_by("value", "month")
    return (
        rows.groupBy("metric")
        .agg(
            F.count(F.lit(1)).alias("months"),
            F.min_by(label, F.struct(-value, F.col("month"))).alias("best_period"),
            F.max("value").alias("best_value"),
            F.min_by(label, F.struct(value, F.col("month"))).alias("worst_period"),
            F.min("value").alias("worst_value"),
            F.when(first != 0, 100.0 * (last - first) / F.abs(first)).alias("pct_change_first_to_last"),
        )
        .where("months >= 2")
        .select(
            "metric", F.lit(date).alias("date_column"), "best_period", "best_value",
            "worst_period", "worst_value", "pct_change_first_to_last",
        )
    )


def monthly_series(df: DataFrame, date: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """`(by..., month, idx, value)`: one row per calendar month from the first to the last.

    Months without rows are 0. `idx` counts months from the start of the series.
    """
    complete = df.where(col(date).isNotNull() & finite(col(metric)).isNotNull())
    sums = _metric_sums(complete, date, [metric], by)
    if by:
        names = [f"g{i}" for i in range(len(by))]
        sums = sums.select(*[col(b).alias(n) for b, n in zip(by, names)], "month", "m0")
    else:
        names = ["g0"]
        sums = sums.select(F.lit(1).alias("g0"), "month", "m0")
    # All months of a series meet in one row: a map of at most a few thousand months.
    series = sums.groupBy(*names).agg(
        F.min("month").alias("first"),
        F.max("month").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("month", "m0"))).alias("known"),
    )
    return series.select(
        *([F.col(n).alias(b) for b, n in zip(by, names)] if by else []),
        "known",
        F.posexplode(F.expr("sequence(first, last, interval 1 month)")).alias("idx", "month"),
    ).select(
        *[col(b) for b in by], "month", "idx",
        F.coalesce(F.try_element_at("known", F.col("month")), F.lit(0.0)).alias("value"),
    )


def _horizon(n: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 4))).cast("int")


def _series_length(series: DataFrame, by: Sequence[str]) -> DataFrame:
    group = Window.partitionBy(*([col(b) for b in by] or [F.lit(1)]))  # calendar months only
    return series.withColumn("n", F.count(F.lit(1)).over(group)).where(
        F.col("n") >= K.FORECAST_MIN_MONTHS
    )


def forecast_linear(df: DataFrame, date: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares trend over the month number, for one series or one per group.

    `(by..., period, value, lower, upper)` for the next 3 to 6 months; the band is
    1.96 standard deviations of the residuals. Series shorter than six months have
    no forecast.
    """
    series = _series_length(monthly_series(df, date, metric, by), by)
    keys = [col(b) for b in by]
    group = Window.partitionBy(*(keys or [F.lit(1)]))  # calendar months only
    t, y = F.col("idx").cast("double"), F.col("value")
    fit = (
        series.withColumn("slope", F.regr_slope(y, t).over(group))
        .withColumn("intercept", F.regr_intercept(y, t).over(group))
        .groupBy(*(keys or [F.lit(1)]))  # no row for no series
        .agg(
            F.max("n").alias("n"),
            F.max("month").alias("last"),
            F.max("slope").alias("slope"),
            F.max("intercept").alias("intercept"),
            F.stddev_pop(y - (F.col("intercept") + F.col("slope") * t)).alias("deviation"),
        )
    )
    deviation = F.col("deviation")
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), _horizon(F.col("n"))))).withColumn(
        "value", F.col("intercept") + F.col("slope") * (F.col("n") + F.col("step") - 1)
    )
    return ahead.select(
        *keys,
        F.date_format(F.add_months("last", F.col("step")), "yyyy-MM-dd").alias("period"),
        "value",
        (F.col("value") - 1.96 * deviation).alias("lower"),
        (F.col("value") + 1.96 * deviation).alias("upper"),
    )


def forecast_metrics(df: DataFrame, date: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Error of a line fitted to the first 80 % of the months on the rest.

    `(by..., months, horizon_months, mae, rmse, r2)`.
    """
    series = _series_length(monthly_series(df, date, metric, by), by)
    keys = [col(b) for b in by]
    group = Window.partitionBy(*(keys or [F.lit(1)]))  # calendar months only
    split = F.greatest(F.lit(3), F.floor(F.col("n") * F.lit(0.8)))
    t = F.col("idx").cast("double")
    y = F.col("value")
    train = F.col("idx") < split
    fitted = series.select(
        *keys, "n", t.alias("t"), y.alias("y"), train.alias("train"),
        F.regr_slope(F.when(train, y), F.when(train, t)).over(group).alias("slope"),
        F.regr_intercept(F.when(train, y), F.when(train, t)).over(group).alias("intercept"),
    )
    held_y = F.when(~F.col("train"), F.col("y"))
    error = held_y - (F.col("intercept") + F.col("slope") * F.col("t"))
    held = F.count(held_y)
    spread = F.var_pop(held_y) * held
    result = fitted.groupBy(*(keys or [F.lit(1)])).agg(  # no row for no series
        F.max("n").alias("months"),
        _horizon(F.max("n")).alias("horizon_months"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when((held > 1) & (spread > 0), 1 - F.sum(error * error) / spread).alias("r2"),
    )
    return result.select(*keys, "months", "horizon_months", "mae", "rmse", "r2")
