"""Datasets behind charts: one spec at a time, or all charts of a table in a batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col, is_geo_name, is_metric_name
from . import schema as S
from .column_types import of_type
from .correlation import correlation_heatmap
from .distributions import box_statistics, box_tables, histogram
from .frequency import summarize_counts, value_counts
from .grouping import detail_table, dimension_metrics, geo_breakdown, line_series, numeric_value, top_groups
from .local import pinned
from .sampling import scatter_points, stable_sample

# How many metrics and categories a density combines.
DENSITY = {"balanced": 4, "detailed": 8, "maximum": 12, "all": None}
DATE_AXES = 2


@dataclass(frozen=True)
class ChartSpec:
    """What to draw: a chart type, its axes, and how values combine."""

    type: str
    x: str | None = None
    y: str | None = None
    how: str = "sum"
    color: str | None = None
    columns: tuple[str, ...] = ()
    grain: str = "month"
    rows: int | None = K.TABLE_ROWS
    key: tuple[str, ...] = ()


def chart_data(df: DataFrame, spec: ChartSpec) -> DataFrame | None:
    """The dataset of one chart; None where the spec does not fit the table."""
    x = spec.x if spec.x in df.columns else None
    y = spec.y if spec.y in df.columns else None
    kind = spec.type.lower()
    if kind == "table":
        return detail_table(df, spec.columns or [c for c in (spec.x, spec.y) if c], limit=spec.rows)
    if kind == "heatmap":
        numeric = [c for c in spec.columns if c in df.columns] or S.columns_where(df, S.is_numeric)
        return correlation_heatmap(df, numeric) if len(numeric) >= 2 else None
    if kind == "histogram":
        return histogram(df, [x or y]) if x or y else None
    if kind == "box":
        return box_statistics(df, y or x, x if y and x != y else None) if x or y else None
    if x is None:
        return None
    if kind in ("bar", "column"):
        return top_groups(df, x, y, spec.how)
    if kind in ("pie", "donut"):
        return top_groups(df, x, y, spec.how, top_n=K.PIE_CATEGORIES)
    if kind in ("line", "area"):
        return line_series(df, x, y, spec.how, spec.grain)
    if kind == "map":
        return geo_breakdown(df, x, y, spec.how)
    if kind == "scatter" and y:
        return scatter_points(df, x, y, spec.color, spec.key)
    return None


def chart_columns(
    df: DataFrame, types: dict[str, str], density: str = "balanced", date_axes: int | None = DATE_AXES
) -> dict[str, list[str]]:
    """Columns worth charting: metric-like numbers first, categories with 2 to 60 values,
    those with at most 8 values, places, and date axes.

    `density` says how many metrics and categories are combined, `all` for no limit.
    """
    width = DENSITY.get(density, DENSITY["balanced"])
    numeric = of_type(types, "numerical")
    metrics = sorted(numeric, key=lambda c: not is_metric_name(c))[:width]
    candidates = of_type(types, "categorical", "boolean")
    sizes = {}
    if candidates:
        counted = summarize_counts(value_counts(df, candidates)).select("column", "nunique")
        sizes = {r["column"]: r["nunique"] for r in counted.collect()}
    usable = [c for c in candidates if 2 <= sizes.get(c, 0) <= 2 * K.CHART_CATEGORIES]
    return {
        "metrics": metrics,
        "categories": usable[:width],
        "pies": [c for c in usable[:width] if sizes[c] <= K.PIE_CATEGORIES],
        "places": [c for c in usable if is_geo_name(c)],
        "dates": [c for c in of_type(types, "date") if S.is_date(df.schema[c].dataType)][:date_axes],
        "numeric": numeric,
    }


SECTIONS = ("aggregates", "histogram", "box", "scatter", "heatmap", "table")


def chart_datasets(
    df: DataFrame, types: dict[str, str], density: str = "balanced", sections: Sequence[str] = SECTIONS,
    date_axes: int | None = DATE_AXES,
) -> dict[str, DataFrame]:
    """All charts of a table as a few long tables; only the `sections` asked for are built.

    `aggregates` holds every bar, pie, map and monthly line chart as
    `(chart, dimension, key, metric, value)` from a single scan, `box` the boxes of all
    metrics by the first category, `scatter` every pair of metrics over one sample of rows.
    The number of passes does not grow with the number of metrics.
    """
    chosen = chart_columns(df, types, density, date_axes)
    metrics, categories = chosen["metrics"], chosen["categories"]
    result: dict[str, DataFrame] = {}
    if "aggregates" in sections and (categories or chosen["dates"]):
        result["aggregates"] = aggregate_charts(df, chosen)
    if "histogram" in sections and metrics:
        result["histogram"] = histogram(df, metrics)
    if "box" in sections and metrics:
        result["box"] = box_tables(df, metrics, categories[0] if categories else None)
    if "scatter" in sections and len(metrics) >= 2:
        result["scatter"] = scatter_pairs(df, metrics)
    if "heatmap" in sections and len(chosen["numeric"]) >= 2:
        result["heatmap"] = correlation_heatmap(df, chosen["numeric"])
    if "table" in sections:
        result["table"] = detail_table(df, chosen["dates"][:1] + categories[:3] + metrics[:4], limit=K.TABLE_ROWS)
    return result


def scatter_pairs(df: DataFrame, metrics: Sequence[str], key: Sequence[str] = (), n: int = K.SCATTER_POINTS) -> DataFrame:
    """`(x_metric, y_metric, x, y)`: the complete pairs of one sample of rows, for all pairs of metrics."""
    values = [numeric_value(df, m).alias(f"m{i}") for i, m in enumerate(metrics)]
    rows = df.select(*values, *[col(k).alias(f"key{i}") for i, k in enumerate(key)])
    sample = pinned(stable_sample(rows, n, [f"key{i}" for i in range(len(key))]))
    pairs = [
        F.struct(F.lit(a).alias("x_metric"), F.lit(b).alias("y_metric"), F.col(f"m{i}").alias("x"), F.col(f"m{j}").alias("y"))
        for i, a in enumerate(metrics) for j, b in enumerate(metrics) if i < j
    ]
    return sample.select(F.inline(F.array(*pairs))).where("x is not null and y is not null")


def aggregate_charts(df: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
    """`(chart, dimension, key, metric, value)` for bar, pie, map and line charts."""
    cells = dimension_metrics(df, chosen["categories"], chosen["dates"], chosen["metrics"])
    first = chosen["metrics"][0] if chosen["metrics"] else None
    name = F.col("dimension")
    on_first = F.col("metric").eqNullSafe(F.lit(first).cast("string"))

    def chart(label: str, wanted: Column) -> Column:
        return F.when(wanted, label)

    charts = F.array_compact(
        F.array(
            chart("bar", ~F.col("is_date") & F.col("metric").isNotNull()),
            chart("line", F.col("is_date") & F.col("metric").isNotNull()),
            chart("pie", name.isin(chosen["pies"] or [""]) & ~F.col("is_date") & on_first),
            chart("map", name.isin(chosen["places"] or [""]) & ~F.col("is_date") & on_first & F.col("metric").isNotNull()),
        )
    )
    return cells.select(F.explode(charts).alias("chart"), "dimension", "key", "metric", "value").where(
        F.col("value").isNotNull()
    )
