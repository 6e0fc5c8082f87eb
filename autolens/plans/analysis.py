"""The complete analysis of a table as a dictionary of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import constants as K
from ..operators import schema as S
from ..operators.column_types import infer_types, of_type
from ..operators.correlation import correlations, strong_correlations
from ..operators.frequency import value_counts
from ..operators.grouping import category_extremes
from ..operators.outliers import outlier_counts
from ..operators.profile import dataset_summary, quality
from ..operators.statistics import (
    analyze_dates, analyze_numerical, business_metrics, categorical_distribution,
    categorical_summary, date_counts, important_columns,
)
from ..operators.staging import stage
from ..operators.trends import monthly_sums, trend_points, trend_summary
from . import insights as I
from ..operators.local import local_table, pinned


class Columns:
    """Columns of a table by role, native types only."""

    def __init__(self, df: DataFrame, types: dict[str, str]):
        self.numerical = [c for c in of_type(types, "numerical") if S.is_numeric(df.schema[c].dataType)]
        self.categories = of_type(types, "categorical", "boolean")
        self.dates = [c for c in of_type(types, "date") if S.is_date(df.schema[c].dataType)]
        self.identifiers = of_type(types, "identifier")


def analyze(df: DataFrame, types: dict[str, str] | None = None, approx: bool = False) -> dict[str, DataFrame]:
    """Every analysis section as a table.

    Sections that do not apply (no dates, one numerical column, ...) are missing. Each
    part of the table is scanned once: the sections share pinned statistics.
    """
    types = types or infer_types(df, approx)
    columns = Columns(df, types)
    found = quality(df)
    result = {"dataset_summary": dataset_summary(df, types, found), "quality": found}
    stats = None
    if columns.numerical:
        stats = pinned(analyze_numerical(df, columns.numerical, approx))
        result["numerical_analysis"] = stats
        result["outliers"] = pinned(
            outlier_counts(df, columns.numerical, stats, stats.select("column", "q25", "q75")).where("count > 0")
        )
        result["business_metrics"] = business_metrics(df, columns.numerical, stats)
    summary = None
    if columns.categories:
        counts = stage(value_counts(df, columns.categories))
        summary = pinned(categorical_summary(df, columns.categories, counts))
        result["categorical_summary"] = summary
        result["categorical_distribution"] = categorical_distribution(df, columns.categories, counts)
    if columns.dates:
        result["date_analysis"] = analyze_dates(df, columns.dates)
        result["date_counts"] = date_counts(df, columns.dates)
    if len(columns.numerical) >= 2:
        pairs = pinned(correlations(df, columns.numerical, stats))
        result["correlations"] = pairs
        result["strong_correlations"] = strong_correlations(pairs)
    if columns.dates and columns.numerical:
        sums = monthly_sums(df, columns.dates[0], columns.numerical)
        result["trends"] = trend_summary(df, columns.dates[0], columns.numerical, sums)
        result["trend_points"] = trend_points(df, columns.dates[0], columns.numerical, sums)
    if stats is not None or summary is not None:
        filler = local_table(df.sparkSession, [], "column string, count bigint, mean double, std double")
        none = local_table(df.sparkSession, [], "column string, n_categories bigint")
        result["important_columns"] = important_columns(
            stats if stats is not None else filler, summary if summary is not None else none,
            columns.dates, columns.identifiers, columns.numerical, columns.categories,
        )
    return result


def primary_metric(sections: dict[str, DataFrame]) -> str | None:
    """The top-ranked business metric."""
    if "business_metrics" not in sections:
        return None
    best = sections["business_metrics"].where("rank = 1").first()
    return best["column"] if best else None


def insights(
    df: DataFrame, types: dict[str, str], sections: dict[str, DataFrame] | None = None,
    model=None, limit: int | None = K.MAX_INSIGHTS,
) -> DataFrame:
    """The insight package of a table: `(seq, type, subject, value, message)`."""
    sections = sections if sections is not None else analyze(df, types)
    columns = Columns(df, types)
    parts: list[DataFrame | None] = [I.dataset_insights(sections["dataset_summary"], types)]
    if "categorical_summary" in sections:
        metric = primary_metric(sections)
        extremes = category_extremes(df, columns.categories, metric) if metric else None
        parts.append(
            I.category_insights(sections["categorical_summary"], extremes, metric, columns.categories)
        )
    if "numerical_analysis" in sections:
        parts.append(I.numerical_insights(sections["numerical_analysis"], columns.numerical))
    if "correlations" in sections:
        parts.append(I.correlation_insights(sections["correlations"]))
    if "trends" in sections:
        parts.append(I.trend_insights(sections["trends"], columns.numerical))
    if "outliers" in sections:
        parts.append(I.outlier_insights(sections["outliers"], columns.numerical))
    parts.append(I.model_insights(model))
    return I.insight_package(parts, limit)
