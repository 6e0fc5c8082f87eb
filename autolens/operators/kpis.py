"""KPIs, default KPIs and the catalogue of what a column can be used for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col, is_geo_name, is_metric_name, name_in
from ..functions.scalars import display_number
from .column_types import of_type
from .frequency import summarize_counts, value_counts
from .grouping import numeric_value
from .quantiles import quantiles
from .local import local_table


@dataclass(frozen=True)
class Kpi:
    name: str
    column: str | None = None
    how: str = "sum"


def compute_kpis(df: DataFrame, kpis: Sequence[Kpi]) -> DataFrame:
    """`(name, column, aggregation, value, display)`, in the given order.

    One scan answers counts, sums, means and extremes; distinct counts share one
    frequency table and medians one quantile search. A KPI on an unknown column,
    or on no rows at all, is null.
    """
    spark = df.sparkSession
    plain, distinct, medians = {}, set(), set()
    for i, kpi in enumerate(kpis):
        known = kpi.column in df.columns
        if kpi.how == "count":
            plain[i] = F.count(col(kpi.column)) if known else F.count(F.lit(1))
        elif not known:
            continue
        elif kpi.how == "nunique":
            distinct.add(kpi.column)
        elif kpi.how == "median":
            medians.add(kpi.column)
        else:
            v = numeric_value(df, kpi.column)
            total = F.coalesce(F.sum(v), F.lit(0.0))
            plain[i] = {"mean": F.avg(v), "min": F.min(v), "max": F.max(v)}.get(kpi.how, total)
    listing = local_table(spark, [(i, k.name, k.column, k.how) for i, k in enumerate(kpis)],
        "position int, name string, column string, aggregation string",
    )
    rows = F.count(F.lit(1))
    cells = [
        F.struct(F.lit(i).alias("position"), F.when(rows > 0, e.cast("double")).alias("value"))
        for i, e in plain.items()
    ]
    values = local_table(spark, [], "position int, value double")
    if cells:
        values = values.unionByName(df.agg(F.array(*cells).alias("v")).select(F.inline("v")))
    if distinct:
        counted = summarize_counts(value_counts(df, sorted(distinct))).select(
            "column", F.col("nunique").cast("double").alias("value")
        )
        wanted = listing.where("aggregation = 'nunique'").select("position", "column")
        values = values.unionByName(wanted.join(F.broadcast(counted), "column").select("position", "value"))
    if medians:
        numbers = df.select(*[numeric_value(df, c).alias(c) for c in sorted(medians)])
        middle = quantiles(numbers, sorted(medians), {"value": 0.5}).select("column", "value")
        wanted = listing.where("aggregation = 'median'").select("position", "column")
        values = values.unionByName(wanted.join(F.broadcast(middle), "column").select("position", "value"))
    # One row per KPI.
    return (
        listing.join(F.broadcast(values), "position", "left")
        .orderBy("position")
        .select("name", "column", "aggregation", "value", display_number(F.col("value")).alias("display"))
    )


def default_kpis(types: dict[str, str]) -> list[Kpi]:
    """Rows, total and mean of the first numerical column, categories of the first categorical one."""
    kpis = [Kpi(K.KPI_NAMES["rows"], None, "count")]
    for c in of_type(types, "numerical")[:1]:
        kpis += [Kpi(K.KPI_NAMES[how].format(c), c, how) for how in ("sum", "mean")]
    for c in of_type(types, "categorical")[:1]:
        kpis.append(Kpi(K.KPI_NAMES["nunique"].format(c), c, "nunique"))
    return kpis


def eligibility(df: DataFrame, types: dict[str, str], counts: DataFrame | None = None) -> DataFrame:
    """What each column may be used for in a dashboard, one row per column."""
    categories = of_type(types, "categorical", "boolean", "text", "numerical")
    counts = counts if counts is not None else value_counts(df, categories)
    listing = local_table(df.sparkSession, [(i, c, types[c]) for i, c in enumerate(df.columns)],
        "position int, column string, inferred_type string",
    )
    kind, n = F.col("inferred_type"), F.col("n_values")
    stats = summarize_counts(counts).select("column", F.col("nunique").alias("n_values"))
    identifier = kind == "identifier"
    grouping = kind.isin("categorical", "boolean")
    return (
        listing.join(F.broadcast(stats), "column", "left")  # one row per column
        .withColumn("n_values", F.when(~kind.isin("date", "identifier", "unsupported"), F.coalesce("n_values", F.lit(0))))
        .select(
            "position", "column", "inferred_type", "n_values",
            F.coalesce((kind == "date") | (~identifier & (n <= K.FILTER_VALUES)), F.lit(False)).alias("can_filter"),
            F.coalesce(~identifier & (n <= K.PIE_CATEGORIES), F.lit(False)).alias("can_pie"),
            F.coalesce(grouping & n.between(2, 2 * K.CHART_CATEGORIES), F.lit(False)).alias("can_group"),
            (kind == "numerical").alias("can_measure"),
            name_in(F.col("column"), [c for c in df.columns if is_metric_name(c)]).alias("is_metric_like"),
            name_in(F.col("column"), [c for c in df.columns if is_geo_name(c)]).alias("is_geo"),
            F.when(kind == "numerical", ", ".join(K.AGGREGATIONS))
            .when(kind.isin("categorical", "identifier"), "nunique, count")
            .otherwise("count").alias("kpi_aggregations"),
        )
    )
