"""Which columns can be targets and features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import is_class_target_name, is_identifier_name, is_metric_name, name_in
from ..operators import schema as S
from ..operators.column_types import of_type
from ..operators.frequency import summarize_counts, value_counts
from ..operators.local import local_table

# Sizes of targets and features.
CLASS_VALUES = (2, 12)
CLASS_ROW_SHARE = 0.2
FEATURE_VALUES = (2, 30)


@dataclass
class ModelResult:
    """What a model run produced. `tables` are the datasets behind its charts."""

    session: SparkSession
    task: str
    used: bool = False
    model_type: str | None = None
    target: str | None = None
    features: list[str] = field(default_factory=list)
    metrics: dict[str, float | None] = field(default_factory=dict)
    importance: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    message: str = ""

    def metric_table(self) -> DataFrame:
        rows = [(k, None if v is None else float(v)) for k, v in self.metrics.items()]
        return local_table(self.session, rows, "metric string, value double")


def category_sizes(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """`(column, n_values, n_rows)` of the categorical and boolean columns."""
    counts = value_counts(df, of_type(types, "categorical", "boolean"))
    return summarize_counts(counts).select(
        "column", F.col("nunique").alias("n_values"), (F.col("non_null") + F.col("missing")).alias("n_rows")
    )


def screen_targets(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """`(column, role, eligible, preferred, reason)` for every role a column may play.

    Roles: `class_target`, `regression_target`, `numeric_feature` and
    `categorical_feature`. Preferred targets have a telling name.
    """
    categories = of_type(types, "categorical", "boolean")
    numbers = of_type(types, "numerical")
    name, n, rows = F.col("column"), F.col("n_values"), F.col("n_rows")
    id_like = name_in(name, [c for c in df.columns if is_identifier_name(c)])
    metric = name_in(name, [c for c in numbers if is_metric_name(c)])
    result = local_table(df.sparkSession, [], "column string, role string, eligible boolean, preferred boolean, reason string"
    )
    if categories:
        sized = category_sizes(df, types)
        enough = rows >= K.ML_MIN_ROWS
        small = n.between(*CLASS_VALUES) & (n / rows < CLASS_ROW_SHARE)
        result = result.unionByName(
            sized.select(
                "column", F.lit("class_target").alias("role"),
                (enough & small).alias("eligible"),
                name_in(name, [c for c in categories if is_class_target_name(c)]).alias("preferred"),
                F.when(~enough, "fewer than 30 rows")
                .when(n < CLASS_VALUES[0], "a single value")
                .when(n > CLASS_VALUES[1], "more than 12 values")
                .when(~small, "too few rows per value").otherwise("2 to 12 values").alias("reason"),
            )
        ).unionByName(
            sized.select(
                "column", F.lit("categorical_feature").alias("role"),
                (~id_like & n.between(*FEATURE_VALUES)).alias("eligible"),
                F.lit(False).alias("preferred"),
                F.when(id_like, "named like an identifier")
                .when(n < FEATURE_VALUES[0], "a single value")
                .when(n > FEATURE_VALUES[1], "more than 30 values").otherwise("2 to 30 values").alias("reason"),
            )
        )
    if numbers:
        listing = local_table(df.sparkSession, [(c,) for c in numbers], "column string")
        result = result.unionByName(
            listing.select(
                "column", F.lit("regression_target").alias("role"), F.lit(True).alias("eligible"),
                metric.alias("preferred"),
                F.when(metric, "named like a metric").otherwise("numerical").alias("reason"),
            )
        ).unionByName(
            listing.select(
                "column", F.lit("numeric_feature").alias("role"), (~id_like).alias("eligible"),
                F.lit(False).alias("preferred"),
                F.when(id_like, "named like an identifier").otherwise("numerical").alias("reason"),
            )
        )
    return result


def feature_columns(
    df: DataFrame, types: dict[str, str], target: str | None = None,
    max_numeric: int | None = None, max_categorical: int | None = None,
) -> tuple[list[str], list[str]]:
    """Numeric and categorical features; identifiers by type or name are out.

    All of them, or the first `max_numeric` and `max_categorical` in table order.
    """
    usable = {
        c for c in df.columns
        if c != target and types.get(c) != "identifier" and not is_identifier_name(c)
    }
    numeric = [
        c for c in of_type(types, "numerical") if c in usable and S.is_numeric(df.schema[c].dataType)
    ]
    categories = [c for c in of_type(types, "categorical", "boolean") if c in usable]
    if categories:
        sizes = {r["column"]: r["n_values"] for r in category_sizes(df, {c: types[c] for c in categories}).collect()}
        low, high = FEATURE_VALUES
        categories = [c for c in categories if low <= sizes.get(c, 0) <= high]
    return numeric[:max_numeric], categories[:max_categorical]
