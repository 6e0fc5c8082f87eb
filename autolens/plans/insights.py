"""Facts in plain language. Every number in a sentence comes from an aggregate.

All results have the columns `(type, subject, value, message)`; the order of the
facts is carried in `part` and `pos` until the package numbers them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.scalars import display_number, display_percent
from ..operators.column_types import of_type
from ..operators.local import local_table

SHAPE = "part int, pos array<double>, type string, subject string, value double, message string"
HIGH_CONCENTRATION = 60.0
NOTABLE_SKEW = 1.0
FURTHER_CORRELATIONS = 5


def _position(name: Column, order: Sequence[str]) -> Column:
    return F.coalesce(
        F.array_position(F.array(*[F.lit(c) for c in order]).cast("array<string>"), name), F.lit(0)
    ).cast("double")


def _fact(
    part: int, pos: Sequence[Column], kind: str, subject: Column, value: Column, message: Column,
    when: Column | None = None,
) -> Column:
    fact = F.struct(
        F.lit(part).alias("part"),
        F.array(*[p.cast("double") for p in pos]).alias("pos"),
        F.lit(kind).alias("type"),
        subject.cast("string").alias("subject"),
        value.cast("double").alias("value"),
        message.alias("message"),
    )
    return fact if when is None else F.when(when, fact)


def _facts(df: DataFrame, *facts: Column) -> DataFrame:
    return df.select(F.inline(F.array_compact(F.array(*facts))))


def _text(sentence: str, *values: Column) -> Column:
    return F.format_string(K.SENTENCES[sentence], *values)


def dataset_insights(summary: DataFrame, types: dict[str, str]) -> DataFrame:
    """Size, columns per type, share of missing cells; from a one-row summary."""
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    missing = 100.0 * F.col("missing_values") / cells
    return _facts(
        summary,
        _fact(
            1, [F.lit(1)], "dataset", F.lit(None), F.col("rows"),
            _text(
                "size",
                F.format_number("rows", 0), F.col("columns"),
                *[F.lit(len(of_type(types, t))) for t in ("numerical", "categorical", "date")],
            ),
        ),
        _fact(
            1, [F.lit(2)], "quality", F.lit(None), missing,
            _text("missing", display_percent(missing)),
        ),
    )


def category_insights(
    summary: DataFrame, extremes: DataFrame | None, metric: str | None, order: Sequence[str]
) -> DataFrame:
    """Dominant category, and highest, lowest and top-three share by the primary metric.

    Both inputs have one row per category column.
    """
    name = F.col("column")
    table = summary
    if extremes is not None:
        table = summary.join(F.broadcast(extremes), "column", "left")
    at = _position(name, order)
    share = F.col("dominant_percentage")
    facts = [
        _fact(
            2, [at, F.lit(1)], "concentration", name, share,
            _text(
                "dominant",
                name, F.col("dominant_category"), display_percent(share), F.col("n_categories"),
            ),
        ),
        _fact(
            2, [at, F.lit(2)], "concentration", name, share,
            _text(
                "concentrated",
                name, F.col("dominant_category"), display_percent(share),
            ),
            when=share >= HIGH_CONCENTRATION,
        ),
    ]
    if extremes is not None:
        known = F.col("n_groups").isNotNull()
        facts += [
            _fact(
                2, [at, F.lit(3)], "top_category", name, F.col("top_value"),
                _text(
                    "highest",
                    F.lit(metric), name, F.col("top_key"), display_number(F.col("top_value")),
                    display_percent(F.col("top_share")),
                ),
                when=known,
            ),
            _fact(
                2, [at, F.lit(4)], "bottom_category", name, F.col("bottom_value"),
                _text(
                    "lowest",
                    F.lit(metric), name, F.col("bottom_key"), display_number(F.col("bottom_value")),
                ),
                when=known,
            ),
            _fact(
                2, [at, F.lit(5)], "concentration", name, F.col("top3_share"),
                _text(
                    "top_three",
                    name, display_percent(F.col("top3_share")), F.lit(metric),
                ),
                when=F.col("top3_share").isNotNull(),
            ),
        ]
    return _facts(table, *facts)


def numerical_insights(stats: DataFrame, order: Sequence[str]) -> DataFrame:
    """Centre and range, a note on skew, and the total; from the numerical analysis."""
    name, at = F.col("column"), _position(F.col("column"), order)
    skew = F.col("skewness")
    return _facts(
        stats,
        _fact(
            3, [at, F.lit(1)], "metric", name, F.col("mean"),
            _text(
                "average",
                name, *[display_number(F.col(c)) for c in ("mean", "median", "min", "max")],
            ),
        ),
        _fact(
            3, [at, F.lit(2)], "distribution", name, skew,
            _text(
                "skewed",
                name, F.when(skew > 0, "right").otherwise("left"), skew,
            ),
            when=F.abs(skew) >= NOTABLE_SKEW,
        ),
        _fact(
            3, [at, F.lit(3)], "metric", name, F.col("sum"),
            _text("total", name, display_number(F.col("sum"))),
            when=F.abs("sum") > F.abs("mean"),
        ),
    )


def correlation_insights(pairs: DataFrame) -> DataFrame:
    """The strongest pair, then up to five more with |r| of 0.5 or above; from ranked pairs."""
    a, b, r = F.col("column_1"), F.col("column_2"), F.col("correlation")
    subject = F.concat_ws(" / ", a, b)
    number = F.col("correlation").cast("string")
    strong = F.abs(r) >= K.STRONG_CORRELATION
    return _facts(
        pairs.where(F.col("rank") <= 1 + FURTHER_CORRELATIONS),
        _fact(
            4, [F.col("rank")], "correlation", subject, r,
            _text(
                "strongest",
                a, b, number, F.col("strength"), F.col("direction"),
            ),
            when=F.col("rank") == 1,
        ),
        _fact(
            4, [F.col("rank")], "correlation", subject, r,
            _text(
                "correlated",
                a, b, F.col("strength"), F.col("direction"), number,
            ),
            when=(F.col("rank") > 1) & strong,
        ),
    )


def trend_insights(trends: DataFrame, order: Sequence[str]) -> DataFrame:
    """Best and worst month and the change over the whole period, per metric."""
    name, at = F.col("metric"), _position(F.col("metric"), order)
    change = F.col("pct_change_first_to_last")
    return _facts(
        trends,
        _fact(
            5, [at, F.lit(1)], "trend", name, F.col("best_value"),
            _text("best_month", name, F.col("best_period"), display_number(F.col("best_value"))),
        ),
        _fact(
            5, [at, F.lit(2)], "trend", name, F.col("worst_value"),
            _text("worst_month", name, F.col("worst_period"), display_number(F.col("worst_value"))),
        ),
        _fact(
            5, [at, F.lit(3)], "trend", name, change,
            _text(
                "change",
                name, F.when(change >= 0, "increased").otherwise("declined"), display_percent(F.abs(change)),
            ),
            when=change.isNotNull(),
        ),
    )


def outlier_insights(outliers: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number, share and method of outliers for the columns that have any."""
    name = F.col("column")
    return _facts(
        outliers.where("count > 0"),
        _fact(
            6, [_position(name, order)], "outlier", name, F.col("count"),
            _text(
                "outliers",
                F.col("count"), name, display_percent(F.col("percentage")), F.col("method"),
            ),
        ),
    )


def model_insights(result) -> DataFrame | None:
    """Model, headline quality and the most important features of a model run."""
    if result is None or not result.used:
        return None
    ending = f" with target '{result.target}'." if result.target else "."
    facts = [("model", None, K.SENTENCES["model"] % result.model_type + ending)]
    metrics = result.metrics
    if "accuracy" in metrics:
        facts.append(("accuracy", metrics["accuracy"], K.SENTENCES["accuracy"] % f"{100 * metrics['accuracy']:.1f}%"))
    if metrics.get("r2") is not None:
        facts.append(("r2", metrics["r2"], K.SENTENCES["r2"] % metrics["r2"]))
    if "silhouette" in metrics:
        facts.append(("silhouette", metrics["silhouette"], K.SENTENCES["silhouette"] % metrics["silhouette"]))
    if result.importance is not None:
        best = result.importance.orderBy(F.desc("importance"), "feature").limit(5).collect()
        named = ", ".join(f"{r['feature']} ({100 * r['importance']:.1f}%)" for r in best)
        if named:
            facts.append(("features", None, K.SENTENCES["features"] % named))
    rows = [(7, [float(i)], "ml", s, v, m) for i, (s, v, m) in enumerate(facts)]
    return local_table(result.session, rows, SHAPE)


def insight_package(parts: Sequence[DataFrame | None], limit: int | None = K.MAX_INSIGHTS) -> DataFrame:
    """All facts in order, repeated messages dropped; the first `limit` of them.

    `(seq, type, subject, value, message)`. There are a few facts per column, so one
    window over all of them is small.
    """
    present = [p for p in parts if p is not None]
    facts = present[0]
    for part in present[1:]:
        facts = facts.unionByName(part)
    order = [F.col("part"), F.col("pos"), F.col("message")]
    first = Window.partitionBy("message").orderBy(*order)
    whole = Window.partitionBy(F.lit(1)).orderBy(*order)
    return (
        facts.where(F.trim("message") != "")
        .withColumn("copy", F.row_number().over(first))
        .where("copy = 1")
        .withColumn("seq", F.row_number().over(whole))
        .where(F.lit(True) if limit is None else F.col("seq") <= limit)
        .select("seq", "type", "subject", "value", "message")
        .orderBy("seq")
    )
