"""Exact quantiles without gathering a column in one task.

Spark's `percentile` merges every distinct value of a group in one reducer. Here
each value goes to a bucket that grows with it, a pass counts the buckets, and the
next pass opens only the buckets that hold a wanted rank. Counts per bucket combine
on the map side, so a scan shuffles a few thousand rows per column and task whatever
the size or skew of the table. Buckets first follow the logarithm (256 per factor of
two, about a third of a percent wide). Its counts are exact, so it is known how much the
open buckets hold: where each is small enough for a task, the second pass counts their
values and is the last. Otherwise it divides the range between the smallest and the
largest value seen in a bucket into 4096 parts, and a third pass opens one of those. Both
mappings are monotone, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.scalars import finite
from .local import collected
from .staging import stage

BUCKETS_PER_OCTAVE = 256
SMALLEST_EXPONENT = 1075
PARTS = 4096
# Disjoint ranges a re-read filters one column by; more are joined into one span.
MAX_RANGES = 32
# The opened buckets are broadcast only while they are provably this few.
BROADCAST_ROWS = 200_000
# Rows of a bucket whose values one task may put in order.
ORDERED_ROWS = 500_000


def _log_bucket(v: Column) -> Column:
    size = F.floor((F.log2(F.abs(v)) + SMALLEST_EXPONENT) * BUCKETS_PER_OCTAVE)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(0).cast("bigint")


def _part(v: Column, low: Column, high: Column) -> Column:
    """Place of v between low and high; low is part 0 and high the last part."""
    return F.least(F.floor((v - low) / (high - low) * PARTS), F.lit(PARTS - 1)).cast("int")


def _wanted_ranks(probabilities: Sequence[float], total: Column) -> Column:
    """0-based ranks next to each linear-interpolation position (n - 1) * p."""
    positions = [(total - 1) * F.lit(float(p)) for p in probabilities]
    ranks = [F.floor(x) for x in positions] + [F.ceil(x) for x in positions]
    return F.array_distinct(F.array(*[r.cast("bigint") for r in ranks]))


def _count(rows: DataFrame, path: list[str], bucket: str) -> DataFrame:
    """Rows, range and rows below, per bucket; a path has a bounded number of buckets."""
    order = Window.partitionBy(*path).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.groupBy(*path, bucket)
        .agg(F.sum("n").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
        .withColumn("before", F.sum("n").over(order) - F.col("n"))
    )


def _at_most(spans: list[tuple[float, float]], limit: int) -> list[tuple[float, float]]:
    if len(spans) <= limit:
        return spans
    return [(min(low for low, _ in spans), max(high for _, high in spans))]


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: dict[str, float],
    by: Sequence[str] = (),
    max_groups: int | None = None,
    ordered_rows: int = ORDERED_ROWS,
) -> DataFrame:
    """Linear-interpolated quantiles: one row per group and column.

    `probabilities` maps result names to probabilities. Nulls, NaN and infinities
    are left out. `max_groups` is a bound on the number of groups that the caller
    can prove; without one, groups are counted first, and a large number of them
    is joined by shuffle instead of broadcast. Buckets of more than `ordered_rows` rows
    are divided before their values are put in order.
    """
    names = list(probabilities)
    probs = [probabilities[n] for n in names]
    groups = [f"g{i}" for i in range(len(by))]
    keys = [*groups, "c"]

    def long_rows(ranges: dict[str, list[tuple[float, float]]]) -> DataFrame:
        """`(group keys, c, v, n, b1)` for the given columns, cut to the given ranges."""
        values = []
        for label, spans in ranges.items():
            v = finite(col(columns[int(label[1:])]))
            if spans:
                inside = F.lit(False)
                for low, high in spans:
                    inside = inside | v.between(low, high)
                v = F.when(inside, v)
            values.append(v.alias(label))
        return (
            df.select(*[col(b).alias(g) for b, g in zip(by, groups)], *values)
            .unpivot(groups, list(ranges), "c", "v")
            .where(F.col("v").isNotNull())
            .withColumn("n", F.lit(1).cast("bigint"))
            .withColumn("b1", _log_bucket(F.col("v")))
        )

    rows = long_rows({f"c{i}": [] for i in range(len(columns))})
    few = not by
    if by:
        if max_groups is None:
            max_groups = df.select(*[col(b) for b in by]).distinct().count()
        few = max_groups * len(columns) * 2 * len(probs) <= BROADCAST_ROWS
        if not few:
            # Equal values become one row, so no join key is hot.
            rows = stage(rows.groupBy(*keys, "v", "b1").agg(F.sum("n").alias("n")))

    def joined(rows: DataFrame, small: DataFrame, path: list[str], inside: Column | None = None):
        """Inner join on the bucket; group keys may be null."""
        right = small.select(*[F.col(c).alias(f"r_{c}") if c in path else F.col(c) for c in small.columns])
        match = inside
        for k in path:
            same = F.col(k).eqNullSafe(F.col(f"r_{k}")) if k in groups else F.col(k) == F.col(f"r_{k}")
            match = same if match is None else match & same
        return rows.join(F.broadcast(right) if few else right, match, "inner")

    # First pass: logarithmic buckets.
    picked = (
        _count(rows, keys, "b1")
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        .withColumn(
            "rank",
            F.explode(
                F.filter(
                    _wanted_ranks(probs, F.col("total")),
                    lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")),
                )
            ),
        )
        .withColumn("offset", F.col("rank") - F.col("before"))
        .select(*keys, "b1", "rank", "total", "offset", "n", F.col("first").alias("low"), F.col("last").alias("high"))
    )
    settled = None
    while True:
        # A pass leaves at most two rows per group, column and probability. They come to
        # the driver with few groups, and are staged otherwise.
        if few:
            found, table = collected(picked)
            table = table.coalesce(1)
            spans: dict[str, set] = {}
            for r in found:
                if r["low"] < r["high"]:
                    spans.setdefault(r["c"], set()).add((r["low"], r["high"]))
            largest = max((r["n"] for r in found if r["low"] < r["high"]), default=None)
        else:
            table = stage(picked)
            largest = table.where("low < high").agg(F.max("n")).first()[0]
        done = table.where("low = high").select(*keys, "rank", "total", F.col("low").alias("v"))
        settled = done if settled is None else settled.unionByName(done)
        if largest is None:
            break
        # Further passes: divide the open buckets, into values if these are few enough. With
        # few groups only the open columns are read again, and of them only the open ranges.
        still = table.where("low < high")
        if few:
            rows = long_rows({c: _at_most(sorted(s), MAX_RANGES) for c, s in spans.items()})
        path = [*keys, "b1"]
        bucket = [*path, "low", "high"]
        inside = F.col("v").between(F.col("low"), F.col("high"))
        part = F.col("v") if largest <= ordered_rows else _part(F.col("v"), F.col("low"), F.col("high"))
        parts = joined(rows, still.select(*bucket).distinct(), path, inside).select(*bucket, "v", F.col("n").alias("n"), part.alias("part"))
        wanted = still.groupBy(*bucket).agg(
            F.collect_list(F.struct("rank", "offset")).alias("wanted"), F.first("total").alias("total")
        )
        picked = (
            joined(_count(parts, bucket, "part"), wanted, bucket)
            .withColumn("w", F.explode("wanted"))
            .where("w.offset >= before and w.offset < before + n")
            .select(
                *path, F.col("w.rank").alias("rank"), "total",
                (F.col("w.offset") - F.col("before")).alias("offset"), "n",
                F.col("first").alias("low"), F.col("last").alias("high"),
            )
        )
    if few:
        settled = settled.coalesce(1)

    def interpolated(p: float) -> Column:
        position = (F.col("total") - 1) * F.lit(float(p))
        below = F.max(F.when(F.col("rank") == F.floor(position), F.col("v")))
        above = F.max(F.when(F.col("rank") == F.ceil(position), F.col("v")))
        share = F.max(position - F.floor(position))
        return below + (above - below) * share

    result = settled.groupBy(*keys).agg(
        F.max("total").alias("n"), *[interpolated(p).alias(f"q{i}") for i, p in enumerate(probs)]
    )
    label = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("c", 2, 10).cast("int") + 1)
    return result.select(
        *[F.col(g).alias(b) for b, g in zip(by, groups)], label.alias("column"), "n", *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)]
    )


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass variant with rank error n / accuracy, for when exactness is not needed."""
    names = list(probabilities)
    levels = [float(probabilities[n]) for n in names]
    stats = df.groupBy(*[col(b) for b in by]).agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(finite(col(c))).alias("n"),
                F.percentile_approx(finite(col(c)), levels, accuracy).alias("q"),
            ).alias(f"s{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = stats.select(
        *[col(b) for b in by], F.explode(F.array(*[f"s{i}" for i in range(len(columns))])).alias("s")
    ).where("s.n > 0")
    return rows.select(
        *[col(b) for b in by], "s.column", "s.n",
        *[F.element_at("s.q", i + 1).alias(n) for i, n in enumerate(names)],
    )
