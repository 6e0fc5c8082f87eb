"""Reproducible row samples for plots, previews and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.names import col
from .grouping import numeric_value


_DRAW = "autolens_draw"


def hashable(df: DataFrame, name: str) -> Column:
    """A column in a form that Spark hashes and orders; maps as their sorted entries."""
    c = col(name)
    return F.sort_array(F.map_entries(c)) if isinstance(df.schema[name].dataType, T.MapType) else c


def preview(df: DataFrame, n: int = K.PREVIEW_ROWS) -> DataFrame:
    return df.limit(n)


def stable_sample(df: DataFrame, n: int, key: Sequence[str] = (), seed: int = K.SEED) -> DataFrame:
    """n rows drawn with equal chances.

    With a `key` that tells rows apart the draw goes by its hash: the same rows
    whatever the partitioning or file order. Without one it goes by a seeded random
    number, the same for the same files, since copies of a row must have chances of
    their own. The rows are counted first, so that only a few more than n leave the tasks.
    """
    total = df.count()
    if total <= n:
        return df
    if key:
        parts = [hashable(df, c) for c in key]
        bits = F.xxhash64(F.lit(seed), *parts).bitwiseAND(F.lit((1 << 53) - 1))
        drawn = df.withColumn(_DRAW, bits / float(1 << 53))
        order = [F.col(_DRAW), *parts]
    else:
        drawn = df.withColumn(_DRAW, F.rand(seed))
        order = [F.col(_DRAW)]
    # Eight standard deviations above n.
    chosen = drawn.where(F.col(_DRAW) < (n + 8.0 * n**0.5 + 32.0) / total)
    if key and chosen.limit(n).count() < n:
        # The key repeats so much that its hashes are not spread evenly.
        chosen = drawn
    return chosen.orderBy(*order).limit(n).drop(_DRAW)


def scatter_points(
    df: DataFrame, x: str, y: str, color: str | None = None, key: Sequence[str] = (),
    n: int = K.SCATTER_POINTS, seed: int = K.SEED,
) -> DataFrame:
    """Complete numeric (x, y) pairs, at most 5000 of them."""
    extra = [col(color)] if color in df.columns else []
    kept = [c for c in key if c not in (x, y, color)]
    pairs = df.select(
        numeric_value(df, x).alias(x), numeric_value(df, y).alias(y), *extra, *[col(k) for k in kept]
    ).where(col(x).isNotNull() & col(y).isNotNull())
    sample = stable_sample(pairs, n, key, seed)
    return sample.select(col(x), col(y), *extra)


def anomaly_plot_rows(df: DataFrame, flag: str, normals: int = K.ANOMALY_PLOT_NORMALS) -> DataFrame:
    """Every flagged row and a sample of the others."""
    return df.where(col(flag)).unionByName(stable_sample(df.where(~col(flag)), normals))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row `(rows, fingerprint)` that does not depend on row order or partitioning."""
    fields = []
    for f in df.schema.fields:
        # Hash functions pass over nulls, so say where they are.
        fields += [col(f.name).isNull(), hashable(df, f.name)]
    row = F.xxhash64(*fields)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.hex(
            F.xxhash64(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")))
        ).alias("fingerprint"),
    )
