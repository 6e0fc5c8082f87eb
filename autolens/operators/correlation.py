"""Pearson correlation over pairwise complete rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import correlation_direction, correlation_strength, finite
from .gram import column_facts, pair_sums
from .local import local_table
from .moments import moments

# Pairs per job: each is a few sums in generated code. More pairs are summed by matrix products.
PAIRS_PER_PASS = 200
# Where less of the squares than this is left after centring on the common rows, the pair is
# looked at again for a column that is constant on them.
UNCERTAIN_SPREAD = 1e-9

_PAIRS = "column_1 string, column_2 string, r double"


def _pair_sums(a: str, b: str, complete: bool, name: str) -> list[Column]:
    """Sums that give r, of centred values. Where gaps differ, each pair needs its own."""
    product = F.col(a) * F.col(b)
    if complete:
        return [F.sum(product).alias(f"{name}xy")]
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return [
        F.sum(product).alias(f"{name}xy"), F.count(product).alias(f"{name}n"),
        F.sum(x).alias(f"{name}x"), F.sum(y).alias(f"{name}y"),
        F.sum(x * x).alias(f"{name}xx"), F.sum(y * y).alias(f"{name}yy"),
        F.min(x).alias(f"{name}x_low"), F.max(x).alias(f"{name}x_high"),
        F.min(y).alias(f"{name}y_low"), F.max(y).alias(f"{name}y_high"),
    ]


def pair_correlations(
    df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """`(column_1, column_2, r)` for every pair of the columns, computed now; with `limit`
    of the first so many columns.

    Values are centred on their mean (`stats` from `moments`, found in a first scan if
    not given), so that plain sums are accurate. Columns without gaps share their own
    sums and need one product per pair; nothing but running sums is shuffled. More than
    `PAIRS_PER_PASS` pairs are summed in one scan by matrix products. A column that is
    constant, also on just the rows a pair has in common, has no correlation.
    """
    wanted = list(columns)[:limit]
    if stats is not None or len(wanted) * (len(wanted) - 1) // 2 <= PAIRS_PER_PASS:
        known = stats if stats is not None else moments(df, wanted)
        facts = {r["column"]: r for r in known.collect()}
    else:
        facts = column_facts(df, wanted)
    varying = [c for c in wanted if c in facts and facts[c]["count"] and facts[c]["min"] < facts[c]["max"]]
    pairs = list(combinations(varying, 2))
    if len(pairs) <= PAIRS_PER_PASS:
        result = _by_sums(df, facts, pairs)
    else:
        result, uncertain = [], []
        for i, j, n, xy, x, y, xx, yy in pair_sums(df, varying, [float(facts[c]["mean"]) for c in varying]):
            a, b = varying[i], varying[j]
            across, down = xx - x * x / n, yy - y * y / n
            if across <= UNCERTAIN_SPREAD * xx or down <= UNCERTAIN_SPREAD * yy:
                uncertain.append((a, b))
            else:
                result.append((a, b, _bounded((xy - x * y / n) / (across * down) ** 0.5)))
        result += _by_sums(df, facts, uncertain)
    return local_table(df.sparkSession, result, _PAIRS)


def _bounded(r: float) -> float:
    return max(-1.0, min(1.0, r))


def _by_sums(df: DataFrame, facts: dict, pairs: Sequence[tuple[str, str]]) -> list[tuple[str, str, float]]:
    """`(column_1, column_2, r)` of the pairs, some at a time in generated code."""
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    full = {c for c in names if not facts[c]["missing"]}
    index = {c: f"c{i}" for i, c in enumerate(names)}
    result = []
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        batch = pairs[start : start + PAIRS_PER_PASS]
        used = list(dict.fromkeys(c for pair in batch for c in pair))
        sums = []
        for c in used:
            value = F.col(index[c])
            sums += [F.sum(value).alias(f"{index[c]}x"), F.sum(value * value).alias(f"{index[c]}xx")]
        for i, (a, b) in enumerate(batch):
            sums += _pair_sums(index[a], index[b], a in full and b in full, f"p{i}")
        row = (
            df.select(*[(finite(col(c)) - F.lit(float(facts[c]["mean"]))).alias(index[c]) for c in used])
            .agg(*sums)
            .first()
        )
        for i, (a, b) in enumerate(batch):
            if a in full and b in full:
                n = facts[a]["count"]
                x, xx = row[f"{index[a]}x"], row[f"{index[a]}xx"]
                y, yy = row[f"{index[b]}x"], row[f"{index[b]}xx"]
            else:
                n, x, y, xx, yy, *ends = (
                    row[f"p{i}{k}"] for k in ("n", "x", "y", "xx", "yy", "x_low", "x_high", "y_low", "y_high")
                )
                if not n or not (ends[0] < ends[1] and ends[2] < ends[3]):
                    continue
            spread = (xx - x * x / n) * (yy - y * y / n)
            if spread > 0:
                result.append((a, b, _bounded((row[f"p{i}xy"] - x * y / n) / spread**0.5)))
    return result


def _copies(df: DataFrame, pairs: DataFrame) -> set[tuple[str, str]]:
    """Pairs of columns that are equal in every row; only near-perfect pairs are looked at."""
    near = pairs.where(F.abs("r") >= K.DUPLICATE_CORRELATION).collect()
    if not near:
        return set()
    row = df.agg(
        *[
            F.bool_and(finite(col(p["column_1"])).eqNullSafe(finite(col(p["column_2"])))).alias(f"p{i}")
            for i, p in enumerate(near)
        ]
    ).first()
    return {(p["column_1"], p["column_2"]) for i, p in enumerate(near) if row[f"p{i}"]}


def correlations(
    df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Ranked pairs with strength and direction; copies of a column are skipped."""
    r = F.col("r")
    pairs = pair_correlations(df, columns, stats, limit)
    for a, b in _copies(df, pairs):
        pairs = pairs.where(~((F.col("column_1") == a) & (F.col("column_2") == b)))
    # A row for each pair of columns.
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.abs("correlation")), "column_1", "column_2")
    return (
        pairs.coalesce(1)
        .select(
            "column_1", "column_2",
            F.round(r, 4).alias("correlation"),
            F.round(F.abs(r), 4).alias("absolute_correlation"),
            correlation_strength(r).alias("strength"),
            correlation_direction(r).alias("direction"),
        )
        .withColumn("rank", F.row_number().over(order))
        .orderBy("rank")
    )


def strong_correlations(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("absolute_correlation") >= K.STRONG_CORRELATION)


def correlation_heatmap(
    df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Long-form matrix `(row, column, correlation)`: both triangles and the diagonal."""
    pairs = pair_correlations(df, columns, stats, limit).coalesce(1)
    varying = pairs.select(F.explode(F.array("column_1", "column_2")).alias("c")).distinct()
    return (
        pairs.select(F.col("column_1").alias("row"), F.col("column_2").alias("column"), F.col("r").alias("correlation"))
        .unionByName(pairs.select(F.col("column_2").alias("row"), F.col("column_1").alias("column"), F.col("r").alias("correlation")))
        .unionByName(varying.select(F.col("c").alias("row"), F.col("c").alias("column"), F.lit(1.0).alias("correlation")))
    )
