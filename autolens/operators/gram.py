"""Sums of products of all pairs of many columns in one scan.

A wide table has more pairs than an aggregate has room for in generated code. Each task
instead adds up matrix products of its rows and of their presence masks, and gives one
row per pair; those are summed like any other aggregate, over as many keys as pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import col
from ..functions.scalars import finite

# Workers need not be able to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Columns of one side of a scan; six squares of doubles are what a task holds.
COLUMNS_PER_SIDE = 1024
ROWS_PER_PRODUCT = 2048

_SUMS = ("n", "xy", "x", "y", "xx", "yy")


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[finite(col(c)).alias(f"c{i}") for i, c in enumerate(columns)])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by columns, NaN where there is no value."""
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns])


def column_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """`count, missing, mean, min, max` of each column, in one scan; mean, min and max of a column
    without values are null."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = 0
        n, total = np.zeros(width), np.zeros(width)
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for batch in batches:
            x = _matrix(batch)
            there = ~np.isnan(x)
            rows += len(x)
            n += there.sum(axis=0)
            total += np.where(there, x, 0.0).sum(axis=0)
            low = np.minimum(low, np.where(there, x, np.inf).min(axis=0, initial=np.inf))
            high = np.maximum(high, np.where(there, x, -np.inf).max(axis=0, initial=-np.inf))
        if rows:
            yield pa.record_batch(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, float(rows))), *map(pa.array, (n, total, low, high))],
                names=["i", "rows", "n", "total", "low", "high"],
            )

    if not width:
        return {}
    parts = _values(df, columns).mapInArrow(run, "i int, rows double, n double, total double, low double, high double")
    found = parts.groupBy("i").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    ).collect()
    return {
        columns[r["i"]]: {
            "count": int(r["n"]), "missing": int(r["rows"] - r["n"]), "mean": r["total"] / r["n"] if r["n"] else None,
            "min": r["low"] if r["n"] else None, "max": r["high"] if r["n"] else None,
        }
        for r in found
    }


def pair_sums(df: DataFrame, columns: Sequence[str], centres: Sequence[float]) -> Iterator[tuple]:
    """`(i, j, n, xy, x, y, xx, yy)` of each pair `i < j` of the columns with common rows.

    The sums are over the rows that have both values, less their centre: of x y, x, y, x x
    and y y. One scan for up to `COLUMNS_PER_SIDE` columns, beyond them one for each two
    groups of so many.
    """
    groups = [range(s, min(s + COLUMNS_PER_SIDE, len(columns))) for s in range(0, len(columns), COLUMNS_PER_SIDE)]
    for a, left in enumerate(groups):
        for right in groups[a:]:
            yield from _block(df, columns, centres, left, right)


def _block(df: DataFrame, columns: Sequence[str], centres: Sequence[float], left: range, right: range) -> Iterator[tuple]:
    same = left == right
    used = [*left] if same else [*left, *right]
    middle = np.array([centres[i] for i in used], dtype=float)
    height, width = len(left), len(right)
    rows_at, columns_at = np.triu_indices(height, 1) if same else [m.ravel() for m in np.indices((height, width))]
    firsts, seconds = left.start, right.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, height, width))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_PRODUCT):
                x = _matrix(batch.slice(start, ROWS_PER_PRODUCT)) - middle
                there = ~np.isnan(x)
                x[~there] = 0.0
                there = there.astype(float)
                xa, ma, xb, mb = x[:, :height], there[:, :height], x[:, -width:], there[:, -width:]
                sums += [ma.T @ mb, xa.T @ xb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb)]
        flat = sums[:, rows_at, columns_at]
        kept = np.flatnonzero(flat[0])
        for start in range(0, len(kept), 65536):
            at = kept[start : start + 65536]
            yield pa.record_batch(
                [
                    pa.array((rows_at[at] + firsts).astype(np.int32)), pa.array((columns_at[at] + seconds).astype(np.int32)),
                    *[pa.array(s[at]) for s in flat],
                ],
                names=["i", "j", *_SUMS],
            )

    parts = _values(df, [columns[i] for i in used]).mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    total = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS]).orderBy("i", "j").toArrow()
    yield from zip(*[total.column(c).to_pylist() for c in ("i", "j", *_SUMS)], strict=True)
