"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

X are the centred rows, one for each distinct vector. Each step multiplies X with the
newest right vector v, takes out what lies along the earlier left vectors (full
reorthogonalisation), and multiplies its transpose with the result, out of which go all
earlier right vectors. The left vectors have an entry for each row, too many for the
driver; each is X y with a short y, so the tasks make them again from y, and nothing
but sums leaves a task. One pass over the rows serves both products of a step: what
Xᵀ does to the earlier left vectors is known already.

The singular values of the small bidiagonal matrix are those of X, and its right
vectors give the components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

COMPONENTS = 4
#: Entries are whole numbers of this part of one.
SCALE = 256
#: A value this small against the largest is rounding, squared for eigenvalues.
ROUNDING = 1e-13


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """`(vec_id, x)` of the rows that take part: x is floor(scale * entry) as long."""
    entry = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.col("embedding").isNotNull() & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    return vectors.where(usable).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(entry, lambda c: F.floor(F.lit(float(scale)) * c).cast("bigint")).alias("x"),
    )


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, d)


@dataclass
class Moments:
    """Of the fit list: rows, sums and sums of squares of each dimension, exact."""

    n: int
    sums: list[int]
    squares: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        """Of the covariance with divisor n."""
        return sum(self.n * q - s * s for s, q in zip(self.sums, self.squares, strict=True)) / self.n**2

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, rounded once."""
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), *(abs(s) // self.n + 1 for s in self.sums))
        if largest * self.n < 1 << 61:
            return (x * self.n - np.array(self.sums, np.int64)) / self.n
        return ((x.astype(object) * self.n - np.array(self.sums, object)) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - sums)² for each row; None beyond a long."""
        bound = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if bound * bound * x.shape[1] < 1 << 62:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]


def moments(fit: DataFrame, d: int) -> Moments:
    """Every task adds up its own rows; a row per dimension reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, [0] * d, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            large = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            y = x if large * large * max(len(x), 1) < 1 << 62 else x.astype(object)
            sums = [a + int(b) for a, b in zip(sums, y.sum(axis=0), strict=True)]
            squares = [a + int(b) for a, b in zip(squares, (y * y).sum(axis=0), strict=True)]
        yield pa.record_batch(
            [pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(str, sums), pa.string()), pa.array(map(str, squares), pa.string())],
            names=["i", "n", "s", "q"],
        )

    wide = "decimal(38,0)"
    rows = fit.select("x").mapInArrow(run, "i int, n bigint, s string, q string")
    found = rows.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(wide)).alias("s"), F.sum(F.col("q").cast(wide)).alias("q")).collect()
    found.sort(key=lambda r: r["i"])
    exact = [[int(v) if isinstance(v, Decimal) else v for v in (r["n"], r["s"], r["q"])] for r in found]
    return Moments(exact[0][0], [r[1] for r in exact], [r[2] for r in exact])


class Products:
    """Sums over the centred rows of the fit list, one distributed pass each."""

    def __init__(self, fit: DataFrame, facts: Moments, d: int) -> None:
        self.fit, self.facts, self.d = fit, facts, d

    def total(self, of_rows, size: int) -> np.ndarray:
        """The sum of `of_rows(X)`, a vector of `size`, over all blocks of rows."""
        d, facts = self.d, self.facts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            result = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    result += of_rows(facts.centred(matrix(batch.column(0), d)))
            yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array(result)], names=["i", "v"])

        rows = self.fit.select("x").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(size)
        for r in rows:
            total[r["i"]] = r["v"]
        return total

    def step(self, earlier: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """With t = X y and the left vectors U = X `earlier`: |t|², Uᵀt and Xᵀt."""
        k = earlier.shape[1]

        def of_rows(x: np.ndarray) -> np.ndarray:
            both = x @ np.column_stack([earlier, y])
            t = both[:, k]
            return np.concatenate([[t @ t], both[:, :k].T @ t, x.T @ t])

        found = self.total(of_rows, 1 + k + self.d)
        return float(found[0]), found[1 : 1 + k], found[1 + k :]


def without(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """v without what lies in the span of an orthonormal basis, taken out twice."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(products: Products, trace: float, n: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance and their unit vectors (columns).

    It ends when the wanted values cannot change beyond rounding: every residual is
    rounding, and the variance outside the space searched so far is less than the last
    wanted value; or when the space is whole. Where the space closes early (equal
    eigenvalues, vectors of less than full rank) it goes on from a new direction.
    """
    d = products.d
    rng = np.random.default_rng(seed)
    right, left, through = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # V, Y with U = X Y, XᵀU
    small = np.zeros((0, 0))
    v, beta = rng.standard_normal(d), 0.0
    scale = math.sqrt(trace * n)
    while True:
        v = without(v, right)
        size = np.linalg.norm(v)
        if size <= 1e-8 or right.shape[1] == d:
            break
        v /= size
        k = right.shape[1]
        y = v - beta * left[:, k - 1] if k and beta else v
        square, along, across = products.step(left, y)
        # What rounding left along the earlier left vectors goes too.
        alpha = math.sqrt(max(square - along @ along, 0.0))
        right = np.column_stack([right, v])
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = small
        if k:
            grown[k - 1, k] = beta
        if alpha > ROUNDING * scale:
            y = (y - left @ along) / alpha
            across = (across - through @ along) / alpha
            grown[:k, k] += along
            grown[k, k] = alpha
        else:  # X v lies in the span of the earlier left vectors
            y, across = np.zeros(d), np.zeros(d)
            grown[:k, k] += along
        small, left, through = grown, np.column_stack([left, y]), np.column_stack([through, across])
        rest = without(across - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        p, values, _ = np.linalg.svd(small)
        enough = len(values) >= wanted
        residual = beta * np.abs(p[-1, :wanted]).max(initial=0)
        outside = max(trace * n - float((small**2).sum()), 0.0)
        if enough and residual <= ROUNDING * scale and outside <= max(values[wanted - 1] ** 2, (ROUNDING * scale) ** 2):
            break
        if beta <= ROUNDING * scale:
            v, beta = rng.standard_normal(d), 0.0
        else:
            v = rest
    _, values, q = np.linalg.svd(small)
    vectors = right @ q.T
    return values[:wanted] ** 2 / n, vectors[:, :wanted] / np.linalg.norm(vectors[:, :wanted], axis=0)


@dataclass
class Whitening:
    """What the rows are multiplied with; a few vectors of d entries."""

    facts: Moments
    values: np.ndarray
    vectors: np.ndarray

    @property
    def d(self) -> int:
        return len(self.facts.sums)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.facts.centred(x) @ self.vectors / np.sqrt(self.values)


def fitted(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """Components of positive variance, at most `components`; None if there is none."""
    facts = moments(fit, d)
    if not facts.trace:
        return None
    values, vectors = bidiagonalise(Products(fit, facts, d), facts.trace, facts.n, min(components, d))
    real = values > ROUNDING * facts.trace
    return Whitening(facts, values[real], vectors[:, real])


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list, less the identity."""
    k = len(model.values)

    def of_rows(x: np.ndarray) -> np.ndarray:
        w = x @ model.vectors / np.sqrt(model.values)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = Products(fit, model.facts, model.d).total(of_rows, k + k * k) / model.facts.n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(covariance - np.eye(k)).max())


COLUMNS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """`(vec_id, component, n, deviation, whitened, explained, identity_error)`.

    Rows without a vector, or with a null or non-finite entry, take no part; of the
    others, those whose length is not the commonest one (of equally common ones the
    longest) take none either. The components come from the distinct vectors, each once;
    every row is projected, repeated ones too; null ids stay null, other columns are
    ignored. A component without variance has no rows, so equal vectors, a single one,
    empty vectors and an empty table give none. Entries beyond a long become the nearest
    long; a deviation beyond a long is null.
    """
    spark = vectors.sparkSession
    x = whole_vectors(vectors, scale)
    sizes = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    if not d:
        return spark.createDataFrame([], COLUMNS)
    x = x.where(F.size("x") == d)
    stage = Stage(x.select("x").distinct())
    fit = stage.read()
    model = fitted(fit, d, components)
    if model is None:
        stage.drop()
        return spark.createDataFrame([], COLUMNS)
    error = identity_error(fit, model)
    stage.drop()
    explained = (model.values / model.facts.trace).tolist()
    k = len(explained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(1), d)
            n = len(rows)
            deviations = pa.array(model.facts.deviations(rows), pa.int64())
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.record_batch(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.facts.n)),
                    deviations.take(each), pa.array(model.apply(rows).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error)),
                ],
                names=[c.split()[0] for c in COLUMNS.split(", ")],
            )

    return x.mapInArrow(run, COLUMNS)
