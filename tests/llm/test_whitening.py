"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from autolens.llm.queries import QUERIES
from autolens.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>"


def usable(rows):
    kept = [(i, v) for i, v in rows if v is not None and not any(c is None or math.isnan(c) or math.isinf(c) for c in v)]
    return [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in kept]


def check(found, rows, components=4, tolerance=1e-8):
    rows = usable(rows)
    fit = np.array(sorted({tuple(x) for _, x in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-10 * values.sum()).sum()))
    assert len(found) == len(rows) * k
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(1, k + 1):
        clear = all(abs(values[c - 1] - v) > 1e-9 * values[0] for i, v in enumerate(values) if i != c - 1)
        expected, got = [], []
        for i, x in rows:
            r = by[i, c][0]
            assert (r["n"], r["deviation"]) == (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
            assert r["identity_error"] < 1e-9
            y = np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
            expected.append(y @ vectors[:, c - 1] / math.sqrt(values[c - 1]))
            got.append(r["whitened"])
        if clear:
            sign = np.sign(np.dot(expected, got))
            assert np.abs(sign * np.array(got) - expected).max() < tolerance


def test_query(spark, folder):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True))
    check(QUERIES["op12_whitening"](spark, folder).collect(), rows)


@pytest.mark.parametrize("d", [1, 2, 6, 40])
def test_random_vectors(spark, d):
    rng = np.random.default_rng(d)
    base = rng.standard_normal((90, d)) * np.geomspace(1, 0.05, d) + rng.standard_normal(d)
    rows = [(i, [float(c) for c in base[i % 80]]) for i in range(90)]
    rows += [(100, None), (101, [None] * d), (102, [float("nan")] * d), (103, [float("-inf")] * d), (104, [0.5] * (d + 1))]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "3 AS i").repartition(3)
    check(whiten(df).collect(), rows[:-1])


def test_equal_eigenvalues_and_low_rank(spark):
    corners = [[float(a), float(b), float(c), 0.0, float(a)] for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    rows = list(enumerate(corners * 3))
    check(whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_close_eigenvalues(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((400, 24)))]
    check(whiten(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_large_entries(spark):
    rows = [(i, [1e12 * (i % 7), 3.0 * i, -2e11 + i]) for i in range(20)]
    found = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in found if r["vec_id"] % 7 == 0) and len(found) >= 20


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, []), (2, [])], [(None, [None])]])
def test_nothing_varies(spark, rows):
    assert whiten(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 0.5]), (3, [0.25, 0.5])]
    found = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [sum(r["vec_id"] == i for r in found) for i in (None, 3)] == [4, 4] and {r["n"] for r in found} == {3}
