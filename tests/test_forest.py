"""Forests of many rows against Spark's on the same rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from autolens.models import forest, supervised


@pytest.fixture(scope="module")
def vectors(spark):
    generator = np.random.default_rng(8)
    n = 3000
    pdf = pd.DataFrame({f"x{k}": generator.normal(size=n) for k in range(4)} | {"x4": generator.integers(0, 2, n).astype(float), "x5": 1.0})
    pdf["number"] = 3 * pdf["x0"] + np.abs(pdf["x1"]) + 2 * pdf["x4"] + generator.normal(0, 0.3, n) + 1000
    pdf["kind"] = ((pdf["x0"] > 0).astype(int) + (pdf["x2"] > 0.7)).astype(float)
    rows = VectorAssembler(inputCols=[f"x{k}" for k in range(6)], outputCol="features").transform(spark.createDataFrame(pdf).repartition(3))
    return rows.cache()


def test_numbers_like_sparks_forest(vectors):
    rows = vectors.select("features", F.col("number").alias("label"))
    ours = forest.Forest(30, 6, 1).fit(rows)
    theirs = RandomForestRegressor(numTrees=30, maxDepth=6, seed=1).fit(rows)
    assert np.abs(ours.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 0.06
    error = F.avg((F.col("label") - F.col("prediction")) ** 2)
    found, want = (m.transform(rows).agg(error).first()[0] for m in (ours, theirs))
    assert found < 1.15 * want


def test_classes_like_sparks_forest(vectors):
    rows = vectors.select("features", F.col("kind").alias("label"))
    ours = forest.Forest(100, 6, 1, 3).fit(rows)
    theirs = RandomForestClassifier(numTrees=100, maxDepth=6, seed=1).fit(rows)
    assert np.abs(ours.featureImportances.toArray() - theirs.featureImportances.toArray()).max() < 0.1
    right = F.avg((F.col("label") == F.col("prediction")).cast("int"))
    found, want = (m.transform(rows).agg(right).first()[0] for m in (ours, theirs))
    assert found > want - 0.02


def test_first_split_against_brute_force(vectors):
    """One tree, one level: the split with the greatest gain of all bins, from the rows as drawn."""
    rows = vectors.select("features", F.col("number").alias("label"))
    limits = forest.bin_limits(rows, 6)
    grown = forest.Trees(2, 1, 6, 1)
    data = forest.blocks(rows, limits).cache()
    got = {r["tree"]: r for r in forest.best_splits(forest.level_sums(data, grown, 0, 6, 0, 1000.0, 7), 0, 6, 6, 0, 7).collect()}
    parts = [(r["block"], np.frombuffer(r["bins"], np.uint8).reshape(-1, 6), np.frombuffer(r["labels"]) - 1000.0) for r in data.collect()]
    draws = [[], []]
    for block, _, y in parts:
        stream = np.random.default_rng([7, 0, block])
        for t in range(2):
            draws[t].append(forest.DRAWN[stream.integers(0, 1 << 16, len(y), np.uint16)])
    bins, y = np.concatenate([b for _, b, _ in parts]), np.concatenate([y for _, _, y in parts])
    assert len(y) == 3000
    for t in range(2):
        w = np.concatenate(draws[t])
        assert abs(w.mean() - 1) < 0.1 and abs(w.var() - 1) < 0.15
        best = (-1.0, None)
        for f in range(6):
            for b in range(len(limits[f])):
                left = bins[:, f] <= b
                sides = [(w[s].sum(), (w[s] * y[s]).sum()) for s in (left, ~left, left | ~left)]
                if not all(n for n, _ in sides):
                    continue
                gain = sum(s * s / n for n, s in sides[:2]) - sides[2][1] ** 2 / sides[2][0]
                best = max(best, (gain, (f, b)))
        assert (got[t]["feature"], got[t]["bin"]) == best[1] and got[t]["gain"] == pytest.approx(best[0])


def test_many_rows_take_it_and_are_dealt(spark, monkeypatch, vectors):
    from autolens.operators.column_types import infer_types

    monkeypatch.setattr(supervised, "MANY_ROWS", 1000)
    monkeypatch.setattr(supervised, "TASK_ROWS", 1000)
    df = vectors.select(F.monotonically_increasing_id().alias("row_id"), *[F.col("features").cast("string").isNull().cast("int").alias("none")],
                        F.expr("number - 1000").alias("price"), F.expr("number * 0.5 + kind").alias("size")).coalesce(1)
    assert supervised.dealt(df, 3000).rdd.getNumPartitions() == 15  # one task held all of them
    fitted = []
    fit = forest.Forest.fit
    monkeypatch.setattr(forest.Forest, "fit", lambda self, train: fitted.append(train.rdd.getNumPartitions()) or fit(self, train))
    result = supervised.regress(df, {"row_id": "identifier", "price": "numerical", "size": "numerical"}, "price", models=["random_forest"])
    assert result.used and fitted == [15] and result.metrics["r2"] > 0.9
    assert [r["feature"] for r in result.importance.collect()] == ["size"]


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("level", [0, 2])
def test_level_sums_against_a_plain_loop(spark, monkeypatch, classes, level):
    """Sums of every node, chosen feature and bin; features of two bins are counted together."""
    monkeypatch.setattr(forest, "BLOCK", 200)
    monkeypatch.setattr(forest, "TOGETHER", 500)
    generator = np.random.default_rng(4)
    n, width, some, trees = 900, 9, 4, 3
    x = np.stack([generator.integers(0, top, n) for top in (40, 32, 9, 2, 2, 2, 2, 1, 5)], axis=1).astype(float)
    y = generator.integers(0, classes, n).astype(float) if classes else generator.normal(5, 1, n)
    rows = spark.createDataFrame(pd.DataFrame({"features": x.tolist(), "label": y})).repartition(2)
    data = forest.blocks(rows, [np.arange(min(t, 32) - 1.0) for t in (40, 32, 9, 2, 2, 2, 2, 1, 5)]).cache()
    grown = forest.Trees(trees, 3, width, 1)
    for t in range(trees):
        for node in range((1 << level) - 1):
            if (t, node) != (1, 1):  # which is no split
                grown.feature[t, node], grown.limit[t, node] = generator.integers(0, 3), generator.integers(1, 6)
    found = {}
    for r in forest.level_sums(data, grown, level, some, classes, 5.0, 6).collect():
        found[r["tree"]] = found.get(r["tree"], 0) + np.frombuffer(r["sums"]).reshape(classes or 2, 1 << level, some, forest.BINS)
    want = np.zeros((trees, classes or 2, 1 << level, some, forest.BINS))
    chosen = [forest.choices(6, t, level, width, some) for t in range(trees)]
    seen = 0
    for r in data.collect():
        bins, labels = np.frombuffer(r["bins"], np.uint8).reshape(-1, width), np.frombuffer(r["labels"])
        stream = np.random.default_rng([6, 0, r["block"]])
        for t in range(trees):
            drawn = forest.DRAWN[stream.integers(0, 1 << 16, len(labels), np.uint16)]
            for b, label, w in zip(bins, labels, drawn):
                node = 0
                for _ in range(level):
                    node = 2 * node + 1 + int(b[grown.feature[t, node]] > grown.limit[t, node])
                node -= (1 << level) - 1
                for j, k in enumerate(chosen[t][node]):
                    if classes:
                        want[t, int(label), node, j, b[k]] += w
                    else:
                        want[t, :, node, j, b[k]] += (w, w * (label - 5.0))
        seen += len(labels)
    assert seen == n and sorted(found) == list(range(trees))
    for t in range(trees):
        assert np.allclose(found[t], want[t])


def test_limits_are_quantiles_of_all_rows(spark, monkeypatch, vectors):
    values = np.array([r[0].toArray() for r in vectors.select("features").collect()])
    shares = np.arange(1, 31) / 31

    def wanted(column):
        limits = np.unique([column.min(), *np.quantile(column, shares, method="inverted_cdf")])
        return limits[limits < column.max()]

    for found, column in zip(forest.bin_limits(vectors, 6), values.T, strict=True):
        assert np.allclose(found, wanted(column), rtol=0, atol=0)
    # Many parts of many values: ranks may be off by what the steps allow.
    monkeypatch.setattr(forest, "POINTS", 200)
    monkeypatch.setattr(forest, "PARTS", 3)
    monkeypatch.setattr(forest, "TOGETHER", 250)
    with_few = forest.bin_limits(vectors, 6)
    ranks = np.searchsorted(np.sort(values[:, 0]), with_few[0]) / len(values)
    assert len(with_few[0]) == 31 and np.abs(ranks[1:] - shares).max() < 0.01


def test_times_as_drawn():
    random = np.arange(1 << 16).astype(np.uint16)
    assert (forest.times(random) == forest.DRAWN).all()


def test_forest_alone_takes_rows_from_the_staged_table(spark, monkeypatch, vectors):
    """Rows that many tasks scan are not dealt, and no row becomes a vector on the way to the blocks."""
    monkeypatch.setattr(supervised, "MANY_ROWS", 1000)
    monkeypatch.setattr(supervised, "FEW_TASKS", 2)
    df = vectors.select(
        F.expr("number - 1000").alias("price"), F.expr("if(x0 > 1.5, null, number * 0.5 + kind)").alias("size"),
        F.when(F.col("x2") > 0.7, "long").when(F.col("x1") > 1, None).otherwise("short").alias("shape"),
    )
    taken = []
    fit = forest.Forest.fit
    monkeypatch.setattr(forest.Forest, "fit", lambda self, train: taken.append(train) or fit(self, train))
    types = {"price": "numerical", "size": "numerical", "shape": "categorical"}
    result = supervised.regress(df, types, "price", models=["random_forest"])
    assert result.used and result.metrics["r2"] > 0.8 and {r["feature"] for r in result.importance.collect()} == {"size", "shape"}
    plan = taken[0]._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "UDF" not in plan
    assert result.tables["actual_vs_predicted"].count() > 0


def test_plain_features_are_the_vectors_entries(spark, vectors):
    rows = vectors.select(
        F.when(F.col("x0") < 1, F.col("x0")).alias("n0"), F.col("x1").alias("n1"), F.lit(2.0).alias("n2"), F.lit(None).cast("double").alias("n3"),
        F.when(F.col("x4") > 0, "a").when(F.col("x2") > 0, "b").otherwise("(missing)").alias("k0"),
        F.when(F.col("x3") > 1, "only in the test").otherwise("p").alias("k1"), F.col("number").alias("label"), (F.col("x3") <= 1).alias("train"),
    )
    preparation, present = supervised._preparation(rows, ["a", "b", "c", "d"], ["e", "f"])
    assert present == ["a", "b", "c"]
    both = preparation.transform(rows).select(F.col("features").alias("v"), supervised.plain_features(preparation).alias("x"))
    got = [(r["v"].toArray(), np.array(r["x"])) for r in both.collect()]
    assert len(got) == 3000
    for v, x in got:
        assert np.allclose(v, x, rtol=1e-12, atol=1e-12)
