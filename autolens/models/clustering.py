"""K-means with the number of clusters chosen by silhouette.

The starts are fitted on a coreset: rows drawn by their share of the spread, weighted by the
inverse of their chance, so that the loss of any centres on it is near their loss on all rows.
The best of each number of clusters then takes a step on all rows; losses, sizes and the
silhouette are those of all rows. Four scans, whatever the numbers tried.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import finite
from ..operators.local import collected, local_table
from ..operators.moments import moments
from ..operators.sampling import stable_sample
from ..operators.staging import stage
from .screening import ModelResult, feature_columns

# Workers need not be able to import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CLUSTERS = 8
ROWS_PER_CLUSTER = 20
RESTARTS = 2
#: Rows of the coreset, about: all rows where there are half as many.
CORESET_ROWS = 20_000
STEPS = 100
TOLERANCE = 1e-8

#: Centres, a row each, by number of clusters.
Models = dict[int, np.ndarray]


def complete_rows(df: DataFrame, features: list[str]) -> DataFrame:
    """`(f0, f1, ...)` of the rows that have every feature."""
    return df.select(*[finite(col(c)).alias(f"f{i}") for i, c in enumerate(features)]).na.drop()


def standardised(rows: DataFrame, names: list[str]) -> tuple[DataFrame, int]:
    """The rows with columns `s0, s1, ...` of mean 0 and deviation 1 (a constant one is 0), and how many vary."""
    facts = {r["column"]: r for r in moments(rows, names).collect()}
    scaled, varying = [], 0
    for i, name in enumerate(names):
        mean, std = facts[name]["mean"], facts[name]["std"]
        varying += bool(std)
        value = (F.col(name) - F.lit(float(mean))) / F.lit(float(std)) if std else F.lit(0.0)
        scaled.append(value.alias(f"s{i}"))
    return rows.select("*", *scaled), varying


def coreset(points: DataFrame, width: int, n: int, varying: int, size: int = CORESET_ROWS, seed: int = K.SEED) -> DataFrame:
    """`(s0, s1, ..., weight)` of about `size` of the `n` rows.

    A row's chance is half the same for all, half by its share of the squared distances
    from the mean; those of standardised columns sum to n - 1 each. Every row is drawn for
    itself, so that nothing but the drawn ones leave the tasks.
    """
    values = [F.col(f"s{i}") for i in range(width)]
    norm = sum((v * v for v in values), F.lit(0.0))
    share = F.lit(0.5 / n) + norm * (0.5 / (max(varying, 1) * max(n - 1, 1)))
    chance = F.least(F.lit(1.0), share * float(size))
    drawn = points.select(*values, chance.alias("chance"), F.rand(seed).alias("draw")).where("draw < chance")
    return drawn.select(*values, (1 / F.col("chance")).alias("weight"))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1))


def weighted_lloyd(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, float]:
    """Centres and loss: starts drawn by weight and distance, then steps until the loss stays."""
    rng = np.random.default_rng(seed)
    centres = x[[rng.choice(len(x), p=weight / weight.sum())]]
    while len(centres) < k:
        apart = distances(x, centres).min(axis=1) * weight
        chances = apart if apart.sum() > 0 else weight
        centres = np.vstack([centres, x[rng.choice(len(x), p=chances / chances.sum())]])
    loss = np.inf
    for _ in range(STEPS):
        apart = distances(x, centres)
        nearest = apart.argmin(axis=1)
        before, loss = loss, float((apart.min(axis=1) * weight).sum())
        if before - loss <= TOLERANCE * loss:
            break
        mass = np.bincount(nearest, weight, k)
        sums = np.column_stack([np.bincount(nearest, weight * column, k) for column in x.T])
        centres = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centres)
    return centres, loss


def fitted(core: DataFrame, width: int, tries: list[tuple[int, int]], seed: int = K.SEED) -> Models:
    """The best centres of each number of clusters; each `(clusters, start)` is a task of its own."""
    names = [f"s{i}" for i in range(width)]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        k, start = int(group["k"].iloc[0]), int(group["start"].iloc[0])
        group = group.sort_values([*names, "weight"])  # the same whatever order the rows came in
        centres, loss = weighted_lloyd(group[names].to_numpy(float), group["weight"].to_numpy(float), k, seed + start)
        return pd.DataFrame({"k": [k], "start": [start], "loss": [loss], "centres": [centres.ravel()]})

    copies = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(start).alias("start")) for k, start in tries]))
    found = (
        core.select("*", copies.alias("try")).select(*names, "weight", "try.k", "try.start")
        .groupBy("k", "start").applyInPandas(fit, "k int, start int, loss double, centres array<double>")
        .orderBy("k", "loss", "start").collect()
    )
    best: Models = {}
    for r in found:
        best.setdefault(r["k"], np.array(r["centres"]).reshape(r["k"], width))
    return best


def cluster_sums(points: DataFrame, width: int, models: Models) -> dict[int, dict[str, np.ndarray]]:
    """Of each model and cluster the rows, loss, sum of squares and sums of the columns, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros((k, 3 + width)) for k in models}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            squares = (x * x).sum(axis=1)
            for k, centres in models.items():
                apart = distances(x, centres)
                nearest = apart.argmin(axis=1)
                for i, column in enumerate([np.ones(len(x)), apart.min(axis=1), squares, *x.T]):
                    held[k][:, i] += np.bincount(nearest, column, k)
        for k, sums in held.items():
            cluster, item = (m.ravel().astype(np.int32) for m in np.indices(sums.shape))
            yield pa.record_batch(
                [pa.array(np.full(sums.size, k, np.int32)), pa.array(cluster), pa.array(item), pa.array(sums.ravel())],
                names=["k", "cluster", "item", "value"],
            )

    parts = points.select(*[f"s{i}" for i in range(width)]).mapInArrow(run, "k int, cluster int, item int, value double")
    total = {k: np.zeros((k, 3 + width)) for k in models}
    for r in parts.groupBy("k", "cluster", "item").agg(F.sum("value").alias("value")).collect():
        total[r["k"]][r["cluster"], r["item"]] = r["value"]
    return {k: {"n": t[:, 0], "loss": t[:, 1], "squares": t[:, 2], "sums": t[:, 3:]} for k, t in total.items()}


def silhouettes(points: DataFrame, width: int, models: Models, sums: dict[int, dict[str, np.ndarray]]) -> dict[int, float]:
    """Mean silhouette of each model over squared distances and all rows, in one scan; -1 for a
    model whose rows are all in one cluster. A row alone in its cluster counts 0."""
    judged = {k: m for k, m in models.items() if (sums[k]["n"] > 0).sum() > 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = dict.fromkeys(judged, 0.0)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            squares, at = (x * x).sum(axis=1)[:, None], np.arange(len(x))
            for k, centres in judged.items():
                nearest = distances(x, centres).argmin(axis=1)
                n = sums[k]["n"]
                size = np.maximum(n, 1.0)
                mean = np.maximum(0.0, squares + sums[k]["squares"] / size - 2 * x @ (sums[k]["sums"] / size[:, None]).T)
                mean[:, n == 0] = np.inf
                inside = mean[at, nearest] * n[nearest] / np.maximum(n[nearest] - 1, 1.0)
                mean[at, nearest] = np.inf
                outside = mean.min(axis=1)
                larger = np.maximum(inside, outside)
                value = np.where((n[nearest] > 1) & (larger > 0), (outside - inside) / np.where(larger > 0, larger, 1.0), 0.0)
                totals[k] += float(value.sum())
        if totals:
            yield pa.record_batch([pa.array(list(totals), pa.int32()), pa.array(list(totals.values()), pa.float64())], names=["k", "total"])

    scores = dict.fromkeys(models, -1.0)
    if judged:
        parts = points.select(*[f"s{i}" for i in range(width)]).mapInArrow(run, "k int, total double")
        for r in parts.groupBy("k").agg(F.sum("total").alias("total")).collect():
            scores[r["k"]] = r["total"] / sums[r["k"]]["n"].sum()
    return scores


def nearest_centre(centres: np.ndarray) -> Column:
    """The number of the nearest centre, the first of equals."""
    apart = [
        sum(((F.col(f"s{i}") - F.lit(float(v))) * (F.col(f"s{i}") - F.lit(float(v))) for i, v in enumerate(c)), F.lit(0.0))
        for c in centres
    ]
    each = F.array(*apart)
    return (F.array_position(each, F.array_min(each)) - 1).cast("int")


def cluster(df: DataFrame, types: dict[str, str], restarts: int = RESTARTS, coreset_rows: int = CORESET_ROWS) -> ModelResult:
    """Try 2 to 8 clusters of the standardised features, several starts each.

    The silhouette is over squared distances and all rows, the lowest number of clusters
    wins of equals. What leaves the executors is the centres and sums of clusters, never
    more with a larger table.
    """
    result = ModelResult(df.sparkSession, "clustering")
    features, _ = feature_columns(df, types)
    if len(features) < 2:
        raise ValueError(K.MODEL_SENTENCES["no_cluster_features"])
    rows = stage(complete_rows(df, features))
    n = rows.count()
    if n < K.ML_MIN_ROWS:
        raise ValueError(K.MODEL_SENTENCES["few_cluster_rows"])
    names, width = [f"f{i}" for i in range(len(features))], len(features)
    points, varying = standardised(rows, names)
    numbers = range(2, min(MAX_CLUSTERS, max(2, n // ROWS_PER_CLUSTER)) + 1)
    tries = [(k, start) for k in numbers for start in range(restarts)]
    models = fitted(coreset(points, width, n, varying, coreset_rows), width, tries)
    sums = cluster_sums(points, width, models)
    models = {
        k: np.where(sums[k]["n"][:, None] > 0, sums[k]["sums"] / np.maximum(sums[k]["n"], 1)[:, None], m)
        for k, m in models.items()
    }
    sums = cluster_sums(points, width, models)
    scores = silhouettes(points, width, models, sums)
    k = max(scores, key=lambda k: (scores[k], -k))
    score = scores[k]
    elbow = [(i, float(sums[i]["loss"].sum())) for i in numbers]
    assigned = points.select(*names, nearest_centre(models[k]).alias("cluster"))
    summary = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"), *[F.avg(f).alias(c) for f, c in zip(names, features, strict=True)]
    )
    table = collected(summary)[1]  # one row per cluster
    sample = stable_sample(
        assigned.select(F.col("f0").alias("x"), F.col("f1").alias("y"), "cluster"), K.CLUSTER_PLOT_POINTS
    )
    scatter = collected(sample)[1]
    result.used = True
    result.model_type = "clustering:kmeans"
    result.features = features
    result.metrics = {"n_clusters": k, "silhouette": score}
    result.tables = {
        "elbow": local_table(df.sparkSession, elbow, "k int, inertia double"),
        "cluster_distribution": table.select("cluster", "count"),
        "cluster_summary": table.drop("count"),
        "scatter": scatter,
    }
    result.message = K.MODEL_SENTENCES["clusters"].format(k, score)
    return result
