"""Isolation forest (Liu, Ting and Zhou, 2008).

A tree needs 256 rows however large the table, so drawing the sample and scoring
are the distributed parts: one scan finds the sample, each tree is grown in its own
task, and the trees (100 of at most 511 nodes) travel to the rows for scoring.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..operators.sampling import anomaly_plot_rows
from ..operators.staging import stage
from .clustering import complete_rows
from .screening import ModelResult, feature_columns

TREES = 100
SAMPLE = 256
THRESHOLD = 0.5
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, length double"
EULER = 0.5772156649015329


#: The row's number in the table, by which rows are drawn, and how many rows share a stream.
AT, BLOCK = "_at", 4096
#: Rows scored together: they and their places in a tree fit in a core's cache.
SCORED = 4096

# What the tasks run is sent with them, so that workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mean_path(n) -> float:
    """Average path of an unsuccessful search in a tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def draw_samples(rows: DataFrame, n: int, trees: int, size: int, seed: int) -> DataFrame:
    """`(tree, features...)` with `size` distinct random rows per tree.

    Every tree draws from all rows: each row has its own chance for each tree, somewhat
    above size / n, so that few more than `size` rows of a tree leave the tasks, of which
    the lowest draws are kept. The rule is the same for any number of rows.

    Rows are taken in blocks by their numbers. How many of the cells (row, tree) of a block
    are drawn is one binomial number, and which ones a choice of so many, from a stream of
    the block's own: a row costs nothing unless drawn, and the draws depend neither on
    tasks nor on batches.
    """
    share = min(1.0, (size + 8.0 * math.sqrt(size) + 32.0) / max(n, 1))
    numbered = rows if AT in rows.columns else rows.withColumn(AT, F.monotonically_increasing_id())
    names = [c for c in rows.columns if c != AT]
    per_block = BLOCK

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            blocks, place = at // per_block, at % per_block
            picked, trees_of, draws = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
            for block in np.unique(blocks):
                stream = np.random.default_rng([seed, int(block)])
                cells = stream.choice(per_block * trees, stream.binomial(per_block * trees, share), replace=False)
                r = stream.random(len(cells))
                here = np.flatnonzero(blocks == block)
                row_of = np.full(per_block, -1)
                row_of[place[here]] = here
                row = row_of[cells // trees]
                known = row >= 0
                picked.append(row[known])
                trees_of.append((cells % trees)[known])
                draws.append(r[known])
            chosen = batch.select(list(range(1, batch.num_columns))).take(pa.array(np.concatenate(picked)))
            yield pa.record_batch(
                [*chosen.columns, pa.array(np.concatenate(trees_of).astype(np.int32)), pa.array(np.concatenate(draws))],
                names=[*chosen.schema.names, "tree", "r"],
            )

    fields = [f for f in numbered.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("tree", T.IntegerType()), T.StructField("r", T.DoubleType())])
    copies = numbered.select(AT, *[F.col(f"`{f.name}`") for f in fields]).mapInArrow(draw, schema)
    return (
        copies.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy("r")))
        .where(F.col("place") <= size)
        .drop("r", "place")
    )


def grow_trees(samples: DataFrame, names: list[str], size: int, seed: int) -> DataFrame:
    """One row per node; a tree is grown in one task from its `size` rows."""
    depth = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        values = sample[names].to_numpy(dtype=float)
        # Sorted first, so that the tree does not depend on the order of arrival.
        values = values[np.lexsort(values.T[::-1])]
        random = np.random.default_rng([seed, tree])
        nodes: list[list] = []
        todo = [(np.arange(len(values)), 0, None, None)]
        while todo:
            members, level, parent, side = todo.pop()
            here = len(nodes)
            if parent is not None:
                nodes[parent][side] = here
            low, high = values[members].min(axis=0), values[members].max(axis=0)
            splittable = np.flatnonzero(high > low)
            if level >= depth or len(members) <= 1 or not len(splittable):
                nodes.append([tree, here, -1, 0.0, here, here, level + mean_path(len(members))])
                continue
            feature = int(random.choice(splittable))
            threshold = float(random.uniform(low[feature], high[feature]))
            goes_left = values[members, feature] <= threshold
            nodes.append([tree, here, feature, threshold, -1, -1, 0.0])
            todo.append((members[~goes_left], level + 1, here, 5))
            todo.append((members[goes_left], level + 1, here, 4))
        return pd.DataFrame(
            nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "length"]
        )

    return samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def score_rows(rows: DataFrame, names: list[str], nodes: pd.DataFrame, size: int) -> DataFrame:
    """Rows with `score` (0 to 1, high is anomalous); Arrow batches, tree after tree."""
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    trees = nodes["tree"].nunique()
    # Trees as arrays by place: the children of place i are 2 i + 1 and 2 i + 2. From a
    # node that is not split all rows go on to the left.
    feature = np.zeros((trees, (2 << depth) - 1), np.int64)
    threshold = np.full(feature.shape, np.inf)
    length = np.zeros(feature.shape)
    for t, (_, tree) in enumerate(nodes.sort_values(["tree", "node"]).groupby("tree")):
        found = list(tree[["feature", "threshold", "left", "right", "length"]].itertuples(index=False, name=None))
        todo = [(0, 0)]
        while todo:
            here, place = todo.pop()
            f, limit, left, right, path = found[here]
            if f >= 0:
                feature[t, place], threshold[t, place] = f, limit
                todo += [(left, 2 * place + 1), (right, 2 * place + 2)]
                continue
            while place < length.shape[1]:
                length[t, place] = path
                place = 2 * place + 1
    norm = trees * (mean_path(size) or 1.0)
    chunk = SCORED

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        values = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total = np.zeros(len(values))
        for first in range(0, len(values), chunk):
            flat = values[first : first + chunk].ravel()
            base = np.arange(0, len(flat), len(columns))
            for t in range(trees):
                # The places of the rows in the tree, level by level.
                node = np.zeros(len(base), np.int64)
                for _ in range(depth):
                    # All places are valid; "clip" saves the check.
                    right = flat.take(base + feature[t].take(node, mode="clip"), mode="clip") > threshold[t].take(node, mode="clip")
                    node += node
                    node += 1
                    node += right
                total[first : first + chunk] += length[t].take(node, mode="clip")
        return pd.Series(np.exp2(-total / norm))

    return rows.withColumn("score", score(*names))


def detect_anomalies(
    df: DataFrame, types: dict[str, str], trees: int = TREES, seed: int = K.SEED
) -> ModelResult:
    """Score every complete row and flag those above 0.5."""
    result = ModelResult(df.sparkSession, "anomaly")
    features, _ = feature_columns(df, types)
    if len(features) < 2:
        raise ValueError(K.MODEL_SENTENCES["no_anomaly_features"])
    # Numbered before the rows are written: the draws do not depend on the files.
    numbered = stage(complete_rows(df, features).withColumn(AT, F.monotonically_increasing_id()))
    rows = numbered.drop(AT)
    n = rows.count()
    if n < K.ML_MIN_ROWS:
        raise ValueError(K.MODEL_SENTENCES["few_anomaly_rows"])
    size = min(SAMPLE, n)
    names = [f"f{i}" for i in range(len(features))]
    nodes = grow_trees(draw_samples(numbered, n, trees, size, seed), names, size, seed).toPandas()
    scored = score_rows(rows, names, nodes, size).withColumn("anomaly", F.col("score") > THRESHOLD)
    scored = stage(scored)
    count = scored.agg(F.coalesce(F.sum(F.col("anomaly").cast("bigint")), F.lit(0))).first()[0]
    result.used = True
    result.model_type = "anomaly:isolation_forest"
    result.features = features
    result.metrics = {"anomaly_count": count, "anomaly_rate": count / max(n, 1)}
    result.tables = {
        "scores": scored.select(*[F.col(f).alias(c) for f, c in zip(names, features)], "score", "anomaly"),
        "scatter": anomaly_plot_rows(scored, "anomaly").select(
            F.col("f0").alias("x"), F.col("f1").alias("y"), "anomaly", "score"
        ),
    }
    result.message = K.MODEL_SENTENCES["anomalies"].format(count)
    return result
