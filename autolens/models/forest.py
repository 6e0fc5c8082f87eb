"""Random forests of large tables, grown level by level on binned rows.

Spark's forest keeps a count for each row and tree in memory and takes about a
microsecond to add a row to a node. Here the training rows are written once as blocks of
bins, one byte for each feature. A pass over the blocks adds up, for one level of all
trees, the labels by node, feature and bin. It takes a tree at a time through some blocks
and divides their rows at each node, so that a node's sums are plain counts of its own
rows; the sums of a tree meet in one group, which splits its nodes. How often a row is in
a tree comes from a stream of its block's own, drawn again in every pass.

The rules are those of Spark's forests: bootstrap by Poisson counts, the features of
each node chosen anew, 32 bins by quantiles, splits by variance or Gini while they gain,
predictions by the trees' means, importances by gain, shares of 1 for each tree.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import stage

BINS = 32
#: Rows of a block, and those that go through a tree together.
BLOCK, TOGETHER = 65_536, 524_288
#: A task describes a feature by so many values at most; each such step moves a quantile by one in 32,768 rows at most.
POINTS, PARTS = 16_384, 32
NODES = "tree int, node int, feature int, bin int, gain double, left array<double>, right array<double>"

# What the tasks run is sent with them, so that workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How often a row is drawn, by a random number of 16 bits: Poisson with mean 1.
DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float64)


#: The least random numbers that mean one time more.
STEPS = np.repeat(np.arange(1, 1 << 16), np.diff(DRAWN).astype(int)).astype(np.uint16)


def times(random: np.ndarray) -> np.ndarray:
    """`DRAWN` of random numbers, as bytes."""
    drawn = (random >= STEPS[0]).view(np.uint8)
    for step in STEPS[1:3]:
        drawn += random >= step
    often = np.flatnonzero(random >= STEPS[3])
    drawn[often] = DRAWN[random[often]]
    return drawn


def matrix(batch: pa.RecordBatch, place: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return batch.column(place).flatten().to_numpy().reshape(batch.num_rows, -1)


def entries(rows: DataFrame) -> Column:
    """The features as an array, be they one or a vector."""
    is_array = isinstance(rows.schema["features"].dataType, T.ArrayType)
    return F.col("features") if is_array else vector_to_array("features")


def described(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order with their weights; where they are many, the ends and values at even ranks."""
    if weights is None:
        values, weights = np.sort(values), np.ones(len(values))
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    last = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    up_to = weights.cumsum()[last]
    values = values[last]
    if len(values) <= POINTS:
        return values, np.diff(up_to, prepend=0.0)
    ranks = (np.arange(POINTS) + 0.5) * (up_to[-1] / POINTS)
    inner = values[np.minimum(np.searchsorted(up_to, ranks), len(values) - 1)]
    return np.concatenate([values[:1], inner, values[-1:]]), np.concatenate([[0.0], np.full(POINTS, up_to[-1] / POINTS), [0.0]])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return described(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def bin_limits(train: DataFrame, width: int) -> list[np.ndarray]:
    """Upper limits of the bins of each feature: its least value and quantiles below the greatest.

    All rows are sorted, in parts; tasks send what describes theirs, to a group for each feature.
    """
    shares = np.arange(1, BINS - 1) / (BINS - 1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in range(width)]
        held, size = [], 0

        def add() -> None:
            for k, column in enumerate(np.concatenate(held).T):
                found[k].append(described(column))
                if len(found[k]) == PARTS:
                    found[k] = [merged(found[k])]

        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch, 0))
                size += batch.num_rows
            if size >= TOGETHER:
                add()
                held, size = [], 0
        if size:
            add()
        for k, parts in enumerate(found):
            if parts:
                values, weights = merged(parts)
                yield pa.record_batch([
                    pa.array([k], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([weights.tobytes()], pa.binary())
                ], names=["feature", "points", "weights"])

    def limits(group: pa.Table) -> pa.Table:
        # One feature's parts; no task has more than POINTS and two values.
        parts = [tuple(np.frombuffer(c.as_buffer(), np.float64) for c in pair) for pair in zip(group["points"], group["weights"], strict=True)]
        values, weights = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(values, kind="stable")
        values, up_to = values[order], weights[order].cumsum()
        # Sums of shares may miss a whole number by rounding.
        inner = values[np.minimum(np.searchsorted(up_to, shares * up_to[-1] * (1 - 1e-12)), len(values) - 1)]
        found = np.unique(np.append(values[0], inner))
        return pa.table({"feature": group["feature"][:1], "limits": pa.array([found[found < values[-1]].tolist()], pa.list_(pa.float64()))})

    parts = train.select(entries(train).alias("x")).mapInArrow(describe, "feature int, points binary, weights binary")
    found = parts.groupBy("feature").applyInArrow(limits, "feature int, limits array<double>").collect()
    by_feature = {r["feature"]: np.array(r["limits"]) for r in found}
    return [by_feature[k] for k in range(width)]


def binned(values: np.ndarray, limits: list[np.ndarray]) -> np.ndarray:
    """The bins of a matrix of features, a row for each feature."""
    return np.stack([np.searchsorted(t, v, side="left").astype(np.uint8) for t, v in zip(limits, np.ascontiguousarray(values.T), strict=True)])


def blocks(train: DataFrame, limits: list[np.ndarray]) -> DataFrame:
    """`(block, bins, labels)`: the rows' bins as bytes, row after row, and their labels."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 32, [], 0

        def packed() -> pa.RecordBatch:
            bins, labels = (np.concatenate(c) for c in zip(*held, strict=True))
            return pa.record_batch([
                pa.array([first]), pa.array([bins.tobytes()], pa.binary()), pa.array([labels.tobytes()], pa.binary())
            ], names=["block", "bins", "labels"])

        for batch in batches:
            values, labels = matrix(batch, 0), batch.column(1).to_numpy()
            held.append((binned(values, limits).T, labels))
            size += len(labels)
            if size >= BLOCK:
                yield packed()
                first, held, size = first + 1, [], 0
        if size:
            yield packed()

    return train.select(entries(train).alias("x"), F.col("label").cast("double")).mapInArrow(
        pack, "block bigint, bins binary, labels binary"
    )


class Splits:
    """The rows that go right at a split, a bit for each; trees share the splits of a feature."""

    def __init__(self, columns: np.ndarray) -> None:
        self.columns, self.count = columns, columns.shape[1]
        self.every = np.packbits(np.ones(self.count, bool))
        self.found: dict[tuple[int, int], np.ndarray] = {}

    def right(self, feature: int, limit: int) -> np.ndarray:
        if (feature, limit) not in self.found:
            self.found[feature, limit] = np.packbits(self.columns[feature] > limit)
        return self.found[feature, limit]


class Codes:
    """The bins of rows in fewer columns: features are joined while no more than `BINS` of their bins occur together.

    `places[k]` is the column of feature k; `counts[k]`, of one that is joined, has a row for
    each code, with a 1 at its bin.
    """

    def __init__(self, columns: np.ndarray) -> None:
        top = columns.max(axis=1).tolist()
        self.places = [0] * len(columns)
        found: list[np.ndarray] = []
        joined: dict[int, np.ndarray] = {}  # bins of the features of the last column, by code
        bins: dict[int, np.ndarray] = {}
        for k in sorted(range(len(columns)), key=top.__getitem__):
            code, seen = columns[k], np.arange(top[k] + 1)
            if joined:
                code = found[-1].astype(np.int64) * (top[k] + 1) + columns[k]
                seen = np.flatnonzero(np.bincount(code))
            if joined and len(seen) <= BINS:
                dense = np.zeros(seen[-1] + 1, np.uint8)
                dense[seen] = np.arange(len(seen))
                found[-1] = dense.take(code)
                joined = {other: b[seen // (top[k] + 1)] for other, b in joined.items()} | {k: seen % (top[k] + 1)}
                bins |= joined
            else:
                found.append(columns[k])
                joined = {k: np.arange(top[k] + 1)}
            self.places[k] = len(found) - 1
        self.counts = {k: np.pad(np.eye(BINS)[b], ((0, BINS - len(b)), (0, 0))) for k, b in bins.items()}
        # Rows of 8, 16 or 32 bytes are taken fastest.
        self.rows = np.zeros((columns.shape[1], max(8, 1 << (len(found) - 1).bit_length())), np.uint8)
        for c, column in enumerate(found):
            self.rows[:, c] = column


class Plan:
    """In which order the nodes of a level look at the columns of `Codes`.

    Nodes that look at more columns come first (`rank`), so that each turn takes the first
    rows. A turn has the column of each node and, by feature, the ranks, nodes and places
    among the chosen features whose sums it gives.
    """

    def __init__(self, chosen: list[list[int]], places: tuple[int, ...]) -> None:
        looked = [sorted({places[k] for k in features}) for features in chosen]
        order = sorted(range(len(chosen)), key=lambda node: -len(looked[node]))
        self.rank = np.empty(len(order), np.uint8 if len(order) <= 256 else np.uint16)
        self.rank[order] = np.arange(len(order))
        self.turns: list[tuple[list[int], dict[int, tuple[list[int], list[int], list[int]]]]] = []
        for turn in range(len(looked[order[0]])):
            part = [node for node in order if len(looked[node]) > turn]
            wanted: dict[int, tuple[list[int], list[int], list[int]]] = {}
            for r, node in enumerate(part):
                for j, k in enumerate(chosen[node]):
                    if places[k] == looked[node][turn]:
                        for known, x in zip(wanted.setdefault(k, ([], [], [])), (r, node, j), strict=True):
                            known.append(x)
            self.turns.append(([looked[node][turn] for node in part], wanted))


class Trees:
    """Trees as arrays by place: the children of node i are 2 i + 1 and 2 i + 2.

    A node that is not split has the limit 255, which sends all rows to the left.
    """

    def __init__(self, trees: int, depth: int, width: int, outputs: int) -> None:
        places = (2 << depth) - 1
        self.depth, self.width = depth, width
        self.feature = np.zeros((trees, places), np.int64)
        self.limit = np.full((trees, places), 255, np.uint8)
        self.value = np.zeros((trees, places, outputs))
        self.gain = np.zeros((trees, width))

    def places(self, tree: int, splits: Splits, depth: int) -> np.ndarray:
        """The place of each row's node among those of a depth, left to right."""
        feature, limit = self.feature[tree].tolist(), self.limit[tree].tolist()
        went_right = [np.zeros_like(splits.every) for _ in range(depth)]
        # Down the left side first, so that few sets of rows wait.
        waiting = [(0, 0, splits.every)]
        while waiting:
            node, level, rows = waiting.pop()
            while level < depth:
                if limit[node] != 255:
                    right = rows & splits.right(feature[node], limit[node])
                    went_right[level] |= right
                    if level + 1 < depth:
                        waiting.append((2 * node + 2, level + 1, right))
                        rows = rows ^ right
                node, level = 2 * node + 1, level + 1
        place = np.zeros(splits.count, np.uint8 if depth <= 8 else np.uint16)
        for right in went_right:
            place <<= 1
            place |= np.unpackbits(right, count=splits.count)
        return place


def choices(seed: int, tree: int, level: int, width: int, some: int) -> np.ndarray:
    """The features that each node of a level may be split by."""
    order = np.random.default_rng([seed, 1, tree, level]).random((1 << level, width)).argsort(axis=1)
    return np.sort(order[:, :some], axis=1)


def level_sums(data: DataFrame, grown: Trees, level: int, some: int, classes: int, centre: float, seed: int) -> DataFrame:
    """`(tree, sums)`: of each task, weights and labels by node, chosen feature and bin."""
    trees, width, outputs = len(grown.feature), grown.width, classes or 2
    nodes = 1 << level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, outputs, nodes, some, BINS))
        plans: dict[tuple[int, ...], list[Plan]] = {}

        def add_rows(held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            columns = np.ascontiguousarray(np.concatenate([bins for _, bins, _ in held]).reshape(-1, width).T)
            splits, codes = Splits(columns), Codes(columns)
            places = tuple(codes.places)
            if places not in plans:
                plans[places] = [Plan(choices(seed, t, level, width, some).tolist(), places) for t in range(trees)]
            y = np.concatenate([labels for _, _, labels in held])
            y = y.astype(np.intp) if classes else y - centre
            streams = [(np.random.default_rng([seed, 0, block]), len(labels)) for block, _, labels in held]
            for t, plan in enumerate(plans[places]):
                drawn = times(np.concatenate([s.integers(0, 1 << 16, n, np.uint16) for s, n in streams]))
                at = np.flatnonzero(drawn != 0)
                if level:
                    rank = plan.rank.take(grown.places(t, splits, level).take(at, mode="clip"), mode="clip")
                    at = at.take(rank.argsort(kind="stable"), mode="clip")
                    count = np.bincount(rank, minlength=nodes)
                else:
                    count = np.array([len(at)])
                ends = count.cumsum().tolist()
                found, label = codes.rows.take(at, axis=0, mode="clip"), y.take(at, mode="clip")
                weight = drawn.take(at, mode="clip").astype(np.float64)
                first = np.repeat(np.arange(nodes) * (BINS * (classes or 1)), count)
                if classes:
                    first += label
                else:
                    label *= weight
                cells = np.empty(len(at), np.intp)
                for looked, wanted in plan.turns:
                    start = 0
                    for column, end in zip(looked, ends, strict=False):
                        if end > start:
                            cells[start:end] = found[start:end, column]
                            start = end
                    cell, size = cells[:start], len(looked) * BINS
                    if classes:
                        cell *= classes
                    cell += first[:start]
                    if classes:
                        got = np.moveaxis(np.bincount(cell, weight[:start], size * classes).reshape(-1, BINS, classes), 2, 0)
                    else:
                        got = np.stack([np.bincount(cell, x[:start], size).reshape(-1, BINS) for x in (weight, label)])
                    for k, (ranks, of_nodes, j) in wanted.items():
                        part = got[:, ranks]
                        sums[t][:, of_nodes, j] += part @ codes.counts[k] if k in codes.counts else part

        held, size, empty = [], 0, True
        for batch in batches:
            for block, bins, labels in zip(*batch.columns, strict=True):
                labels = np.frombuffer(labels.as_buffer(), np.float64)
                held.append((block.as_py(), np.frombuffer(bins.as_buffer(), np.uint8), labels))
                size, empty = size + len(labels), False
                if size >= TOGETHER:
                    add_rows(held)
                    held, size = [], 0
        if held:
            add_rows(held)
        if not empty:
            yield pa.record_batch([
                pa.array(np.arange(trees, dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())
            ], names=["tree", "sums"])

    return data.mapInArrow(add, "tree int, sums binary")


def best_splits(sums: DataFrame, level: int, width: int, some: int, classes: int, seed: int) -> DataFrame:
    """The split of each node of the level that has one that gains, from the sums of all tasks."""
    outputs = classes or 2

    def purity(x: np.ndarray) -> np.ndarray:
        """What is left of the spread: the squares of sums over weights."""
        weight = x.sum(axis=-1) if classes else x[..., 0]
        squares = (x * x).sum(axis=-1) if classes else x[..., 1] ** 2
        return np.divide(squares, weight, out=np.zeros_like(squares), where=weight > 0)

    def split(group: pa.Table) -> pa.Table:
        tree = group["tree"][0].as_py()
        total = np.zeros(outputs * (1 << level) * some * BINS)
        for part in group["sums"]:
            total += np.frombuffer(part.as_buffer(), np.float64)
        x = np.moveaxis(total.reshape(outputs, 1 << level, some, BINS), 0, -1)
        left = x.cumsum(axis=2)
        whole = left[:, :, -1:, :]
        right = whole - left
        heavy = (lambda s: s.sum(axis=-1)) if classes else (lambda s: s[..., 0])
        gain = purity(left) + purity(right) - purity(whole)
        gain[(heavy(left) < 0.5) | (heavy(right) < 0.5)] = 0.0
        best = gain.reshape(1 << level, -1).argmax(axis=1)
        node = np.arange(1 << level)
        j, b = best // BINS, best % BINS
        found = gain[node, j, b]
        # Gains below rounding are none.
        good = np.flatnonzero(found > 1e-12 * np.abs(purity(left[:, 0, -1, :])) + 1e-300)
        chosen = choices(seed, tree, level, width, some)
        return pa.table({
            "tree": pa.array([tree] * len(good), pa.int32()), "node": pa.array(good + (1 << level) - 1, pa.int32()),
            "feature": pa.array(chosen[good, j[good]], pa.int32()), "bin": pa.array(b[good], pa.int32()),
            "gain": pa.array(found[good], pa.float64()),
            "left": pa.array([left[n, j[n], b[n]].tolist() for n in good], pa.list_(pa.float64())),
            "right": pa.array([right[n, j[n], b[n]].tolist() for n in good], pa.list_(pa.float64())),
        })

    return sums.groupBy("tree").applyInArrow(split, NODES)


class ForestModel:
    """The trees with their bins' limits; predicts like one of Spark's models."""

    def __init__(self, grown: Trees, limits: list[np.ndarray], classes: int, centre: float) -> None:
        self.grown, self.limits, self.classes, self.centre = grown, limits, classes, centre

    @property
    def featureImportances(self) -> DenseVector:
        gain = self.grown.gain
        whole = gain.sum(axis=1, keepdims=True)
        shares = np.divide(gain, whole, out=np.zeros_like(gain), where=whole > 0).sum(axis=0)
        return DenseVector(shares / (shares.sum() or 1.0))

    def transform(self, rows: DataFrame) -> DataFrame:
        grown, limits, classes, centre = self.grown, self.limits, self.classes, self.centre

        leaves = grown.value[:, (1 << grown.depth) - 1 :]

        def predicted(held: list[np.ndarray]) -> pa.Array:
            splits = Splits(np.concatenate(held, axis=1))
            votes = np.zeros((splits.count, leaves.shape[2]))
            for t in range(len(leaves)):
                votes += leaves[t].take(grown.places(t, splits, grown.depth), axis=0, mode="clip")
            return pa.array(votes.argmax(axis=1).astype(float) if classes else votes[:, 0] / len(leaves) + centre)

        @F.arrow_udf("double")
        def predict(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held, size = [], 0
            for x in arrays:
                if len(x):
                    held.append(binned(x.flatten().to_numpy().reshape(len(x), -1), limits))
                    size += len(x)
                if size >= TOGETHER:
                    yield predicted(held)
                    held, size = [], 0
            if size:
                yield predicted(held)

        return rows.withColumn("prediction", predict(entries(rows)))


class Forest:
    """A forest of `trees` trees; for `classes` classes, or 0 for numbers."""

    def __init__(self, trees: int, depth: int, seed: int, classes: int = 0) -> None:
        self.trees, self.depth, self.seed, self.classes = trees, depth, seed, classes

    def fit(self, train: DataFrame) -> ForestModel:
        centre, width = float(train.agg(F.avg("label")).first()[0]), len(train.select(entries(train)).first()[0])
        classes = self.classes
        # As many features a node as Spark's forests look at.
        some = max(1, math.ceil(math.sqrt(width)) if classes else math.ceil(width / 3))
        limits = bin_limits(train, width)
        data = stage(blocks(train, limits))
        grown = Trees(self.trees, self.depth, width, classes or 1)

        def value(sums: list[float]) -> np.ndarray:
            x = np.array(sums)
            return x / x.sum() if classes else x[1:] / x[0]

        for level in range(self.depth):
            sums = level_sums(data, grown, level, some, classes, centre, self.seed)
            for r in best_splits(sums, level, width, some, classes, self.seed).collect():
                t, node = r["tree"], r["node"]
                grown.feature[t, node], grown.limit[t, node] = r["feature"], r["bin"]
                grown.gain[t, r["feature"]] += r["gain"]
                for child, part in ((2 * node + 1, r["left"]), (2 * node + 2, r["right"])):
                    while child < grown.value.shape[1]:  # a leaf's rows go on to the left
                        grown.value[t, child] = value(part)
                        child = 2 * child + 1
        return ForestModel(grown, limits, classes, centre)
