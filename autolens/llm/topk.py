"""Exact top-k search by inner product with a KD-tree in every shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARD_ROWS = 4096
LEAF_ROWS = 64
#: Queries whose box bounds are computed at once.
QUERY_BLOCK = 256
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)


def scaled(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component, as long integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    """Not null, without null, NaN and infinite components."""
    bad = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class KDTree:
    """Median splits on the widest side; every node has the tight box of its points.

    Nodes are numbered parent first. `low_id` is the smallest id below a node: a node
    that can only tie with the kth score is opened only for a smaller id.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        order = np.arange(len(ids))
        self.children: list[tuple[int, int] | None] = []
        self.spans: list[tuple[int, int]] = []
        lows, highs, low_ids = [], [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            a, b, above, side = waiting.pop()
            node = len(self.spans)
            if above >= 0:
                self.children[above][side] = node
            part = points[order[a:b]]
            low, high = part.min(axis=0), part.max(axis=0)
            self.spans.append((a, b))
            self.children.append(None)
            lows.append(low)
            highs.append(high)
            low_ids.append(int(ids[order[a:b]].min()))
            width = high.astype(np.float64) - low
            if b - a > leaf and len(width) and width.max() > 0:
                d = int(width.argmax())
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, d], middle)]
                self.children[node] = [-1, -1]
                waiting += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.ids, self.points = ids[order], points[order]
        self.low_id = low_ids
        self.lows, self.highs = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the highest inner product that the box allows."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.highs.T + down @ self.lows.T

    def search(self, query: np.ndarray, query_id: int, bound: np.ndarray, k: int, kth: tuple[int, int] | None) -> list[tuple[int, int]]:
        """Up to k `(score, id)`, best first; none worse than `kth` where that is known.

        The node with the highest bound is opened next. The search ends when no bound
        reaches the kth score, which starts at what other shards have reached.
        """
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        floor = (kth[0], -kth[1]) if kth else None
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            b = -b
            worst = best[0] if len(best) == k else None
            if floor is not None and (worst is None or floor > worst):
                worst = floor
            if worst is not None:
                if b < worst[0]:
                    break
                if b == worst[0] and -self.low_id[node] < worst[1]:
                    continue
            below = self.children[node]
            if below is not None:
                for c in below:
                    if worst is None or bound[c] >= worst[0]:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, e = self.spans[node]
            scores = self.points[a:e] @ query
            ids = self.ids[a:e]
            good = ids != query_id
            if worst is not None:
                good &= scores >= worst[0]
            at = np.flatnonzero(good)
            if len(at) > k:
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
            for i in at:
                item = (int(scores[i]), -int(ids[i]))
                if floor is not None and item < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


HITS = "query_id bigint, score bigint, vec_id bigint"


def _search(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """Hits of the query rows (kind 1) among the vector rows (kind 0) of their shard.

    A task reads a shard's vectors, builds the tree, then streams its queries, so it
    holds one shard and one arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        tree: KDTree | None = None
        for batch in batches:
            dim, shard, kind, vec_id, _, kth_score, kth_id = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dim)
            known = pa.compute.is_valid(batch.column(5)).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.r_[True, (dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])])
            out: list[tuple[int, int, int]] = []
            for a, b in zip(cut, np.r_[cut[1:], len(dim)], strict=True):
                key, d = (dim[a], shard[a]), int(dim[a])
                if key != at:
                    at, held, tree = key, [], None
                points = flat[ends[a] - d : ends[b - 1]].reshape(b - a, d)
                if kind[a] == 0:
                    held.append((vec_id[a:b], points))
                    continue
                if not held:
                    continue
                if tree is None:
                    ids = np.concatenate([x[0] for x in held])
                    vectors = np.concatenate([x[1] for x in held])
                    most = float(np.abs(vectors.astype(np.float64)).max(initial=0))
                    tree = KDTree(ids, vectors)
                    whole = (tree.points, tree.lows, tree.highs)
                    doubles = tuple(x.astype(np.float64) for x in whole)
                top = float(np.abs(points.astype(np.float64)).max(initial=0))
                exact = most * top * max(d, 1) < EXACT
                tree.points, tree.lows, tree.highs = doubles if exact else whole
                queries = points.astype(np.float64) if exact else points
                for s in range(0, b - a, QUERY_BLOCK):
                    block = queries[s : s + QUERY_BLOCK]
                    bound = tree.bounds(block)
                    for i in range(len(block)):
                        j = a + s + i
                        kth = (int(kth_score[j]), int(kth_id[j])) if known[j] else None
                        out += [(int(vec_id[j]), *hit) for hit in tree.search(block[i], int(vec_id[j]), bound[i], k, kth)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "score", "vec_id"])

    laid = rows.select("dim", "shard", "kind", "vec_id", "v", "kth_score", "kth_id")
    return laid.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "vec_id").mapInArrow(run, HITS)


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the k highest integer inner products of each query.

    Candidates are all rows but those with the query's vec_id; ties go to the smaller
    vec_id. Vectors that are null or hold null or non-finite components, and rows with a
    null vec_id, take no part. A vector is compared with those of its own length; scores
    are 64-bit integers. Identical rows count once; rows that share a vec_id but differ
    are candidates each, and as queries they share one result, the best of their scores.
    Other columns are ignored; an empty table gives no row.

    Vectors are dealt to shards by a hash, each with a KD-tree. A query is first searched
    in its own shard; the kth score it reaches there goes with it to all other shards,
    which open only boxes that can beat it. Every shard returns at most k hits a query,
    cut to k again per task before the last shuffle.
    """
    v = F.col("embedding")
    used = vectors.where(usable(v) & F.col("vec_id").isNotNull())
    rows = stage(
        used.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(v, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
        .distinct()
    )
    n = rows.count()
    shards = max(1, -(-n // shard_rows))
    rows = rows.select(
        F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v", "query",
    )
    nothing = F.lit(None).cast("bigint")
    points = rows.select("dim", "shard", F.lit(0).alias("kind"), "vec_id", "v", nothing.alias("kth_score"), nothing.alias("kth_id"))
    queries = rows.where("query").select("dim", "shard", F.lit(1).alias("kind"), "vec_id", "v")
    home = stage(
        _search(points.unionByName(queries.withColumns({"kth_score": nothing, "kth_id": nothing})), k, shards)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = home.distinct().withColumn("rank", F.row_number().over(order))
    reached = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
    hits = home
    if shards > 1:
        away = queries.join(reached, queries["vec_id"] == reached["query_id"], "left").withColumn(
            "to", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
        ).where("to <> shard").select("dim", F.col("to").alias("shard"), "kind", "vec_id", "v", "kth_score", "kth_id")
        hits = hits.unionByName(_search(points.unionByName(away), k, shards))
    return (
        hits.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
