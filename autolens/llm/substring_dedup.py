"""Removal of passages that an earlier document holds already: seed and extend.

Words become 64-bit hashes. A seed is a run of half the wanted length; winnowing keeps
the seed of least hash in every stretch as long as a passage, so two documents that
share a passage share one of its seeds, at the same place of the passage. Documents meet
on seeds (a join, never all pairs of a group) and matches are extended both ways:

1. As far as a passage with this seed can reach. Occurrences of a seed with equal reach
   form a class; all members but those of the least document are settled at once.
2. Where classes of one seed differ, each class extends step by step: every split of the
   wanted length before and behind the seed is one key, and the least document of each
   key is an aggregate.

What is covered is merged to maximal spans per document. Equality is that of two 64-bit
hashes of the same words: the seed's and the reach's, or two of the whole passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, plain_text

#: Words of a passage that may not repeat.
LENGTH = 50
#: The place of rows without an id: behind all documents.
LAST = 2**63 - 1
#: Odd bases of the two rolling hashes, arithmetic modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of runs of a sequence, for any place and length, from one sum of prefixes."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self._grow(1 << 12)

    def _grow(self, size: int) -> None:
        def powers(x: np.uint64) -> np.ndarray:
            p = np.full(size, x, np.uint64)
            p[0] = 1
            return np.cumprod(p, dtype=np.uint64)

        self.up, self.down = powers(self.base), powers(self.inverse)

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self._grow(2 * len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:], dtype=np.uint64)
        return sums

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The minimum (or maximum) of every `width` neighbours, by doubling."""
    f, m, count = np.minimum if least else np.maximum, 1, len(x) - width + 1
    while 2 * m <= width:
        x = f(x[:-m], x[m:])
        m *= 2
    return f(x[:count], x[width - m : width - m + count])


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


class Winnow:
    """Seeds of one length for passages of `length` words."""

    def __init__(self, length: int) -> None:
        if length < 2:
            raise ValueError("a passage has two words at least")
        self.length, self.seed = length, length // 2
        self.reach = length - self.seed
        self.first, self.second = (Rolling(b) for b in BASES)

    def seeds(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds, hashes of their reach, places. Seeds of equal least hash are all kept,
        so that the choice depends on nothing but the words of the stretch."""
        n = len(hashes)
        sums = self.first.prefixes(hashes)
        starts = np.arange(n - self.seed + 1)
        grams = mixed(self.first.runs(sums, starts, starts + self.seed)) | np.uint64(1)
        width = self.length - self.seed + 1
        rim = np.zeros(width - 1, np.uint64)
        lows = np.concatenate([rim, sliding(grams, width, True), rim])
        at = np.flatnonzero(sliding(lows, width, False) == grams)
        a, b = np.maximum(at - self.reach, 0), np.minimum(at + self.length, n)
        shape = ((at - a) * 2 * self.length + (b - a)).astype(np.uint64)
        second = self.second.prefixes(hashes)
        reach = mixed(mixed(self.second.runs(second, a, b)) + shape)
        return grams[at], reach, at

    def passages(self, hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of all passages that hold one of the seeds at `places`."""
        starts = (places[:, None] - np.arange(self.reach + 1)[None, :]).ravel()
        starts = np.unique(starts[(starts >= 0) & (starts + self.length <= len(hashes))])
        both = [
            mixed(r.runs(r.prefixes(hashes), starts, starts + self.length)) for r in (self.first, self.second)
        ]
        return starts, both[0], both[1]


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind; its result is a written table."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _written(df: DataFrame) -> Stage:
    with freeing_shuffles(df.sparkSession):
        return Stage(df)


def _place() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc")


def _rows(docs: DataFrame) -> DataFrame:
    """`doc` orders the documents; `h` tells apart texts that share it."""
    text = plain_text()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _place(), F.xxhash64(text).alias("h"), text.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, kind))


def seeds_of(rows: DataFrame, length: int) -> DataFrame:
    """`(doc, h, seeds, reaches, places)` of every text that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnow(length)
        for batch in batches:
            docs, hs, found = [], [], []
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()
                if len(words) >= length:
                    docs.append(doc)
                    hs.append(h)
                    found.append(winnow.seeds(word_hashes(words)))
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(hs, pa.int64()), _lists(columns[0], pa.int64()), _lists(columns[1], pa.int64()),
                 _lists(columns[2], pa.int32())],
                names=["doc", "h", "seeds", "reaches", "places"],
            )

    return rows.select("doc", "h", "text").mapInArrow(
        run, "doc bigint, h bigint, seeds array<bigint>, reaches array<bigint>, places array<int>"
    )


def passages_of(rows: DataFrame, length: int) -> DataFrame:
    """`(doc, h, starts, a, b)`: the passages around the seeds at `places` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnow(length)
        for batch in batches:
            found = [
                winnow.passages(word_hashes(text.as_buffer().to_pybytes().split()), places.values.to_numpy())
                for text, places in zip(batch.column(2), batch.column(3), strict=True)
            ]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), _lists(columns[0], pa.int32()), _lists(columns[1], pa.int64()), _lists(columns[2], pa.int64())],
                names=["doc", "h", "starts", "a", "b"],
            )

    return rows.select("doc", "h", "text", "places").mapInArrow(
        run, "doc bigint, h bigint, starts array<int>, a array<bigint>, b array<bigint>"
    )


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, list[Stage]]:
    """`(doc, h, spans)`: words `start` to `end` of each text that an earlier document has.

    `doc` and `h` are those of `_rows`. The spans of a document are not merged yet. The
    stages are to be dropped when the result has been read.
    """
    rows = _rows(docs)
    seeded = _written(seeds_of(rows, length))
    seeds = seeded.read().select("doc", "h", F.inline(F.arrays_zip("seeds", "reaches", "places")))
    seeds = seeds.toDF("doc", "h", "seed", "reach", "place")
    several = seeds.groupBy("seed").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("reach").alias("a"), F.max("reach").alias("b")
    ).where("lo < hi")
    # Aggregates are written before they are joined: Spark splits the rows of a hot key only
    # where both sides of a join come straight from a shuffle.
    several = _written(several.select("seed", F.expr("a <> b").alias("open")))
    shared = _written(seeds.join(several.read(), "seed"))
    seeded.drop()
    several.drop()

    # Equal reach: the least document keeps its words, all others lose them.
    classes = _written(shared.read().groupBy("seed", "reach").agg(F.min("doc").alias("least")))
    met = _written(
        shared.read().join(classes.read(), ["seed", "reach"]).where("doc > least OR open")
        .select("doc", "h", "place", F.expr("doc > least").alias("settled"))
    )
    shared.drop()
    classes.drop()

    # Different reach: the least document of each class, with every passage around the seed.
    # One row for each text on this side, so this join has no hot key.
    open_places = met.read().where("NOT settled").groupBy("doc", "h").agg(F.collect_set("place").alias("places"))
    around = _written(passages_of(rows.join(open_places, ["doc", "h"]), length))
    passages = around.read().select("doc", "h", F.inline(F.arrays_zip("starts", "a", "b"))).toDF("doc", "h", "start", "a", "b")
    firsts = _written(passages.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    later = passages.join(firsts.read(), ["a", "b"]).where("doc > least")
    reach = length - length // 2
    spans = met.read().where("settled").select("doc", "h", F.expr(f"greatest(place - {reach}, 0)").alias("start"), F.expr(f"place + {length}").alias("end"))
    spans = spans.unionByName(later.select("doc", "h", "start", F.expr(f"start + {length}").alias("end")))
    found = _written(spans.groupBy("doc", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    met.drop()
    around.drop()
    firsts.drop()
    return found.read(), [found]


def kept_words(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The words that no span covers; an end may lie behind the last word."""
    n = len(words)
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(ends, n), minlength=n + 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:n]) == 0).tolist()]


def _cleaned(docs: DataFrame, length: int, texts: bool) -> DataFrame:
    spans, _ = repeat_spans(docs, length)
    joined = _rows(docs).join(spans, ["doc", "h"], "left").select("doc_id", "text", "spans.start", "spans.end")
    value = "text string" if texts else "kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, values = [], [], []
            for text, starts, ends in zip(*batch.columns[1:], strict=True):
                words = text.as_buffer().to_pybytes().split()
                kept = kept_words(words, starts.values.to_numpy(), ends.values.to_numpy()) if starts.is_valid else words
                total.append(len(words))
                removed.append(len(words) - len(kept))
                left = b" ".join(kept)
                values.append(left.decode() if texts else hashlib.sha256(left).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(values, pa.string())],
                names=["doc_id", "n_words", "n_removed", value.split()[0]],
            )

    return joined.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {value}")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`(doc_id, n_words, n_removed, text)`: the words left of each text, joined by spaces.

    Rules as for `repeat_report`.
    """
    return _cleaned(docs, length, True)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_sha256)`, one row per input row.

    A word goes if it lies in `length` consecutive words that also occur in a document
    with a smaller doc_id. Windows are judged on the input. Repeats within a document, or
    between rows that share a doc_id, remove nothing; rows without an id come behind all
    others, and remove nothing from each other. Null and empty texts, and texts of white
    space, have no words. Repeated rows come back each; other columns are ignored; an
    empty table gives no row.
    """
    return _cleaned(docs, length, False)
