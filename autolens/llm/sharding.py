"""Shards by a two-pass external shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, shared_folder

SHARDS = 40
SEED = 20_24
#: Bytes of a bucket of the first pass; a task holds one bucket's places, not its rows.
BUCKET_BYTES = 32 << 20
#: Buckets that have a task each; of more buckets a task takes about TASK_BYTES one after the other.
FREE_TASKS = 10_000
TASK_BYTES = 512 << 20
#: Bytes that a row counts beside its text.
ROW_BYTES = 16
#: Copies of one row that a task makes again.
COPY_CHUNK = 10_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and a fixed amount for the row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def permutation(n: int, seed: int, bucket: int) -> np.ndarray:
    """Fisher-Yates: from the last place down, each place swaps with one drawn from those up to it."""
    rng = np.random.default_rng([seed, bucket])
    draws = rng.integers(0, np.arange(n, 0, -1))  # draws[i] for place n - 1 - i
    places = list(range(n))
    for at, other in zip(range(n - 1, 0, -1), draws.tolist(), strict=False):
        places[at], places[other] = places[other], places[at]
    return np.array(places, np.int64)


def whole(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("it")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType)


def row_digest(docs: DataFrame) -> list[Column]:
    """128 bits of a whole row as `d1`, `d2`; null columns and empty ones differ."""
    parts = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        parts.append(c.isNull())
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c.cast("string")  # tells -0.0 from 0.0
        parts.append(F.to_json(F.struct(c.alias("c")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}) if _has_map(f.dataType) else c)
    return [F.xxhash64(F.lit(1), *parts).alias("d1"), F.xxhash64(F.lit(2), *parts).alias("d2")]


def numbered_copies(groups: DataFrame, chunk: int = COPY_CHUNK) -> DataFrame:
    """Each row of `groups` `n` times, numbered from 0 in `copy`; no task makes more than a share of a large group."""
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / chunk))))
    last = F.least((F.col("part") + 1) * chunk, F.col("n")) - 1
    return parts.repartition("d1", "part").withColumn("copy", F.explode(F.sequence(F.col("part") * chunk, last))).drop("part", "n")


def first_places(buckets: DataFrame, group: int = 4096) -> DataFrame:
    """`(bucket, rows, first)`: where each bucket starts when they lie one behind the other.

    Sums of groups of buckets are added up first, so no task orders more than a group of
    buckets or the list of groups.
    """
    wide = buckets.withColumn("far", F.floor(F.col("bucket") / group))
    before = Window.orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    sums = wide.groupBy("far").agg(F.sum("rows").alias("rows"))
    starts = sums.select("far", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("far").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return wide.join(starts, "far").select(
        "bucket", "rows", (F.col("start") + F.coalesce(F.sum("rows").over(inside), F.lit(0))).alias("first")
    )


def shuffled(
    docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, task_bytes: int = TASK_BYTES,
    copy_chunk: int = COPY_CHUNK,
) -> tuple[DataFrame, int]:
    """`(it, place)`: every row as a struct with its place in one random order, and the row count.

    Pass 1 scatters rows to buckets with a hash of the seed, the row's 128-bit digest and its
    number among the rows equal to it in all columns, so copies spread like other rows and no
    bucket is larger than chance makes it. Pass 2 takes a bucket in the order of that hash and
    puts it in Fisher-Yates order. Buckets lie one behind the other: a place is the bucket's
    first place plus the place within.

    Everything derives from the seed and the rows, not from files or tasks: the same rows get the
    same places however they are stored. Since equal rows cannot be told apart, they are counted
    and made again from one of them, which numbers them without gathering them. Every bucket gets
    a row in front that tells its tasks the size and first place; the driver holds neither.
    """
    rows = docs.select(whole(docs), size_of(F.col("text")).alias("size"), *row_digest(docs))
    counts = Stage(rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))).read()
    total = counts.agg(F.sum("n").alias("rows"), F.sum("bytes").alias("bytes"), F.max("n").alias("most")).first()
    volume = total["bytes"] or 0
    buckets = max(1, -(-volume // bucket_bytes))
    single, more = counts.where("n = 1").select("d1", "d2", F.lit(0).cast("bigint").alias("copy")), counts.where("n > 1")
    known, laid = single, rows.withColumn("copy", F.lit(0).cast("bigint"))
    if (total["most"] or 0) > 1:
        known = known.unionByName(numbered_copies(more.drop("bytes"), copy_chunk))
        repeated = more.select("d1", "d2")
        made = rows.join(repeated, ["d1", "d2"], "left_semi").groupBy("d1", "d2").agg(
            F.any_value("it").alias("it"), F.count(F.lit(1)).alias("n")
        )
        laid = laid.join(repeated, ["d1", "d2"], "left_anti").select("it", "d1", "d2", "copy").unionByName(
            numbered_copies(made, copy_chunk).select("it", "d1", "d2", "copy")
        )

    k = F.xxhash64(F.lit(seed), "d1", "d2", "copy")
    bucket = F.pmod(F.col("k"), F.lit(buckets))
    heads = first_places(known.select(k.alias("k")).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows")))
    it = rows.schema["it"].dataType
    lined = laid.select("it", k.alias("k")).select(
        "it", bucket.alias("bucket"), "k", F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("bigint").alias("first")
    ).unionByName(heads.select(F.lit(None).cast(it).alias("it"), "bucket", F.lit(None).cast("bigint").alias("k"), "rows", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, places = 0, 0, np.empty(0, np.int64)
        for batch in batches:
            size = batch.column(2)
            heads = np.flatnonzero(np.asarray(size.is_valid()))
            out = []
            for a, b in zip(np.r_[0, heads], np.r_[heads, len(batch)], strict=True):
                if a < b and size[int(a)].is_valid:
                    first, done = batch.column(3)[int(a)].as_py(), 0
                    places = permutation(size[int(a)].as_py(), seed, batch.column(1)[int(a)].as_py())
                    a += 1
                out.append(first + places[done : done + b - a])
                done += b - a
            data = batch.column(0).filter(size.is_null())
            yield pa.record_batch([data, pa.array(np.concatenate(out), pa.int64())], names=["it", "place"])

    kind = T.StructType([rows.schema["it"], T.StructField("place", T.LongType())])
    # A task takes one bucket, or more of them where there would be too many tasks to plan.
    tasks = min(buckets, max(FREE_TASKS, -(-volume // task_bytes)))
    laid = lined.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions(
        "bucket", F.col("rows").asc_nulls_last(), "k"
    )
    return laid.select("it", "bucket", "rows", "first").mapInArrow(run, kind), total["rows"] or 0


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Shards under `path`, a folder each, rows in order of `slot` within every file.

    The law is `rows`: the random order is cut in `shards` stretches whose counts differ
    by at most one. Columns of the input are kept in the struct `it`.

    The copies of a text are spread like any other rows. Null texts and ids are values
    like others; an empty table gives no shard.
    """
    rows, n = shuffled(docs, seed, bucket_bytes)
    small, larger = divmod(n, shards) if n else (0, 0)
    # The first `larger` shards have a row more.
    edge = larger * (small + 1)
    place = F.col("place")
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - edge) / max(1, small)))
    start = F.least(F.col("shard"), F.lit(larger)) * (small + 1) + F.greatest(F.col("shard") - larger, F.lit(0)) * small
    laid = rows.withColumn("shard", shard.cast("int")).withColumn("slot", (place - start).cast("bigint"))
    laid.select("it", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """`(doc_id, size, text_crc32, law, shard, slot, grown_shard)`, one row per input row,
    read from the shards written. A null text counts as empty."""
    path = f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, shards, seed)
    it = docs.select(whole(docs)).schema["it"]
    kind = T.StructType([it, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    text = F.col("it.text")
    return docs.sparkSession.read.schema(kind).parquet(path).select(
        F.col("it.doc_id").cast("bigint").alias("doc_id"), size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
