"""Records of delimited text whose quoted cells may hold line breaks.

Spark's line reader splits a large file over many tasks, but a line may lie inside a
quoted cell. Whether it does is the parity of the quotes before it. So quotes are counted
per file block in parallel, the parity at the start of each block is a running sum over
blocks, and each task then cuts its own lines into records. A record that crosses a
block's end is put together from the pieces, at most two for each block, and only these
are shuffled. Files without such cells, told by the same count, are cut at lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.staging import stage

#: Blocks whose start is broadcast; one block is up to `spark.sql.files.maxPartitionBytes`.
BROADCAST_BLOCKS = 200_000


@dataclass
class Records:
    """`rows` are `(file, line, value)`, a row for each record that is not blank; `heads` are
    `(file, path, line, header)`, the first record of each file."""

    rows: DataFrame
    heads: DataFrame
    encoding: str
    unbalanced: int
    files: int

    def with_heads(self, heads: DataFrame) -> DataFrame:
        """`rows` with columns of their file, without a shuffle by file unless files are very many."""
        return self.rows.join(F.broadcast(heads) if self.files <= BROADCAST_BLOCKS else heads, "file")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(file, path, block, line, value)`; lines are numbered in file order within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value",
    )


def cut_blocks(lines: DataFrame) -> DataFrame:
    """`(file, block, line, piece, value)` from lines in order with `inside`, the parity at
    the start of their block. `piece` is 0 for a whole record, 1 for the end (or middle) of
    one that an earlier block began, 2 for one that goes on in the next block."""
    names = ["file", "block", "line", "piece", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: tuple[int, int] | None = None
        held: list[str] = []
        start = (0, 0)  # line where the open record began, and its piece
        is_open = False
        for batch in batches:
            out: list[tuple[int, int, int, int, str]] = []
            for file, block, line, inside, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != here:
                    if held:
                        out.append((*here, start[0], start[1] or 2, "\n".join(held)))
                    here, held, is_open = (file, block), [], bool(inside)
                    start = (line, 1 if inside else 0)
                if not held and not is_open:
                    start = (line, 0)
                held.append(value)
                is_open ^= value.count('"') % 2 == 1
                if not is_open:
                    out.append((file, block, *start, "\n".join(held)))
                    held, start = [], (line, 0)
            yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], names=names) if out else empty
        if held:
            yield pa.record_batch([pa.array([x]) for x in (*here, start[0], start[1] or 2, "\n".join(held))], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    empty = pa.record_batch([pa.array([], k) for k in kinds], names=names)
    return lines.select("file", "block", "line", "inside", "value").mapInArrow(
        run, "file bigint, block bigint, line bigint, piece bigint, value string"
    )


def joined_pieces(pieces: DataFrame) -> DataFrame:
    """Records that cross blocks, from their pieces."""
    order = Window.partitionBy("file").orderBy("block", "piece")
    numbered = pieces.withColumn("record", F.sum((F.col("piece") == 2).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "piece", "line", "value")))
    whole = numbered.groupBy("file", "record").agg(parts.alias("parts"))
    return whole.select("file", F.expr("parts[0].line").alias("line"), F.array_join("parts.value", "\n").alias("value"))


def read_records(spark: SparkSession, path: str) -> Records:
    """Encoding (UTF-8 where every line is, else Latin-1, which accepts any byte), headers and records.

    A file with an odd number of quotes has a stray one: it is cut at lines and counted in
    `unbalanced`.
    """
    lines = text_lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = stage(lines.groupBy("file", "path", "block").agg(
        F.sum(quotes).alias("quotes"), F.max(quotes % 2).alias("odd"), F.min(F.is_valid_utf8("value")).alias("valid"),
        F.min("line").alias("line"), F.min_by("value", "line").alias("first"),
    ))
    facts = blocks.agg(F.min("valid").alias("valid"), F.max("odd").alias("odd"), F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files")).first()
    encoding = "ISO-8859-1" if facts["valid"] is False else "UTF-8"

    def decoded(name: str):
        value = F.decode(F.col(name).cast("binary"), encoding) if encoding != "UTF-8" else F.col(name)
        return value.alias(name)

    of_file = Window.partitionBy("file")
    earlier = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.withColumn("broken", F.sum("quotes").over(of_file) % 2 == 1)
        .withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
        .withColumn("number", F.row_number().over(of_file.orderBy("block")))
    )
    unbalanced = blocks.where("number = 1 AND broken").count() if facts["odd"] else 0
    heads = blocks.where("number = 1").select("file", "path", "line", F.col("first").alias("header"))
    rows = lines.select("file", "block", "line", decoded("value"))
    if facts["odd"]:
        starts = blocks.select("file", "block", "inside", "broken")
        if facts["n"] <= BROADCAST_BLOCKS:
            rows = rows.join(F.broadcast(starts), ["file", "block"])
        else:
            rows = rows.join(starts, ["file", "block"]).sortWithinPartitions("file", "block", "line")
        cut = stage(cut_blocks(rows.where("NOT broken")))
        whole = cut.where("piece = 0").select("file", "line", "value").unionByName(joined_pieces(cut.where("piece > 0")))
        rows = whole.unionByName(rows.where("broken").select("file", "line", "value"))
        # A header may have line breaks too.
        first = heads.drop("header")
        first = F.broadcast(first) if facts["files"] <= BROADCAST_BLOCKS else first
        heads = rows.withColumnRenamed("value", "header").join(first, ["file", "line"])
    rows = rows.select("file", "line", F.regexp_replace("value", "\r\\z", "").alias("value"))
    heads = heads.select("file", "path", "line", decoded("header") if not facts["odd"] else "header")
    heads = heads.withColumn("header", F.regexp_replace("header", "^\ufeff|\r\\z", ""))
    # One row for each file, found once.
    return Records(rows.where("value <> ''"), stage(heads), encoding, unbalanced, facts["files"])
