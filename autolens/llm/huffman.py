"""Token ids in files of canonical, length-limited Huffman code.

A file is a Parquet table of blocks, so that Spark writes and reads it on any store.
Each block decodes on its own: every document's bits start on a byte, and the bit
offset of every STEP-th id is noted, so that all of these runs are decoded side by
side from one lookup table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, plain_text, shared_folder
from .words import encoder

#: Longest code word; the decoding table has two entries for each value of so many bits.
MAX_BITS = 16
#: Ids between two noted bit offsets.
STEP = 128
#: Ids of a block, unless one document has more.
BLOCK_IDS = 1 << 17


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits` (package-merge); 0 for unused symbols.

    Ties go to the smaller symbol. A single used symbol gets one bit.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.lexsort((used, counts[used]))]
    weights = counts[order].astype(np.int64)
    # Level by level, the list of the level below is packed in pairs and merged with the
    # single symbols; `singles` notes which entries of a level are symbols.
    level, singles = weights, [np.ones(len(weights), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        level = both[place]
        singles.append(place < len(weights))
    take = 2 * (len(weights) - 1)
    result = np.zeros(len(weights), np.int64)
    for single in reversed(singles):
        n = int(single[:take].sum())
        result[:n] += 1
        take = 2 * (take - n)
    lengths[order] = result
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words by length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    code, before = 0, 0
    sizes = lengths[order].astype(int)
    for n in np.unique(sizes):
        code <<= n - before
        here = order[sizes == n]
        codes[here] = code + np.arange(len(here))
        code, before = code + len(here), int(n)
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next `max_bits` bits the symbol and the length of its code."""
    order = np.flatnonzero(lengths)
    order = order[np.lexsort((order, lengths[order]))]
    spans = np.left_shift(1, max_bits - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return symbols, sizes


def encode_ids(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all documents, how many bytes each has, and the bits before each id
    within its document. `starts` are the places where a document (of at least one id)
    begins; its bits begin on a byte.
    """
    size = lengths[ids].astype(np.int64)
    before = np.cumsum(size) - size
    counts = np.diff(np.r_[starts, len(ids)])
    before -= np.repeat(before[starts], counts)
    bits = np.add.reduceat(size, starts)
    sizes = -(-bits // 8)
    at = before + 8 * np.repeat(np.cumsum(sizes) - sizes, counts)
    # A code word of up to 16 bits touches three bytes; bits of different ids never meet,
    # so sums of the parts are the bytes.
    total = int(sizes.sum())
    value = codes[ids].astype(np.int64) << (24 - size - (at & 7))
    byte = at >> 3
    out = np.bincount(byte, weights=value >> 16, minlength=total + 2)
    out += np.bincount(byte + 1, weights=value >> 8 & 255, minlength=total + 2)
    out += np.bincount(byte + 2, weights=value & 255, minlength=total + 2)
    return out[:total].astype(np.uint8), sizes, before


def decode_ids(data: np.ndarray, at: np.ndarray, counts: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """`counts` ids from each of the bit offsets `at`, one run after the other.

    All runs advance together, an id at a time, the longest runs first in the arrays so
    that the ones still going are always in front.
    """
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 16 | padded[1:-2] << 8 | padded[2:-1]
    out = np.zeros(int(counts.sum()), np.uint32)
    order = np.argsort(-counts, kind="stable")
    bit, place = at.astype(np.int64)[order], (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    live = np.searchsorted(-counts[order], -np.arange(1, longest + 1), side="right")
    for n in live.tolist():
        b = bit[:n]
        v = window[b >> 3] >> (24 - max_bits - (b & 7)).astype(np.uint32) & ((1 << max_bits) - 1)
        out[place[:n]] = symbols[v]
        bit[:n] += sizes[v]
        place[:n] += 1
    return out


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """`(doc_id, ids)`: little-endian unsigned ids of `width` bytes with the end id, as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = encoder(tokenizer).encode_column(part.column(1))
                ids = [np.frombuffer(x + end, "<u4").astype(f"<u{width}").tobytes() for _, x in found]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text")).mapInArrow(
        run, "doc_id bigint, ids binary"
    )


def id_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How often each id occurs: every task counts its own, so at most the vocabulary leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for x in batch.column(0):
                here = np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"))
                if len(here) > len(total):
                    total = np.r_[total, np.zeros(len(here) - len(total), np.int64)]
                total[: len(here)] += here
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    found = rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    counts[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


BLOCKS = (
    "part int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, "
    "sizes array<bigint>, data binary, offsets array<int>"
)


def blocks(tokens: DataFrame, lengths: np.ndarray, width: int, block_ids: int) -> DataFrame:
    """Blocks of whole documents in ascending order of doc_id, in code.

    `first` counts the ids before the block in its own file, `offsets` are bits within
    the document, `sizes` the bytes of each document.
    """
    codes = canonical_codes(lengths)
    arrow = pa.schema(
        [("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
         ("counts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()), ("offsets", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        waiting = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join([x for _, x in held]), f"<u{width}")
            counts = np.array([len(x) // width for _, x in held])
            starts = np.cumsum(counts) - counts
            data, sizes, before = encode_ids(ids, starts, lengths, codes)
            offsets = np.concatenate([before[s : s + n : STEP] for s, n in zip(starts, counts, strict=True)])
            row = [part, number, first, len(ids), [d for d, _ in held], counts, sizes, data.tobytes(), offsets.astype(np.int32)]
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc_id, ids in zip(*batch.columns, strict=True):
                held.append((doc_id.as_py(), ids.as_py()))
                waiting += len(held[-1][1]) // width
                if waiting >= block_ids:
                    yield block()
                    number, first, held, waiting = number + 1, first + waiting, [], 0
        if held:
            yield block()

    # Rows that share a doc_id, or have none, spread by the hash of their ids.
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    ordered = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "ids").mapInArrow(run, BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, max_bits: int = MAX_BITS, block_ids: int = BLOCK_IDS) -> None:
    """Token files of all documents under `path`: `blocks` and the code lengths in `code`.

    Texts are tokenized once, to a written table from which the ids are counted and which
    is then put in order, two bytes an id where the vocabulary allows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    tokens = Stage(tokenized(docs, tokenizer, end_id, width))
    lengths = code_lengths(id_counts(tokens.read(), width), max_bits)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(used.tolist(), lengths[used].tolist(), max_bits)], "ids array<bigint>, lengths array<int>, max_bits int").coalesce(1).write.parquet(f"{path}/code")
    blocks(tokens.read(), lengths, width, block_ids).write.option("compression", "none").parquet(f"{path}/blocks")
    tokens.drop()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """`(doc_id, start, n_tokens, ids)` from token files, ids as binary; `start` counts the
    ids of all documents before it.

    The ids of each file, a row per file, are added up on the driver; a block needs
    nothing else from outside.
    """
    code = spark.read.parquet(f"{path}/code").first()
    lengths = np.zeros(max(code["ids"], default=0) + 1, np.uint8)
    lengths[code["ids"]] = code["lengths"]
    max_bits = code["max_bits"]
    table = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, before = {}, 0
    for part, n in totals:
        base[part], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, sizes = decoding_table(lengths, max_bits)
        for batch in batches:
            for part, _, first, n_ids, doc_ids, counts, bytes_, data, offsets in zip(*batch.columns, strict=True):
                counts, bytes_ = counts.values.to_numpy(), bytes_.values.to_numpy()
                runs = -(-counts // STEP)
                at = offsets.values.to_numpy() + 8 * np.repeat(np.cumsum(bytes_) - bytes_, runs)
                each = np.full(int(runs.sum()), STEP, np.int64)
                each[np.cumsum(runs) - 1] = counts - (runs - 1) * STEP
                ids = decode_ids(np.frombuffer(data.as_buffer(), np.uint8), at, each, symbols, sizes, max_bits).astype("<u4")
                ends = np.cumsum(counts)
                yield pa.record_batch(
                    [
                        doc_ids.values, pa.array(base[part.as_py()] + first.as_py() + ends - counts), pa.array(counts),
                        pa.array([ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return table.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """`(doc_id, start, n_tokens, ids_crc32)` of every document, from files written and read back.

    Null texts are empty and have the end id alone; null doc_ids come first in the order;
    rows that share a doc_id are in the order of a hash of their ids; other columns are ignored; an
    empty table gives no row.
    """
    path = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    back = read_ids(docs.sparkSession, path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
