"""Hierarchical packing of documents into windows of several context sizes."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text
from .words import encoder

#: Context sizes, longest first; each is half the one before, so every full window is
#: as long as a power of two and needs no padding.
TIERS = (2048, 1024, 512, 256)
#: Ids and documents that a task holds before it plans: 16 MB of ids, some 100 MB of facts of documents.
BLOCK_TOKENS, BLOCK_DOCS = 4_000_000, 200_000
#: Tokens of one training step.
STEP_TOKENS = 32_768

Item = tuple[int, int, int]  # length, document, start


def tier_of(length: int, tiers: Sequence[int] = TIERS) -> int:
    """The shortest context size that holds so many tokens."""
    return next(t for t in reversed(tiers) if length <= t)


def plan(items: Sequence[Item], tiers: Sequence[int] = TIERS, last: bool = True) -> tuple[list[list[Item]], list[Item]]:
    """Windows, each a list of pieces, and what is left for a later plan.

    1. Route: whole windows of the longest tier are cut off a document; the rest, of
       any length up to that, belongs to the shortest tier that holds it.
    2. Pack each tier from the longest: two rests of a tier never fit in one of its
       windows (each fills over half), so a rest opens a window,
    3. and its gap is filled from shorter tiers, the longest that fits first. A gap
       that no rest fits is closed with a cut from a rest of a shorter tier, or else
       of the same tier; what remains of that is routed again.
    4. Only the last window may stay open. It is cut into windows of shorter tiers,
       and less than a window of the shortest tier is left, or ends as a short window
       with `last`.
    """
    longest = tiers[0]
    windows: list[list[Item]] = []
    pool: list[Item] = []
    for length, doc, start in items:
        while length >= longest:
            windows.append([(longest, doc, start)])
            length, start = length - longest, start + longest
        if length:
            pool.append((length, doc, start))
    pool.sort()
    while pool:
        window = [pool.pop()]
        size = tier_of(window[0][0], tiers)
        gap = size - window[0][0]
        while gap and pool:
            at = bisect_right(pool, gap, key=lambda x: x[0])
            if at:
                window.append(pool.pop(at - 1))
                gap -= window[-1][0]
            else:
                shorter = bisect_right(pool, size // 2, key=lambda x: x[0])
                length, doc, start = pool.pop(shorter - 1)  # of the same tier if none is shorter
                window.append((gap, doc, start))
                insort(pool, (length - gap, doc, start + gap))
                gap = 0
        if not gap:
            windows.append(window)
            continue
        for size in tiers[1:]:
            while sum(x[0] for x in window) >= size:
                full, need = [], size
                while need:
                    length, doc, start = window.pop(0)
                    full.append((min(length, need), doc, start))
                    if length > need:
                        window.insert(0, (length - need, doc, start + need))
                    need -= full[-1][0]
                windows.append(full)
        if window and last:
            windows.append(window)
            window = []
        return windows, window
    return windows, []


def step_groups(sizes: Sequence[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each window: the longest windows first, each to the lightest step."""
    steps = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(steps)]
    result = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = heapq.heappop(heap)
        result[i] = g
        heapq.heappush(heap, (load + sizes[i], g))
    return result


SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int, step_group bigint"
)
ARROW = pa.schema(
    [(x.split()[0], pa.int32() if x.endswith(" int") else pa.int64()) for x in SCHEMA.split(", ")]
)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: Sequence[int] = TIERS,
    block_tokens: int = BLOCK_TOKENS, step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """The pieces of all documents: what each window takes of which document.

    Every task encodes its own rows, plans whenever it holds `block_tokens` ids or
    BLOCK_DOCS documents, and carries the open end over, so nothing is shuffled, and
    memory is bounded by the block and one document. Only the last window of a task may be open.

    Null texts are empty and give the end id alone; a null doc_id stays null; repeated
    rows are packed once each; other columns are ignored; an empty table gives no row.
    Windows and steps are numbered within the partition that made them; the partition
    is in the upper bits.
    """
    tiers = tuple(sorted(tiers, reverse=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 36
        end = end_id.to_bytes(4, "little")
        held: dict[int, tuple[int | None, bytes]] = {}
        items: list[Item] = []
        waiting = known = sequences = steps = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, items, waiting, sequences, steps
            windows, items = plan(items, tiers, last)
            groups = step_groups([sum(p[0] for p in w) for w in windows], step_tokens)
            rows = []
            for window, group in zip(windows, groups, strict=True):
                offset, tier = 0, tier_of(sum(p[0] for p in window), tiers)
                for length, doc, start in window:
                    doc_id, ids = held[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, len(ids) // 4, part | sequences, offset, tier, part | (steps + group)))
                    offset += length
                sequences += 1
            steps += max(groups, default=-1) + 1
            held = {d: held[d] for _, d, _ in items}
            waiting = sum(x[0] for x in items)
            columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, ids in encoder(tokenizer).encode_column(batch.column(1)):
                ids += end
                held[known] = (doc_ids[i], ids)
                items.append((len(ids) // 4, known, 0))
                known += 1
                waiting += len(ids) // 4
                if waiting >= block_tokens or len(items) >= BLOCK_DOCS:
                    yield flush(False)
        yield flush(True)

    return docs.select(F.col("doc_id").cast("bigint"), plain_text()).mapInArrow(run, SCHEMA)
