"""Near-duplicates by SimHash, linked with anchor points of a covering code."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_text, stage
from .components import components

#: Words of a shingle unless a caller asks for another number; differing bits of a link.
WORDS, BITS = 5, 3
#: Fingerprints of an anchor that are compared as one block.
BLOCK = 16_384
#: Shingles whose bits are counted at once.
SLICE = 1 << 16

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; fewer words are one shingle."""
    from xxhash import xxh64_digest

    found = text.encode().translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    shingles = [joined] if len(found) < words else [joined[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False)]
    return np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(42))), ">u8").astype(np.uint64)


def fingerprint(text: str, words: int) -> int:
    """The unsigned 64-bit SimHash: a bit is 1 if more than half of the shingles' XXH64 have it."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """`(doc_id, fp)`, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text")).mapInArrow(
        run, "doc_id bigint, fp bigint"
    )


def _syndrome(word: Column) -> Column:
    """The exclusive or of the places (1 to 31) of the bits that are set."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    parts = [F.bit_count(word.bitwiseAND(F.lit(m))) % 2 * (1 << k) for k, m in enumerate(masks)]
    return sum(parts[1:], parts[0]).cast("int")


def anchors(fps: DataFrame) -> DataFrame:
    """`(anchor, home, fp)`: each fingerprint at every anchor near it.

    Two fingerprints that differ in at most three bits differ in at most one bit of
    their upper or of their lower half. On 31 bits of each half the codewords of the
    Hamming code are the anchors: every word is within the covering radius 1 of exactly
    one, its home. A fingerprint goes to every anchor within the radius plus the
    threshold of the half, 1 + 1: a word with syndrome s reaches its home by flipping
    place s and the others by flipping two places i and j with i xor j = s, 16 in all
    (a codeword only itself). So of two linked fingerprints each comes to the other's
    home, for at least one half. The 32nd bit of a half is left out of its anchors.
    """
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    rows = fps.select("fp", half).select(
        "fp", "half",
        F.when(F.col("half") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("w"),
    ).withColumn("s", _syndrome(F.col("w")))
    first = F.expr("explode(if(s = 0, array(0), filter(sequence(0, 31), i -> i < (i ^ s))))").alias("i")
    rows = rows.select("*", first)
    flipped = F.expr(
        "w ^ if(i = 0, 0L, shiftleft(1L, i - 1)) ^ if(i ^ s = 0, 0L, shiftleft(1L, (i ^ s) - 1))"
    )
    return rows.select(
        flipped.bitwiseOR(F.col("half").cast("bigint") * (1 << 31)).alias("anchor"), (F.col("i") == 0).alias("home"), "fp"
    )


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words, one row of each against one of the other."""
    # Of a signed number numpy would count the bits of the absolute value.
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int32)


def _forest(homes: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray], bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among homes and between homes and others.

    Both are `(ids, words)`. At most one link for each of them and not all pairs, though
    every pair is compared.
    """
    ids, words = homes
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    step = max(1, (1 << 20) // max(1, len(ids)))
    for at in range(0, len(others[0]), step):
        names, part = others[0][at : at + step], others[1][at : at + step]
        rows, cols = np.nonzero(_distance(part[:, None], words[None, :]) <= bits)
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        ends = np.r_[starts[1:], len(rows)] if len(rows) else []
        for a, b in zip(starts, ends, strict=True):
            x, first = int(names[rows[a]]), int(cols[a])
            if x != int(ids[first]):
                links.append((x, int(ids[first])))
            if b - a > 1:
                top = root(first)
                for c in cols[a + 1 : b].tolist():
                    r = root(c)
                    if r != top:
                        parent[r] = top
                        links.append((int(ids[first]), int(ids[c])))
    return links


#: Groups up to this size are compared all at once, larger ones one by one.
SMALL = 8


def _small_groups(ids: np.ndarray, words: np.ndarray, home: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links within many small groups: the first member of each with its second, and so on."""
    out: list[tuple[int, int]] = []
    for gap in range(1, SMALL):
        # Every member that has another `gap` places behind it in its group.
        sizes = np.maximum(ends - starts - gap, 0)
        firsts = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        firsts = firsts[home[firsts] | home[firsts + gap]]
        firsts = firsts[_distance(words[firsts], words[firsts + gap]) <= bits]
        out += zip(ids[firsts].tolist(), ids[firsts + gap].tolist(), strict=True)
    return out


def link_rows(rows: DataFrame, words: list[str], bits: int, block: int = BLOCK) -> DataFrame:
    """`(u, v)`: enough links to connect all ids of `(anchor, home, id, words...)` that are linked.

    Per anchor every row is compared with the ones at home there. An anchor with more
    than `block` at home is split into parts of that size, each of which meets everything
    that comes to the anchor, so that no task holds more than a part.
    """
    homes = rows.where("home").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    crowded = stage(homes.where(F.col("n") > block).select("anchor", F.ceil(F.col("n") / block).cast("int").alias("parts")))
    if crowded.limit(1).count():
        rows = rows.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        rows = rows.withColumn("own", own).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        # What is at home in one part is a visitor to the others.
        rows = rows.withColumn("home", F.col("home") & (F.col("part") == F.col("own")))
    else:
        rows = rows.withColumn("part", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        none = (np.empty(0, np.int64), np.empty((0, len(words)), np.int64))
        homes = none
        for batch in batches:
            anchor, part, home, ids, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            matrix = np.stack(columns, axis=1)
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(anchor)]
            here = np.add.reduceat(home.astype(np.int64), starts)
            size = ends - starts
            # The first and the last group may go on in other batches; their homes come first.
            edge = np.zeros(len(starts), bool)
            edge[0] = edge[-1] = True
            small = (here > 0) & (size > 1) & (size <= SMALL) & ~edge
            out = _small_groups(ids, matrix, home, starts[small], ends[small], bits)
            for g in np.flatnonzero(edge | (here > 0) & (size > SMALL)):
                a, b, k = int(starts[g]), int(ends[g]), int(here[g])
                key = (int(anchor[a]), int(part[a]))
                if key != at:
                    at, homes = key, none
                old = len(homes[0])
                mine = (ids[a : a + k], matrix[a : a + k])
                if k:
                    homes = (np.concatenate([homes[0], mine[0]]), np.concatenate([homes[1], mine[1]]))
                    if k > 1 or old:
                        out += _forest(homes, mine, bits)
                if len(homes[0]) and b - a > k:
                    out += _forest(homes, (ids[a + k : b], matrix[a + k : b]), bits)
            if out:
                u, v = zip(*out, strict=True)
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return (
        rows.select("anchor", "part", "home", "id", *words).repartition("anchor", "part")
        .sortWithinPartitions("anchor", "part", F.desc("home"), "id").mapInArrow(run, "u bigint, v bigint")
    )


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """`(u, v)`: enough links between fingerprints to connect all that differ in at most
    three bits."""
    rows = anchors(fps)
    return link_rows(rows.select("anchor", "home", F.col("fp").alias("id"), F.col("fp").alias("w0")), ["w0"], BITS, block)


def near_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`(doc_id, fingerprint, component_id)`, one row per input row.

    Fingerprints link at three or fewer differing bits; component_id is the smallest
    doc_id reachable over links, the row's own included. Words are runs of characters
    other than space and U+0009-U+000D in the text with A-Z lower-cased; a text of fewer
    than `words` words is one shingle, a text without words (or null) has fingerprint
    zero, which links like any other. Null doc_ids stay null and are no component's
    smallest unless it has no other; repeated rows come back as often; other columns
    are ignored; an empty table gives no row.

    Equal fingerprints are one node, so copies are never paired, and only fingerprints
    that have a link enter the rounds of the components.
    """
    found = stage(fingerprints(docs, words))
    nodes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = components(links(nodes.select("fp")))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# -- near copies of a given similarity ---------------------------------------------

#: Words of 64 bits of a wide fingerprint; tables it is looked up in, and least hashes in a key of them.
WIDE, TABLES, LEAST = 4, 64, 6
SIMILARITY = 0.8
#: Standard errors that an estimate may be off to the low side.
SLACK = 4.2
#: Documents of a cloud whose shingles are compared as one block.
CLOUD_BLOCK = 512


def wide_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints that stand for at least the similarity.

    Two sets of shingles of Jaccard similarity s have the cosine 2s / (1 + s), and a bit
    of their SimHash differs with the angle's share of a half turn.
    """
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    n = 64 * WIDE
    return round(n * share + SLACK * math.sqrt(n * share * (1 - share)))


def candidate_bits(similarity: float) -> int:
    """Differing bits up to which a pair is a candidate.

    Ties make the bits of small sets differ more often than the angle says, most of all
    for the smallest set that can have one shingle more at the similarity.
    """
    n, m = 64 * WIDE, max(1, math.ceil(similarity / max(1 - similarity, 1e-3) - 1e-9))
    share = math.exp(math.lgamma(m + 1) - math.lgamma(m // 2 + 1) - math.lgamma(m - m // 2 + 1) - (m + 1) * math.log(2))
    return max(wide_bits(similarity), round(n * share + 4.5 * math.sqrt(n * share * (1 - share))))


def wide_fingerprint(text: str, words: int) -> np.ndarray:
    """SimHash of WIDE * 64 bits over distinct shingles; their XXH64 is mixed anew for every word."""
    return wide_of(np.unique(shingle_hashes(text, words)))


def wide_of(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(WIDE, np.int64)
    counts = np.zeros(64 * WIDE, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), SLICE):
            h = hashes[at : at + SLICE, None] * np.array([2 * k + 1 for k in range(WIDE)], np.uint64) + np.arange(WIDE, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            counts += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(hashes)).view(np.int64)


_FACTORS = np.random.default_rng(64).integers(0, 1 << 32, TABLES * LEAST, np.uint32) | np.uint32(1)
_MIX = np.random.default_rng(65).integers(0, 1 << 63, LEAST, np.uint64) * np.uint64(2) + np.uint64(1)


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each table: LEAST minima of the set of shingles, each under a hash of its own.

    Two sets of similarity s have the same key in a table with probability s ** LEAST.
    """
    least = np.full(TABLES * LEAST, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(least, (_FACTORS[:, None] * short[None, at : at + 2048]).min(axis=1), out=least)
    with np.errstate(over="ignore"):
        keys = ((least.reshape(TABLES, LEAST).astype(np.uint64) + np.uint64(1)) * _MIX).sum(axis=1, dtype=np.uint64)
        keys = (keys ^ (keys >> np.uint64(31)) ^ np.arange(TABLES, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


_NAMES = [f"w{k}" for k in range(WIDE)]
#: What tells sets of shingles apart: the fingerprints, their number and the sum of their hashes.
_IDENTITY = [*_NAMES, "fp", "many", "total"]


def wide_rows(docs: DataFrame, words: int) -> DataFrame:
    """`(place, w0, w1, ..., fp, many, total, keys)` of `(place, text)`; fp is the fingerprint with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, narrow, sums, keys = [], [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), words)
                narrow.append(fingerprint_of(hashes))
                hashes = np.unique(hashes)
                prints.append(wide_of(hashes))
                sums.append((len(hashes), int(hashes.sum(dtype=np.uint64).view(np.int64))))
                keys.append(table_keys(hashes))
            found = np.array(prints, np.int64).reshape(-1, WIDE)
            many, total = zip(*sums, strict=True) if sums else ((), ())
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * TABLES), flat)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(found[:, k]) for k in range(WIDE)), pa.array(np.array(narrow, np.uint64).view(np.int64)), pa.array(many, pa.int64()), pa.array(total, pa.int64()), lists],
                names=["place", *_IDENTITY, "keys"],
            )

    return docs.select("place", plain_text().alias("text")).mapInArrow(
        run, "place bigint, " + ", ".join(f"{n} bigint" for n in _IDENTITY) + ", keys array<bigint>"
    )


def _exact_links(names: list[np.ndarray], home: np.ndarray, ids: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect all sets of hashes whose Jaccard similarity reaches `similarity`."""
    sizes = np.array([len(x) for x in names], np.int64)
    codes = np.unique(np.concatenate(names), return_inverse=True)[1] if len(names) else np.empty(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    result = []
    has = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    for a in np.flatnonzero(home):
        mine = codes[starts[a] : starts[a] + sizes[a]]
        has[mine] = True
        both = np.add.reduceat(has[codes], starts)
        has[mine] = False
        for b in np.flatnonzero(both >= similarity * (sizes + sizes[a] - both) - 1e-9).tolist():
            x, y = root(int(a)), root(b)
            if x != y:
                parent[x] = y
                result.append((int(ids[a]), int(ids[b])))
    return result


def exact_links(docs: DataFrame, clouds: DataFrame, words: int, similarity: float, block: int = CLOUD_BLOCK) -> DataFrame:
    """`(u, v)`: enough links to connect the documents of each cloud `(place, cloud)` that have the
    Jaccard similarity of their shingles, all of which are compared.

    A cloud of more than `block` documents is dealt to blocks; each two of them meet in a
    group of their own, so that no task holds more than two blocks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [np.unique(shingle_hashes(t.as_py(), words)).tobytes() for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.binary())], names=["cloud", "place", "hashes"])

    def compare(group: pa.Table) -> pa.Table:
        # A set without shingles is one node only, and never in a cloud.
        found = [np.frombuffer(x, np.uint64) for x in group["hashes"].to_pylist()]
        own, i = group["own"].to_numpy(), group["i"].to_numpy()
        got = _exact_links(found, own == i, group["place"].to_numpy(), similarity)
        u, v = zip(*got, strict=True) if got else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    sizes = clouds.groupBy("cloud").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    dealt = clouds.join(sizes, "cloud").withColumn("own", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))
    hashed = docs.select("place", plain_text().alias("text")).join(clouds, "place").select("cloud", "place", "text").mapInArrow(
        sets, "cloud bigint, place bigint, hashes binary"
    )
    rows = hashed.join(dealt.select("place", "parts", "own"), "place")
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("cloud", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "place", "hashes")
    return rows.groupBy("cloud", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def key_anchors(nodes: DataFrame) -> DataFrame:
    """`(anchor, home, id, words...)`: each set of shingles at the anchor of each of its keys."""
    return nodes.select(F.explode("keys").alias("anchor"), F.lit(True).alias("home"), "id", *_NAMES)


def candidate_links(nodes: DataFrame, similarity: float) -> DataFrame:
    return link_rows(key_anchors(nodes), _NAMES, candidate_bits(similarity))


def anchor_links(nodes: DataFrame) -> DataFrame:
    """`(u, v)`: enough links to connect all ids whose fingerprints differ in at most BITS bits.

    Found as `near_components` does, at the anchors of the covering code: none is missed.
    """
    lowest = stage(nodes.groupBy("fp").agg(F.min("id").alias("low")))
    apart = links(lowest.select("fp")).join(lowest.toDF("u", "low_u"), "u").join(lowest.toDF("v", "low_v"), "v")
    equal = nodes.select("fp", "id").join(lowest, "fp").where("id <> low")
    return apart.select(F.col("low_u").alias("u"), F.col("low_v").alias("v")).unionAll(equal.select("id", "low"))


def _near(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """`(place, group)` of `(place, text)`; places are unique, and stay the same when read again."""
    found = stage(wide_rows(docs, words))
    nodes = stage(
        found.groupBy(*_IDENTITY).agg(F.min(F.struct("place", "keys")).alias("first"))
        .select(*_IDENTITY, F.col("first.place").alias("id"), F.col("first.keys").alias("keys"))
    )
    sets = nodes.where("many > 0")
    linked = components(anchor_links(sets).unionAll(candidate_links(sets, similarity)))
    clouds = linked.select(F.col("node").alias("place"), F.col("root").alias("cloud"))
    clouds = stage(clouds.unionAll(linked.select("root", "root").distinct().toDF("place", "cloud")))
    exact = components(exact_links(docs, clouds, words, similarity))
    rooted = nodes.join(exact, nodes["id"] == exact["node"], "left").select(*_IDENTITY, F.coalesce("root", "id").alias("group"))
    return found.select("place", *_IDENTITY).join(rooted, _IDENTITY).select("place", "group")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`(doc_id, component_id)`: documents linked by a Jaccard similarity of their distinct
    shingles of at least `similarity`.

    Candidates are, first, all texts whose SimHash fingerprints differ in at most BITS bits,
    met at the anchors of the covering code as in `near_components`, and, for the lower
    similarities that no such code covers, sets that share the key of a table and differ in
    few bits of a wide fingerprint. What both connect is a cloud, in which the hashed
    shingles of all documents are compared.
    Only that comparison links. Null and odd rows as in `near_components`; texts without
    words are copies of each other.
    """
    rows = stage(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.monotonically_increasing_id().alias("place")
    ))
    named = rows.select("doc_id", "place").join(_near(rows, words, similarity), "place")
    lowest = named.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return named.join(lowest, "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each group of `near_copies`: that with the smallest doc_id,
    and of rows that share the doc_id the first. Rows with a null doc_id stay only where
    their group has no other id. All columns stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("it")
    numbered = stage(docs.select(whole, F.monotonically_increasing_id().alias("place")))
    near = _near(numbered.select("place", F.col("it.text").alias("text")), words, similarity)
    named = numbered.select("place", F.col("it.doc_id").alias("doc_id")).join(near, "place")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "place")).alias("first")
    best = named.groupBy("group").agg(first).select(F.col("first.place").alias("place"))
    return numbered.join(best, "place", "left_semi").select("it.*")
