"""Alignment of two tokenizers over a corpus, with inverted bitmaps of id pairs.

A byte-level tokenizer (A) and a piece model (B) cut the same bytes; both ends of a
token are byte offsets, so every stretch between neighbouring ends of either side is one
overlapping pair, and offsets where both end cut the tokens into groups.

Documents are taken in blocks. For each pair of ids a block has compressed bitmaps of its
documents: plane k holds those in which the pair is linked so often that bit k of the
number is set, as 16-bit numbers or, where shorter, as bits. Blocks hold different
documents, so what the corpus has is the sum over blocks of the bits of all planes OR-ed
(documents) and of 2^k times the bits of plane k (links). The sums go back to the blocks,
whose postings turn them into scores of documents.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, plain_text
from .sentencepiece_bpe import SPACE, codec
from .words import _byte_letters, ranked

#: Stretches of text in a block, unless one document has more.
BLOCK_SEGMENTS = 600_000
#: Documents of a block: their numbers in it have 16 bits.
BLOCK_DOCS = 1 << 16
#: White space other than these may be part of a longer piece of B.
CUT = re.compile(r"\s*\S+(?:(?![ \n])\s+\S*)*|\s+")
#: Stretches of characters that all libraries put in the same classes, and that end in no white space.
CLEAR = re.compile("[\x00-\x7fÀ-ÖØ-öø-ſ]*[\x21-\x7eÀ-ÖØ-öø-ſ]")


@dataclass
class Stretches:
    """Distinct stretches of text and what both tokenizers make of them.

    Four numbers for each (tokens of A, tokens of B, groups, links), its groups as text,
    and its linked pairs, `first` to `first + links`: A's id in the upper half.
    """

    numbers: np.ndarray
    broken: np.ndarray
    texts: list[bytes]
    pairs: np.ndarray
    first: np.ndarray


def interleaved(first: np.ndarray, counts: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Ids in the order of their stretches, from those of the stretches marked `first` and of the others."""
    of = np.repeat(first, counts)
    out = np.empty(len(of), np.int64)
    out[of], out[~of] = some, others
    return out


class Aligner:
    """Tokens, groups and links of stretches of text.

    A text is cut before a space or line feed that follows other characters: neither
    tokenizer has a token across such a place, so equal stretches have equal tokens.
    """

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.library_b = SentencePieceProcessor(model_file=piece_path)
        self.a, self.b = Tokenizer.from_file(byte_path), codec(piece_path)
        self.a.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout"):
            raise ValueError("A must be a byte-level tokenizer that changes no character")
        if not self.b.cuts:
            raise ValueError("B must have no longer piece with a line feed")
        byte_of = {c: b for b, c in _byte_letters().items()}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        names = {i: t for t, i in model["vocab"].items() if t not in special}
        shown = [bytes(byte_of[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.size = np.array([len(x) for x in shown], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.ranked = ranked(model, sorted(special))
        # Every id with the sign that may follow it.
        m, n = len(shown), len(self.b.shown_size)
        self.signs = [b"%d%s" % (i, s) for size, s in ((m, b","), (m, b"|"), (n, b","), (n, b";")) for i in range(size)]
        self.sign_size = np.array([len(x) for x in self.signs], np.int64)

    def bytes_a(self, ids: np.ndarray) -> bytes:
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[ids] - (ends - sizes), sizes)
        return self.shown[where].tobytes()

    def ids_a(self, segments: Sequence[str], data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, and how many each has.

        Stretches of well-known characters that end in no white space are encoded as one
        text; where one ends a token does.
        """
        clear = np.zeros(len(segments), bool)
        if self.ranked:
            high = np.diff(np.r_[0, np.cumsum(data >= 128)][ends], prepend=0) > 0
            last = data[ends - 1]
            clear = ~high & (last > 32) & (last < 127)
            for i in np.flatnonzero(high).tolist():
                clear[i] = CLEAR.fullmatch(segments[i]) is not None
        apart = [e.ids for e in self.a.encode_batch([segments[i] for i in np.flatnonzero(~clear).tolist()], add_special_tokens=False)]
        together = "".join(segments if clear.all() else [segments[i] for i in np.flatnonzero(clear).tolist()])
        ids = np.array(self.ranked.encode_ordinary(together) if together else [], np.int64)
        counts = np.zeros(len(segments), np.int64)
        last = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(np.diff(ends, prepend=0)[clear])) + 1
        counts[clear] = np.diff(last, prepend=0)
        counts[~clear] = np.fromiter(map(len, apart), np.int64, len(apart))
        return interleaved(clear, counts, ids, np.fromiter(chain.from_iterable(apart), np.int64)), counts

    def ids_b(self, segments: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of B. The library puts a space before what it encodes, so it encodes
        stretches that begin with one; merge rounds do the others."""
        spaced = np.fromiter((s[0] == " " and len(s) > 1 for s in segments), bool, len(segments))
        chosen = spaced.tolist()
        found = self.library_b.encode([s[1:] for s, c in zip(segments, chosen, strict=True) if c], num_threads=1)
        other, other_counts = self.b.encode_words([s.replace(" ", SPACE) for s, c in zip(segments, chosen, strict=True) if not c])
        counts = np.zeros(len(segments), np.int64)
        counts[spaced] = np.fromiter(map(len, found), np.int64, len(found))
        counts[~spaced] = other_counts
        return interleaved(spaced, counts, np.fromiter(chain.from_iterable(found), np.int64), other), counts

    def stretches(self, segments: Sequence[str]) -> Stretches:
        if not segments:
            none = np.empty(0, np.int64)
            return Stretches(np.empty((4, 0), np.int64), np.empty(0, bool), [], none, none)
        array = pa.array(segments, pa.large_string())
        _, offsets, data = array.buffers()
        ends = np.frombuffer(offsets, np.int64)[1 : len(segments) + 1]
        data = np.frombuffer(data, np.uint8)[: ends[-1]]
        a, a_counts = self.ids_a(segments, data, ends)
        b, b_counts = self.ids_b(segments)
        broken = np.zeros(len(segments), bool)
        whole = data.tobytes()
        if self.bytes_a(a) != whole or self.b.bytes_of(b) != whole:
            a_parts, b_parts = (np.split(x, np.cumsum(c)[:-1]) for x, c in ((a, a_counts), (b, b_counts)))
            raw = [whole[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            broken = np.array([self.bytes_a(x) != r or self.b.bytes_of(y) != r for x, y, r in zip(a_parts, b_parts, raw, strict=True)])
            a, b = a[~np.repeat(broken, a_counts)], b[~np.repeat(broken, b_counts)]
            a_counts, b_counts = np.where(broken, 0, a_counts), np.where(broken, 0, b_counts)
            ends = np.cumsum(np.where(broken, 0, np.diff(ends, prepend=0)))
        total = int(ends[-1])
        # Which bytes end a token, and how many tokens, links and groups have ended before a byte.
        a_ends, b_ends = np.cumsum(self.size[a]), np.cumsum(self.b.shown_size[b])
        a_mark, b_mark = np.zeros(total, bool), np.zeros(total, bool)
        a_mark[a_ends - 1] = True
        b_mark[b_ends - 1] = True

        def ended(mark: np.ndarray) -> np.ndarray:
            return np.r_[0, np.cumsum(mark)]

        cuts = np.flatnonzero(a_mark | b_mark)
        common = a_mark & b_mark
        a_before, b_before, groups_before = ended(a_mark), ended(b_mark), ended(common)
        pairs = a[a_before[cuts]] << 32 | b[b_before[cuts]]
        links, groups = (np.diff(ended(x)[ends], prepend=0) for x in (a_mark | b_mark, common))
        # Tokens by group, A's before B's, each with its sign.
        edges = np.r_[0, np.flatnonzero(common) + 1]
        a_group, b_group = groups_before[a_ends - 1], groups_before[b_ends - 1]
        m, n = len(self.size), len(self.b.shown_size)
        sign = np.empty(len(a) + len(b), np.int64)
        sign[np.arange(len(a)) + b_before[edges[a_group]]] = a + m * common[a_ends - 1]
        sign[np.arange(len(b)) + a_before[edges[b_group + 1]]] = 2 * m + b + n * common[b_ends - 1]
        text = b"".join([self.signs[i] for i in sign.tolist()])
        places = np.r_[0, np.cumsum(self.sign_size[sign])][np.cumsum(a_counts + b_counts)].tolist()
        texts = [text[s:e] for s, e in zip([0, *places[:-1]], places, strict=True)]
        return Stretches(np.array([a_counts, b_counts, groups, links]), broken, texts, pairs, np.cumsum(links) - links)


@functools.lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One for each pair of files and worker process."""
    return Aligner(byte_path, piece_path)


# -- bitmaps ------------------------------------------------------------------------

Plane = tuple[np.ndarray, np.ndarray, bytes, bytes]


def packed(pair: np.ndarray, doc: np.ndarray, docs: int) -> Plane:
    """Bitmaps of documents for each pair, both sorted: which pairs have any, how many
    documents each (negative: as bits), the documents as 16-bit numbers, the bits."""
    at, cards = np.unique(pair, return_counts=True)
    width = -(-docs // 8)
    as_bits = 2 * cards > width
    bits = np.repeat(as_bits, cards)
    row = np.repeat(np.cumsum(as_bits) - 1, cards)[bits]
    dense = np.zeros((int(as_bits.sum()), width * 8), np.uint8)
    dense[row, doc[bits]] = 1
    return at, np.where(as_bits, -cards, cards), doc[~bits].astype("<u2").tobytes(), np.packbits(dense, axis=1).tobytes()


def unpacked(plane: Plane, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and documents of a plane."""
    at, cards, sparse, dense = plane
    width = -(-docs // 8)
    some = cards > 0
    rows, places = np.nonzero(np.unpackbits(np.frombuffer(dense, np.uint8).reshape(-1, width), axis=1)) if len(dense) else (np.empty(0, np.int64),) * 2
    pair = np.concatenate([np.repeat(at[some], cards[some]), at[~some][rows]])
    return pair, np.concatenate([np.frombuffer(sparse, "<u2").astype(np.int64), places])


def planes_of(pair: np.ndarray, doc: np.ndarray, number: np.ndarray, docs: int) -> list[Plane]:
    """Plane k of postings in order: those whose number has bit k."""
    result = []
    for k in range(int(number.max(initial=0)).bit_length()):
        has = (number >> k & 1).astype(bool)
        result.append(packed(pair[has], doc[has], docs))
    return result


def popcounts(planes: Sequence[Plane], pairs: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (bits of all planes OR-ed) and links (bits weighed by plane) of each pair."""
    links = np.zeros(pairs, np.int64)
    codes = []
    for k, plane in enumerate(planes):
        links[plane[0]] += np.abs(plane[1]).astype(np.int64) << k
        pair, doc = unpacked(plane, docs)
        codes.append(pair * docs + doc)
    together = np.concatenate([*codes, np.empty(0, np.int64)]).astype(np.int64)
    together.sort()
    together = together[np.flatnonzero(np.diff(together, prepend=-1))]
    return np.bincount(together // max(docs, 1), minlength=pairs), links


# -- blocks -------------------------------------------------------------------------

BLOCKS = (
    "block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "digests array<string>, pairs array<bigint>, at array<array<int>>, cards array<array<int>>, sparse array<binary>, dense array<binary>"
)
_INTS = pa.list_(pa.list_(pa.int32()))
_ARROW = pa.schema(
    [("block", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")), ("digests", pa.list_(pa.string())),
     ("pairs", pa.list_(pa.int64())), ("at", _INTS), ("cards", _INTS), ("sparse", pa.list_(pa.binary())), ("dense", pa.list_(pa.binary()))]
)


def block_row(align: Aligner, number: int, doc_ids: list[int | None], cut: list[list[str]]) -> pa.RecordBatch:
    """Everything known of some documents, given as their stretches."""
    docs = len(cut)
    sizes = np.fromiter(map(len, cut), np.int64, docs)
    place: defaultdict[str, int] = defaultdict(count().__next__)
    at = np.fromiter(map(place.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum()))
    found = align.stretches(list(place))
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(docs), sizes)
    # A document with a broken stretch has no tokens at all.
    broken = np.bincount(doc, weights=found.broken[at], minlength=docs) > 0
    digests, listed = [], at.tolist()
    for s, e, bad in zip((ends - sizes).tolist(), ends.tolist(), broken.tolist(), strict=True):
        if bad or s == e:
            digests.append("")
        else:
            digests.append(hashlib.sha256(b"".join([found.texts[i] for i in listed[s:e]])[:-1]).hexdigest())
    if broken.any():
        use = ~broken[doc]
        doc, at = doc[use], at[use]
    totals = [np.bincount(doc, weights=c[at], minlength=docs).astype(np.int64) for c in found.numbers]
    # Every link of every document, sorted by pair and document: equal ones are the number.
    pairs, pair_of = np.unique(found.pairs, return_inverse=True)
    each = found.numbers[3][at]
    where = np.repeat(found.first[at] - (np.cumsum(each) - each), each)
    where += np.arange(len(where))
    code = pair_of[where] * docs + np.repeat(doc, each)
    code.sort()
    new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    number_of = np.diff(np.r_[new, len(code)])
    pair, doc = np.divmod(code[new], max(docs, 1))
    planes = planes_of(pair, doc, number_of, docs)
    row = [number, doc_ids, *totals, digests, pairs, *([p[i] for p in planes] for i in range(4))]
    return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)


def pair_index(docs: DataFrame, byte_path: str, piece_path: str, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """The documents in blocks with their inverted bitmaps, columns as in `BLOCKS`.

    A text is null, empty, or its tokens do not give the bytes of a space and the text:
    the document is listed, without tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(byte_path, piece_path)
        number, held, cut, waiting = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plain = text.as_py()
                held.append(doc_id)
                cut.append(CUT.findall(" " + plain) if plain else [])
                waiting += len(cut[-1])
                if waiting >= block_segments or len(held) == BLOCK_DOCS:
                    yield block_row(align, number, held, cut)
                    number, held, cut, waiting = number + 1, [], [], 0
        if held:
            yield block_row(align, number, held, cut)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text")).mapInArrow(run, BLOCKS)


def _planes(at, cards, sparse, dense) -> list[Plane]:
    return [
        (a.values.to_numpy().astype(np.int64), c.values.to_numpy(), s.as_py(), d.as_py())
        for a, c, s, d in zip(at.values, cards.values, sparse.values, dense.values, strict=True)
    ]


def pair_counts(index: DataFrame) -> DataFrame:
    """`(pair, docs, links)` over all blocks, from the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, pairs, *planes in zip(*batch.columns, strict=True):
                found, links = popcounts(_planes(*planes), len(pairs.values), len(doc_ids.values))
                yield pa.record_batch([pairs.values, pa.array(found), pa.array(links)], names=["pair", "docs", "links"])

    rows = index.select("doc_ids", "pairs", "at", "cards", "sparse", "dense").mapInArrow(run, "pair bigint, docs bigint, links bigint")
    return rows.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))


def pair_table(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """`(a_id, b_id, docs, links, best)`: which ids of the two tokenizers stand for the same
    bytes, in how many documents and how often; `best` marks the pairs of each B id that are
    linked most often, ties included."""
    return _ranked(pair_counts(Stage(pair_index(docs, byte_path, piece_path)).read())).select(
        F.shiftright("pair", 32).cast("int").alias("a_id"), F.expr("int(pair & 4294967295)").alias("b_id"), "docs", "links", "best"
    )


def _ranked(counts: DataFrame) -> DataFrame:
    # A group has one row for each A id at most.
    top = F.max("links").over(Window.partitionBy(F.expr("pair & 4294967295")))
    return counts.withColumn("best", F.col("links") == top)


def alignment(docs: DataFrame, byte_path: str, piece_path: str, block_segments: int = BLOCK_SEGMENTS) -> DataFrame:
    """`(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`, a row per input row.

    Null and empty texts, and texts whose tokens do not give the bytes of a space and the
    text (such as ones with U+2581), have zeros and an empty digest, and add to no count.
    Strings of special tokens are plain text. Null doc_ids stay null, repeated rows count
    and come back each, other columns are ignored, an empty table gives no row.
    """
    index = Stage(pair_index(docs, byte_path, piece_path, block_segments))
    counts = Stage(_ranked(pair_counts(index.read())))
    asked = index.read().select("block", F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts.read(), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "links", "best")).alias("answers"))
    joined = index.read().drop("pairs").join(answers, "block", "left").select(
        "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "at", "cards", "sparse", "dense",
        *(F.coalesce(F.col(f"answers.{c}"), F.array()).alias(c) for c in ("place", "links", "best")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *facts, at, cards, sparse, dense, place, links, best in zip(*batch.columns, strict=True):
                docs = len(facts[0].values)
                order = place.values.to_numpy()
                score = np.zeros((2, len(order)), np.int64)
                score[0, order] = links.values.to_numpy()
                score[1, order] = best.values.to_numpy(zero_copy_only=False)
                count_sum, n_best = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                for k, plane in enumerate(_planes(at, cards, sparse, dense)):
                    pair, doc = unpacked(plane, docs)
                    np.add.at(count_sum, doc, score[0, pair] << k)
                    np.add.at(n_best, doc, score[1, pair] << k)
                *numbers, digests = [x.values for x in facts]
                yield pa.record_batch(
                    [*numbers, pa.array(n_best), pa.array(count_sum), digests],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return joined.mapInArrow(
        run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    )
