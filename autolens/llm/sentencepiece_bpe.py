"""SentencePiece byte-pair encoding and decoding in vectorised merge rounds."""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, plain_text

SPACE = "▁"
NEVER = np.int32(2**31 - 1)
#: Entries of one generation of the word cache, and rows that are encoded together.
KEPT_WORDS, ROWS = 150_000, 400


class PairTable:
    """Rank and result of merging two symbols, an open-addressed hash table in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray) -> None:
        self.bits = max(4, int(len(left)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        self.results = np.zeros(1 << self.bits, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        left_over = np.arange(len(keys))
        while len(left_over):
            at = slot[left_over]
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            put = np.zeros(len(left_over), bool)
            put[first] = True
            put &= free
            i = left_over[put]
            self.keys[slot[i]], self.ranks[slot[i]], self.results[slot[i]] = keys[i], rank[i], result[i]
            left_over = left_over[~put]
            slot[left_over] = (slot[left_over] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        rank, result = self.ranks[slot], self.results[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        rank[self.keys[slot] != keys] = NEVER
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.keys) - 1)
            here = self.keys[slot[other]]
            hit = here == keys[other]
            rank[other[hit]], result[other[hit]] = self.ranks[slot[other[hit]]], self.results[slot[other[hit]]]
            other = other[~hit & (here != -1)]
        return rank, result


class PieceCodec:
    """Encodes and decodes with a byte-pair model with byte fallback.

    The model keeps white space, puts a space before a text and changes no character;
    other kinds are refused. Symbols are the model's pieces; a character that is no
    piece is symbol -1, never merges, and ends as the pieces of its bytes.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        size = len(library)
        special = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(size)]
        pieces = [library.id_to_piece(i) for i in range(size)]
        if any(library.is_unused(i) for i in range(size)) or "".join(library.encode(" a  b ", out_type=str)) != f"{SPACE*2}a{SPACE*2}b{SPACE}":
            raise ValueError("the model rewrites white space or has unused pieces")
        self.of_byte = np.array([library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        known = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(c not in known for p in known for c in p):
            raise ValueError("the model has pieces of characters that are no pieces")
        scores = np.array([library.get_score(i) for i in range(size)])
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        pairs = [
            (known[p[:k]], known[p[k:]], rank_of[scores[i]], i)
            for p, i in known.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known
        ]
        self.pairs = PairTable(*(np.array(c, np.int32) for c in zip(*pairs, strict=True)))
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # A line feed that occurs in no longer piece cuts a text like a space does.
        self.cuts = not any("\n" in p and len(p) > 1 for p in known)
        # Pieces with a space behind a letter would merge over the cuts at spaces.
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known):
            raise ValueError("the model has pieces that span words")
        shown = [
            bytes([int(p[3:5], 16)]) if library.is_byte(i) else b"" if special[i] else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_size) - self.shown_size
        self.cache = Recent(None, KEPT_WORDS)

    # -- merging ------------------------------------------------------------------

    def encode_words(self, words: Sequence[str], careful: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each word has.

        A round finds the lowest pair rank of every word and merges all pairs of that
        rank, from the left, in all words at once; words without a pair leave the arrays.
        The library merges one pair at a time. That differs only if a merge makes a pair
        that ranks no later than the pair just merged, while the word had more merges in
        the same round: such words are done again, one merge a round (`careful`).
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.symbol[code]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(symbol), NEVER, np.int32)
        result = np.zeros(len(symbol), np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same], result[same] = self.pairs.find(symbol[same], symbol[same + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        doubtful: list[np.ndarray] = []
        while len(symbol):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            ended = lowest == NEVER
            if ended.any():
                out = np.repeat(ended, lengths)
                done.append((word[out], symbol[out], code[out]))
                stay = ~out
                symbol, word, code, rank, result = (x[stay] for x in (symbol, word, code, rank, result))
                lowest, lengths = lowest[~ended], lengths[~ended]
                if not len(symbol):
                    break
            per_symbol = np.repeat(lowest, lengths)
            at = np.flatnonzero(rank == per_symbol)
            if careful:
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]]
            else:
                # Of pairs that overlap every second one merges, counted from the left.
                run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
            symbol[at] = result[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            rank[at] = NEVER
            place = np.cumsum(keep)[at] - 1
            merged = per_symbol[at]
            symbol, word, code, rank, result = (x[keep] for x in (symbol, word, code, rank, result))
            for side in (place - 1, place):
                inside = (side >= 0) & (side + 1 < len(symbol))
                p = side[inside]
                ok = word[p] == word[p + 1]
                r, m = self.pairs.find(symbol[p], symbol[p + 1])
                rank[p] = np.where(ok, r, NEVER)
                result[p] = m
                if not careful:
                    doubtful.append(word[p[ok & (r <= merged[inside])]])
            if len(place):
                rank[place[place == len(symbol) - 1]] = NEVER
        words_out = np.concatenate([x[0] for x in done]) if done else np.empty(0, np.int64)
        order = np.argsort(words_out, kind="stable")
        symbols = np.concatenate([x[1] for x in done])[order] if done else np.empty(0, np.int32)
        codes = np.concatenate([x[2] for x in done])[order] if done else np.empty(0, np.uint32)
        ids, counts = self._with_bytes(words_out[order], symbols, codes, len(words))
        if not careful and doubtful:
            again = np.unique(np.concatenate(doubtful))
            if len(again):
                ids, counts = self._replace(ids, counts, again, *self.encode_words([words[i] for i in again], True))
        return ids, counts

    def _with_bytes(self, word: np.ndarray, symbol: np.ndarray, code: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(symbol < 0)
        if len(odd):
            raw = [np.frombuffer(chr(c).encode(), np.uint8) for c in code[odd].tolist()]
            each = np.ones(len(symbol), np.int64)
            each[odd] = [len(x) for x in raw]
            start = np.cumsum(each) - each
            symbol, word = np.repeat(symbol, each), np.repeat(word, each)
            for s, x in zip(start[odd].tolist(), raw, strict=True):
                symbol[s : s + len(x)] = self.of_byte[x]
        return symbol, np.bincount(word, minlength=words)

    @staticmethod
    def _replace(ids, counts, at, new_ids, new_counts):
        ends = np.cumsum(counts)
        parts, before = [], 0
        new_ends = np.cumsum(new_counts)
        for i, w in enumerate(at.tolist()):
            parts += [ids[before : ends[w] - counts[w]], new_ids[new_ends[i] - new_counts[i] : new_ends[i]]]
            before = ends[w]
        counts = counts.copy()
        counts[at] = new_counts
        return np.concatenate([*parts, ids[before:]]), counts

    # -- texts --------------------------------------------------------------------

    def cut(self, text: str) -> list[str]:
        """The words of a text with the spaces before them; no merge crosses a cut."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        words: list[str] = []
        for i, line in enumerate(marked.split("\n") if self.cuts else [marked]):
            if i:
                words.append("\n")
            first, *rest = line.split(SPACE)
            if "" in rest:
                words += re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
                continue
            if first:
                words.append(first)
            words += [SPACE + w for w in rest]
        return words

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        distinct = list(dict.fromkeys(w for words in cut for w in words))
        ids, counts = self.encode_words(distinct)
        ends = np.cumsum(counts)
        of = {w: ids[e - c : e] for w, c, e in zip(distinct, counts.tolist(), ends.tolist(), strict=True)}
        none = np.empty(0, np.int32)
        return [np.concatenate([of[w] for w in words]) if words else none for words in cut]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes that the pieces stand for."""
        sizes = self.shown_size[ids]
        ends = np.cumsum(sizes)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.shown_at[ids] - (ends - sizes), sizes)
        return self.shown[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before a text goes, bytes that are no UTF-8 become U+FFFD."""
        return plain(self.bytes_of(np.asarray(ids)))

    # -- digests of whole texts, with a cache of words -------------------------------

    def digests(self, texts: Sequence[str]) -> list[tuple[int, str, str]]:
        """`(ids, SHA-256 of the ids, SHA-256 of the decoded text)` of each text."""
        cut = [self.cut(t) for t in texts]
        local: dict[str, tuple[bytes, bytes]] = {}
        missing = []
        for w in set().union(*cut):
            found = self.cache.get(w) or self.cache.old.get(w)
            if found is None:
                missing.append(w)
            else:
                local[w] = found
        if missing:
            ids, counts = self.encode_words(missing)
            written = b",".join([b"%d" % i for i in ids.tolist()]).split(b",") if len(ids) else []
            raw, sizes = self.bytes_of(ids), np.cumsum(self.shown_size[ids])
            a = s = 0
            for w, b in zip(missing, np.cumsum(counts).tolist(), strict=True):
                e = int(sizes[b - 1])
                local[w] = (b",".join(written[a:b]), raw[s:e])
                a, s = b, e
        for w, found in local.items():
            if w not in self.cache:
                self.cache.put(w, found)
        result = []
        for words in cut:
            parts = [local[w] for w in words]
            ids = b",".join([p[0] for p in parts])
            text = plain(b"".join([p[1] for p in parts]))
            result.append(
                (ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            )
        return result


codecs.register_error("each-byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


def plain(raw: bytes) -> str:
    """The text of a document's bytes: without the space put before it, U+FFFD for each broken byte."""
    return raw.removeprefix(b" ").decode("utf-8", "each-byte")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """One codec for each model and worker process."""
    return PieceCodec(path)


def encode_column(docs: DataFrame, model: str) -> DataFrame:
    """`(doc_id, ids)` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = codec(model).encode(part.column(1).to_pylist())
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>"
    )


def decode_column(rows: DataFrame, model: str) -> DataFrame:
    """`(doc_id, text)` from `(doc_id, ids)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(model).decode(np.array(x.as_py() or [], np.int32)) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """`(doc_id, n_tokens, ids_sha256, decoded_sha256)`, one row per input row.

    Every text is encoded and its ids are decoded again; the digests are of the decimal
    ids joined by commas and of the decoded text in UTF-8. Null counts as empty, which
    has no ids and decodes to nothing. Null doc_ids stay null, repeated rows come back
    each, other columns are ignored, an empty table gives no row. Rows are independent,
    so nothing is shuffled; a task holds some hundred texts and a bounded word cache.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, ids, texts = zip(*codec(model).digests(part.column(1).to_pylist()), strict=True)
                yield pa.record_batch(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text")).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
