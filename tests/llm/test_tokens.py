"""Packing, SentencePiece and Huffman files against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from helpers import texts_of
from tokenizers import Tokenizer

from autolens.llm import huffman, packing
from autolens.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, QUERIES, WORD_TOKENIZER
from autolens.llm.sentencepiece_bpe import codec, decode_column, digests, encode_column
from autolens.llm.words import WordEncoder

PARTS = [
    "a", "b", "th", "the", " ", "  ", "\n", "\n\n", "é", "É", "é", "中", "文", "😀", "\t", "▁", "1", "23", "!", "!!", "\x00", "ab",
    "ing", "ß", "      ", "'s", "'", "don't", ",", ".", "|", "\xa0", "\x1c", " ", "<|endoftext|>", "<s>", "-", "İ", "Σ", "ſ", "²",
]


def odd_texts(n=1500, seed=4):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return made + ["", " ", "\n", "a" * 3000, "the" * 700, " " * 100, "ab" * 500, " " * 17 + "x" + " " * 33, "-" * 333, "0" * 50]


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_words_equal_the_library(path, folder):
    own, library = WordEncoder(path), Tokenizer.from_file(path)
    texts = odd_texts() + list(texts_of(folder).values())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.ids, text[:200]


def test_word_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr("autolens.llm.words.KEPT_CHUNKS", 5)
    own, library = WordEncoder(BYTE_TOKENIZER), Tokenizer.from_file(BYTE_TOKENIZER)
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i % 7)}x" for i in range(500))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.inner) <= 5 and len(own.inner.old) <= 5


def check_pieces(pieces, documents):
    """Each id of each document lies in one piece; windows are gapless and full."""
    spans, windows = {}, {}
    for p in pieces:
        spans.setdefault(p["doc_id"], []).append((p["start"], p["length"], p["doc_tokens"]))
        windows.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(spans) == set(documents)
    for doc, found in spans.items():
        at = 0
        for start, length, total in sorted(found):
            assert start == at and length > 0 and total == documents[doc]
            at += length
        assert at == documents[doc]
    sizes = []
    for found in windows.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes, default=0) <= packing.TIERS[0]
    return sizes


def test_plan_fills_all_windows_but_the_last():
    rng = random.Random(2)
    for _ in range(200):
        items = [(rng.choice((1, 3, 255, 256, 257, 1024, 2047, 2048, 2049, rng.randint(1, 9000))), i, 0) for i in range(rng.randint(0, 60))]
        windows, rest = packing.plan(items)
        assert not rest
        sizes = [sum(p[0] for p in w) for w in windows]
        assert sum(sizes) == sum(x[0] for x in items)
        assert sum(s not in packing.TIERS for s in sizes) <= 1
        pieces = [
            {"doc_id": d, "start": s, "length": n, "doc_tokens": items[d][0], "sequence_id": k, "offset": sum(p[0] for p in w[:j])}
            for k, w in enumerate(windows) for j, (n, d, s) in enumerate(w)
        ]
        check_pieces(pieces, {d: n for n, d, _ in items})


def test_plan_prefers_whole_short_documents():
    windows, _ = packing.plan([(1500, 0, 0), (400, 1, 0), (148, 2, 0)])
    assert windows == [[(1500, 0, 0), (400, 1, 0), (148, 2, 0)]]


def test_step_groups_are_balanced():
    sizes = [2048] * 31 + [1024] * 17 + [512] * 9 + [256] * 5
    groups = packing.step_groups(sizes, 8192)
    loads = {}
    for s, g in zip(sizes, groups, strict=True):
        loads[g] = loads.get(g, 0) + s
    assert max(loads.values()) <= 8192 and max(loads.values()) - min(loads.values()) <= 1024


@pytest.mark.parametrize("block", [50, packing.BLOCK_TOKENS])
def test_pack_odd_rows(spark, odd_docs, block):
    library = Tokenizer.from_file(BYTE_TOKENIZER)
    rows = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows.collect()}
    pieces = packing.pack(rows, BYTE_TOKENIZER, block_tokens=block).collect()
    check_pieces(pieces, {d: len(x) for d, x in ids.items()})
    for p in pieces:
        part = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert p["ids_crc32"] == zlib.crc32(part.tobytes())


def test_pack_null_ids_repeated_rows_and_no_rows(spark, odd_docs, no_docs):
    pieces = packing.pack(odd_docs, BYTE_TOKENIZER).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 8) == 2 * next(p["doc_tokens"] for p in pieces if p["doc_id"] == 8)
    assert sum(p["length"] for p in pieces if p["doc_id"] is None) > 1
    assert packing.pack(no_docs, BYTE_TOKENIZER).count() == 0


def test_pack_query(spark, folder):
    texts = texts_of(folder)
    library = Tokenizer.from_file(BYTE_TOKENIZER)
    sizes = {d: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}
    found = check_pieces(QUERIES["op3_packing"](spark, folder).collect(), sizes)
    padding = sum(2048 - n for n in found if n & (n - 1))
    assert padding <= 2048 * 4


def piece_digest(library, text):
    ids = library.encode(text or "")
    return (
        len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(library.decode(ids).encode()).hexdigest(),
    )


def test_pieces_equal_the_library(folder):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    own = codec(PIECE_MODEL)
    texts = odd_texts() + list(texts_of(folder).values())
    want = library.encode(texts)
    got = own.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [own.decode(g) for g in got] == [library.decode(w) for w in want]
    for at in (0, 700):
        assert own.digests(texts[at : at + 700]) == [piece_digest(library, t) for t in texts[at : at + 700]]


def test_careful_words_equal_fast_words():
    own = codec(PIECE_MODEL)
    words = list(dict.fromkeys(w for t in odd_texts(300) for w in own.cut(t)))
    fast, careful = own.encode_words(words), own.encode_words(words, careful=True)
    assert (fast[0] == careful[0]).all() and (fast[1] == careful[1]).all()


def test_decode_of_broken_bytes():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    own = codec(PIECE_MODEL)
    ids = np.array([264, *own.of_byte[[0xC3, 0x28, 0xE2, 0x82]], 287])
    assert own.decode(ids) == library.decode(ids.tolist())


def test_piece_columns_and_digests(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = digests(odd_docs, PIECE_MODEL).collect()
    want = sorted(str((r["doc_id"], *piece_digest(library, r["text"]))) for r in odd_docs.collect())
    assert sorted(str(tuple(r)) for r in got) == want
    assert digests(no_docs, PIECE_MODEL).count() == 0
    back = decode_column(encode_column(odd_docs, PIECE_MODEL), PIECE_MODEL).collect()
    assert sorted(str(r["text"]) for r in back) == sorted(r["text"] or "" for r in odd_docs.collect())


def brute_cost(counts, limit):
    """Cost of the best prefix code with at most `limit` bits, by trying all length lists."""
    from itertools import combinations_with_replacement

    best = None
    for lengths in combinations_with_replacement(range(1, limit + 1), len(counts)):
        if sum(2.0**-n for n in lengths) <= 1:
            cost = sum(n * c for n, c in zip(lengths, sorted(counts, reverse=True), strict=True))
            best = cost if best is None else min(best, cost)
    return best


def test_code_lengths_are_optimal_under_the_limit():
    rng = random.Random(1)
    for _ in range(60):
        counts = [rng.choice((1, 1, 2, 5, 40, 300)) for _ in range(rng.randint(2, 7))]
        for limit in (3, 4, 6):
            lengths = huffman.code_lengths(np.array(counts), limit)
            assert lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths) <= 1
            assert int((lengths * np.array(counts)).sum()) == brute_cost(counts, limit)


def test_code_edge_cases():
    assert huffman.code_lengths(np.array([0, 0, 9])).tolist() == [0, 0, 1]
    assert huffman.code_lengths(np.zeros(3, int)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, int), 2)


def test_codes_are_canonical():
    lengths = np.array([2, 0, 1, 3, 3], np.uint8)
    assert huffman.canonical_codes(lengths).tolist() == [0b10, 0, 0b0, 0b110, 0b111]


def test_ids_round_trip():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 30_000), 40_000).astype("<u4")
    starts = np.array([0, 1, 2, 130, 129 + 128 * 3, 20_000])
    lengths = huffman.code_lengths(np.bincount(ids))
    data, sizes, before = huffman.encode_ids(ids, starts, lengths, huffman.canonical_codes(lengths))
    counts = np.diff(np.r_[starts, len(ids)])
    at, run = [], []
    for s, n, first in zip(starts, counts, np.cumsum(sizes) - sizes, strict=True):
        for k in range(s, s + n, huffman.STEP):
            at.append(before[k] + 8 * first)
            run.append(min(huffman.STEP, s + n - k))
    back = huffman.decode_ids(data, np.array(at), np.array(run), *huffman.decoding_table(lengths))
    assert (back == ids).all()


def test_token_files(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    got = huffman.round_trip(odd_docs, WORD_TOKENIZER).collect()
    rows = [(r["doc_id"], np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")) for r in odd_docs.collect()]
    want = sorted(str((d, len(x), zlib.crc32(x.tobytes()))) for d, x in rows)
    assert sorted(str((r["doc_id"], r["n_tokens"], r["ids_crc32"])) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids)
    assert huffman.round_trip(no_docs, WORD_TOKENIZER).count() == 0


def test_token_files_query(spark, folder):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    texts = texts_of(folder)
    start, want = 0, []
    for d in sorted(texts):
        ids = np.array(library.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op7_token_files"](spark, folder).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_piece_query(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_sentencepiece"](spark, folder).collect()}
    assert got == {d: piece_digest(library, t) for d, t in texts_of(folder).items()}


@pytest.mark.parametrize("path", [BYTE_TOKENIZER, WORD_TOKENIZER])
def test_texts_taken_together_have_the_ids_of_the_library(path):
    import random

    from autolens.llm.words import WordEncoder

    library, words = Tokenizer.from_file(path), WordEncoder(path)
    assert words.ranked is not None
    rng = random.Random(7)
    parts = ["the", "The", "DON'T", "'s", "''s", "'", " ", "  ", "\n", "\t", "\r\n", "É", "ß", "straße", "Ÿ", "İ", "中", "7", "1984", "½", ".", "...", "_", "-", "\x01", "ing", "x" * 90, "<|endoftext|>", "à"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(3000)]
    for t, ids in zip(texts, words.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_ranks_only_where_they_merge_alike():
    from autolens.llm.words import _byte_letters, ranked

    singles = {c: b for b, c in _byte_letters().items()}
    assert ranked({"vocab": singles | {"ab": 256}, "merges": [["a", "b"]]}, []) is not None
    # "abc" is made of "ab" and "c", but its own bytes merge to "a" and "bc" first.
    odd = {"vocab": singles | {"bc": 256, "ab": 257, "abc": 258}, "merges": [["b", "c"], ["a", "b"], ["ab", "c"]]}
    assert ranked(odd, []) is None
