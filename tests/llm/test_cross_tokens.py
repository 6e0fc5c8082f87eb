"""Alignment of two tokenizers, against the libraries and a plain count of overlaps."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from helpers import texts_of
from tokenizers import Tokenizer

from autolens.llm import cross_tokens
from autolens.llm.queries import BYTE_TOKENIZER, PIECE_MODEL, QUERIES
from autolens.llm.words import _byte_letters


def spans(pieces):
    result, at = [], 0
    for i, raw in pieces:
        result.append((at, at + len(raw), i))
        at += len(raw)
    return result, b"".join(raw for _, raw in pieces)


def aligned(text, a, b, byte_of):
    """Groups and links of a text, token by token; None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    left, left_raw = spans([(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a_ids])
    right, right_raw = spans(
        [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    )
    if left_raw != raw or right_raw != raw:
        return None
    links = [(x, y) for s, e, x in left for t, u, y in right if s < u and t < e] if len(left) < 400 else fast_links(left, right)
    groups, i, j = [], 0, 0
    for cut in sorted({e for _, e, _ in left} & {e for _, e, _ in right}):
        k, m = i, j
        while k < len(left) and left[k][1] <= cut:
            k += 1
        while m < len(right) and right[m][1] <= cut:
            m += 1
        groups.append(",".join(str(x) for _, _, x in left[i:k]) + "|" + ",".join(str(y) for _, _, y in right[j:m]))
        i, j = k, m
    return len(left), len(right), groups, links


def fast_links(left, right):
    links, j = [], 0
    for s, e, x in left:
        while right[j][1] <= s:
            j += 1
        k = j
        while k < len(right) and right[k][0] < e:
            links.append((x, right[k][2]))
            k += 1
    return links


def brute(rows):
    a, b = Tokenizer.from_file(BYTE_TOKENIZER), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a.encode_special_tokens = True
    byte_of = {c: x for x, c in _byte_letters().items()}
    found = [aligned(t, a, b, byte_of) for _, t in rows]
    count = Counter(p for f in found if f for p in f[3])
    highest = Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    result = []
    for (d, _), f in zip(rows, found, strict=True):
        if f is None:
            result.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        best = sum(count[p] == highest[p[1]] for p in links)
        result.append(
            (d, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
        )
    return sorted(result, key=str), count


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "a ▁ b", "a\r\nb\tc \r d;\r\n", "  two  spaces   three    ", "\n\n\nlines\n \n", "tab\ttab\t\t x",
    "x y  z w", "\x00 \x1c \x85 b", "👩‍👩‍👧 é é 中文字 ไทย", "don't I'll we've 'S  's", "1234567 12 ½ ²", ";\r ;\r;\r\r ▁", "a" * 3000,
    " lead", "trail ", " ", "\n", "\r", "}\r\n}", "﻿bom �",
]


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "twice the same"), (3, "twice the same"), (90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS pairs", "3 AS links").repartition(3)
    assert found(cross_tokens.alignment(df, BYTE_TOKENIZER, PIECE_MODEL)) == brute(rows)[0]


@pytest.mark.parametrize("size", [1, 60, 10**6])
def test_random_texts_in_blocks(spark, size):
    rng = random.Random(size)
    parts = ["the", "The", " ", "  ", "\n", "\t", "\r", "é", "ß", "中", "▁", "ing", ";", "<s>", "'s", "7", "42", " ", "\x1c", "😀", "-", "un"]
    rows = [(d, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(0, 60)))) for d in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert found(cross_tokens.alignment(df, BYTE_TOKENIZER, PIECE_MODEL, size)) == brute(rows)[0]


def test_query_and_pairs(spark, folder):
    rows = list(texts_of(folder).items())
    expected, count = brute(rows)
    assert found(QUERIES["op13_alignment"](spark, folder)) == expected
    from autolens.llm.common import table

    pairs = cross_tokens.pair_table(table(spark, folder, "documents"), BYTE_TOKENIZER, PIECE_MODEL).collect()
    assert {(r["a_id"], r["b_id"]): r["links"] for r in pairs} == count
    assert all(0 < r["docs"] <= min(r["links"], len(rows)) for r in pairs)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(cross_tokens.alignment(odd_docs, BYTE_TOKENIZER, PIECE_MODEL)) == brute(rows)[0]
    assert cross_tokens.alignment(no_docs, BYTE_TOKENIZER, PIECE_MODEL).count() == 0


def test_bitmaps():
    rng = np.random.default_rng(3)
    for docs in (1, 9, 700, 65536):
        pair, doc = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(docs), indexing="ij"))
        number = rng.integers(0, 40, len(pair)) * (rng.random(len(pair)) < np.array([0, 0.001, 0.05, 0.3, 0.9, 1])[pair])
        has = number > 0
        planes = cross_tokens.planes_of(pair[has], doc[has], number[has], docs)
        found_docs, links = cross_tokens.popcounts(planes, 6, docs)
        assert found_docs.tolist() == np.bincount(pair, weights=has, minlength=6).tolist()
        assert links.tolist() == np.bincount(pair, weights=number, minlength=6).tolist()
