"""Passages that repeat, against a plain search of all windows."""

import hashlib
import random
import re

import pytest
from helpers import texts_of

from autolens.llm.queries import QUERIES
from autolens.llm.substring_dedup import LAST, drop_repeats, repeat_report


def brute(rows, length):
    """`(doc_id, words, removed, digest)` by holding every window of every document."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        d = LAST if d is None else d
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(first.get(key, d), d)
    result = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < (LAST if d is None else d):
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        result.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(result, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("length", [2, 5, 8])
def test_random_texts_of_few_words(spark, length):
    rng = random.Random(length)
    rows = []
    for d in range(150):
        w = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        if rows and rng.random() < 0.5:
            other = (rng.choice(rows)[1] or "").split()
            at = rng.randrange(0, len(other) + 1)
            w[len(w) // 2 : len(w) // 2] = other[at : at + 12]
        rows.append((rng.choice([d, d, d, rng.randrange(150), None]), rng.choice([" ", "\n", " \t "]).join(w) or rng.choice(["", None])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert found(repeat_report(df, length)) == brute(rows, length)


def test_passages_with_different_surroundings(spark):
    rng = random.Random(5)
    line = [f"p{i}" for i in range(70)]

    def own(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    rows = []
    for d in range(120):
        a = rng.randrange(0, 25)
        b = a + rng.randrange(40, 70)
        rows.append((1000 - d, " ".join(own(rng.randrange(0, 90)) + line[a:b] + own(rng.randrange(0, 90)))))
    rows += [(5000 + i, rows[7][1]) for i in range(30)]  # copies of one text
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    expected = brute(rows, 50)
    assert sum(r[2] for r in expected) > 3000
    assert found(repeat_report(df)) == expected


def test_texts_that_are_left(spark):
    shared = [f"s{i}" for i in range(55)]
    rows = [(1, " ".join(["a", *shared, "b"])), (2, " ".join(["c", "d", *shared, "e"])), (3, None)]
    left = {r["doc_id"]: r["text"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left == {1: rows[0][1], 2: "c d e", 3: ""}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert found(repeat_report(odd_docs)) == brute(rows, 50)
    assert repeat_report(no_docs).count() == 0


def test_query(spark, folder):
    rows = list(texts_of(folder).items())
    assert found(QUERIES["op11_repeats"](spark, folder)) == brute(rows, 50)
