"""Near copies against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

from autolens.llm import simhash


def edited(seed=5):
    """Texts of 8 to 300 words with copies of many degrees, around a similarity of 0.8 above all."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts = []
    for _ in range(220):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy[: len(copy) - rng.randint(0, len(copy) // 12)]))
    return texts


@pytest.mark.parametrize("block", [3, simhash.CLOUD_BLOCK])
def test_near_copies_equal_brute_force_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.exact_links, "__defaults__", (block,))
    texts = edited()
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    lowest = list(range(len(texts)))

    def root(i):
        while lowest[i] != i:
            i = lowest[i]
        return i

    between = 0
    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            between += 0.6 < same < 0.8
            if same >= 0.8 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                lowest[b] = a
    assert between > 50  # an estimate links many of these
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_candidates_at_the_similarity():
    rng = np.random.default_rng(2)
    missed = 0
    for n in [4, 9, 16, 40, 90] * 60:  # of n + n // 4 shingles n are shared: 0.8
        large = np.unique(rng.integers(0, 1 << 63, n + n // 4, np.uint64) * np.uint64(2))
        small = np.sort(rng.permutation(large)[:n])
        far = simhash._distance(simhash.wide_of(large), simhash.wide_of(small)) > simhash.candidate_bits(0.8)
        missed += bool(far) or not (simhash.table_keys(large) == simhash.table_keys(small)).any()
    assert missed == 0


def test_no_pair_below_the_similarity_is_linked(spark):
    rng = random.Random(4)
    texts = []
    for n in [60, 90, 120, 200] * 25:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        cut = round(n * 0.22)
        texts += [" ".join(base), " ".join(base[cut // 2 : len(base) - (cut - cut // 2)])]  # similarity 0.78
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(r["doc_id"] == r["component_id"] for r in simhash.near_copies(docs).collect())


def test_anchors_of_the_fingerprints_link_by_themselves(spark, monkeypatch):
    """Without the tables, what the covering code brings together is linked where the similarity is reached."""
    monkeypatch.setattr(simhash, "candidate_links", lambda nodes, similarity: nodes.select("id", "id").limit(0).toDF("u", "v"))
    texts = edited(6)[:400]
    texts += [f"{t} {t}" for t in texts[:20]] + ["so " * 40 + f"{a} {b}" for a in "abc" for b in "def"]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    n = len(texts)

    def grouped(pairs):
        low = list(range(n))

        def root(i):
            while low[i] != i:
                i = low[i]
            return i

        for i, j in pairs:
            a, b = sorted((root(i), root(j)))
            low[b] = a
        return [root(i) for i in range(n)]

    pairs = [(i, j) for i in range(n) for j in range(i)]
    close = [(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 3]
    cloud = grouped(close)
    same = [(i, j) for i, j in pairs if cloud[i] == cloud[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(same) > 20 and any(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for i, j in close)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    want = grouped(same)
    assert got == dict(enumerate(want))
