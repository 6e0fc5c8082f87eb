import hashlib
import random
import re

import numpy as np
import xxhash
from helpers import CLASHES, texts_of

from autolens.llm import simhash
from autolens.llm.components import components
from autolens.llm.exact_dedup import drop_copies, exact_groups
from autolens.llm.queries import QUERIES


def body(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def expected_groups(rows):
    """(doc_id, keep_id, size, kept count per group) by brute force."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(body(text), []).append((doc_id, text or ""))
    result = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(key.encode()).hexdigest()
        result += [(str(d), str(keep), len(members), digest) for d, _ in members]
    return sorted(result)


def test_exact_groups_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    got = exact_groups(odd_docs, digest_all=True).collect()
    found = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got)
    assert found == expected_groups(rows)
    kept = {}
    for r in got:
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
    assert set(kept.values()) == {1}


def test_exact_groups_digest_only_where_needed(odd_docs):
    got = exact_groups(odd_docs).collect()
    assert any(r["text_sha256"] is None for r in got)
    assert all(r["text_sha256"] for r in got if r["group_size"] > 1)


def test_drop_copies_keeps_columns(odd_docs):
    left = drop_copies(odd_docs)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    assert len(rows) == len({body(r["text"]) for r in odd_docs.collect()}) == len({body(r["text"]) for r in rows})
    assert all(r[c] == c for r in rows for c in CLASHES)


def test_empty_tables(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert drop_copies(no_docs).count() == 0
    assert simhash.near_components(no_docs).count() == 0
    assert simhash.keep_one(no_docs).columns == no_docs.columns


def brute_fingerprint(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def brute_roots(values, bits=3):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(values))]


def test_fingerprints_match_definition(odd_docs):
    for r in odd_docs.collect():
        for words in (3, 5):
            if len(r["text"] or "") < 10_000:
                assert simhash.fingerprint(r["text"] or "", words) == brute_fingerprint(r["text"], words)


def test_simhash_odd_rows(odd_docs):
    got = simhash.near_components(odd_docs, words=3).collect()
    assert len(got) == odd_docs.count()
    prints = [int(r["fingerprint"], 16) for r in got]
    roots = brute_roots(prints)
    for root in set(roots):
        members = [r for r, x in zip(got, roots, strict=True) if x == root]
        ids = [r["doc_id"] for r in members if r["doc_id"] is not None]
        assert {r["component_id"] for r in members} == {min(ids, default=None)}
    zero = {r["doc_id"] for r in got if int(r["fingerprint"], 16) == 0}
    assert {3, 4, 5, None} <= zero


def planted(seed=5, clusters=60):
    """Random fingerprints, chains of three-bit steps through all bits, and a dense ball."""
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(400)}
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(6):
            values.add(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)}
    return sorted(values)


def check_links(spark, values, block):
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    found = {r["node"]: r["root"] for r in components(simhash.links(fps, block)).collect()}
    roots = brute_roots(values)
    groups = {}
    for v, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(v)
    for members in groups.values():
        if len(members) > 1:
            assert {found.get(m, m) for m in members} == {min(members)}
        else:
            assert members.isdisjoint(found)


def test_anchors_find_every_link(spark):
    check_links(spark, planted(), simhash.BLOCK)


def test_crowded_anchors_are_split(spark):
    check_links(spark, planted(seed=8, clusters=10), 4)


def test_one_anchor_group_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check_links(spark, planted(seed=9, clusters=10), simhash.BLOCK)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def jaccard(a, b, words=5):
    x, y = (set(simhash.shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def near_corpus(seed=11):
    """Texts of 30 to 400 words, most with a copy in which some words are changed."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    texts, pairs = [], []
    for i in range(150):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 400))]
        texts.append(" ".join(base))
        if i % 3:
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
            pairs.append((len(texts) - 2, len(texts) - 1))
    return texts, pairs


def test_near_copies_by_similarity(spark):
    texts, pairs = near_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert set(found) == set(range(len(texts)))
    linked = [(found[a] == found[b], jaccard(texts[a], texts[b])) for a, b in pairs]
    high = [hit for hit, j in linked if j >= 0.85]
    assert len(high) > 50 and np.mean(high) > 0.97
    assert np.mean([hit for hit, j in linked if j >= 0.8]) > 0.9
    group = {}
    for d, c in found.items():
        group.setdefault(c, []).append(d)
    partners = dict(pairs)
    for members in group.values():  # nothing but planted copies is linked
        assert len(members) == 1 or len(members) == 2 and partners[min(members)] == max(members)
        assert len(members) == 1 or jaccard(texts[members[0]], texts[members[1]]) > 0.6


def test_wide_distance_follows_similarity():
    texts, pairs = near_corpus(3)
    for a, b in pairs:
        x, y = (simhash.wide_fingerprint(texts[i], 5) for i in (a, b))
        d = int(simhash._distance(x, y))
        j = jaccard(texts[a], texts[b])
        share = np.arccos(min(1.0, 2 * j / (1 + j))) / np.pi
        assert abs(d - 256 * share) <= 3 + 4.5 * (256 * share * (1 - share)) ** 0.5
    assert simhash.wide_bits(1.0) == 0 < simhash.wide_bits(0.9) < simhash.wide_bits(0.8) < 64


def test_keep_one(odd_docs):
    left = simhash.keep_one(odd_docs, words=3)
    assert left.columns == odd_docs.columns
    near = simhash.near_copies(odd_docs, words=3)
    rows = left.collect()
    assert len(rows) == near.select("component_id").distinct().count()
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {
        r["component_id"] for r in near.collect() if r["component_id"] is not None
    }
    assert all(r[c] == c for r in rows for c in CLASHES)


def test_query_against_brute_force(spark, folder):
    texts = texts_of(folder)
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash"](spark, folder).collect()}
    ids = sorted(texts)
    prints = [simhash.fingerprint(texts[i] or "", 3) for i in ids]
    assert [int(got[i]["fingerprint"], 16) for i in ids] == prints
    roots = brute_roots(prints)
    lowest = {}
    for i, r in zip(ids, roots, strict=True):
        lowest[r] = min(lowest.get(r, i), i)
    assert [got[i]["component_id"] for i in ids] == [lowest[r] for r in roots]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300) if i != 150] + [(7, 7), (1, 0)], "u bigint, v bigint")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(found.get(i, 0) == 0 for i in range(151)) and all(found.get(i, 151) == 151 for i in range(151, 301))
