"""Label model, voters and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from helpers import CLASHES
from pyspark.sql import functions as F

from autolens.llm import toxicity as X
from autolens.llm.queries import QUERIES


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    plain = [f"wa{a}{b}" for a in "bcdfgh" for b in "klmnpr"]
    bad = ["snarkle", "blorf", "grundel", "wexo"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad[:3]) + (rng.choice(["", "an", "ize", "s"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_on_planted_words(spark):
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in X.toxicity(*frames(spark, rows, labels)).collect()}
    truth = dict(labels)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got.values() if r["held_out"]]
    wrong = [r["doc_id"] for r in held if r["predicted"] != truth[r["doc_id"]]]
    assert len(held) > 100 and len(wrong) <= 2


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus()
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    a = {r["doc_id"]: r["score"] for r in X.toxicity(*frames(spark, rows, labels)).collect()}
    b = {r["doc_id"]: r["score"] for r in X.toxicity(*frames(spark, rows, flipped)).collect()}
    assert a == b


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    rows, labels = corpus(200)
    extra = [(900, None), (None, 1), (901, 7), (1, 1), (1, 0), (999_999, 1)]
    docs = frames(spark, rows, [])[0].unionByName(odd_docs.select("doc_id", "text")).withColumn("score", F.lit("x"))
    table = frames(spark, [], labels + extra)[1]
    got = X.toxicity(docs, table).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert X.toxicity(no_docs, table).count() == 0
    assert X.toxicity(docs, table.limit(0)).count() == docs.count()
    assert X.toxicity(docs, table.where("toxic = 0")).count() == docs.count()


def test_without_labels_the_insult_list_counts(spark, odd_docs):
    table = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in X.toxicity(odd_docs, table).collect()}
    assert got[8] == 1 and got[1] == 0 and got[4] == 0
    left = X.drop_toxic(odd_docs, table)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    assert len(rows) == odd_docs.count() - 2 and all(r[c] == c for r in rows for c in CLASHES)


def test_bound_on_training_rows(spark):
    rows, labels = corpus(300)
    assert X.training_rows(*frames(spark, rows, labels), bound=40).read().count() == 40


def test_label_model_recovers_labels_and_correlated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.15
    rate = np.array([[0.01, 0.7], [0.02, 0.5], [0.01, 0.6], [0.3, 0.3]])
    votes = np.stack([rng.random(4000) < np.where(y, r[1], r[0]) for r in rate], axis=1)
    copies = np.repeat(votes[:, 3:], 3, axis=1)  # three more voters that repeat a useless one
    votes = np.hstack([votes, copies]).astype(np.float32)
    guess = np.array([[0.05, 0.4]] * 3 + [[0.25, 0.35]] * 4)
    post = X.fit_label_model(votes, guess, 0.2)
    lean = np.log(0.15 / 0.85) + sum(
        np.where(votes[:, j] == 1, np.log(r[1] / r[0]), np.log((1 - r[1]) / (1 - r[0]))) for j, r in enumerate(rate)
    )
    best = 1 / (1 + np.exp(-lean))  # with the true rates, each useless voter counted once
    assert np.abs(post - best).mean() < 0.04
    parent = X._tree(votes.astype(float), np.stack([1 - post, post]))
    assert all(parent[j] in (3, 4, 5, 6) for j in (4, 5, 6)) or sum(parent[j] in (3, 4, 5, 6) for j in (3, 4, 5, 6)) >= 3


def test_strength_has_a_sign_and_handles_zeros():
    assert X._strength(10, 0, 100, 1000) > 4 > 0 > X._strength(0, 500, 100, 1000)
    assert abs(X._strength(10, 100, 100, 1000)) < 1e-6


def test_query_separates_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}
    labels = pq.read_table(f"{folder}/labels.parquet").to_pylist()
    held = [(got[x["doc_id"]]["score"], x["toxic"]) for x in labels if got[x["doc_id"]]["held_out"]]
    toxic = [s for s, t in held if t]
    clean = [s for s, t in held if not t]
    auc = np.mean([(np.array(clean) < s).mean() + (np.array(clean) == s).mean() / 2 for s in toxic])
    assert auc > 0.9
    assert np.mean([s >= 0.3 for s in clean]) < 0.01
