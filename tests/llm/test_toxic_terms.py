"""Every strong term counts."""

import random

import numpy as np
from pyspark.sql import functions as F

from autolens.llm import toxicity as X


def test_every_planted_word_is_learned(spark):
    rng = random.Random(8)
    bad = [f"{a}{b}{c}" for a in ("zork", "quim", "vlex", "wubb") for b in "aeiou" for c in ("nta", "ppo", "rd", "sk", "tch", "ll", "mb")]
    plain = [f"wa{a}{b}" for a in "bcdfgh" for b in "klmnpr"]
    rows, labels = [], []
    for i in range(8000):
        words = [rng.choice(plain) for _ in range(12)]
        if i % 5 == 0:
            words += rng.sample(bad, 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = X.train(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert set(bad) <= set(model.levels)
    lone = spark.createDataFrame([(i, " ".join(plain[:12]) + " " + w) for i, w in enumerate(bad)], "doc_id bigint, text string")
    assert all(r["score"] >= X.THRESHOLD for r in X.score(lone, model).collect())


def test_the_floor_does_not_rise_with_the_sample(spark):
    rows = spark.range(22_000).select(
        F.when(F.col("id") < 4, "rare words here").otherwise("some words here").alias("text"), (F.col("id") < 2000).cast("int").alias("toxic")
    )
    assert ("rare", 1) in X.candidate_terms(rows)  # 4 of 2,000 toxic rows


def test_words_and_beginnings_are_one_voter():
    terms = [("idiot", 1), ("idio-", 1), ("blorf", 2), ("idiot-", 2), ("blorf", 1), ("idi", 1)]
    assert X.families(terms) == [0, 0, 1, 0, 1, 2]


def test_weights_of_a_sparse_fit():
    rng = np.random.default_rng(1)
    x = rng.random((300, 6)) < 0.3
    target, times = rng.random(300), rng.integers(1, 4, 300).astype(float)
    weights, bias = X.fit_linear([np.flatnonzero(r).tolist() for r in x], 6, target, times)
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.abs(x.T @ (times * (p - target)) + weights).max() < 1e-3 and abs((times * (p - target)).sum()) < 1e-3


def test_a_word_and_its_beginnings_cover_a_row_once():
    terms = [("idio-", 1), ("idiot", 1), ("zorknta", 1)]
    lists = [[0, 1, 2], [0, 1], [2]]
    assert sorted(X.choose_voters(lists, np.array([30.0, 5, 5]), X.families(terms))) == [0, 1, 2]


def test_a_labelled_document_that_repeats_teaches_once(spark):
    docs = spark.range(5000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"))
    docs = docs.unionAll(spark.createDataFrame([(1, "other text"), (3, "x")], docs.schema))
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, toxic int").where(X.fold_of(F.col("doc_id")) != 2)
    assert X.training_rows(docs, labels).read().where("doc_id = 1").count() == 2
