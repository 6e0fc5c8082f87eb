"""Scores by a plain loop over the lexicon, posteriors by enumeration of all vote patterns."""

import itertools
import math
import re

import numpy as np
from test_toxicity import corpus, frames

from autolens.llm import toxicity as X


def plain_score(text, model):
    """Each term looked for in each word of the text, nothing cached or shared."""
    words = [w for chunk in text.split() for w in re.findall(r"[^\W\d_]+", chunk.lower())]
    total = model.bias
    for term, levels in model.levels.items():
        if term.endswith("-"):
            count = sum(len(w) > len(term) - 1 and w.startswith(term[:-1]) for w in words)
        else:
            count = words.count(term)
        total += sum(model.weights[feature] for least, feature in levels if count >= least)
    if any(w in X.INSULTS for w in words):
        total += model.weights[model.terms_end]
    for i, pattern in enumerate(X.PATTERNS.values()):
        if pattern.search(text):
            total += model.weights[model.terms_end + 1 + i]
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def test_scores_by_plain_loop(spark):
    rows, labels = corpus(500)
    odd = [(9001, ""), (9002, "You are an IDIOT, a MORON!!"), (9003, "snarkle " * 5000), (9004, "d*mn blorf-blorf blorfize\x0bwexo"), (9005, "ÉTÉ crétin")]
    docs, table = frames(spark, rows + odd, labels)
    model = X.train(docs, table)
    assert len(model.levels) > 5 and any(len(levels) > 1 for levels in model.levels.values())
    got = {r["doc_id"]: r["score"] for r in X.score(docs, model).collect()}
    for doc_id, text in rows + odd:
        assert abs(got[doc_id] - plain_score(text, model)) < 1e-9


def information(patterns, weights, a, b):
    """Mutual information of two voters given the label, by the four cells of each label."""
    total = 0.0
    for y in (0, 1):
        n = sum(w[y] for w in weights) + 1.0
        one = {j: (sum(w[y] for p, w in zip(patterns, weights) if p[j]) + 0.5) / n for j in (a, b)}
        both = (sum(w[y] for p, w in zip(patterns, weights) if p[a] and p[b]) + 0.25) / n
        cells = {(1, 1): both, (1, 0): one[a] - both, (0, 1): one[b] - both, (0, 0): 1 - one[a] - one[b] + both}
        for (va, vb), joint in cells.items():
            apart = (one[a] if va else 1 - one[a]) * (one[b] if vb else 1 - one[b])
            total += n * max(joint, 1e-9) * math.log(max(joint, 1e-9) / max(apart, 1e-9))
    return total


def enumerated_posterior(patterns, times, fires, share, rounds, strength):
    """EM over all patterns of three voters; the tree is the best of the three there are."""
    voters = range(len(fires))
    post = []
    for p in patterns:
        like = [math.prod(fires[j][y] if p[j] else 1 - fires[j][y] for j in voters) * (share if y else 1 - share) for y in (0, 1)]
        post.append(like[1] / sum(like))
    for turn in range(rounds):
        weights = [(t * (1 - q), t * q) for t, q in zip(times, post)]
        if turn % 10 == 0:
            edge = {e: information(patterns, weights, *e) for e in ((0, 1), (0, 2), (1, 2))}
            left_out = min(edge, key=edge.get)
            # Rooted at voter 0.
            parent = {(0, 1): [0, 2, 0], (0, 2): [0, 0, 1], (1, 2): [0, 0, 0]}[left_out]

        def rate(j, y, before):
            rows = [(p, w[y]) for p, w in zip(patterns, weights) if parent[j] == j or p[parent[j]] == before]
            return (sum(w for p, w in rows if p[j]) + strength * fires[j][y]) / (sum(w for _, w in rows) + strength)

        prior = (sum(w[1] for w in weights) + share * strength) / (sum(times) + strength)
        post = []
        for p in patterns:
            like = []
            for y in (0, 1):
                rates = [min(max(rate(j, y, p[parent[j]]), 1e-6), 1 - 1e-6) for j in voters]
                like.append(math.prod(r if v else 1 - r for r, v in zip(rates, p)) * (prior if y else 1 - prior))
            post.append(like[1] / sum(like))
    return post


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(4)
    patterns = list(itertools.product((0, 1), repeat=3))
    for case in range(6):
        y = rng.random(3000) < 0.2
        votes = rng.random((3000, 3)) < np.where(y[:, None], [0.7, 0.5, 0.6], [0.03, 0.05, 0.02])
        copied = rng.random(3000) < 0.6  # two of the voters often agree
        votes[:, case % 3] = np.where(copied, votes[:, (case + 1) % 3], votes[:, case % 3])
        times = np.array([(votes == np.array(p, bool)).all(axis=1).sum() for p in patterns], float)
        fires = np.array([[0.04, 0.6], [0.06, 0.4], [0.05, 0.5]])
        for rounds in (1, 7, 12):
            got = X.fit_label_model(np.array(patterns, np.uint8), fires, 0.2, rounds=rounds, times=times)
            # The operator may end early once nothing moves by more than 1e-5.
            want = enumerated_posterior(patterns, times.tolist(), fires.tolist(), 0.2, rounds, 30.0)
            assert np.abs(got - want).max() < 5e-4
