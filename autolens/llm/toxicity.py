"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, Stage, fold_of, plain_text

#: The one bound on training: at most so many labelled rows, picked by a hash of the id.
MAX_LABELLED = 20_000
#: A term is looked at from so many toxic rows on, whatever the size of the sample. It has to be
#: that strongly tied to label 1 (signed root of the likelihood ratio), and so many times as
#: frequent there as in rows with label 0; every one that is becomes a feature.
MIN_ROWS, MIN_Z, MIN_RATIO = 3, 4.0, 20
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7)
#: A term is looked at as occurring so many times or more.
LEVELS = (1, 2, 3)
KEPT_CHUNKS = 200_000

#: Fixed list: plain insults, a voter of its own beside the mined lexicon.
INSULTS = frozenset(
    """
    bastard clown crap cretin damn disgusting dumb fool hate idiot imbecile loser moron pathetic retard scum stupid
    trash ugly vermin worthless abschaum arschloch dummkopf idiot trottel versager widerlich wertlos abruti connard
    crétin débile imbécile merde minable ordure salaud basura escoria estúpido gilipollas idiota imbécil inútil mierda
    """.split()
)
#: Fixed patterns, each a voter.
PATTERNS = {
    "shouted": re.compile(r"\b[A-ZÀ-Þ]{4,}\b.*\b[A-ZÀ-Þ]{4,}\b", re.S),
    "exclaimed": re.compile(r"!!"),
    "addressed": re.compile(r"\b(?:you|du|tu|eres|ihr|vous)\s+(?:are|bist|es|seid|êtes)\b", re.I),
    "masked": re.compile(r"\b\w+[*@#$]+\w+\b"),
}
_LETTERS = re.compile(r"[^\W\d_]+")


def terms_of(chunk: str) -> list[str]:
    """Words of a chunk in lower case, and their beginnings, which end in a dash."""
    result = []
    for word in _LETTERS.findall(chunk.lower()):
        result.append(word)
        result += [f"{word[:n]}-" for n in PREFIXES if len(word) > n]
    return result


def pattern_hits(text: str) -> list[int]:
    return [i for i, p in enumerate(PATTERNS.values()) if p.search(text)]


@dataclass(frozen=True)
class Model:
    """`levels` has for each lexicon term the features it gives: `(least count, feature)`.
    Behind those `terms_end` features come the insult list and the patterns."""

    levels: dict[str, list[tuple[int, int]]]
    terms_end: int
    weights: np.ndarray
    bias: float

    @staticmethod
    def of(names: list[tuple[str, int]], weights: np.ndarray, bias: float) -> Model:
        levels: dict[str, list[tuple[int, int]]] = {}
        for feature, (term, least) in enumerate(names):
            levels.setdefault(term, []).append((least, feature))
        return Model(levels, len(names), weights, bias)

    def features(self, text: str, cache: Recent) -> set[int]:
        counts: Counter[str] = Counter()
        for chunk, n in Counter(text.split()).items():
            for term in cache[chunk]:
                counts[term] += n
        found = {f for term, n in counts.items() if term for least, f in self.levels[term] if n >= least}
        if "" in counts:
            found.add(self.terms_end)
        found.update(self.terms_end + 1 + i for i in pattern_hits(text))
        return found

    def chunk_cache(self) -> Recent:
        """Chunks with the lexicon terms in them; the empty term stands for an insult."""

        def look(chunk: str) -> tuple[str, ...]:
            terms = terms_of(chunk)
            hits = [t for t in terms if t in self.levels]
            return (*hits, *([] if INSULTS.isdisjoint(terms) else [""]))

        return Recent(look, KEPT_CHUNKS)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Stage:
    """`(doc_id, text, toxic)` of labelled rows outside the held-out fold.

    The ids are picked on the narrow label table; at most `bound` of them are broadcast.
    Rows with a null label or id teach nothing; an id with both labels counts as toxic.
    A document that repeats teaches once.
    """
    ids = (
        labels.where("doc_id is not null and toxic in (0, 1)").where(fold_of(F.col("doc_id")) != 2)
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), plain_text().alias("text"))
    return Stage(rows.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "text"]))


def _term_counts(rows: DataFrame) -> DataFrame:
    """`(term, least, a, b)`: rows with label 1 and 0 that have the term so many times or more,
    added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Recent(terms_of, KEPT_CHUNKS)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                counts: tuple[Counter[tuple[str, int]], Counter[tuple[str, int]]] = (Counter(), Counter())
                for text, toxic in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    here: Counter[str] = Counter()
                    for chunk, n in Counter(text.as_py().split()).items():
                        for term in cache[chunk]:
                            here[term] += n
                    counts[toxic].update((t, least) for t, n in here.items() for least in LEVELS if n >= least)
                keys = list(counts[0].keys() | counts[1].keys())
                terms, levels = zip(*keys, strict=True) if keys else ((), ())
                yield pa.record_batch(
                    [pa.array(terms, pa.string()), pa.array(levels, pa.int32()),
                     *(pa.array([counts[y][k] for k in keys], pa.int64()) for y in (1, 0))],
                    names=["term", "least", "a", "b"],
                )

    found = rows.select("text", "toxic").mapInArrow(run, "term string, least int, a bigint, b bigint")
    return found.groupBy("term", "least").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _strength(a: int, b: int, p: int, n: int) -> float:
    """Signed root of the likelihood ratio of a term in `a` of `p` rows against `b` of `n`."""
    share = (a + b) / (p + n)
    total = 0.0
    for seen, rows in ((a, p), (b, n)):
        for count, expected in ((seen, rows * share), (rows - seen, rows * (1 - share))):
            if count:
                total += count * np.log(count / expected)
    return float(np.sign(a * n - b * p) * np.sqrt(max(0.0, 2 * total)))


def candidate_terms(rows: DataFrame) -> list[tuple[str, int]]:
    """All terms with a least count over-represented in rows with label 1, the strongest first.

    Every term is counted in toxic and clean rows on the cluster, and what is rare or
    about as frequent in clean rows is left out there.
    """
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = totals.get(1, 0), totals.get(0, 0)
    if not p or not n:
        return []
    counted = _term_counts(rows).where((F.col("a") >= MIN_ROWS) & (F.col("a") * n >= F.col("b") * (MIN_RATIO * p)))
    found = {}

    def strong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_strength(a, b, p, n) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            both = pa.record_batch([batch.column(0), batch.column(1), pa.array(z, pa.float64())], names=["term", "least", "z"])
            yield both.filter(pa.array([x >= MIN_Z for x in z], pa.bool_()))

    for r in counted.mapInArrow(strong, "term string, least int, z double").toLocalIterator():
        found[r["term"], r["least"]] = r["z"]
    return sorted(found, key=lambda t: (-found[t], t))


def families(terms: list[tuple[str, int]]) -> list[int]:
    """For each term the number of its voter: a word, its beginnings and all their least counts are one.

    A word belongs to the shortest beginning among the terms.
    """
    starts = {t for t, _ in terms if t.endswith("-")}
    names = [next((f"{t[:k]}-" for k in PREFIXES if len(t) > k and f"{t[:k]}-" in starts), t) for t, _ in terms]
    numbers = {name: i for i, name in enumerate(dict.fromkeys(names))}
    return [numbers[name] for name in names]


def choose_voters(lists: list[list[int]], gains: np.ndarray, voters: list[int]) -> list[int]:
    """Features that together cover the toxic rows, as voters of the label model.

    `lists` are the features of each row, `gains` its toxic less its weighed clean rows,
    `voters` the number of each feature's voter. Greedily the feature that gains most among
    rows where fewer than two voters fire, the stronger (earlier) one of equals, while that
    gains two rows. A word and its beginnings are one voter and cover a row once.
    """
    columns = np.array([f for row in lists for f in row if f < len(voters)], np.int64)
    rows = np.repeat(np.arange(len(lists)), [sum(f < len(voters) for f in row) for row in lists])
    order = np.argsort(columns, kind="stable")
    ends = np.searchsorted(columns[order], np.arange(len(voters) + 1))
    fired = np.zeros((len(lists), max(voters, default=-1) + 1), bool)
    chosen: list[int] = []
    while voters:
        gain = np.bincount(columns, np.where(fired.sum(axis=1) < 2, gains, 0)[rows], len(voters))
        gain[chosen] = 0
        j = int(np.argmax(gain))
        if gain[j] < 2:
            break
        chosen.append(j)
        fired[rows[order[ends[j] : ends[j + 1]]], voters[j]] = True
    return chosen


def fit_label_model(
    votes: np.ndarray, fires: np.ndarray, share: float, rounds: int = 30, strength: float = 30.0, times: np.ndarray | None = None
) -> np.ndarray:
    """Posterior probability of label 1 for each row of the vote matrix (rows x voters, 0/1).

    A generative model: the hidden label, then each voter fires with a probability that
    depends on the label and on one other voter, its nearest by mutual information
    within the labels (a tree, so correlated voters are not counted as independent
    evidence). EM estimates both. `fires` (voters x 2) are first guesses of how often
    a voter fires under each label, and weigh as `strength` rows. A row counts as often
    as `times` says.
    """
    rows, voters = votes.shape
    times = np.ones(rows) if times is None else times
    share = min(max(share, 1e-3), 1 - 1e-3)
    log1, log0 = np.log(fires), np.log1p(-fires)
    lean = np.full(rows, float((log0[:, 1] - log0[:, 0]).sum()) + np.log(share / (1 - share)))
    blocks = [np.arange(at, min(at + 64, voters)) for at in range(0, voters, 64)]  # of voters, to hold few of them as numbers
    for block in blocks:
        lean += votes[:, block].astype(np.float64) @ (log1 - log0)[block] @ [-1, 1]
    post = 1 / (1 + np.exp(-np.clip(lean, -50, 50)))
    for turn in range(rounds):
        weights = np.stack([1 - post, post]) * times
        if turn % 10 == 0:
            parent = _tree(votes, weights)
        logs = np.zeros((rows, 2))
        for block in blocks:
            x, above = votes[:, block].astype(np.float64), votes[:, parent[block]].astype(np.float64)
            for y in (0, 1):
                w = weights[y]
                for before in (0, 1):
                    # How often each voter fires given the label and what its parent does.
                    sel = above if before else 1 - above
                    sel = np.where(parent[block] == block, float(before), sel)
                    seen = w @ sel
                    rate = (w @ (sel * x) + strength * fires[block, y]) / (seen + strength)
                    rate = np.clip(rate, 1e-6, 1 - 1e-6)
                    logs[:, y] += (sel * (x * np.log(rate) + (1 - x) * np.log1p(-rate))).sum(axis=1)
        prior = np.clip(((post * times).sum() + share * strength) / (times.sum() + strength), 1e-3, 1 - 1e-3)
        lean = logs[:, 1] - logs[:, 0] + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(lean, -50, 50)))
        done = np.abs(new - post).max() < 1e-5
        post = new
        if done:
            break
    return post


def _tree(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each voter its parent in the maximum spanning tree of the mutual information
    given the label; the root is its own parent."""
    total = np.zeros((x.shape[1], x.shape[1]))
    for w in weights:
        n = w.sum() + 1.0
        both = np.zeros_like(total)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024].astype(np.float64)
            both += (part * w[at : at + 1024, None]).T @ part
        both = (both + 0.25) / n
        one = (w @ x + 0.5) / n
        for a, b, joint in (
            (one[:, None], one[None, :], both),
            (one[:, None], 1 - one[None, :], one[:, None] - both),
            (1 - one[:, None], one[None, :], one[None, :] - both),
            (1 - one[:, None], 1 - one[None, :], 1 - one[:, None] - one[None, :] + both),
        ):
            joint = np.clip(joint, 1e-9, 1)
            total += n * joint * np.log(joint / np.clip(a * b, 1e-9, 1))
    np.fill_diagonal(total, -np.inf)
    voters = x.shape[1]
    parent, best, left = np.zeros(voters, np.int64), total[0].copy(), set(range(1, voters))
    while left:
        j = max(left, key=lambda i: (best[i], -i))
        left.discard(j)
        closer = total[j] > best
        best = np.where(closer, total[j], best)
        parent = np.where(closer & np.isin(np.arange(voters), list(left)), j, parent)
    parent[0] = 0
    return parent


def fit_linear(
    lists: list[list[int]], width: int, target: np.ndarray, times: np.ndarray, l2: float = 1.0, rounds: int = 25
) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps; the bias is not penalised.

    Rows are lists of the features that are 1 and count as often as `times` says. Steps are
    solved by conjugate gradients, so nothing of features x features is held.
    """
    columns = np.array([f for row in lists for f in row], np.int64)
    rows = np.repeat(np.arange(len(lists)), [len(row) for row in lists])
    forward = lambda v: np.bincount(rows, v[columns], len(lists)) + v[-1]
    back = lambda r: np.r_[np.bincount(columns, r[rows], width), r.sum()]
    beta = np.zeros(width + 1)
    ridge = np.r_[np.full(width, l2), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(beta), -30, 30)))
        grad = back(times * (p - target)) + ridge * beta
        w = times * np.maximum(p * (1 - p), 1e-6)
        scale = back(w) + ridge
        step, left = np.zeros_like(beta), grad.copy()
        way = left / scale
        size = left @ way
        for _ in range(1000):
            if size <= 1e-24:
                break
            bent = back(w * forward(way)) + ridge * way
            step += (length := size / (way @ bent)) * way
            left -= length * bent
            size, old = left @ (left / scale), size
            way = left / scale + size / old * way
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """Mine voters, estimate them, and fit the classifier; at most `bound` labelled rows.

    Without any labelled row of either kind only the fixed insult list counts.
    """
    held = training_rows(docs, labels, bound)
    rows = held.read()
    terms = candidate_terms(rows)
    draft = Model.of(terms, np.zeros(0), 0.0)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = draft.chunk_cache()
        for batch in batches:
            found = [sorted(draft.features(t.as_py(), cache)) for t in batch.column(0)]
            yield pa.record_batch([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["hits", "toxic"])

    # Equal hit lists of at most `bound` rows are one: small integers, few in a list.
    got = rows.select("text", "toxic").mapInArrow(hits, "hits array<int>, toxic int").groupBy("hits").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")
    ).collect()
    held.drop()
    got = sorted((list(r["hits"]), r["p"], r["n"]) for r in got)
    lists, toxic, clean = [r[0] for r in got], np.array([r[1] for r in got], float), np.array([r[2] for r in got], float)
    p, n = int(toxic.sum()), int(clean.sum())
    if not p or not n:
        return Model.of([], np.r_[6.0, np.zeros(len(PATTERNS))], -4.0)
    chosen = choose_voters(lists, toxic - MIN_RATIO * clean, families(terms))
    fixed = 1 + len(PATTERNS)
    places = {f: i for i, f in enumerate([*chosen, *range(len(terms), len(terms) + fixed)])}
    votes = np.zeros((len(lists), len(places)), np.uint8)
    for i, found in enumerate(lists):
        votes[i, [places[f] for f in found if f in places]] = 1
    guess = np.stack([(y @ votes + 0.5) / (k + 1.0) for y, k in ((clean, n), (toxic, p))], axis=1)
    post = fit_label_model(votes, guess, p / (p + n), times=toxic + clean)
    return Model.of(terms, *fit_linear(lists, len(terms) + fixed, post, toxic + clean))


def score(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """`(doc_id, score)` for every row, or with `keep` all columns as the struct `it` and the score."""
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("it") if keep else F.col("doc_id").cast("bigint").alias("doc_id")
    text = F.col("it.text") if keep else plain_text()
    rows = docs.select(first, *([] if keep else [text.alias("text")]))
    name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = model.chunk_cache()
        for batch in batches:
            texts = batch.column(0).field("text") if keep else batch.column(1)
            sums = [
                sum(model.weights[i] for i in sorted(model.features(t.as_py() or "", cache))) + model.bias for t in texts
            ]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -50, 50)))
            yield pa.record_batch([batch.column(0), pa.array(scores)], names=[name, "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """`(doc_id, held_out, score, predicted)`, one row per input row.

    Labels come only from rows whose crc32(doc_id as text) modulo 4 is not 2; label, lang,
    source and doc_id are never inputs of a score. Null texts score as empty ones. A null
    doc_id is not held out and teaches nothing. Repeated rows are scored each; other
    columns are ignored; an empty table gives no row.
    """
    model = train(docs, labels, bound)
    return score(docs, model).select(
        "doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """`docs` without the rows that score THRESHOLD or more; all columns stay."""
    return score(docs, train(docs, labels, bound), keep=True).where(F.col("score") < THRESHOLD).select("it.*")
