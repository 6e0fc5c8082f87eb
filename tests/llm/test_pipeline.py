"""The stages in a row, against brute force on what each was given."""

import numpy as np
import pyarrow.parquet as pq
from test_dedup import body
from test_tokens import check_pieces
from tokenizers import Tokenizer

import corpus_pipeline
from autolens.llm import simhash, toxicity
from autolens.llm.queries import BYTE_TOKENIZER


def test_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = docs.collect()
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    clean = corpus_pipeline.toxicity(spark, docs, folder)
    assert clean.schema == docs.schema
    after = clean.collect()
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in given if not scores[r["doc_id"]])

    single = corpus_pipeline.exact_dedup(spark, clean, folder)
    assert single.columns == docs.columns
    groups = {}
    for r in after:
        groups.setdefault(body(r["text"]), []).append((-len(r["text"]), r["doc_id"]))
    after = single.collect()
    assert sorted(r["doc_id"] for r in after) == sorted(min(g)[1] for g in groups.values())

    apart = corpus_pipeline.near_dedup(spark, single, folder)
    assert apart.columns == docs.columns
    after.sort(key=lambda r: r["doc_id"])
    prints = np.array([simhash.wide_fingerprint(r["text"], 5) for r in after])
    bits = simhash.wide_bits(0.8)
    lowest = {}
    for i, r in enumerate(after):  # in order of doc_id: the first of a pair stays
        near = np.flatnonzero(simhash._distance(prints[:i], prints[i]) <= bits)
        lowest[r["doc_id"]] = min([r["doc_id"], *(lowest[after[j]["doc_id"]] for j in near)])
    gone = {r["doc_id"] for r in after} - {r["doc_id"] for r in apart.collect()}
    want = {d for d, low in lowest.items() if low < d}
    assert gone <= want
    sets = [set(simhash.shingle_hashes(r["text"], 5).tolist()) for r in after]
    copies = [
        after[i]["doc_id"] in gone for i in range(len(after)) for j in range(i)
        if len(sets[i] & sets[j]) >= 0.82 * len(sets[i] | sets[j])
    ]
    assert all(copies)
    after = apart.collect()

    library = Tokenizer.from_file(BYTE_TOKENIZER)
    sizes = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in after}
    check_pieces(corpus_pipeline.packing(spark, apart, folder).collect(), sizes)


def test_run_equals_the_stages(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    kept = {p["doc_id"] for p in pieces}
    toxic = {d for d, t in zip(labels["doc_id"], labels["toxic"], strict=True) if t}
    assert np.sum([p["length"] for p in pieces]) > 0 and len(kept & toxic) < len(toxic)


def test_stages_on_odd_rows(spark, odd_docs, no_docs, folder):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, folder)
            assert docs.columns == columns
        total = corpus_pipeline.packing(spark, docs, folder)
        assert {r["doc_id"] for r in total.collect()} == {r["doc_id"] for r in docs.collect()}
