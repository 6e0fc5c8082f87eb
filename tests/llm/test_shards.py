"""Places of the external shuffle: any layout of the input, copies, many buckets."""

import pytest
from pyspark.sql import functions as F

from autolens.llm import sharding


def placed(docs, **kw):
    rows, n = sharding.shuffled(docs, **kw)
    found = [(r["place"], r["it"].asDict(recursive=True)) for r in rows.collect()]
    assert sorted(p for p, _ in found) == list(range(n)) and n == docs.count()
    return [x for _, x in sorted(found, key=lambda pair: pair[0])]


@pytest.fixture(scope="module")
def docs(spark):
    plain = [(i if i % 9 else None, f"text {i}" if i % 7 else None) for i in range(600)]
    return spark.createDataFrame([(1, "copy")] * 700 + plain + [(2, "two")] * 2, "doc_id bigint, text string")


def test_same_places_in_any_layout(docs):
    first = placed(docs, bucket_bytes=600)
    assert first == placed(docs.orderBy(F.desc("text")).coalesce(1), bucket_bytes=600)
    assert first == placed(docs.repartition(13), bucket_bytes=600, copy_chunk=50)


def test_the_input_comes_out_and_is_mixed(docs):
    got = placed(docs)
    assert sorted(map(str, got)) == sorted(str(r.asDict()) for r in docs.collect())
    copies = [i for i, r in enumerate(got) if r["text"] == "copy"]
    half = len(got) / 2
    assert abs(sum(i < half for i in copies) - len(copies) / 2) < 80


def test_many_buckets_in_few_tasks(docs, monkeypatch):
    want = placed(docs, bucket_bytes=100)
    monkeypatch.setattr(sharding, "FREE_TASKS", 3)
    assert placed(docs, bucket_bytes=100) == want
    rows, _ = sharding.shuffled(docs, bucket_bytes=100, task_bytes=4000)
    assert 3 <= rows.rdd.getNumPartitions() <= 10


def test_first_places_of_many_buckets(spark):
    sizes = [(b, b % 5 + 1) for b in range(0, 30_000, 3)]
    got = sorted(sharding.first_places(spark.createDataFrame(sizes, "bucket bigint, rows bigint")).collect())
    at = 0
    for (bucket, size), row in zip(sizes, got, strict=True):
        assert tuple(row) == (bucket, size, at)
        at += size


def test_rows_that_differ_in_a_map_a_zero_or_a_null_stay(spark):
    docs = spark.sql(
        "SELECT 1L AS doc_id, 'a' AS text, map('k', id % 2) AS m, if(id % 4 < 2, 0.0D, -0.0D) AS z,"
        " if(id < 8, '', null) AS e, id AS id FROM range(16)"
    ).drop("id")
    got = placed(docs)
    assert sorted(map(str, got)) == sorted(str(r.asDict(recursive=True)) for r in docs.collect())
