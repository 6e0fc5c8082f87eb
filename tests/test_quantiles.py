import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from autolens.operators import quantiles as Q

P = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def expected(values):
    return [float(np.quantile(values, p)) for p in P.values()]


def check(row, values):
    assert row["n"] == len(values)
    assert [row[p] for p in P] == pytest.approx(expected(values), rel=1e-12, abs=1e-300)


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


CASES = {
    "prices": [round(random.Random(1).uniform(1, 1e5), 2) for _ in range(3000)],
    "continuous": [random.Random(2).gauss(0, 1) ** 3 for _ in range(3000)],
    "one hot value": [5.0] * 2000 + [float(i) for i in range(1000)],
    "far apart": [10.0**k for k in range(-300, 300)],
    "negative": [-(1.0 + i * 1e-9) for i in range(1000)],
    "neighbours": [1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2), 1.0],
    "signs": [-1e300, -1.0, -0.0, 0.0, 1e-300, 1e300],
    "one": [3.25],
    "whole numbers": [float(i % 1000) for i in range(5000)],
    "tiny": [5e-324, 1e-323, 2e-323],
}


@pytest.mark.parametrize("name", CASES)
def test_matches_numpy(spark, name):
    check(Q.quantiles(frame(spark, CASES[name]), ["v"], P).first(), CASES[name])


def test_nulls_and_nan_are_left_out(spark):
    df = frame(spark, [1.0, None, float("nan"), 2.0, float("inf"), 4.0])
    check(Q.quantiles(df, ["v"], P).first(), [1.0, 2.0, 4.0])
    assert Q.quantiles(frame(spark, [None, None]), ["v"], P).collect() == []


def grouped(spark):
    generator = random.Random(3)
    rows = [("hot", round(generator.uniform(0, 1e6), 2), generator.randint(0, 9)) for _ in range(2000)]
    rows += [(generator.choice(["a", "b", None]), generator.gauss(5, 2), generator.randint(0, 99)) for _ in range(1000)]
    return rows, spark.createDataFrame(rows, "g string, x double, y int")


@pytest.mark.parametrize("limit", [200_000, 0])
def test_groups_by_broadcast_and_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(Q, "BROADCAST_ROWS", limit)
    rows, df = grouped(spark)
    found = {(r["g"], r["column"]): r for r in Q.quantiles(df, ["x", "y"], P, by=["g"]).collect()}
    assert len(found) == 8
    for group in ("hot", "a", "b", None):
        for i, column in ((1, "x"), (2, "y")):
            check(found[(group, column)], [float(r[i]) for r in rows if r[0] == group])


def test_few_parts_take_more_passes(spark, monkeypatch):
    monkeypatch.setattr(Q, "PARTS", 3)
    check(Q.quantiles(frame(spark, CASES["continuous"]), ["v"], P).first(), CASES["continuous"])


def test_many_open_ranges_are_joined(spark, monkeypatch):
    monkeypatch.setattr(Q, "MAX_RANGES", 1)
    check(Q.quantiles(frame(spark, CASES["prices"]), ["v"], P).first(), CASES["prices"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=64, min_value=-1e150, max_value=1e150), min_size=1, max_size=60))
def test_any_numbers(spark, values):
    row = Q.quantiles(frame(spark, values), ["v"], {"median": 0.5}).first()
    assert row["median"] == pytest.approx(float(np.quantile(values, 0.5)), rel=1e-9, abs=1e-12)


def test_approximate(spark):
    row = Q.approximate_quantiles(frame(spark, CASES["whole numbers"]), ["v"], {"median": 0.5}).first()
    assert row["n"] == 5000 and abs(row["median"] - 499.5) <= 1


def test_a_dominant_group_of_full_precision(spark):
    """Two scans where the open buckets are small, three where they have to be divided first."""
    import numpy as np

    from autolens.operators.quantiles import quantiles

    rng = np.random.default_rng(4)
    rows = [("hot", float(x)) for x in rng.lognormal(3, 2, 20_000)] + [("hot", 7.25)] * 3000 + [("cold", float(x)) for x in rng.normal(0, 1, 500)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"a": 0.01, "b": 0.5, "c": 0.975}
    for ordered_rows in (500_000, 40, 0):
        for groups in (2, 10**9):
            found = quantiles(df, ["x"], wanted, by=["g"], max_groups=groups, ordered_rows=ordered_rows).collect()
            assert len(found) == 2
            for r in found:
                values = [x for g, x in rows if g == r["g"]]
                assert [r[k] for k in wanted] == pytest.approx(np.quantile(values, list(wanted.values())).tolist(), rel=1e-12)
