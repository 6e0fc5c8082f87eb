import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from autolens.models import clustering, isolation
from autolens.models.run import TASKS, chart_tables, report_rows, run_ml
from autolens.models.screening import feature_columns, screen_targets
from autolens.models.supervised import classify, regress, weighted_scores
from autolens.operators.column_types import infer_types
from autolens.plans.insights import model_insights


@pytest.fixture(scope="module")
def staff(spark):
    generator = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({
        "employee_id": np.arange(n), "age": generator.integers(20, 60, n).astype(float),
        "salary": generator.lognormal(8, 0.4, n), "department": generator.choice(["a", "b", "c"], n), "country": "x",
    })
    leaves = (pdf["salary"] < 2600) & (pdf["age"] < 45)
    pdf["attrition"] = np.where(leaves ^ (generator.random(n) < 0.03), "Yes", "No")
    pdf["bonus"] = pdf["salary"] * 0.1 + np.where(pdf["department"] == "a", 500.0, 0.0) + generator.normal(0, 5, n)
    pdf.loc[::9, "age"] = None
    df = spark.createDataFrame(pdf)
    return df, infer_types(df)


def test_screening(staff):
    df, types = staff
    rows = {(r["column"], r["role"]): r for r in screen_targets(df, types).collect()}
    assert rows["attrition", "class_target"]["eligible"] and rows["attrition", "class_target"]["preferred"]
    assert not rows["country", "class_target"]["eligible"] and not rows["country", "categorical_feature"]["eligible"]
    assert rows["salary", "regression_target"]["preferred"] and ("employee_id", "numeric_feature") not in rows
    assert feature_columns(df, types, "attrition") == (["age", "salary", "bonus"], ["department"])


def test_classification(staff):
    df, types = staff
    result = classify(df, types, "attrition", boost_rounds=5)
    majority = max(r["count"] for r in df.groupBy("attrition").count().collect()) / 400
    assert result.used and result.metrics["accuracy"] > majority + 0.05
    matrix = result.tables["confusion_matrix"].collect()
    assert len(matrix) == 4
    right = sum(r["count"] for r in matrix if r["actual"] == r["predicted"])
    assert right / sum(r["count"] for r in matrix) == pytest.approx(result.metrics["accuracy"])
    if result.importance is not None:
        shares = {r["feature"]: r["importance"] for r in result.importance.collect()}
        assert set(shares) <= {"age", "salary", "bonus", "department"} and sum(shares.values()) == pytest.approx(1, abs=0.01)
    texts = [r["message"] for r in model_insights(result).collect()]
    assert texts[0].startswith("Machine learning (classification:") and texts[1].startswith("Classification accuracy: ")


def test_rare_classes_drop_out(staff):
    df, types = staff
    rare = df.withColumn("status", F.when(F.col("employee_id") < 3, "rare").otherwise(F.col("attrition")))
    result = classify(rare.drop("attrition"), infer_types(rare.drop("attrition")), "status", models=["decision_tree"])
    assert {r["actual"] for r in result.tables["confusion_matrix"].collect()} == {"Yes", "No"}


def test_three_classes_boosted(staff):
    df, types = staff
    result = classify(df, types, "department", boost_rounds=2, models=["gradient_boosting"])
    assert result.model_type == "classification:gradient_boosting" and result.importance is not None


def test_regression_and_importance(staff):
    df, types = staff
    result = regress(df, types, "bonus", boost_rounds=5)
    assert result.used and result.metrics["r2"] > 0.9 and result.metrics["rmse"] ** 2 == pytest.approx(result.metrics["mse"])
    assert result.tables["residuals"].agg(F.sum("count")).first()[0] == result.tables["actual_vs_predicted"].count()
    forest = regress(df, types, "bonus", models=["random_forest"])
    ranked = [r["feature"] for r in forest.importance.collect()]
    assert set(ranked[:2]) == {"department", "salary"} and len(ranked) == len(set(ranked)) <= 4


def test_weighted_scores():
    scores = weighted_scores([(0.0, 0.0, 6), (0.0, 1.0, 2), (1.0, 1.0, 1), (1.0, 0.0, 1)])
    assert scores["accuracy"] == pytest.approx(0.7) and scores["recall"] == pytest.approx(0.7)
    precision = 0.8 * 6 / 7 + 0.2 * 1 / 3
    f1 = 0.8 * (2 * 6 / 7 * 0.75 / (6 / 7 + 0.75)) + 0.2 * (2 / 3 * 0.5 / (1 / 3 + 0.5))
    assert scores["precision"] == pytest.approx(precision) and scores["f1"] == pytest.approx(f1)


@pytest.fixture(scope="module")
def blobs(spark):
    generator = np.random.default_rng(11)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    points = np.vstack([c + generator.normal(0, 1, (100, 2)) for c in centres])
    far = generator.uniform(60, 90, (3, 2))
    return (spark.createDataFrame(pd.DataFrame(points, columns=["u", "v"])),
            spark.createDataFrame(pd.DataFrame(np.vstack([points, far]), columns=["u", "v"])))


def test_clusters(blobs):
    df, _ = blobs
    result = run_ml(df, infer_types(df), "clustering")
    assert result.used, result.message
    assert result.metrics["n_clusters"] == 3 and result.metrics["silhouette"] > 0.9
    assert sorted(r["count"] for r in result.tables["cluster_distribution"].collect()) == [100, 100, 100]
    centres = sorted((round(r["u"] / 20), round(r["v"] / 20)) for r in result.tables["cluster_summary"].collect())
    assert centres == [(0, 0), (0, 1), (1, 0)]
    assert result.tables["scatter"].count() == 300 and result.tables["elbow"].count() == 7


def test_clusters_of_a_coreset_lose_little_on_all_rows(spark):
    """Loss and silhouette of all rows against Spark's on all rows, with a coreset of a tenth."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(9)
    centres = rng.normal(0, 6, (5, 3))
    x = centres[rng.integers(0, 5, 4000)] + rng.normal(size=(4000, 3))
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["f0", "f1", "f2"])).repartition(6)
    points, varying = clustering.standardised(rows, ["f0", "f1", "f2"])
    core = clustering.coreset(points, 3, 4000, varying, 400).toPandas()
    assert 300 < len(core) < 500 and abs(core["weight"].sum() - 4000) < 600
    models = clustering.fitted(spark.createDataFrame(core), 3, [(5, 0), (5, 1), (3, 0), (3, 1)])
    sums = clustering.cluster_sums(points, 3, models)
    vectors = VectorAssembler(inputCols=["s0", "s1", "s2"], outputCol="features").transform(points)
    for k, centres in models.items():
        spark_loss = min(KMeans(k=k, seed=i).fit(vectors).summary.trainingCost for i in range(3))
        assert sums[k]["n"].sum() == 4000 and sums[k]["loss"].sum() <= 1.1 * spark_loss
        judged = vectors.withColumn("prediction", clustering.nearest_centre(centres))
        want = ClusteringEvaluator(featuresCol="features").evaluate(judged)
        assert abs(clustering.silhouettes(points, 3, models, sums)[k] - want) < 1e-9


def test_clusters_of_equal_rows(spark):
    rows = spark.createDataFrame([(1.0, 2.0)] * 50, "f0 double, f1 double")
    points, varying = clustering.standardised(rows, ["f0", "f1"])
    models = clustering.fitted(clustering.coreset(points, 2, 50, varying), 2, [(2, 0)])
    sums = clustering.cluster_sums(points, 2, models)
    assert varying == 0 and sums[2]["loss"].sum() == 0 and sums[2]["n"].max() == 50
    assert clustering.silhouettes(points, 2, models, sums) == {2: -1.0}


def test_anomalies(blobs):
    _, df = blobs
    result = run_ml(df, infer_types(df), "anomaly")
    assert result.used, result.message
    scores = result.tables["scores"]
    assert scores.count() == 303
    worst = scores.orderBy(F.desc("score")).limit(3).collect()
    assert all(r["u"] > 50 and r["anomaly"] for r in worst)
    assert scores.where("score > 0.5").count() == result.metrics["anomaly_count"]
    again = run_ml(df, infer_types(df), "anomaly")
    assert again.metrics == result.metrics


def test_isolation_against_brute_force(spark, blobs):
    """Scores of the vectorised trees equal a walk down each tree, row by row."""
    _, df = blobs
    rows = df.select(F.col("u").alias("f0"), F.col("v").alias("f1"))
    names = ["f0", "f1"]
    nodes = isolation.grow_trees(isolation.draw_samples(rows, 303, 7, 64, 1), names, 64, 1).toPandas()
    assert sorted(nodes["tree"].unique()) == list(range(7))
    found = isolation.score_rows(rows, names, nodes, 64).collect()
    trees = {t: g.set_index("node") for t, g in nodes.groupby("tree")}
    for row in found[::29]:
        lengths = []
        for tree in trees.values():
            node = tree.loc[0]
            while node["feature"] >= 0:
                node = tree.loc[int(node["left"] if row[int(node["feature"])] <= node["threshold"] else node["right"])]
            lengths.append(node["length"])
        assert row["score"] == pytest.approx(2 ** (-np.mean(lengths) / isolation.mean_path(64)))


def test_samples_follow_one_rule(spark):
    rows = spark.range(5000).select(F.col("id").cast("double").alias("f0"))
    drawn = isolation.draw_samples(rows, 5000, 10, 64, 1)
    assert [r["count"] for r in drawn.groupBy("tree").count().collect()] == [64] * 10
    assert drawn.distinct().count() == 640
    # Trees draw from all rows, so two of them share about 64 * 64 / 5000 rows.
    assert 560 < drawn.select("f0").distinct().count() < 640


def test_mean_path():
    assert isolation.mean_path(1) == 0 and isolation.mean_path(2) == 1
    assert isolation.mean_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_forecast(spark):
    df = spark.range(36).select(F.expr("timestamp_ntz'2020-01-05 00:00:00' + make_interval(0, int(id))").alias("day"), (F.col("id") * 2.0 + 1).alias("sales"))
    result = run_ml(df, infer_types(df), "forecasting")
    assert result.used and result.metrics["horizon_months"] == 6 and result.metrics["mae"] == pytest.approx(0, abs=1e-6)
    assert chart_tables(result)["history"].count() == 36 and chart_tables(result)["forecast"].count() == 6
    assert result.warnings and report_rows(result).where("field = 'used' and value = 'true'").count() == 1


def test_unsuitable_data_is_a_warning(spark, staff):
    df, types = staff
    tiny = df.limit(29)
    for task, target in (("classification", "attrition"), ("regression", "bonus"), ("clustering", None), ("anomaly", None), ("forecasting", None), ("magic", None)):
        result = run_ml(tiny, types, task, target)
        assert not result.used and result.warnings and not chart_tables(result)
    assert model_insights(result) is None and len(TASKS) == 5


def test_scoring_keeps_its_places_in_cache(monkeypatch, spark, blobs):
    """Whatever the number of trees, a batch takes little memory; the scores are those of Spark's run."""
    import tracemalloc

    _, df = blobs
    rows = df.select(F.col("u").alias("f0"), F.col("v").alias("f1"))
    nodes = isolation.grow_trees(isolation.draw_samples(rows, 303, 100, 256, 1), ["f0", "f1"], 256, 1).toPandas()
    want = [r["score"] for r in isolation.score_rows(rows, ["f0", "f1"], nodes, 256).collect()]
    kept = []
    monkeypatch.setattr(isolation.F, "pandas_udf", lambda _: lambda f: kept.append(f) or (lambda *columns: None))
    isolation.score_rows(type("Rows", (), {"withColumn": lambda *_: None})(), ["f0", "f1"], nodes, 256)
    values = df.toPandas()
    many = pd.concat([values] * 33, ignore_index=True)
    tracemalloc.start()
    got = kept[0](many["u"], many["v"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:303].tolist() == pytest.approx(want) and peak < 2_000_000
