"""Classification and regression: the best of a few standard Spark ML models."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.feature import (
    Imputer, ImputerModel, OneHotEncoder, OneHotEncoderModel, StandardScaler, StandardScalerModel, StringIndexer,
    StringIndexerModel, VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col
from ..functions.scalars import finite
from ..operators.distributions import histogram
from ..operators.grouping import numeric_value
from ..operators.sampling import stable_sample
from ..operators.staging import stage
from .forest import Forest, ForestModel
from .screening import ModelResult, feature_columns
from ..operators.local import collected, local_table

TRAIN_SHARE = 0.75
FOREST_TREES = 100
FOREST_DEPTH = 8
TREE_DEPTH = 6
BOOST_DEPTH = 3
BOOST_ROUNDS = 20
TOP_FEATURES = 15
MAX_CLASSES = 100
PARALLEL_FITS = 4
#: Beyond so many rows they are dealt to tasks evenly and a forest is grown on binned rows.
MANY_ROWS = 200_000
TASK_ROWS, FEW_TASKS = 250_000, 24


def hash_fraction(columns: Sequence[Column]) -> Column:
    """A number in [0, 1) from the md5 of the columns as text, null as empty."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / float(1 << 32)


def split(rows: DataFrame, key: Sequence[str], by: str | None = None) -> DataFrame:
    """`rows` with `train`, true for three quarters by the hash of the key columns.

    The split is the same in any order and partitioning. With `by`, a class whose hashes
    all lie on one side gives its row of the lowest hash to the test, or keeps the one of
    the highest for training, so that every class of two different rows is on both sides.
    Only the lowest and highest hash of a class are gathered.
    """
    h = F.col("_hash")
    hashed = rows.withColumn("_hash", hash_fraction([col(k) for k in key]))
    if by is None:
        return hashed.withColumn("train", h >= 1 - TRAIN_SHARE).drop("_hash")
    ends = hashed.groupBy(col(by).alias("_class")).agg(F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
    test = (h < F.greatest(F.lit(1 - TRAIN_SHARE), F.col("_low"))) | (h == F.col("_low"))
    return (
        hashed.join(F.broadcast(ends), col(by) == F.col("_class"))  # one row per class
        .withColumn("train", ~(test & (h < F.col("_high")))).drop("_hash", "_class", "_low", "_high")
    )


def _feature_rows(
    df: DataFrame, numeric: list[str], categories: list[str], label, key: Sequence[str] = (), stratified: bool = False
) -> DataFrame:
    """`(n0.., k0.., label, train)`, staged once.

    The split goes by the key columns, which should tell rows apart; without a key by
    all features and the label, so that equal rows are on one side.
    """
    names = [f"key{i}" for i in range(len(key))]
    rows = df.select(
        *[finite(col(c)).alias(f"n{i}") for i, c in enumerate(numeric)],
        *[F.coalesce(col(c).cast("string"), F.lit("(missing)")).alias(f"k{i}") for i, c in enumerate(categories)],
        *[col(c).alias(n) for c, n in zip(key, names)],
        label.alias("label"),
    ).where(F.col("label").isNotNull())
    return stage(split(rows, names or rows.columns, "label" if stratified else None).drop(*names))


def _preparation(rows: DataFrame, numeric: list[str], categories: list[str]) -> tuple[PipelineModel, list[str]]:
    """Impute and standardise numbers, one-hot encode categories; with the numbers that have values.

    A median is only looked for where a value is missing.
    """
    stages, inputs, present = [], [], []
    train = rows.where("train")
    if numeric:
        counts = rows.agg(*[
            F.struct(F.count(F.when(F.col("train"), F.col(c))), F.count_if(F.col(c).isNull())).alias(c)
            for c in (f"n{i}" for i in range(len(numeric)))
        ]).first()
        plain = [f"n{i}" for i in range(len(numeric)) if counts[f"n{i}"][0]]
        gaps = [c for c in plain if counts[c][1]]
        present = [numeric[int(c[1:])] for c in plain]
    if present:
        if gaps:
            stages.append(Imputer(inputCols=gaps, outputCols=[f"f{c}" for c in gaps], strategy="median"))
        stages += [
            VectorAssembler(inputCols=[f"f{c}" if c in gaps else c for c in plain], outputCol="numbers"),
            StandardScaler(inputCol="numbers", outputCol="num", withMean=True),
        ]
        inputs.append("num")
    if categories:
        names = [f"k{i}" for i in range(len(categories))]
        indexes = [f"i{c}" for c in names]
        codes = [f"oh{i}" for i in range(len(categories))]
        stages += [
            StringIndexer(inputCols=names, outputCols=indexes, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexes, outputCols=codes, handleInvalid="keep"),
        ]
        inputs += codes
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages).fit(train), present


def dealt(rows: DataFrame, n: int) -> DataFrame:
    """The `n` rows in equal partitions of a bounded size, however few files hold them."""
    if n <= MANY_ROWS:
        return rows
    return rows.repartition(math.ceil(max(n / TASK_ROWS, min(n * 5 / TASK_ROWS, FEW_TASKS))))


def plain_features(preparation: PipelineModel) -> Column:
    """The features of a fitted preparation as an array, by expressions on the numbers and categories.

    They are the entries of its vectors; no row becomes a vector on the way.
    """
    found: dict[str, list[Column]] = {}
    labels: dict[str, tuple[str, list[str]]] = {}
    for step in preparation.stages:
        if isinstance(step, ImputerModel):
            medians = step.surrogateDF.first()
            for c, out in zip(step.getInputCols(), step.getOutputCols(), strict=True):
                found[out] = [F.coalesce(F.col(c), F.lit(medians[c]))]
        elif isinstance(step, VectorAssembler):
            found[step.getOutputCol()] = [x for c in step.getInputCols() for x in found.get(c, [F.col(c)])]
        elif isinstance(step, StandardScalerModel):
            facts = zip(found[step.getInputCol()], step.mean.tolist(), step.std.tolist(), strict=True)
            found[step.getOutputCol()] = [(x - F.lit(mean)) * F.lit(1 / std if std else 0.0) for x, mean, std in facts]
        elif isinstance(step, StringIndexerModel):
            for c, out, known in zip(step.getInputCols(), step.getOutputCols(), step.labelsArray, strict=True):
                labels[out] = c, list(known)
        elif isinstance(step, OneHotEncoderModel):
            for c, out in zip(step.getInputCols(), step.getOutputCols(), strict=True):
                name, known = labels[c]
                hits = [F.col(name) == F.lit(x) for x in known] + [~F.col(name).isin(known)]
                found[out] = [hit.cast("double") for hit in hits]
        else:
            raise TypeError(f"No expressions for {type(step).__name__}.")
    return F.array(*found["features"])


def spread(rows: DataFrame, n: int) -> DataFrame:
    """The rows as they are where a scan has many tasks, else dealt and kept."""
    if rows.rdd.getNumPartitions() >= FEW_TASKS:
        return rows
    return dealt(rows, n).persist(StorageLevel.MEMORY_AND_DISK)


def _prepared(preparation: PipelineModel, rows: DataFrame, n: int, models: Sequence[str] | None) -> tuple[DataFrame, Callable]:
    """`(features, label, train)` for the models and what frees them.

    Most models go over the rows again and again and get them as vectors that are kept. A
    forest of many rows reads them three times: alone, it takes them from the staged table.
    """
    if n > MANY_ROWS and models is not None and set(models) == {"random_forest"}:
        kept = spread(rows, n)
        return kept.select(plain_features(preparation).alias("features"), "label", "train"), kept.unpersist
    kept = preparation.transform(dealt(rows, n)).select("features", "label", "train").persist(StorageLevel.MEMORY_AND_DISK)
    return kept, kept.unpersist


def forest(estimator, n: int, classes: int = 0):
    """Spark's forest, or for many rows one that is grown on binned rows."""
    return Forest(FOREST_TREES, FOREST_DEPTH, K.SEED, classes) if n > MANY_ROWS else estimator


def _tried(session, candidates: dict, models: Sequence[str] | None, judge: Callable, parallel: int = PARALLEL_FITS) -> list:
    """`(name, *judge(estimator))` of the wanted candidates, fitted side by side, in their order.

    The jobs of one model leave executors idle between its rounds; another's fill the gaps.
    """
    wanted = [name for name in candidates if models is None or name in models]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        running = [pool.submit(inheritable_thread_target(session)(judge), candidates[name]) for name in wanted]
        return [(name, *task.result()) for name, task in zip(wanted, running, strict=True)]


def _importances(model) -> list[float] | None:
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray().tolist()
    parts = [m.featureImportances.toArray() for m in getattr(model, "models", []) if hasattr(m, "featureImportances")]
    return (sum(parts) / len(parts)).tolist() if parts else None


def feature_importance(
    model, prepared: DataFrame, numeric: list[str], categories: list[str], k: int | None = TOP_FEATURES
) -> DataFrame | None:
    """`(feature, importance)`: the codes of a category folded into one, shares of 1, the k best (None: all)."""
    weights = _importances(model)
    if weights is None:
        return None
    groups = prepared.schema["features"].metadata["ml_attr"]["attrs"]
    totals: dict[str, float] = defaultdict(float)
    for attributes in groups.values():
        for attribute in attributes:
            source, _, rest = attribute["name"].partition("_")
            name = numeric[int(rest)] if source == "num" else categories[int(source[2:])]
            totals[name] += weights[attribute["idx"]]
    whole = sum(totals.values()) or 1.0
    ranked = sorted(totals.items(), key=lambda item: (-item[1], item[0]))[:k]
    return local_table(prepared.sparkSession, [(name, round(weight / whole, 4)) for name, weight in ranked], "feature string, importance double"
    )


def weighted_scores(confusion: list[tuple[float, float, int]]) -> dict[str, float]:
    """Accuracy and class-weighted precision, recall and F1 from (actual, predicted, count)."""
    total = sum(n for _, _, n in confusion) or 1
    actual, predicted, right = defaultdict(int), defaultdict(int), defaultdict(int)
    for a, p, n in confusion:
        actual[a] += n
        predicted[p] += n
        if a == p:
            right[a] += n
    scores = {"accuracy": sum(right.values()) / total, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    for label, n in actual.items():
        precision = right[label] / predicted[label] if predicted[label] else 0.0
        recall = right[label] / n
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        for name, value in (("precision", precision), ("recall", recall), ("f1", f1)):
            scores[name] += value * n / total
    return scores


def classify(
    df: DataFrame, types: dict[str, str], target: str, boost_rounds: int = BOOST_ROUNDS,
    models: Sequence[str] | None = None, max_classes: int = MAX_CLASSES, key: Sequence[str] = (),
) -> ModelResult:
    """Train four classifiers on three quarters of the rows and keep the best weighted F1.

    `models` restricts the candidates by name. A target of more than `max_classes`
    values is refused, since the matrix of classes comes to the driver.
    """
    result = ModelResult(df.sparkSession, "classification", target=target)
    numeric, categories = feature_columns(df, types, target)
    if not numeric + categories:
        raise ValueError(K.MODEL_SENTENCES["no_class_features"])
    label = col(target).cast("string")
    sizes = (
        df.where(label.isNotNull()).groupBy(label.alias("c")).count()
        .where(F.col("count") >= K.ML_MIN_CLASS_ROWS).limit(max_classes + 1).collect()
    )
    classes = sorted(r["c"] for r in sizes)
    if len(classes) > max_classes:
        raise ValueError(f"Target has more than {max_classes} classes.")
    if len(classes) < 2:
        raise ValueError(K.MODEL_SENTENCES["few_classes"])
    n = sum(r["count"] for r in sizes)
    if n < K.ML_MIN_ROWS:
        raise ValueError(K.MODEL_SENTENCES["few_class_rows"])
    # Class numbers in alphabetical order; rare classes have none and drop out.
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    rows = _feature_rows(df, numeric, categories, F.when(number > 0, (number - 1).cast("double")), key, stratified=True)
    preparation, numeric_used = _preparation(rows, numeric, categories)
    prepared, free = _prepared(preparation, rows, n, models)
    train, test = prepared.where("train"), prepared.where("not train")
    boost = GBTClassifier(maxIter=boost_rounds, maxDepth=BOOST_DEPTH, stepSize=0.1, seed=K.SEED)
    candidates = {
        "logistic_regression": LogisticRegression(maxIter=100, regParam=1.0 / n),
        "decision_tree": DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=K.SEED),
        "random_forest": forest(RandomForestClassifier(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=K.SEED), n, len(classes)),
        "gradient_boosting": boost if len(classes) == 2 else OneVsRest(classifier=boost),
    }

    def judge(estimator):
        model = estimator.fit(train)
        cells = model.transform(test).groupBy("label", "prediction").count().collect()
        return model, weighted_scores([(r["label"], r["prediction"], r["count"]) for r in cells]), cells

    # The first of equals.
    best = max(_tried(df.sparkSession, candidates, models, judge), key=lambda found: found[2]["f1"])
    name, model, scores, cells = best
    session = df.sparkSession
    counted = {(int(r["label"]), int(r["prediction"])): r["count"] for r in cells}
    matrix = [
        (a, p, counted.get((i, j), 0)) for i, a in enumerate(classes) for j, p in enumerate(classes)
    ]
    result.used = True
    result.model_type = f"classification:{name}"
    result.features = numeric + categories
    result.metrics = scores
    result.importance = feature_importance(model, preparation.transform(rows), numeric_used, categories)
    result.tables["confusion_matrix"] = local_table(session, matrix, "actual string, predicted string, count bigint"
    )
    result.tables["prediction_distribution"] = (
        result.tables["confusion_matrix"].groupBy(F.col("predicted").alias("class"))
        .agg(F.sum("count").alias("count")).where("count > 0")
    )
    if result.importance is not None:
        result.tables["feature_importance"] = result.importance
    result.message = K.MODEL_SENTENCES["classifier"].format(name, target)
    free()
    return result


def regress(
    df: DataFrame, types: dict[str, str], target: str, boost_rounds: int = BOOST_ROUNDS,
    models: Sequence[str] | None = None, key: Sequence[str] = (),
) -> ModelResult:
    """Train three regressors on three quarters of the rows and keep the best R².

    `models` restricts the candidates by name.
    """
    result = ModelResult(df.sparkSession, "regression", target=target)
    numeric, categories = feature_columns(df, types, target)
    if not numeric + categories:
        raise ValueError(K.MODEL_SENTENCES["no_regression_features"])
    rows = _feature_rows(df, numeric, categories, numeric_value(df, target), key)
    n = rows.count()
    if n < K.ML_MIN_ROWS:
        raise ValueError(K.MODEL_SENTENCES["few_regression_rows"])
    preparation, numeric_used = _preparation(rows, numeric, categories)
    prepared, free = _prepared(preparation, rows, n, models)
    train, test = prepared.where("train"), prepared.where("not train")
    candidates = {
        "linear_regression": LinearRegression(),
        "random_forest": forest(RandomForestRegressor(numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, seed=K.SEED), n),
        "gradient_boosting": GBTRegressor(maxIter=boost_rounds, maxDepth=BOOST_DEPTH, stepSize=0.1, seed=K.SEED),
    }
    error = F.col("label") - F.col("prediction")

    def judge(estimator):
        model = estimator.fit(train)
        tested = model.transform(test).select("label", "prediction")
        if isinstance(model, ForestModel):
            tested = stage(tested)
        row = tested.agg(
            F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("mse"),
            F.var_pop("label").alias("spread"),
        ).first()
        r2 = 1 - row["mse"] / row["spread"] if row["spread"] else 0.0
        return model, {"mae": row["mae"], "mse": row["mse"], "rmse": row["mse"] ** 0.5, "r2": r2}, tested

    best = max(_tried(df.sparkSession, candidates, models, judge), key=lambda found: found[2]["r2"])
    name, model, scores, tested = best
    predictions = tested.select(
        F.col("label").alias("actual"), F.col("prediction").alias("predicted"), error.alias("residual")
    )
    shown = stable_sample(predictions, K.RESIDUAL_POINTS)
    points = collected(shown)[1]
    result.used = True
    result.model_type = f"regression:{name}"
    result.features = numeric + categories
    result.metrics = scores
    result.importance = feature_importance(model, preparation.transform(rows), numeric_used, categories)
    result.tables["actual_vs_predicted"] = points
    result.tables["residuals"] = histogram(points, ["residual"])
    if result.importance is not None:
        result.tables["feature_importance"] = result.importance
    result.message = K.MODEL_SENTENCES["regressor"].format(name, target)
    free()
    return result
