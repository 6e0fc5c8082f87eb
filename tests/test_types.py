import datetime as dt

from pyspark.sql import functions as F

from autolens.operators.column_types import column_types, infer_types
from autolens.operators.frequency import distinct_rows, top_values, value_counts


def table(spark, n=120):
    day = dt.datetime(2024, 1, 1)
    return spark.range(n).select(
        F.col("id").cast("bigint").alias("order_id"),
        (F.col("id") % 3).alias("group_id"),
        (F.col("id") % 2).cast("int").alias("zero_one"),
        (F.col("id") % 2).cast("double").alias("zero_one_float"),
        F.lit(1).alias("always_one"),
        (F.col("id") * 1.5).alias("amount"),
        F.concat(F.lit("$"), F.col("id"), F.lit(",000")).alias("money"),
        F.when(F.col("id") % 10 < 2, "n/a?").otherwise(F.col("id").cast("string")).alias("mostly_number_80"),
        F.when(F.col("id") % 10 < 1, "n/a?").otherwise(F.col("id").cast("string")).alias("mostly_number_90"),
        F.lit("7").alias("same_number_text"),
        F.expr("date_format(date'2024-01-01' + int(id), 'M/d/yyyy')").alias("us"),
        F.when(F.col("id") % 10 < 3, "soon").otherwise(F.expr("cast(date'2024-01-01' + int(id) as string)")).alias("day_70"),
        F.when(F.col("id") % 10 < 3, "so-on").otherwise(F.expr("cast(date'2024-01-01' + int(id) as string)")).alias("other_70"),
        F.concat(F.lit("code"), F.col("id")).alias("code"),
        F.concat(F.lit("x" * 60), F.least(F.col("id"), F.lit(n * 92 // 100))).alias("long_text"),
        F.concat(F.lit("x"), F.least(F.col("id"), F.lit(n * 92 // 100))).alias("short_text"),
        F.when(F.col("id") % 2 == 0, "Yes").otherwise(" no").alias("flag"),
        F.when(F.col("id") % 3 == 0, "yes").when(F.col("id") % 3 == 1, "no").otherwise("on").alias("three_tokens"),
        F.lit(None).cast("string").alias("nothing"),
        F.lit(None).cast("string").alias("nothing_id"),
        F.lit(day).cast("timestamp_ntz").alias("at"),
        F.array(F.col("id")).alias("nested"),
        F.when(F.col("id") % 2 == 0, float("nan")).otherwise(2.0).alias("nan_amount"),
    )


EXPECTED = {
    "order_id": "identifier", "group_id": "numerical", "zero_one": "boolean", "zero_one_float": "numerical",
    "always_one": "boolean", "amount": "numerical", "money": "numerical", "mostly_number_80": "identifier",
    "mostly_number_90": "numerical", "same_number_text": "categorical", "us": "date", "day_70": "date",
    "other_70": "categorical", "code": "identifier", "long_text": "text", "short_text": "text", "flag": "boolean",
    "three_tokens": "categorical", "nothing": "categorical", "nothing_id": "identifier", "at": "date",
    "nested": "unsupported", "nan_amount": "numerical",
}


def test_rules(spark):
    df = table(spark).drop("mostly_number_80")
    expected = {k: v for k, v in EXPECTED.items() if k in df.columns}
    assert infer_types(df) == expected
    listed = {r["column"]: r["inferred_type"] for r in column_types(df).collect()}
    assert listed == expected


def test_approximate_types_agree(spark):
    df = table(spark).drop("mostly_number_80")
    assert infer_types(df, approx=True) == {k: v for k, v in EXPECTED.items() if k in df.columns}


def test_long_text_uses_whole_values(spark):
    prefix = "p" * 300
    df = spark.range(60).select(F.concat(F.lit(prefix), F.col("id")).alias("v"))
    row = column_types(df).first()
    assert row["nunique"] == 60 and abs(row["avg_len"] - (300 + (10 + 50 * 2) / 60)) < 1e-9
    padded = spark.range(5).select(F.concat(F.lit(" " * 300), F.col("id"), F.lit("5")).alias("v"))
    assert column_types(padded).first()["numeric_ratio"] == 1.0


def test_empty_and_edge_tables(spark):
    empty = spark.createDataFrame([], "a string, b double, user_id int")
    assert infer_types(empty) == {"a": "categorical", "b": "numerical", "user_id": "numerical"}
    assert infer_types(spark.createDataFrame([(1.0,)], "a double")) == {"a": "numerical"}


def test_scale_changes_tag(spark):
    few = spark.range(40).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    many = spark.range(60).select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    assert infer_types(few) == {"name": "categorical"}
    assert infer_types(many) == {"name": "identifier"}


def test_value_counts_and_ties(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), (None, 2.0), ("a", float("nan")), ("b", -0.0), ("c", 0.0)], "s string, x double")
    counts = value_counts(df, ["s", "x"])
    top = [(r["value"], r["count"]) for r in top_values(df, counts, 2, ["s"]).orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2)]
    numbers = {r["value"]: r["n"] for r in counts.where("column = 'x'").collect()}
    assert numbers == {"1.0": 2, "2.0": 1, None: 1, "0.0": 2}


def test_distinct_rows(spark):
    long = "z" * 500
    df = spark.createDataFrame([(1, None, long), (1, None, long), (1, 2.0, long + "!"), (None, None, None)], "a int, b double, c string")
    row = distinct_rows(df).first()
    assert (row["rows"], row["distinct_rows"], row["missing_cells"]) == (4, 3, 5)


def test_result_does_not_depend_on_partitions(spark):
    df = table(spark)
    a = {r["column"]: r.asDict() for r in column_types(df.repartition(1)).collect()}
    b = {r["column"]: r.asDict() for r in column_types(df.repartition(13)).collect()}
    assert a == b
