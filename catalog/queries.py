"""One query per operator: `(spark, folder of the tables) -> DataFrame`.

Doubles are rounded to six digits (two for money totals), as sums depend on the
order of the rows in the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autolens.functions import scalars
from autolens.functions.names import col
from autolens.models import supervised
from autolens.models.run import chart_tables, run_ml
from autolens.models.screening import screen_targets
from autolens.operators import (
    charts, cleaning, column_types, correlation, distributions, filters, frequency, grouping, kpis,
    outliers, profile, sampling, statistics, trends,
)
from autolens.operators.staging import scratch_path
from autolens.plans import analysis, insights
from autolens.plans.dashboard import TableSpec, dashboard
from autolens.sources.read import read_table
from autolens.sources.write import write_csv, write_json, write_report

from . import dirt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NUMERIC = {
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax",
    ],
    "orders": ["o_orderkey", "o_custkey", "o_totalprice"],
}
CATEGORIES = {"lineitem": ["l_returnflag", "l_linestatus"], "orders": ["o_orderstatus", "o_orderpriority"]}
TYPED_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, _ = dirt.DIRTY[name]
    return table(spark, folder, source).selectExpr(*dirt.select_list(name))


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, dates and times as text."""
    cells = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            places = special.get(f.name, digits)
            # A thousandth of a digit more sends exact halves up in every engine.
            c = F.round(c.cast("double") + F.lit(10.0 ** -(places + 3)), places) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = scalars.iso_timestamp(c)
        cells.append(c.alias(f.name))
    return df.select(*cells)


def scratch(spark: SparkSession, extension: str = "") -> str:
    # Without a checkpoint folder the warehouse, which a cluster shares as well.
    path = scratch_path(spark) or f"{spark.conf.get('spark.sql.warehouse.dir')}/autolens-{uuid.uuid4().hex}"
    return path + extension


def types_of(df: DataFrame) -> dict[str, str]:
    return column_types.infer_types(df)


# --- grouping ---------------------------------------------------------------


@query
def topn_other(spark, folder):
    return tidy(grouping.top_groups(table(spark, folder, "part"), "p_name", "p_retailprice"), value=2)


@query
def topn_other_mean(spark, folder):
    return tidy(grouping.top_groups(table(spark, folder, "part"), "p_name", "p_retailprice", "mean"))


@query
def topn_other_mean_summed(spark, folder):
    return tidy(
        grouping.top_groups(table(spark, folder, "part"), "p_name", "p_retailprice", "mean", other="summed")
    )


@query
def topn_other_median(spark, folder):
    return tidy(grouping.top_groups(table(spark, folder, "part"), "p_name", "p_retailprice", "median"))


@query
def topn_other_nunique(spark, folder):
    return tidy(grouping.top_groups(table(spark, folder, "part"), "p_name", "p_brand", "nunique"))


@query
def topn_pie_null_group(spark, folder):
    gaps = dirty(spark, folder, "gaps").select(
        F.concat("returnflag", col("linenumber").cast("string")).alias("flag"), "quantity"
    )
    return tidy(grouping.top_groups(gaps, "flag", "quantity", top_n=8), value=2)


@query
def topn_count(spark, folder):
    return tidy(grouping.top_groups(table(spark, folder, "documents"), "source"))


@query
def topn_numeric_key(spark, folder):
    return tidy(grouping.top_groups(table(spark, folder, "lineitem"), "l_suppkey", "l_extendedprice"), value=2)


@query
def grouped_table(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(grouping.grouped_table(orders, "o_custkey", ["o_custkey", "o_totalprice", "o_orderkey"], "mean", 200), 4)


@query
def grouped_table_all(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(grouping.grouped_table(orders, "o_custkey", ["o_totalprice"], "max"), 4)


@query
def grouped_table_median(spark, folder):
    lines = table(spark, folder, "lineitem")
    return tidy(grouping.grouped_table(lines, "l_returnflag", ["l_quantity", "l_extendedprice"], "median"))


@query
def grouped_table_nunique(spark, folder):
    lines = table(spark, folder, "lineitem")
    return tidy(grouping.grouped_table(lines, "l_linenumber", ["l_suppkey", "l_quantity"], "nunique"))


@query
def geo_breakdown(spark, folder):
    # nation has 25 rows at every scale.
    customers = table(spark, folder, "customer").join(
        F.broadcast(table(spark, folder, "nation")), col("c_nationkey") == col("n_nationkey")
    )
    return tidy(grouping.geo_breakdown(customers, "n_name", "c_acctbal"), value=2)


@query
def geo_counts(spark, folder):
    return tidy(grouping.geo_breakdown(table(spark, folder, "documents"), "lang"))


@query
def geo_many_places(spark, folder):
    return tidy(grouping.geo_breakdown(table(spark, folder, "customer"), "c_name", "c_acctbal", top_n=7), value=2)


@query
def geo_many_counts(spark, folder):
    return tidy(grouping.geo_breakdown(table(spark, folder, "orders").selectExpr("cast(o_custkey % 97 as string) AS place"), "place"))


@query
def category_extremes(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(
        grouping.category_extremes(orders, CATEGORIES["orders"], "o_totalprice"),
        total=2, top_value=2, bottom_value=2,
    )


@query
def line_series(spark, folder):
    return tidy(grouping.line_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"), value=2)


@query
def line_series_strict(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(grouping.line_series(orders, "o_orderdate", "o_totalprice", grain="raw", points=120), value=2)


@query
def line_grain_day(spark, folder):
    return tidy(grouping.line_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", grain="day"), value=2)


@query
def line_grain_year(spark, folder):
    return tidy(grouping.line_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "mean", grain="year"), value=2)


@query
def line_numeric(spark, folder):
    return tidy(grouping.line_series(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity"), value=2)


@query
def top_rows(spark, folder):
    return tidy(grouping.top_k(table(spark, folder, "orders"), "o_totalprice", 25, ["o_orderkey"]))


@query
def detail_rows(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(grouping.detail_table(orders, ["o_orderkey", "o_orderdate", "missing"], ["o_orderkey"], limit=200))


# --- types ------------------------------------------------------------------


@query
def column_types_all(spark, folder):
    result = None
    for name in TYPED_TABLES:
        part = column_types.column_types(table(spark, folder, name)).select(
            F.lit(name).alias("table_name"), "column", "inferred_type", "nunique", "unique_ratio",
            "numeric_ratio", "date_ratio",
            # Engines write numbers and times differently.
            F.when(col("dtype") == "string", col("avg_len")).otherwise(0.0).alias("avg_len"),
        )
        result = part if result is None else result.unionByName(part)
    return tidy(result)


@query
def column_types_lineitem(spark, folder):
    return tidy(
        column_types.column_types(table(spark, folder, "lineitem")).select("column", "inferred_type", "nunique")
    )


@query
def column_types_approx(spark, folder):
    """Types from estimated distinct counts, which agree away from the thresholds."""
    result = None
    for name in ("orders", "events", "documents", "part", "strings"):
        df = dirty(spark, folder, name) if name == "strings" else table(spark, folder, name)
        part = column_types.column_types(df, approx=True).select(
            F.lit(name).alias("table_name"), "column", "inferred_type", "numeric_ratio", "date_ratio", "separator_ratio"
        )
        result = part if result is None else result.unionByName(part)
    return tidy(result)


@query
def column_types_dirty(spark, folder):
    strings = dirty(spark, folder, "strings")
    return tidy(
        column_types.column_types(strings).select(
            "column", "inferred_type", "nunique", "numeric_ratio", "date_ratio", "separator_ratio"
        )
    )


@query
def numeric_parse_ratio(spark, folder):
    strings = dirty(spark, folder, "strings").select("money", "percent", "parsed_80", "parsed_90", "padded")
    return tidy(column_types.column_types(strings).select("column", "numeric_ratio", "inferred_type"))


@query
def date_parse_ratio(spark, folder):
    strings = dirty(spark, folder, "strings").select("ship_iso", "ship_us", "ship_mixed", "padded")
    return tidy(column_types.column_types(strings).select("column", "date_ratio", "separator_ratio"))


@query
def bool_tokens(spark, folder):
    strings = dirty(spark, folder, "strings")
    return strings.select(
        "orderkey", col("linenumber").cast("bigint").alias("linenumber"),
        scalars.parse_boolean(col("flag")).alias("flag"),
        scalars.parse_boolean(col("padded")).alias("padded"),
    )


# --- profile ----------------------------------------------------------------


@query
def profile_counts(spark, folder):
    gaps = dirty(spark, folder, "gaps")
    return tidy(profile.profile_counts(gaps, types_of(gaps)))


@query
def profile_numeric(spark, folder):
    return tidy(profile.profile_numeric(table(spark, folder, "lineitem"), NUMERIC["lineitem"]))


@query
def profile_categorical(spark, folder):
    return tidy(profile.profile_categorical(table(spark, folder, "part"), ["p_name", "p_brand", "p_type"]))


@query
def profile_date(spark, folder):
    return tidy(profile.profile_date(table(spark, folder, "events"), ["ts"]))


@query
def profile_table(spark, folder):
    """The flagship: one row per column of `lineitem`."""
    lines = table(spark, folder, "lineitem")
    return tidy(profile.profile(lines)).drop("dtype", "note", "position")


@query
def dataset_summary(spark, folder):
    gaps = dirty(spark, folder, "gaps")
    return tidy(profile.dataset_summary(gaps, types_of(gaps)))


@query
def quality(spark, folder):
    return tidy(profile.quality(dirty(spark, folder, "repeats")))


@query
def duplicate_texts(spark, folder):
    documents = table(spark, folder, "documents").select("text", "lang", "source")
    return tidy(frequency.distinct_rows(documents))


@query
def preview_count(spark, folder):
    """As many rows as asked for, and each of them a row of the table."""
    orders = table(spark, folder, "orders")
    rows = sampling.preview(orders, 50)
    known = rows.join(orders, orders.columns, "left_semi").select(F.lit(1).alias("known"))
    return rows.select(F.lit(0).alias("known")).unionByName(known).agg(
        F.count(F.when(F.col("known") == 0, 1)).alias("rows"), F.sum("known").cast("bigint").alias("known")
    )


# --- cleaning ---------------------------------------------------------------


@query
def drop_empty(spark, folder):
    rows = cleaning.drop_empty_rows(dirty(spark, folder, "empties"))
    return tidy(cleaning.drop_columns(rows, cleaning.empty_columns(rows)))


@query
def dedup_rows(spark, folder):
    return tidy(cleaning.drop_duplicates(dirty(spark, folder, "repeats")))


@query
def trim_strings(spark, folder):
    strings = dirty(spark, folder, "strings").select("orderkey", "linenumber", "padded", "blank", "flag")
    return tidy(cleaning.trim_strings(strings))


@query
def parse_numbers(spark, folder):
    strings = dirty(spark, folder, "strings").select("orderkey", "linenumber", "money", "percent", "parsed_80", "parsed_90")
    wanted = {c: "numerical" for c in ("money", "percent", "parsed_80", "parsed_90")}
    return tidy(cleaning.convert(strings, wanted))


@query
def parse_dates(spark, folder):
    strings = dirty(spark, folder, "strings").select("orderkey", "linenumber", "ship_iso", "ship_us", "ship_mixed")
    return tidy(cleaning.convert(strings, {c: "date" for c in ("ship_iso", "ship_us", "ship_mixed")}))


@query
def impute_median(spark, folder):
    gaps = dirty(spark, folder, "gaps").select("orderkey", "linenumber", "quantity", "price")
    return tidy(cleaning.impute_medians(gaps, ["quantity", "price"]))


@query
def impute_mode(spark, folder):
    gaps = dirty(spark, folder, "gaps").select("orderkey", "linenumber", "returnflag")
    return tidy(cleaning.impute_modes(gaps, ["returnflag"]))


@query
def header_repair(spark, folder):
    """Headers with spaces, repeats in any case and a blank one; distinct values tell columns apart."""
    part = table(spark, folder, "part").toDF("  P  key", "name", "NAME", "name ", "", "size_1")
    cleaned = cleaning.clean_headers(part)
    cells = [F.struct(F.lit(c).alias("header"), F.count_distinct(col(c)).alias("n")) for c in cleaned.columns]
    return cleaned.agg(F.array(*cells).alias("h")).select(F.inline("h"))


@query
def display_values(spark, folder):
    value = F.expr("abs(value) * power(10D, event_id % 11 - 1) + 0.00071")
    events = table(spark, folder, "events").select("event_id", value.alias("v"))
    return events.select("event_id", scalars.display_number(F.col("v")).alias("number"), scalars.display_percent(F.col("v")).alias("percent"))


@query
def csv_separators(spark, folder):
    """Written with several separators and encodings, and read back without a hint."""
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "concat('é', lang) AS tag", "concat(source, ',', lang) AS pair", "n_chars"
    )
    result = None
    for separator, encoding in ((";", "UTF-8"), ("\t", "UTF-8"), ("|", "UTF-8"), (",", "UTF-8"), (";", "ISO-8859-1")):
        path = scratch(spark, ".csv")
        documents.write.option("header", True).option("sep", separator).option("encoding", encoding).csv(path)
        back, _ = read_table(spark, path)
        part = back.groupBy("tag").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("bigint").alias("chars"), F.max("pair").alias("pair")
        ).select(F.lit(f"{ord(separator)} {encoding}").alias("written"), "*")
        result = part if result is None else result.unionByName(part)
    return result


@query
def scatter_counts(spark, folder):
    """As many points as the limit allows, and each of them a row of the table."""
    lines = table(spark, folder, "lineitem")
    points = sampling.scatter_points(lines, "l_quantity", "l_extendedprice", key=["l_orderkey", "l_linenumber"], n=1500)
    known = lines.select("l_quantity", "l_extendedprice").distinct().withColumn("known", F.lit(1))
    return points.join(known, ["l_quantity", "l_extendedprice"], "left").agg(
        F.count(F.lit(1)).alias("points"), F.count("known").alias("known")
    )


@query
def fingerprint_changes(spark, folder):
    """Equal for the same rows in another order, different after a change to one of them."""
    lines = table(spark, folder, "lineitem")
    whole = sampling.fingerprint(lines).first()["fingerprint"]
    moved = sampling.fingerprint(lines.repartition(7, "l_partkey").sortWithinPartitions("l_tax")).first()["fingerprint"]
    first = F.expr("l_orderkey = 1 AND l_linenumber = 1")
    changed = sampling.fingerprint(lines.withColumn("l_tax", F.when(first, F.col("l_tax") + 1).otherwise(F.col("l_tax")))).first()["fingerprint"]
    return lines.agg(F.count(F.lit(1)).alias("n"), F.count_if(first).alias("touched")).select(
        "n", F.lit(whole == moved).alias("same"), (F.lit(whole != changed) == (F.col("touched") > 0)).alias("differs")
    )


@query
def impute_mode_long(spark, folder):
    """Every seventh text is missing; the most frequent one is longer than the digests' limit."""
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN repeat(source || ' long text ', 40) "
        "ELSE text END AS text",
    )
    return cleaning.impute_modes(documents, ["text"]).selectExpr("doc_id", "md5(text) AS digest", "length(text) AS size")


@query
def split_counts(spark, folder):
    labels = table(spark, folder, "labels").withColumn("rare", F.expr("if(doc_id < 30, 'rare', cast(toxic AS string))"))
    return supervised.split(labels, ["doc_id"], "rare").groupBy("rare", "train").agg(F.count(F.lit(1)).alias("n"))


@query
def constant_columns(spark, folder):
    return profile.constant_columns(dirty(spark, folder, "messy"))


@query
def missing_counts(spark, folder):
    return tidy(profile.missing_counts(dirty(spark, folder, "messy")))


@query
def quality_score(spark, folder):
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("gaps"),
        F.sum(F.when(col("o_orderkey") % 9 == 0, 1).otherwise(0)).alias("copies"),
    )
    score = cleaning.quality_score(
        col("n"), col("n") - col("copies"), F.lit(3), col("copies"), col("gaps"),
        F.floor(col("gaps") / 2), F.lit(1),
    )
    return counts.select("o_orderpriority", score.alias("score"))


@query
def cleaning_report(spark, folder):
    return tidy(cleaning.clean(dirty(spark, folder, "messy")).report)


@query
def cleaned_rows(spark, folder):
    return tidy(cleaning.clean(dirty(spark, folder, "messy")).table)


@query
def cleaning_actions(spark, folder):
    return cleaning.clean(dirty(spark, folder, "messy")).actions.select("column", "action")


# --- statistics -------------------------------------------------------------


@query
def numeric_analysis(spark, folder):
    return tidy(
        statistics.analyze_numerical(table(spark, folder, "lineitem"), NUMERIC["lineitem"]), sum=2, variance=3
    )


@query
def numeric_analysis_gaps(spark, folder):
    return tidy(statistics.analyze_numerical(dirty(spark, folder, "gaps"), ["quantity", "price", "k"]), sum=2, variance=3)


@query
def numeric_analysis_approx(spark, folder):
    lines = table(spark, folder, "lineitem")
    return tidy(statistics.analyze_numerical(lines, NUMERIC["lineitem"], approx=True), sum=2, variance=3)


@query
def categorical_analysis(spark, folder):
    return tidy(statistics.categorical_summary(table(spark, folder, "orders"), CATEGORIES["orders"]))


@query
def categorical_distribution(spark, folder):
    return tidy(statistics.categorical_distribution(table(spark, folder, "part"), ["p_name", "p_brand"]))


@query
def date_analysis(spark, folder):
    return tidy(statistics.analyze_dates(table(spark, folder, "orders"), ["o_orderdate"]))


@query
def date_counts(spark, folder):
    return tidy(statistics.date_counts(table(spark, folder, "orders"), ["o_orderdate"]))


@query
def outliers_iqr(spark, folder):
    return tidy(outliers.outlier_counts(table(spark, folder, "events"), ["value", "user_id"]))


@query
def outliers_z(spark, folder):
    return tidy(outliers.outlier_counts(dirty(spark, folder, "two_values"), ["rare", "constant"]))


@query
def outlier_flags(spark, folder):
    rows = dirty(spark, folder, "two_values").select("orderkey", "linenumber", "rare")
    return tidy(outliers.flag_outliers(rows, ["rare"]))


@query
def correlations(spark, folder):
    return tidy(correlation.correlations(table(spark, folder, "lineitem"), NUMERIC["lineitem"]))


@query
def correlations_gaps(spark, folder):
    gaps = dirty(spark, folder, "gaps")
    return tidy(correlation.correlations(gaps, ["orderkey", "linenumber", "quantity", "price", "k"]))


@query
def correlations_wide(spark, folder):
    """45 columns, so 990 pairs."""
    lines = table(spark, folder, "lineitem").selectExpr(*[f"cast((l_orderkey * {i + 3} + l_partkey) % {i + 11} AS double) AS c{i}" for i in range(45)])
    return tidy(correlation.pair_correlations(lines, lines.columns), 3)


@query
def correlations_blocked(spark, folder):
    """30 columns with gaps of their own, so 435 pairs by matrix products."""
    lines = table(spark, folder, "lineitem").selectExpr(*[
        f"CASE WHEN (l_orderkey + l_linenumber) % {i + 3} <> 1 THEN l_quantity * {i % 5} + (l_partkey * {i + 2}) % {i + 17} END AS c{i}"
        for i in range(30)
    ])
    return tidy(correlation.pair_correlations(lines, lines.columns), 4)


@query
def corr_heatmap(spark, folder):
    return tidy(correlation.correlation_heatmap(table(spark, folder, "lineitem"), NUMERIC["lineitem"]))


@query
def monthly_trend(spark, folder):
    return tidy(trends.trend_points(table(spark, folder, "orders"), "o_orderdate", NUMERIC["orders"]), value=2)


@query
def best_worst_month(spark, folder):
    return tidy(
        trends.trend_summary(table(spark, folder, "orders"), "o_orderdate", NUMERIC["orders"]),
        best_value=2, worst_value=2,
    )


@query
def business_metrics(spark, folder):
    return tidy(statistics.business_metrics(table(spark, folder, "lineitem"), NUMERIC["lineitem"]), sum=2)


@query
def important_columns(spark, folder):
    lines = table(spark, folder, "lineitem")
    return tidy(
        statistics.important_columns(
            statistics.moments(lines, NUMERIC["lineitem"]),
            statistics.categorical_summary(lines, CATEGORIES["lineitem"]),
            ["l_shipdate"], [], NUMERIC["lineitem"], CATEGORIES["lineitem"], k=10, k_dates=5,
        )
    )


# --- KPIs, filters, dashboard -------------------------------------------------

ORDER_KPIS = [
    kpis.Kpi("rows", None, "count"),
    kpis.Kpi("customers", "o_custkey", "nunique"),
    kpis.Kpi("priorities", "o_orderpriority", "nunique"),
    kpis.Kpi("statuses", "o_orderstatus", "count"),
    kpis.Kpi("total", "o_totalprice", "sum"),
    kpis.Kpi("average", "o_totalprice", "mean"),
    kpis.Kpi("middle", "o_totalprice", "median"),
    kpis.Kpi("smallest", "o_totalprice", "min"),
    kpis.Kpi("largest", "o_totalprice", "max"),
    kpis.Kpi("unknown", "nowhere", "sum"),
]


@query
def order_kpis(spark, folder):
    result = kpis.compute_kpis(table(spark, folder, "orders"), ORDER_KPIS)
    return tidy(result.select("name", "aggregation", "value"), 2)


@query
def default_kpis(spark, folder):
    orders = table(spark, folder, "orders")
    result = kpis.compute_kpis(orders, kpis.default_kpis(types_of(orders)))
    return tidy(result.select("name", "aggregation", "value"), 2)


@query
def filter_options(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(filters.filter_options(orders, ["o_orderdate", "o_orderpriority", "o_custkey"]))


@query
def filter_options_long(spark, folder):
    """All texts as options, each also twice over, so that most are long."""
    documents = table(spark, folder, "documents").selectExpr("concat(text, ' ', text) AS text")
    options = filters.filter_options(documents, ["text"], limit=40)
    return options.selectExpr("cast(rank = 1 AS int) AS first", "length(value) AS size", "count").where("count > 1").select("size", "count")


def _long_keys(spark, folder):
    """Long strings that agree in their beginning, each equally often."""
    body = F.concat(F.repeat(F.lit("the same words "), 20), "source", F.lit(" "), "lang", F.lit(" "), F.col("doc_id") % 50)
    return table(spark, folder, "documents").select(body.alias("body")).distinct()


@query
def mode_long_ties(spark, folder):
    keys = _long_keys(spark, folder)
    return frequency.modes(keys, frequency.value_counts(keys, ["body"]))


@query
def filter_options_ties(spark, folder):
    """Of equally frequent strings, long and short, the first in order are offered."""
    keys = _long_keys(spark, folder)
    mixed = keys.unionByName(keys.select(F.substring("body", 290, 200).alias("body"))).unionByName(keys.select(F.substring("body", 1, 200).alias("body")).distinct())
    options = filters.filter_options(mixed, ["body"], limit=25)
    return options.select("rank", "value", "count")


@query
def mode_float(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_discount").cast("float").alias("discount"), F.col("l_tax").cast("float").alias("tax"))
    return frequency.top_values(lines, frequency.value_counts(lines, lines.columns), 20)


@query
def filter_options_apply(spark, folder):
    """The rows that the first offered option selects are as many as it says."""
    documents = table(spark, folder, "documents").selectExpr("doc_id", "text")
    option = filters.filter_options(documents, ["text"], limit=1).first()
    return filters.apply_filters(documents, {"text": [option["value"]]}).selectExpr("count(*) AS n")


@query
def filter_float(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_discount AS float) AS discount")
    return filters.apply_filters(lines, {"discount": [0.1, "0.05"]}).select("l_orderkey", "l_linenumber")


@query
def filter_decimal(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_discount AS decimal(10, 2)) AS discount")
    return filters.apply_filters(lines, {"discount": [0.1, 0.054]}).select("l_orderkey", "l_linenumber")


@query
def filter_range(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(filters.apply_filters(orders, {"o_orderdate": ("1997-01-01", "1997-06-30")}))


@query
def filter_in(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(filters.apply_filters(orders, {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": []}))


@query
def filter_eq(spark, folder):
    lines = table(spark, folder, "lineitem")
    return tidy(filters.apply_filters(lines, {"l_quantity": 5, "l_returnflag": "R", "nowhere": 1}))


@query
def filtered_dashboard(spark, folder):
    orders = table(spark, folder, "orders")
    board = dashboard(
        orders, types_of(orders),
        filters={"o_orderdate": ("1996-01-01", None), "o_orderstatus": ["F", "O"]},
        kpis=ORDER_KPIS[:9],
        charts=[charts.ChartSpec("bar", "o_orderpriority", "o_totalprice")],
        tables=[TableSpec(("o_totalprice",), "o_orderstatus", "mean")],
    )
    values = board.kpis.select(F.concat(F.lit("kpi:"), "name").alias("item"), "value")
    bars = board.charts[0].select(F.concat(F.lit("bar:"), "o_orderpriority").alias("item"), "value")
    means = board.tables[0].select(
        F.concat(F.lit("mean:"), "o_orderstatus").alias("item"), col("o_totalprice").alias("value")
    )
    return tidy(values.unionByName(bars).unionByName(means), 2)


@query
def eligibility(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(kpis.eligibility(orders, types_of(orders))).drop("position")


@query
def target_screen(spark, folder):
    documents = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return screen_targets(documents, types_of(documents)).select("column", "role", "eligible", "preferred")


# --- chart datasets -----------------------------------------------------------


@query
def histogram(spark, folder):
    return tidy(distributions.histogram(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"]))


@query
def box_stats(spark, folder):
    return tidy(distributions.box_statistics(table(spark, folder, "events"), "value", "event_type"))


@query
def box_stats_top_groups(spark, folder):
    return tidy(distributions.box_statistics(table(spark, folder, "events"), "value", "props"))


@query
def chart_datasets(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(charts.chart_datasets(orders, types_of(orders), sections=["aggregates"])["aggregates"], 2)


@query
def chart_boxes(spark, folder):
    lines = table(spark, folder, "lineitem")
    return tidy(distributions.box_tables(lines, ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag"))


@query
def chart_scatter(spark, folder):
    """All pairs of metrics over one sample of rows; each point is a row of the table."""
    customers = table(spark, folder, "customer")
    points = charts.scatter_pairs(customers, ["c_acctbal", "c_nationkey", "c_custkey"], ["c_custkey"])
    known = customers.selectExpr("cast(c_custkey AS double) AS y", "c_acctbal AS x", "1 AS known")
    return points.join(known, ["x", "y"], "left").groupBy("x_metric", "y_metric").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.expr("x_metric = 'c_acctbal' AND y_metric = 'c_custkey'"), F.col("known"))).alias("known")
    )


@query
def chart_box(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(
        charts.chart_data(orders, charts.ChartSpec("box", "o_orderstatus", "o_totalprice"))
    )


@query
def chart_donut(spark, folder):
    spec = charts.ChartSpec("donut", "p_brand", "p_retailprice")
    return tidy(charts.chart_data(table(spark, folder, "part"), spec), value=2)


@query
def chart_area(spark, folder):
    spec = charts.ChartSpec("area", "l_shipdate", "l_quantity")
    return tidy(charts.chart_data(table(spark, folder, "lineitem"), spec), value=2)


@query
def scatter_sample(spark, folder):
    return sampling.scatter_points(
        table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag",
        ["l_orderkey", "l_linenumber", "l_partkey"],
    )


@query
def scatter_pairs(spark, folder):
    """`part` has fewer rows than a plot takes at the scale the SQL runs at."""
    return tidy(sampling.scatter_points(table(spark, folder, "part"), "p_size", "p_retailprice", "p_brand", ["p_partkey"]))


# --- insights -----------------------------------------------------------------


def _values(facts: DataFrame, digits: int = 6) -> DataFrame:
    return tidy(facts.select("type", "subject", "value"), digits)


@query
def insight_dataset(spark, folder):
    gaps = dirty(spark, folder, "gaps")
    types = types_of(gaps)
    return _values(insights.dataset_insights(profile.dataset_summary(gaps, types), types))


@query
def insight_category(spark, folder):
    orders = table(spark, folder, "orders")
    return _values(
        insights.category_insights(
            statistics.categorical_summary(orders, CATEGORIES["orders"]),
            grouping.category_extremes(orders, CATEGORIES["orders"], "o_totalprice"),
            "o_totalprice", CATEGORIES["orders"],
        ),
        2,
    )


@query
def insight_numeric(spark, folder):
    stats = statistics.analyze_numerical(table(spark, folder, "events"), ["user_id", "value"])
    return _values(insights.numerical_insights(stats, ["user_id", "value"]), 2)


@query
def insight_correlation(spark, folder):
    pairs = correlation.correlations(table(spark, folder, "lineitem"), NUMERIC["lineitem"])
    return _values(insights.correlation_insights(pairs), 4)


@query
def insight_trend(spark, folder):
    summary = trends.trend_summary(table(spark, folder, "orders"), "o_orderdate", NUMERIC["orders"])
    return _values(insights.trend_insights(summary, NUMERIC["orders"]), 2)


@query
def insight_outlier(spark, folder):
    found = outliers.outlier_counts(table(spark, folder, "events"), ["user_id", "value"])
    return _values(insights.outlier_insights(found, ["user_id", "value"]))


@query
def insight_package(spark, folder):
    orders = table(spark, folder, "orders")
    facts = analysis.insights(orders, types_of(orders))
    return tidy(facts.select("seq", "type", "subject", "value"), 2)


@query
def insight_messages(spark, folder):
    events = table(spark, folder, "events")
    return analysis.insights(events, types_of(events)).select("seq", "type", "message")


# --- series and models ----------------------------------------------------------


@query
def month_resample(spark, folder):
    series = trends.monthly_series(dirty(spark, folder, "month_gaps"), "orderdate", "totalprice")
    return tidy(series, value=2)


@query
def forecast_linear(spark, folder):
    return tidy(trends.forecast_linear(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"), 2)


@query
def forecast_by_group(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(trends.forecast_linear(orders, "o_orderdate", "o_totalprice", ["o_orderpriority"]), 2)


@query
def forecast_errors(spark, folder):
    orders = table(spark, folder, "orders")
    return tidy(trends.forecast_metrics(orders, "o_orderdate", "o_totalprice", ["o_orderstatus"]), 2, r2=6)


def _model(spark, df, task, **options):
    result = run_ml(df, types_of(df), task, **options)
    if not result.used:
        raise RuntimeError(result.message)
    return result


def _labelled(spark, folder):
    return table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")


@query
def classify(spark, folder):
    result = _model(spark, _labelled(spark, folder), "classification", target="quality")
    return result.metric_table()


@query
def confusion_matrix(spark, folder):
    orders = table(spark, folder, "orders")
    result = _model(spark, orders, "classification", target="o_orderstatus")
    return chart_tables(result)["confusion_matrix"]


@query
def regress(spark, folder):
    return _model(spark, table(spark, folder, "part"), "regression", target="p_retailprice").metric_table()


@query
def importance(spark, folder):
    from autolens.models.supervised import regress as train

    lines = table(spark, folder, "lineitem")
    return train(lines, types_of(lines), "l_extendedprice", models=["random_forest"]).importance


@query
def kmeans(spark, folder):
    return chart_tables(_model(spark, table(spark, folder, "part"), "clustering"))["cluster_summary"]


@query
def iforest(spark, folder):
    return chart_tables(_model(spark, table(spark, folder, "lineitem"), "anomaly"))["scores"]


@query
def regress_line(spark, folder):
    """One feature, ordinary least squares: errors on the test rows, the plotted points, the stated fact."""
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS line", "l_quantity AS size", "l_extendedprice AS price")
    types = {"id": "identifier", "line": "identifier", "size": "numerical", "price": "numerical"}
    result = supervised.regress(lines, types, "price", models=["linear_regression"], key=["id", "line"])
    fact = insights.model_insights(result).where("subject = 'r2'").first()["value"]
    shown = chart_tables(result)["actual_vs_predicted"].agg(F.count(F.lit(1)).alias("points"))
    found = result.metrics
    return tidy(shown.select(
        F.lit(found["mae"]).alias("mae"), F.lit(found["rmse"]).alias("rmse"), F.lit(found["r2"]).alias("r2"),
        F.lit(fact).alias("fact_r2"), "points",
    ), 3)


@query
def class_test_sizes(spark, folder):
    """Test rows of each class in the matrix, whatever the model says; a class of few rows is none."""
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey AS id", "o_totalprice AS price", "CASE WHEN o_orderkey < 5 THEN 'rare' ELSE o_orderstatus END AS class"
    )
    types = {"id": "identifier", "price": "numerical", "class": "categorical"}
    result = supervised.classify(orders, types, "class", models=["decision_tree"], key=["id"])
    return chart_tables(result)["confusion_matrix"].groupBy("actual").agg(F.sum("count").alias("n"))


@query
def importance_first(spark, folder):
    """A class that one feature tells: it has the whole importance."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS id", "l_linenumber AS step", "l_quantity AS size", "l_tax AS tax", "l_discount AS discount",
        "CASE WHEN l_linenumber > 3 THEN 'late' ELSE 'early' END AS class",
    )
    types = {"id": "identifier", **dict.fromkeys(["step", "size", "tax", "discount"], "numerical"), "class": "categorical"}
    result = supervised.classify(lines, types, "class", models=["decision_tree"])
    return tidy(result.importance)


def _sized_parts(spark, folder):
    parts = table(spark, folder, "part").selectExpr("p_size AS size", "p_retailprice AS price")
    return parts, {"size": "numerical", "price": "numerical"}


@query
def cluster_totals(spark, folder):
    """Sizes and means of the clusters add up to those of all rows."""
    charts = chart_tables(run_ml(*_sized_parts(spark, folder), "clustering"))
    both = charts["cluster_summary"].join(F.broadcast(charts["cluster_distribution"]), "cluster")  # one row per cluster
    n = F.sum("count")
    return tidy(both.agg(
        n.alias("n"), (F.sum(F.col("size") * F.col("count")) / n).alias("size"),
        (F.sum(F.col("price") * F.col("count")) / n).alias("price"),
    ), 4)


@query
def anomaly_totals(spark, folder):
    """Every row is scored once, between 0 and 1, and flagged beyond one half."""
    rows = chart_tables(run_ml(*_sized_parts(spark, folder), "anomaly"))["scores"]
    return tidy(rows.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("score").between(0, 1), 1)).alias("in_range"),
        F.count(F.when(F.col("anomaly") == (F.col("score") > 0.5), 1)).alias("consistent"),
        F.sum("size").alias("size"), F.sum("price").alias("price"),
    ), 2)


@query
def model_refusals(spark, folder):
    """A task that the table does not serve gives a reason and no result."""
    orders = table(spark, folder, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "length(o_orderpriority) > 0 AS given")
    types = {"id": "identifier", "status": "categorical", "given": "boolean"}
    rows = None
    for task in ("classification", "clustering", "anomaly", "forecasting", "other"):
        result = run_ml(orders, types, task, "given" if task == "classification" else None)
        one = orders.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(task).alias("task"), F.lit(result.used).alias("used"), F.lit(len(result.warnings)).cast("bigint").alias("warnings"),
            F.lit(len(chart_tables(result))).cast("bigint").alias("charts"), "rows",
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query
def anomaly_rows_kept(spark, folder):
    """Every flagged row and as many others as a plot takes."""
    lines = table(spark, folder, "lineitem").withColumn("flagged", F.col("l_quantity") >= 45)
    kept = sampling.anomaly_plot_rows(lines, "flagged")
    return tidy(kept.groupBy("flagged").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("flagged"), F.col("l_extendedprice"))).alias("price"),
    ), 2)


# --- values -----------------------------------------------------------------------


@query
def shortened_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", scalars.shorten(F.col("text"), 80).alias("text"))


@query
def priority_bands(spark, folder):
    """Bands from critical to low, with gaps, zeros and both sides of each limit."""
    events = table(spark, folder, "events")
    priority = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 101 - F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(0.0))
    banded = events.select("event_type", scalars.priority_band(priority).alias("band"))
    return banded.groupBy("event_type", "band").agg(F.count(F.lit(1)).alias("n"))


@query
def nan_values(spark, folder):
    """NaN is a gap; infinities too, where a number is computed with."""
    events = table(spark, folder, "events")
    value = (
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    cleaned = scalars.clean_value("value", T.DoubleType(), value)
    return tidy(events.select("event_id", cleaned.isNull().alias("gap"), scalars.finite(value).alias("value")))


# --- sources and sinks ------------------------------------------------------------


@query
def read_facts(spark, folder):
    """What the reader says of a file, beside what is in it."""
    path = scratch(spark, ".csv")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders.write.option("header", True).option("sep", ";").csv(path)
    back, info = read_table(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.lit(info.columns).cast("bigint").alias("n_columns"), F.lit(info.separator).alias("separator"),
        F.lit(info.encoding).alias("encoding"), F.lit(len(info.warnings)).cast("bigint").alias("n_warnings"),
        F.sum("o_custkey").cast("bigint").alias("custkeys"),
    )



@query
def fingerprint(spark, folder):
    return sampling.fingerprint(table(spark, folder, "orders"))


@query
def csv_round_trip(spark, folder):
    path = scratch(spark, ".csv")
    write_csv(table(spark, folder, "orders"), path)
    df, _ = read_table(spark, path)
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("o_custkey").alias("custkeys"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min("o_orderpriority").alias("first_priority"),
    )


@query
def csv_quoted(spark, folder):
    """All texts, with quotes, separators and line breaks, written and read back."""
    text = F.concat(F.lit('"quoted", '), "text", F.lit(' ;"\r\n"end'))
    documents = table(spark, folder, "documents").select("doc_id", text.alias("text"), "lang")
    path = scratch(spark, ".csv")
    write_csv(documents, path)
    back, _ = read_table(spark, path)
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang")


@query
def csv_header_orders(spark, folder):
    """Files of one folder with their columns in other orders, one of them without a column."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    path = scratch(spark, ".csv")
    for part, columns in enumerate((orders.columns, orders.columns[::-1], orders.columns[1:3] + orders.columns[:1])):
        orders.where(F.col("o_orderkey") % 3 == part).select(*columns).write.mode("append").option("header", True).csv(path)
    back, _ = read_table(spark, path)
    return back.select(*orders.columns)


@query
def csv_row_widths(spark, folder):
    """Rows with a cell too many or too few are read and counted."""
    whole = F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus")
    line = F.when(F.col("o_orderkey") % 7 == 0, F.concat(whole, F.lit(",more,cells")))
    line = line.when(F.col("o_orderkey") % 11 == 0, F.concat_ws(",", "o_orderkey", "o_custkey")).otherwise(whole)
    path = scratch(spark, ".csv")
    rows = table(spark, folder, "orders").select(line.alias("o_orderkey,o_custkey,o_orderstatus"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    back, info = read_table(spark, path)
    return back.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_custkey").cast("bigint").alias("custkeys"),
        F.lit(info.long_rows).cast("bigint").alias("long_rows"), F.lit(info.short_rows).cast("bigint").alias("short_rows"),
        F.lit(len(info.warnings)).cast("bigint").alias("warnings"),
    )


@query
def json_round_trip(spark, folder):
    path = scratch(spark, ".json")
    write_json(table(spark, folder, "events"), path)
    df, _ = read_table(spark, path)
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("value"), 2).alias("total"),
        F.min("ts").alias("first_ts"),
    )


@query
def report_sections(spark, folder):
    orders = table(spark, folder, "orders")
    path = scratch(spark)
    sections = analysis.analyze(orders, types_of(orders))
    write_report(sections, path, "parquet")
    result = None
    for name in sections:
        part = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("section"), "rows"
        )
        result = part if result is None else result.unionByName(part)
    return result
