"""Semantic type of every column: numerical, categorical, date, boolean, text or
identifier (and `unsupported` for nested and binary columns)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.names import col, is_date_name, is_identifier_name, name_in
from ..functions.scalars import parse_date, parse_number, strip
from . import schema as S
from .frequency import family_rows, value_counts
from .local import local_table

_TOKENS = K.TRUE_TOKENS + K.FALSE_TOKENS


# Stands for "some other value" in the bit set of tokens.
_OTHER_TOKEN = 1 << 62


def _token_bit(value: Column) -> Column:
    """The bit of a boolean token; any other value has a bit beyond all tokens."""
    place = F.array_position(F.array(*[F.lit(t) for t in _TOKENS]), F.lower(strip(value))).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return F.when(place > 0, bit).when(place == 0, F.lit(_OTHER_TOKEN))


def _ratios(stats: DataFrame) -> DataFrame:
    rows = F.greatest(F.col("non_null"), F.lit(1))
    return stats.select(
        "column", "non_null", "missing", "nunique",
        (F.col("nunique") / rows).alias("unique_ratio"),
        (F.col("numeric_hits") / rows).alias("numeric_ratio"),
        (F.col("separator_hits") / rows).alias("separator_ratio"),
        (F.col("date_hits") / rows).alias("date_ratio"),
        (F.col("date_hits") / F.greatest(F.col("non_null") + F.col("missing"), F.lit(1))).alias("date_row_ratio"),
        F.coalesce(F.col("characters") / rows, F.lit(0.0)).alias("avg_len"),
        F.coalesce(
            (F.col("tokens") < F.lit(_OTHER_TOKEN)) & (F.bit_count("tokens") <= 2), F.lit(False)
        ).alias("boolean_like"),
    )


def text_statistics(counts: DataFrame, text_columns: list[str]) -> DataFrame:
    """Per-column facts for the type rules, from a frequency table.

    Each distinct value of a text column is parsed once and weighted by its count.
    """
    value, n = F.col("value"), F.col("n")
    parsed = name_in(F.col("column"), text_columns) & value.isNotNull()
    is_long = F.col("long_length").isNotNull()
    facts = counts.select(
        "column", "value", "n",
        F.coalesce(F.col("long_length"), F.length(value)).alias("length"),
        (parsed & F.when(is_long, F.col("long_numeric")).otherwise(parse_number(value).isNotNull())).alias("is_number"),
        (
            parsed & F.when(is_long, F.col("long_separator")).otherwise(strip(value).rlike(K.DATE_SEPARATOR_PATTERN))
        ).alias("is_separated"),
        (parsed & parse_date(F.when(is_long, F.col("long_probe")).otherwise(value)).isNotNull()).alias("is_date"),
        F.when(is_long, F.lit(_OTHER_TOKEN)).otherwise(_token_bit(value)).alias("token"),
    )

    def weight(hit: str) -> Column:
        return F.sum(F.when(F.col(hit), n).otherwise(0))

    return _ratios(
        facts.groupBy("column").agg(
            F.sum(F.when(value.isNotNull(), n).otherwise(0)).alias("non_null"),
            F.sum(F.when(value.isNull(), n).otherwise(0)).alias("missing"),
            F.count("value").alias("nunique"),
            weight("is_number").alias("numeric_hits"),
            weight("is_separated").alias("separator_hits"),
            weight("is_date").alias("date_hits"),
            F.sum(n * F.col("length")).alias("characters"),
            F.bit_or("token").alias("tokens"),
        )
    )


# 2^16 registers estimate distinct values to within half a percent.
SKETCH_BITS = 16


def approximate_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """The facts of `text_statistics` by scans without a shuffle of values.

    Only the number of distinct values is an estimate; it decides the tag of a text
    column near the thresholds, and nothing else.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in columns if S.is_text(fields[c])]
    other = [c for c in columns if c not in text]
    result = _scan(df, other, fields) if other or not text else None
    if text:
        part = _text_scan(df, text)
        result = part if result is None else result.unionByName(part)
    return _ratios(result)


def _text_scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """One scan for any number of text columns: a row per cell, combined in each task."""
    cells, name = family_rows(df, columns, "string")
    value = F.col("value")
    marks = cells.select(
        "v", "value", _token_bit(value).alias("token"), F.length(value).alias("chars"),
        parse_number(value).isNotNull().cast("int").alias("number"),
        strip(value).rlike(K.DATE_SEPARATOR_PATTERN).cast("int").alias("separated"),
        parse_date(value).isNotNull().cast("int").alias("date"),
    )
    zero = F.lit(0).cast("bigint")
    found = marks.groupBy("v").agg(
        F.count("value").alias("non_null"), F.count_if(value.isNull()).alias("missing"),
        F.least(F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("value", SKETCH_BITS)), zero), F.count("value")).alias("nunique"),
        *[F.coalesce(F.sum(m), zero).alias(n) for m, n in (("number", "numeric_hits"), ("separated", "separator_hits"), ("date", "date_hits"), ("chars", "characters"))],
        F.bit_or("token").alias("tokens"),
    )
    return found.select(
        name.alias("column"), "non_null", "missing", "nunique", "numeric_hits", "separator_hits", "date_hits", "characters", "tokens"
    )


def _scan(df: DataFrame, columns: list[str], fields: dict) -> DataFrame:
    marks, sums, cells = [], [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        value = F.when(~F.isnan(col(c)), col(c)) if fields[c].typeName() in ("double", "float") else col(c)
        parsed = S.is_text(fields[c])
        marks.append((value.cast("bigint") if S.is_integer(fields[c]) else value.cast("string")).alias(f"v{i}"))
        sums += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(f"v{i}", SKETCH_BITS)), F.lit(0)).alias(f"nu{i}"),
        ]
        zero = F.lit(0).cast("bigint")
        if parsed or S.is_integer(fields[c]):
            marks.append(_token_bit(value.cast("string")).alias(f"token{i}"))
            sums.append(F.bit_or(f"token{i}").alias(f"token{i}"))
        if parsed:
            marks += [
                F.length(value).alias(f"chars{i}"),
                parse_number(value).isNotNull().cast("int").alias(f"number{i}"),
                strip(value).rlike(K.DATE_SEPARATOR_PATTERN).cast("int").alias(f"separated{i}"),
                parse_date(value).isNotNull().cast("int").alias(f"date{i}"),
            ]
            sums += [F.sum(f"{m}{i}").alias(f"{m}{i}") for m in ("chars", "number", "separated", "date")]
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"n{i}").alias("non_null"),
                (F.col("rows") - F.col(f"n{i}")).alias("missing"),
                F.least(F.col(f"nu{i}"), F.col(f"n{i}")).alias("nunique"),
                *[
                    (F.coalesce(F.col(f"{m}{i}"), zero) if parsed else zero).alias(name)
                    for m, name in (("number", "numeric_hits"), ("separated", "separator_hits"), ("date", "date_hits"), ("chars", "characters"))
                ],
                (F.col(f"token{i}") if parsed or S.is_integer(fields[c]) else F.lit(_OTHER_TOKEN)).alias("tokens"),
            )
        )
    return df.select(*marks).agg(*sums).select(F.inline(F.array(*cells)))


def _rules(df: DataFrame) -> Column:
    """The ordered type rules; the first hit wins."""
    kind = {
        test.__name__: S.columns_where(df, test)
        for test in (S.is_boolean, S.is_date, S.is_numeric, S.is_supported, S.is_integer, S.is_text)
    }
    name = F.col("column")
    id_name = name_in(name, [c for c in df.columns if is_identifier_name(c)])
    date_name = name_in(name, [c for c in df.columns if is_date_name(c)])
    ratio, nunique = F.col("unique_ratio"), F.col("nunique")
    numeric = F.when(id_name & (ratio >= K.IDENTIFIER_RATIO), "identifier").otherwise("numerical")
    is_date_text = (
        (F.col("separator_ratio") >= K.DATE_SEPARATOR_RATIO) & (F.col("date_ratio") >= K.DATE_PARSE_RATIO)
    ) | (date_name & (F.col("date_ratio") >= K.DATE_NAMED_PARSE_RATIO) & (F.col("non_null") > 0))
    return (
        F.when(~name_in(name, kind["is_supported"]), "unsupported")
        .when(name_in(name, kind["is_boolean"]), "boolean")
        .when(
            F.col("boolean_like") & name_in(name, kind["is_integer"] + kind["is_text"]), "boolean"
        )
        .when(name_in(name, kind["is_date"]), "date")
        .when(name_in(name, kind["is_numeric"]), numeric)
        .when((F.col("numeric_ratio") >= K.NUMERIC_PARSE_RATIO) & (nunique > 1), numeric)
        .when(is_date_text, "date")
        .when(
            id_name
            | ((ratio >= K.IDENTIFIER_RATIO) & (nunique > K.IDENTIFIER_DISTINCT) & ~date_name),
            "identifier",
        )
        .when(
            (ratio >= K.HIGH_CARDINALITY_RATIO)
            & ((F.col("avg_len") > K.TEXT_MEAN_LENGTH) | (nunique > K.TEXT_DISTINCT)),
            "text",
        )
        .otherwise("categorical")
    )


def _typed(df: DataFrame, statistics: DataFrame) -> DataFrame:
    listing = local_table(df.sparkSession, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column string, dtype string",
    )
    zero = {
        "non_null": 0, "missing": 0, "nunique": 0, "unique_ratio": 0.0, "numeric_ratio": 0.0,
        "separator_ratio": 0.0, "date_ratio": 0.0, "date_row_ratio": 0.0, "avg_len": 0.0,
        "boolean_like": False,
    }
    # Both sides have one row per column of the table.
    stats = listing.join(F.broadcast(statistics), "column", "left").fillna(zero)
    return stats.withColumn("inferred_type", _rules(df))


def column_types(df: DataFrame, counts: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """`(position, column, dtype, inferred_type, nunique, unique_ratio, numeric_ratio, ...)`.

    `approx=True` estimates the numbers of distinct values, so that near-unique
    columns are not shuffled.
    """
    usable = S.supported_columns(df)
    if approx:
        return _typed(df, approximate_statistics(df, usable))
    if counts is None:
        counts = value_counts(df, usable)
    return _typed(df, text_statistics(counts, S.columns_where(df, S.is_text)))


def infer_with_statistics(df: DataFrame, approx: bool = False) -> tuple[dict[str, str], dict[str, dict]]:
    """Column -> semantic type, and the statistics of the counted columns.

    One row per column reaches the driver. Values are counted only where a rule
    depends on them: native dates, booleans and fractions are settled by their
    Spark type, so their near-unique values are never shuffled; whole numbers need
    only their range unless they are named like an identifier.
    """
    def needs_values(f) -> bool:
        return S.is_text(f.dataType) or (S.is_numeric(f.dataType) and is_identifier_name(f.name))

    fields = df.schema.fields
    counted = [f.name for f in fields if needs_values(f)]
    types: dict[str, str] = {}
    statistics: dict[str, dict] = {}
    for f in fields:
        if not S.is_supported(f.dataType):
            types[f.name] = "unsupported"
        elif S.is_boolean(f.dataType):
            types[f.name] = "boolean"
        elif S.is_date(f.dataType):
            types[f.name] = "date"
        else:
            types[f.name] = "numerical"
    if counted:
        part = df.select(*[col(c) for c in counted])
        for row in column_types(part, approx=approx).collect():
            statistics[row["column"]] = row.asDict()
            types[row["column"]] = row["inferred_type"]
    ranged = [f.name for f in fields if S.is_integer(f.dataType) and types[f.name] == "numerical"]
    if ranged:
        row = df.agg(
            *[F.min(col(c)).alias(f"lo{i}") for i, c in enumerate(ranged)],
            *[F.max(col(c)).alias(f"hi{i}") for i, c in enumerate(ranged)],
        ).first()
        for i, c in enumerate(ranged):
            if row[f"lo{i}"] is not None and row[f"lo{i}"] >= 0 and row[f"hi{i}"] <= 1:
                types[c] = "boolean"
    return types, statistics


def infer_types(df: DataFrame, approx: bool = False) -> dict[str, str]:
    """Column -> semantic type, on the driver (one entry per column)."""
    return infer_with_statistics(df, approx)[0]


def of_type(types: dict[str, str], *wanted: str) -> list[str]:
    """Columns of the given semantic types, in the order of the types, then of the table."""
    return [c for w in wanted for c, t in types.items() if t == w]
