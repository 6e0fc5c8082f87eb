"""The SQL each query is checked against, written from the definition of the
operator and independent of the library's expressions."""

from __future__ import annotations

from autolens.functions import constants as K

from .dirt import DIRTY, as_sql
from .queries import CATEGORIES, NUMERIC, TYPED_TABLES

ORACLES: dict[str, str] = {}


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def r(expression: str, digits: int = 6) -> str:
    """Rounded like `tidy`: a thousandth of a digit is added, so that exact halves go up."""
    return f"ROUND({expression} + 1e-{digits + 3}, {digits})"


# --- grouping ---------------------------------------------------------------


def topn(source: str, x: str, aggregate: str, n: int, rest: str, digits: int) -> str:
    """Top groups by value; `rest` is the FROM-less aggregate of the other rows as SQL."""
    return f"""
    WITH base AS (SELECT * FROM ({source})),
    g AS (SELECT {x}, {aggregate} AS value FROM base GROUP BY {x}),
    ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, {x} NULLS FIRST) AS rn FROM g),
    o AS ({rest})
    SELECT {x}, {r('value', digits)} AS value, FALSE AS is_other FROM ranked WHERE rn <= {n}
    UNION ALL SELECT 'Other', {r('value', digits)}, TRUE FROM o WHERE value IS NOT NULL AND value <> 0
    """


SUMMED = "SELECT SUM(value) AS value FROM ranked WHERE rn > {n}"
POOLED = (
    "SELECT {agg} AS value FROM base JOIN ranked ON base.{x} IS NOT DISTINCT FROM ranked.{x} WHERE rn > {n}"
)

PART = "SELECT p_name, p_brand, p_retailprice FROM part"
ORACLES["topn_other"] = topn(PART, "p_name", "SUM(p_retailprice)", 30, SUMMED.format(n=30), 2)
ORACLES["topn_other_mean"] = topn(
    PART, "p_name", "AVG(p_retailprice)", 30, POOLED.format(agg="AVG(p_retailprice)", x="p_name", n=30), 6
)
ORACLES["topn_other_mean_summed"] = topn(PART, "p_name", "AVG(p_retailprice)", 30, SUMMED.format(n=30), 6)
ORACLES["topn_other_median"] = topn(
    PART, "p_name", "QUANTILE_CONT(p_retailprice, 0.5)", 30,
    POOLED.format(agg="QUANTILE_CONT(p_retailprice, 0.5)", x="p_name", n=30), 6,
)
ORACLES["topn_other_nunique"] = topn(
    PART, "p_name", "COUNT(DISTINCT p_brand)", 30,
    POOLED.format(agg="COUNT(DISTINCT p_brand)", x="p_name", n=30), 0,
).replace("ROUND(value + 1e-3, 0)", "value")
ORACLES["topn_pie_null_group"] = topn(
    f"SELECT returnflag || CAST(linenumber AS VARCHAR) AS flag, quantity FROM ({as_sql('gaps')}) WHERE quantity IS NOT NULL",
    "flag", "SUM(quantity)", 8, SUMMED.format(n=8), 2,
)
ORACLES["topn_count"] = topn(
    "SELECT source FROM documents", "source", "COUNT(*)", 30, SUMMED.format(n=30), 0
).replace("ROUND(value + 1e-3, 0)", "CAST(value AS BIGINT)")
ORACLES["topn_numeric_key"] = topn(
    "SELECT l_suppkey, l_extendedprice FROM lineitem", "l_suppkey", "SUM(l_extendedprice)", 30, SUMMED.format(n=30), 2
).replace("SELECT 'Other', ", "SELECT CAST(NULL AS BIGINT), ")
ORACLES["grouped_table"] = """
    SELECT o_custkey, ROUND(AVG(o_totalprice) + 1e-7, 4) AS o_totalprice, ROUND(AVG(o_orderkey) + 1e-7, 4) AS o_orderkey
    FROM orders GROUP BY o_custkey ORDER BY o_custkey LIMIT 200
"""
ORACLES["grouped_table_median"] = """
    SELECT l_returnflag, ROUND(QUANTILE_CONT(l_quantity, 0.5) + 1e-9, 6) AS l_quantity,
           ROUND(QUANTILE_CONT(l_extendedprice, 0.5) + 1e-9, 6) AS l_extendedprice
    FROM lineitem GROUP BY l_returnflag ORDER BY 1 LIMIT 200
"""
ORACLES["grouped_table_nunique"] = """
    SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, COUNT(DISTINCT l_suppkey) AS l_suppkey,
           COUNT(DISTINCT l_quantity) AS l_quantity
    FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 200
"""
ORACLES["grouped_table_all"] = """
    SELECT o_custkey, ROUND(MAX(o_totalprice) + 1e-7, 4) AS o_totalprice FROM orders GROUP BY o_custkey
"""
ORACLES["geo_breakdown"] = topn(
    "SELECT n_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey", "n_name", "SUM(c_acctbal)", 30,
    SUMMED.format(n=30), 2,
)
ORACLES["geo_counts"] = topn(
    "SELECT lang FROM documents WHERE lang IS NOT NULL", "lang", "COUNT(*)", 30, SUMMED.format(n=30), 0
).replace("ROUND(value + 1e-3, 0)", "CAST(value AS BIGINT)")
ORACLES["geo_many_places"] = topn(
    "SELECT c_name, c_acctbal FROM customer", "c_name", "SUM(c_acctbal)", 7, SUMMED.format(n=7), 2
)
ORACLES["geo_many_counts"] = topn(
    "SELECT CAST(o_custkey % 97 AS VARCHAR) AS place FROM orders", "place", "COUNT(*)", 30, SUMMED.format(n=30), 0
).replace("ROUND(value + 1e-3, 0)", "CAST(value AS BIGINT)")
ORACLES["line_grain_day"] = """
    SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS o_orderdate, ROUND(SUM(o_totalprice) + 1e-5, 2) AS value
    FROM orders GROUP BY 1
"""
ORACLES["line_grain_year"] = """
    SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS o_orderdate, ROUND(AVG(o_totalprice) + 1e-5, 2) AS value
    FROM orders GROUP BY 1
"""
ORACLES["line_numeric"] = "SELECT l_suppkey, ROUND(SUM(l_quantity) + 1e-5, 2) AS value FROM lineitem GROUP BY 1"
LONG_TEXTS = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN repeat(source || ' long text ', 40)
                         ELSE text END AS text FROM documents)"""
ORACLES["impute_mode_long"] = f"""
    WITH t AS {LONG_TEXTS},
    m AS (SELECT text FROM t WHERE text IS NOT NULL GROUP BY text ORDER BY COUNT(*) DESC,
          CASE WHEN length(text) > 256 THEN sha256(text) ELSE text END LIMIT 1)
    SELECT doc_id, md5(coalesce(t.text, m.text)) AS digest, length(coalesce(t.text, m.text)) AS size FROM t, m
"""
HASH = "CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"
ORACLES["split_counts"] = f"""
    WITH t AS (SELECT CASE WHEN doc_id < 30 THEN 'rare' ELSE CAST(toxic AS VARCHAR) END AS rare, {HASH} AS h FROM labels),
    e AS (SELECT rare, MIN(h) AS low, MAX(h) AS high FROM t GROUP BY rare)
    SELECT rare, NOT ((h < 0.25 OR h <= low) AND h < high) AS train, COUNT(*) AS n FROM t JOIN e USING (rare) GROUP BY 1, 2
"""
ORACLES["filter_options_long"] = """
    SELECT length(text) AS size, n AS count FROM (
        SELECT text || ' ' || text AS text, COUNT(*) AS n FROM documents GROUP BY 1
        ORDER BY n DESC, CASE WHEN length(text || ' ' || text) > 256 THEN sha256(text || ' ' || text) ELSE text || ' ' || text END LIMIT 40)
    WHERE n > 1
"""
WIDE = range(45)
ORACLES["correlations_wide"] = f"""
    WITH w AS (SELECT {", ".join(f"CAST((l_orderkey * {i + 3} + l_partkey) % {i + 11} AS DOUBLE) AS c{i}" for i in WIDE)} FROM lineitem),
    p AS (SELECT unnest([{", ".join(f"{{'a': 'c{i}', 'b': 'c{j}', 'r': corr(c{i}, c{j})}}" for i in WIDE for j in WIDE if i < j)}]) AS p FROM w)
    SELECT p.a AS column_1, p.b AS column_2, {r('p.r', 3)} AS r FROM p
"""
ORACLES["anomaly_rows_kept"] = f"""
    SELECT l_quantity >= 45 AS flagged,
           CASE WHEN l_quantity >= 45 THEN COUNT(*) ELSE LEAST(COUNT(*), {K.ANOMALY_PLOT_NORMALS}) END AS n,
           CASE WHEN l_quantity >= 45 THEN {r('SUM(l_extendedprice)', 2)} END AS price
    FROM (SELECT CASE WHEN l_quantity >= 45 THEN 45 ELSE 0 END AS l_quantity, l_extendedprice FROM lineitem) GROUP BY l_quantity
"""
ORACLES["shortened_texts"] = """
    SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS text FROM documents
"""
ORACLES["priority_bands"] = """
    WITH p AS (SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN event_id % 101 - CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END END AS given
               FROM events),
    q AS (SELECT event_type, CASE WHEN given IS NULL OR given = 0 THEN 50 ELSE given END AS p FROM p)
    SELECT event_type, CASE WHEN p >= 90 THEN 'critical' WHEN p >= 70 THEN 'important' WHEN p >= 50 THEN 'supporting'
                            WHEN p >= 30 THEN 'optional' ELSE 'low' END AS band, COUNT(*) AS n
    FROM q GROUP BY 1, 2
"""
ORACLES["nan_values"] = f"""
    SELECT event_id, event_id % 5 = 0 OR value IS NULL AND event_id % 7 <> 0 AS gap,
           CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN {r('value', 6)} END AS value
    FROM events
"""
ORACLES["read_facts"] = """
    SELECT COUNT(*) AS n, CAST(3 AS BIGINT) AS n_columns, ';' AS separator, 'UTF-8' AS encoding, CAST(0 AS BIGINT) AS n_warnings,
           CAST(SUM(o_custkey) AS BIGINT) AS custkeys
    FROM orders
"""
BLOCKED = range(30)
ORACLES["correlations_blocked"] = f"""
    WITH w AS (SELECT {", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % {i + 3} <> 1 THEN l_quantity * {i % 5} + (l_partkey * {i + 2}) % {i + 17} END AS c{i}" for i in BLOCKED)} FROM lineitem),
    p AS (SELECT unnest([{", ".join(f"{{'a': 'c{i}', 'b': 'c{j}', 'r': corr(c{i}, c{j})}}" for i in BLOCKED for j in BLOCKED if i < j)}]) AS p FROM w)
    SELECT p.a AS column_1, p.b AS column_2, {r('p.r', 4)} AS r FROM p
"""
ORACLES["header_repair"] = union([
    f"SELECT '{name}' AS header, COUNT(DISTINCT {c}) AS n FROM part"
    for name, c in (("P key", "p_partkey"), ("name", "p_name"), ("NAME_1", "p_brand"), ("name_2", "p_type"),
                    ("column", "p_size"), ("size_1", "p_retailprice"))
])
ORACLES["display_values"] = """
    WITH e AS (SELECT event_id, abs(value) * power(10, event_id % 11 - 1) + 0.00071 AS v FROM events)
    SELECT event_id,
           CASE WHEN v >= 1e9 THEN printf('%.2fB', v / 1e9) WHEN v >= 1e6 THEN printf('%.2fM', v / 1e6)
                WHEN v >= 1e3 THEN printf('%.2fK', v / 1e3) WHEN v >= 100 THEN printf('%.0f', v)
                ELSE printf('%.2f', v) END AS number,
           printf('%.1f%%', v) AS percent
    FROM e
"""
ORACLES["csv_separators"] = union([
    f"""SELECT '{written}' AS written, 'é' || lang AS tag, COUNT(*) AS n, CAST(SUM(n_chars) AS BIGINT) AS chars,
               MAX(source || ',' || lang) AS pair FROM documents GROUP BY lang"""
    for written in ("59 UTF-8", "9 UTF-8", "124 UTF-8", "44 UTF-8", "59 ISO-8859-1")
])
ORACLES["scatter_counts"] = """
    SELECT LEAST(1500, COUNT(*)) AS points, LEAST(1500, COUNT(*)) AS known FROM lineitem
    WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
"""
ORACLES["fingerprint_changes"] = "SELECT COUNT(*) AS n, TRUE AS same, TRUE AS differs FROM lineitem"
LONG_KEYS = """
    SELECT DISTINCT repeat('the same words ', 20) || source || ' ' || lang || ' ' || CAST(doc_id % 50 AS VARCHAR) AS body FROM documents
"""
ORACLES["mode_long_ties"] = f"SELECT 'body' AS \"column\", MIN(body) AS mode, CAST(1 AS BIGINT) AS mode_count FROM ({LONG_KEYS})"
ORACLES["filter_options_ties"] = f"""
    WITH k AS ({LONG_KEYS}),
    m AS (SELECT body FROM k UNION ALL SELECT substr(body, 290, 200) FROM k UNION ALL SELECT DISTINCT substr(body, 1, 200) FROM k),
    c AS (SELECT body AS value, COUNT(*) AS "count" FROM m GROUP BY body)
    SELECT CAST(row_number() OVER (ORDER BY "count" DESC, value) AS INTEGER) AS rank, value, "count" FROM c QUALIFY rank <= 25
"""
ORACLES["mode_float"] = union([
    f"""SELECT * FROM (SELECT '{name}' AS "column", CAST(row_number() OVER (ORDER BY COUNT(*) DESC, CAST(v AS VARCHAR)) AS INTEGER) AS rank,
               CAST(v AS VARCHAR) AS value, COUNT(*) AS "count" FROM (SELECT CAST(l_{name} AS FLOAT) AS v FROM lineitem) GROUP BY v) WHERE rank <= 20"""
    for name in ("discount", "tax")
])
ORACLES["filter_options_apply"] = "SELECT MAX(n) AS n FROM (SELECT COUNT(*) AS n FROM documents GROUP BY text)"
ORACLES["filter_float"] = """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem
    WHERE CAST(l_discount AS FLOAT) IN (CAST(0.1 AS FLOAT), CAST(0.05 AS FLOAT))
"""
ORACLES["filter_decimal"] = """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE CAST(l_discount AS DECIMAL(10, 2)) = 0.1
"""


def extremes_sql(source: str, columns: list[str], metric: str) -> str:
    totals = union(
        [
            f"SELECT '{c}' AS \"column\", {c} AS key, SUM({metric}) AS value FROM {source} "
            f"WHERE {c} IS NOT NULL AND {metric} IS NOT NULL GROUP BY {c}"
            for c in columns
        ]
    )
    return f"""
    WITH t AS ({totals}),
    q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY value DESC, key) AS up,
                 ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY value, key DESC) AS down FROM t)
    SELECT "column", COUNT(*) AS n_groups, SUM(value) AS total,
           MAX(CASE WHEN up = 1 THEN key END) AS top_key, MAX(value) AS top_value,
           100.0 * MAX(value) / SUM(value) AS top_share,
           MAX(CASE WHEN down = 1 THEN key END) AS bottom_key, MIN(value) AS bottom_value,
           CASE WHEN COUNT(*) >= 3 THEN 100.0 * SUM(CASE WHEN up <= 3 THEN value END) / SUM(value) END AS top3_share
    FROM q GROUP BY "column"
    """


ORDER_EXTREMES = extremes_sql("orders", CATEGORIES["orders"], "o_totalprice")
ORACLES["category_extremes"] = f"""
    SELECT "column", n_groups, ROUND(total + 1e-5, 2) AS total, top_key, ROUND(top_value + 1e-5, 2) AS top_value,
           ROUND(top_share + 1e-9, 6) AS top_share, bottom_key, ROUND(bottom_value + 1e-5, 2) AS bottom_value,
           ROUND(top3_share + 1e-9, 6) AS top3_share FROM ({ORDER_EXTREMES})
"""
MONTH_POINTS = """
    SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS o_orderdate, ROUND(SUM(o_totalprice) + 1e-5, 2) AS value
    FROM orders GROUP BY 1
"""
ORACLES["line_series"] = MONTH_POINTS
ORACLES["line_series_strict"] = """
    SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, ROUND(value + 1e-5, 2) AS value FROM (
        SELECT o_orderdate, SUM(o_totalprice) AS value FROM orders GROUP BY 1
        ORDER BY value DESC, o_orderdate LIMIT 120)
"""
ORACLES["top_rows"] = """
    SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice + 1e-9, 6) AS o_totalprice,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
    FROM orders ORDER BY orders.o_totalprice DESC, o_orderkey LIMIT 25
"""
ORACLES["detail_rows"] = """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate
    FROM orders ORDER BY o_orderkey LIMIT 200
"""

# --- types ------------------------------------------------------------------

COLUMNS = {
    "events": [("event_id", "n"), ("ts", "d"), ("user_id", "n"), ("event_type", "s"), ("value", "f"), ("props", "s")],
    "documents": [("doc_id", "n"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "n")],
    "orders": [("o_orderkey", "n"), ("o_custkey", "n"), ("o_orderstatus", "s"), ("o_totalprice", "f"),
               ("o_orderdate", "d"), ("o_orderpriority", "s")],
    "labels": [("doc_id", "n"), ("quality", "n"), ("toxic", "n")],
    "customer": [("c_custkey", "n"), ("c_name", "s"), ("c_nationkey", "n"), ("c_acctbal", "f"), ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "n"), ("s_name", "s"), ("s_nationkey", "n"), ("s_acctbal", "f")],
    "nation": [("n_nationkey", "n"), ("n_name", "s"), ("n_regionkey", "n")],
    "region": [("r_regionkey", "n"), ("r_name", "s")],
    "part": [("p_partkey", "n"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "n"), ("p_retailprice", "f")],
    "embeddings": [("vec_id", "n"), ("embedding", "u"), ("label", "n")],
    "pages": [("page_id", "n"), ("url", "s"), ("html", "s")],
    "benchmark": [("item_id", "n"), ("text", "s")],
    "conversations": [("conv_id", "n"), ("turn", "n"), ("role", "s"), ("text", "s")],
    "lineitem": [("l_orderkey", "n"), ("l_partkey", "n"), ("l_suppkey", "n"), ("l_linenumber", "n"),
                 ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "d")],
    "strings": [("orderkey", "n"), ("linenumber", "n")] + [
        (c, "s") for c in ("money", "percent", "parsed_80", "parsed_90", "padded", "blank", "flag",
                           "ship_iso", "ship_us", "ship_mixed")
    ],
}
STRIPPED = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
TOKENS = ", ".join(f"'{t}'" for t in K.TRUE_TOKENS + K.FALSE_TOKENS)
ID_NAME = "|".join(K.IDENTIFIER_PATTERNS)
DATE_NAME = "|".join(K.DATE_WORDS)


def number_sql(c: str) -> str:
    return f"TRY_CAST(replace(replace(replace({STRIPPED.format(c=c)}, ',', ''), '$', ''), '%', '') AS DOUBLE)"


def date_sql(c: str) -> str:
    return f"try_strptime({STRIPPED.format(c=c)}, ['%Y-%m-%d', '%m/%d/%Y'])"


def column_type_sql(source: str, name: str, kind: str) -> str:
    """One row of type statistics; kind: n whole number, f fraction, d date, s text, u nested."""
    if kind == "u":
        return f"""SELECT '{name}' AS "column", 'unsupported' AS inferred_type, CAST(0 AS BIGINT) AS nunique,
            0.0::DOUBLE AS unique_ratio, 0.0::DOUBLE AS numeric_ratio, 0.0::DOUBLE AS date_ratio,
            0.0::DOUBLE AS separator_ratio, 0.0::DOUBLE AS avg_len"""
    text = f"CAST({name} AS VARCHAR)"
    numeric = f"CASE WHEN regexp_matches('{name}', '{ID_NAME}') AND ratio >= 0.95 THEN 'identifier' ELSE 'numerical' END"
    zero = "CAST(0 AS BIGINT)"
    stats = f"""
        SELECT COUNT({name}) AS nn, COUNT(DISTINCT {name}) AS nu,
               {f'COUNT({number_sql(name)})' if kind == 's' else zero} AS num,
               {f'COUNT({date_sql(name)})' if kind == 's' else zero} AS dat,
               {f"COUNT(CASE WHEN regexp_matches({STRIPPED.format(c=name)}, '[-/:T ]') THEN 1 END)" if kind == 's' else zero} AS sep,
               {f'SUM(LENGTH({text}))' if kind == 's' else '0'} AS chars,
               COUNT(CASE WHEN lower({STRIPPED.format(c=text)}) IN ({TOKENS}) THEN 1 END) AS tok,
               COUNT(DISTINCT lower({STRIPPED.format(c=text)})) AS tokens
        FROM {source}"""
    if kind == "d":
        tag = "'date'"
    elif kind == "f":
        tag = numeric
    elif kind == "n":
        tag = f"CASE WHEN nn > 0 AND tok = nn AND tokens <= 2 THEN 'boolean' ELSE {numeric} END"
    else:
        tag = f"""CASE
            WHEN nn > 0 AND tok = nn AND tokens <= 2 THEN 'boolean'
            WHEN num_ratio >= 0.85 AND nu > 1 THEN {numeric}
            WHEN (sep_ratio >= 0.5 AND date_ratio >= 0.8)
                 OR (regexp_matches('{name}', '{DATE_NAME}') AND date_ratio >= 0.6) THEN 'date'
            WHEN regexp_matches('{name}', '{ID_NAME}')
                 OR (ratio >= 0.95 AND nu > 50 AND NOT regexp_matches('{name}', '{DATE_NAME}')) THEN 'identifier'
            WHEN ratio >= 0.9 AND (avg_len > 40 OR nu > 100) THEN 'text'
            ELSE 'categorical' END"""
    return f"""
        SELECT '{name}' AS "column", {tag} AS inferred_type, nu AS nunique, ROUND(ratio + 1e-9, 6) AS unique_ratio,
               ROUND(num_ratio + 1e-9, 6) AS numeric_ratio, ROUND(date_ratio + 1e-9, 6) AS date_ratio,
               ROUND(sep_ratio + 1e-9, 6) AS separator_ratio, ROUND(avg_len + 1e-9, 6) AS avg_len
        FROM (SELECT *, nu / GREATEST(nn, 1) AS ratio, num / GREATEST(nn, 1) AS num_ratio,
                     dat / GREATEST(nn, 1) AS date_ratio, sep / GREATEST(nn, 1) AS sep_ratio,
                     COALESCE(chars / GREATEST(nn, 1), 0) AS avg_len FROM ({stats}))"""


def types_sql(source: str, columns: list[tuple[str, str]]) -> str:
    return union([column_type_sql(source, c, k) for c, k in columns])


# Lengths of numbers as text differ between engines, so they are compared for text only.
ORACLES["column_types_all"] = union(
    [
        f"""SELECT '{t}' AS table_name, "column", inferred_type, nunique, unique_ratio, numeric_ratio, date_ratio, avg_len
            FROM ({types_sql(t, COLUMNS[t])})"""
        for t in TYPED_TABLES
    ]
)
ORACLES["column_types_lineitem"] = f"""
    SELECT "column", inferred_type, nunique FROM ({types_sql('lineitem', COLUMNS['lineitem'])})
"""
STRINGS = f"({as_sql('strings')})"
ORACLES["column_types_dirty"] = f"""
    SELECT "column", inferred_type, nunique, numeric_ratio, date_ratio, separator_ratio
    FROM ({types_sql(STRINGS, COLUMNS['strings'])})
"""
ORACLES["column_types_approx"] = union(
    [
        f"""SELECT '{t}' AS table_name, "column", inferred_type, numeric_ratio, date_ratio, separator_ratio
            FROM ({types_sql(STRINGS if t == 'strings' else t, COLUMNS[t])})"""
        for t in ("orders", "events", "documents", "part", "strings")
    ]
)
ORACLES["numeric_parse_ratio"] = f"""
    SELECT "column", numeric_ratio, inferred_type
    FROM ({types_sql(STRINGS, [(c, 's') for c in ('money', 'percent', 'parsed_80', 'parsed_90', 'padded')])})
"""
ORACLES["date_parse_ratio"] = f"""
    SELECT "column", date_ratio, separator_ratio
    FROM ({types_sql(STRINGS, [(c, 's') for c in ('ship_iso', 'ship_us', 'ship_mixed', 'padded')])})
"""
TRUE_SET = ", ".join(f"'{t}'" for t in K.TRUE_TOKENS)
FALSE_SET = ", ".join(f"'{t}'" for t in K.FALSE_TOKENS)


def boolean_sql(c: str) -> str:
    token = f"lower({STRIPPED.format(c=c)})"
    return f"CASE WHEN {token} IN ({TRUE_SET}) THEN TRUE WHEN {token} IN ({FALSE_SET}) THEN FALSE END"


ORACLES["bool_tokens"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber, {boolean_sql('flag')} AS flag,
           {boolean_sql('padded')} AS padded FROM {STRINGS}
"""

# --- profile ----------------------------------------------------------------

GAPS = f"({as_sql('gaps')})"
GAP_COLUMNS = list(DIRTY["gaps"][1])


def mode_sql(source: str, c: str) -> str:
    return (
        f"(SELECT CAST({c} AS VARCHAR) FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)"
    )


ORACLES["profile_counts"] = union(
    [
        f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing_count,
            ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*) + 1e-9, 6) AS missing_percentage,
            COUNT(DISTINCT {c}) AS unique_count, ROUND(100.0 * COUNT(DISTINCT {c}) / COUNT(*) + 1e-9, 6) AS unique_percentage,
            {mode_sql(GAPS, c) if c == 'returnflag' else 'CAST(NULL AS VARCHAR)'} AS mode FROM {GAPS}"""
        for c in GAP_COLUMNS
    ]
)


def fence_sql(source: str, c: str) -> str:
    """Statistics, fences, method and outlier count of one column, from eight values up."""
    return f"""
        SELECT '{c}' AS "column", n, method,
               CASE method WHEN 'iqr' THEN q1 - 1.5 * (q3 - q1) WHEN 'zscore' THEN mean - 3 * std END AS lower,
               CASE method WHEN 'iqr' THEN q3 + 1.5 * (q3 - q1) WHEN 'zscore' THEN mean + 3 * std END AS upper,
               (SELECT COUNT(*) FROM {source} WHERE
                   (method = 'iqr' AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)))
                   OR (method = 'zscore' AND ABS({c} - mean) / std > 3)) AS count
        FROM (SELECT *, CASE WHEN q3 - q1 > 0 THEN 'iqr' WHEN std > 0 THEN 'zscore' ELSE 'none' END AS method
              FROM (SELECT COUNT({c}) AS n, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std,
                           QUANTILE_CONT({c}, 0.25) AS q1, QUANTILE_CONT({c}, 0.75) AS q3 FROM {source}))
        WHERE n >= 8"""


def outliers_sql(source: str, columns: list[str]) -> str:
    return f"""SELECT "column", n, method, ROUND(lower + 1e-9, 6) AS lower, ROUND(upper + 1e-9, 6) AS upper, count,
               ROUND(100.0 * count / n + 1e-9, 6) AS percentage
               FROM ({union([fence_sql(source, c) for c in columns])})"""


def profile_numeric_sql(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
        {r(f'AVG({c})')} AS mean, {r(f'STDDEV_SAMP({c})')} AS std, {r(f'QUANTILE_CONT({c}, 0.25)')} AS q25,
        {r(f'QUANTILE_CONT({c}, 0.5)')} AS median, {r(f'QUANTILE_CONT({c}, 0.75)')} AS q75,
        (SELECT count FROM ({fence_sql(source, c)})) AS outlier_count FROM {source}"""


ORACLES["profile_numeric"] = union([profile_numeric_sql("lineitem", c) for c in NUMERIC["lineitem"]])


def top_sql(source: str, c: str, k: int, label: str = "percentage") -> str:
    return f"""SELECT '{c}' AS "column", ROW_NUMBER() OVER (ORDER BY n DESC, v) AS rank, v AS value, n AS count,
        ROUND(100.0 * n / SUM(n) OVER () + 1e-9, 6) AS {label}
        FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1)
        QUALIFY rank <= {k}"""


ORACLES["profile_categorical"] = union([f"SELECT * FROM ({top_sql('part', c, 10)})" for c in ("p_name", "p_brand", "p_type")])


def iso(c: str) -> str:
    return (
        f"CASE WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


ORACLES["profile_date"] = f"""
    SELECT 'ts' AS "column", {iso('MIN(ts)')} AS minimum_date, {iso('MAX(ts)')} AS maximum_date,
           CAST(floor(epoch_us(MAX(ts)) / 86400000000.0 - epoch_us(MIN(ts)) / 86400000000.0) AS BIGINT) AS date_range_days
    FROM events
"""
LINE_TYPES = f"({types_sql('lineitem', COLUMNS['lineitem'])})"
ORACLES["profile_table"] = f"""
    WITH counts AS ({union([
        f'''SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing_count, 0.0::DOUBLE AS missing_percentage,
            COUNT(DISTINCT {c}) AS unique_count, ROUND(100.0 * COUNT(DISTINCT {c}) / COUNT(*) + 1e-9, 6) AS unique_percentage,
            {mode_sql('lineitem', c) if k == 's' else 'CAST(NULL AS VARCHAR)'} AS mode FROM lineitem'''
        for c, k in COLUMNS['lineitem']
    ])}), numbers AS ({union([profile_numeric_sql('lineitem', c) for c in NUMERIC['lineitem']])}),
    dates AS (SELECT 'l_shipdate' AS "column", {iso('MIN(l_shipdate)')} AS minimum_date,
              {iso('MAX(l_shipdate)')} AS maximum_date,
              CAST(date_diff('day', MIN(l_shipdate), MAX(l_shipdate)) AS BIGINT) AS date_range_days FROM lineitem)
    SELECT t."column", inferred_type, missing_count, missing_percentage, unique_count, unique_percentage, mode,
           min, max, mean, std, q25, median, q75, outlier_count, minimum_date, maximum_date, date_range_days
    FROM {LINE_TYPES} t JOIN counts USING ("column") LEFT JOIN numbers USING ("column") LEFT JOIN dates USING ("column")
"""


def null_cells(columns: list[str]) -> str:
    return " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in columns)


ORACLES["dataset_summary"] = f"""
    SELECT COUNT(*) AS rows, CAST({len(GAP_COLUMNS)} AS BIGINT) AS columns,
           CAST(5 AS BIGINT) AS numerical_variables, CAST(1 AS BIGINT) AS categorical_variables,
           CAST(0 AS BIGINT) AS date_variables, CAST(0 AS BIGINT) AS boolean_variables,
           CAST(0 AS BIGINT) AS text_variables, CAST(0 AS BIGINT) AS identifier_variables,
           CAST({null_cells(GAP_COLUMNS)} AS BIGINT) AS missing_values,
           COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {GAPS})) AS duplicate_rows FROM {GAPS}
"""
REPEATS = f"({as_sql('repeats')})"
REPEAT_COLUMNS = list(DIRTY["repeats"][1])
ORACLES["quality"] = f"""
    SELECT COUNT(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST({null_cells(REPEAT_COLUMNS)} AS BIGINT) AS missing_values,
           ROUND(100.0 * ({null_cells(REPEAT_COLUMNS)}) / (COUNT(*) * 4) + 1e-9, 6) AS missing_percentage,
           COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {REPEATS})) AS duplicate_rows,
           '' AS constant_columns FROM {REPEATS}
"""
ORACLES["duplicate_texts"] = """
    SELECT COUNT(*) AS rows, (SELECT COUNT(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS distinct_rows,
           CAST(SUM((text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT) AS BIGINT) AS missing_cells
    FROM documents
"""
ORACLES["preview_count"] = "SELECT COUNT(*) AS rows, COUNT(*) AS known FROM (SELECT * FROM orders LIMIT 50)"

# --- cleaning ---------------------------------------------------------------

ORACLES["drop_empty"] = f"""
    SELECT quantity, returnflag FROM ({as_sql('empties')}) WHERE NOT (quantity IS NULL AND returnflag IS NULL)
"""
ORACLES["dedup_rows"] = f"""
    SELECT DISTINCT quantity, CAST(linenumber AS BIGINT) AS linenumber, returnflag, linestatus FROM {REPEATS}
"""
ORACLES["trim_strings"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber, trim(padded) AS padded, trim(blank) AS blank,
           trim(flag) AS flag FROM {STRINGS}
"""
ORACLES["parse_numbers"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber,
           {', '.join(f'{number_sql(c)} AS {c}' for c in ('money', 'percent', 'parsed_80', 'parsed_90'))}
    FROM {STRINGS}
"""
ORACLES["parse_dates"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber,
           {', '.join(f"strftime({date_sql(c)}, '%Y-%m-%dT%H:%M:%S') AS {c}" for c in ('ship_iso', 'ship_us', 'ship_mixed'))}
    FROM {STRINGS}
"""
ORACLES["impute_median"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber,
           COALESCE(quantity, (SELECT QUANTILE_CONT(quantity, 0.5) FROM {GAPS})) AS quantity, price
    FROM {GAPS}
"""
ORACLES["impute_mode"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber,
           COALESCE(returnflag, {mode_sql(GAPS, 'returnflag')}) AS returnflag FROM {GAPS}
"""
MESSY = f"({as_sql('messy')})"
ORACLES["constant_columns"] = """SELECT 'k' AS "column" UNION ALL SELECT 'nothing'"""
ORACLES["missing_counts"] = union(
    [f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT(*) - COUNT({c}) AS missing FROM {MESSY}"""
     for c in DIRTY["messy"][1]]
)
ORACLES["quality_score"] = """
    SELECT o_orderpriority, ROUND(GREATEST(0, LEAST(100, 100
        - LEAST(35, 0.7 * 100.0 * gaps / (n * 3)) - LEAST(20, 0.5 * 100.0 * copies / n)
        - LEAST(15, 0.4 * 100.0 / 3) - LEAST(20, 0.5 * 100.0 * floor(gaps / 2) / ((n - copies) * 3)))), 1) AS score
    FROM (SELECT o_orderpriority, COUNT(*) AS n, SUM(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)::DOUBLE AS gaps,
                 SUM(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END)::DOUBLE AS copies FROM orders GROUP BY 1)
"""
# Cleaning of the messy table step by step: distinct rows, conversion, imputation.
CLEANING = f"""
    WITH raw AS (SELECT * FROM {MESSY}),
    uniq AS (SELECT DISTINCT quantity, sparse, returnflag, money, trim(flag) AS flag, shipped, k FROM raw),
    conv AS (SELECT quantity, sparse, returnflag, {number_sql('money')} AS money, {boolean_sql('flag')} AS flag,
                    TRY_CAST(shipped AS TIMESTAMP) AS shipped, k FROM uniq),
    med AS (SELECT QUANTILE_CONT(quantity, 0.5) AS quantity, QUANTILE_CONT(sparse, 0.5) AS sparse,
                   QUANTILE_CONT(money, 0.5) AS money,
                   COUNT(*) - COUNT(sparse) <= 0.6 * COUNT(*) AS fill_sparse FROM conv),
    fin AS (SELECT COALESCE(conv.quantity, med.quantity) AS quantity,
                   CASE WHEN fill_sparse THEN COALESCE(conv.sparse, med.sparse) ELSE conv.sparse END AS sparse,
                   COALESCE(returnflag, {mode_sql('conv', 'returnflag')}) AS returnflag,
                   COALESCE(conv.money, med.money) AS money, flag, shipped, k FROM conv, med)
"""
CLEAN_COLUMNS = ["quantity", "sparse", "returnflag", "money", "flag", "shipped", "k"]
ORACLES["cleaned_rows"] = f"""
    {CLEANING} SELECT quantity, sparse, returnflag, money, flag, {iso('shipped')} AS shipped, k FROM fin
"""
ORACLES["cleaning_report"] = f"""
    {CLEANING},
    c AS (SELECT (SELECT COUNT(*) FROM raw)::DOUBLE AS original_rows,
                 (SELECT COUNT(*) FROM fin)::DOUBLE AS final_rows,
                 (SELECT {null_cells(CLEAN_COLUMNS)} FROM conv)::DOUBLE AS missing_before,
                 (SELECT {null_cells(CLEAN_COLUMNS)} FROM fin)::DOUBLE AS missing_after,
                 (SELECT fill_sparse FROM med) AS fill_sparse,
                 (SELECT COUNT(*) FROM ({union([fence_sql('fin', x) for x in ('quantity', 'sparse', 'money', 'k')])})
                  WHERE count > 0)::DOUBLE AS outlier_columns,
                 (SELECT COUNT(*) - COUNT(shipped) FROM fin) AS date_gaps)
    {union([f"SELECT '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM c" for k, v in {
        'original_rows': 'original_rows', 'final_rows': 'final_rows', 'original_columns': 8, 'final_columns': 7,
        'empty_rows_removed': 0, 'empty_columns_removed': 1, 'duplicates_removed': 'original_rows - final_rows',
        'missing_values_before': 'missing_before', 'missing_values_after': 'missing_after',
        'converted_columns': 3, 'imputed_columns': 'CASE WHEN fill_sparse THEN 4 ELSE 3 END',
        'constant_columns': 1, 'identifier_columns': 0, 'outlier_columns': 'outlier_columns',
        'warnings': '1 + CASE WHEN fill_sparse THEN 0 ELSE 1 END + CASE WHEN date_gaps > 0 THEN 1 ELSE 0 END',
        'data_quality_score': '''ROUND(GREATEST(0, LEAST(100, 100 - LEAST(35, 70.0 * missing_before / (original_rows * 7))
            - LEAST(20, 50.0 * (original_rows - final_rows) / original_rows) - LEAST(15, 40.0 / 7)
            - LEAST(20, 50.0 * missing_after / (final_rows * 7)))), 1)''',
    }.items()])}
"""

# --- statistics -------------------------------------------------------------


def numeric_sql(source: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", COUNT({c}) AS count, COUNT(*) - COUNT({c}) AS missing, {r(f'AVG({c})')} AS mean,
        CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max, {r(f'STDDEV_SAMP({c})')} AS std,
        {r(f'VAR_SAMP({c})', 3)} AS variance,
        CASE WHEN COUNT({c}) < 3 THEN NULL WHEN VAR_SAMP({c}) = 0 THEN 0 ELSE {r(f'SKEWNESS({c})')} END AS skewness,
        {r(f'CAST(SUM({c}) AS DOUBLE)', 2)} AS sum, {r(f'QUANTILE_CONT({c}, 0.05)')} AS q05,
        {r(f'QUANTILE_CONT({c}, 0.25)')} AS q25, {r(f'QUANTILE_CONT({c}, 0.5)')} AS median,
        {r(f'QUANTILE_CONT({c}, 0.75)')} AS q75, {r(f'QUANTILE_CONT({c}, 0.95)')} AS q95 FROM {source}"""


ORACLES["numeric_analysis"] = union([numeric_sql("lineitem", c) for c in NUMERIC["lineitem"]])
ORACLES["numeric_analysis_gaps"] = union([numeric_sql(GAPS, c) for c in ("quantity", "price", "k")])
ORACLES["categorical_analysis"] = union(
    [
        f"""SELECT '{c}' AS "column", COUNT(*) AS n_categories,
            (SELECT {c} FROM orders GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS dominant_category,
            MAX(n) AS dominant_count, ROUND(100.0 * MAX(n) / SUM(n) + 1e-9, 6) AS dominant_percentage
            FROM (SELECT {c}, COUNT(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c})"""
        for c in CATEGORIES["orders"]
    ]
)
ORACLES["categorical_distribution"] = union([f"SELECT * FROM ({top_sql('part', c, 30)})" for c in ("p_name", "p_brand")])
ORACLES["date_analysis"] = f"""
    SELECT 'o_orderdate' AS "column", {iso('MIN(o_orderdate)')} AS earliest, {iso('MAX(o_orderdate)')} AS latest,
           CAST(date_diff('day', MIN(o_orderdate), MAX(o_orderdate)) AS BIGINT) AS time_span_days FROM orders
"""
ORACLES["date_counts"] = """
    SELECT 'o_orderdate' AS "column", 'month' AS granularity, period, count FROM (
        SELECT strftime(o_orderdate, '%Y-%m') AS period, COUNT(*) AS count FROM orders GROUP BY 1
        ORDER BY 1 DESC LIMIT 24)
    UNION ALL SELECT 'o_orderdate', 'year', strftime(o_orderdate, '%Y'), COUNT(*) FROM orders GROUP BY 3
"""
ORACLES["outliers_iqr"] = outliers_sql("events", ["value", "user_id"])
TWO_VALUES = f"({as_sql('two_values')})"
ORACLES["outliers_z"] = outliers_sql(TWO_VALUES, ["rare", "constant"])
ORACLES["outlier_flags"] = f"""
    SELECT orderkey, CAST(linenumber AS BIGINT) AS linenumber, rare,
           ABS(rare - (SELECT AVG(rare) FROM {TWO_VALUES})) / (SELECT STDDEV_SAMP(rare) FROM {TWO_VALUES}) > 3 AS rare_outlier
    FROM {TWO_VALUES}
"""


def pairs_sql(source: str, columns: list[str]) -> str:
    cells = [
        f"SELECT '{a}' AS column_1, '{b}' AS column_2, CORR({a}, {b}) AS r FROM {source}"
        for i, a in enumerate(columns) for b in columns[i + 1:]
    ]
    return f"SELECT * FROM ({union(cells)}) WHERE r IS NOT NULL AND NOT isnan(r)"


def correlations_sql(source: str, columns: list[str]) -> str:
    return f"""
    SELECT column_1, column_2, ROUND(r, 4) AS correlation, ROUND(ABS(r), 4) AS absolute_correlation,
           CASE WHEN ABS(r) >= 0.7 THEN 'strong' WHEN ABS(r) >= 0.4 THEN 'moderate' WHEN ABS(r) >= 0.2 THEN 'weak'
                ELSE 'very weak' END AS strength,
           CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'none' END AS direction,
           ROW_NUMBER() OVER (ORDER BY ROUND(ABS(r), 4) DESC, column_1, column_2) AS rank
    FROM ({pairs_sql(source, columns)})"""


ORACLES["correlations"] = correlations_sql("lineitem", NUMERIC["lineitem"])
ORACLES["correlations_gaps"] = correlations_sql(GAPS, ["orderkey", "linenumber", "quantity", "price"])
ORACLES["corr_heatmap"] = f"""
    WITH p AS ({pairs_sql('lineitem', NUMERIC['lineitem'])})
    SELECT column_1 AS row, column_2 AS "column", ROUND(r + 1e-9, 6) AS correlation FROM p
    UNION ALL SELECT column_2, column_1, ROUND(r + 1e-9, 6) FROM p
    UNION ALL SELECT DISTINCT c, c, 1.0::DOUBLE FROM (SELECT column_1 AS c FROM p UNION SELECT column_2 FROM p)
"""


def months_sql(source: str, date: str, metrics: list[str]) -> str:
    return union(
        [
            f"SELECT '{m}' AS metric, strftime({date}, '%Y-%m') AS period, CAST(COALESCE(SUM({m}), 0) AS DOUBLE) AS value "
            f"FROM {source} WHERE {date} IS NOT NULL GROUP BY 2"
            for m in metrics
        ]
    )


ORDER_MONTHS = months_sql("orders", "o_orderdate", NUMERIC["orders"])
ORACLES["monthly_trend"] = f"""
    SELECT metric, period, ROUND(value + 1e-5, 2) AS value FROM ({ORDER_MONTHS})
    QUALIFY ROW_NUMBER() OVER (PARTITION BY metric ORDER BY period DESC) <= 36
"""
TRENDS = f"""
    SELECT metric, 'o_orderdate' AS date_column,
           (list(period ORDER BY value DESC, period))[1] AS best_period, MAX(value) AS best_value,
           (list(period ORDER BY value, period))[1] AS worst_period, MIN(value) AS worst_value,
           100.0 * ((list(value ORDER BY period DESC))[1] - (list(value ORDER BY period))[1])
               / ABS((list(value ORDER BY period))[1]) AS pct_change_first_to_last
    FROM ({ORDER_MONTHS}) GROUP BY metric
"""
ORACLES["best_worst_month"] = f"""
    SELECT metric, date_column, best_period, ROUND(best_value + 1e-5, 2) AS best_value, worst_period,
           ROUND(worst_value + 1e-5, 2) AS worst_value, ROUND(pct_change_first_to_last + 1e-9, 6) AS pct_change_first_to_last
    FROM ({TRENDS})
"""
METRIC_NAME = "|".join(K.METRIC_WORDS)
AVERAGE_NAME = "|".join(K.AVERAGE_WORDS)
ORACLES["business_metrics"] = f"""
    SELECT "column", CASE WHEN regexp_matches("column", '{METRIC_NAME}') AND NOT regexp_matches("column", '{AVERAGE_NAME}')
                          THEN 'sum' ELSE 'mean' END AS preferred_aggregation,
           ROUND(mean + 1e-9, 6) AS mean, ROUND(sum + 1e-5, 2) AS sum, regexp_matches("column", '{METRIC_NAME}') AS is_metric_like,
           ROW_NUMBER() OVER (ORDER BY regexp_matches("column", '{METRIC_NAME}') DESC, ABS(sum) DESC) AS rank
    FROM ({union([f'''SELECT '{c}' AS "column", AVG({c}) AS mean, CAST(SUM({c}) AS DOUBLE) AS sum FROM lineitem'''
                  for c in NUMERIC['lineitem']])})
"""
ORACLES["important_columns"] = f"""
    SELECT 'numerical' AS kind, ROW_NUMBER() OVER (
               ORDER BY regexp_matches("column", '{METRIC_NAME}') DESC, weight DESC) AS rank, "column"
    FROM ({union([f'''SELECT '{c}' AS "column", ABS(AVG({c})) + ABS(STDDEV_SAMP({c})) AS weight FROM lineitem'''
                  for c in NUMERIC['lineitem']])}) QUALIFY rank <= 10
    UNION ALL
    SELECT 'categorical', ROW_NUMBER() OVER (ORDER BY n, pos), "column"
    FROM ({union([f'''SELECT '{c}' AS "column", {i} AS pos, COUNT(DISTINCT {c}) AS n FROM lineitem'''
                  for i, c in enumerate(CATEGORIES['lineitem'])])}) WHERE n BETWEEN 2 AND 60
    UNION ALL SELECT 'date', 1, 'l_shipdate'
"""

# --- KPIs, filters, dashboard -------------------------------------------------


def kpis_sql(source: str) -> str:
    cells = {
        ("rows", "count"): "COUNT(*)", ("customers", "nunique"): "COUNT(DISTINCT o_custkey)",
        ("priorities", "nunique"): "COUNT(DISTINCT o_orderpriority)", ("statuses", "count"): "COUNT(o_orderstatus)",
        ("total", "sum"): "SUM(o_totalprice)", ("average", "mean"): "AVG(o_totalprice)",
        ("middle", "median"): "QUANTILE_CONT(o_totalprice, 0.5)", ("smallest", "min"): "MIN(o_totalprice)",
        ("largest", "max"): "MAX(o_totalprice)",
    }
    return union(
        [
            f"SELECT '{n}' AS name, '{how}' AS aggregation, ROUND(CAST({e} AS DOUBLE) + 1e-5, 2) AS value FROM {source}"
            for (n, how), e in cells.items()
        ]
    )


ORACLES["order_kpis"] = f"{kpis_sql('orders')} UNION ALL SELECT 'unknown', 'sum', NULL"
ORACLES["default_kpis"] = """
    SELECT 'Total Records' AS name, 'count' AS aggregation, CAST(COUNT(*) AS DOUBLE) AS value FROM orders
    UNION ALL SELECT 'Total o_orderkey', 'sum', CAST(SUM(o_orderkey) AS DOUBLE) FROM orders
    UNION ALL SELECT 'Avg o_orderkey', 'mean', ROUND(AVG(o_orderkey) + 1e-5, 2) FROM orders
    UNION ALL SELECT 'Unique o_orderstatus', 'nunique', CAST(COUNT(DISTINCT o_orderstatus) AS DOUBLE) FROM orders
"""
ORACLES["filter_options"] = f"""
    SELECT 'o_orderdate' AS "column", 'date' AS type, CAST(NULL AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS value,
           CAST(NULL AS BIGINT) AS count, strftime(MIN(o_orderdate), '%Y-%m-%d') AS min,
           strftime(MAX(o_orderdate), '%Y-%m-%d') AS max FROM orders
    UNION ALL SELECT "column", 'categorical', rank, value, count, NULL, NULL FROM
        ({union([f'SELECT * FROM ({top_sql("orders", c, 100)})' for c in ('o_orderpriority', 'o_custkey')])})
"""
ORDER_ROWS = f"""SELECT o_orderkey, o_custkey, o_orderstatus, ROUND(o_totalprice + 1e-9, 6) AS o_totalprice,
    {iso('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders"""
ORACLES["filter_range"] = f"{ORDER_ROWS} WHERE orders.o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30'"
ORACLES["filter_in"] = f"{ORDER_ROWS} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"
ORACLES["filter_eq"] = f"""
    SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
           ROUND(l_extendedprice + 1e-9, 6) AS l_extendedprice, ROUND(l_discount + 1e-9, 6) AS l_discount, ROUND(l_tax + 1e-9, 6) AS l_tax,
           l_returnflag, l_linestatus, {iso('l_shipdate')} AS l_shipdate
    FROM lineitem WHERE l_quantity = 5 AND l_returnflag = 'R'
"""
VIEW = "(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus IN ('F', 'O'))"
ORACLES["filtered_dashboard"] = f"""
    SELECT 'kpi:' || name AS item, value FROM ({kpis_sql(VIEW)})
    UNION ALL SELECT 'bar:' || o_orderpriority, ROUND(SUM(o_totalprice) + 1e-5, 2) FROM {VIEW} GROUP BY o_orderpriority
    UNION ALL SELECT 'mean:' || o_orderstatus, ROUND(AVG(o_totalprice) + 1e-5, 2) FROM {VIEW} GROUP BY o_orderstatus
"""
ORACLES["eligibility"] = f"""
    SELECT "column", inferred_type, n_values, inferred_type = 'date' OR COALESCE(n_values <= 100, FALSE) AS can_filter,
           COALESCE(n_values <= 8, FALSE) AS can_pie,
           inferred_type = 'categorical' AND n_values BETWEEN 2 AND 60 AS can_group,
           inferred_type = 'numerical' AS can_measure,
           regexp_matches("column", '{METRIC_NAME}') AS is_metric_like,
           regexp_matches("column", '{"|".join(K.GEO_WORDS)}') AS is_geo,
           CASE inferred_type WHEN 'numerical' THEN 'sum, mean, median, min, max, count, nunique'
                WHEN 'categorical' THEN 'nunique, count' ELSE 'count' END AS kpi_aggregations
    FROM (SELECT "column", inferred_type, CASE WHEN inferred_type <> 'date' THEN nunique END AS n_values
          FROM ({types_sql('orders', COLUMNS['orders'])}))
"""
LABELLED = "(SELECT * FROM documents JOIN labels USING (doc_id))"
ORACLES["target_screen"] = f"""
    WITH s AS (SELECT COUNT(*) AS n, COUNT(DISTINCT lang) AS lang, COUNT(DISTINCT source) AS source,
                      COUNT(DISTINCT quality) AS quality, COUNT(DISTINCT toxic) AS toxic FROM {LABELLED}),
    c AS ({union([f"SELECT '{c}' AS \"column\", {c} AS v, n FROM s" for c in ('lang', 'source', 'quality', 'toxic')])})
    SELECT "column", 'class_target' AS role, n >= 30 AND v BETWEEN 2 AND 12 AND v / n < 0.2 AS eligible,
           FALSE AS preferred FROM c
    UNION ALL SELECT "column", 'categorical_feature', v BETWEEN 2 AND 30, FALSE FROM c
    UNION ALL SELECT 'n_chars', 'regression_target', TRUE, FALSE
    UNION ALL SELECT 'n_chars', 'numeric_feature', TRUE, FALSE
"""

# --- chart datasets -----------------------------------------------------------


def histogram_sql(source: str, c: str) -> str:
    return f"""
    SELECT '{c}' AS "column", bin, ROUND(lo + w * bin + 1e-9, 6) AS lower, ROUND(lo + w * (bin + 1) + 1e-9, 6) AS upper,
           COALESCE(n, 0) AS count
    FROM (SELECT MIN({c}) AS lo, (MAX({c}) - MIN({c})) / 30 AS w FROM {source}),
         (SELECT unnest(range(30)) AS bin)
    LEFT JOIN (
        SELECT CAST(LEAST(FLOOR(({c} - lo) / w), 29) AS BIGINT) AS b, COUNT(*) AS n FROM {source},
            (SELECT MIN({c}) AS lo, (MAX({c}) - MIN({c})) / 30 AS w FROM {source}) GROUP BY 1
    ) ON b = bin"""


ORACLES["histogram"] = union([histogram_sql("lineitem", c) for c in ("l_extendedprice", "l_quantity")])


def box_sql(source: str, x: str, y: str) -> str:
    return f"""
    WITH top AS (SELECT {x} FROM {source} WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, {x} LIMIT 30),
    rows AS (SELECT {x}, {y} FROM {source} JOIN top USING ({x}) WHERE {y} IS NOT NULL),
    q AS (SELECT {x}, QUANTILE_CONT({y}, 0.25) AS q25, QUANTILE_CONT({y}, 0.5) AS median,
                 QUANTILE_CONT({y}, 0.75) AS q75 FROM rows GROUP BY 1),
    f AS (SELECT *, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi FROM q)
    SELECT {x}, COUNT(*) AS count, ROUND(AVG({y}) + 1e-9, 6) AS mean,
           MIN(CASE WHEN {y} BETWEEN lo AND hi THEN {y} END) AS whisker_low, ROUND(q25 + 1e-9, 6) AS q25,
           ROUND(median + 1e-9, 6) AS median, ROUND(q75 + 1e-9, 6) AS q75,
           MAX(CASE WHEN {y} BETWEEN lo AND hi THEN {y} END) AS whisker_high,
           COUNT(CASE WHEN NOT ({y} BETWEEN lo AND hi) THEN 1 END) AS outliers
    FROM rows JOIN f USING ({x}) GROUP BY {x}, q25, median, q75"""


ORACLES["box_stats"] = box_sql("events", "event_type", "value")
ORACLES["box_stats_top_groups"] = box_sql("events", "props", "value")
ORACLES["chart_boxes"] = union([
    f"""SELECT '{m}' AS metric, l_returnflag AS key, count, mean, whisker_low, q25, median, q75, whisker_high, outliers
        FROM ({box_sql("lineitem", "l_returnflag", m)})""" for m in ("l_quantity", "l_extendedprice", "l_discount")
])
ORACLES["chart_scatter"] = union([
    f"SELECT '{a}' AS x_metric, '{b}' AS y_metric, LEAST(5000, COUNT(*)) AS n, {k} AS known FROM customer"
    for a, b, k in (("c_acctbal", "c_nationkey", "0"), ("c_acctbal", "c_custkey", "LEAST(5000, COUNT(*))"), ("c_nationkey", "c_custkey", "0"))
])
ORACLES["chart_box"] = box_sql("orders", "o_orderstatus", "o_totalprice")


def chart_cells(chart: str, dimension: str, key: str, metrics: list[str]) -> list[str]:
    return [
        f"SELECT '{chart}' AS chart, '{dimension}' AS dimension, {key} AS key, '{m}' AS metric, "
        f"ROUND(CAST(SUM({m}) AS DOUBLE) + 1e-5, 2) AS value FROM orders GROUP BY 3"
        for m in metrics
    ]


ORACLES["chart_datasets"] = union(
    chart_cells("bar", "o_orderstatus", "o_orderstatus", NUMERIC["orders"])
    + chart_cells("bar", "o_orderpriority", "o_orderpriority", NUMERIC["orders"])
    + chart_cells("line", "o_orderdate", "strftime(o_orderdate, '%Y-%m')", NUMERIC["orders"])
    # The price is the metric-like column, so pies show it.
    + chart_cells("pie", "o_orderstatus", "o_orderstatus", ["o_totalprice"])
    + chart_cells("pie", "o_orderpriority", "o_orderpriority", ["o_totalprice"])
)
ORACLES["chart_donut"] = topn(PART, "p_brand", "SUM(p_retailprice)", 8, SUMMED.format(n=8), 2)
ORACLES["chart_area"] = """
    SELECT strftime(date_trunc('month', l_shipdate), '%Y-%m-%d') AS l_shipdate, ROUND(SUM(l_quantity) + 1e-5, 2) AS value
    FROM lineitem GROUP BY 1
"""

# --- insights -----------------------------------------------------------------

ORACLES["insight_dataset"] = f"""
    SELECT 'dataset' AS type, CAST(NULL AS VARCHAR) AS subject, CAST(COUNT(*) AS DOUBLE) AS value FROM {GAPS}
    UNION ALL SELECT 'quality', NULL, ROUND(100.0 * ({null_cells(GAP_COLUMNS)}) / (COUNT(*) * {len(GAP_COLUMNS)}) + 1e-9, 6) FROM {GAPS}
"""
CATEGORY_FACTS = f"""
    SELECT 'concentration' AS type, "column" AS subject, dominant_percentage AS value FROM ({ORACLES['categorical_analysis']})
    UNION ALL SELECT 'concentration', "column", dominant_percentage FROM ({ORACLES['categorical_analysis']})
        WHERE dominant_percentage >= 60
    UNION ALL SELECT 'top_category', "column", top_value FROM ({ORDER_EXTREMES})
    UNION ALL SELECT 'bottom_category', "column", bottom_value FROM ({ORDER_EXTREMES})
    UNION ALL SELECT 'concentration', "column", top3_share FROM ({ORDER_EXTREMES}) WHERE top3_share IS NOT NULL
"""
ORACLES["insight_category"] = f"SELECT type, subject, ROUND(value + 1e-5, 2) AS value FROM ({CATEGORY_FACTS})"


def numeric_facts(source: str, columns: list[str]) -> str:
    stats = f"({union([numeric_sql(source, c) for c in columns])})"
    return f"""
    SELECT 'metric' AS type, "column" AS subject, mean AS value FROM {stats}
    UNION ALL SELECT 'distribution', "column", skewness FROM {stats} WHERE ABS(skewness) >= 1
    UNION ALL SELECT 'metric', "column", sum FROM {stats} WHERE ABS(sum) > ABS(mean)"""


ORACLES["insight_numeric"] = (
    f"SELECT type, subject, ROUND(value + 1e-5, 2) AS value FROM ({numeric_facts('events', ['user_id', 'value'])})"
)
ORACLES["insight_correlation"] = f"""
    SELECT 'correlation' AS type, column_1 || ' / ' || column_2 AS subject, correlation AS value
    FROM ({ORACLES['correlations']}) WHERE rank = 1 OR (rank <= 6 AND ABS(correlation) >= 0.5)
"""
ORACLES["insight_trend"] = f"""
    SELECT 'trend' AS type, metric AS subject, ROUND(unnest([best_value, worst_value, pct_change_first_to_last]) + 1e-5, 2) AS value
    FROM ({TRENDS})
"""
ORACLES["insight_outlier"] = f"""
    SELECT 'outlier' AS type, "column" AS subject, CAST(count AS DOUBLE) AS value
    FROM ({ORACLES['outliers_iqr']}) WHERE count > 0
"""



def place(column: str, names: list[str]) -> str:
    return f"list_position([{', '.join(repr(n) for n in names)}], {column})"


ORDER_STATS = f"({union([numeric_sql('orders', c) for c in NUMERIC['orders']])})"
ORDER_CATEGORY = ORACLES["categorical_analysis"]
ORACLES["insight_package"] = f"""
    WITH facts AS (
        SELECT 1 AS part, 1 AS p, 1 AS q, 'dataset' AS type, CAST(NULL AS VARCHAR) AS subject,
               CAST(COUNT(*) AS DOUBLE) AS value FROM orders
        UNION ALL SELECT 1, 2, 1, 'quality', NULL, 0.0
        UNION ALL SELECT 2, {place('"column"', CATEGORIES['orders'])}, 1, 'concentration', "column", dominant_percentage
            FROM ({ORDER_CATEGORY})
        UNION ALL SELECT 2, {place('"column"', CATEGORIES['orders'])}, 2, 'concentration', "column", dominant_percentage
            FROM ({ORDER_CATEGORY}) WHERE dominant_percentage >= 60
        UNION ALL SELECT 2, {place('"column"', CATEGORIES['orders'])}, 3, 'top_category', "column", top_value
            FROM ({ORDER_EXTREMES})
        UNION ALL SELECT 2, {place('"column"', CATEGORIES['orders'])}, 4, 'bottom_category', "column", bottom_value
            FROM ({ORDER_EXTREMES})
        UNION ALL SELECT 2, {place('"column"', CATEGORIES['orders'])}, 5, 'concentration', "column", top3_share
            FROM ({ORDER_EXTREMES}) WHERE top3_share IS NOT NULL
        UNION ALL SELECT 3, {place('"column"', NUMERIC['orders'])}, 1, 'metric', "column", mean FROM {ORDER_STATS}
        UNION ALL SELECT 3, {place('"column"', NUMERIC['orders'])}, 2, 'distribution', "column", skewness
            FROM {ORDER_STATS} WHERE ABS(skewness) >= 1
        UNION ALL SELECT 3, {place('"column"', NUMERIC['orders'])}, 3, 'metric', "column", sum
            FROM {ORDER_STATS} WHERE ABS(sum) > ABS(mean)
        UNION ALL SELECT 4, rank, 1, 'correlation', column_1 || ' / ' || column_2, correlation
            FROM ({correlations_sql('orders', NUMERIC['orders'])})
            WHERE rank = 1 OR (rank <= 6 AND ABS(correlation) >= 0.5)
        UNION ALL SELECT 5, {place('metric', NUMERIC['orders'])}, 1, 'trend', metric, best_value FROM ({TRENDS})
        UNION ALL SELECT 5, {place('metric', NUMERIC['orders'])}, 2, 'trend', metric, worst_value FROM ({TRENDS})
        UNION ALL SELECT 5, {place('metric', NUMERIC['orders'])}, 3, 'trend', metric, pct_change_first_to_last
            FROM ({TRENDS}) WHERE pct_change_first_to_last IS NOT NULL
        UNION ALL SELECT 6, {place('"column"', NUMERIC['orders'])}, 1, 'outlier', "column", CAST(count AS DOUBLE)
            FROM ({outliers_sql('orders', NUMERIC['orders'])}) WHERE count > 0
    )
    SELECT ROW_NUMBER() OVER (ORDER BY part, p, q) AS seq, type, subject, ROUND(value + 1e-5, 2) AS value
    FROM facts QUALIFY seq <= 40
"""

# --- series and models ----------------------------------------------------------

MONTH_GAPS = f"({as_sql('month_gaps')})"


def series_sql(source: str, date: str, metric: str, by: str = "0") -> str:
    """`(g, m, idx, y)`: every calendar month of every group."""
    return f"""
        SELECT g, m, CAST(ROW_NUMBER() OVER (PARTITION BY g ORDER BY m) - 1 AS BIGINT) AS idx, COALESCE(s, 0) AS y
        FROM (SELECT {by} AS g, unnest(generate_series(date_trunc('month', MIN({date})), date_trunc('month', MAX({date})),
                     INTERVAL 1 MONTH)) AS m FROM {source} WHERE {date} IS NOT NULL AND {metric} IS NOT NULL GROUP BY 1)
        LEFT JOIN (SELECT {by} AS g, date_trunc('month', {date}) AS m, SUM({metric}) AS s FROM {source}
                   WHERE {date} IS NOT NULL GROUP BY 1, 2) USING (g, m)"""


ORACLES["month_resample"] = f"""
    SELECT strftime(m, '%Y-%m-%d') AS month, idx, ROUND(y + 1e-5, 2) AS value
    FROM ({series_sql(MONTH_GAPS, 'orderdate', 'totalprice')})
"""


def forecast_sql(source: str, date: str, metric: str, by: str = "0") -> str:
    return f"""
    WITH s AS ({series_sql(source, date, metric, by)}),
    fit AS (SELECT g, COUNT(*) AS n, MAX(m) AS last, REGR_SLOPE(y, idx) AS b, REGR_INTERCEPT(y, idx) AS a FROM s GROUP BY g),
    dev AS (SELECT g, STDDEV_POP(y - (a + b * idx)) AS d FROM s JOIN fit USING (g) GROUP BY g),
    ahead AS (SELECT fit.*, d, unnest(range(1, CAST(LEAST(6, GREATEST(3, floor(n / 4))) AS BIGINT) + 1)) AS step
              FROM fit JOIN dev USING (g) WHERE n >= 6)
    SELECT g, strftime(last + to_months(CAST(step AS INTEGER)), '%Y-%m-%d') AS period, ROUND(a + b * (n + step - 1) + 1e-5, 2) AS value,
           ROUND(a + b * (n + step - 1) - 1.96 * d + 1e-5, 2) AS lower, ROUND(a + b * (n + step - 1) + 1.96 * d + 1e-5, 2) AS upper
    FROM ahead"""


ORACLES["forecast_linear"] = (
    f"SELECT period, value, lower, upper FROM ({forecast_sql('orders', 'o_orderdate', 'o_totalprice')})"
)
ORACLES["forecast_by_group"] = (
    f"SELECT g AS o_orderpriority, period, value, lower, upper "
    f"FROM ({forecast_sql('orders', 'o_orderdate', 'o_totalprice', 'o_orderpriority')})"
)
ORACLES["forecast_errors"] = f"""
    WITH s AS ({series_sql('orders', 'o_orderdate', 'o_totalprice', 'o_orderstatus')}),
    k AS (SELECT *, COUNT(*) OVER (PARTITION BY g) AS n FROM s),
    t AS (SELECT *, GREATEST(3, floor(n * 0.8)) AS split FROM k WHERE n >= 6),
    fit AS (SELECT g, REGR_SLOPE(y, idx) AS b, REGR_INTERCEPT(y, idx) AS a FROM t WHERE idx < split GROUP BY g),
    e AS (SELECT t.*, y - (a + b * idx) AS err FROM t JOIN fit USING (g) WHERE idx >= split)
    SELECT g AS o_orderstatus, MAX(n) AS months, CAST(MAX(LEAST(6, GREATEST(3, floor(n / 4)))) AS BIGINT) AS horizon_months,
           ROUND(AVG(ABS(err)) + 1e-5, 2) AS mae, ROUND(SQRT(AVG(err * err)) + 1e-5, 2) AS rmse,
           ROUND(1 - SUM(err * err) / (VAR_POP(y) * COUNT(*)) + 1e-9, 6) AS r2
    FROM e GROUP BY g
"""

# --- sources and sinks ------------------------------------------------------------

ORACLES["csv_round_trip"] = """
    SELECT o_orderstatus, COUNT(*) AS rows, CAST(SUM(o_custkey) AS BIGINT) AS custkeys,
           ROUND(SUM(o_totalprice) + 1e-5, 2) AS total, MIN(o_orderpriority) AS first_priority
    FROM orders GROUP BY o_orderstatus
"""
ORACLES["csv_quoted"] = """
    SELECT doc_id, sha256('"quoted", ' || text || ' ;"' || chr(13) || chr(10) || '"end') AS text_sha256, lang FROM documents
"""
ORACLES["csv_header_orders"] = """
    SELECT o_orderkey, o_custkey, o_orderpriority, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS o_orderstatus FROM orders
"""
ORACLES["csv_row_widths"] = """
    SELECT CASE WHEN o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0 THEN o_orderstatus END AS o_orderstatus, COUNT(*) AS n,
           CAST(SUM(o_custkey) AS BIGINT) AS custkeys, MAX(long_rows) AS long_rows, MAX(short_rows) AS short_rows, CAST(2 AS BIGINT) AS warnings
    FROM orders, (SELECT COUNT(*) FILTER (o_orderkey % 7 = 0) AS long_rows,
                         COUNT(*) FILTER (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0) AS short_rows FROM orders)
    GROUP BY ALL
"""
ORACLES["json_round_trip"] = f"""
    SELECT event_type, COUNT(*) AS rows, ROUND(SUM(value) + 1e-5, 2) AS total, {iso('MIN(ts)')} AS first_ts
    FROM events GROUP BY event_type
"""

ORACLES["report_sections"] = f"""
    SELECT 'dataset_summary' AS section, CAST(1 AS BIGINT) AS rows UNION ALL SELECT 'quality', 1
    UNION ALL SELECT 'numerical_analysis', 3 UNION ALL SELECT 'business_metrics', 3
    UNION ALL SELECT 'outliers', COUNT(*) FROM ({outliers_sql('orders', NUMERIC['orders'])}) WHERE count > 0
    UNION ALL SELECT 'categorical_summary', 2
    UNION ALL SELECT 'categorical_distribution', COUNT(DISTINCT o_orderstatus) + COUNT(DISTINCT o_orderpriority) FROM orders
    UNION ALL SELECT 'date_analysis', 1
    UNION ALL SELECT 'date_counts', COUNT(*) FROM ({ORACLES['date_counts']})
    UNION ALL SELECT 'correlations', 3
    UNION ALL SELECT 'strong_correlations', COUNT(*) FROM ({correlations_sql('orders', NUMERIC['orders'])})
        WHERE absolute_correlation >= 0.5
    UNION ALL SELECT 'trends', 3
    UNION ALL SELECT 'trend_points', COUNT(*) FROM ({ORACLES['monthly_trend']})
    UNION ALL SELECT 'important_columns', 3 + 2 + 1
"""
# A column with more than 60 % missing after the duplicates are gone is left as it is.
ORACLES["cleaning_actions"] = f"""
    {CLEANING}
    SELECT * FROM (VALUES (NULL, 'drop_empty_columns'), (NULL, 'drop_duplicates'), ('money', 'convert'),
        ('flag', 'convert'), ('shipped', 'convert'), ('quantity', 'impute_median'), ('money', 'impute_median'),
        ('returnflag', 'impute_mode'), (NULL, 'flag_constant'), ('shipped', 'date_gaps'),
        (NULL, 'constant_columns')) AS t("column", action)
    UNION ALL SELECT 'sparse', CASE WHEN fill_sparse THEN 'impute_median' ELSE 'left_missing' END FROM med
    UNION ALL SELECT NULL, 'flag_outliers' FROM (
        SELECT SUM(count) AS n FROM ({union([fence_sql('fin', x) for x in ('quantity', 'sparse', 'money', 'k')])})
    ) WHERE n > 0
"""
ORACLES["scatter_pairs"] = """
    SELECT CAST(p_size AS DOUBLE) AS p_size, ROUND(p_retailprice, 6) AS p_retailprice, p_brand FROM part
"""


# --- models: what the definition fixes -----------------------------------------------


def hashed(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0"


ORACLES["regress_line"] = f"""
    WITH t AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y,
                      {hashed("CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)")} AS h FROM lineitem),
    m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM t WHERE h >= 0.25),
    e AS (SELECT y, y - (a * x + b) AS d FROM t, m WHERE h < 0.25),
    q AS (SELECT AVG(ABS(d)) AS mae, SQRT(AVG(d * d)) AS rmse, 1 - AVG(d * d) / VAR_POP(y) AS r2, COUNT(*) AS n FROM e)
    SELECT {r('mae', 3)} AS mae, {r('rmse', 3)} AS rmse, {r('r2', 3)} AS r2, {r('r2', 3)} AS fact_r2, LEAST(n, {K.RESIDUAL_POINTS}) AS points FROM q
"""
ORACLES["class_test_sizes"] = f"""
    WITH t AS (SELECT CASE WHEN o_orderkey < 5 THEN 'rare' ELSE o_orderstatus END AS class, {hashed("CAST(o_orderkey AS VARCHAR)")} AS h FROM orders),
    e AS (SELECT class, MIN(h) AS low, MAX(h) AS high FROM t GROUP BY class HAVING COUNT(*) >= {K.ML_MIN_CLASS_ROWS})
    SELECT class AS actual, COUNT(*) FILTER ((h < 0.25 OR h <= low) AND h < high) AS n FROM t JOIN e USING (class) GROUP BY class
"""
ORACLES["importance_first"] = """
    WITH t AS (SELECT l_linenumber > 3 AS late, unnest([
        {'feature': 'step', 'x': CAST(l_linenumber AS DOUBLE)}, {'feature': 'size', 'x': CAST(l_quantity AS DOUBLE)},
        {'feature': 'tax', 'x': CAST(l_tax AS DOUBLE)}, {'feature': 'discount', 'x': CAST(l_discount AS DOUBLE)}]) AS v FROM lineitem)
    SELECT v.feature AS feature, CASE WHEN MAX(v.x) FILTER (NOT late) < MIN(v.x) FILTER (late) THEN 1.0 ELSE 0.0 END AS importance
    FROM t GROUP BY 1
"""
ORACLES["cluster_totals"] = f"""
    SELECT COUNT(*) AS n, {r('AVG(p_size)', 4)} AS size, {r('AVG(p_retailprice)', 4)} AS price
    FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL
"""
ORACLES["anomaly_totals"] = f"""
    SELECT COUNT(*) AS n, COUNT(*) AS in_range, COUNT(*) AS consistent, {r('SUM(CAST(p_size AS DOUBLE))', 2)} AS size,
           {r('SUM(CAST(p_retailprice AS DOUBLE))', 2)} AS price
    FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL
"""
ORACLES["model_refusals"] = """
    SELECT task, false AS used, 1 AS warnings, 0 AS charts, COUNT(*) AS rows
    FROM orders, (SELECT unnest(['classification', 'clustering', 'anomaly', 'forecasting', 'other']) AS task) GROUP BY task
"""
