"""Dirty versions of the test tables: select lists that Spark and SQL read alike.

The tables are clean, so gaps, padding, mixed formats and repeats are put in by
expressions over every row.
"""

US_DATE = (
    "CAST(month(l_shipdate) AS STRING) || '/' || CAST(day(l_shipdate) AS STRING) || '/' || "
    "CAST(year(l_shipdate) AS STRING)"
)

# name -> (table, select list)
DIRTY = {
    "gaps": (
        "lineitem",
        {
            "orderkey": "l_orderkey",
            "linenumber": "l_linenumber",
            "quantity": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END",
            "price": "CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_extendedprice END",
            "returnflag": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END",
            "k": "CAST(1.5 AS DOUBLE)",
        },
    ),
    "strings": (
        "lineitem",
        {
            "orderkey": "l_orderkey",
            "linenumber": "l_linenumber",
            "money": "'$' || CAST(l_linenumber AS STRING) || ',' || '000.50'",
            "percent": "CAST(l_linenumber AS STRING) || '%'",
            "parsed_80": "CASE WHEN l_orderkey % 10 < 2 THEN 'n/a?' ELSE CAST(l_linenumber AS STRING) END",
            "parsed_90": "CASE WHEN l_orderkey % 10 = 0 THEN 'n/a?' ELSE CAST(l_linenumber AS STRING) END",
            "padded": "'  ' || l_linestatus || ' '",
            "blank": "CASE WHEN l_linenumber = 1 THEN '   ' ELSE l_returnflag END",
            "flag": "CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE ' no' END",
            "ship_iso": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
            "ship_us": US_DATE,
            "ship_mixed": f"CASE WHEN l_orderkey % 4 = 0 THEN {US_DATE} WHEN l_orderkey % 4 = 1 THEN 'soon' "
                          "ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
        },
    ),
    "empties": (
        "lineitem",
        {
            "quantity": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END",
            "returnflag": "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END",
            "nothing": "CAST(NULL AS DOUBLE)",
        },
    ),
    "repeats": (
        "lineitem",
        {
            "quantity": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END",
            "linenumber": "l_linenumber",
            "returnflag": "l_returnflag",
            "linestatus": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_linestatus END",
        },
    ),
    "messy": (
        "lineitem",
        {
            "quantity": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END",
            "sparse": "CASE WHEN l_orderkey % 3 <> 0 THEN NULL ELSE l_discount END",
            "returnflag": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_returnflag END",
            "money": "CASE WHEN l_orderkey % 10 = 1 THEN 'n/a?' ELSE '$' || CAST(l_linenumber AS STRING) END",
            "flag": "CASE WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE ' no' END",
            "shipped": "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE "
                       "CAST(year(l_shipdate) AS STRING) || '-0' || CAST(quarter(l_shipdate) AS STRING) || '-01' END",
            "k": "CAST(1.5 AS DOUBLE)",
            "nothing": "CAST(NULL AS DOUBLE)",
        },
    ),
    "two_values": (
        "lineitem",
        {
            "orderkey": "l_orderkey",
            "linenumber": "l_linenumber",
            "rare": "CASE WHEN l_orderkey % 100 = 0 THEN 1000.0E0 ELSE 5.0E0 END",
            "constant": "CAST(1.5 AS DOUBLE)",
        },
    ),
    "month_gaps": (
        "orders",
        {
            "orderdate": "CASE WHEN month(o_orderdate) IN (3, 4) THEN NULL ELSE o_orderdate END",
            "orderstatus": "o_orderstatus",
            "totalprice": "o_totalprice",
        },
    ),
}


def select_list(name: str) -> list[str]:
    return [f"{expression} AS {alias}" for alias, expression in DIRTY[name][1].items()]


def as_sql(name: str) -> str:
    return f"SELECT {', '.join(select_list(name))} FROM {DIRTY[name][0]}"
