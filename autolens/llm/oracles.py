"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op1_topk": """
        WITH e AS (
            SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        )
        SELECT query_id,
               CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM s
        QUALIFY rank <= 10
    """,
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER g = 1 AS kept,
               sha256(body) AS text_sha256
        FROM d
        WINDOW g AS (PARTITION BY body ORDER BY points DESC, doc_id)
    """,
}
