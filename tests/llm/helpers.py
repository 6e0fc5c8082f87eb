#: Names that the operators use for columns of their own.
CLASHES = [
    "fp", "row", "key", "word", "bits", "shared", "n", "it", "place", "score", "size", "shard", "ids", "h", "v", "rank", "host",
]


def texts_of(folder, table="documents", key="doc_id", value="text"):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{folder}/{table}.parquet", columns=[key, value])
    return dict(zip(rows[key].to_pylist(), rows[value].to_pylist(), strict=True))
