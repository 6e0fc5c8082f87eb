"""Exact deduplication by progressive refinement, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Stage, plain_text

#: Characters of the prefix hash.
PREFIX = 64
#: What survives a round is passed on as a bit map of so many bits: 2 MB at most,
#: whatever the size of the input.
MAP_BITS = 24


def normalized(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def _word(key: Column) -> Column:
    return F.shiftright(F.pmod(key, F.lit(1 << MAP_BITS)), 6)


def _bit(key: Column) -> Column:
    place = F.pmod(key, F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def _shared_keys(rows: DataFrame, *by: str) -> Stage:
    """The keys of more than one row, as `(word, bits)` of a bit map.

    Two keys may meet in a bit; that sends a row into the next round without need and
    changes no group. Only counts and words leave a task.
    """
    counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.col("key")
    return Stage(counted.groupBy(_word(key).alias("word")).agg(F.bit_or(_bit(key)).alias("bits")))


def _survives(rows: DataFrame, shared: Stage) -> DataFrame:
    """`rows` with the flag `shared`: whether the bit of `key` is set."""
    bits = shared.read()
    return (
        rows.withColumn("word", _word(F.col("key"))).join(F.broadcast(bits), "word", "left")
        .withColumn("shared", F.coalesce(F.col("bits").bitwiseAND(_bit(F.col("key"))) != 0, F.lit(False)))
        .drop("word", "bits")
    )


def refine(docs: DataFrame, digest_all: bool = False, carry: bool = False) -> Stage:
    """One row per document: `row, doc_id, points, sha256, shared` and, with `carry`, the
    document itself as the struct `it`.

    Round 1 groups by the length of the normalised text, round 2 what shares a length
    by a hash of its first characters, round 3 reads in full what shares both, for a
    SHA-256. Rows that a round leaves alone are unique; they have a digest only with
    `digest_all`. `row` numbers the rows of the written table.
    """
    text = plain_text()
    body = normalized(text).alias("body")
    sized = docs.select(F.octet_length(body).cast("bigint").alias("key"))
    lengths = _shared_keys(sized, "key")
    head = F.xxhash64(F.octet_length("body"), F.substring("body", 1, PREFIX))
    heads = _survives(
        docs.select(body).withColumn("key", F.octet_length("body").cast("bigint")), lengths
    ).where("shared").select(head.alias("key"))
    prefixes = _shared_keys(heads, "key")
    whole = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.length(text).cast("bigint").alias("points"), body,
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("it")] if carry else []),
    )
    whole = _survives(whole.withColumn("key", F.octet_length("body").cast("bigint")), lengths)
    whole = _survives(whole.withColumnRenamed("shared", "by_length").withColumn("key", head), prefixes)
    shared = F.col("by_length") & F.col("shared")
    digest = F.sha2("body", 256)
    found = Stage(
        whole.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", "points",
            (digest if digest_all else F.when(shared, digest)).alias("sha256"), shared.alias("shared"),
            *(["it"] if carry else []),
        )
    )
    lengths.drop()
    prefixes.drop()
    return found


def groups(found: DataFrame) -> DataFrame:
    """`sha256, keep_id, keep_row, n` for each digest that rounds 1 and 2 let through.

    The most code points stay, then the smallest doc_id (null last), then the first row.
    """
    order = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    return (
        found.where("shared").groupBy("sha256").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
        .select("sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")
    )


def exact_groups(docs: DataFrame, digest_all: bool = False) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)`, one row per input row.

    Texts are equal when they are identical without the characters space and
    U+0009-U+000D. Null counts as empty, and empty texts are equal to each other. Of
    equal texts the one with the most code points stays, then the smallest doc_id, a
    null doc_id last; of rows that also share the doc_id, the first of the input, so
    exactly one row of a group is `kept`. Extra columns are ignored; an empty table
    gives no rows. Every task sums its own rows of a group first, and the join back is
    one that Spark splits where a group is very large.
    """
    found = refine(docs, digest_all).read()
    best = groups(found).where("n > 1")
    return found.join(best, "sha256", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that `exact_groups` does not keep; all columns stay.

    Rows that are unique by length or prefix pass without a shuffle; of the others the
    kept rows are picked by their number.
    """
    found = refine(docs, carry=True).read()
    kept = groups(found).select(F.col("keep_row").alias("row"))
    alone = found.where("NOT shared").select("it.*")
    return alone.unionByName(found.where("shared").join(kept, "row", "left_semi").select("it.*"))
