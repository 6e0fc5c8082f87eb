"""The operators over the tables of a folder, one query each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .cross_tokens import alignment
from .exact_dedup import exact_groups
from .huffman import round_trip
from .licenses import license_passages
from .packing import pack
from .sentencepiece_bpe import digests
from .sharding import shard_report
from .simhash import near_components
from .substring_dedup import repeat_report
from .topk import top_k
from .toxicity import toxicity
from .url_filter import verdicts
from .whitening import whiten

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_components(table(spark, folder, "documents"), words=3)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), BYTE_TOKENIZER)


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(table(spark, folder, "pages"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"), PIECE_MODEL)


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return license_passages(table(spark, folder, "documents"))


def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), WORD_TOKENIZER)


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(table(spark, folder, "documents"), digest_all=True)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return shard_report(table(spark, folder, "documents"))


def op11_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeat_report(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment(table(spark, folder, "documents"), BYTE_TOKENIZER, PIECE_MODEL)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk, op2_simhash, op3_packing, op4_url_filter, op5_sentencepiece, op6_licenses, op7_token_files,
        op8_exact_dedup, op9_toxicity, op10_sharding, op11_repeats, op12_whitening, op13_alignment,
    )
}
