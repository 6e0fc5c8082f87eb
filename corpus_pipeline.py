"""From raw documents to packed training windows.

Each stage reads what the one before has written. The first three drop rows and keep
the columns of `documents`; the last gives the pieces of the windows.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from autolens.llm.common import Stage, table  # noqa: E402
from autolens.llm.exact_dedup import drop_copies  # noqa: E402
from autolens.llm.packing import pack  # noqa: E402
from autolens.llm.queries import BYTE_TOKENIZER  # noqa: E402
from autolens.llm.simhash import keep_one  # noqa: E402
from autolens.llm.toxicity import drop_toxic  # noqa: E402


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (0.8 of the shingles of five words) stays."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the windows that hold what is left."""
    return pack(docs, BYTE_TOKENIZER)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Training a classifier and merging byte pairs are no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, function in STAGES:
        after = Stage(function(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        docs, before = after.read(), after
    return docs
