"""Shared storage, table access and arrow helpers of the operators."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deleted or split at by several contracts: space, tab, line feed, VT, FF, CR.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Python workers of a local session find the package where the driver does; on a
    # cluster it is installed or passed with --py-files.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is `spark.checkpoint.dir`; only where that is unset, as in a bare test session,
    a folder of the warehouse, which a cluster shares as well.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


class Stage:
    """A table written once to the shared folder.

    A written table cuts the lineage, so a lost executor costs the running tasks only,
    and every later pass sees the same rows. `drop()` removes it when no frame that
    still has to run reads it.
    """

    def __init__(self, df: DataFrame, codec: str = "zstd", partition_by: tuple[str, ...] = ()) -> None:
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/llm-{uuid.uuid4().hex}"
        writer = df.write.option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, codec: str = "zstd") -> DataFrame:
    return Stage(df, codec).read()


def plain_text(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id falls in fold 0 as crc32 of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


class Recent(dict):
    """A cache of two generations: `make` fills it, and at most twice `size` entries stay."""

    def __init__(self, make, size: int) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
