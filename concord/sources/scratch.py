"""Fresh folders for tables that are written and read again, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column of folders that hold many small shards.
FOLDER = "folder"


def folder_of(folder_bits: int) -> str:
    """The column that names folders: each shard has its own, or ``2 ** folder_bits`` neighbouring ones share one."""
    return FOLDER if folder_bits else "shard"


def foldered(df: DataFrame, folder_bits: int, *more: Column) -> DataFrame:
    """Rows of ``shard`` dealt by folder (and ``more``), so that a folder gets no more files than needed."""
    named = df.withColumn(FOLDER, F.shiftright(F.col("shard").cast("long"), folder_bits)) if folder_bits else df
    return named.repartition(folder_of(folder_bits), *more)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, gets a temporary folder where that is unset; on a cluster each
    executor would write to a disk of its own, so there it is an error.
    """
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="concord-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
