"""Packed verdicts on storage: Parquet by shard, and import of raw little-endian bit slices."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.sources.scratch import FOLDER, folder_of, foldered, stored

SCHEMA = "source string, block long, bits long, shard long"
#: Blocks that one output row batch of an imported slice has.
BATCH = 1 << 16


def write_packed(packed: DataFrame, path: str, shards: DataFrame | None = None, folder_bits: int = 0) -> None:
    """Write ``source, block, bits, shard`` by shard; only the shards that occur are replaced, concurrent ones stay.

    ``shards`` (``shard``) are replaced even if they come out without any row: a row without bits stands for them. With
    ``folder_bits``, which a store keeps for good, ``2 ** folder_bits`` small shards share a folder. What the folder holds of
    other shards is written along, so two writers must not be at one folder at once.
    """
    rows = packed.select("source", "block", "bits", "shard").where("bits <> 0")
    if shards is not None:
        rows = rows.union(shards.selectExpr("cast(null as string)", "cast(null as long)", "0L", "cast(shard as long)"))
    if folder_bits and (old := _existing(packed.sparkSession, path)) is not None:
        rows = stored(rows, "replacing")
        new = rows.select("shard").distinct()
        folders = new.select(F.shiftright("shard", folder_bits).alias(FOLDER)).distinct()
        rows = rows.unionByName(old.join(folders, FOLDER, "left_semi").join(new, "shard", "left_anti").drop(FOLDER))
    spread = foldered(rows, folder_bits).sortWithinPartitions(folder_of(folder_bits), "shard", "source", "block")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(folder_of(folder_bits)).parquet(path)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{SCHEMA}, {FOLDER} long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_packed(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """Stored blocks; a block that isn't stored is all zero. ``shards`` prunes folders, or ranges of rows in them."""
    found = spark.read.schema(SCHEMA).parquet(path).drop(FOLDER).where("bits <> 0")
    return found if shards is None else found.where(F.col("shard").isin(shards))


def import_bitmap_slices(spark: SparkSession, path: str, name: str = r"([^/]+)-(\d+)\.bin$", shard_bits: int = 24) -> DataFrame:
    """Blocks of raw slices, named ``<source>-<shard>.bin``."""
    files = spark.read.format("binaryFile").load(path)
    return decode_slices(files.select(F.regexp_extract("path", name, 1).alias("source"), F.regexp_extract("path", name, 2).cast("long").alias("shard"), "content"), shard_bits)


def decode_slices(slices: DataFrame, shard_bits: int = 24) -> DataFrame:
    """Blocks of ``source, shard, content`` rows: bit i of the content is word i of the shard, lowest bit first.

    Eight bytes as a little-endian long are one block. Rows of zero blocks are left out.
    """

    def run(batches) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for source, shard, content in pdf.itertuples(index=False):
                content = content + bytes(-len(content) % 8)
                bits = np.frombuffer(content, "<i8")
                at = np.flatnonzero(bits)
                first = int(shard) << (shard_bits - 6)
                for lo in range(0, len(at), BATCH):
                    part = at[lo : lo + BATCH]
                    yield pd.DataFrame({"source": source, "block": first + part, "bits": bits[part], "shard": int(shard)})

    return slices.mapInPandas(run, SCHEMA)
