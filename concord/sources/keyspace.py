"""The domain of words as a DataFrame, and its shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.bits import shard_of


def key_space(spark: SparkSession, width: int, shard_bits: int, partitions: int | None = None) -> DataFrame:
    """``word, shard``: every word of ``[0, 2**width)`` once. Partitions hold whole shards in order, so packing by
    block needs no more than partial aggregation to shrink to its result."""
    shards = 1 << (width - shard_bits)
    n = partitions or min(shards, max(1, (1 << width) >> 22), 1 << 14)
    return spark.range(0, 1 << width, 1, n).select(F.col("id").alias("word"), shard_of(F.col("id"), shard_bits).alias("shard"))


def shard_bounds(spark: SparkSession, width: int, shard_bits: int) -> DataFrame:
    """``shard, start, end`` (end not included) of every shard that the domain has."""
    size = 1 << shard_bits
    return spark.range(1 << (width - shard_bits)).select(F.col("id").alias("shard"), (F.col("id") * size).alias("start"), ((F.col("id") + 1) * size).alias("end"))


def random_words(spark: SparkSession, n: int, seed: int, width: int) -> DataFrame:
    """``probe, word``: n pseudo-random words with replacement, the same for each seed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 8)
    return spark.range(n).select(F.col("id").alias("probe"), F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(1 << width)).alias("word"))
