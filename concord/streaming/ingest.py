"""Verdicts that arrive over time: packed per micro-batch, merged on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concord.operators.packed import pack, to_long
from concord.sources.packed import SCHEMA
from concord.sources.scratch import folder_of, foldered


def ingest_verdicts(arriving: DataFrame, sources: list[str], shard_bits: int, path: str, checkpoint: str, folder_bits: int = 0) -> StreamingQuery:
    """Pack every micro-batch of verdict rows (``word`` and a boolean per source) to ``path/batch=<id>``.

    A batch that is tried again overwrites its own folder, so blocks are neither lost nor doubled; bits of different
    batches meet by OR, which is the same in any order. With ``folder_bits`` ``2 ** folder_bits`` small shards share a folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        blocks = foldered(to_long(pack(batch, sources), sources, shard_bits), folder_bits)
        blocks.write.mode("overwrite").partitionBy(folder_of(folder_bits)).parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """``source, block, bits, shard`` over all batches so far."""
    rows = spark.read.schema(SCHEMA + ", batch long").parquet(path)
    return rows.groupBy("shard", "source", "block").agg(F.bit_or("bits").alias("bits")).select("source", "block", "bits", "shard")
