"""Content hashes of shards and of runs, independent of partitions and of file layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of one (shard, source) whose text is hashed as one piece.
CHUNK_BITS = 12


def _digest(df: DataFrame, by: tuple[str, ...], value: str, order: tuple[str, ...], out: str) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["_v"]), ""), 256).alias(out))


def content_hash(packed: DataFrame, sources: list[str]) -> DataFrame:
    """``shard, content_hash`` from stored blocks (``source, block, bits, shard``).

    Two levels: chunks of 4096 blocks of a source, then the chunks of a shard in the order of sources, so no group holds
    more than 4096 values or the chunks of one shard. Zero blocks are left out, so absent and zero are one.
    """
    seq = F.create_map(*(x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))))
    rows = packed.where("bits <> 0").select("shard", F.try_element_at(seq, F.col("source")).alias("seq"), F.shiftright("block", CHUNK_BITS).alias("chunk"), "block", F.concat_ws(":", F.hex("block"), F.hex("bits")).alias("v"))
    chunks = _digest(rows.where("seq is not null"), ("shard", "seq", "chunk"), "v", ("block",), "_h")
    chunks = chunks.withColumn("h", F.concat_ws(":", "seq", "chunk", "_h"))
    return _digest(chunks, ("shard",), "h", ("seq", "chunk"), "content_hash")


def result_hash(artifacts: DataFrame) -> DataFrame:
    """One hash over the hashes of artifacts (``seq, hash``) in order: of 4096 neighbouring numbers each, and of these."""
    parts = _digest(artifacts.withColumn("_part", F.shiftright("seq", CHUNK_BITS)), ("_part",), "hash", ("seq",), "_h")
    return parts.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_part", "_h"))), lambda r: r["_h"]), ""), 256).alias("result_hash"))
