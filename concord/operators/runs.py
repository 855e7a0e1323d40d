"""Shard records and resumable runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.hashing import content_hash
from concord.operators.packed import popcounts
from concord.sources.packed import read_packed, write_packed
from concord.sources.scratch import stored


def shard_records(packed: DataFrame, sources: list[str], bounds: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One record per shard of ``bounds``: counts per source, errors, content hash; complete without untriaged errors.

    ``errors`` has ``word-level`` rows ``shard, triaged``.
    """
    zero = F.lit(0).cast("long")
    wide = popcounts(packed, ("shard", "source")).groupBy("shard").agg(*(F.coalesce(F.max(F.when(F.col("source") == s, F.col("n_valid"))), zero).alias(s) for s in sources))
    counts = F.map_from_arrays(F.array(*map(F.lit, sources)), F.array(*(F.coalesce(s, zero) for s in sources)))
    out = bounds.join(wide, "shard", "left").join(content_hash(packed, sources), "shard", "left")
    if errors is None:
        out = out.withColumn("crash_count", zero).withColumn("untriaged_crash_count", zero)
    else:
        crashed = errors.groupBy("shard").agg(F.count("*").alias("crash_count"), F.count_if(~F.col("triaged")).alias("untriaged_crash_count"))
        out = out.join(crashed, "shard", "left").withColumn("crash_count", F.coalesce("crash_count", zero)).withColumn("untriaged_crash_count", F.coalesce("untriaged_crash_count", zero))
    status = F.when(F.col("untriaged_crash_count") == 0, F.lit("complete")).otherwise(F.lit("incomplete"))
    return out.select(F.col("shard").cast("int").alias("shard_id"), "start", "end", F.array(*map(F.lit, sources)).alias("sources"), counts.alias("valid_counts"), "crash_count", "untriaged_crash_count", F.coalesce("content_hash", F.sha2(F.lit(""), 256)).alias("content_hash"), zero.alias("duration_ms"), status.alias("status"))


def stored_counts(packed: DataFrame, sources: list[str]) -> DataFrame:
    """``shard_id, valid_counts`` as the stored blocks have them."""
    zero = F.lit(0).cast("long")
    sums = [F.sum(F.when(F.col("source") == s, F.bit_count("bits").cast("long")).otherwise(zero)).alias(s) for s in sources]
    return packed.groupBy(F.col("shard").cast("int").alias("shard_id")).agg(*sums)


def complete_shards(records: DataFrame, packed: DataFrame, sources: list[str]) -> DataFrame:
    """Shards recorded as complete whose stored blocks still have the recorded counts."""
    found = stored_counts(packed, sources)
    same = [F.coalesce(F.element_at("valid_counts", s), F.lit(0)) == F.coalesce(s, F.lit(0)) for s in sources]
    good = records.where("status = 'complete'").join(found, "shard_id", "left")
    for test in same:
        good = good.where(test)
    return good.select(F.col("shard_id").cast("long").alias("shard"))


def shards_to_do(bounds: DataFrame, records: DataFrame, packed: DataFrame, sources: list[str]) -> DataFrame:
    return bounds.join(complete_shards(records, packed, sources), "shard", "left_anti")


def resume(bounds: DataFrame, records: DataFrame, sweep: Callable[[DataFrame], DataFrame], path: str, sources: list[str], folder_bits: int = 0) -> DataFrame:
    """Process what isn't complete: ``sweep`` makes stored rows of the shards to do; only these are overwritten, also
    those that ``sweep`` gives no row.

    Returns fresh records of those shards.
    """
    spark = bounds.sparkSession
    # the list of shards is written down before the store changes under it
    todo = stored(shards_to_do(bounds, records, read_packed(spark, path), sources), "todo")
    write_packed(sweep(todo), path, todo, folder_bits)
    done = read_packed(spark, path).join(F.broadcast(todo.select("shard")), "shard", "left_semi")
    return shard_records(done, sources, todo)


def verify_shard(records: DataFrame, fresh: DataFrame, sources: list[str]) -> DataFrame:
    """``shard_id, recorded, recomputed, same`` for the shards of ``fresh`` stored rows, which are only read."""
    found = content_hash(fresh, sources).select(F.col("shard").cast("int").alias("shard_id"), F.col("content_hash").alias("recomputed"))
    both = records.select("shard_id", F.col("content_hash").alias("recorded")).join(found, "shard_id", "right")
    return both.withColumn("same", F.col("recorded").eqNullSafe(F.col("recomputed")))
