"""Seeded uniform samples that don't depend on partitions, and what they were taken from, in one pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.sources.scratch import stored


def sample_key(seed: int, word: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), word.cast("string")))


def bottom_k(df: DataFrame, k: int, seed: int, key: str = "word") -> DataFrame:
    """The sketch of each task: its ``k`` rows of smallest hashed key (``_h``), and one row with only ``_seen``, how many rows
    it read. Sketches merge: the ``k`` smallest of all of them are the ``k`` smallest of all rows, and the counts add up.

    A task holds up to ``2 k`` rows and a batch.
    """
    hashed = df.withColumn("_h", sample_key(seed, F.col(key)))
    names = hashed.columns

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held, seen, limit, schema = None, 0, None, None
        order = [("_h", "ascending"), (key, "ascending")]
        for batch in batches:
            schema = batch.schema
            seen += len(batch)
            rows = pa.Table.from_batches([batch])
            if limit is not None:
                rows = rows.filter(pc.less_equal(rows.column("_h"), limit))
            held = rows if held is None else pa.concat_tables([held, rows])
            if len(held) > 2 * k:
                held = held.take(pc.sort_indices(held, order)[:k])
                limit = held.column("_h")[-1] if k else limit
        if schema is None:
            return
        kept = held.take(pc.sort_indices(held, order)[:k])
        out = pa.schema([f.with_nullable(True) for f in schema.append(pa.field("_seen", pa.int64()))])
        columns = [c.combine_chunks() for c in kept.columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(kept), pa.int64())], schema=out)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in schema), pa.array([seen])], schema=out)

    nullable = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema.fields)
    return hashed.select(*names).mapInArrow(run, f"{nullable}, _seen long")


def sampled(df: DataFrame, k: int, seed: int, key: str = "word") -> tuple[DataFrame, DataFrame]:
    """``k`` rows, uniform and the same for a seed, and their report (``population, sample_size``), from one pass over ``df``.

    The tasks' sketches are written; what is read after is these. The population that they counted gives a hash below which
    about ``k`` rows are to be expected, with a margin of six deviations, so that the last sort has hardly more than those.
    """
    sketch = stored(bottom_k(df, k, seed, key), "sample-sketch")
    rows = sketch.where("_seen is null").drop("_seen")
    counted = sketch.agg(F.coalesce(F.sum("_seen"), F.lit(0)).alias("population"))
    population = counted.first()["population"]
    margin = k + 6 * math.isqrt(k) + 10
    if margin < population:
        few = rows.where(F.substring("_h", 1, 8) <= f"{margin * (1 << 32) // population:08x}")
        if few.limit(k).count() == k:
            rows = few
    report = counted.select("population", F.least("population", F.lit(k)).alias("sample_size"))
    return rows.orderBy("_h", key).limit(k).drop("_h"), report


def seeded_sample(df: DataFrame, k: int, seed: int, key: str = "word") -> DataFrame:
    """k rows, uniform and the same for a seed: those of smallest hashed key."""
    return sampled(df, k, seed, key)[0]


def shard_pick(shards: DataFrame, seed: int) -> DataFrame:
    """One seeded shard."""
    return seeded_sample(shards, 1, seed, "shard")
