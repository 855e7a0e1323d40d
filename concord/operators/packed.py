"""Verdicts packed to one long per 64 words: packing, alignment of sources, counts, unpacking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.bits import all_of, any_of, bit_at, block_of, differing, existing, none_of, popcount, words_in


def pack(verdicts: DataFrame, sources: list[str]) -> DataFrame:
    """``block`` and one long per source from rows of ``word`` and a boolean per source.

    One pass and one exchange for all sources. Rows of a block mostly share a partition when the domain is cut in
    ranges, so the partial aggregation leaves about one row per block.
    """
    bit, zero = bit_at(F.col("word")), F.lit(0).cast("long")
    return verdicts.groupBy(block_of(F.col("word")).alias("block")).agg(*(F.bit_or(F.when(F.col(s), bit).otherwise(zero)).alias(s) for s in sources))


def to_long(wide: DataFrame, sources: list[str], shard_bits: int) -> DataFrame:
    """``source, block, bits, shard`` rows, the stored form, zero blocks left out."""
    stacked = ", ".join(f"'{s}', `{s}`" for s in sources)
    return wide.selectExpr("block", f"stack({len(sources)}, {stacked}) as (source, bits)").where("bits <> 0").select("source", "block", "bits", F.shiftright("block", shard_bits - 6).alias("shard"))


def align_sources(packed: DataFrame, sources: list[str]) -> DataFrame:
    """Wide blocks from stored rows: one pivoting aggregation instead of a chain of outer joins; absent is 0."""
    zero = F.lit(0).cast("long")
    return packed.groupBy("block").agg(*(F.bit_or(F.when(F.col("source") == s, F.col("bits")).otherwise(zero)).alias(s) for s in sources))


def completed(wide: DataFrame, sources: list[str], n_words: int) -> DataFrame:
    """``wide`` with every block of the domain ``[0, n_words)``; those that weren't there are zero."""
    every = wide.sparkSession.range((n_words + 63) >> 6).withColumnRenamed("id", "block")
    return every.join(wide.select("block", *sources), "block", "full").select("block", *(F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in sources))


def popcounts(packed: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    return packed.groupBy(*by).agg(F.sum(popcount(F.col("bits"))).alias("n_valid"))


def set_masks(wide: DataFrame, sources: list[str], n_words: int) -> DataFrame:
    """``block`` with the masks of words accepted by all, by some, by none, and of those that the sources differ on."""
    masks = [F.col(s) for s in sources]
    return wide.select("*", all_of(*masks).alias("by_all"), any_of(*masks).alias("by_some"), none_of(*masks, tail=existing(F.col("block"), n_words)).alias("by_none"), differing(*masks).alias("differ"))


def unpack(blocks: DataFrame, mask: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per set bit of ``mask``; blocks without any go before the explode."""
    return blocks.where(F.col(mask) != 0).select(F.explode(words_in(F.col("block"), F.col(mask))).alias("word"), *keep)


def confusion(wide: DataFrame, sources: list[str], base: str, n_words: int) -> DataFrame:
    """Per source: both valid, both invalid, valid against the baseline, invalid against it. Blocks that aren't stored
    count as both invalid."""
    sums = []
    for s in sources:
        a, b = F.col(s), F.col(base)
        sums += [F.sum(popcount(a.bitwiseAND(b))).alias(f"{s}.tp"), F.sum(popcount(a.bitwiseAND(F.bitwise_not(b)))).alias(f"{s}.fp"), F.sum(popcount(b.bitwiseAND(F.bitwise_not(a)))).alias(f"{s}.fn")]
    rows = ", ".join(f"'{s}', `{s}.tp`, `{s}.fp`, `{s}.fn`" for s in sources)
    stacked = wide.agg(*sums).selectExpr(f"stack({len(sources)}, {rows}) as (source, both_valid, false_positive, false_negative)")
    return stacked.withColumn("both_invalid", F.lit(n_words) - F.col("both_valid") - F.col("false_positive") - F.col("false_negative"))


def co_acceptance(wide: DataFrame, sources: list[str]) -> DataFrame:
    """``a, b, n``: words that both accept, for a before b, and each source's own count as (a, a)."""
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i:]]
    sums = [F.sum(popcount(F.col(a).bitwiseAND(F.col(b)))).alias(f"{a}.{b}") for a, b in pairs]
    rows = ", ".join(f"'{a}', '{b}', `{a}.{b}`" for a, b in pairs)
    return wide.agg(*sums).selectExpr(f"stack({len(pairs)}, {rows}) as (a, b, n)")


def accepted_kinds(verdicts: DataFrame, sources: list[str]) -> DataFrame:
    """``kind, word``, the row form: words accepted by all (intersection), by some (union), by none (difference to the domain).

    One pass and one exchange; rows of a word, if it has several, are taken together.
    """
    each = verdicts.groupBy("word").agg(*(F.coalesce(F.bool_or(s), F.lit(False)).alias(s) for s in sources))
    every, some = reduce(lambda a, b: a & b, map(F.col, sources)), reduce(lambda a, b: a | b, map(F.col, sources))
    kinds = F.array_compact(F.array(F.when(every, F.lit("by_all")), F.when(some, F.lit("by_some")), F.when(~some, F.lit("by_none"))))
    return each.select(F.explode(kinds).alias("kind"), "word")


def accepted_sets(verdicts: DataFrame, sources: list[str]) -> dict[str, DataFrame]:
    """``accepted_kinds`` apart by kind; each of them is a pass over the verdicts."""
    kinds = accepted_kinds(verdicts, sources)
    return {k: kinds.where(F.col("kind") == k).select("word") for k in ("by_all", "by_some", "by_none")}
