"""Agreement of sources with the baseline: counts, micro and macro rates, text agreement, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.bits import all_of, bit_at, block_of, differing, popcount, xor
from concord.functions.classify import TEXT_CATEGORIES
from concord.operators.corpus import normalized_sources


def against_baseline(wide: DataFrame, sources: list[str], base: str) -> DataFrame:
    """``block, source, diff``: per source the mask of words on which it and the baseline differ."""
    rows = ", ".join(f"'{s}', {i}, (`{s}` ^ `{base}`)" for i, s in enumerate(sources))
    return wide.selectExpr("block", f"stack({len(sources)}, {rows}) as (source, source_seq, diff)")


def micro(wide: DataFrame, sources: list[str], base: str, n_words: int) -> DataFrame:
    """``source, disagreements, micro``: the rate over the whole domain. One pass, one row to the final aggregate per
    task."""
    sums = [F.sum(popcount(xor(F.col(s), F.col(base)))).alias(s) for s in sources]
    rows = ", ".join(f"'{s}', {i}, `{s}`" for i, s in enumerate(sources))
    counted = wide.agg(*sums).selectExpr(f"stack({len(sources)}, {rows}) as (source, source_seq, disagreements)")
    n = F.coalesce("disagreements", F.lit(0))
    return counted.select("source", "source_seq", n.alias("disagreements"), ((F.lit(float(n_words)) - n) / n_words).alias("micro"))


def macro(wide: DataFrame, sources: list[str], base: str, shards: DataFrame, shard_bits: int) -> DataFrame:
    """``source, macro``: the mean of the shards' rates. ``shards`` (``shard, n_words``) lists all shards, so that one
    without a stored block counts as fully agreeing, and shards may have different denominators."""
    sums = [F.sum(popcount(xor(F.col(s), F.col(base)))).alias(s) for s in sources]
    per_shard = wide.groupBy(F.shiftright("block", shard_bits - 6).alias("shard")).agg(*sums)
    rates = shards.join(per_shard, "shard", "left").select(*(F.avg((F.col("n_words") - F.coalesce(s, F.lit(0))) / F.col("n_words")).alias(s) for s in sources))
    rows = ", ".join(f"'{s}', `{s}`" for s in sources)
    return rates.selectExpr(f"stack({len(sources)}, {rows}) as (source, macro)")


def group_masks(words: DataFrame, group: str) -> DataFrame:
    """``group, block, bits``: the words of each group as masks of blocks, from rows ``word`` and the group's column."""
    return words.groupBy(F.col(group).alias("group"), block_of(F.col("word")).alias("block")).agg(F.bit_or(bit_at(F.col("word"))).alias("bits"))


def group_rates(wide: DataFrame, sources: list[str], base: str, masks: DataFrame) -> DataFrame:
    """``group, n_words, source, source_seq, disagreements, rate`` over groups of words that are no ranges, such as those of a
    rule. Masks of a block meet its verdicts, so no verdict is unpacked; a block that isn't stored agrees everywhere."""
    blocks = masks.join(wide.select("block", *sources, base), "block", "left")
    sums = [F.coalesce(F.sum(popcount(xor(F.col(s), F.col(base)).bitwiseAND(F.col("bits")))), F.lit(0)).alias(s) for s in sources]
    counted = blocks.groupBy("group").agg(F.sum(popcount(F.col("bits"))).alias("n_words"), *sums)
    rows = ", ".join(f"'{s}', {i}, `{s}`" for i, s in enumerate(sources))
    tall = counted.selectExpr("group", "n_words", f"stack({len(sources)}, {rows}) as (source, source_seq, disagreements)")
    return tall.withColumn("rate", (F.col("n_words") - F.col("disagreements")) / F.col("n_words"))


def macro_of_groups(rates: DataFrame) -> DataFrame:
    """``source, macro``: the unweighted mean of the groups' rates."""
    return rates.groupBy("source").agg(F.avg("rate").alias("macro"))


PRESENT = "_present"


def agreement(wide: DataFrame, sources: list[str], base: str, n_words: int, shard_bits: int) -> DataFrame:
    """``source, source_seq, disagreements, micro, macro`` from blocks that also have a bit for every word there is
    (``_present``): one aggregation per shard gives the counts, the shard's size and both rates."""
    sums = [F.sum(popcount(xor(F.col(s), F.col(base)))).alias(s) for s in sources]
    per_shard = wide.groupBy(F.shiftright("block", shard_bits - 6).alias("shard")).agg(*sums, F.sum(popcount(F.col(PRESENT))).alias("n"))
    both = [x for s in sources for x in (F.coalesce(F.sum(s), F.lit(0)).alias(f"{s}.d"), F.avg((F.col("n") - F.col(s)) / F.col("n")).alias(f"{s}.macro"))]
    rows = ", ".join(f"'{s}', {i}, `{s}.d`, `{s}.macro`" for i, s in enumerate(sources))
    stacked = per_shard.agg(*both).selectExpr(f"stack({len(sources)}, {rows}) as (source, source_seq, disagreements, macro)")
    return stacked.withColumn("micro", (F.lit(float(n_words)) - F.col("disagreements")) / n_words)


def ranked(metrics: DataFrame, rate: str = "micro") -> DataFrame:
    """Worst first, ties in the order of sources. One row per source."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(rate, "source_seq")))


def all_accept(wide: DataFrame, sources: list[str]) -> DataFrame:
    return wide.agg(F.coalesce(F.sum(popcount(all_of(*map(F.col, sources)))), F.lit(0)).alias("population"))


def disagreeing(wide: DataFrame, sources: list[str], shard_bits: int) -> DataFrame:
    """Words on which the sources aren't of one mind, and the shards that have any, from two levels of partial sums."""
    per_shard = wide.withColumn("d", popcount(differing(*map(F.col, sources)))).where("d > 0").groupBy(F.shiftright("block", shard_bits - 6).alias("shard")).agg(F.sum("d").alias("d"))
    return per_shard.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("disagreements"), F.count("*").alias("shards"))


def text_disagreements(corpus: DataFrame, sources: list[str], base: str, texts: str = "oracle_text", compare: str = "raw", has_text: dict[str, bool] | None = None, compiled: DataFrame | None = None) -> DataFrame:
    """``source, text_disagreements`` over records of text categories; texts are compared null-safe. One pass.

    ``compare="normalized"`` compares what the text rules (and ``compiled`` alias rules) make of both texts. Sources that
    ``has_text`` says have none of their own, but a mark that they accept, are left out.
    """
    if compare not in ("raw", "normalized"):
        raise ValueError(f"compare is raw or normalized, not {compare}")
    sources = [s for s in sources if (has_text or {}).get(s, True)]
    chosen = corpus.where(F.col("category").isin(*TEXT_CATEGORIES))
    if compare == "raw":
        of = lambda s: F.element_at(texts, s)
    else:
        apart = chosen.select(F.monotonically_increasing_id().alias("word"), *(F.element_at(texts, s).alias(s) for s in (*sources, base)))
        chosen, of = normalized_sources(apart, [*sources, base], compiled), lambda s: F.col(f"{s}_norm")
    sums = [F.count_if(~of(s).eqNullSafe(of(base))).alias(s) for s in sources]
    rows = ", ".join(f"'{s}', `{s}`" for s in sources)
    return chosen.agg(*sums).selectExpr(f"stack({len(sources)}, {rows}) as (source, text_disagreements)")


def text_agreement(counts: DataFrame, sample_size: int, population: int, mode: str = "sample") -> DataFrame:
    """Rate of text agreement: over the sample (default), or over the whole population as ``mode='reference'``."""
    n = {"sample": sample_size, "reference": population}[mode]
    rate = F.lit(1.0) if n == 0 else (F.lit(float(n)) - F.col("text_disagreements")) / n
    return counts.withColumn("text_agreement", rate)
