"""Whole questions: which source agrees least, where do sources disagree, and is what was published true."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.agree import PRESENT, agreement, ranked
from concord.operators.corpus import merged, text_tier, verdict_tier
from concord.operators.packed import pack, set_masks


def agreement_ranking(verdicts: DataFrame, sources: list[str], base: str, n_words: int, shard_bits: int) -> DataFrame:
    """``source, disagreements, micro, macro, rank``, worst first, from one pass: verdicts are read, packed and counted once."""
    wide = pack(verdicts.withColumn(PRESENT, F.lit(True)), [*sources, base, PRESENT])
    return ranked(agreement(wide, sources, base, n_words, shard_bits)).drop("source_seq")


def disagreement_corpus(verdicts: DataFrame, texts: DataFrame, sources: list[str], comparable: list[str], n_words: int, shard_bits: int, compiled: DataFrame | None = None) -> DataFrame:
    """Both tiers: every word with differing verdicts, and every sampled text record that isn't equivalent."""
    blocks = set_masks(pack(verdicts, sources), sources, n_words)
    return merged(verdict_tier(blocks, sources, shard_bits), text_tier(texts, sources, comparable, shard_bits, compiled))
