"""The corpus of disagreements: verdict-tier and text-tier records, histograms, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.alias import apply_aliases
from concord.functions.bits import get_bit, popcount, shard_of, word_text
from concord.functions.classify import record_category
from concord.functions.text import ALL_RULES, normalize_text
from concord.operators.packed import unpack
from concord.sources.records import FORMAT_VERSION


def record(word: Column, category: Column, valid: Column, text: Column, shard_bits: int, tier: int) -> list[Column]:
    return [F.lit(FORMAT_VERSION).alias("format_version"), word_text(word).alias("word"), category.alias("category"), valid.alias("oracle_valid"), text.alias("oracle_text"), shard_of(word, shard_bits).alias("shard"), F.lit(tier).alias("tier")]


def verdict_tier(blocks: DataFrame, sources: list[str], shard_bits: int) -> DataFrame:
    """A VALIDITY record for every word of the mask ``differ``; only those words become rows."""
    rows = unpack(blocks, "differ", tuple(sources))
    valid = F.map_from_arrays(F.array(*map(F.lit, sources)), F.array(*(get_bit(F.col(s), F.col("word")) for s in sources)))
    texts = F.map_from_arrays(F.array(*map(F.lit, sources)), F.array_repeat(F.lit(None).cast("string"), len(sources)))
    return rows.select(*record(F.col("word"), F.lit("VALIDITY"), valid, texts, shard_bits, 0))


def normalized_sources(texts: DataFrame, sources: list[str], compiled: DataFrame | None = None) -> DataFrame:
    """``texts`` (``word`` and a text column per source) with ``<source>_norm`` and ``<source>_rules``."""
    for s in sources:
        texts = normalize_text(texts, s, f"{s}_norm", f"{s}_rules")
        if compiled is not None:
            texts = apply_aliases(texts, compiled, f"{s}_norm", f"{s}_rules")
    return texts


def text_tier(texts: DataFrame, sources: list[str], comparable: list[str], shard_bits: int, compiled: DataFrame | None = None) -> DataFrame:
    """A record for every word whose comparable sources aren't all equivalent, of its worst pair's category.

    Sources that only say that they accept are shown in the record but not compared.
    """
    rows = normalized_sources(texts, comparable, compiled)
    category = record_category([(F.col(s), F.col(f"{s}_norm")) for s in comparable])
    names = F.array(*map(F.lit, sources))
    valid, text = F.map_from_arrays(names, F.array(*(F.col(s).isNotNull() for s in sources))), F.map_from_arrays(names, F.array(*map(F.col, sources)))
    # exploded, as a filter on a plain column would be pushed below the normalized texts and compute them once more
    return rows.withColumn("_category", F.explode(F.array(category))).where("_category is not null").select(*record(F.col("word"), F.col("_category"), valid, text, shard_bits, 1))


def merged(verdicts: DataFrame, texts: DataFrame) -> DataFrame:
    """Both tiers as one bag; ``tier`` orders the verdict tier first in a shard."""
    return verdicts.unionByName(texts)


def category_histogram(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("category").agg(F.count("*").alias("n"))


def tier_histogram(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """The same from the parts of the corpus, without a row for every differing word: bits of the mask ``differ``, and the
    records of the text tier."""
    n = blocks.agg(F.coalesce(F.sum(popcount(F.col("differ"))), F.lit(0)).alias("n"))
    both = n.where("n > 0").select(F.lit("VALIDITY").alias("category"), "n").union(category_histogram(texts))
    return both.groupBy("category").agg(F.sum("n").alias("n"))


def totals(corpus: DataFrame) -> DataFrame:
    """Records and shards. Shards are counted after a partial aggregation per shard."""
    return corpus.groupBy("shard").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("shards"))


def rule_counts(normalized: DataFrame, trace: str = "applied_rules", result: str = "normalized", expected: str = "expected") -> DataFrame:
    """``rule, n`` for every declared rule, also those that never applied, with the numbers of comparisons and of
    texts that became what was expected. Unknown names in the trace are ignored."""
    spark = normalized.sparkSession
    declared = spark.createDataFrame([(i, r) for i, r in enumerate(ALL_RULES)], "rule_seq int, rule string")
    sums = [F.count_if(F.array_contains(trace, r)).alias(r) for r in ALL_RULES]
    counted = normalized.agg(F.count("*").alias("comparisons"), F.count_if(F.col(result).eqNullSafe(F.col(expected))).alias("collapsed"), *sums)
    rows = ", ".join(f"'{r}', `{r}`" for r in ALL_RULES)
    per_rule = counted.selectExpr("comparisons", "collapsed", f"stack({len(ALL_RULES)}, {rows}) as (rule, n)")
    return F.broadcast(declared).join(per_rule, "rule").select("rule", "n", "comparisons", "collapsed")


def unexercised(normalized: DataFrame, trace: str = "applied_rules") -> DataFrame:
    """Declared rules that never changed a text."""
    declared = normalized.sparkSession.createDataFrame([(r,) for r in ALL_RULES], "rule string")
    return declared.join(normalized.select(F.explode(trace).alias("rule")).distinct(), "rule", "left_anti")


def source_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of sources (by ``seq``) for each word from long rows ``word, seq, source, text``: an equi-join on the word;
    a word has as many rows as there are sources."""
    a = texts.select("word", F.col("seq").alias("seq_a"), F.col("source").alias("source_a"), F.col("text").alias("text_a"))
    b = texts.select("word", F.col("seq").alias("seq_b"), F.col("source").alias("source_b"), F.col("text").alias("text_b"))
    return a.join(b, "word").where("seq_a < seq_b")
