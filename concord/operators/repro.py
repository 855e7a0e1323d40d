"""A few diverse reproducers out of a corpus: caps per bucket, first-seen dedupe, preference, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.classify import TEXT_CATEGORIES, shown
from concord.sources.scratch import stored

ENCOUNTER = ("shard", "tier", "word")


def displays(corpus: DataFrame, sources: list[str]) -> DataFrame:
    """``corpus`` with ``show_<source>``: what each source says of the word."""
    return corpus.select("*", *(shown(F.element_at("oracle_text", s), F.element_at("oracle_valid", s)).alias(f"show_{s}") for s in sources))


def first_disagreeing(sources: list[str], base: str) -> Column:
    """The first source whose answer isn't the baseline's; null if there is none."""
    return F.coalesce(*(F.when(F.col(f"show_{s}") != F.col(f"show_{base}"), F.lit(s)) for s in sources))


def first_shards(corpus: DataFrame, k: int, at_least: int = 0) -> DataFrame:
    """Records of the k lowest shards that have any. The shard ids alone are ranked, not the records."""
    ids = corpus.where(F.col("shard") >= at_least).select("shard").distinct().orderBy("shard").limit(k)
    return corpus.join(F.broadcast(ids), "shard", "left_semi")


def capped(rows: DataFrame, cap: int, key: tuple[str, ...], order: tuple[str, ...] = ENCOUNTER) -> DataFrame:
    """The first ``cap`` rows of each key; Spark keeps no more than that per key and task before the exchange."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def first_seen(rows: DataFrame, key: str = "word", order: tuple[str, ...] = ENCOUNTER) -> DataFrame:
    return capped(rows, 1, (key,), order)


def greedy(rows: DataFrame, cap: int, key: tuple[str, ...], word: str = "word", order: tuple[str, ...] = ENCOUNTER) -> DataFrame:
    """What a loop over the rows in their order keeps that passes over rows of a word kept before and of a key that has
    ``cap`` kept ones. A row that its key turns away does not use up its word, so a later row of the word may be kept.

    Rounds to a fixpoint: of every key that isn't full the first rows that may still fill it are candidates, and those are
    kept before which no row of their word can be. All rows of kept words and full keys are out of the next round. The
    first row that is left is always kept, and a round keeps all that don't wait for another word's row, so there are as
    many rounds as such waits follow on each other. Only candidates, at most ``cap`` a key, and rows of their words meet.
    """
    named = stored(rows.withColumn("_key", F.struct(*key)).withColumn("_at", F.struct(*order, F.monotonically_increasing_id().alias("_row"))), "greedy-rows")
    left = named.select(F.col(word).alias("_word"), "_key", "_at")
    kept = left.limit(0)
    while True:
        filled = kept.groupBy("_key").agg(F.count("*").alias("_n"))
        open_ = left.join(kept.select("_word"), "_word", "left_anti").join(filled.where(F.col("_n") >= cap), "_key", "left_anti")
        place = F.row_number().over(Window.partitionBy("_key").orderBy("_at"))
        first = open_.withColumn("_place", place).where(F.col("_place") <= cap)  # no more of a key leave a task
        first = stored(first.join(filled, "_key", "left").where(F.col("_place") <= cap - F.coalesce("_n", F.lit(0))).select("_word", "_key", "_at"), "greedy-first")
        earliest = open_.join(first.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.min("_at").alias("_earliest"))
        found = stored(first.join(earliest, "_word").where(F.col("_at") == F.col("_earliest")).select("_word", "_key", "_at"), "greedy-kept")
        if found.isEmpty():
            return named.join(kept.select("_at"), "_at", "left_semi").drop("_key", "_at")
        kept = kept.unionByName(found)  # written parts, one a round


def chosen(corpus: DataFrame, sources: list[str], base: str, n: int = 10, cap: int = 2, pool: int = 200, shards: int = 5, at_least: int = 0, complete: bool = True) -> DataFrame:
    """``n`` records with ``tool`` (first disagreeing source), ``spec``, ``actual`` and ``rank`` from 0.

    Of the first shards the records that a loop keeps which takes each word once and at most ``cap`` per (category,
    baseline's answer), the first ``pool`` of these in encounter order; then preferred categories before VALIDITY. Fewer
    than ``n`` are an error, unless ``complete`` is false. The corpus is read twice, once for its shard ids alone, so it
    should be a written table.
    """
    rows = displays(first_shards(corpus, shards, at_least), [*sources, base]).withColumn("tool", first_disagreeing(sources, base)).where("tool is not null")
    spec = F.col(f"show_{base}").alias("spec")
    actual = F.coalesce(*(F.when(F.col("tool") == s, F.col(f"show_{s}")) for s in sources)).alias("actual")
    slim = rows.select("shard", "tier", "word", "category", spec, "tool", actual)
    kept = greedy(slim, cap, ("category", "spec")).orderBy(*ENCOUNTER).limit(pool)
    found = stored(preferred_first(kept, n), "reproducers")
    if complete and (m := found.count()) < n:
        raise ValueError(f"only {m} reproducers in the first {shards} shards, {n} are asked for: take more shards")
    return found


def preferred_first(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows with ``rank`` from 0: text categories before VALIDITY, then in encounter order."""
    order = (F.when(F.col("category").isin(*TEXT_CATEGORIES), 0).otherwise(1), *ENCOUNTER)
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)  # n rows


def render_reproducers(rows: DataFrame) -> DataFrame:
    """``file, text``: five header fields and a sentence."""
    text = F.format_string(
        "- word: %s\n- category: %s\n- tool: %s\n- spec: %s\n- actual: %s\n\nFor the word `%s` (%s) the baseline says `%s` and `%s` says `%s`. The word alone reproduces it.\n",
        "word", "category", "tool", "spec", "actual", "word", "category", "spec", "tool", "actual",
    )
    return rows.select(F.format_string("%02d-%s", "rank", "word").alias("file"), text.alias("text"))
