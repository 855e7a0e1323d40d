"""Data-quality checks. Each gives one row (check_id, passed, reason, evidence, measured) and fails closed."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions.bits import bit_at, block_of, existing, parse_word, popcount
from concord.functions.classify import TAXONOMY, shown
from concord.functions.text import ALIAS_RULE
from concord.operators.agree import micro, ranked, text_disagreements
from concord.operators.corpus import rule_counts, unexercised
from concord.operators.hashing import result_hash
from concord.operators.packed import unpack
from concord.operators.rules import classify_words, tiling_summary
from concord.operators.runs import verify_shard
from concord.sources.records import CORRUPT, FORMAT_VERSION
from concord.sources.scratch import stored

SCHEMA = "check_id string, passed boolean, reason string, evidence map<string,string>, measured map<string,string>"
EXAMPLES = 10
#: Words (with their shards) that are broadcast to pick records of a corpus.
FEW_KEYS = 1_000_000


def verdict(check_id: str, facts: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """The check's row from one row of facts: the first failing test is the reason; a null test fails."""
    good = [F.coalesce(t, F.lit(False)) for _, t in tests]
    reason = F.coalesce(*(F.when(~g, F.lit(name)) for (name, _), g in zip(tests, good, strict=True)), F.lit("ok"))
    evidence = F.create_map(*(x for (name, _), g in zip(tests, good, strict=True) for x in (F.lit(name), g.cast("string"))))
    measured = F.create_map(*(x for c in facts.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))
    return facts.select(F.lit(check_id).alias("check_id"), reduce(lambda a, b: a & b, good).alias("passed"), reason.alias("reason"), evidence.alias("evidence"), measured.alias("measured"))


def closed(spark: SparkSession, check_id: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The check's row, made now, or a failed row.

    The check is an action of its own: what its inputs raise while they are planned or while tasks read them (absent or
    broken files, records of an unknown version) fails this check alone, as does a check that gives no row or several.
    """
    try:
        rows = make().limit(2).collect()  # one row
    except Exception as e:  # whatever it is, the check has not passed
        condition = e.getCondition() if isinstance(e, PySparkException) else None
        rows = [(check_id, False, f"input: {type(e).__name__}", {"error": condition or str(e)[:200]}, {})]
    if len(rows) != 1:
        rows = [(check_id, False, "no result", {"rows": "none" if not rows else "several"}, {})]
    return spark.createDataFrame(rows, SCHEMA)


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), rows)


def coverage_gaps(blocks: DataFrame, corpus: DataFrame, probes: DataFrame, shard_bits: int) -> DataFrame:
    """``shard, word``: probed words that truly disagree and have no VALIDITY record in their shard. ``blocks`` has the mask ``differ``.

    Probes and records meet as masks of 64 words; only words that lack a record become rows. Of the corpus only blocks with
    probed words move, as these are broadcast up to FEW_KEYS.
    """
    asked = probes.groupBy(block_of(F.col("word")).alias("block")).agg(F.bit_or(bit_at(F.col("word"))).alias("asked"))
    true = asked.join(blocks.select("block", "differ"), "block").groupBy("block").agg(F.bit_or(F.col("asked").bitwiseAND(F.col("differ"))).alias("wanted"))
    true = stored(true.where("wanted <> 0"), "probes")
    word = F.col("word")
    own = F.when(F.col("shard").cast("long") == F.shiftright(word, shard_bits), bit_at(word))  # no filter, which would parse the word once more
    records = corpus.where("category = 'VALIDITY'").select("shard", parse_word(word).alias("word")).select(block_of(word).alias("block"), own.alias("bit"))
    known = of_keys(records, true, "block").groupBy("block").agg(F.coalesce(F.bit_or("bit"), F.lit(0)).cast("long").alias("known"))
    lacking = true.join(known, "block", "left").select("block", F.col("wanted").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long")))).alias("lacking"))
    return unpack(lacking, "lacking").select(F.shiftright("word", shard_bits).alias("shard"), "word")


def of_keys(corpus: DataFrame, keys: DataFrame, *by: str) -> DataFrame:
    """Rows of the keys ``by`` of a written table; it is broadcast if it has no more than FEW_KEYS rows."""
    ids = keys.select(*by)
    return corpus.join(F.broadcast(ids) if ids.count() <= FEW_KEYS else ids, list(by), "left_semi")


def examples(gaps: DataFrame, n: int | None = None) -> DataFrame:
    """The first rows by word."""
    return gaps.orderBy("word").limit(n or EXAMPLES)


def missing_shards(records: DataFrame, bounds: DataFrame) -> DataFrame:
    return bounds.join(records.select(F.col("shard_id").cast("long").alias("shard")), "shard", "left_anti")


def wrong_bounds(records: DataFrame, bounds: DataFrame) -> DataFrame:
    want = bounds.select("shard", F.col("start").alias("want_start"), F.col("end").alias("want_end"))
    return records.join(want, records["shard_id"].cast("long") == want["shard"], "left").where(~(F.col("start").eqNullSafe(F.col("want_start")) & F.col("end").eqNullSafe(F.col("want_end"))))


def shard_gaps(records: DataFrame) -> DataFrame:
    """Records that don't start where the one before ends.

    The one before is looked up among 4096 neighbouring shards; the first of these takes the last of the ranges before, of which
    there is a row each.
    """
    ranged = records.withColumn("_range", F.shiftright("shard_id", 12))
    ends = ranged.groupBy("_range").agg(F.max_by("end", "shard_id").alias("_last"))
    carried = ends.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_carried"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("_range").orderBy("shard_id")), "_carried")
    return ranged.join(carried, "_range").withColumn("before", before).where("before is not null and before <> start").drop("_range", "_carried")


def lookups(claims: DataFrame, corpus: DataFrame, shard_bits: int, sources: list[str], base: str) -> DataFrame:
    """``claims`` (reproducers) with what the record of their word shows, ``problems`` (all that is wrong, in the order of
    the tests) and ``problem``, the first of these or null.

    The word's first record of the claimed category counts, else its first. Only records of claimed words are ordered, as the
    claims are broadcast up to FEW_KEYS.
    """
    claims = stored(claims, "claims")
    keyed = claims.withColumn("shard", F.shiftright(parse_word(F.col("word")), shard_bits))
    of_claims = stored(of_keys(corpus, keyed.select("shard", "word").distinct(), "shard", "word").select("shard", "word", "category", "tier", "oracle_text", "oracle_valid"), "claimed")  # of one pass
    record = F.struct(F.col("category").alias("found"), "oracle_text", "oracle_valid")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("tier"))
    same = of_claims.withColumn("_n", nth("shard", "word", "category")).where("_n = 1").select("shard", "word", "category", record.alias("_same"))
    first = of_claims.withColumn("_n", nth("shard", "word")).where("_n = 1").select("shard", "word", record.alias("_first"))
    says = lambda of: shown(F.try_element_at("oracle_text", of), F.try_element_at("oracle_valid", of))
    met = keyed.join(same, ["shard", "word", "category"], "left").join(first, ["shard", "word"], "left")
    met = met.withColumn("_record", F.coalesce("_same", "_first")).select("*", "_record.*").drop("_same", "_first", "_record")
    both = met.withColumn("found_spec", says(F.lit(base))).withColumn("found_actual", says(F.col("tool")))
    header = ("word", "category", "tool", "spec", "actual")
    known = F.col("found").isNotNull()
    tests = [
        ("header", reduce(lambda a, b: a | b, (F.coalesce(F.col(c), F.lit("")) == "" for c in header))),
        ("unknown tool", ~F.col("tool").isin(*sources)),
        ("unknown category", ~F.col("category").isin(*TAXONOMY)),
        ("no disagreement", F.col("spec") == F.col("actual")),
        ("word form", ~F.col("word").startswith("0x") | parse_word(F.col("word")).isNull()),
        ("not in corpus", ~known),
        ("category", known & (F.col("found") != F.col("category"))),
        ("spec", known & (F.col("found_spec") != F.col("spec"))),
        ("actual", known & (F.col("found_actual") != F.col("actual"))),
    ]
    problems = F.array_compact(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in tests)))
    return both.withColumn("problems", problems).withColumn("problem", F.get("problems", F.lit(0)))


def metric_differences(claimed: DataFrame, actual: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows ``source, metric`` on which two tall tables of metrics differ by more than the tolerance, or one lacks."""
    a, b = claimed.select("source", "metric", F.col("value").alias("claimed")), actual.select("source", "metric", F.col("value").alias("actual"))
    return a.join(b, ["source", "metric"], "full").where(~F.coalesce(F.abs(F.col("claimed") - F.col("actual")) <= tolerance, F.lit(False)))


def missing_keys(present: Column, required: list[str]) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def unknown_values(df: DataFrame, col: str, allowed: tuple[str, ...]) -> DataFrame:
    known = df.sparkSession.createDataFrame([(x,) for x in allowed], f"{col} string")
    return df.select(col).subtract(known)


def shard_difference(bounds: DataFrame, records: DataFrame) -> DataFrame:
    return bounds.select("shard").subtract(records.select(F.col("shard_id").cast("long").alias("shard")))


def check_rules(tiled: DataFrame, docs: DataFrame, release: str, rules: DataFrame, known_word: int, known_rule: int, width: int = 32) -> DataFrame:
    """Q1: all files tile, all documents are of the release, a known word has its rule and no other."""
    spark = rules.sparkSession
    word = spark.createDataFrame([(known_word,)], "word long")
    facts = beside(tiling_summary(tiled), docs.agg(F.count("*").alias("documents"), F.count_if(~F.col("commit_id").eqNullSafe(F.lit(release))).alias("other_release")), classify_words(word, rules, width).select("rule_id", "n_match"))
    return verdict("rules", facts, [("tiling", (F.col("checked") > 0) & (F.col("checked") == F.col("passed"))), ("release", (F.col("documents") > 0) & (F.col("other_release") == 0)), ("known word", (F.col("rule_id") == known_rule) & (F.col("n_match") == 1))])


def domain_counts(wide: DataFrame, sources: list[str], n_words: int) -> DataFrame:
    """One row: for every source its ones and zeros among the stored words of the domain, and its bits beyond it."""
    tail = existing(F.col("block"), n_words)
    sums = []
    for s in sources:
        bits = F.col(s)
        each = (("ones", bits.bitwiseAND(tail)), ("zeros", F.bitwise_not(bits).bitwiseAND(tail)), ("beyond", bits.bitwiseAND(F.bitwise_not(tail))))
        sums += [F.coalesce(F.sum(popcount(x)), F.lit(0)).alias(f"{name} {s}") for name, x in each]
    return wide.agg(*sums)


def miscounted(records: DataFrame, wide: DataFrame, sources: list[str], shard_bits: int) -> DataFrame:
    """``shard_id, source, recorded, counted`` where a shard's recorded count isn't that of its blocks."""
    sums = [F.sum(popcount(F.col(s))).alias(s) for s in sources]
    found = wide.groupBy(F.shiftright("block", shard_bits - 6).cast("int").alias("shard_id")).agg(*sums)
    both = records.select("shard_id", "valid_counts").join(found, "shard_id", "full")
    rows = ", ".join(f"'{s}', coalesce(valid_counts['{s}'], 0), coalesce(`{s}`, 0)" for s in sources)
    return both.selectExpr("shard_id", f"stack({len(sources)}, {rows}) as (source, recorded, counted)").where("recorded <> counted")


def check_coverage(records: DataFrame, bounds: DataFrame, wide: DataFrame, sources: list[str], n_words: int, fresh: DataFrame, shard_bits: int, dense: bool = True) -> DataFrame:
    """Q2: every shard once with its bounds, complete ones without untriaged errors; for every source ones and zeros counted
    apart adding up to the domain, no bit beyond it, and each shard's ones as recorded; fresh hashes equal to the recorded.

    ``wide`` has every block of the domain (``packed.completed``). Of a store that leaves out empty blocks, ``dense=False``,
    a lost block shows in the counts alone.
    """
    counts = domain_counts(wide, sources, n_words)
    facts = beside(
        missing_shards(records, bounds).agg(F.count("*").alias("missing")),
        wrong_bounds(records, bounds).agg(F.count("*").alias("wrong_bounds")),
        shard_gaps(records).agg(F.count("*").alias("gaps")),
        records.agg(F.count("*").alias("records"), F.count_if((F.col("status") == "complete") & (F.col("untriaged_crash_count") > 0)).alias("untriaged"), F.count_if(F.col("status") != "complete").alias("incomplete")),
        counts,
        miscounted(records, wide, sources, shard_bits).agg(F.count("*").alias("miscounted"), F.count_distinct("shard_id").alias("miscounted_shards")),
        verify_shard(records, fresh, sources).agg(F.count_if(~F.col("same")).alias("changed")),
    )
    zero = lambda c: F.col(c) == 0
    every = lambda test: reduce(lambda a, b: a & b, map(test, sources))
    sums = every(lambda s: F.col(f"ones {s}") + F.col(f"zeros {s}") == n_words) if dense else F.lit(True)
    return verdict(
        "coverage",
        facts,
        [
            ("missing shards", zero("missing") & (F.col("records") > 0)),
            ("bounds", zero("wrong_bounds")),
            ("gaps", zero("gaps")),
            ("untriaged errors", zero("untriaged")),
            ("incomplete shards", zero("incomplete")),
            ("beyond the domain", every(lambda s: zero(f"beyond {s}"))),
            ("ones and zeros", sums),
            ("counts", zero("miscounted")),
            ("hashes", zero("changed")),
        ],
    )


def check_normalization(normalized: DataFrame) -> DataFrame:
    """Q3: there were comparisons, the alias rule is counted by itself and applied, and every declared rule did."""
    counts = rule_counts(normalized)
    facts = beside(counts.agg(F.max("comparisons").alias("comparisons"), F.max(F.when(F.col("rule") == ALIAS_RULE, F.col("n"))).alias("alias_applied")), unexercised(normalized).agg(F.count("*").alias("unexercised"), F.concat_ws(",", F.sort_array(F.collect_list("rule"))).alias("rules")))
    return verdict("normalization", facts, [("comparisons", F.col("comparisons") > 0), ("alias rule", F.col("alias_applied") > 0), ("unexercised rules", F.col("unexercised") == 0)])


def check_corpus(corpus: DataFrame, sources: list[str], claimed_total: int, exhaustive: bool, sample_size: int | None, population: int | None, gaps: DataFrame) -> DataFrame:
    """Q4: one pass over the corpus for its form, the claimed total, and the coverage of probed disagreements.

    The corpus comes from ``scan_corpus`` or ``scan_corpus_ndjson``, which don't turn away what the check is to count: records of
    another version, and lines that are no record.
    """
    full = F.size(missing_keys(F.map_keys("oracle_valid"), sources)) == 0
    unreadable = F.col(CORRUPT).isNotNull() if CORRUPT in corpus.columns else F.lit(False)
    facts = beside(
        corpus.agg(
            F.count("*").alias("records"),
            F.count_if(unreadable).alias("unreadable"),
            F.count_if(~unreadable & ~F.col("format_version").eqNullSafe(F.lit(FORMAT_VERSION))).alias("bad_version"),
            F.count_if(~F.coalesce(F.col("category").isin(*TAXONOMY), F.lit(False))).alias("bad_category"),
            F.count_if(~F.coalesce(full, F.lit(False))).alias("bad_sources"),
            F.count_if(~F.coalesce(F.col("word").startswith("0x"), F.lit(False))).alias("bad_word"),
        ),
        examples(gaps).agg(F.count("*").alias("uncovered"), F.concat_ws(",", F.sort_array(F.collect_list("word"))).alias("examples")),
    )
    sized = F.lit(bool(exhaustive) or bool(sample_size and population and sample_size > 0 and population > 0))
    zero = lambda c: F.col(c) == 0
    return verdict("corpus", facts, [("readable", zero("unreadable")), ("version", zero("bad_version")), ("taxonomy", zero("bad_category")), ("sources", zero("bad_sources")), ("word form", zero("bad_word")), ("total", F.col("records") == claimed_total), ("sample sizes", sized), ("coverage", zero("uncovered"))])


def check_metrics(claimed: DataFrame, ranking: DataFrame, wide: DataFrame, sources: list[str], base: str, n_words: int, corpus: DataFrame) -> DataFrame:
    """Q5: claimed metrics (``source, metric, value``) against recomputed ones; claimed ranking (``rank, source``) worst
    first."""
    validity = micro(wide, sources, base, n_words)
    tall = validity.selectExpr("source", "stack(2, 'disagreements', cast(disagreements as double), 'micro', micro) as (metric, value)").unionByName(text_disagreements(corpus, sources, base).selectExpr("source", "'text_disagreements' as metric", "cast(text_disagreements as double) as value"))
    order = ranked(validity).select("rank", F.col("source").alias("want"))
    facts = beside(metric_differences(claimed, tall).agg(F.count("*").alias("different")), claimed.agg(F.count("*").alias("claimed")), ranking.join(order, "rank", "full").agg(F.count_if(~F.col("source").eqNullSafe(F.col("want"))).alias("misranked")))
    return verdict("metrics", facts, [("values", (F.col("different") == 0) & (F.col("claimed") > 0)), ("ranking", F.col("misranked") == 0)])


def check_reproducers(claims: DataFrame, corpus: DataFrame, shard_bits: int, sources: list[str], base: str, least: int = 10) -> DataFrame:
    """Q6: enough of them, different words, and each as its record says in every field."""
    found = lookups(claims, corpus, shard_bits, sources, base)
    kinds = found.select(F.explode("problems").alias("kind")).agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("problems"))  # nine kinds at most
    facts = beside(found.agg(F.count("*").alias("files"), F.count_distinct("word").alias("words"), F.count_if(F.col("problem").isNotNull()).alias("wrong")), kinds)
    return verdict("reproducers", facts, [("number", F.col("files") >= least), ("different words", F.col("files") == F.col("words")), ("records", F.col("wrong") == 0)])


def check_hash(artifacts: DataFrame, stored: str) -> DataFrame:
    """Q7: the stored hash of the run is the one of its artifacts' hashes."""
    return verdict("result hash", result_hash(artifacts), [("hash", F.col("result_hash") == stored)])


def run_checks(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]], at_once: int = 1) -> DataFrame:
    """Q8: every registered check, none is skipped, and none takes another with it. ``at_once`` of them run side by side."""
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(lambda x: closed(spark, *x), checks.items()))
    return reduce(lambda a, b: a.unionByName(b), rows)


def merged_status(status: DataFrame, results: DataFrame) -> DataFrame:
    """``goal, state`` with the state of checked goals replaced, others as they were."""
    new = results.select(F.col("check_id").alias("goal"), F.when(F.col("passed"), F.lit("passing")).otherwise(F.lit("failing")).alias("_new"))
    return status.join(new, "goal", "left").select("goal", F.coalesce("_new", "state").alias("state"))
