"""Rule tables: boxes to masks, tiling, classification of words, counts of regions without enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators import dag

#: Variable bits of a prefix up to which a rule is copied to all buckets that it allows (16 at most).
MOST_VARIABLE = 4
#: Rules that are broadcast; a larger table is joined by a shuffle on the prefix.
FEW_RULES = 100_000


def mask_value(boxes: Column, width: int = 32) -> tuple[Column, Column]:
    """Mask and value of a rule: a fixed bit is 1 in the mask; a variable box leaves 0.

    Boxes without cells or with a wrong number of cells are variable.
    """

    def fold(pick: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            bits = F.when(F.length(b["fixed_bits"]) == b["width"], b["fixed_bits"])
            digits = F.when(pick, bits).otherwise(F.translate(bits, "0", "1"))
            low = b["hibit"] - b["width"] + 1
            number = F.coalesce(F.conv(digits, 2, 10).cast("long"), F.lit(0).cast("long"))
            return acc.bitwiseOR(F.call_function("shiftleft", number, low))

        return F.aggregate(boxes, F.lit(0).cast("long"), add)

    return fold(F.lit(False)), fold(F.lit(True))


def tilings(boxes: DataFrame, width: int = 32) -> DataFrame:
    """``file, iclass, ok``: whether the boxes (rows ``file, iclass, hibit, width``) chain from the top bit to bit 0."""
    w = Window.partitionBy("file", "iclass").orderBy(F.col("hibit").desc(), F.col("width").desc())
    expected = F.coalesce(F.lag(F.col("hibit") - F.col("width")).over(w), F.lit(width - 1))
    chained = boxes.withColumn("_ok", F.col("hibit") == expected).withColumn("_low", F.col("hibit") - F.col("width"))
    return chained.groupBy("file", "iclass").agg((F.bool_and("_ok") & (F.min("_low") == -1)).alias("ok"))


def tiling_summary(tiled: DataFrame) -> DataFrame:
    """Files that have classes, and those of which all classes tile."""
    files = tiled.groupBy("file").agg(F.bool_and("ok").alias("ok"))
    return files.agg(F.count("*").alias("checked"), F.count_if("ok").alias("passed"))


def scope_histogram(docs: DataFrame, allowed: tuple[str, ...], cls: str = "instr_class") -> DataFrame:
    """Documents by class outside of the scope."""
    return docs.where(~F.coalesce(F.col(cls).isin(*allowed), F.lit(False))).groupBy(cls).agg(F.count("*").alias("n"))


def prefix_buckets(rules: DataFrame, width: int, bits: int, skip: int = 0) -> DataFrame:
    """Each rule once per value that it allows of the ``bits`` bits below the top ``skip`` ones, as ``prefix``."""
    low = width - skip - bits
    part = lambda c: F.shiftright(c, low).bitwiseAND((1 << bits) - 1)
    mask, value = part("mask"), part("value")
    return rules.withColumn("prefix", F.explode(F.filter(F.sequence(F.lit(0), F.lit((1 << bits) - 1)).cast("array<long>"), lambda p: p.bitwiseAND(mask) == value)))


def variable_bits(width: int, bits: int, skip: int = 0) -> Column:
    """How many of these bits a rule leaves open."""
    return bits - F.bit_count(F.shiftright("mask", width - skip - bits).bitwiseAND((1 << bits) - 1))


def classify_words(words: DataFrame, rules: DataFrame, width: int = 32, prefix_bits: int = 8, names: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``words`` (``word`` and more) with ``valid, rule_id, n_match``: the lowest matching rule and how many
    match.

    ``word & mask = value`` is looked up by parts of the word. A rule table of checked size is folded into one array of
    rules per value of the word's first bits and broadcast: every word meets one row, is tested against its bucket's few
    rules, and never moves, so the sweep of a whole domain has no exchange. Rules that leave many of the first bits open,
    and would be copied to many buckets, are looked up by the next bits in the same way; those that leave both open
    form one more array, which every word is tested against. A larger rule table is descended as a decision DAG
    (``classify_many_rules``).
    """
    bits = min(prefix_bits, width)
    if rules.limit(FEW_RULES + 1).count() > FEW_RULES:
        return classify_many_rules(words, rules, width, names)
    slim = rules.select("rule_id", "mask", "value")
    folded = F.sort_array(F.collect_list(F.struct("rule_id", "mask", "value")))
    none = "cast(array() as array<struct<rule_id: {0}, mask: bigint, value: bigint>>)".format(dict(rules.dtypes)["rule_id"])
    met, parts, rest = words, [], slim
    for k in range(2 if width >= 2 * bits else 1):
        copied = variable_bits(width, bits, k * bits) <= MOST_VARIABLE
        near = prefix_buckets(rest.where(copied), width, bits, k * bits).groupBy("prefix").agg(folded.alias(f"_near{k}"))
        rest = rest.where(~copied)
        met = met.withColumn("prefix", F.shiftright("word", width - (k + 1) * bits).bitwiseAND((1 << bits) - 1)).join(F.broadcast(near), "prefix", "left")
        parts.append(f"coalesce(_near{k}, {none})")
    met = met.crossJoin(F.broadcast(rest.agg(folded.alias("_far"))))  # one row
    hits = met.withColumn("_hits", F.expr(f"filter(concat({', '.join(parts)}, _far), r -> (word & r.mask) = r.value)"))
    out = hits.withColumn("n_match", F.size("_hits").cast("long")).withColumn("rule_id", F.expr("array_min(_hits).rule_id")).withColumn("valid", F.col("n_match") > 0).drop("prefix", "_far", "_hits", *(f"_near{k}" for k in range(len(parts))))
    return out if not names else out.join(F.broadcast(rules.select("rule_id", *names)), "rule_id", "left")


#: Rows of a level of the DAG for each rule of the table.
MOST_ROWS = 64
#: For rule tables too large to broadcast: bits of the long and the short prefix, and shares of a short prefix's words.
LONG, SHORT, SALTS = 16, 8, 64


def classify_many_rules(words: DataFrame, rules: DataFrame, width: int, names: tuple[str, ...] = ()) -> DataFrame:
    """The form for rule tables that don't fit a broadcast: words descend the table's decision DAG, a level at a time, by
    broadcast lookups up to ``dag.FEW_LINKS`` links a level. Should a level hold over MOST_ROWS times as many (node, rule) rows
    as there are rules, the DAG is given up for a join on prefixes."""
    found = dag.build(rules, width, most_rows=MOST_ROWS * rules.count())
    if found is None:
        return _classify_by_shuffle(words, rules, width, names)
    out = dag.classify(words, found)
    return out if not names else out.join(rules.select("rule_id", *names), "rule_id", "left")


def _classify_by_shuffle(words: DataFrame, rules: DataFrame, width: int, names: tuple[str, ...]) -> DataFrame:
    """The form for rule tables whose DAG grows too large: equi-joins, matches aggregated per word.

    Most rules meet their words by the first 16 bits (65,536 keys). Rules that leave many of these open meet them by the first
    8, of which the words are dealt to 64 shares. A task holds the rules of a key, and the words stream by.
    """
    long_, short = min(LONG, width), min(SHORT, width)
    match = F.col("word").bitwiseAND(F.col("mask")) == F.col("value")
    slim, keyed = rules.select("rule_id", "mask", "value"), words.select("word").distinct()
    copied = variable_bits(width, long_) <= MOST_VARIABLE + 2
    near = keyed.withColumn("prefix", F.shiftright("word", width - long_)).join(prefix_buckets(slim.where(copied), width, long_), "prefix").where(match)
    salted = keyed.withColumn("prefix", F.shiftright("word", width - short)).withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    shares = prefix_buckets(slim.where(~copied), width, short).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    far = salted.join(shares, ["prefix", "salt"]).where(match)
    found = near.select("word", "rule_id").union(far.select("word", "rule_id")).groupBy("word").agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("n_match"))
    out = words.join(found, "word", "left").withColumn("valid", F.col("rule_id").isNotNull()).withColumn("n_match", F.coalesce("n_match", F.lit(0)))
    return out if not names else out.join(rules.select("rule_id", *names), "rule_id", "left")


def classify_nested_loop(words: DataFrame, rules: DataFrame) -> DataFrame:
    """The plain form of the same join, for comparison."""
    match = F.col("word").bitwiseAND(F.col("mask")) == F.col("value")
    hits = words.select("word").join(F.broadcast(rules.select("rule_id", "mask", "value")), match)
    found = hits.groupBy("word").agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("n_match"))
    return words.join(found, "word", "left").withColumn("valid", F.col("rule_id").isNotNull()).withColumn("n_match", F.coalesce("n_match", F.lit(0)))


def regions(rules: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The regions of the domain, each the words that have the same set of matching rules, counted without enumerating words.

    ``region, n_rules, weight`` has a row per region, the one without rules has the region null, so the weights sum to
    ``2**width``; ``region, rule_id`` has a row per rule of a region.
    """
    found = dag.build(rules, width)
    sizes = found.leaves.select("node", F.col("n_match").alias("n_rules"))
    counted = dag.weights(found).join(sizes, "node", "left")
    return counted.select(F.col("node").alias("region"), F.coalesce("n_rules", F.lit(0).cast("long")).alias("n_rules"), "weight"), found.leaf_rules.withColumnRenamed("node", "region")


def allocation(counted: DataFrame) -> DataFrame:
    """One row: words with a rule, without one, and the number of different sets of two or more rules."""
    n = F.col("n_rules")
    return counted.agg(
        F.coalesce(F.sum(F.when(n > 0, F.col("weight"))), F.lit(0)).alias("allocated"),
        F.coalesce(F.sum(F.when(n == 0, F.col("weight"))), F.lit(0)).alias("unallocated"),
        F.count_if(n > 1).alias("ambiguous_groups"),
    )
