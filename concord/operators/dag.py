"""A decision DAG over a rule table: sets of rules that can still match, by the leading bits of a word, equal sets being one.

Built level by level with joins: a set is kept as rows (node, rule), never as one row, and named by a 128-bit hash that is
summed up from its rules, so nodes of one level that hold the same rules become one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.sources.scratch import stored

#: Bits of a word that one level decides.
STEP = 4
#: Rules of a task before they are dealt to nodes, which multiplies them from level to level.
RULES_PER_TASK = 1000
#: Links of a level that are broadcast (16 bytes each).
FEW_LINKS = 4_000_000


@dataclass
class Level:
    """``links``: ``at, next``; ``at`` is ``node * 2 ** bits`` and the value of the level's bits, ``next`` the node there.
    A value without a link leads to the empty set."""

    shift: int
    bits: int
    links: DataFrame
    n_links: int


@dataclass
class Dag:
    """``leaves``: ``node, n_match, rule_id`` (the lowest); ``leaf_rules``: ``node, rule_id``. The root is node 0."""

    width: int
    levels: list[Level]
    leaves: DataFrame
    leaf_rules: DataFrame

    @property
    def n_links(self) -> int:
        return sum(level.n_links for level in self.levels)


def _bits(c: Column | str, shift: int, bits: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND((1 << bits) - 1)


def _allowed(spark: SparkSession, bits: int) -> DataFrame:
    """``m, v, x``: the values ``x`` of these bits that a rule with mask ``m`` and value ``v`` allows, ``4 ** bits`` rows."""
    m, x = F.shiftright("id", bits), F.col("id").bitwiseAND((1 << bits) - 1)
    return spark.range(1 << 2 * bits).select(m.alias("m"), x.bitwiseAND(m).alias("v"), x.alias("x"))


def build(rules: DataFrame, width: int, step: int = STEP, most_rows: int | None = None) -> Dag | None:
    """The DAG of ``rules`` (``rule_id, mask, value``), or None once a level has more than ``most_rows`` (node, rule) rows.

    Rules of equal mask and value are one until the leaves. Bits that no rule of a node fixes lead to one next node for all
    their values, so rules that leave the first bits open are not copied by them.
    """
    spark = rules.sparkSession
    # their number multiplies later, so that a small table is dealt to all cores at once
    n_tasks = min(spark.sparkContext.defaultParallelism, 1 + rules.count() // RULES_PER_TASK)
    alike = stored(rules.repartition(n_tasks, "mask", "value").groupBy("mask", "value").agg(F.min("rule_id").alias("lowest"), F.count("*").alias("n")), "dag-alike")
    # two independent 64-bit hashes; a set's name is their bitwise sums, which need no order
    seeded = lambda seed: F.xxhash64(F.lit(seed), "mask", "value")
    held = alike.select(F.lit(0).cast("long").alias("node"), "mask", "value")
    levels = []
    for top in range(width, 0, -step):
        bits = min(step, top)
        shift = top - bits
        met = held.withColumn("m", _bits("mask", shift, bits)).withColumn("v", _bits("value", shift, bits)).join(F.broadcast(_allowed(spark, bits)), ["m", "v"])
        below = met.select("mask", "value", (F.col("node") * (1 << bits) + F.col("x")).alias("at"))
        named = below.groupBy("at").agg(F.bit_xor(seeded(1)).alias("s"), F.bit_xor(seeded(2)).alias("t"))
        # of the places with the same set one stands for it, and gives it its number
        links = stored(named.select("at", F.min("at").over(Window.partitionBy("s", "t")).alias("next")), "dag-links")
        levels.append(Level(shift, bits, links, links.count()))
        nodes = links.select(F.col("next").alias("node")).distinct()
        few = levels[-1].n_links <= FEW_LINKS
        held = stored(below.withColumnRenamed("at", "node").join(F.broadcast(nodes) if few else nodes, "node", "left_semi"), "dag-level")
        if most_rows is not None and held.count() > most_rows:
            return None
    pairs = held.join(alike, ["mask", "value"])
    leaves = stored(pairs.groupBy("node").agg(F.sum("n").alias("n_match"), F.min("lowest").alias("rule_id")), "dag-leaves")
    return Dag(width, levels, leaves, held.select("node", "mask", "value").join(rules.select("rule_id", "mask", "value"), ["mask", "value"]).select("node", "rule_id"))


def descend(words: DataFrame, dag: Dag) -> DataFrame:
    """``words`` with ``node``, the leaf of their ``word``, null where no rule matches. A level of up to FEW_LINKS links is
    broadcast, so up to there no word moves; a larger one is met in an exchange."""
    out = words.withColumn("node", F.lit(0).cast("long"))
    for level in dag.levels:
        links = F.broadcast(level.links) if level.n_links <= FEW_LINKS else level.links
        out = out.withColumn("at", F.col("node") * (1 << level.bits) + _bits("word", level.shift, level.bits)).join(links, "at", "left").drop("at", "node").withColumnRenamed("next", "node")
    return out


def classify(words: DataFrame, dag: Dag) -> DataFrame:
    """``words`` with ``valid, rule_id, n_match``: the lowest matching rule and how many match."""
    leaves = F.broadcast(dag.leaves) if dag.levels[-1].n_links <= FEW_LINKS else dag.leaves
    found = descend(words, dag).join(leaves, "node", "left").drop("node")
    return found.withColumn("n_match", F.coalesce("n_match", F.lit(0).cast("long"))).withColumn("valid", F.col("n_match") > 0)


def weights(dag: Dag) -> DataFrame:
    """``node, weight``: how many words of the domain end in each leaf; those that no rule matches have the node null."""
    spark = dag.leaves.sparkSession
    reached = spark.createDataFrame([(0, 1)], "node long, weight long")
    for level in dag.levels:
        from_, of = F.shiftright("at", level.bits).alias("node"), level.links
        met = of.select(from_, "next").join(reached, "node")
        reached = stored(met.groupBy(F.col("next").alias("node")).agg(F.sum("weight").alias("weight")), "dag-weights")
    rest = reached.agg((F.lit(1 << dag.width) - F.coalesce(F.sum("weight"), F.lit(0))).alias("weight")).where("weight > 0")
    return reached.unionByName(rest.select(F.lit(None).cast("long").alias("node"), "weight"))
