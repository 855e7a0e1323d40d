"""Alias rules: conditions compiled once to clauses, evaluated per text by broadcast join and array functions."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions.text import ALIAS_RULE, operands_of, strip

#: Operand places of register fields.
FIELD_PLACE = {"Rd": 0, "Rn": 1, "Rm": 2, "Ra": 3, "Rt": 1}
#: Base, alias, condition. Full conditions, also where they can't be proven from a text.
ALIASES: tuple[tuple[str, str, str], ...] = (
    ("ORR", "MOV", "shift == '00' && imm6 == '000000' && Rn == '11111'"),
    ("SUBS", "CMP", "Rd == '11111'"),
    ("SUBS", "NEGS", "Rn == '11111' && Rd != '11111'"),
    ("ADDS", "CMN", "Rd == '11111'"),
    ("ANDS", "TST", "Rd == '11111'"),
    ("ORN", "MVN", "Rn == '11111'"),
    ("SUB", "NEG", "Rn == '11111'"),
    ("ASRV", "ASR", "Unconditionally"),
    ("LSLV", "LSL", "Unconditionally"),
    ("LSRV", "LSR", "Unconditionally"),
    ("RORV", "ROR", "Unconditionally"),
    ("EXTR", "ROR", "Rn == Rm"),
    ("CSINC", "CSET", "Rm == '11111' && Rn == '11111' && !(cond IN {'111x'})"),
    ("LDADD", "STADD", "A == '0' && Rt == '11111'"),
    ("BFM", "BFC", "Rn == '11111' && UInt(imms) < UInt(immr)"),
)


#: The table where none is stored. Its condition for ORR is the bare one.
FALLBACK = (("ORR", "MOV", "Rn == '11111'"), *ALIASES[1:12])
#: Rules that are broadcast, folded by base; a larger table is joined by a shuffle.
FEW_RULES = 100_000
TABLE = "base_seq long, alias_seq long, base string, alias string, condition string"


def alias_rules(spark: SparkSession, rows=ALIASES) -> DataFrame:
    """``base_seq, alias_seq, base, alias, condition``: bases in order of first appearance, aliases in order."""
    bases = list(dict.fromkeys(b for b, _, _ in rows))
    return spark.createDataFrame([(bases.index(b), i, b, a, c) for i, (b, a, c) in enumerate(rows)], TABLE)


def grouped_aliases(aliasrefs: DataFrame) -> DataFrame:
    """Rule rows from extracted alias references (``file_seq, ref_seq, base, alias, condition``): upper-cased bases in
    order of first appearance, then the order of references, counted from 0 in each base."""
    of_base = Window.partitionBy("base")
    place = F.row_number().over(of_base.orderBy("file_seq", "ref_seq")) - 1
    named = aliasrefs.withColumn("base", F.upper("base"))
    return named.select(F.min("file_seq").over(of_base).cast("long").alias("base_seq"), place.cast("long").alias("alias_seq"), "base", "alias", F.coalesce("condition", F.lit("")).alias("condition"))


def load_alias_rules(spark: SparkSession, path: str) -> DataFrame:
    """Alias rules from storage: a table of rule rows, or one JSON document ``{base: [{alias_mnemonic, condition}]}`` in
    its order (``*.json``). The built-in fallback where there is none or it can't be read."""
    try:
        if not path.endswith(".json"):
            stored = spark.read.schema(TABLE).parquet(path)
            stored.isEmpty()  # can be read
            return stored
        text = spark.read.text(path, wholetext=True)
        docs = text.select(F.from_json("value", "map<string, array<struct<alias_mnemonic: string, condition: string>>>").alias("doc"))
        if docs.where("doc is not null").isEmpty():
            return alias_rules(spark, FALLBACK)
    except PySparkException:
        return alias_rules(spark, FALLBACK)
    bases = docs.select(F.posexplode("doc").alias("base_seq", "base", "refs"))
    rows = bases.select("base_seq", F.posexplode("refs").alias("alias_seq", "ref"), "base")
    blank = F.lit("")
    return rows.select(F.col("base_seq").cast("long"), F.col("alias_seq").cast("long"), "base", F.coalesce("ref.alias_mnemonic", blank).alias("alias"), F.coalesce("ref.condition", blank).alias("condition"))


def split_clauses(condition: Column) -> Column:
    """Clauses joined by ``&&`` outside parentheses, trimmed."""
    return F.transform(F.split(condition, r"&&(?![^(]*\))"), lambda c: F.trim(c))


def compile_alias_rules(rules: DataFrame, empty_condition: str = "decline") -> DataFrame:
    """Rules with ``clauses``: an array of (g, k, p, q) and ``always``.

    g is the group (clauses of one group are alternatives), k the shape: ``zr`` field p is the zero register, ``nz`` it
    is not, ``eq`` fields p and q are the same register, ``?`` can't be proven from a text.
    """
    place = F.create_map(*(F.lit(x) for kv in FIELD_PLACE.items() for x in kv))
    # fixed values: the forms of a clause that can be proven from a text
    zr, nz, eq = r"^(R\w*)\s*==\s*'11111'$", r"^(R\w*)\s*!=\s*'11111'$", r"^(R\w*)\s*==\s*(R\w*)$"

    def shape(c: Column, g: Column) -> Column:
        def field(pattern: str, i: int) -> Column:
            return F.try_element_at(place, F.regexp_extract(c, pattern, i))

        def made(k: Column | str, p: Column, q: Column) -> Column:
            return F.struct(g.alias("g"), (F.lit(k) if isinstance(k, str) else k).alias("k"), p.cast("int").alias("p"), q.cast("int").alias("q"))

        none = F.lit(None).cast("int")
        a, b = field(eq, 1), field(eq, 2)
        return (
            F.when(c.rlike(zr) & field(zr, 1).isNotNull(), made("zr", field(zr, 1), none))
            .when(c.rlike(nz) & field(nz, 1).isNotNull(), made("nz", field(nz, 1), none))
            .when(c.rlike(eq) & (a != b), made("eq", F.least(a, b), F.greatest(a, b)))
            .otherwise(made("?", none, none))
        )

    def alternatives(clause: Column) -> Column:
        grouped = clause.rlike(r"^\(.*\)$")
        return F.when(grouped, F.transform(F.split(F.regexp_replace(clause, r"^\(|\)$", ""), r"\|\|"), lambda c: F.trim(c))).otherwise(F.array(clause))

    condition = F.trim(F.coalesce("condition", F.lit("")))
    always = (condition == "Unconditionally") | (F.lit(empty_condition == "apply") & (condition == ""))
    clauses = F.flatten(F.transform(split_clauses(condition), lambda c, g: F.transform(alternatives(c), lambda x: shape(x, g))))
    alias = F.lower(F.trim(F.split("alias", ",")[0]))
    return rules.select("base_seq", "alias_seq", F.lower("base").alias("base"), alias.alias("alias"), always.alias("always"), F.when(~always, clauses).alias("clauses")).where(F.col("alias") != "")


def evaluated(clauses: Column, ops: Column) -> Column:
    """Clauses with ``ok`` (null: unknown) and the operand that a true one makes redundant."""
    zero = lambda o: o.rlike(r"^[wx]zr$")

    def one(c: Column) -> Column:
        a, b = F.get(ops, c["p"]), F.get(ops, c["q"])
        ok = F.when(c["k"] == "zr", zero(a)).when(c["k"] == "nz", ~zero(a)).when((c["k"] == "eq") & a.isNotNull() & b.isNotNull(), a.rlike(r"^[wx]\d{1,2}$") & (a == b))
        return F.struct(c["g"].alias("g"), ok.alias("ok"), F.when(ok & (c["k"] == "zr"), c["p"]).when(ok & (c["k"] == "eq"), c["q"]).alias("drop"))

    return F.transform(clauses, one)


def holds(found: Column) -> Column:
    """All groups have a true clause and none is unknown in a place that decides (a false group declines as well)."""
    return ~F.exists(found, lambda e: e["ok"].isNull()) & F.forall(found, lambda e: F.exists(found, lambda y: (y["g"] == e["g"]) & y["ok"]))


def render(alias: Column, ops: Column, drops: Column) -> Column:
    kept = F.filter(ops, lambda o, i: ~F.coalesce(F.array_contains(drops, i), F.lit(False)))
    return F.trim(F.concat_ws(" ", alias, F.nullif(F.array_join(kept, ", "), F.lit(""))))


def chain_depth(compiled: DataFrame) -> int:
    """How often an alias may be the base of a later rule, step by step: where chains of one more rule end, and the
    earliest base of their last rule. Bases only grow along a chain, so it ends."""
    links = compiled.select("base_seq", "base", F.col("alias").alias("to"))
    ends, depth = links.groupBy("to").agg(F.min("base_seq").alias("last")), 1
    while True:
        ends = ends.select(F.col("to").alias("base"), "last").join(links, "base").where("base_seq > last").groupBy("to").agg(F.min("base_seq").alias("last"))
        if ends.isEmpty():
            return depth
        depth += 1


def apply_aliases(df: DataFrame, compiled: DataFrame, col: str = "normalized", trace: str | None = "applied_rules") -> DataFrame:
    """``df`` with ``col`` after the alias rule: per base in order the first alias whose whole condition is proven.

    The compiled rules are folded into one row per base with its candidates, so a text meets its rules
    by one lookup and no row is multiplied or regrouped. Up to FEW_RULES rules are broadcast.
    """
    few = compiled.limit(FEW_RULES + 1).count() <= FEW_RULES
    candidates = compiled.groupBy("base").agg(F.sort_array(F.collect_list(F.struct("base_seq", "alias_seq", "alias", "always", "clauses"))).alias("_rules")).withColumnRenamed("base", "_base")
    df = df.withColumn("_before", F.col(col)).withColumn("_from", F.lit(-1))
    for _ in range(chain_depth(compiled)):
        base = F.regexp_extract(F.col(col), r"^(\w+)(?!\w)", 1)
        df = df.join(F.broadcast(candidates) if few else candidates, base == F.col("_base"), "left")
        rest = strip(F.substr(F.col(col), F.length("_base") + 1))
        df = df.withColumn("_ops", F.when(rest == "", F.array().cast("array<string>")).otherwise(operands_of(rest)))

        def tried(r: Column) -> Column:
            found = evaluated(r["clauses"], F.col("_ops"))
            drops = F.filter(F.transform(found, lambda e: e["drop"]), lambda x: x.isNotNull())
            ok = r["always"] | holds(found)
            return F.struct(ok.alias("ok"), r["base_seq"].alias("seq"), render(r["alias"], F.col("_ops"), F.coalesce(drops, F.array().cast("array<int>"))).alias("out"))

        hits = F.filter(F.transform(F.filter("_rules", lambda r: r["base_seq"] > F.col("_from")), tried), lambda t: F.coalesce(t["ok"], F.lit(False)))
        df = df.withColumn("_hit", F.get(hits, F.lit(0)))
        df = df.withColumn(col, F.coalesce(F.col("_hit.out"), F.col(col))).withColumn("_from", F.coalesce(F.col("_hit.seq"), F.col("_from"))).drop("_base", "_rules", "_ops", "_hit")
    if trace:
        df = df.withColumn(trace, F.when(~F.col(col).eqNullSafe(F.col("_before")), F.array_append(F.col(trace), F.lit(ALIAS_RULE))).otherwise(F.col(trace)))
    return df.drop("_before", "_from")
