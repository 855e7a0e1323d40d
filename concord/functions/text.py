"""The ordered text rules, as expressions that stay in the JVM, with a trace of the rules that changed a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's ``\s`` sees it (Java's is ASCII without this flag).
S = r"(?U)"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, S + r"^\s+|\s+$", "")


def strip_comments(t: Column) -> Column:
    return strip(F.regexp_replace(t, r"(//|;).*$", ""))


def lowercase(t: Column) -> Column:
    return F.lower(t)


def whitespace(t: Column) -> Column:
    t = F.regexp_replace(strip(t), S + r"\s+", " ")
    for pattern, by in ((r"\s*,\s*", ", "), (r"\[\s+", "["), (r"\s+\]", "]"), (r",\s*\]", "]")):
        t = F.regexp_replace(t, S + pattern, by)
    return t


def long_decimal(digits: Column) -> Column:
    """Decimal digits of a hex number of any length: limbs of nine decimal digits, lowest first, take one hex digit a step."""
    base = 10**9

    def step(limbs: Column, digit: Column) -> Column:
        def carry(done: Column, limb: Column) -> Column:
            n = limb * 16 + done["carry"]
            return F.struct(F.array_append(done["out"], n % base).alias("out"), F.floor(n / base).alias("carry"))

        start = F.struct(F.array().cast("array<long>").alias("out"), F.conv(digit, 16, 10).cast("long").alias("carry"))
        return F.aggregate(limbs, start, carry, lambda done: F.when(done["carry"] > 0, F.array_append(done["out"], done["carry"])).otherwise(done["out"]))

    limbs = F.aggregate(F.split(digits, ""), F.array(F.lit(0).cast("long")), step)
    return F.array_join(F.transform(F.reverse(limbs), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 9, "0"))), "")


def immediates(t: Column) -> Column:
    """Hex immediates of any length become decimals where an operand may start; ``# 32`` loses its space."""
    parts = F.split(t, r"(?<=^|[,\s\[])(?=#)")
    pattern = r"^#\s*(-?)0x([0-9a-fA-F]+)"

    def decimal(p: Column) -> Column:
        sign, digits = F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 2)
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        value = F.when(F.length(short) <= 16, F.conv(short, 16, 10)).otherwise(long_decimal(short))
        shown = F.concat(F.lit("#"), F.when((sign == "-") & (value != "0"), F.lit("-")).otherwise(F.lit("")), value, F.regexp_replace(p, pattern, ""))
        return F.when(p.rlike(pattern), shown).otherwise(p)

    return F.regexp_replace(F.array_join(F.transform(parts, decimal), ""), r"#\s+(\d+)", "#$1")


def zero_registers(t: Column) -> Column:
    return F.regexp_replace(t, r"\b(w|x)31\b", "$1zr")


def shift_defaults(t: Column) -> Column:
    return F.regexp_replace(t, r",\s*lsl\s+#0\b", "")


#: Branch conditions of two spellings.
SYNONYMS = (("b.hs", "b.cs"), ("b.lo", "b.cc"))


def condition_codes(t: Column) -> Column:
    for old, new in SYNONYMS:
        t = F.regexp_replace(t, rf"\b{old.replace('.', '[.]')}\b", new)
    return t


def memory_operands(t: Column) -> Column:
    return F.regexp_replace(t, r"\[([a-zA-Z0-9_]+),\s*#0\]", "[$1]")


#: The rules in their fixed order; the alias rule follows in ``alias.apply_aliases``.
RULES: tuple[tuple[str, Callable[[Column], Column]], ...] = (
    ("strip_comments", strip_comments),
    ("lowercase", lowercase),
    ("whitespace", whitespace),
    ("immediates", immediates),
    ("zero_registers", zero_registers),
    ("shift_defaults", shift_defaults),
    ("condition_codes", condition_codes),
    ("memory_operands", memory_operands),
)
ALIAS_RULE = "spec_alias"
ALL_RULES = (*(name for name, _ in RULES), ALIAS_RULE)


def normalize_text(df: DataFrame, col: str, out: str = "normalized", trace: str = "applied_rules") -> DataFrame:
    """``df`` with the text after all rules but the alias rule, and the names of the rules that changed it.

    Each rule's text is a column of its own, so no expression is repeated in the next one.
    """
    steps = [F.col(col)]
    for k, (_, rule) in enumerate(RULES):
        df = df.withColumn(f"_t{k}", rule(steps[-1]))
        steps.append(F.col(f"_t{k}"))
    applied = F.array(*(F.when(~a.eqNullSafe(b), F.lit(name)) for (name, _), a, b in zip(RULES, steps, steps[1:], strict=False)))
    df = df.withColumn(out, steps[-1]).withColumn(trace, F.filter(applied, lambda x: x.isNotNull()))
    return df.drop(*(f"_t{k}" for k in range(len(RULES))))


def operands_of(rest: Column) -> Column:
    """Operands split at commas outside brackets, trimmed; an empty last part is dropped."""
    parts = F.transform(F.split(rest, r",(?![^\[]*\])"), strip)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def first_token(t: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(t, F.lit("")), S + r"^\s*(\S*)", 1))
