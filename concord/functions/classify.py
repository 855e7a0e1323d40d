"""Categories of a pair of texts and of a record, and how a source's answer is shown."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.text import first_token, strip

EQUIVALENT = "EQUIVALENT"
#: What a record of the corpus may be.
TAXONOMY = ("VALIDITY", "MNEMONIC", "OPERAND", "ALIAS", "FORMATTING", "NORMALIZATION_UNCERTAIN", "CRASH")
TEXT_CATEGORIES = ("OPERAND", "MNEMONIC", "ALIAS", "FORMATTING", "NORMALIZATION_UNCERTAIN")
#: Worst last: a record has the category of its worst pair.
WORST = (EQUIVALENT, "OPERAND", "NORMALIZATION_UNCERTAIN", "VALIDITY")


def classify_pair(raw_a: Column, raw_b: Column, norm_a: Column, norm_b: Column) -> Column:
    return (
        F.when(raw_a.isNull() | raw_b.isNull(), F.lit("VALIDITY"))
        .when(norm_a.eqNullSafe(norm_b), F.lit(EQUIVALENT))
        .when(first_token(norm_a) == first_token(norm_b), F.lit("OPERAND"))
        .otherwise(F.lit("NORMALIZATION_UNCERTAIN"))
    )


def record_category(texts: list[tuple[Column, Column]]) -> Column:
    """Worst category over all pairs of (raw, normalized) texts; null if all pairs are equivalent."""
    pairs = [classify_pair(a[0], b[0], a[1], b[1]) for a, b in combinations(texts, 2)]
    order = F.array(*map(F.lit, WORST))
    worst = F.element_at(order, F.greatest(*(F.array_position(order, p) for p in pairs), F.lit(1).cast("long")).cast("int"))
    return F.nullif(worst, F.lit(EQUIVALENT))


def rule_name(valid: Column, mnemonic: Column, psname: Column) -> Column:
    """What the baseline shows for a word: the rule's mnemonic, else its name; null if the word isn't valid."""
    return F.when(valid, F.coalesce(F.nullif(mnemonic, F.lit("")), psname))


def composed_text(mnemonic: Column, operands: Column) -> Column:
    """Mnemonic and operands without white space around them; without operands the mnemonic alone; null if both are empty."""
    blank = F.lit("")
    return F.nullif(F.concat_ws(" ", F.nullif(strip(mnemonic), blank), F.nullif(strip(operands), blank)), blank)


def shown(text: Column, valid: Column) -> Column:
    """A source's answer: its text, else its verdict; empty if it gave no verdict."""
    return F.coalesce(text, F.when(valid, F.lit("valid")).when(~valid, F.lit("invalid")), F.lit(""))


def verdicts_of(texts: Column, sources: list[str]) -> Column:
    """A map of verdicts for the full list of sources: a source with a text accepts."""
    return F.map_from_arrays(F.array(*map(F.lit, sources)), F.array(*(F.element_at(texts, s).isNotNull() for s in sources)))
