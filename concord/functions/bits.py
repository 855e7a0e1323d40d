"""Words, shards, blocks and the 64 verdicts of a block as bits of a long."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BITS = 6


def shard_of(word: Column, shard_bits: int) -> Column:
    return F.shiftright(word, shard_bits)


def block_of(word: Column) -> Column:
    return F.shiftright(word, BLOCK_BITS)


def place_of(word: Column) -> Column:
    """Place of a word in its block."""
    return word.bitwiseAND(63).cast("int")


def bit_at(word: Column) -> Column:
    """A long with only the word's bit set; bit 63 makes it negative."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place_of(word))


def get_bit(bits: Column, word: Column) -> Column:
    return F.getbit(bits, place_of(word)) == 1


def popcount(bits: Column) -> Column:
    return F.bit_count(bits).cast("long")


def xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def all_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), masks)


def any_of(*masks: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), masks)


def none_of(*masks: Column, tail: Column | None = None) -> Column:
    """Places that no mask has; ``tail`` marks the places that exist in the last block."""
    return F.bitwise_not(any_of(*masks)).bitwiseAND(tail if tail is not None else F.lit(-1).cast("long"))


def differing(*masks: Column) -> Column:
    """Places on which the sources are not of one mind."""
    return any_of(*masks).bitwiseAND(F.bitwise_not(all_of(*masks)))


def existing(block: Column, n_words: int) -> Column:
    """Places of a block that are words of the domain ``[0, n_words)``."""
    full, rest = n_words >> BLOCK_BITS, n_words & 63
    return F.when(block < full, F.lit(-1).cast("long")).when((block == full) & F.lit(rest > 0), F.lit((1 << rest) - 1).cast("long")).otherwise(F.lit(0).cast("long"))


def words_in(block: Column, mask: Column) -> Column:
    """The words whose bit is set, ascending."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(mask, i) == 1)
    return F.transform(places, lambda i: block * 64 + i)


def word_text(word: Column) -> Column:
    """``0x`` and eight lower-case hex digits, always padded."""
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(word), 8, "0")))


def parse_word(text: Column) -> Column:
    """The number of a hex string with or without ``0x``; null if it isn't one, or not below 2**63."""
    plain = F.substring(text, 3, 8)  # of the form that ``word_text`` gives, which needs no regular expression
    usual = (F.length(text) == 10) & text.startswith("0x") & (F.translate(plain, "0123456789abcdef", "") == "")
    digits = F.regexp_replace(F.trim(text), "^0[xX]", "")
    good = digits.rlike("^0*(?:[0-7][0-9a-fA-F]{15}|[0-9a-fA-F]{1,15})$")
    return F.when(usual, F.conv(plain, 16, 10).cast("long")).when(good, F.conv(F.regexp_replace(digits, "^0+(?=.)", ""), 16, 10).cast("long"))
