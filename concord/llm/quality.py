"""Quality rules: per-document rules and the cross-document frequency of lines per host."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import materialize

SYMBOLS = b"#*$%&|<>"
#: UTF-8 continuation bytes: all bytes but these start a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Copies of each frequent line among the join keys, so that the rows of one very common line spread over tasks.
SALT = 32
#: Frequent lines that are broadcast; more of them meet the lines in a salted exchange.
FEW_LINES = 500_000


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more in the text, first occurrences included."""
    n = len(words) - 2
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)[1].astype(np.int64)
    _, window, count = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def line_hash(line: bytes) -> int:
    """XXH64 of the line with A-Z lower-cased and white space collapsed."""
    return xxhash.xxh64_intdigest(b" ".join(line.lower().split())) - (1 << 63)


def measures(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the text's different lines with their words."""
    words = text.split()
    inside = text.translate(None, SPACES)
    word_chars = len(inside.translate(None, CONTINUATION))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, n_dup, lines = set(), 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            n_dup += line in seen
            seen.add(line)
            h = line_hash(line)
            lines[h] = lines.get(h, 0) + n
    return len(words), word_chars, n_symbols, n_dup, repeated_words(words), list(lines), list(lines.values())


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("host", pa.string()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("hashes", pa.list_(pa.int64())), ("words", pa.list_(pa.int64()))]
)


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = [measures(t.as_py() or b"") for t in batch.column(2)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=SCHEMA)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").cast("binary").alias("text"))
    fields = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return chosen.mapInArrow(run, f"doc_id long, host string, {fields}, hashes array<long>, words array<long>")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    min_docs: int = 30,
    host_share: float = 0.005,
    least_left: float = 0.5,
    few_lines: int = FEW_LINES,
) -> DataFrame:
    """One row per input row with the rules' figures, the words left without frequent lines, and ``kept``.

    A line is frequent in a host if more than ``min_docs`` and more than ``host_share`` of the host's documents hold
    it; lines are compared by a 64-bit hash of their normalised bytes and counted once per document, with map-side
    combine. A host has no more frequent lines than the lines of its mean document by ``1 / host_share``, so they are broadcast up to
    ``few_lines``, and the lines of documents stay where they are. Frequent lines go; a document with less than ``least_left`` of its words left is rejected.

    Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows
    are documents of their own; a null id is an id like others; other columns are ignored; an empty table gives none.
    """
    base = materialize(measured(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "quality-base")
    host = F.coalesce(F.concat(F.lit("="), F.col("host")), F.lit("-")).alias("host")
    lines = base.select("row", host, F.explode(F.arrays_zip("hashes", "words")).alias("l")).select("row", "host", F.col("l.hashes").alias("hash"), F.col("l.words").alias("words"))
    limits = base.groupBy(host).agg(F.greatest(F.lit(float(min_docs)), F.count("*") * F.lit(host_share)).alias("limit"))
    frequent = lines.groupBy("host", "hash").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs).join(limits, "host").where("docs > limit")
    frequent = materialize(frequent.select("host", "hash"), "quality-frequent")
    if frequent.count() <= few_lines:
        hit = lines.join(F.broadcast(frequent), ["host", "hash"])
    else:
        salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hit = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALT)).cast("int")).join(salted, ["host", "hash", "salt"])
    removed = hit.groupBy("row").agg(F.sum("words").alias("removed"), F.count("*").alias("frequent_lines"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        base.drop("hashes", "words")
        .join(removed, "row", "left")
        .withColumn("words_left", left)
        .withColumn("frequent_lines", F.coalesce("frequent_lines", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.col("n_words") * least_left))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "frequent_lines", "words_left")
    )
