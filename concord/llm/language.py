"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest context, in bytes.
ORDER = 3
#: Documents per language that the model is fitted on; the bound of all statistics.
SAMPLE_DOCS = 150
#: Bytes scored at a time, about.
STRETCH = 1 << 20
LETTER = regex.compile(r"\p{L}")


def folded(text: str) -> bytes:
    """What the model sees: the lower-cased text in UTF-8."""
    return text.lower().encode()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def grams(data: bytes) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one number (context first); the text starts after spaces."""
    b = np.frombuffer(b" " * ORDER + data, np.uint8).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | b[k : k + len(data)]
    return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """Of each language the ``per_lang`` documents of smallest hashed id, whole, of those that are not held out."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(F.col("doc_id")), F.lit(True))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("_rank", rank).where(F.col("_rank") <= per_lang)
    return known.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")  # at most per_lang ids of a language


def count_grams(rows: DataFrame) -> pd.DataFrame:
    """``lang, gram, n`` over the bounded sample, counted in tasks and summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gram, n = np.unique(grams(folded(text.as_py())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()


class Ppm:
    """Context trees of all languages and the exact code length of every byte after every known context.

    Escapes follow method C: after a context seen n times with d different bytes, a byte seen c times has probability
    c / (n + d), the escape to the next shorter context d / (n + d). Below the empty context all 256 bytes are equal.
    A context that a language never saw is left for the next shorter one at no cost. Statistics are frozen: scoring a
    text changes nothing, so the length of a byte depends on the ORDER bytes before it only.

    A tree is kept as, per language and order, the sorted contexts with the bits of their escape and the sorted (context,
    byte) pairs with their bits: what was seen in the sample, whatever the number of languages and scripts. The different
    grams of a stretch of texts are looked up once each.
    """

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts.lang.unique().tolist(), key=lambda s: s.encode())
        #: Per language, from the longest order to the empty context: contexts, bits of escape, pairs, bits of the byte.
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        for lang in self.langs:
            mine, tree = counts[counts.lang == lang], []
            for order in range(ORDER, -1, -1):
                full, inverse = np.unique(mine.gram.to_numpy(np.int64) & (1 << 8 * (order + 1)) - 1, return_inverse=True)
                c = np.bincount(inverse, mine.n.to_numpy(), len(full))
                known, ctx = np.unique(full >> 8, return_inverse=True)
                n, d = np.bincount(ctx, c, len(known)), np.bincount(ctx, minlength=len(known))
                tree.append((known.astype(np.uint32), np.log2((n + d) / d), full.astype(np.uint32), np.log2((n + d)[ctx] / c)))
            self.trees.append(tree)

    def bits_of(self, gram: np.ndarray) -> np.ndarray:
        """``(grams, languages)``: bits of the last byte of each gram after the others."""
        out = np.zeros((len(gram), len(self.langs)))
        for i, tree in enumerate(self.trees):
            open_ = np.arange(len(gram))
            for order, (known, escape, full, byte) in zip(range(ORDER, -1, -1), tree, strict=True):
                wanted = gram[open_] & np.uint32((1 << 8 * (order + 1)) - 1)
                at = np.minimum(np.searchsorted(full, wanted), len(full) - 1)
                hit = full[at] == wanted
                out[open_[hit], i] += byte[at[hit]]
                open_, wanted = open_[~hit], wanted[~hit] >> np.uint32(8)
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                out[open_, i] += np.where(known[at] == wanted, escape[at], 0)
            out[open_, i] += 8
        return out

    def lengths_of(self, texts: list[bytes]) -> np.ndarray:
        """``(texts, languages)``: bits that each language needs for each text; a text over STRETCH bytes is scored by parts."""
        total = np.zeros((len(texts), len(self.langs)))
        held, owner, size = [], [], 0

        def score() -> None:
            nonlocal held, owner, size
            different, at = np.unique(np.concatenate(held), return_inverse=True)
            first = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(total, owner, np.add.reduceat(self.bits_of(different)[at], first, axis=0))
            held, owner, size = [], [], 0

        for k, text in enumerate(texts):
            for lo in range(0, len(text), STRETCH):
                # the part with the bytes before it
                part = grams(text[max(lo - ORDER, 0) : lo + STRETCH])[min(lo, ORDER) :]
                held.append(part)
                owner.append(k)
                size += len(part)
                if size >= STRETCH:
                    score()
        if held:
            score()
        return total

    def lengths(self, data: bytes) -> np.ndarray:
        """Bits that each language needs for the data."""
        return self.lengths_of([data])[0]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of the least bits and its share of the likelihood, for each text."""
        out = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        bits = self.lengths_of([folded(texts[i]) for i in known])
        for i, b in zip(known, bits, strict=True):
            best = int(np.argmin(b))  # ties: the first language
            out[i] = (self.langs[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum()))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_DOCS) -> Ppm:
    """Fit on at most ``per_lang`` documents of each language; the model's size is bounded by that sample."""
    return Ppm(count_grams(sample(docs, id_col, text_col, lang_col, per_lang)))


def predictions(docs: DataFrame, model: Ppm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; score is the language's share of the likelihood.

    Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language first by
    code points; null ids count as not held out; repeated rows give equal rows; without any labelled row all are
    ``und``; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows of ``docs`` that are not held out and predict all of its rows."""
    return predictions(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``lang`` replaced by the prediction; rows that are ``und`` go. Other columns stay as they are."""
    shared, at, text_at = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, lang_col)), docs.columns.index(lang_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([lang for lang, _ in shared.value.predict(batch.column(text_at).to_pylist())], pa.string())
            columns = [found if i == at else c for i, c in enumerate(batch.columns)]
            known = pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pc.not_equal(found, "und"))
            if known.num_rows:
                yield known

    return docs.withColumn(lang_col, F.col(lang_col).cast("string")).mapInArrow(run, docs.withColumn(lang_col, F.col(lang_col).cast("string")).schema)
