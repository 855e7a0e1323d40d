"""Ranked lexical search: best-first over intervals of documents, bounded by range-maximum queries on posting lists."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import materialize, release

#: Terms of the items that are searched for in one pass over the documents; they and their counts are broadcast.
ITEM_TERMS = 500_000
#: Postings and documents of one index; a worker holds one at a time.
POSTINGS = 1 << 20
DOCUMENTS = 1 << 15
#: Intervals that one step of a search splits, at first and at most.
FIRST_STEP, LARGEST_STEP = 4, 256
#: ASCII letters and digits are lower-cased and kept, other ASCII separates, bytes of other characters are kept.
TERM_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, repeats included."""
    return text.encode().translate(TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term with its weight and frequency adds to the score of a document of this length."""
    if 90 * int(length.max(initial=0)) * n_docs >= 1 << 63:
        length = length.astype(object)
    m = 100 - 90 + (90 * length * n_docs // n_terms).astype(np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Index:
    """Posting lists of some documents, which are numbered from 0, and a sparse table for the place of the highest impact
    in any range of a list."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        order = np.lexsort((doc, term))
        self.n_docs, self.doc, self.impact = n_docs, doc[order], impact[order]
        self.key = term[order] * n_docs + self.doc
        longest = int(np.bincount(term).max(initial=1))
        place = np.int32 if len(doc) < 1 << 31 else np.int64
        self.table = [np.arange(len(doc), dtype=place)]
        while 2 ** len(self.table) <= longest:
            half, below = 2 ** (len(self.table) - 1), self.table[-1]
            left, right = below[:-half], below[half:]
            best = below.copy()
            best[:-half] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.table.append(best)
        self.table = np.stack(self.table)

    def places(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Where each document (rows) stands, or would, in each term's list (columns)."""
        return np.searchsorted(self.key, terms * self.n_docs + docs[:, None])

    def bounds(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval (rows; where it begins and ends in the terms' lists) the sum of the terms' highest impacts in
        it, which no document's score exceeds, and the document that has the highest of these."""
        size = right - left
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        a = self.table[level, np.where(some, left, 0)]
        b = self.table[level, np.where(some, right - (1 << level), 0)]
        of_a, of_b = self.impact[a], self.impact[b]
        value = np.where(some, np.maximum(of_a, of_b), 0)
        row, most = np.arange(len(left)), value.argmax(axis=1)
        first = of_a[row, most] >= of_b[row, most]
        return value.sum(axis=1), self.doc[np.where(first, a[row, most], b[row, most])]

    def scores(self, terms: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of documents, with where each document begins and ends in the terms' lists."""
        at = self.places(terms, docs)
        near = np.minimum(at, len(self.key) - 1)
        there = self.key[near] == terms * self.n_docs + docs[:, None]
        return np.where(there, self.impact[near], 0).sum(axis=1), at, at + there


class Best:
    """The k best documents of an item so far, by falling score and rising id; rows without an id come last."""

    def __init__(self, k: int):
        self.k, self.heap = k, []  # the worst first

    def offer(self, score: int, doc_id: int | None) -> None:
        row = (score, doc_id is not None, -doc_id if doc_id is not None else 0)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, row)
        elif row > self.heap[0]:
            heapq.heapreplace(self.heap, row)

    def closed(self, bound: int, least_id: int | None) -> bool:
        """Whether documents of at most this score, of which this id is the smallest, can't get in."""
        return len(self.heap) == self.k and (bound, least_id is not None, -least_id if least_id is not None else 0) <= self.heap[0]

    def rows(self) -> list[tuple[int, int | None]]:
        return [(score, -negative if known else None) for score, known, negative in self.heap]


def search(index: Index, terms: np.ndarray, ids: list, best: Best) -> int:
    """Offer to ``best`` the documents of the index that may belong to it; ``ids`` are ascending, None last.

    The open interval of the highest bound is split at the document that has the highest impact in it: this one is
    scored, and what is left and right of it gets bounds of its own. Several intervals are split in one step. Ends when no
    open interval's bound can beat the worst of the best. Returns how many documents were scored.
    """
    if not len(terms) or not len(index.doc):
        return 0
    ends = index.places(terms, np.array([0, index.n_docs]))
    bound, at = index.bounds(ends[:1], ends[1:])
    heap = [(-int(bound[0]), 0, index.n_docs, int(at[0]), ends[0], ends[1])]
    step, scored = FIRST_STEP, 0
    while heap:
        open_ = []
        while heap and len(open_) < step:
            part = heapq.heappop(heap)
            if not best.closed(-part[0], ids[part[1]]):
                open_.append(part)
            elif -part[0] < best.heap[0][0]:
                heap.clear()  # no other has a higher bound
        if not open_:
            break
        _, lo, hi, docs, left, right = zip(*open_, strict=True)
        score, begin, end = index.scores(terms, np.array(docs))
        for doc, x in zip(docs, score.tolist(), strict=True):
            if x > 0:
                best.offer(x, ids[doc])
        left, right = np.concatenate([left, end]), np.concatenate([begin, right])
        bound, at = index.bounds(left, right)
        parts = chain(zip(lo, docs, strict=True), zip((d + 1 for d in docs), hi, strict=True))
        for i, ((a, b), most, split) in enumerate(zip(parts, bound.tolist(), at.tolist(), strict=True)):
            if most > 0 and not best.closed(most, ids[a]):
                heapq.heappush(heap, (-most, a, b, split, left[i], right[i]))
        scored += len(open_)
        step = min(2 * step, LARGEST_STEP)
    return scored


FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document that has a term: how many it has in all, and which of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            n, found = [], []
            for text in batch.column(1):
                words = terms_of(text.as_py() or "")
                n.append(len(words))
                found.append([x for x in map(number.get, words) if x is not None])
            n = np.array(n, np.int64)
            each = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.repeat(np.arange(len(found)), each) * max(len(number), 1) + np.fromiter(chain.from_iterable(found), np.int64, int(each.sum()))
            flat, tf = np.unique(flat, return_counts=True)
            ends = np.searchsorted(flat, np.arange(len(found) + 1) * max(len(number), 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (flat % max(len(number), 1), tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FORWARD)


def candidates(rows: DataFrame, items: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, postings: int = POSTINGS) -> DataFrame:
    """``item, doc_id, score``: the ``k`` best of each item among the documents of one task."""
    shared = rows.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(k) for _ in items]
        held, size, count = [], 0, 0

        def close() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            # rows without an id come last
            table = table.take(pa.compute.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            lists = table.column("terms").combine_chunks()
            each = np.diff(lists.offsets.to_numpy())
            term, tf = (table.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
            doc = np.repeat(np.arange(len(table)), each)
            impact = impacts(weights[term], tf, table.column("n").to_numpy()[doc], n_docs, n_terms)
            some = impact > 0
            index, ids = Index(term[some], doc[some], impact[some], len(table)), table.column("doc_id").to_pylist()
            there = np.bincount(term[some], minlength=len(weights)) > 0
            for (_, terms), of in zip(items, best, strict=True):
                search(index, terms[there[terms]], ids, of)

        for batch in batches:
            lo = 0
            ends = np.append(0, np.cumsum(pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)))
            while lo < len(batch):
                hi = int(np.searchsorted(ends, ends[lo] + postings - size, "right")) - 1
                hi = min(max(hi, lo + (not held)), lo + DOCUMENTS - count, len(batch))
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
                    size, count, lo = size + int(ends[hi] - ends[lo]), count + hi - lo, hi
                if lo < len(batch):
                    close()
                    held, size, count = [], 0, 0
        if held:
            close()
        found = [(items[i][0], doc_id, score) for i, of in enumerate(best) for score, doc_id in of.rows()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def top(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_terms: int = ITEM_TERMS, postings: int = POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each item, of those with a score above 0.

    Items are dealt to blocks of about ``item_terms`` terms, so what is broadcast (the block's terms, weights and items)
    is bounded; each block is one pass that counts its terms in every document and writes the counts, and one that searches
    them. A task indexes up to ``postings`` postings at a time and keeps only ``k`` documents of an item, whose scores also
    bound the search of its next documents. The tasks' rows are cut to ``k`` in shares and then by item.

    Defined cases: null texts have no terms; items without a term, or whose terms no document has, give no rows; equal
    scores are ranked by ascending id, rows without an id last; repeated rows are documents, or items, of their own, so an
    item that stands twice gets its rows twice; texts are read whole; other columns are ignored; an empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py() or ""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).mapInArrow(split, "item_id long, terms array<binary>")
    asked = materialize(asked.where("size(terms) > 0").withColumn("item", F.monotonically_increasing_id()), "lexical-items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // item_terms)
    found, total = None, None
    for block in range(blocks):
        chosen = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "terms").collect()  # bounded by item_terms
        vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for r in chosen for t in r.terms}))}
        rows = materialize(forward(docs, vocabulary, id_col, text_col), "lexical-forward")
        n_docs, n_terms = total = total or rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # one row per term of the block
            df[r.term] = r.df
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        numbered = [(r.item, np.array([vocabulary[bytes(t)] for t in r.terms], np.int64)) for r in chosen]
        part = materialize(candidates(rows, numbered, weights, n_docs, n_terms, k, postings).withColumn("share", F.spark_partition_id() % 256), "lexical-found")
        release(rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    last = top(top(found, k, "item", "share").drop("rank"), k, "item")
    return last.join(asked.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
