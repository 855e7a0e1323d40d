"""Alignment of two tokenizers' tokens: incidence matrices in CSR, multiplied row by row, and link counts of a corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.bpe import Bpe
from concord.llm.common import materialize, with_row_key

#: Products that one block of rows of a matrix product expands at once.
BLOCK = 1 << 22
#: Words whose alignment a worker remembers, and characters of texts that are aligned together.
CACHE = 300_000
STRETCH = 1 << 22
#: Id pairs that may be broadcast with their counts (about 20 bytes each).
FEW_PAIRS = 200_000
#: A space between two other characters starts a token in either tokenizer.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


@dataclass
class Csr:
    """A sparse matrix by rows: row i has the columns ``indices[indptr[i] : indptr[i + 1]]``, ascending, with ``data``."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_cols: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1

    @classmethod
    def of_sizes(cls, sizes: np.ndarray, indices: np.ndarray, n_cols: int) -> Csr:
        """Ones at ``indices``, of which each row takes its size's number."""
        return cls(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), indices, np.ones(len(indices), np.int64), n_cols)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """The symbolic pass: how many single products each row of ``a b`` adds up."""
    each = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices])])
    return each[a.indptr[1:]] - each[a.indptr[:-1]]


def gustavson(a: Csr, b: Csr, block: int = BLOCK) -> Iterator[tuple[int, Csr]]:
    """``a b`` in blocks of rows, each with its first row's number.

    Row i of the product is the sum of the rows of ``b`` that row i of ``a`` names. A block expands about ``block``
    products, and at least one row's.
    """
    done = np.concatenate([[0], np.cumsum(product_sizes(a, b))])
    lo = 0
    while lo < a.n_rows:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + block, "right")) - 1)
        e0, e1 = int(a.indptr[lo]), int(a.indptr[hi])
        named = a.indices[e0:e1]
        first, count = b.indptr[named], b.indptr[named + 1] - b.indptr[named]
        before = np.cumsum(count) - count
        at = np.repeat(first - before, count) + np.arange(int(count.sum()))
        row = np.repeat(np.repeat(np.arange(lo, hi), np.diff(a.indptr[lo : hi + 1])), count)
        key, value = (row - lo) * b.n_cols + b.indices[at], np.repeat(a.data[e0:e1], count) * b.data[at]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        key, value = key[new], np.add.reduceat(value, new) if len(new) else value
        yield lo, Csr(np.searchsorted(key, np.arange(hi - lo + 1) * b.n_cols), key % b.n_cols, value, b.n_cols)
        lo = hi


def piece_bytes(model) -> list[bytes]:
    """The bytes that each piece of a sentencepiece model stands for."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def spelled(ids: np.ndarray, n: np.ndarray, bytes_of: np.ndarray, size_of: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pieces (``n`` of the ids each) give the ``size`` bytes of ``raw`` that belong to them."""
    part = np.repeat(np.arange(len(n)), n)
    same = np.bincount(part, size_of[ids], minlength=len(n)) == size
    ids = ids[same[part]]
    count = size_of[ids]
    first = np.cumsum(size_of) - size_of
    given = bytes_of[np.repeat(first[ids] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    of = np.repeat(np.arange(len(n)), size)
    kept = same[of]
    return same & (np.bincount(of[kept], given != raw[kept], minlength=len(n)) == 0)


@dataclass
class Aligned:
    """Tokens of some pieces of text, one after the other, and what their matrices give.

    ``part_a, part_b``: the piece of a token; ``group_a, group_b``: its group; the groups of a piece are in a row, and so
    are the tokens of a group.
    """

    ok: np.ndarray
    ids_a: np.ndarray
    ids_b: np.ndarray
    part_a: np.ndarray
    part_b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    part_of_group: np.ndarray
    bytes_a: Csr  # tokens of A by bytes
    bytes_b: Csr  # bytes by tokens of B
    groups_a: Csr  # tokens of A by groups
    groups_b: Csr  # groups by tokens of B

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``a, b, n_bytes``: tokens that share bytes, and how many."""
        return _entries(gustavson(self.bytes_a, self.bytes_b))

    def companions(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``a, b, 1``: tokens of one group."""
        return _entries(gustavson(self.groups_a, self.groups_b))


def _entries(blocks: Iterator[tuple[int, Csr]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for lo, block in blocks:
        yield np.repeat(np.arange(lo, lo + block.n_rows), np.diff(block.indptr)), block.indices, block.data


class Aligner:
    """Both tokenizers, given as their files' bytes, and the alignment of words seen before."""

    def __init__(self, spec: bytes, model: bytes):
        import sentencepiece

        self.a, self.b = Bpe(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
        spellings = self.a.bytes_of, piece_bytes(self.b)
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in spellings)
        self.bytes_a, self.bytes_b = (np.frombuffer(b"".join(x), np.uint8) for x in spellings)
        # words are aligned apart if no piece goes on after a space and the model leaves the characters as they are
        goes_on = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.size_b)))
        samples = ["a  b", "ﬁ ①", "é é", " x ", "\tY\n"]
        as_is = all(self.b.normalize(s) == "▁" + s.replace(" ", "▁") for s in samples)
        self.by_words = as_is and not goes_on
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        self.sizes = np.zeros((0, 6), np.int64)  # ok, tokens of A, of B, groups, overlaps, shared-group links
        self.links_to = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of a space and each piece, their numbers, and whether both give the piece's bytes again."""
        words = [self.a.split.findall(" " + p) for p in pieces]
        self.a.learn(set(chain.from_iterable(words)))
        packed = [b"".join(map(self.a.ids.__getitem__, ws)) for ws in words]
        found = self.b.encode(pieces, num_threads=1)
        raw = [b" " + p.encode() for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.frombuffer(b"".join(raw), np.uint8)
        ids_a, n_a = np.frombuffer(b"".join(packed), np.uint32).astype(np.int64), np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ids_b, n_b = np.fromiter(chain.from_iterable(found), np.int64), np.fromiter(map(len, found), np.int64, len(found))
        ok = spelled(ids_a, n_a, self.bytes_a, self.size_a, whole, size) & spelled(ids_b, n_b, self.bytes_b, self.size_b, whole, size)
        return ok, ids_a[np.repeat(ok, n_a)], ids_b[np.repeat(ok, n_b)], n_a * ok, n_b * ok

    def align(self, pieces: list[str]) -> Aligned:
        """The matrices of some pieces of text; their bytes stand one after the other."""
        ok, ids_a, ids_b, n_a, n_b = self.tokens(pieces)
        part_a, part_b = np.repeat(np.arange(len(pieces)), n_a), np.repeat(np.arange(len(pieces)), n_b)
        size_a, size_b = self.size_a[ids_a], self.size_b[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        ends = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        last = np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True)[: len(group_a)])
        n_bytes = int(size_a.sum())
        return Aligned(
            ok, ids_a, ids_b, part_a, part_b, group_a, group_b, part_a[last],
            Csr.of_sizes(size_a, np.arange(n_bytes), n_bytes),
            Csr.of_sizes(np.ones(n_bytes, np.int64), np.repeat(np.arange(len(ids_b)), size_b), len(ids_b)),
            Csr.of_sizes(np.ones(len(ids_a), np.int64), group_a, len(ends)),
            Csr.of_sizes(np.bincount(group_b, minlength=len(ends)), np.arange(len(ids_b)), len(ids_b)),
        )

    def learn(self, keys: list[str]) -> None:
        """Align words not seen before."""
        x = self.align([k[1:] if k[:1] == " " else k for k in keys])
        n = len(keys)
        pairs, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b, _ in x.overlaps():
            pairs.append(x.ids_a[a] * len(self.size_b) + x.ids_b[b])
            parts.append(x.part_a[a])
        pairs, parts = np.concatenate(pairs), np.concatenate(parts)
        count = lambda part, weights=None: np.bincount(part, weights, minlength=n).astype(np.int64)
        companions = count(x.part_a, product_sizes(x.groups_a, x.groups_b))
        sizes = np.stack([x.ok, count(x.part_a), count(x.part_b), count(x.part_of_group), count(parts), companions], axis=1)
        # ids in the order of the groups, A's before B's; what follows an id depends on whether its group goes on
        place_a = np.arange(len(x.ids_a)) + np.searchsorted(x.group_b, x.group_a, "left")
        place_b = np.arange(len(x.ids_b)) + np.searchsorted(x.group_a, x.group_b, "right")
        out = np.empty(len(place_a) + len(place_b), object)
        for place, ids, group, end in ((place_a, x.ids_a, x.group_a, "|"), (place_b, x.ids_b, x.group_b, ";")):
            goes_on = np.append(group[1:] == group[:-1], False)[: len(group)].tolist()
            out[place] = [f"{i}," if g else f"{i}{end}" for i, g in zip(ids.tolist(), goes_on, strict=True)]
        to = np.cumsum(sizes[:, 1] + sizes[:, 2]).tolist()
        self.shown += ["".join(out[lo:hi])[:-1] for lo, hi in zip([0, *to], to, strict=False)]
        self.known.update(zip(keys, range(len(self.known), len(self.known) + n), strict=True))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.links_to = np.concatenate([self.links_to, self.links_to[-1] + np.cumsum(sizes[:, 4])])
        self.links = np.concatenate([self.links, pairs])

    def keys(self, text: str) -> list[str]:
        """The words that a text is cut into. Those with white space at an end, or empty, have a space before them here, so
        they are no other text's words."""
        if not self.by_words:
            return [" " + text]
        words = text.split(" ")
        if all(w and not w[0].isspace() and not w[-1].isspace() for w in filterfalse(self.known.__contains__, words)):
            return words
        return [" " + w for w in BETWEEN.split(text)]

    def summaries(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens of A, of B, groups, overlaps, shared-group links (rows of one array); the digest of its groups;
        and, as ends, pairs and times, the different id pairs that it holds linked and how often."""
        if len(self.known) > CACHE:
            self.forget()
            self.a.ids.clear()
            self.a.shown.clear()
        keys = [self.keys(t) if t else [] for t in texts]
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(keys)))
        if new:
            self.learn(sorted(new))
        n = np.fromiter(map(len, keys), np.int64, len(keys))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(keys)), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(texts)), n)
        good = (n > 0) & (np.bincount(of, 1 - self.sizes[at, 0], minlength=len(texts)) == 0)
        sizes = np.stack([np.bincount(of, self.sizes[at, k], minlength=len(texts)).astype(np.int64) for k in range(1, 6)]) * good
        to = np.cumsum(n).tolist()
        shown, places = self.shown.__getitem__, at.tolist()
        digests = [hashlib.sha256(";".join(map(shown, places[hi - len(ks) : hi])).encode()).hexdigest() if g else "" for ks, hi, g in zip(keys, to, good.tolist(), strict=True)]
        at, of = at[good[of]], of[good[of]]
        count = self.links_to[at + 1] - self.links_to[at]
        flat = np.repeat(self.links_to[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        span = len(self.size_a) * len(self.size_b)
        found, times = np.unique(np.repeat(of, count) * span + self.links[flat], return_counts=True)
        ends = np.searchsorted(found, np.arange(len(texts) + 1) * span)
        return sizes, digests, ends, found % span, times


_loaded: dict[int, Aligner] = {}


def _broadcast(docs: DataFrame, spec: str, model: str):
    """Both files' bytes: their size depends on the vocabularies only (2 MB)."""
    files = []
    for path in (spec, model):
        with open(path, "rb") as f:
            files.append(f.read())
    return docs.sparkSession.sparkContext.broadcast((hash(tuple(files)), *files))


def _aligner(shared) -> Aligner:
    """One pair of tokenizers per Python worker."""
    if shared.value[0] not in _loaded:
        _loaded[shared.value[0]] = Aligner(*shared.value[1:])
    return _loaded[shared.value[0]]


def together(texts: list[str], most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Runs of texts of bounded size; a longer text is one by itself."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= most):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_group_links")
ALIGNED = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, spec: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the numbers of its tokens, groups and links, the digest of its groups, and the different
    id pairs that it holds linked, as ``a * (size of B) + b``, with how often it does.

    Words between single spaces are aligned once for each worker and stretch of text: neither tokenizer has a token that
    goes on after such a space. Other models than these go by whole texts.
    """
    shared = _broadcast(docs, spec, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in together(texts):
                sizes, digests, ends, pairs, times = aligner.summaries(texts[lo:hi])
                lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int64))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, sizes), pa.array(digests, pa.string()), *lists], names=["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ALIGNED)


def token_links(docs: DataFrame, spec: str, model: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The links themselves: ``doc_id, a, b, a_id, b_id, weight`` for token number ``a`` of A and ``b`` of B.

    ``kind="overlap"``: tokens that share bytes, ``weight`` being how many. ``kind="group"``: tokens of one group, weight 1; a
    group gives as many links as it has pairs of tokens, which leave the worker in blocks.
    """
    shared = _broadcast(docs, spec, model)
    names = ["doc_id", "a", "b", "a_id", "b_id", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                x = aligner.align([text])
                for a, b, weight in x.overlaps() if kind == "overlap" else x.companions():
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(a), pa.int64()), *map(pa.array, (a, b, x.ids_a[a], x.ids_b[b], weight))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: in how many documents an id pair is linked, and whether none of A's id is in more.

    The highest counts are a row per id of A, so their number is bounded by the vocabulary, and they are broadcast.
    """
    counted = materialize(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "alignment-counts")
    id_a = F.expr(f"pair div {size_b}").alias("id_a")
    highest = counted.groupBy(id_a).agg(F.max("n").alias("highest"))
    return counted.withColumn("id_a", id_a).join(F.broadcast(highest), "id_a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def alignment_summary(docs: DataFrame, spec: str, model: str, id_col: str = "doc_id", text_col: str = "text", few_pairs: int = FEW_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256`` per document.

    A is a byte-level BPE file of the tokenizers library (of a space and the text, special tokens' strings being ordinary
    text), B a sentencepiece BPE model, which adds the space itself. Links are pairs of token occurrences that share
    bytes; a pair of ids counts once in each document that holds it linked. Pairs in over a ``few_pairs``-th of all
    (document, pair) cases are at most ``few_pairs``; they are most of the cases and are broadcast, so that no task gathers a
    pair that all documents have. The others meet their counts in an exchange.

    Defined cases: null and empty texts, and those that either tokenizer doesn't give back byte by byte (such as with
    U+2581), have zeros and an empty digest; texts of any length are aligned whole; repeated rows are documents of their
    own and count again; null ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    rows, key = with_row_key(aligned(docs, spec, model, id_col, text_col), "alignment-rows")
    scored = materialize(pair_counts(rows, size_b), "alignment-scored")
    cases = scored.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") > cases / few_pairs
    cased = rows.select(key, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(key, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    hot = F.broadcast(scored.where(frequent))
    both = cased.join(hot, "pair").unionByName(cased.join(hot.select("pair"), "pair", "left_anti").join(scored.where(~frequent), "pair").select("pair", key, "times", "n", "best"))
    sums = both.groupBy(key).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.select(key, "doc_id", *COUNTS, "groups_sha256").join(sums, key, "left").select("doc_id", *COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
