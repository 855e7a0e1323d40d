"""Byte-level BPE encoding and decoding by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of byte-level BPE vocabularies of this family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.iinfo(np.int64).max
#: Longer words go through a heap: rounds over them would cost the square of their length.
LONG_WORD = 4096
#: Characters split at a time; a space between two other characters always starts a token, so texts are cut there.
STRETCH = 1 << 19
CACHE = 300_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, others follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Vocabulary and merges of a tokenizer file, given as the file's bytes."""

    def __init__(self, spec: bytes):
        spec = json.loads(spec)
        vocab, merges, chars = spec["model"]["vocab"], spec["model"]["merges"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.split = regex.compile(SPLIT)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair among the sorted keys, and its rank (NONE if it never merges)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``(word, id)`` of all tokens, in order. Each round merges the lowest-ranked pair of every unfinished word."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            at, rank = self.look_up(sym[:-1], sym[1:])
            last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
            rank = np.append(rank, NONE)
            rank[last] = NONE
            first = np.append(0, last[:-1] + 1)
            count = last - first + 1
            best = np.minimum.reduceat(rank, first)
            go = np.repeat(best < NONE, count)
            hit = np.flatnonzero((rank == np.repeat(best, count)) & go)
            # of a run of overlapping hits (the same symbol again and again) every second one merges, from the left
            start = np.append(True, hit[1:] != hit[:-1] + 1)[: len(hit)]
            run = np.flatnonzero(start)[np.cumsum(start) - 1] if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            done.append((word[~go], sym[~go]))
            sym[hit] = self.merged[at[hit]]
            go[hit + 1] = False
            sym, word = sym[go], word[go]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return word[order], sym[order]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one very long word, with a heap of pairs by (rank, place)."""
        sym = self.of_byte[np.frombuffer(word, np.uint8)]
        at, rank = self.look_up(sym[:-1], sym[1:])
        ids, n = sym.tolist(), len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(rank[i]), int(i), ids[i], ids[i + 1]) for i in np.flatnonzero(rank < NONE)]
        heapq.heapify(heap)
        merged = {}

        def push(i: int, j: int) -> None:
            pair = (ids[i], ids[j])
            if pair not in merged:
                p, r = self.look_up(np.array([pair[0]]), np.array([pair[1]]))
                merged[pair] = (int(r[0]), int(self.merged[p[0]]))
            if merged[pair][0] < NONE:
                heapq.heappush(heap, (merged[pair][0], i, *pair))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            if (a, b) not in merged:
                p, r = self.look_up(np.array([a]), np.array([b]))
                merged[a, b] = (int(r[0]), int(self.merged[p[0]]))
            ids[i], ids[j] = merged[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def learn(self, words: set[str]) -> None:
        """Encode words that the cache lacks."""
        if len(self.ids) > CACHE:
            self.ids.clear()
            self.shown.clear()
        new = [w for w in words if w not in self.ids]
        raw = [w.encode() for w in new]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG_WORD]
        word, sym = self.merge_rounds([raw[i] for i in short])
        bounds = np.searchsorted(word, np.arange(len(short) + 1)).tolist()
        packed, shown = sym.astype(np.uint32).tobytes(), list(map(str, sym.tolist()))
        for k, i in enumerate(short):
            lo, hi = bounds[k], bounds[k + 1]
            self.ids[new[i]], self.shown[new[i]] = packed[4 * lo : 4 * hi], ",".join(shown[lo:hi])
        for i, b in enumerate(raw):
            if len(b) > LONG_WORD:
                ids = self.merge_long(b)
                self.ids[new[i]], self.shown[new[i]] = np.array(ids, np.uint32).tobytes(), ",".join(map(str, ids))

    def stretches(self, text: str) -> Iterator[str]:
        """Parts of a text between which no token reaches."""
        lo = 0
        while len(text) - lo > STRETCH:
            m = re.compile(r"(?<=\S) (?=\S)").search(text, lo + STRETCH)
            if not m:
                break
            yield text[lo : m.start()]
            lo = m.start()
        yield text[lo:]

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Words of the text's stretches, and the ids of the special tokens between them."""
        plain, specials = (self.cut.split(text), self.cut.findall(text)) if self.cut else ([text], [])
        for k, part in enumerate(plain):
            for stretch in self.stretches(part):
                words = self.split.findall(stretch)
                if words:
                    yield words
            if k < len(specials):
                yield self.special[specials[k]]

    def rendered(self, piece: list[str] | int) -> tuple[bytes, str]:
        """Ids of a piece with known words, as little-endian 32-bit bytes and as decimals joined by commas."""
        if isinstance(piece, int):
            return np.uint32(piece).tobytes(), str(piece)
        return b"".join(map(self.ids.__getitem__, piece)), ",".join(map(self.shown.__getitem__, piece))

    def encode(self, text: str) -> Iterator[tuple[bytes, str]]:
        """Parts of the ids of a text, of bounded size."""
        for piece in self.pieces(text):
            if not isinstance(piece, int):
                self.learn(set(piece))
            yield self.rendered(piece)

    def encode_many(self, texts: list[str]) -> Iterator[Iterator[tuple[bytes, str]]]:
        """The parts of each text; words of neighbouring short texts are merged in the same rounds."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STRETCH):
                size += len(texts[hi])
                hi += 1
            if hi == lo + 1:
                yield self.encode(texts[lo])
            else:
                split = [list(self.pieces(t)) for t in texts[lo:hi]]
                self.learn({w for pieces in split for p in pieces if not isinstance(p, int) for w in p})
                for pieces in split:
                    yield map(self.rendered, pieces)
            lo = hi

    def decode(self, ids: bytes) -> str:
        """Text of ids given as little-endian 32-bit bytes; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, np.uint32).tolist())).decode("utf-8", "replace")


_loaded: dict[int, Bpe] = {}


def _bpe(shared) -> Bpe:
    """One vocabulary per Python worker."""
    if shared.value[0] not in _loaded:
        _loaded[shared.value[0]] = Bpe(shared.value[1])
    return _loaded[shared.value[0]]


def _broadcast(docs: DataFrame, path: str):
    """The file's bytes: its size depends on the vocabulary only (1.5 MB for 50,000 tokens)."""
    with open(path, "rb") as f:
        spec = f.read()
    return docs.sparkSession.sparkContext.broadcast((hash(spec), spec))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids. Null texts are empty and have no ids; an existing ``ids_col`` is replaced."""
    shared = _broadcast(docs, path)

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        bpe = _bpe(shared)
        return texts.map(lambda t: np.frombuffer(b"".join(i for i, _ in bpe.encode(t or "")), np.uint32).astype(np.int32), na_action=None)

    return docs.withColumn(ids_col, ids_of(F.col(text_col)))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the text of its token ids; null ids give an empty text."""
    shared = _broadcast(rows, path)

    @F.pandas_udf("string")
    def text_of(ids):
        bpe = _bpe(shared)
        return ids.map(lambda x: "" if x is None else bpe.decode(np.asarray(x, np.uint32).tobytes()), na_action=None)

    return rows.withColumn(text_col, text_of(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every whole text encoded, its ids decoded, both digested.

    Defined cases: null and empty texts have 0 tokens and the digests of nothing; a text may hold special tokens, which
    get their own id; repeated rows give equal rows; null ids stay null; other columns are ignored; no rows give none.
    Besides the Arrow batch one stretch of words of bounded size is held, or the ids of one text.
    """
    shared = _broadcast(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(shared)
        for batch in batches:
            rows = []
            for parts in bpe.encode_many([t or "" for t in batch.column(1).to_pylist()]):
                ids, digest, n = [], hashlib.sha256(), 0
                for raw, decimals in parts:
                    digest.update((("," if n else "") + decimals).encode())
                    n += len(raw) // 4
                    ids.append(raw)
                rows.append((n, digest.hexdigest(), hashlib.sha256(bpe.decode(b"".join(ids)).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types[1:], strict=True))] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
