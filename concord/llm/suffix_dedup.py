"""Removal of repeated byte strings by a distributed difference-cover algorithm, cut off at the repeated length.

The difference-cover construction sorts a sample of the suffixes, names equal ones, and orders the others through
their nearest sampled neighbour. Here only equality over the first GRAM bytes matters, so the sort stops at that depth:

1. Positions p with p mod 31 in COVER are sampled. COVER is a perfect difference set: for any two positions there is
   a shift of at most 30 that makes both sampled, so of two equal strings of 100 bytes some sampled tuples of
   70 bytes, and thus of WIDTH = 64, are equal.
2. The tuples are hashed, dealt out by hash and sorted; the name of a tuple is the first place that has it. Places
   that are alone under their name are dropped (most are). A tuple with HOT or more places in one stretch of texts is
   named there first: its places link to the first of them, and only that one is dealt out, with a mark. So a passage
   that stands in any share of all documents brings a bucket fewer than HOT places per stretch.
3. Names are compared in sequence: sampled places of one document whose names are places at one distance in one other
   document, with tuples that overlap, make a stretch that repeats an earlier one.
4. Every start whose 100 bytes lie in such a stretch is repeated. The starts next to a named place that no stretch
   settles, and their counterparts at the name, are merged in: hashed over all 100 bytes, sorted, and compared with
   their neighbours in that order. Of equal ones in one stretch of texts only the first is dealt out. As places may
   link to a marked place instead of the name, the starts next to the name of a marked tuple are merged in as well.

Hashes of tuples only nominate: a stretch needs several equal names in sequence and step 4 compares 128 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import materialize, release

GRAM = 100
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = np.array([1, 5, 11, 24, 25, 27])
WIDTH = 64
#: Bytes of text whose sampled tuples one task handles at a time, and sampled tuples of one bucket, about.
STRETCH = 4 << 20
BUCKET = 1_000_000
#: Places of one tuple in a stretch from which they are named there.
HOT = 4
#: Ids that may be broadcast to pick documents; beyond that the documents are joined by a shuffle.
FEW_IDS = 1_000_000
#: Apart of documents on the line of all places; no text is longer.
FAR = np.int64(1) << 32


def pack(*arrays: np.ndarray, level: int = 0) -> bytes:
    head = [np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)]
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in [*head, *arrays])
    return zstandard.ZstdCompressor(level=level).compress(raw) if level else raw


def unpack(raw: bytes, packed: bool = False) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw) if packed else raw
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    spec, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for k in range(n):
        kind = np.dtype(chr(spec[2 * k]))
        out.append(np.frombuffer(raw, kind, int(spec[2 * k + 1]), at))
        at += kind.itemsize * int(spec[2 * k + 1])
    return out


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def hashed(data: bytes, at: np.ndarray, width: int, seed: int) -> np.ndarray:
    """64-bit hash of ``width`` bytes at every place; ``data`` must go on for 8 bytes after them."""
    words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    h = np.full(len(at), seed * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        h ^= words[at + k]
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(29)


def offset_of(ordinal: np.ndarray) -> np.ndarray:
    return ordinal // len(COVER) * PERIOD + COVER[ordinal % len(COVER)]


def n_sampled(size: np.ndarray) -> np.ndarray:
    """Sampled places of a text whose tuples lie inside it."""
    room = size - WIDTH
    full, rest = np.divmod(np.maximum(room, -1), PERIOD)
    return np.where(room < 0, 0, full * len(COVER) + np.searchsorted(COVER, rest, side="right"))


def by_number(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each number, in order."""
    order = np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")
    sorted_ = numbers[order]
    cuts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(sorted_[lo]), order[lo:hi]


def group_of(docs: np.ndarray, groups: int) -> np.ndarray:
    return (docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups


def blob(keys: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["k", "blob"])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of each key of the task."""
    found: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[k].append(b)
    for k in sorted(found):
        yield k, found.pop(k)


def joined(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], list]]:
    """Ids and texts (and what else the rows have), a bounded number of bytes at a time."""
    for batch in batches:
        ids, texts, more, size = [], [], [], 0
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py() or b""
            ids.append(batch.column(0)[row].as_py())
            texts.append(text)
            more.append(batch.column(2)[row].as_py() if batch.num_columns > 2 else None)
            size += len(text)
            if size >= STRETCH:
                yield np.array(ids, np.int64), texts, more
                ids, texts, more, size = [], [], [], 0
        if ids:
            yield np.array(ids, np.int64), texts, more


def passed_on(batches: Iterator[pa.RecordBatch], buckets: int, rest: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs for group k, which come under the key ``buckets + k``; the other rows are added to ``rest``."""
    for batch in batches:
        here = pc.greater_equal(batch.column(0), buckets)
        for_groups = batch.filter(here)
        if for_groups.num_rows:
            yield blob([k - buckets for k in for_groups.column(0).to_pylist()], for_groups.column(1).to_pylist())
        rest.append(batch.filter(pc.invert(here)))


def links_of(h: np.ndarray, doc: np.ndarray, off: np.ndarray, marked: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Links (document, place, document of the earlier place, distance) between places of one hash, and the first places.

    All places link to the first of their hash, and to the next earlier one of their document at a multiple of PERIOD,
    which keeps the distance constant along text of a short period. Where any place but the first is marked, the first
    links to itself, which only asks for the starts next to it to be compared.
    """
    order = np.lexsort((off, doc, h))
    h, doc, off = h[order], doc[order], off[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else np.zeros(0, np.int64)
    links = [(doc, off, doc[first], off[first])]
    line = np.lexsort((off, off % PERIOD, doc, h))
    a, b = line[:-1], line[1:]
    near = (h[a] == h[b]) & (doc[a] == doc[b]) & (off[a] % PERIOD == off[b] % PERIOD) & (a != first[b])
    links.append((doc[b][near], off[b][near], doc[a][near], off[a][near]))
    m_doc, m_off, e_doc, e_off = joined(links)
    other = (m_doc != e_doc) | (m_off != e_off)
    asked = np.unique(first[marked[order] & ~new])
    m_doc, m_off, e_doc, e_off = joined([(m_doc[other], m_off[other], e_doc[other], e_off[other]), (doc[asked], off[asked], doc[asked], off[asked])])
    line = np.lexsort((m_off, m_doc))
    m_doc, m_off, e_doc, e_off = m_doc[line], m_off[line], e_doc[line], e_off[line]
    return (m_doc, m_off.astype(np.uint32), e_doc, m_off - e_off), order[new]


def links_by_group(links: tuple[np.ndarray, ...], groups: int) -> tuple[list[int], list[bytes]]:
    keys, out = [], []
    for g, at in by_number(group_of(links[0], groups)):
        keys.append(g)
        out.append(pack(*(x[at] for x in links), level=1))
    return keys, out


def sampled_tuples(buckets: int):
    """Step 1: per bucket of the tuples' hash a blob of (documents, samples of each, hash, marked ones, gaps of ordinals).

    Links of tuples that are named here go out under the key of their group plus ``buckets``.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        for ids, texts, _ in stretches(batches):
            sizes = np.array([len(t) for t in texts], np.int64)
            count = np.where(sizes >= GRAM, n_sampled(sizes), 0)
            if not count.sum():
                continue
            doc, ordinal = np.repeat(np.arange(len(ids)), count), ragged(count)
            h = hashed(b"".join([*texts, bytes(8)]), (np.cumsum(sizes) - sizes)[doc] + offset_of(ordinal), WIDTH, 1)
            ordered = np.sort(h)
            hot = np.unique(ordered[HOT - 1 :][ordered[HOT - 1 :] == ordered[: max(len(h) - HOT + 1, 0)]])
            marked, keys, blobs = np.zeros(len(h), bool), [], []
            if len(hot):
                here = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
                links, first = links_of(h[here], ids[doc[here]], offset_of(ordinal[here]), marked[here])
                keys, blobs = links_by_group(links, buckets)
                keys = [buckets + g for g in keys]
                marked[here[first]] = True
                sent = np.ones(len(h), bool)
                sent[here] = False
                sent |= marked
                h, doc, ordinal, marked = h[sent], doc[sent], ordinal[sent], marked[sent]
            for k, at in by_number((h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)):
                d, o = doc[at], ordinal[at]
                new = np.append(True, d[1:] != d[:-1])
                gap = np.where(new, o, np.append(0, np.diff(o)))
                first = np.flatnonzero(new)
                # small gaps as two planes of bytes, of which the high one is nearly all zero
                planes = (gap & 255).astype(np.uint8), (gap >> 8 & 255).astype(np.uint8), *(() if gap.max() < 1 << 16 else ((gap >> 16).astype(np.uint32),))
                keys.append(k)
                blobs.append(pack(ids[d[first]], np.diff(np.append(first, len(d))).astype(np.uint32), h[at].astype(np.uint32), np.flatnonzero(marked[at]).astype(np.uint32), *planes))
            yield blob(keys, blobs)

    return run


def unpack_tuples(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    docs, counts, h, places, low, high, *more = unpack(raw)
    marked = np.zeros(len(h), bool)
    marked[places] = True
    gap = low.astype(np.int64) | high.astype(np.int64) << 8
    if more:
        gap |= more[0].astype(np.int64) << 16
    first = np.cumsum(counts, dtype=np.int64) - counts
    run = np.cumsum(gap)
    return h, np.repeat(docs, counts), offset_of(run - np.repeat(run[first] - gap[first], counts)), marked


def named_tuples(groups: int):
    """Step 2: sort the tuples of a bucket, name them by their first place; out go the links of other places to it."""

    def run(batches):
        rest: list[pa.RecordBatch] = []
        yield from passed_on(batches, groups, rest)
        for _, blobs in gathered(iter(rest)):
            h, doc, off, marked = joined([unpack_tuples(b) for b in blobs])
            key = np.sort(h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64))
            top, at = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            same = top[1:] == top[:-1]
            many = np.append(same, False) | np.append(False, same)
            h, at = top[many], at[many]
            links, _ = links_of(h, doc[at], off[at], marked[at])
            if len(links[0]):
                yield blob(*links_by_group(links, groups))

    return run


def union_of(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals (ends included) that cover the same whole numbers."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.append(True, lo[1:] > hi[:-1] + 1)[: len(lo)]
    return lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)] if len(lo) else hi


def minus(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the second disjoint intervals leave of the first."""
    at = np.concatenate([lo, hi + 1, lo2, hi2 + 1])
    one = np.concatenate([np.ones(len(lo), np.int64), -np.ones(len(lo), np.int64), np.zeros(2 * len(lo2), np.int64)])
    two = np.concatenate([np.zeros(2 * len(lo), np.int64), np.ones(len(lo2), np.int64), -np.ones(len(lo2), np.int64)])
    order = np.argsort(at, kind="stable")
    at, one, two = at[order], np.cumsum(one[order]), np.cumsum(two[order])
    good = (one[:-1] > 0) & (two[:-1] == 0) & (at[1:] > at[:-1])
    return at[:-1][good], at[1:][good] - 1


STEP3 = "k int, doc long, lo long, hi long, blob binary"


def compared_names(batches):
    """Step 3, for the documents of a group: repeated starts (as blobs), and the starts that are still to be compared."""
    for g, blobs in gathered(batches):
        m_doc, m_off, e_doc, far = joined([tuple(unpack(b, packed=True)) for b in blobs])
        m_off = m_off.astype(np.int64)
        order = np.lexsort((m_off, far, e_doc, m_doc))
        m_doc, m_off, e_doc, far = m_doc[order], m_off[order], e_doc[order], far[order]
        ids, line = np.unique(m_doc, return_inverse=True)
        line = line.astype(np.int64) * FAR + FAR // 4  # a place on the line of all documents of the group
        linked = np.flatnonzero((m_doc != e_doc) | (far != 0))  # a place that links to itself repeats nothing
        a, b = linked[:-1], linked[1:]
        cut = (m_doc[b] != m_doc[a]) | (e_doc[b] != e_doc[a]) | (far[b] != far[a]) | (m_off[b] > m_off[a] + WIDTH)
        first = np.flatnonzero(np.append(True, cut)[: len(linked)])
        last = np.append(first[1:] - 1, len(linked) - 1)[: len(first)]
        lo, hi = (line + m_off)[linked[first]], (line + m_off)[linked[last]] + WIDTH - GRAM
        long_ = hi >= lo
        lo, hi = union_of(lo[long_], hi[long_])
        window_lo, window_hi = line + np.maximum(m_off - (PERIOD - 1), 0), line + m_off
        rest_lo, rest_hi = minus(*union_of(window_lo, window_hi), lo, hi)
        if len(lo):
            at = lo // FAR
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([pack(ids[at], lo - at * FAR - FAR // 4, hi - at * FAR - FAR // 4, level=1)], pa.binary())], names=["k", "doc", "lo", "hi", "blob"])
        if not len(rest_lo):
            continue
        # counterparts: of each link's window the part from its first to its last open start, moved to the name's side
        i, j = np.searchsorted(rest_hi, window_lo), np.searchsorted(rest_lo, window_hi, side="right") - 1
        open_ = i <= j
        i, j = i[open_], j[open_]
        c_lo, c_hi = np.maximum(rest_lo[i], window_lo[open_]) - line[open_] - far[open_], np.minimum(rest_hi[j], window_hi[open_]) - line[open_] - far[open_]
        names, at = np.unique(e_doc[open_], return_inverse=True)
        base = at.astype(np.int64) * FAR + FAR // 4
        c_lo, c_hi = union_of(base + np.maximum(c_lo, 0), base + np.maximum(c_hi, -1))
        docs = np.concatenate([ids[rest_lo // FAR], names[c_lo // FAR]])
        lo, hi = np.concatenate([rest_lo, c_lo]) % FAR - FAR // 4, np.concatenate([rest_hi, c_hi]) % FAR - FAR // 4
        for a in range(0, len(docs), 1 << 16):
            part = slice(a, a + (1 << 16))
            n = len(docs[part])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.array(docs[part]), pa.array(lo[part]), pa.array(hi[part]), pa.nulls(n, pa.binary())], names=["k", "doc", "lo", "hi", "blob"])


def repeats(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which places have the 128 bits of an earlier one; a place that is there twice does not repeat itself."""
    order = np.lexsort((offs, docs, h2, h1))
    h1, h2, docs, offs = h1[order], h2[order], docs[order], offs[order]
    new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))[: len(h1)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    hit = np.zeros(len(h1), bool)
    hit[order] = (docs != docs[first]) | (offs != offs[first])
    return hit


def starts_by_group(docs: np.ndarray, offs: np.ndarray, groups: int) -> tuple[list[int], list[bytes]]:
    order = np.lexsort((offs, docs))
    docs, offs = docs[order], offs[order].astype(np.int64)
    keys, out = [], []
    for g, at in by_number(group_of(docs, groups)) if len(docs) else ():
        keys.append(g)
        out.append(pack(docs[at], offs[at], offs[at], level=1))
    return keys, out


def open_starts(buckets: int):
    """Step 4a: hash all GRAM bytes at the open starts of each document; blobs by bucket of the hash.

    Of equal strings of a stretch all but the first are repeated and go out under the key of their group plus ``buckets``.
    """

    def run(batches):
        for ids, texts, spans in stretches(batches):
            sizes = np.array([len(t) for t in texts], np.int64)
            start = np.cumsum(sizes) - sizes
            lo = np.array([s["lo"] for x in spans for s in x], np.int64)
            hi = np.array([s["hi"] for x in spans for s in x], np.int64)
            doc = np.repeat(np.arange(len(ids)), [len(x) for x in spans])
            lo, hi = np.maximum(lo, 0), np.minimum(hi, sizes[doc] - GRAM)
            good = hi >= lo
            if not good.any():
                continue
            lo, hi = union_of(doc[good] * FAR + lo[good], doc[good] * FAR + hi[good])
            at = np.repeat(lo, hi - lo + 1) + ragged(hi - lo + 1)
            doc, off = at // FAR, at % FAR
            data, place = b"".join([*texts, bytes(8)]), start[doc] + off
            h1, h2 = hashed(data, place, GRAM, 2), hashed(data, place, GRAM, 3)
            again = repeats(h1, h2, ids[doc], off)
            keys, blobs = starts_by_group(ids[doc[again]], off[again], buckets)
            keys = [buckets + g for g in keys]
            h1, h2, doc, off = h1[~again], h2[~again], doc[~again], off[~again]
            for k, x in by_number((h1 >> np.uint64(40)).astype(np.int64) % buckets):
                new = np.flatnonzero(np.append(True, doc[x][1:] != doc[x][:-1]))
                keys.append(k)
                blobs.append(pack(ids[doc[x][new]], np.diff(np.append(new, len(x))).astype(np.uint32), off[x].astype(np.uint32), h1[x], h2[x]))
            yield blob(keys, blobs)

    return run


def compared_starts(groups: int):
    """Step 4b: sort a bucket's strings; all but the first place of equal neighbours are repeated. Blobs by group."""

    def run(batches):
        rest: list[pa.RecordBatch] = []
        yield from passed_on(batches, groups, rest)
        for _, blobs in gathered(iter(rest)):
            docs, offs, h1, h2 = joined([(np.repeat(d, n), off, a, b) for d, n, off, a, b in map(unpack, blobs)])
            hit = repeats(h1, h2, docs, offs)
            if hit.any():
                yield blob(*starts_by_group(docs[hit], offs[hit], groups))

    return run


def removed_spans(batches):
    """Spans of bytes (end not included) that repeated starts cover, one row per document of a group that has any."""
    for _, blobs in gathered(batches):
        docs, lo, hi = joined([tuple(unpack(b, packed=True)) for b in blobs])
        ids, line = np.unique(docs, return_inverse=True)
        base = line.astype(np.int64) * FAR + FAR // 4
        lo, hi = union_of(base + lo, base + hi + GRAM - 1)
        doc = lo // FAR
        count = np.bincount(doc, minlength=len(ids))
        lo, hi = lo - doc * FAR - FAR // 4, hi - doc * FAR - FAR // 4 + 1
        bounds = np.append(0, np.cumsum(count)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), spans], names=["doc", "spans"])


def few(ids: DataFrame) -> bool:
    """Whether a written table of different ids may be broadcast."""
    return ids.count() <= FEW_IDS


def with_order(rows: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, text``) with ``doc``, a number of its own for every different row, in the order of ids.

    That is the id itself, unless an id stands at different texts or is null. Then the different rows are sorted by
    id, nulls first, and by the digest of their text, and numbered; the texts move once more to get their number.
    """
    brief = F.xxhash64("text")
    unfit = rows.groupBy("doc_id").agg(F.min(brief).alias("lo"), F.max(brief).alias("hi")).where("doc_id is null or lo <> hi")
    if unfit.isEmpty():
        return rows.withColumn("doc", F.col("doc_id"))
    ordered = rows.select("doc_id", F.sha2("text", 256).alias("digest")).distinct().orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    numbers = materialize(ordered.withColumn("doc", F.monotonically_increasing_id()), "suffix-order").withColumnRenamed("doc_id", "_id")
    named = rows.withColumn("digest", F.sha2("text", 256))
    return named.join(numbers, (F.col("_id").eqNullSafe(F.col("doc_id"))) & (named["digest"] == numbers["digest"])).select("doc_id", "text", "doc")


def repeated_spans(texts: DataFrame, max_buckets: int = 1 << 20) -> DataFrame:
    """``doc, spans``: what to remove, for documents (``doc`` long, ``text`` binary) with anything to remove."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << min(max(4, (max(1, total * len(COVER) // PERIOD // BUCKET) - 1).bit_length()), max_buckets.bit_length() - 1)
    blobs = "k int, blob binary"
    tuples = texts.mapInArrow(sampled_tuples(buckets), blobs)
    links = tuples.repartitionById(buckets, F.col("k") % buckets).mapInArrow(named_tuples(buckets), blobs)
    stretches_ = materialize(links.repartitionById(buckets, F.col("k") % buckets).mapInArrow(compared_names, STEP3), "suffix-stretches")
    open_ = stretches_.where("blob is null").groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    ids = stretches_.where("blob is null").select("doc").distinct()
    # of few documents the others' texts stay where they are
    wanted = (texts.join(F.broadcast(ids), "doc", "left_semi") if few(ids) else texts).join(open_, "doc").select("doc", "text", "spans")
    starts = wanted.mapInArrow(open_starts(buckets), blobs).repartitionById(buckets, F.col("k") % buckets).mapInArrow(compared_starts(buckets), blobs)
    found = stretches_.where("blob is not null").select("k", "blob").union(starts)
    spans = materialize(found.repartitionById(buckets, F.col("k") % buckets).mapInArrow(removed_spans, "doc long, spans array<struct<lo: long, hi: long>>"), "suffix-spans")
    release(stretches_)
    return spans


def cut_out(text: bytes, spans) -> tuple[bytes, int, int]:
    """The text without the spans, the bytes removed and the number of spans."""
    kept, at, removed = [], 0, 0
    for s in spans:
        lo, hi = s["lo"], min(s["hi"], len(text))
        kept.append(text[at:lo])
        removed += hi - lo
        at = hi
    kept.append(text[at:])
    return b"".join(kept), removed, len(spans)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row (and ``kept``, the remaining bytes, if asked).

    Defined cases: null and empty texts, and those under 100 bytes, lose nothing; repeated rows (of one id and text) are one
    document, so they don't remove each other's bytes; different texts of one id are documents in the order of the SHA-256
    of their texts; a null id is smaller than any other; other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    texts = with_order(rows)
    spans = repeated_spans(texts.select("doc", "text"))
    kept_col = [F.col("text").alias("kept")] if with_text else []
    none = F.lit(0).cast("long")

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                kept, removed, n = cut_out(text, spans.as_py() or ())
                rows.append((len(text), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    if not few(spans):
        return texts.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
    ids = F.broadcast(spans.select("doc"))
    whole = texts.join(ids, "doc", "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *kept_col)
    part = texts.join(ids, "doc", "left_semi").join(spans, "doc").select("doc_id", "text", "spans").mapInArrow(run, schema)
    return whole.unionByName(part)
