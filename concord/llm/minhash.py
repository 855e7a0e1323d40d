"""MinHash near-duplicates: table keys are pairs of values of two small collections, candidates are confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import FEW_HOT, HOT_ROWS, connected_components, join_groups, materialize, release, with_row_key

#: Values in each of the two collections, and minhashes in a value: 96 minhashes make the keys of 16 x 16 tables of six
#: minhashes each. Of two sets of similarity 0.8 one value of a collection agrees with probability 0.8 ** 3, so both
#: collections have an agreeing value, and some table has both in one key, with probability over 0.99998; at 0.85 it is
#: over 0.9999995.
VALUES, MINHASHES = 16, 3
#: Counts of a set's shingles by the top bits of their hash, from which an intersection is bounded.
COUNTERS = 128
FULL = 255
#: Nodes of one table key that one task compares; larger keys are dealt out.
PART = 4096
#: Documents that one copy of a text is compared with, and ids that may be broadcast to pick texts.
PER_COPY = 1000
FEW_IDS = 1_000_000
#: Shingles that are hashed at a time.
STRETCH = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int) -> set[bytes]:
    """The different word shingles; fewer words than ``width`` are one, none gives none."""
    words = text.lower().split()  # ASCII letters and white space only, as these are bytes
    if not words:
        return set()
    if len(words) <= width:
        return {b" ".join(words)}
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def seeds(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "big"), 13) for i in range(n)], np.uint64)


def mixed(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    y = (x ^ seed) * ODD
    y ^= y >> np.uint64(29)
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(32)
    return y


def collections(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The values of both collections for each set (rows); ``starts`` says where the sets' hashes begin."""
    out = np.empty((len(starts), 2 * VALUES), np.uint64)
    seed = seeds(2 * VALUES * MINHASHES)
    for i in range(2 * VALUES):
        value = np.full(len(starts), i, np.uint64)
        for k in range(MINHASHES):
            value = mixed(value ^ np.minimum.reduceat(mixed(hashes, seed[i * MINHASHES + k]), starts), ODD)
        out[:, i] = value
    return out


def counters(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Counts by the hash's top bits for each set. If one doesn't fit a byte, all are ``FULL`` and bound nothing."""
    bits = COUNTERS.bit_length() - 1
    at = np.repeat(np.arange(len(sizes)), sizes) * COUNTERS + (hashes >> np.uint64(64 - bits)).astype(np.int64)
    count = np.bincount(at, minlength=len(sizes) * COUNTERS).reshape(-1, COUNTERS)
    count[(count >= FULL).any(axis=1)] = FULL
    return count.astype(np.uint8)


PRINTS = "row long, doc_id long, n long, digest binary, collections array<long>, counters binary"


def prints(texts: DataFrame, width: int) -> DataFrame:
    """Per row of ``row, doc_id, text`` the size of its set, a 128-bit digest of the sorted set, its collections and its
    counters; without words all but the size is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, held, size = 0, [], 0
            sets = (shingles(t.as_py() or b"", width) for t in batch.column(2))
            for i, s in enumerate(sets):
                held.append((hashlib.blake2b(b"\n".join(sorted(s)), digest_size=16).digest() if s else None, [xxhash.xxh64_intdigest(x) for x in s]))
                size += len(s)
                if size >= STRETCH or i == len(batch) - 1:
                    yield close(batch, lo, held)
                    lo, held, size = i + 1, [], 0

    def close(batch: pa.RecordBatch, lo: int, held: list) -> pa.RecordBatch:
        sizes = np.array([len(h) for _, h in held], np.int64)
        some = sizes > 0
        hashes = np.array([x for _, h in held for x in h], np.uint64)
        values, counts = np.zeros((len(held), 2 * VALUES), np.uint64), np.zeros((len(held), COUNTERS), np.uint8)
        if some.any():
            values[some] = collections(hashes, (np.cumsum(sizes) - sizes)[some])
            counts[some] = counters(hashes, sizes[some])
        ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * 2 * VALUES)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(lo, len(held)), batch.column(1).slice(lo, len(held)), pa.array(sizes), pa.array([d for d, _ in held], pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64).ravel())), pa.array([c.tobytes() for c in counts], pa.binary()),
            ],
            names=["row", "doc_id", "n", "digest", "collections", "counters"],
        )

    return texts.select("row", "doc_id", F.col("text").cast("binary")).mapInArrow(run, PRINTS)


def small(df: DataFrame, few: int) -> DataFrame:
    """``df``, to be broadcast if it has up to ``few`` rows, which are of a few numbers each."""
    return F.broadcast(df) if df.limit(few + 1).count() <= few else df


def met(rows: DataFrame, key: str, name: str, few_ids: int, hot_rows: int) -> DataFrame:
    """``rows`` whose key another row has too, with the number of rows of the key. Keys are counted after partial sums; up to
    ``few_ids`` of them are broadcast, of more the frequent ones, so none is gathered in a task."""
    sizes = materialize(rows.groupBy(key).agg(F.count("*").alias("met")).where("met > 1"), name)
    if sizes.count() <= few_ids:
        return rows.join(F.broadcast(sizes), key)
    return join_groups(rows, sizes, key, sizes, "met", hot_rows)


def members(nodes: DataFrame, part: int, few_ids: int, hot_rows: int) -> DataFrame:
    """``key, value, node, parts``: the nodes of every table key that has two or more, the key's value of the first collection,
    and the parts that the key is dealt to.

    A key is a pair of a value of the first and one of the second collection. Values that only one node has can't be in a
    key of two, so the pairs are made of the others alone.
    """
    values = nodes.select("node", F.posexplode("collections").alias("at", "value"))
    both = met(values, "value", "minhash-values", few_ids, hot_rows)
    shared = both.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("shared"))
    pick = lambda lo: f"filter(sequence({lo}, {lo + VALUES - 1}), i -> getbit(shared, i) = 1)"
    keys = F.expr(f"flatten(transform({pick(0)}, i -> transform({pick(VALUES)}, j -> struct(xxhash64(collections[i], collections[j]) as key, collections[i] as value))))")
    keyed = nodes.select("node", "collections").join(shared, "node").select("node", F.explode(keys).alias("x")).select("node", "x.key", "x.value")
    keyed = materialize(keyed, "minhash-keyed")
    found = met(keyed, "key", "minhash-keys", few_ids, hot_rows)
    held = materialize(found.select("key", "value", "node", F.ceil(F.col("met") / part).cast("int").alias("parts")), "minhash-members")
    release(keyed)
    return held


def may_link(n: np.ndarray, counts: np.ndarray, full: np.ndarray, a, b, percent: int) -> np.ndarray:
    """Whether the sets ``a`` and ``b`` (places) can be similar enough: their intersection is at most the sum of the smaller
    counts, and they link if it is ``percent`` of the union."""
    common = np.minimum(counts[a], counts[b]).sum(axis=-1, dtype=np.int64)
    common = np.where(full[a] | full[b], np.minimum(n[a], n[b]), common)
    return (100 + percent) * common >= percent * (n[a] + n[b])


def forest(n: np.ndarray, counts: np.ndarray, full: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (places) that connect what all pairs that may link connect; every other pair that may link is within a tree."""
    edges, left = [], np.arange(len(n))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = may_link(n, counts, full, x, left, percent)
            if hit.any():
                edges += [(x, y) for y in left[hit].tolist()]
                queue += left[hit].tolist()
                left = left[~hit]
    return edges


def between(n: np.ndarray, counts: np.ndarray, full: np.ndarray, sets: list[frozenset], label: np.ndarray, side: np.ndarray, percent: int, every: bool) -> Iterator[tuple[int, int]]:
    """Pairs (places) of different labels whose sets of hashes are similar enough, which all linked pairs are; of two sides
    only those across. Unless ``every`` of them is asked for, a pair makes one label of two."""
    two, label = (side != side[0]).any(), label.copy()
    for x in range(len(n) - 1):
        y = np.flatnonzero((label[x + 1 :] != label[x]) & ((side[x + 1 :] != side[x]) | (not two))) + x + 1
        for z in y[may_link(n, counts, full, x, y, percent)].tolist() if len(y) else []:
            if label[z] != label[x] and (100 + percent) * len(sets[x] & sets[z]) >= percent * (n[x] + n[z]):
                yield x, z
                if not every:
                    label[label == label[z]] = label[x]


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows, sorted by their first ``keys`` columns, of which the last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        if held and any(h.column(i)[-1].as_py() != c[0] for h in held[-1:] for i, c in enumerate(cols)):
            yield pa.Table.from_batches(held)
            held = []
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        if len(change):
            last = int(change[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(n).to_pylist()), np.uint8).reshape(-1, COUNTERS) if n == "counters" else table.column(n).to_numpy() for n in names]


def paired(found: set[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in (zip(*found, strict=True) if found else ([], [])))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def first_pairs(held: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: for every key and part a forest of pairs that may link, and one of the parts' first nodes."""
    slim = nodes.select("node", "n", "counters")
    dealt = held.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).otherwise(0))
    firsts = dealt.where("parts > 1").groupBy("key", "part").agg(F.min("node").alias("node")).select("key", F.lit(-1).alias("part"), "node")
    rows = dealt.select("key", "part", "node").union(firsts).join(slim, "node").select("key", "part", "node", "n", "counters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for table in runs(batches, 2):
            key, part, node, n, counts = columns(table, "key", "part", "node", "n", "counters")
            full = counts.min(axis=1) == FULL
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
            size = np.diff(np.append(starts, len(key)))
            first = np.repeat(starts, size)
            # most groups are stars: all may link with the first. Only the others need more than this one comparison
            near = may_link(n, counts, full, first, np.arange(len(key)), percent)
            star = np.repeat(np.logical_and.reduceat(near, starts), size) & (np.arange(len(key)) != first)
            found.update(zip(node[first[star]].tolist(), node[star].tolist(), strict=True))
            for lo, k in zip(starts.tolist(), size.tolist(), strict=True):
                if k > 1 and not near[lo : lo + k].all():
                    found.update((int(node[lo + x]), int(node[lo + y])) for x, y in forest(n[lo : lo + k], counts[lo : lo + k], full[lo : lo + k], percent))
            if len(found) > STRETCH:
                yield paired(found)
                found.clear()
        yield paired(found)

    return _dealt(rows, ["key", "part"], ["node"]).mapInArrow(run, "a long, b long").distinct()


def hash_sets(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node, n, hashes``: 32-bit hashes of the sets of some nodes. Two sets have at least as many hashes in common as
    shingles, less the few that are the same hash within one set; these count as one more each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py() or b"", width) for t in batch.column(1)]
            hashes = [np.fromiter((xxhash.xxh32_intdigest(x) for x in s), np.uint32, len(s)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(hashes, pa.binary())], names=["node", "n", "hashes"])

    return texts.join(nodes.withColumnRenamed("node", "row"), "row").select(F.col("row").alias("node"), F.col("text").cast("binary")).mapInArrow(run, "node long, n long, hashes binary")


def later_pairs(held: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, part: int, every: bool) -> DataFrame:
    """``a, b``: pairs of these members with different labels whose hash sets are similar enough.

    Members meet by the value of the first collection, of which a node has a few, and not by every key. Values of many nodes
    are dealt out as pairs of parts.
    """
    slim = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = held.select("value", "node").distinct()
    sizes = at.groupBy("value").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")  # few are larger than a part
    cut = F.coalesce("parts", F.lit(1))
    both = at.join(sizes, "value", "left").withColumn("part", F.pmod(F.xxhash64("node"), cut).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    rows = both.select("value", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node")
    rows = rows.join(slim, "node").select("value", "p", "q", "part", "node", "n", "label", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for table in runs(batches, 3):
            value, p, q, side, node, n, label = columns(table, "value", "p", "q", "part", "node", "n", "label")
            hashes = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
            sizes = np.array(list(map(len, hashes)), np.int64)
            counts = counters(np.concatenate(hashes).astype(np.uint64) << np.uint64(32), sizes)
            full = counts.min(axis=1) == FULL
            # a set's hashes that are the same count again, so that no intersection comes out too small
            own = [frozenset(numbered(h)) for h in hashes]
            starts = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(value)], strict=True):
                s = slice(lo, hi)
                for x, y in between(n[s], counts[s], full[s], own[lo:hi], label[s], side[s], percent, every):
                    found.add((int(node[lo + x]), int(node[lo + y])))
                    if len(found) > STRETCH:
                        yield paired(found)
                        found.clear()
        yield paired(found)

    return _dealt(rows, ["value", "p", "q"], ["part", "node"]).mapInArrow(run, "a long, b long").distinct()


def numbered(hashes: np.ndarray) -> list[int]:
    """The hashes, those that stand more than once with a number on top for each further time."""
    found = np.sort(hashes).astype(np.uint64)
    again = np.flatnonzero(found[1:] == found[:-1]) + 1
    for i in again.tolist():
        found[i] = found[i - 1] + (np.uint64(1) << np.uint64(32))
    return found.tolist()


def _dealt(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by).sortWithinPartitions(*by, *order)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int, per_copy: int = PER_COPY, few_ids: int = FEW_IDS) -> DataFrame:
    """``a, b, linked``, written, for the rows of a written table of pairs, from the full sets of both texts.

    Texts of paired rows are picked once. That of ``a`` is held while those of its ``b`` pass; where it has many, they are
    dealt to copies of it, so no task gets all.
    """
    rows = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    picked = materialize(texts.select("row", "text").join(small(rows, few_ids), "row", "left_semi"), "minhash-texts")
    per_copy = max(per_copy, pairs.count() // FEW_HOT)
    hubs = pairs.groupBy("a").agg(F.count("*").alias("of_a")).where(F.col("of_a") > per_copy)  # fewer than FEW_HOT
    hubs = F.broadcast(hubs.select("a", F.ceil(F.col("of_a") / per_copy).cast("int").alias("copies")))
    one = F.coalesce("copies", F.lit(1))
    dealt = pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).cast("int").alias("copy"))
    firsts = pairs.select("a").distinct().join(hubs, "a", "left").select("a", F.explode(F.sequence(F.lit(0), one - 1)).alias("copy"))
    seconds = picked.withColumnRenamed("row", "b").join(small(dealt, few_ids), "b").select("a", "copy", "b", "text")
    firsts = picked.withColumnRenamed("row", "a").join(small(firsts, few_ids), "a").select("a", "copy", F.lit(None).cast("long").alias("b"), "text")
    rows = seconds.unionByName(firsts).withColumn("text", F.col("text").cast("binary"))
    both = _dealt(rows, ["a", "copy"], [F.asc_nulls_first("b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[bytes] = set()
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2)), batch.column(3), strict=True):
                own = shingles(text.as_py() or b"", width)
                if b is None:
                    held = own
                else:
                    common = len(held & own)
                    out.append((a, b, 100 * common >= percent * (len(held) + len(own) - common)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "linked"])

    out = materialize(both.mapInArrow(run, "a long, b long, linked boolean"), "minhash-links")
    release(picked)
    return out


def open_keys(held: DataFrame, tested: DataFrame, labels: DataFrame, few_ids: int) -> DataFrame:
    """Keys, written, in which a pair that may link can be untested between different labels: those of a pair that didn't link, and
    those dealt to parts that have not become one."""
    failed = tested.where("not linked").select("a", "b")
    a, b = held.select("key", F.col("node").alias("a")), held.select("key", F.col("node").alias("b"))
    of_a = materialize(a.join(small(failed, few_ids), "a").select("key", "b"), "minhash-failed")
    by_pair = b.join(small(of_a, few_ids), ["key", "b"]).select("key")
    named = held.where("parts > 1").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    out = materialize(by_pair.union(apart).distinct(), "minhash-open")
    release(of_a)
    return out


def labelled(links: DataFrame) -> DataFrame:
    return connected_components(links.where("linked")).select("node", F.col("component").alias("label"))


def minhash_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 80,
    part: int = PART,
    per_copy: int = PER_COPY,
    few_ids: int = FEW_IDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Rows of equal sets are one node, whatever their number. Nodes meet in tables whose keys pair a value of one small
    collection of minhashes with a value of another. Within a key only a forest of the pairs that may link is taken, by a
    bound that no linked pair fails; these pairs are confirmed on the full sets of shingles. Should one not link, the members
    of its keys meet again with hashes of their whole sets, and pairs that connect what these connect are confirmed, so
    that no candidate is lost.

    Defined cases: texts without words (null, empty, white space) have an empty set and link with nothing, not even each
    other, so their component is their own id; fewer words than ``width`` are one shingle; rows with a null id link and are
    linked through like any other, a component without any id is null, and they are kept only in such a component;
    repeated rows give equal rows; texts are read whole; other columns are ignored; an empty table gives an empty result.
    Written tables that the result does not read are deleted as soon as no later step reads them.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    whole, key = with_row_key(slim, "minhash-rows")
    texts = whole.withColumnRenamed(key, "row")
    sketched = materialize(prints(texts, width), "minhash-prints")
    sets = materialize(sketched.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), "minhash-sets")
    nodes = materialize(sketched.withColumnRenamed("row", "node").join(small(sets.select("node"), few_ids), "node").select("node", "n", "collections", "counters"), "minhash-nodes")
    held = members(nodes, part, few_ids, hot_rows)
    pairs = materialize(first_pairs(held, nodes, percent), "minhash-pairs")
    release(nodes)
    links = confirmed(pairs, texts, width, percent, per_copy, few_ids)
    release(pairs)
    labels = labelled(links)
    still = open_keys(held, links, labels, few_ids)
    if not still.isEmpty():
        large = held.where("parts > 1").groupBy("key").agg(F.count("*").alias("met"))
        few = still.count() <= few_ids
        again = materialize(held.join(F.broadcast(still), "key") if few else join_groups(held, still, "key", large, "met", hot_rows), "minhash-again")
        hashed = materialize(hash_sets(small(again.select("node").distinct(), few_ids), texts, width), "minhash-hashes")
        for every in (False, True):
            more = materialize(later_pairs(again, hashed, labels, percent, part, every).join(links.select("a", "b"), ["a", "b"], "left_anti"), "minhash-pairs")
            found = confirmed(more, texts, width, percent, per_copy, few_ids)
            release(more)
            links = links.unionByName(found)
            labels = labelled(links)
            if found.where("not linked").isEmpty():
                break  # else two hashes are equal by chance, and a pair that isn't linked may have hidden one that is
        release(again, hashed)
    release(whole, held, still)
    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = materialize(named.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("n_sets")), "minhash-smallest")
    of_set = join_groups(named.select("label", "digest"), smallest.drop("n_sets"), "label", smallest, "n_sets", hot_rows).select("digest", "component_id")
    rows = join_groups(sketched.where("n > 0").select("doc_id", "n", "digest"), of_set, "digest", sets, "n_rows", hot_rows)
    out = rows.select("doc_id", "n", "component_id").union(sketched.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
