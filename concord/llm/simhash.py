"""SimHash near-duplicates: pigeonring candidates, exact Hamming links, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import HOT_ROWS, connected_components, join_groups, materialize

#: The ring of segments of a fingerprint: (lowest bit, width).
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one key that one task links at once; larger sets are dealt out as pairs of parts.
PART = 1 << 15


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles; fewer words than ``width`` are one shingle, none gives zero."""
    words = text.lower().split()  # ASCII letters and white space only, as these are bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - width].tolist(), ends[width - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, len(starts), 1 << 15):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo : lo + (1 << 15)], ends[lo : lo + (1 << 15)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py() or b"") for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ring_keys(fps: DataFrame, most: int) -> DataFrame:
    """Each fingerprint once for every place where a chain may start, and every bit that its second segment may miss.

    ``most`` differing bits over five segments: some segment starts a chain whose every prefix of l segments differs
    in at most ``l * most / 5`` bits. For up to 4 bits that is 0 for the first segment and 1 for the first two, so two
    linked fingerprints meet in a key of the first segment and the second with one bit left out.
    """
    if not 0 <= most <= 4:
        raise ValueError("the ring of five segments is for 0 to 4 differing bits")
    keys = []
    for i, (lo, width) in enumerate(RING):
        lo2, width2 = RING[(i + 1) % len(RING)]
        first = f"(shiftrightunsigned(fp, {lo}) & {(1 << width) - 1}L)"
        second = f"(shiftrightunsigned(fp, {lo2}) & {(1 << width2) - 1}L)"
        for b in range(width2):
            keys.append(f"(shiftleft({i * 16 + b}L, 32) | shiftleft({first}, 13) | ({second} & {((1 << width2) - 1) & ~(1 << b)}L))")
    return fps.select(F.expr(f"explode(array({', '.join(keys)}))").alias("key"), "fp", "node")


def linked(fp: np.ndarray, others: np.ndarray, start: int, most: int) -> np.ndarray:
    """Which of ``others`` the chain from segment ``start`` leaves within budget, up to the whole ring."""
    diff, total, ok = fp ^ others, 0, np.ones(len(others), bool)
    for length in range(1, len(RING) + 1):
        lo, width = RING[(start + length - 1) % len(RING)]
        total = total + np.bitwise_count(diff & np.uint64(((1 << width) - 1) << lo))
        ok &= total * len(RING) <= length * most
    return ok


def forest(fps: np.ndarray, start: int, most: int) -> list[tuple[int, int]]:
    """Edges (places) that connect what the links of one key connect; each place is reached once."""
    edges, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = linked(fps[x], fps[left], start, most)
            if hit.any():
                found = left[hit]
                edges += [(x, y) for y in found.tolist()]
                queue += found.tolist()
                left = left[~hit]
    return edges


EDGES = pa.schema([("key", pa.int64()), ("part", pa.int64()), ("fp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def link_sorted(most: int, part: int | None = PART, has_parts: bool = False):
    """A function for mapInArrow over rows sorted by key: links inside each key; keys over ``part`` rows pass as parts.

    Output rows with ``b`` are links of nodes; those without are rows of a large key (``a`` is the node), with the
    number of their part. At most ``part`` rows of a key and one batch are held.
    """

    def close(key: int, fps: np.ndarray, nodes: np.ndarray, number: int, last: bool, out: list) -> None:
        if number or not last:
            out.append((np.full(len(fps), key), np.full(len(fps), number), fps.view(np.int64), nodes, np.full(len(fps), -1), np.zeros(len(fps), bool)))
        else:
            edges = forest(fps, (key >> 32) // 16, most)
            if edges:
                a, b = nodes[[x for x, _ in edges]], nodes[[y for _, y in edges]]
                out.append((np.full(len(a), key), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), a, b, np.ones(len(a), bool)))

    def batch_of(out: list) -> pa.RecordBatch:
        key, number, fp, a, b, is_edge = map(np.concatenate, zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(number), pa.array(fp), pa.array(a), pa.array(b, mask=~is_edge)], schema=EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, number, out = None, [], 0, []  # held: pieces of the key at the end of the last batch

        def flush(last: bool) -> None:
            nonlocal held, number
            if held_key is not None and held:
                fps, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
                close(held_key, fps, nodes, number, last, out)
            held, number = [], 0 if last else number + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, node = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            sizes = np.diff(starts)
            # keys of one row are the rule: only larger ones, and the first and last of the batch, are looked at
            for r in np.unique(np.append(np.flatnonzero(sizes > 1), [0, len(sizes) - 1])):
                lo, hi = int(starts[r]), int(starts[r + 1])
                if key[lo] != held_key:
                    flush(True)
                    held_key = int(key[lo])
                while lo < hi:
                    room = hi - lo if part is None else min(hi - lo, part - sum(len(x) for x, _ in held))
                    if room:
                        held.append((fp[lo : lo + room], node[lo : lo + room]))
                        lo += room
                    if lo < hi:
                        flush(False)
            if out:
                yield batch_of(out)
                out = []
        flush(True)
        if out:
            yield batch_of(out)

    return run


def links(fps: DataFrame, most: int = 4, part: int = PART) -> DataFrame:
    """``a, b``: links of nodes that connect exactly what all pairs within ``most`` bits connect.

    ``fps`` has one row per different fingerprint (``fp, node``). Within a key only a spanning forest is emitted, so
    a dense group gives links in proportion to its members. A key with over ``part`` rows is cut in parts and every
    pair of parts is linked as a key of its own, so that no task holds more than two parts. That is exact and its cost
    is the square of the number of parts: a key has 25 of the 64 bits, so fingerprints spread evenly reach ``part`` rows a
    key at about 2**40 different fingerprints.
    """
    schema = "key long, part long, fp long, a long, b long"
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the table of fingerprints is small beside its keys (64 for each), so it is dealt out before they are made
    keyed = ring_keys(fps.repartition(n, "fp"), most)
    found = materialize(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(link_sorted(most, part), schema), "simhash-links")
    edges, large = found.where("b is not null").select("a", "b"), found.where("b is null")
    if large.isEmpty():
        return edges
    parts = large.groupBy("key").agg(F.max("part").alias("last"))
    both = large.join(parts, "key").select("key", "fp", F.col("a").alias("node"), F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("q"))
    pairs = both.select("key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def done():
            if held:
                fps, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
                edges = forest(fps, (at[0] >> 32) // 16, most)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[[x for x, _ in edges]]), pa.array(nodes[[y for _, y in edges]])], names=["a", "b"])

        for batch in batches:
            key, p, q, fp, node = (batch.column(i).to_numpy() for i in range(5))
            change = np.flatnonzero((key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(key)], strict=True):
                if lo == hi:
                    continue
                now = (int(key[lo]), int(p[lo]), int(q[lo]))
                if now != at:
                    yield from done()
                    held, at = [], now
                held.append((fp[lo:hi].view(np.uint64), node[lo:hi]))
        yield from done()

    more = pairs.repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(run, "a long, b long")
    return edges.union(materialize(more, "simhash-large"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows of one fingerprint are one node, named by the fingerprint, whatever their number; only nodes are compared. The
    smallest id of a component's rows is taken at the end. Fingerprints of over ``hot_rows`` rows meet it by a broadcast
    (``join_groups``).

    Defined cases: null and empty texts have fingerprint zero, which links like any other; rows with a null id link and
    are linked through like any other, and a component without any id is null; repeated rows give equal rows; other
    columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash-fps")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")), "simhash-nodes")
    components = connected_components(links(nodes.select("fp", F.col("fp").alias("node")), most))
    labelled = nodes.join(components.withColumnRenamed("node", "fp"), "fp", "left")
    linked_ = labelled.where("component is not null")
    smallest = materialize(linked_.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("n_nodes")), "simhash-smallest")
    alone = labelled.where("component is null").select("fp", F.col("first").alias("component_id"))
    in_one = join_groups(linked_, smallest.drop("n_nodes"), "component", smallest, "n_nodes", hot_rows)
    named = alone.union(in_one.select("fp", "component_id"))
    return join_groups(prints, named, "fp", nodes, "n_rows", hot_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
