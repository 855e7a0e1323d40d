"""Mix sources to target weights by blocks of words drawn through per-source index permutations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import materialize, with_row_key

#: Words of a block.
BLOCK = 64
#: Rows that one task orders, about, if all are of one source; and the least number of chunks.
CHUNK_ROWS, CHUNKS = 20_000, 256
#: Slots of the mix that one task draws, and that one task writes, about.
TASK_SLOTS, FILE_SLOTS = 1 << 20, 1 << 19
WEIGHTS = (3, 1, 2)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def share_out(sizes: list[int], weights: list[int], total: float, most: float) -> list[float]:
    """Targets by weight; none is over ``most`` times its size, what is above goes to the others by weight."""
    target, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
    return target


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (multiply and shift)."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each ``index`` under the permutation of ``range(n)`` that ``key`` names.

    Four Feistel rounds over the smallest even number of bits that holds n, walked until the value is below n.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    n, key = n.astype(np.uint64), key.astype(np.uint64)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            left, right = right, left ^ (mix64(right + key[todo] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r)) & mask[todo])
        x[todo] = left << half[todo] | right
        todo &= x >= n
    return x.astype(np.int64)


def index_of(place: int, n: int, key: int) -> int:
    """The index that ``permuted`` moves to ``place``: its rounds in reverse."""
    half = max(1, (math.ceil(math.log2(max(n, 2))) + 1) // 2)
    mask, x = (1 << half) - 1, place
    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(4)):
            scrambled = mix64(np.array([left + key * 0x9E3779B97F4A7C15 + r & (1 << 64) - 1], np.uint64))[0]
            left, right = right ^ int(scrambled) & mask, left
        x = left << half | right
        if x < n:
            return x


def epoch_key(seed: int, s, epoch):
    """Names the permutation of a source in an epoch."""
    return seed * 1_000_003 + s * 64 + epoch


def slots_for(target: int, size: int, block: int, seed: int, s: int) -> tuple[int, int]:
    """``(slots, words of the last one)`` that hold exactly ``target`` words of source ``s``.

    A whole epoch gives ``size`` words in its blocks, the last of which is short. In the epoch that is cut off the short
    block may be among the blocks taken; the words it lacks are then made up.
    """
    if not size or not target:
        return 0, block
    blocks, (epochs, rest) = -(-size // block), divmod(target, size)
    if not rest:
        return epochs * blocks, block
    lacks = blocks * block - size
    n = -(-rest // block)
    short = index_of(blocks - 1, blocks, epoch_key(seed, s, epochs))
    if short < n and n * block - lacks < rest:
        n += 1
    return epochs * blocks + n, rest - ((n - 1) * block - (lacks if short < n - 1 else 0))


#: From this sum on numpy draws no hypergeometric counts.
NUMPY_MOST = 10**9


def log_factorial(n: int) -> Decimal:
    """To some 28 digits after the point: from the factorial itself, or by Stirling's series, whose error is below n**-11."""
    with localcontext() as c:
        c.prec = 50
        if n < 500:
            return Decimal(math.factorial(n)).ln()
        x = Decimal(n)
        tail = sum(Decimal(a) / (b * x**k) for a, b, k in ((1, 12, 1), (-1, 360, 3), (1, 1260, 5), (-1, 1680, 7), (1, 1188, 9)))
        return (x + Decimal("0.5")) * x.ln() - x + LOG_ROOT_2PI + tail


LOG_ROOT_2PI = Decimal("0.91893853320467274178032973640561763986139747363778")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` of ``good + bad`` things are good, for counts of any size.

    Few draws are made one by one; others by ratio of uniforms (Stadlober's HRUA), with the logarithms in decimals, as the
    factorials of large counts cancel.
    """
    few, many, total = min(good, bad), max(good, bad), good + bad
    drawn = min(sample, total - sample)
    if min(drawn, few) < 10:
        # drawing few from many, or dealing the few things out to the places of the draw
        pool, tries = (few, drawn) if drawn <= few else (drawn, few)
        k = 0
        for i in range(tries):
            k += int(rng.integers(0, total - i)) < pool - k
    else:
        p = few / total
        a = drawn * p + 0.5
        c = math.sqrt((total - drawn) * drawn * p * (1 - p) / (total - 1) + 0.5)
        h = 1.7155277699214135 * c + 0.8989161620588988
        logs = lambda k: log_factorial(k) + log_factorial(few - k) + log_factorial(drawn - k) + log_factorial(many - drawn + k)
        mode = logs((drawn + 1) * (few + 1) // (total + 2))
        while True:
            u, v = 1 - rng.random(), rng.random()
            x = a + h * (v - 0.5) / u
            if not 0 <= x < min(drawn, few) + 1:
                continue
            k = int(x)
            if 2 * math.log(u) <= float(mode - logs(k)):
                break
    if good > bad:
        k = drawn - k
    return good - k if drawn < sample else k


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the slots that ``left`` counts by source, all equally likely: a multivariate hypergeometric draw."""
    total = int(left.sum())
    if total < NUMPY_MOST:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros(len(left), np.int64)
    for i, mine in enumerate(left.tolist()):
        total -= mine
        out[i] = hypergeometric(rng, mine, total, n) if n else 0
        n -= int(out[i])
    return out


@dataclass
class Plan:
    """Per source, in the order of code points with null last: its size, target, slots, and slots by output shard.

    A shard takes the next ``until[j, s] - until[j - 1, s]`` slots of source s, as drawn for it. Independent multinomial
    counts per shard, given that each source's counts add up to its slots, are multivariate hypergeometric: that is the draw,
    since a source has to give its target and no more.
    """

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    slots: list[int]
    last: list[int]  # words of the source's last slot
    until: np.ndarray  # (shards, sources): slots of the source up to and with the shard


def plan(sizes: dict[str | None, int], share: float, most: float, shards: int, seed: int, weights: tuple[int, ...], block: int) -> Plan:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    sized = [sizes[s] for s in names]
    targets = share_out(sized, [weights[i % len(weights)] for i in range(len(names))], share * sum(sized), most)
    cut = [slots_for(round(t), n, block, seed, s) for s, (t, n) in enumerate(zip(targets, sized, strict=True))]
    slots = [n for n, _ in cut]
    rng, left, drawn = np.random.default_rng(seed), np.array(slots, np.int64), []
    total = int(left.sum())
    for j in range(shards):
        # multinomial counts of the shard's sources, given what each source has to give in all
        drawn.append(draw(rng, left, total * (j + 1) // shards - total * j // shards) if len(names) and total else np.zeros(len(names), np.int64))
        left = left - drawn[-1]
    return Plan(names, sized, targets, slots, [n for _, n in cut], np.cumsum(np.array(drawn).reshape(shards, len(names)), axis=0))


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, th, row``: words of each whole text, counted on its bytes (``bytes.split`` knows ASCII space only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len((t.as_py() or b"").split()) for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, batch.column(3), batch.column(4)], names=["doc_id", "source", "size", "th", "row"])

    return docs.mapInArrow(run, "doc_id long, source string, size long, th long, row long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, shards: int = 16, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, row_col: str | None = None) -> tuple[DataFrame, DataFrame, Plan]:
    """``(documents, pieces, plan)``: the mix as pieces of documents.

    documents: ``row, doc_id, source, size, s`` (s: number of the source) and the stretch ``[start, start + size)`` of
    its words in the line of the source. pieces: ``row, epoch, shard, slot, block, word_from, word_to``, the words of
    the document (from 0) that a slot of the mix takes. The counts drawn for a shard say which slots of each source it
    takes; ``slot`` is the place among all slots of the shard, whose sources are mixed there by one more permutation. The
    k-th slot of a source takes block ``permutation(k mod blocks)`` of epoch ``k div blocks``; its last slot takes only the
    words that are left to the target, so every source gives its target, rounded. Only one row per source
    meets on the driver; no source is gathered in one task: its line is built from sums per chunk of rows.

    Defined cases: null and empty texts have size 0 and are never taken; a null source is a source, the last; repeated
    rows are documents of their own; null ids are ids; an empty table gives an empty mix. ``row`` is ``row_col``, a written
    unique key, where one is given. Documents stand in the order of id, size and text, so only equal rows may change places.
    """
    spark = docs.sparkSession
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    text = F.col(text_col).cast("string")
    sized = sizes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.cast("binary").alias("text"), F.xxhash64(text).alias("th"), row.alias("row")))
    sized = materialize(sized, "mix-sizes")
    chunks = max(CHUNKS, -(-sized.count() // CHUNK_ROWS))
    p = plan({r.source: r.size for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}, share, most, shards, seed, weights, block)
    table = spark.createDataFrame([(s, i) for i, s in enumerate(p.names)], "name string, s int")
    base = sized.join(F.broadcast(table), sized["source"].eqNullSafe(table["name"])).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "th"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy("s", "chunk").agg(F.sum("size").alias("n")).select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    line = Window.partitionBy("s", "chunk").orderBy(F.col("doc_id").asc_nulls_last(), "size", "th", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.withColumn("upto", F.sum("size").over(line)).join(offsets, ["s", "chunk"]).select("row", "doc_id", "source", "size", "s", (F.col("offset") + F.col("upto") - F.col("size")).alias("start"))
    placed = materialize(placed, "mix-line")

    slots, first = np.array(p.slots, np.int64), np.append(0, np.cumsum(p.slots))
    blocks = -(-np.array(p.sizes, np.int64) // block)
    last, until = np.array(p.last, np.int64), p.until
    start = np.vstack([np.zeros((1, until.shape[1]), np.int64), until])  # slots of a source that the shards before take
    ahead = np.cumsum(np.diff(start, axis=0), axis=1) - np.diff(start, axis=0)  # in a shard, slots of the sources before
    full = np.diff(start, axis=0).sum(axis=1)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column(0).to_numpy()
            s = np.searchsorted(first, number, side="right") - 1
            k = number - first[s]
            epoch, index = k // blocks[s], k % blocks[s]
            at = permuted(index, blocks[s], epoch_key(seed, s, epoch))
            shard = (until[:, s] <= k).sum(axis=0)
            slot = permuted(ahead[shard, s] + k - start[shard, s], full[shard], epoch_key(seed, len(slots), shard))
            most_words = np.where(k == slots[s] - 1, last[s], block)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in ((s, np.int32), (at, np.int64), (epoch, np.int32), (shard, np.int32), (slot, np.int64), (most_words, np.int64))], names=["s", "block", "epoch", "shard", "slot", "words"])

    tasks = max(spark.sparkContext.defaultParallelism, -(-int(first[-1]) // TASK_SLOTS))
    taken = spark.range(0, int(first[-1]), 1, tasks).mapInArrow(drawn, "s int, block long, epoch int, shard int, slot long, words long")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    lo, hi = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    pieces = cut.join(taken, ["s", "block"]).select("row", "epoch", "shard", "slot", "block", (lo - F.col("start")).alias("word_from"), (hi - F.col("start")).alias("word_to"), (lo - F.col("block") * block).alias("at")).where("word_to > word_from")
    return placed, pieces, p


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, n_slots, shards`` for every row.

    ``n_slots`` counts the slots that take words of the document, ``shards`` lists the output shards they are drawn for,
    ascending, with the words each takes, as in ``0:64 3:12``.
    """
    placed, pieces, p = mix(docs, **options)
    facts = docs.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(p.sizes, p.targets, strict=True))], "s int, source_size long, target double")
    by_shard = pieces.groupBy("row", "shard").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("words"), F.count("*").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("shard", "words")))  # a row per shard at most
    taken = by_shard.groupBy("row").agg(F.sum("words").alias("taken"), F.sum("n").alias("n_slots"), F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["shard"], x["words"])), " ").alias("shards"))
    none = F.lit(0).cast("long")
    return placed.join(F.broadcast(facts), "s").join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("n_slots", none).alias("n_slots"), F.coalesce("shards", F.lit("")).alias("shards"))


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORDS.finditer(text)]


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as rows of ``docs``: each document once per epoch that takes words of it, with the text taken.

    A document taken as a whole keeps its exact text. Of others the taken stretches of words stand joined by a newline.
    The columns are those of ``docs``; documents with no word taken are absent. Texts
    meet their stretches by a written row key, so rows with null or repeated ids are documents of their own.
    """
    columns = docs.columns
    docs, key = with_row_key(docs, "mix-rows")
    placed, pieces, _ = mix(docs, id_col=id_col, text_col=text_col, row_col=key, **options)
    spans = pieces.groupBy("row", "epoch").agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("_spans"))  # no more than the document's blocks
    spans = spans.join(placed.select("row", "size"), "row").select(F.col("row").alias(key), F.col("size").alias("_size"), "_spans")

    @F.pandas_udf("string")
    def cut(texts, spans):
        def one(text: str, pairs) -> str:
            merged: list[list[int]] = []
            for p in pairs:
                lo, hi = int(p["word_from"]), int(p["word_to"])
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            at = word_spans(text)
            return "\n".join(text[at[lo][0] : at[hi - 1][1]] for lo, hi in merged)

        import pandas as pd

        return pd.Series([one(t, p) for t, p in zip(texts, spans, strict=True)], dtype="object")

    names = dict(zip(columns, [f"_c{i}" for i in range(len(columns))], strict=True))  # apart from the columns added here
    texts = docs.select(key, *(F.col(c).alias(n) for c, n in names.items()))
    text = names[text_col]
    joined = texts.join(spans, key)
    words = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, p: n + p["word_to"] - p["word_from"])
    shown = [F.col(n).alias(c) for c, n in names.items()]
    whole = joined.where(words == F.col("_size")).select(*shown)
    part = joined.where(words < F.col("_size")).withColumn(text, cut(F.col(text).cast("string"), F.col("_spans"))).select(*shown)
    return whole.unionByName(part)


def write_mix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Write the mix to ``path``: a ``mix_shard=<k>`` folder for each output shard, of rows ``slot, at, doc_id, text``.

    A row is what one document gives to one slot; ``at`` is the place of its first word in the block. The rows of a file
    are in the order of slots, and a file holds a range of the shard's slots, so a reader gets the drawn order.
    """
    docs, key = with_row_key(docs, "mix-rows")
    _, pieces, p = mix(docs, id_col=id_col, text_col=text_col, row_col=key, **options)
    spans = pieces.groupBy(F.col("row").alias(key)).agg(F.collect_list(F.struct("shard", "slot", "at", "word_from", "word_to")).alias("_spans"))  # most * size / block of a document, and its ends

    @F.pandas_udf("array<string>")
    def cut(texts, spans):
        import pandas as pd

        def one(text: str, pairs) -> list[str]:
            at = word_spans(text)
            return [text[at[p["word_from"]][0] : at[p["word_to"] - 1][1]] for p in pairs]

        return pd.Series([one(t, x) for t, x in zip(texts, spans, strict=True)], dtype="object")

    texts = docs.select(key, F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(spans, key)
    rows = texts.select("_id", F.explode(F.arrays_zip(F.col("_spans"), cut("_text", "_spans").alias("_texts"))).alias("x"))
    rows = rows.select(F.col("x._spans.slot").alias("slot"), F.col("x._spans.at").alias("at"), F.col("_id").alias("doc_id"), F.col("x._texts").alias("text"), F.col("x._spans.shard").alias("mix_shard"))
    files = sum(max(1, -(-int(n) // FILE_SLOTS)) for n in np.diff(p.until, axis=0, prepend=0).sum(axis=1))
    part = F.expr(f"slot div {FILE_SLOTS}")
    dealt = rows.repartition(max(1, files), "mix_shard", part).sortWithinPartitions("mix_shard", "slot", "at")
    dealt.write.option("compression", "zstd").partitionBy("mix_shard").parquet(path)
