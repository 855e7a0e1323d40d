"""Minimum-cost-flow resharding: move the fewest bytes from old shards to new ones of equal capacity."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import fresh_path, materialize

#: Files of the old layout: rows of a line that the flow cuts, rows whose text stands in several old shards, heavy ones.
LINED, SHARED, HEAVY = 0, 1, 2
#: Blocks of an old shard, by the hash of the text; equal texts share a block.
#: Each falls into one or two shards, so the blocks of a task bound the files it writes.
BLOCKS = 48
#: Parts of a block that holds too much for one task or shard, by more bits of the text's hash; the rows of a group that
#: is too large for one shard go by the hash of their id.
PARTS = 16
#: Bytes of a part, about, apart from large groups of equal texts; blocks of more than PARTS times as many get more parts.
PART_BYTES = 1 << 27
#: Bytes of text that one task sorts and writes, about.
TASK_BYTES = 1 << 27
#: Groups of equal texts, and single documents, above this share of a shard's bytes (there are at most its inverse times the
#: number of shards) are placed one by one before the flow is solved.
LARGE_GROUP = 1 / 200
#: A group of equal texts of at most this share of a shard's bytes always stays in one shard. A larger one does if a shard
#: has room for it when the larger groups are placed; else it is spread, as the shards could not be of equal size.
WHOLE_GROUP = 1 / 4


def capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def place_heavy(heavy: list[tuple[int, int]], caps: list[int]) -> list[int]:
    """Shard of each group or document ``(size, old shard)``, largest first: the old one while it has room, else the emptiest."""
    load, at = [0] * len(caps), [0] * len(heavy)
    for i in sorted(range(len(heavy)), key=lambda i: (-heavy[i][0], i)):
        size, old = heavy[i]
        at[i] = old if old < len(caps) and load[old] + size <= caps[old] else min(range(len(caps)), key=lambda s: (load[s] - caps[s], s))
        load[at[i]] += size
    return at


def kept_whole(sizes: list[int], caps: list[int], always: int) -> list[bool]:
    """Which groups stay whole: those of up to ``always`` bytes, and of the others, largest first, each that fits into what
    the emptiest shard has left."""
    load, kept = [0] * len(caps), [False] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = min(range(len(caps)), key=lambda s: (load[s] - caps[s], s))
        kept[i] = sizes[i] <= always or load[s] + sizes[i] <= caps[s]
        load[s] += sizes[i] * kept[i]
    return kept


def levelled(total: int, load: list[int]) -> list[int]:
    """Capacities that bring unequal loads to one level by ``total`` more bytes; none is below 0."""
    order = sorted(range(len(load)), key=lambda s: load[s])
    n, below = 0, 0
    while n < len(order) and (n == 0 or load[order[n]] * n - below < total):
        below += load[order[n]]
        n += 1
    shares = capacities(total + below, n)
    return [max(0, shares[order.index(s)] - load[s]) if s in order[:n] else 0 for s in range(len(load))]


def min_cost_flow(sizes: list[int], caps: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard; a byte that stays where it is costs 0, a moved one 1.

    Successive shortest augmenting paths on the bipartite graph of shards (its size depends on the shard counts only).
    """
    n, m = len(sizes), len(caps)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, cap: int, c: int) -> None:
        for x, y, r, k in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    for o, size in enumerate(sizes):
        edge(source, o, size, 0)
        for s in range(m):
            edge(o, n + s, size, int(o != s))
    for s, cap in enumerate(caps):
        edge(n + s, sink, cap, 0)
    while True:
        dist, via = {source: 0}, {}
        queue = deque([source])
        while queue:  # label correcting: residual edges may cost -1
            x = queue.popleft()
            for e in graph[x]:
                if room[e] > 0 and dist[x] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = dist[x] + cost[e], e
                    queue.append(to[e])
        if sink not in dist:
            break
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    return {(to[e ^ 1], to[e] - n): room[e ^ 1] for o in range(n) for e in graph[o] if n <= to[e] < n + m and room[e ^ 1] > 0}


@dataclass(frozen=True)
class Plan:
    """Where rows stand and where they go. ``rows(df)`` adds ``was``, ``kind``, ``block`` (the file of the old layout),
    ``pieces`` (cuts of its line) and ``shard`` to rows with ``doc_id, size, old, th, b1``; ``slim`` are such rows without texts."""

    rows: Callable[[DataFrame], DataFrame]
    slim: DataFrame
    flow: dict[tuple[int, int], int]
    tasks: int


def sized(docs: DataFrame, old_shard: Column, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(old_shard, F.lit(0)).cast("int").alias("old"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"),
    ).withColumn("b1", F.pmod(F.col("th"), F.lit(BLOCKS)).cast("int"))


def plan(base: DataFrame, n_old: int, n_new: int) -> Plan:
    """Block transfers that bring the rows of ``sized`` into ``n_new`` shards of near equal bytes; reads texts once, for their sizes."""
    spark = base.sparkSession
    slim = materialize(base.drop("text"), "shard-sizes")
    total = slim.agg(F.sum("size")).first()[0] or 0
    most, whole = (max(1, int(total / n_new * x)) for x in (LARGE_GROUP, WHOLE_GROUP))
    groups = slim.groupBy("th").agg(F.sum("size").alias("b"), F.min("old").alias("lo"), F.max("old").alias("hi"), F.min(F.struct("doc_id", "old"))["old"].alias("home"))
    groups = materialize(groups.where((F.col("lo") < F.col("hi")) | (F.col("b") > most)), "shard-groups")
    # at most n_new / LARGE_GROUP of them, of which fewer than n_new / WHOLE_GROUP are spread
    large_groups = groups.where(F.col("b") > most).select("th", "b", "home").orderBy("th").collect()
    kept = kept_whole([r.b for r in large_groups], capacities(total, n_new), whole)
    hot = [r.th for r, k in zip(large_groups, kept, strict=True) if not k]
    homes = groups.where(F.col("b") <= most).select("th", "home")
    several = not homes.isEmpty()

    # the rows of a group too large for one shard are told apart by the hash of their id
    is_hot = F.col("th").isin(hot) if hot else F.lit(False)
    own = F.when(is_hot, F.xxhash64("doc_id")).otherwise(F.lit(0)).cast("long")
    single = slim.where(is_hot & (F.col("size") > most)).groupBy("th", own.alias("own")).agg(F.sum("size").alias("b"), F.min("old").alias("old")).orderBy("th", "own").collect()  # at most n_new / LARGE_GROUP rows
    heavy = [(r.th, 0, r.b, r.home) for r, k in zip(large_groups, kept, strict=True) if k] + [(r.th, r.own, r.b, r.old) for r in single]
    placed_at = place_heavy([(b, o) for _, _, b, o in heavy], capacities(total, n_new))
    load = [0] * n_new
    for (_, _, b, _), s in zip(heavy, placed_at, strict=True):
        load[s] += b
    heavy_at = F.broadcast(spark.createDataFrame([(th, o, s) for (th, o, _, _), s in zip(heavy, placed_at, strict=True)], "th long, own long, heavy_shard int"))
    limit = max(1, min(total // n_new // 4, PART_BYTES))

    def lined(df: DataFrame) -> DataFrame:
        """Rows with the old shard they stand in (``was``) and the line the flow cuts them from (``old``): that of the smallest
        id for groups of several old shards, -1 for heavy groups and documents."""
        df = df.withColumn("was", F.col("old")).withColumn("home", F.lit(None).cast("int"))
        if several:
            salt = F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)).cast("int") + 1).otherwise(F.lit(0))
            df = df.drop("home").withColumn("salt", salt).join(homes.withColumn("salt", F.lit(0)), ["th", "salt"], "left").drop("salt")
        found = df.withColumn("own", own).join(heavy_at, ["th", "own"], "left")
        # of a hot group only documents that are heavy by themselves are placed one by one
        found = found.withColumn("heavy_shard", F.when(~is_hot | (F.col("size") > most), F.col("heavy_shard")))
        kind = F.when(F.col("heavy_shard").isNotNull(), HEAVY).when(F.col("home").isNotNull(), SHARED).otherwise(LINED)
        return found.withColumn("kind", kind).withColumn("old", F.when(F.col("kind") == HEAVY, -1).otherwise(F.coalesce("home", "old"))).drop("home")

    slim = materialize(lined(slim), "shard-lines")
    rows = slim.where("old >= 0").groupBy("old", "b1").agg(F.sum("size").alias("b")).collect()
    sizes = [sum(r.b for r in rows if r.old == o) for o in range(n_old)]
    flow = min_cost_flow(sizes, levelled(sum(sizes), load))
    large = {(r.old, r.b1): max(PARTS, -(-r.b // PART_BYTES)) for r in rows if r.b > limit}
    by_id, by_text = (F.pmod(h, F.col("n_parts")).cast("int") for h in (F.xxhash64("doc_id"), F.shiftright("th", 20)))
    # files of rows that stand in no line, no larger than a part of a line in the fullest old shard
    loose = {r.kind: max(1, -(-r.b // limit)) for r in slim.where(F.col("kind") != LINED).groupBy("kind", "was").agg(F.sum("size").alias("b")).groupBy("kind").agg(F.max("b").alias("b")).collect()}
    most_parts = max(large.values(), default=1)
    # a row per block at most; heavy documents (old -1) have none
    cut_up = F.broadcast(spark.createDataFrame([(o, b, n) for (o, b), n in sorted(large.items())], "old int, b1 int, n_parts int"))

    def filed(df: DataFrame) -> DataFrame:
        df = df.join(cut_up, ["old", "b1"], "left").withColumn("b2", F.when(F.col("n_parts").isNull(), 0).when(is_hot, by_id).otherwise(by_text))
        block = F.when(F.col("kind") == LINED, F.col("b1").cast("long") * most_parts + F.col("b2"))
        block = block.when(F.col("kind") == SHARED, F.pmod(F.shiftright("th", 20), F.lit(loose.get(SHARED, 1))))
        return df.withColumn("block", block.otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(loose.get(HEAVY, 1))))).drop("n_parts")

    slim = filed(slim)
    parts = {(r.old, r.b1, r.b2): r.b for r in slim.where("old >= 0").groupBy("old", "b1", "b2").agg(F.sum("size").alias("b")).collect()} if large else {(r.old, r.b1, 0): r.b for r in rows}
    starts, at = [], {}
    for (o, b1, b2), size in sorted(parts.items()):
        starts.append((o, b1, b2, at.get(o, 0)))
        at[o] = at.get(o, 0) + size
    cuts = []
    for o in range(n_old):
        lo, mine = 0, []
        for s in sorted((s for x, s in flow if x == o), key=lambda s: (s != o, s)):
            mine.append((lo, s))
            lo += flow[o, s]
        cuts.append((o, mine or [(0, o % n_new)]))
    # the first table has a row per part, the second one per old shard
    start = F.broadcast(spark.createDataFrame(starts, "old int, b1 int, b2 int, start long"))
    cut = F.broadcast(spark.createDataFrame(cuts, "old int, cuts array<struct<lo: long, shard: int>>"))
    line = Window.partitionBy("old", "b1", "b2").orderBy("th", "own").rowsBetween(Window.unboundedPreceding, 0)
    texts = slim.where("old >= 0").groupBy("old", "b1", "b2", "th", "own").agg(F.sum("size").alias("b"), F.sum((F.col("kind") == LINED).cast("long")).alias("n"))
    texts = texts.withColumn("pos", F.sum("b").over(line) - F.col("b")).join(start, ["old", "b1", "b2"]).join(cut, "old")
    texts = texts.withColumn("shard", F.expr("element_at(filter(cuts, c -> c.lo <= start + pos), -1).shard"))
    # where a line is cut inside a part: a row per part, and one more per transfer
    pieces = texts.groupBy("old", "b1", "b2", "shard").agg(F.min(F.struct("th", "own")).alias("first"), F.sum("n").alias("n"))
    before = Window.partitionBy("old", "b1", "b2").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("rows_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = materialize(pieces.groupBy("old", "b1", "b2").agg(F.sort_array(F.collect_list(F.struct("first", "shard", "rows_before"))).alias("pieces")), "shard-pieces")

    def to_shards(df: DataFrame) -> DataFrame:
        found = df.join(F.broadcast(pieces), ["old", "b1", "b2"], "left")
        mine = "element_at(filter(pieces, p -> p.first.th < th or (p.first.th = th and p.first.own <= own)), -1)"
        return found.withColumn("piece", F.expr(f"case when old >= 0 then {mine} end")).withColumn("shard", F.coalesce("heavy_shard", "piece.shard"))

    # as many tasks as the bytes need, however few the session has by default
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return Plan(lambda df: to_shards(filed(lined(df))), to_shards(slim), flow, tasks)


def write_layout(base: DataFrame, where: Plan, path: str) -> None:
    """The layout before: a file per old shard and block, rows numbered from 1 in ``rn`` by the hash of the text. Each row
    carries the shard it is to have, so that rewriting reads a file without looking anything up.

    Rows whose text stands in several old shards, and heavy ones, are in files apart, so that a transfer of blocks
    leaves the others as they are. The texts move in one exchange, to as many tasks as the bytes need.
    """
    rows = where.rows(base).repartition(where.tasks, "was", "kind", "block")
    order = Window.partitionBy("was", "kind", "block").orderBy("th", "own", F.col("doc_id").asc_nulls_first())
    rows = rows.withColumn("rn", F.row_number().over(order).cast("long")).withColumn("rows_before", F.col("piece.rows_before"))
    rows.select("doc_id", "text", "size", "shard", "rn", "rows_before", "was", "kind", "block").write.option("compression", "zstd").partitionBy("was", "kind", "block").parquet(path)


def rewrite(layout: DataFrame, files: DataFrame, tasks: int, path: str) -> None:
    """Write the rows of the files that don't stay to ``path``, by new shard; rows of lines keep their order and don't move
    between tasks, groups from several shards and heavy ones meet in one exchange."""
    moved = layout.join(F.broadcast(files.where(~F.col("kept")).select("was", "kind", "block")), ["was", "kind", "block"])
    columns = ["doc_id", "text", "size", "was", "kind", "block", "rn", "shard"]
    cut = moved.where(F.col("kind") == LINED).withColumn("rn", F.col("rn") - F.col("rows_before"))
    file = ["was", "kind", "block", "shard"]
    loose = moved.where(F.col("kind") != LINED).repartition(tasks, *file).withColumn("rn", F.row_number().over(Window.partitionBy(*file).orderBy("rn")).cast("long"))
    cut.select(*columns).unionByName(loose.select(*columns)).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> dict[tuple[int, int], int]:
    """Write ``docs`` in their old layout to ``path/old``, bring them into ``n_new`` shards and return the flow.

    ``old_shard`` is an expression over ``docs`` in [0, n_old). Rows of an old shard stand in one line, ordered by block
    (hash of the text), text hash and id; the flow cuts that line. Files of the layout whose rows all stay are left alone;
    the others are written anew to ``path/new`` by shard. ``path/files`` has a row per file: its rows, bytes, moved bytes
    and whether it is kept. ``read_shards`` reads both.

    Equal texts of several old shards stand on one line, that
    of their smallest id; large groups are placed as a whole first; a group over WHOLE_GROUP of a shard that no shard has room
    for is spread (``kept_whole``). Only sums per block meet on the driver: at most
    ``n_old * BLOCKS`` rows, PARTS or a row per PART_BYTES of each block that is too large, and the few heavy documents and
    groups; cuts and files are tables of that size. The texts move in one exchange, and in one more
    where the table of groups on several lines is too large to be broadcast. Places are computed without texts.

    Defined cases: a null text counts 8 bytes and equals no group but the other null and empty texts; null ids are
    ordered first; repeated rows are rows of their own (of a group that is spread, rows of equal id stay together); an
    empty table writes an empty dataset.
    """
    base = sized(docs, old_shard, id_col, text_col)
    where = plan(base, n_old, n_new)
    moves = (F.col("shard") != F.col("was")).cast("long")
    files = where.slim.groupBy("was", "kind", "block").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum(moves * F.col("size")).alias("moved_bytes"), F.max(moves).alias("moves"))
    files.withColumn("kept", (F.col("kind") == LINED) & (F.col("moves") == 0)).drop("moves").write.parquet(f"{path}/files")
    spark = docs.sparkSession
    write_layout(base, where, f"{path}/old")
    rewrite(old_layout(spark, path), old_files(spark, path), where.tasks, f"{path}/new")
    return where.flow


def old_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, text string, size long, shard int, rn long, rows_before long, was int, kind int, block long").parquet(f"{path}/old")


def old_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("was int, kind int, block long, rows long, bytes long, moved_bytes long, kept boolean").parquet(f"{path}/files")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of kept and of rewritten files with ``was`` (the old shard), ``rewritten`` and ``slot``, gapless from 0 in every
    shard, in the order of old shards and their blocks."""
    file = ["was", "kind", "block"]
    columns = ["doc_id", "text", "size", *file, "rn", "shard", "rewritten"]
    kept = F.broadcast(old_files(spark, path).where(F.col("kept") == F.lit(True)).select(*file))
    stay = old_layout(spark, path).join(kept, file).withColumn("rewritten", F.lit(False)).select(*columns)
    new = spark.read.schema("doc_id long, text string, size long, was int, kind int, block long, rn long, shard int").parquet(f"{path}/new")
    rows = stay.unionByName(new.withColumn("rewritten", F.lit(True)).select(*columns))
    counts = rows.groupBy("shard", *file).agg(F.count("*").alias("n"))  # a row per file, and one more per transfer
    before = Window.partitionBy("shard").orderBy(*file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", *file, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), ["shard", *file]).withColumn("slot", (F.col("_before") + F.col("rn") - 1).cast("long")).drop("_before", "rn")


def reshard_documents(docs: DataFrame, n_old: int = 20, n_new: int = 24, group_col: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, rewritten`` as read back from the shards.

    The old layout has one shard per hash of ``group_col``, so it is as skewed as the sources are. ``rewritten`` is false for
    rows whose file stayed as it was.
    """
    path = fresh_path(docs.sparkSession, "shards")
    reshard(docs, F.pmod(F.xxhash64(F.coalesce(F.col(group_col).cast("string"), F.lit(""))), F.lit(n_old)), n_old, n_new, path)
    return read_shards(docs.sparkSession, path).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("was").alias("old_shard"),
        "rewritten",
    )
