"""Small helpers shared by the operators: written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for lower-casing A-Z alone (``lower`` would change other letters too).
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Groups that hold more rows than this are hot, unless the table is so large that FEW_HOT groups of this size are common:
#: then those are hot that hold over a FEW_HOT-th of all rows. So fewer than FEW_HOT groups are, and they may be broadcast.
HOT_ROWS = 100_000
FEW_HOT = 100_000


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_below: ContextVar[str | None] = ContextVar("below", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are the driver, gets a temporary folder where that is unset; on a cluster each
    executor would write to a disk of its own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="concord-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_below.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*written: DataFrame) -> None:
    """Delete the folders of tables made by ``materialize`` that nothing reads any more."""
    for df in written:
        remove(df.sparkSession, df._written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what is to stay has its path from before."""
    folder = fresh_path(spark, "scratch")
    token = _below.set(folder)
    try:
        yield
    finally:
        _below.reset(token)
        remove(spark, folder)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: what reads the result survives the loss of any executor without recomputing ``df``.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def with_row_key(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` with a key for each row, written, and the name of the key's column, which no column of ``df`` has."""
    key = "_row"
    while key.lower() in {c.lower() for c in df.columns}:
        key += "_"
    return materialize(df.withColumn(key, F.monotonically_increasing_id()), name), key


def join_groups(rows: DataFrame, groups: DataFrame, key: str, sizes: DataFrame, size: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined on ``key`` to ``groups``, which has one row per key; all of its columns must be small.

    ``sizes`` is a written table with the number of rows of every key in column ``size``. The hot groups are broadcast, so
    none is gathered in a task, whatever share of the rows it holds; the others meet in one exchange.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    hot = sizes.where(F.col(size) > max(hot_rows, total // FEW_HOT)).select(key)
    if hot.isEmpty():
        return rows.join(groups, key)
    hot = F.broadcast(hot)
    many, others = groups.join(hot, key, "left_semi"), groups.join(hot, key, "left_anti")
    return rows.join(F.broadcast(many), key).unionByName(rows.join(hot, key, "left_anti").join(others, key))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node id reachable.

    Every round hooks each node to its smallest neighbour and contracts the edges to those; every node that is
    not a local minimum goes, so the edges shrink geometrically in practice. All steps are joins and
    pre-aggregated ``min``; a hub is never gathered into one group. Each round is written to the shared folder.
    """
    live = materialize(
        edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null").distinct(), "cc-edges"
    )
    labels = materialize(live.select(F.col("u").alias("node")).union(live.select("v")).distinct().withColumn("component", F.col("node")), "cc-labels")
    while True:
        open_ = live.where("u <> v")
        if open_.isEmpty():
            release(live)
            return labels
        both = open_.select("u", "v").union(open_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-hook")
        hook = nearest
        # two pointer jumps before contracting: chains of decreasing ids fold up
        for _ in range(2):
            up = hook.select(F.col("u").alias("m"), F.col("m").alias("mm"))
            hook = hook.join(up, "m", "left").select("u", F.coalesce("mm", "m").alias("m"))
        hook = materialize(hook, "cc-hook")
        named = materialize(
            labels.join(hook.select(F.col("u").alias("component"), "m"), "component", "left").select("node", F.coalesce("m", "component").alias("component")), "cc-labels"
        )
        to_u, to_v = hook.select("u", F.col("m").alias("mu")), hook.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        contracted = materialize(
            open_.join(to_u, "u", "left").join(to_v, "v", "left").select(F.coalesce("mu", "u").alias("u"), F.coalesce("mv", "v").alias("v")).where("u <> v").distinct(), "cc-edges"
        )
        release(live, labels, nearest, hook)
        live, labels = contracted, named
