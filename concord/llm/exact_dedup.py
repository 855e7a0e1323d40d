"""Exact deduplication by a 128-bit content hash, verified by bytes. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import HOT_ROWS, LOWER, UPPER, join_groups, materialize


#: Hashes of groups of two or more that may be broadcast (8 bytes each); beyond it their texts are found by a shuffle.
FEW_GROUPS = 1_000_000


def normalise(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def hash128(digest_hex: Column) -> Column:
    """The first 128 bits of a SHA-256 given as hex."""
    return F.substring(digest_hex, 1, 32)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    content_hash: Callable[[Column], Column] = hash128,
    few_groups: int = FEW_GROUPS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows group by the content hash with map-side combine, so a group with a third of all rows costs one row per
    task. Groups of two or more are then verified: their texts are grouped again by (hash, bytes). Should one hash
    hold different bytes, those rows are regrouped by their bytes, so a collision never merges different texts. Rows
    get the result of their group by an exchange; groups of over ``hot_rows`` are broadcast instead (``join_groups``).

    Defined cases: a null text is an empty text; empty texts are equal to each other; of equal texts the row with the
    largest id stays (``keep="min"``: smallest). Repeated rows with one id are all counted, and all of them are kept
    or dropped together. Null ids never stay unless the whole group has none. An empty table gives an empty result;
    other columns are ignored.
    """
    pick = F.max if keep == "max" else F.min
    texts = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("_norm"))
    hashed = materialize(texts.select("doc_id", F.sha2("_norm", 256).alias("text_sha256")).withColumn("_h", content_hash(F.col("text_sha256"))), "dedup-hash")
    groups = materialize(hashed.groupBy("_h").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-groups")

    # bytes inside groups: only the texts of groups of two or more meet again. They are picked in the scan by 64 bits of
    # the content hash; a text picked for those alone has a group of its own and is found equal to itself
    short = F.xxhash64("_h").alias("_s")
    many = groups.where("group_size > 1").select(short).distinct()
    few = groups.where("group_size > 1").count() <= few_groups
    same = texts.withColumn("_h", content_hash(F.sha2("_norm", 256))).withColumn("_s", short).join(F.broadcast(many) if few else many, "_s", "left_semi")
    classes = same.groupBy("_h", "_norm").agg(F.count("*").alias("_n"))
    collided = materialize(classes.groupBy("_h").agg(F.count("*").alias("_classes")).where("_classes > 1"), "dedup-collided")

    def shown(df: DataFrame) -> DataFrame:
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return df.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), "text_sha256")

    if collided.isEmpty():
        return shown(join_groups(hashed, groups, "_h", groups, "group_size", hot_rows))
    apart = texts.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_h", content_hash(F.col("text_sha256"))).join(collided.select("_h"), "_h", "left_semi")
    by_bytes = apart.groupBy("_h", "_norm").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    whole = groups.join(collided, "_h", "left_anti")
    return shown(join_groups(hashed, whole, "_h", groups, "group_size", hot_rows)).union(shown(apart.join(by_bytes, ["_h", "_norm"])))
