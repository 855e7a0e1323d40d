"""A corpus pipeline over ``documents``: each stage calls one operator of the subpackage ``concord.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All stages but the last return the columns of ``documents``. Other columns of ``docs``, whatever their
names, are left out, and an empty table gives an empty table in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import bpe
from concord.llm.common import documents, fresh_path, remove, scratch, with_row_key
from concord.llm.exact_dedup import exact_dedup
from concord.llm.language import with_language
from concord.llm.mixing import mixed_texts
from concord.llm.simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` is the predicted language; documents whose language can't be told go: null texts and those without a letter.

    Fitted on the rows with a ``lang`` that are not held out; without any, no language can be told and all documents go.
    Ties go to the language first by code points. Texts of any length are scored whole. Null ids, sources and sizes stay as
    they are, repeated rows stay all.
    """
    return with_language(docs).select(*COLUMNS)


def one_of_each(docs: DataFrame, key: str, groups: DataFrame, best: Callable[[Column], Column], order: list[Column]) -> DataFrame:
    """The row of each group that is ``best`` by ``order``, then by its key. ``groups`` has ``key`` and ``group``."""
    ranks = docs.select(key, F.struct(*order, F.col(key).alias("key")).alias("rank"))
    kept = groups.join(ranks, key).groupBy("group").agg(best("rank")["key"].alias(key))
    return docs.join(kept.select(key), key, "left_semi").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: one with the largest id, or with none if no row of the group has one.

    Rows are told apart by a written key, so rows with null or repeated ids are rows of their own. Null texts equal empty
    ones, and texts that differ in the case of A-Z alone are equal. Of repeated rows one stays.
    """
    keyed, key = with_row_key(docs, "pipeline-exact-rows")
    groups = exact_dedup(keyed, id_col=key).select(F.col("doc_id").alias(key), F.col("keep_id").alias("group"))
    return one_of_each(keyed, key, groups, F.max, [F.col("doc_id")])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: one with the smallest id, or with none if no row of the component has one.

    Null and empty texts have fingerprint zero, which links like any other. Rows with null or repeated ids are rows of their
    own; of repeated rows one stays.
    """
    keyed, key = with_row_key(docs, "pipeline-near-rows")
    groups = near_duplicates(keyed, id_col=key).select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    return one_of_each(keyed, key, groups, F.min, [F.col("doc_id").isNull(), F.col("doc_id")])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' texts as often and as far as the mix takes them; ``n_chars`` follows the text.

    A document of which words are taken in two epochs stands twice; one of which none are taken, as one without words, goes.
    A null source is a source, the last. Rows with null or repeated ids are documents of their own.
    """
    return mixed_texts(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text of every row of the mix.

    Null and empty texts have 0 tokens; null ids stay null; repeated rows give equal rows.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: The stages are not expressible in SQL; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others keep. What a stage wrote for itself is deleted once its result is written, and
    its result once the next one's is."""
    docs, before = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        for old in before:
            remove(spark, old)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
