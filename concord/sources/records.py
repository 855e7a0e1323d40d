"""Corpus, word lists, text samples, shard records, reproducers and metrics on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.bits import parse_word
from concord.sources.scratch import FOLDER, folder_of, foldered

FORMAT_VERSION = 1
CORRUPT = "_corrupt_record"
CORPUS = "format_version int, word string, category string, oracle_valid map<string,boolean>, oracle_text map<string,string>"
SHARD_RECORD = "shard_id int, start long, end long, sources array<string>, valid_counts map<string,bigint>, crash_count long, untriaged_crash_count long, content_hash string, duration_ms long, status string"
TEXT_SAMPLE = "word string, oracle_text map<string,string>"


def write_corpus(corpus: DataFrame, path: str, parts_per_shard: int = 1, folder_bits: int = 0) -> int:
    """Write by shard as zstd Parquet, sorted by tier and word; the number of shards written. Empty shards get no file.

    ``parts_per_shard`` spreads one shard over several tasks where shards are large; ``folder_bits`` puts ``2 **
    folder_bits`` shards in a folder where they are small.
    """
    salt = F.pmod(F.xxhash64("word"), F.lit(parts_per_shard))
    foldered(corpus, folder_bits, salt).sortWithinPartitions(folder_of(folder_bits), "shard", "tier", "word").write.mode("overwrite").option("compression", "zstd").partitionBy(folder_of(folder_bits)).parquet(path)
    return corpus.sparkSession.read.parquet(path).select("shard").distinct().count()


def of_known_version(corpus: DataFrame) -> DataFrame:
    """The same rows; a record of another format version, or without one, is an error when it is read."""
    version = F.col("format_version")
    return corpus.where(F.assert_true(version.eqNullSafe(F.lit(FORMAT_VERSION)), F.concat(F.lit("unknown format_version "), F.coalesce(version.cast("string"), F.lit("null")))).isNull())


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All stored records, of whatever version."""
    return spark.read.schema(f"{CORPUS}, tier int, shard long").parquet(path).drop(FOLDER)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return of_known_version(scan_corpus(spark, path))


def write_corpus_ndjson(corpus: DataFrame, path: str, folder_bits: int = 0) -> None:
    """One JSON object per line, sorted by word in its shard, in a folder per shard, or per ``2 ** folder_bits`` of them (gzip)."""
    columns = [c for c in ("format_version", "word", "category", "oracle_valid", "oracle_text") if c in corpus.columns]
    lines = corpus.select("shard", F.col("word").alias("_w"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    folder = folder_of(folder_bits)
    foldered(lines, folder_bits).sortWithinPartitions(folder, "shard", "_w").select("value", folder).write.mode("overwrite").option("compression", "gzip").partitionBy(folder).text(path)


def scan_corpus_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a corpus in JSON, of whatever version; those that aren't a record stand in ``_corrupt_record``."""
    return spark.read.schema(f"{CORPUS}, {CORRUPT} string").json(path).drop(FOLDER)


def read_corpus_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a corpus in JSON; blank lines are skipped, the last may lack its newline."""
    return of_known_version(spark.read.schema(CORPUS).json(path).drop(FOLDER))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """``word, rejected``: hex words, one a line with or without 0x; blank lines go, bad ones stand in ``rejected``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(parse_word(F.col("value")).alias("word"), F.when(parse_word(F.col("value")).isNull(), F.col("value")).alias("rejected"))


def read_text_sample(spark: SparkSession, path: str) -> DataFrame:
    """``word, texts`` of a text sample in JSON lines."""
    return spark.read.schema(TEXT_SAMPLE).json(path).select(parse_word(F.col("word")).alias("word"), F.col("oracle_text").alias("texts"))


def read_shard_records(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Shard records, one JSON document a file, or a line; ``_corrupt_record`` holds what couldn't be read."""
    return spark.read.schema(SHARD_RECORD + ", _corrupt_record string").option("multiLine", not lines).json(path).drop(FOLDER)


def write_shard_records(records: DataFrame, path: str, folder_bits: int = 0) -> None:
    """One JSON document per shard, in a folder of its own, so that shards can be written apart; with ``folder_bits`` a line per
    shard, ``2 ** folder_bits`` shards a folder, which are written together."""
    if folder_bits:
        foldered(records.withColumn("shard", F.col("shard_id")), folder_bits).drop("shard").sortWithinPartitions(FOLDER, "shard_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).json(path)
        return
    records.withColumn("shard", F.col("shard_id")).repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON document."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_rule_table(rules: DataFrame, metrics: DataFrame, aliases: DataFrame, path: str) -> None:
    for name, df in (("rules", rules), ("metrics", metrics), ("aliases", aliases)):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def write_reproducers(rendered: DataFrame, path: str) -> None:
    """``file, text`` rows, a folder per file."""
    rendered.select(F.col("text").alias("value"), "file").repartition("file").write.mode("overwrite").partitionBy("file").text(path)


def read_reproducers(spark: SparkSession, path: str) -> DataFrame:
    """Header fields ``- key: value`` of each file; of a repeated key the last counts."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"file=([^/]+)/", 1))
    last = lambda key: F.element_at(F.regexp_extract_all("value", F.lit(rf"(?m)^- {key}: (.*)$"), 1), -1)
    keys = ("word", "category", "tool", "spec", "actual")
    has = lambda key: F.col("value").rlike(rf"(?m)^- {key}: ")
    return files.select("file", *(F.when(has(k), last(k)).alias(k) for k in keys))
