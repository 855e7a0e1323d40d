"""Raw bitmaps of a whole domain, one file ``<source>.bin`` each, as a data source that reads and writes ranges of bytes."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "verdict_bitmaps"
SCHEMA = "source string, block long, bits long, shard long"
#: Bytes that one task reads, and that one task writes of a file.
RANGE = 1 << 22
#: Blocks that one batch of rows has.
BATCH = 1 << 16


def file_bytes(n_words: int) -> int:
    return (n_words + 7) >> 3


def opened(path: str):
    """A file system and the path in it. Local paths and ``file:`` need no other library, others go through Arrow."""
    import pyarrow.fs

    if urlparse(path).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem(), local(path)
    return pyarrow.fs.FileSystem.from_uri(path)


def local(path: str) -> str:
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"bitmaps are written in place, which {found.scheme}: can't do; give a folder that all executors mount")
    return unquote(found.path) if found.scheme else path


@dataclass
class Range(InputPartition):
    source: str
    start: int
    end: int


class Reader(DataSourceReader):
    """A partition is a range of one file's bytes. The size of every file is checked while the scan is planned."""

    def __init__(self, options: dict):
        self.path, self.n_words = options["path"].rstrip("/"), int(options["words"])
        self.shard_bits, self.dense = int(options.get("shardbits", 24)), options.get("dense", "false") == "true"
        self.range = max(8, int(options.get("rangebytes", RANGE)) // 8 * 8)
        self.sources = [s for s in options.get("sources", "").split(",") if s]
        self.shards = sorted({int(s) for s in options.get("shards", "").split(",") if s}) if "shards" in options else None

    def stretches(self) -> list[tuple[int, int]]:
        """Bytes to read of each file: all, or those of the shards asked for."""
        size = file_bytes(self.n_words)
        if self.shards is None:
            return [(0, size)]
        bytes_ = 1 << (self.shard_bits - 3)
        return [(s * bytes_, min((s + 1) * bytes_, size)) for s in self.shards if s * bytes_ < size]

    def partitions(self) -> list[Range]:
        import pyarrow.fs

        files, root = opened(self.path)
        names = self.sources or sorted(f.base_name[:-4] for f in files.get_file_info(pyarrow.fs.FileSelector(root)) if f.base_name.endswith(".bin") and not f.base_name.startswith("."))
        for name in names:
            found = files.get_file_info(f"{root}/{name}.bin")
            if found.type == pyarrow.fs.FileType.NotFound:
                raise FileNotFoundError(f"{self.path}/{name}.bin")
            if found.size != file_bytes(self.n_words):
                raise ValueError(f"{name}.bin has {found.size} bytes, a domain of {self.n_words} words has {file_bytes(self.n_words)}")
        return [Range(name, lo, min(lo + self.range, end)) for name in names for start, end in self.stretches() for lo in range(start, end, self.range)]

    def read(self, partition: Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        files, root = opened(self.path)
        with files.open_input_file(f"{root}/{partition.source}.bin") as f:
            raw = f.read_at(partition.end - partition.start, partition.start)
        if len(raw) != partition.end - partition.start:
            raise ValueError(f"{partition.source}.bin ends at byte {partition.start + len(raw)}")
        bits = np.frombuffer(raw + bytes(-len(raw) % 8), "<i8")
        at = np.arange(len(bits)) if self.dense else np.flatnonzero(bits)
        for lo in range(0, len(at), BATCH):
            part = at[lo : lo + BATCH]
            block = part + partition.start // 8
            columns = [pa.array([partition.source] * len(part), pa.string()), pa.array(block), pa.array(bits[part]), pa.array(block >> (self.shard_bits - 6))]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "block", "bits", "shard"])


class Writer(DataSourceArrowWriter):
    """Files of the full size, all zero, are made first; tasks then write their blocks at their place. A task that runs again
    writes the same bytes. The files get their names when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.n_words = local(options["path"].rstrip("/")), int(options["words"])
        self.sources, self.mark = options["sources"].split(","), uuid.uuid4().hex
        os.makedirs(self.path, exist_ok=True)
        there = [s for s in self.sources if os.path.exists(self.final(s))]
        if there and not overwrite:
            raise FileExistsError(f"{self.path} has bitmaps of {', '.join(there)}")
        for s in self.sources:
            with open(self.partial(s), "wb") as f:
                f.truncate(file_bytes(self.n_words))

    def final(self, source: str) -> str:
        return f"{self.path}/{source}.bin"

    def partial(self, source: str) -> str:
        return f"{self.path}/.{source}.bin.{self.mark}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import numpy as np
        import pyarrow.compute as pc

        files: dict[str, int] = {}
        try:
            for batch in iterator:
                source = batch.column(batch.schema.get_field_index("source"))
                block, bits = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("block", "bits"))
                for name in pc.unique(source).to_pylist():
                    if name not in self.sources:
                        raise ValueError(f"no bitmap is written for source {name}")
                    if name not in files:
                        files[name] = os.open(self.partial(name), os.O_WRONLY)
                    mine = np.flatnonzero(pc.equal(source, name).to_numpy(zero_copy_only=False))
                    mine = mine[np.argsort(block[mine], kind="stable")]
                    for run in np.split(mine, np.flatnonzero(np.diff(block[mine]) != 1) + 1):
                        self.put(files[name], int(block[run[0]]), bits[run])
        finally:
            for f in files.values():
                os.close(f)
        return WriterCommitMessage()

    def put(self, file: int, block: int, bits) -> None:
        """Blocks in a row; what is beyond the domain must be zero."""
        raw, room = bits.astype("<i8").tobytes(), file_bytes(self.n_words) - 8 * block
        within, beyond = raw[: max(room, 0)], raw[max(room, 0) :]
        last = within[-1] if within and len(within) == room and self.n_words % 8 else 0
        if block < 0 or any(beyond) or last >> (self.n_words % 8 or 8):
            raise ValueError(f"a bit at block {block} or after it is no word of the domain")
        if within:
            os.pwrite(file, within, 8 * block)

    def commit(self, messages) -> None:
        for s in self.sources:
            os.replace(self.partial(s), self.final(s))

    def abort(self, messages) -> None:
        for s in self.sources:
            if os.path.exists(self.partial(s)):
                os.remove(self.partial(s))


class BitmapFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write_bitmaps(packed: DataFrame, path: str, sources: list[str], n_words: int, overwrite: bool = True) -> None:
    """One file per source of ``packed`` (``source, block, bits, shard``, a block once), each ``n_words`` bits long.

    The rows are dealt by ranges of a file's bytes, so that a task writes long runs. The folder must be one that all
    executors mount: a file is written at many places at once.
    """
    packed.sparkSession.dataSource.register(BitmapFiles)
    near = packed.select("source", "block", "bits", "shard").where("bits <> 0").repartition("source", F.shiftright("block", (RANGE // 8).bit_length() - 1)).sortWithinPartitions("source", "block")
    near.write.format(FORMAT).option("words", n_words).option("sources", ",".join(sources)).mode("overwrite" if overwrite else "append").save(path)


def read_bitmaps(spark: SparkSession, path: str, n_words: int, shard_bits: int = 24, sources: list[str] | None = None, shards: list[int] | None = None, dense: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """Blocks of the files of a folder, or of some sources or shards, whose bytes alone are read. Empty blocks are left out
    unless ``dense``. A file that is missing or isn't ``n_words`` bits long is an error."""
    spark.dataSource.register(BitmapFiles)
    options = {"words": n_words, "shardBits": shard_bits, "dense": str(dense).lower(), "rangeBytes": range_bytes}
    if sources is not None:
        options["sources"] = ",".join(sources)
    if shards is not None:
        options["shards"] = ",".join(map(str, shards))
    return spark.read.format(FORMAT).options(**options).load(path)
