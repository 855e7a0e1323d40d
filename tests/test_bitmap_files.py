"""Raw bitmap files: ranges of bytes, sizes, and the way back."""

import numpy as np
import pytest

from concord.operators import packed
from concord.sources import bitmap_files, keyspace


def as_rows(df):
    return sorted((r.source, r.block, r.bits, r.shard) for r in df.collect())


def bitmap(n_words, words):
    bits = np.zeros(-(-n_words // 8) * 8, bool)
    bits[list(words)] = True
    return np.packbits(bits, bitorder="little").tobytes()


@pytest.mark.parametrize("n_words, range_bytes", [(4096, 1 << 22), (4096, 64), (4096, 8), (1000, 32)])
def test_files_are_read_by_ranges(spark, tmp_path, n_words, range_bytes):
    rng = np.random.default_rng(n_words)
    words = {s: set(rng.choice(n_words, 300, replace=False).tolist()) | {0, n_words - 1} for s in "ab"}
    for s, w in words.items():
        (tmp_path / f"{s}.bin").write_bytes(bitmap(n_words, w))
    df = bitmap_files.read_bitmaps(spark, str(tmp_path), n_words, 8, range_bytes=range_bytes)
    found = {s: set() for s in "ab"}
    for source, block, bits, shard in as_rows(df):
        assert bits and shard == block >> 2
        found[source] |= {block * 64 + i for i in range(64) if bits >> i & 1}
    assert found == words
    assert df.rdd.getNumPartitions() >= 2 * (n_words // 8 // range_bytes or 1)
    some = bitmap_files.read_bitmaps(spark, f"file://{tmp_path}", n_words, 8, ["b"], [1, 3, 99], range_bytes=range_bytes)
    assert as_rows(some) == [r for r in as_rows(df) if r[0] == "b" and r[3] in (1, 3)]
    dense = bitmap_files.read_bitmaps(spark, str(tmp_path), n_words, 8, dense=True, range_bytes=range_bytes)
    assert dense.count() == 2 * -(-n_words // 64)


def test_written_files_are_bitmaps(spark, tmp_path):
    n_words = 1 << 16
    words = keyspace.key_space(spark, 16, 8).selectExpr("word", "word % 3 = 0 as a", "word % 1000 = 7 or word > 65000 as b", "false as c")
    long = packed.to_long(packed.pack(words, ["a", "b", "c"]), ["a", "b", "c"], 8)
    bitmap_files.write_bitmaps(long.repartition(7), str(tmp_path), ["a", "b", "c"], n_words)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.bin", "b.bin", "c.bin"]
    assert (tmp_path / "a.bin").read_bytes() == bitmap(n_words, range(0, n_words, 3))
    assert (tmp_path / "b.bin").read_bytes() == bitmap(n_words, [w for w in range(n_words) if w % 1000 == 7 or w > 65000])
    assert (tmp_path / "c.bin").read_bytes() == bytes(n_words // 8)
    assert as_rows(bitmap_files.read_bitmaps(spark, str(tmp_path), n_words, 8)) == as_rows(long)
    bitmap_files.write_bitmaps(long.where("block = 5"), str(tmp_path), ["a"], n_words)  # replaces the file
    assert as_rows(bitmap_files.read_bitmaps(spark, str(tmp_path), n_words, 8, ["a"])) == [r for r in as_rows(long) if r[:2] == ("a", 5)]
    with pytest.raises(Exception, match="has bitmaps of a"):
        bitmap_files.write_bitmaps(long, str(tmp_path), ["a"], n_words, overwrite=False)


@pytest.mark.parametrize("rows", [[("a", 16, 1, 4)], [("a", 15, 1 << 40, 3)], [("z", 0, 1, 0)], [("a", -1, 1, 0)]])
def test_what_is_no_word_is_an_error(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, bitmap_files.SCHEMA)
    with pytest.raises(Exception, match="no word of the domain|no bitmap is written"):
        bitmap_files.write_bitmaps(df, str(tmp_path), ["a"], 1000)
    assert list(tmp_path.iterdir()) == []


def test_wrong_sizes_and_missing_files_are_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(127))
    with pytest.raises(Exception, match="127 bytes"):
        bitmap_files.read_bitmaps(spark, str(tmp_path), 1024, 8).count()
    with pytest.raises(Exception, match="b.bin"):
        bitmap_files.read_bitmaps(spark, str(tmp_path), 1024, 8, ["b"]).count()
    with pytest.raises(ValueError, match="written in place"):
        bitmap_files.local("s3://bucket/x")
    assert bitmap_files.read_bitmaps(spark, str(tmp_path), 1016, 8).count() == 0
