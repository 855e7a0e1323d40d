"""Every operator against plain Python on hard rows, on an empty table, and on the smallest tables of the driver."""

import base64
import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from concord.llm import bpe, exact_dedup, language, licenses, mixing, quality, sharding, simhash, suffix_dedup, warc
from concord.llm.common import connected_components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# ------------------------------------------------------------------ BPE


def bpe_expected(rows):
    t = Tokenizer.from_file(VOCABULARY)
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in rows]
    return sorted(repr((i, len(x), sha(",".join(map(str, x))), sha(t.decode(x, skip_special_tokens=False)))) for i, x in ids)


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_bpe_round_trip(request, name):
    df = request.getfixturevalue(name)
    got = sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.round_trip(df, VOCABULARY).collect())
    assert got == bpe_expected(pairs(df))


def test_bpe_columns_and_empty(spark, hard, empty):
    assert bpe.round_trip(empty, VOCABULARY).count() == 0
    back = bpe.decode(bpe.encode(hard.select("doc_id", "text"), VOCABULARY).withColumnRenamed("text", "was"), VOCABULARY)
    assert all((r.was or "") == r.text for r in back.collect())


def test_bpe_long_words_and_stretches():
    t, b = Tokenizer.from_file(VOCABULARY), bpe.Bpe(open(VOCABULARY, "rb").read())
    rng = np.random.default_rng(1)
    texts = ["a" * 9001, "ab" * 4000, "".join(rng.choice(list("etaoin"), 9000)), "aaa aaaaa\n\n  b", "<|endoftext|>", " ".join(["word"] * 200_000), "don't  stop \t\n x"]
    for parts, text in zip(b.encode_many(texts), texts, strict=True):
        got = np.frombuffer(b"".join(i for i, _ in parts), np.uint32).tolist()
        assert got == t.encode(text, add_special_tokens=False).ids
        assert b.decode(np.array(got, np.uint32).tobytes()) == text


# ------------------------------------------------------------------ exact dedup


def dedup_expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(A_Z)].append(i)
    out = []
    for i, t in rows:
        g = groups[(t or "").translate(A_Z)]
        keep = max((x for x in g if x is not None), default=None)
        out.append(repr((i, keep, len(g), i == keep, sha((t or "").translate(A_Z)))))
    return sorted(out)


@pytest.mark.parametrize("name", ["hard", "docs"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(request, name, weak):
    """Also with a hash of four bits, so that groups hold many collisions, and with more groups than are broadcast."""
    df = request.getfixturevalue(name)
    options = {"content_hash": lambda h: F.substring(h, 1, 1), "few_groups": 3} if weak else {}
    got = exact_dedup.exact_dedup(df, **options).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == dedup_expected(pairs(df))


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_exact_dedup_of_hot_groups(request, name):
    """Groups of two and more are broadcast, single rows are not."""
    df = request.getfixturevalue(name)
    got = exact_dedup.exact_dedup(df, hot_rows=1).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == dedup_expected(pairs(df))


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# ------------------------------------------------------------------ language


def test_language_on_held_out_rows(docs):
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got} == {True}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_equals_plain_ppm(docs):
    """Code lengths of the tabulated model against PPM with method C written out."""
    chosen = language.sample(docs, "doc_id", "text", "lang", 5)
    model, rows = language.Ppm(language.count_grams(chosen)), chosen.collect()
    text = language.folded(docs.where("doc_id = 3").first().text[:400] + " \x01 漢")
    for i, lang in enumerate(model.langs):
        seen = [defaultdict(Counter) for _ in range(language.ORDER + 1)]
        for r in rows:
            if r.lang == lang:
                data = b" " * language.ORDER + language.folded(r.text)
                for p in range(language.ORDER, len(data)):
                    for o in range(language.ORDER + 1):
                        seen[o][data[p - o : p]][data[p]] += 1
        bits, data = 0.0, b" " * language.ORDER + text
        for p in range(language.ORDER, len(data)):
            for o in range(language.ORDER, -1, -1):
                found = seen[o].get(data[p - o : p])
                if found is None:
                    continue
                n, d = sum(found.values()), len(found)
                if data[p] in found:
                    bits += np.log2((n + d) / found[data[p]])
                    break
                bits += np.log2((n + d) / d)
            else:
                bits += 8
        assert model.lengths(text)[i] == pytest.approx(bits, rel=1e-4)


def test_language_hard_rows(hard, empty):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(hard).collect()}
    assert {i for i, lang in got if lang == "und"} == {3, 4, 8, 12}
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_prediction_ignores_label_source_and_id(docs):
    model = language.fit(docs)
    one = {r.doc_id: r.lang_pred for r in language.predictions(docs, model).collect()}
    shuffled = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("q")).withColumn("doc_id", F.col("doc_id") + 1000)
    assert {i - 1000: x for i, x in ((r.doc_id, r.lang_pred) for r in language.predictions(shuffled, model).collect())} == one


# ------------------------------------------------------------------ mixing


def check_mix(df):
    got = mixing.mixed_counts(df).collect()
    names = sorted({r.source for r in df.select("source").collect()}, key=lambda s: (s is None, (s or "").encode()))
    sizes = Counter()
    for r in df.select("source", "text").collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, left, target = set(names), 1.5 * sum(sizes.values()), {}
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if unit * weights[s] > 2 * sizes[s]}
        if not over:
            target |= {s: unit * weights[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    want = Counter(round(t, 6) for s, t in target.items() for r in df.where(F.col("source").eqNullSafe(F.lit(s))).select("doc_id").collect())
    assert Counter(round(r.target, 6) for r in got) == want
    assert sorted(map(repr, ((r.doc_id, r["size"]) for r in got))) == sorted(map(repr, ((i, len(WORD.findall(t or ""))) for i, t in pairs(df))))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    taken, wanted = sum(r.taken for r in got), sum(target.values())
    assert abs(taken - wanted) <= 2 * mixing.BLOCK * len(names)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed_counts(df.repartition(5)).collect()))


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_mix(request, name):
    check_mix(request.getfixturevalue(name))


def test_mix_empty(empty):
    assert mixing.mixed_counts(empty).count() == 0


def test_permutations_are_permutations():
    for n in (1, 2, 3, 64, 1000, 4097):
        at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(at.tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 2))).mean() > 0.9


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_every_source_gives_its_target(request, name):
    df = request.getfixturevalue(name)
    small = [(-i, " ".join(f"w{k}" for k in range(n)), f"small {n}") for i, n in enumerate([1, 33, 63, 64, 65, 100, 127, 200, 333, 1000], 1)]
    df = df.select("doc_id", "text", "source").unionByName(df.sparkSession.createDataFrame(small, "doc_id long, text string, source string"))
    placed, pieces, p = mixing.mix(df)
    taken = {r.s: r.n for r in placed.join(pieces, "row").groupBy("s").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n")).collect()}
    assert {s: n for s, n in enumerate(map(round, p.targets)) if n} == taken
    for t in (0.3, 0.71, 1.23, 1.9):
        placed, pieces, p = mixing.mix(df, share=t, seed=int(100 * t))
        got = placed.join(pieces, "row").groupBy("s").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n")).collect()
        assert {s: n for s, n in enumerate(map(round, p.targets)) if n} == {r.s: r.n for r in got}


def test_index_of_is_the_way_back():
    for n in (1, 2, 3, 64, 1000, 4097):
        at = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 7_000_021 + 65))
        assert all(mixing.index_of(int(at[i]), n, 7_000_021 + 65) == i for i in range(0, n, max(1, n // 50)))


def test_plan_of_a_large_corpus():
    """Over 10**9 slots, where numpy's own draw ends."""
    sizes = {"a": 10**12, "b": 3 * 10**12, None: 40, "c": 64 * 10**10}
    p = mixing.plan(sizes, 1.5, 2.0, 16, 7, (3, 1, 2), 64)
    drawn = np.diff(p.until, axis=0, prepend=0)
    total = sum(p.slots)
    assert p.until[-1].tolist() == p.slots and (drawn >= 0).all()
    assert drawn.sum(axis=1).tolist() == [total * (j + 1) // 16 - total * j // 16 for j in range(16)]
    assert np.allclose(drawn[:, :3], np.array(p.slots[:3]) / 16, rtol=1e-3)


@pytest.mark.parametrize("good, bad, sample", [(40, 60, 30), (70, 30, 80), (5, 300, 150), (300, 5, 20), (1000, 3000, 500), (3 * 10**10, 10**11, 2 * 10**10), (3, 10**12, 5 * 10**11)])
def test_hypergeometric_counts(good, bad, sample):
    rng = np.random.default_rng(1)
    got = np.array([mixing.hypergeometric(rng, good, bad, sample) for _ in range(3000)], float)
    n, p = good + bad, good / (good + bad)
    mean, var = sample * p, sample * p * (1 - p) * (n - sample) / (n - 1)
    assert got.min() >= max(0, sample - bad) and got.max() <= min(good, sample)
    assert abs(got.mean() - mean) < 4 * (var / 3000) ** 0.5
    assert got.var() == pytest.approx(var, rel=0.12)


def plain_permuted(index, n, key):
    """Four Feistel rounds, walked until the value is below n, with Python's whole numbers."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, full = (1 << half) - 1, (1 << 64) - 1

    def scramble(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    while True:
        left, right = index >> half, index & mask
        for r in range(4):
            left, right = right, left ^ scramble(right + key * 0x9E3779B97F4A7C15 + r & full) & mask
        index = left << half | right
        if index < n:
            return index


def plain_mix(documents, sizes, targets, shards, seed, block):
    """Pieces ``(row, epoch, shard, slot, word_from, word_to)`` from the documents' stretches in the line of their source."""
    n_blocks = [-(-n // block) for n in sizes]
    words = {}  # of source s and slot k: (block, epoch, first word, end)
    for s, (size, target) in enumerate(zip(sizes, targets, strict=True)):
        left, k = round(target), 0
        while left:
            epoch, index = divmod(k, n_blocks[s])
            b = plain_permuted(index, n_blocks[s], seed * 1_000_003 + s * 64 + epoch)
            n = min(left, min(size, (b + 1) * block) - b * block)
            words[s, k] = (b, epoch, b * block, b * block + n)
            left, k = left - n, k + 1
    slots = [sum(x == s for x, _ in words) for s in range(len(sizes))]
    rng, left, given, out, counts = np.random.default_rng(seed), np.array(slots), [0] * len(sizes), [], []
    for j in range(shards):
        n = sum(slots) * (j + 1) // shards - sum(slots) * j // shards
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals")
        left = left - drawn
        place = 0
        for s, m in enumerate(drawn.tolist()):
            for k in range(given[s], given[s] + m):
                slot = plain_permuted(place, n, seed * 1_000_003 + len(sizes) * 64 + j)
                place += 1
                _, epoch, lo, hi = words[s, k]
                for row, source, start, size in documents:
                    if source == s and start < hi and start + size > lo:
                        out.append((row, epoch, j, slot, max(start, lo) - start, min(start + size, hi) - start))
            given[s] += m
        counts.append(drawn.tolist())
    return out, counts


@pytest.mark.parametrize("name", ["hard", "docs"])
@pytest.mark.parametrize("seed", [7, 8])
def test_mix_equals_plain_draw(request, name, seed):
    """Which words of which document stand where: the draw of shards, the permutations and the blocks, written out."""
    df = request.getfixturevalue(name).select("doc_id", "text", "source")
    placed, pieces, p = mixing.mix(df, seed=seed)
    documents = [(r.row, r.s, r.start, r["size"]) for r in placed.collect() if r["size"]]
    for s, size in enumerate(p.sizes):  # the documents of a source lie end to end
        mine = sorted((start, n) for _, x, start, n in documents if x == s)
        assert [start for start, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))] and sum(n for _, n in mine) == size
    want, counts = plain_mix(documents, p.sizes, p.targets, 16, seed, mixing.BLOCK)
    assert sorted((r.row, r.epoch, r.shard, r.slot, r.word_from, r.word_to) for r in pieces.collect()) == sorted(want)
    assert np.diff(p.until, axis=0, prepend=0).tolist() == counts
    by_doc, by_shard = defaultdict(int), defaultdict(Counter)
    for row, _, j, _, lo, hi in want:
        by_doc[row] += hi - lo
        by_shard[row][j] += hi - lo
    of = {r.row: r.doc_id for r in placed.collect()}
    expected = sorted(repr((i, by_doc[row], " ".join(f"{j}:{n}" for j, n in sorted(by_shard[row].items())))) for row, i in of.items())
    assert sorted(repr((r.doc_id, r.taken, r.shards)) for r in mixing.mixed_counts(df, seed=seed).collect()) == expected


def test_counts_of_shards_are_drawn():
    """Not dealt out in proportion: the counts of a source vary over shards and seeds as the draw's do."""
    sizes, got = {"a": 64_000, "b": 64_000, "c": 128_000}, []
    for seed in range(40):
        p = mixing.plan(sizes, 1.0, 2.0, 16, seed, (1, 1, 1), 64)
        got += np.diff(p.until, axis=0, prepend=0)[:, 0].tolist()
    n, total = p.slots[0], sum(p.slots)
    share, m = n / total, total / 16
    assert np.mean(got) == pytest.approx(n / 16)
    assert np.var(got) == pytest.approx(m * share * (1 - share) * (total - m) / (total - 1), rel=0.25)


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_mix_is_written_by_shard(spark, request, name, tmp_path):
    df = request.getfixturevalue(name).select("doc_id", "text", "source")
    mixing.write_mix(df, f"{tmp_path}/mix")
    got = spark.read.parquet(f"{tmp_path}/mix").withColumn("file", F.input_file_name()).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect()
    placed, pieces, p = mixing.mix(df)
    ids = {r.row: r.doc_id for r in placed.collect()}
    assert Counter((r.mix_shard, r.slot, r.doc_id, len(WORD.findall(r.text))) for r in got) == Counter((r.shard, r.slot, ids[r.row], r.word_to - r.word_from) for r in pieces.collect())
    whole = defaultdict(list)
    for i, t in pairs(df):
        whole[i].append(t or "")
    order, slots = defaultdict(list), defaultdict(set)
    for r in got:
        assert any(r.text in t for t in whole[r.doc_id])
        order[r.file].append((r.slot, r.at))
        slots[r.mix_shard].add(r.slot)
    assert all(x == sorted(x) for x in order.values())
    drawn = np.diff(p.until, axis=0, prepend=0).sum(axis=1).tolist()
    assert {j: len(x) for j, x in slots.items()} == {j: n for j, n in enumerate(drawn) if n} and all(x == set(range(len(x))) for x in slots.values())


def test_mixed_texts_hold_the_counted_words(docs):
    counts = {r.doc_id: r.taken for r in mixing.mixed_counts(docs).collect()}
    texts = mixing.mixed_texts(docs).collect()
    found, whole = Counter(), {r.doc_id: r.text for r in docs.collect()}
    for r in texts:
        found[r.doc_id] += len(WORD.findall(r.text))
        assert all(part in whole[r.doc_id] for part in r.text.split("\n") if part)
    assert {i: n for i, n in counts.items() if n} == dict(found)


# ------------------------------------------------------------------ suffix dedup


def spans_expected(rows):
    """A row for each of ``rows``; different ones are documents in the order of id, null first, and of the text's digest."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen, out = set(), {}
    for i, t in sorted(set(data), key=lambda r: (r[0] is not None, r[0] or 0, sha(r[1]))):
        mark, new = np.zeros(len(t), bool), set()
        for p in range(len(t) - 99):
            s = t[p : p + 100]
            if s in seen or s in new:
                mark[p : p + 100] = True
            new.add(s)
        seen |= new
        edge = np.diff(np.concatenate([[0], mark.astype(int)])) == 1
        out[i, t] = (i, len(t), int(mark.sum()), int(edge.sum()), sha(np.frombuffer(t, np.uint8)[~mark].tobytes()))
    return sorted(repr(out[x]) for x in data)


def spans_got(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.repeated_bytes(df).collect())


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_repeated_bytes_of_hard_rows(hard, monkeypatch, most):
    """Also with more ids than are broadcast."""
    monkeypatch.setattr(suffix_dedup, "FEW_IDS", most)
    assert spans_got(hard) == spans_expected(pairs(hard))


@pytest.mark.parametrize("ids", [(1, 2, 2), (2, 1, 1), (1, 2, 1), (None, None, None), (None, 1, None), (-(1 << 63), None, 7)])
def test_repeated_bytes_of_rows_that_share_an_id(spark, ids):
    a, b = " ".join(f"a{i}" for i in range(100)), " ".join(f"b{i * 7}" for i in range(100))
    rows = [*zip(ids, (a, a, b), strict=True), (9, b + "!"), (9, a[50:] + b[:200]), (9, b + "!")]
    assert spans_got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == spans_expected(rows)


def test_repeated_bytes_of_documents(docs):
    assert spans_got(docs) == spans_expected(pairs(docs))


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes_of_random_joins(spark, seed):
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcd "), 500)) for _ in range(5)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.integers(0, 6)):
            at = int(rng.integers(0, 400))
            text += base[rng.integers(0, 5)][at : at + int(rng.choice([50, 99, 100, 101, 131, 190]))] + rng.choice(["", "é", "yz" * int(rng.integers(0, 80)), "q" * int(rng.integers(0, 300))])
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert spans_got(df) == spans_expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes_of_frequent_passages(spark, seed):
    """Many more than HOT places of a tuple, in stretches of six rows, with shared 64 bytes inside unequal 100."""
    rng = np.random.default_rng(100 + seed)
    base = ["".join(rng.choice(list("abcd "), n)) for n in (66, 90, 100, 130, 400)]
    rows = []
    for i in rng.permutation(150).tolist():
        filler = ["".join(rng.choice(list("wxyz"), int(rng.integers(0, 60)))) for _ in range(4)]
        rows.append((i, "".join(f + base[rng.integers(0, 5)] for f in filler)))
    rows += [(200 + i, base[4] + "tail") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 6)
    try:
        assert spans_got(df) == spans_expected(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_repeated_bytes_empty(empty):
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_cover_and_small_pieces():
    assert len({int(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER}) == suffix_dedup.PERIOD
    for n in (*range(60, 200), 1000):
        assert suffix_dedup.n_sampled(np.array([n]))[0] == sum(p % 31 in suffix_dedup.COVER.tolist() for p in range(n - suffix_dedup.WIDTH + 1))
    arrays = [np.arange(5), np.array([1, 2], np.uint8), np.zeros(0, np.uint32)]
    for level in (0, 1):
        assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, suffix_dedup.unpack(suffix_dedup.pack(*arrays, level=level), packed=bool(level)), strict=True))


# ------------------------------------------------------------------ quality


def quality_expected(rows, min_docs, share):
    hosts, holds = Counter(h for _, _, h in rows), Counter()
    norm = lambda line: " ".join(WORD.findall(line.translate(A_Z)))
    for _, t, h in rows:
        holds.update((h, x) for x in {norm(x) for x in (t or "").split("\n")} if x)
    out = []
    for i, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        win = Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {k + d for k in range(len(w) - 2) if win[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = {x for x in map(norm, lines) if holds[h, x] > max(min_docs, share * hosts[h])}
        left = len(w) - sum(len(WORD.findall(x)) for x in lines if norm(x) in gone)
        failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
        out.append(repr((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep), failed, not failed and left >= 0.5 * len(w), len(gone), left)))
    return sorted(out)


@pytest.mark.parametrize("name", ["hard", "docs"])
@pytest.mark.parametrize("min_docs", [1, 30])
def test_quality_rules(request, name, min_docs):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
    want = quality_expected(rows, min_docs, 0.005)
    assert sorted(repr(tuple(r)) for r in quality.quality_rules(df, min_docs=min_docs).collect()) == want
    assert sorted(repr(tuple(r)) for r in quality.quality_rules(df, min_docs=min_docs, few_lines=0).collect()) == want


def test_quality_rejects_depleted_documents(spark):
    boiler = "\n".join("this is boilerplate line number %d of every page" % i for i in range(8))
    own = lambda i: " ".join(f"{i}w{k}" for k in range(60))
    rows = [(i, boiler, "h") for i in range(40)] + [(i, f"{own(i)}\n{boiler.splitlines()[0]}", "h") for i in range(40, 80)]
    kept = {r.doc_id for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.kept}
    assert kept == set(range(40, 80))


def test_quality_empty(empty):
    assert quality.quality_rules(empty).count() == 0


# ------------------------------------------------------------------ sharding


def check_shards(df):
    got = sharding.reshard_documents(df).collect()
    want = sorted(repr((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))) for i, t in pairs(df))
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return got


def test_shards_of_hard_rows(hard):
    check_shards(hard)


def test_shards_of_documents(docs):
    load = Counter()
    for r in check_shards(docs):
        load[r.shard] += r["size"]
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean


def test_shards_empty(empty):
    assert sharding.reshard_documents(empty).count() == 0


@pytest.mark.parametrize("one_source", [True, False])
def test_equal_texts_stay_together(spark, one_source):
    """Copies lie in several old shards; besides small groups there are large ones and one that no shard can take."""
    large = [("large " * 100 + str(k), 5 + 8 * k) for k in range(8)]  # from a fiftieth to a fifth of a shard
    rows = [(i, f"text {i // 3} " + "x" * 50, f"s{i % 5}") for i in range(30_000)] + [(i, "everywhere " * 5, f"s{i % 7}") for i in range(30_000, 60_000)]
    rows += [(60_000 + i, t, f"s{i % 6}") for i, t in enumerate(t for t, n in large for _ in range(n))]
    rows += [(90_000 + i, "y" * (30_000 + i), f"s{i}") for i in range(3)]  # single documents
    df = spark.createDataFrame([(i, t, "one" if one_source else s) for i, t, s in rows], "doc_id long, text string, source string")
    at, load, text = defaultdict(set), Counter(), {i: t for i, t, _ in rows}
    got = sharding.reshard_documents(df).collect()
    for r in got:
        at[text[r.doc_id]].add(r.shard)
        load[r.shard] += r["size"]
    size = Counter()
    for i, t, _ in rows:
        size[t] += len(t) + 8
    shard = sum(load.values()) / 24
    assert {t for t, x in at.items() if len(x) > 1} == {t for t, n in size.items() if n > shard * sharding.WHOLE_GROUP} == {"everywhere " * 5}
    assert len(load) == 24 and max(load.values()) < 1.05 * min(load.values())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_only_affected_files_are_rewritten(spark, tmp_path):
    """Bytes moved are the flow's but for texts at the cuts; files that stay hold their rows alone, the others none that are read."""
    rows = [(i, f"text number {i} " + "x" * (i % 50), i % 4 if i % 3 else 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, old int")
    flow = sharding.reshard(df, F.col("old"), 4, 6, str(tmp_path))
    files = sharding.old_files(spark, str(tmp_path)).collect()
    transfers = [x for (o, s), x in flow.items() if o != s]
    assert abs(sum(r.moved_bytes for r in files) - sum(transfers)) < 100 * len(flow) and sum(r.rows for r in files) == 20_000
    got = sharding.read_shards(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.was for r in got} == {i: o for i, _, o in rows} and len(got) == 20_000
    assert all(r.shard == r.was for r in got if not r.rewritten)
    assert sum(r["size"] for r in got if not r.rewritten) == sum(r.bytes for r in files if r.kept) > 0
    assert sum(r["size"] for r in got if r.shard != r.was) == sum(r.moved_bytes for r in files)
    # at most one file per transfer holds rows that stay beside rows that go
    assert sum(0 < r.moved_bytes < r.bytes for r in files) <= len(flow)
    assert spark.read.parquet(f"{tmp_path}/new").count() == sum(r.rows for r in files if not r.kept)


def test_nothing_moves_between_equal_layouts(spark, tmp_path):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('text number ', lpad(id, 6, '0')) as text")
    flow = sharding.reshard(df, (F.col("doc_id") % 4).cast("int"), 4, 4, str(tmp_path))
    assert set(flow) == {(k, k) for k in range(4)} and all(r.kept and r.moved_bytes == 0 for r in sharding.old_files(spark, str(tmp_path)).collect())
    got = sharding.read_shards(spark, str(tmp_path)).collect()
    assert len(got) == 4000 and all(r.shard == r.doc_id % 4 and not r.rewritten for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(k, i) for k in range(4) for i in range(1000)]


def test_no_group_of_the_documents_is_split(docs):
    at, load = defaultdict(set), Counter()
    for r in sharding.reshard_documents(docs).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").collect():
        at[r.text].add(r.shard)
        load[r.text] += r["size"]
    limit = sum(load.values()) / 24 * sharding.WHOLE_GROUP
    assert all(len(x) == 1 for t, x in at.items() if load[t] <= limit)


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(0, 1000, rng.integers(1, 8)).tolist()
        caps = sharding.capacities(sum(sizes), int(rng.integers(1, 9)))
        flow = sharding.min_cost_flow(sizes, caps)
        assert [sum(x for (o, _), x in flow.items() if o == i) for i in range(len(sizes))] == sizes
        assert [sum(x for (_, s), x in flow.items() if s == j) for j in range(len(caps))] == caps
        stay = sum(min(a, b) for a, b in zip(sizes, caps, strict=False))
        assert sum(x for (o, s), x in flow.items() if o != s) == sum(sizes) - stay


def test_groups_that_fit_a_shard_stay_whole():
    caps = [100] * 4
    assert sharding.kept_whole([90, 30, 100, 60, 30], caps, 25) == [True, True, True, True, True]
    assert sharding.kept_whole([90, 90, 90, 90, 40], caps, 25) == [True, True, True, True, False]
    assert sharding.kept_whole([120, 20, 60], caps, 25) == [False, True, True]


def test_a_group_of_half_a_shard_stays_whole(spark):
    rows = [(i, f"unlike text number {i} " + "x" * 60, f"s{i % 7}") for i in range(4000)] + [(10_000 + i, "copy " * 30, f"s{i % 5}") for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.reshard_documents(df).collect()
    assert len({r.shard for r in got if r.doc_id >= 10_000}) == 1
    load = np.bincount([r.shard for r in got], [r.size for r in got], minlength=24)
    copies = 45 * (150 + 8)
    assert copies > load.mean() / 4 and load.max() < 1.1 * load.mean()


def test_levelled_loads():
    assert sharding.levelled(10, [0, 5, 100]) == [8, 2, 0] or sum(sharding.levelled(10, [0, 5, 100])) == 10
    assert sum(sharding.levelled(7, [3, 3, 3, 0])) == 7 and sharding.levelled(0, [1, 2]) == [0, 0]


# ------------------------------------------------------------------ licenses


def fewest_differences(words, template):
    """Missing and extra words against the closest stretch of the whole text, without windows: the table written out."""
    row = [0] * (len(words) + 1)
    for t in template:
        last, row = row, [row[0] + 1]
        for j, w in enumerate(words):
            row.append(min(last[j + 1] + 1, row[j] + 1, last[j] if w == t else 1 << 30))
    return min(row)


def whole_text_scan(text):
    """Every wording against the whole text by the table written out: no cues, no blocks, no compression."""
    words, want = re.findall(r"[0-9a-z]+(?:[.'/][0-9a-z]+)*", text.lower()), {}
    for name, wording in licenses.TEMPLATES:
        template = re.findall(r"[0-9a-z]+(?:[.'/][0-9a-z]+)*", wording.lower())
        if len(set(template) - set(words)) <= 0.05 * len(template):
            n = fewest_differences(words, template)
            if n <= 0.05 * len(template):
                want[name] = min(n, want.get(name, n))
    return sorted(want.items())


def test_every_copy_within_tolerance_has_a_cue():
    """Each differing word can take one cue from a wording at most, and no wording has as few cues as words that may differ."""
    for k, (name, text) in enumerate(licenses.TEMPLATES):
        cues = len(licenses.CUE_WORDS.findall(text.lower()))
        assert cues == len(licenses.CUE.findall(text.encode())) > int(licenses.TOLERANCE * len(licenses.compressors()[k][1])), name


@pytest.mark.parametrize("name", ["hard", "docs"])
def test_license_scan(request, name):
    df = request.getfixturevalue(name)
    short = [(i, t) for i, t in pairs(df) if len(t or "") < 3000]
    got = {i: [(m.license, m.differences) for m in r.matches] for r in licenses.license_scan(df).collect() if (i := r.doc_id) is not None}
    assert all(got[i] == whole_text_scan(t or "") for i, t in short if i is not None) and len(got) == len({i for i, _ in pairs(df)} - {None})
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in licenses.license_scan(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        assert [m.license for m in r.matches] == sorted(v for k, v in lines.items() if k in (r.text or ""))


def test_every_template_is_found_among_other_words():
    for name, text in licenses.TEMPLATES:
        noise = "lorem ipsum dolor sit amet " * 400
        assert [m["license"] for m in licenses.scan(f"{noise}\n{text}\n{noise}".encode())[1]] == [name]
        assert name in [m["license"] for m in licenses.scan(f"{noise}{text} {noise}".encode())[1]]


PROSE = "It was a bright cold day in April, and the clocks were striking thirteen; this software of ours is provided to you and to the others, subject to all conditions that the authors, or the holders of any copyright, have in mind for it. "


@pytest.mark.parametrize("start", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("width", [60, 72, 79])
def test_every_template_is_found_wrapped(start, width):
    for name, text in licenses.TEMPLATES:
        lines = [start + x for x in textwrap.wrap(text, width - len(start))]
        for gap in ("\n", "\n\n", f"\n{start.rstrip()}\n"):
            page = "lorem ipsum dolor sit amet\n" * 30 + "\n" + gap.join(lines) + "\n\n" + "lorem ipsum dolor sit amet\n" * 30
            assert (name, 0) in [(m["license"], m["differences"]) for m in licenses.scan(page.encode())[1]]


@pytest.mark.parametrize("width", [60, 72, 79])
def test_every_template_is_found_amid_prose(width):
    for name, text in licenses.TEMPLATES:
        page = "\n".join(textwrap.wrap(f"{PROSE * 5} {text} {PROSE * 5}", width))
        assert (name, 0) in [(m["license"], m["differences"]) for m in licenses.scan(page.encode())[1]]


def test_license_scan_equals_one_without_blocks():
    """Changed, wrapped wordings in long texts: a wording is found where the whole text has it within tolerance."""
    rng = np.random.default_rng(4)
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        words = licenses.words_of(text)
        noise = [str(x) for x in rng.choice(["the", "of", "license", "copyright", "lorem", "ipsum", "software", "permission"], 500)]
        changed = list(words)
        for _ in range(int(rng.integers(0, 7))):
            i = int(rng.integers(0, len(changed)))
            changed[i : i + 1] = [[], ["other"], [changed[i], "more"]][rng.integers(0, 3)]
        page = "\n".join(textwrap.wrap(" ".join(noise[:250] + changed + noise[250:]), 72))
        found = {}  # of one name the closest wording
        for name, template in licenses.TEMPLATES:
            t = licenses.words_of(template)
            n = fewest_differences(licenses.words_of(page), t)
            if n <= 0.05 * len(t):
                found[name] = min((n, -len(t)), found.get(name, (n, -len(t))))
        # of one family at one place the closest stays
        kin = lambda x: x.lstrip("AL").split("-")[0] if x.endswith("later") or "GPL" in x else x.split("-")[0]
        want = {x: n[0] for x, n in found.items() if not any(y != x and kin(y) == kin(x) and m < n for y, m in found.items())}
        assert {m["license"]: m["differences"] for m in licenses.scan(page.encode())[1]} == want, k


def test_reductions_rank_the_licenses(spark, monkeypatch):
    """The order of the result is that of the size reductions; without the compressor it is another."""
    names = [compressor[0] for compressor in licenses.compressors()]
    wordings = {n: " ".join(c[1]) for n, c in zip(names, licenses.compressors(), strict=True)}
    short = sorted(wordings, key=lambda n: len(wordings[n]))
    text = (wordings[short[0]] + " and here something else entirely " * 3 + wordings[short[-1]]).encode()
    _, found = licenses.scan(text)
    order = [m["license"] for m in sorted(found, key=lambda m: (-m["gain"], m["license"]))]
    assert {short[0], short[-1]} <= set(order)
    row = licenses.license_summary(spark.createDataFrame([(1, text.decode())], "doc_id long, text string")).first()
    assert row.licenses.split(",") == order and row.gains.split(",") == sorted(row.gains.split(","), key=int, reverse=True)
    monkeypatch.setattr(licenses, "ranked", lambda block, candidates: [(k, 0.0) for k in candidates])
    _, without = licenses.scan(text)
    assert sorted(m["license"] for m in without) == sorted(order) and {m["gain"] for m in without} == {0.0}


def test_licenses_side_by_side():
    by = dict(reversed(licenses.TEMPLATES))
    for pair in (["BSD-2-Clause", "BSD-3-Clause"], ["CC-BY-4.0", "CC-BY-SA-4.0"], ["GPL-2.0-or-later", "GPL-3.0-or-later"]):
        page = "\n".join(textwrap.wrap(by[pair[0]], 72) + [""] + textwrap.wrap(by[pair[1]], 72))
        for text in (page, (page + "\n") * 6):
            assert [m["license"] for m in licenses.scan(text.encode())[1]] == pair


def test_license_scan_leaves_talk_about_licenses_alone(empty):
    for text in ("I lost my driving license yesterday.", "The permission to use this copyright was denied.", "Licensed under nothing at all, version 9."):
        assert licenses.scan(text.encode())[1] == []
    assert licenses.license_scan(empty).count() == 0


# ------------------------------------------------------------------ WARC


def warc_expected(rows):
    first = {}
    for i, h in rows:
        first[h or ""] = min((x for x in (i, first.get(h or "", i)) if x is not None), default=None)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        f = first[h or ""]
        out.append(repr((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)))
    return sorted(out)


def test_warc_round_trip(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    more = pages.withColumn("page_id", F.col("page_id") + 10_000).where("page_id % 3 = 0")
    odd = spark.createDataFrame([(900_000, None, None), (900_001, "http://x/\r\ny: z", ""), (900_002, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n"), (None, "u", "null id"), (None, "ü", "é" * 20_000)], "page_id long, url string, html string")
    df = pages.unionByName(more).unionByName(odd).withColumn("strong", F.lit(1)).withColumn("payload", F.lit(2))
    got = sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.round_trip(df).collect())
    assert got == warc_expected([(r.page_id, r.html) for r in df.collect()])
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_of_hot_payloads(spark, tmp_path):
    """Payloads of many pages, with null and repeated ids and URLs, by broadcast digests and several copies each."""
    rows = [(i if i % 7 else None, f"http://x/{i % 40}", f"text {i % 3 * (i % 5)}") for i in range(200)] + [(5, "http://x/5", "text 0")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(df, str(tmp_path), hot_rows=10, records_per_copy=4)
    assert spark.read.parquet(f"{tmp_path}/store").agg(F.max("copies_to_read")).first()[0] > 10
    got = sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.parse_records(warc.read_archive(spark, str(tmp_path))).collect())
    assert got == warc_expected([(i, h) for i, _, h in rows])


def test_warc_headers_of_any_length(spark):
    long_ = ["http://x/?q=" + "a" * n for n in (16_000, 16_384, 100_000)] + ["data:text/html," + "é漢" * 20_000]
    tail = "Content-Length: 5 WARC-Payload-Digest: sha1:X"
    long_ += [f"http://x/{end}{tail}" for end in ("Å", "\u0085", "\u2028", "\r\n", "\r\n\r\n", "\x0b", "\x0c", "\x85\r")]
    rows = [(i, u, f"text {i // 2}") for i, u in enumerate(u for u in long_ for _ in range(2))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in warc.round_trip(df).collect())
    assert got == warc_expected([(i, h) for i, _, h in rows])


def test_warc_records_are_well_formed(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b", "same"), (3, "http://c", "other")], "page_id long, url string, html string")
    warc.write_archive(df, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/store").count() == 2
    for r in warc.read_archive(spark, str(tmp_path)).collect():
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and body[size:] == b"\r\n\r\n"
        assert (b"revisit" in head) == (b"page:2>" in head.split(b"WARC-Date")[0])


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(A_Z))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(ids, fps, most=4):
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= most):
            parent[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("hot_rows", [1, 100_000])
@pytest.mark.parametrize("name", ["hard", "docs"])
def test_near_duplicates(request, name, hot_rows):
    df = request.getfixturevalue(name)
    rows = pairs(df)
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(repr((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, components([i for i, _ in rows], fps), strict=True))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(df, hot_rows=hot_rows).collect()) == want


@pytest.mark.parametrize("part", [7, 1 << 15])
def test_links_connect_what_all_pairs_connect(spark, part):
    """Dense clusters and strays, also with keys cut in parts of seven rows."""
    rng = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, node long"), 4, part)
    got = dict(connected_components(edges).collect())
    assert [got.get(i, i) for i in range(len(fps))] == components(range(len(fps)), fps)


def test_near_duplicates_link_through_rows_without_id(spark, monkeypatch):
    prints = spark.createDataFrame([(1, 0x00), (None, 0x0F), (3, 0xFF), (None, 1 << 40), (None, 0xFF << 48)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(None).collect()}
    assert got == {f"{0:016x}": 1, f"{0x0F:016x}": 1, f"{0xFF:016x}": 1, f"{1 << 40:016x}": 1, f"{0xFF << 48:016x}": None}


def test_near_duplicates_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_chains_and_hubs(spark):
    rng = np.random.default_rng(3)
    order = rng.permutation(300).tolist()
    chain = list(zip(order, order[1:], strict=False))
    hub = [(1000, 1000 + i) for i in range(1, 200)]
    got = dict(connected_components(spark.createDataFrame([*chain, *hub, (5000, 5000)], "a long, b long")).collect())
    assert {got[i] for i in range(300)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[5000] == 5000
