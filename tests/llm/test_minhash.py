"""MinHash near-duplicates against comparing all pairs of sets."""

import random
import re

import numpy as np
import pytest
import xxhash

from concord.llm import common, minhash

WORD = re.compile("[^\x20\x09-\x0d]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(A_Z))
    return {" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= 80 * (len(a) + len(b) - common):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(s), least.get(find(i)), d == least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def got(df, **options):
    return sorted(repr(tuple(r)) for r in minhash.minhash_duplicates(df, **options).collect())


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "part": 2, "per_copy": 2, "few_ids": 0}])
@pytest.mark.parametrize("name", ["hard", "docs"])
def test_duplicates(request, name, options, spark, small):
    df = request.getfixturevalue(name) if name == "hard" else spark.read.parquet(f"{small}/documents.parquet")
    assert got(df, **options) == plain(pairs(df))


def family(rng, n_words, copies, edits):
    """Texts that differ from one text, which is among them, in some words each."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(copies):
        words = list(base)
        for at in rng.sample(range(n_words), rng.randint(*edits)):
            words[at] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("part", [3, 5, minhash.PART])
def test_families_around_the_limit(spark, part):
    """Copies that link with their original and mostly not with each other, in small, cut and whole keys; the original is
    anywhere among them. Long texts too, whose counters bound less."""
    rng, texts = random.Random(9), []
    for n_words, edits in ((60, (1, 2)), (200, (3, 6)), (400, (8, 14)), (3000, (60, 110)), (50, (1, 3))):
        texts += family(rng, n_words, 14, edits)
    shared = " ".join(f"s{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"t{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))) for _ in range(25)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, part=part) == plain(rows)


def test_counters_too_large_for_a_byte(spark):
    rng = random.Random(3)
    texts = family(rng, 40_000, 2, (900, 1000)) + family(rng, 40_000, 1, (3000, 3100))
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_no_linked_pair_fails_the_bound():
    rng = random.Random(5)
    for n_words, edits in ((30, (1, 3)), (300, (5, 20)), (5000, (100, 300))):
        sets = [minhash.shingles(t.encode(), 4) for t in family(rng, n_words, 8, edits)]
        hashes = [np.array([xxhash.xxh64_intdigest(x) for x in s], np.uint64) for s in sets]
        n = np.array(list(map(len, sets)))
        counts = minhash.counters(np.concatenate(hashes), n)
        may = minhash.may_link(n, counts, counts.min(axis=1) == minhash.FULL, np.arange(len(n))[:, None], np.arange(len(n)), 80)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert may[i, j] or 100 * len(a & b) < 80 * len(a | b)


@pytest.mark.parametrize("every", [False, True])
def test_pairs_between_labels(every):
    """Unless all are asked for, the pairs connect what all connect; numbered hashes never give too small an intersection."""
    rng = random.Random(6)
    sets = [minhash.shingles(t.encode(), 4) for t in family(rng, 80, 25, (2, 6)) + family(rng, 80, 25, (1, 3))]
    n = np.array(list(map(len, sets)))
    for modulus in (1 << 32, 50):
        hashes = [np.array([xxhash.xxh32_intdigest(x) % modulus for x in s], np.uint32) for s in sets]
        own = [frozenset(minhash.numbered(h)) for h in hashes]
        assert all(len(o) == len(s) for o, s in zip(own, sets, strict=True))
        assert all(len(own[i] & own[j]) >= len(sets[i] & sets[j]) for i in range(20) for j in range(20))
    hashes = [np.array([xxhash.xxh32_intdigest(x) for x in s], np.uint32) for s in sets]
    own, counts = [frozenset(minhash.numbered(h)) for h in hashes], minhash.counters(np.concatenate(hashes).astype(np.uint64) << np.uint64(32), n)
    label = np.array([i // 3 for i in range(len(sets))])
    for side in (np.zeros(len(sets), int), np.arange(len(sets)) % 2):
        got = list(minhash.between(n, counts, np.zeros(len(sets), bool), own, label, side, 80, every))
        want = {(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j] and (side.max() == 0 or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
        if every:
            assert set(got) == want
        else:
            assert set(got) <= want and joined(label, got) == joined(label, want)


def joined(label, pairs):
    """Labels that pairs make one, as a partition."""
    root = {int(x): int(x) for x in label}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(int(label[a]))] = find(int(label[b]))
    return {frozenset(x for x in root if find(x) == r) for r in map(find, root)}


def test_agreement_of_values_follows_the_similarity():
    """Of sets of known similarity as many values of a collection agree as the third power of it."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 8000).astype(np.uint64)
    agree = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
        a, b = np.concatenate([common, x[:1000]]), np.concatenate([common, x[1000:]])
        values = minhash.collections(np.concatenate([a, b]), np.array([0, len(a)]))
        agree.append((values[0] == values[1]).mean())
        common = rng.integers(0, 1 << 63, 8000).astype(np.uint64)
    assert abs(np.mean(agree) - 0.8**3) < 0.02


def test_duplicates_empty(empty):
    assert minhash.minhash_duplicates(empty).count() == 0


def test_tables_that_the_result_does_not_read_are_deleted(spark, tmp_path, monkeypatch):
    """Near copies that link and, as every key is cut in parts, members that meet again."""
    random.seed(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(random.choices(words, k=60)) for _ in range(4)]
    rows = [(i, base[i % 4] + " end" * (i // 4 % 5)) for i in range(40)]
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    out = minhash.minhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), part=1)
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "minhash-links" in left
    assert not left & {f"minhash-{x}" for x in ("rows", "nodes", "keyed", "members", "pairs", "texts", "failed", "open", "again", "hashes")}
    assert sorted(repr(tuple(r)) for r in out.collect()) == plain(rows)
