"""Cross-tokenizer alignment against plain loops over tokens."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from concord.llm import alignment
from concord.llm.bpe import byte_alphabet

SPEC, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a", " ", "  two  spaces ", "\ttab\nline ", "x" * 3000, "<|endoftext|> <s> </s> <0x41>", "low ▁ line", "日本 語😀 é ﬁ", "nul \x00 and \x1c and \x85 here", "don't 12345 stop!!", "no break 　 wide"]


@pytest.fixture(scope="module")
def models():
    t = Tokenizer.from_file(SPEC)
    t.encode_special_tokens = True
    chars = {c: bytes([b]) for c, b in byte_alphabet().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return t, lambda i: b"".join(chars[c] for c in t.id_to_token(i)), b, alignment.piece_bytes(b)


def plain(models, text):
    """Ids of A and B, their groups as index lists, overlaps as index pairs with bytes; empty where the bytes differ."""
    t, bytes_a, sp, bytes_b = models
    if not text:
        return [], [], [], {}
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    raw_a, raw_b = [bytes_a(i) for i in a], [bytes_b[i] for i in b]
    if b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
        return [], [], [], {}
    end_a, end_b = list(accumulate(map(len, raw_a))), list(accumulate(map(len, raw_b)))
    groups, i, j = [], 0, 0
    for end in sorted(set(end_a) & set(end_b)):
        hi, hj = end_a.index(end, i) + 1, end_b.index(end, j) + 1
        groups.append((list(range(i, hi)), list(range(j, hj))))
        i, j = hi, hj
    shared = {}
    for ga, gb in groups:
        for x in ga:
            for y in gb:
                n = min(end_a[x], end_b[y]) - max(end_a[x] - len(raw_a[x]), end_b[y] - len(raw_b[y]))
                if n > 0:
                    shared[x, y] = n
    return a, b, groups, shared


def expected(models, rows):
    each = [(i, plain(models, t)) for i, t in rows]
    pairs = [Counter((a[x], b[y]) for x, y in shared) for _, (a, b, _, shared) in each]
    count = Counter(p for c in pairs for p in c)
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    out = []
    for (i, (a, b, groups, shared)), c in zip(each, pairs, strict=True):
        shown = ";".join(",".join(str(a[x]) for x in ga) + "|" + ",".join(str(b[y]) for y in gb) for ga, gb in groups)
        best = sum(k for p, k in c.items() if count[p] == highest[p[0]])
        digest = hashlib.sha256(shown.encode()).hexdigest() if a else ""
        out.append(repr((i, len(a), len(b), len(groups), len(shared), sum(len(x) * len(y) for x, y in groups), best, sum(count[p] * k for p, k in c.items()), digest)))
    return sorted(out)


def got(df, **options):
    return sorted(repr(tuple(r)) for r in alignment.alignment_summary(df, SPEC, MODEL, **options).collect())


@pytest.mark.parametrize("few_pairs", [1, 50, alignment.FEW_PAIRS])
def test_alignment_of_hard_rows(models, hard, few_pairs):
    assert got(hard, few_pairs=few_pairs) == expected(models, [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()])


def test_alignment_of_documents(models, spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    assert got(df) == expected(models, [(r.doc_id, r.text) for r in df.collect()])


def test_alignment_of_odd_texts(models, spark, monkeypatch):
    """Also with workers that forget what they have seen."""
    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "é", "漢", "😀", "▁", "<0x41>", "the", "ing", " The", "'s", "23", "!!", " ", "\x1c", "é"]
    rows = list(enumerate([*TEXTS, *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(300))]))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == expected(models, rows)
    aligner = alignment.Aligner(open(SPEC, "rb").read(), open(MODEL, "rb").read())
    assert aligner.by_words
    texts = [t for _, t in rows]
    want = [x.tolist() if isinstance(x, np.ndarray) else x for x in aligner.summaries(texts)]
    monkeypatch.setattr(alignment, "CACHE", 0)
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in aligner.summaries(texts)] == want
    aligner.by_words = False
    aligner.forget()
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in aligner.summaries(texts)] == want


@pytest.mark.parametrize("kind", ["overlap", "group"])
def test_links_of_tokens(models, spark, kind):
    rows = list(enumerate([None, "", *TEXTS[:4], *TEXTS[5:]]))
    want = []
    for i, text in rows:
        a, b, groups, shared = plain(models, text)
        links = shared if kind == "overlap" else {(x, y): 1 for ga, gb in groups for x in ga for y in gb}
        want += [(i, x, y, a[x], b[y], n) for (x, y), n in links.items()]
    links = alignment.token_links(spark.createDataFrame(rows, "doc_id long, text string"), SPEC, MODEL, kind)
    assert sorted(map(tuple, links.collect())) == sorted(want)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_products_equal_dense_ones(block):
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, k, m = rng.integers(1, 12, 3)
        dense = [rng.integers(0, 3, shape) * (rng.random(shape) < 0.4) for shape in ((n, k), (k, m))]
        a, b = (alignment.Csr(np.append(0, np.cumsum((x > 0).sum(1))), np.nonzero(x)[1], x[np.nonzero(x)], x.shape[1]) for x in dense)
        product, rows = np.zeros((n, m), np.int64), 0
        for lo, part in alignment.gustavson(a, b, block):
            assert lo == rows
            rows += part.n_rows
            for i in range(part.n_rows):
                s = slice(part.indptr[i], part.indptr[i + 1])
                assert (np.diff(part.indices[s]) > 0).all()
                product[lo + i, part.indices[s]] = part.data[s]
        assert rows == n and (product == dense[0] @ dense[1]).all()
        assert alignment.product_sizes(a, b).tolist() == ((dense[0] > 0).astype(int) @ (dense[1] > 0)).sum(1).tolist()


def test_alignment_empty(empty):
    assert alignment.alignment_summary(empty, SPEC, MODEL).count() == 0
    assert alignment.token_links(empty, SPEC, MODEL).count() == 0
