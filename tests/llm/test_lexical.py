"""Ranked lexical search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from concord.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(A_Z)))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x for *_, x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(A_Z)))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scores = []
        for doc, bag, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(w[t] * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [repr((item, rank, None if null else doc, -s)) for rank, (s, null, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(docs, items, **options):
    return sorted(repr(tuple(r)) for r in lexical.ranked(docs, items, **options).collect())


def rows(df, key):
    return [(r[key], r.text) for r in df.select(key, "text").collect()]


@pytest.mark.parametrize("item_terms, postings", [(lexical.ITEM_TERMS, lexical.POSTINGS), (700, 3000), (5000, 1)])
def test_ranking_of_documents(spark, small, item_terms, postings):
    """Also with items in several blocks and with indexes of a few or of single documents."""
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(docs, items, item_terms=item_terms, postings=postings) == plain(rows(docs, "doc_id"), rows(items, "item_id"))


@pytest.mark.parametrize("postings", [2, lexical.POSTINGS])
def test_ranking_of_hard_rows(spark, hard, postings):
    """Repeated rows and items, ties, null ids on both sides, items without a term."""
    items = spark.createDataFrame([(1, "the quick BROWN fox"), (1, "the quick BROWN fox"), (2, None), (3, " ?! "), (None, "w1 w2 漢字 É é"), (4, "nowhere"), (5, "line id here w7 fox")], "item_id long, text string")
    assert got(hard, items, postings=postings, k=3) == plain(rows(hard, "doc_id"), rows(items, "item_id"), 3)


def test_ranking_of_many_equal_documents(spark):
    """Ties go by id across tasks and indexes; what ties with the last place is not scored one by one."""
    docs = spark.createDataFrame([(5000 - i, "same words in all of them" if i % 3 else "other words") for i in range(4000)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(7, "same them"), (8, "other")], "item_id long, text string")
    assert got(docs, items, postings=900) == plain(rows(docs, "doc_id"), rows(items, "item_id"))
    term = np.zeros(3000, np.int64)
    index = lexical.Index(term, np.arange(3000), np.full(3000, 7), 3000)
    best = lexical.Best(10)
    assert lexical.search(index, np.array([0]), list(range(3000)), best) < 300
    assert sorted(best.rows()) == [(7, i) for i in range(10)]


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_scoring_all(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms, n = 400, 30, 3000
    flat = rng.choice(n_docs * n_terms, n, replace=False)
    term, doc = flat // n_docs, flat % n_docs
    impact = rng.integers(1, 5 if seed % 2 else 10**9, n)
    index, scored = lexical.Index(term, doc, impact, n_docs), 0
    for size in (1, 3, 12):
        chosen = np.sort(rng.choice(n_terms, size, replace=False))
        ids = [*range(100, 100 + n_docs - 2), None, None]
        best = lexical.Best(10)
        scored += lexical.search(index, chosen, ids, best)
        sums = np.bincount(doc[np.isin(term, chosen)], impact[np.isin(term, chosen)], minlength=n_docs).astype(np.int64)
        want = sorted((-s, ids[i] is None, ids[i] or 0) for i, s in enumerate(sums.tolist()) if s)[:10]
        assert sorted((-s, i is None, i or 0) for s, i in best.rows()) == want
        left, right = np.sort(rng.integers(0, n_docs, (2, 50)), axis=0)
        bound, _ = index.bounds(index.places(chosen, left), index.places(chosen, right + 1))
        one = np.array([[impact[(term == t) & (doc >= lo) & (doc <= hi)].max(initial=0) for t in chosen] for lo, hi in zip(left, right, strict=True)])
        assert bound.tolist() == one.sum(1).tolist()
    assert scored < 3 * n_docs


def test_length_beyond_64_bits():
    w, tf = np.array([3000]), np.array([10])
    assert lexical.impacts(w, tf, np.array([10**9]), 10**12, 10**15).tolist() == [3000 * (10**10 // (10**4 + 8 * (10 + 90 * 10**21 // 10**15)))]


def test_ranking_empty(spark, empty, hard):
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.ranked(empty, items).count() == 0
    assert lexical.ranked(hard, items.where("false")).count() == 0
