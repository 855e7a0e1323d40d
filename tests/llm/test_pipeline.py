"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import A_Z, WORD, components, plain_fingerprint  # the operators' plain forms
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 1), (10_001, "123 ...", None, None, None)], docs.schema)
    before = docs.unionByName(odd)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)

    one = stage["language_id"](spark, before, small)
    assert one.columns == COLUMNS
    texts = {r.doc_id: r.text for r in one.collect()}
    assert texts == {r.doc_id: r.text for r in docs.collect()}

    two = stage["exact_dedup"](spark, one, small)
    last = {t.translate(A_Z): i for i, t in sorted(texts.items())}
    assert sorted(r.doc_id for r in two.collect()) == sorted(last.values())

    three = stage["simhash_near_dedup"](spark, two, small)
    ids = sorted(last.values())
    part = components(ids, [plain_fingerprint(texts[i]) for i in ids])
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i, c in zip(ids, part, strict=True) if i == c)

    four = stage["mixing"](spark, three, small).cache()
    assert four.columns == COLUMNS
    taken = Counter()
    for r in four.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    sizes = {r.doc_id: len(WORD.findall(r.text)) for r in three.collect()}
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, len(x := t.encode(r.text, add_special_tokens=False).ids), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for r in four.collect())
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in stage["bpe"](spark, four, small).collect()) == want


def test_stages_of_hard_rows(spark, hard):
    """Null and repeated ids, one id for different texts and sources: no text is lost, no copy stays, none is mixed up."""
    other = [(7, "short one", "en", "s1", 9), (7, "zwei kurze andere", "de", "s1", 9), (None, "no id either, and no copy", "en", None, 1), (None, "no id here", "en", "s9", 1), (6, "a b", "en", "s3", 3)]
    before = hard.select(COLUMNS).unionByName(spark.createDataFrame(other, hard.select(COLUMNS).schema)).repartition(4)
    stage = dict(corpus_pipeline.STAGES)
    norm = lambda t: (t or "").translate(A_Z)

    one = stage["language_id"](spark, hard, "")
    assert one.columns == COLUMNS
    key = lambda r: repr((r.doc_id, r.text, r.source, r.n_chars))
    assert sorted(map(key, one.collect())) == sorted(key(r) for r in hard.collect() if any(c.isalpha() for c in r.text or ""))
    assert {r.lang for r in one.collect()} <= {"en", "de", "fr"}

    two = stage["exact_dedup"](spark, before, "").cache()
    groups = defaultdict(list)
    for r in before.collect():
        groups[norm(r.text)].append(r.doc_id)
    want = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(map(repr, ((norm(r.text), r.doc_id) for r in two.collect()))) == sorted(map(repr, want.items()))

    # copies again, as no stage may rely on the one before it
    three = stage["simhash_near_dedup"](spark, before, "")
    rows = [(r.doc_id, r.text) for r in before.collect()]
    part = components(range(len(rows)), [plain_fingerprint(t) for _, t in rows])
    parts = defaultdict(list)
    for (i, _), c in zip(rows, part, strict=True):
        parts[c].append(i)
    want = [min((i for i in ids if i is not None), default=None) for ids in parts.values()]
    assert Counter(r.doc_id for r in three.collect()) == Counter(want)

    four = stage["mixing"](spark, before, "").collect()
    texts = defaultdict(list)
    for r in before.collect():
        texts[r.doc_id, r.lang, r.source].append(r.text or "")
    taken, size = Counter(), {k: sum(len(WORD.findall(t)) for t in x) for k, x in texts.items()}
    for r in four:
        k = (r.doc_id, r.lang, r.source)
        taken[k] += len(WORD.findall(r.text))
        assert any(all(x in t for x in r.text.split("\n")) for t in texts[k])
    assert all(n <= 2 * size[k] for k, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)


    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in hard.collect()]
    want = sorted(repr((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())) for i, x in ids)
    assert sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256)) for r in stage["bpe"](spark, hard, "").collect()) == want


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, hard, empty, name):
    """Also with the clashing columns of the hard rows, which no stage passes on."""
    stage = dict(corpus_pipeline.STAGES)[name]
    for none in (empty, hard.where("false")):
        got = stage(spark, none, "")
        assert got.count() == 0
        assert name == "bpe" or got.columns == COLUMNS


@pytest.mark.parametrize("name", ["exact_dedup", "simhash_near_dedup", "mixing"])
def test_stages_leave_other_columns_out(spark, hard, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, hard, "").columns == COLUMNS


def test_language_stage_without_labels(spark, hard):
    assert corpus_pipeline.language_id(spark, hard.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_run_is_the_stages_in_order(spark, small):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) for _ in range(2))
    assert one == two and len(one) > 100
