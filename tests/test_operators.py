import functools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord import bindings
from concord.functions import alias, classify
from concord.functions import text as T
from concord.operators import agree, checks, corpus, dag, hashing, packed, repro, rules, runs, sample
from concord.plans import questions
from concord.sources import keyspace, plugins, records, rule_xml
from concord.sources import packed as stored
from concord.sources.scratch import fresh_path

ALL = ["a", "b", "c", "base"]
PATTERNS = ["1xx0xxxxxxxx", "1x10xxxxxxxx", "000000000000", "01xxxxxxxxxx"]


def rule_rows(spark, patterns):
    rows = [(i, int("".join("0" if c == "x" else "1" for c in p), 2), int(p.replace("x", "0"), 2)) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "rule_id int, mask long, value long")


def brute(patterns, width):
    return [[i for i, p in enumerate(patterns) if all(c in ("x", b) for c, b in zip(p, f"{w:0{width}b}", strict=True))] for w in range(1 << width)]


def test_three_forms_of_classification_agree(spark, monkeypatch):
    patterns = [*PATTERNS, "xxxxxxxxx101", "xxxx1xxxxxxx"]
    words, table = keyspace.key_space(spark, 12, 6), rule_rows(spark, patterns)
    near = {r.word: (r.rule_id, r.n_match, r.valid) for r in rules.classify_words(words, table, 12).collect()}
    monkeypatch.setattr(rules, "FEW_RULES", 2)
    assert near == {r.word: (r.rule_id, r.n_match, r.valid) for r in rules.classify_words(words, table, 12).collect()}
    loop = {r.word: (r.rule_id, r.n_match, r.valid) for r in rules.classify_nested_loop(words, table).collect()}
    want = {w: (min(m) if m else None, len(m), bool(m)) for w, m in enumerate(brute(patterns, 12))}
    assert near == loop == want


def test_rules_are_looked_up_by_two_prefixes(spark, monkeypatch):
    """Rules that fix the first bits, only the next ones, or neither, in the broadcast and the shuffled form."""
    patterns = ["1010x0xx" + "x" * 10, "x" * 8 + "0110xx1x" + "10", "x" * 16 + "01", "x" * 18, "xxxxxx10" + "x1x0x" + "x" * 5, "0" * 18]
    words, table = keyspace.key_space(spark, 18, 12), rule_rows(spark, patterns)
    want = {w: (min(m) if m else None, len(m)) for w, m in enumerate(brute(patterns, 18))}
    assert {r.word: (r.rule_id, r.n_match) for r in rules.classify_words(words, table, 18).collect()} == want
    monkeypatch.setattr(rules, "FEW_RULES", 2)
    assert {r.word: (r.rule_id, r.n_match) for r in rules.classify_words(words, table, 18).collect()} == want


def region_sets(table, width):
    counted, members = rules.regions(table, width)
    live = {}
    for r in members.collect():
        live.setdefault(r.region, []).append(r.rule_id)
    out = {}
    for r in counted.collect():
        found = tuple(sorted(live.get(r.region, [])))
        assert len(found) == r.n_rules and found not in out
        out[found] = r.weight
    return out


@pytest.mark.parametrize("step", [1, 4, 5])
def test_regions_are_counted_without_enumeration(spark, monkeypatch, step):
    monkeypatch.setattr(dag, "build", functools.partial(dag.build, step=step))
    for patterns in (PATTERNS, [*PATTERNS, PATTERNS[1], PATTERNS[1], "xxxxxxxxxx11"], ["x" * 12], []):  # also with rules that are alike
        want = {}
        for m in brute(patterns, 12):
            want[tuple(m)] = want.get(tuple(m), 0) + 1
        assert region_sets(spark.createDataFrame(rule_rows(spark, patterns).collect() if patterns else [], "rule_id int, mask long, value long"), 12) == want
    assert region_sets(rule_rows(spark, PATTERNS), 12)[()] == 2047
    one = rules.allocation(rules.regions(rule_rows(spark, PATTERNS), 12)[0]).first()
    assert (one.allocated, one.unallocated, one.ambiguous_groups) == (2049, 2047, 1)


def test_full_width_counts(spark):
    table = spark.createDataFrame([(0, 2**32 - 1, 0), (1, 2**31, 2**31)], "rule_id int, mask long, value long")
    one = rules.allocation(rules.regions(table, 32)[0]).first()
    assert (one.allocated, one.ambiguous_groups) == (1 + 2**31, 0)


@pytest.mark.parametrize("few", [dag.FEW_LINKS, 0])
def test_words_descend_the_dag(spark, monkeypatch, few):
    """With links that are broadcast and with links that are not; a table whose DAG is given up gives the same rows."""
    monkeypatch.setattr(dag, "FEW_LINKS", few)
    rng = np.random.default_rng(8)
    masks = rng.integers(0, 1 << 14, 300) | 0b1010101
    rows = [(i, int(m), int(m & v)) for i, (m, v) in enumerate(zip(masks, rng.integers(0, 1 << 14, 300), strict=True))]
    table, words = spark.createDataFrame(rows, "rule_id int, mask long, value long"), keyspace.key_space(spark, 14, 8)
    got = {r.word: (r.rule_id, r.n_match, r.valid) for r in rules.classify_many_rules(words, table, 14).collect()}
    want = {}
    for w in range(1 << 14):
        m = [i for i, mask, value in rows if w & mask == value]
        want[w] = (min(m) if m else None, len(m), bool(m))
    assert got == want
    monkeypatch.setattr(rules, "MOST_ROWS", 0)
    assert {r.word: (r.rule_id, r.n_match, r.valid) for r in rules.classify_many_rules(words, table, 14).collect()} == want
    if few:
        plan = dag.classify(words, dag.build(table, 14))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_many_rules_that_leave_the_first_bits_open(spark):
    """100,000 rules over 32 bits, none of which fixes one of the first eight: the DAG has them once a level."""
    table = spark.range(100_000).select(F.col("id").cast("int").alias("rule_id"), F.lit((1 << 24) - 1).cast("long").alias("mask"), (F.col("id") * 167 % (1 << 24)).alias("value"))
    found = dag.build(table, 32)
    assert [level.n_links for level in found.levels[:2]] == [16, 16] and found.leaves.count() == 100_000
    one = rules.allocation(rules.regions(table, 32)[0]).first()
    assert (one.allocated, one.unallocated, one.ambiguous_groups) == (100_000 << 8, (1 << 32) - (100_000 << 8), 0)
    words = spark.range(1000).select((F.col("id") * 4_294_967 + (F.col("id") * 167)).alias("word"))
    got = {r.word: r.rule_id for r in dag.classify(words, found).collect()}
    value_of = {i * 167 % (1 << 24): i for i in range(100_000)}
    assert got == {w: value_of.get(w & 0xFFFFFF) for w in got}


def test_mask_of_boxes(spark):
    boxes = [(31, 22, "1101011001011111000000"), (9, 5, None), (4, 5, "00000")]
    rows = spark.createDataFrame([([{"hibit": h, "width": w, "name": None, "fixed_bits": f} for h, w, f in boxes],)], "boxes array<struct<hibit:int,width:int,name:string,fixed_bits:string>>")
    m, v = rules.mask_value(F.col("boxes"))
    r = rows.select(m.alias("m"), v.alias("v")).first()
    assert r.m == 0xFFFFFC1F and r.v == 0xD65F0000 and 0xD65F03C0 & r.m == r.v


def test_tilings_find_gaps_and_overlaps(spark):
    rows = [("gap", 31, 31), ("over", 31, 16), ("over", 20, 21), ("ok", 31, 16), ("ok", 15, 16), ("short", 31, 16)]
    got = {r.file: r.ok for r in rules.tilings(spark.createDataFrame([(f, "k", h, w) for f, h, w in rows], "file string, iclass string, hibit int, width int")).collect()}
    assert got == {"gap": False, "over": False, "ok": True, "short": False}


def tiny(spark, **sets):
    """256 words in four shards of 64."""
    rows = [(w, *(w in sets.get(s, ()) for s in ALL)) for w in range(256)]
    return spark.createDataFrame(rows, "word long, a boolean, b boolean, c boolean, base boolean")


def test_one_disagreement_of_small_domain(spark):
    v = tiny(spark, a={0, 8}, b={0, 8}, c={8}, base={0, 8})
    wide = packed.pack(v, ALL)
    d = agree.disagreeing(wide, ALL, 6).first()
    assert (d.disagreements, d.shards, agree.all_accept(wide, ALL).first().population) == (1, 1, 1)
    c = corpus.verdict_tier(packed.set_masks(wide, ALL, 256), ALL, 6).collect()
    assert [(r.word, r.category, r.oracle_valid["c"], r.oracle_valid["base"]) for r in c] == [("0x00000000", "VALIDITY", False, True)]


def test_rates_and_ranking(spark):
    v = tiny(spark, a={5}, b={70, 71})
    got = {r.source: r for r in questions.agreement_ranking(v, ["a", "b", "c"], "base", 256, 6).collect()}
    assert got["b"].rank == 1 and got["a"].rank == 2 and got["c"].rank == 3
    assert got["a"].micro == got["a"].macro == 255 / 256 and got["b"].disagreements == 2


def test_macro_counts_shards_without_a_stored_block(spark):
    v = tiny(spark, a={5}).where("word < 64")
    sizes = spark.createDataFrame([(0, 64), (1, 64), (2, 32)], "shard long, n_words long")
    got = {r.source: r.macro for r in agree.macro(packed.pack(v, ALL), ["a"], "base", sizes, 6).collect()}
    assert got["a"] == pytest.approx((63 / 64 + 1 + 1) / 3)


def test_texts_and_words_of_any_form(spark):
    rows = spark.createDataFrame([("\tadd", "\tx0\n"), (" \n", None), ("ret", "\t ")], "m string, o string")
    assert [r.t for r in rows.select(classify.composed_text(F.col("m"), F.col("o")).alias("t")).collect()] == ["add x0", None, "ret"]
    hexes = ["0x1", "#0xff", "#-0x10", "#0xFFFFFFFFFFFFFFFF", "#0x10000000000000000", "#-0x" + "f" * 40, "#0x" + "0" * 20 + "1", "#0x" + "9" * 33]
    got = [r.t for r in spark.createDataFrame([(h,) for h in hexes], "h string").select(T.immediates(F.col("h")).alias("t")).collect()]
    assert got == ["0x1", *(f"#{int(h[1:].replace('0x', ''), 16)}" for h in hexes[1:])]
    from concord.functions.bits import parse_word

    words = ["0x7fffffffffffffff", "0x8000000000000000", "0x00000000000000000010", "0x" + "f" * 15, "g", ""]
    got = [r.w for r in spark.createDataFrame([(w,) for w in words], "h string").select(parse_word(F.col("h")).alias("w")).collect()]
    assert got == [2**63 - 1, None, 16, 16**15 - 1, None, None]


def test_confusion_pairs_and_sets(spark):
    v = tiny(spark, a={1, 2, 63}, b={2, 64}, base={2, 63, 200})
    wide = packed.pack(v, ALL)
    r = {x.source: x for x in packed.confusion(wide, ["a"], "base", 256).collect()}["a"]
    assert (r.both_valid, r.false_positive, r.false_negative, r.both_invalid) == (2, 1, 1, 252)
    assert {(x.a, x.b): x.n for x in packed.co_acceptance(wide, ["a", "b"]).collect()} == {("a", "a"): 3, ("a", "b"): 1, ("b", "b"): 2}
    sets = packed.accepted_sets(v, ["a", "b"])
    assert sorted(x.word for x in sets["by_all"].collect()) == [2] and sets["by_none"].count() == 252


def test_packed_round_trip_touches_its_shards_only(spark):
    path = fresh_path(spark, "p")
    long = packed.to_long(packed.pack(tiny(spark, a={0, 63, 64, 200}), ALL), ALL, 6)
    stored.write_packed(long, path)
    stored.write_packed(spark.createDataFrame([("a", 3, 1, 3)], stored.SCHEMA), path)
    got = sorted((r.shard, r.block, r.bits & (2**64 - 1)) for r in stored.read_packed(spark, path).collect())
    assert got == [(0, 0, 1 | 1 << 63), (1, 1, 1), (3, 3, 1)]
    assert stored.read_packed(spark, path, [1]).count() == 1


def test_raw_slices(spark, tmp_path):
    bits = np.zeros(256, bool)
    bits[[0, 1, 8, 100, 255]] = True
    (tmp_path / "x-2.bin").write_bytes(np.packbits(bits, bitorder="little").tobytes())
    got = stored.import_bitmap_slices(spark, str(tmp_path), shard_bits=8).collect()
    assert {w for r in got for w in (r.block * 64 + i for i in range(64) if r.bits >> i & 1)} == {512, 513, 520, 612, 767}
    assert {(r.source, r.shard) for r in got} == {("x", 2)}


def test_hashes_depend_on_content_only(spark):
    long = packed.to_long(packed.pack(tiny(spark, a={0, 63}, b={70}), ALL), ALL, 6)
    one = {r.shard: r.content_hash for r in hashing.content_hash(long, ALL).collect()}
    two = {r.shard: r.content_hash for r in hashing.content_hash(long.repartition(7).union(spark.createDataFrame([("c", 0, 0, 0)], "source string, block long, bits long, shard long")), ALL).collect()}
    assert one == two and len(one) == 2
    other = packed.to_long(packed.pack(tiny(spark, b={0, 63}, a={70}), ALL), ALL, 6)
    assert {r.shard: r.content_hash for r in hashing.content_hash(other, ALL).collect()} != one


def test_samples_are_seeded_and_independent_of_partitions(spark):
    words = spark.range(5000).withColumnRenamed("id", "word")
    a = [r.word for r in sample.seeded_sample(words, 50, 1).collect()]
    assert a == [r.word for r in sample.seeded_sample(words.repartition(13), 50, 1).collect()]
    assert a != [r.word for r in sample.seeded_sample(words, 50, 2).collect()] and len(set(a)) == 50


@pytest.mark.parametrize("k", [0, 1, 700, 100_000, 400_000])
def test_samples_are_the_smallest_hashes_and_count_their_population(spark, k):
    """Also of many rows, of all rows, and of none; the rows keep their other columns. Nothing reads the input again."""
    words = spark.range(300_000).select(F.col("id").alias("word"), (F.col("id") * 2).alias("other"), F.when(F.col("id") % 2 == 0, F.lit("x")).alias("text")).repartition(5)
    rows, report = sample.sampled(words, k, 1)
    hashed = words.withColumn("h", sample.sample_key(1, F.col("word"))).orderBy("h", "word").limit(k).drop("h")
    assert rows.count() == min(k, 300_000) and rows.exceptAll(hashed).isEmpty() and rows.columns == words.columns
    assert tuple(report.first()) == (300_000, min(k, 300_000))
    for df in (rows, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Range" not in plan and "MapInArrow" not in plan
    none = sample.sampled(words.where("word < 0"), 5, 1)
    assert none[0].count() == 0 and tuple(none[1].first()) == (0, 0)


def test_ties_and_nulls_in_samples(spark):
    words = spark.createDataFrame([(i % 50 if i % 9 else None,) for i in range(2000)], "word long").repartition(6)
    rows, report = sample.sampled(words, 300, 2)
    want = words.withColumn("h", sample.sample_key(2, F.col("word"))).orderBy("h", "word").limit(300)
    assert sorted(repr(r.word) for r in rows.collect()) == sorted(repr(r.word) for r in want.collect()) and report.first().population == 2000


def test_rates_over_groups_that_are_no_ranges(spark):
    wide = packed.pack(tiny(spark, a={0, 1, 63, 70}, b={0, 1}, c={0}, base={0, 1, 130}), ALL).where("block <> 3")
    words = spark.range(256).select(F.col("id").alias("word"), F.when(F.col("id") % 5 == 0, "five").when(F.col("id") == 63, "one").when(F.col("id") > 200, "high").otherwise("rest").alias("kind"))
    rates = agree.group_rates(wide, ["a", "b", "c"], "base", agree.group_masks(words, "kind"))
    kind = {r.word: r.kind for r in words.collect()}
    sets = {"a": {0, 1, 63, 70}, "b": {0, 1}, "c": {0}}
    want = {}
    for g in set(kind.values()):
        of = {w for w, k in kind.items() if k == g}
        for s, x in sets.items():
            d = len((x ^ {0, 1, 130}) & of)
            want[g, s] = (len(of), d, (len(of) - d) / len(of))
    assert {(r.group, r.source): (r.n_words, r.disagreements, r.rate) for r in rates.collect()} == want
    macro = {r.source: r.macro for r in agree.macro_of_groups(rates).collect()}
    assert macro == {s: pytest.approx(np.mean([v[2] for k, v in want.items() if k[1] == s])) for s in sets}


def test_text_disagreements_raw_and_normalized(spark):
    texts = spark.createDataFrame([(1, "mov w0, w1", "MOV  W0, W1 // x", "mov w0, w2"), (2, "add w0, #0x10", "add w0, #16", "add w0, #17")], "word long, a string, b string, c string")
    c = corpus.text_tier(texts, ["a", "b", "c", "base"][:3], ["a", "b", "c"], 6)
    run = lambda **k: {r.source: r.text_disagreements for r in agree.text_disagreements(c, ["b", "c"], "a", **k).collect()}
    assert run() == {"b": 2, "c": 2} and run(compare="normalized") == {"b": 0, "c": 2}
    assert run(compare="normalized", has_text={"c": False}) == {"b": 0}
    with pytest.raises(ValueError):
        run(compare="exact")


def test_reproducers_cap_and_preference(spark):
    texts = spark.createDataFrame([(1, "mov w0, w1", "mov w0, w2", "MOV"), (2, "add w0", "add w1", "ADD"), (3, "ret", "RET", "RET")], "word long, a string, b string, base string")
    t = corpus.text_tier(texts, ["a", "b", "base"], ["a", "b"], 6)
    assert {r.word: r.category for r in t.collect()} == {"0x00000001": "OPERAND", "0x00000002": "OPERAND"}
    v = tiny(spark, a=set(range(10, 40)), base=set(range(20, 60)))
    c = corpus.merged(corpus.verdict_tier(packed.set_masks(packed.pack(v, ALL), ALL, 256), ["a", "b", "base"], 6), t)
    got = repro.chosen(c, ["a", "b"], "base", n=6).orderBy("rank").collect()
    assert [r.category for r in got] == ["OPERAND"] * 2 + ["VALIDITY"] * 4
    assert max(sum(r.spec == s for r in got if r.category == "VALIDITY") for s in ("valid", "invalid")) <= 2
    path = fresh_path(spark, "r")
    records.write_reproducers(repro.render_reproducers(repro.chosen(c, ["a", "b"], "base", n=6)), path)
    back = {r.word: r.actual for r in records.read_reproducers(spark, path).collect()}
    assert back == {r.word: r.actual for r in got}


def loop(rows, cap):
    """What the plain loop keeps of (shard, tier, word, category, spec) rows."""
    seen, full, kept = set(), {}, []
    for r in sorted(rows):
        key = r[3:]
        if r[2] not in seen and full.get(key, 0) < cap:
            seen.add(r[2])
            full[key] = full.get(key, 0) + 1
            kept.append(r)
    return kept


@pytest.mark.parametrize("seed", range(5))
def test_greedy_selection_equals_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    n_words, n_specs = ((40, 3), (15, 8), (200, 2), (6, 30), (60, 12))[seed]
    places = {(int(rng.integers(3)), int(rng.integers(2)), f"w{rng.integers(n_words):03}") for _ in range(150)}
    rows = [(*at, "AB"[rng.integers(2)], f"s{rng.integers(n_specs)}") for at in sorted(places)]
    for cap in (1, 2, 5):
        got = repro.greedy(spark.createDataFrame(rows, "shard int, tier int, word string, category string, spec string").repartition(3), cap, ("category", "spec"))
        assert sorted(map(tuple, got.collect())) == loop(rows, cap)


def test_records_turned_away_leave_their_word_free(spark):
    schema = "shard int, tier int, word string, category string, spec string"
    rows = [(0, 0, f"0x{i}", "VALIDITY", "valid") for i in (1, 2, 3)] + [(0, 1, "0x3", "OPERAND", "ADD")]
    assert [r.tier for r in repro.greedy(spark.createDataFrame(rows, schema), 2, ("category", "spec")).where("word = '0x3'").collect()] == [1]
    # a chain of waits: each row needs the one before to be turned away
    rows = [(0, i, f"0x{i // 2:02}", "A", f"{(i + 1) // 2}") for i in range(14)]
    assert sorted(map(tuple, repro.greedy(spark.createDataFrame(rows, schema), 1, ("category", "spec")).collect())) == loop(rows, 1)


def test_too_few_reproducers_are_an_error(spark):
    *_, c = world(spark)
    with pytest.raises(ValueError, match="only 4 reproducers"):
        repro.chosen(c, ["a", "b", "c"], "base")
    assert repro.chosen(c, ["a", "b", "c"], "base", complete=False).count() == 4


def test_last_of_repeated_header_fields_counts(spark):
    path = fresh_path(spark, "r")
    rows = [("00-x", "- word: 0x1\n- tool: a\n- tool: b\n")]
    records.write_reproducers(spark.createDataFrame(rows, "file string, text string"), path)
    r = records.read_reproducers(spark, path).first()
    assert (r.word, r.tool, r.spec) == ("0x1", "b", None)


def test_one_failing_word_is_isolated(spark):
    def bad_word(words):
        if (words == 1050).any():
            raise RuntimeError("boom")
        return words % 2 == 0, None

    words = spark.range(1000, 1100).withColumnRenamed("id", "word")
    got = plugins.udf_source(words, "s", bad_word).collect()
    assert [r.word for r in got if r.error] == [1050] and sum(r.error is None for r in got) == 99
    assert next(r.valid for r in got if r.word == 1050) is False
    with pytest.raises(KeyError):
        plugins.Registry().rows(words, ["nobody"])


@pytest.mark.parametrize("own_process", [False, True])
def test_a_word_that_hangs_or_kills_costs_itself_alone(spark, own_process):
    def hangs(words):
        import time

        if (words == 7).any():
            time.sleep(3600)
        if (words == 8).any():
            raise RuntimeError("boom")
        return words % 2 == 0, [f"w{w}" for w in words.tolist()]

    def dies(words):
        import os

        if (words == 9).any():
            os.kill(os.getpid(), 11)
        if (words == 11).any():
            os._exit(3)
        return hangs(words)

    words = spark.range(64).withColumnRenamed("id", "word").coalesce(2)
    got = {r.word: (r.valid, r.text, r.error) for r in plugins.udf_source(words, "s", dies if own_process else hangs, seconds=0.5, own_process=own_process).collect()}
    lost = {7: "TimeoutError: over 0.5 s", 8: "RuntimeError: boom"} | ({9: "ChildProcessError: ended with -11", 11: "ChildProcessError: ended with 3"} if own_process else {})
    assert got == {w: (False, None, lost[w]) if w in lost else (w % 2 == 0, f"w{w}", None) for w in range(64)}


XML = """<instructionsection id="SUBS" type="instruction"><docvars><docvar key="mnemonic" value="SUBS"/><docvar key="instr-class" value="general"/></docvars>
<alias_list howmany="1"><aliasref aliaspageid="CMP_SUBS"><text>CMP (x)</text><aliaspref>Rd == '11111'</aliaspref></aliasref><aliasref aliaspageid="NEGS_S"/></alias_list>
<classes><iclass id="k" name="k"><regdiagram psname="ps"><box hibit="31" width="31"><c>x</c></box><box><c>1</c></box></regdiagram><encoding name="E"/></iclass><iclass id="none"/></classes>
<ps_section><ps><pstext section="Decode">a <a>UNPRE</a>DICTABLE</pstext></ps></ps_section></instructionsection>"""


def test_rule_documents(spark):
    docs = spark.createDataFrame([(XML,), ("<other/>",), ("<instructionsection id='q'",), (f"<?xml version='1.0'?>\n<!-- x -->{XML.replace('Decode', 'Execute')}",)], "xml string")
    d = rule_xml.docvars(rule_xml.parse_rule_xml(docs))
    assert d.count() == 2
    assert [r.f for r in d.select(rule_xml.not_fully_defined("xml").alias("f")).collect()] == [True, False]
    r = rule_xml.extract_rules(d).first()
    assert [(b.hibit, b.width, b.fixed_bits) for b in r.boxes] == [(31, 31, None), (0, 1, "1")]
    assert {(x.base, x.alias, x.condition) for x in rule_xml.extract_aliases(d).collect()} == {("SUBS", "CMP", "Rd == '11111'"), ("SUBS", "NEGS", "")}


def test_scope_of_rules_and_aliases(spark):
    """Instructions of other classes, without a class, and documents of other types give no rules and no aliases."""
    other = [XML.replace("general", "sve"), XML.replace('<docvar key="instr-class" value="general"/>', ""), XML.replace('type="instruction"', 'type="alias"')]
    d = rule_xml.docvars(rule_xml.parse_rule_xml(spark.createDataFrame([(x,) for x in other], "xml string")))
    assert d.count() == 3 and rule_xml.extract_rules(d).count() == 0 and rule_xml.extract_aliases(d).count() == 0
    assert rule_xml.extract_rules(d, None).count() == 2 and rule_xml.extract_rules(d, ("sve",)).count() == 1
    assert rule_xml.extract_boxes(d).count() == 3


def test_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text("<other/>")
    (tmp_path / "c.xml").write_text("<instructionsection id='broken'")
    scanned = rule_xml.docvars(rule_xml.read_rule_xml(spark, str(tmp_path)))
    assert [(r._id, r.mnemonic, r.instr_class) for r in scanned.collect()] == [("SUBS", "SUBS", "general")]
    assert [r.f for r in scanned.select(rule_xml.not_fully_defined("xml").alias("f")).collect()] == [True]
    assert {r.alias for r in rule_xml.extract_aliases(scanned).collect()} == {"CMP", "NEGS"}
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "x").write_text("\x1e".join([XML, "<instructionsection id='broken'", "", XML.replace('id="SUBS"', 'id="TWO"')]))
    assert sorted(r._id for r in rule_xml.read_rule_xml(spark, str(tmp_path / "many"), "\x1e").collect()) == ["SUBS", "TWO"]


def test_alias_tables_from_storage(spark, tmp_path):
    normal = lambda rules, text: alias.apply_aliases(T.normalize_text(spark.createDataFrame([(text,)], "raw string"), "raw"), alias.compile_alias_rules(rules)).first().normalized
    (tmp_path / "a.json").write_text('{"SUBS": [{"alias_mnemonic": "CMP", "condition": "Rd == \'11111\'"}], "ADD": [{"alias_mnemonic": "INC", "condition": "Unconditionally"}, {"alias_mnemonic": "X"}]}')
    found = alias.load_alias_rules(spark, str(tmp_path / "a.json"))
    assert [(r.base_seq, r.alias_seq, r.base, r.alias, r.condition) for r in found.orderBy("base_seq", "alias_seq").collect()] == [(0, 0, "SUBS", "CMP", "Rd == '11111'"), (1, 0, "ADD", "INC", "Unconditionally"), (1, 1, "ADD", "X", "")]
    assert normal(found, "ADD X0, X1") == "inc x0, x1" and normal(found, "ORR W0, W31, W1") == "orr w0, wzr, w1"
    (tmp_path / "b.json").write_text('{"SUBS": [{"alias_')
    for name in ("b.json", "none.json", "none"):
        fallback = alias.load_alias_rules(spark, str(tmp_path / name))
        assert fallback.count() == 12 and normal(fallback, "ORR W0, W31, W1") == "mov w0, w1"
    assert normal(alias.alias_rules(spark), "ORR W0, W31, W1") == "orr w0, wzr, w1"
    found.write.parquet(str(tmp_path / "t"))
    assert alias.load_alias_rules(spark, str(tmp_path / "t")).count() == 3


def test_alias_places_of_many_references(spark, monkeypatch):
    refs = spark.createDataFrame([(f, r, "B", f"a{f}_{r}", None) for f in (1, 2) for r in range(1500)], "file_seq long, ref_seq int, base string, alias string, condition string")
    got = alias.grouped_aliases(refs).orderBy("alias_seq").collect()
    assert [r.alias for r in got] == [f"a{f}_{r}" for f in (1, 2) for r in range(1500)] and {r.base_seq for r in got} == {1}
    chain = alias.compile_alias_rules(alias.alias_rules(spark, [("A", "B", "Unconditionally"), ("B", "C", "Unconditionally"), ("C", "D", "Unconditionally"), ("D", "A", "Unconditionally")]))
    assert alias.chain_depth(chain) == 4
    for few in (100, 1):
        monkeypatch.setattr(alias, "FEW_RULES", few)
        rows = alias.apply_aliases(T.normalize_text(spark.createDataFrame([("A x1",), ("C x2",)], "raw string"), "raw"), chain)
        assert {r.normalized for r in rows.collect()} == {"a x1", "a x2"}


def test_word_list_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "w.txt").write_text("0x10\n\nff\nnope\n 0X1\n")
    got = records.read_word_list(spark, str(tmp_path)).collect()
    assert sorted(r.word for r in got if r.word is not None) == [1, 16, 255] and [r.rejected for r in got if r.word is None] == ["nope"]


def test_unreadable_shard_record_is_seen(spark, tmp_path):
    (tmp_path / "0.json").write_text('{"shard_id": 0, "start": 0, "end": 64, "status": "complete"}')
    (tmp_path / "1.json").write_text("{broken")
    got = records.read_shard_records(spark, str(tmp_path)).collect()
    assert sorted(r._corrupt_record is None for r in got) == [False, True]


def test_records_of_an_unknown_version_are_an_error(spark):
    path, lines = fresh_path(spark, "c"), fresh_path(spark, "n")
    *_, c = world(spark)
    records.write_corpus(c, path)
    assert records.read_corpus(spark, path).count() == c.count()
    for version in (2, None):
        records.write_corpus(c.withColumn("format_version", F.when(F.col("word") == "0x00000001", F.lit(version).cast("int")).otherwise(F.col("format_version"))), path)
        with pytest.raises(Exception, match="unknown format_version"):
            records.read_corpus(spark, path).select("category").collect()
    records.write_corpus_ndjson(c.withColumn("format_version", F.lit(7)), lines)
    with pytest.raises(Exception, match="unknown format_version 7"):
        records.read_corpus_ndjson(spark, lines).collect()


def world(spark):
    v = tiny(spark, a={0, 1, 63, 70}, b={0, 1}, c={0}, base={0, 1, 130})
    wide = packed.pack(v, ALL)
    long = packed.to_long(wide, ALL, 6)
    shards = keyspace.shard_bounds(spark, 8, 6)
    blocks = packed.set_masks(wide, ALL, 256)
    return wide, long, shards, blocks, runs.shard_records(long, ALL, shards), corpus.verdict_tier(blocks, ALL, 6)


def outcome(df):
    r = df.first()
    return r.passed, r.reason


def test_coverage_check(spark):
    wide, long, shards, _, recs, _ = world(spark)
    run = lambda r, fresh=long, w=wide, dense=True: outcome(checks.check_coverage(r, shards, w, ALL, 256, fresh, 6, dense))
    assert run(recs) == (True, "ok")
    assert run(recs.where("shard_id <> 2")) == (False, "missing shards")
    assert run(recs.withColumn("end", F.col("end") + (F.col("shard_id") == 0).cast("int"))) == (False, "bounds")
    assert run(recs.withColumn("untriaged_crash_count", F.lit(3).cast("long"))) == (False, "untriaged errors")
    assert run(recs.withColumn("content_hash", F.lit("x"))) == (False, "hashes")
    assert run(recs, w=wide.where("block <> 3")) == (False, "ones and zeros")  # an empty block of all sources
    assert run(recs, w=wide.where("block <> 0"), dense=False) == (False, "counts")
    assert run(recs, w=wide.where("block <> 3"), dense=False) == (True, "ok")
    assert run(recs, w=packed.completed(wide.where("block <> 3"), ALL, 256)) == (True, "ok")
    assert run(recs, w=wide.union(spark.createDataFrame([(4, 0, 0, 1, 0)], wide.schema))) == (False, "beyond the domain")
    lost = wide.withColumn("c", F.when(F.col("block") == 0, F.lit(0)).otherwise(F.col("c")))
    assert run(recs, w=lost) == (False, "counts")  # not of the first source


def test_corpus_check(spark):
    _, _, _, blocks, _, c = world(spark)
    every = spark.range(256).withColumnRenamed("id", "word")
    run = lambda c, total, gaps, **k: outcome(checks.check_corpus(c, ALL, total, k.get("exhaustive", True), k.get("n"), k.get("p"), checks.coverage_gaps(blocks, gaps, every, 6)))
    n = c.count()
    assert run(c, n, c) == (True, "ok")
    assert run(c, n + 4, c) == (False, "total")
    assert run(c.withColumn("category", F.lit("NOT_REAL")), n, c) == (False, "taxonomy")
    assert run(c, n, c, exhaustive=False) == (False, "sample sizes")
    assert run(c, n, c.where("word <> '0x00000001'")) == (False, "coverage")
    assert run(c.withColumn("format_version", F.lit(9)), n, c) == (False, "version")
    path, lines = fresh_path(spark, "c"), fresh_path(spark, "n")
    records.write_corpus(c.withColumn("format_version", F.when(F.col("word") == "0x00000001", 2).otherwise(1)), path)
    assert run(records.scan_corpus(spark, path), n, c) == (False, "version")
    records.write_corpus_ndjson(c, lines)
    assert run(records.scan_corpus_ndjson(spark, lines), n, c) == (True, "ok")
    spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(f"{lines}/shard=0")
    assert run(records.scan_corpus_ndjson(spark, lines), n, c) == (False, "readable")


def test_metrics_check(spark):
    wide, _, _, _, _, c = world(spark)
    m = agree.micro(wide, ["a", "b", "c"], "base", 256)
    tall = m.selectExpr("source", "stack(2, 'disagreements', cast(disagreements as double), 'micro', micro) as (metric, value)").unionByName(agree.text_disagreements(c, ["a", "b", "c"], "base").selectExpr("source", "'text_disagreements' metric", "cast(text_disagreements as double) value"))
    order = agree.ranked(m).select("rank", "source")
    run = lambda t, o: outcome(checks.check_metrics(t, o, wide, ["a", "b", "c"], "base", 256, c))
    assert run(tall, order) == (True, "ok")
    assert run(tall.withColumn("value", F.col("value") + (F.col("source") == "a").cast("int")), order) == (False, "values")
    assert run(tall, order.withColumn("rank", 4 - F.col("rank"))) == (False, "ranking")


def test_reproducer_check(spark):
    *_, c = world(spark)
    good = repro.chosen(c, ["a", "b", "c"], "base", n=3, cap=3)
    run = lambda g, least=3: outcome(checks.check_reproducers(g, c, 6, ["a", "b", "c"], "base", least))
    assert run(good) == (True, "ok")
    assert run(good, 10) == (False, "number")
    assert run(good.withColumn("word", F.lit("0x000000ff"))) == (False, "different words")
    for field, value, problem in (("spec", "FORGED", "spec"), ("actual", "?", "actual"), ("category", "OPERAND", "category"), ("category", "NEW", "unknown category"), ("tool", "z", "unknown tool"), ("spec", "", "header"), ("actual", None, "header"), ("word", "1", "word form")):
        forged = good.withColumn(field, F.when(F.col("rank") == 1, F.lit(value)).otherwise(F.col(field)))
        row = checks.check_reproducers(forged, c, 6, ["a", "b", "c"], "base", 3).first()
        assert (row.passed, row.reason, row.measured["wrong"]) == (False, "records", "1") and problem in row.measured["problems"].split(",")
    same = checks.check_reproducers(good.withColumn("actual", F.col("spec")), c, 6, ["a", "b", "c"], "base", 3).first()
    assert same.measured["problems"] == "actual,no disagreement"


def test_rules_normalization_and_hash_checks(spark):
    tiled = spark.createDataFrame([("f", "k", True)], "file string, iclass string, ok boolean")
    docs = spark.createDataFrame([("R1",)], "commit_id string")
    table = rule_rows(spark, ["0" * 12])
    assert outcome(checks.check_rules(tiled, docs, "R1", table, 0, 0, 12)) == (True, "ok")
    assert outcome(checks.check_rules(tiled, docs, "R2", table, 0, 0, 12)) == (False, "release")
    assert outcome(checks.check_rules(tiled.where("false"), docs, "R1", table, 0, 0, 12)) == (False, "tiling")
    assert outcome(checks.check_rules(tiled, docs, "R1", table, 1, 0, 12)) == (False, "known word")
    h = spark.createDataFrame([(0, "x"), (1, "y")], "seq int, hash string")
    assert outcome(checks.check_hash(h, hashing.result_hash(h).first().result_hash)) == (True, "ok")
    assert outcome(checks.check_hash(h.withColumn("seq", 1 - F.col("seq")), hashing.result_hash(h).first().result_hash)) == (False, "hash")
    none = spark.createDataFrame([], "normalized string, expected string, applied_rules array<string>")
    assert outcome(checks.check_normalization(none)) == (False, "comparisons")
    absent = checks.run_checks(spark, {"gone": lambda: checks.check_hash(spark.read.parquet("/nowhere/at/all"), "")})
    assert outcome(absent)[0] is False


@pytest.mark.parametrize("at_once", [1, 3])
def test_checks_fail_closed_while_they_run(spark, at_once):
    """A broken file and an unknown version show only when tasks read them; other checks keep their rows."""
    *_, c = world(spark)
    h = spark.createDataFrame([(0, "x"), (1, "y")], "seq int, hash string")
    broken, old = fresh_path(spark, "h"), fresh_path(spark, "c")
    h.write.parquet(broken)
    spark.createDataFrame([("no parquet at all",)], "value string").write.mode("append").text(broken)
    records.write_corpus(c.withColumn("format_version", F.lit(2)), old)
    none, word = spark.createDataFrame([], "word long"), hashing.result_hash(h).first().result_hash

    def boom():
        raise ZeroDivisionError

    rows = checks.run_checks(
        spark,
        {
            "good": lambda: checks.check_hash(h, word),
            "broken": lambda: checks.check_hash(spark.read.schema(h.schema).parquet(broken), word),
            "old": lambda: checks.check_corpus(records.read_corpus(spark, old), ALL, c.count(), True, None, None, none),
            "boom": boom,
            "none": lambda: checks.check_hash(h, word).where("false"),
            "last": lambda: checks.check_hash(h, "z"),
        },
        at_once,
    ).collect()
    assert [(r.check_id, r.passed) for r in rows] == [("result hash", True), ("broken", False), ("old", False), ("boom", False), ("none", False), ("result hash", False)]
    assert [r.reason.split(":")[0] for r in rows] == ["ok", "input", "input", "input", "no result", "hash"]


def test_resume_does_only_what_is_open(spark):
    _, long, shards, _, recs, _ = world(spark)
    path = fresh_path(spark, "store")
    stored.write_packed(long.where("shard <> 1"), path)
    assert [r.shard for r in runs.shards_to_do(shards, recs, stored.read_packed(spark, path), ALL).collect()] == [1]
    fresh = runs.resume(shards, recs, lambda todo: long.join(todo.select("shard"), "shard", "left_semi"), path, ALL)
    assert [r.shard_id for r in fresh.collect()] == [1]
    assert runs.shards_to_do(shards, recs, stored.read_packed(spark, path), ALL).count() == 0


def test_resume_clears_a_shard_that_comes_out_empty(spark):
    bounds = spark.createDataFrame([(1, 64, 128)], "shard long, start long, end long")
    path, none = fresh_path(spark, "store"), spark.createDataFrame([], stored.SCHEMA)
    stored.write_packed(spark.createDataFrame([("a", 1, 1, 1), ("a", 4, 1, 2)], "source string, block long, bits long, shard long"), path)
    recs = runs.shard_records(none, ["a"], bounds).withColumn("status", F.lit("incomplete"))
    fresh = runs.resume(bounds, recs, lambda todo: none, path, ["a"]).collect()
    assert [(r.shard_id, r.valid_counts) for r in fresh] == [(1, {"a": 0})]
    assert [(r.block, r.shard) for r in stored.read_packed(spark, path).collect()] == [(4, 2)]


def test_gaps_across_ranges_of_shards(spark):
    rows = [(i, i * 10, i * 10 + 10 + (i in (5, 4095, 9000))) for i in range(9500) if i not in (3, 4096, 4097, 8192)]
    df = spark.createDataFrame(rows, "shard_id int, start long, end long")
    assert sorted(r.shard_id for r in checks.shard_gaps(df).collect()) == [4, 6, 4098, 8193, 9001]


def test_lookups_and_coverage_of_many_claims(spark, monkeypatch):
    """The same with claims too many to be broadcast."""
    _, _, _, blocks, _, c = world(spark)
    claims = spark.createDataFrame([("0x00000001", "VALIDITY", "c", "valid", "invalid"), ("0x000000ff", "VALIDITY", "a", "valid", "invalid")], "word string, category string, tool string, spec string, actual string")
    every = spark.range(256).withColumnRenamed("id", "word")
    for few in (1000, 0):
        monkeypatch.setattr(checks, "FEW_KEYS", few)
        assert {r.word: r.problem for r in checks.lookups(claims, c, 6, ["a", "b", "c"], "base").collect()} == {"0x00000001": None, "0x000000ff": "not in corpus"}
        gone = checks.coverage_gaps(blocks, c.where("word <> '0x00000001'"), every, 6)
        assert [r.word for r in gone.collect()] == [1]


def test_coverage_gaps_meet_as_blocks(spark, monkeypatch):
    """Words that meet records as rows take a row of each through an exchange; masks take one for 64."""
    _, _, _, blocks, _, c = world(spark)
    every = spark.range(256).withColumnRenamed("id", "word")
    for few in (1000, 0):
        monkeypatch.setattr(checks, "FEW_KEYS", few)
        gone = checks.coverage_gaps(blocks, c.where("word <> '0x00000001'"), every, 6)
        joins = [x for x in gone._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert len(joins) == 2 and not any("word#" in x for x in joins)
        assert [tuple(r) for r in gone.collect()] == [(0, 1)]
        forms = c.withColumn("word", F.upper(F.regexp_replace("word", "^0x0*", " ")))  # without 0x and zeros, some in upper case
        assert checks.coverage_gaps(blocks, forms, every, 6).isEmpty()
        moved = checks.coverage_gaps(blocks, c.withColumn("shard", F.col("shard") + 1), every, 6)  # a record counts in its shard alone
        assert moved.count() == c.where("category = 'VALIDITY'").select("word").distinct().count() > 1
        assert checks.coverage_gaps(blocks, c.withColumn("word", F.lit("no word")), every, 6).count() == moved.count()


def test_inputs_of_checks_side_by_side_are_made_once():
    from concurrent.futures import ThreadPoolExecutor
    from time import sleep

    from concord.bindings import once

    calls = []
    get = once(lambda: (sleep(0.2), calls.append(1)))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: get(), range(4)))
    assert len(calls) == 1


def test_errors_make_a_shard_incomplete(spark):
    _, long, shards, _, _, _ = world(spark)
    errors = spark.createDataFrame([(1, False), (2, True)], "shard long, triaged boolean")
    got = {r.shard_id: (r.crash_count, r.status) for r in runs.shard_records(long, ALL, shards, errors).collect()}
    assert got == {0: (0, "complete"), 1: (1, "incomplete"), 2: (1, "complete"), 3: (0, "complete")}


def test_a_document_is_parsed_once_for_its_variables_and_once_for_its_keywords(spark):
    docs = spark.createDataFrame([(XML,)], "xml string")
    found = rule_xml.instructions(rule_xml.docvars(rule_xml.parse_rule_xml(docs))).select("_id", "mnemonic", "instr_class")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count('@key="mnemonic"'), plan.count('@key="instr-class"'), plan.count("from_xml(")) == (1, 2, 1)  # one path has both
    assert [tuple(r) for r in found.collect()] == [("SUBS", "SUBS", "general")]
    assert docs.select(rule_xml.not_fully_defined("xml").alias("f"))._jdf.queryExecution().analyzed().toString().count("//pstext") == 1


def test_documents_of_parts_are_made_by_all_cores(spark, small):
    assert bindings.parts(spark, small).count() == bindings.table(spark, small, "part").count()
    many = spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("B#1").alias("p_brand"))
    path = fresh_path(spark, "parts")
    many.coalesce(1).write.parquet(f"{path}/part.parquet")
    docs = bindings.rule_docs(spark, path)
    assert docs.rdd.getNumPartitions() == 4 and docs.count() == 2000


def test_small_shards_share_folders(spark):
    """A folder for 2 ** folder_bits shards; replacing one shard keeps the others of its folder, an empty one goes."""
    path, files = fresh_path(spark, "shared"), lambda p: {f for r in spark.read.parquet(p).select(F.input_file_name().alias("f")).distinct().collect() for f in [r.f]}
    rows = spark.createDataFrame([("a", s, 1 + s, s) for s in range(8)], stored.SCHEMA)
    stored.write_packed(rows, path, folder_bits=2)
    assert len(files(path)) == 2
    stored.write_packed(spark.createDataFrame([("a", 3, 99, 3)], stored.SCHEMA), path, spark.createDataFrame([(2,)], "shard long"), folder_bits=2)
    assert sorted((r.shard, r.bits) for r in stored.read_packed(spark, path).collect()) == [(0, 1), (1, 2), (3, 99), (4, 5), (5, 6), (6, 7), (7, 8)]
    _, long, shards, _, recs, c = world(spark)
    corpus_path, records_path, store = fresh_path(spark, "c"), fresh_path(spark, "r"), fresh_path(spark, "s")
    assert records.write_corpus(c, corpus_path, folder_bits=2) == c.select("shard").distinct().count() and len(files(corpus_path)) == 1
    got = records.read_corpus(spark, corpus_path)
    assert "folder" not in got.columns and sorted((r.word, r.shard) for r in got.collect()) == sorted((r.word, r.shard) for r in c.collect())
    records.write_shard_records(recs, records_path, folder_bits=2)
    assert sorted(r.shard_id for r in records.read_shard_records(spark, records_path, lines=True).collect()) == [0, 1, 2, 3]
    stored.write_packed(long.where("shard <> 1"), store, folder_bits=2)
    fresh = runs.resume(shards, recs, lambda todo: long.join(todo.select("shard"), "shard", "left_semi"), store, ALL, 2)
    assert [r.shard_id for r in fresh.collect()] == [1] and stored.read_packed(spark, store).count() == long.count()


def test_a_word_that_never_ends_is_waited_for_three_times(spark):
    def waiting(words):
        if (words == 777).any():
            time.sleep(3600)
        return words % 2 == 0, None

    started = time.monotonic()
    rows = plugins.udf_source(spark.range(0, 4000, 1, 1).withColumnRenamed("id", "word"), "x", waiting, seconds=1.0).collect()
    assert time.monotonic() - started < 9  # halving waits twelve times
    assert len(rows) == 4000 and [(r.word, r.valid, r.error) for r in rows if r.error] == [(777, False, "TimeoutError: over 1 s")]


def test_sets_of_repeated_words_in_one_exchange(spark):
    v = spark.createDataFrame([(1, True, False), (1, False, True), (2, None, False), (3, True, None), (None, True, True)], "word long, a boolean, b boolean")
    kinds = packed.accepted_kinds(v, ["a", "b"])
    assert kinds._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert sorted(map(str, map(tuple, kinds.collect()))) == sorted(map(str, [("by_all", 1), ("by_some", 1), ("by_none", 2), ("by_some", 3), ("by_all", None), ("by_some", None)]))


def test_region_queries_take_the_rules_of_all_parts_as_they_are(spark, small):
    """Part 0 has an empty mask, which all words match."""
    assert {r.mask for r in bindings.whole_rules(spark, small).collect()} == {r.p_partkey * 37 % 16384 for r in bindings.table(spark, small, "part").collect()}
    assert bindings.QUERIES["a7_ambiguity_groups"](spark, small).first().unallocated == 0
