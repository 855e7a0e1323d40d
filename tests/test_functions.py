import pytest
from pyspark.sql import functions as F

from concord.functions import alias as A
from concord.functions import bits as B
from concord.functions import classify as C
from concord.functions import text as T

NORMALIZED = [
    ("  ADD X0, X1, X2  ", "add x0, x1, x2"),
    ("SUB X0, X1, #0x10", "sub x0, x1, #16"),
    ("ADD X0, X1, X2, LSL #0", "add x0, x1, x2"),
    ("B.HS #16", "b.cs #16"),
    ("B.LO #32", "b.cc #32"),
    ("LDR X0, [X1, #0]", "ldr x0, [x1]"),
    ("RET // return to caller", "ret"),
    ("NOP ; no operation", "nop"),
    ("sub x0, x1, # 32", "sub x0, x1, #32"),
    ("mov sp, x0", "mov sp, x0"),
    ("ldr x0, [x1, #8]", "ldr x0, [x1, #8]"),
    ("add x0, x1, x2, lsl #2", "add x0, x1, x2, lsl #2"),
    ("adr x26, #0xfffffffffff36908", "adr x26, #18446744073708726536"),
    ("mov x0, #-0x0", "mov x0, #0"),
    ("mov x0, #-0x45a3", "mov x0, #-17827"),
    ("b y#0x10", "b y#0x10"),
    ("mov x0, #0x12345678901234567", "mov x0, #20988295476557333863"),
    ("ldr x0, [ x1 , ]", "ldr x0, [x1]"),
    ("", ""),
    (None, None),
]


def test_normalization_pairs(spark):
    rows = spark.createDataFrame([(i, r, e) for i, (r, e) in enumerate(NORMALIZED)], "i int, raw string, expected string")
    for r in T.normalize_text(rows, "raw").collect():
        assert r.normalized == r.expected, r


def test_trace_lists_only_rules_that_changed_the_text(spark):
    rows = spark.createDataFrame([("  ADD   X0,   X31,   #0x10,   LSL #0   // add immediate  ",), ("add x0, x1, x2",), (" ret",)], "raw string")
    got = T.normalize_text(rows, "raw").collect()
    assert got[0].normalized == "add x0, xzr, #16"
    assert got[0].applied_rules == ["strip_comments", "lowercase", "whitespace", "immediates", "zero_registers", "shift_defaults"]
    assert got[1].applied_rules == []
    assert got[2].applied_rules == ["strip_comments"]


ALIASED = [
    ("subs xzr, x0, x1", "cmp x0, x1"),
    ("subs x0, xzr, x1", "negs x0, x1"),
    ("subs xzr, xzr, x1", "cmp xzr, x1"),
    ("ands xzr, x0, x1", "tst x0, x1"),
    ("orn x0, xzr, x1", "mvn x0, x1"),
    ("sub x0, xzr, x1", "neg x0, x1"),
    ("extr w0, w1, w1, #5", "ror w0, w1, #5"),
    ("lslv x0, x1, x2", "lsl x0, x1, x2"),
    ("orr x0, xzr, x1", "orr x0, xzr, x1"),
    ("csinc w0, wzr, wzr, eq", "csinc w0, wzr, wzr, eq"),
    ("ldadd w0, wzr, [x1]", "ldadd w0, wzr, [x1]"),
    ("bfm x0, xzr, #4, #8", "bfm x0, xzr, #4, #8"),
    ("sub xzr", "sub xzr"),
    ("ret", "ret"),
    ("", ""),
    (None, None),
]


def test_alias_pairs(spark):
    rows = spark.createDataFrame(ALIASED, "t string, expected string").withColumn("applied_rules", F.array().cast("array<string>"))
    got = A.apply_aliases(rows, A.compile_alias_rules(A.alias_rules(spark)), "t").collect()
    for r, (raw, _) in zip(got, ALIASED, strict=True):
        assert r.t == r.expected
        assert r.applied_rules == (["spec_alias"] if raw != r.expected else [])


def test_alternatives_empty_conditions_and_chains(spark):
    rules = [("CSX", "CSY", "(Rd == '11111' || Rn == '11111')"), ("CSY", "CSZ", "Rd != '11111'"), ("AAA", "BBB", ""), ("X1", "Y1,", "Unconditionally")]
    rows = spark.createDataFrame([("csx x0, xzr, x2",), ("csx x0, x1, x2",), ("aaa x0",), ("x1 [x0, x1], x2",), ("b.eq x0",)], "t string")
    plain = A.compile_alias_rules(A.alias_rules(spark, rules))
    assert [r.t for r in A.apply_aliases(rows, plain, "t", None).collect()] == ["csz x0, x2", "csx x0, x1, x2", "aaa x0", "y1 [x0, x1], x2", "b.eq x0"]
    parity = A.compile_alias_rules(A.alias_rules(spark, rules), empty_condition="apply")
    assert A.apply_aliases(rows, parity, "t", None).collect()[2].t == "bbb x0"


@pytest.mark.parametrize(
    ("a", "b", "category"),
    [("ret", "RET", None), ("mov w0, w1", "mov w0, w2", "OPERAND"), ("add w0, w1, w2", "sub w0, w1, w2", "NORMALIZATION_UNCERTAIN"), (None, "nop", "VALIDITY")],
)
def test_record_category(spark, a, b, category):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    for s in "ab":
        rows = T.normalize_text(rows, s, f"{s}n", f"{s}r")
    got = rows.select(C.record_category([(F.col("a"), F.col("an")), (F.col("b"), F.col("bn"))]).alias("c")).first().c
    assert got == category


def test_bits_against_python(spark):
    words = [0, 1, 8, 63, 64, 100, 1000, 2**20 - 1, 2**32 - 1]
    rows = spark.createDataFrame([(w,) for w in words], "w long")
    w = F.col("w")
    got = rows.select("w", B.bit_at(w).alias("bit"), B.word_text(w).alias("t"), B.parse_word(B.word_text(w)).alias("p"), B.block_of(w).alias("b"), B.words_in(B.block_of(w), B.bit_at(w)).alias("back")).collect()
    for r in got:
        assert r.bit & (2**64 - 1) == 1 << (r.w % 64)
        assert r.t == f"0x{r.w:08x}" and r.p == r.w and r.b == r.w // 64 and r.back == [r.w]
    bad = spark.createDataFrame([("zz",), ("0x",), ("0xff",), (" 1F ",)], "t string").select(B.parse_word(F.col("t")).alias("p")).collect()
    assert [r.p for r in bad] == [None, None, 255, 31]


def test_last_block_is_masked(spark):
    one = spark.range(3).select(B.existing(F.col("id"), 70).alias("m")).collect()
    assert [r.m for r in one] == [-1, 63, 0]


def test_displays_and_composition(spark):
    rows = spark.createDataFrame([(None, True, " ret ", " "), (None, None, "", ""), ("x", False, "add", " x0 ")], "t string, v boolean, m string, o string")
    got = rows.select(C.shown(F.col("t"), F.col("v")).alias("s"), C.composed_text(F.col("m"), F.col("o")).alias("c")).collect()
    assert [(r.s, r.c) for r in got] == [("valid", "ret"), ("", None), ("x", "add x0")]
