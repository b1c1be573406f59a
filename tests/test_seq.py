import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.functions import aligned, quality, seq

reads = st.lists(st.text("ACGTN", max_size=40), min_size=1, max_size=20)


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", expr.alias("x")).collect())]


def test_reverse_complement_twice_is_the_read(spark):
    values = ["", "A", "ACGTN", "NNAC", None]
    assert column(spark, values, seq.revcomp(seq.revcomp("v"))) == values
    assert column(spark, ["ACGTN"], seq.revcomp("v")) == ["NACGT"]


def test_noise_round_trip(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.text("ACGTN", min_size=12, max_size=12), st.text("ACGTN", min_size=12, max_size=12)), min_size=1, max_size=30))
    def check(rows):
        df = spark.createDataFrame([(a, b) for a, b in rows], "a string, b string")
        out = df.select("a", aligned.apply_noise("b", aligned.noise("a", "b")).alias("x"), seq.apply_noise("b", seq.noise("a", "b")).alias("y"), aligned.cost3("a", "b").alias("c"), seq.bit_cost("a", "b", True).alias("d")).collect()
        assert all(r.a == r.x == r.y and r.c == r.d for r in out)

    check()


def test_noise_of_null_and_empty(spark):
    df = spark.createDataFrame([("", ""), (None, "A"), ("A", None), ("AC", "AG")], "a string, b string")
    got = [r[0] for r in df.select(aligned.noise("a", "b")).collect()]
    assert got[0] == [] and got[1] is None and got[2] is None and [tuple(x) for x in got[3]] == [(1, "2")]
    assert [r[0] for r in df.select(aligned.cost3("a", "b")).collect()] == [0, None, None, 2]


def test_bit_cost_counts_code_bits(spark):
    code = {"A": 0, "C": 1, "G": 2, "T": 3, "N": 4}
    pairs = list(itertools.product(code, repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert {(r[0], r[1]): r[2] for r in df.select("a", "b", aligned.cost3("a", "b")).collect()} == {(a, b): (code[a] ^ code[b]).bit_count() for a, b in pairs}


def test_mate_patterns(spark):
    cases = [("r/1", "r/2", 1), ("same", "same", 2), ("a 1:N", "a 2:N", 3), ("a 1:N b", "a 2:N b", 0), ("a 1 1x", "a 2 2x", 3), ("x", "xy", 0), ("", "", 2), ("a 3", "a 3", 2), ("a1", "b2", 0)]
    df = spark.createDataFrame(cases, "a string, b string, code int")
    for r in df.select("*", seq.mate_pattern("a", "b").alias("got"), seq.mate_id("a", F.col("code")).alias("made")).collect():
        assert r.got == r.code, r
        if r.code:
            assert seq_made(r.a, r.code) == r.made


def seq_made(a, code):
    if code == 2:
        return a
    if code == 1:
        return a[:-1] + "2"
    i = a.index(" ")
    return a[: i + 1] + "2" + a[i + 2 :]


def tokens(text):
    out, i = [], 0
    while i < len(text):
        c, j = text[i], i + 1
        if re.match("[A-Za-z]", c):
            while j < len(text) and re.match("[A-Za-z]", text[j]):
                j += 1
        elif c == "0":
            while j < len(text) and text[j] == "0":
                j += 1
        elif c in "123456789":
            value = int(c)
            while j < len(text) and text[j] in "0123456789" and value < 1 << 28:
                value = value * 10 + int(text[j])
                j += 1
        out.append(text[i:j])
        i = j
    return out


def test_id_tokens(spark):
    cases = ["", "@R1.007 7/1", "268435455999", "268435456999", "2684354561", "99999999999", "12345678901234567890", "abc_00_10é\n1"]
    assert column(spark, cases, seq.id_tokens("v")) == [tokens(c) for c in cases]


def test_zigzag(spark):
    values = [0, 1, -1, 2**62, -(2**62), 63, 64, -64, -65]
    assert column(spark, values, seq.unzigzag(seq.zigzag("v")), "bigint") == values
    assert column(spark, [0, -1, 1, 63, 64, -64, -65], seq.varint_bytes("v"), "bigint") == [1, 1, 1, 1, 2, 1, 2]


def test_quality_binning_is_idempotent_and_closed(spark):
    every = "".join(chr(33 + q) for q in range(60))
    once = column(spark, [every], quality.illumina_bin("v"))[0]
    assert column(spark, [once], quality.illumina_bin("v"))[0] == once
    assert {ord(c) - 33 for c in once} == {0, 6, 15, 22, 27, 33, 37, 40}
    assert column(spark, ["!5I"], quality.threshold("v", 20, 37, 6))[0] == "'FF"


def test_pack4(spark):
    values = ["", "F", "F:,#", "FFFFF", "#" * 9, "bad", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("p", quality.pack4("v"))
    got = [r[0] for r in df.select(quality.unpack4("p.packed", "p.tail")).collect()]
    assert got == values[:5] + [None, None]


def test_kmers_of_short_reads(spark):
    assert column(spark, ["ACG", "AC", ""], seq.kmers("v", 3)) == [["ACG"], [], []]
