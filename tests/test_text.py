import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as X

PROBES = ["", " ", "a", " a  b ", "one. two! three?", "no end", "x.\u3000y", "\u00a0a\u2003b\u205f", "\x1ca\x1db\x85", "a.b. c", "A.  \n B!\t", "...", "e.g. this", "\u200bzero", "word " * 5000, '"\\\n\r', "\u2028"]


def _sentences(s):
    return len([x for x in re.split(r"(?<=[.!?])\s+", s.strip()) if x])


def _check(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    rows = df.select(c, X.word_count(c).alias("w"), X.sentence_count(c).alias("s"), X.strip(c).alias("p"), X.is_blank(c).alias("b"), X.dot_escape(c).alias("d")).collect()
    for r in rows:
        t = r["t"]
        assert (r["w"], r["s"], r["p"], r["b"]) == (len(t.split()), _sentences(t), t.strip(), not t.strip()), ascii(t)
        assert r["d"] == t.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def test_probes(spark):
    _check(spark, PROBES)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from("ab.!? \n\t\x0b\x1c\x85\u00a0\u1680\u2000\u200a\u2028\u202f\u205f\u3000\u200b"), max_size=12), min_size=1, max_size=30))
def test_like_python(spark, texts):
    _check(spark, texts)


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(X.word_count(F.col("t")), X.sentence_count(F.col("t")), X.is_blank(F.col("t")), X.strip(F.col("t"))).first()
    assert tuple(r) == (0, 0, True, None)


def test_targets_round_half_to_even(spark):
    cases = [(0, 0.1), (1, 0.1), (5, 0.1), (15, 0.1), (25, 0.1), (393, 0.05), (393, 0.1), (10, 0.0), (3, 0.5), (7, 0.5)]
    df = spark.createDataFrame(cases, "w int, d double")
    for r in df.select("w", "d", X.target_entities(F.col("w"), F.col("d")).alias("e"), X.target_relations(F.col("w"), F.col("d")).alias("r")).collect():
        want = round(r["w"] * r["d"])
        assert r["r"] == want
        assert r["e"] == (max(1, want) if r["w"] and r["d"] > 0 else want)


def test_messages(spark):
    df = spark.createDataFrame([(0.0625, "it's", ["a", "b'"]), (0.4005, 'q"', []), (0.6005, "x\n", ["z"]), (None, None, None)], "d double, s string, l array<string>")
    for r in df.select("*", X.fixed3("d").alias("f"), X.quoted("s").alias("q"), X.quoted_list("l").alias("m")).collect():
        assert r["f"] == (None if r["d"] is None else f"{r['d']:.3f}")
        assert r["q"] == (None if r["s"] is None else repr(r["s"]))
        assert r["m"] == (None if r["l"] is None else repr(list(r["l"])))


def test_labels(spark):
    df = spark.createDataFrame([("t", "f", "m", "c", "e1"), (None, "f", "", "c", "e1"), ("", "", None, "", "e1")], "o string, f string, m string, c string, i string")
    got = [r[0] for r in df.select(X.node_label(*map(F.col, "ofmci"))).collect()]
    assert got == ["t\nm", "f\nc", "e1"]
    df = spark.createDataFrame([(["a", "", "b"], ["x"]), (["", None], ["x", "y"]), ([], []), (None, None)], "t array<string>, f array<string>")
    assert [r[0] for r in df.select(X.edge_label(F.col("t"), F.col("f"))).collect()] == ["a, b", "x, y", "", ""]


def test_degree_limit_and_density(spark):
    df = spark.createDataFrame([(n, m) for n in range(0, 8) for m in range(0, 5)], "n long, m long")
    for r in df.select("n", "m", X.graph_density(F.col("m"), F.col("n")).alias("d"), X.degree_limit(F.col("n"), 0.5).alias("k")).collect():
        n, m = r["n"], r["m"]
        assert math.isclose(r["d"], 0.0 if m == 0 or n <= 1 else 2 * m / (n * (n - 1)))
        assert r["k"] == max(2, int(0.5 * (n - 1)))
