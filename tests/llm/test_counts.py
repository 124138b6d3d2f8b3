"""Term frequency, co-occurrence and mixing against brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from graphloom.llm import cooccurrence as co
from graphloom.llm import frequency as fr
from graphloom.llm import mixture as mx


@pytest.mark.parametrize("heavy, salts", [(512, 64), (3, 3), (0, 4000)])
def test_term_frequency(spark, heavy, salts):
    rnd = random.Random(6)
    long = ["L" * 300 + str(i) for i in range(3)]
    rows = []
    for i in range(4000):
        term = rnd.choice(["hot"] * 30 + ["warm"] * 10 + long + [None, "", " ", "a\0b"] + [f"t{rnd.randrange(900)}"] * 20)
        rows.append((rnd.choice([1] * 5 + list(range(2, 40)) + [None]), rnd.choice([f"e{i}"] * 9 + [None]), term))
    rows += rows[:700]  # copies
    df = spark.createDataFrame(rows, "doc_id bigint, entity_id string, free_type string").selectExpr("*", "1 as k", "2 as slot", "3 as n_docs")
    got = {tuple(r) for r in fr.term_frequency(df, "free_type", "entity_id", heavy=heavy, salts=salts).collect()}
    records, docs = defaultdict(set), defaultdict(set)
    for d, e, t in rows:
        if t:
            records[t].add((d, e))
            if d is not None:
                docs[t].add(d)
    assert got == {(t, len(records[t]), len(docs[t])) for t in records}
    both = fr.term_frequencies(df, ["free_type", "entity_id"], "entity_id", heavy=heavy, salts=salts)
    assert {tuple(r)[1:] for r in both.where("field = 'free_type'").collect()} == got
    assert both.where("field = 'entity_id' and n_records < n_docs").isEmpty()


def test_marks_and_empty(spark):
    df = spark.createDataFrame([("a", 10, 5), ("b", 3, 1), ("c", 3, 2), ("d", 1, 0)], "term string, n_records bigint, n_docs bigint")
    assert {r["term"]: r["mark"] for r in fr.marked(df, 50).collect()} == {"a": "common", "b": "rare", "c": "", "d": "rare"}
    assert {r["term"]: r["mark"] for r in fr.marked(df, 10).collect()}["b"] == "common"
    none = spark.createDataFrame([], "doc_id bigint, entity_id string, free_type string")
    assert fr.term_frequency(none, "free_type", "entity_id").isEmpty() and fr.document_count(none) == 0


@pytest.mark.parametrize("held, block", [(500_000, 1000), (20, 3)])  # with 3, most documents are wide
def test_cooccurrence(spark, held, block, monkeypatch):
    monkeypatch.setattr(co, "HELD", held)
    monkeypatch.setattr(co, "BLOCK", block)
    rnd = random.Random(7)
    rows = [(rnd.randrange(80), rnd.choice("abcdefghij" + "ab" * 4)) for _ in range(600)] + [(None, "a"), (1, None), (500, "lone")]
    df = spark.createDataFrame(rows, "doc_id bigint, kind string").selectExpr("*", "0 as item", "0 as d")
    sets = defaultdict(set)
    for d, k in rows:
        if d is not None and k is not None:
            sets[d].add(k)
    one = Counter(k for s in sets.values() for k in s)
    two = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    n = len(sets)

    def llr(a, b, ab):
        table = [[ab, a - ab], [b - ab, n - a - b + ab]]
        return 2 * sum(x * math.log(x * n / (sum(table[i]) * (table[0][j] + table[1][j]))) for i in (0, 1) for j, x in enumerate(table[i]) if x)

    got = {(r["item_a"], r["item_b"]): r for r in co.cooccurrence(df, "doc_id", "kind").collect()}
    assert {k: (r["n_docs"], r["n_a"], r["n_b"], r["n_ab"]) for k, r in got.items()} == {(a, b): (n, one[a], one[b], k) for (a, b), k in two.items()}
    for (a, b), r in got.items():
        assert r["llr"] == pytest.approx(llr(one[a], one[b], two[a, b]), abs=1e-6) and r["lift"] == pytest.approx(two[a, b] * n / (one[a] * one[b]))
    assert co.cooccurrence(df.limit(0), "doc_id", "kind").isEmpty()


def test_least_ratio_drops_no_case(spark):
    rnd = random.Random(12)
    rows = []
    for _ in range(4000):
        n = rnd.choice([10, 300, 30_000])
        a, b = rnd.randrange(1, n), rnd.randrange(1, n)
        ab = rnd.randrange(max(0, a + b - n), min(a, b) + 1)
        if 2 * ab * n >= 3 * a * b and ab:
            table = [[ab, a - ab], [b - ab, n - a - b + ab]]
            rows.append((ab, 2 * sum(x * math.log(x * n / (sum(table[i]) * (table[0][j] + table[1][j]))) for i in (0, 1) for j, x in enumerate(table[i]) if x)))
    df = spark.createDataFrame(rows, "n_ab bigint, llr double")
    assert len(rows) > 500 and df.where(F.col("llr") < co.least_llr(F.col("n_ab"), 1.5)).isEmpty()


def test_pivotal_rounding():
    rnd = random.Random(1)
    hits = Counter()
    for seed in range(3000):
        rows = [(k, s, p) for k, s, p in (("a", 10, 0.2), ("b", 30, 0.7), ("c", 5, 0.5), ("d", 25, 0.9), ("z", 0, 0.4))]
        done, rest = mx.pivotal(rows, seed)
        held = dict(done)
        total = sum(s * held.get(k, 0) for k, s, _ in rows) + (rest[1] * rest[2] if rest else 0)
        assert total == pytest.approx(sum(s * p for _, s, p in rows))
        assert len(done) + (rest is not None) == 5 and held["z"] == 0
        for k, v in done:
            hits[k] += v
        if rest:
            hits[rest[0]] += rest[2]
    for k, p in (("a", 0.2), ("b", 0.7), ("c", 0.5), ("d", 0.9)):
        assert hits[k] / 3000 == pytest.approx(p, abs=0.04)
    assert rnd


TARGETS = "source string, target_share double, max_repeats int"


def test_mixture(spark, monkeypatch):
    monkeypatch.setattr(mx, "PART", 50)
    monkeypatch.setattr(mx, "FAN_IN", 3)
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["big"] * 8 + ["mid"] * 3 + ["tiny", "unlisted", None]), rnd.choice([0, None] + [rnd.randrange(1, 900)] * 8)) for i in range(3000)]
    df = spark.createDataFrame([*rows, *rows[:50], (None, "mid", 5)], "doc_id bigint, source string, n_tokens bigint").selectExpr("*", "1 as key", "1 as part", "2 as copies")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.15, 3), ("absent", 0.05, 2), (None, 0.1, 1), ("big", 0.5, 1), ("void", None, None)], TARGETS)
    m = mx.Mixture(df, targets)
    assert m.levels > 2
    got = m.rows.collect()
    listed = [r for r in rows if r[1] in ("big", "mid", "tiny")]
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in listed)
    repeats = {"big": 1, "mid": 2, "tiny": 3}
    assert all(0 <= r["copies"] <= repeats[r["source"]] for r in got) and all(r["copies"] == 0 for r in got if not r["n_tokens"])
    rep = {r["source"]: r for r in m.report().collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.15)):
        assert rep[s]["actual_share"] == pytest.approx(share / 0.95, rel=0.02)
        assert rep[s]["tokens_used"] == sum((r["n_tokens"] or 0) * r["copies"] for r in got if r["source"] == s)
    assert rep["absent"]["tokens_used"] == 0 and rep["absent"]["actual_share"] == 0
    again = mx.Mixture(df.repartition(7), targets).rows
    assert {(r["doc_id"], r["copies"]) for r in again.collect()} == {(r["doc_id"], r["copies"]) for r in got}
    less = mx.Mixture(df, targets, total=5000.0)
    assert sum(r["tokens_used"] for r in less.report().collect()) == pytest.approx(5000, rel=0.2)


def test_mixture_of_nothing(spark):
    df = spark.createDataFrame([(1, "a", 0)], "doc_id bigint, source string, n_tokens bigint")
    for sizes, targets in ((df.limit(0), [("a", 1.0, 1)]), (df, [("b", 1.0, 1)]), (df, [("a", 1.0, 1)])):
        m = mx.Mixture(sizes, spark.createDataFrame(targets, TARGETS))
        assert m.total == 0 and m.report().first()["tokens_used"] == 0
    assert F is not None
