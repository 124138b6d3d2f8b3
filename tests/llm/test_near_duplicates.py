import random
import re
from itertools import combinations

import numpy as np
import pytest

from graphloom.llm import near_duplicates as nd


def _words(rnd, n):
    return [f"w{rnd.randrange(400)}" for _ in range(n)]


def _corpus():
    rnd = random.Random(9)
    docs, base = {}, _words(rnd, 300)
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 45)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        docs[i] = " ".join(w)
    for i in range(60, 120):
        docs[i] = " ".join(_words(rnd, rnd.randrange(5, 120)))
    for i in range(120, 140):
        docs[i] = docs[3].upper() + "!"
    return docs | {140: "", 141: None, 142: "K" * 30, 143: docs[3] * 40}


def _brute(docs, k, percent, least):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        if len(w) >= max(least, k):
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}, set(sets)


@pytest.mark.parametrize("bucket", [64, 2])  # with 2, most buckets are hot and go through exact prefixes
def test_against_brute_force(spark, bucket):
    docs = _corpus()
    rows = [*docs.items(), (3, docs[3]), (None, docs[3])]
    df = spark.createDataFrame(rows, "doc_id bigint, source_text string").selectExpr("*", "'z' as class_id", "1 as a")
    found = nd.NearDuplicates(df, "doc_id", "source_text", k=3, percent=70, min_words=20, bucket=bucket)
    want, taking_part = _brute(docs, 3, 70, 20)
    assert {tuple(r) for r in found.row_pairs().collect()} == want and len(want) > 100
    groups = found.groups().collect()
    assert {r["doc_id"] for r in groups} == taking_part and len(groups) == len(taking_part)
    links, root = dict.fromkeys(taking_part, 0), {d: d for d in taking_part}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        links[a] += 1
        links[b] += 1
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {r["doc_id"]: (r["group_id"], r["n_links"]) for r in groups} == {d: (find(d), links[d]) for d in taking_part}


def test_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "short")], "doc_id bigint, source_text string")
    found = nd.NearDuplicates(df, "doc_id", "source_text", min_words=20)
    assert found.row_pairs().isEmpty() and found.groups().isEmpty()
    assert nd.NearDuplicates(df.limit(0), "doc_id", "source_text").row_pairs().isEmpty()


def test_signatures_are_unbiased():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(0, 2**63, 260, dtype=np.uint64)
    a, b = np.sort(pool[:230]), np.sort(pool[30:])
    true = 200 / 260
    same = nd.signature(a, 400) == nd.signature(b, 400)
    assert abs(same.mean() - true) < 0.04
    assert abs(same[0::2].mean() - true) < 0.06 and abs(same[1::2].mean() - true) < 0.06
    assert nd.bands_for(0.7, 4) * np.log(1 - 0.7**4) <= np.log(1e-5)
