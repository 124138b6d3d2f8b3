"""Graph building, components, reports and normalisation on hand-made and random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.config import Limits
from graphloom.errors import RenderError, ValidationFailed
from graphloom.operators import context, dot, graph, motifs, normalize, report
from graphloom.operators.components import star_components, weak_components

E = "doc_id bigint, ord int, entity_id string, mention_text string, free_type string, description string, evidence string, confidence double"
R = "doc_id bigint, ord int, relation_id string, source_id string, target_id string, free_type string, evidence string, confidence double"
CE = "doc_id bigint, ord int, entity_id string, ontology_type string, canonical_name string, attributes map<string,string>, confidence double"
CR = "doc_id bigint, ord int, relation_id string, source_id string, target_id string, ontology_type string, attributes map<string,string>, confidence double"


def entities(spark, graphs):
    return spark.createDataFrame([(d, i, e, f"m{e}", "t", "", "", None) for d, (es, _) in graphs.items() for i, e in enumerate(es)], E)


def relations(spark, graphs):
    return spark.createDataFrame([(d, i, f"r{i}", s, t, "rel", "", None) for d, (_, rs) in graphs.items() for i, (s, t) in enumerate(rs)], R)


CASES = {
    1: ([], []),
    2: (["a"], []),
    3: (["a"], [("a", "a")]),
    4: (["b", "a", "d", "c"], [("b", "a"), ("c", "d")]),
    5: (["a", "b"], [("a", "b"), ("b", "a"), ("a", "b")]),
    6: (list("hxyzuvw"), [("h", x) for x in "xyzuvw"]),
    7: (["a", "b", "c"], [("a", "b")]),
    8: (list("abcdef"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f")]),
}


def _reports(spark, **kw):
    docs = spark.createDataFrame([(d,) for d in CASES], "doc_id bigint")
    n, e = graph.build_nodes(entities(spark, CASES)), graph.build_edges(relations(spark, CASES))
    return {r["doc_id"]: r for r in report.validation_report(n, e, docs=docs, **kw).collect()}


def test_report(spark):
    got = _reports(spark)
    assert got[1]["issues"] == ["graph has no entities"] and not got[1]["connected"] and got[1]["density_ok"]
    assert got[2]["valid"] and got[2]["issues"] == []
    assert got[3]["issues"] == ["graph density 0.000 exceeds 0.400"] and got[3]["connected"] and got[3]["max_neighbor_count"] == 2
    assert got[4]["codes"] == ["DISCONNECTED"] and got[4]["hub_nodes"] == []
    assert got[5]["edge_count"] == 3 and got[5]["density"] == 1.0 and got[5]["issues"] == ["graph density 1.000 exceeds 0.400"]
    assert got[6]["codes"] == ["HUBS"] and got[6]["hub_nodes"] == ["h"] and got[6]["issues"] == ["graph contains 1 hub node(s): h"] and got[6]["sparse"]
    assert got[8]["valid"] and got[8]["density"] == pytest.approx(1 / 3)
    assert _reports(spark, limits=Limits(max_hub_nodes=1))[6]["valid"]


def test_limits_are_checked():
    for bad in ({"max_density": 0}, {"max_density": 1.1}, {"max_degree_fraction": 0}, {"max_hub_nodes": -1}):
        with pytest.raises(ValueError):
            Limits(**bad)


def test_normalize(spark):
    e, r = entities(spark, CASES), relations(spark, CASES)
    parts = weak_components(e, r)
    docs = spark.createDataFrame([(d,) for d in CASES], "doc_id bigint")
    n = normalize.normalize(e, r, parts, docs=docs)
    rep = {x["doc_id"]: x for x in n.report.collect()}
    assert rep[4]["component_count"] == 2 and rep[4]["retained_entities"] == 2 and rep[4]["discarded_relations"] == 1
    assert {x["entity_id"] for x in n.entities.where("doc_id = 4").collect()} == {"a", "b"}  # the tie goes to the least id
    assert rep[7]["note"] == "retained largest weakly connected component with 2 node(s); discarded 1 disconnected entity/entities and 0 relation(s)"
    assert rep[1]["note"] == "could not normalize an empty graph" and rep[1]["component_count"] == 0
    assert rep[8]["note"] is None and rep[8]["retained_entities"] == 6
    lists = {x["doc_id"]: x for x in normalize.id_lists(n.fate_entities, "entity_id").collect()}
    assert lists[4]["retained_ids"] == ["b", "a"] and lists[4]["discarded_ids"] == ["d", "c"]
    kept = normalize.normalize(e, r, parts, "preserve", docs)
    assert kept.entities.count() == e.count() and kept.report.where("note is not null").isEmpty()
    with pytest.raises(ValidationFailed):
        normalize.normalize(e, r, parts, "raise", docs)
    with pytest.raises(ValueError):
        normalize.normalize(e, r, parts, "other")


def test_preserve_keeps_dangling_relations(spark):
    g = {1: (["a", "b", "c"], [("a", "b"), ("a", "nowhere")])}
    e, r = entities(spark, g), relations(spark, g)
    parts = weak_components(e, graph.attached(r, e))
    assert normalize.normalize(e, r, parts, "preserve").relations.count() == 2
    assert normalize.normalize(e, r, parts).relations.count() == 1


def _union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    graphs = {}
    for d in range(40):
        nodes = [f"n{rnd.randrange(1000)}" for _ in range(rnd.randrange(1, 30))]
        nodes = list(dict.fromkeys(nodes))
        graphs[d] = (nodes, [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.randrange(0, 25))])
    graphs[99] = ([f"c{i:03}" for i in range(120)], [(f"c{i:03}", f"c{i + 1:03}") for i in range(119)])  # a long chain
    want = {(d, n, c) for d, (ns, es) in graphs.items() for n, c in _union_find(ns, es).items()}
    e, r = entities(spark, graphs), relations(spark, graphs)
    for limit in (500_000, 15):  # with 15, most documents go through the alternating stars
        got = {tuple(x) for x in weak_components(e, r, limit).collect()}
        assert got == want


def test_components_of_nothing_and_nulls(spark):
    e = spark.createDataFrame([], E)
    r = spark.createDataFrame([(1, 0, "r", None, "a", "t", "", None), (1, 1, "q", "a", "a", "t", "", None)], R)
    assert {tuple(x) for x in weak_components(e, r).collect()} == {(1, "a", "a")}
    assert weak_components(e, r.limit(0)).isEmpty()
    assert star_components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()
    assert {tuple(x) for x in star_components(spark.createDataFrame([(1, 1), (2, None), (5, 3)], "a bigint, b bigint")).collect()} == {(1, 1), (3, 3), (5, 3)}


def test_a_hub_of_many_edges(spark):
    edges = spark.range(3000).select(F.lit(-1).cast("long").alias("a"), F.col("id").alias("b"))
    assert star_components(edges).groupBy("component").count().collect() == [(-1, 3001)]


def test_building_last_one_wins(spark):
    e = spark.createDataFrame([(1, 0, "a", "first", "t", "", "", 0.5), (1, 1, "a", "second", "t", "", "", None), (1, 2, None, "x", "t", "", "", None)], E)
    ce = spark.createDataFrame([(1, 0, "a", "old", "", {"k": "1"}, 0.1), (1, 3, "a", "new", "n", {"k": "2", "j": "3"}, None)], CE)
    (row,) = graph.build_nodes(e, ce).collect()
    assert (row["mention_text"], row["ontology_type"], row["ontology_attributes"]) == ("second", "new", {"k": "2", "j": "3"})
    assert graph.build_nodes(e).columns == ["doc_id", "ord", "entity_id", "mention_text", "free_type", "description", "evidence", "confidence"]
    r = spark.createDataFrame([(1, 0, "r", "a", "b", "x", "", None), (1, 1, "r", "a", "b", "y", "", None), (1, 2, "s", "a", "b", "z", "", None)], R)
    cr = spark.createDataFrame([(1, 0, "r", "a", "b", "links", {}, 0.5)], CR)
    rows = {x["relation_id"]: x for x in graph.build_edges(r, cr).collect()}
    assert rows["r"]["raw_relations"][0]["free_type"] == "y" and rows["r"]["ontology_relations"][0]["ontology_type"] == "links"
    assert rows["s"]["ontology_relations"] == []


def test_dangling(spark):
    e = entities(spark, {1: (["a", "b"], [])})
    r = spark.createDataFrame([(1, 0, "r0", "a", "b", "", "", None), (1, 1, "r1", "x", "x", "", "", None), (1, 2, "r2", None, "y", "", "", None), (2, 0, "r3", "a", "b", "", "", None)], R)
    got = {x["relation_id"]: x["missing"] for x in graph.dangling(r, e).collect()}
    assert got == {"r1": ["x"], "r2": ["", "y"], "r3": ["a", "b"]}
    assert [x["relation_id"] for x in graph.attached(r, e).collect()] == ["r0"]


def _typed(spark):
    e = spark.createDataFrame([(1, 0, "e1", 'al"pha\\', "f", "", "", None), (1, 1, "e2", "be\nta", "", "", "", None)], E)
    r = spark.createDataFrame([(1, 0, "r1", "e1", "e2", "first", "", None), (1, 1, "r2", "e1", "e2", "second", "", None)], R)
    ce = spark.createDataFrame([(1, 0, "e1", "thing", "", {}, None)], CE)
    cr = spark.createDataFrame([(1, 0, "r1", "e1", "e2", "links", {}, None)], CR)
    return graph.build_nodes(e, ce), graph.build_edges(r, cr)


def test_dot(spark):
    n, e = _typed(spark)
    (row,) = dot.dot_texts(dot.dot_lines(n, e)).collect()
    assert row["dot"] == (
        'digraph "DocumentGraph" {\n  rankdir=LR;\n  "e1" [label="thing\\nal\\"pha\\\\", shape=box];\n  "e2" [label="be\\nta", shape=box];\n'
        '  "e1" -> "e2" [color="#555555", label="links"];\n  "e1" -> "e2" [color="#555555", label="second"];\n}\n'
    )
    lines = [r["line"] for r in dot.numbered(dot.dot_lines(n, e, "a\"b", edge_labels=False, directed=False)).orderBy("line_no").collect()]
    assert lines[0] == 'graph "a\\"b" {' and lines[-2] == '  "e1" -- "e2" [color="#555555"];'
    with pytest.raises(RenderError):
        dot.dot_lines(n, e, require_types=True)
    assert [(r["n_lines"] > 3, r["dot"]) for r in dot.dot_texts(dot.dot_lines(n, e), max_lines=3).collect()] == [(True, None)]


def test_unlabeled(spark):
    n, e = _typed(spark)
    assert {tuple(r) for r in graph.unlabeled(n, e).collect()} == {(1, "node", "e2"), (1, "edge", "e1->e2")}


def test_adjacency_and_requests(spark):
    g = {1: (["a", "b", "c"], [("a", "b"), ("b", "b"), ("a", "b")])}
    n, e = graph.build_nodes(entities(spark, g), spark.createDataFrame([], CE)), graph.build_edges(relations(spark, g))
    got = {(r["entity_id"], r["direction"], r["id"]) for r in context.adjacency(n, e).collect()}
    assert got == {("a", "outgoing", "r0"), ("b", "incoming", "r0"), ("b", "incoming", "r1"), ("b", "outgoing", "r1"), ("a", "outgoing", "r2"), ("b", "incoming", "r2")}
    rows = {(r["id"], r["page"]): r for r in context.node_requests(n, e).collect()}
    assert set(rows) == {("a", 0), ("b", 0), ("c", 0)} and [x["id"] for x in rows["b", 0]["incoming_relations"]] == ["r0", "r1", "r2"]
    assert rows["c", 0]["incoming_relations"] == [] and rows["c", 0]["canonical_name"] == ""


@pytest.mark.parametrize("page", [7, 500, 5000])
def test_requests_list_every_relation_of_a_hub(spark, page):
    g = {1: (["hub", "x"], [("hub", "x")] * 1_200 + [("x", "hub")] * 1_100), 2: (["hub", "y"], [("hub", "y")])}
    n, e = graph.build_nodes(entities(spark, g), spark.createDataFrame([], CE)), graph.build_edges(relations(spark, g))
    pages = context.node_requests(n, e, page)
    rows = pages.where("doc_id = 1 and id = 'hub'").orderBy("page").collect()
    assert max(len(r[c]) for r in rows for c in ("incoming_relations", "outgoing_relations")) < 2 * page
    assert [x["id"] for r in rows for x in r["outgoing_relations"]] == [f"r{i}" for i in range(1_200)]
    assert [x["id"] for r in rows for x in r["incoming_relations"]] == [f"r{i}" for i in range(1_200, 2_300)]
    whole = {(r["doc_id"], r["id"]): r for r in context.whole_requests(pages).collect()}
    assert len(whole) == 4 and [x["id"] for x in whole[1, "hub"]["outgoing_relations"]] == [f"r{i}" for i in range(1_200)]


def test_report_names_every_hub(spark):
    n = 1_100
    ids = [f"n{i}" for i in range(n)]
    g = {1: (ids, [(ids[i], ids[(i + k) % n]) for i in range(n) for k in (1, 2)])}
    got = report.validation_report(entities(spark, g), relations(spark, g), Limits(max_degree_fraction=0.001)).first()
    assert got["hub_count"] == n and got["hub_nodes"] == ids
    assert got["issues"][-1] == f"graph contains {n} hub node(s): {', '.join(ids)}"


def test_motifs_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(d, f"r{i}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}", rnd.choice(["x", "y", None])) for d in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, relation_id string, source_id string, target_id string, type string")
    want, by_edge = {}, {}
    for d, i, s, t, a in rows:
        for d2, j, s2, t2, b in rows:
            if d == d2 and t == s2 and i != j:
                k = (d, a or "", b or "")
                want[k] = want.get(k, 0) + 1
                for e in (i, j):
                    by_edge[d, e] = by_edge.get((d, e), 0) + 1
    assert {tuple(r)[:3]: r["n"] for r in motifs.typed_wedges(df).collect()} == want
    ones = motifs.motif_features(motifs.typed_wedges(df)).select("motif", F.lit(1).alias("score")).distinct()
    assert {(r["doc_id"], r["relation_id"]): r["importance"] for r in motifs.edge_importance(df, ones).collect()} == by_edge
    tri = set()
    for d in range(4):
        p = {tuple(sorted((s, t))) for x, _, s, t, _ in rows if x == d and s != t}
        ns = sorted({n for e in p for n in e})
        tri |= {(d, a, b, c) for a in ns for b in ns for c in ns if a < b < c and {(a, b), (b, c), (a, c)} <= p}
    assert {tuple(r) for r in motifs.triangles(df).collect()} == tri
