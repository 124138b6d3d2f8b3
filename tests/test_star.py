"""The star queries over all line items against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import DATA

from graphloom.plans import graph_queries as q


def _components(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    of = {}
    for start in sorted(near):
        todo = [] if start in of else [start]
        while todo:
            x = todo.pop()
            if x not in of:
                of[x] = start
                todo += near[x]
    return of


def _report(edges):
    """One brand's largest component, of equal ones that of the least id: (valid, nodes, edges, density, top degree, hubs, codes)."""
    of = _components(edges)
    sizes = Counter(of.values())
    best = min(sizes, key=lambda c: (-sizes[c], c))
    kept = [(a, b) for a, b in edges if of[a] == best]
    degree = Counter(x for pair in set(kept) for x in pair)
    n = sizes[best]
    density = len(set(kept)) / (n * (n - 1)) * 2
    hubs = sum(d > max(2, int(0.5 * (n - 1))) for d in degree.values())
    codes = ",".join(c for c, bad in (("DENSITY", density > 0.4), ("HUBS", hubs > 0)) if bad)
    return (not codes, n, len(kept), round(density, 12), max(degree.values()), hubs, codes)


def _check(spark, folder):
    brand = {r["p_partkey"]: r["p_brand"] for r in q.read(spark, folder, "part").collect()}
    items = [(r["l_partkey"], r["l_suppkey"]) for r in q.read(spark, folder, "lineitem").collect()]
    graphs = defaultdict(list)
    for p, s in items:
        graphs[brand[p]].append((f"p{p}", f"s{s}"))
    rows = q.star_report(spark, folder).collect()
    got = {r["doc_id"]: (r["valid"], r["node_count"], r["edge_count"], round(r["density"], 12), r["max_neighbor_count"], r["hub_count"], r["codes"]) for r in rows}
    assert got == {b: _report(e) for b, e in graphs.items()}
    whole = Counter(_components([e for g in graphs.values() for e in g]).values())
    assert {r["component"]: r["size"] for r in q.star_whole(spark, folder).collect()} == dict(whole)


def test_star_of_low_quantities(spark, tmp_path):
    """Line items that the fixture's condition leaves out take part; parallel ones, ties and single pairs too."""
    rnd = random.Random(3)
    parts = [(p, f"Brand#{p % 3}") for p in range(40)]
    items = [(p, s, float(rnd.randrange(1, 51)), rnd.randrange(11) / 100) for p in range(30) for s in rnd.choices(range(25), k=rnd.randrange(1, 3))]
    items += [(37, 90, 1.0, 0.0), (38, 91, 1.0, 0.0), (39, 92, 1.0, 0.0), (39, 92, 2.0, 0.0)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(items, "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    _check(spark, str(tmp_path))


def test_star_over_the_whole_table(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    assert q.star_graph(spark, str(DATA))[1].count() == q.read(spark, str(DATA), "lineitem").count()
    _check(spark, str(DATA))


# Graphs, nodes, edges, components and largest component over the line items of quantity 50 alone.
LOW = (24, 198, 124, 76, 7)


def test_star_of_high_quantities(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    nodes, edges = q.star_graph(spark, str(DATA), "l_quantity >= 50")
    sizes = q.report.component_sizes(q.weak_components(nodes, edges)).collect()
    assert (len({r["doc_id"] for r in sizes}), nodes.count(), edges.count(), len(sizes), max(r["size"] for r in sizes)) == LOW
