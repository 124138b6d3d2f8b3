"""Weak connected components: union-find per document, and alternating stars for graphs too large for one task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.util import cut

HELD = 1_000_000  # nodes of the forest that a task contracts its edges to
TASK_ROWS = 500_000  # nodes and edges of one document that one task may hold


def _forest(batches):
    """Edges (u, v) of a task to edges (node, root) of its own forest, roots being least; the forest is sent on when it holds HELD nodes."""
    root: dict = {}
    kind = None

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def plain(column):
        values = column.to_pylist()
        return [tuple(v.values()) for v in values] if pa.types.is_struct(kind) else values

    def out():
        pairs = [(x, find(x)) for x in root]
        sides = zip(*(p for p in pairs if p[0] != p[1])) if any(x != y for x, y in pairs) else ((), ())
        if pa.types.is_struct(kind):
            names = [kind.field(i).name for i in range(kind.num_fields)]
            sides = ([dict(zip(names, v)) for v in side] for side in sides)
        cols = [pa.array(list(side), kind) for side in sides]
        root.clear()
        return pa.RecordBatch.from_arrays(cols, names=["u", "v"])

    for b in batches:
        kind = b.schema[0].type
        for x, y in zip(plain(b.column(0)), plain(b.column(1))):
            root.setdefault(x, x)
            root.setdefault(y, y)
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
        if len(root) > HELD:
            yield out()
    if kind is not None:
        yield out()


def star_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its least node.

    Each task first contracts its own edges to a forest by union-find, which leaves at most one edge per node and task. Then large-star and
    small-star rounds alternate: each node links its neighbours to the least one it knows, until the
    edges form stars. The number of rounds grows with the logarithm of the diameter. Neighbourhoods are reduced to
    their minimum before they are joined back, so a hub costs one row per task. Null ends are left out; an edge from a node to itself
    makes it known. Each round is a written table. An empty table gives no rows.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    own = pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(own.mapInArrow(_forest, own.schema).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def _union_find(table: pa.Table) -> pa.Table:
    """Rows (doc, a, b) of one document, b null for a node: labels each node with the least id it is connected to."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(table.column(1).to_pylist(), table.column(2).to_pylist()):
        root.setdefault(x, x)
        if y is not None:
            root.setdefault(y, y)
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
    doc = table.column(0)[0].as_py()
    return pa.table({"doc_id": pa.array([doc] * len(root), table.schema[0].type), "entity_id": pa.array(list(root), pa.string()), "component_id": pa.array([find(x) for x in root], pa.string())})


def weak_components(nodes: DataFrame, edges: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(doc_id, entity_id, component_id) of nodes(doc_id, entity_id) and edges(doc_id, source_id, target_id), all distinct-checked.

    component_id is the least id (code-point order) of the weak component; direction, parallels and self-loops don't matter.
    Documents of at most `task_rows` rows are folded by union-find, one Arrow batch each; larger ones go through star_components,
    so no document is ever held by one task. Null ids are left out, unknown endpoints become nodes of their own.
    """
    ends = edges.where("source_id is not null and target_id is not null").select("doc_id", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).distinct()
    rows = nodes.where("entity_id is not null").select("doc_id", F.col("entity_id").alias("a"), F.lit(None).cast("string").alias("b")).distinct().unionByName(ends)
    rows = cut(rows.where("doc_id is not null"))  # read for the count and for the fold
    kind = nodes.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, entity_id string, component_id string"
    large = rows.groupBy("doc_id").count().where(F.col("count") > task_rows).select("doc_id")
    if large.isEmpty():
        return rows.groupBy("doc_id").applyInArrow(_union_find, schema)
    large = cut(large)
    folded = rows.join(large, "doc_id", "left_anti").groupBy("doc_id").applyInArrow(_union_find, schema)
    huge = rows.join(large, "doc_id", "left_semi")
    stars = star_components(huge.select(F.struct("doc_id", F.col("a").alias("id")).alias("a"), F.struct("doc_id", F.coalesce("b", "a").alias("id")).alias("b")))
    return folded.unionByName(stars.select(F.col("node.doc_id").alias("doc_id"), F.col("node.id").alias("entity_id"), F.col("component.id").alias("component_id")))
