"""Small typed subgraphs: counts, features per document, their selection, and importance carried back to the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import projection
from graphloom.util import cut

MAX_LABELS = 1_000


def typed_wedges(edges: DataFrame) -> DataFrame:
    """(doc_id, first_type, second_type, n): directed paths a -> b -> c of two edges by their types; a = c counts, an edge with itself doesn't.

    edges(doc_id, source_id, target_id, type). Counted as in-edges times out-edges of each middle node and type pair, so a hub
    costs one row per type, never a row per path. Null types are a type of their own, ''.
    """
    e = edges.where("source_id is not null and target_id is not null").withColumn("type", F.coalesce("type", F.lit("")))
    into = e.groupBy("doc_id", F.col("target_id").alias("node"), F.col("type").alias("first_type")).agg(F.count(F.lit(1)).alias("i"))
    out = e.groupBy("doc_id", F.col("source_id").alias("node"), F.col("type").alias("second_type")).agg(F.count(F.lit(1)).alias("o"))
    both = into.join(out, ["doc_id", "node"]).select("doc_id", "first_type", "second_type", (F.col("i") * F.col("o")).alias("n"))
    loops = e.where("source_id = target_id").groupBy("doc_id", F.col("type").alias("first_type"), F.col("type").alias("second_type")).agg((-F.count(F.lit(1))).alias("n"))
    return both.unionByName(loops).groupBy("doc_id", "first_type", "second_type").agg(F.sum("n").alias("n")).where("n > 0")


def triangles(edges: DataFrame) -> DataFrame:
    """(doc_id, a, b, c): the triangles of the simple projection, each once.

    Edges point from the end of lower degree to that of higher, which bounds the wedges of a node by the square root of twice the edges.
    """
    p = projection(edges).where("a <> b")
    ends = p.select("doc_id", F.explode(F.array("a", "b")).alias("v")).groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("k"))
    x = p.join(ends.withColumnsRenamed({"v": "a", "k": "ka"}), ["doc_id", "a"]).join(ends.withColumnsRenamed({"v": "b", "k": "kb"}), ["doc_id", "b"])
    up = F.struct("ka", "a") < F.struct("kb", "b")
    e = x.select("doc_id", F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"))
    w = e.select("doc_id", "low", F.col("high").alias("x")).join(e.select("doc_id", "low", F.col("high").alias("y")), ["doc_id", "low"]).where("x < y")
    met = w.join(p.select("doc_id", F.col("a").alias("x"), F.col("b").alias("y")), ["doc_id", "x", "y"])
    return met.select("doc_id", F.array_sort(F.array("low", "x", "y")).alias("t")).select("doc_id", *(F.col("t")[i].alias(n) for i, n in enumerate("abc")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(doc_id, seed, entity_id, hop): every node within `hops` edges of a seed, direction aside, at its least distance."""
    p = projection(edges).where("a <> b")
    both = p.select("doc_id", F.col("a").alias("entity_id"), F.col("b").alias("next")).union(p.select("doc_id", "b", "a"))
    out = edge = seeds.select("doc_id", F.col("entity_id").alias("seed"), "entity_id", F.lit(0).alias("hop")).distinct()
    for k in range(1, hops + 1):
        step = edge.join(both, ["doc_id", "entity_id"]).select("doc_id", "seed", F.col("next").alias("entity_id"), F.lit(k).alias("hop")).distinct()
        edge = cut(step.join(out, ["doc_id", "seed", "entity_id"], "left_anti").select("doc_id", "seed", "entity_id", "hop"))
        out = out.unionByName(edge)
    return out


def motif_features(wedges: DataFrame) -> DataFrame:
    """(doc_id, motif, n): typed wedges as named features, in long form, which stays sparse at any number of motifs."""
    return wedges.select("doc_id", F.concat("first_type", F.lit(">"), "second_type").alias("motif"), "n")


def select_features(features: DataFrame, labels: DataFrame, top: int | None = 50) -> DataFrame:
    """(motif, chi2): the motifs whose presence depends most on labels(doc_id, label), by chi-square over the documents with a label; ties by name. Without `top`, all of them."""
    n_docs = labels.where("label is not null").select("doc_id", "label").distinct()
    per_label = n_docs.groupBy("label").agg(F.count(F.lit(1)).alias("l"))
    total = n_docs.count()
    have = features.where("n > 0").join(n_docs, "doc_id").groupBy("motif", "label").agg(F.countDistinct("doc_id").alias("o"))
    motif = have.groupBy("motif").agg(F.sum("o").alias("m"))
    known = per_label.limit(MAX_LABELS + 1).collect()
    if len(known) > MAX_LABELS:
        raise ValueError(f"over {MAX_LABELS} labels")
    # the few labels become an array beside each motif, so motifs without documents of a label have their cell too
    every = F.array(*(F.struct(F.lit(r["label"]).alias("label"), F.lit(r["l"]).alias("l")) for r in known)) if known else F.array().cast("array<struct<label:string,l:bigint>>")
    grid = motif.select("motif", "m", F.inline(every))
    cells = grid.join(have, ["motif", "label"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    e1 = F.col("m") * F.col("l") / total
    e0 = (total - F.col("m")) * F.col("l") / total
    part = F.when(e1 > 0, (F.col("o") - e1) ** 2 / e1).otherwise(0) + F.when(e0 > 0, (F.col("o") - e1) ** 2 / e0).otherwise(0)
    out = cells.groupBy("motif").agg(F.sum(part).alias("chi2"))
    return out if top is None else out.orderBy(F.desc("chi2"), "motif").limit(top)


def edge_importance(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, relation_id, importance): each motif's score carried back to the edges of its occurrences, as summed over the paths through them.

    edges(doc_id, relation_id, source_id, target_id, type); scores(motif, score). An edge a -> b takes part once per edge into a and once per edge
    out of b; these are counted per node and type, so no path is listed.
    """
    e = edges.withColumn("type", F.coalesce("type", F.lit("")))
    into = e.groupBy("doc_id", F.col("target_id").alias("source_id"), F.col("type").alias("other")).agg(F.count(F.lit(1)).alias("k"))
    out = e.groupBy("doc_id", F.col("source_id").alias("target_id"), F.col("type").alias("other")).agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k") - F.when((F.col("source_id") == F.col("target_id")) & (F.col("other") == F.col("type")), 1).otherwise(0)  # a loop doesn't meet itself
    first = e.join(out, ["doc_id", "target_id"]).select("doc_id", "relation_id", F.concat("type", F.lit(">"), "other").alias("motif"), k.alias("k"))
    second = e.join(into, ["doc_id", "source_id"]).select("doc_id", "relation_id", F.concat("other", F.lit(">"), "type").alias("motif"), k.alias("k"))
    return first.union(second).where("k > 0").join(scores, "motif").groupBy("doc_id", "relation_id").agg(F.sum(F.col("k") * F.col("score")).alias("importance"))
