"""Graphs as two tables: nodes and edges of every document, raw or typed, and their undirected simple projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import graph_density, is_blank

ENDS = ("source_id", "target_id")


def last_per(df: DataFrame, key: str) -> DataFrame:
    """One row per document and `key`: the one of the greatest `ord`. Of equal ones the greatest row counts, so the choice is fixed."""
    rest = [c for c in df.columns if c not in ("doc_id", key)]
    maps = {c for c in rest if df.schema[c].dataType.typeName() == "map"}  # maps have no order, their sorted entries do
    row = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rest if c != "ord"]
    best = df.groupBy("doc_id", key).agg(F.max(F.struct("ord", *row)).alias("x"))
    back = [F.map_from_entries(F.col(f"x.{c}")).alias(c) if c in maps else F.col(f"x.{c}").alias(c) for c in rest]
    return best.select("doc_id", key, *back).select(*df.columns)


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, ord, relation_id, missing): relations with an end that is no entity of the document, null ends included.

    missing: the sorted distinct unknown ends; a null end is listed as ''. One join finds both ends' entities.
    """
    ends = relations.select("doc_id", "ord", "relation_id", F.explode(F.array(*ENDS)).alias("entity_id"))
    known = entities.select("doc_id", "entity_id").where("entity_id is not null").distinct()
    lost = ends.join(known, ["doc_id", "entity_id"], "left_anti")
    return lost.groupBy("doc_id", "ord", "relation_id").agg(F.sort_array(F.collect_set(F.coalesce("entity_id", F.lit("")))).alias("missing"))


def attached(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """The relations with both ends among the entities of their document. Null ids match nothing."""
    known = entities.select("doc_id", "entity_id").where("entity_id is not null").distinct()
    for end in ENDS:
        relations = relations.join(known.withColumnRenamed("entity_id", end), ["doc_id", end], "left_semi")
    return relations


def build_nodes(entities: DataFrame, cast_entities: DataFrame | None = None) -> DataFrame:
    """Nodes: the five attributes of each entity, and the typed ones of its casting, null where there is none.

    Of repeated entity ids and of repeated castings the last counts. Null ids are no nodes.
    """
    nodes = last_per(entities.where("entity_id is not null"), "entity_id").select("doc_id", "ord", "entity_id", "mention_text", "free_type", "description", "evidence", "confidence")
    if cast_entities is None:
        return nodes
    typed = last_per(cast_entities.where("entity_id is not null"), "entity_id").select(
        "doc_id", "entity_id", "ontology_type", "canonical_name", F.col("attributes").alias("ontology_attributes"), F.col("confidence").alias("ontology_confidence")
    )
    return nodes.join(typed, ["doc_id", "entity_id"], "left")


def build_edges(relations: DataFrame, cast_relations: DataFrame | None = None) -> DataFrame:
    """Edges, one per relation: raw_relations holds the relation, ontology_relations its casting or nothing.

    Parallel, reverse and self edges all stay. A relation id that comes again on the same ends counts once, the last; on other ends it is
    another edge. Whether the ends exist is asked before, see `dangling` and `attached`.
    """
    keyed = relations.where("relation_id is not null").withColumn("ends", F.struct("source_id", "target_id", "relation_id"))
    rows = last_per(keyed.drop("relation_id", *ENDS), "ends").select("doc_id", "ord", "ends.*", "free_type", "evidence", "confidence")
    raw = F.array(F.struct("relation_id", "free_type", "evidence", "confidence")).alias("raw_relations")
    none = F.array().cast("array<struct<relation_id:string,ontology_type:string,attributes:map<string,string>,confidence:double>>")
    if cast_relations is None:
        return rows.select("doc_id", "ord", "relation_id", *ENDS, raw, none.alias("ontology_relations"))
    typed = last_per(cast_relations.where("relation_id is not null"), "relation_id")
    typed = typed.select("doc_id", "relation_id", F.array(F.struct("relation_id", "ontology_type", "attributes", "confidence")).alias("t"))
    met = rows.join(typed, ["doc_id", "relation_id"], "left")
    return met.select("doc_id", "ord", "relation_id", *ENDS, raw, F.coalesce("t", none).alias("ontology_relations"))


def projection(edges: DataFrame) -> DataFrame:
    """(doc_id, a, b), a <= b: the undirected simple graph; parallels collapse, self-loops stay."""
    return edges.where("source_id is not null and target_id is not null").select("doc_id", F.least(*ENDS).alias("a"), F.greatest(*ENDS).alias("b")).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, entity_id, keep.., degree) in the simple projection; a self-loop adds 2, a node without edges has 0."""
    ends = projection(edges).select("doc_id", F.explode(F.array("a", "b")).alias("entity_id")).groupBy("doc_id", "entity_id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("doc_id", "entity_id", *keep).join(ends, ["doc_id", "entity_id"], "left").select("doc_id", "entity_id", *keep, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def sizes(nodes: DataFrame, edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, node_count, edge_count, simple_edges, density) of every document that has a node or an edge, or of `docs`."""
    n = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("node_count"))
    m = edges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("edge_count"))
    s = projection(edges).groupBy("doc_id").agg(F.count(F.lit(1)).alias("simple_edges"))
    met = n.join(m, "doc_id", "full").join(s, "doc_id", "left")
    if docs is not None:
        met = docs.select("doc_id").distinct().join(met, "doc_id", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("node_count", "edge_count", "simple_edges")]
    return met.select("doc_id", *zero).withColumn("density", graph_density(F.col("simple_edges"), F.col("node_count")))


def unlabeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, kind, subject): nodes without an ontology type and edges whose castings don't cover their relations.

    An edge is complete if its typed list is not empty, holds the same relation ids as the raw list, and no type in it is blank.
    """
    lost = nodes.where(is_blank(F.col("ontology_type"))).select("doc_id", F.lit("node").alias("kind"), F.col("entity_id").alias("subject"))
    raw, typed = F.col("raw_relations.relation_id"), F.col("ontology_relations.relation_id")
    same = (F.size(F.array_except(raw, typed)) == 0) & (F.size(F.array_except(typed, raw)) == 0)
    whole = (F.size("ontology_relations") > 0) & same & ~F.exists("ontology_relations", lambda x: is_blank(x["ontology_type"]))
    open_ = edges.where(~whole).select("doc_id", F.lit("edge").alias("kind"), F.concat("source_id", F.lit("->"), "target_id").alias("subject"))
    return lost.unionByName(open_)
