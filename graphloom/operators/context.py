"""Node contexts: what each node is connected to, the request for an annotator, and the annotated graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import ContextSettings
from graphloom.util import small

PAGE = 1_000  # relations of a node and direction on a page; a page ends with the run of as many positions in which it passes this number


def relation_rows(edges: DataFrame) -> DataFrame:
    """(doc_id, ord, id, source_id, target_id, raw_relation, ontology_relation, evidence); ontology_relation is null where uncast."""
    raw, typed = F.col("raw_relations")[0], F.get("ontology_relations", F.lit(0))
    return edges.select("doc_id", "ord", F.col("relation_id").alias("id"), "source_id", "target_id", raw["free_type"].alias("raw_relation"), typed["ontology_type"].alias("ontology_relation"), raw["evidence"].alias("evidence"))


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, entity_id, direction, ord, id, other_id, relation): every incoming and outgoing relation of every node. A self-loop has both."""
    rows = relation_rows(edges).withColumn("relation", F.coalesce("ontology_relation", "raw_relation"))
    sides = [F.struct(F.lit(d).alias("direction"), F.col(a).alias("entity_id"), F.col(b).alias("other_id")) for d, a, b in (("incoming", "target_id", "source_id"), ("outgoing", "source_id", "target_id"))]
    flat = rows.select("doc_id", "ord", "id", "relation", F.inline(F.array(*sides)))
    return flat.join(nodes.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi").select("doc_id", "entity_id", "direction", "ord", "id", "other_id", "relation")


def node_requests(nodes: DataFrame, edges: DataFrame, page: int = PAGE) -> DataFrame:
    """One row per typed node and page: id, mention, types and its relations as arrays in relation order, [] where there are none.

    Nearly every node has one page, number 0. A hub's relations are counted by runs of `page` positions, and the runs are dealt out to pages in
    order, so no row grows with the hub, none is lost, and no hub is ranked in one task. Positions are those of the document: as a rule each
    is one relation's, so a page holds less than twice `page` of them per direction. whole_requests joins the pages of a node.
    """
    body = ("id", "source_id", "target_id", "raw_relation", "ontology_relation", "evidence")
    sides = [F.struct(F.lit(d).alias("direction"), F.col(end).alias("entity_id")) for d, end in (("incoming", "target_id"), ("outgoing", "source_id"))]
    run = F.floor(F.coalesce("ord", F.lit(0)) / page).alias("run")
    key = ["doc_id", "entity_id", "direction"]
    flat = relation_rows(edges).select("doc_id", "ord", run, F.struct(*body).alias("r"), F.inline(F.array(*sides)))
    counts = edges.select("doc_id", run, F.inline(F.array(*sides))).groupBy(*key, "run").agg(F.count(F.lit(1)).alias("n"))
    hubs = counts.groupBy(*key).agg(F.sum("n").alias("all")).where(F.col("all") > page).select(*key)
    before = F.sum("n").over(Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    later = counts.join(hubs, key, "left_semi").withColumn("page", F.floor(before / page).cast("int")).where("page > 0").select(*key, "run", "page")
    flat = flat.join(small(later, 100_000), [*key, "run"], "left").withColumn("page", F.coalesce("page", F.lit(0)))
    lists = flat.groupBy("doc_id", "entity_id", "page").agg(*(F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.struct("ord", "r")))).alias(d) for d in ("incoming", "outgoing")))
    met = nodes.join(lists, ["doc_id", "entity_id"], "left")
    none = F.array().cast("array<struct<id:string,source_id:string,target_id:string,raw_relation:string,ontology_relation:string,evidence:string>>")
    listed = [F.coalesce(F.col(f"{d}.r"), none).alias(f"{d}_relations") for d in ("incoming", "outgoing")]
    return met.select("doc_id", "ord", F.col("entity_id").alias("id"), F.coalesce("page", F.lit(0)).alias("page"), F.col("mention_text").alias("raw_mention"), F.col("free_type").alias("raw_type"), "ontology_type", F.coalesce("canonical_name", F.lit("")).alias("canonical_name"), *listed)


def whole_requests(pages: DataFrame) -> DataFrame:
    """The requests with all pages of a node in one row, for an annotator that takes a document as one message anyway."""
    lists = ("incoming_relations", "outgoing_relations")
    same = [c for c in pages.columns if c not in ("page", *lists)]
    rows = pages.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("page", *lists))).alias("x"))
    return rows.select(*same, *(F.flatten(f"x.{c}").alias(c) for c in lists))


def trimmed(contexts: DataFrame, settings: ContextSettings = ContextSettings()) -> DataFrame:
    """Contexts as an annotator's answer is taken: evidence cut to the first items or left out, uncertainty null or off as ''."""
    none = F.array().cast("array<string>")
    kept = F.slice(F.coalesce("evidence", none), 1, settings.max_evidence_items) if settings.include_evidence and settings.max_evidence_items else none
    doubt = F.coalesce("uncertainty", F.lit("")) if settings.include_uncertainty else F.lit("")
    return contexts.withColumns({"evidence": kept, "uncertainty": doubt})


def annotated(nodes: DataFrame, contexts: DataFrame) -> DataFrame:
    """Nodes with node_context, node_context_evidence and node_context_uncertainty; null where a node has none."""
    own = contexts.groupBy("doc_id", "entity_id").agg(F.max(F.struct("ord", "summary", "evidence", "uncertainty")).alias("c"))
    met = nodes.join(own, ["doc_id", "entity_id"], "left")
    return met.select(*nodes.columns, F.col("c.summary").alias("node_context"), F.col("c.evidence").alias("node_context_evidence"), F.col("c.uncertainty").alias("node_context_uncertainty"))
