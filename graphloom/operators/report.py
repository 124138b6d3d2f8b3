"""Validation of graphs: connectivity, density and hubs of every document in one report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import Limits
from graphloom.functions.text import degree_limit, fixed3
from graphloom.operators.components import weak_components
from graphloom.operators.graph import degrees, sizes


def component_sizes(components: DataFrame) -> DataFrame:
    """(doc_id, component_id, size)."""
    return components.groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("size"))


def hub_nodes(nodes: DataFrame, edges: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, ord, entity_id, degree) of the nodes over the degree limit. Graphs of at most one node have none."""
    counts = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = degrees(nodes, edges).join(nodes.select("doc_id", "entity_id", "ord"), ["doc_id", "entity_id"]).join(counts, "doc_id")
    return met.where(F.col("degree") > degree_limit(F.col("n"), limits.max_degree_fraction)).select("doc_id", "ord", "entity_id", "degree")


def validation_report(nodes: DataFrame, edges: DataFrame, limits: Limits = Limits(), docs: DataFrame | None = None, components: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """One row per document: the fields of schemas.REPORT, and `codes`, the machine-readable issues.

    nodes(doc_id, ord, entity_id), one row per node; edges(doc_id, source_id, target_id), ends among the nodes. `docs` adds documents
    without any node: such a graph is not connected, and its issue is EMPTY_GRAPH alone. A graph of one node is connected; a self-loop on
    it fails the density check. All hubs are listed, in node order (ord, id); hub_nodes has them as rows.
    """
    base = sizes(nodes, edges, docs)
    parts = (components if components is not None else weak_components(nodes, edges)).select("doc_id", "component_id").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"))
    # one row per node meets its document's size; both the top degree and the hubs come from the same pass
    limit = degree_limit(F.col("node_count"), limits.max_degree_fraction)
    hub = (F.col("node_count") > 1) & (F.col("degree") > limit)
    ranked = degrees(nodes, edges, "ord").join(base.select("doc_id", "node_count"), "doc_id").groupBy("doc_id").agg(
        F.max("degree").alias("top"), F.count(F.when(hub, 1)).alias("hub_count"), F.sort_array(F.collect_list(F.when(hub, F.struct("ord", "entity_id")))).alias("h")
    )
    ranked = ranked.select("doc_id", "top", "hub_count", F.col("h.entity_id").alias("hub_nodes"))
    met = base.join(parts, "doc_id", "left").join(ranked, "doc_id", "left")
    n, m = F.col("node_count"), F.col("edge_count")
    hub_count = F.coalesce("hub_count", F.lit(0)).cast("long")
    met = met.select(
        "doc_id", "node_count", "edge_count", "density", F.coalesce("top", F.lit(0)).cast("long").alias("max_neighbor_count"), hub_count.alias("hub_count"),
        F.coalesce("hub_nodes", F.array().cast("array<string>")).alias("hub_nodes"), F.coalesce(F.col("parts") == 1, F.lit(False)).alias("connected"),
        F.when(n <= 1, m == 0).otherwise(F.col("density") <= limits.max_density).alias("density_ok"), (hub_count <= limits.max_hub_nodes).alias("hubs_ok"),
    )
    met = met.withColumn("sparse", F.col("density_ok")).withColumn("valid", F.col("connected") & F.col("density_ok") & F.col("hubs_ok"))
    connect = F.when(F.col("node_count") == 0, "EMPTY_GRAPH").when(~F.col("connected"), "DISCONNECTED")
    codes = F.array_compact(F.array(connect, F.when(~F.col("density_ok"), "DENSITY"), F.when(~F.col("hubs_ok"), "HUBS")))
    met = met.withColumn("codes", codes)
    if not texts:
        return met
    said = {
        "EMPTY_GRAPH": F.lit("graph has no entities"), "DISCONNECTED": F.lit("graph is disconnected"),
        "DENSITY": F.concat(F.lit("graph density "), fixed3("density"), F.lit(f" exceeds {limits.max_density:.3f}")),
        "HUBS": F.concat(F.lit("graph contains "), F.col("hub_count").cast("string"), F.lit(" hub node(s): "), F.array_join("hub_nodes", ", ")),
    }
    return met.withColumn("issues", F.array_compact(F.array(*(F.when(F.array_contains("codes", c), t) for c, t in said.items()))))
