"""Queries of the graph operators over the whole graph tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import ContextSettings, Density, Limits
from graphloom.extract import requests
from graphloom.functions import text as X
from graphloom.ontology import closure, domain_range_audit, inverse_edges, unknown_types
from graphloom.operators import context, dot, graph, motifs, normalize, report, validate
from graphloom.operators.components import star_components, weak_components
from graphloom.plans.graph_sql import SQL  # noqa: F401
from graphloom.sources import wire
from graphloom.streaming.counts import drained, type_counts
from graphloom.util import cut, read

ENTITY = ("doc_id", "ord", "entity_id", "mention_text", "free_type", "description", "evidence", "confidence")
RELATION = ("doc_id", "ord", "relation_id", "source_id", "target_id", "free_type", "evidence", "confidence")


class Tables:
    """The graph tables of a folder, copies counted once: rows equal in all but their arrival are one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _plain(self, name: str, columns) -> DataFrame:
        return read(self.spark, self.dir, name).select(*columns).distinct()

    def _cast(self, name: str, columns) -> DataFrame:
        """Maps are not grouped by: copies agree in key and position, of which the attributes follow."""
        rows = read(self.spark, self.dir, name).select(*columns, F.array_sort(F.map_entries("attributes")).alias("a"), "confidence").distinct()
        return rows.select(*columns, F.map_from_entries("a").alias("attributes"), "confidence")

    @property
    def entities(self):
        return self._plain("entities", ENTITY)

    @property
    def relations(self):
        return self._plain("relations", RELATION)

    @property
    def cast_entities(self):
        return self._cast("cast_entities", ("doc_id", "ord", "entity_id", "ontology_type", "canonical_name"))

    @property
    def cast_relations(self):
        return self._cast("cast_relations", ("doc_id", "ord", "relation_id", "source_id", "target_id", "ontology_type"))

    @property
    def kinds(self):
        return read(self.spark, self.dir, "ontology_entity_types")

    @property
    def ties(self):
        return read(self.spark, self.dir, "ontology_relation_types")

    @property
    def ids(self):
        """(doc_id, ord, entity_id) of every entity, once per id."""
        return self._plain("entities", ("doc_id", "ord", "entity_id")).groupBy("doc_id", "entity_id").agg(F.max("ord").alias("ord")).select("doc_id", "ord", "entity_id")

    def keyed(self, name: str) -> DataFrame:
        """The columns of a table that its checks ask for: position, keys, ends and type."""
        known = ("doc_id", "ord", "entity_id", "relation_id", "source_id", "target_id", "ontology_type")
        rows = read(self.spark, self.dir, name)
        return rows.select(*(c for c in known if c in rows.columns)).distinct()

    @property
    def links(self):
        """Relations with both ends among the entities."""
        return graph.attached(self._plain("relations", ("doc_id", "ord", "relation_id", "source_id", "target_id")), self.ids)

    def texts(self):
        return read(self.spark, self.dir, "extraction_requests").select("doc_id", "source_text", "entities_per_word", "relations_per_entity").distinct()

    def typed(self) -> tuple[DataFrame, DataFrame]:
        nodes = graph.build_nodes(self.entities, self.cast_entities)
        return nodes, graph.attached(graph.build_edges(self.relations, self.cast_relations), nodes)


def target_counts(spark, d):
    t = Tables(spark, d).texts()
    t = t.select("doc_id", X.word_count(F.col("source_text")).alias("word_count"), "entities_per_word", "relations_per_entity")
    t = t.withColumn("target_entity_count", X.target_entities(F.col("word_count"), F.col("entities_per_word")))
    return t.withColumn("target_relation_count", X.target_relations(F.col("target_entity_count"), F.col("relations_per_entity")))


def source_hash(spark, d):
    return Tables(spark, d).texts().select("doc_id", X.sha256(F.col("source_text")).alias("source_sha256"), X.is_blank(F.col("source_text")).alias("blank"))


def sentence_count(spark, d):
    return Tables(spark, d).texts().select("doc_id", X.sentence_count(F.col("source_text")).alias("n_sentences"), F.coalesce(F.length(X.strip(F.col("source_text"))), F.lit(0)).alias("n_stripped"))


def extraction_issues(spark, d):
    t = Tables(spark, d)
    return validate.extraction_issues(t.keyed("entities"), t.keyed("relations")).select("doc_id", "code", "subject", "detail")


def graph_nodes(spark, d):
    nodes, _ = Tables(spark, d).typed()
    names = F.array_join(F.transform(F.array_sort(F.map_entries("ontology_attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return nodes.withColumn("ontology_attributes", names)


def graph_edges(spark, d):
    _, edges = Tables(spark, d).typed()
    raw, typed = F.col("raw_relations")[0], F.get("ontology_relations", F.lit(0))
    return edges.select("doc_id", "ord", "relation_id", "source_id", "target_id", raw["free_type"].alias("free_type"), F.size("ontology_relations").alias("n_typed"), typed["ontology_type"].alias("ontology_type"), typed["confidence"].alias("typed_confidence"))


def graph_projection(spark, d):
    return graph.projection(Tables(spark, d).links)


def node_degree(spark, d):
    t = Tables(spark, d)
    return graph.degrees(t.ids, t.links)


def graph_density(spark, d):
    t = Tables(spark, d)
    return graph.sizes(t.ids, t.links)


def weak_components_query(spark, d):
    t = Tables(spark, d)
    return weak_components(t.ids, t.links)


def component_sizes(spark, d):
    return report.component_sizes(weak_components_query(spark, d))


def validation_report(spark, d):
    t = Tables(spark, d)
    out = report.validation_report(t.ids, t.links, docs=t.texts().select("doc_id"), texts=False)
    return out.withColumn("codes", F.array_join("codes", ",")).withColumn("hub_nodes", F.array_join("hub_nodes", ","))


def report_texts(spark, d):
    """The messages of the report, with densities to three decimals of their exact binary value."""
    t = Tables(spark, d)
    return report.validation_report(t.ids, t.links, docs=t.texts().select("doc_id")).select("doc_id", F.array_join("issues", "; ").alias("issues"))


def _normalized(spark, d):
    t = Tables(spark, d)
    relations = t._plain("relations", ("doc_id", "ord", "relation_id", "source_id", "target_id"))
    parts = cut(weak_components(t.ids, t.links))
    return normalize.normalize(t.ids, relations, parts, docs=t.texts().select("doc_id")), parts


def largest_component(spark, d):
    return normalize.largest_component(weak_components_query(spark, d))


def normalization_report(spark, d):
    return _normalized(spark, d)[0].report


def retention(spark, d):
    n = _normalized(spark, d)[0]
    e = n.fate_entities.select("doc_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "retained")
    return e.unionByName(n.fate_relations.select("doc_id", F.lit("relation").alias("kind"), F.col("relation_id").alias("id"), "retained"))


def casting_issues(spark, d):
    t = Tables(spark, d)
    found = validate.casting_issues(*(t.keyed(n) for n in ("entities", "relations", "cast_entities", "cast_relations")), t.kinds, t.ties)
    return found.select("doc_id", "code", "subject", "detail")


def unknown_cast_types(spark, d):
    t = Tables(spark, d)
    pairs = (("entity", t.keyed("cast_entities"), t.kinds), ("relation", t.keyed("cast_relations"), t.ties))
    parts = [unknown_types(c, k).select("doc_id", F.lit(n).alias("kind"), F.array_join("unknown", "|").alias("unknown")) for n, c, k in pairs]
    return parts[0].unionByName(parts[1])


def label_completeness(spark, d):
    return graph.unlabeled(*Tables(spark, d).typed())


def relation_rows(spark, d):
    return context.relation_rows(Tables(spark, d).typed()[1])


def node_adjacency(spark, d):
    return context.adjacency(*Tables(spark, d).typed())


def node_requests(spark, d):
    nodes, edges = Tables(spark, d).typed()
    rows = context.node_requests(nodes, cut(edges))  # read for the counts of hubs and for the lists
    return rows.select("doc_id", "id", "raw_mention", "ontology_type", "canonical_name", "page", F.array_join("incoming_relations.id", ",").alias("incoming"), F.array_join("outgoing_relations.id", ",").alias("outgoing"))


def _contexts(t: Tables) -> DataFrame:
    """Descriptions as summaries and evidence phrases as evidence: real text with blanks, nulls and long ones."""
    both = F.array_compact(F.array("evidence", "description", "mention_text"))
    return t.entities.select("doc_id", "ord", "entity_id", F.coalesce("evidence", F.lit("")).alias("summary"), both.alias("evidence"), F.lit(None).cast("string").alias("uncertainty"))


def context_issues(spark, d):
    t = Tables(spark, d)
    settings = ContextSettings(max_sentences=1, max_evidence_items=2)
    some = _contexts(t).where("ord <> 3")
    found = validate.context_issues(some, t.ids, settings)
    return found.select("doc_id", "code", "subject", "detail")


def trimmed_contexts(spark, d):
    t = Tables(spark, d)
    out = context.annotated(t.ids, context.trimmed(_contexts(t), ContextSettings(max_evidence_items=1)))
    return out.select("doc_id", "entity_id", "node_context", F.array_join("node_context_evidence", "|").alias("node_context_evidence"), "node_context_uncertainty")


def dot_lines(spark, d):
    return dot.dot_lines(*Tables(spark, d).typed())


def dot_undirected(spark, d):
    """The lines of every graph as an undirected one without edge labels."""
    return dot.dot_lines(*Tables(spark, d).typed(), name='Graph "1"', edge_labels=False, directed=False)


def strict_limits(spark, d):
    """Reports under other limits: density 0.05, a tenth of the nodes as degree, and two hubs allowed."""
    t = Tables(spark, d)
    out = report.validation_report(t.ids, t.links, Limits(0.05, 0.1, 2), t.texts().select("doc_id"), texts=False)
    return out.select("doc_id", "valid", "density_ok", "hubs_ok", "hub_count")


def preserved(spark, d):
    """What the policy 'preserve' keeps: everything, with the number of components."""
    t = Tables(spark, d)
    relations = t._plain("relations", ("doc_id", "ord", "relation_id", "source_id", "target_id"))
    parts = cut(weak_components(t.ids, t.links))
    out = normalize.normalize(t.ids, relations, parts, "preserve", t.texts().select("doc_id")).report
    return out.select("doc_id", "policy", "component_count", "retained_entities", "retained_relations", "note")


def issue_texts(spark, d):
    """The messages of the extraction and casting checks."""
    t = Tables(spark, d)
    e, r, ce, cr = (t.keyed(n) for n in ("entities", "relations", "cast_entities", "cast_relations"))
    found = validate.extraction_issues(e, r).unionByName(validate.casting_issues(e, r, ce, cr, t.kinds, t.ties))
    return validate.texts(found).where(F.col("code").isin("DUP_ENTITY", "DUP_RELATION", "UNKNOWN_ENDPOINT", "ENDPOINT_CHANGED", "NO_TYPE")).select("doc_id", "code", "text")


def request_payloads(spark, d):
    """The payload of the first pass of every request: its counts, the densities and the text's length as read back from the JSON."""
    made = requests(Tables(spark, d).texts().select("doc_id", F.col("source_text").alias("text")).where("text is not null"), Density())
    got = F.from_json("payload", "source_text string, extraction_density struct<entities_per_word double, relations_per_entity double>, target_counts struct<word_count int, target_entity_count int, target_relation_count int>").alias("p")
    return made.select("doc_id", got).select("doc_id", X.sha256(F.col("p.source_text")).alias("source_sha256"), "p.extraction_density.*", "p.target_counts.*")


def answers(spark, d):
    """Records of the entities table written as an extractor's answer per record, and read back strictly: those with a null or number in a text field are refused."""
    rows = Tables(spark, d).entities.where("entity_id is not null")
    body = F.struct(F.col("entity_id").alias("id"), "mention_text", "free_type", "description", "evidence", "confidence")
    said = F.to_json(F.struct(F.array(body).alias("entities"), F.array().cast("array<string>").alias("relations"), F.lit("").alias("notes")), {"ignoreNullFields": "false"})
    got = wire.parse(rows.select("doc_id", "entity_id", said.alias("said")), "said", "extraction")
    first = F.col("answer.entities")[0]
    return got.select("doc_id", "entity_id", F.col("problem").isNull().alias("accepted"), first["mention_text"].alias("mention_text"), first["evidence"].alias("evidence"), first["confidence"].alias("confidence"))


def event_days(spark, d):
    """Events per day and type as a stream counts them: the table is read as a stream with a watermark, and its windows are written by batches."""
    rows = read(spark, d, "events").select("ts", "event_type")
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(type_counts(stream, "ts", "event_type")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "type", "n")


def ontology_closure(spark, d):
    return closure(Tables(spark, d).kinds)


def domain_range(spark, d):
    t = Tables(spark, d)
    return domain_range_audit(graph.last_per(t.cast_entities.where("entity_id is not null"), "entity_id"), graph.last_per(t.cast_relations.where("relation_id is not null"), "relation_id"), t.kinds, t.ties)


def inverses(spark, d):
    t = Tables(spark, d)
    return inverse_edges(graph.last_per(t.cast_relations.where("relation_id is not null"), "relation_id"), t.ties)


def _typed_edges(t: Tables) -> DataFrame:
    own = graph.last_per(t.cast_relations.where("relation_id is not null"), "relation_id").select("doc_id", "relation_id", F.col("ontology_type").alias("type"))
    return t.links.join(own, ["doc_id", "relation_id"], "left")


def motif_counts(spark, d):
    return motifs.typed_wedges(_typed_edges(Tables(spark, d)))


def triangle_counts(spark, d):
    return motifs.triangles(Tables(spark, d).links).groupBy("doc_id").agg(F.count(F.lit(1)).alias("triangles"))


# The fixture graphs over the star schema.


def star_graph(spark, d, where: str = "true") -> tuple[DataFrame, DataFrame]:
    """One graph per brand: parts and suppliers joined by the line items, all of them or those of a condition."""
    part = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("doc_id"))
    item = read(spark, d, "lineitem").where(where).select("l_partkey", "l_suppkey")
    edges = item.join(part, item.l_partkey == part.p_partkey).select("doc_id", F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"))
    nodes = edges.select("doc_id", F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct().withColumn("ord", F.lit(0))
    return nodes, edges


def star_report(spark, d, where: str = "true"):
    """Reports of the brands' graphs over all line items, after normalisation."""
    nodes, edges = (cut(t) for t in star_graph(spark, d, where))
    kept = normalize.normalize(nodes.select("doc_id", "ord", "entity_id"), edges, cut(weak_components(nodes, edges)))
    out = report.validation_report(cut(kept.entities), cut(kept.relations), texts=False)
    return out.select("doc_id", "valid", "node_count", "edge_count", "density", "max_neighbor_count", "hub_count", F.array_join("codes", ",").alias("codes"))


def star_whole(spark, d, where: str = "true"):
    """Components of all brands in one graph over all line items, by alternating stars."""
    _, edges = star_graph(spark, d, where)
    return star_components(edges, "source_id", "target_id").groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def event_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """One graph per user: event types joined by consecutive events."""
    from pyspark.sql import Window

    e = read(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edges = e.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("source_id"), F.lead("event_type").over(w).alias("target_id")).where("target_id is not null")
    nodes = e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("ord"), F.col("event_type").alias("entity_id")).distinct()
    return nodes, edges


def event_report(spark, d):
    out = report.validation_report(*event_graph(spark, d), texts=False)
    return out.select("doc_id", "connected", "node_count", "edge_count", "density", "max_neighbor_count", "hub_count", F.array_join("codes", ",").alias("codes"))


QUERIES = {
    "target_counts": target_counts, "source_hash": source_hash, "sentence_count": sentence_count, "extraction_issues": extraction_issues,
    "graph_nodes": graph_nodes, "graph_edges": graph_edges, "graph_projection": graph_projection, "node_degree": node_degree, "graph_density": graph_density,
    "weak_components": weak_components_query, "component_sizes": component_sizes, "validation_report": validation_report, "report_texts": report_texts,
    "largest_component": largest_component, "normalization_report": normalization_report, "retention": retention, "casting_issues": casting_issues,
    "unknown_cast_types": unknown_cast_types, "label_completeness": label_completeness, "relation_rows": relation_rows, "node_adjacency": node_adjacency,
    "node_requests": node_requests, "context_issues": context_issues, "trimmed_contexts": trimmed_contexts, "dot_lines": dot_lines,
    "dot_undirected": dot_undirected, "strict_limits": strict_limits, "preserved": preserved, "issue_texts": issue_texts, "request_payloads": request_payloads, "answers": answers, "event_days": event_days,
    "ontology_closure": ontology_closure, "domain_range": domain_range, "inverse_edges": inverses, "motif_counts": motif_counts, "triangle_counts": triangle_counts,
    "star_report": star_report, "star_whole": star_whole, "event_report": event_report,
}
