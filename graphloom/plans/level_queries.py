"""Queries of the whole pipeline and of the levels of interpretation above the typed graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.config import Settings
from graphloom.extract import RuleExtractor, TableExtractor
from graphloom.functions.text import SPACE
from graphloom.ontology import Ontology
from graphloom.operators import abstraction, motifs
from graphloom.plans.graph_queries import Tables, _typed_edges
from graphloom.plans.graph_sql import _BASE, _FATE, _REACH, _blank, _cut
from graphloom.plans.pipeline import Pipeline
from graphloom.util import read


def _run(spark, d):
    t = Tables(spark, d)
    stored = TableExtractor(t.entities, t.relations, t.cast_entities, t.cast_relations)
    return Pipeline(stored, Ontology.from_tables(t.kinds, t.ties), Settings()).run(t.texts().select("doc_id", F.col("source_text").alias("text")))


def pipeline_quarantine(spark, d):
    """Documents that leave the pipeline early, and where."""
    return _run(spark, d).quarantine.select("doc_id", "stage")


def pipeline_runs(spark, d):
    """Documents that come through, with the size of their final graph."""
    r = _run(spark, d)
    return r.runs.select("doc_id", "source_sha256").join(r.final_report.select("doc_id", "node_count", "edge_count", "connected"), "doc_id")


def pipeline_run_metadata(spark, d):
    """The pipeline's table of runs: model and the hashes of source and prompt of every document that comes through. Without SQL, for the prompt is rendered in Python."""
    return _run(spark, d).runs


def run_metadata(spark, d):
    """The pipeline's table of runs without the prompt's hash."""
    return _run(spark, d).runs.select("doc_id", "model", "source_sha256")


def pipeline_rule(spark, d):
    """The pipeline with the rule extractor over the documents: final reports."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    made = Pipeline(RuleExtractor(), Ontology({"thing": {}}, {"links": {}}), Settings(context_policy="disabled")).run(docs)
    return made.final_report.select("doc_id", "node_count", "edge_count", "connected", F.array_join("codes", ",").alias("codes"))


def _labels(t):
    """A label per document: whether it has a water permit."""
    return t.cast_entities.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("ontology_type") == "water_permit").cast("int"), F.lit(0))).cast("string").alias("label"))


def motif_selection(spark, d):
    t = Tables(spark, d)
    found = motifs.select_features(motifs.motif_features(motifs.typed_wedges(_typed_edges(t))), _labels(t), None)
    return found.select("motif", F.round("chi2", 6).alias("chi2"))


def edge_importance(spark, d):
    t = Tables(spark, d)
    edges = _typed_edges(t)
    scores = motifs.motif_features(motifs.typed_wedges(edges)).groupBy("motif").agg(F.countDistinct("doc_id").alias("score"))
    return motifs.edge_importance(edges, scores)


def neighbourhoods(spark, d):
    """Everything within two edges of the first entity of each document."""
    t = Tables(spark, d)
    seeds = t.ids.groupBy("doc_id").agg(F.min_by("entity_id", F.struct("ord", "entity_id")).alias("entity_id"))
    return motifs.neighbourhood(t.links, seeds, 2)


def concept_graph(spark, d):
    """Entities of one ontology type become one node per document."""
    t = Tables(spark, d)
    of = t.cast_entities.where("ontology_type is not null and entity_id is not null").groupBy("doc_id", "entity_id").agg(F.max_by("ontology_type", "ord").alias("concept_id"))
    return abstraction.lift(t.ids, _typed_edges(t), of, 1)[1]


def concept_lineage(spark, d):
    t = Tables(spark, d)
    of = t.cast_entities.where("ontology_type is not null and entity_id is not null").groupBy("doc_id", "entity_id").agg(F.max_by("ontology_type", "ord").alias("concept_id"))
    return abstraction.lift(t.ids, _typed_edges(t), of, 1)[2]


def concept_levels(spark, d):
    """Edges of every level of interpretation: entities, their ontology types, the parents of these, and so on to the roots."""
    t = Tables(spark, d)
    of = t.cast_entities.where("ontology_type is not null and entity_id is not null").groupBy("doc_id", "entity_id").agg(F.max_by("ontology_type", "ord").alias("concept_id"))
    kinds = t.kinds.select(F.col("id").alias("concept_id"), "parent")
    edges = abstraction.levels(t.ids, _typed_edges(t), of, kinds.join(kinds.select(F.col("concept_id").alias("parent")), "parent", "left_semi"))[1]
    return edges.groupBy("level", "doc_id", "source_id", "target_id", "type").agg(F.sum("n_base").alias("n_below"))


def recognised_labels(spark, d):
    """Every embedding with the label whose mean is closest by cosine, labels numbered in order."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(F.col("label").cast("int").alias("concept_id"), F.col("c.m").alias("centroid"))
    return abstraction.recognise(rows.select("vec_id", "embedding"), "embedding", mean).select("vec_id", "concept_id", F.round("similarity", 6).alias("similarity"))


def embedding_concepts(spark, d):
    """Embeddings clustered, and every one assigned to its closest centroid."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    _, centres = abstraction.clusters(rows, "embedding", 10)
    return abstraction.recognise(rows, "embedding", centres).select("vec_id", "concept_id", "similarity")


def label_centroids(spark, d):
    """Every embedding's cosine with the mean of its label."""
    rows = read(spark, d, "embeddings").select("vec_id", "embedding", "label")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("label", F.col("c.m").alias("centre"))
    return rows.join(mean, "label").select("vec_id", "label", F.round(abstraction.cosine(F.col("embedding"), F.col("centre")), 9).alias("similarity"))


def time_split(spark, d):
    t = Tables(spark, d)
    times = read(spark, d, "extraction_requests").select("doc_id", F.col("requested_at").alias("time"))
    return abstraction.split_by_time(_labels(t), times, "2024-07-01")


def blank_texts(spark, d):
    """Documents and requests whose text is null or white space."""
    rows = read(spark, d, "documents").select(F.lit("documents").alias("table_name"), "doc_id", F.col("text").alias("x"))
    rows = rows.union(read(spark, d, "extraction_requests").select(F.lit("extraction_requests"), "doc_id", "source_text")).distinct()
    return rows.where(F.coalesce(F.col("x").rlike(rf"\A{SPACE}*\z"), F.lit(True))).select("table_name", "doc_id")


_LABELS = "labels AS (SELECT doc_id, CAST(max(CAST(coalesce(ontology_type = 'water_permit', false) AS INT)) AS VARCHAR) AS label FROM ce WHERE doc_id IS NOT NULL GROUP BY doc_id),"
_WEDGES = """
wedges AS (
  SELECT x.doc_id, coalesce(x.ontology_type, '') || '>' || coalesce(y.ontology_type, '') AS motif, x.relation_id AS r1, y.relation_id AS r2
  FROM edges x JOIN edges y ON x.doc_id = y.doc_id AND x.target_id = y.source_id AND x.relation_id <> y.relation_id),
"""
_CONCEPTS = """
of AS (SELECT doc_id, entity_id, '1:' || arg_max(ontology_type, ord) AS concept FROM ce WHERE ontology_type IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL)
"""

_STAGES = _BASE + _REACH + _cut(_FATE) + f"""
, blank AS (SELECT doc_id FROM t WHERE {_blank("source_text")}),
bad1 AS (
  SELECT DISTINCT doc_id FROM (SELECT doc_id FROM e GROUP BY doc_id, entity_id HAVING count(*) > 1 UNION SELECT doc_id FROM r GROUP BY doc_id, relation_id HAVING count(*) > 1
  UNION SELECT r.doc_id FROM r ANTI JOIN links ON links.doc_id = r.doc_id AND links.relation_id = r.relation_id) WHERE doc_id IN (SELECT doc_id FROM t) AND doc_id NOT IN (SELECT doc_id FROM blank)),
live AS (SELECT doc_id FROM t WHERE doc_id NOT IN (SELECT doc_id FROM blank) AND doc_id NOT IN (SELECT doc_id FROM bad1)),
ke AS (SELECT doc_id, id FROM fate_e JOIN live USING (doc_id) WHERE retained), kr AS (SELECT doc_id, id FROM fate_r JOIN live USING (doc_id) WHERE retained),
kce AS (SELECT ce.* FROM ce JOIN ke ON ke.doc_id = ce.doc_id AND ke.id = ce.entity_id), kcr AS (SELECT cr.* FROM cr JOIN kr ON kr.doc_id = cr.doc_id AND kr.id = cr.relation_id),
bad2 AS (
  SELECT doc_id FROM ke ANTI JOIN kce ON kce.doc_id = ke.doc_id AND kce.entity_id = ke.id
  UNION SELECT doc_id FROM kr ANTI JOIN kcr ON kcr.doc_id = kr.doc_id AND kcr.relation_id = kr.id
  UNION SELECT doc_id FROM kce GROUP BY doc_id, entity_id HAVING count(*) > 1 UNION SELECT doc_id FROM kcr GROUP BY doc_id, relation_id HAVING count(*) > 1
  UNION SELECT doc_id FROM kce WHERE ontology_type IS NULL OR ontology_type NOT IN (SELECT id FROM ontology_entity_types)
  UNION SELECT doc_id FROM kcr WHERE ontology_type IS NULL OR ontology_type NOT IN (SELECT id FROM ontology_relation_types)
  UNION SELECT kcr.doc_id FROM kcr JOIN r USING (doc_id, relation_id) WHERE kcr.source_id IS DISTINCT FROM r.source_id OR kcr.target_id IS DISTINCT FROM r.target_id),
through AS (SELECT t.doc_id, sha256(source_text) AS source_sha256 FROM t JOIN live USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM bad2))
"""

SQL = {
    "pipeline_runs": _STAGES + """
SELECT doc_id, source_sha256, (SELECT count(*) FROM ke WHERE ke.doc_id = through.doc_id) AS node_count, (SELECT count(*) FROM kr WHERE kr.doc_id = through.doc_id) AS edge_count,
  EXISTS (SELECT 1 FROM ke WHERE ke.doc_id = through.doc_id) AS connected FROM through""",
    "run_metadata": _STAGES + "SELECT doc_id, 'gpt-4o-mini' AS model, source_sha256 FROM through",
    "concept_levels": _BASE + """
own AS (SELECT doc_id, entity_id, arg_max(ontology_type, ord) AS concept FROM ce WHERE ontology_type IS NOT NULL AND entity_id IS NOT NULL GROUP BY ALL),
up AS (
  SELECT id AS base, id AS concept, 1 AS level FROM (SELECT DISTINCT concept AS id FROM own)
  UNION ALL SELECT base, coalesce(k.parent, up.concept), level + 1 FROM up LEFT JOIN ontology_entity_types k ON k.id = up.concept AND k.parent IN (SELECT id FROM ontology_entity_types)
  WHERE level < 1 + (SELECT max(depth) FROM (
    WITH RECURSIVE d AS (SELECT DISTINCT concept AS id, 0 AS depth FROM own UNION ALL SELECT k.parent, depth + 1 FROM d JOIN ontology_entity_types k ON k.id = d.id WHERE k.parent IN (SELECT id FROM ontology_entity_types)) SELECT * FROM d))),
named AS (SELECT own.doc_id, own.entity_id, level, level || ':' || up.concept AS concept FROM own JOIN up ON up.base = own.concept),
lines AS (
  SELECT 0 AS level, doc_id, source_id, target_id, ontology_type AS type FROM edges
  UNION ALL SELECT s.level, x.doc_id, s.concept, g.concept, x.ontology_type FROM edges x JOIN named s ON s.doc_id = x.doc_id AND s.entity_id = x.source_id JOIN named g ON g.doc_id = x.doc_id AND g.entity_id = x.target_id AND g.level = s.level
  WHERE s.concept <> g.concept)
SELECT level, doc_id, source_id, target_id, type, count(*) AS n_below FROM lines GROUP BY ALL""",
    "recognised_labels": """
WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i, label FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL),
s AS (SELECT vec_id, c.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS cos FROM p JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, CAST(label AS INT) AS concept_id, round(cos, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) = 1""",
    "pipeline_quarantine": _STAGES + """
SELECT doc_id, 'input' AS stage FROM blank UNION ALL SELECT doc_id, 'extraction' FROM bad1 UNION ALL SELECT doc_id, 'casting' FROM bad2""",
    "motif_selection": _BASE + _LABELS + _cut(_WEDGES) + """
, pos AS (SELECT DISTINCT w.doc_id, motif, label FROM wedges w JOIN labels USING (doc_id)),
m AS (SELECT motif, count(*) AS m FROM pos GROUP BY ALL), l AS (SELECT label, count(*) AS l FROM labels GROUP BY ALL), n AS (SELECT count(*) AS n FROM labels),
cells AS (SELECT motif, label, m, l, n, (SELECT count(*) FROM pos WHERE pos.motif = m.motif AND pos.label = l.label) AS o FROM m CROSS JOIN l CROSS JOIN n)
SELECT motif, round(sum(power(o - m * l / n, 2) / (m * l / n) + CASE WHEN n > m THEN power(o - m * l / n, 2) / ((n - m) * l / n) ELSE 0 END), 6) AS chi2 FROM cells GROUP BY motif""",
    "edge_importance": _BASE + _cut(_WEDGES) + """
, scores AS (SELECT motif, count(DISTINCT doc_id) AS score FROM wedges GROUP BY motif)
SELECT doc_id, r AS relation_id, CAST(sum(score) AS BIGINT) AS importance FROM (SELECT doc_id, r1 AS r, motif FROM wedges UNION ALL SELECT doc_id, r2, motif FROM wedges) JOIN scores USING (motif) GROUP BY ALL""",
    "neighbourhoods": _cut(_BASE) + """
, two AS (SELECT doc_id, a AS x, b AS y FROM simple WHERE a <> b UNION SELECT doc_id, b, a FROM simple WHERE a <> b),
s AS (SELECT doc_id, arg_min(entity_id, {'ord': ord, 'id': entity_id}) AS seed FROM ids GROUP BY doc_id),
hops AS (
  SELECT doc_id, seed, seed AS entity_id, 0 AS hop FROM s UNION ALL SELECT s.doc_id, seed, y, 1 FROM s JOIN two ON two.doc_id = s.doc_id AND two.x = seed
  UNION ALL SELECT s.doc_id, seed, q.y, 2 FROM s JOIN two p ON p.doc_id = s.doc_id AND p.x = seed JOIN two q ON q.doc_id = p.doc_id AND q.x = p.y)
SELECT doc_id, seed, entity_id, min(hop) AS hop FROM hops GROUP BY ALL""",
    "concept_graph": _BASE + _CONCEPTS + """
SELECT x.doc_id, s.concept AS source_id, g.concept AS target_id, x.ontology_type AS type, count(*) AS n_base
FROM edges x JOIN of s ON s.doc_id = x.doc_id AND s.entity_id = x.source_id JOIN of g ON g.doc_id = x.doc_id AND g.entity_id = x.target_id WHERE s.concept <> g.concept GROUP BY ALL""",
    "concept_lineage": _BASE + _CONCEPTS + "SELECT 1 AS level, doc_id, concept AS concept_id, entity_id AS base_entity_id FROM of SEMI JOIN ids ON ids.doc_id = of.doc_id AND ids.entity_id = of.entity_id",
    "label_centroids": """
WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL)
SELECT vec_id, label, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 9) AS similarity FROM p JOIN c USING (label, i) GROUP BY ALL""",
    "time_split": _BASE + _cut(_LABELS) + """
SELECT doc_id, label, CASE WHEN min(requested_at) < TIMESTAMP '2024-07-01' THEN 'before' ELSE 'after' END AS part FROM labels JOIN extraction_requests USING (doc_id) WHERE requested_at IS NOT NULL GROUP BY ALL""",
    "blank_texts": f"""
SELECT DISTINCT 'documents' AS table_name, doc_id FROM documents WHERE {_blank("text")} UNION ALL SELECT DISTINCT 'extraction_requests', doc_id FROM extraction_requests WHERE {_blank("source_text")}""",
}

QUERIES = {
    "pipeline_quarantine": pipeline_quarantine, "pipeline_runs": pipeline_runs, "pipeline_run_metadata": pipeline_run_metadata, "run_metadata": run_metadata, "concept_levels": concept_levels, "recognised_labels": recognised_labels, "pipeline_rule": pipeline_rule, "motif_selection": motif_selection, "edge_importance": edge_importance,
    "neighbourhoods": neighbourhoods, "concept_graph": concept_graph, "concept_lineage": concept_lineage, "embedding_concepts": embedding_concepts,
    "label_centroids": label_centroids, "time_split": time_split, "blank_texts": blank_texts,
}
