"""SQL of the graph queries over the same tables."""

from __future__ import annotations

from graphloom.functions.text import _CODES

_WS = "[" + "".join(f"\\x{{{c:x}}}" for c in _CODES) + "]"
_STRIP = f"regexp_replace(source_text, '^{_WS}+|{_WS}+$', '', 'g')"

_BASE = """
WITH RECURSIVE e AS (SELECT DISTINCT doc_id, ord, entity_id, mention_text, free_type, description, evidence, confidence FROM entities),
r AS (SELECT DISTINCT doc_id, ord, relation_id, source_id, target_id, free_type, evidence, confidence FROM relations),
ce AS (SELECT DISTINCT doc_id, ord, entity_id, ontology_type, canonical_name, attributes, confidence FROM cast_entities),
cr AS (SELECT DISTINCT doc_id, ord, relation_id, source_id, target_id, ontology_type, attributes, confidence FROM cast_relations),
t AS (SELECT DISTINCT doc_id, source_text, entities_per_word, relations_per_entity FROM extraction_requests),
ids AS (SELECT doc_id, entity_id, max(ord) AS ord FROM e GROUP BY ALL),
links AS (
  SELECT r.* FROM r WHERE EXISTS (SELECT 1 FROM ids WHERE ids.doc_id = r.doc_id AND ids.entity_id = r.source_id)
  AND EXISTS (SELECT 1 FROM ids WHERE ids.doc_id = r.doc_id AND ids.entity_id = r.target_id)),
lce AS (SELECT * FROM ce WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, entity_id ORDER BY ord DESC) = 1),
lcr AS (SELECT * FROM cr WHERE relation_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, relation_id ORDER BY ord DESC) = 1),
nodes AS (
  SELECT e.*, lce.ontology_type, lce.canonical_name, lce.attributes AS ontology_attributes, lce.confidence AS ontology_confidence
  FROM e LEFT JOIN lce USING (doc_id, entity_id) WHERE e.entity_id IS NOT NULL),
edges AS (
  SELECT links.*, lcr.relation_id AS typed_id, lcr.ontology_type, lcr.confidence AS typed_confidence FROM links LEFT JOIN lcr USING (doc_id, relation_id)),
simple AS (SELECT DISTINCT doc_id, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM links),
degree AS (
  SELECT ids.doc_id, ids.entity_id, count(x.v) AS degree
  FROM ids LEFT JOIN (SELECT doc_id, a AS v FROM simple UNION ALL SELECT doc_id, b FROM simple) x ON x.doc_id = ids.doc_id AND x.v = ids.entity_id GROUP BY ALL),
"""

_REACH = """
both_ways AS (SELECT doc_id, a AS x, b AS y FROM simple UNION SELECT doc_id, b, a FROM simple),
reach AS (
  SELECT doc_id, entity_id AS x, entity_id AS y FROM ids
  UNION SELECT reach.doc_id, reach.x, both_ways.y FROM reach JOIN both_ways ON both_ways.doc_id = reach.doc_id AND both_ways.x = reach.y),
comp AS (SELECT doc_id, x AS entity_id, min(y) AS component_id FROM reach GROUP BY ALL),
csize AS (SELECT doc_id, component_id, count(*) AS size FROM comp GROUP BY ALL),
top AS (
  SELECT doc_id, component_id, size, count(*) OVER (PARTITION BY doc_id) AS component_count FROM csize
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, component_id) = 1),
"""

_SIZES = """
sizes AS (
  SELECT n.doc_id, coalesce(nc, 0)::BIGINT AS node_count, coalesce(ec, 0)::BIGINT AS edge_count, coalesce(sc, 0)::BIGINT AS simple_edges,
    CASE WHEN coalesce(sc, 0) = 0 OR coalesce(nc, 0) <= 1 THEN 0e0 ELSE sc / (nc * (nc - 1))::DOUBLE * 2e0 END AS density
  FROM {docs} n LEFT JOIN (SELECT doc_id, count(*) AS nc FROM ids GROUP BY ALL) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS ec FROM links GROUP BY ALL) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS sc FROM simple GROUP BY ALL) USING (doc_id)),
"""

_REPORT = """
hubs AS (
  SELECT d.doc_id, count(*) AS hub_count, string_agg(d.entity_id, ',' ORDER BY ids.ord, d.entity_id) AS hub_nodes
  FROM degree d JOIN ids USING (doc_id, entity_id) JOIN sizes USING (doc_id)
  WHERE node_count > 1 AND d.degree > greatest(2, trunc(0.5e0 * (node_count - 1))) GROUP BY ALL),
checks AS (
  SELECT s.doc_id, node_count, edge_count, density, coalesce((SELECT max(degree) FROM degree WHERE degree.doc_id = s.doc_id), 0)::BIGINT AS max_neighbor_count,
    coalesce(hub_count, 0)::BIGINT AS hub_count, coalesce(hub_nodes, '') AS hub_nodes,
    coalesce((SELECT count(DISTINCT component_id) FROM comp WHERE comp.doc_id = s.doc_id), 0) = 1 AS connected,
    CASE WHEN node_count <= 1 THEN edge_count = 0 ELSE density <= 0.4e0 END AS density_ok, coalesce(hub_count, 0) = 0 AS hubs_ok
  FROM sizes s LEFT JOIN hubs USING (doc_id)),
report AS (
  SELECT *, density_ok AS sparse, connected AND density_ok AND hubs_ok AS valid,
    concat_ws(',', CASE WHEN node_count = 0 THEN 'EMPTY_GRAPH' WHEN NOT connected THEN 'DISCONNECTED' END, CASE WHEN NOT density_ok THEN 'DENSITY' END, CASE WHEN NOT hubs_ok THEN 'HUBS' END) AS codes
  FROM checks)
"""

_LABEL = """concat_ws(chr(10), coalesce(nullif(ontology_type, ''), nullif(free_type, '')), coalesce(nullif(mention_text, ''), nullif(canonical_name, ''), entity_id))"""


def _esc(x: str) -> str:
    return f"replace(replace(replace({x}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n')"


def _q(x: str) -> str:
    return f"chr(34) || {_esc(x)} || chr(34)"


def _blank(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '{_WS}*'), true)"


_FATE = """
fate_e AS (SELECT ids.doc_id, ids.entity_id AS id, top.component_id IS NOT NULL AS retained FROM ids JOIN comp USING (doc_id, entity_id) LEFT JOIN top ON top.doc_id = comp.doc_id AND top.component_id = comp.component_id),
fate_r AS (
  SELECT r.doc_id, r.relation_id AS id, coalesce(s.retained AND g.retained, false) AS retained
  FROM r LEFT JOIN fate_e s ON s.doc_id = r.doc_id AND s.id = r.source_id LEFT JOIN fate_e g ON g.doc_id = r.doc_id AND g.id = r.target_id),
"""


def _cut(parts: str) -> str:
    return parts.strip().rstrip(",") + "\n"


def _mismatch(own: str, cast: str, key: str, code: str) -> str:
    return f"""
SELECT doc_id, '{code}' AS code, '' AS subject,
  'missing=' || coalesce(string_agg(id, ',' ORDER BY id) FILTER (m IS NULL), '') || '; extra=' || coalesce(string_agg(id, ',' ORDER BY id) FILTER (n IS NULL), '')
  || '; repeated=' || coalesce(string_agg(id, ',' ORDER BY id) FILTER (n IS NOT NULL AND m IS NOT NULL), '') AS detail
FROM (SELECT doc_id, {key} AS id, count(*) AS n FROM {own} WHERE {key} IS NOT NULL GROUP BY ALL)
FULL JOIN (SELECT doc_id, {key} AS id, count(*) AS m FROM {cast} WHERE {key} IS NOT NULL GROUP BY ALL) USING (doc_id, id)
WHERE n IS NULL OR m IS NULL OR n <> m GROUP BY doc_id"""


def _typed(cast: str, key: str, types: str) -> str:
    return f"""
SELECT doc_id, CASE WHEN ontology_type IS NULL THEN 'NO_TYPE' ELSE 'UNKNOWN_TYPE' END AS code, coalesce({key}, '') AS subject, coalesce(ontology_type, '') AS detail
FROM {cast} WHERE ontology_type IS NULL OR ontology_type NOT IN (SELECT id FROM {types})"""


_STAR = """
WITH RECURSIVE links AS (
  SELECT p_brand AS doc_id, 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id FROM lineitem JOIN part ON p_partkey = l_partkey),
ids AS (SELECT DISTINCT doc_id, entity_id, 0 AS ord FROM (SELECT doc_id, source_id AS entity_id FROM links UNION ALL SELECT doc_id, target_id FROM links)),
simple AS (SELECT DISTINCT doc_id, least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM links),
"""

# Components by least labels, one row per node, where all pairs of connected nodes would be too many.
_KEYED = """
both_ways AS (SELECT doc_id, a AS x, b AS y FROM simple UNION SELECT doc_id, b, a FROM simple),
label(doc_id, entity_id, component_id) USING KEY (doc_id, entity_id) AS (
  SELECT doc_id, entity_id, entity_id FROM ids
  UNION SELECT w.doc_id, w.y, min(label.component_id) FROM label JOIN both_ways w ON w.doc_id = label.doc_id AND w.x = label.entity_id
  JOIN recurring.label AS r ON r.doc_id = w.doc_id AND r.entity_id = w.y WHERE label.component_id < r.component_id GROUP BY w.doc_id, w.y),
comp AS (SELECT * FROM label),
csize AS (SELECT doc_id, component_id, count(*) AS size FROM comp GROUP BY ALL),
top AS (
  SELECT doc_id, component_id, size, count(*) OVER (PARTITION BY doc_id) AS component_count FROM csize
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, component_id) = 1),
"""

SQL = {
    "target_counts": f"""
SELECT doc_id, entities_per_word, relations_per_entity, w AS word_count, te AS target_entity_count, CAST(round_even(te * relations_per_entity, 0) AS INT) AS target_relation_count
FROM (SELECT *, CASE WHEN w > 0 AND entities_per_word > 0 THEN greatest(1, CAST(round_even(w * entities_per_word, 0) AS INT)) ELSE CAST(round_even(w * entities_per_word, 0) AS INT) END AS te
  FROM (SELECT DISTINCT doc_id, entities_per_word, relations_per_entity, CAST(len(list_filter(regexp_split_to_array(coalesce(source_text, ''), '{_WS}+'), lambda x: x <> '')) AS INT) AS w FROM extraction_requests))""",
    "source_hash": f"SELECT DISTINCT doc_id, sha256(source_text) AS source_sha256, {_blank('source_text')} AS blank FROM extraction_requests",
    "sentence_count": f"""
SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace({_STRIP}, '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS INT) AS n_sentences, CAST(length({_STRIP}) AS INT) AS n_stripped
FROM (SELECT DISTINCT doc_id, coalesce(source_text, '') AS source_text FROM extraction_requests)""",
    "extraction_issues": _cut(_BASE) + """
SELECT doc_id, 'DUP_ENTITY' AS code, '' AS subject, string_agg(entity_id, ', ' ORDER BY entity_id) AS detail FROM (SELECT doc_id, entity_id FROM e WHERE entity_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id
UNION ALL SELECT doc_id, 'DUP_RELATION', '', string_agg(relation_id, ', ' ORDER BY relation_id) FROM (SELECT doc_id, relation_id FROM r WHERE relation_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id
UNION ALL SELECT doc_id, 'UNKNOWN_ENDPOINT', relation_id, string_agg(DISTINCT coalesce(x, ''), ', ' ORDER BY coalesce(x, ''))
FROM (SELECT doc_id, ord, relation_id, source_id AS x FROM r UNION ALL SELECT doc_id, ord, relation_id, target_id FROM r) y
WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.doc_id = y.doc_id AND ids.entity_id = y.x) GROUP BY doc_id, ord, relation_id""",
    "graph_nodes": _cut(_BASE) + """
SELECT * REPLACE (CASE WHEN ontology_attributes IS NULL THEN NULL ELSE coalesce(array_to_string(list_transform(list_sort(map_entries(ontology_attributes)), lambda x: x.key || '=' || x.value), ';'), '') END AS ontology_attributes) FROM nodes""",
    "graph_edges": _cut(_BASE) + "SELECT doc_id, ord, relation_id, source_id, target_id, free_type, CAST(typed_id IS NOT NULL AS INT) AS n_typed, ontology_type, typed_confidence FROM edges",
    "graph_projection": _cut(_BASE) + "SELECT * FROM simple",
    "node_degree": _cut(_BASE) + "SELECT * FROM degree",
    "graph_density": _BASE + _cut(_SIZES.format(docs="(SELECT DISTINCT doc_id FROM ids UNION SELECT doc_id FROM links)")) + "SELECT * FROM sizes",
    "weak_components": _BASE + _cut(_REACH) + "SELECT * FROM comp",
    "component_sizes": _BASE + _cut(_REACH) + "SELECT * FROM csize",
    "largest_component": _BASE + _cut(_REACH) + "SELECT * FROM top",
    "validation_report": _BASE + _REACH + _SIZES.format(docs="(SELECT DISTINCT doc_id FROM t)") + _REPORT + "SELECT * FROM report",
    "normalization_report": _BASE + _REACH + _FATE + """
counted AS (
  SELECT d.doc_id, coalesce(component_count, 0)::BIGINT AS component_count,
    (SELECT count(*) FROM fate_e f WHERE f.doc_id = d.doc_id AND retained) AS retained_entities, (SELECT count(*) FROM fate_e f WHERE f.doc_id = d.doc_id AND NOT retained) AS discarded_entities,
    (SELECT count(*) FROM fate_r f WHERE f.doc_id = d.doc_id AND retained) AS retained_relations, (SELECT count(*) FROM fate_r f WHERE f.doc_id = d.doc_id AND NOT retained) AS discarded_relations
  FROM (SELECT doc_id FROM t UNION SELECT doc_id FROM e UNION SELECT doc_id FROM r) d LEFT JOIN top USING (doc_id))
SELECT *, 'largest_component' AS policy, CASE WHEN component_count = 0 THEN 'could not normalize an empty graph' WHEN component_count > 1 THEN
    'retained largest weakly connected component with ' || retained_entities || ' node(s); discarded ' || discarded_entities || ' disconnected entity/entities and ' || discarded_relations || ' relation(s)' END AS note
FROM counted""",
    "retention": _BASE + _REACH + _cut(_FATE) + "SELECT doc_id, 'entity' AS kind, id, retained FROM fate_e UNION ALL SELECT doc_id, 'relation', id, retained FROM fate_r",
    "casting_issues": _cut(_BASE) + _mismatch("e", "ce", "entity_id", "CAST_ENTITY_IDS") + " UNION ALL " + _mismatch("r", "cr", "relation_id", "CAST_RELATION_IDS") + " UNION ALL " + _typed("ce", "entity_id", "ontology_entity_types")
    + " UNION ALL " + _typed("cr", "relation_id", "ontology_relation_types") + """
UNION ALL SELECT cr.doc_id, 'ENDPOINT_CHANGED', cr.relation_id, '' FROM cr JOIN r USING (doc_id, relation_id)
WHERE cr.source_id IS DISTINCT FROM r.source_id OR cr.target_id IS DISTINCT FROM r.target_id""",
    "unknown_cast_types": _cut(_BASE) + """
SELECT doc_id, 'entity' AS kind, string_agg(DISTINCT ontology_type, '|' ORDER BY ontology_type) AS unknown FROM ce WHERE ontology_type NOT IN (SELECT id FROM ontology_entity_types) GROUP BY doc_id
UNION ALL SELECT doc_id, 'relation', string_agg(DISTINCT ontology_type, '|' ORDER BY ontology_type) FROM cr WHERE ontology_type NOT IN (SELECT id FROM ontology_relation_types) GROUP BY doc_id""",
    "label_completeness": _cut(_BASE) + f"""
SELECT doc_id, 'node' AS kind, entity_id AS subject FROM nodes WHERE {_blank("ontology_type")}
UNION ALL SELECT doc_id, 'edge', source_id || '->' || target_id FROM edges WHERE typed_id IS NULL OR {_blank("ontology_type")}""",
    "relation_rows": _cut(_BASE) + "SELECT doc_id, ord, relation_id AS id, source_id, target_id, free_type AS raw_relation, ontology_type AS ontology_relation, evidence FROM edges",
    "node_adjacency": _cut(_BASE) + """
SELECT doc_id, target_id AS entity_id, 'incoming' AS direction, ord, relation_id AS id, source_id AS other_id, coalesce(ontology_type, free_type) AS relation FROM edges
UNION ALL SELECT doc_id, source_id, 'outgoing', ord, relation_id, target_id, coalesce(ontology_type, free_type) FROM edges""",
    "node_requests": _cut(_BASE) + """
, sides AS (
  SELECT doc_id, target_id AS entity_id, 'i' AS d, ord, relation_id, ord // 1000 AS run FROM edges UNION ALL SELECT doc_id, source_id, 'o', ord, relation_id, ord // 1000 FROM edges),
runs AS (SELECT doc_id, entity_id, d, run, count(*) AS n FROM sides GROUP BY ALL),
pages AS (
  SELECT doc_id, entity_id, d, run, CASE WHEN sum(n) OVER (PARTITION BY doc_id, entity_id, d) <= 1000 THEN 0
    ELSE coalesce(sum(n) OVER (PARTITION BY doc_id, entity_id, d ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 END AS page FROM runs),
lists AS (
  SELECT doc_id, entity_id, page, string_agg(relation_id, ',' ORDER BY ord, relation_id) FILTER (d = 'i') AS i, string_agg(relation_id, ',' ORDER BY ord, relation_id) FILTER (d = 'o') AS o
  FROM sides JOIN pages USING (doc_id, entity_id, d, run) GROUP BY ALL)
SELECT doc_id, entity_id AS id, mention_text AS raw_mention, ontology_type, coalesce(canonical_name, '') AS canonical_name, CAST(coalesce(page, 0) AS INT) AS page, coalesce(i, '') AS incoming, coalesce(o, '') AS outgoing
FROM nodes LEFT JOIN lists USING (doc_id, entity_id)""",
    "context_issues": _cut(_BASE) + f"""
, c AS (SELECT doc_id, ord, entity_id, coalesce(evidence, '') AS summary, CAST(evidence IS NOT NULL AS INT) + CAST(description IS NOT NULL AS INT) + CAST(mention_text IS NOT NULL AS INT) AS items FROM e WHERE ord <> 3),
coded AS (
  SELECT c.*, CASE WHEN c.ord > (SELECT min(ord) FROM c d WHERE d.doc_id = c.doc_id AND d.entity_id = c.entity_id) THEN 'CTX_DUP' WHEN {_blank("summary")} THEN 'CTX_EMPTY'
    WHEN len(list_filter(string_split(regexp_replace(regexp_replace(summary, '^{_WS}+|{_WS}+$', '', 'g'), '([.!?]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) > 1 THEN 'CTX_SENTENCES' WHEN items > 2 THEN 'CTX_EVIDENCE_MANY' END AS code FROM c)
SELECT doc_id, code, coalesce(entity_id, '') AS subject, '' AS detail FROM coded WHERE code IS NOT NULL
UNION ALL SELECT doc_id, 'CTX_MISSING', '', string_agg(entity_id, ', ' ORDER BY ord, entity_id) FROM ids WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = ids.doc_id AND c.entity_id = ids.entity_id) GROUP BY doc_id""",
    "trimmed_contexts": _cut(_BASE) + """
SELECT doc_id, entity_id, coalesce(evidence, '') AS node_context, coalesce(evidence, description, mention_text, '') AS node_context_evidence, '' AS node_context_uncertainty FROM e""",
    "dot_lines": _cut(_BASE) + f"""
SELECT DISTINCT doc_id, 0 AS section, '' AS k1, '' AS k2, '' AS k3, 'digraph "DocumentGraph" {{' AS line FROM ids
UNION ALL SELECT DISTINCT doc_id, 1, '', '', '', '  rankdir=LR;' FROM ids UNION ALL SELECT DISTINCT doc_id, 4, '', '', '', '}}' FROM ids
UNION ALL SELECT doc_id, 2, entity_id, '', '', '  ' || {_q("entity_id")} || ' [label=' || {_q(_LABEL)} || ', shape=box];' FROM nodes
UNION ALL SELECT doc_id, 3, source_id, target_id, lab, '  ' || {_q("source_id")} || ' -> ' || {_q("target_id")} || ' [color="#555555"' || CASE WHEN lab <> '' THEN ', label=' || {_q("lab")} ELSE '' END || '];'
FROM (SELECT *, coalesce(nullif(ontology_type, ''), free_type, '') AS lab FROM edges)""",
    "dot_undirected": _cut(_BASE) + f"""
SELECT DISTINCT doc_id, 0 AS section, '' AS k1, '' AS k2, '' AS k3, 'graph "Graph \\"1\\"" {{' AS line FROM ids
UNION ALL SELECT DISTINCT doc_id, 1, '', '', '', '  rankdir=LR;' FROM ids UNION ALL SELECT DISTINCT doc_id, 4, '', '', '', '}}' FROM ids
UNION ALL SELECT doc_id, 2, entity_id, '', '', '  ' || {_q("entity_id")} || ' [label=' || {_q(_LABEL)} || ', shape=box];' FROM nodes
UNION ALL SELECT doc_id, 3, source_id, target_id, coalesce(nullif(ontology_type, ''), free_type, ''), '  ' || {_q("source_id")} || ' -- ' || {_q("target_id")} || ' [color="#555555"];' FROM edges""",
    "strict_limits": _BASE + _SIZES.format(docs="(SELECT DISTINCT doc_id FROM t)") + """
hubs AS (SELECT d.doc_id, count(*) AS n FROM degree d JOIN sizes USING (doc_id) WHERE node_count > 1 AND degree > greatest(2, trunc(0.1e0 * (node_count - 1))) GROUP BY ALL),
comp AS (SELECT doc_id, x AS entity_id, min(y) AS component FROM (
  WITH RECURSIVE w AS (SELECT doc_id, a AS x, b AS y FROM simple UNION SELECT doc_id, b, a FROM simple),
  reach AS (SELECT doc_id, entity_id AS x, entity_id AS y FROM ids UNION SELECT reach.doc_id, reach.x, w.y FROM reach JOIN w ON w.doc_id = reach.doc_id AND w.x = reach.y) SELECT * FROM reach) GROUP BY ALL),
checks AS (
  SELECT doc_id, CASE WHEN node_count <= 1 THEN edge_count = 0 ELSE density <= 0.05e0 END AS density_ok, coalesce(hubs.n, 0) <= 2 AS hubs_ok, coalesce(hubs.n, 0)::BIGINT AS hub_count,
    coalesce((SELECT count(DISTINCT component) FROM comp WHERE comp.doc_id = sizes.doc_id), 0) = 1 AS connected FROM sizes LEFT JOIN hubs USING (doc_id))
SELECT doc_id, connected AND density_ok AND hubs_ok AS valid, density_ok, hubs_ok, hub_count FROM checks""",
    "preserved": _BASE + _cut(_REACH) + """
SELECT doc_id, 'preserve' AS policy, coalesce(component_count, 0)::BIGINT AS component_count, (SELECT count(*) FROM ids WHERE ids.doc_id = d.doc_id) AS retained_entities,
  (SELECT count(*) FROM (SELECT DISTINCT doc_id, ord, relation_id, source_id, target_id FROM r) x WHERE x.doc_id = d.doc_id) AS retained_relations, CAST(NULL AS VARCHAR) AS note
FROM (SELECT doc_id FROM t UNION SELECT doc_id FROM ids UNION SELECT doc_id FROM r) d LEFT JOIN top USING (doc_id)""",
    "issue_texts": _cut(_BASE) + """
SELECT doc_id, 'DUP_ENTITY' AS code, 'duplicate entity ids: ' || string_agg(entity_id, ', ' ORDER BY entity_id) AS text FROM (SELECT doc_id, entity_id FROM e WHERE entity_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id
UNION ALL SELECT doc_id, 'DUP_RELATION', 'duplicate relation ids: ' || string_agg(relation_id, ', ' ORDER BY relation_id) FROM (SELECT doc_id, relation_id FROM r WHERE relation_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id
UNION ALL SELECT doc_id, 'UNKNOWN_ENDPOINT', 'relation ''' || relation_id || ''' references unknown endpoint(s): ' || string_agg(DISTINCT coalesce(x, ''), ', ' ORDER BY coalesce(x, ''))
FROM (SELECT doc_id, ord, relation_id, source_id AS x FROM r UNION ALL SELECT doc_id, ord, relation_id, target_id FROM r) y
WHERE NOT EXISTS (SELECT 1 FROM ids WHERE ids.doc_id = y.doc_id AND ids.entity_id = y.x) GROUP BY doc_id, ord, relation_id
UNION ALL SELECT cr.doc_id, 'ENDPOINT_CHANGED', 'relation ''' || cr.relation_id || ''' changed endpoints during casting' FROM cr JOIN r USING (doc_id, relation_id)
WHERE cr.source_id IS DISTINCT FROM r.source_id OR cr.target_id IS DISTINCT FROM r.target_id
UNION ALL SELECT doc_id, 'NO_TYPE', 'entity ''' || coalesce(entity_id, '') || ''' has no ontology type' FROM ce WHERE ontology_type IS NULL
UNION ALL SELECT doc_id, 'NO_TYPE', 'relation ''' || coalesce(relation_id, '') || ''' has no ontology type' FROM cr WHERE ontology_type IS NULL""",
    "request_payloads": f"""
SELECT doc_id, sha256(source_text) AS source_sha256, 0.1e0 AS entities_per_word, 2e0 AS relations_per_entity, w AS word_count, te AS target_entity_count, te * 2 AS target_relation_count
FROM (SELECT *, CASE WHEN w > 0 THEN greatest(1, CAST(round_even(w * 0.1e0, 0) AS INT)) ELSE 0 END AS te
  FROM (SELECT DISTINCT doc_id, source_text, CAST(len(list_filter(regexp_split_to_array(source_text, '{_WS}+'), lambda x: x <> '')) AS INT) AS w FROM extraction_requests WHERE source_text IS NOT NULL))""",
    "answers": _cut(_BASE) + """
SELECT doc_id, entity_id, ok AS accepted, CASE WHEN ok THEN mention_text END AS mention_text, CASE WHEN ok THEN evidence END AS evidence, CASE WHEN ok THEN confidence END AS confidence
FROM (SELECT *, mention_text IS NOT NULL AND free_type IS NOT NULL AND description IS NOT NULL AND evidence IS NOT NULL AS ok FROM e WHERE entity_id IS NOT NULL)""",
    "event_days": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "report_texts": _BASE + _REACH + _SIZES.format(docs="(SELECT DISTINCT doc_id FROM t)") + _REPORT + """
SELECT doc_id, concat_ws('; ', CASE WHEN node_count = 0 THEN 'graph has no entities' WHEN NOT connected THEN 'graph is disconnected' END,
  CASE WHEN NOT density_ok THEN 'graph density ' || printf('%.3f', density) || ' exceeds 0.400' END,
  CASE WHEN NOT hubs_ok THEN 'graph contains ' || hub_count || ' hub node(s): ' || replace(hub_nodes, ',', ', ') END) AS issues FROM report""",
    "ontology_closure": """
WITH RECURSIVE up AS (
  SELECT id, id AS ancestor, 0 AS depth FROM ontology_entity_types
  UNION ALL SELECT up.id, t.parent, up.depth + 1 FROM up JOIN ontology_entity_types t ON t.id = up.ancestor WHERE t.parent IN (SELECT id FROM ontology_entity_types))
SELECT * FROM up""",
    "domain_range": _cut(_BASE) + """
, up AS (
  SELECT id, id AS ancestor FROM ontology_entity_types
  UNION ALL SELECT up.id, k.parent FROM up JOIN ontology_entity_types k ON k.id = up.ancestor WHERE k.parent IS NOT NULL)
SELECT c.doc_id, c.relation_id, c.ontology_type, k.domain_id IS NULL OR EXISTS (SELECT 1 FROM up WHERE up.id = s.ontology_type AND up.ancestor = k.domain_id) AS domain_ok,
  k.range_id IS NULL OR EXISTS (SELECT 1 FROM up WHERE up.id = g.ontology_type AND up.ancestor = k.range_id) AS range_ok
FROM lcr c JOIN ontology_relation_types k ON k.id = c.ontology_type JOIN lce s ON s.doc_id = c.doc_id AND s.entity_id = c.source_id AND s.ontology_type IS NOT NULL
JOIN lce g ON g.doc_id = c.doc_id AND g.entity_id = c.target_id AND g.ontology_type IS NOT NULL""",
    "inverse_edges": _cut(_BASE) + "SELECT doc_id, relation_id || '~inverse' AS relation_id, target_id AS source_id, source_id AS target_id, k.inverse AS ontology_type FROM lcr JOIN ontology_relation_types k ON k.id = ontology_type WHERE k.inverse IS NOT NULL",
    "motif_counts": _cut(_BASE) + """
SELECT x.doc_id, coalesce(x.ontology_type, '') AS first_type, coalesce(y.ontology_type, '') AS second_type, count(*) AS n
FROM edges x JOIN edges y ON x.doc_id = y.doc_id AND x.target_id = y.source_id AND x.relation_id <> y.relation_id GROUP BY ALL""",
    "triangle_counts": _cut(_BASE) + """
SELECT x.doc_id, count(*) AS triangles FROM simple x JOIN simple y ON x.doc_id = y.doc_id AND x.b = y.a AND y.a < y.b JOIN simple z ON z.doc_id = x.doc_id AND z.a = x.a AND z.b = y.b
WHERE x.a < x.b GROUP BY x.doc_id""",
    "star_report": _STAR + _KEYED + """
kept AS (SELECT c.doc_id, c.entity_id FROM comp c JOIN top USING (doc_id, component_id)),
klinks AS (SELECT l.* FROM links l JOIN kept k ON k.doc_id = l.doc_id AND k.entity_id = l.source_id),
ksimple AS (SELECT s.* FROM simple s JOIN kept k ON k.doc_id = s.doc_id AND k.entity_id = s.a),
kdeg AS (SELECT doc_id, v, count(*) AS degree FROM (SELECT doc_id, a AS v FROM ksimple UNION ALL SELECT doc_id, b FROM ksimple) GROUP BY ALL),
size AS (
  SELECT doc_id, (SELECT count(*) FROM kept k WHERE k.doc_id = top.doc_id) AS node_count, (SELECT count(*) FROM klinks k WHERE k.doc_id = top.doc_id) AS edge_count,
    (SELECT count(*) FROM ksimple k WHERE k.doc_id = top.doc_id) AS m, (SELECT max(degree) FROM kdeg k WHERE k.doc_id = top.doc_id) AS max_neighbor_count FROM top),
full_ AS (SELECT *, m / (node_count * (node_count - 1))::DOUBLE * 2e0 AS density,
    (SELECT count(*) FROM kdeg k WHERE k.doc_id = size.doc_id AND degree > greatest(2, trunc(0.5e0 * (node_count - 1)))) AS hub_count FROM size)
SELECT doc_id, density <= 0.4e0 AND hub_count = 0 AS valid, node_count, edge_count, density, max_neighbor_count, hub_count,
  concat_ws(',', CASE WHEN density > 0.4e0 THEN 'DENSITY' END, CASE WHEN hub_count > 0 THEN 'HUBS' END) AS codes FROM full_""",
    "star_whole": """
WITH RECURSIVE l AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN part ON p_partkey = l_partkey),
w AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
comp(x, label) USING KEY (x) AS (
  SELECT DISTINCT x, x FROM w
  UNION SELECT w.y, min(comp.label) FROM comp JOIN w ON w.x = comp.x JOIN recurring.comp AS r ON r.x = w.y WHERE comp.label < r.label GROUP BY w.y)
SELECT label AS component, count(*) AS size FROM comp GROUP BY ALL""",
    "event_report": """
WITH l AS (SELECT user_id AS doc_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
n AS (SELECT user_id AS doc_id, count(DISTINCT event_type) AS node_count FROM events GROUP BY ALL),
m AS (SELECT doc_id, count(*) AS edge_count FROM l WHERE t IS NOT NULL GROUP BY ALL),
p AS (SELECT DISTINCT doc_id, least(s, t) AS a, greatest(s, t) AS b FROM l WHERE t IS NOT NULL),
d AS (SELECT doc_id, v, count(*) AS k FROM (SELECT doc_id, a AS v FROM p UNION ALL SELECT doc_id, b FROM p) GROUP BY ALL),
r AS (
  SELECT n.doc_id, true AS connected, node_count, coalesce(edge_count, 0) AS edge_count,
    CASE WHEN node_count <= 1 THEN 0e0 ELSE (SELECT count(*) FROM p WHERE p.doc_id = n.doc_id) / (node_count * (node_count - 1))::DOUBLE * 2e0 END AS density,
    coalesce((SELECT max(k) FROM d WHERE d.doc_id = n.doc_id), 0) AS max_neighbor_count,
    CASE WHEN node_count <= 1 THEN 0 ELSE (SELECT count(*) FROM d WHERE d.doc_id = n.doc_id AND k > greatest(2, trunc(0.5e0 * (node_count - 1)))) END AS hub_count
  FROM n LEFT JOIN m USING (doc_id))
SELECT *, concat_ws(',', CASE WHEN CASE WHEN node_count <= 1 THEN edge_count > 0 ELSE density > 0.4e0 END THEN 'DENSITY' END, CASE WHEN hub_count > 0 THEN 'HUBS' END) AS codes FROM r""",
}
