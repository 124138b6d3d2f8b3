"""The foreign-key graph of the graph tables, for the orphan queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.orphans import Cascade, ForeignKey, Table, orphan_cascade, orphan_report
from graphloom.util import read

FOUND_KEYS = [ForeignKey("relations", "source_id", "entities"), ForeignKey("relations", "target_id", "entities"), ForeignKey("cast_entities", "entity_id", "entities")]
ALL_KEYS = [*FOUND_KEYS, ForeignKey("cast_relations", "relation_id", "relations"), ForeignKey("cast_relations", "source_id", "cast_entities"), ForeignKey("cast_relations", "target_id", "cast_entities")]


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, Table]:
    known = {
        "entities": ("entity_id", "extracted_at", "deleted_at"),
        "relations": ("relation_id", "extracted_at", None),
        "cast_entities": ("entity_id", "cast_at", None),
        "cast_relations": ("relation_id", "cast_at", None),
    }
    return {n: Table(n, read(spark, sf_dir, n), key, event, deleted=gone) for n in names for key, event, gone in [known[n]]}


def _cascade(spark: SparkSession, sf_dir: str) -> Cascade:
    return orphan_cascade(tables(spark, sf_dir, "entities", "relations", "cast_entities", "cast_relations"), ALL_KEYS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 of the cascade over the whole key graph, for the three references to entities: (table_name, field_name, record_id, period)."""
    asked = F.concat_ws(".", "table_name", "field_name").isin([f"{k.child}.{k.column}" for k in FOUND_KEYS])
    return _cascade(spark, sf_dir).direct.where(asked).select("table_name", "field_name", "record_id", "period").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table, field and month over the whole key graph, cast_relations included: direct and inherited orphans."""
    return orphan_report(_cascade(spark, sf_dir))


P2_FOUND_SQL = """
WITH e AS (SELECT doc_id, entity_id, min(loaded_at) AS first_in, min(deleted_at) AS first_out FROM entities GROUP BY ALL),
r AS (SELECT doc_id, relation_id, source_id, target_id, extracted_at, min(loaded_at) AS arrived FROM relations GROUP BY ALL),
c AS (SELECT doc_id, entity_id, cast_at, min(loaded_at) AS arrived FROM cast_entities GROUP BY ALL),
refs AS (
  SELECT doc_id, 'relations' AS table_name, 'source_id' AS field_name, relation_id AS record_id, source_id AS ref, extracted_at AS t, arrived FROM r
  UNION ALL SELECT doc_id, 'relations', 'target_id', relation_id, target_id, extracted_at, arrived FROM r
  UNION ALL SELECT doc_id, 'cast_entities', 'entity_id', entity_id, entity_id, cast_at, arrived FROM c)
SELECT DISTINCT table_name, field_name, record_id, strftime(t, '%Y-%m') AS period
FROM refs LEFT JOIN e ON refs.doc_id = e.doc_id AND refs.ref = e.entity_id
WHERE ref <> '' AND (first_in IS NULL OR first_in > arrived OR first_out <= arrived)
"""

P2_REPORT_SQL = """
WITH e AS (SELECT doc_id, entity_id AS id, min(loaded_at) AS first_in, min(deleted_at) AS first_out FROM entities GROUP BY ALL),
r AS (SELECT doc_id, relation_id, source_id, target_id, strftime(extracted_at, '%Y-%m') AS period, min(loaded_at) AS arrived FROM relations GROUP BY ALL),
c AS (SELECT doc_id, entity_id, strftime(cast_at, '%Y-%m') AS period, min(loaded_at) AS arrived FROM cast_entities GROUP BY ALL),
x AS (SELECT doc_id, relation_id, source_id, target_id, strftime(cast_at, '%Y-%m') AS period, min(loaded_at) AS arrived FROM cast_relations GROUP BY ALL),
parents AS (
  SELECT 'entities' AS parent, * FROM e
  UNION ALL SELECT 'relations', doc_id, relation_id, min(arrived), NULL FROM r GROUP BY ALL
  UNION ALL SELECT 'cast_entities', doc_id, entity_id, min(arrived), NULL FROM c GROUP BY ALL),
refs AS (
  SELECT 'relations' AS table_name, 'source_id' AS field_name, 'entities' AS parent, doc_id, relation_id AS record_id, source_id AS ref, period, arrived FROM r
  UNION ALL SELECT 'relations', 'target_id', 'entities', doc_id, relation_id, target_id, period, arrived FROM r
  UNION ALL SELECT 'cast_entities', 'entity_id', 'entities', doc_id, entity_id, entity_id, period, arrived FROM c
  UNION ALL SELECT 'cast_relations', 'relation_id', 'relations', doc_id, relation_id, relation_id, period, arrived FROM x
  UNION ALL SELECT 'cast_relations', 'source_id', 'cast_entities', doc_id, relation_id, source_id, period, arrived FROM x
  UNION ALL SELECT 'cast_relations', 'target_id', 'cast_entities', doc_id, relation_id, target_id, period, arrived FROM x),
direct AS (
  SELECT refs.* FROM refs LEFT JOIN parents p ON p.parent = refs.parent AND p.doc_id = refs.doc_id AND p.id = refs.ref
  WHERE ref <> '' AND (first_in IS NULL OR first_in > arrived OR first_out <= arrived)),
inherited AS (
  SELECT refs.* FROM refs
  WHERE ref <> '' AND EXISTS (SELECT 1 FROM direct d WHERE d.table_name = refs.parent AND d.doc_id = refs.doc_id AND d.record_id = refs.ref)
  AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.table_name = refs.table_name AND d.field_name = refs.field_name AND d.doc_id = refs.doc_id AND d.record_id = refs.record_id)),
together AS (SELECT *, 0 AS level FROM direct UNION ALL SELECT *, 1 FROM inherited)
SELECT table_name, field_name, period, count(*) FILTER (level = 0) AS direct_orphans, count(*) FILTER (level > 0) AS inherited_orphans,
  CAST(max(level) AS INT) AS deepest_level
FROM together GROUP BY ALL
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {"p2_found": P2_FOUND_SQL, "p2_report": P2_REPORT_SQL}
