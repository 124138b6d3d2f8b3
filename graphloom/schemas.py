"""Row types of the graph tables. Every table is keyed by doc_id; `ord` is the position in the extraction it came from."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


STR, DBL, INT, LONG, BOOL = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
STRINGS, MAP = T.ArrayType(STR), T.MapType(STR, STR)

ENTITY = _struct(entity_id=STR, mention_text=STR, free_type=STR, description=STR, evidence=STR, confidence=DBL)
RELATION = _struct(relation_id=STR, source_id=STR, target_id=STR, free_type=STR, evidence=STR, confidence=DBL)
EXTRACTION = _struct(entities=T.ArrayType(ENTITY), relations=T.ArrayType(RELATION), notes=STR)
CAST_ENTITY = _struct(entity_id=STR, ontology_type=STR, canonical_name=STR, attributes=MAP, confidence=DBL)
CAST_RELATION = _struct(relation_id=STR, source_id=STR, target_id=STR, ontology_type=STR, attributes=MAP, confidence=DBL)
CASTING = _struct(entities=T.ArrayType(CAST_ENTITY), relations=T.ArrayType(CAST_RELATION), notes=STR)
NODE_CONTEXT = _struct(entity_id=STR, summary=STR, evidence=STRINGS, uncertainty=STR)
REPORT = _struct(
    valid=BOOL, connected=BOOL, sparse=BOOL, node_count=LONG, edge_count=LONG, density=DBL, max_neighbor_count=LONG, hub_nodes=STRINGS, issues=STRINGS, density_ok=BOOL, hubs_ok=BOOL
)
NORMALIZATION = _struct(
    policy=STR, component_count=LONG, retained_entity_ids=STRINGS, discarded_entity_ids=STRINGS, retained_relation_ids=STRINGS, discarded_relation_ids=STRINGS
)
RUN = _struct(model=STR, source_sha256=STR, prompt_sha256=STR)
ISSUE = "doc_id bigint, stage string, code string, subject string, detail string"


def keyed(record: T.StructType, doc_type: T.DataType = LONG) -> T.StructType:
    """Table schema of a record: doc_id and ord before its fields."""
    return T.StructType([T.StructField("doc_id", doc_type), T.StructField("ord", INT), *record.fields])
