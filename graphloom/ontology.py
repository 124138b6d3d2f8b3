"""Ontologies: vocabularies of entity and relation types, from YAML or tables, and the small tables they are joined as."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.codec import decode
from graphloom.util import cut, small

ENTITY_TYPES = "id string, label string, parent string, description string, abstract boolean, synonyms array<string>, examples array<string>, attributes array<string>"
RELATION_TYPES = "id string, label string, domain_id string, range_id string, inverse string, description string"


@dataclass(frozen=True)
class Ontology:
    """entity_types and relation_types by id, and metadata. Other keys of the source are dropped."""

    entity_types: Mapping = field(default_factory=dict)
    relation_types: Mapping = field(default_factory=dict)
    metadata: Mapping = field(default_factory=dict)

    @classmethod
    def from_mapping(cls, data: Mapping) -> Ontology:
        return cls(dict(data.get("entity_types") or {}), dict(data.get("relation_types") or {}), dict(data.get("ontology") or {}))

    @classmethod
    def from_yaml(cls, path) -> Ontology:
        """An empty file is an empty ontology; a root that is no mapping is refused."""
        data = decode(Path(path).read_text(encoding="utf-8"), "yaml", "an ontology")
        return cls.from_mapping(data)

    @classmethod
    def from_tables(cls, entity_types: DataFrame, relation_types: DataFrame, max_rows: int = 10_000) -> Ontology:
        """From the two type tables. Over `max_rows` types are refused: the tables are meant to be broadcast."""
        out = []
        for df in (entity_types, relation_types):
            rows = df.limit(max_rows + 1).collect()
            if len(rows) > max_rows:
                raise ValueError(f"an ontology of over {max_rows} types")
            out.append({r["id"]: {k: v for k, v in r.asDict(True).items() if k != "id" and v is not None} for r in rows})
        return cls(*out)

    def prompt_schema(self) -> dict:
        return {"entity_types": dict(self.entity_types), "relation_types": dict(self.relation_types)}

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """The type tables; keys that a type lacks are null, lists are empty."""

        def rows(types, lists, plain, renamed=()):
            for k, v in sorted(types.items()):
                v = v or {}
                yield (k, *(v.get(p) if v.get(p) is not None else v.get(dict(renamed).get(p, p)) for p in plain), *(list(v.get(x) or []) for x in lists))

        kinds = [(i, label, parent, text, bool(abstract), *lists) for i, label, parent, text, abstract, *lists in rows(self.entity_types, ("synonyms", "examples", "attributes"), ("label", "parent", "description", "abstract"))]
        ties = list(rows(self.relation_types, (), ("label", "domain_id", "range_id", "inverse", "description"), (("domain_id", "domain"), ("range_id", "range"))))
        return spark.createDataFrame(kinds, ENTITY_TYPES), spark.createDataFrame(ties, RELATION_TYPES)


def unknown_types(casting: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, unknown): per document its sorted distinct types that are not in the vocabulary; null types are ignored."""
    bad = casting.where("ontology_type is not null").select("doc_id", "ontology_type").join(small(types.select(F.col("id").alias("ontology_type"))), "ontology_type", "left_anti")
    return bad.groupBy("doc_id").agg(F.sort_array(F.collect_set("ontology_type")).alias("unknown"))


def closure(types: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth) of every type, itself at depth 0. A type whose parent is missing ends there; a cycle ends where it returns.

    Runs until no ancestor is new; where `max_depth` is set, a deeper chain raises RuntimeError.
    """
    pairs = types.select("id", "parent")
    level = pairs.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    up = small(pairs.where("parent is not null").select(F.col("id").alias("ancestor"), "parent"))
    depth = 0
    while True:
        depth += 1
        level = level.join(up, "ancestor").select("id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"))
        level = cut(level.join(types.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").join(out, ["id", "ancestor"], "left_anti").select("id", "ancestor", "depth"))
        if level.isEmpty():
            return out
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"types lie more than {max_depth} levels below an ancestor")
        out = out.unionByName(level)


def domain_range_audit(entities: DataFrame, relations: DataFrame, entity_types: DataFrame, relation_types: DataFrame) -> DataFrame:
    """(doc_id, relation_id, ontology_type, domain_ok, range_ok) of the typed relations with both ends typed.

    An end fits if its type is the declared one or below it; an undeclared domain or range admits everything. Both tables hold one row
    per id and document.
    """
    kinds = entities.select("doc_id", "entity_id", F.col("ontology_type").alias("kind")).where("kind is not null")
    below = small(closure(entity_types).select("id", "ancestor"), 100_000)
    ends = relations.where("ontology_type is not null").join(small(relation_types.select(F.col("id").alias("ontology_type"), "domain_id", "range_id")), "ontology_type")
    ends = ends.join(kinds.select("doc_id", F.col("entity_id").alias("source_id"), F.col("kind").alias("source_kind")), ["doc_id", "source_id"])
    ends = ends.join(kinds.select("doc_id", F.col("entity_id").alias("target_id"), F.col("kind").alias("target_kind")), ["doc_id", "target_id"])
    for end, wanted in (("source", "domain"), ("target", "range")):
        fits = below.select(F.col("id").alias(f"{end}_kind"), F.col("ancestor").alias(f"{wanted}_id"), F.lit(True).alias(f"{wanted}_fits"))
        ends = ends.join(fits, [f"{end}_kind", f"{wanted}_id"], "left")
    ok = {f"{w}_ok": F.col(f"{w}_id").isNull() | F.col(f"{w}_fits").isNotNull() for w in ("domain", "range")}
    return ends.select("doc_id", "relation_id", "ontology_type", *(c.alias(n) for n, c in ok.items()))


def inverse_edges(relations: DataFrame, relation_types: DataFrame) -> DataFrame:
    """The inverse of each typed relation whose type names one: ends swapped, type the inverse's name, id '<id>~inverse'."""
    ties = small(relation_types.where("inverse is not null").select(F.col("id").alias("ontology_type"), "inverse"))
    return relations.join(ties, "ontology_type").select("doc_id", F.concat("relation_id", F.lit("~inverse")).alias("relation_id"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), F.col("inverse").alias("ontology_type"))
