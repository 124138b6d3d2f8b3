"""Record validators. Each gives a table of issues: doc_id, rank, ord, code, subject, detail; rank and ord order the issues of a document.

rank: position of the check; ord: position of the record within it. subject: the id the issue is about; detail: ids or types, comma-joined.
`texts` renders the messages; other users go by the codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import ContextSettings
from graphloom.functions.text import is_blank, quoted, quoted_list, sentence_count
from graphloom.operators.graph import dangling
from graphloom.util import small

ISSUE = ("doc_id", "rank", "ord", "code", "subject", "detail")


def _issue(df: DataFrame, rank: int, order: Column, code: Column | str, subject: Column, detail: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rank).alias("rank"), order.cast("long").alias("ord"), (F.lit(code) if isinstance(code, str) else code).alias("code"), subject.alias("subject"), detail.alias("detail"))


def _repeated(df: DataFrame, key: str, rank: int, code: str) -> DataFrame:
    """One issue per document with ids that occur more than once, sorted."""
    twice = df.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = twice.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(key)), ", ").alias("ids"))
    return _issue(ids, rank, F.lit(0), code, F.lit(""), F.col("ids"))


def extraction_issues(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """DUP_ENTITY, DUP_RELATION, then UNKNOWN_ENDPOINT per relation in input order. Null ends are unknown, shown as ''."""
    lost = dangling(relations, entities)
    ends = _issue(lost, 2, F.col("ord"), "UNKNOWN_ENDPOINT", F.col("relation_id"), F.array_join("missing", ", "))
    return _repeated(entities, "entity_id", 0, "DUP_ENTITY").unionByName(_repeated(relations, "relation_id", 1, "DUP_RELATION")).unionByName(ends)


def _id_mismatch(own: DataFrame, cast: DataFrame, key: str, rank: int, code: str) -> DataFrame:
    """One issue per document whose casting ids are not exactly its ids, each once. detail: 'missing=..; extra=..; repeated=..' sorted.

    Only the ids that differ are gathered, not all of a document's.
    """
    a = own.where(F.col(key).isNotNull()).groupBy("doc_id", F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    b = cast.where(F.col(key).isNotNull()).groupBy("doc_id", F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("m"))
    met = a.join(b, ["doc_id", "id"], "full").where("n is null or m is null or n <> m")

    def those(which):
        return F.array_join(F.sort_array(F.collect_list(F.when(which, F.col("id")))), ",")

    lists = met.groupBy("doc_id").agg(those(F.col("m").isNull()).alias("a"), those(F.col("n").isNull()).alias("b"), those(F.col("n").isNotNull() & F.col("m").isNotNull()).alias("c"))
    return _issue(lists, rank, F.lit(0), code, F.lit(""), F.concat(F.lit("missing="), "a", F.lit("; extra="), "b", F.lit("; repeated="), "c"))


def casting_issues(entities: DataFrame, relations: DataFrame, cast_entities: DataFrame, cast_relations: DataFrame, entity_types: DataFrame, relation_types: DataFrame, require_types: bool = True) -> DataFrame:
    """CAST_ENTITY_IDS, CAST_RELATION_IDS; per cast entity NO_TYPE or UNKNOWN_TYPE; per cast relation ENDPOINT_CHANGED, then its type.

    A null type is an issue only if types are required. Castings of unknown relations are left to the id check.
    """

    def typed(cast, types, key, rank):
        known = small(types.select(F.col("id").alias("ontology_type"), F.lit(True).alias("known")))
        met = cast.join(known, "ontology_type", "left")
        code = F.when(F.col("ontology_type").isNull(), F.lit("NO_TYPE") if require_types else F.lit(None)).when(F.col("known").isNull(), "UNKNOWN_TYPE")
        return _issue(met.withColumn("c", code).where("c is not null"), rank, F.col("ord") * 2 + 1, F.col("c"), F.coalesce(key, F.lit("")), F.coalesce("ontology_type", F.lit("")))

    own = relations.select("doc_id", "relation_id", F.col("source_id").alias("s"), F.col("target_id").alias("t"))
    own = own.groupBy("doc_id", "relation_id").agg(F.max(F.struct("s", "t")).alias("own"))
    moved = cast_relations.join(own, ["doc_id", "relation_id"]).where("not (source_id <=> own.s and target_id <=> own.t)")
    out = _id_mismatch(entities, cast_entities, "entity_id", 0, "CAST_ENTITY_IDS")
    out = out.unionByName(_id_mismatch(relations, cast_relations, "relation_id", 1, "CAST_RELATION_IDS"))
    out = out.unionByName(typed(cast_entities, entity_types, "entity_id", 2))
    out = out.unionByName(_issue(moved, 3, F.col("ord") * 2, "ENDPOINT_CHANGED", F.col("relation_id"), F.lit("")))
    return out.unionByName(typed(cast_relations, relation_types, "relation_id", 3))


def context_issues(contexts: DataFrame, nodes: DataFrame, settings: ContextSettings = ContextSettings()) -> DataFrame:
    """Every issue of the contexts: CTX_DUP, CTX_UNKNOWN, CTX_EMPTY, CTX_SENTENCES, CTX_EVIDENCE_OFF, CTX_EVIDENCE_MANY per context, and CTX_MISSING.

    contexts(doc_id, ord, entity_id, summary, evidence, uncertainty). Only the first issue of a context is given, as its check would
    stop there. `first_issues` gives what a fail-fast check of each document reports. CTX_MISSING lists nodes in node order.
    """
    first = contexts.groupBy("doc_id", "entity_id").agg(F.min("ord").alias("first"))
    known = nodes.select("doc_id", "entity_id", F.lit(True).alias("known")).distinct()
    met = contexts.join(first, ["doc_id", "entity_id"], "left").join(known, ["doc_id", "entity_id"], "left")
    items = F.coalesce(F.size("evidence"), F.lit(0))
    code = (
        F.when(F.col("ord") > F.col("first"), "CTX_DUP").when(F.col("known").isNull(), "CTX_UNKNOWN").when(is_blank(F.col("summary")), "CTX_EMPTY")
        .when(sentence_count(F.col("summary")) > settings.max_sentences, "CTX_SENTENCES")
        .when((items > 0) & F.lit(not settings.include_evidence), "CTX_EVIDENCE_OFF").when(items > settings.max_evidence_items, "CTX_EVIDENCE_MANY")
    )
    bad = met.withColumn("c", code).where("c is not null")
    out = _issue(bad, 0, F.col("ord"), F.col("c"), F.coalesce("entity_id", F.lit("")), F.lit(""))
    lost = nodes.join(contexts.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_anti")
    lists = lost.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "entity_id"))).alias("x"))
    return out.unionByName(_issue(lists, 1, F.lit(0), "CTX_MISSING", F.lit(""), F.array_join("x.entity_id", ", ")))


def first_issues(issues: DataFrame) -> DataFrame:
    """The first issue of each document."""
    rest = [c for c in issues.columns if c not in ("doc_id", "rank", "ord")]
    best = issues.groupBy("doc_id").agg(F.min(F.struct("rank", "ord", *rest)).alias("x"))
    return best.select("doc_id", "x.*").select(*issues.columns)


def texts(issues: DataFrame) -> DataFrame:
    """Adds `text`, the message of each extraction or casting issue."""
    kind = F.when(F.col("rank").isin(0, 2), F.lit("entity")).otherwise(F.lit("relation"))

    def ids(name):
        part = F.regexp_extract("detail", rf"{name}=([^;]*)", 1)
        return quoted_list(F.filter(F.split(part, ","), lambda x: x != ""))

    whole = F.when(F.col("rank") == 0, F.lit("entity")).otherwise(F.lit("relation"))
    said = (
        F.when(F.col("code") == "DUP_ENTITY", F.concat(F.lit("duplicate entity ids: "), "detail"))
        .when(F.col("code") == "DUP_RELATION", F.concat(F.lit("duplicate relation ids: "), "detail"))
        .when(F.col("code") == "UNKNOWN_ENDPOINT", F.concat(F.lit("relation "), quoted("subject"), F.lit(" references unknown endpoint(s): "), "detail"))
        .when(F.col("code").isin("CAST_ENTITY_IDS", "CAST_RELATION_IDS"), F.concat(whole, F.lit(" casting ids do not exactly match extraction (missing="), ids("missing"), F.lit(", extra="), ids("extra"), F.lit(")")))
        .when(F.col("code") == "NO_TYPE", F.concat(kind, F.lit(" "), quoted("subject"), F.lit(" has no ontology type")))
        .when(F.col("code") == "UNKNOWN_TYPE", F.concat(kind, F.lit(" "), quoted("subject"), F.lit(" has unknown ontology type "), quoted("detail")))
        .when(F.col("code") == "ENDPOINT_CHANGED", F.concat(F.lit("relation "), quoted("subject"), F.lit(" changed endpoints during casting")))
        .otherwise(F.concat_ws(" ", "code", "subject", "detail"))
    )
    return issues.withColumn("text", said)
