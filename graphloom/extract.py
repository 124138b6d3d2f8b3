"""Extractors: what names the entities, casts them and writes contexts. The pipeline's only point of extension.

An extractor works on tables, so a rule, stored results or a remote model look the same to the pipeline.
"""

from __future__ import annotations

import json
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import ContextSettings, Density
from graphloom.errors import ResponseError
from graphloom.functions.text import strip, target_entities, target_relations, word_count
from graphloom.operators.context import whole_requests
from graphloom.sources.wire import explode_records, parse
from graphloom.util import cut


def requests(docs: DataFrame, density: Density = Density(), text: str = "text") -> DataFrame:
    """docs with word_count, target_entity_count, target_relation_count and the JSON payload of the first pass."""
    per, ties = F.lit(float(density.entities_per_word)), F.lit(float(density.relations_per_entity))
    counted = docs.withColumn("word_count", word_count(F.col(text)))
    counted = counted.withColumn("target_entity_count", target_entities(F.col("word_count"), per))
    counted = counted.withColumn("target_relation_count", target_relations(F.col("target_entity_count"), ties))
    payload = F.struct(
        F.col(text).alias("source_text"), F.struct(per.alias("entities_per_word"), ties.alias("relations_per_entity")).alias("extraction_density"),
        F.struct("word_count", "target_entity_count", "target_relation_count").alias("target_counts"),
    )
    return counted.withColumn("payload", F.to_json(payload))


class Extractor(Protocol):
    """Tables in, tables out; every table is keyed by doc_id. Documents that fail are left out, or named in `problems`."""

    def extract(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """entities and relations of docs(doc_id, text, payload)."""

    def cast(self, docs: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
        """cast_entities and cast_relations of the normalised records."""

    def contexts(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """(doc_id, ord, entity_id, summary, evidence, uncertainty) of the node requests."""


class TableExtractor:
    """Results that are stored already, by document."""

    def __init__(self, entities: DataFrame, relations: DataFrame, cast_entities: DataFrame, cast_relations: DataFrame, contexts: DataFrame | None = None):
        self.tables = entities, relations, cast_entities, cast_relations
        self.stored = contexts

    def extract(self, docs):
        return tuple(t.join(docs.select("doc_id"), "doc_id", "left_semi") for t in self.tables[:2])

    def cast(self, docs, entities, relations):
        e = self.tables[2].join(entities.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")
        return e, self.tables[3].join(relations.select("doc_id", "relation_id"), ["doc_id", "relation_id"], "left_semi")

    def contexts(self, docs, nodes):
        if self.stored is not None:
            return self.stored.join(docs.select("doc_id"), "doc_id", "left_semi")
        said = F.concat(F.lit("Context for "), F.coalesce(F.nullif("raw_mention", F.lit("")), F.col("id")), F.lit("."))
        return nodes.where("page = 0").select("doc_id", "ord", F.col("id").alias("entity_id"), said.alias("summary"), F.array().cast("array<string>").alias("evidence"), F.lit("").alias("uncertainty"))


class RuleExtractor(TableExtractor):
    """A fixed rule without any model: long words are entities, neighbours in a sentence are related. Casts everything to one type each.

    `ord` is the word's number among the long words of its document.
    """

    def __init__(self, least: int = 7, entity_type: str = "thing", relation_type: str = "links"):
        self.least, self.types, self.stored = least, (entity_type, relation_type), None

    def extract(self, docs):
        cuts, word = F.split(strip(F.lower("text")), r"(?<=[.!?])\s+"), F.lit(f"([a-z]{{{self.least},}})")
        found = F.transform(cuts, lambda x, s: F.transform(F.regexp_extract_all(x, word), lambda w: F.struct(s.alias("s"), w.alias("w"))))
        words = docs.select("doc_id", F.posexplode(F.flatten(found)).alias("p", "x")).select("doc_id", "p", "x.s", "x.w")
        none, no_number = F.lit(""), F.lit(None).cast("double").alias("confidence")
        entities = words.groupBy("doc_id", F.col("w").alias("entity_id")).agg(F.min("p").alias("ord"))
        entities = entities.select("doc_id", "ord", "entity_id", F.col("entity_id").alias("mention_text"), F.lit("word").alias("free_type"), none.alias("description"), none.alias("evidence"), no_number)
        after = words.select("doc_id", "s", (F.col("p") - 1).alias("p"), F.col("w").alias("next"))
        pairs = words.join(after, ["doc_id", "s", "p"]).where("w <> next")
        relations = pairs.select("doc_id", F.col("p").alias("ord"), F.concat(F.lit("r"), "p").alias("relation_id"), F.col("w").alias("source_id"), F.col("next").alias("target_id"), F.lit("next to").alias("free_type"), none.alias("evidence"), no_number)
        return entities, relations

    def cast(self, docs, entities, relations):
        none = F.create_map().cast("map<string,string>").alias("attributes")
        e = entities.select("doc_id", "ord", "entity_id", F.lit(self.types[0]).alias("ontology_type"), F.col("mention_text").alias("canonical_name"), none, "confidence")
        return e, relations.select("doc_id", "ord", "relation_id", "source_id", "target_id", F.lit(self.types[1]).alias("ontology_type"), none, "confidence")


class ClientExtractor:
    """A client that answers one document at a time with JSON text: extract(payload), cast(payload), contexts(payload) -> str.

    The client is made once per task by `make`, calls run on the executors in Arrow batches, answers are parsed strictly. `problems` collects
    the refused answers as (doc_id, stage, code, detail). Outputs are written once by the pipeline, so no call is repeated for a recomputation.
    """

    def __init__(self, make, ontology: dict | None = None, settings: ContextSettings = ContextSettings()):
        self.make, self.ontology, self.settings = make, ontology or {}, settings
        self.problems: list[DataFrame] = []

    def _ask(self, rows: DataFrame, method: str, which: str) -> DataFrame:
        make = self.make

        def run(batches):
            client = make()
            for b in batches:
                out = []
                for doc, payload in zip(b["doc_id"], b["payload"]):
                    try:
                        out.append((doc, getattr(client, method)(payload)))
                    except Exception as e:  # noqa: BLE001
                        out.append((doc, json.dumps(f"{type(e).__name__}: {e}")))
                yield pd.DataFrame(out, columns=["doc_id", "said"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        answers = cut(parse(rows.select("doc_id", "payload").mapInPandas(run, f"doc_id {kind}, said string"), "said", which))
        self.problems.append(answers.where("problem is not null").select("doc_id", F.lit(which).alias("stage"), F.lit("BAD_ANSWER").alias("code"), F.col("problem").alias("detail")))
        return answers

    def extract(self, docs):
        answers = self._ask(docs, "extract", "extraction")
        return explode_records(answers, "entities"), explode_records(answers, "relations")

    def cast(self, docs, entities, relations):
        lists = []
        for table, name in ((entities, "entities"), (relations, "relations")):
            body = F.struct(*(c for c in table.columns if c not in ("doc_id", "ord")))
            lists.append(table.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", body.alias("r")))).alias("x")).select("doc_id", F.col("x.r").alias(name)))
        met = docs.select("doc_id", F.col("text").alias("source_text")).join(lists[0], "doc_id").join(lists[1], "doc_id", "left")
        empty = F.expr("cast(array() as array<string>)")
        free = F.to_json(F.struct("entities", "relations"), KEEP_NULLS)
        free = F.when(F.col("relations").isNull(), F.to_json(F.struct("entities", empty.alias("relations")), KEEP_NULLS)).otherwise(free)
        free_object = F.concat(F.expr("left(free, length(free) - 1)"), F.lit(',"notes":""}'))  # notes are no table of the pipeline
        payload = _object({"source_text": _text("source_text"), "free_extraction": free_object, "ontology": F.lit(json.dumps(self.ontology, ensure_ascii=False))})
        answers = self._ask(met.withColumn("free", free).select("doc_id", payload.alias("payload")), "cast", "casting")
        return explode_records(answers, "entities"), explode_records(answers, "relations")

    def contexts(self, docs, nodes):
        nodes = whole_requests(nodes)
        body = [c for c in nodes.columns if c not in ("doc_id", "ord")]
        lists = nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.to_json(F.struct(*body), KEEP_NULLS).alias("node"), "outgoing_relations"))).alias("x"))
        met = docs.select("doc_id", F.col("text").alias("source_text")).join(lists, "doc_id")
        # every relation leaves one node, so the nodes' outgoing lists are all relations
        relations = F.to_json(F.flatten("x.outgoing_relations"), KEEP_NULLS)
        listed = F.concat(F.lit("["), F.array_join("x.node", ","), F.lit("]"))
        payload = _object({"source_text": _text("source_text"), "nodes": listed, "relations": relations, "ontology": F.lit(json.dumps(self.ontology, ensure_ascii=False)), "context_config": F.lit(json.dumps(self.settings.to_mapping()))})
        answers = self._ask(met.select("doc_id", payload.alias("payload")), "contexts", "contexts")
        return explode_records(answers, "contexts")


KEEP_NULLS = {"ignoreNullFields": "false"}


def _text(column: str) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(F.coalesce(column, F.lit("")).alias("x")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _object(members: dict[str, Column]) -> Column:
    """A JSON object of members that are JSON already."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), v) for k, v in members.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def require_answers(problems: DataFrame) -> None:
    """Raises ResponseError if any answer was refused."""
    bad = problems.limit(5).collect()
    if bad:
        raise ResponseError("; ".join(f"document {r['doc_id']}: {r['detail']}" for r in bad))
