"""Documents to validated, typed, annotated graphs, all documents at once. A document that fails a stage leaves a quarantine row and goes no further."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import CONTEXT_ALIASES, CONTEXT_POLICIES, Settings
from graphloom.errors import GraphError
from graphloom.extract import Extractor, requests
from graphloom.functions.text import is_blank, sha256
from graphloom.ontology import Ontology
from graphloom.operators.components import weak_components
from graphloom.operators.context import annotated, node_requests, trimmed
from graphloom.operators.graph import build_edges, build_nodes, unlabeled
from graphloom.operators.normalize import normalize
from graphloom.operators.report import validation_report
from graphloom.operators.validate import casting_issues, context_issues, extraction_issues, first_issues
from graphloom.prompts import Prompt
from graphloom.util import cut


@dataclass
class Result:
    """Tables by stage, all keyed by doc_id. quarantine(doc_id, stage, code, detail) has one row per document that failed."""

    entities: DataFrame
    relations: DataFrame
    raw_report: DataFrame
    normalization: DataFrame
    fate_entities: DataFrame
    fate_relations: DataFrame
    normalized_report: DataFrame
    cast_entities: DataFrame
    cast_relations: DataFrame
    nodes: DataFrame
    edges: DataFrame
    final_report: DataFrame
    contexts: DataFrame | None
    runs: DataFrame
    quarantine: DataFrame


@dataclass
class Pipeline:
    """settings, ontology and extractor; `on_error='raise'` raises if any document was quarantined."""

    extractor: Extractor
    ontology: Ontology
    settings: Settings = field(default_factory=Settings)
    prompt: Prompt | None = None
    on_error: str = "quarantine"

    def __post_init__(self):
        if self.on_error not in ("quarantine", "raise"):
            raise ValueError("on_error must be 'quarantine' or 'raise'")
        policy = CONTEXT_ALIASES.get(self.settings.context_policy, self.settings.context_policy)
        if policy not in CONTEXT_POLICIES:
            raise ValueError(f"unknown context policy {policy!r}")
        if self.prompt is None:
            path = self.settings.prompt_template_path
            self.prompt = Prompt.load(path) if path else Prompt.default()
        if not self.prompt.rendered:  # a rendered prompt is taken as it is
            self.prompt = self.prompt.render(self.ontology, self.settings.extraction_density, self.settings.model, self.settings.node_context)
        if self.settings.prompt_snapshot_path:
            self.prompt.save(self.settings.prompt_snapshot_path)

    def run(self, docs: DataFrame, text: str = "text") -> Result:
        """docs(doc_id, text), one row per document. The extractor's tables are written once (util.cut): no recomputation asks it again."""
        s, spark = self.settings, docs.sparkSession
        kinds, ties = self.ontology.tables(spark)
        docs = docs.select("doc_id", F.col(text).alias("text"))
        failed: list[DataFrame] = []

        def fail(rows: DataFrame, stage: str, code="code", detail="detail") -> DataFrame:
            bad = cut(rows.select("doc_id", F.lit(stage).alias("stage"), F.col(code).alias("code"), F.col(detail).cast("string").alias("detail")))
            failed.append(bad)
            return bad.select("doc_id").distinct()

        def refused(*tables: DataFrame) -> list[DataFrame]:
            """Documents whose answer the extractor has refused since the last call go no further."""
            problems = getattr(self.extractor, "problems", [])
            while problems:
                q = problems.pop()
                failed.append(q)
                tables = without(q.select("doc_id").distinct(), *tables)
            return list(tables)

        def without(bad: DataFrame, *tables: DataFrame) -> list[DataFrame]:
            return [t.join(bad, "doc_id", "left_anti") for t in tables]

        blank = fail(docs.where(is_blank(F.col("text"))).withColumns({"code": F.lit("BLANK_TEXT"), "detail": F.lit("")}), "input")
        (live,) = without(blank, requests(docs, s.extraction_density))
        raw_e, raw_r = (cut(t) for t in self.extractor.extract(live))
        live, raw_e, raw_r = refused(live, raw_e, raw_r)
        bad = fail(first_issues(extraction_issues(raw_e, raw_r)), "extraction")
        live, e, r = without(bad, live, raw_e, raw_r)
        parts = cut(weak_components(e.select("doc_id", "entity_id"), r.select("doc_id", "source_id", "target_id")))
        raw_report = validation_report(build_nodes(e), build_edges(r), s.limits, live, parts)
        if s.disconnected_policy == "raise":
            bad = fail(raw_report.where("not connected").withColumns({"code": F.lit("DISCONNECTED"), "detail": F.array_join("issues", "; ")}), "normalization")
            live, e, r, parts = without(bad, live, e, r, parts)
        norm = normalize(e, r, parts, "preserve" if s.disconnected_policy == "raise" else s.disconnected_policy, live)
        e, r = cut(norm.entities), cut(norm.relations)
        normal_report = cut(validation_report(build_nodes(e), build_edges(r), s.limits, live))
        if s.strict_validation:
            bad = fail(normal_report.where("not valid").withColumns({"code": F.lit("INVALID_GRAPH"), "detail": F.array_join("issues", "; ")}), "normalization")
            live, e, r = without(bad, live, e, r)
        cast_e, cast_r = (cut(t) for t in self.extractor.cast(live, e, r))
        live, e, r, cast_e, cast_r = refused(live, e, r, cast_e, cast_r)
        bad = fail(first_issues(casting_issues(e, r, cast_e, cast_r, kinds, ties)), "casting")
        live, e, r, cast_e, cast_r = without(bad, live, e, r, cast_e, cast_r)
        nodes, edges = cut(build_nodes(e, cast_e)), cut(build_edges(r, cast_r))
        open_ = unlabeled(nodes, edges).groupBy("doc_id").agg(F.min(F.struct("kind", "subject")).alias("x"))
        bad = fail(open_.select("doc_id", F.lit("UNLABELED").alias("code"), F.concat_ws(" ", "x.kind", "x.subject").alias("detail")), "labels")
        live, nodes, edges = without(bad, live, nodes, edges)
        final = cut(validation_report(nodes, edges, s.limits, live))
        if s.strict_validation:
            bad = fail(final.where("not valid").withColumns({"code": F.lit("INVALID_GRAPH"), "detail": F.array_join("issues", "; ")}), "labels")
            live, nodes, edges = without(bad, live, nodes, edges)
        contexts = None
        if CONTEXT_ALIASES.get(s.context_policy, s.context_policy) == "all_nodes":
            contexts = cut(trimmed(self.extractor.contexts(live, node_requests(nodes, edges)), s.node_context))
            live, nodes, edges, contexts = refused(live, nodes, edges, contexts)
            bad = fail(first_issues(context_issues(contexts, nodes, s.node_context)).withColumn("detail", F.concat_ws(" ", "subject", "detail")), "contexts")
            live, nodes, edges, contexts = without(bad, live, nodes, edges, contexts)
            nodes = annotated(nodes, contexts)
        runs = live.select("doc_id", F.lit(s.model).alias("model"), sha256(F.col("text")).alias("source_sha256"), F.lit(self.prompt.sha256()).alias("prompt_sha256"))
        quarantine = failed[0]
        for f in failed[1:]:
            quarantine = quarantine.unionByName(f)
        if self.on_error == "raise" and (first := quarantine.limit(5).collect()):
            raise GraphError("; ".join(f"document {x['doc_id']}, {x['stage']}: {x['code']} {x['detail']}" for x in first))
        return Result(raw_e, raw_r, raw_report, norm.report, norm.fate_entities, norm.fate_relations, normal_report, cast_e, cast_r, nodes, edges, final, contexts, runs, quarantine)
