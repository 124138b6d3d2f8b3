"""Normalisation of disconnected graphs: the largest component is kept, everything discarded is reported."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import POLICIES
from graphloom.errors import ValidationFailed
from graphloom.operators.report import component_sizes


def largest_component(components: DataFrame) -> DataFrame:
    """(doc_id, component_id, size, component_count): the largest component of each document, of equal ones that of the least id.

    A minimum over component sizes, partly aggregated: no window, and no document in one task.
    """
    per = component_sizes(components)
    best = per.groupBy("doc_id").agg(F.min(F.struct((-F.col("size")).alias("s"), "component_id")).alias("x"), F.count(F.lit(1)).alias("component_count"))
    return best.select("doc_id", F.col("x.component_id").alias("component_id"), (-F.col("x.s")).alias("size"), "component_count")


@dataclass(frozen=True)
class Normalized:
    """entities, relations: what is kept, in the columns and order columns given. fate_*: every id with `retained`. report: one row per document."""

    entities: DataFrame
    relations: DataFrame
    fate_entities: DataFrame
    fate_relations: DataFrame
    report: DataFrame


def normalize(entities: DataFrame, relations: DataFrame, components: DataFrame, policy: str = "largest_component", docs: DataFrame | None = None) -> Normalized:
    """Applies the policy to every document.

    Connected documents, and all under 'preserve', stay as they are, without a note. 'raise' raises ValidationFailed if any document is
    disconnected or, named in `docs`, empty. Under 'largest_component' the entities of the largest component are kept and the relations
    with both ends in it; an empty document gets the note that it could not be normalised, and its relations count as discarded.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    every = entities.select("doc_id").union(relations.select("doc_id"))
    every = (every.union(docs.select("doc_id")) if docs is not None else every).distinct()
    best = largest_component(components)
    known = every.join(best, "doc_id", "left").withColumn("component_count", F.coalesce("component_count", F.lit(0)))
    if policy == "raise":
        bad = known.where("component_count <> 1").select("doc_id").limit(1).collect()
        if bad:
            raise ValidationFailed([f"document {bad[0][0]}: graph is disconnected or empty"])
    kept = components.join(best.select("doc_id", "component_id"), ["doc_id", "component_id"], "left_semi").select("doc_id", "entity_id")
    if policy == "preserve":
        kept = components.select("doc_id", "entity_id")
    mark = kept.withColumn("kept", F.lit(True))
    fate_e = entities.join(mark, ["doc_id", "entity_id"], "left").withColumn("retained", F.coalesce("kept", F.lit(policy == "preserve"))).drop("kept")
    # an edge never leaves its component, so one end decides; a relation whose other end is no entity is discarded
    ends = relations.join(mark.withColumnRenamed("entity_id", "source_id"), ["doc_id", "source_id"], "left").withColumnRenamed("kept", "s")
    ends = ends.join(mark.withColumnRenamed("entity_id", "target_id"), ["doc_id", "target_id"], "left").withColumnRenamed("kept", "t")
    both = F.col("s").isNotNull() & F.col("t").isNotNull()
    fate_r = ends.withColumn("retained", both | F.lit(policy == "preserve")).drop("s", "t").select(*relations.columns, "retained")
    fate_e = fate_e.select(*entities.columns, "retained")

    def counts(fate, name):
        return fate.groupBy("doc_id").agg(F.count(F.when(F.col("retained"), 1)).alias(f"retained_{name}"), F.count(F.when(~F.col("retained"), 1)).alias(f"discarded_{name}"))

    report = known.select("doc_id", "component_count").join(counts(fate_e, "entities"), "doc_id", "left").join(counts(fate_r, "relations"), "doc_id", "left")
    names = [f"{x}_{y}" for y in ("entities", "relations") for x in ("retained", "discarded")]
    report = report.select("doc_id", F.lit(policy).alias("policy"), F.col("component_count").cast("long").alias("component_count"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))
    # fixed format of the note
    note = F.format_string(
        "retained largest weakly connected component with %d node(s); discarded %d disconnected entity/entities and %d relation(s)", "retained_entities", "discarded_entities", "discarded_relations"
    )
    changed = F.when(F.col("component_count") == 0, F.lit("could not normalize an empty graph")).when(F.col("component_count") > 1, note)
    report = report.withColumn("note", changed if policy == "largest_component" else F.lit(None).cast("string"))
    return Normalized(fate_e.where("retained").drop("retained"), fate_r.where("retained").drop("retained"), fate_e, fate_r, report)


def id_lists(fate: DataFrame, key: str) -> DataFrame:
    """(doc_id, retained_ids, discarded_ids) in input order, for documents that are looked at one by one."""
    rows = F.sort_array(F.collect_list(F.struct("ord", F.col(key).alias("id"), "retained")))
    kept, gone = F.filter("x", lambda r: r["retained"]), F.filter("x", lambda r: ~r["retained"])
    pick = [F.transform(c, lambda r: r["id"]).alias(f"{n}_ids") for c, n in ((kept, "retained"), (gone, "discarded"))]
    return fate.groupBy("doc_id").agg(rows.alias("x")).select("doc_id", *pick)
