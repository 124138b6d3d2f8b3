"""Levels of interpretation: vectors, clusters as concepts, graphs of concepts, lineage down to the base graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.util import cut, small


def dot_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of one length; null if either is a null or zero vector."""
    n = F.sqrt(dot_product(a, a)) * F.sqrt(dot_product(b, b))
    return F.when(n > 0, dot_product(a, b) / n)


def clusters(vectors: DataFrame, column: str, k: int = 10, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(members, centroids): vectors with `concept_id`, and (concept_id, centroid). Null vectors are left out."""
    rows = vectors.where(F.col(column).isNotNull()).withColumn("__v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="concept_id", maxIter=20).fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return model.transform(rows).drop("__v"), vectors.sparkSession.createDataFrame(centres, "concept_id int, centroid array<double>")


def motif_vectors(features: DataFrame, motifs: list[str]) -> DataFrame:
    """(doc_id, vector): the counts of the given motifs per document, scaled to length 1, for clusters by structure. At most 1,000 motifs.

    Documents with none of them get a zero vector.
    """
    if len(motifs) > 1_000:
        raise ValueError("over 1,000 motifs")
    places = features.sparkSession.createDataFrame([(m, i) for i, m in enumerate(motifs)], "motif string, i int")
    met = features.join(F.broadcast(places), "motif", "left").groupBy("doc_id", "i").agg(F.sum("n").cast("double").alias("n"))
    held = met.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "n")))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(len(motifs) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))) if motifs else F.array().cast("array<double>")
    norm = F.sqrt(dot_product(F.col("raw"), F.col("raw")))
    return held.select("doc_id", raw.alias("raw")).select("doc_id", F.when(norm > 0, F.transform("raw", lambda x: x / norm)).otherwise(F.col("raw")).alias("vector"))


def recognise(vectors: DataFrame, column: str, centroids: DataFrame, least: float = -1.0) -> DataFrame:
    """`vectors` with the concept of the closest centroid by cosine and the similarity; null under `least` or for a null vector.

    The centroids are few (a model's k) and checked; they go to the tasks as one matrix, and vectors meet it in Arrow batches. Of equally
    close centroids the least concept counts. Vectors of another length, or with a null in them, are null ones.
    """
    known = sorted(centroids.limit(1_001).collect(), key=lambda r: r["concept_id"])
    if len(known) > 1_000:
        raise ValueError("over 1,000 concepts")
    matrix = np.array([r["centroid"] for r in known], float).reshape(len(known), -1)
    length = np.linalg.norm(matrix, axis=1)
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["concept_id"] for r in known]), matrix / np.where(length > 0, length, np.nan)[:, None]))
    at, names = vectors.columns.index(column), [*vectors.columns, "concept_id", "similarity"]

    def run(batches):
        concepts, centres = shared.value
        for b in batches:
            ids, near = [], []
            for v in b.column(at).to_pylist():
                x = np.array(v, float) if v is not None and len(v) == centres.shape[1] and None not in v else np.zeros(centres.shape[1])
                cos = centres @ (x / n) if (n := np.linalg.norm(x)) > 0 else np.full(len(centres), np.nan)
                best = int(np.nanargmax(cos)) if not np.isnan(cos).all() else -1
                ok = best >= 0 and cos[best] >= least
                ids.append(int(concepts[best]) if ok else None)
                near.append(float(cos[best]) if ok else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int32()), pa.array(near, pa.float64())], names=names)

    return vectors.mapInArrow(run, T.StructType([*vectors.schema.fields, T.StructField("concept_id", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))


def lift(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, lineage) of the next level.

    concepts(doc_id, entity_id, concept_id): nodes of one concept and document become one node '<level>:<concept>'; nodes without a concept stay out.
    Edges join the concepts of their ends, one per pair and type with the number of base edges (the sum of `n_base`, where the edges have it); edges within a concept are its own and vanish.
    lineage(level, doc_id, concept_id, base_entity_id) leads every new node back to the nodes below it.
    """
    name = F.concat(F.lit(f"{level}:"), F.col("concept_id").cast("string"))
    of = concepts.where("concept_id is not null").select("doc_id", "entity_id", name.alias("concept")).distinct()
    of = of.join(nodes.select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi")
    above = of.groupBy("doc_id", F.col("concept").alias("entity_id")).agg(F.count(F.lit(1)).alias("n_base"))
    ends = edges.join(of.withColumnsRenamed({"entity_id": "source_id", "concept": "s"}), ["doc_id", "source_id"]).join(of.withColumnsRenamed({"entity_id": "target_id", "concept": "t"}), ["doc_id", "target_id"])
    joined = ends.where("s <> t").groupBy("doc_id", F.col("s").alias("source_id"), F.col("t").alias("target_id"), "type").agg((F.sum("n_base") if "n_base" in edges.columns else F.count(F.lit(1))).alias("n_base"))
    return above, joined, of.select(F.lit(level).alias("level"), "doc_id", F.col("concept").alias("concept_id"), F.col("entity_id").alias("base_entity_id"))


def levels(nodes: DataFrame, edges: DataFrame, concepts: DataFrame, above: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, lineage) of all levels of interpretation, each with its number in `level`, the base graph being level 0.

    concepts(doc_id, entity_id, concept_id) names the concept of base nodes; above(concept_id, parent) the concept over each concept. A concept
    without one stays as it is on higher levels. Levels are lifted from one another until no concept has another one above it, at most one level
    per concept in `above`; a cycle therefore raises RuntimeError. lineage leads every node to those one level below.
    """
    up = small(above.where("concept_id is not null and parent is not null and concept_id <> parent").select(F.col("concept_id").alias("was"), "parent").dropDuplicates(["was"]))
    most = up.count() + 1
    columns = ["level", "doc_id", "entity_id"]
    every_node = nodes.select(F.lit(0).alias("level"), "doc_id", "entity_id")
    every_edge = edges.select(F.lit(0).alias("level"), "doc_id", "source_id", "target_id", "type", F.lit(1).cast("long").alias("n_base"))
    every_line = None
    at, of = (nodes, edges), concepts
    for level in range(1, most + 1):
        n, e, line = lift(*at, of, level)
        n, e, line = cut(n), cut(e), cut(line)
        every_node = every_node.unionByName(n.select(F.lit(level).alias("level"), "doc_id", "entity_id"))
        every_edge = every_edge.unionByName(e.select(F.lit(level).alias("level"), "doc_id", "source_id", "target_id", "type", "n_base"))
        every_line = line if every_line is None else every_line.unionByName(line)
        here = n.select("doc_id", "entity_id", F.substring("entity_id", len(f"{level}:") + 1, 1 << 30).alias("was")).join(up, "was", "left")
        if here.where("parent is not null").isEmpty():
            return every_node.select(*columns), every_edge, every_line
        at, of = (n, e), here.select("doc_id", "entity_id", F.coalesce("parent", "was").alias("concept_id"))
    raise RuntimeError("concepts lie above each other in a circle")


def split_by_time(labels: DataFrame, times: DataFrame, at: str) -> DataFrame:
    """labels with `part`: 'before' or 'after' the moment `at`, by times(doc_id, time); documents without a time are left out."""
    met = labels.join(times.where("time is not null").groupBy("doc_id").agg(F.min("time").alias("time")), "doc_id")
    return met.withColumn("part", F.when(F.col("time") < F.lit(at).cast("timestamp"), "before").otherwise("after")).drop("time")
