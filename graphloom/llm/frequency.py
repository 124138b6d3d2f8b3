"""Frequency of every distinct term: records and documents that hold it, by heavy-light aggregation.

Rows are exchanged once, by document, which brings copies of a record and all records of a document together. Heavy terms, found by a
frequent-items sketch and broadcast as a table term -> slot, are then counted where they are: every task adds them to exact local counter arrays and
sends on one row per slot. Only light terms are shuffled by term, added up within the task before. Both count tables meet in one union. Documents
with more rows than a task's share are spread over records; only for them a term's documents are told apart after the exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.util import frequent

HEAVY = 2_048  # most heavy terms over all fields; as many keys of at most LONG bytes are broadcast
SHARE = 5_000  # heavy: at least one row in so many, or in twice as many as there are partitions
LONG = 256  # bytes; a longer term is never broadcast, it is light, and light terms are added up before they are shuffled
SALTS = 64  # a document with more rows than a 64th, or a partition's share, is spread over as many keys as there are partitions


def _counter_arrays(slots: int):
    """(slot, f, t, d, n, own) rows to (slot, f, t, d, n_records, n_docs): heavy rows go into one pair of counter arrays per task, light ones pass."""

    def run(batches):
        records, documents = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
        names = ["slot", "f", "t", "d", "n_records", "n_docs"]
        kinds = None
        for b in batches:
            kinds = [c.type for c in b.columns]
            slot, n, own = b.column(0), b.column(4), b.column(5)
            heavy = np.asarray(slot.is_valid()) & np.asarray(b.column(3).is_null())
            at = slot.fill_null(0).to_numpy(zero_copy_only=False)[heavy]
            records += np.bincount(at, np.asarray(n)[heavy], slots).astype(np.int64)
            documents += np.bincount(at, np.asarray(own)[heavy], slots).astype(np.int64)
            rest = b.filter(pa.array(~heavy))
            yield pa.RecordBatch.from_arrays(rest.columns, names=names)
        if kinds is not None:
            met = np.flatnonzero(records)
            none = [pa.nulls(len(met), k) for k in kinds[1:4]]
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *none, pa.array(records[met]), pa.array(documents[met])], names=names)

    return run


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def term_frequencies(df: DataFrame, terms: list[str], record: str, doc: str = "doc_id", heavy: int = HEAVY, salts: int = SALTS) -> DataFrame:
    """(field, term, n_records, n_docs) of every distinct value of each column of `terms`, null and '' left out.

    n_records: distinct (doc, record) that hold the term, so copies count once; rows without a record id count once per document.
    n_docs: distinct documents, rows without a document id not counted. An empty table gives no rows. Terms compare exactly.
    The table is read twice: for the sketch, and for the counts.
    """
    spark, parts = df.sparkSession, _partitions(df)
    base = df.select(F.col(doc).alias("d"), F.col(record).alias("r"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(terms)))
    short: dict[str, Column] = {f"t{i}": F.when(F.octet_length(f"t{i}") <= LONG, F.nullif(f"t{i}", F.lit(""))) for i in range(len(terms))}
    n, found = frequent(base, {"d": F.col("d"), **short}, max(1, heavy), max(8_192, 2 * parts))
    share, big = max(SHARE, 2 * parts), max(salts, parts)
    keys = [(i, v) for i in range(len(terms)) for v, k in found[f"t{i}"] if heavy and k * share >= n]
    hot = [v for v, k in found["d"] if k * big >= n]
    spread = F.pmod(F.xxhash64("r"), F.lit(parts))
    kind = base.schema["d"].dataType.simpleString()
    if hot:  # as many as partitions at most
        known = F.broadcast(spark.createDataFrame([(v,) for v in hot], f"d {kind}").withColumn("hot", F.lit(True)))
        base = base.join(known, "d", "left")
    else:
        base = base.withColumn("hot", F.lit(None).cast("boolean"))
    salt = F.when(F.col("hot") | F.col("d").isNull(), spread).otherwise(F.lit(0))
    fields = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"t{i}").alias("t")) for i in range(len(terms))))
    rows = base.withColumn("salt", salt).repartition("d", "salt").select("d", "salt", "hot", "r", F.inline(fields)).where("t <> ''")
    # copies of a record, then records of a document: both lie within the partition, so neither needs another exchange
    one = rows.groupBy("d", "salt", "hot", "f", "t", "r").agg(F.lit(1).alias("x")).groupBy("d", "salt", "hot", "f", "t").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("d").isNull() | F.col("hot"), 0).otherwise(1).cast("long")
    one = one.select("f", "t", F.when(F.col("hot"), F.col("d")).alias("d"), "n", own.alias("own"))
    if keys:
        slots = F.broadcast(spark.createDataFrame([(s, f, t) for s, (f, t) in enumerate(keys)], "slot int, f int, t string"))
        met = one.join(slots, ["f", "t"], "left").select("slot", "f", "t", "d", "n", "own")
        out = met.mapInArrow(_counter_arrays(len(keys)), f"slot int, f int, t string, d {kind}, n_records long, n_docs long")
        light = out.where("f is not null").select("f", "t", "d", "n_records", "n_docs")
        exact = out.where("f is null").select("slot", "n_records", "n_docs").join(slots, "slot").select("f", "t", F.lit(None).cast(kind).alias("d"), "n_records", "n_docs")
        counts = light.unionByName(exact)
    else:
        counts = one.select("f", "t", "d", F.col("n").alias("n_records"), F.col("own").alias("n_docs"))
    # a spread document has one row per term here, whatever its records; all others have d null
    docs = counts.groupBy("f", "t", "d").agg(F.sum("n_records").alias("n_records"), F.sum("n_docs").alias("n_docs"))
    total = docs.groupBy("f", "t").agg(F.sum("n_records").alias("n_records"), (F.sum("n_docs") + F.count("d")).alias("n_docs"))
    names = F.element_at(F.array(*map(F.lit, terms)), F.col("f") + 1)
    return total.select(names.alias("field"), F.col("t").alias("term"), "n_records", "n_docs")


def term_frequency(df: DataFrame, term: str, record: str, doc: str = "doc_id", heavy: int = HEAVY, salts: int = SALTS) -> DataFrame:
    """(term, n_records, n_docs) of one column."""
    return term_frequencies(df, [term], record, doc, heavy, salts).drop("field")


def marked(counts: DataFrame, n_docs: int, common_share: int = 10, rare_docs: int = 1) -> DataFrame:
    """Adds `mark`: 'common' if at least one document in `common_share` holds the term, else 'rare' if at most `rare_docs` do, else ''."""
    common = F.col("n_docs") * common_share >= n_docs
    return counts.withColumn("mark", F.when(common, "common").when(F.col("n_docs") <= rare_docs, "rare").otherwise(""))


def document_count(df: DataFrame, doc: str = "doc_id") -> int:
    return df.select(doc).where(F.col(doc).isNotNull()).distinct().count()
