"""Items that appear together: stripes of co-occurrence counts, then log-likelihood ratios.

Each task keeps one stripe per item, an associative array neighbour -> number of documents, and adds every document's
item set to it; stripes leave a task merged and are merged again by item. No pair is ever emitted per document. A document of
very many items is cut into blocks, and its pairs of blocks go to different tasks.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.util import cut

HELD = 500_000  # counters a task holds before it sends its stripes on
BLOCK = 1_000  # items of a document in a block, about
STRIPES = "item string, neighbours array<string>, counts array<long>"


def _batch(stripes: dict[str, Counter]) -> pa.RecordBatch:
    items = list(stripes)
    return pa.RecordBatch.from_arrays(
        [pa.array(items, pa.string()), pa.array([list(stripes[i]) for i in items], pa.list_(pa.string())), pa.array([list(stripes[i].values()) for i in items], pa.list_(pa.int64()))],
        names=["item", "neighbours", "counts"],
    )


def _stripe(batches):
    """Rows (items, others) to stripes: each item meets the others, itself among them in one row, so its stripe also holds its document count."""
    stripes, held = defaultdict(Counter), 0
    for b in batches:
        for items, others in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for a in items:
                own = stripes[a]
                held -= len(own)
                own.update(others)
                held += len(own)
                if held > HELD:
                    yield _batch(stripes)
                    stripes, held = defaultdict(Counter), 0
    if stripes:
        yield _batch(stripes)


def _merge(batches):
    """Merges the stripes of a partition by item."""
    stripes, held = defaultdict(Counter), 0
    for b in batches:
        for item, near, counts in zip(*(c.to_pylist() for c in b.columns)):
            own = stripes[item]
            held -= len(own)
            for x, n in zip(near, counts):
                own[x] += n
            held += len(own)
            if held > 4 * HELD:
                yield _batch(stripes)
                stripes, held = defaultdict(Counter), 0
    if stripes:
        yield _batch(stripes)


def least_llr(n_ab: Column, lift: float) -> Column:
    """The least log-likelihood ratio of a pair that occurs n_ab times and at least `lift` > 1 times as often as by chance.

    With e <= n_ab / lift expected, G^2 is at least that of the two cells 'both' and 'not both', 2 (n ln(n / e) + (N - n) ln((N - n) / (N - e))),
    of which the second part is at least e - n; so G^2 >= 2 (n ln(n / e) - (n - e)), which falls with e. The last digits are left to rounding.
    """
    return 2 * n_ab * (math.log(lift) - (1 - 1 / lift)) - 1e-6 * (1 + n_ab)


def _x_log_x(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c)).otherwise(0.0)


def cooccurrence(df: DataFrame, doc: str, item: str) -> DataFrame:
    """(item_a, item_b, n_docs, n_a, n_b, n_ab, lift, llr) of each pair item_a < item_b that shares a document.

    n_docs: documents with at least one item; a document counts once however often it holds an item, so copies don't matter.
    Null documents and null items are left out. llr is Dunning's G^2 of the 2x2 table, 0 or more; lift = n_ab n_docs / (n_a n_b).
    Item sets are collected per document and block of BLOCK items, so a row is bounded however wide a document is. An empty table gives no rows.
    """
    pairs = df.select(F.col(doc).alias("d"), F.col(item).alias("i")).where("d is not null and i is not null")
    wide = pairs.groupBy("d").agg(F.approx_count_distinct("i").alias("c")).where(F.col("c") > BLOCK).select("d", F.ceil(F.col("c") / BLOCK).cast("int").alias("k"))
    wide = cut(wide)
    if wide.isEmpty():
        sets = pairs.groupBy("d").agg(F.sort_array(F.collect_set("i")).alias("items")).select("items", F.col("items").alias("others"))
    else:
        parted = pairs.join(wide, "d", "left").withColumn("block", F.pmod(F.xxhash64("i"), F.coalesce("k", F.lit(1))).cast("int"))
        sets = parted.groupBy("d", "block").agg(F.sort_array(F.collect_set("i")).alias("items"), F.first("k").alias("k"))
        alone = sets.where("k is null").select("items", F.col("items").alias("others"))
        blocks = cut(sets.where("k is not null").select("d", "block", "items"))
        # every block meets every block of its document; the rows are blocks, not items, and each names its partner
        both = blocks.join(wide, "d").select("d", "items", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"))
        met = both.join(blocks.withColumnRenamed("items", "others"), ["d", "block"]).select("items", "others")
        sets = alone.unionByName(met)
    stripes = sets.mapInArrow(_stripe, STRIPES)
    # two merges: the first spreads an item that very many tasks met over salts
    merged = stripes.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("item", "salt").drop("salt").mapInArrow(_merge, STRIPES)
    merged = merged.repartition("item").mapInArrow(_merge, STRIPES)
    cells = merged.select("item", F.inline(F.arrays_zip("neighbours", "counts"))).groupBy("item", F.col("neighbours").alias("other")).agg(F.sum("counts").alias("n"))
    total = pairs.select("d").distinct().count()
    single = cells.where("item = other").select("item", "n")
    both = cells.where("item < other").select(F.col("item").alias("item_a"), F.col("other").alias("item_b"), F.col("n").alias("n_ab"))
    met = both.join(single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), "item_a").join(single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b")), "item_b")
    n, a, b, ab = F.lit(total).cast("long"), F.col("n_a"), F.col("n_b"), F.col("n_ab")
    k = [c.cast("double") for c in (ab, a - ab, b - ab, n - a - b + ab)]
    rows = _x_log_x(k[0] + k[1]) + _x_log_x(k[2] + k[3])
    cols = _x_log_x(k[0] + k[2]) + _x_log_x(k[1] + k[3])
    whole = sum((_x_log_x(c) for c in k[1:]), _x_log_x(k[0]))
    llr = F.greatest(F.lit(0.0), 2.0 * (whole - rows - cols + _x_log_x(n.cast("double"))))
    return met.select("item_a", "item_b", n.alias("n_docs"), "n_a", "n_b", "n_ab", (ab * n / (a * b)).alias("lift"), llr.alias("llr"))
