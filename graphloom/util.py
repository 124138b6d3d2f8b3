"""Session helpers shared by all operators: lineage cuts, table reading, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The parquet table `table` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder: the one the session names in spark.checkpoint.dir; only where that is unset (tests, one machine) one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once, write it as a table to the shared folder and read it from there: a lineage cut that survives the loss of executors.

    A table rather than a checkpoint, for it is stored in compressed columns and later reads prune them. Tables are removed at the end of the
    `scratch` block that they were written in, by `release`, or when the session's JVM ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _filesystem(sc, path).deleteOnExit(sc._jvm.org.apache.hadoop.fs.Path(path))
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[str] = []
_SCRATCH = threading.local()  # a stream's batches run in a thread of their own


def _written() -> list[str]:
    """The list of the innermost scratch block of this thread, else the session's."""
    blocks = getattr(_SCRATCH, "blocks", None)
    return blocks[-1] if blocks else _TABLES


def _remove(spark: SparkSession, paths: list[str]) -> None:
    sc = spark.sparkContext
    while paths:
        path = paths.pop()
        _filesystem(sc, path).delete(sc._jvm.org.apache.hadoop.fs.Path(path), True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that `cut` writes within the block are removed at its end: results must be written before."""
    if not hasattr(_SCRATCH, "blocks"):
        _SCRATCH.blocks = []
    _SCRATCH.blocks.append([])
    try:
        yield
    finally:
        _remove(spark, _SCRATCH.blocks.pop())


def _filesystem(sc, path: str):
    return sc._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(sc._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Removes every table that `cut` has written outside of scratch blocks; results that still rest on them can't be read any more."""
    _remove(spark, _TABLES)


def small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark `df` for broadcast if it has at most `max_rows` rows, counted over `limit(max_rows + 1)`; else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def frequent(df: DataFrame, keys: dict[str, Column], most: int, tracked: int = 8_192, mergers: int = 64) -> tuple[int, dict[str, list[tuple[str, int]]]]:
    """The number of rows, and per key its at most `most` most frequent non-null values with their counts, as a sketch estimates them.

    One pass over all rows; every task keeps a sketch of `tracked` values per key. Sketches are merged by `mergers` tasks and then by one, so
    the last one gets as many sketches as there are mergers, however many tasks the input has. A value that is in more than about
    rows / (0.75 * tracked) rows is never missed. Only the values found are collected.
    """
    cols = df.select(*(c.alias(f"k{i}") for i, c in enumerate(keys.values())))
    sketch = [F.expr(f"approx_top_k_accumulate(k{i}, {tracked})").alias(f"s{i}") for i in range(len(keys))]
    parts = cols.groupBy(F.pmod(F.spark_partition_id(), F.lit(mergers)).alias("m")).agg(F.count(F.lit(1)).alias("n"), *sketch)
    last = [F.expr(f"approx_top_k_estimate(approx_top_k_combine(s{i}, {tracked}), {most})").alias(f"t{i}") for i in range(len(keys))]
    got = parts.groupBy(F.lit(0).alias("all")).agg(F.sum("n").alias("n"), *last).first()  # grouped, for an empty table has no sketch to merge
    if got is None:
        return 0, {k: [] for k in keys}
    return got["n"], {k: [(x["item"], x["count"]) for x in got[f"t{i}"] or [] if x["item"] is not None] for i, k in enumerate(keys)}
