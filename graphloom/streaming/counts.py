"""Streams of records: event-time counts with late data, sessions, copies within a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.util import folder


def type_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(window, type, n): records per event-time window and type; records later than `late` are dropped once their window is closed."""
    frame = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, late).groupBy(frame.alias("window"), F.col(kind).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, window, n): runs of records of a key with no gap of `gap` between them."""
    return stream.withWatermark(time, late).groupBy(F.col(key), F.session_window(time, gap).alias("window")).agg(F.count(F.lit(1)).alias("n"))


def without_copies(stream: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """Drops records delivered again within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame) -> DataFrame:
    """The final rows of an aggregating stream over what its source holds now, as a table in the shared folder.

    Every batch's updated rows are written with the batch's number, and the latest of a row's keys counts; all columns but `n` are keys.
    """
    path = f"{folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    stream.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{path}/rows/*")
    keys = [c for c in stream.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
