"""Streams of documents: the batch operators on micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.plans.pipeline import Pipeline
from graphloom.util import scratch


def run_stream(docs: DataFrame, pipeline: Pipeline, folder: str, checkpoint: str, trigger: dict | None = None):
    """Runs the pipeline on every micro-batch of a document stream and appends its tables below `folder`, one folder per batch.

    Every operator works within a document, so a batch needs no state of earlier ones. A batch that is run again after a failure
    overwrites its own folder, which makes the output exactly-once. A batch's working tables are removed with it.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        with scratch(batch.sparkSession):
            result = pipeline.run(batch.dropDuplicates(["doc_id"]))
            for name in ("nodes", "edges", "final_report", "runs", "quarantine"):
                getattr(result, name).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Any operator within documents on every micro-batch, one output folder per batch."""

    def step(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
