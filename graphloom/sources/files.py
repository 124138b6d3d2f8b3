"""Files in and out: texts, ontologies, stage tables, DOT images."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import MissingDependency, RenderError
from graphloom.ontology import Ontology


def load_text(path) -> str:
    """One whole file as UTF-8 text, on the driver."""
    return Path(path).read_text(encoding="utf-8")


def load_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file as one row, read by the executors."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def load_ontology(path) -> Ontology:
    return Ontology.from_yaml(path)


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Each stage table as Parquet, clustered by document so that later joins on doc_id read sorted runs."""
    for name, df in tables.items():
        (df.repartition("doc_id").sortWithinPartitions("doc_id") if "doc_id" in df.columns else df).write.mode(mode).parquet(f"{folder}/{name}")


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def write_dot(text: str, path) -> Path:
    """One DOT text to a file; the folder is made if need be."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def render(text: str, path, output_format: str | None = None, command: str = "dot") -> Path:
    """DOT text to an image by the Graphviz program; the format is the argument, else the file's suffix, else png."""
    path = Path(path)
    kind = output_format or path.suffix.lstrip(".") or "png"
    path.parent.mkdir(parents=True, exist_ok=True)
    program = shutil.which(command)
    if program:
        run = subprocess.run([program, f"-T{kind}", "-o", str(path)], input=text, text=True, capture_output=True)
        if run.returncode:
            raise RenderError(run.stderr.strip() or f"{command} ended with {run.returncode}")
        return path
    try:
        import pygraphviz
    except ImportError as e:
        raise MissingDependency("neither the Graphviz program nor pygraphviz is installed") from e
    pygraphviz.AGraph(string=text).draw(str(path), prog="dot")
    return path


def render_all(dots: DataFrame, folder: str, output_format: str = "png", command: str = "dot") -> DataFrame:
    """(doc_id, path, error): renders dots(doc_id, dot) on the executors into a shared folder; a failure is a row, not an end."""

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for doc, dot in zip(b["doc_id"], b["dot"]):
                try:
                    out.append((doc, str(render(dot, f"{folder}/{doc}.{output_format}", output_format, command)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((doc, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["doc_id", "path", "error"])

    return dots.mapInPandas(run, f"doc_id {dots.schema['doc_id'].dataType.simpleString()}, path string, error string")
