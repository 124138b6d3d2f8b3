"""Graphs as DOT text, in a fixed order: header, nodes by id, edges by source, target and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.errors import RenderError
from graphloom.functions.text import dot_escape, edge_label, node_label
from graphloom.operators.graph import unlabeled

DEFAULT_NAME = "DocumentGraph"
MAX_LINES = 200_000  # lines of a graph that dot_texts puts into one string


def _q(c):
    return F.concat(F.lit('"'), dot_escape(c), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame, name: str = DEFAULT_NAME, edge_labels: bool = True, require_types: bool = False, directed: bool = True) -> DataFrame:
    """(doc_id, section, k1, k2, k3, line): sorted by (section, k1, k2, k3) the lines are the document's DOT text.

    Every line is made on its own, so a graph of any size is written by many tasks. Ties in the order are equal lines. `require_types`
    raises if any node or edge is without its ontology label. Nodes and edges are those of build_nodes and build_edges.
    """
    typed = "ontology_type" in nodes.columns
    if require_types:
        if not typed or not unlabeled(nodes, edges).isEmpty():
            raise RenderError("nodes or edges without ontology labels")
    empty = F.lit("")
    label = node_label(F.col("ontology_type") if typed else F.lit(None).cast("string"), F.col("free_type"), F.col("mention_text"), F.col("canonical_name") if typed else F.lit(None).cast("string"), F.col("entity_id"))
    docs = nodes.select("doc_id").union(edges.select("doc_id")).distinct()
    head = f'{"digraph" if directed else "graph"} "{name.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34))}" {{'
    frame = [F.struct(F.lit(k).alias("section"), F.lit(t).alias("line")) for k, t in ((0, head), (1, "  rankdir=LR;"), (4, "}"))]
    outer = docs.select("doc_id", F.inline(F.array(*frame))).select("doc_id", "section", empty.alias("k1"), empty.alias("k2"), empty.alias("k3"), "line")
    # fixed formats of node and edge lines
    dots = nodes.select("doc_id", F.lit(2).alias("section"), F.col("entity_id").alias("k1"), empty.alias("k2"), empty.alias("k3"), F.concat(F.lit("  "), _q(F.col("entity_id")), F.lit(" [label="), _q(label), F.lit(", shape=box];")).alias("line"))
    text = edge_label(F.col("ontology_relations.ontology_type"), F.col("raw_relations.free_type"))
    shown = F.when((text != "") & F.lit(edge_labels), F.concat(F.lit(", label="), _q(text))).otherwise(empty)
    arrow = F.lit(" -> " if directed else " -- ")
    line = F.concat(F.lit("  "), _q(F.col("source_id")), arrow, _q(F.col("target_id")), F.lit(' [color="#555555"'), shown, F.lit("];"))
    return outer.unionByName(dots).unionByName(edges.select("doc_id", F.lit(3).alias("section"), F.col("source_id").alias("k1"), F.col("target_id").alias("k2"), text.alias("k3"), line.alias("line")))


def dot_texts(lines: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """(doc_id, n_lines, dot): one text per document, with a final line feed. Where a document has over `max_lines` dot is null: write_dot_lines writes it."""
    sizes = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    few = sizes.where(F.col("n_lines") <= max_lines).select("doc_id")
    whole = lines.join(few, "doc_id", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section", "k1", "k2", "k3", "line"))).alias("x"))
    return sizes.join(whole, "doc_id", "left").select("doc_id", "n_lines", F.concat(F.array_join("x.line", "\n"), F.lit("\n")).alias("dot"))


def numbered(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of documents that fit a task; for comparison and display."""
    w = Window.partitionBy("doc_id").orderBy("section", "k1", "k2", "k3")
    return lines.select("doc_id", F.row_number().over(w).alias("line_no"), "line")


def write_dot_lines(lines: DataFrame, path: str) -> None:
    """All graphs as text, one folder per document, range-partitioned by document and order, so files in name order make the text."""
    keys = ["doc_id", "section", "k1", "k2", "k3"]
    lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "line").write.mode("overwrite").partitionBy("doc_id").text(path)
