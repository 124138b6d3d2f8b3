"""Scalar text functions as Columns, with the semantics of Python's str methods where Spark's differ."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters that Python's str.split, str.strip and \s take for white space, as a Java character class.
_CODES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in _CODES) + "]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(c.rlike(rf"\A{SPACE}*\z"), F.lit(True))


def word_count(c: Column) -> Column:
    """Number of runs of other than white space; a null text has none."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), f"{SPACE}+"), lambda x: x != "")).cast("int")


def target_entities(words: Column, per_word: Column) -> Column:
    """Half-even rounding; at least 1 for a text with words and a positive density."""
    n = F.rint(words * per_word).cast("int")
    return F.when((words > 0) & (per_word > 0), F.greatest(F.lit(1), n)).otherwise(n)


def target_relations(entities: Column, per_entity: Column) -> Column:
    """Half-even rounding, no minimum."""
    return F.rint(entities * per_entity).cast("int")


def sentence_count(c: Column) -> Column:
    """Pieces of the stripped text cut after '.', '!' or '?' and white space; blank or null text has none."""
    return F.size(F.filter(F.split(strip(F.coalesce(c, F.lit(""))), rf"(?<=[.!?]){SPACE}+"), lambda x: x != "")).cast("int")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def dot_escape(c: Column) -> Column:
    """Backslash, then quote, then line feed, in this order."""
    for what, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(what), F.lit(by))
    return c


def node_label(ontology_type: Column, free_type: Column, mention: Column, canonical: Column, entity_id: Column) -> Column:
    """Type, if there is one, over mention; empty strings count as absent."""

    def some(*cs):
        return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))

    return F.concat_ws("\n", some(ontology_type, free_type), F.coalesce(some(mention, canonical), entity_id))


def edge_label(typed: Column, free: Column) -> Column:
    """Comma-joined non-empty types of the typed list, else of the free one."""

    def joined(c):
        return F.array_join(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x != ""), ", ")

    return F.when(joined(typed) != "", joined(typed)).otherwise(joined(free))


def graph_density(edges: Column, nodes: Column) -> Column:
    """2 m / (n (n - 1)) of the undirected simple graph; 0 without edges or with fewer than two nodes."""
    return F.when((edges == 0) | (nodes <= 1), F.lit(0.0)).otherwise(edges / (nodes * (nodes - 1)).cast("double") * 2.0)


def degree_limit(nodes: Column, fraction: float) -> Column:
    """The degree over which a node is a hub: the fraction of the other nodes, at least 2."""
    return F.greatest(F.lit(2), (F.lit(fraction) * (nodes - 1)).cast("int"))


@F.pandas_udf(StringType())
def fixed3(values: pd.Series) -> pd.Series:
    """Three decimals of the exact binary value, ties to even; no built-in formats so. Only for message texts."""
    return values.map(lambda v: None if v is None or pd.isna(v) else f"{v:.3f}")


@F.pandas_udf(StringType())
def quoted(values: pd.Series) -> pd.Series:
    """Python's repr of a string. Only for message texts."""
    return values.map(lambda v: None if v is None else repr(v))


@F.pandas_udf(StringType())
def quoted_list(values: pd.Series) -> pd.Series:
    """Python's repr of a list of strings. Only for message texts."""
    return values.map(lambda v: None if v is None else repr([str(x) for x in v]))
