"""Orphan references: a fixpoint cascade of semi-joins down the foreign-key graph.

A reference is *directly* orphaned when the row it names is missing, withdrawn or loaded later than the
record that holds it. Every row that refers to an orphaned record is orphaned by *inheritance*; the
cascade repeats this, level by level, until a level adds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.util import cut, frequent

MAX_HOT = 2_000  # hot keys per reference column; as HOT_SHARE says, there can't be more
HOT_SHARE = 2_000  # a key (scope and reference) is hot when it has at least one row in so many


@dataclass(frozen=True)
class Table:
    """A table of the key graph. `scope` columns are part of every key; `loaded`/`deleted` are arrival and withdrawal times.

    `event` is the time whose month is the reporting period. `deleted` may be None: rows are never withdrawn.
    """

    name: str
    df: DataFrame
    key: str
    event: str
    scope: tuple[str, ...] = ("doc_id",)
    loaded: str = "loaded_at"
    deleted: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str


@dataclass
class Cascade:
    """direct: one row per orphan reference; inherited: one row per reference to an orphaned record, with its level."""

    direct: DataFrame
    inherited: DataFrame
    levels: int = field(default=0)


def _scoped(table: Table) -> list[Column]:
    return [F.col(c).alias(f"s{i}") for i, c in enumerate(table.scope)]


def _records(table: Table, fks: list[ForeignKey]) -> DataFrame:
    """One row per record and reference: scope, record, field, ref, period, arrival (earliest over copies)."""
    scope = [f"s{i}" for i in range(len(table.scope))]
    refs = [F.struct(F.lit(k.column).alias("field_name"), F.col(k.column).alias("ref"), F.lit(k.parent).alias("parent")) for k in fks]
    rows = table.df.select(
        *_scoped(table), F.col(table.key).alias("record_id"), F.date_format(table.event, "yyyy-MM").alias("period"),
        F.col(table.loaded).alias("at"), F.array(*refs).alias("refs"),
    )
    # the copies of a record agree in everything but the arrival, so they meet in one group
    one = rows.groupBy(*scope, "record_id", "period", "refs").agg(F.min("at").alias("at"))
    return one.select(*scope, "record_id", "period", "at", F.inline("refs")).where(F.length("ref") > 0)


def _parents(table: Table) -> DataFrame:
    """Per key: earliest arrival and earliest withdrawal over its rows."""
    scope = [f"s{i}" for i in range(len(table.scope))]
    gone = F.col(table.deleted) if table.deleted else F.lit(None).cast("timestamp")
    return (
        table.df.select(*_scoped(table), F.col(table.key).alias("ref"), F.col(table.loaded).alias("a"), gone.alias("g"))
        .where(F.col("ref").isNotNull()).groupBy(*scope, "ref").agg(F.min("a").alias("first_in"), F.min("g").alias("first_out"))
    )


def _key(*columns: str) -> Column:
    """Scope and reference as one string; null for long ones, which are never hot."""
    whole = F.concat_ws("\0", *(F.col(c).cast("string") for c in columns))
    return F.when(F.octet_length(whole) <= 256, whole)


def _hot(tables: dict[str, Table], fks: list[ForeignKey]) -> list[tuple[str, str]]:
    """(parent, key) of the hot references, by frequent-items sketches over all rows of the child tables; no row is shuffled."""
    out = set()
    for name in dict.fromkeys(k.child for k in fks):
        child, own = tables[name], [k for k in fks if k.child == name]
        n, found = frequent(child.df, {k.column: F.when(F.length(k.column) > 0, _key(*child.scope, k.column)) for k in own}, MAX_HOT)
        out |= {(k.parent, v) for k in own for v, rows in found[k.column] if rows * HOT_SHARE >= n}
    return sorted(out)


class _References:
    """References joined to tables of their targets: hot keys meet a broadcast of the targets they name, the rest is shuffled.

    `rows` is written once, with a mark at the hot ones. The targets hold one row per key, so the broadcast holds at most as many as there are hot keys.
    """

    def __init__(self, rows: DataFrame, scope: list[str], hot: list[tuple[str, str]]):
        self.on = ["parent", *scope, "ref"]
        self.keys = rows.sparkSession.createDataFrame(hot, "parent string, key string") if hot else None
        self.key = _key(*scope, "ref")
        marked = rows.withColumn("hot", F.lit(False))
        if self.keys is not None:
            known = F.broadcast(self.keys.withColumn("known", F.lit(True)))
            marked = rows.withColumn("key", self.key).join(known, ["parent", "key"], "left").withColumn("hot", F.coalesce("known", F.lit(False))).drop("key", "known")
        self.rows = cut(marked)

    def meet(self, targets: DataFrame, how: str, parents: list[str] | None = None) -> DataFrame:
        rows = self.rows if parents is None else self.rows.where(F.col("parent").isin(parents))
        if self.keys is None:
            return rows.join(targets, self.on, how).drop("hot")
        few = targets.withColumn("key", self.key).join(F.broadcast(self.keys), ["parent", "key"], "left_semi").drop("key")
        return rows.where("hot").join(F.broadcast(few), self.on, how).unionByName(rows.where("not hot").join(targets, self.on, how)).drop("hot")


def orphan_cascade(tables: dict[str, Table], fks: list[ForeignKey], max_levels: int | None = None) -> Cascade:
    """Orphan references level by level down the key graph, to the fixpoint.

    Level 0, direct: rows (scope.., table_name, field_name, record_id, period, ref) whose reference leads nowhere when the record arrives. Null and
    empty references are no references. A record's arrival is its earliest one over copies; it is orphaned if no parent row has its scope and
    key, or the parent's earliest arrival is later, or its earliest withdrawal is not later. A null arrival of the record counts as never
    known and is not compared: the reference is then orphaned only if missing.

    Every further level semi-joins the references to the records orphaned in the one before (the frontier) and keeps those that are not orphaned yet,
    with the level at which they were reached, until a level adds nothing or no table refers to the frontier's. Cycles end too: a record joins the
    frontier once. References and frontiers are written tables. Where `max_levels` is set, a cascade that is deeper raises RuntimeError. Empty
    tables give empty results.
    """
    width = max(len(t.scope) for t in tables.values())
    scope = [f"s{i}" for i in range(width)]
    columns = [*scope, "table_name", "field_name", "record_id", "period", "ref"]
    same = [*scope, "table_name", "field_name", "record_id"]
    rows = known = None
    for name in dict.fromkeys(k.child for k in fks):
        part = _records(tables[name], [k for k in fks if k.child == name]).withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    for name in dict.fromkeys(k.parent for k in fks):
        part = _parents(tables[name]).withColumn("parent", F.lit(name))
        known = part if known is None else known.unionByName(part)
    refs = _References(rows, scope, _hot(tables, fks))
    lost = F.col("first_in").isNull() | (F.col("first_in") > F.col("at")) | (F.col("first_out") <= F.col("at"))
    direct = cut(refs.meet(known, "left").where(lost).select(*columns))
    found, level, new = None, 0, direct
    reached = {k.child for k in fks}
    seen = None
    while down := [k for k in fks if k.parent in reached]:
        frontier = new.select(*scope, "table_name", "record_id").where(F.col("record_id").isNotNull()).distinct()
        frontier = cut(frontier if seen is None else frontier.join(seen, [*scope, "table_name", "record_id"], "left_anti"))
        seen = frontier if seen is None else seen.unionByName(frontier)
        gone = frontier.withColumnsRenamed({"table_name": "parent", "record_id": "ref"})
        step = refs.meet(gone, "left_semi", sorted({k.parent for k in down})).select(*columns).join(direct, same, "left_anti")
        level += 1
        new = cut((step if found is None else step.join(found, same, "left_anti")).withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        if max_levels is not None and level > max_levels:
            raise RuntimeError(f"orphans are inherited over more than {max_levels} levels")
        found = new if found is None else found.unionByName(new)
        reached = {k.child for k in down}
    empty = direct.withColumn("level", F.lit(0)).limit(0)
    return Cascade(direct, empty if found is None else found, level)


def orphan_report(cascade: Cascade) -> DataFrame:
    """Per table, field and period: the records directly orphaned and orphaned by inheritance."""
    both = cascade.direct.withColumn("level", F.lit(0)).unionByName(cascade.inherited)
    return both.groupBy("table_name", "field_name", "period").agg(
        F.count(F.when(F.col("level") == 0, 1)).alias("direct_orphans"),
        F.count(F.when(F.col("level") > 0, 1)).alias("inherited_orphans"),
        F.max("level").alias("deepest_level"),
    )
