"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets the same expected number of copies of each of its documents: target tokens / tokens it has. The whole part is
given to every document; the fraction is rounded pivotally: two fractional documents meet, tokens move between them at random, without bias,
until one of the two is integral. A source's tokens are kept exactly in every meeting. Each task rounds its own documents and leaves at
most one fraction per source; the residues meet in a reduction tree, level by level, until one per source is left, rounded last.
"""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.util import cut

FAN_IN = 64  # residues of a source that meet in one task of the tree
PART = 20_000  # documents of a source that one group of the first level holds, about
MAX_SOURCES = 10_000  # rows of the target table, which is collected


def _uniform(seed: int, a, b) -> float:
    """A number in [0, 1) that depends on the seed and the two keys alone, so a task that runs again decides the same."""
    return xxhash.xxh3_64_intdigest(f"{seed}|{a}|{b}") / 2.0**64


def pivotal(rows: list[tuple[object, int, float]], seed: int) -> tuple[list[tuple[object, int]], tuple[object, int, float] | None]:
    """Rounds (key, size, fraction) in order: the decided (key, 0 or 1), and the one residue if the sizes don't come out even.

    The sum of size * value is the same before and after, the residue included; the expectation of each value is its fraction.
    """
    decided, held = [], None
    for key, size, p in rows:
        if p <= 1e-12 or p >= 1 - 1e-12 or size <= 0:
            decided.append((key, int(p > 0.5)))
            continue
        if held is None:
            held = (key, size, p)
            continue
        k2, s2, p2 = held
        up = min((1 - p) * size, p2 * s2)  # tokens that can move to the new one
        down = min(p * size, (1 - p2) * s2)  # and from it
        move = up if _uniform(seed, key, k2) * (up + down) < down else -down
        a, b = p + move / size, p2 - move / s2
        a, b = (min(1.0, max(0.0, x)) for x in (a, b))
        a_done, b_done = min(a, 1 - a) <= 1e-12, min(b, 1 - b) <= 1e-12
        held = None
        for k, s, x, done in ((key, size, a, a_done), (k2, s2, b, b_done)):
            if done:
                decided.append((k, round(x)))
            else:
                held = (k, s, x)
    return decided, held


def _round_groups(seed: int):
    """(group, source, key, size, p) sorted by source, group, key: decided rows with value, residues with their fraction."""

    def run(batches):
        open_rows: list = []
        now = None

        def close():
            done, rest = pivotal([(k, n, p) for k, n, p in open_rows], seed)
            sizes = {k: n for k, n, _ in open_rows}
            out = [(now[0], now[1], k, sizes[k], float(v), True) for k, v in done]
            if rest:
                out.append((now[0], now[1], rest[0], rest[1], rest[2], False))
            return out

        for b in batches:
            out = []
            for source, group, key, size, p in zip(*(c.to_pylist() for c in b.columns)):
                if (source, group) != now:
                    if open_rows:
                        out += close()
                    now, open_rows = (source, group), []
                open_rows.append((key, size, p))
                if len(open_rows) >= 4096:  # keep the residue, let the decided go
                    part = close()
                    rest = [r for r in part if not r[5]]
                    out += [r for r in part if r[5]]
                    open_rows = [(r[2], r[3], r[4]) for r in rest]
            yield _rows(out, b)
        if open_rows:
            yield _rows(close(), b)

    def _rows(out, b):
        cols = list(zip(*out)) or [()] * 6
        kinds = [b.schema[0].type, b.schema[1].type, b.schema[2].type, pa.int64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["source", "part", "key", "size", "p", "done"])

    return run


class Mixture:
    """rows: (key, source, n_tokens, copies) of every document of a listed source; report: shares per source.

    The total is the largest one at which every listed source that has tokens can supply its share within its repeats, or `total`
    if that is smaller. Shares count among the sources that have documents: a listed source without any supplies nothing and is reported
    with 0; documents of sources not listed, and with a null source, aren't used. Documents without tokens get no copy; rows of one key and source are one document, rows without a key none.
    """

    def __init__(self, sizes: DataFrame, targets: DataFrame, key: str = "doc_id", total: float | None = None, seed: int = 17):
        self.key = key
        spark = sizes.sparkSession
        wanted = targets.select("source", "target_share", "max_repeats").where("source is not null").limit(MAX_SOURCES + 1).collect()
        if len(wanted) > MAX_SOURCES:
            raise ValueError(f"over {MAX_SOURCES} sources")
        # the last row of a source counts; a null share or repeat is 0
        wanted = list({r["source"]: {k: v or 0 for k, v in r.asDict().items()} for r in wanted}.values())
        rows = sizes.select(F.col(key).alias("key"), "source", F.col("n_tokens").alias("size")).where("key is not null")
        rows = rows.groupBy("key", "source").agg(F.max("size").alias("size"))
        listed = F.broadcast(spark.createDataFrame([(r["source"],) for r in wanted], "source string"))  # at most MAX_SOURCES
        stock = {r["source"]: r for r in rows.join(listed, "source", "left_semi").groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}
        has = {r["source"]: r for r in wanted if r["source"] in stock and (stock[r["source"]]["tokens"] or 0) > 0 and r["target_share"] > 0 and r["max_repeats"] > 0}
        share = sum(r["target_share"] for r in has.values()) or 1.0
        most = min((r["max_repeats"] * stock[s]["tokens"] * share / r["target_share"] for s, r in has.items()), default=0.0)
        self.total = min(most, total) if total is not None else most
        plan = []
        for r in wanted:
            s = r["source"]
            docs, tokens = (stock[s]["docs"], stock[s]["tokens"] or 0) if s in stock else (0, 0)
            each = min(float(r["max_repeats"]), self.total * r["target_share"] / share / tokens) if s in has else 0.0
            whole = math.floor(each + 1e-9)
            plan.append((s, float(r["target_share"]), int(r["max_repeats"]), int(docs), int(tokens), int(whole), max(0.0, each - whole) if each - whole > 1e-9 else 0.0))
        self.plan = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, n_docs long, tokens long, whole int, fraction double")
        near = F.broadcast(self.plan.select("source", "whole", "fraction", F.greatest(F.lit(1), (F.col("n_docs") / PART).cast("int")).alias("groups")))
        known = rows.join(near, "source")
        # groups by hash: a source with a third of all documents is rounded in many tasks
        open_rows = known.where("fraction > 0 and size > 0").select("source", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("groups")).alias("part"), "key", "size", F.col("fraction").alias("p"))
        kind = rows.schema["key"].dataType.simpleString()
        schema = f"source string, part long, key {kind}, size long, p double, done boolean"

        def step(df: DataFrame) -> DataFrame:
            return df.repartition("source", "part").sortWithinPartitions("source", "part", "key").mapInArrow(_round_groups(seed), schema)

        met = cut(step(open_rows))
        chosen = met.where("done").select("key", "source", F.col("p").cast("int").alias("more"))
        rest = met.where("not done")
        self.levels = 1
        while rest.groupBy("source").count().where("count > 1").limit(1).count():
            met = cut(step(rest.select("source", F.expr(f"cast(floor(part / {FAN_IN}) as long)").alias("part"), "key", "size", "p")))
            chosen = chosen.unionByName(met.where("done").select("key", "source", F.col("p").cast("int").alias("more")))
            rest = met.where("not done")
            self.levels += 1
        last = rest.select("key", "source", (F.pmod(F.xxhash64("key", F.lit(seed), F.lit("last")), F.lit(1 << 30)) < F.col("p") * (1 << 30)).cast("int").alias("more"))
        chosen = chosen.unionByName(last).where("more = 1").groupBy("source", F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("more"))
        joined = known.join(chosen.withColumnRenamed("source", "s2"), (F.col("key") == F.col("k")) & (F.col("source") == F.col("s2")), "left")
        extra = F.when(F.col("more").isNotNull(), 1).otherwise(0)
        self.rows = joined.select(F.col("key").alias(key), "source", F.col("size").alias("n_tokens"), F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).alias("copies"))

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, n_docs, used_docs, tokens_available, tokens_used, most_copies, max_repeats) of every listed source."""
        used = self.rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("u"), F.count(F.when(F.col("copies") > 0, 1)).alias("d"), F.max("copies").alias("c"))
        used = cut(used)  # at most MAX_SOURCES rows
        total = used.agg(F.sum("u")).first()[0] or 0
        met = self.plan.join(F.broadcast(used), "source", "left").withColumn("all", F.lit(total))
        zero = F.lit(0)
        return met.select(
            "source", "target_share", F.when(F.col("all") > 0, F.coalesce("u", zero) / F.col("all")).otherwise(0.0).alias("actual_share"), "n_docs", F.coalesce("d", zero).alias("used_docs"),
            F.col("tokens").alias("tokens_available"), F.coalesce("u", zero).alias("tokens_used"), F.coalesce("c", zero).alias("most_copies"), "max_repeats",
        )
