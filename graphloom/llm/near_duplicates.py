"""Near-duplicate texts: min-max hashing of word shingles, banding, exact verification.

Under each permutation both the least and the greatest hash of a text's shingles are kept, so K permutations give
2 K signature values: half the hash evaluations of min-wise hashing, unbiased and of lower variance. Texts with equal shingle sets
are one class and take part once. Classes that share a band are candidates; their Jaccard similarity is computed exactly.

Only digests and band keys are written. The shingles, eight bytes a word, are made again for the texts that are candidates.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import star_components
from graphloom.util import cut, small

WORD = re.compile(r"[a-z0-9]+")
BUCKET = 64  # classes of a bucket whose pairs are taken directly: at most 32 per class; larger buckets go to prefix_pairs
ROWS = 4  # signature values of a band
SPLIT = 1_000  # sets that hold one prefix shingle, beyond which their pairs are spread over tasks
FEW = 300_000  # candidate ids up to which they are broadcast
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # fixed values: odd mixing constants


class _Words(dict):
    """word -> 64-bit hash; emptied when it holds a million."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: str, k: int, min_words: int) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the runs of k words; None for texts under min_words (or k) words.

    Words are the longest runs of ASCII letters and digits of the lower-cased text.
    """
    words = WORD.findall(text.lower())
    if len(words) < max(min_words, k):
        return None
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - k + 1
    mix = np.zeros(n, np.uint64)
    for i in range(k):
        mix = (mix ^ h[i : i + n]) * _M1
        mix ^= mix >> np.uint64(29)
    return np.unique(mix)


def signature(values: np.ndarray, permutations: int) -> np.ndarray:
    """(least, greatest) hash under each permutation, in turn: 2 * permutations values."""
    seeds = (np.arange(1, permutations + 1, dtype=np.uint64) * _M1) ^ _M2
    x = values[None, :] ^ seeds[:, None]
    x = (x ^ (x >> np.uint64(30))) * _M2
    x ^= x >> np.uint64(27)
    x = x * _M1
    return np.stack([x.min(1), x.max(1)], 1).ravel()


def bands_for(threshold: float, rows: int, miss: float = 1e-5) -> int:
    """Bands that a pair at the threshold misses with a probability of at most `miss`."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The bucket of a shingle set in every band; the band's number is part of the bucket's hash."""
    sig = signature(values, -(-bands * rows // 2))[: bands * rows].reshape(bands, rows)
    mix = np.arange(1, bands + 1, dtype=np.uint64) * _M2
    for j in range(rows):
        mix = (mix ^ sig[:, j]) * _M1
        mix ^= mix >> np.uint64(31)
    return mix.view(np.int64)


def _measured(df: DataFrame, key: str, text: str, k: int, min_words: int, what, kind: str) -> DataFrame:
    """(key, digest, n, x): per text with shingles the digest and size of its set, and the numbers that `what` makes of it. Null and short texts give no row."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, digests, sizes, out = [], [], [], []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    s = shingles(t, k, min_words)
                    if s is not None:
                        keys.append(d)
                        digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                        sizes.append(len(s))
                        out.append(what(s))
                ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
                flat = np.concatenate(out) if out else np.array([], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, part.schema[0].type), pa.array(digests, pa.string()), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["key", "digest", "n", kind])

    return rows.mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, digest string, n int, {kind} array<long>")


def prefix_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """All candidate pairs (a, b) among `sets` by exact prefix filtering: nothing at the threshold is missed.

    Shingles are ordered from rare to common; two sets at the threshold share one in their first n - ceil(t n) + 1.
    What makes a bucket large without being similar is common, so it stays out of the prefixes. Where many sets hold one prefix shingle,
    one side is salted and the other repeated per salt, so that its pairs are spread over tasks.
    """
    one = sets.select("class_id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    weight = one.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    ranked = one.join(weight, "s").where("f > 1").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
    # shingles of one set only can't be shared; they come first in the order and use up the prefix
    length = F.expr(f"n - cast(ceil({percent} * n / 100.0) as int) + 1 - (n - size(x))")
    heads = ranked.where(length > 0).select("class_id", "n", F.explode(F.slice("x", 1, length)).alias("p")).select("class_id", "n", F.col("p.s").alias("s"))
    heads = cut(heads)
    parts = heads.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("s", F.ceil(F.col("f") / SPLIT).cast("int").alias("k"))
    heads = heads.join(parts, "s")
    a = heads.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", F.pmod(F.xxhash64("class_id"), F.col("k")).cast("int").alias("salt"))
    b = heads.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"))
    return a.join(b, ["s", "salt"]).where(f"a < b and {percent} * na <= 100 * nb and {percent} * nb <= 100 * na").select("a", "b").distinct()


def candidates(keys: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """((a, b) of the classes that share a bucket of at most `bucket` classes, class_id of those in larger ones) from keys(class_id, bucket).

    Buckets are counted first, without their members; a bucket of two is its least and its greatest class. Only members of larger ones are joined to
    them, and none is gathered that holds more than `bucket`.
    """
    sizes = cut(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("a"), F.max("class_id").alias("b")).where("n > 1"))
    near = sizes.where("n = 2").select("a", "b").distinct()
    more = sizes.where("n > 2").select("bucket", "n")
    if more.isEmpty():
        return near, near.select(F.col("a").alias("class_id")).limit(0)
    held = cut(keys.join(small(more, FEW), "bucket"))
    groups = held.where(F.col("n") <= bucket).groupBy("bucket").agg(F.sort_array(F.collect_list("class_id")).alias("c"))
    pairs = groups.select(F.posexplode("c").alias("i", "a"), "c").select("a", F.explode(F.expr("slice(c, i + 2, size(c))")).alias("b"))
    return near.union(pairs).distinct(), held.where(F.col("n") > bucket).select("class_id").distinct()


class NearDuplicates:
    """members: (key, class_id) of every text, class_id being the least key of the texts with its shingle set; pairs: the similar classes.

    Texts under `min_words` words and null texts take no part; a key delivered again with the same text counts once, with another text the one of the least digest.
    """

    def __init__(self, df: DataFrame, key: str, text: str, k: int = 5, percent: int = 80, min_words: int = 0, bucket: int = BUCKET):
        self.key = key
        bands = bands_for(percent / 100, ROWS)
        rows = cut(_measured(df, key, text, k, min_words, lambda s: band_keys(s, bands, ROWS), "bands"))
        own = rows.groupBy("key").agg(F.min("digest").alias("digest"))
        classes = own.groupBy("digest").agg(F.min("key").alias("class_id"))
        self.members = cut(own.join(classes, "digest").select(F.col("key").alias(key), "digest", "class_id"))
        heads = self.members.where(F.col(key) == F.col("class_id")).select("class_id", "digest")
        keys = rows.join(heads, (F.col("key") == F.col("class_id")) & (rows["digest"] == heads["digest"])).dropDuplicates(["class_id"]).select("class_id", F.explode("bands").alias("bucket"))
        near, crowded = candidates(keys, bucket)

        def sets(ids: DataFrame) -> DataFrame:
            """(class_id, n, shingles) of the given classes, made again from the texts."""
            ids = small(ids.join(heads, "class_id"), FEW)
            texts = df.select(F.col(key).alias("class_id"), F.col(text).alias("text")).join(ids.select("class_id"), "class_id", "left_semi")
            made = _measured(texts, "class_id", "text", k, min_words, lambda s: s.view(np.int64), "shingles").withColumnRenamed("key", "class_id")
            return made.join(ids, ["class_id", "digest"], "left_semi").dropDuplicates(["class_id"]).select("class_id", "n", "shingles")

        crowded = cut(crowded)
        if not crowded.isEmpty():
            near = near.union(prefix_pairs(sets(crowded), percent)).distinct()
        near = cut(near)
        own = sets(near.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()).select("class_id", "shingles")
        met = near.join(own.withColumnsRenamed({"class_id": "a", "shingles": "x"}), "a").join(own.withColumnsRenamed({"class_id": "b", "shingles": "y"}), "b")
        shared = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("both"))
        self.pairs = cut(shared.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("joined")).where(f"100 * shared >= {percent} * joined"))

    def row_pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b: every two rows that are similar, copies expanded. As large as the result asks for."""
        m, k = self.members, self.key
        one = m.select(F.col(k).alias("x"), F.col("class_id").alias("a"))
        two = m.select(F.col(k).alias("y"), F.col("class_id").alias("b"))
        same = one.join(two.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
        other = self.pairs.select("a", "b").join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        return same.union(other).distinct().toDF(f"{k}_a", f"{k}_b")

    def groups(self) -> DataFrame:
        """(key, class_id, group_id, n_class, n_links): group_id is the least key of the connected group; a lone text is its own group.

        n_class: rows with the same shingle set; n_links: other rows similar to this one.
        """
        k = self.key
        sizes = self.members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class"))
        both = self.pairs.select("a", "b").union(self.pairs.select("b", "a"))
        links = both.join(sizes.select(F.col("class_id").alias("b"), "n_class"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n_class").alias("others"))
        stars = star_components(self.pairs).withColumnRenamed("node", "class_id")
        known = sizes.join(stars, "class_id", "left").join(links, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
        known = known.select("class_id", F.col("component").alias("group_id"), "n_class", (F.col("n_class") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        return self.members.join(known, "class_id").select(k, "class_id", "group_id", "n_class", "n_links")
