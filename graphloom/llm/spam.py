"""Keyword-stuffed and link-list texts: robust Mahalanobis outliers that lie in the spam direction.

Five features per document (listing density, tag density, entropy, repetition, function words) are centred and scaled per language by a
minimum-covariance-determinant estimate over all documents of that language: concentration steps on the nearer half, so up to half of
a language may be spam, then one reweighting. Outliers that deviate towards spam in every feature give the spam pole, the mean of such
documents. A document is spam if its robust distance is beyond the chi-square bound and its position along the discriminant direction from the centre
to the pole is beyond the half-way point: features are shares of the text, so a document half of which is listed lies half-way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.util import cut

FEATURES = ("listing", "tags", "entropy", "repetition", "function_words")
SIDE = (1.0, 1.0, -1.0, 1.0, -1.0)  # the direction in which each feature moves in spam
FLOOR = (0.02, 0.05, 0.05, 0.05, 0.1)  # noise of a feature's measurement, added to its scale; most documents agree exactly in some
PRIOR_POLE = (1.0, 0.5, 0.6, 0.6, 0.0)  # a text that is nothing but lists, worth PRIOR documents beside those found
PRIOR = 30.0  # documents that the estimate over all languages is worth within each language
DISTANCE = 15.09  # chi-square of 5 degrees of freedom at 99 %
CORE = 12.83  # chi-square at 97.5 %: documents within take part in the reweighted estimate
MEDIAN = 4.35  # chi-square at 50 %, to which the concentrated scatter is scaled
STEPS = 3  # concentration steps
COMMON = 0.1  # a word is a function word of a language if so many of its documents hold it
MOST_WORDS = 200_000  # function words of all languages; more are refused, not cut

_EDGES = chr(0xFEFF) + " \t"
MARKUP = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
EFFECT = re.compile(r"\[[^\]\n]*\]|\([^)\n]*\)|(?<!\w)\*[^*\n]*[^\W_]{3}[^*\n]*\*(?!\w)")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
HIDDEN = re.compile("[%s]" % "".join(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))))
APART = re.compile(r"(?<![^\W_])[^\W_](?:([^\w\n,;])[^\W_])(?:\1[^\W_])+(?![^\W_])")  # letters of a word set apart by one sign
DIGITS = re.compile(r"[^\W_]*[^\W\d_][^\W_]*\d[^\W_]*|[^\W_]*\d[^\W_]*[^\W\d_][^\W_]*")
LEET = str.maketrans("430157", "aeoist")  # fixed values: digits written for letters
LINK = re.compile(r"\w{3,}://\S*|\bwww\.\S*|\b[\w-]{2,}(?:\.|\s?\[\.\]\s?|\s?\(\.\)\s?|\s?\bdot\s)[a-z]{2,}\b(?:/\S*)?", re.I)
LINKISH = re.compile(r"://|\w\.[a-z]{2}|\[\.\]|\(\.\)|\bdot\s", re.I)
PRICE = re.compile(r"(?<!\w)[A-Z]{2,}-?\d+\b|\d+[.,]\d\d(?!\d)|[$€£¥]\s?\d|\d\s?[$€£¥%]|\*{3,}")
SONG = chr(0x266A)
# Words of site navigation.
NAVIGATION = frozenset(
    "home start shop store cart basket checkout login logout register account contact about imprint impressum kontakt contacto accueil inicio startseite sitemap archive archives archiv tags tag "
    "next previous prev back top new news sale sales offers partner partners links link faq help search menu categories privacy terms newsletter blog forum index page".split()
)
PARTED = re.compile(r"\s+[|/>%s%s%s-]\s+|\s{2,}|\t" % tuple(map(chr, (0xBB, 0x2022, 0xB7))))
CLOSING, ENDING = " \"'-)" + "".join(map(chr, (0x201D, 0x2019, 0xBB, 0x266A))), ".!?" + chr(0x2026)  # fixed values
MIXED = re.compile(r"[^\W\d_]\d|\d[^\W\d_]")


def _bytes_of(code_page: str) -> dict[int, int]:
    """What a reader of the code page shows for each byte from 128 on, led back to the byte."""
    shown = {b: bytes([b]).decode(code_page, "ignore") or chr(b) for b in range(128, 256)}
    return {ord(c): b for b, c in shown.items()}


# Code pages in which UTF-8 is often misread, and the signs that then stand for the lead bytes of longer characters.
MISREAD = [_bytes_of(c) for c in ("cp1252", "cp1251", "cp437")]
LEADS = re.compile("[" + "".join({chr(c) for table in MISREAD for c, b in table.items() if b in (0xC2, 0xC3, 0xE2)}) + "][^\x00-\x7f]")


def reread(line: str) -> str:
    """A line of UTF-8 that was read in another code page, read again; else the line."""
    for table in MISREAD:
        try:
            return line.translate(table).encode("latin-1").decode()
        except UnicodeError:
            pass
    return line


def cue_lines(text: str) -> list[str]:
    """Lines of the cue texts, numbers, times and markup aside."""
    if not text.isascii() and LEADS.search(text):
        text = "\n".join(map(reread, text.replace("\r\n", "\n").replace("\r", "\n").split("\n")))
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text or "{" in text:
        text = MARKUP.sub("", text)
    return [s for line in text.split("\n") if (s := line.strip(_EDGES)) and "-->" not in s and not s.isdigit() and not s.startswith("WEBVTT")]


def tokens(lines: list[str]) -> list[list[str]]:
    """Lower-cased words of each line: hidden signs dropped, set-apart letters joined, digits in words read as letters, effects left out."""
    body = "\n".join(lines)
    if not body.isascii() and HIDDEN.search(body):
        body = HIDDEN.sub("", body)
    if "[" in body or "(" in body or "*" in body:
        body = EFFECT.sub(" ", body)
    body = body.lower()
    if MIXED.search(body):
        body = DIGITS.sub(lambda m: m.group().translate(LEET), body)
    words = [WORD.findall(line) for line in body.split("\n")]
    alone = sum(len(w) == 1 for ws in words for w in ws)
    if alone * 5 > sum(map(len, words)) and APART.search(body):  # many letters stand alone
        words = [WORD.findall(line) for line in APART.sub(lambda m: m.group()[:: 1 + len(m.group(1))], body).split("\n")]
    return words


def measure(text: str, common: frozenset[str]) -> list[float] | None:
    """The features of a text; None for one without words.

    listing: share of the cue characters in lines that list rather than speak: links, hashtags and prices without a function word, navigation and parted
    lines, lines of the document's repeated keywords. tags: share of lines with a link, a hashtag or a price. entropy: of the words, relative to
    all different. repetition: share of words that are repeated keywords. function_words: share of words that are common in a language.
    """
    lines = cue_lines(text)
    words = tokens(lines)
    counts = Counter(chain.from_iterable(words))
    n = sum(counts.values())
    if not n:
        return None
    body = "\n".join(lines)
    total = len(body) - len(lines) + 1
    known = {w for w in counts if w in common}
    least = max(3.0, 0.015 * n)
    keys = {w for w, k in counts.items() if k >= least and len(w) > 2 and w not in known}
    main = [w for w in keys if counts[w] >= max(6, 0.12 * n)]
    links, prices, hashes = bool(LINKISH.search(body)), bool(PRICE.search(body)), "#" in body
    listed = tagged = 0
    for line, w in zip(lines, words):
        if not w:
            continue
        size = len(line)
        last = line.rstrip(CLOSING)[-1:]
        ended = last in ENDING and last != ""
        if links and (found := LINK.findall(line)):
            tagged += size
            if len(WORD.findall(LINK.sub(" ", line))) <= 2 * len(found) or not ended and known.isdisjoint(w):
                listed += size
        elif hashes and line.count("#") * 2 >= len(line.split()):
            listed, tagged = listed + size, tagged + size
        else:
            price = prices and PRICE.search(line)
            tagged += size if price else 0
            if price and known.isdisjoint(w) or not ended and (NAVIGATION.issuperset(x for x in w if not x.isdigit()) or len(parts := PARTED.split(line)) > 2 and max(len(p.split()) for p in parts) < 4):
                listed += size
            elif keys.isdisjoint(w) or SONG in line or last == "!" and len(set(w)) == 1:  # a name called out is a chant
                continue
            # a list of keywords, or a sentence that says the one word of the document again and again
            elif (2 * sum(x in keys for x in w) >= len(w) and not (ended and len(w) < 4)) or any(w.count(x) > 1 for x in main):
                listed += size
    entropy = (math.log(n) - sum(k * math.log(k) for k in counts.values() if k > 1) / n) / math.log(max(n, 2))
    return [listed / total, tagged / total, entropy, sum(counts[w] for w in keys) / n, sum(counts[w] for w in known) / n]


def _language(column: str) -> Column:
    """Declared language as two lower-case letters; anything else, null included, is 'und'. So there are at most 677 groups."""
    low = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    return F.when((low != "und") & low.rlike("^[a-z]{2}"), F.substring(low, 1, 2)).otherwise("und")


_PLAIN_WORD = re.compile(r"[^\W\d_]+")


def _document_words(batches):
    """(language, word, documents) counted within the task; '' counts the documents themselves."""
    counts: dict[str, Counter] = {}

    def out():
        rows = [(g, w, n) for g, c in counts.items() for w, n in c.items()]
        counts.clear()
        g, w, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["g", "w", "n"])

    for b in batches:
        for group, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            c = counts.setdefault(group, Counter())
            c.update(set(_PLAIN_WORD.findall(text.lower())))
            c[""] += 1
        if sum(map(len, counts.values())) > 400_000:
            yield out()
    yield out()


def function_words(rows: DataFrame) -> frozenset[str]:
    """Words that a tenth of a language's documents hold, over all languages, from (g, text) rows.

    Document counts are exact over all rows. Every language is judged as if PRIOR documents with the word's share over all languages were added,
    so a language of few documents has the words that are common everywhere, and its own as it grows.
    Such words are at most ten times a document's distinct words per language; over MOST_WORDS of them raise ValueError.
    """
    counts = cut(rows.mapInArrow(_document_words, "g string, w string, n long").groupBy("g", "w").agg(F.sum("n").alias("n")))
    sizes = counts.where("w = ''").select("g", F.col("n").alias("docs"))
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    # a word that is common somewhere is in a tenth of that language's documents, or in the prior's tenth of all
    near = counts.where("w <> ''").join(F.broadcast(sizes), "g").where(F.col("n") >= COMMON * F.col("docs"))
    words = near.select("w").distinct()
    pooled = counts.join(words, "w").groupBy("w").agg((F.sum("n") / F.lit(max(total, 1))).alias("share"))
    met = near.join(pooled, "w").where(F.col("n") + PRIOR * F.col("share") >= COMMON * (F.col("docs") + PRIOR))
    got = met.select("w").distinct().limit(MOST_WORDS + 1).collect()
    if len(got) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} function words")
    return frozenset(r["w"] for r in got)


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _moments(rows: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Per language: documents, sums and sums of products of the features; at most 677 rows are collected."""
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in _PAIRS]
    out = {}
    for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums, *products).collect():
        second = np.zeros((len(FEATURES),) * 2)
        for i, j in _PAIRS:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"]
        out[r["g"]] = float(r["n"]), np.array([r[f"s{i}"] for i in range(len(FEATURES))]), second
    return out


def _estimates(moments: dict) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and scatter of each language, that of all languages counting as PRIOR documents of it."""
    n = sum(m[0] for m in moments.values())
    mean, second = (sum(m[k] for m in moments.values()) / n for k in (1, 2))
    out = {}
    for g, (k, s, p) in moments.items():
        centre = (s + PRIOR * mean) / (k + PRIOR)
        out[g] = centre, (p + PRIOR * second) / (k + PRIOR) - np.outer(centre, centre)
    return out


def _distance2(known: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[list, Column]:
    """Rows (g, centre, inverse) of the estimates, and the squared distance of a row that was joined with its language's."""
    flat = [(g, [float(x) for x in c], [float(x) for x in np.linalg.inv(s + np.diag(np.square(FLOOR))).ravel()]) for g, (c, s) in known.items()]
    off = [F.col(f) - F.element_at("centre", i + 1) for i, f in enumerate(FEATURES)]
    k = len(FEATURES)
    return flat, sum(off[i] * off[j] * F.element_at("inverse", i * k + j + 1) for i in range(k) for j in range(k))


def _distances(rows: DataFrame, known: dict) -> DataFrame:
    flat, distance2 = _distance2(known)
    table = rows.sparkSession.createDataFrame(flat, "g string, centre array<double>, inverse array<double>")
    return rows.join(F.broadcast(table), "g").withColumn("distance2", distance2)  # at most 677 rows


def robust_estimates(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language: centre and scatter of the features by minimum covariance determinant.

    Start: medians and median absolute deviations. Each concentration step takes the nearer half of a language's documents; the scatter of the last half is
    scaled to the median distance, and mean and covariance of the documents within the core bound are the estimate.
    """
    medians = rows.groupBy("g").agg(*(F.percentile_approx(f, 0.5, 10_000).alias(f"m{i}") for i, f in enumerate(FEATURES)))
    off = rows.join(F.broadcast(medians), "g")
    first = off.groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(len(FEATURES))), *(F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i, f in enumerate(FEATURES)))
    known = {r["g"]: (np.array([r[f"m{i}"] for i in range(len(FEATURES))]), np.diag([(1.4826 * r[f"d{i}"]) ** 2 for i in range(len(FEATURES))])) for r in first.collect()}
    for _ in range(STEPS if known else 0):
        near = _distances(rows, known)
        half = near.groupBy("g").agg(F.percentile_approx("distance2", 0.5, 10_000).alias("half"))
        known = _estimates(_moments(near.join(F.broadcast(half), "g").where("distance2 <= half")))
    if known:
        near = _distances(rows, known)
        half = near.groupBy("g").agg(F.greatest(F.lit(1.0), F.percentile_approx("distance2", 0.5, 10_000) / MEDIAN).alias("scale"))
        known = _estimates(_moments(near.join(F.broadcast(half), "g").where(F.col("distance2") <= CORE * F.col("scale"))))
    return known


def spam_pole(rows: DataFrame) -> np.ndarray:
    """Mean of the outliers that deviate towards spam in every feature, PRIOR_POLE counting as PRIOR of them. rows: as _distances gives them."""
    ahead = F.col("distance2") > DISTANCE
    for i, (f, side) in enumerate(zip(FEATURES, SIDE)):
        ahead = ahead & ((F.col(f) - F.element_at("centre", i + 1)) * side > 0)
    got = rows.where(ahead).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f), F.lit(0.0)).alias(f) for f in FEATURES)).first()
    return (np.array([got[f] for f in FEATURES]) + PRIOR * np.array(PRIOR_POLE)) / (got["n"] + PRIOR)


def decided(measured: DataFrame) -> DataFrame:
    """measured(g, features..) with distance2, spamward and spam.

    spamward: position along the discriminant direction, 0 at the language's centre and 1 at the pole; spam: beyond the distance bound and 1/2.
    """
    known = robust_estimates(measured)
    if not known:
        return measured.select("*", F.lit(0.0).alias("distance2"), F.lit(0.0).alias("spamward"), F.lit(False).alias("spam")).limit(0)
    near = _distances(measured, known)
    pole = spam_pole(near)
    flat = []
    for g, (centre, scatter) in known.items():
        toward = np.linalg.solve(scatter + np.diag(np.square(FLOOR)), pole - centre)
        flat.append((g, [float(x) for x in toward / (toward @ (pole - centre))]))
    table = measured.sparkSession.createDataFrame(flat, "g string, toward array<double>")
    spamward = sum((F.col(f) - F.element_at("centre", i + 1)) * F.element_at("toward", i + 1) for i, f in enumerate(FEATURES))
    out = near.join(F.broadcast(table), "g").withColumn("spamward", spamward)
    return out.select(*measured.columns, "distance2", "spamward", ((F.col("distance2") > DISTANCE) & (F.col("spamward") > 0.5)).alias("spam"))


def spam_scores(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, language, features.., distance2, spamward, spam) of every text with a word.

    Null, empty and wordless texts give no row. Rows of one key are judged each on its own. The features are written once: texts are read
    twice, once for the function words. Estimates are made over all documents and are of one row per language.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), _language(lang).alias("g")).where("t <> ''")
    common = df.sparkSession.sparkContext.broadcast(function_words(rows.select("g", "t")))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                got = [measure(t, common.value) for t in part.column(1).to_pylist()]
                keep = pa.array([g is not None for g in got])
                got = [g for g in got if g is not None]
                cols = [pa.array([g[i] for g in got], pa.float64()) for i in range(len(FEATURES))]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(2).filter(keep), *cols], names=["k", "g", *FEATURES])

    measured = cut(rows.mapInArrow(run, f"k {kind}, g string, {', '.join(f'{f} double' for f in FEATURES)}"))
    return decided(measured).withColumnsRenamed({"k": key, "g": "language"})


def spam(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key) of the spam texts."""
    return spam_scores(df, key, text, lang).where("spam").select(key)
