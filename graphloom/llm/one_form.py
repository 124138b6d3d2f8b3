"""One consistent form for text that looks the same: compatibility forms, ignorable characters, blanks, hyphens, look-alike letters.

After normalisation of single characters, every word of more than one script becomes a lattice: each letter may stand for itself or
for a letter of another script that looks like it. Viterbi search finds the best path under character bigram scores of clean
one-script words of the corpus, where a change of script within the word costs more than any bigram.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look like each other, by the Latin letter they are shown as. Each group holds code points of other scripts.
LOOK_ALIKE = {
    "A": "0391 0410 13AA", "B": "0392 0412 13F4", "C": "0421 03F9 216D", "D": "13A0 216E", "E": "0395 0415 13AC", "F": "03DC", "G": "050C 13C0",
    "H": "0397 041D 13BB", "I": "0399 0406 04C0", "J": "0408 037F 13AB", "K": "039A 041A 13E6", "L": "13DE 216C", "M": "039C 041C 216F", "N": "039D",
    "O": "039F 041E 0555", "P": "03A1 0420 13E2", "Q": "051A", "R": "13A1", "S": "0405 0555 13DA", "T": "03A4 0422 13A2", "U": "054D", "V": "0474 13D9",
    "W": "051C 13B3", "X": "03A7 0425", "Y": "03A5 04AE", "Z": "0396 13C3",
    "a": "0430 0251 03B1", "b": "042C 13CF", "c": "0441 03F2 217D", "d": "0501 217E", "e": "0435 04BD", "f": "0584", "g": "0261 0581", "h": "04BB 0570",
    "i": "0456 03B9 0131", "j": "0458 03F3", "k": "03BA 043A", "l": "04CF 217C", "m": "217F 043C", "n": "0578", "o": "043E 03BF 0585", "p": "0440 03C1",
    "q": "051B 0566", "r": "0433", "s": "0455", "t": "0442", "u": "03C5 057D", "v": "03BD 0475 2174", "w": "051D 0461", "x": "0445 03C7", "y": "0443 04AF", "z": "1D22",
}
# Blanks and hyphens that are shown like the ordinary ones; characters that show nothing.
HYPHENS = {0x2010, 0x2011, 0xFE63, 0xFF0D}
IGNORABLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFEFF, 0xFFA0, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)}
ZWNJ, ZWJ = chr(0x200C), chr(0x200D)
# Arabic letters that do not join to the letter after them; a joiner behind them shows nothing.
_UNJOINED = set(map(chr, [0x0622, 0x0623, 0x0624, 0x0625, 0x0627, 0x0629, 0x062F, 0x0630, 0x0631, 0x0632, 0x0648, 0x0649, 0x0671, 0x0688, 0x0691, 0x0698, 0x06C0, 0x06D2, 0x06D3, 0x06D5]))

_SHOWN: dict[str, str] = {chr(int(h, 16)): latin for latin, group in LOOK_ALIKE.items() for h in group.split()}
_PEERS: dict[str, set[str]] = {}
for _c, _latin in _SHOWN.items():
    _PEERS.setdefault(_latin, {_latin}).add(_c)
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "ARABIC", "HEBREW", "HIRAGANA", "KATAKANA", "CJK", "HANGUL", "THAI", "DEVANAGARI")
CHANGE, UNSEEN = 40.0, 12.0  # cost of a change of script, and of a bigram never seen
NEVER = {chr(0x0261): chr(0x67), chr(0x0251): "a", chr(0x0131): "i", chr(0x1D22): "z"}  # Latin letters of phonetic spelling and the plain ones


@lru_cache(100_000)
def script(c: str) -> str:
    """Script of a letter, '' for anything else. Roman numerals count as Latin."""
    if not c.isalpha() and unicodedata.category(c) != "Nl":
        return ""
    name = unicodedata.name(c, "")
    if "ROMAN NUMERAL" in name:
        return "LATIN"
    return next((s for s in SCRIPTS if name.startswith(s)), name.split(" ")[0])


@lru_cache(100_000)
def plain(c: str) -> str:
    """A single character in its plain form: wide, narrow, ligature, font and numeral forms opened; signs, powers and fractions kept."""
    code = ord(c)
    if c == " ":
        return c
    if code in HYPHENS:
        return "-"
    if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85":
        return " "
    form = unicodedata.decomposition(c)
    if not form or c in _SHOWN and script(c) != "LATIN":  # the lattice decides on look-alikes of other scripts
        return c
    kind = form.split(" ")[0]
    if not kind.startswith("<"):  # a canonical twin such as the Kelvin sign
        return unicodedata.normalize("NFC", c)
    if kind in ("<wide>", "<narrow>", "<font>") or kind == "<compat>" and unicodedata.category(c) in ("Ll", "Lu", "Lt", "Lo", "Nl", "Lm"):
        return unicodedata.normalize("NFKC", c)
    return c


def _arabic(c: str) -> bool:
    return script(c) == "ARABIC"


def characters(text: str) -> str:
    """Normalisation of single characters: plain forms, ignorables deleted, composed letters in one piece.

    A zero-width non-joiner stays between Arabic letters of which the first would join; a joiner or variation sign stays after a pictograph.
    """
    out: list[str] = []
    for i, c in enumerate(text):
        if ord(c) in IGNORABLE:
            before = out[-1][-1] if out else ""  # a plain form may be of several characters
            if c == ZWNJ and before and _arabic(before) and before not in _UNJOINED:
                after = next((x for x in text[i + 1 :] if ord(x) not in IGNORABLE), "")
                if after and _arabic(after):
                    out.append(c)
            elif before and ord(before) >= 0x2600 and unicodedata.category(before) in ("So", "Sk") and (c == ZWJ or ord(c) == 0xFE0F):
                out.append(c)
            continue
        out.append(plain(c))
    return unicodedata.normalize("NFC", "".join(out))


_WORD = re.compile(r"[^\W\d_]+")


class Scores:
    """-log P(next letter | letter) within clean words, smoothed; '^' and '$' are the word's ends."""

    def __init__(self, counts: dict[str, int]):
        total: Counter = Counter()
        for pair, n in counts.items():
            total[pair[0]] += n
        self.cost = {pair: min(UNSEEN, -math.log(n / (total[pair[0]] + 1))) for pair, n in counts.items()}

    def __call__(self, a: str, b: str) -> float:
        return self.cost.get(a + b, UNSEEN)


@lru_cache(50_000)
def _choices(c: str) -> tuple[str, ...]:
    """The letter itself and the letters that it may be standing for."""
    peers = _PEERS.get(_SHOWN.get(c, c), set()) - {c}
    # a letter never stands for a phonetic sign or a numeral
    return (c, *sorted(p for p in peers if p not in NEVER and unicodedata.category(p) != "Nl"))


def decode(word: str, scores: Scores) -> str:
    """The likeliest reading of a word whose letters come from several scripts, or that holds a phonetic look-alike; else the word."""
    known = {script(c) for c in word}
    if not (len(known - {""}) > 1 and any(len(_choices(c)) > 1 for c in word) or any(c in NEVER for c in word)):
        return word
    if known <= {"HIRAGANA", "KATAKANA", "CJK"}:
        return word
    paths = {"^": (0.0, "", "")}  # last choice -> cost, script, reading
    for i, c in enumerate(word):
        step: dict[str, tuple[float, str, str]] = {}
        for x in _choices(c):
            s, keep = script(x), 0.0 if x == c else 0.5
            if x in NEVER:
                keep += CHANGE / 2
            for last, (cost, was, reading) in paths.items():
                turn = CHANGE if was and s and s != was else 0.0
                total = cost + keep + turn + scores(last.casefold(), x.casefold())
                if x not in step or total < step[x][0]:
                    step[x] = (total, s or was, reading + x)
        paths = step
    best = min(((cost + scores(last.casefold(), "$"), reading) for last, (cost, _, reading) in paths.items()))[1]
    # a word whose scripts can't be brought together is left as it is, such as a symbol beside a word
    return best if len({script(c) for c in best} - {""}) < max(2, len(known - {""})) else word


def one_form(text: str, scores: Scores) -> str:
    """The consistent form of a text."""
    base = characters(text)
    if base.isascii():
        return base
    return _WORD.sub(lambda m: m.group() if m.group().isascii() else decode(m.group(), scores), base)


def _bigrams(batches):
    """Bigram counts of clean one-script words, local to the task."""
    counts: Counter = Counter()
    words: Counter = Counter()

    def flush():
        for w, n in words.items():
            if len({script(c) for c in w}) == 1 and all(plain(c) == c and c not in NEVER for c in w):
                w = f"^{w.casefold()}$"
                for a, b in zip(w, w[1:]):
                    counts[a + b] += n
        words.clear()

    for b in batches:
        for column in b.columns:
            for t in column.to_pylist():
                if t:
                    words.update(_WORD.findall(t))
                    if len(words) > 300_000:
                        flush()
    flush()
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])


def bigram_scores(df: DataFrame, fields: list[str]) -> dict[str, int]:
    """Bigram counts over the given fields of all rows. Words are counted per task; only bigrams of letters are shuffled and collected, all of them."""
    got = df.select(*fields).mapInArrow(_bigrams, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return {r["pair"]: r["n"] for r in got}


PLAIN = r"^[\x20-\x7e]*$"  # such texts are in the consistent form already


def consistent(df: DataFrame, fields: list[str]) -> DataFrame:
    """`df` with a column <field>_form for each field: its consistent form. Null stays null, '' stays ''. No shuffle of rows.

    Texts of printable ASCII alone are passed through by the JVM; only the others are looked at in Python.
    """
    shared = df.sparkSession.sparkContext.broadcast(bigram_scores(df, fields))
    held: dict = {}

    @F.pandas_udf("string")
    def form(column: pd.Series) -> pd.Series:
        if "s" not in held:
            held["s"] = Scores(shared.value)
        return pd.Series([t if t is None else one_form(t, held["s"]) for t in column], dtype=object)

    for f in fields:
        df = df.withColumn(f"{f}_form", F.when(F.col(f).rlike(PLAIN), F.col(f)).otherwise(F.lit(None)))
    odd = F.lit(False)
    for f in fields:
        odd = odd | ~F.coalesce(F.col(f).rlike(PLAIN), F.lit(True))
    rows = df.withColumn("__odd", odd)
    fixed = rows.where("__odd")
    for f in fields:
        fixed = fixed.withColumn(f"{f}_form", form(F.col(f)))
    return rows.where("not __odd").unionByName(fixed).drop("__odd")
