"""Mapping of freely written values to the entries of a canonical list.

First a multi-pattern automaton over all names and aliases finds embedded mentions; the longest of the non-overlapping ones wins.
Values without one go to token-set similarity: every word of an alias is matched to its closest word of the value,
in any order, cut-off words count nearly whole, words left over weigh little. Values under the threshold mean no entry. Last, in words
that were run together, a mention counts without word edges about it.

Every decision names the runner-up, the best other entry, and its score: equal scores are a tie, which goes to the entry of the least id and shows.
Aliases are found by the words they share with a value and by their letters, so a value is compared with few of them.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.64
MAX_ALIASES = 50_000  # a canonical list beyond this is refused, not broadcast
CACHE = 200_000  # values whose entry a worker remembers
INSIDE = 8  # letters of a mention that counts without word edges
CUT, LEAST = 0.92, 0.5  # worth of a cut-off word, and the similarity at which a word may stand for another
# Signs that are written for letters, and letters that look alike in many fonts, as one form each.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "l": "i", "|": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"})
_CAMEL = re.compile(r"(?<=[a-z\d])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+")


def words(value: str, pairs: bool = True) -> list[str]:
    """Words of a value in one form: compatibility forms, accents, case, camel case and look-alikes folded, with `pairs` also 'rn' for 'm'."""
    text = unicodedata.normalize("NFKC", value)
    if not text.isupper():
        text = _CAMEL.sub(" ", text)
    text = unicodedata.normalize("NFD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(LOOK_ALIKE)
    return _WORD.findall(text.replace("rn", "m") if pairs else text)


def _letters(word: str) -> int:
    """The letters of a word as a bit set, each counted up to three times: shared bits bound the edit distance from below."""
    out, seen = 0, {}
    for c in word:
        k = seen[c] = seen.get(c, 0) + 1
        if k <= 3:
            out |= 1 << (3 * (ord(c) % 64) + k)
    return out


class Word(str):
    """A string that knows its letter set and its bit masks for the distance."""

    __slots__ = ("letters", "masks")

    def __new__(cls, text: str):
        self = super().__new__(cls, text)
        self.letters = _letters(text)
        self.masks = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        return self


def distance(a: Word, b: str) -> int:
    """Edit distance with transpositions of neighbours (optimal string alignment), bit-parallel over `a`."""
    m = len(a)
    if not m or not b:
        return max(m, len(b))
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, d0, before, score = full, 0, 0, 0, m
    get = a.masks.get
    for c in b:
        eq = get(c, 0)
        d0 = ((((~d0) & eq) << 1) & before) | ((((eq & plus) + plus) ^ plus) | eq | minus)
        hp, hm = minus | ~(d0 | plus), d0 & plus
        if hp & top:
            score += 1
        elif hm & top:
            score -= 1
        hp, hm = ((hp << 1) | 1) & full, (hm << 1) & full
        plus, minus, before = (hm | ~(d0 | hp)) & full, hp & d0 & full, eq
    return score


def similarity(a: Word, b: Word, least: float) -> float:
    """1 - distance / longer length; 0 if that is under `least`."""
    long = max(len(a), len(b))
    if not long or long - min(len(a), len(b)) > (1 - least) * long:
        return 0.0
    if a == b:
        return 1.0
    # repeats beyond three of a letter are not in the sets, so at most what is left out is forgiven
    shared = (a.letters & b.letters).bit_count() + max(0, min(len(a) - a.letters.bit_count(), len(b) - b.letters.bit_count()))
    if long - shared > (1 - least) * long:
        return 0.0
    s = 1 - distance(a, b) / long
    return s if s >= least else 0.0


@dataclass(frozen=True)
class Alias:
    entry: str
    tokens: tuple[Word, ...]
    joined: Word


class Letters:
    """Words by their letters: those that can be similar to a word, by a bound on the edit distance, computed over all of them at once."""

    def __init__(self, items: list[str]):
        self.sizes = np.array([len(x) for x in items], np.int32)
        self.counts = np.array([self.count(x) for x in items], np.int16).reshape(len(items), 64)

    @staticmethod
    def count(word: str) -> np.ndarray:
        return np.bincount([ord(c) % 64 for c in word], minlength=64) if word else np.zeros(64, np.int64)

    def near(self, word: str, least: float) -> list[int]:
        shared = np.minimum(self.counts, self.count(word).astype(np.int16)).sum(1)
        return np.flatnonzero(shared >= least * np.maximum(self.sizes, len(word)) - 1e-9).tolist()


@dataclass(frozen=True)
class Choice:
    """entry meant ('' for none) with its score, and the best other entry ('' for none) with its own."""

    entry: str = ""
    score: float = 0.0
    runner_up: str = ""
    next_score: float = 0.0


def _choice(scores: dict[str, float]) -> Choice:
    ranked = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:2]
    return Choice(*(x for pair in ranked for x in pair))


class Matcher(dict):
    """value -> Choice."""

    def __init__(self, aliases: list[tuple[str, str]], threshold: float):
        super().__init__()
        self.threshold = threshold
        self.aliases, seen = [], {}
        for entry, name in sorted(set(aliases)):
            tokens = tuple(Word(w) for w in words(name))
            if tokens and (entry, tokens) not in seen:
                seen[entry, tokens] = 1
                self.aliases.append(Alias(entry, tokens, Word("".join(tokens))))
        self.tokens = list({t: t for a in self.aliases for t in a.tokens}.values())
        self.of_token: dict[str, list[int]] = {}
        self.starts: dict[str, list[Word]] = {}
        for i, a in enumerate(self.aliases):
            for t in set(a.tokens):
                self.of_token.setdefault(t, []).append(i)
        for t in self.tokens:
            self.starts.setdefault(t[:3], []).append(t)
        self.joined, self.single = Letters([a.joined for a in self.aliases]), Letters(self.tokens)
        self.close: dict[str, dict[str, float]] = {}
        named: dict[str, list[str]] = {}
        for a in self.aliases:
            named.setdefault(a.joined, []).append(a.entry)
        self.automaton = ahocorasick.Automaton()
        for name, entries in named.items():
            self.automaton.add_word(name, (len(name), tuple(sorted(set(entries)))))
        self.parts = ahocorasick.Automaton()
        for t in self.tokens:
            if len(t) >= 4:
                self.parts.add_word(t, len(t))
        if self.aliases:
            self.automaton.make_automaton()
        if len(self.parts):
            self.parts.make_automaton()

    def __missing__(self, value: str) -> Choice:
        if len(self) > CACHE:
            self.clear()
        found = self[value] = self.find(value)
        return found

    def find(self, value: str) -> Choice:
        ws = words(value)
        if not ws or not self.aliases:
            return Choice()
        first = None
        for step in (lambda: self.embedded(ws), lambda: self.closest(ws), lambda: self.closest(self.apart(ws)), lambda: self.embedded(ws, False), lambda: self.closest(self.apart(words(value, False)))):
            got = step()
            if got.score >= self.threshold:
                return got
            first = got if first is None or got.score > first.score else first
        return Choice("", 0.0, first.entry, first.score)  # what it means least badly is the runner-up to nothing

    def embedded(self, ws: list[str], edges: bool = True) -> Choice:
        """The longest mention that begins and ends with a word of the value, the first of equally long ones; without `edges` within run-together words too."""
        ends, at = {0}, 0
        for w in ws:
            at += len(w)
            ends.add(at)
        hits = [(n, end + 1 - n, entries) for end, (n, entries) in self.automaton.iter("".join(ws)) if (end + 1 in ends and end + 1 - n in ends if edges else n >= INSIDE)]
        if not hits:
            return Choice()
        most, _, entries = min(hits, key=lambda h: (-h[0], h[1]))
        scores = {e: n / most for n, _, own in sorted(hits, key=lambda h: h[0]) for e in own}
        others = {e: s for e, s in scores.items() if e not in entries}
        if len(entries) > 1:
            return Choice(entries[0], 1.0, entries[1], 1.0)
        best = _choice(others)
        # of equally long mentions the first counts, so another one as long is no tie
        return Choice(entries[0], 1.0, best.entry, min(best.score, 1 - 1e-9) if best.entry else 0.0)

    def apart(self, ws: list[str]) -> list[str]:
        """Words that were run together, cut at the alias words in them, the longest first."""
        if not len(self.parts):
            return ws
        out = []
        for w in ws:
            cuts: set[int] = set()
            taken = [False] * len(w)
            for n, begin in sorted(((n, end + 1 - n) for end, n in self.parts.iter(w)), key=lambda h: (-h[0], h[1])):
                if not any(taken[begin : begin + n]):
                    taken[begin : begin + n] = [True] * n
                    cuts |= {begin, begin + n}
            edges = sorted(cuts | {0, len(w)})
            out += [w[a:b] for a, b in zip(edges, edges[1:]) if a < b]
        return out

    def _close(self, word: str) -> dict[str, float]:
        """alias word -> similarity, of the alias words that a word may stand for."""
        if word not in self.close:
            if len(self.close) > CACHE:
                self.close.clear()
            w, out = Word(word), {}
            for i in self.single.near(w, LEAST):
                if s := similarity(self.tokens[i], w, LEAST):
                    out[self.tokens[i]] = s
            for t in self.starts.get(w[:3], ()) if len(w) >= 3 else ():
                if len(w) < len(t) and t.startswith(w):
                    out[t] = max(out.get(t, 0.0), CUT)
            self.close[word] = out
        return self.close[word]

    def closest(self, ws: list[str]) -> Choice:
        """The entry whose best alias is most similar, over the aliases that share a close word or nearly all letters with the value."""
        joined, near = Word("".join(ws)), [self._close(w) for w in ws]
        met = set(self.joined.near(joined, self.threshold))
        for own in near:
            for t in own:
                met.update(self.of_token[t])
        scores: dict[str, float] = {}
        for i in sorted(met):
            a = self.aliases[i]
            score = similarity(a.joined, joined, self.threshold)
            if len(ws) > 1 or len(a.tokens) > 1 or len(joined) >= 4:
                free, got, size = list(range(len(ws))), 0.0, 0
                for t in sorted(a.tokens, key=len, reverse=True):
                    size += len(t)
                    i = max(free, key=lambda i, t=t: near[i].get(t, 0.0), default=None)
                    if i is not None and t in near[i]:
                        got += len(t) * near[i][t]
                        free.remove(i)
                score = max(score, got / (size + 0.25 * sum(len(ws[i]) for i in free)))
            if score > scores.get(a.entry, 0.0):
                scores[a.entry] = score
        return _choice(scores)


FIELDS = {"type_id": ("entry", pa.string()), "score": ("score", pa.float64()), "runner_up": ("runner_up", pa.string()), "next_score": ("next_score", pa.float64())}
_MATCHERS: dict[tuple, Matcher] = {}


def aliases_of(entries: DataFrame, entry: str, single: list[str], several: list[str] = ()) -> list[tuple[str, str]]:
    """(entry id, name) pairs of a canonical list: its id, `single` columns and `several` array columns. Refused over MAX_ALIASES."""
    names = F.concat(F.array(F.col(entry), *single), *(F.coalesce(c, F.array().cast("array<string>")) for c in several))
    got = entries.select(F.col(entry).alias("e"), F.explode(names).alias("n")).where("e is not null and n is not null").distinct().limit(MAX_ALIASES + 1).collect()
    if len(got) > MAX_ALIASES:
        raise ValueError(f"a canonical list of over {MAX_ALIASES} names is not broadcast")
    return [(r["e"], r["n"]) for r in got]


def map_values(df: DataFrame, value: str, aliases: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """`df` with type_id, the id of the entry that `value` means, '' if it means none, its score, and runner_up and next_score, the best other entry.

    For a value that means none the runner-up is what it came closest to. A null value gives nulls. No shuffle: every task maps its own rows and remembers the values it has met, so a value that a third of all
    rows hold is mapped once per worker. An empty list maps everything to ''.
    """
    shared = df.sparkSession.sparkContext.broadcast((tuple(sorted(set(aliases))), threshold))
    at = df.columns.index(value)

    def run(batches):
        key = (hash(shared.value[0]), shared.value[1])
        if key not in _MATCHERS:
            _MATCHERS[key] = Matcher(list(shared.value[0]), shared.value[1])
        matcher = _MATCHERS[key]
        for b in batches:
            got = [None if v is None else matcher[v] for v in b.column(at).to_pylist()]
            more = [pa.array([None if g is None else getattr(g, f) for g in got], kind) for f, kind in FIELDS.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *FIELDS])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, type_id string, score double, runner_up string, next_score double")
