"""Splitting of oversized texts at natural boundaries into pieces under a limit, with an overlap.

Balanced targets: take the least number of pieces that can do, place equally spaced targets, snap each to the strongest
boundary near it, and add a piece whenever a piece would exceed the limit.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

# Boundaries by strength, strongest first; a cut falls at the end of the match.
BOUNDARIES = [
    (6, re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)+\s*")),  # blank line
    (5, re.compile(r"\r\n|\r|\n|[%s%s]" % (chr(0x2028), chr(0x2029)))),  # end of line
    (4, re.compile(r"[.!?…]+[\"')\]’”»]*\s+(?=[\"'(\[‘“«¿¡]*[A-Z0-9À-Þ])|[。！？]")),  # end of sentence
    (3, re.compile(r"[;:]\s+|[–—]\s*")),
    (2, re.compile(r",\s+|[、，]")),
    (1, re.compile(r"\s+")),
]
_JOINER = chr(0x200D)
_INNER = re.compile(f"[{chr(0x300)}-{chr(0x36F)}{_JOINER}{chr(0xFE00)}-{chr(0xFE0F)}]")  # belongs to the character before


def _hard(text: str, low: int, at: int) -> int:
    """The last place up to `at` that breaks no CR LF, joined or composed character; `at` itself if there is none after `low`."""
    cut = at
    while cut > low and cut < len(text) and (text[cut - 1 : cut + 1] == "\r\n" or _INNER.match(text[cut]) or text[cut - 1] == _JOINER):
        cut -= 1
    return cut if cut > low else at


def _snap(text: str, low: int, target: int, high: int) -> int | None:
    """The strongest boundary in (low, high], of equals the one nearest to the target; None if there is none."""
    for _, pattern in BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text, low, high) if low < m.end() <= high]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    return None


def _overlap(text: str, cut: int, most: int, low: int) -> int:
    """Where the next piece begins: at a word or line start in the last `most` characters before the cut."""
    first = max(low, cut - most)
    for _, pattern in (BOUNDARIES[2], BOUNDARIES[5]):
        starts = [m.end() for m in pattern.finditer(text, first, cut) if first <= m.end() < cut]
        if starts:
            return starts[0]
    return _hard(text, low, first) if first > low else first


def spans(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int]]:
    """(begin, end) of each piece in code points; together they cover the text, each begins at most `overlap` before the last end.

    A text within the limit, '' included, is one piece. Every piece is at most `limit` long and longer than its overlap.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    count = 1 + -(-(n - limit) // (limit - overlap))
    while (found := _pieces(text, count, limit, overlap)) is None:
        count += 1
    if found[1] and (more := _pieces(text, count + 1, limit, overlap)) is not None and more[1] < found[1]:
        return more[0]
    return found[0]


def _pieces(text: str, count: int, limit: int, overlap: int) -> tuple[list[tuple[int, int]], int] | None:
    """At most `count` balanced pieces and how many of their cuts are hard ones; None if a piece would exceed the limit.

    A cut snaps to a boundary near its target; where there is none, to the nearest strongest one of all places that the limit permits.
    """
    n, fresh = len(text), limit - overlap  # fresh: characters that a piece after the first can add
    out, begin, end, hard = [], 0, 0, 0
    slack = max(1, n // count // 4)
    while end < n and len(out) < count:
        left = count - len(out)
        if left == 1 or n - begin <= limit and n - end <= n / count:
            cut = n
        else:
            target = end + round((n - end) / left)
            # what remains must still fit into the pieces that are left
            least, most = max(end + 1, begin + overlap + 1, n - (left - 1) * fresh), min(begin + limit, n - 1)
            low, high = max(least, target - slack), min(most, target + slack)
            if low > high:
                return None
            cut = _snap(text, low - 1, target, high) or _snap(text, least - 1, target, most)
            if cut is None:
                cut, hard = _hard(text, low - 1, min(max(target, low), high)), hard + 1
        if cut - begin > limit:
            return None
        out.append((begin, cut))
        begin, end = _overlap(text, cut, overlap, begin + 1), cut
    return (out, hard) if end == n else None


def split_texts(df: DataFrame, key: str, text: str, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, n_pieces, begin, end, piece): the pieces of each text, numbered from 0.

    A null text gives no row, an empty one a single empty piece. Rows are independent: no shuffle, a long text is cut in one task.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    rows = df.select(key, text).where(f"`{text}` is not null")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(6)]
                part = batch.slice(at, 256)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    cuts = spans(t, limit, overlap)
                    for i, (a, b) in enumerate(cuts):
                        for col, v in zip(out, (k, i, len(cuts), a, b, t[a:b])):
                            col.append(v)
                kinds = [part.schema[0].type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[key, "piece_no", "n_pieces", "begin", "end", "piece"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, piece_no int, n_pieces int, begin int, end int, piece string")
