"""Byte-pair encoding of a corpus with a public rank file, as a streaming transducer with bounded lookahead.

Merges apply in rank order. Whether a boundary between two tokens stands can depend on bytes to its right
only through a chain of merges, each of a lower rank than the one it disturbs and starting inside its right part.
The longest such chain, in bytes, is the merge list's *sufficient lookahead*; it is computed once from the list.
A token is stable, and emitted, as soon as that many bytes after it are known, so memory is constant however
long the text is. Merging restarts at a stable boundary: no merge crosses it, so both sides merge as they would together.

The pattern that splits text before the merges is a transducer too: a run that it finds is settled as soon as AHEAD more characters
are known, and a run longer than the window is merged as a stream of its own while it lasts. Every text takes this one way, in
chunks of CHUNK bytes; runs that were met before are looked up.
"""

from __future__ import annotations

import base64
import codecs
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The kinds of runs of that pattern, by their beginning and what continues them.
KINDS = [(r" ?\p{L}", r"\p{L}*"), (r" ?\p{N}", r"\p{N}*"), (r"\s\s", r"\s*"), (r" ?[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]*")]
AHEAD = 3  # characters after a run on which its end can rest: the longest of the pattern's endings, 're, has three
WINDOW = 8 << 10  # characters of one run that are held before it is merged as a stream
CHUNK = 64 << 10  # bytes of a text that are taken in at once
CACHE, CACHED = 300_000, 64  # runs whose ids a worker remembers, and their most characters
BATCH = 4 << 20  # bytes of text per output batch
HELD = 1 << 20  # ids held as Python numbers


class Stream:
    """Ids of one run of bytes that arrives in parts. Holds a window of a few lookaheads, whatever the length of the run."""

    def __init__(self, enc: Encoder, window: int | None = None):
        self.enc, self.held = enc, bytearray()
        self.window = max(window or 4 * enc.lookahead, enc.lookahead + 512)

    def feed(self, data: bytes) -> list[int]:
        """Ids that are stable now."""
        out, held, tokens = [], self.held, self.enc.tokens
        held += data
        settled = self.window - self.enc.lookahead
        while len(held) >= self.window:
            at = 0
            for i in self.enc.merge(bytes(held[: self.window])):
                if at + len(tokens[i]) > settled:
                    break
                at += len(tokens[i])
                out.append(i)
            del held[:at]
        return out

    def close(self) -> list[int]:
        """The rest, as nothing follows."""
        out = self.enc.merge(bytes(self.held)) if self.held else []
        self.held.clear()
        return out


class Run:
    """A run of the pattern that fills the window, as a stream while it lasts."""

    def __init__(self, enc: Encoder, text: str):
        self.kind = next(i for i, (begin, _) in enumerate(enc.kinds) if begin.match(text))
        self.space = KINDS[self.kind][1] == r"\s*"
        self.more, self.stream = enc.kinds[self.kind][1], Stream(enc)
        self.begun = False

    def feed(self, text: str, last: bool) -> tuple[list[int], str, bool]:
        """(stable ids, what is left of the text, whether the run is over). Of white space the last character waits, for it may lead the next run."""
        end = self.more.match(text, int(not self.begun and not self.space and text[0] == " ")).end()
        over = end < len(text) or last
        if self.space and not (end == len(text) and last):
            end = max(0, end - 1)
        self.begun = True
        ids = self.stream.feed(text[:end].encode())
        return ids + self.stream.close() if over else ids, text[end:], over


class Encoder(dict):
    """Run of text -> its ids, as the stream gives them. Emptied when CACHE runs are held."""

    def __init__(self, raw: bytes, ahead: int | None = None):
        super().__init__()
        pairs = [line.split() for line in raw.splitlines() if line]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.kinds = [(regex.compile(begin), regex.compile(more)) for begin, more in KINDS]
        self._ahead = ahead

    def __missing__(self, run: str) -> tuple[int, ...]:
        ids = tuple(self.stream((run.encode(),)))
        if len(run) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[run] = ids
        return ids

    @property
    def lookahead(self) -> int:
        """Sufficient lookahead in bytes.

        chain[x]: the most bytes after a token x on which a merge that takes x as its left part, and the chain behind it, can rest.
        A merge (a, b) can be disturbed by lower-ranked merges whose left part ends where b ends, that is by the last parts of b.
        """
        if self._ahead is None:
            reach: dict[bytes, int] = {}
            ends: dict[bytes, tuple[bytes, ...]] = {}
            self._ahead = 1
            for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
                if len(token) == 1:
                    ends[token] = (token,)
                    continue
                parts = self._split(token, rank)
                left, right = parts[0], parts[-1]
                behind = max(reach.get(x, 0) for x in ends[right])
                ends[token] = (token, *ends[right])
                reach[left] = max(reach.get(left, 0), len(right) + behind)
                self._ahead = max(self._ahead, len(right) + behind)
        return self._ahead

    def _split(self, token: bytes, rank: int) -> list[bytes]:
        """The two parts that the merge of this rank joins."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                raise ValueError(f"rank {rank} is not the merge of two earlier tokens")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge(self, data: bytes) -> list[int]:
        """Ids of one run of bytes, all merges applied in rank order; equal ranks from the left."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        if n < 48:
            parts = [data[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                near = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
                if (best := min(near)) == 1 << 60:
                    break
                at = near.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray([1]) * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def stream(self, parts: Iterable[bytes], window: int | None = None) -> Iterator[int]:
        """Ids of a run of bytes that arrives in parts."""
        run = Stream(self, window)
        for part in parts:
            yield from run.feed(part)
        yield from run.close()

    def transduce(self, chunks: Iterable[str]) -> Iterator[Iterable[int]]:
        """Ids of a text that arrives in chunks, in groups, each as soon as it is stable.

        Runs that end within AHEAD characters of what is known wait for the next chunk. If no run is settled when WINDOW characters are
        known, they all lie in one run, which goes on as a stream until it ends. Holds a window and a chunk, whatever the length of the text.
        """
        chunks = iter(chunks)
        held, run, coming = "", None, next(chunks, None)
        while coming is not None:
            held, coming = held + coming, next(chunks, None)
            last = coming is None
            while held:
                if run is None:
                    runs, waiting = self.find(held), 0
                    if not last:
                        n, at = len(runs), len(held)
                        while n and at > len(held) - AHEAD:
                            n -= 1
                            at -= len(runs[n])
                        runs, waiting = runs[:n], len(held) - at
                    yield chain.from_iterable(map(self.__getitem__, runs))
                    held = held[len(held) - waiting :] if waiting else ""
                    if len(held) < WINDOW:
                        break
                    run = Run(self, held)
                ids, held, over = run.feed(held, last)
                yield ids
                if not over:
                    break
                run = None

    def encode(self, text: str) -> list[int]:
        """Ids of a text that is there as a whole."""
        return list(chain.from_iterable(self.transduce(text[i : i + CHUNK] for i in range(0, len(text), CHUNK))))

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids: a byte-to-text state machine that holds back the bytes of an unfinished character."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := state.decode(self.tokens[i]):
                yield text
        if text := state.decode(b"", True):
            yield text


_ENCODERS: dict[int, Encoder] = {}
_AHEAD: dict[int, int] = {}


def encoder(shared: tuple[bytes, int]) -> Encoder:
    """The worker's encoder of a rank file; built once per Python worker."""
    key = hash(shared)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*shared)
    return _ENCODERS[key]


def vocabulary(df: DataFrame, path: str):
    """The rank file and its lookahead as a broadcast of the file's bytes (below 1 MB for 50,000 ranks; over 16 MB is refused)."""
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 16 << 20:
        raise ValueError(f"{path}: {len(raw)} bytes is too large a vocabulary to broadcast")
    if (key := hash(raw)) not in _AHEAD:
        _AHEAD[key] = Encoder(raw).lookahead
    return df.sparkSession.sparkContext.broadcast((raw, _AHEAD[key]))


def batches_of(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most about BATCH bytes of text each; a longer text comes alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        part = np.cumsum(sizes) // BATCH
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows] if len(part) else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> Iterator[Iterator[str]]:
    """Each text of a string column as its chunks, decoded while they are taken; null and '' have none. Bytes that are no UTF-8 come as U+FFFD."""
    _, ends, data = column.buffers()
    view = memoryview(data) if data is not None else memoryview(b"")
    ends = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4).tolist()
    for a, b, known in zip(ends, ends[1:], column.is_valid().to_pylist()):
        yield _decoded(view[a : b if known else a])


def _decoded(data: memoryview) -> Iterator[str]:
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(data), CHUNK):
        yield state.decode(data[at : at + CHUNK], at + CHUNK >= len(data))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each text, without special tokens; a special token's string is ordinary text.

    Null and empty texts give an empty array, never null. One row per input row, null keys and repeated rows included; no shuffle.
    """
    shared = vocabulary(df, path)

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches_of(batches, 1):
            ids, parts, ends = [], [], [0]
            size = 0
            for chunks in texts_of(batch.column(1)):
                for group in enc.transduce(chunks):
                    ids.extend(group)
                    if len(ids) > HELD:
                        parts.append(np.array(ids, np.int32))
                        size += len(ids)
                        ids = []
                ends.append(size + len(ids))
            parts.append(np.array(ids, np.int32))
            values = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, "ids"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(keep.., n_tokens): the number of tokens of each text, 0 for null and empty ones; no shuffle."""
    shared = vocabulary(df, path)

    def run(batches):
        enc = encoder(shared.value)
        last = len(keep)
        for batch in batches_of(batches, last):
            counts = [sum(sum(1 for _ in group) for group in enc.transduce(chunks)) for chunks in texts_of(batch.column(last))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    rows = df.select(*keep, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, n_tokens long")


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens, same): whether decoding the ids of each text gives the text back, null and empty as ''.

    The decoded text is compared piece by piece with the text's own chunks, so neither is held whole.
    """
    shared = vocabulary(df, path)

    def run(batches):
        enc = encoder(shared.value)
        for batch in batches_of(batches, 1):
            n, same = [], []
            for chunks, again in zip(texts_of(batch.column(1)), texts_of(batch.column(1))):
                state, ahead, ok, k = codecs.getincrementaldecoder("utf-8")("replace"), "", True, 0
                for group in chain(enc.transduce(chunks), (None,)):
                    ids = list(group or ())
                    k += len(ids)
                    got = state.decode(b"".join(map(enc.tokens.__getitem__, ids)), group is None)
                    while len(ahead) < len(got) and (more := next(again, None)) is not None:
                        ahead += more
                    ok, ahead = ok and ahead.startswith(got), ahead[len(got) :]
                n.append(k)
                same.append(ok and not ahead and next(again, None) is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same)], names=[key, "n_tokens", "same"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, n_tokens long, same boolean")
