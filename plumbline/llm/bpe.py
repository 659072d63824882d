"""Byte-level BPE: merges taken from a rank queue over a hierarchical bitmap."""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice
from threading import Timer

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import text as X

CACHED = 500_000  # pieces a worker process remembers, the half used last at least
CACHED_CHARS = 48
BLOCK_CHARS = 1 << 20  # longer texts are cut into pieces lazily
IDLE_S = 2.0  # after which a worker process without a task gives its pieces' memory back
LONG = 4096  # bytes from which on a piece is held in flat arrays
BLOCK_IDS = 1 << 20  # ids decoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 bytes and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Waiting:
    """Places of a long piece that wait for one rank: those of the start in a flat array, later ones in a heap."""

    __slots__ = ("start", "at", "later")

    def __init__(self, start: array):
        self.start, self.at, self.later = start, 0, []

    def pop(self) -> int:
        if self.at < len(self.start) and not (self.later and self.later[0] < self.start[self.at]):
            self.at += 1
            return self.start[self.at - 1]
        return heappop(self.later)

    def __len__(self) -> int:
        return len(self.start) - self.at + len(self.later)


class RankQueue:
    """Places waiting per merge rank; the lowest rank is found by find-first-set on two bitmap levels of 256 bits and more."""

    def __init__(self, ranks: int):
        self.low, self.top = [0] * (ranks // 256 + 1), 0
        self.bucket: dict[int, list[int] | Waiting] = {}

    def push(self, rank: int, place: int) -> None:
        waiting = self.bucket.get(rank)
        if waiting is None:
            self.bucket[rank] = [place]
            self.low[rank >> 8] |= 1 << (rank & 255)
            self.top |= 1 << (rank >> 8)
        else:
            heappush(waiting if waiting.__class__ is list else waiting.later, place)

    def fill(self, ranks: np.ndarray) -> None:
        """All places of a long piece at once; negative ranks do not wait."""
        order = np.argsort(ranks, kind="stable").astype(np.int32)
        own, first = np.unique(ranks[order], return_index=True)
        for rank, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            if rank >= 0:
                self.bucket[rank] = Waiting(array("i", order[a:b].tobytes()))
                self.low[rank >> 8] |= 1 << (rank & 255)
                self.top |= 1 << (rank >> 8)

    def pop(self) -> tuple[int, int]:
        """Lowest rank and its leftmost place."""
        top = self.top
        a = (top & -top).bit_length() - 1
        bits = self.low[a]
        first = bits & -bits
        rank = a << 8 | first.bit_length() - 1
        waiting = self.bucket[rank]
        place = heappop(waiting) if waiting.__class__ is list else waiting.pop()
        if not waiting:
            del self.bucket[rank]
            self.low[a] = bits = bits ^ first
            if not bits:
                self.top = top & (top - 1)
        return rank, place


_encoders: dict[bytes, Encoder] = {}
_release: list[Timer] = []  # the timer that waits for the next task


class Encoder(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers; as a dict it is its own bounded memory."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.queue = ranks, RankQueue(max(ranks.values(), default=0) + 1)
        self.older: dict[str, bytes] = {}
        self.pairs = [-1] * (1 << 16)  # rank of every two bytes
        for raw, rank in ranks.items():
            if len(raw) == 2:
                self.pairs[raw[0] << 8 | raw[1]] = rank

    @staticmethod
    def of(key: bytes, ranks: dict[bytes, int]) -> Encoder:
        """The one of this worker process for a vocabulary, with what it remembers from earlier tasks."""
        while _release:
            _release.pop().cancel()
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(ranks)
        return _encoders[key]

    @staticmethod
    def rest() -> None:
        """The task is over: unless another one comes soon, forget everything."""
        timer = Timer(IDLE_S, _encoders.clear)
        timer.daemon = True
        timer.start()
        _release.append(timer)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = struct.pack("<I", whole) if whole is not None else self.merged(raw)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, raw: bytes) -> bytes:
        """Merge neighbours, lowest rank first and leftmost among equals, until no pair has a rank."""
        n, rank_of, queue, pairs = len(raw), self.ranks.get, self.queue, self.pairs
        if n >= LONG:
            data = np.frombuffer(raw, np.uint8).astype(np.int32)
            found = np.append(np.array(pairs, np.int32)[data[:-1] << 8 | data[1:]], np.int32(-1))
            queue.fill(found)
            pair = array("i", found.tobytes())
            after, before = (array("i", np.arange(s, n + s, dtype=np.int32).tobytes()) for s in (1, -1))
        else:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            pair = [pairs[a << 8 | b] for a, b in zip(raw, raw[1:])]
            pair.append(-1)
            for i, rank in enumerate(pair):
                if rank >= 0:
                    queue.push(rank, i)
        push, pop = queue.push, queue.pop
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale: a neighbour was merged meanwhile
            j = after[i]
            k = after[j]
            after[i], pair[j] = k, -1
            if k < n:
                before[k] = i
                new = rank_of(raw[i : after[k]], -1)
                pair[i] = new
                if new >= 0:
                    push(new, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                new = rank_of(raw[h:k], -1)
                pair[h] = new
                if new >= 0:
                    push(new, h)
        out, i = array("I"), 0
        ranks = self.ranks
        while i < n:
            k = after[i]
            out.append(ranks[raw[i:k]])
            i = k
        return out.tobytes()


def encode_text(text: str, encoder: Encoder, pattern: object) -> bytes:
    """Ids of one text; a very long text is matched in blocks of pieces."""
    if len(text) <= BLOCK_CHARS:
        return b"".join(map(encoder.__getitem__, pattern.findall(text)))
    found, out = pattern.finditer(text), []
    while block := [m.group() for m in islice(found, 65536)]:
        out.append(b"".join(map(encoder.__getitem__, block)))
    return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """`docs` with `ids`: the ids of every text as little-endian unsigned 32-bit integers in one binary value.

    Every match of `pattern` is encoded by itself, without special tokens. The ranks (of a fixed vocabulary file) are
    broadcast; the pass is narrow. Null or empty text has no ids (an empty value). `text` is dropped unless kept; a column
    `ids` of docs is replaced.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    with open(path, "rb") as f:
        key = hashlib.sha256(f.read()).digest()
    names = [c for c in docs.columns if c != "ids" and (keep_text or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoder, compiled = Encoder.of(key, ranks.value), regex.compile(pattern)
        try:
            for batch in batches:
                for part in X.slices(batch, text):
                    ids = [encode_text(t or "", encoder, compiled) for t in part.column(text).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(ids, pa.binary())], names=[*names, "ids"])
        finally:
            Encoder.rest()

    return docs.mapInArrow(run, f"{fields}{', ' if fields else ''}ids binary")


def decode(rows: DataFrame, path: str, out: str = "decoded") -> DataFrame:
    """`rows` with the bytes that `ids` stand for; null ids give no bytes, an unknown id is an error. A column `out` is replaced."""
    known = read_ranks(path)
    size = np.full(max(known.values(), default=-1) + 1, -1, np.int64)
    for raw, rank in known.items():
        size[rank] = len(raw)
    flat = b"".join(raw for raw, _ in sorted(known.items(), key=lambda x: x[1]))
    shared = rows.sparkSession.sparkContext.broadcast((np.frombuffer(flat, np.uint8), size))
    names = [c for c in rows.columns if c != out]
    fields = X.fields_of(rows, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, size = shared.value
        first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        for batch in batches:
            for part in X.slices(batch, "ids"):
                raw, off = X.bytes_of(part.column("ids").cast(pa.large_binary()))
                ids = np.frombuffer(raw.tobytes(), "<u4").astype(np.int64)
                if len(ids) and (ids.max() >= len(size) or (size[ids] < 0).any()):
                    raise ValueError("an id is not in the vocabulary")
                said = []
                for a in range(0, len(ids), BLOCK_IDS):
                    own = ids[a : a + BLOCK_IDS]
                    n = size[own]
                    end = np.cumsum(n)
                    said.append(letters[np.repeat(first[own] - (end - n), n) + np.arange(end[-1])].tobytes())
                bound = np.concatenate([[0], np.cumsum(size[ids])])[off // 4]
                data = b"".join(said)
                texts = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), texts.cast(pa.binary())], names=[*names, out])

    return rows.mapInArrow(run, f"{fields}, {out} binary")
