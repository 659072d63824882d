"""Words of whole texts as 64-bit codes, computed on Arrow's bytes, and the packed key exchange two operators share.

A task never loops over words in Python: word bounds come from a byte table, word codes from prefix sums of a polynomial
over the bytes, codes of word sequences from the same polynomial over the codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import work_folder

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SEGMENT = 1 << 20
LONG_WORD = 256  # bytes; longer words have their code from a cryptographic hash, as sums modulo 2^64 collide for some
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 32 << 20
WHITE = bytes([9, 10, 11, 12, 13, 32])
NOT_ALNUM = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = np.asarray(x, np.uint64)
    out = x >> np.uint64(32)
    out ^= x
    for _ in range(2):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """A random value per word byte, 0 per separator; with `lower`, A-Z have the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


SPACED = byte_table(WHITE, lower=False)
SPACED_LOWER = byte_table(WHITE, lower=True)
ALNUM_LOWER = byte_table(NOT_ALNUM, lower=True)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT * 2)
        _powers.clear()
        for b in (BASE, BASE_INVERSE):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors))
    return _powers[0], _powers[1]


class Words(NamedTuple):
    """Words of several texts: code, byte bounds in `data`, and the first word of each text (one entry more than texts)."""

    data: np.ndarray
    code: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(column: pa.Array | pa.ChunkedArray, table: np.ndarray) -> Words:
    """The words of every text of a column; a word never spans two texts."""
    data, off = bytes_of(column)
    n = len(data)
    inside = (table != 0)[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    cuts = off[(off > 0) & (off < n)]
    begin[cuts] |= inside[cuts]
    stop[cuts - 1] |= inside[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    code = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + SEGMENT)))
        a, b = start[at], end[to - 1]
        up, down = powers(int(b - a))
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        code[at:to] = (sums[end[at:to] - a] - sums[start[at:to] - a]) * down[start[at:to] - a]
        at = to
    code = mix(code)
    for i in np.flatnonzero(end - start >= LONG_WORD).tolist():
        code[i] = int.from_bytes(hashlib.blake2b(table[data[start[i] : end[i]]].tobytes(), digest_size=8).digest(), "little")
    return Words(data, code, start, end, np.searchsorted(start, off))


def sequences(code: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Code of every n consecutive words, across text bounds too: the caller picks the valid starts."""
    size = max(0, len(code) - n + 1)
    out = np.full(size, n + salt, np.uint64)
    for k in range(n):
        out *= np.uint64(BASE)
        out += code[k : k + size] ^ np.uint64(salt)
    return mix(out)


def valid_starts(w: Words, n: int) -> np.ndarray:
    """Starts of n consecutive words that lie in one text."""
    if len(w.code) < n:
        return np.zeros(0, np.int64)
    at = np.arange(len(w.code) - n + 1)
    return at[at + n <= w.first[w.text_of()[: len(at)] + 1]]


def member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array `wanted`."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


class Lookup:
    """Places of 64-bit keys in a sorted array, found by their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(1, min(22, len(keys).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.first).max(initial=0))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Index of each value among the keys, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not len(self.keys):
            return out
        head = (values >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        open_ = np.flatnonzero(at < end)
        for _ in range(self.longest):
            if not len(open_):
                break
            same = self.keys[at[open_]] == values[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def slices(batch: pa.RecordBatch | pa.Table, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive rows with about `size` bytes of text; a longer text comes alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0)
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores after it until no column is called so; Spark does not tell upper from lower case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def fields_of(df: DataFrame, names: list[str]) -> str:
    """Some columns of `df` as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (df.schema[c] for c in names))


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of text in all rows; one number, for the numbers of chunks and buckets."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a table in the shared folder: it is computed once, and its lineage ends there."""
    folder = work_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Chunks(NamedTuple):
    """Rows dealt into bounded chunks (column `__chunk`), and the number of key buckets for them."""

    rows: DataFrame
    buckets: int


def chunks(docs: DataFrame, id_col: str, text: str) -> Chunks:
    """Deal whole rows by a hash of id and text, so that copies and equal ids spread; one shuffle, which later steps reuse."""
    total = text_bytes(docs, text)
    n = max(shuffle_parts(docs.sparkSession), -(-total // CHUNK_BYTES))
    key = F.expr(f"cast(pmod(xxhash64(`{id_col}`, `{text}`), {n}) as int)")
    return Chunks(docs.withColumn("__chunk", key).repartition(n, "__chunk"), max(shuffle_parts(docs.sparkSession), -(-total // BUCKET_BYTES)))


PACKED = "bucket int, chunk int, keys binary"


def packed(chunk: int, keys: np.ndarray, buckets: int, **more: np.ndarray) -> pa.Table:
    """Keys of one chunk, one row per key bucket; `more` holds arrays that go with the keys."""
    bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    ids, at = np.unique(bucket[order], return_index=True)
    ends = np.append(at[1:], len(keys))
    cols = {"bucket": pa.array(ids.astype(np.int32)), "chunk": pa.array(np.full(len(ids), chunk, np.int32))}
    for name, values in {"keys": keys, **more}.items():
        values = values[order]
        cols[name] = pa.array([values[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
    return pa.table(cols)


def unpacked(table: pa.Table, column: str, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many each row has."""
    data, off = bytes_of(table.column(column).cast(pa.large_binary()).combine_chunks()) if table.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return np.frombuffer(data.tobytes(), dtype), np.diff(off) // np.dtype(dtype).itemsize


def shared_keys(parts: Chunks, keys_of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(chunk, keys): per chunk those of its keys that some other chunk has too.

    A chunk sends each key once, so a key that a third of all rows hold is sent once per chunk, not once per row.
    """
    buckets = parts.buckets

    def send(table: pa.Table) -> pa.Table:
        return packed(table.column("__chunk")[0].as_py(), np.unique(keys_of(table)), buckets)

    def meet(table: pa.Table) -> pa.Table:
        keys, n = unpacked(table, "keys", np.uint64)
        chunk = np.repeat(table.column("chunk").to_numpy(), n)
        order = np.argsort(keys, kind="stable")
        keys, chunk = keys[order], chunk[order]
        same = keys[1:] == keys[:-1]
        found = np.zeros(len(keys), bool)
        found[1:] |= same
        found[:-1] |= same
        keys, chunk = keys[found], chunk[found]
        order = np.argsort(chunk, kind="stable")
        ids, at = np.unique(chunk[order], return_index=True)
        ends = np.append(at[1:], len(order))
        return pa.table({"chunk": pa.array(ids.astype(np.int32)), "keys": pa.array([keys[order[a:b]].tobytes() for a, b in zip(at, ends)], pa.binary())})

    sent = parts.rows.groupBy("__chunk").applyInArrow(send, PACKED)
    return sent.groupBy("bucket").applyInArrow(meet, "chunk int, keys binary")
