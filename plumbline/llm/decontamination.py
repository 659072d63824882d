"""Benchmark decontamination: test n-grams in a broadcast hash set, scanned over the word windows of every text."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as X

N = 10
BLOCK_BYTES = 8 << 20  # benchmark text per broadcast; its index takes about four times as much


class Index(NamedTuple):
    """Windows of one benchmark block: per window length the sorted codes, the first word and the item of each."""

    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    data: bytes
    bound: np.ndarray
    items: list[str | None]

    def text(self, word: int, n: int) -> bytes:
        return self.data[self.bound[word] : self.bound[word + n] - 1]


def spelled(w: X.Words) -> tuple[bytes, np.ndarray]:
    """All words lower-cased, each followed by a space, and where each starts."""
    low = w.data.tobytes().lower()
    parts = [low[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
    return b" ".join(parts) + b" ", np.concatenate([[0], np.cumsum(w.end - w.start + 1)])


def index_of(items: pa.Table, n: int) -> Index:
    w = X.words(items.column("text"), X.ALNUM_LOWER)
    data, bound = spelled(w)
    count, lengths = w.count(), {}
    for size in sorted(set(np.minimum(count, n).tolist()) - {0}):
        at = X.valid_starts(w, size)
        row = w.text_of()[at]
        own = count[row] >= n if size == n else count[row] == size
        at, row = at[own], row[own]
        code = X.sequences(w.code, size)[at]
        order = np.argsort(code, kind="stable")
        lengths[size] = (code[order], at[order], row[order])
    return Index(lengths, data, bound, items.column("id").to_pylist())


def hits(column: pa.ChunkedArray, index: Index) -> tuple[X.Words, np.ndarray, list[set[str]]]:
    """Words of the texts, which of them an occurrence covers, and the items found per text."""
    w = X.words(column, X.ALNUM_LOWER)
    row, edge, items = w.text_of(), np.zeros(len(w.code) + 1, np.int64), [set() for _ in range(len(w.first) - 1)]
    for size, (code, word, item) in index.lengths.items():
        at = X.valid_starts(w, size)
        own = X.sequences(w.code, size)[at] if len(at) else np.zeros(0, np.uint64)
        found = X.member(own, code)
        at, own = at[found], own[found]
        low, high = np.searchsorted(code, own, side="left"), np.searchsorted(code, own, side="right")
        for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            said = b" ".join(w.data[s:e].tobytes() for s, e in zip(w.start[i : i + size], w.end[i : i + size])).lower()
            same = [k for k in range(a, b) if index.text(word[k], size) == said]
            if same:
                edge[i] += 1
                edge[i + size] -= 1
                items[row[i]].update(x for k in same if (x := index.items[item[k]]) is not None)
    return w, np.cumsum(edge[:-1]) > 0, items


def spans(hit: np.ndarray) -> list[int]:
    """Covered word runs as start, end, start, end, ..."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


def _scan(docs: DataFrame, text: str, index: object, spans_name: str, items_name: str) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, text):
                w, hit, items = hits(part.column(text), index.value)
                cols = [*part.columns, pa.array([spans(hit[a:b]) for a, b in zip(w.first[:-1], w.first[1:])], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(w.count())]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, spans_name, items_name, "n_words"])

    return docs.mapInArrow(run, f"{fields}, `{spans_name}` array<bigint>, `{items_name}` array<string>, n_words bigint")


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row of `docs` with n_words, `hit_spans` (word ranges start, end, ... that benchmark windows cover) and `item_ids`.

    Words are runs of digits, letters and non-ASCII characters with A-Z lower-cased. A window is n consecutive words of an
    item, or all words of an item with fewer; codes find candidates and the words themselves are compared.

    The benchmark is broadcast in blocks of at most `block_bytes` of text (at least one item). With one block the scan is a
    single narrow pass. With more, every block scans the documents for itself and the found ranges of equal texts are
    united, so the result is the same and no broadcast grows.

    Null or empty text has no words and no hits; items without words have no window; items with a null id still cover
    words but are not listed; repeated rows get equal results. Columns named like results are replaced, any others stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "item_ids")
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-X.text_bytes(items, "text") // block_bytes))
    pick = lambda b: items.where(F.expr(f"pmod(xxhash64(id, text), {blocks}) = {b}")) if blocks > 1 else items
    shared = [spark.sparkContext.broadcast(index_of(pick(b).toArrow(), n)) for b in range(blocks)]
    if blocks == 1:
        return _scan(docs, text, shared[0], "hit_spans", "item_ids").select(*docs.columns, "hit_spans", "item_ids", "n_words")
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    key_name, spans_name, items_name, pairs_name = (X.free_name(x, docs.columns) for x in ("__key", "__spans", "__items", "__p"))
    slim = docs.select(key.alias("__key"), F.col(text).alias("text"))
    found = None
    for index in shared:
        one = _scan(slim, "text", index, "__spans", "__items").where("size(__spans) > 0").select("__key", "__spans", "__items")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy(F.col("__key").alias(key_name)).agg(
        F.flatten(F.collect_set("__spans")).alias(spans_name), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__items")))).alias("item_ids"))
    counted = _scan(docs, text, spark.sparkContext.broadcast(Index({}, b"", np.zeros(1, np.int64), [])), spans_name, items_name).drop(spans_name, items_name)
    joined = counted.withColumn(key_name, key).join(found, key_name, "left").drop(key_name)
    pairs = F.expr(f"transform(sequence(0, size({spans_name}) div 2 - 1), i -> named_struct('a', {spans_name}[2 * i], 'b', {spans_name}[2 * i + 1]))")
    merged = F.expr(
        f"aggregate(array_sort({pairs_name}), cast(array() as array<bigint>), (acc, x) -> if(size(acc) > 0 and x.a <= acc[size(acc) - 1], "
        "concat(slice(acc, 1, size(acc) - 1), array(greatest(x.b, acc[size(acc) - 1]))), concat(acc, array(x.a, x.b))))")
    none = F.col(spans_name).isNull()
    return (
        joined.withColumn(pairs_name, F.when(none, F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")).otherwise(pairs))
        .withColumn("hit_spans", merged).withColumn("item_ids", F.coalesce("item_ids", F.expr("cast(array() as array<string>)")))
        .select(*docs.columns, "hit_spans", "item_ids", "n_words")
    )


def hit_words() -> F.Column:
    """Number of covered words of a scanned row."""
    return F.expr("aggregate(hit_spans, 0L, (s, x) -> x - s, s -> if(size(hit_spans) = 0, 0L, s))")


def decontaminate(docs: DataFrame, benchmark: DataFrame, how: str = "documents", text: str = "text", **options: object) -> DataFrame:
    """`docs` without contaminated documents (`how="documents"`), or with their covered words cut out (`how="spans"`).

    A cut takes the bytes from the first to the last covered word and leaves one space; other texts stay as they are.
    """
    found = scan(docs, benchmark, text, **options)
    if how == "documents":
        return found.where("size(hit_spans) = 0").select(*docs.columns)
    if how != "spans":
        raise ValueError(f"how is documents or spans, not {how}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, text):
                w, out = X.words(part.column(text), X.ALNUM_LOWER), part.column(text).to_pylist()
                off = X.bytes_of(part.column(text))[1]
                for i, ranges in enumerate(part.column("hit_spans").to_pylist()):
                    if ranges:
                        pieces, last, first = [], off[i], w.first[i]
                        for a, b in zip(ranges[::2], ranges[1::2]):
                            pieces.append(w.data[last : w.start[first + a]].tobytes())
                            last = w.end[first + b - 1]
                        out[i] = b" ".join([*pieces, w.data[last : off[i + 1]].tobytes()]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text else part.column(c) for c in names], names=names)

    return found.mapInArrow(cut, fields)
