"""Repeated passages across documents, found by recompression.

Round by round, runs of one symbol and pairs of a left-class and a right-class symbol become new symbols. A symbol's name is
a 64-bit hash of what it stands for and its class a bit of that name, so every task names equal runs and pairs alike
without a dictionary. After two rounds, whether a symbol starts at a word depends on the five words before and after only
(a run's name does not hold its length, and runs join no pair), so equal passages have equal symbol starts inside.

A window of 20 words takes as key, among the symbol starts 5 to 12 words into it, the least code of the 13 words around
the start; without such a start (inside a long run), the code of the whole window. Equal windows have equal keys, and a
key is shared by neighbouring windows, so about a fifth of the words give a key. Then

1. chunks of documents send their keys once each to key buckets; a chunk gets back the keys other chunks have;
2. windows with such a key are sent with 96 bits of their own code and their first place in the chunk; a chunk gets back
   the windows that start earlier elsewhere;
3. the chunk compares its windows with each other and removes the words that a later window covers.

No step brings together the documents that share a passage: a key or window is sent once per chunk, whatever its count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import text as X

WINDOW = 20
REACH = 5
NO_KEY = np.uint64(2**64 - 1)
LAST_ID = np.iinfo(np.int64).max


def compress(symbol: np.ndarray, start: np.ndarray, opens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: names, first words and text starts of the symbols after naming runs and pairs.

    `opens` marks symbols that start a text; nothing crosses them.
    """
    if not len(symbol):
        return symbol, start, opens
    again = np.zeros(len(symbol) + 1, bool)
    again[1:-1] = (symbol[1:] == symbol[:-1]) & ~opens[1:]
    in_run = again[:-1] | again[1:]
    left = X.mix(symbol ^ np.uint64(level)) & np.uint64(1) == 0
    second = np.zeros(len(symbol) + 1, bool)
    second[1:-1] = left[:-1] & ~left[1:] & ~in_run[:-1] & ~in_run[1:] & ~opens[1:]
    at = np.flatnonzero(~again[:-1] & ~second[:-1])
    name = symbol[at].copy()
    runs, pairs = in_run[at], second[at + 1]
    name[runs] = X.mix(name[runs] + np.uint64(level + 101))
    name[pairs] = X.mix(name[pairs] * np.uint64(X.BASE) + symbol[at[pairs] + 1] + np.uint64(level))
    return name, start[at], opens[at]


def symbol_starts(w: X.Words, rounds: int = 2) -> np.ndarray:
    """Words at which a symbol starts after the rounds."""
    opens = np.zeros(len(w.code), bool)
    opens[w.first[:-1][w.count() > 0]] = True
    symbol, start = w.code, np.arange(len(w.code))
    for level in range(1, rounds + 1):
        symbol, start, opens = compress(symbol, start, opens, level)
    return start


def window_keys(w: X.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid window starts, their keys and their codes."""
    at = X.valid_starts(w, WINDOW)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    code = X.sequences(w.code, WINDOW)[at]
    around = X.sequences(w.code, 2 * REACH + 3)
    least = np.full(len(w.code) + WINDOW, NO_KEY, np.uint64)
    p = symbol_starts(w)
    p = p[(p >= REACH) & (p - REACH < len(around))]
    least[p] = around[p - REACH]
    for step in (1, 2, 4):
        least[:-step] = np.minimum(least[:-step], least[step:])
    key = least[at + REACH]
    return at, np.where(key == NO_KEY, X.mix(code + np.uint64(7)), key), code


def _ids(table: pa.Table, id_col: str) -> np.ndarray:
    return table.column(id_col).cast(pa.int64()).combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False)


def _order(code: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return np.lexsort((pos, ids, code))


def _starts(code: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of `docs` with `kept_text` (kept words joined by one space), `n_words` and `n_removed`.

    A word is removed if a window of 20 consecutive words covers it whose words also start earlier: in a document with a
    smaller id, or earlier in the same document. Words are runs of bytes other than white space, unchanged.

    Null text has no words (kept_text is empty); null ids count as one document after all others; rows with the same id
    and text are at the same place, so neither is earlier; texts under 20 words lose nothing. All columns of `docs` stay;
    columns of it named kept_text, n_words or n_removed are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("kept_text", "n_words", "n_removed")
    for own in [c for c in docs.columns if c.lower() == "__chunk"]:  # the name of the dealt chunk
        hidden = X.free_name("__chunk_of_input", docs.columns)
        return remove_repeats(docs.withColumnRenamed(own, hidden), id_col, text).withColumnRenamed(hidden, own)
    parts = X.chunks(docs, id_col, text)
    buckets = parts.buckets
    slim = X.Chunks(parts.rows, buckets)

    def keys_of(table: pa.Table) -> np.ndarray:
        return window_keys(X.words(table.column(text), X.SPACED))[1]

    def located(table: pa.Table, keep: np.ndarray | None) -> tuple[X.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, window starts, codes, document ids and places; only windows whose key is in `keep`, if given."""
        w = X.words(table.column(text), X.SPACED)
        at, key, code = window_keys(w)
        if keep is not None:
            picked = X.member(key, keep)
            at, code = at[picked], code[picked]
        row = w.text_of()[at]
        return w, at, code, _ids(table, id_col)[row], at - w.first[row]

    def send(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), **{c: pa.array([], pa.binary()) for c in ("keys", "check", "ids", "places")}})
        keep = np.sort(X.unpacked(reply, "keys", np.uint64)[0])
        w, at, code, ids, pos = located(table, keep)
        order = _order(code, ids, pos)
        order = order[_starts(code[order])]
        check = X.sequences(w.code, WINDOW, salt=0x5BD1E995).astype(np.uint32)[at[order]] if len(at) else np.zeros(0, np.uint32)
        return X.packed(key[0].as_py(), code[order], buckets, check=check, ids=ids[order], places=pos[order].astype(np.int32))

    def meet(table: pa.Table) -> pa.Table:
        code, n = X.unpacked(table, "keys", np.uint64)
        check, ids, pos = (X.unpacked(table, c, t)[0] for c, t in (("check", np.uint32), ("ids", np.int64), ("places", np.int32)))
        chunk = np.repeat(table.column("chunk").to_numpy(), n)
        order = np.lexsort((pos, ids, check, code))
        code, check, ids, pos, chunk = code[order], check[order], ids[order], pos[order], chunk[order]
        new = _starts(code)
        new[1:] |= check[1:] != check[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0)) if len(code) else np.zeros(0, np.int64)
        later = (ids != ids[lead]) | (pos != pos[lead])
        code, chunk = code[later], chunk[later]
        order = np.argsort(chunk, kind="stable")
        who, first = np.unique(chunk[order], return_index=True)
        ends = np.append(first[1:], len(order))
        return pa.table({"chunk": pa.array(who.astype(np.int32)), "keys": pa.array([code[order[a:b]].tobytes() for a, b in zip(first, ends)], pa.binary())})

    names = docs.columns

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        later = np.sort(X.unpacked(reply, "keys", np.uint64)[0])
        w, at, code, ids, pos = located(table, None)
        order = _order(code, ids, pos)
        new = _starts(code[order])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
        gone = X.member(code, later)
        gone[order] |= (ids[order] != ids[lead]) | (pos[order] != pos[lead])
        edge = np.zeros(len(w.code) + 1, np.int64)
        np.add.at(edge, at[gone], 1)
        np.add.at(edge, at[gone] + WINDOW, -1)
        removed = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(removed)])
        n_removed = total[w.first[1:]] - total[w.first[:-1]]
        off = X.bytes_of(table.column(text))[1]
        kept = []
        for i in range(table.num_rows):
            parts_ = w.data[off[i] : off[i + 1]].tobytes().split()
            if n_removed[i]:
                parts_ = [p for p, r in zip(parts_, removed[w.first[i] : w.first[i + 1]]) if not r]
            kept.append(b" ".join(parts_))
        out = {c: table.column(c) for c in names}
        out |= {"kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "n_words": pa.array(w.count()), "n_removed": pa.array(n_removed)}
        return pa.table(out)

    candidates = X.shared_keys(slim, keys_of)
    sent = parts.rows.groupBy("__chunk").cogroup(candidates.groupBy("chunk")).applyInArrow(
        send, "bucket int, chunk int, keys binary, check binary, ids binary, places binary")
    later = sent.groupBy("bucket").applyInArrow(meet, "chunk int, keys binary")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return parts.rows.groupBy("__chunk").cogroup(later.groupBy("chunk")).applyInArrow(
        remove, f"{fields}, kept_text string, n_words bigint, n_removed bigint")
