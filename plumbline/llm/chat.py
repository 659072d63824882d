"""Chat formatting: conversations assembled column-wise into one preallocated byte buffer per Arrow batch.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside texts are escaped: `<`, any backslashes and `|` get
one backslash more, so an escaped text never holds `<|`. In roles backslash, line feed and `<` are escaped as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm import text as X

OPEN, MIDDLE, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
PARTS = "part bigint, formatted string, loss array<struct<start:bigint,length:bigint>>"
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = {"\\\\": "\\", "\\n": "\n", "\\l": "<"}


def escape_texts(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.fill_null(column, ""), r"<(\\*)\|", r"<\\\1|")


def escape_roles(column: pa.Array) -> pa.Array:
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("<", "\\l")):
        column = pc.replace_substring(column, a, b)
    return column


def unescape_text(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\nl]", lambda m: _ROLE[m.group()], role)


def scatter(out: np.ndarray, column: pa.Array, to: np.ndarray) -> None:
    """Copy every value's bytes to its place in the buffer."""
    data, off = X.bytes_of(column)
    size = np.diff(off)
    out[np.repeat(to - off[:-1], size) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, where each turn starts, and where each turn's text starts and ends."""
    role_len, text_len = (np.diff(X.bytes_of(c)[1]) for c in (roles, texts))
    at = np.concatenate([[0], np.cumsum(len(OPEN) + role_len + len(MIDDLE) + text_len + len(CLOSE))])
    turn = at[:-1]
    role_at, out = turn + len(OPEN), np.empty(at[-1], np.uint8)
    text_at = role_at + role_len + len(MIDDLE)
    text_end = text_at + text_len
    for piece, to in ((OPEN, turn), (MIDDLE, role_at + role_len), (CLOSE, text_end)):
        out[to[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    scatter(out, roles, role_at)
    scatter(out, texts, text_at)
    return out, at, text_at, text_end


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """(conv, part, formatted, loss): formatted conversations with the character ranges of the turns to learn from.

    A conversation is one part unless it crosses an Arrow batch or 4 MB of text; then its parts follow each other in order
    and join to the whole, so no conversation has to fit in memory. Rows are dealt by conversation and sorted by turn; rows
    of the same turn follow by role and text.

    Null texts and roles are empty; a null turn comes first; rows with a null id are one conversation; repeated rows are
    turns of their own; other columns are not carried. An empty table gives an empty table.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = turns.select(conv, turn, role, text).repartition(conv).sortWithinPartitions(conv, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = object(), 0
        for batch in batches:
            for rows_ in X.slices(batch, text):
                ids = rows_.column(conv).to_pylist()
                roles = pc.fill_null(rows_.column(role), "")
                out, at, text_at, text_end = assemble(escape_roles(roles), escape_texts(rows_.column(text)))
                chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
                first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
                bound, wanted = [*first, len(ids)], pc.equal(roles, loss_role).to_numpy(zero_copy_only=False)
                numbers, loss = [], []
                for a, b in zip(bound[:-1], bound[1:]):
                    part = part + 1 if ids[a] == last and last is not None or (ids[a] is None and last is None) else 0
                    last = ids[a]
                    numbers.append(part)
                    loss.append([{"start": int(chars[text_at[i]] - chars[at[a]]), "length": int(chars[text_end[i]] - chars[text_at[i]])} for i in range(a, b) if wanted[i]])
                offsets = pa.py_buffer(at[bound].astype(np.int32))
                formatted = pa.StringArray.from_buffers(len(first), offsets, pa.py_buffer(out))
                yield pa.RecordBatch.from_arrays(
                    [rows_.column(conv).take(pa.array(first)), pa.array(numbers, pa.int64()), formatted,
                     pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                    names=[conv, "part", "formatted", "loss"])

    return rows.mapInArrow(run, f"`{conv}` {kind}, {PARTS}")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    out = []
    for said in formatted.split(OPEN.decode())[1:]:
        role, _, text = said[: -len(CLOSE)].partition("\n")
        out.append((unescape_role(role), unescape_text(text)))
    return out


DIGESTS = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, read from the rows of `format_chats` in their order: turns, loss text and sizes as digests.

    Digests are fed part by part, so a conversation of any length takes constant memory.
    """
    kind = parts.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            ids, n, turns, chars, loss, size = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(n, pa.int64()), pa.array([t.hexdigest() for t in turns]), pa.array(chars, pa.int64()),
                 pa.array([x.hexdigest() for x in loss]), pa.array(size, pa.int64())],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done, id_type = [], batch.column(conv).type
            for row in batch.to_pylist():
                if state is None or row["part"] == 0:
                    if state is not None:
                        done.append((now, *state))
                    now, state = row[conv], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(row["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape_text(row["formatted"][span["start"] : span["start"] + span["length"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(row["formatted"])
            if done:
                yield batch_of(done)
        if state is not None:
            yield batch_of([(now, *state)])

    return parts.mapInArrow(run, f"`{conv}` {kind}, {DIGESTS}")
