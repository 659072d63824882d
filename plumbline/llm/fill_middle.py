"""Fill-in-middle transformation by displacement scatter.

Cutting a text in prefix, middle and suffix and laying the parts out in another order moves every byte of a part by the
same amount. For all texts of a slice at once, a difference array holds at each part's first byte how much its displacement
differs from the part before it; the cumulative sum is the displacement of every byte, and one numpy scatter builds all
outputs. The way back finds the cuts in the output, makes the same displacements and gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as X

PLAIN, SPM, PSM = "plain", "spm", "psm"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3  # bytes of each mark
LETTERS = b"PSM"
WORD = np.ones(256, bool)
WORD[list(X.WHITE)] = False
BLOCK = 1 << 20  # bytes moved at a time


class Cuts(NamedTuple):
    """Where the middle and the suffix of each text begin, as byte positions in the slice, and which texts are cut how."""

    middle: np.ndarray
    suffix: np.ndarray
    spm: np.ndarray
    psm: np.ndarray


def units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all units (white space with the word after it, or white space that ends a text), and each text's first unit."""
    word = WORD[data]
    stop = np.zeros(len(data) + 1, bool)  # a unit ends before this byte
    stop[1:-1] = word[:-1] & ~word[1:]
    stop[off[1:][np.diff(off) > 0]] = True
    ends = np.flatnonzero(stop)
    return ends, np.searchsorted(ends, off, side="right")


def has_mark(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which texts contain one of the marks."""
    at = np.flatnonzero(data == ord("<"))
    at = at[at + 2 < len(data)]
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(LETTERS, np.uint8))]
    text = np.searchsorted(off, at, side="right") - 1
    out = np.zeros(len(off) - 1, bool)
    out[text[at + MARK <= off[text + 1]]] = True
    return out


def displacements(off: np.ndarray, out_off: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Difference array over the input bytes: its cumulative sum is how far each byte moves.

    With p, m and s bytes in the parts, psm moves them by one mark, three marks + s, and two marks - m; spm moves them by
    two marks + s, three marks + s, and one mark - p - m.
    """
    first, end = off[:-1], off[1:]
    p, m, s = cuts.middle - first, cuts.suffix - cuts.middle, end - cuts.suffix
    base = out_off[:-1] - first
    moved = np.where(cuts.spm, 2 * MARK + s, np.where(cuts.psm, MARK, 0)) + base
    middle = np.where(cuts.spm | cuts.psm, 3 * MARK + s, 0) + base
    suffix = np.where(cuts.spm, MARK - p - m, np.where(cuts.psm, 2 * MARK - m, 0)) + base
    steps = np.zeros(off[-1] + 1, np.int64)
    np.add.at(steps, first, moved)
    np.add.at(steps, cuts.middle, middle - moved)
    np.add.at(steps, cuts.suffix, suffix - middle)
    np.add.at(steps, end, -suffix)
    return steps


def moves(steps: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of input bytes with the place of each in the output."""
    shift = 0
    for a in range(0, len(steps) - 1, BLOCK):
        b = min(a + BLOCK, len(steps) - 1)
        place = np.cumsum(steps[a:b])
        place += shift
        shift = int(place[-1])
        place += np.arange(a, b)
        yield a, b, place


def build(data: np.ndarray, off: np.ndarray, cuts: Cuts) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of all texts, and where each starts."""
    cut = cuts.spm | cuts.psm
    out_off = off + np.concatenate([[0], np.cumsum(3 * MARK * cut)])
    out = np.empty(out_off[-1], np.uint8)
    for a, b, place in moves(displacements(off, out_off, cuts)):
        out[place] = data[a:b]
    p, s = cuts.middle - off[:-1], off[1:] - cuts.suffix
    for which, order in ((cuts.psm, ((PREFIX, 0 * p), (SUFFIX, MARK + p), (MIDDLE, 2 * MARK + p + s))), (cuts.spm, ((SUFFIX, 0 * p), (PREFIX, MARK + s), (MIDDLE, 2 * MARK + p + s)))):
        for mark, at in order:
            where = (out_off[:-1] + at)[which]
            for k in range(MARK):
                out[where + k] = mark[k]
    return out, out_off


def found_cuts(out: np.ndarray, out_off: np.ndarray, forms: list[str]) -> tuple[np.ndarray, Cuts]:
    """Where the input texts start and are cut, read from the outputs; each mark stands in an output once."""
    size = np.diff(out_off)
    kind = np.array(forms, dtype="U5") if forms else np.zeros(0, "U5")
    spm, psm = kind == SPM, kind == PSM
    off = np.concatenate([[0], np.cumsum(size - 3 * MARK * (spm | psm))])
    middle, suffix = off[:-1].copy(), off[:-1].copy()
    at = np.flatnonzero(out == ord("<"))
    at = at[at + 2 < len(out)]
    at = at[out[at + 2] == ord(">")]
    text = np.searchsorted(out_off, at, side="right") - 1
    at, text = at[(spm | psm)[text]], text[(spm | psm)[text]]
    spot = {}
    for mark in (PREFIX, SUFFIX, MIDDLE):
        own = out[at + 1] == mark[1]
        spot[mark] = np.zeros(len(size), np.int64)
        spot[mark][text[own]] = at[own] - out_off[text[own]]
    p = np.where(psm, spot[SUFFIX] - MARK, spot[MIDDLE] - spot[PREFIX] - MARK)
    m = size - spot[MIDDLE] - MARK
    cut = spm | psm
    middle[cut] += p[cut]
    suffix[cut] += (p + m)[cut]
    return off, Cuts(middle, suffix, spm, psm)


def gather(out: np.ndarray, out_off: np.ndarray, forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts that the outputs were built from, and where each starts."""
    off, cuts = found_cuts(out, out_off, forms)
    data = np.empty(off[-1], np.uint8)
    for a, b, place in moves(displacements(off, out_off, cuts)):
        data[a:b] = out[place]
    return data, off


def strings(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """Bytes and bounds as a string column, without a copy per row."""
    if off[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)])


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many code points begin before each of the ascending positions."""
    edges = np.concatenate([[0], at])
    return np.cumsum([np.count_nonzero((data[a:b] & 0xC0) != 0x80) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])


FOUND = "n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """`docs` without its text, with n_units, form, prefix_chars, middle_chars and output.

    A unit is white space with the word after it, or white space that ends the text. The first four 8-digit groups of the
    hex sha256 of `seed:id` are h1 to h4. The cuts stand after the smaller and the larger of h1 and h2 modulo units + 1;
    the text stays as it is (plain) if it is empty, holds a mark, or h3 % 100 >= `rate`; otherwise it is laid out as
    suffix, prefix, middle (spm) if h4 % 100 < `spm_rate`, else as prefix, suffix, middle (psm), each after its mark.

    Null text counts as empty, a null id as the empty string; rows with equal id and text get equal results. Columns of
    docs with the names of results are replaced, all others stay. The pass is narrow; a long text is moved in blocks.
    """
    names = [c for c in docs.columns if c not in (text, "n_units", "form", "prefix_chars", "middle_chars", "output")]
    own = X.free_name("draws", docs.columns)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)])
    rows = docs.select(*names, F.col(text), draws.alias(own))
    fields = X.fields_of(docs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, text):
                data, off = X.bytes_of(part.column(text))
                h = part.column(own).flatten().to_numpy().reshape(-1, 4)
                ends, first = units(data, off)
                n = np.diff(first)
                low, high = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))
                place = lambda k: np.where(k > 0, np.append(ends, 0)[np.maximum(first[:-1] + k - 1, 0)], off[:-1])  # noqa: B023, E731
                cut = (n > 0) & ~has_mark(data, off) & (h[:, 2] % 100 < rate)
                spm = cut & (h[:, 3] % 100 < spm_rate)
                cuts = Cuts(np.where(cut, place(low), off[:-1]), np.where(cut, place(high), off[:-1]), spm, cut & ~spm)
                out, out_off = build(data, off, cuts)
                chars = code_points(data, np.stack([off[:-1], cuts.middle, cuts.suffix], 1).ravel()).reshape(-1, 3)
                form = np.where(cuts.spm, SPM, np.where(cuts.psm, PSM, PLAIN))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars[:, 1] - chars[:, 0], mask=~cut),
                     pa.array(chars[:, 2] - chars[:, 1], mask=~cut), strings(out, out_off)], names=[*names, "n_units", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"{fields}{', ' if fields else ''}{FOUND}")


def restore(rows: DataFrame, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """`rows` with the text that each output was built from, read from the output and its form alone.

    Null output gives an empty text; a null form counts as plain. A column `to` is replaced.
    """
    names = [c for c in rows.columns if c != to]
    fields = X.fields_of(rows, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, output):
                out, out_off = X.bytes_of(part.column(output))
                data, off = gather(out, out_off, [x or PLAIN for x in part.column(form).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), strings(data, off)], names=[*names, to])

    return rows.mapInArrow(run, f"{fields}, `{to}` string")
