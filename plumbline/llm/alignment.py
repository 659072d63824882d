"""Cross-tokenizer alignment, each distinct text once.

Documents are shuffled by their full text, so that every distinct text is tokenised and aligned once and carries its number
of copies. Two tokenisations of the same bytes are aligned by the ends of their tokens: all ends of both cut the bytes in
elementary pieces, each piece lies in one token of either side and is one link, and ends that both have close a group. How
often an id pair is linked is counted over distinct texts, weighted by their copies; the measures of a text are then
joined to all documents that hold it.

Inside a task a text falls in pieces at spaces no token crosses, and pieces met before are not tokenised again. Token ids
are kept as a table between the passes (2 bytes an id for vocabularies of up to 65,536), which numpy aligns
again, all texts of a slice at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as X

SLICE_BYTES = 1 << 20  # text tokenised at a time
KNOWN, KNOWN_CHARS = 250_000, 48  # aligned pieces a worker remembers, and their longest
LINE_CHARS = 1 << 15  # pieces that are new are tokenised side by side in lines of about this length
HELD_PAIRS = 1 << 21  # pairs a task gathers before it hands them over
BLOCK_PAIRS = 1 << 21  # pair counts that are broadcast at a time, 17 bytes each
# Letters, digits and signs that no normal form changes; a single space between two of them starts a token on either side.
STEADY = "[!-~À-ÖØ-öø-ÿ]"
SAFE = re.compile(f"(?<={STEADY}) (?={STEADY})")
ENDS_STEADY = re.compile(f"{STEADY}(.*{STEADY})?", re.DOTALL)
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level entries: printable bytes for themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary(NamedTuple):
    """What a task needs of a tokenizer: the file's content, and the bytes of each id."""

    kind: str
    content: bytes
    entries: list[bytes]

    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.entries], np.int64)


def read_byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library."""
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        content = f.read()
    letters = byte_letters()
    entries = [b""] * (max((known := Tokenizer.from_str(content.decode()).get_vocab(True)).values(), default=-1) + 1)
    for said, i in known.items():
        entries[i] = bytes(letters[c] for c in said) if all(c in letters for c in said) else said.encode()
    return Vocabulary("byte-level", content, entries)


def read_pieces(path: str) -> Vocabulary:
    """A sentencepiece model that puts a space before each text."""
    import sentencepiece

    with open(path, "rb") as f:
        content = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    said = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Vocabulary("pieces", content, [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(x)) else x.replace("▁", " ").encode() for x in said])


_loaded: dict[bytes, object] = {}


class Tokenizer:
    """Ids of texts that start with a space."""

    def __init__(self, vocabulary: Vocabulary):
        self.kind, self.entries = vocabulary.kind, vocabulary.entries
        if self.kind == "byte-level":
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Fast

            self.model = Fast.from_str(vocabulary.content.decode())
            self.model.encode_special_tokens = True
            self.splits = True
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.content)
            # no piece goes on over a space after other letters, so merges do not cross such a space
            self.splits = not any(b" " in x.lstrip(b" ") for x in vocabulary.entries)

    def __call__(self, spaced: list[str]) -> list[list[int]]:
        if self.kind == "byte-level":
            return [e.ids for e in self.model.encode_batch_fast(spaced, add_special_tokens=False)]
        return self.model.encode([x[1:] for x in spaced], num_threads=1)

    def spells(self, ids: list[int], raw: bytes) -> bool:
        return b"".join(map(self.entries.__getitem__, ids)) == raw


Record = tuple[bytes, bytes, str]  # packed ids of both sides, and the groups


class Aligner:
    """Aligned texts by their pieces: no token of either side crosses a single space between steady letters, so a text
    falls in pieces that are tokenised and aligned by themselves, and repeated ones are remembered."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.one, self.two = Tokenizer(a), Tokenizer(b)
        self.length_a, self.length_b, self.shown = a.lengths(), b.lengths(), decimals(max(len(a.entries), len(b.entries)))
        self.pack_a, self.pack_b = packing(len(a.entries)), packing(len(b.entries))
        self.splits = self.one.splits and self.two.splits
        self.known: dict[str, Record | None] = {}

    @staticmethod
    def of(a: Vocabulary, b: Vocabulary) -> Aligner:
        """The one of this worker process."""
        key = hashlib.sha256(a.content).digest() + hashlib.sha256(b.content).digest()
        if key not in _loaded:
            _loaded[key] = Aligner(a, b)
        return _loaded[key]

    def fresh(self, pieces: list[str], side_by_side: bool = True) -> list[Record | None]:
        """Tokenise and align whole pieces; None where the tokens do not spell space + piece."""
        out: list[Record | None] = [None] * len(pieces)
        lines, size, alone = [], LINE_CHARS, []
        for i, x in enumerate(pieces):
            if not (side_by_side and ENDS_STEADY.fullmatch(x)):
                alone.append([i])
            elif size >= LINE_CHARS:
                lines.append([i])
                size = len(x)
            else:
                lines[-1].append(i)
                size += len(x) + 1
        lines += alone
        spaced = [" " + " ".join([pieces[i] for i in line]) for line in lines]
        of_a, of_b = self.one(spaced), self.two(spaced)
        good = [k for k, x in enumerate(spaced) if self.one.spells(of_a[k], raw := x.encode()) and self.two.spells(of_b[k], raw)]
        place = [i for k in good for i in lines[k]]
        if place:
            ids_a, ids_b = (np.fromiter(chain.from_iterable(of[k] for k in good), np.int64) for of in (of_a, of_b))
            bound = np.cumsum([len(pieces[i].encode()) + 1 for i in place])
            ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
            at_a, at_b = np.searchsorted(ends_a, bound) + 1, np.searchsorted(ends_b, bound) + 1
            if side_by_side and not (np.array_equal(ends_a[at_a - 1], bound) and np.array_equal(ends_b[at_b - 1], bound)):
                return self.fresh(pieces, side_by_side=False)
            n_a, n_b = np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)
            said = group_strings(ids_a, ids_b, n_a, n_b, align(ids_a, ids_b, n_a, self.length_a, self.length_b), self.shown)
            raw_a, raw_b = ids_a.astype(self.pack_a).tobytes(), ids_b.astype(self.pack_b).tobytes()
            step_a, step_b = np.dtype(self.pack_a).itemsize, np.dtype(self.pack_b).itemsize
            cuts = zip(place, said, ((at_a - n_a) * step_a).tolist(), (at_a * step_a).tolist(), ((at_b - n_b) * step_b).tolist(), (at_b * step_b).tolist())
            for i, x, low_a, high_a, low_b, high_b in cuts:
                out[i] = (raw_a[low_a:high_a], raw_b[low_b:high_b], x.decode())
        again = [i for k in sorted(set(range(len(lines))) - set(good)) if len(lines[k]) > 1 for i in lines[k]]
        if again:
            for i, x in zip(again, self.fresh([pieces[i] for i in again], side_by_side=False)):
                out[i] = x
        return out

    def __call__(self, texts: list[str]) -> list[Record | None]:
        if not self.splits:
            return self.fresh(texts)
        if len(self.known) > KNOWN:
            self.known.clear()
        cut = [SAFE.split(x) for x in texts]
        new = list({p for pieces in cut for p in pieces if p not in self.known})
        self.known.update(zip(new, self.fresh(new)))
        find, out = self.known.__getitem__, []
        for text, pieces in zip(texts, cut):
            found = list(map(find, pieces))
            if None in found:  # a piece is not spelled; the text as a whole decides
                out.append(self.fresh([text])[0])
            else:
                ids_a, ids_b, said = zip(*found)
                out.append((b"".join(ids_a), b"".join(ids_b), ";".join(said)))
        for p in new:
            if len(p) > KNOWN_CHARS:
                del self.known[p]
        return out


class Aligned(NamedTuple):
    """Links of all texts of a slice in order, with the text of each; common ends of both sides; ends of the texts."""

    a: np.ndarray
    b: np.ndarray
    text: np.ndarray
    common: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    bound: np.ndarray


def align(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> Aligned:
    """Align the tokens of several texts laid one after the other; both sides hold the same bytes of each text."""
    ends_a, ends_b = np.cumsum(length_a[ids_a]), np.cumsum(length_b[ids_b])
    ends = np.zeros(ends_a[-1] + 1 if len(ends_a) else 1, np.uint8)
    ends[ends_a] = 1
    ends[ends_b] += 2
    cut = np.flatnonzero(ends)
    kind = ends[cut]
    by_a, by_b = kind & 1, kind >> 1
    bound = np.concatenate([[0], ends_a])[np.cumsum(n_a)]
    upto = np.searchsorted(cut, bound, side="right")
    text = np.repeat(np.arange(len(bound)), np.diff(upto, prepend=0))
    at = lambda own: np.cumsum(own, dtype=np.int64) - own
    return Aligned(ids_a[at(by_a)], ids_b[at(by_b)], text, cut[kind == 3], ends_a, ends_b, bound)


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids, left-aligned, and how many each has."""
    said = [str(i).encode() for i in range(size)]
    width = max(map(len, said), default=1)
    return np.frombuffer(b"".join(x.ljust(width) for x in said), np.uint8).reshape(-1, width), np.array([len(x) for x in said])


def group_strings(ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, found: Aligned, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each text: every id is put with the sign after it at its place in one buffer."""
    in_a, in_b = np.searchsorted(found.common, found.ends_a), np.searchsorted(found.common, found.ends_b)
    place = np.concatenate([np.arange(len(ids_a)) + np.searchsorted(in_b, in_a), np.arange(len(ids_b)) + np.searchsorted(in_a, in_b, side="right")])
    ids, sign = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
    ids[place] = np.concatenate([ids_a, ids_b])
    last = lambda x: np.append(x[1:] != x[:-1], True)[: len(x)]
    sign[place] = np.concatenate([np.where(last(in_a), ord("|"), ord(",")), np.where(last(in_b), ord(";"), ord(","))])
    size = digits[1][ids]
    end = np.cumsum(size + 1)
    start = end - size - 1
    out = np.empty(end[-1] if len(end) else 0, np.uint8)
    for k in range(digits[0].shape[1]):
        some = size > k
        out[start[some] + k] = digits[0][ids[some], k]
    out[start + size] = sign
    said = out.tobytes()
    bound = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
    return [said[a : max(a, b - 1)] for a, b in zip(bound[:-1], bound[1:])]


def packing(entries: int) -> type:
    return np.uint16 if entries <= 1 << 16 else np.uint32


def tokenised(texts: DataFrame, a: Vocabulary, b: Vocabulary, groups: bool = False) -> DataFrame:
    """texts(key, copies, text) as (key, copies, n_a, n_b, n_groups, n_links, groups_sha256, ids_a, ids_b[, groups]).

    Texts whose tokens do not spell space + text on both sides are left out.
    """
    shared = texts.sparkSession.sparkContext.broadcast((a, b))
    size_a, size_b = (np.dtype(packing(len(v.entries))).itemsize for v in (a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*shared.value)
        for batch in batches:
            for part in X.slices(batch, "text", SLICE_BYTES):
                found = aligner(part.column("text").to_pylist())
                good = [i for i, x in enumerate(found) if x is not None]
                if not good:
                    continue
                ids_a, ids_b, said = zip(*(found[i] for i in good))
                rows = part.take(pa.array(good))
                n_a, n_b = np.array([len(x) // size_a for x in ids_a]), np.array([len(x) // size_b for x in ids_b])
                n_groups = np.array([x.count("|") for x in said])
                cols = {
                    "key": rows.column("key"), "copies": rows.column("copies"), "n_a": pa.array(n_a), "n_b": pa.array(n_b), "n_groups": pa.array(n_groups),
                    "n_links": pa.array(n_a + n_b - n_groups),  # each end of a token closes one link, a common end closes one for both
                    "groups_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
                    "ids_a": pa.array(ids_a, pa.binary()), "ids_b": pa.array(ids_b, pa.binary()),
                }
                if groups:
                    cols["groups"] = pa.array(said)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    more = ", groups string" if groups else ""
    return texts.mapInArrow(run, f"key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, ids_a binary, ids_b binary{more}")


def slices_of_ids(batches: Iterator[pa.RecordBatch], pack_a: type, pack_b: type, length_a: np.ndarray, length_b: np.ndarray) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Rows of packed ids with their alignment, about 4 MB of ids at a time."""
    for batch in batches:
        for part in X.slices(batch, "ids_a", 2 * SLICE_BYTES):
            ids = [np.frombuffer(X.bytes_of(part.column(c).cast(pa.large_binary()))[0].tobytes(), t).astype(np.int64) for c, t in (("ids_a", pack_a), ("ids_b", pack_b))]
            yield part, align(*ids, part.column("n_a").to_numpy(), length_a, length_b)


def added(pair: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights, or ones, added up over equal pairs."""
    if weight is None:
        pair = np.sort(pair)
    else:
        order = np.argsort(pair)
        pair, weight = pair[order], weight[order]
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    return pair[at], np.diff(at, append=len(pair)) if weight is None else np.add.reduceat(weight, at) if len(at) else weight


def pair_counts(ids: DataFrame, a: Vocabulary, b: Vocabulary) -> DataFrame:
    """(pair, n, best) over the rows of `tokenised`: how many links hold the pair a << 32 | b, each text as often as it has
    copies, and whether no other pair of that b has more."""
    pack_a, pack_b = packing(len(a.entries)), packing(len(b.entries))
    shared = ids.sparkSession.sparkContext.broadcast((a.lengths(), b.lengths()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part, found in slices_of_ids(batches, pack_a, pack_b, *shared.value):
            pair, copies = found.a << 32 | found.b, part.column("copies").to_numpy()
            again = copies[found.text] > 1
            own, more = added(pair[~again]), added(pair[again], copies[found.text[again]])
            pairs, counts = added(np.concatenate([pairs, own[0], more[0]]), np.concatenate([counts, own[1], more[1]]))
            if len(pairs) >= HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    counted = ids.select("copies", "n_a", "ids_a", "ids_b").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = X.written(counted.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def measured(ids: DataFrame, pairs: DataFrame, a: Vocabulary, b: Vocabulary, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(key, n_best, count_sum) per row of `tokenised`.

    The pair counts are broadcast in blocks of at most about `block_pairs`; with one block this is a narrow pass, with more
    each block passes over the ids for itself and the sums of a text are added up.
    """
    spark = ids.sparkSession
    pack_a, pack_b = packing(len(a.entries)), packing(len(b.entries))
    lengths = spark.sparkContext.broadcast((a.lengths(), b.lengths()))
    slim = ids.select("key", "n_a", "ids_a", "ids_b")

    def one_pass(block: object) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = block.value  # ordered by the mixed pairs
            places = X.Lookup(known)
            for part, found in slices_of_ids(batches, pack_a, pack_b, *lengths.value):
                at = places.find(X.mix(found.a << 32 | found.b))
                hit = at >= 0
                start = np.searchsorted(found.text, np.arange(part.num_rows))  # every row has tokens
                sums = [np.add.reduceat(np.where(hit, x[at], 0), start) for x in (best, n)] if len(at) else [np.zeros(0, np.int64)] * 2
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x.astype(np.int64)) for x in sums)], names=["key", "n_best", "count_sum"])

        return slim.mapInArrow(run, "key binary, n_best bigint, count_sum bigint")

    count = max(1, -(-pairs.count() // block_pairs))
    out = None
    for k in range(count):
        own = (pairs.where(F.expr(f"pmod(xxhash64(pair), {count}) = {k}")) if count > 1 else pairs).toArrow()
        mixed = X.mix(own.column("pair").to_numpy())
        order = np.argsort(mixed)
        n, best = (np.append(own.column(c).to_numpy()[order].astype(np.int64), 0) for c in ("n", "best"))
        own = one_pass(spark.sparkContext.broadcast((mixed[order], n, best)))
        out = own if out is None else out.unionByName(own)
    return out if count == 1 else out.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Alignment(NamedTuple):
    """`docs` with the measures, the distinct texts' ids, and the pair counts."""

    docs: DataFrame
    ids: DataFrame
    pairs: DataFrame


def align_tokenizers(docs: DataFrame, a: Vocabulary, b: Vocabulary, text: str = "text", block_pairs: int = BLOCK_PAIRS,
                     groups: bool = False) -> Alignment:
    """Align the tokens of two tokenizers over all texts.

    The documents come without their text, with n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the
    highest count of its b), count_sum (counts over all links) and groups_sha256; `groups` adds the groups themselves to
    the table of ids, whose rows are distinct texts by the SHA-256 of their bytes (`key`).

    Null and empty texts, and texts whose tokens do not spell space + text on both sides, have zeros and an empty
    groups_sha256. Equal counts are all highest. Repeated rows count as often as they are there. Columns of docs with the
    names of results are replaced, all others but the text stay.
    """
    names = [c for c in docs.columns if c not in (text, *MEASURES, "groups_sha256")]
    key = X.free_name("key", [*docs.columns, *MEASURES, "groups_sha256"])
    digest = F.unhex(F.sha2(F.col(text), 256))
    texts = docs.where(F.octet_length(F.col(text)) > 0).groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    ids = X.written(tokenised(texts, a, b, groups), "token-ids", compression="zstd")
    pairs = X.written(pair_counts(ids, a, b), "pair-counts")
    sums = measured(ids, pairs, a, b, block_pairs)
    own = ids.select("key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "key").withColumnRenamed("key", key)
    joined = docs.select(*names, digest.alias(key)).join(own, key, "left")
    zeros = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in MEASURES]
    return Alignment(joined.select(*names, *zeros, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), ids, pairs)
