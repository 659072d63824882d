"""Counts of words and of byte n-grams inside words, gathered per task before they are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as X

EDGE = 0x20  # stands for both ends of a word
HELD_BYTES = 16 << 20


class Types:
    """Distinct (group, word) with counts, gathered from slices, to be handed over once they fill `held` bytes."""

    def __init__(self, held: int = HELD_BYTES) -> None:
        self.held = held
        self.reset()

    def reset(self) -> None:
        self.group, self.code, self.count, self.spelled, self.size = [], [], [], [], 0

    def add(self, w: X.Words, group: np.ndarray) -> None:
        """Words of texts with a small non-negative group number per text; negative groups are left out."""
        own = group[w.text_of()]
        picked = np.flatnonzero(own >= 0)
        key = w.code[picked] ^ X.mix(own[picked].astype(np.uint64))
        code, at, n = np.unique(key, return_index=True, return_counts=True)
        at = picked[at]
        self.group.append(own[at])
        self.code.append(code)
        self.count.append(n)
        data = w.data.tobytes()
        self.spelled.extend(data[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist()))
        self.size = sum(map(len, self.code)) * 64

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Group, word code, count and spelling of each type so far."""
        if not self.code:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        group, code, count = np.concatenate(self.group), np.concatenate(self.code), np.concatenate(self.count)
        _, at, back = np.unique(code, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=count, minlength=len(at)).astype(np.int64)
        return group[at], code[at] ^ X.mix(group[at].astype(np.uint64)), total, [self.spelled[i] for i in at.tolist()]

    @property
    def full(self) -> bool:
        return self.size >= self.held


class Grams:
    """All byte n-grams of spelled words with their ends marked, as positions in one flat array."""

    def __init__(self, spelled: list[bytes]):
        flat = b"".join(b"%c%b%c" % (EDGE, s, EDGE) for s in spelled)
        self.data = np.frombuffer(flat, np.uint8)
        size = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 2
        place = np.int32 if len(flat) < 1 << 30 else np.int64
        self.word = np.repeat(np.arange(len(spelled), dtype=place), size)
        self.first = np.repeat((np.cumsum(size) - size).astype(place), size)
        self.value = X.mix((self.data.astype(np.uint64) + np.uint64(1)) * np.uint64(X.BASE))

    def codes(self, n: int) -> np.ndarray:
        """Code of the n bytes from each position on."""
        return X.sequences(self.value, n, salt=n)

    def starts(self, n: int) -> np.ndarray:
        """Positions of n bytes that lie in one word."""
        size = max(0, len(self.data) - n + 1)
        return np.flatnonzero(self.word[:size] == self.word[n - 1 :][:size]).astype(self.first.dtype)


def summed(keys: dict[str, np.ndarray], **counts: np.ndarray) -> pd.DataFrame:
    """Named counts added up over equal keys; all columns are determined by the first two."""
    names = list(keys)
    order = np.lexsort((keys[names[0]], keys[names[1]]))
    a, b = keys[names[0]][order], keys[names[1]][order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    out = {n: keys[n][order][at] for n in names}
    return pd.DataFrame(out | {n: np.add.reduceat(c[order], at) if len(at) else np.zeros(0, np.int64) for n, c in counts.items()})


def fair_shares(sizes: list[int], budget: int) -> list[int]:
    """Entries each group may keep: all of the small ones, equal shares of what is left for the others."""
    share, left = [0] * len(sizes), budget
    for done, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        share[i] = min(sizes[i], left // (len(sizes) - done))
        left -= share[i]
    return share


def most_per_group(counted: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Rows (keys, code, n) of the highest counts, at most `budget` in all and in fair shares per group; all, if they fit.

    Of equal counts at a group's cut those of the least codes stay, up to one of 4096 ranges of codes; nothing else decides,
    so a large group takes nothing away from a small one. The driver sees the groups' distinct counts.
    """
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("rows")).toPandas()
    if sizes["rows"].sum() <= budget:
        return counted
    sizes["share"] = fair_shares(sizes["rows"].tolist(), budget)
    over = {tuple(r[k] for k in keys): r["share"] for r in sizes.to_dict("records") if r["share"] < r["rows"]}
    steps = counted.groupBy(*keys, "n").agg(F.count("*").alias("rows")).toPandas().sort_values("n", ascending=False)
    cuts = []
    for key, own in steps.groupby(keys):
        if key in over:
            upto = own["rows"].cumsum()
            at = int((upto <= over[key]).sum())  # steps that fit whole; the next one is cut by code
            cuts.append((*(k.item() if hasattr(k, "item") else k for k in key), int(own["n"].iloc[at]), over[key] - int(upto.iloc[at - 1] if at else 0)))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (counted.schema[k] for k in keys))
    spark = counted.sparkSession
    edges = spark.createDataFrame(cuts, f"{types}, __last bigint, __left bigint")
    head = F.shiftright("code", 52)
    ties = counted.join(F.broadcast(edges), keys).where(F.col("n") == F.col("__last")).groupBy(*keys, head.alias("head")).count().toPandas().sort_values("head")
    limits = []
    for *key, last, left in cuts:
        own = ties[(ties[keys] == key).all(axis=1)]
        fits = own["head"][own["count"].cumsum() <= left]
        limits.append((*key, last, int(fits.iloc[-1]) if len(fits) else -(1 << 12)))
    limits = spark.createDataFrame(limits, f"{types}, __last bigint, __head bigint")
    kept = counted.join(F.broadcast(limits), keys, "left")
    return kept.where("__last is null or n > __last or n = __last and shiftright(code, 52) <= __head").select(*counted.columns)


def most_frequent(counted: DataFrame, most: int) -> pd.DataFrame:
    """The `most` rows (code, n) of the highest counts in order; of equal counts those of the least codes.

    The driver sees the distinct counts (they grow with the root of all words), 65,536 ranges of codes, and what is kept.
    """
    sizes = counted.groupBy("n").agg(F.count("*").alias("rows")).toPandas().sort_values("n", ascending=False)
    upto = sizes["rows"].cumsum()
    if len(sizes) and upto.iloc[-1] > most:
        last = int(sizes["n"][upto >= most].iloc[0])
        head = F.shiftright("code", 48)
        heads = counted.where(F.col("n") == last).groupBy(head.alias("head")).agg(F.count("*").alias("rows")).toPandas().sort_values("head")
        left = most - int(sizes["rows"][sizes["n"] > last].sum())
        counted = counted.where((F.col("n") > last) | (F.col("n") == last) & (head <= int(heads["head"][heads["rows"].cumsum() >= left].iloc[0])))
    return counted.toPandas().sort_values(["n", "code"], ascending=[False, True]).head(most)


def lowered(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(pc.fill_null(column, ""))
