"""N-gram Jaccard self-join by a grouped prefix join, returned as connected components.

Documents with equal shingle sets are one class. A class of n shingles has a prefix of n - ceil(0.8 n) + 1 shingles, first
those rare in the corpus; two classes above the threshold share a prefix shingle. Classes with equal prefix and size are
one group, and group pairs that share a prefix shingle early enough in both are candidates, expanded to classes and verified
on their whole sets. Classes enter only if a somewhat longer prefix shows more shared shingles (see `asked`): most classes
share a few by chance, and their sets need not be moved.

Only connectivity is asked for, so candidates come in rounds. In the first few each group meets a few others that share
prefix shingles, and each class the leader of its own group: a few pairs per class. Verified links give provisional
components. At the end all pairs of classes that are still in different components are formed and verified, so a group of
thousands of near copies is joined by thousands of pairs, not millions, and no link that could connect two components is
left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as X

N = 5
LOW, HIGH = 4, 5  # similarity 0.8 as a fraction
TURNS, PARTNERS = 2, 3  # cheap rounds before all pairs of different components are formed, and pairs per class in each
BEFORE = 2  # preceding shingles an entry carries, so that a pair which met on one of them does not meet again
ASKED_IDS = 1 << 20  # classes that are broadcast to pick the sets of some pairs
NO_ID = 1 << 62  # classes without any id are numbered from here


def shingle_sets(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle codes of all texts, ascending per text, and where each text's begin."""
    w = X.words(column, X.SPACED_LOWER)
    count = w.count()
    size = np.where(count >= N, count - N + 1, np.minimum(count, 1))
    bound = np.concatenate([[0], np.cumsum(size)])
    codes = np.empty(bound[-1], np.uint64)
    at = X.valid_starts(w, N)
    if len(at):
        codes[bound[w.text_of()[at]] + at - w.first[w.text_of()[at]]] = X.sequences(w.code, N)[at]
    for k in range(1, N):
        short = np.flatnonzero(count == k)
        if len(short):
            codes[bound[short]] = X.sequences(w.code, k)[w.first[short]]
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
        codes[a:b].sort()
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    new[bound[:-1][size > 0]] = True
    return codes[new], np.concatenate([[0], np.cumsum(new)])[bound]


def names(codes: np.ndarray, bound: np.ndarray) -> list[bytes]:
    """128-bit name of each set, from sums over its members."""
    out = np.zeros((len(bound) - 1, 2), np.uint64)
    for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(X.mix(codes ^ np.uint64(salt)))])
        out[:, k] = sums[bound[1:]] - sums[bound[:-1]]
    out[:, 1] += np.diff(bound).astype(np.uint64)
    return [x.tobytes() for x in out]


def first_of(items: list[bytes]) -> np.ndarray:
    """Index of the first of each distinct item."""
    seen: dict[bytes, int] = {}
    for i, x in enumerate(items):
        seen.setdefault(x, i)
    return np.fromiter(seen.values(), np.int64, len(seen))


def spread(bound: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Positions of the members of some sets."""
    size = bound[rows + 1] - bound[rows]
    return np.repeat(bound[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(rows) else np.zeros(0, np.int64)


def overlap(n: int) -> int:
    """Least overlap of n shingles with any set that is similar enough."""
    return -(-LOW * n // HIGH)


def asked(n: int) -> int:
    """How many shared shingles a long prefix of n shingles has to show: similar sets share so many in both prefixes.

    The first k shared shingles stand among the first n - overlap(n) + k of a set, and the partner may be as small as the
    overlap.
    """
    return 1 + n // 10


class Sets:
    """Distinct non-empty sets of some texts."""

    def __init__(self, column: pa.ChunkedArray):
        self.codes, self.bound = shingle_sets(column)
        self.name = names(self.codes, self.bound)
        self.rows = [i for i in first_of(self.name).tolist() if self.bound[i + 1] > self.bound[i]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct codes, and in how many of the sets each is."""
        return np.unique(self.codes[spread(self.bound, np.array(self.rows, np.int64))], return_counts=True)


def survey(docs: DataFrame) -> DataFrame:
    """(id, n, name) per row of docs(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, "text"):
                codes, bound = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bound)), pa.array(names(codes, bound), pa.binary())], names=["id", "n", "name"])

    return docs.mapInArrow(run, "id bigint, n bigint, name binary")


def frequencies(parts: X.Chunks) -> DataFrame:
    """(chunk, bucket, codes, counts): the shingles of a chunk that other chunks have too, and in how many chunks they are.

    A chunk sends each shingle once, in 32 bits beside its bucket. Two shingles that fall together only look more frequent,
    alike for everyone; the order of prefixes stays one order.
    """
    buckets = parts.buckets

    def send(table: pa.Table) -> pa.Table:
        code, _ = Sets(table.column("text")).distinct()
        out = X.packed(table.column("__chunk")[0].as_py(), code, buckets)
        keys, n = X.unpacked(out, "keys", np.uint64)
        ends = np.cumsum(n)
        short = [np.unique(keys[b - k : b].astype(np.uint32)).tobytes() for b, k in zip(ends, n)]
        return out.set_column(2, "keys", pa.array(short, pa.binary()))

    def meet(table: pa.Table) -> pa.Table:
        keys, n = X.unpacked(table, "keys", np.uint32)
        row = np.repeat(np.arange(table.num_rows), n)
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(keys)))
        count = np.empty(len(keys), np.uint32)
        count[order] = np.repeat(size, size)
        found = count > 1
        keys, count, row = keys[found], count[found], row[found]
        cut = np.searchsorted(row, np.arange(table.num_rows + 1))
        return pa.table({
            "chunk": table.column("chunk"), "bucket": table.column("bucket"),
            "codes": pa.array([keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            "counts": pa.array([count[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})

    sent = parts.rows.groupBy("__chunk").applyInArrow(send, X.PACKED)
    return sent.groupBy("bucket").applyInArrow(meet, "chunk int, bucket int, codes binary, counts binary")


def candidates(parts: X.Chunks) -> DataFrame:
    """(name, n, met, usual, grp, codes, members): classes with prefix shingles that other classes have too, in the prefix's order.

    `met` counts the shingles of the whole set that another class has: no overlap is larger, so a class with fewer than any
    similar set needs is left out. `usual` is the mean log frequency of the set's shingles: of a group of near copies the one
    with the fewest edits has the highest.
    """
    buckets = parts.buckets

    def pick(table: pa.Table, reply: pa.Table) -> pa.Table:
        s = Sets(table.column("text"))
        code, here = s.distinct()
        short, n = X.unpacked(reply, "codes", np.uint32)
        count, _ = X.unpacked(reply, "counts", np.uint32)
        spot = np.repeat(reply.column("bucket").to_numpy().astype(np.uint64), n) << np.uint64(32) | short.astype(np.uint64)
        order = np.argsort(spot)
        spot, count = spot[order], count[order]
        own = (code >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | code & np.uint64(0xFFFFFFFF)
        known = X.member(own, spot)
        weight = np.ones(len(code), np.int64)
        weight[known] = count[np.searchsorted(spot, own[known])]
        met = known | (here > 1)
        rows = []
        for i in s.rows:
            a, b = s.bound[i], s.bound[i + 1]
            at, n = np.searchsorted(code, s.codes[a:b]), int(b - a)
            order = np.argsort(weight[at], kind="stable")[: n - overlap(n) + asked(n)]
            prefix, also = s.codes[a:b][order], met[at[order]]
            seen, prefix = int(also.sum()), prefix[: n - overlap(n) + 1]
            shared, common = prefix[also[: len(prefix)]], int(met[at].sum())
            if len(shared) and seen >= asked(overlap(n)) and common >= overlap(n):
                group = names(np.append(prefix, np.uint64(n)), np.array([0, len(prefix) + 1]))[0]
                rows.append((s.name[i], n, common, float(np.log(weight[at]).mean()), group, shared.view(np.int64), s.codes[a:b].tobytes()))
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.table({"name": pa.array(cols[0], pa.binary()), "n": pa.array(cols[1], pa.int64()), "met": pa.array(cols[2], pa.int64()),
                         "usual": pa.array(cols[3], pa.float64()), "grp": pa.array(cols[4], pa.binary()),
                         "codes": pa.array(cols[5], pa.list_(pa.int64())), "members": pa.array(cols[6], pa.binary())})

    return parts.rows.groupBy("__chunk").cogroup(frequencies(parts).groupBy("chunk")).applyInArrow(
        pick, "name binary, n bigint, met bigint, usual double, grp binary, codes array<bigint>, members binary")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose sets reach the threshold.

    The pairs are written, so that while they are of at most ASKED_IDS classes only the sets of these are shuffled.
    """
    pairs = X.written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    if ids.count() <= ASKED_IDS:
        sets = sets.join(F.broadcast(ids), "class", "left_semi")
    own = lambda side: sets.select(F.col("class").alias(side), F.col("members").alias(f"of_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int(X.member(p, q).sum())
                keep.append(HIGH * both >= LOW * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links reaches.

    Alternates large and small stars: a node's larger neighbours, then its smaller ones, are tied to its smallest. The
    links shrink to one star per component in logarithmically many rounds; each round is a written table.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = X.written(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = X.written(small.distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fits(x: str, y: str) -> Column:
    """Sizes within the threshold of each other."""
    return F.least(x, y) * HIGH >= F.greatest(x, y) * LOW


def both(x: str, y: str) -> Column:
    """Least overlap of two similar sets of these sizes."""
    return F.ceil((F.col(x) + F.col(y)) * LOW / (LOW + HIGH))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(entries: DataFrame, tied: DataFrame, turn: int) -> DataFrame:
    """(a, b): for each leading class up to PARTNERS classes of other components that stand for one of its shingles.

    Per shingle and size band one class stands for all: in the first turn the most usual one, as most near copies link with
    the least edited of them, then another one each turn. The partners that stand for most of a class's shingles are taken.
    """
    own = entries.join(tied.withColumnRenamed("node", "lead"), "lead").select("code", "band", "lead", "n", "usual", "root")
    rank = F.xxhash64("lead", F.lit(turn)) if turn else F.struct(-F.col("usual"), F.col("lead"))
    head = F.min_by(F.struct("lead", "n", "root"), rank)
    heads = own.groupBy("code", "band").agg(head.alias("head"))
    near = heads.select("code", F.explode(F.array([F.col("band") + k for k in range(-2, 3)])).alias("band"), "head")
    met = own.join(near, ["code", "band"]).where(fits("n", "head.n") & (F.col("root") != F.col("head.root")))
    votes = met.groupBy(F.col("lead").alias("a"), F.col("head.lead").alias("b")).count()
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "b"))), 1, PARTNERS)
    return votes.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row of `docs`: the smallest id that its links reach, itself included.

    A set holds the distinct runs of five words (bytes other than white space, A-Z lower-cased), or all words of a shorter
    text as one. Rows link when 100 * intersection >= 80 * union. Null, empty and blank texts have no set and no link.
    Rows with an equal id count as one document; a row without id links like any other, and its component_id is null if
    its component holds no id. Repeated rows get equal results; other columns are not carried. Ids are whole numbers.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    rows = X.written(survey(docs), "survey")
    first = F.coalesce(F.min("id"), F.lit(NO_ID) + F.pmod(F.xxhash64("name"), F.lit(1 << 60)))
    classes = rows.where("n > 0").groupBy("name").agg(first.alias("class"))
    found = candidates(X.chunks(docs, "id", "text")).dropDuplicates(["name"])
    sets = X.written(found.join(classes, "name").drop("name"), "sets")
    slim = sets.select("class", "n", "grp")

    leader = sets.groupBy("grp", "n").agg(F.min("class").alias("lead"), F.min_by("usual", "class").alias("usual"))
    band = F.floor(F.ln("n") / (log(HIGH / LOW) / 2)).cast("int")
    entries = X.written(
        sets.select("grp", "n", F.explode("codes").alias("code")).distinct()
        .join(leader, ["grp", "n"]).withColumn("band", band), "entries")
    inside = slim.join(leader, ["grp", "n"]).select(F.col("class").alias("a"), F.col("lead").alias("b"))
    tied = slim.select(F.col("class").alias("node"), F.col("class").alias("root")).distinct()
    for turn in range(TURNS):
        links = verify(ordered(stars(entries, tied, turn).unionByName(inside) if turn == 0 else stars(entries, tied, turn)), sets)
        known = tied.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        merged = components(known.unionByName(links))
        tied = X.written(slim.select(F.col("class").alias("node")).distinct().join(merged, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "tied")
    placed = X.written(slim.join(tied, slim["class"] == tied["node"]).select("class", "n", "grp", "root"), "placed")
    groups = placed.groupBy("grp", "n").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    prefix = X.written(sets.groupBy("grp", "n").agg(F.first("codes").alias("codes"), F.max("met").alias("met")), "prefix")  # a group's codes are equal in all its classes
    before = F.transform("codes", lambda _, i: F.slice("codes", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE))))
    left_over = F.transform("codes", lambda _, i: F.col("met") - i)  # from a shingle on, it included
    spots = prefix.select("grp", "n", F.inline(F.arrays_zip(F.col("codes").alias("code"), left_over.alias("room"), before.alias("before")))).join(groups, ["grp", "n"])
    mixed = spots.groupBy("code").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("code")
    left = spots.join(mixed, "code")
    x, y = (left.select("code", *[F.col(c).alias(f"{s}_{c}") for c in ("room", "before", "grp", "n", "low", "high")]) for s in "xy")
    # from the first shingle that two similar sets share, both still have as many that other classes have as they must share
    room = F.least("x_room", "y_room") >= both("x_n", "y_n")
    apart = ~((F.col("x_low") == F.col("y_high")) & (F.col("x_high") == F.col("y_low")))
    # a pair that shares a shingle just before this one has met there: both places are earlier and leave more room
    again = F.arrays_overlap("x_before", "y_before")
    met = x.join(y, "code").where((F.col("x_grp") <= F.col("y_grp")) & room & apart & ~again).select("x_grp", "x_n", "y_grp", "y_n").distinct()
    # a pair cannot overlap in more than the shingles its prefixes share and what the prefix that ends first leaves of its set
    rest_of = lambda s: F.col(f"{s}_met") - F.size(f"{s}_codes")
    needed = both("x_n", "y_n") - F.greatest(rest_of("x"), rest_of("y"))
    of = lambda s: prefix.select(*[F.col(c).alias(f"{s}_{c}") for c in ("grp", "n", "met", "codes")])
    met = met.join(of("x"), ["x_grp", "x_n"]).join(of("y"), ["y_grp", "y_n"]).where(F.size(F.array_intersect("x_codes", "y_codes")) >= needed).select("x_grp", "x_n", "y_grp", "y_n")
    member = lambda s: placed.select(*[F.col(c).alias(f"{s}_{c}") for c in ("grp", "n", "class", "root")])
    rest = met.join(member("x"), ["x_grp", "x_n"]).join(member("y"), ["y_grp", "y_n"]).where("x_root <> y_root")
    more = verify(ordered(rest.select(F.col("x_class").alias("a"), F.col("y_class").alias("b"))), sets)
    known = tied.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(known.unionByName(more))
    named = classes.join(roots, classes["class"] == roots["node"], "left").select("name", F.coalesce("root", "class").alias("root"))
    whole = rows.join(named, "name", "left")
    return whole.select("id", F.col("n").alias("n_shingles"), F.when(F.col("root") < NO_ID, F.col("root")).when(F.col("root").isNull(), F.col("id")).alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row per component: that of the smallest id. Rows without id or without words stay.

    Of several rows with one id, those whose id leads its component stay.
    """
    lead = jaccard_components(docs, id_col, text).where("component_id is not null").groupBy(F.col("id").alias("__id")).agg(F.min("component_id").alias("__to"))
    gone = lead.where("__id <> __to").select("__id")
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
