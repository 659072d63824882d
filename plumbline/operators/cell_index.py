"""Approximate neighbours from an inverted-cell index that is kept as a table.

The space is cut in coarse cells around centres; a reference row is stored in its cell as a short code of what is left after
the centre is taken away (its residual, cut in parts, each part by the number of its nearest codeword). A query looks into
the cells whose centres are nearest to it, ranks their rows by the codes alone, and measures the best ones exactly.

Centres and codewords are fitted on a bounded sample, every row is indexed. How many cells a query has to look into is not
guessed: `probes_for` takes exact neighbours of some queries and gives the least number of probes that finds the wanted
share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.functions.arrow import matrix
from plumbline.operators.pivot_join import gaps, nearest_point, slices, written

SAMPLE_BYTES = 32 << 20  # of vectors that centres and codewords are fitted on
SAMPLE_PER_CELL = 256
MOST_CELLS = 4096
CODEWORDS = 256
ROUNDS = 8  # of moving centres to the means of their rows
BLOCK_CODES = 1 << 20  # rows of the index in one task
QUERY_ROWS = 4096  # queries that meet a block in one task
CELL_ROWS = 1024  # rows of a cell that some queries are held against at a time
RERANK = 20  # rows measured exactly, times k


class Codes(NamedTuple):
    """Coarse centres (cells x D), codewords (parts x CODEWORDS x width) and the bounds of the parts."""

    centres: np.ndarray
    words: list[np.ndarray]
    cuts: list[int]

    def cell_order(self, x: np.ndarray) -> np.ndarray:
        """Cells of each row, the nearest centre first; equal ones by number."""
        return np.argsort(gaps(x, self.centres), axis=1, kind="stable")

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centres[cell]
        return np.stack([nearest_point(rest[:, a:b], w) for w, a, b in zip(self.words, self.cuts, self.cuts[1:])], 1).astype(np.uint8)

    def tables(self, x: np.ndarray, cell: int) -> list[np.ndarray]:
        """Per part the squared distances of the queries' residuals to all codewords."""
        rest = x - self.centres[cell]
        return [gaps(rest[:, a:b], w) ** 2 for w, a, b in zip(self.words, self.cuts, self.cuts[1:])]


def moved_centres(x: np.ndarray, wanted: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres that start on the first different rows and move to the means of the rows nearest to them."""
    _, first = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(first)[:wanted]].copy()
    for _ in range(rounds):
        own = nearest_point(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


class Index(NamedTuple):
    """The codes and the table (cell, id, code); `refs` are the vectors that the best candidates are measured on."""

    codes: Codes
    table: DataFrame
    refs: DataFrame
    cells: DataFrame


def sampled(ref: DataFrame, rows: int, of: int, seed: int) -> np.ndarray:
    """The `rows` first of `of` rows by hash. A bound on the hash goes before the order, so that a task sends few more than are wanted."""
    keyed = ref.select("v", V.draw_key(seed, 0, "id").alias("d"))
    share = 1.2 * rows / max(of, 1) + 0.001
    few = keyed.where(F.col("d") < f"{int(share * (1 << 32)):08x}") if share < 1.0 else keyed
    drawn = few.orderBy("d").limit(rows).select("v").toArrow()
    if drawn.num_rows < min(rows, of):
        drawn = keyed.orderBy("d").limit(rows).select("v").toArrow()
    return matrix(drawn.column("v"))


def build_index(ref: DataFrame, cells: int | None = None, parts: int | None = None, ref_id: str = "sample_id", features: str = "features", seed: int = 11) -> Index:
    """Index all rows. Default: as many cells as the root of the rows (4096 at most), a part per four dimensions.

    Fitted on at most 256 rows per cell and 32 MB of vectors, drawn by hash. An empty reference gives an empty index.
    """
    ref = ref.select(F.col(ref_id).alias("id"), F.col(features).alias("v"))
    rows, width = ref.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    cells = max(1, min(cells or int(np.ceil(np.sqrt(max(rows, 1)))), MOST_CELLS))
    most = max(cells, min(cells * SAMPLE_PER_CELL, SAMPLE_BYTES // (8 * width)))
    if not rows:
        none = ref.sparkSession.createDataFrame([], T.StructType([T.StructField("cell", T.IntegerType()), ref.schema["id"], T.StructField("code", T.BinaryType())]))
        return Index(Codes(np.zeros((0, 0)), [], [0]), none, ref, none.select("cell", F.lit(0).alias("blocks")))
    x = sampled(ref, most, rows, seed)
    centres = moved_centres(x, cells)
    cuts = np.linspace(0, width, (parts or -(-width // 4)) + 1).astype(int).tolist()
    rest = x - centres[nearest_point(x, centres)]
    codes = Codes(centres, [moved_centres(rest[:, a:b], CODEWORDS) for a, b in zip(cuts, cuts[1:])], cuts)
    shared = ref.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                cell = nearest_point(x, shared.value.centres)
                said = shared.value.encode(x, cell)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), pa.array([r.tobytes() for r in said], pa.binary())], names=["cell", "id", "code"])

    kind = T.StructType([T.StructField("cell", T.IntegerType()), ref.schema["id"], T.StructField("code", T.BinaryType())])
    table = written(ref.mapInArrow(run, kind), "index")
    sizes = written(table.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_CODES).cast("int").alias("blocks")), "index-cells")
    return Index(codes, table, ref, sizes)


def asked_cells(query: DataFrame, codes: object, probes: int) -> DataFrame:
    """query(id, v) with the array `cells` of the `probes` nearest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for cut in slices(whole.num_rows, len(codes.value.centres)) if len(codes.value.centres) else ():
                batch = whole.slice(cut.start, cut.stop - cut.start)
                order = codes.value.cell_order(matrix(batch.column("v")))[:, :probes].astype(np.int32)
                ends = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(order.ravel()))], names=[*batch.schema.names, "cells"])

    return query.mapInArrow(run, T.StructType([*query.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))]))


def add_best(rough: np.ndarray, place: np.ndarray, who: np.ndarray, total: np.ndarray, rows: np.ndarray) -> None:
    """Put code distances `total` of the queries `who` to `rows` among the best ones so far, in place."""
    keep = rough.shape[1]
    values = np.concatenate([rough[who], total], axis=1)
    which = np.concatenate([place[who], np.broadcast_to(rows, total.shape)], axis=1)
    first = np.argpartition(values, keep - 1, axis=1)[:, :keep]
    rough[who], place[who] = np.take_along_axis(values, first, 1), np.take_along_axis(which, first, 1)


def best_codes(codes: Codes, x: np.ndarray, asked: np.ndarray, cell: np.ndarray, code: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row, code distance) of the `keep` best of the rows (cell, code) that lie in the asked cells of each query."""
    order = np.argsort(cell, kind="stable")
    cell, code = cell[order], code[order]
    held, starts = np.unique(cell, return_index=True)
    rows_of = dict(zip(held.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])))
    rough, place = np.full((len(x), keep), np.inf), np.zeros((len(x), keep), np.int64)
    who, wanted = np.repeat(np.arange(len(x)), asked.shape[1]), asked.ravel()
    by_cell = np.argsort(wanted, kind="stable")
    cells, first = np.unique(wanted[by_cell], return_index=True)
    for c, own in zip(cells.tolist(), np.split(who[by_cell], first[1:])):
        if c not in rows_of:
            continue
        start, end = rows_of[c]
        for part in slices(len(own), CODEWORDS * len(codes.words)):
            some = own[part]
            tables = codes.tables(x[some], c)
            for at in range(start, end, CELL_ROWS):
                rows = np.arange(at, min(at + CELL_ROWS, end))
                total = np.zeros((len(some), len(rows)))
                for m, table in enumerate(tables):
                    total += table[:, code[rows, m]]
                add_best(rough, place, some, total, rows)
    i, j = np.nonzero(np.isfinite(rough))
    return i, order[place[i, j]], rough[i, j]


def search(index: Index, query: DataFrame, k: int, probes: int, rerank: int = RERANK, query_id: str = "sample_id", features: str = "features") -> DataFrame:
    """(query_id, ref_id, distance, rank): about the k nearest rows of each query, with exact Euclidean distances.

    Each query looks into `probes` cells; the `rerank * k` rows with the best codes are measured. Equal distances go to the
    smaller id. Queries with equal ids count as one.

    Codes are far smaller than vectors and candidates: a task gets some queries, which travel once per block of codes, and a
    block, and only the best of all asked cells in it leave the task, so nothing is sent per probe.
    """
    spark = query.sparkSession
    shared = spark.sparkContext.broadcast(index.codes)
    keep = rerank * k
    q = written(query.select(F.col(query_id).alias("id"), F.col(features).alias("v")).dropDuplicates(["id"]), "asked")
    blocks, salts = (max(1, -(-df.count() // n)) for df, n in ((index.table, BLOCK_CODES), (q, QUERY_ROWS)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = index.table.withColumn("block", part(blocks)).withColumn("salt", each(salts))
    sent = q.withColumn("salt", part(salts)).withColumn("block", each(blocks))

    def best(asking: pa.Table, held: pa.Table) -> pa.Table:
        if asking.num_rows and held.num_rows:
            code = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            x = matrix(asking.column("v"))
            asked = np.concatenate([shared.value.cell_order(x[cut])[:, :probes] for cut in slices(len(x), len(shared.value.centres))])
            i, j, rough = best_codes(shared.value, x, asked, held.column("cell").to_numpy(), code, keep)
        else:
            i, j, rough = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return pa.table([asking.column("id").take(pa.array(i)), held.column("id").take(pa.array(j)), pa.array(rough)], names=["query_id", "ref_id", "rough"])

    kind = T.StructType([T.StructField("query_id", q.schema["id"].dataType), T.StructField("ref_id", index.refs.schema["id"].dataType), T.StructField("rough", T.DoubleType())])
    key = ["block", "salt"]
    found = sent.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(best, kind)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "ref_id"))
    near = found.withColumn("i", first).where(F.col("i") <= keep).select("query_id", "ref_id")
    near = near.join(index.refs.select(F.col("id").alias("ref_id"), F.col("v").alias("rv")), "ref_id").join(q.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref_id"))
    return near.select("query_id", "ref_id", V.l2_distance("qv", "rv").alias("distance")).withColumn("rank", place).where(F.col("rank") <= k)


def probes_for(index: Index, query: DataFrame, exact: DataFrame, share: float, query_id: str = "sample_id", features: str = "features") -> int:
    """The least number of probes whose cells hold `share` of the exact neighbours (query_id, ref_id) of the queries.

    The driver gets one count per probe.
    """
    shared = query.sparkSession.sparkContext.broadcast(index.codes)
    order = asked_cells(query.select(F.col(query_id).alias("id"), F.col(features).alias("v")), shared, len(index.codes.centres))
    place = order.select(F.col("id").alias("query_id"), F.posexplode("cells").alias("place", "cell"))
    held = exact.join(index.table.select(F.col("id").alias("ref_id"), "cell"), "ref_id").join(place, ["query_id", "cell"])
    counts = {r["place"]: r["count"] for r in held.groupBy("place").count().collect()}
    total, seen = sum(counts.values()), 0
    for p in sorted(counts):
        seen += counts[p]
        if seen >= share * total:
            return p + 1
    return len(index.codes.centres)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, neighbours, recall): the share of the exact neighbours (query_id, ref_id) that were found."""
    hit = exact.select("query_id", "ref_id").join(found.select("query_id", "ref_id", F.lit(1).alias("hit")), ["query_id", "ref_id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))
