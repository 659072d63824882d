"""Exact neighbours inside groups: a two-level pivot tree per large group and a bound of its own for every query.

A group of more than one block of reference rows gets a tree: random rows as leaf pivots, about one per block, under a root
of them as top pivots. Every row finds its leaf through the top level. Then

1. a query meets one block of its own leaf; the k-th distance there bounds how far its neighbours can be;
2. it is sent on to the leaves alone whose pivot distance less their radius is within that bound (triangle inequality),
   top cells that are out of reach being passed over with all their leaves.

Both inputs are evaluated once: they are written with their leaves, the queries again with their bounds. Leaves are cut in
blocks of bounded size however many rows they hold, queries of a block in salts of bounded size, and of equal reference
vectors only as many as can be among the neighbours are kept, so equal rows do not multiply.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.functions.arrow import matrix, with_columns
from plumbline.session import BLOCK_ROWS, MAX_PIVOTS, PIVOT_BYTES, cut_lineage, limit, work_folder

REGION_BLOCKS = 16  # blocks' worth of neighbouring leaves that a query is sent to at once, as long as their vectors take
REGION_BYTES = 16 << 20  # at most so many bytes
SALT_BLOCKS = 8  # blocks' worth of queries that meet one reference block in a task, REGION_BLOCKS if they take REGION_BYTES at most
SLICE_CELLS = 1 << 20  # entries of a matrix of distances in a task
SALTS = 32  # tasks that the queries of all regions are dealt to at least, if they are so many blocks
NO_TREE = -1  # leaf of a group that is one cell


def gaps(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows to points, up to rounding."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2.0 * x @ points.T + (points**2).sum(1)[None, :], 0.0))


def slices(rows: int, width: int) -> Iterator[slice]:
    """Slices of `rows` rows of which a matrix with `width` columns has at most SLICE_CELLS entries."""
    step = max(1, SLICE_CELLS // max(width, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def nearest_point(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Number of the nearest point of each row."""
    return np.concatenate([np.zeros(0, np.int64), *(gaps(x[cut], points).argmin(axis=1) for cut in slices(len(x), len(points)))])


@dataclass
class Tree:
    """Leaf pivots under top pivots; rows, radius per leaf and radius per top cell are known after the reference is placed."""

    points: np.ndarray
    tops: np.ndarray = field(init=False)
    kids: list[np.ndarray] = field(init=False)
    rows: np.ndarray = field(init=False)
    radius: np.ndarray = field(init=False)
    top_radius: np.ndarray = field(init=False)
    region: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        _, first = np.unique(self.points, axis=0, return_index=True)
        self.points = self.points[np.sort(first)]
        top = self.points[: max(1, int(np.ceil(np.sqrt(len(self.points)))))]
        owner = nearest_point(self.points, top)
        used = np.unique(owner)
        self.tops, self.kids = top[used], [np.flatnonzero(owner == t) for t in used]
        self.rows, self.radius, self.top_radius = np.zeros(len(self.points), np.int64), np.zeros(len(self.points)), np.full(len(used), -np.inf)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of each row, and its distances to the leaf's and the top cell's pivot."""
        top = nearest_point(x, self.tops)
        leaf = np.empty(len(x), np.int64)
        for t in np.unique(top):
            own = np.flatnonzero(top == t)
            leaf[own] = self.kids[t][nearest_point(x[own], self.points[self.kids[t]])]
        return leaf, np.linalg.norm(x - self.points[leaf], axis=1), np.linalg.norm(x - self.tops[top], axis=1)

    def learn(self, leaf: int, rows: int, radius: float, top_radius: float) -> None:
        self.rows[leaf], self.radius[leaf] = rows, radius
        t = next(i for i, kids in enumerate(self.kids) if leaf in kids)
        self.top_radius[t] = max(self.top_radius[t], top_radius)

    def settle(self, block_rows: int) -> list[tuple[int, int, int]]:
        """Join leaves of the same and of following top cells in regions; (leaf, region, blocks of the region) of all."""
        most = max(block_rows, min(REGION_BLOCKS * block_rows, REGION_BYTES // (8 * self.points.shape[1])))
        order = np.concatenate(self.kids)
        held = self.rows[order]
        self.region = np.zeros(len(order), np.int64)
        self.region[order] = (np.cumsum(held) - held) // most
        blocks = np.ceil(np.bincount(self.region, weights=self.rows) / most).astype(np.int64)
        return [(int(leaf), int(r), max(1, int(blocks[r]))) for leaf, r in enumerate(self.region)]

    def slack(self, x: np.ndarray) -> np.ndarray:
        """What rounding may add to the distances of rows to pivots."""
        return 1e-7 * (1.0 + np.linalg.norm(x, axis=1) + np.abs(self.points).max()) * np.sqrt(x.shape[1])

    def reaching(self, x: np.ndarray, bound: np.ndarray, leaf: int) -> np.ndarray:
        """Numbers of the rows whose bound reaches into a leaf."""
        return np.flatnonzero(gaps(x, self.points[leaf:leaf + 1])[:, 0] - self.radius[leaf] <= bound + self.slack(x))

    def certain(self, x: np.ndarray, need: int) -> np.ndarray:
        """A distance within which each row surely has `need` reference rows: whole leaves, the nearest far sides first."""
        far = gaps(x, self.points) + self.radius[None, :]
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.rows[order], axis=1) >= need
        first = enough.argmax(axis=1)
        at = np.take_along_axis(far, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
        return np.where(enough[:, -1], at, np.inf)

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that can hold a reference row within a row's bound, ordered by row."""
        most = bound + self.slack(x)
        near = gaps(x, self.tops) - self.top_radius[None, :] <= most[:, None]
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, kids in enumerate(self.kids):
            own = np.flatnonzero(near[:, t])
            kids = kids[self.rows[kids] > 0]
            if len(own) and len(kids):
                a, b = np.nonzero(gaps(x[own], self.points[kids]) - self.radius[kids][None, :] <= most[own][:, None])
                rows.append(own[a])
                leaves.append(kids[b])
        row, leaf = np.concatenate(rows), np.concatenate(leaves)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


Forest = dict[str, Tree]


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    folder = work_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def plant(ref: DataFrame) -> Forest:
    """Trees of all groups of (grp, id, v) that hold more than one block, the largest first while pivots last.

    The driver sees the pivots: at most `plumbline.knn.maxPivots`, and at most `plumbline.knn.pivotBytes` of them.
    """
    spark = ref.sparkSession
    rows = limit(spark, BLOCK_ROWS)
    most = limit(spark, MAX_PIVOTS)
    large = ref.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).where(F.col("n") > rows)
    sizes = large.orderBy(F.desc("n"), "grp").limit(most).collect()
    if not sizes:
        return {}
    most = max(1, min(most, limit(spark, PIVOT_BYTES) // (8 * max(r["width"] for r in sizes))))
    share = min(1.0, most * rows / sum(r["n"] for r in sizes))
    wanted = [(r["grp"], int(np.ceil(share * r["n"] / rows))) for r in sizes[:most]]
    table = spark.createDataFrame(pa.table({"grp": pa.array([g for g, _ in wanted], pa.string()), "leaves": [n for _, n in wanted]}))
    drawn = F.row_number().over(Window.partitionBy("grp").orderBy("d", "id"))
    picked = ref.join(F.broadcast(table), "grp").select("grp", "id", "v", "leaves", V.draw_key(7, 0, "id").alias("d"))
    ends = picked.withColumn("i", drawn).where(F.col("i") <= max(n for _, n in wanted)).where("i <= leaves").select("grp", "i", "v").toArrow().sort_by([("grp", "ascending"), ("i", "ascending")])
    group = ends.column("grp").to_numpy(zero_copy_only=False)
    x = matrix(ends.column("v"))
    return {g: Tree(x[group == g]) for g in dict.fromkeys(group)}


def by_group(batch: pa.RecordBatch, forest: Forest) -> Iterator[tuple[Tree, np.ndarray]]:
    """Row numbers of a batch per group with a tree."""
    group = batch.column("grp").to_numpy(zero_copy_only=False)
    for g in set(group) & set(forest):
        yield forest[g], np.flatnonzero(group == g)


def placed(df: DataFrame, forest: object) -> DataFrame:
    """Rows with their leaf and the distances to both pivots; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            leaf, near, far = np.full(n, NO_TREE, np.int64), np.zeros(n), np.zeros(n)
            if n:
                x = matrix(batch.column("v"))
                for tree, own in by_group(batch, forest.value):
                    leaf[own], near[own], far[own] = tree.place(x[own])
            yield with_columns(batch, {"leaf": pa.array(leaf.astype(np.int32)), "near": near, "far": far})

    more = [T.StructField("leaf", T.IntegerType()), T.StructField("near", T.DoubleType()), T.StructField("far", T.DoubleType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))


def grow(spark: SparkSession, forest: Forest, refs: DataFrame) -> DataFrame:
    """Teach the trees what their leaves hold; (grp, leaf, blocks) of all cells."""
    rows = limit(spark, BLOCK_ROWS)
    stats = refs.groupBy("grp", "leaf").agg(F.count("*").alias("n"), F.max("near").alias("near"), F.max("far").alias("far"))
    if forest:
        for r in stats.where(F.col("leaf") != NO_TREE).collect():  # one row per pivot
            forest[r["grp"]].learn(r["leaf"], r["n"], r["near"], r["far"])
    return stats.select("grp", "leaf", F.ceil(F.col("n") / rows).cast("int").alias("blocks"))


def reached(queries: DataFrame, forest: object, need: int, regions: bool = False) -> DataFrame:
    """Rows with `leaves`: those that can hold a reference row within the row's `bound`, or their regions; open bounds are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = max([len(tree.points) for tree in forest.value.values()], default=1)
        for batch in (whole.slice(cut.start, cut.stop - cut.start) for whole in batches for cut in slices(whole.num_rows, width)):
            found_rows, found_leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if batch.num_rows:
                x, bound = matrix(batch.column("v")), batch.column("bound").to_numpy().copy()
                for tree, own in by_group(batch, forest.value):
                    open_ = own[~np.isfinite(bound[own])]
                    if len(open_):
                        bound[open_] = tree.certain(x[open_], need)
                    row, leaf = tree.within(x[own], bound[own])
                    if regions:
                        row, leaf = np.divmod(np.unique(row * len(tree.points) + tree.region[leaf]), len(tree.points))
                    found_rows.append(own[row])
                    found_leaves.append(leaf)
            row, leaf = np.concatenate(found_rows), np.concatenate(found_leaves)
            order = np.argsort(row, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf[order].astype(np.int32)))
            yield with_columns(batch, {"bound": bound, "leaves": lists} if batch.num_rows else {"leaves": lists})

    return queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))]))


CELL = ["grp", "leaf", "block", "salt"]


def in_regions(spark: SparkSession, forest: Forest, refs: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """refs with their region as `leaf` and their leaf as `spot`, and the cells (grp, leaf, blocks) of the regions."""
    rows = limit(spark, BLOCK_ROWS)
    own = [(g, *x) for g, tree in forest.items() for x in tree.settle(rows)]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*own) if own else [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["grp", "leaf", "region", "blocks"])
    placing = spark.createDataFrame(table).unionByName(cells.where(F.col("leaf") == NO_TREE).select("grp", "leaf", F.col("leaf").alias("region"), "blocks"))
    held = refs.join(placing.select("grp", "leaf", "region"), ["grp", "leaf"]).withColumnRenamed("leaf", "spot").withColumnRenamed("region", "leaf")
    return held, placing.select("grp", F.col("region").alias("leaf"), "blocks").distinct()


def by_leaf(q: pa.Table, r: pa.Table, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, reference rows) of each leaf of a region that some queries reach."""
    if not q.num_rows or not r.num_rows:
        return
    tree = forest.get(q.column("grp")[0].as_py())
    if tree is None:
        yield np.arange(q.num_rows), np.arange(r.num_rows)
        return
    x, bound, spot = matrix(q.column("v")), q.column("bound").to_numpy(), r.column("spot").to_numpy()
    for leaf in np.unique(spot):
        asking = tree.reaching(x, bound, leaf)
        if len(asking):
            yield asking, np.flatnonzero(spot == leaf)


def met(queries: DataFrame, refs: DataFrame, cells: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, more: tuple[str, ...] = ()) -> DataFrame:
    """`run` on the queries and the reference rows of every cell block; both sides are dealt by (grp, leaf, block, salt).

    cells(grp, leaf, blocks, salts). Queries hold `block`, and a salt by their id.
    """
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int")
    r = refs.select("grp", "leaf", "id", "v", "aux", *more).join(cells, ["grp", "leaf"]).withColumn("block", own)
    r = r.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("blocks", "salts")
    q = queries.join(cells.select("grp", "leaf", "salts"), ["grp", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts")).cast("int")).drop("salts")
    return q.groupBy(*CELL).cogroup(r.groupBy(*CELL)).applyInArrow(run, schema)


def salted(cells: DataFrame, rows_per_cell: DataFrame, rows: int, blocks: float = SALT_BLOCKS) -> DataFrame:
    """cells with the salts that `n` query rows per cell, each in one of its blocks or in all, need at most."""
    return cells.join(rows_per_cell, ["grp", "leaf"]).select("grp", "leaf", "blocks", F.ceil(F.col("n") / (rows * blocks)).cast("int").alias("salts"))


def salt_blocks(asking: DataFrame, forest: Forest, rows: int) -> float:
    """Blocks' worth of queries in a salt of a region, fewer while the sendings (grp, leaf, n) are too few for SALTS tasks.

    A region's references are sent once per salt, so salts are as large as regions may be.
    """
    sent = int(asking.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    width = max([tree.points.shape[1] for tree in forest.values()], default=1)
    most = max(SALT_BLOCKS, min(REGION_BLOCKS, REGION_BYTES / (8 * width * rows)))
    return min(float(most), max(1.0, sent / (SALTS * rows)))


def sendings(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """A row per query and block of the cells it has to be sent to."""
    sent = queries.withColumn("leaf", F.explode("leaves")).drop("leaves")
    sent = sent.join(cells.select("grp", "leaf", "blocks"), ["grp", "leaf"])
    return sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")


def all_blocks(queries: DataFrame) -> DataFrame:
    """Queries of a group without a tree reach its one cell."""
    return queries.withColumn("leaves", F.when(F.col("leaf") == NO_TREE, F.array(F.lit(NO_TREE))).otherwise(F.col("leaves")))


def counted(queries: DataFrame) -> DataFrame:
    """Queries per (grp, leaf) that they reach."""
    return queries.select("grp", F.explode("leaves").alias("leaf")).groupBy("grp", "leaf").agg(F.count("*").alias("n"))


def best(qv: np.ndarray, x: np.ndarray, rv: np.ndarray, y: np.ndarray, k: int, unit: bool, exclude_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, distance) of the k nearest references per query, nearest first, equal ones by id.

    The expanded form rounds differently from the plain one: all rows within rounding of the k-th are measured exactly.
    Queries are taken in slices, so that memory does not grow with queries times references.
    """
    by_id = np.empty(len(rv), np.int64)
    by_id[np.argsort(rv, kind="stable")] = np.arange(len(rv))
    square, kk = (y**2).sum(1), min(k, len(rv))
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for cut in slices(len(x), len(y)):
        own = x[cut]
        rough = own @ y.T
        rough *= -2.0
        rough += (own**2).sum(1)[:, None]
        rough += square[None, :]
        np.maximum(rough, 0.0, out=rough)
        if exclude_self:
            rough[qv[cut, None] == rv[None, :]] = np.inf
        kth = np.partition(rough, kk - 1, axis=1)[:, kk - 1]
        a, b = np.nonzero((rough <= kth[:, None] + 1e-9 * (1.0 + kth[:, None])) & np.isfinite(rough))
        exact = np.concatenate([np.zeros(0), *(measured(own[a[c]], y[b[c]], unit) for c in slices(len(a), own.shape[1]))])
        order = np.lexsort((by_id[b], exact, a))
        a, b, exact = a[order], b[order], exact[order]
        keep = np.arange(len(a)) - np.searchsorted(a, np.arange(len(own)))[a] < k
        parts.append((a[keep] + cut.start, b[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def measured(x: np.ndarray, y: np.ndarray, unit: bool) -> np.ndarray:
    return 1.0 - np.einsum("nd,nd->n", x, y) if unit else np.linalg.norm(x - y, axis=1)


def _sides(q: pa.Table, r: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids = lambda t: t.column("id").to_numpy()
    return ids(q), matrix(q.column("v")), ids(r), matrix(r.column("v"))


def one_block(ref: DataFrame) -> pa.Table | None:
    """All rows of (id, v, ...) if they are one block, which is small enough to be sent to every task."""
    rows = limit(ref.sparkSession, BLOCK_ROWS)
    held = ref.drop("grp").limit(rows + 1).toArrow()
    return held if held.num_rows <= rows else None


def to_block(query: DataFrame, block: pa.Table, run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """`run` on every batch of queries and the one block; a narrow pass."""
    shared = query.sparkSession.sparkContext.broadcast(block)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(pa.Table.from_batches([batch]), shared.value).cast(pa.schema([(n, t) for n, t in kinds])).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [(f.name, f.type) for f in to_arrow_schema(schema)]
    return query.mapInArrow(each, schema)


def nearest(query: DataFrame, ref: DataFrame, k: int, unit: bool, exclude_self: bool) -> DataFrame:
    """(query_id, ref_id, distance, rank) of the k nearest rows of ref(grp, id, v) in the group of each row of query(grp, id, v).

    Without `grp` all rows are one group. Fewer in a smaller group, none without one. Equal distances go to the smaller id;
    `unit` vectors get 1 - dot.
    """
    kinds = [("query_id", query.schema["id"].dataType), ("ref_id", ref.schema["id"].dataType), ("distance", T.DoubleType()), ("rank", T.IntegerType())]
    answer = T.StructType([T.StructField(*x) for x in kinds])

    def pairs(q: pa.Table, r: pa.Table) -> pa.Table:
        """The best of one block, ranked within it."""
        qv, x, rv, y = _sides(q, r)
        a, b, d = best(qv, x, rv, y, k, unit, exclude_self) if len(qv) and len(rv) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        place = np.arange(len(a)) - np.searchsorted(a, a) + 1
        return pa.table([q.column("id").take(pa.array(a)), r.column("id").take(pa.array(b)), pa.array(d), pa.array(place.astype(np.int32))], names=answer.names)

    if "grp" not in ref.columns:
        block = one_block(ref.select("id", "v"))
        if block is not None:
            return to_block(query.select("id", "v"), block, pairs, answer)
        query, ref = query.withColumn("grp", F.lit("")), ref.withColumn("grp", F.lit(""))
    spark = ref.sparkSession
    rows = limit(spark, BLOCK_ROWS)
    forest = plant(ref)
    if not forest:  # every group is one block
        cell = [F.lit(NO_TREE).alias("leaf"), F.lit(0).alias("block")]
        cells = ref.select("grp").distinct().select("grp", F.lit(NO_TREE).alias("leaf"), F.lit(1).alias("blocks"))
        plan = salted(cells, query.groupBy("grp").agg(F.count("*").alias("n"), F.lit(NO_TREE).alias("leaf")), rows)
        small = ref.select("grp", "id", "v", F.lit(0.0).alias("aux"), F.lit(NO_TREE).alias("leaf"))
        return met(query.select("grp", "id", "v", *cell), small, plan, pairs, answer)
    shared = spark.sparkContext.broadcast(forest)
    refs = placed(ref.select("grp", "id", "v", F.lit(0.0).alias("aux")), shared)
    # of equal vectors only the k smallest ids, one more for a row that is left out, can be neighbours
    copy = F.row_number().over(Window.partitionBy("grp", "leaf", "v").orderBy("id"))
    refs = refs.withColumn("copy", copy).where(F.col("copy") <= k + exclude_self).drop("copy")
    refs = written(refs, "references")
    cells = grow(spark, forest, refs)
    queries = written(placed(query.select("grp", "id", "v"), shared).drop("near", "far"), "queries")
    plan = salted(cells, queries.groupBy("grp", "leaf").agg(F.count("*").alias("n")), rows)
    own = queries.join(cells, ["grp", "leaf"], "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("id", F.lit("first")), F.col("blocks")).cast("int"), F.lit(0))).drop("blocks")
    vector = query.schema["v"].dataType

    def first(q: pa.Table, r: pa.Table) -> pa.Table:
        """The queries with the distance of the k-th neighbour in one block of their leaf."""
        qv, x, rv, y = _sides(q, r)
        last = np.full(len(qv), np.inf)
        if len(rv) and len(qv):
            a, b, _ = best(qv, x, rv, y, k, unit, exclude_self)
            worst = np.concatenate([np.zeros(0), *(measured(x[a[c]], y[b[c]], False) for c in slices(len(a), x.shape[1]))])
            most = np.zeros(len(qv))
            np.maximum.at(most, a, worst)
            full = np.bincount(a, minlength=len(qv)) == k
            last[full] = most[full]
        return pa.table([*(q.column(c) for c in ("grp", "id", "v", "leaf")), pa.array(last)], names=["grp", "id", "v", "leaf", "bound"])

    def rest(q: pa.Table, r: pa.Table) -> pa.Table:
        """The best of one block of a region, from the leaves in reach."""
        qv, x, rv, y = _sides(q, r)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j in by_leaf(q, r, known.value):
            a, b, d = best(qv[i], x[i], rv[j], y[j], k, unit, exclude_self)
            found.append((i[a], j[b], d))
        a, b, d = (np.concatenate(c) for c in zip(*found))
        by_id = np.empty(len(rv), np.int64)
        by_id[np.argsort(rv, kind="stable")] = np.arange(len(rv))
        order = np.lexsort((by_id[b], d, a))
        a, b, d = a[order], b[order], d[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pa.table([q.column("id").take(pa.array(a[keep])), r.column("id").take(pa.array(b[keep])), pa.array(d[keep])], names=answer.names[:3])

    fields = [T.StructField("grp", T.StringType()), T.StructField("id", query.schema["id"].dataType), T.StructField("v", vector), T.StructField("leaf", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("bound", T.DoubleType())])

    # queries whose own leaf holds no reference row have no bound yet
    bare = own.join(cells, ["grp", "leaf"], "left_anti").where(F.col("leaf") != NO_TREE).select("grp", "id", "v", "leaf", F.lit(float("inf")).alias("bound"))
    bounded = written(met(own, refs, plan, first, schema).unionByName(bare), "bounds")
    held, regions = in_regions(spark, forest, refs, cells)
    known = spark.sparkContext.broadcast(forest)  # with what the leaves hold
    open_ = all_blocks(reached(bounded, known, k + exclude_self, regions=True))
    asking = cut_lineage(counted(open_))  # a row per region
    more = salted(regions, asking, rows, salt_blocks(asking, forest, rows))
    # a query's own leaf is within its bound, so the regions hold all its neighbours
    others = met(sendings(open_, regions), held, more, rest, T.StructType(answer.fields[:3]), ("spot",))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ref_id"))
    return others.withColumn("rank", place).where(F.col("rank") <= k)


def least_within(query: DataFrame, ref: DataFrame, name: str) -> DataFrame:
    """(query_id, name): the smallest aux of rows of ref(grp, id, v, aux) within `bound` of each row of query(grp, id, v, bound).

    Without `grp` all rows are one group.
    """
    schema = T.StructType([T.StructField("query_id", query.schema["id"].dataType), T.StructField(name, T.DoubleType())])

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        return least(q, r, {})

    def least(q: pa.Table, r: pa.Table, forest: Forest) -> pa.Table:
        qv, x, rv, y = _sides(q, r)
        low = np.full(len(qv), np.inf)
        reach, carried = q.column("bound").to_numpy(), r.column("aux").to_numpy()
        for i, j in by_leaf(q, r, forest) if forest else [(np.arange(len(qv)), np.arange(len(rv)))] if len(qv) and len(rv) else []:
            z, aux = y[j], carried[j]
            square = (z**2).sum(1)
            for cut in slices(len(i), len(j)):
                own, far = x[i[cut]], reach[i[cut]]
                rough = np.maximum((own**2).sum(1)[:, None] - 2.0 * own @ z.T + square[None, :], 0.0)
                a, b = np.nonzero(rough <= (far**2)[:, None] + 1e-9 * (1.0 + (far**2)[:, None]))
                for c in slices(len(a), own.shape[1]):
                    inside = measured(own[a[c]], z[b[c]], False) <= far[a[c]]
                    np.minimum.at(low, i[cut][a[c][inside]], aux[b[c][inside]])
        hit = np.flatnonzero(np.isfinite(low))
        return pa.table([q.column("id").take(pa.array(hit)), pa.array(low[hit])], names=schema.names)

    if "grp" not in ref.columns:
        block = one_block(ref.select("id", "v", "aux"))
        if block is not None:
            return to_block(query.select("id", "v", "bound"), block, run, schema)
        query, ref = query.withColumn("grp", F.lit("")), ref.withColumn("grp", F.lit(""))
    spark = ref.sparkSession
    rows = limit(spark, BLOCK_ROWS)
    forest = plant(ref)
    shared = spark.sparkContext.broadcast(forest)
    refs = placed(ref.select("grp", "id", "v", "aux"), shared)
    copy = F.row_number().over(Window.partitionBy("grp", "leaf", "v").orderBy("aux", "id"))
    refs = written(refs.withColumn("copy", copy).where("copy = 1").drop("copy"), "references")
    cells = grow(spark, forest, refs)
    held, regions = in_regions(spark, forest, refs, cells)
    known = spark.sparkContext.broadcast(forest)
    queries = written(placed(query.select("grp", "id", "v", "bound"), shared).drop("near", "far"), "queries")
    open_ = all_blocks(reached(queries, known, 1, regions=True))
    asking = cut_lineage(counted(open_))
    more = salted(regions, asking, rows, salt_blocks(asking, forest, rows))
    found = met(sendings(open_, regions), held, more, lambda q, r: least(q, r, known.value), schema, ("spot",))
    return found.groupBy("query_id").agg(F.min(name).alias(name))
