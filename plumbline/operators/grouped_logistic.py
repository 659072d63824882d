"""Logistic models of many groups at once: folds, bins, seeds and attribute values are groups of one table.

Groups whose rows fit a task are fitted whole, each in one task, all in one job. The rows of larger groups stay where they
are: every step of all their solvers is one distributed pass that adds up loss and gradient at each group's trial point.
Both run the same limited-memory quasi-Newton steps to the same strictly convex optimum, so the number of jobs does not
grow with the groups.

The objective is C * sum(loss) + |w|^2 / 2 with free intercepts; two classes have one weight vector.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.arrow import matrix, with_columns
from plumbline.operators.pivot_join import written
from plumbline.session import BROADCAST_BYTES, FIT_BYTES, limit

HISTORY = 10
STATE_BYTES = 256 << 20  # solver states of large groups that the driver holds at a time
PARTS = 64  # partial sums per group before the last addition


def descent(x: np.ndarray, max_iter: int, tol: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps; asks for loss and gradient at trial points, returns the last point."""
    f, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tol:
            break
        d, alphas = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d -= a * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas)):
            d += (a - (y @ d) / (s @ y)) * s
        d = -d
        slope = g @ d
        if slope >= 0:
            d, slope, steps = -g, -(g @ g), []
        t = 1.0 if steps else min(1.0, 1.0 / np.abs(g).sum())
        for _ in range(40):
            new_f, new_g = yield x + t * d
            if new_f <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_g - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-HISTORY:]
        done = f - new_f <= 1e-13 * max(1.0, abs(f))
        x, f, g = x + s, new_f, new_g
        if done:
            break
    return x


def outputs(classes: int) -> int:
    return 1 if classes == 2 else classes


def loss(params: np.ndarray, x: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Sum of losses over the rows, followed by its gradient."""
    k = outputs(classes)
    w = params.reshape(-1, k)
    z = x @ w[:-1] + w[-1]
    if k == 1:
        z = z[:, 0]
        total = np.logaddexp(0.0, z).sum() - z[y == 1].sum()
        r = (1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - (y == 1))[:, None]
    else:
        high = z.max(axis=1, keepdims=True)
        e = np.exp(z - high)
        sums = e.sum(axis=1, keepdims=True)
        total = (np.log(sums) + high).sum() - z[np.arange(len(y)), y].sum()
        r = e / sums
        r[np.arange(len(y)), y] -= 1.0
    return np.concatenate([[total], np.concatenate([x.T @ r, r.sum(axis=0, keepdims=True)]).ravel()])


def with_penalty(sums: np.ndarray, params: np.ndarray, c: float, k: int) -> tuple[float, np.ndarray]:
    w = params.copy()
    w[-k:] = 0.0
    return float(c * sums[0] + w @ w / 2), c * sums[1:] + w


@dataclass
class Scale:
    mean: np.ndarray
    factor: np.ndarray

    @staticmethod
    def of(n: int, total: np.ndarray, squares: np.ndarray) -> Scale:
        mean = total / n
        std = np.sqrt(np.maximum(squares / n - mean**2, 0.0))
        std[std <= 1e-12 * (1.0 + np.abs(mean))] = 1.0
        return Scale(mean, 1.0 / std)

    def undone(self, params: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and intercepts for unscaled vectors."""
        w = params.reshape(-1, k)
        weights = w[:-1] * self.factor[:, None]
        return weights, w[-1] - self.mean @ weights


def unscaled(width: int) -> Scale:
    return Scale(np.zeros(width), np.ones(width))


def fit_here(x: np.ndarray, y: np.ndarray, classes: int, c: float, max_iter: int, standardize: bool) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one group whose rows are at hand."""
    scale = Scale.of(len(x), x.sum(axis=0), (x**2).sum(axis=0)) if standardize else unscaled(x.shape[1])
    x, k = (x - scale.mean) * scale.factor, outputs(classes)
    solver = descent(np.zeros((x.shape[1] + 1) * k), max_iter)
    point = next(solver)
    while True:
        try:
            point = solver.send(with_penalty(loss(point, x, y, classes), point, c, k))
        except StopIteration as end:
            return scale.undone(end.value, k)


def models_schema(label: T.DataType) -> T.StructType:
    doubles = T.ArrayType(T.DoubleType())
    return T.StructType([T.StructField("grp", T.StringType()), T.StructField("classes", T.ArrayType(label)), T.StructField("weights", doubles), T.StructField("intercepts", doubles), T.StructField("n", T.LongType())])


def fit_groups(
    rows: DataFrame, label: str, features: str = "features", grp: str = "grp", c: float = 1.0, max_iter: int = 200, min_rows: int = 1, standardize: bool = False,
) -> DataFrame:
    """(grp, classes, weights, intercepts, n): a model per group, of its classes with at least `min_rows` rows.

    Groups with fewer than two such classes have no model. Rows without group, label or vector are left out. With
    `standardize` vectors are scaled to the group's mean and population deviation first; weights are for unscaled vectors.
    Weights are stored row by row; with two classes they are those of the larger one.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(grp).cast("string").alias("grp"), F.col(label).alias("y"), F.col(features).cast("array<double>").alias("v")).where("grp is not null and y is not null and v is not null")
    kind = rows.schema["y"].dataType
    sizes = rows.groupBy("grp", "y").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).where(F.col("n") >= min_rows)
    plan = sizes.groupBy("grp").agg(F.sort_array(F.collect_list("y")).alias("classes"), F.sum("n").alias("n"), F.max("width").alias("width")).where(F.size("classes") > 1)
    plan = written(plan, "groups")
    fits = F.col("n") * F.col("width") * 8 <= limit(spark, FIT_BYTES)
    schema = models_schema(kind)

    def fit(table: pa.Table) -> pa.Table:
        classes = table.column("classes")[0].as_py()
        place = {v: i for i, v in enumerate(classes)}
        y = np.array([place[v] for v in table.column("y").to_pylist()])
        w, b = fit_here(matrix(table.column("v")), y, len(classes), c, max_iter, standardize)
        return pa.table([[table.column("grp")[0].as_py()], pa.array([classes], table.schema.field("classes").type), [w.ravel().tolist()], [b.tolist()], [len(y)]], names=schema.names)

    own = rows.join(plan.where(fits).select("grp", "classes"), "grp").where(F.array_contains("classes", F.col("y")))
    small = own.groupBy("grp").applyInArrow(fit, schema)
    large = plan.where(~fits)
    if large.isEmpty():
        return small
    return small.unionByName(fit_large(rows, large, kind, c, max_iter, standardize))


def added_up(rows: DataFrame, shared: object, each: Callable[..., np.ndarray]) -> dict[str, np.ndarray]:
    """Per group the sum of `each(x, y, shared entry)` over its rows: per task, per part, then one row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                x, y, group = matrix(batch.column("v")), batch.column("at").to_numpy(), batch.column("grp").to_numpy(zero_copy_only=False)
                for g in set(group) & set(shared.value):
                    at = group == g
                    found = each(x[at], y[at], shared.value[g])
                    totals[g] = totals[g] + found if g in totals else found
        for g, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["grp", "sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table([[table.column("grp")[0].as_py()], pa.array([matrix(table.column("sums")).sum(axis=0).tolist()], pa.list_(pa.float64()))], names=["grp", "sums"])

    kind = "grp string, sums array<double>"
    parts = rows.mapInArrow(run, kind).withColumn("part", F.spark_partition_id() % PARTS)
    sums = parts.groupBy("grp", "part").applyInArrow(add, kind).groupBy("grp").applyInArrow(add, kind)
    return {r["grp"]: np.asarray(r["sums"]) for r in sums.collect()}


def fit_large(rows: DataFrame, plan: DataFrame, kind: T.DataType, c: float, max_iter: int, standardize: bool) -> DataFrame:
    """The groups of plan(grp, classes, n, width), as many at a time as their solver states fit the driver; a pass per step."""
    spark = rows.sparkSession
    groups = plan.orderBy("grp").collect()  # each holds more rows than a task may
    batches: list[list] = [[]]
    room = STATE_BYTES
    for r in groups:
        need = 8 * (r["width"] + 1) * outputs(len(r["classes"])) * (2 * HISTORY + 6)
        if batches[-1] and need > room:
            batches.append([])
            room = STATE_BYTES
        batches[-1].append(r)
        room -= need
    found = []
    for batch in batches:
        wanted = F.broadcast(plan.where(F.col("grp").isin([r["grp"] for r in batch])).select("grp", "classes"))
        own = rows.join(wanted, "grp").withColumn("at", F.array_position("classes", F.col("y")) - 1).where("at >= 0").select("grp", "at", "v")
        own = written(own, "large-groups")
        scales = {r["grp"]: unscaled(r["width"]) for r in batch}
        if standardize:
            sums = added_up(own, spark.sparkContext.broadcast({r["grp"]: None for r in batch}), lambda x, y, _: np.concatenate([x.sum(axis=0), (x**2).sum(axis=0)]))
            scales = {r["grp"]: Scale.of(r["n"], *np.split(sums[r["grp"]], 2)) for r in batch}
        solvers = {r["grp"]: descent(np.zeros((r["width"] + 1) * outputs(len(r["classes"]))), max_iter) for r in batch}
        sizes = {r["grp"]: len(r["classes"]) for r in batch}
        points, ended = {g: next(s) for g, s in solvers.items()}, {}
        while points:
            shared = spark.sparkContext.broadcast({g: (p, scales[g], sizes[g]) for g, p in points.items()})
            sums = added_up(own, shared, lambda x, y, s: loss(s[0], (x - s[1].mean) * s[1].factor, y, s[2]))
            for g, p in list(points.items()):
                try:
                    points[g] = solvers[g].send(with_penalty(sums[g], p, c, outputs(sizes[g])))
                except StopIteration as end:
                    ended[g] = end.value
                    del points[g]
        for r in batch:
            w, b = scales[r["grp"]].undone(ended[r["grp"]], outputs(sizes[r["grp"]]))
            found.append((r["grp"], r["classes"], w.ravel().tolist(), b.tolist(), r["n"]))
    return spark.createDataFrame(found, models_schema(kind))


@dataclass
class Model:
    classes: list
    weights: np.ndarray
    intercepts: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.intercepts
        return np.concatenate([np.zeros_like(z), z], axis=1) if z.shape[1] == 1 else z


def model_blocks(models: DataFrame) -> Iterator[tuple[Callable[[str], Column], object]]:
    """(condition on a group column, broadcast {grp: Model}) in blocks that stay below `plumbline.broadcast.maxBytes`."""
    spark = models.sparkSession
    size = models.agg(F.coalesce(F.sum(8 * (F.size("weights") + F.size("classes"))), F.lit(0))).first()[0]
    count = max(1, -(-size // limit(spark, BROADCAST_BYTES)))
    for b in range(count):
        mine = lambda name, b=b: F.pmod(F.xxhash64(name), F.lit(count)) == b
        held = {r["grp"]: Model(r["classes"], np.reshape(r["weights"], (-1, len(r["intercepts"]))), np.asarray(r["intercepts"])) for r in models.where(mine("grp")).collect()}
        yield mine, spark.sparkContext.broadcast(held)


def predict_groups(rows: DataFrame, models: DataFrame, label: str, features: str = "features", grp: str = "grp") -> DataFrame:
    """Rows with a model of their group `grp`, with `predicted` and `true_rank`, the place of the true class (null if untrained)."""
    kind = models.schema["classes"].dataType.elementType
    schema = T.StructType([*rows.schema.fields, T.StructField("predicted", kind), T.StructField("true_rank", T.IntegerType())])
    out = None
    for mine, shared in model_blocks(models):

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                group = np.array(batch.column(grp).to_pylist(), object)
                keep = np.flatnonzero([g in shared.value for g in group])
                batch, group = batch.take(pa.array(keep)), group[keep]
                x, y = matrix(batch.column(features)), batch.column(label).to_pylist()
                said, place = [None] * len(keep), [None] * len(keep)
                for g in set(group):
                    model, at = shared.value[g], np.flatnonzero(group == g)
                    z = model.logits(x[at])
                    number = {v: i for i, v in enumerate(model.classes)}
                    for i, row, best in zip(at.tolist(), z, z.argmax(axis=1).tolist()):
                        said[i] = model.classes[best]
                        j = number.get(y[i])
                        place[i] = None if j is None else int((row > row[j]).sum()) + 1
                yield with_columns(batch, {"predicted": pa.array(said, pa.from_numpy_dtype(np.int32) if isinstance(kind, T.IntegerType) else None), "true_rank": pa.array(place, pa.int32())})

        part = rows.where(mine(grp)).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def tested_on_all(test: DataFrame, models: DataFrame, label: str, features: str = "features") -> DataFrame:
    """(grp, label, n, hits, known): how often each model is right on every class of the same test rows; no row is copied."""
    kind = test.schema[label].dataType
    schema = T.StructType([T.StructField("grp", T.StringType()), T.StructField(label, kind), T.StructField("n", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("known", T.BooleanType())])
    out = None
    for _, shared in model_blocks(models):

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            counts: dict[tuple, list] = {}
            label_type = None
            for batch in batches:
                label_type = batch.schema.field(label).type
                if not batch.num_rows:
                    continue
                x, y = matrix(batch.column(features)), np.array(batch.column(label).to_pylist(), object)
                for g, model in shared.value.items():
                    said = np.array(model.classes, object)[model.logits(x).argmax(axis=1)]
                    for v in set(y):
                        own = y == v
                        entry = counts.setdefault((g, v), [0, 0, v in model.classes])
                        entry[0] += int(own.sum())
                        entry[1] += int((said[own] == v).sum())
            if counts:
                keys, values = zip(*counts.items())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], label_type), *(pa.array([v[i] for v in values]) for i in range(3))], names=schema.names)

        part = test.select(label, features).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("grp", label).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max("known").alias("known"))
