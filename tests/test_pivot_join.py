"""The pivot-tree joins against brute force: clusters, equal rows, many groups, few pivots; and how far they send queries."""

import tracemalloc

import numpy as np
import pytest

from plumbline.operators import neighbors
from plumbline.operators import pivot_join as J
from plumbline.session import BLOCK_ROWS, MAX_PIVOTS, PIVOT_BYTES
from pyspark.sql import functions as F


def rows_of(spark, x, grp, first=0):
    return spark.createDataFrame([(str(g), i + first, v.tolist()) for i, (v, g) in enumerate(zip(x, grp))], "grp string, id bigint, v array<double>")


def clustered(n, groups, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(40, 6)) * 30
    x = centres[r.integers(0, 40, n)] + r.normal(size=(n, 6)) * 0.5
    x[: n // 3] = x[0]  # one vector holds a third of the rows
    return x, r.integers(0, groups, n) if groups > 1 else np.zeros(n, int)


@pytest.mark.parametrize("groups, rows, pivots, size", [(1, 64, 16_384, 32 << 20), (1, 64, 5, 32 << 20), (3, 32, 16_384, 32 << 20), (3, 32, 1, 32 << 20), (300, 64, 16_384, 32 << 20), (1, 64, 1000, 500)])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_nearest_as_brute_force(spark, limits, groups, rows, pivots, size, exclude_self):
    limits(BLOCK_ROWS, rows)
    limits(MAX_PIVOTS, pivots)
    limits(PIVOT_BYTES, size)
    x, g = clustered(900, groups)
    q, gq = (x[::3], g[::3]) if not exclude_self else (x, g)
    ids = np.arange(900)[::3] if not exclude_self else np.arange(900)
    query = spark.createDataFrame([(str(b), int(i), v.tolist()) for i, v, b in zip(ids, q, gq)] + [("nowhere", 5000, q[0].tolist())], "grp string, id bigint, v array<double>")
    got = {}
    for r in J.nearest(query, rows_of(spark, x, g), 4, False, exclude_self).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.ref_id, r.distance))
    for i, v, b in zip(ids, q, gq):
        d = np.linalg.norm(x - v, axis=1)
        pool = [j for j in np.flatnonzero(g == b) if not (exclude_self and j == i)]
        want = sorted((d[j], j) for j in pool)[:4]
        found = sorted(got.get(i, []))
        assert [f[0] for f in found] == list(range(1, len(want) + 1))
        assert [f[1] for f in found] == [j for _, j in want]
        assert np.allclose([f[2] for f in found], [w for w, _ in want])
    assert 5000 not in got


@pytest.mark.parametrize("rows, pivots", [(2048, 16_384), (32, 16_384), (32, 4)])
def test_least_within_as_brute_force(spark, limits, rows, pivots):
    limits(BLOCK_ROWS, rows)
    limits(MAX_PIVOTS, pivots)
    x, g = clustered(600, 2)
    aux, bound = np.arange(600)[::-1] * 1.0, np.where(np.arange(600) % 5 == 0, 0.0, 1.5)
    ref = rows_of(spark, x, g).withColumn("aux", F.lit(599.0) - F.col("id"))
    query = rows_of(spark, x + 0.01, g).withColumn("bound", F.when(F.col("id") % 5 == 0, 0.0).otherwise(1.5))
    got = {r.query_id: r.low for r in J.least_within(query, ref, "low").collect()}
    for i in range(600):
        inside = (g == g[i]) & (np.linalg.norm(x - (x[i] + 0.01), axis=1) <= bound[i])
        assert got.get(i) == (aux[inside].min() if inside.any() else None)


def test_queries_are_sent_to_few_leaves(spark, limits):
    """On clustered rows a query reaches a small part of the leaves, and the part falls as rows and leaves grow."""
    limits(BLOCK_ROWS, 50)
    shares = []
    for n in (2000, 8000):
        r = np.random.default_rng(1)
        centres = r.normal(size=(n // 50, 8)) * 20
        x = centres[r.integers(0, len(centres), n)] + r.normal(size=(n, 8)) * 0.3
        ref = rows_of(spark, x, np.zeros(n, int))
        forest = J.plant(ref)
        shared = spark.sparkContext.broadcast(forest)
        refs = J.placed(ref, shared).cache()
        cells = J.grow(spark, forest, refs)
        leaves = cells.count()
        queries = refs.select("grp", "id", "v", "leaf", F.lit(0).alias("block"), F.lit(2.0).alias("bound"))
        sent = J.counted(J.reached(queries, spark.sparkContext.broadcast(forest), 5)).agg(F.sum("n")).first()[0]
        shares.append(sent / (n * leaves))
        refs.unpersist()
    assert leaves > 80 and shares[0] < 0.2 and shares[1] < 0.6 * shares[0]


def test_inputs_are_evaluated_once(spark, limits):
    """Sizes, pivots and rows: three passes over the reference, one over the queries, whatever the rounds."""
    limits(BLOCK_ROWS, 40)
    x, g = clustered(400, 1)
    seen = {s: spark.sparkContext.accumulator(0) for s in "qr"}

    def watched(df, side):
        def run(batches):
            for b in batches:
                seen[side].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    ref = rows_of(spark, x, g)
    found = J.nearest(watched(ref, "q"), watched(ref, "r"), 3, False, True)
    assert found.count() == 1200
    found.count()
    assert seen["q"].value == 400 and seen["r"].value <= 1200


def test_knn_join_keeps_string_ids_and_ties(spark, limits):
    limits(BLOCK_ROWS, 8)
    x = np.repeat(np.eye(3), 10, axis=0)
    df = spark.createDataFrame([(f"s{i:02d}", v.tolist()) for i, v in enumerate(x)], "sample_id string, features array<double>")
    got = neighbors.knn_join(df, df, 3, metric="cosine", exclude_self=True).orderBy("query_id", "rank").collect()
    for i in range(30):
        want = [f"s{j:02d}" for j in range(10 * (i // 10), 10 * (i // 10) + 10) if j != i][:3]
        assert [r.ref_id for r in got[3 * i : 3 * i + 3]] == want


def peak(run):
    """MB that numpy took at most while `run` ran."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 2**20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("unit, exclude_self", [(False, False), (True, True)])
def test_a_full_salt_meets_a_block_in_little_memory(unit, exclude_self):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(J.SALT_BLOCKS * 2048, 8)), r.normal(size=(2048, 8))
    if unit:
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    ids = np.arange(len(x))
    out = []
    assert peak(lambda: out.append(J.best(ids, x, ids[: len(y)], y, 3, unit, exclude_self))) < 100
    a, b, d = out[0]
    for i in (0, 2047, 2048, len(x) - 1):
        full = 1.0 - y @ x[i] if unit else np.linalg.norm(y - x[i], axis=1)
        full[i if exclude_self and i < len(y) else slice(0, 0)] = np.inf
        assert b[a == i].tolist() == np.argsort(full)[:3].tolist() and np.allclose(d[a == i], np.sort(full)[:3])


def test_queries_in_reach_of_all_leaves_are_sent_once_per_region(spark, limits):
    """Without clusters every leaf is in reach; the copies of a query grow with regions of leaves, not with leaves."""
    limits(BLOCK_ROWS, 50)
    x = np.random.default_rng(1).normal(size=(2000, 40))
    ref = rows_of(spark, x, np.zeros(2000, int)).withColumn("aux", F.lit(0.0))
    forest = J.plant(ref)
    refs = J.placed(ref, spark.sparkContext.broadcast(forest)).cache()
    cells = J.grow(spark, forest, refs)
    held, regions = J.in_regions(spark, forest, refs, cells)
    queries = refs.select("grp", "id", "v", "leaf", F.lit(50.0).alias("bound"))
    open_ = J.reached(queries, spark.sparkContext.broadcast(forest), 5, regions=True)
    sent = J.sendings(open_, regions).count()
    assert cells.count() > 30 and held.count() == 2000 and sent <= 2000 * 5
    refs.unpersist()
