"""The inverted-cell index: all rows are in it, recall against brute force, all probes and many candidates give exact rows."""

import tracemalloc

import numpy as np
import pytest

from plumbline.operators import cell_index as C
from plumbline.operators import neighbors


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, v.tolist()) for i, v in enumerate(x)], "sample_id bigint, features array<double>")


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16)) * 4
    x = centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 16))
    x[:1000] = x[0]  # a third of the rows are equal
    return x


def brute(x, q, k):
    d = np.linalg.norm(x[None] - q[:, None], axis=2)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


def test_all_probes_and_candidates_are_exact(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_CODES", 200)
    monkeypatch.setattr(C, "QUERY_ROWS", 16)
    x = rows[900:2000]
    index = C.build_index(frame(spark, x), cells=10)
    assert index.table.count() == len(x) and index.cells.count() <= 10
    found = C.search(index, frame(spark, x[::25]).withColumnRenamed("sample_id", "sample_id"), 5, 10, rerank=300).orderBy("query_id", "rank").collect()
    want, dist = brute(x, x[::25], 5)
    assert [r.ref_id for r in found] == want.ravel().tolist()
    assert np.allclose([r.distance for r in found], dist.ravel())


def test_recall_with_probes_that_are_measured(spark, rows):
    index = C.build_index(frame(spark, rows))
    some, asked = frame(spark, rows[1010::40]).selectExpr("sample_id * 40 + 1010 as sample_id", "features"), rows[1000::20]
    probes = C.probes_for(index, some, neighbors.knn_join(some, frame(spark, rows), 10), 0.95)
    assert 1 <= probes < len(index.codes.centres) // 2
    found = C.search(index, frame(spark, asked), 10, probes)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.ref_id)
    want, _ = brute(rows, asked, 10)
    assert np.mean([len(got.get(i, set()) & set(w.tolist())) / 10 for i, w in enumerate(want)]) >= 0.9
    exact = neighbors.knn_join(frame(spark, asked), frame(spark, rows), 10)
    said = C.recall(found, exact).first()
    assert said.queries == len(asked) and said.neighbours == 10 * len(asked) and said.recall >= 0.9


def test_empty_reference_and_query(spark, rows):
    none = spark.createDataFrame([], "sample_id bigint, features array<double>")
    assert C.search(C.build_index(none), frame(spark, rows[:3]), 2, 1).count() == 0
    assert C.search(C.build_index(frame(spark, rows[:50])), none, 2, 1).count() == 0
    index = C.build_index(frame(spark, rows[:1]))
    assert [tuple(r) for r in C.search(index, frame(spark, rows[:1]), 3, 1).collect()] == [(0, 0, 0.0, 1)]


def test_centres_are_moved_in_little_memory():
    """The driver fits 256 rows a cell; distances of all rows to all centres took 490 MB here."""
    x = np.random.default_rng(4).normal(size=(65_536, 4))
    tracemalloc.start()
    centres = C.moved_centres(x, 256, 1)
    most = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert len(centres) == 256 and most < 100


def test_the_sample_is_the_first_rows_by_hash(spark, rows):
    df = frame(spark, rows[900:]).select(C.F.col("sample_id").alias("id"), C.F.col("features").alias("v"))
    want = df.orderBy(C.V.draw_key(11, 0, "id")).limit(40).collect()
    assert np.array_equal(C.sampled(df, 40, 2100, 11), np.asarray([r["v"] for r in want]))


def test_a_query_leaves_a_block_with_its_best_codes_alone(rows):
    """However many cells a query looks into, a task hands on `keep` candidates; they are the best of all asked cells."""
    r = np.random.default_rng(6)
    x = rows[1000:]
    centres = C.moved_centres(x, 40)
    cell = C.nearest_point(x, centres)
    rest, cuts = x - centres[cell], [0, 4, 8, 12, 16]
    codes = C.Codes(centres, [C.moved_centres(rest[:, a:b], 64, 1) for a, b in zip(cuts, cuts[1:])], cuts)
    code, q = codes.encode(x, cell), x[r.integers(0, len(x), 30)] + 0.1
    asked = codes.cell_order(q)[:, :25]
    i, j, rough = C.best_codes(codes, q, asked, cell, code, 50)
    for n in range(30):
        open_ = np.flatnonzero(np.isin(cell, asked[n]))
        full = [sum(t[0][c] for t, c in zip(codes.tables(q[n:n + 1], cell[o]), code[o])) for o in open_]
        assert np.allclose(np.sort(rough[i == n]), np.sort(full)[:50]) and np.isin(j[i == n], open_).all()
