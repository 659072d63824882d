"""Steps that are made once or in slices: bootstrap draws, votes of several k, pairs of a kernel sample."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import distances, neighbors, sampling


def test_bootstrap_draws_are_hashed_once(spark):
    df = spark.range(200).select(F.col("id").alias("sample_id"))
    rows = sampling.poisson_reps(df, 3, 7, "sample_id")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    plain = sampling.with_reps(df, 3).withColumn("_w", sampling.poisson_weight(sampling.unit_draw(7, F.col("rep"), "sample_id"))).where("_w > 0")
    assert sorted(map(tuple, rows.select("sample_id", "rep", "_w").collect())) == sorted(map(tuple, plain.select("sample_id", "rep", "_w").collect()))


def test_votes_of_several_k_share_their_neighbours(spark):
    near = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 11, 1), (2, 10, 2)], "query_id int, ref_id int, rank int")
    labels = spark.createDataFrame([(10, 5), (11, 3), (12, 3)], "sample_id int, label int")
    got = neighbors.neighbor_votes(near, labels, "label", [1, 2, 3])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 5), (1, 2, 3), (1, 3, 3), (2, 1, 3), (2, 2, 3), (2, 3, 3)]
    one = neighbors.neighbor_vote(near, labels, "label", 2)
    assert sorted(map(tuple, one.collect())) == [(1, 3), (2, 3)]


def test_pairs_of_a_sample_take_little_memory():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(2, distances.PAIR_ROWS // 2, 16))
    tracemalloc.start()
    got = distances.cubic_mmd(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    u, v = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    kxx, kyy, kxy = ((a @ b.T + 1.0) ** 3 for a, b in ((u, u), (v, v), (u, v)))
    m = len(x)
    want = (kxx.sum() - np.trace(kxx) + kyy.sum() - np.trace(kyy)) / (m * (m - 1)) - 2 * kxy.sum() / m**2
    assert abs(got - want) < 1e-9 and peak < 32 << 20


def test_large_samples_meet_before_their_maps_are_sent(spark, monkeypatch):
    seen = []
    plain = distances._feature_map_sums
    monkeypatch.setattr(distances, "_feature_map_sums", lambda df, *more: seen.append(df) or plain(df, *more))
    rows = spark.range(0, 400, 1, 20).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 4 < 2, "a").otherwise("x").alias("side"), F.array(*[F.xxhash64("id", F.lit(i)) % 100 / 100.0 for i in range(3)]).alias("features"))
    large = distances.kid_of_sides(rows, ["g"], {"kid": ("a", "x")}, most=distances.PAIR_ROWS + 1).orderBy("g").collect()
    tasks = seen[0].select("g", "side", F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == 4  # one map per group and side, whatever the number of tasks before
    small = distances.kid_of_sides(rows, ["g"], {"kid": ("a", "x")}, most=100).orderBy("g").collect()
    assert [round(r.kid, 9) for r in large] == [round(r.kid, 9) for r in small]
