"""Closed forms, brute force, size-limit paths and invariants on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import bounds, conditions, distances, effects, features, moments, neighbors, pairing, prefix, probes, ranking
from plumbline.operators import sampling, scoring, selection, summaries
from plumbline.session import BLOCK_ROWS, BROADCAST_BYTES, MAX_PIVOTS, WINDOW_ROWS
from plumbline.sources import shards, tables
from plumbline.streaming import gate


def frame(spark, x, **cols):
    rows = [(i, *[int(c[i]) for c in cols.values()], [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, " + "".join(f"{c} int, " for c in cols) + "features array<double>")


def unit(x):
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def lw_reference(x):
    """Ledoit-Wolf by its definition, one row at a time."""
    x = x - x.mean(0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() / p for r in x) / n**2, d2)
    return b2 / d2


@pytest.fixture(scope="module")
def blobs():
    """Rows of a skewed mixture: one condition holds a third of all rows."""
    rng = np.random.default_rng(0)
    a = np.r_[np.zeros(200, int), rng.integers(0, 3, 400)]
    b = rng.integers(0, 4, 600)
    b[:200] = 1
    centres = rng.normal(size=(3, 4, 6))
    x = centres[a, b] + 0.4 * rng.normal(size=(600, 6))
    return x, a, b


def test_scores_match_numpy(spark, blobs):
    x, a, b = blobs
    df = frame(spark, x, a=a, b=b)
    model = scoring.fit_components(df, ["a", "b"])
    u = unit(x)
    cov, alpha = np.cov(u.T, bias=True), lw_reference(u)
    assert model.overall.shrinkage == pytest.approx(alpha, rel=1e-9)
    shrunk = (1 - alpha) * cov + alpha * np.trace(cov) / 6 * np.eye(6) + 1e-5 * np.eye(6)
    p = np.linalg.inv(shrunk)
    assert np.allclose(model.overall.precision, p, rtol=1e-7)
    c = u - u.mean(0)
    energy = np.einsum("nd,de,ne->n", c, p, c)
    margins = []
    for y in (a, b):
        mus = np.stack([u[y == v].mean(0) for v in np.unique(y)])
        r = u - mus[y]
        al = lw_reference(r)
        s = r.T @ r / len(r)
        q = np.linalg.inv((1 - al) * s + al * np.trace(s) / 6 * np.eye(6) + 1e-5 * np.eye(6))
        e = np.stack([np.einsum("nd,de,ne->n", u - m, q, u - m) for m in mus], axis=1)
        own = e[np.arange(600), y]
        e[np.arange(600), y] = np.inf
        margins.append(own - e.min(1))
    z = [(m - m.mean()) / m.std(ddof=1) for m in (energy, *margins)]
    got = scoring.score_from_components(df, model).orderBy("sample_id").select("realism_z", "faithfulness_z", "trust").collect()
    assert np.allclose([r[0] for r in got], z[0], atol=1e-8)
    assert np.allclose([r[1] for r in got], (z[1] + z[2]) / 2, atol=1e-8)
    assert np.allclose([r[2] for r in got], z[0] + (z[1] + z[2]) / 2, atol=1e-8)


def test_value_blocks_give_the_same_margins(spark, blobs, limits):
    x, a, b = blobs
    df = frame(spark, x, a=a, b=b)
    whole = scoring.score_from_components(df, scoring.fit_components(df, ["a", "b"])).orderBy("sample_id").select("trust").collect()
    limits(BROADCAST_BYTES, 2 * 8 * 6)  # two means per block
    model = scoring.fit_components(df, ["a", "b"])
    assert len(model.attributes["b"].blocks) == 2
    parts = scoring.score_from_components(df, model).orderBy("sample_id").select("trust").collect()
    assert np.allclose([r[0] for r in whole], [r[0] for r in parts], atol=1e-8)


def test_unknown_value_keeps_a_zero_margin_that_is_scored(spark, blobs):
    x, a, b = blobs
    model = scoring.fit_components(frame(spark, x, a=a, b=b), ["a"])
    row = scoring.score_from_components(frame(spark, x[:1], a=[9]), model).first()
    fit = model.attributes["a"]
    assert row["faithfulness_z"] == pytest.approx((0.0 - fit.mean) / (fit.std + 1e-12))


def test_few_rows_give_the_ridge_precision(spark):
    x = np.random.default_rng(1).normal(size=(5, 8))
    fit = scoring.fit_components(frame(spark, x, a=[0, 0, 1, 1, 1]), ["a"]).attributes["a"]
    assert np.allclose(fit.precision, np.eye(8) / (1e-5 + 1e-3))


def test_l_shape_separates_realism_from_faithfulness(spark):
    """Three clusters at (0,0), (0,1), (1,0); rows near the unseen corner are unreal, wrongly labelled ones unfaithful."""
    rng = np.random.default_rng(3)
    corners = np.array([[0, 0], [0, 1], [1, 0]])
    lab = np.repeat(corners, 400, axis=0)
    x = np.c_[lab + 0.18 * rng.normal(size=(1200, 2)), np.ones(1200)]
    model = scoring.fit_components(frame(spark, x, a=lab[:, 0], b=lab[:, 1]), ["a", "b"])
    probe = np.array([[0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [1.0, 1.0, 1.0]])
    got = scoring.score_from_components(frame(spark, probe, a=[0, 0, 1], b=[0, 0, 1]), model).orderBy("sample_id").collect()
    assert got[0]["trust"] < got[1]["trust"] and got[0]["trust"] < got[2]["trust"]
    assert got[1]["faithfulness_z"] > got[0]["faithfulness_z"]
    assert got[2]["realism_z"] > got[0]["realism_z"]


def test_registry_rejects_unknown_names(spark):
    with pytest.raises(ValueError):
        scoring.score("nope", None, None, [])


# ---- size-limit paths ----------------------------------------------------------------------------


def test_range_path_ranks_like_the_window(spark, limits):
    """Hot key and hot value: a third of the rows each."""
    rows = [(i, 0 if i % 3 else i % 5, float(i % 4 if i % 2 else 7)) for i in range(900)]
    df = spark.createDataFrame(rows, "sample_id long, k int, s double")
    order = [F.col("s"), F.col("sample_id")]
    want = {tuple(r) for r in prefix.rank_rows(df, order, ["k"]).select("sample_id", "rn").collect()}
    want_all = {tuple(r) for r in prefix.rank_rows(df, order).select("sample_id", "rn").collect()}
    limits(WINDOW_ROWS, 2)
    assert {tuple(r) for r in prefix.rank_rows(df, order, ["k"]).select("sample_id", "rn").collect()} == want
    assert {tuple(r) for r in prefix.rank_rows(df, order).select("sample_id", "rn").collect()} == want_all


def test_range_path_percentiles(spark, limits):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([(int(i % 3), float(s)) for i, s in enumerate(v)], "k int, s double")
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    limits(WINDOW_ROWS, 2)
    got = prefix.percentiles(df, "s", probs, ["k"]).collect()
    for r in got:
        assert np.allclose(r["pct"], np.quantile(v[r["k"] :: 3], probs))
    assert np.allclose(prefix.percentiles(df, "s", probs).first()["pct"], np.quantile(v, probs))


@pytest.mark.parametrize("rows,pivots", [(2048, 512), (16, 512), (16, 3)])
def test_knn_is_exact_for_every_block_layout(spark, blobs, limits, rows, pivots):
    x, a, b = blobs
    x = x.copy()
    x[50:60] = x[50]  # copies
    limits(BLOCK_ROWS, rows)
    limits(MAX_PIVOTS, pivots)
    q, r = frame(spark, x[:150]), frame(spark, x)
    d = np.linalg.norm(x[:150, None] - x[None], axis=2)
    got = neighbors.knn_join(q, r, 4).orderBy("query_id", "rank").collect()
    want = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :4]
    assert np.allclose([g["distance"] for g in got], np.take_along_axis(d, want, 1).ravel(), atol=1e-12)
    assert [g["ref_id"] for g in got] == want.ravel().tolist()
    loo = neighbors.knn_join(r, r, 1, exclude_self=True).orderBy("query_id").collect()
    full = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(full, np.inf)
    assert np.allclose([g["distance"] for g in loo], full.min(1), atol=1e-12)


@pytest.mark.parametrize("rows", [2048, 16])
def test_range_join_and_beta_recall(spark, blobs, limits, rows):
    x, _, _ = blobs
    limits(BLOCK_ROWS, rows)
    real, gen = x[:200], x[200:350]
    got = neighbors.beta_recall(frame(spark, real), frame(spark, gen), [0.0, 0.3, 1.0], 3).orderBy("beta").collect()
    r, g = unit(real), unit(gen)
    dr = np.sort(np.linalg.norm(r[:, None] - r[None], axis=2), axis=1)[:, 3]
    dg = np.linalg.norm(g - g.mean(0), axis=1)
    cross = np.linalg.norm(r[:, None] - g[None], axis=2)
    for row, beta in zip(got, [0.0, 0.3, 1.0]):
        typical = dg <= np.quantile(dg, beta)
        assert row["recall"] == pytest.approx((cross[:, typical].min(1) <= dr).mean())


@pytest.mark.parametrize("rows", [2048, 16])
def test_class_knn_small_classes_and_fallback(spark, blobs, limits, rows):
    x, a, _ = blobs
    limits(BLOCK_ROWS, rows)
    a = a.copy()
    a[:3] = [7, 8, 8]  # classes of one and two rows
    query_class = np.r_[np.full(5, 7), np.full(5, 8), np.full(5, 99), np.zeros(5, int)]
    got = {r[0]: r[1] for r in neighbors.class_knn(frame(spark, x[300:320], a=query_class), frame(spark, x, a=a), "a", 5).collect()}
    u = unit(x)
    for i, c in enumerate(query_class):
        pool = u[a == c] if (a == c).any() else u
        k = min(5, max((a == c).sum() - 1, 1)) if (a == c).any() else 5
        assert got[i] == pytest.approx(np.sort(1 - pool @ u[300 + i])[k - 1], abs=1e-9)


def test_kid_feature_map_equals_pairs(spark, blobs):
    x, a, _ = blobs
    m = 180
    for mode in ("cosine", "standard"):
        got = distances.kid(frame(spark, x[:m]), frame(spark, x[m : 2 * m]), mode=mode).first()
        assert got["kid"] == pytest.approx(distances.cubic_mmd(x[:m], x[m : 2 * m], mode), abs=1e-9)
    assert distances.kid(frame(spark, x[:1]), frame(spark, x[1:2])).first()["kid"] is None


def test_cubic_mmd_contract():
    with pytest.raises(ValueError):
        distances.cubic_mmd(np.zeros((2, 3)), np.zeros((3, 3)))
    assert np.isnan(distances.cubic_mmd(np.ones((1, 3)), np.ones((1, 3))))


@pytest.mark.parametrize("rows", [2048, 16])
def test_rbf_and_median_by_blocks(spark, blobs, limits, rows):
    x, a, _ = blobs
    limits(BLOCK_ROWS, rows)
    real, gen = frame(spark, x[:60], a=a[:60] * 0), frame(spark, x[60:110], a=a[:50] * 0, bin=np.arange(50) % 2)
    pair = np.linalg.norm(x[:60, None] - x[None, :60], axis=2)[np.triu_indices(60, 1)]
    assert distances.median_pair_distance(real, ["a"]).first()["median_distance"] == pytest.approx(np.median(pair), rel=1e-9)
    got = {r["bin"]: r["mmd2"] for r in distances.rbf_mmd(gen, real, ["a"]).collect()}

    def k(p, q):
        return np.exp(-(np.linalg.norm(p[:, None] - q[None], axis=2) ** 2) / (2 * np.median(pair) ** 2)).mean()

    for v in (0, 1):
        g = x[60:110][np.arange(50) % 2 == v]
        assert got[v] == pytest.approx(k(g, g) + k(x[:60], x[:60]) - 2 * k(g, x[:60]), abs=1e-9)


def test_rbf_mmd_meets_real_rows_once_per_condition(spark, blobs, limits, monkeypatch):
    """Whatever the number of bins, and every unordered pair of blocks of the same rows once."""
    x, a, _ = blobs
    limits(BLOCK_ROWS, 20)
    met, pairs = [], distances._block_pairs
    monkeypatch.setattr(distances, "_block_pairs", lambda l, r, keys, rows, same: (met.append((list(keys), same)), pairs(l, r, keys, rows, same))[1])
    zero, five = np.zeros(60, int), np.arange(50) % 5
    real, gen = frame(spark, x[:60], a=zero), frame(spark, x[60:110], a=zero[:50], bin=five)
    got = {r["bin"]: r["mmd2"] for r in distances.rbf_mmd(gen, real, ["a"]).collect()}
    assert sorted(met) == [(["a"], True), (["a"], True), (["a", "bin"], False), (["a", "bin"], True)]
    gaps = np.linalg.norm(x[:60][:, None] - x[:60][None], axis=2)
    k = lambda p, q: np.exp(-(np.linalg.norm(p[:, None] - q[None], axis=2) ** 2) / (2 * np.median(gaps[np.triu_indices(60, 1)]) ** 2)).mean()
    for v in range(5):
        g = x[60:110][five == v]
        assert got[v] == pytest.approx(k(g, g) + k(x[:60], x[:60]) - 2 * k(g, x[:60]), abs=1e-9)


def test_correlation_matrix_blocks(spark, blobs, limits):
    x, _, _ = blobs
    limits(BLOCK_ROWS, 7)
    a = frame(spark, x[:20]).withColumnRenamed("features", "mu")
    b = frame(spark, x[20:45]).withColumnRenamed("features", "mu")
    got = effects.correlation_matrix(a, b, ["sample_id"], ["sample_id"]).collect()
    assert len(got) == 500
    for r in got[:50]:
        want = np.corrcoef(x[r["l_sample_id"]], x[20 + r["r_sample_id"]])[0, 1]
        assert r["corr"] == pytest.approx(want)


# ---- statistics ----------------------------------------------------------------------------------


def test_frechet_of_known_gaussians():
    a, b = np.diag([1.0, 4.0]), np.diag([9.0, 1.0])
    assert distances.frechet(np.zeros(2), a, np.array([3.0, 0.0]), b) == pytest.approx(9 + (1 - 3) ** 2 + (2 - 1) ** 2)


def test_whitening_gives_identity(spark, blobs):
    x, _, _ = blobs
    w = moments.whiten(frame(spark, x), frame(spark, x), kappa=1e12).select("whitened").collect()
    assert np.allclose(np.cov(np.array([r[0] for r in w]).T), np.eye(6), atol=1e-6)


def test_pca_and_effective_rank(spark, blobs):
    x, _, _ = blobs
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    got = np.array([r[0] for r in moments.pca_project(frame(spark, x), frame(spark, x), 2).orderBy("sample_id").select("projected").collect()])
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T), atol=1e-8)
    share = s / s.sum()
    assert moments.effective_rank(frame(spark, x)) == pytest.approx(np.exp(-(share * np.log(share)).sum()))


def test_p_values_against_tables(spark):
    """t = 2.228 with 10 degrees and t = 2.086 with 20 degrees of freedom are the 5% points."""
    rows = [(t / np.sqrt(t * t + nu), nu + 2) for t, nu in ((2.228, 10), (2.086, 20))]
    got = ranking.with_p_values(spark.createDataFrame([(float(r), int(n)) for r, n in rows], "spearman double, n int")).collect()
    assert [r["spearman_p"] for r in got] == pytest.approx([0.05, 0.05], abs=2e-4)


def test_detection_edge_cases(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 0), (float("nan"), 1), (None, 1)], "s double, y int")
    row = ranking.detection_summary(df, "s", "y").first()
    assert (row["n_pos"], row["auroc"], row["auprc"]) == (0, None, None)
    tied = spark.createDataFrame([(1.0, 0), (1.0, 1)], "s double, y int")
    assert ranking.detection_summary(tied, "s", "y").first()["auroc"] == 0.5


def test_ridge_r2_from_moments(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = x @ rng.normal(size=(4, 3)) + 0.1 * rng.normal(size=(300, 3))
    row = distances.cross_space_predictability(frame(spark, x), frame(spark, y), 2).first()
    assert row["r2_b_from_a"] > 0.95 and row["n_paired"] == 300


def test_enclosing_ball_of_two_points_is_the_midpoint():
    p = np.array([[2.0, 0.3], [0.3, 1.0]])
    rows = np.array([[0.0, 0.0], [2.0, 1.0]])
    centre, radius = bounds.smallest_ball(rows, p)
    assert np.allclose(centre, rows.mean(0), atol=1e-6)
    assert radius == pytest.approx(bounds.lengths((rows[1] - rows[0])[None], p)[0] / 2)


def test_bound_certifies_signs(spark, blobs):
    x, a, b = blobs
    df = frame(spark, x, a=a, b=b)
    row = bounds.bound_audit(df, df, "a", ["b"], min_ref=2).first()
    for kind in bounds.KINDS:
        if row[f"informative_{kind}"] > 0:
            assert row[f"sign_agreement_{kind}"] == 1.0
    assert row["informative_pair"] >= row["informative_val"] >= row["informative_pooled"]


# ---- draws, subsets, shards ----------------------------------------------------------------------


def test_matched_draw_repeats_only_short_pools(spark):
    pool = spark.createDataFrame([(0, i) for i in range(3)] + [(1, i) for i in range(10, 40)], "a int, sample_id long")
    want = spark.createDataFrame([(0, 8), (1, 8), (2, 5)], "a int, n_want long")
    got = sampling.matched_draw(want, pool, ["a"]).collect()
    by = {v: [r["sample_id"] for r in got if r["a"] == v] for v in (0, 1, 2)}
    assert len(by[0]) == 8 and set(by[0]) <= {0, 1, 2}
    assert len(by[1]) == len(set(by[1])) == 8
    assert by[2] == []


def test_half_split_is_disjoint_and_even(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(51)], "sample_id long, a int")
    rows = sampling.half_split(df, ["a"], 2).collect()
    for rep in (0, 1):
        for a in (0, 1):
            s = {side: {r["sample_id"] for r in rows if (r["rep"], r["a"], r["side"]) == (rep, a, side)} for side in "AB"}
            assert not s["A"] & s["B"] and len(s["A"]) == len(s["B"])


def test_binning_loses_no_rows(spark, blobs):
    x, a, _ = blobs
    df = frame(spark, x, a=a).withColumn("score", F.col("features")[0])
    assert ranking.bin_within(df, ["a"], 7).count() == 600


def test_bins_of_large_groups_equal_window_bins(spark, blobs, limits):
    x, a, _ = blobs
    df = frame(spark, x, a=a).withColumn("score", F.round(F.col("features")[0], 1))
    want = {(r["sample_id"], r["bin"]) for r in ranking.bin_within(df, ["a"], 7).collect()}
    limits(WINDOW_ROWS, 3)
    assert {(r["sample_id"], r["bin"]) for r in ranking.bin_within(df, ["a"], 7).collect()} == want


def test_random_scores_are_flat_over_bins(spark, blobs):
    x, a, _ = blobs
    df = ranking.random_scores(frame(spark, x, a=a))
    means = [r[0] for r in ranking.bin_within(df, ["a"], 3, "random_score").groupBy("bin").agg(F.avg(F.col("features")[0])).select("avg(features[0])").collect()]
    assert max(means) - min(means) < 0.5


def test_dedupe_of_a_very_frequent_vector(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0 if i % 3 else 3.0 + 1e-9 * i]) for i in range(3000)], "sample_id long, features array<double>")
    assert sorted(r[0] for r in summaries.dedupe_vectors(df).select("sample_id").collect())[:2] == [0, 1]
    stats = summaries.dedupe_stats(df).first()
    assert (stats["original_n"], stats["n_removed"]) == (3000, 3000 - stats["deduped_n"])


def test_empty_seen_set_keeps_all(spark, blobs):
    x, a, _ = blobs
    df = frame(spark, x, a=a)
    assert conditions.filter_seen(df, None, ["a"]).count() == conditions.filter_seen(df, df.limit(0), ["a"]).count() == 600


def test_shard_checks(spark):
    index = spark.createDataFrame([("s", 0), ("s", 1)], "signature string, local_idx int")
    twice = spark.createDataFrame([("s", 0, 1.0), ("s", 0, 2.0)], "signature string, local_idx int, v double")
    with pytest.raises(ValueError):
        shards.consolidate_shards(twice, index, ["signature", "local_idx"])
    names = spark.range(4).withColumnRenamed("id", "sample_id")
    with pytest.raises(ValueError):
        shards.merge_shards([names.limit(2)], names)


def test_alignment_is_checked_on_all_rows(spark):
    a = spark.range(300).select(F.col("id").alias("sample_id"), F.lit(0).alias("a"))
    with pytest.raises(ValueError):
        pairing.require_alignment(a, a.withColumn("a", F.when(F.col("sample_id") == 299, 1).otherwise(0)), ["a"])
    pairing.require_alignment(a, a, ["a"])


def test_loo_anchor_is_near_one(spark, blobs):
    x, a, b = blobs
    row = effects.loo_anchor(frame(spark, x, a=a, b=b), ["a", "b"]).first()
    assert row["ratio"] == pytest.approx(1.0, abs=0.1) and abs(row["z"]) < 0.3


# ---- sources, sinks, streams ---------------------------------------------------------------------


def test_sinks_round_trip(spark, tmp_path, blobs):
    x, a, _ = blobs
    df = frame(spark, x[:20], a=a[:20])
    for fmt in ("parquet", "json", "csv"):
        tables.write_result(df, str(tmp_path / fmt), fmt)
    assert tables.read_vectors(spark, str(tmp_path / "parquet"), ["a"]).count() == 20
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == 20
    with pytest.raises(ValueError):
        tables.write_result(df, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        tables.read_vectors(spark, str(tmp_path / "parquet"), ["missing"])


def test_wide_csv_keeps_parsable_complete_rows(spark, tmp_path):
    path = tmp_path / "image.csv"
    path.write_text("FileName_DATA,m1,m2,extra\ncell0_sirna5_1.png,1.5,2,x\ncell1_sirna6_2.png,,2,x\nplate.png,1,2,x\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("FileName_DATA", T.StringType()), T.StructField("m1", T.DoubleType()), T.StructField("m2", T.DoubleType()), T.StructField("extra", T.StringType())])
    rows = tables.read_wide_csv(spark, str(path), schema, ["FileName_DATA", "m1", "m2"])
    out = tables.parse_condition_key(rows, "FileName_DATA", ["cell_type_id", "sirna_id", "sample_idx"]).collect()
    assert [(r["cell_type_id"], r["sirna_id"], r["m1"]) for r in out] == [(0, 5, 1.5)]


def test_scores_json_turns_nan_to_null(spark, tmp_path):
    path = tmp_path / "scores.json"
    path.write_text('{"sample_id": "s0", "trust": 1.5, "realism_z": NaN}\n{"sample_id": "s1"}\n')
    rows = tables.read_scores(spark, str(path)).orderBy("sample_id").collect()
    assert (rows[0]["trust"], rows[0]["realism_z"], rows[1]["trust"]) == (1.5, None, None)


def test_attribute_map_joins_tokens(spark):
    df = spark.createDataFrame([("d/Male0_Smiling1_Blond_Hair0_Eyeglasses1_101.png",)], "path string")
    assert df.select(tables.parse_attribute_map("path")).first()[0] == {"Male": 0, "Smiling": 1, "Blond_Hair": 0, "Eyeglasses": 1}


def test_stream_scores_equal_batch_scores(spark, tmp_path, blobs):
    x, a, b = blobs
    df = frame(spark, x, a=a, b=b)
    model = scoring.fit_components(df, ["a", "b"])
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    s = gate.score_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), model, 0.5)
    q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["sample_id"]: (r["trust"], r["decision"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = scoring.score_from_components(df, model).collect()
    assert len(got) == 600
    for r in want:
        assert got[r["sample_id"]][0] == pytest.approx(r["trust"])
        assert got[r["sample_id"]][1] == ("accept" if r["trust"] <= 0.5 else "abstain")


# ---- selection and classifiers -------------------------------------------------------------------


def test_selection_prefers_real_looking_rows(spark):
    """A third of the generated rows points elsewhere; acceptance drops them and lowers the distance."""
    rng = np.random.default_rng(7)
    a = np.arange(240) % 2
    centre = np.array([[5.0, 0, 0, 0, 0], [0, 5.0, 0, 0, 0]])[a]
    real = centre + 0.3 * rng.normal(size=(240, 5))
    gen = centre + 0.3 * rng.normal(size=(240, 5))
    gen[::3] += np.array([0, 0, 4.0, -4.0, 0])
    rf, gf = frame(spark, real, a=a), frame(spark, gen, a=a)
    model = scoring.fit_components(rf, ["a"])
    rs, gs = (scoring.score_from_components(t, model) for t in (rf, gf))
    row = selection.global_selection(gs, rs, gf, rf, ["a"], [95], n_boot=3, n_rand=3).first()
    assert row["n_accepted"] < 240 and row["delta"] > 0
    cond = selection.per_condition_selection(gs, rs, gf, rf, ["a"], 95, reps=3).collect()
    assert len(cond) == 2 and all(r["delta"] > 0 for r in cond)


def test_logistic_reaches_the_known_optimum(spark):
    """C*sum(loss) + |w|^2/2 with free intercept: the gradient vanishes at the fit."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 3))
    y = (x @ np.array([1.0, -2.0, 0.5]) + rng.normal(size=200) > 0).astype(int)
    m = probes.fit_logistic(frame(spark, x, y=y), "y")
    p = 1 / (1 + np.exp(-(x @ m.weights[:, 0] + m.intercepts[0])))
    assert np.allclose(x.T @ (p - y) + m.weights[:, 0], 0, atol=1e-2)
    assert (p - y).sum() == pytest.approx(0, abs=1e-2)
    got = probes.predict(frame(spark, x, y=y), m, label="y").orderBy("sample_id").collect()
    assert [r["predicted"] for r in got] == (p > 0.5).astype(int).tolist()


def test_gen_to_real_finds_separated_classes(spark, blobs):
    x, a, b = blobs
    row = probes.gen_to_real(frame(spark, x[::2] , a=a[::2]), frame(spark, x[1::2], a=a[1::2]), "a", max_iter=50).first()
    assert row["micro"] > 0.6


def test_constant_columns_are_no_features(spark):
    df = spark.createDataFrame([(1.0, float(i), 2.0 * i + 1e-3 * (i % 3)) for i in range(50)], "flat double, x double, y double")
    assert [r["feature"] for r in features.variance_outlier_filter(df, ["flat", "x", "y"]).collect()] == ["x", "y"]
    assert features.correlation_prune(df, ["x", "y"]) == ["x"]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "x array<double>, y array<double>")
    r = df.select(V.norm("x"), V.dot("x", "y"), V.cosine("x", "y"), V.logsumexp("x"), V.l1_distance("x", "y"), V.pearson("x", "x")).first()
    assert list(r) == pytest.approx([5, 8, 0.8, np.log(np.exp(3) + np.exp(4)), 5, 1])


def test_evaluate_gives_all_tables(spark):
    from plumbline.plans.evaluate import evaluate

    rng = np.random.default_rng(11)
    a, b = np.arange(300) % 2, (np.arange(300) // 2) % 2
    base = np.c_[4.0 * a, 4.0 * b, np.ones(300), np.zeros(300)]
    real = frame(spark, base + 0.4 * rng.normal(size=(300, 4)), a=a, b=b)
    gen = frame(spark, base + 0.5 * rng.normal(size=(300, 4)), a=a, b=b)
    seen = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "a int, b int")
    out = evaluate(real, gen, ["a", "b"], seen, n_bins=3, reps=2, null_reps=10)
    assert {"scores", "condition_ranking", "deciles", "acceptance", "global_selection", "seen_unseen_detection"} <= set(out)
    assert out["scores"].count() == 300 and out["condition_ranking"].count() == 4
    assert out["deciles"].count() == 3 and out["acceptance"].count() == 4
    assert [r["arm"] for r in out["condition_ranking"].orderBy("a", "b").collect()] == ["seen", "seen", "seen", "unseen"]


def test_percentiles_keep_the_null_key_at_any_limit(spark, limits):
    df = spark.createDataFrame([(k, float(i)) for k in ("a", None) for i in range(30)], "k string, v double")
    small = sorted(map(repr, prefix.percentiles(df, "v", [0.1, 0.5], ["k"]).collect()))
    limits(WINDOW_ROWS, 10)
    assert sorted(map(repr, prefix.percentiles(df, "v", [0.1, 0.5], ["k"]).collect())) == small and len(small) == 2


def test_bins_keep_an_id_in_two_groups_once_at_any_limit(spark, limits):
    df = spark.createDataFrame([(m, i, float(i * 7 % 100), "x") for m in ("p", None) for i in range(100)], "m string, sample_id bigint, score double, more string")
    small = sorted(map(repr, ranking.bin_within(df, ["m"], 4).collect()))
    limits(WINDOW_ROWS, 10)
    assert sorted(map(repr, ranking.bin_within(df, ["m"], 4).collect())) == small and len(small) == 200


def test_smallest_ball_against_random_centres():
    rng = np.random.default_rng(4)
    for n, d in ((1, 3), (2, 2), (6, 3), (40, 5)):
        points, half = rng.normal(size=(n, d)), rng.normal(size=(d, d))
        metric = half @ half.T + np.eye(d)
        centre, radius = bounds.smallest_ball(points, metric)
        assert bounds.lengths(points - centre, metric).max() == pytest.approx(radius, rel=1e-6, abs=1e-9)
        for scale in (1e-3, 1e-2, 0.1):
            assert all(bounds.lengths(points - centre - scale * rng.normal(size=d), metric).max() >= radius - 1e-7 for _ in range(50))
