"""Kernel distances of large samples and wide vectors: the feature map, in one or many index blocks, equals the pairs."""

import numpy as np
import pytest

from plumbline.operators import distances as D
from plumbline.operators import moments as M
from plumbline.session import WINDOW_ROWS


def frame(spark, n, seed, width=7, groups=2, shift=0.0):
    r = np.random.default_rng(seed)
    rows = [(i, int(i % groups), (r.normal(size=width) + shift).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id bigint, a int, features array<double>")


def table(df, keys, columns):
    return {tuple(r[k] for k in keys): [r[c] for c in columns] for r in df.collect()}


@pytest.mark.parametrize("mode", ["cosine", "standard"])
@pytest.mark.parametrize("size", [64 << 20, 700])
def test_large_samples_as_pairs(spark, limits, monkeypatch, mode, size):
    real, gen = frame(spark, 120, 1), frame(spark, 90, 2, shift=0.3)
    ask = lambda: (table(D.delta_kid(real, gen, ["a"], 3, mode=mode), ["a"], ["delta_kid", "base_kid", "gen_kid", "n_real"]), table(D.kid_null(real, ["a"], 12, mode=mode), ["a"], ["null_mean", "null_std"]))
    pairs = ask()
    monkeypatch.setattr(D, "PAIR_ROWS", 10)
    monkeypatch.setattr(D, "MAP_BYTES", size)
    limits(WINDOW_ROWS, 5)
    for got, want in zip(ask(), pairs):
        assert set(got) == set(want) and len(want) == 2
        assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_wide_vectors_in_index_blocks(spark, monkeypatch):
    x, y = frame(spark, 60, 3, 20), frame(spark, 50, 4, 20, shift=0.2)
    whole = table(D.kid(x, y, ["a"]), ["a"], ["n_x", "n_y", "kid"])
    monkeypatch.setattr(D, "MAP_BYTES", 8 * 20 * 20 * 3)
    cut = table(D.kid(x, y, ["a"]), ["a"], ["n_x", "n_y", "kid"])
    assert all(np.allclose(cut[k], whole[k]) for k in whole) and len(whole) == 2


def test_no_row_is_left_out_of_large_groups(spark):
    """More than 500 rows a side are all read: the distance of whole groups comes out, not that of a sample."""
    real, gen = frame(spark, 1400, 5, 4, 1), frame(spark, 700, 6, 4, 1, 0.4)
    got = D.delta_kid(real, gen, ["a"], 1).first()
    rows = {r.sample_id: r.features for r in real.collect()}
    import hashlib

    order = sorted(rows, key=lambda i: (hashlib.md5(f"43:0:{i}".encode()).hexdigest(), str(i)))
    a, b = (np.array([rows[i] for i in part]) for part in (order[:700], order[700:1400]))
    g = np.array([r.features for r in gen.collect()])
    assert got["gen_kid"] == pytest.approx(D.cubic_mmd(a, g)) and got["base_kid"] == pytest.approx(D.cubic_mmd(a, b))


def test_panel_reads_all_rows_and_has_its_deltas(spark):
    real, gen = frame(spark, 700, 7, 4, 1), frame(spark, 600, 8, 4, 1, 0.4)
    panel = D.metric_panel(gen, real, ["a"], 2)
    rows = panel.collect()
    assert [r["k"] for r in rows] == [600, 600]
    m = np.array([r.features for r in gen.collect()])
    assert M.collect_moments(gen, "features").n == 600 and all(r["mean_gap"] > 0.3 for r in rows) and m.shape == (600, 4)
    out = {r["metric"]: r for r in D.accepted_against_random(panel, D.metric_panel(gen, real, ["a"], 2, seed=7)).collect()}
    assert set(out) == set(D.PANEL)
    for name in D.PANEL:
        assert out[name]["accepted_mean"] == pytest.approx(np.mean([r[name] for r in rows]))
        assert out[name]["accepted_std"] == pytest.approx(np.std([r[name] for r in rows], ddof=1))
