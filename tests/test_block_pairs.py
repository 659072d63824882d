"""Pairs of blocks inside groups: how often rows are sent, and that their sums stay whole."""

import numpy as np
import pytest
from test_operators import frame

from plumbline.operators import distances
from plumbline.session import BLOCK_ROWS


def test_a_row_is_sent_to_a_bounded_number_of_blocks(spark, limits, monkeypatch):
    """However large its group is: all pairs of rows, every unordered one once."""
    limits(BLOCK_ROWS, 4)
    x = np.random.default_rng(0).normal(size=(400, 3))
    rows = frame(spark, x, a=np.zeros(400, int))
    got = distances._block_pairs(rows, rows, ["a"], 4, True).select("lb", "rb", "lm", "rm").collect()
    n = distances.SIDES
    assert len(got) == n * (n + 1) // 2 and all(r.lb <= r.rb for r in got)
    assert sum(r.lm * r.rm if r.lb < r.rb else r.lm * (r.lm - 1) // 2 for r in got) == 400 * 399 // 2
    monkeypatch.setattr(distances, "SIDE_BYTES", 20 * 8 * 3)  # blocks stay bounded beyond
    assert len({r.lb for r in distances._block_pairs(rows, rows, ["a"], 4, True).collect()}) == 20


def test_sums_over_sides_are_those_over_all_pairs(spark, limits):
    limits(BLOCK_ROWS, 4)
    r = np.random.default_rng(1)
    x, y = r.normal(size=(203, 3)), r.normal(size=(90, 3))
    a, b, bins = np.where(np.arange(203) < 200, 0, 1), np.where(np.arange(90) < 60, 0, 1), np.arange(90) % 3
    many = frame(spark, x, a=a)
    gaps = np.linalg.norm(x[:200, None] - x[None, :200], axis=2)[np.triu_indices(200, 1)]
    width = np.median(gaps)
    assert distances.median_pair_distance(many.where("a = 0"), ["a"]).first()["median_distance"] == pytest.approx(width, rel=1e-9)
    got = {(row["a"], row["bin"]): row for row in distances.rbf_mmd(frame(spark, y, a=b, bin=bins), many, ["a"], min_real=3).collect()}
    assert len(got) == 6 and got[0, 1]["n_real"] == 200 and got[1, 2]["n_real"] == 3

    def k(p, q, w):
        return np.exp(-(np.linalg.norm(p[:, None] - q[None], axis=2) ** 2) / (2 * w**2)).mean()

    few = x[200:]
    widths = {0: width, 1: np.median(np.linalg.norm(few[:, None] - few[None], axis=2)[np.triu_indices(3, 1)])}
    for (c, v), row in got.items():
        g, ref = y[(b == c) & (bins == v)], x[a == c]
        assert row["mmd2"] == pytest.approx(k(g, g, widths[c]) + k(ref, ref, widths[c]) - 2 * k(g, ref, widths[c]), abs=1e-9)
