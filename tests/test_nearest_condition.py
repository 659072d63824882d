"""Nearest conditions over many attributes against a comparison of all pairs."""

from itertools import product

import numpy as np
import pytest

from plumbline.operators import conditions as C


def brute(left, right, ties):
    out = set()
    for w in set(left):
        gaps = sorted((sum(a != b for a, b in zip(w, u)), tuple((x is not None, x if x is not None else 0) for x in u), u) for u in set(right))
        out |= {(w, u, d) for d, _, u in gaps if d == gaps[0][0]} if ties else {(w, gaps[0][2], gaps[0][0])}
    return out


def ask(spark, left, right, n, ties):
    attrs = [f"c{i}" for i in range(n)]
    schema = ", ".join(f"{a} int" for a in attrs)
    got = C.nearest_condition(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), attrs, ties)
    assert got.columns == [*attrs, *[f"near_{a}" for a in attrs], "hamming"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return {(r[:n], r[n:2 * n], r[-1]) for r in rows}


@pytest.mark.parametrize("n, ties", [(3, False), (3, True), (12, False), (12, True), (40, False)])
def test_as_all_pairs(spark, n, ties):
    r = np.random.default_rng(n)
    right = [tuple(int(x) for x in row) for row in r.integers(0, 3, size=(60, n))]
    left = [tuple(int(x) for x in row) for row in r.integers(0, 3, size=(8, n))]
    for moves in (0, 1, 2, 5):  # near ones, also one reached from two sides, and one that agrees nowhere
        row = list(right[moves])
        for i in range(min(moves, n)):
            row[i] = (row[i] + 1) % 3
        left.append(tuple(row))
    left += [left[0], *[(9,) * n] * (n < 40)]
    assert ask(spark, left, right, n, ties) == brute(left, right, ties)


@pytest.mark.parametrize("n", [2, 10])
def test_nulls_agree_with_nulls_and_places_count(spark, n):
    rest = (5,) * (n - 2)
    left, right = [(None, 1, *rest), (1, None, *rest)], [(1, None, *rest), (7, 7, *rest)]
    assert ask(spark, left, right, n, True) == brute(left, right, True)


def test_without_usable_conditions(spark):
    assert ask(spark, [(1,) * 10], [], 10, False) == set()


@pytest.mark.parametrize("n", [9, 14])
def test_conditions_within_the_radius_share_a_choice(n):
    sizes = {f"c{i}": i + 1 for i in range(n)}
    for radius in C.radii(n):
        blocks, choices = C.agreeing_choices(sizes, radius, 40)
        assert len(choices) <= max(40, radius + 1) and blocks <= n
        for off in list(product([0, 1], repeat=n))[:: 37]:
            if sum(off) <= radius:
                differ = {f"c{i}" for i in range(n) if off[i]}
                assert any(not differ & set(c) for c in choices)


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("candidate", [0, 10**9])
def test_keyed_rounds_and_blocks_of_pairs_agree(spark, monkeypatch, ties, candidate):
    monkeypatch.setattr(C, "CANDIDATE", candidate)
    monkeypatch.setattr(C, "BLOCK", 16)
    r = np.random.default_rng(2)
    right = [tuple(None if x == 4 else int(x) for x in row) for row in r.integers(0, 5, size=(50, 70))]
    left = [tuple(None if x == 4 else int(x) for x in row) for row in r.integers(0, 5, size=(20, 70))] + right[:3]
    assert ask(spark, left, right, 70, ties) == brute(left, right, ties)


def test_far_conditions_are_not_joined_on_keys(spark, monkeypatch):
    """Random signs are far apart: more candidates share a key than there are pairs."""
    r = np.random.default_rng(3)
    left, right = ([tuple(int(x) for x in row) for row in r.integers(0, 2, size=(150, 40))] for _ in range(2))
    asked = []
    monkeypatch.setattr(C, "agreement_keys", lambda attrs, choices, *a, keys=C.agreement_keys: (asked.append(len(choices[0])), keys(attrs, choices, *a))[1])
    assert ask(spark, left, right, 40, False) == brute(left, right, False)
    assert min(asked) >= 30
