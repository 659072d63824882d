"""Attributes and mixtures with more values than one broadcast: equal to the dense path, nothing refused."""

import numpy as np
import pytest

from plumbline.operators import scoring
from plumbline.session import BLOCK_ROWS, BROADCAST_BYTES


def rows_of(spark, n, values, width=6, seed=8):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(values, width)) * 2
    a = r.integers(0, values, n)
    x = centres[a] + r.normal(size=(n, width)) * 0.3
    rows = [(i, int(v) if i % 50 else None, z.tolist()) for i, (v, z) in enumerate(zip(a, x))]
    return spark.createDataFrame(rows, "sample_id bigint, a int, features array<double>")


@pytest.mark.parametrize("rows", [2048, 16])
def test_margins_by_join_as_dense(spark, limits, rows):
    real, gen = rows_of(spark, 900, 60), rows_of(spark, 300, 70, seed=9)

    def scored():
        model = scoring.fit_components(real, ["a"])
        table = scoring.model_table(real, model)
        got = {r.sample_id: (r.realism_z, r.faithfulness_z, r.margin_a) for r in scoring.score_from_components(gen, model, keep_margins=True).collect()}
        return model, got, sorted((r.scope, r.value or "", r["mean"]) for r in table.collect())

    dense, want, table = scored()
    limits(BROADCAST_BYTES, 400)
    limits(BLOCK_ROWS, rows)
    many, got, again = scored()
    assert dense.attributes["a"].table is None and many.attributes["a"].table is not None
    assert many.attributes["a"].n_values == dense.attributes["a"].n_values == 60
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-7) for i in want)
    assert [t[:2] for t in again] == [t[:2] for t in table] and np.allclose([t[2] for t in again], [t[2] for t in table], atol=1e-8)


@pytest.mark.parametrize("least", [10, 10_000])
def test_mixture_by_join_as_dense(spark, limits, least):
    real, gen = rows_of(spark, 900, 60), rows_of(spark, 200, 60, seed=9)
    one = scoring.fit_mixture(real, ["a"], min_samples=least)
    want = {r.sample_id: r.mixture_z for r in scoring.mixture_realism(gen, one).collect()}
    limits(BROADCAST_BYTES, 400)
    two = scoring.fit_mixture(real, ["a"], min_samples=least)
    assert (two.table is not None) == (least == 10)
    got = {r.sample_id: r.mixture_z for r in scoring.mixture_realism(gen, two).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-7) for i in want) and len(got) == 200


def test_a_hundred_thousand_values(spark, limits):
    """Every row's own value is its nearest mean here, so all margins are negative; no step sees all means at once."""
    limits(BROADCAST_BYTES, 1 << 20)
    n = 100_000
    from pyspark.sql import functions as F

    angle = F.col("a") * F.lit(2 * np.pi / n)
    rows = spark.range(2 * n).select(F.col("id").alias("sample_id"), (F.col("id") % n).cast("int").alias("a")).withColumn("features", F.array(F.cos(angle), F.sin(angle), F.cos(angle * 7), F.sin(angle * 7)))
    fit = scoring.fit_attribute(rows, "a")
    assert fit.table is not None and fit.n_values == n
    got = scoring.add_margin(rows, fit).agg(F.count("margin"), F.max("margin")).first()
    assert got[0] == 2 * n and got[1] < 0
