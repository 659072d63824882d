"""Rank correlations of scores: their neighbour joins run once, and references are sent to few tasks."""

import numpy as np
from test_operators import frame

from plumbline.operators import pivot_join as J
from plumbline.plans import evaluate as E


def test_the_neighbour_join_runs_once(spark, monkeypatch):
    r = np.random.default_rng(4)
    real, gen = frame(spark, r.normal(size=(40, 4))), frame(spark, r.normal(size=(30, 4)))
    scored = gen.selectExpr("*", *[f"features[{i}] as {name}" for i, name in enumerate(E.SCORES)])
    rows, authenticity = spark.sparkContext.accumulator(0), E.authenticity

    def counted(real, gen):
        out = authenticity(real, gen)

        def run(batches):
            for batch in batches:
                rows.add(batch.num_rows)
                yield batch

        return out.mapInArrow(run, out.schema)

    plain = sorted(map(tuple, E.metric_correlations(scored, real, gen).collect()))
    monkeypatch.setattr(E, "authenticity", counted)
    assert sorted(map(tuple, E.metric_correlations(scored, real, gen).collect())) == plain and len(plain) == 4
    assert rows.value == 30


def test_salts_are_counted_over_all_regions(spark):
    """SALTS tasks in all, not in each region; a salt is at most as large as a region."""
    forest = {"g": J.Tree(np.random.default_rng(5).normal(size=(40, 8)))}
    asking = spark.createDataFrame([("g", leaf, 4096) for leaf in range(10)], "grp string, leaf int, n bigint")
    assert J.salt_blocks(asking, forest, 64) == J.REGION_BLOCKS
    assert J.salt_blocks(asking, forest, 256) == 5.0 and J.salt_blocks(asking.limit(1), forest, 64) == 2.0
    assert J.salt_blocks(asking.limit(0), {}, 64) == 1.0
    wide = {"g": J.Tree(np.random.default_rng(5).normal(size=(4, 1 << 16)))}
    assert J.salt_blocks(asking, wide, 64) == J.SALT_BLOCKS
