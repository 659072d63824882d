"""Models of many groups at once: equal to single fits, alike in a task and over passes, with a job count that does not grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import grouped_logistic as G
from plumbline.operators import probes as P
from plumbline.session import BROADCAST_BYTES, FIT_BYTES


def data(spark, groups=3, n=150, seed=4, classes=(2, 3, 4)):
    r = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        k = classes[g % len(classes)]
        y = r.integers(0, k, n)
        x = r.normal(size=(n, 5)) * [1, 3, 0.5, 1, 1] + np.eye(6)[y][:, :5] * 1.5 + 2
        rows += [(f"g{g}", int(v), int(i + g * n), z.tolist()) for i, (v, z) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "grp string, y int, sample_id bigint, features array<double>")


@pytest.mark.parametrize("standardize", [False, True])
def test_equal_to_single_fits_in_a_task_and_over_passes(spark, limits, standardize):
    rows = data(spark).cache()
    here = {r["grp"]: r for r in G.fit_groups(rows, "y", standardize=standardize).collect()}
    limits(FIT_BYTES, 100)
    over = {r["grp"]: r for r in G.fit_groups(rows, "y", standardize=standardize).collect()}
    assert set(here) == set(over) == {"g0", "g1", "g2"}
    for g, m in here.items():
        assert m["n"] == over[g]["n"] == 150 and m["classes"] == over[g]["classes"]
        assert np.allclose(m["weights"], over[g]["weights"], atol=1e-3)
        own = rows.where(F.col("grp") == g)
        single = P.fit_logistic(P.standardize_vectors(own, own)[0] if standardize else own, "y", max_iter=500)
        if not standardize:
            assert np.allclose(np.reshape(m["weights"], single.weights.shape), single.weights, atol=2e-3)
        want = {r["sample_id"]: r["predicted"] for r in P.predict(P.standardize_vectors(own, own)[0] if standardize else own, single).collect()}
        for models in (here, over):
            table = spark.createDataFrame([models[g]], G.models_schema(rows.schema["y"].dataType))
            got = {r["sample_id"]: r["predicted"] for r in G.predict_groups(own, table, "y").collect()}
            assert sum(got[i] != want[i] for i in want) <= 1 and len(got) == 150
    rows.unpersist()


def test_small_and_missing_classes(spark):
    rows = spark.createDataFrame(
        [("one", 1, [0.0, 1.0])] * 3 + [("two", v, [float(v), 1.0]) for v in (0, 0, 0, 1, 1, 7)] + [(None, 1, [0.0, 0.0]), ("two", None, [0.0, 0.0]), ("two", 1, None)],
        "grp string, y int, features array<double>")
    models = G.fit_groups(rows, "y", min_rows=2).collect()
    assert [(m["grp"], m["classes"], m["n"]) for m in models] == [("two", [0, 1], 5)]
    asked = rows.where("features is not null")
    got = G.predict_groups(asked, spark.createDataFrame(models, G.models_schema(rows.schema["y"].dataType)), "y").collect()
    assert len(got) == 7 and {(r["y"], r["predicted"]) for r in got if r["y"] in (0, 1)} == {(0, 0), (1, 1)}
    assert all((r["true_rank"] is None) == (r["y"] not in (0, 1)) for r in got)
    assert G.fit_groups(rows.limit(0), "y").count() == 0


def test_blocks_of_models_give_the_same_rows(spark, limits):
    rows = data(spark, 6, 40).cache()
    models = G.written(G.fit_groups(rows, "y"), "models")
    whole = sorted(map(tuple, G.predict_groups(rows, models, "y").drop("features").collect()))
    all_ = sorted(map(tuple, G.tested_on_all(rows, models, "y").collect()))
    limits(BROADCAST_BYTES, 200)
    assert sorted(map(tuple, G.predict_groups(rows, models, "y").drop("features").collect())) == whole and len(whole) == 240
    assert sorted(map(tuple, G.tested_on_all(rows, models, "y").collect())) == all_
    by_hand = {}
    for r in models.collect():
        m = G.Model(r["classes"], np.reshape(r["weights"], (-1, len(r["intercepts"]))), np.asarray(r["intercepts"]))
        for row in rows.collect():
            n, hits = by_hand.get((r["grp"], row["y"]), (0, 0))
            by_hand[(r["grp"], row["y"])] = (n + 1, hits + (m.classes[int(m.logits(np.array([row["features"]])).argmax())] == row["y"]))
    assert {(g, y): (n, h) for g, y, n, h, _ in all_} == by_hand
    rows.unpersist()


def jobs(spark, fn):
    group = f"jobs-{np.random.randint(1 << 30)}"
    spark.sparkContext.setJobGroup(group, "")
    fn()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_values(spark):
    few, many = data(spark, 2, 30, classes=(2,)).cache(), data(spark, 20, 30, classes=(2,)).cache()
    counts = [jobs(spark, lambda: P.signal_within({"a": d}, "grp", "y", 3).collect()) for d in (few, many)]
    assert counts[1] <= counts[0] + 2
    got = {r["grp"]: r for r in P.signal_within({"a": many}, "grp", "y", 3).collect()}
    alone = P.cross_validate(many.where("grp = 'g7'"), "y", 3).first()
    assert len(got) == 20 and (got["g7"]["n"], got["g7"]["n_folds"]) == (alone["n"], alone["n_folds"])
    assert got["g7"]["micro_mean"] == pytest.approx(alone["micro_mean"]) and got["g7"]["macro_std"] == pytest.approx(alone["macro_std"])
    few.unpersist()
    many.unpersist()
