"""Principal axes against a dense solution, and the report's odd cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.operators import features, moments
from plumbline.plans import report


def table(spark, x, **more):
    cols = {"sample_id": pa.array(range(len(x)), pa.int64()), "features": pa.array(x.tolist(), pa.list_(pa.float64()))}
    return spark.createDataFrame(pa.table(cols | {k: pa.array(v) for k, v in more.items()})).repartition(4)


def test_principal_axes_are_those_of_the_dense_solution(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 90)) * (0.9 ** np.arange(90)) @ np.linalg.qr(rng.normal(size=(90, 90)))[0] + 5.0
    mean, axes, values = moments.principal_axes(table(spark, x), 5)
    want, basis = np.linalg.eigh(np.cov(x.T))
    assert values == pytest.approx(want[::-1][:5], rel=1e-6) and mean == pytest.approx(x.mean(axis=0))
    cos = np.linalg.svd(axes.T @ basis[:, ::-1][:, :5])[1]
    assert cos.min() > 1 - 1e-6 and axes.T @ axes == pytest.approx(np.eye(5), abs=1e-9)
    assert (axes[np.abs(axes).argmax(axis=0), range(5)] > 0).all()


def test_principal_axes_of_few_rows_and_entries(spark):
    assert moments.principal_axes(table(spark, np.zeros((0, 3))), 2)[1].size == 0
    assert moments.principal_axes(table(spark, np.ones((1, 3))), 2)[1].size == 0
    axes = moments.principal_axes(table(spark, np.array([[0.0, 0], [2, 0], [4, 0]])), 5)
    assert axes[1].shape == (2, 2) and axes[2] == pytest.approx([4, 0])
    same = moments.principal_axes(table(spark, np.ones((6, 3))), 2)
    assert same[2] == pytest.approx([0, 0], abs=1e-12)


def test_criteria_accuracy_names_every_criterion(spark):
    rng = np.random.default_rng(1)
    y = np.arange(60) % 3
    x = rng.normal(size=(60, 5)) + np.outer(y, [6, 0, 0, 5, 0])
    df = table(spark, x, label=y, a=y % 2).select("sample_id", "label", "a", *[F.col("features")[i].alias(f"c{i}") for i in range(5)])
    got = {(r.criterion, r.k): r.accuracy for r in features.criteria_accuracy(df, [f"c{i}" for i in range(5)], ["a", "label"], "label", 2, (1, 3)).collect()}
    assert {c for c, _ in got} == {"f_combo", "f_last", "information", "l1_mass", "pca"} and len(got) == 10
    assert got["f_combo", 1] > 0.95 and got["pca", 3] > 0.95


def test_report_without_seen_conditions_null_scores_and_an_empty_side(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3))
    base = table(spark, x, a=np.arange(40) % 4).withColumns({"trust": F.col("features")[0], "realism_z": F.col("features")[1], "faithfulness_z": F.col("features")[2]})
    gen = base.withColumn("realism_z", F.when(F.col("sample_id") >= 10, F.col("realism_z")))
    one = report.Configuration("one", base, gen, ["a"])
    rows = report.evaluation_report([one, one._replace(name="none", gen=gen.limit(0))], n_bins=2).collect()
    assert {r.config for r in rows if r.section == "bins"} == {"one"}
    n = {r.ranking: r.n for r in rows if r.section == "bins" and r.arm is None and r.bin is None and r.metric == "trust_mean"}
    assert n == {"trust": 40, "realism_z": 30, "faithfulness_z": 40, "random": 40}
    assert {r.arm for r in rows if r.section == "real_gen"} == {"all"}
    auc = {r.ranking: r.value for r in rows if r.section == "real_gen" and r.metric == "auroc" and r.config == "one"}
    assert auc["trust"] == pytest.approx(0.5)
    bins = [r for r in rows if r.section == "bins" and r.ranking == "trust" and r.arm is None and r.bin is not None and r.metric == "trust_mean"]
    assert sorted(r.n for r in bins) == [20, 20] and min(bins, key=lambda r: r.bin).value < max(bins, key=lambda r: r.bin).value
