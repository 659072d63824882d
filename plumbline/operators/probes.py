"""Classifier-based evaluation: train on one table, read out on another.

Models are Spark ML logistic regressions with the objective
C * sum(loss) + |w|^2 / 2, i.e. regParam = 1/(C*n) without standardisation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.functions.arrow import matrix, with_columns
from plumbline.operators import moments as M
from plumbline.operators.grouped_logistic import fit_groups, predict_groups, tested_on_all
from plumbline.operators.neighbors import knn_join, neighbor_vote
from plumbline.operators.pivot_join import written
from plumbline.operators.ranking import bin_within, detection_summary, random_scores
from plumbline.operators.sampling import bootstrap_means, random_baseline, stratified_kfold
from plumbline.operators.scoring import as_scalar_score, scorer

ROWS_PER_TASK = 20_000


@dataclass
class LinearModel:
    """logits = x @ weights + intercepts; one column per class, or one for the larger of two classes."""

    classes: list
    weights: np.ndarray
    intercepts: np.ndarray

    @property
    def binary(self) -> bool:
        return self.weights.shape[1] == 1


def _labels(df: DataFrame, label: str, min_rows: int = 1) -> list:
    rows = df.groupBy(label).count().where((F.col("count") >= min_rows) & F.col(label).isNotNull()).select(label).collect()
    return sorted(r[0] for r in rows)


def fit_logistic(
    df: DataFrame, label: str, features: str = "features", c: float = 1.0, max_iter: int = 200,
    min_rows: int = 1, balanced: bool = False,
) -> LinearModel | None:
    """Multinomial (or binary) logistic model; None with fewer than two classes of `min_rows` rows."""
    per_class = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    classes = sorted(k for k, m in per_class.items() if m >= min_rows)
    if len(classes) < 2:
        return None
    n = sum(per_class[k] for k in classes)
    index = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col(label)) - 1
    rows = df.select(index.cast("double").alias("_y"), array_to_vector(F.col(features).cast("array<double>")).alias("_x")).where(F.col("_y") >= 0)
    # Few rows need few tasks per iteration; a large table keeps its partitions.
    rows = rows.coalesce(max(1, n // ROWS_PER_TASK))
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, tol=1e-8,
        family="binomial" if len(classes) == 2 else "multinomial",
    )
    if balanced:
        weight = F.lit(0.0)
        for y, k in enumerate(classes):
            weight = F.when(F.col("_y") == y, F.lit(n / (len(classes) * per_class[k]))).otherwise(weight)
        rows = rows.withColumn("_w", weight)
        model = model.setWeightCol("_w")
    fit = model.fit(rows)
    if len(classes) == 2:
        return LinearModel(classes, fit.coefficients.toArray()[:, None], np.asarray([fit.intercept]))
    return LinearModel(classes, fit.coefficientMatrix.toArray().T, fit.interceptVector.toArray())


def fit_ridge_classifier(df: DataFrame, label: str, features: str = "features", alpha: float = 1.0) -> LinearModel | None:
    """Ridge regression on -1/+1 class targets from one Gram pass."""
    classes = _labels(df, label)
    if len(classes) < 2:
        return None
    targets = F.array(*[F.when(F.col(label) == k, 1.0).otherwise(-1.0) for k in classes])
    m = M.collect_moments(df.select(F.concat(F.col(features), targets).alias("_xy")), "_xy")
    d = len(m.total) - len(classes)
    s, mu = m.scatter(), m.mean
    w = np.linalg.solve(s[:d, :d] + alpha * np.eye(d), s[:d, d:])
    return LinearModel(classes, w, mu[d:] - mu[:d] @ w)


def predict(df: DataFrame, model: LinearModel, features: str = "features", label: str | None = None) -> DataFrame:
    """Add `predicted`; with a label also `true_rank`, the place of the true class (null if untrained)."""
    kind = T.IntegerType() if isinstance(model.classes[0], int) else T.StringType()
    shared = df.sparkSession.sparkContext.broadcast(model)
    fields = [*df.schema.fields, T.StructField("predicted", kind)]
    if label:
        fields.append(T.StructField("true_rank", T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        classes = np.asarray(m.classes, dtype=object)
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index(features)))
            z = x @ m.weights + m.intercepts if len(x) else np.zeros((0, len(classes)))
            if m.binary and len(x):
                z = np.concatenate([np.zeros_like(z), z], axis=1)
            best = z.argmax(axis=1) if len(z) else np.zeros(0, int)
            new = {"predicted": pa.array(classes[best].tolist(), pa.int32() if kind == T.IntegerType() else pa.string())}
            if label:
                own = {k: i for i, k in enumerate(m.classes)}
                at = [own.get(v) for v in batch.column(batch.schema.get_field_index(label)).to_pylist()]
                new["true_rank"] = pa.array([None if j is None else int((z[i] > z[i, j]).sum()) + 1 for i, j in enumerate(at)], pa.int32())
            yield with_columns(batch, new)

    return df.mapInArrow(run, T.StructType(fields))


def standardize_vectors(fit_on: DataFrame, *tables: DataFrame, features: str = "features") -> list[DataFrame]:
    """Vectors as (x - mean)/population std of `fit_on`; a constant position is only centred."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(features))
    s = fit_on.agg(stats.alias("s")).first()["s"]
    n = s["count"]
    std = np.sqrt(s["variance"].toArray() * (n - 1) / n)
    std[std == 0] = 1.0
    mean, scale = (F.array(*[F.lit(float(v)) for v in arr]) for arr in (s["mean"].toArray(), 1.0 / std))
    value = F.zip_with(F.zip_with(features, mean, lambda a, b: a - b), scale, lambda a, b: a * b)
    return [t.withColumn(features, value) for t in tables]


def accuracy_report(predicted: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Micro accuracy, macro accuracy (mean of class recalls) and rows, per group."""
    by = list(by)
    hit = (F.col("predicted") == F.col(label)).cast("double")
    per_class = predicted.groupBy(*by, label).agg(F.count("*").alias("_n"), F.sum(hit).alias("_hit"))
    grouped = per_class.groupBy(*by) if by else per_class.groupBy()
    return grouped.agg(
        F.sum("_n").alias("n"), (F.sum("_hit") / F.sum("_n")).alias("micro"), F.avg(F.col("_hit") / F.col("_n")).alias("macro"),
    )


def multiclass_metrics(predicted: DataFrame, label: str, top: Sequence[int] = (1, 5), ignore: int = -1) -> DataFrame:
    """Accuracy, macro and weighted F1, and top-k accuracy; rows with the ignored label do not count."""
    rows = predicted.where(F.col(label) != ignore)
    cells = rows.groupBy(F.col(label).alias("y"), F.col("predicted").alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("k"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred")),
        F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred")),
    )).alias("e")).select("e.*")
    per = sides.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("true").alias("t"), F.sum("pred").alias("p"))
    f1 = 2 * F.col("tp") / (F.col("t") + F.col("p"))
    total = per.agg(
        F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("f1_macro"),
        (F.sum(f1 * F.col("t")) / F.sum("t")).alias("f1_weighted"),
    )
    if "true_rank" in predicted.columns:
        hits = rows.agg(*[F.avg(F.coalesce((F.col("true_rank") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in top])
        total = total.join(F.broadcast(hits))
    return total


def per_class_accuracy(predicted: DataFrame, label: str, ignore: int = -1) -> DataFrame:
    rows = predicted.where(F.col(label) != ignore)
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))


def linear_probe_energy(real: DataFrame, gen: DataFrame, attrs: Sequence[str], c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """Sum over attributes of -logsumexp(logits) of a probe trained on real unit vectors.

    A two-class probe has logits (0, z); attributes with one class are skipped.
    """
    real = real.withColumn("_u", V.l2_normalize("features"))
    out = gen.withColumns({"_u": V.l2_normalize("features"), "probe_energy": F.lit(0.0)})
    for attr in attrs:
        model = fit_logistic(real, attr, "_u", c, max_iter)
        if model is None:
            continue
        out = M.apply_matrix(out, model.weights, None, "_u", "_z")
        shift = F.array(*[F.lit(float(b)) for b in model.intercepts])
        z = F.zip_with("_z", shift, lambda a, b: a + b)
        z = F.concat(F.array(F.lit(0.0)), z) if model.binary else z
        out = out.withColumn("_z", z).withColumn("probe_energy", F.col("probe_energy") - V.logsumexp("_z")).drop("_z")
    return out.drop("_u")


@scorer("linear_probe")
def probe_scorer(real: DataFrame, gen: DataFrame, attrs: Sequence[str], **options) -> DataFrame:
    return as_scalar_score(linear_probe_energy(real, gen, attrs, **options), "probe_energy")


def bin_downstream(
    gen: DataFrame, test: DataFrame, attrs: Sequence[str], label: str, rankings: Sequence[str] = ("trust",),
    n_bins: int = 10, random_seeds: int = 1, pipeline: str = "l2", max_iter: int = 200, min_rows: int = 2,
) -> DataFrame:
    """Per ranking, seed and within-condition score bin: train on the bin's classes of `min_rows` rows, test on the real rows.

    Macro and micro accuracy, rows, share of the test classes that were trained, and trained classes. All models are fitted
    in one pass and tested in one pass over the test rows, whatever the number of bins, rankings and seeds. `test` should be
    rows that calibrated nothing, such as the held-out part of `stratified_test_split`.
    """
    if pipeline not in ("l2", "standardize", "none"):
        raise ValueError(f"unknown pipeline {pipeline!r}")
    if pipeline == "l2":
        gen, test = (t.withColumn("features", V.l2_normalize("features")) for t in (gen, test))
    keys = list(dict.fromkeys([*attrs, label]))
    jobs = [(r, gen.select("sample_id", *keys, "features", F.col(r).alias("_s")), 0) for r in rankings]
    jobs += [("random", random_scores(gen, 1000 + s).select("sample_id", *keys, "features", F.col("random_score").alias("_s")), s) for s in range(random_seeds)]
    rows = None
    for name, scored, seed in jobs:
        part = bin_within(scored, attrs, n_bins, "_s").select(F.concat_ws("|", F.lit(name), F.lit(str(seed)), F.col("bin").cast("string")).alias("_model"), label, "features")
        rows = part if rows is None else rows.unionByName(part)
    models = written(fit_groups(rows, label, grp="_model", max_iter=max_iter, min_rows=min_rows, standardize=pipeline == "standardize"), "models")
    cells = tested_on_all(test, models, label)
    report = cells.groupBy("grp").agg(
        F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("micro"), F.avg(F.col("hits") / F.col("n")).alias("macro"), F.avg(F.col("known").cast("double")).alias("coverage"))
    trained = models.select("grp", F.size("classes").alias("n_train_classes"))
    part = lambda i: F.element_at(F.split("grp", "[|]"), i)
    return report.join(trained, "grp").select(
        part(1).alias("ranking"), part(3).cast("int").alias("bin"), part(2).cast("int").alias("seed"), "n", "micro", "macro", "coverage", "n_train_classes")


def bin_summary(results: DataFrame, metric: str = "micro") -> DataFrame:
    """Mean and sample std of the metric over seeds per ranking and bin."""
    return results.groupBy("ranking", "bin").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count("*").alias("n_seeds")
    )


def bin_spread(summary: DataFrame, n_bins: int) -> DataFrame:
    """First-minus-last bin per ranking."""
    first, last = (F.max(F.when(F.col("bin") == b, F.col("mean"))) for b in (0, n_bins - 1))
    return summary.groupBy("ranking").agg((first - last).alias("spread"))


def gen_to_real(
    gen: DataFrame, real: DataFrame, label: str, heldout: Column | None = None, max_iter: int = 200
) -> DataFrame:
    """Train on generated, test on real rows of classes both sides have; optional held-out breakdown."""
    shared = gen.select(label).distinct().intersect(real.select(label).distinct())
    train, test = gen.join(shared, label, "left_semi"), real.join(shared, label, "left_semi")
    model = fit_logistic(train, label, max_iter=max_iter)
    rows = predict(test, model)
    groups = F.array(F.lit("overall")) if heldout is None else F.array(F.lit("overall"), F.when(heldout, "heldout").otherwise("seen"))
    return accuracy_report(rows.withColumn("part", F.explode(groups)), label, ["part"])


def decomposed_accuracy(
    gen: DataFrame, real: DataFrame, attrs: Sequence[str], heldout: DataFrame, label: str = "cond_id", max_iter: int = 200
) -> DataFrame:
    """Predict the joint condition, credit every attribute and the pair; overall, seen and held-out.

    `cond_id` must number the conditions of both tables alike.
    """
    attrs = list(attrs)
    shared = gen.select(label).distinct().intersect(real.select(label).distinct())
    train, test = gen.join(shared, label, "left_semi"), real.join(shared, label, "left_semi")
    names = train.select(label, *attrs).distinct().select(F.col(label).alias("predicted"), *[F.col(a).alias(f"_p_{a}") for a in attrs])
    rows = predict(test, fit_logistic(train, label, max_iter=max_iter)).join(names, "predicted")
    held = heldout.select(*attrs).distinct().withColumn("_h", F.lit(True))
    rows = rows.join(held, attrs, "left")
    part = F.explode(F.array(F.lit("overall"), F.when(F.col("_h"), "heldout").otherwise("seen")))
    hits = [F.avg((F.col(a) == F.col(f"_p_{a}")).cast("double")).alias(f"acc_{a}") for a in attrs]
    joint = F.avg((F.col(label) == F.col("predicted")).cast("double")).alias("acc_pair")
    return rows.withColumn("part", part).groupBy("part").agg(F.count("*").alias("n"), *hits, joint)


def readout(
    real: DataFrame, gen: DataFrame, accepted: Column, attrs: Sequence[str], label: str, seeds: int = 5,
    k: int = 10, max_iter: int = 200,
) -> DataFrame:
    """Accuracy of real-trained logistic, ridge and k-NN on all, accepted and random generated rows."""
    keys = list(dict.fromkeys([*attrs, label]))
    base = gen.select("sample_id", *keys, "features", accepted.alias("_ok"))
    scored = {
        "logistic": predict(base, fit_logistic(real, label, max_iter=max_iter)),
        "ridge": predict(base, fit_ridge_classifier(real, label)),
        f"knn{k}": base.join(neighbor_vote(knn_join(gen, real, k), real.select("sample_id", label), label, k), "sample_id"),
    }
    hits = None
    for name, table in scored.items():
        part = table.select(F.lit(name).alias("classifier"), "sample_id", "_ok", (F.col("predicted") == F.col(label)).cast("double").alias("hit"))
        hits = part if hits is None else hits.unionByName(part)
    rand = random_baseline(base.where("_ok"), base, list(attrs), seeds).select("rep", "sample_id")
    r = hits.join(rand, "sample_id").groupBy("classifier", "rep").agg(F.avg("hit").alias("_a"))
    r = r.groupBy("classifier").agg(F.avg("_a").alias("acc_random"), F.coalesce(F.stddev_samp("_a"), F.lit(0.0)).alias("acc_random_std"))
    out = hits.groupBy("classifier").agg(
        F.avg("hit").alias("acc_all"), F.avg(F.when(F.col("_ok"), F.col("hit"))).alias("acc_accepted"), F.count_if("_ok").alias("n_accepted")
    )
    return out.join(r, "classifier").withColumn("delta", F.col("acc_accepted") - F.col("acc_random"))


def knn_conditioning(
    real: DataFrame, gen: DataFrame, attrs: Sequence[str], label: str, k: int = 5, by: str | None = None, reps: int = 1000
) -> DataFrame:
    """Share of generated rows whose k real neighbours vote for their own class: per condition, then mean with interval."""
    votes = neighbor_vote(knn_join(gen, real, k), real.select("sample_id", label), label, k)
    keys = list(dict.fromkeys([*([by] if by else []), *attrs]))
    rows = gen.select("sample_id", *dict.fromkeys([*keys, label])).join(votes, "sample_id")
    hit = (F.col("predicted") == F.col(label)).cast("double")
    cond = rows.groupBy(*keys).agg(F.avg(hit).alias("accuracy"), F.count("*").alias("rows"))
    cond = cond.withColumn("cond_id", F.concat_ws(",", *[F.col(a).cast("string") for a in attrs]))
    groups = [by] if by else []
    ci = bootstrap_means(cond, "accuracy", groups, reps, 0, sample_id="cond_id").withColumnRenamed("n", "n_conditions")
    pooled = (rows.groupBy(*groups) if groups else rows.groupBy()).agg(F.avg(hit).alias("pooled"), F.count("*").alias("n_rows"))
    return ci.join(pooled, groups) if groups else ci.join(F.broadcast(pooled))


def attribute_probes(train: DataFrame, sets: dict[str, DataFrame], attrs: Sequence[str], max_iter: int = 200) -> DataFrame:
    """One binary probe per 0/1 attribute: accuracy, F1, AUC and positive ratio on every set."""
    out = None
    for attr in attrs:
        model = fit_logistic(train, attr, max_iter=max_iter)
        for name, rows in sets.items():
            p = predict(rows, model)
            z = M.apply_matrix(p, model.weights, None, "features", "_z").withColumn("_s", F.col("_z")[0])
            y, q = F.col(attr) == 1, F.col("predicted") == 1
            tp, fp, fn = F.count_if(y & q), F.count_if(~y & q), F.count_if(y & ~q)
            part = z.agg(
                F.count("*").alias("n"), F.avg((y == q).cast("double")).alias("accuracy"),
                F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), F.avg(F.col(attr)).alias("positive_ratio"),
            ).join(F.broadcast(detection_summary(z, "_s", attr).select("auroc")))
            part = part.select(F.lit(attr).alias("attr"), F.lit(name).alias("set"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def out_of_fold(split: DataFrame, label: str, by: Sequence[str], pipeline: str, max_iter: int) -> DataFrame:
    """Rows of split(*by, fold, sample_id, label, features) predicted by a model trained on the other folds of their group."""
    name = lambda fold: F.concat_ws("|", *[F.col(c).cast("string") for c in by], fold.cast("string"))
    if pipeline == "l2":
        split = split.withColumn("features", V.l2_normalize("features"))
    last = split.groupBy(*by).agg(F.max("fold").alias("_last"))
    others = split.join(last, list(by)) if by else split.join(F.broadcast(last))
    others = others.withColumn("_f", F.explode(F.sequence(F.lit(0), "_last"))).where(F.col("_f") != F.col("fold"))
    train = others.select(name(F.col("_f")).alias("_model"), label, "features")
    models = written(fit_groups(train, label, grp="_model", max_iter=max_iter, standardize=pipeline == "standardize"), "models")
    return predict_groups(split.withColumn("_model", name(F.col("fold"))), models, label, grp="_model").drop("features", "_model")


def fold_report(rows: DataFrame, label: str, by: Sequence[str], top: Sequence[int]) -> DataFrame:
    """Mean and population std of macro and micro accuracy over folds, and top-k accuracy, per group."""
    by = list(by)
    per = accuracy_report(rows, label, [*by, "fold"])
    out = (per.groupBy(*by) if by else per.groupBy()).agg(
        F.avg("macro").alias("macro_mean"), F.stddev_pop("macro").alias("macro_std"), F.avg("micro").alias("micro_mean"),
        F.stddev_pop("micro").alias("micro_std"), F.sum("n").alias("n"), F.count("*").alias("n_folds"),
    )
    hits = (rows.groupBy(*by) if by else rows.groupBy()).agg(*[F.avg((F.col("true_rank") <= k).cast("double")).alias(f"top{k}") for k in top])
    return out.join(hits, by) if by else out.join(F.broadcast(hits))


def cross_validate(
    df: DataFrame, label: str, folds: int = 5, min_rows: int = 5, seed: int = 0, pipeline: str = "standardize",
    max_iter: int = 100, top: Sequence[int] = (1, 5),
) -> DataFrame | None:
    """Stratified out-of-fold accuracy: mean and population std of macro and micro over folds, and top-k.

    None with fewer than two folds or two classes of `min_rows` rows.
    """
    split = written(stratified_kfold(df, label, folds, min_rows, seed).select("sample_id", label, "features", "fold"), "folds")
    n_folds, classes = split.agg(F.max("fold"), F.countDistinct(label)).first()
    if not n_folds or classes < 2:
        return None
    return fold_report(out_of_fold(split, label, [], pipeline, max_iter), label, [], top)


def signal_within(
    tables: dict[str, DataFrame], within: str, label: str, folds: int = 5, max_iter: int = 100, min_rows: int = 5, seed: int = 0,
    pipeline: str = "standardize", top: Sequence[int] = (1, 5),
) -> DataFrame:
    """cross_validate of the label inside each value of another attribute, for several row sets.

    Values and sets are groups of one table, so the number of jobs does not grow with them. Values with fewer than two
    folds or classes are left out.
    """
    rows = None
    for name, df in tables.items():
        part = df.where(F.col(within).isNotNull() & F.col(label).isNotNull()).select(F.lit(name).alias("rows"), within, label, "sample_id", "features")
        rows = part if rows is None else rows.unionByName(part)
    by = ["rows", within]
    split = written(stratified_kfold(rows, label, folds, min_rows, seed, within=by), "folds")
    enough = split.groupBy(*by).agg(F.max("fold").alias("_f"), F.countDistinct(label).alias("_c")).where("_f >= 1 and _c >= 2").select(*by)
    return fold_report(out_of_fold(split.join(enough, by, "left_semi"), label, by, pipeline, max_iter), label, by, top)
