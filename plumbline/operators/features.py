"""Column selection for wide measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import moments as M
from plumbline.operators.neighbors import knn_join, neighbor_votes
from plumbline.operators.prefix import percentiles
from plumbline.operators.probes import fit_logistic, standardize_vectors
from plumbline.operators.sampling import poisson_reps
from plumbline.operators.summaries import long_columns
from plumbline.session import small_table

# Parts of lower-case column names that mark bookkeeping rather than measurements.
METADATA_PARTS = (
    "metadata", "filename", "pathname", "imagenumber", "objectnumber",
    "executiontime", "moduleerror", "series", "frame",
    "group_index", "group_number", "url",
)


def metadata_columns(df: DataFrame, parts: Sequence[str] = METADATA_PARTS) -> list[str]:
    """Columns whose lower-case name contains one of the parts."""
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def numeric_columns(df: DataFrame, parts: Sequence[str] = METADATA_PARTS) -> list[str]:
    skip = set(metadata_columns(df, parts))
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column variance, std and extreme |z| in one aggregate, as rows."""
    row = df.agg(
        *[f(c).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("v", F.var_pop), ("m", F.avg), ("a", F.min), ("b", F.max))]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"),
                F.try_divide(F.greatest(F.col(f"b{i}") - F.col(f"m{i}"), F.col(f"m{i}") - F.col(f"a{i}")), F.sqrt(F.col(f"v{i}"))).alias("max_abs_z"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return row.select(F.explode(cells).alias("e")).select("e.*")


def variance_outlier_filter(
    df: DataFrame, cols: Sequence[str], variance: float = 1e-5, z: float | None = 5.0
) -> DataFrame:
    """Columns with population variance above the limit and every |z| below z; z=None checks variance only."""
    kept = column_profile(df, cols).where(F.col("variance") > variance)
    return kept if z is None else kept.where(F.col("max_abs_z") < z)


def _column_moments(df: DataFrame, cols: Sequence[str]) -> M.Moments:
    return M.collect_moments(df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("features")))


def correlation_prune(df: DataFrame, cols: Sequence[str], limit_r: float = 0.7) -> list[str]:
    """Drop a column if any earlier original column correlates above the limit with it."""
    corr = np.abs(M.correlation_matrix(_column_moments(df, cols)))
    return [c for j, c in enumerate(cols) if not (corr[:j, j] > limit_r).any()]


def anova_f(df: DataFrame, cols: Sequence[str], factor: Sequence[str], keys: Sequence[str] = (), weight: str | None = None, min_rows: int = 1) -> DataFrame:
    """One-way ANOVA F per column from group sums: keys, feature, f_value."""
    factor, keys = list(factor), list(keys)
    w = F.col(weight) if weight else F.lit(1)
    aggs = [F.sum(w).alias("n")]
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        aggs += [F.sum(w * v).alias(f"s{i}"), F.sum(w * v * v).alias(f"q{i}")]
    groups = df.groupBy(*keys, *factor).agg(*aggs).where(F.col("n") >= min_rows)
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("s"), F.col(f"q{i}").alias("q")) for i, c in enumerate(cols)]
    )
    long = groups.select(*keys, "n", F.explode(cells).alias("e")).select(*keys, "n", "e.*")
    out = long.groupBy(*keys, "feature").agg(
        F.sum("n").alias("N"), F.count("*").alias("g"), F.sum("s").alias("S"), F.sum("q").alias("Q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"),
    )
    between = F.try_divide(F.col("B") - F.col("S") * F.col("S") / F.col("N"), F.col("g") - 1)
    within = F.try_divide(F.col("Q") - F.col("B"), F.col("N") - F.col("g"))
    return out.where(F.col("g") >= 2).select(*keys, "feature", F.try_divide(between, within).alias("f_value"))


def anova_top_k(df: DataFrame, cols: Sequence[str], attrs: Sequence[str], k: int) -> DataFrame:
    """Top-k columns by F over the joint condition, with the F of every single attribute."""
    out = anova_f(df, cols, attrs).withColumnRenamed("f_value", "f_combo")
    for a in attrs:
        out = out.join(anova_f(df, cols, [a]).withColumnRenamed("f_value", f"f_{a}"), "feature")
    # One row per column.
    place = F.row_number().over(Window.orderBy(F.desc("f_combo"), "feature"))
    return out.withColumn("place", place).where(F.col("place") <= k)


def binned_information(df: DataFrame, cols: Sequence[str], factor: Sequence[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each column, cut at its deciles, with the joint condition."""
    factor = list(factor)
    long = long_columns(df, cols, factor)
    edges = percentiles(long, "value", [i / bins for i in range(1, bins)], ["feature"], "_e").select("feature", "_e")
    cell = F.size(F.filter("_e", lambda e: e < F.col("value")))
    binned = long.join(F.broadcast(edges), "feature").withColumn("_b", cell)
    joint = binned.groupBy("feature", "_b", *factor).agg(F.count("*").alias("n"))
    a = joint.groupBy("feature", "_b").agg(F.sum("n").alias("na"))
    b = joint.groupBy("feature", *factor).agg(F.sum("n").alias("nb"))
    t = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    all_ = joint.join(a, ["feature", "_b"]).join(b, ["feature", *factor]).join(t, "feature")
    term = F.col("n") / F.col("total") * F.log(F.col("n").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    return all_.groupBy("feature").agg(F.sum(term).alias("information"))


def l1_mass(df: DataFrame, cols: Sequence[str], label: str, c: float = 0.1, max_iter: int = 50) -> DataFrame:
    """Summed |coefficient| per column of an L1 logistic model of the label."""
    n = df.count()
    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*[F.col(x).cast("double") for x in cols])).alias("features"))
    fit = LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, family="multinomial").fit(rows)
    mass = np.abs(fit.coefficientMatrix.toArray()).sum(axis=0)
    return small_table(df.sparkSession, [{"feature": x, "l1_mass": float(m)} for x, m in zip(cols, mass)], [("feature", "string"), ("l1_mass", "double")])


def criteria_comparison(df: DataFrame, cols: Sequence[str], attrs: Sequence[str], label: str) -> DataFrame:
    """Per column the rank by joint F, by the last attribute's F, by information and by L1 mass."""
    table = anova_f(df, cols, attrs).withColumnRenamed("f_value", "f_combo")
    table = table.join(anova_f(df, cols, [attrs[-1]]).withColumnRenamed("f_value", "f_last"), "feature")
    table = table.join(binned_information(df, cols, attrs), "feature").join(l1_mass(df, cols, label), "feature")
    for c in ("f_combo", "f_last", "information", "l1_mass"):
        table = table.withColumn(f"rank_{c}", F.row_number().over(Window.orderBy(F.desc(c), "feature")))
    return table


def criteria_accuracy(
    df: DataFrame, cols: Sequence[str], attrs: Sequence[str], label: str, size: int, ks: Sequence[int] = (1, 5, 10)
) -> DataFrame:
    """Leave-one-out accuracy in the `size` best columns of every criterion, and in as many principal directions of all.

    criterion, k, accuracy; the criteria are those of `criteria_comparison` and `pca`. `label` numbers the classes from 0.
    """
    ranks = criteria_comparison(df, cols, attrs, label)
    names = [c for c in ranks.columns if c.startswith("rank_")]
    best = ranks.where(F.least(*names) <= size).select("feature", *names).collect()  # a row per column at most
    wide = F.array(*[F.col(c).cast("double") for c in cols])
    spaces = {}
    for name in names:
        kept = [r["feature"] for r in sorted(best, key=lambda r: r[name]) if r[name] <= size]
        spaces[name.removeprefix("rank_")] = df.select("sample_id", label, F.array(*[F.col(c).cast("double") for c in kept]).alias("features"))
    rows = df.select("sample_id", label, wide.alias("features"))
    mean, axes, _ = M.principal_axes(rows, size)
    spaces["pca"] = M.apply_matrix(rows, axes, mean, "features", "_p").select("sample_id", label, F.col("_p").alias("features"))
    out = None
    for name, space in spaces.items():
        part = loo_knn_accuracy(space, label, ks).withColumn("criterion", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("criterion", "k", "accuracy")


def aligned_ranking(
    a: DataFrame, b: DataFrame, cols: Sequence[str], label: str, alpha: float = 1.0, max_iter: int = 100
) -> DataFrame:
    """Columns of table b ranked by how much of space a's label signal they carry.

    A logistic model of the label in space a gives logits per row; a ridge fit
    from b's columns to the logits scores each column by its coefficient norm.
    """
    a = standardize_vectors(a, a)[0]
    model = fit_logistic(a, label, max_iter=max_iter)
    logits = M.apply_matrix(a.select("sample_id", "features"), model.weights, None, "features", "_logit")
    shift = F.array(*[F.lit(float(v)) for v in model.intercepts])
    joined = b.select("sample_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("_x")).join(
        logits.select("sample_id", F.zip_with("_logit", shift, lambda u, v: u + v).alias("_y")), "sample_id"
    )
    m = M.collect_moments(joined.select(F.concat("_x", "_y").alias("_xy")), "_xy")
    s, p = m.scatter(), len(cols)
    w = np.linalg.solve(s[:p, :p] + alpha * np.eye(p), s[:p, p:])
    strength = np.linalg.norm(w, axis=1)
    table = small_table(
        b.sparkSession, [{"feature": c, "strength": float(v)} for c, v in zip(cols, strength)], [("feature", "string"), ("strength", "double")]
    )
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.desc("strength"), "feature")))


def bootstrap_stability(
    df: DataFrame, cols: Sequence[str], attrs: Sequence[str], top: int = 30, reps: int = 50, seed: int = 0
) -> DataFrame:
    """How often a column is among the top F values over bootstrap repetitions, with mean and std of F."""
    rows = poisson_reps(df.select("sample_id", *attrs, *cols), reps, seed, "sample_id")
    f = anova_f(rows, cols, attrs, ["rep"], "_w")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("f_value"), "feature"))
    return f.withColumn("_p", place).groupBy("feature").agg(
        F.avg((F.col("_p") <= top).cast("double")).alias("top_freq"), F.avg("f_value").alias("f_mean"),
        F.stddev_pop("f_value").alias("f_std"),
    )


def loo_knn_accuracy(df: DataFrame, label: str, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Leave-one-out nearest-neighbour accuracy for several k; ties go to the smallest label."""
    near = knn_join(df, df, max(ks), exclude_self=True)
    labels = df.select("sample_id", label)
    votes = neighbor_votes(near, labels, label, ks).join(labels, "sample_id")  # one pass, so the join runs once
    return votes.groupBy("k").agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))


def k_sweep(df: DataFrame, cols: Sequence[str], attrs: Sequence[str], label: str, sizes: Sequence[int], ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """loo_knn_accuracy on the top columns by joint F, for several column counts."""
    order = [r["feature"] for r in anova_top_k(df, cols, attrs, len(cols)).orderBy("place").select("feature").collect()]
    out = None
    for size in sizes:
        vec = F.array(*[F.col(c).cast("double") for c in order[:size]])
        part = loo_knn_accuracy(df.select("sample_id", label, vec.alias("features")), label, ks).withColumn("n_columns", F.lit(size))
        out = part if out is None else out.unionByName(part)
    return out


def selection_spread(results: DataFrame, n_bins: int) -> DataFrame:
    """Best-minus-worst bin accuracy per configuration next to the random baseline's level and flatness.

    `results`: config, ranking, bin, metric, value (already averaged over seeds).
    """
    score = F.col("ranking") != "random"
    return results.groupBy("config", "metric").agg(
        F.max(F.when(score & (F.col("bin") == 0), F.col("value"))).alias("first_bin"),
        F.max(F.when(score & (F.col("bin") == n_bins - 1), F.col("value"))).alias("last_bin"),
        F.avg(F.when(~score, F.col("value"))).alias("random_level"),
        F.stddev_pop(F.when(~score, F.col("value"))).alias("random_bin_std"),
    ).withColumn("spread", F.col("first_bin") - F.col("last_bin"))
