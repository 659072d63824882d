"""Gaussian realism and attribute-faithfulness scores.

Fitting needs one Gram pass, one mean pass per attribute and one light pass
for the shrinkage. Scoring is map-only: every task multiplies its batches with
the broadcast means and precision. Means of an attribute with more values than
one broadcast may hold stay a table: energies are squared distances after the
precision's root is applied, so the smallest ones per row are a nearest-mean
join, which sends a row only to means that can be among them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.functions.arrow import matrix, unit_rows, with_columns
from plumbline.operators import moments as M
from plumbline.operators.conditions import filter_seen
from plumbline.operators.pivot_join import nearest, written
from plumbline.session import BROADCAST_BYTES, limit, small_table

EPS = 1e-12


@dataclass
class GlobalFit:
    mu: np.ndarray
    precision: np.ndarray
    n: int
    shrinkage: float
    mean: float = 0.0
    std: float = 1.0


@dataclass
class ValueBlock:
    """Some attribute values with their means; `precisions` only in the per-value variant."""

    values: np.ndarray
    mus: np.ndarray
    precisions: np.ndarray | None = None


@dataclass
class AttributeFit:
    """Means in blocks, or as `table` (value, mu) of an attribute with very many values."""

    attr: str
    precision: np.ndarray | None
    blocks: list[ValueBlock]
    mean: float = 0.0
    std: float = 1.0
    table: DataFrame | None = None

    @property
    def n_values(self) -> int:
        return self.table.count() if self.table is not None else sum(len(b.values) for b in self.blocks)


@dataclass
class Model:
    overall: GlobalFit
    attributes: dict[str, AttributeFit] = field(default_factory=dict)

    @property
    def attrs(self) -> list[str]:
        return list(self.attributes)


def fit_global(real: DataFrame, features: str = "features", reg: float = M.REGULARIZATION) -> GlobalFit:
    """Mean and shrunk precision of the unit vectors; identity covariance below two rows."""
    units = real.select(V.l2_normalize(features).alias("_u"))
    moments = M.collect_moments(units, "_u")
    if moments is None:
        raise ValueError("no reference rows to fit")
    d = len(moments.total)
    if moments.n < 2:
        return GlobalFit(moments.mean, M.precision(np.eye(d), reg), moments.n, 1.0)
    cov = moments.cov()
    alpha = M.lw_shrinkage(cov, M.fourth_moment(units, None, moments.mean, "_u"), moments.n)
    return GlobalFit(moments.mean, M.precision(M.shrink(cov, alpha), reg), moments.n, alpha)


def pooled_precision(
    units: DataFrame, class_means: DataFrame, keys: Sequence[str], min_samples: int, reg: float = M.REGULARIZATION
) -> np.ndarray:
    """Precision of the pooled within-class covariance over classes of `min_samples` rows.

    S_w = sum x xT - sum_c n_c mu_c mu_cT, so no residual vectors are kept;
    with no more rows than dimensions the result is I/(reg + 1e-3).
    """
    kept = class_means.where(F.col("n") >= min_samples)
    rows = units.join(kept.select(*keys, F.col("mu").alias("_mu")), list(keys))
    moments = M.collect_moments(rows, "_u")
    d = len(moments.total) if moments else len(units.select("_u").first()[0])
    if moments is None or moments.n <= d:
        return np.eye(d) / (reg + 1e-3)
    weighted = kept.select(V.scale("mu", F.sqrt("n")).alias("_w"))
    between = M.collect_moments(weighted, "_w").gram
    cov = (moments.gram - between) / moments.n
    alpha = M.lw_shrinkage(cov, M.fourth_moment(rows, "_mu", None, "_u"), moments.n)
    return M.precision(M.shrink(cov, alpha), reg)


def _value_blocks(means: DataFrame, attr: str, d: int, budget: int) -> list[ValueBlock]:
    """Sorted attribute values in blocks whose means stay below the broadcast budget."""
    per_block = max(1, budget // (8 * d))
    blocks, values, mus = [], [], []
    for row in means.select(attr, "mu").orderBy(attr).toLocalIterator():
        values.append(row[0])
        mus.append(np.asarray(row[1]))
        if len(values) == per_block:
            blocks.append(ValueBlock(np.asarray(values), np.stack(mus)))
            values, mus = [], []
    if values:
        blocks.append(ValueBlock(np.asarray(values), np.stack(mus)))
    return blocks


def fit_attribute(
    real: DataFrame, attr: str, features: str = "features", min_samples: int = 2,
    shared_cov: bool = True, reg: float = M.REGULARIZATION,
) -> AttributeFit:
    """Per-value means with one shared within-class precision.

    Without `shared_cov`, or with a single value, every value has its own
    shrunk precision instead.
    """
    units = real.where(F.col(attr).isNotNull()).select(attr, V.l2_normalize(features).alias("_u"))
    means = written(M.centroids(units, [attr], "_u"), "means")
    d = len(units.select("_u").first()[0])
    budget = limit(real.sparkSession, BROADCAST_BYTES)
    if shared_cov and means.count() * 8 * d > 2 * budget:  # two blocks at most
        return AttributeFit(attr, pooled_precision(units, means, [attr], min_samples, reg), [], table=means.select(F.col(attr).alias("value"), "mu"))
    blocks = _value_blocks(means, attr, d, budget)
    n_values = sum(len(b.values) for b in blocks)
    if shared_cov and n_values >= 2:
        return AttributeFit(attr, pooled_precision(units, means, [attr], min_samples, reg), blocks)
    # Own covariance per value: means and fourth moments by value, Gram sums one value at a time.
    centred = units.join(means.select(attr, "mu"), attr)
    square = V.vsum(F.zip_with("_u", "mu", lambda a, b: (a - b) * (a - b)))
    fourth = {
        r[0]: r[1]
        for r in centred.select(attr, (square * square).alias("q")).groupBy(attr).agg(F.avg("q")).toLocalIterator()
    }
    per_block = max(1, budget // (8 * d * d))
    blocks, values, mus, pre = [], [], [], []

    def close() -> None:
        if values:
            blocks.append(ValueBlock(np.asarray(values), np.stack(mus), np.stack(pre)))

    for (value,), mom in M.collect_group_moments(units, [attr], "_u"):
        if mom.n >= min_samples:
            cov = mom.cov()
            p = M.precision(M.shrink(cov, M.lw_shrinkage(cov, fourth[value], mom.n)), reg)
        else:
            p = np.eye(d) / (reg + 1e-3)
        values.append(value)
        mus.append(mom.mean)
        pre.append(p)
        if len(values) == per_block:
            close()
            values, mus, pre = [], [], []
    close()
    return AttributeFit(attr, None, blocks)


def _energies(u: np.ndarray, mus: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, values) squared Mahalanobis distances in the expanded form, clamped at 0."""
    up = u @ p
    own = np.einsum("nd,nd->n", up, u)
    mp = mus @ p
    return np.maximum(own[:, None] - 2.0 * up @ mus.T + np.einsum("vd,vd->v", mp, mus)[None, :], 0.0)


def add_energy(df: DataFrame, fit: GlobalFit, features: str = "features", name: str = "energy") -> DataFrame:
    """Squared Mahalanobis distance of the unit vector to the global mean."""
    return add_min_energy(df, fit.mu[None, :], fit.precision, features, name)


def add_min_energy(
    df: DataFrame, mus: np.ndarray, precision: np.ndarray, features: str = "features", name: str = "energy"
) -> DataFrame:
    """Smallest energy over several means that share one precision."""
    shared = df.sparkSession.sparkContext.broadcast((mus, precision))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, p = shared.value
        for batch in batches:
            if batch.num_rows:
                u = unit_rows(matrix(batch.column(batch.schema.get_field_index(features))))
                energy = _energies(u, centres, p).min(axis=1)
            else:
                energy = np.zeros(0)
            yield with_columns(batch, {name: energy})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def add_margin(df: DataFrame, fit: AttributeFit, features: str = "features", name: str = "margin") -> DataFrame:
    """E(true value) - smallest E(other value); null where undefined.

    Each block of means is one narrow pass that carries the running true and
    smallest other energies.
    """
    if fit.table is not None:
        return _margin_by_join(df, fit, features, name)
    attr = fit.attr
    fields = [*df.schema.fields, T.StructField("_true", T.DoubleType()), T.StructField("_other", T.DoubleType())]
    out = df.withColumns({"_true": F.lit(None).cast("double"), "_other": F.lit(None).cast("double")})
    for block in fit.blocks:
        shared = df.sparkSession.sparkContext.broadcast((block, fit.precision))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part, p = shared.value
            for batch in batches:
                if batch.num_rows == 0:
                    yield batch
                    continue
                u = unit_rows(matrix(batch.column(batch.schema.get_field_index(features))))
                if part.precisions is None:
                    e = _energies(u, part.mus, p)
                else:
                    e = np.concatenate(
                        [_energies(u, m[None, :], q) for m, q in zip(part.mus, part.precisions)], axis=1
                    )
                own = np.asarray(batch.column(batch.schema.get_field_index(attr)).to_pandas())
                hit = own[:, None] == part.values[None, :]
                true = np.where(hit, e, np.nan)
                true = np.where(hit.any(axis=1), np.nansum(true, axis=1), np.nan)
                other = np.where(hit, np.inf, e).min(axis=1)
                old = {c: batch.column(batch.schema.get_field_index(c)).to_pandas().to_numpy(np.float64) for c in ("_true", "_other")}
                true = np.where(np.isnan(true), old["_true"], true)
                other = np.fmin(np.where(np.isinf(other), np.nan, other), old["_other"])
                yield with_columns(
                    batch,
                    {"_true": pa.array(true, from_pandas=True), "_other": pa.array(other, from_pandas=True)},
                )

        out = out.mapInArrow(run, T.StructType(fields))
    return out.withColumn(name, F.col("_true") - F.col("_other")).drop("_true", "_other")


def _rooted(df: DataFrame, vector: Column | str, precision: np.ndarray, name: str) -> DataFrame:
    """Vectors times the precision's root: squared distances between them are energies."""
    return M.apply_matrix(df.withColumn(name, vector if isinstance(vector, Column) else F.col(vector)), np.linalg.cholesky(precision), None, name, name)


def _nearest_means(df: DataFrame, means: DataFrame, precision: np.ndarray, features: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered rows with their rooted vectors (`_row`, `_x`), rooted means (value, `_m`), and the k nearest means per row.

    The rows are written once, so that their numbers stay.
    """
    rows = written(_rooted(df, V.l2_normalize(features), precision, "_x").withColumn("_row", F.monotonically_increasing_id()), "rows")
    centres = _rooted(means.select("value", "mu"), "mu", precision, "_m").select("value", "_m")
    near = nearest(rows.where(F.col(features).isNotNull()).select(F.col("_row").alias("id"), F.col("_x").alias("v")), centres.select(F.col("value").alias("id"), F.col("_m").alias("v")), k, False, False)
    return rows, centres, near


def _margin_by_join(df: DataFrame, fit: AttributeFit, features: str, name: str) -> DataFrame:
    """add_margin without means on the driver or in a broadcast: of a row's two nearest means one is not its own."""
    rows, centres, near = _nearest_means(df, fit.table.where("value is not null"), fit.precision, features, 2)
    own = rows.select("_row", "_x", F.col(fit.attr).alias("value")).join(centres, "value").select("_row", "value", V.l2_distance("_x", "_m").alias("_true"))
    other = near.withColumnRenamed("query_id", "_row").join(own, "_row").where(F.col("ref_id") != F.col("value")).groupBy("_row").agg(F.first("_true").alias("_true"), F.min("distance").alias("_other"))
    margin = other.select("_row", (F.col("_true") * F.col("_true") - F.col("_other") * F.col("_other")).alias(name))
    return rows.join(margin, "_row", "left").select(*df.columns, name)


def calibrate(df: DataFrame, value: str) -> tuple[float, float]:
    """Mean and sample std of a column; (0, 1) without rows, std 1 with a single row."""
    row = df.where(F.col(value).isNotNull()).agg(F.count("*"), F.avg(value), F.stddev_samp(value)).first()
    if row[0] == 0:
        return 0.0, 1.0
    return float(row[1]), float(row[2]) if row[0] > 1 else 1.0


def _class_means(rows: DataFrame, attrs: Sequence[str], features: str, most: int) -> dict[str, list] | None:
    """(value, n, mean) of every attribute value from one aggregate, or None if they exceed `most` rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("long").alias("value")) for a in attrs])
    long = rows.select(F.explode(cells).alias("e"), V.l2_normalize(features).alias("_u"))
    means = M.centroids(long.where(F.col("e.value").isNotNull()).select("e.attr", "e.value", "_u"), ["attr", "value"], "_u")
    found = means.limit(most + 1).collect()
    if len(found) > most:
        return None
    out: dict[str, list] = {a: [] for a in attrs}
    for r in sorted(found, key=lambda r: (r["attr"], r["value"])):
        out[r["attr"]].append((r["value"], r["n"], np.asarray(r["mu"])))
    return out


def _fourth_moments(
    rows: DataFrame, attrs: Sequence[str], features: str, mu: np.ndarray, classes: dict[str, list], min_samples: int
) -> dict[str, float]:
    """Mean |x - c|^4 around the global mean ('') and around each attribute's class means, in one pass."""
    tables = {
        a: (np.asarray([v for v, n, _ in c if n >= min_samples]), np.asarray([m for _, n, m in c if n >= min_samples]))
        for a, c in classes.items()
    }
    shared = rows.sparkSession.sparkContext.broadcast((mu, tables))
    slim = rows.select(*attrs, features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, means = shared.value
        total, count = np.zeros(1 + len(attrs)), np.zeros(1 + len(attrs))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            u = unit_rows(matrix(batch.column(batch.schema.get_field_index(features))))
            total[0] += (((u - centre) ** 2).sum(axis=1) ** 2).sum()
            count[0] += len(u)
            for j, a in enumerate(attrs, 1):
                values, mus = means[a]
                if len(values) == 0:
                    continue
                own = batch.column(batch.schema.get_field_index(a)).to_pandas().to_numpy()
                at = np.clip(np.searchsorted(values, own), 0, len(values) - 1)
                hit = values[at] == own
                total[j] += (((u[hit] - mus[at[hit]]) ** 2).sum(axis=1) ** 2).sum()
                count[j] += hit.sum()
        names = ["", *attrs]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array(count)], names=["attr", "q", "c"])

    out = slim.mapInArrow(run, "attr string, q double, c double").groupBy("attr").agg(F.sum("q"), F.sum("c")).collect()
    return {r[0]: r[1] / r[2] if r[2] else 0.0 for r in out}


def fit_components(
    calib: DataFrame, attrs: Sequence[str], features: str = "features", shared_cov: bool = True,
    seen: DataFrame | None = None, min_samples: int = 2, reg: float = M.REGULARIZATION,
) -> Model:
    """Fit the global and per-attribute statistics and calibrate both on the same rows.

    Four passes: Gram sums, class means, fourth moments, calibration. A class
    below two rows is one row and equals its mean, so the pooled scatter needs
    no Gram pass of its own. Attributes with too many values for one broadcast
    are fitted one by one in blocks.
    """
    rows = filter_seen(calib, seen, attrs).select(*attrs, features)
    moments = M.collect_moments(rows, features, normalize=True)
    if moments is None:
        raise ValueError("no reference rows to fit")
    d = len(moments.total)
    most = max(1, limit(rows.sparkSession, BROADCAST_BYTES) // (8 * d))
    classes = _class_means(rows, attrs, features, most) if shared_cov and min_samples <= 2 and moments.n >= 2 else None
    complete = classes is not None and all(sum(n for _, n, _ in c) == moments.n for c in classes.values())
    if not complete:
        model = Model(fit_global(rows, features, reg))
        for attr in attrs:
            model.attributes[attr] = fit_attribute(rows, attr, features, min_samples, shared_cov, reg)
    else:
        fourth = _fourth_moments(rows, attrs, features, moments.mean, classes, min_samples)
        cov = moments.cov()
        alpha = M.lw_shrinkage(cov, fourth[""], moments.n)
        model = Model(GlobalFit(moments.mean, M.precision(M.shrink(cov, alpha), reg), moments.n, alpha))
        for attr in attrs:
            if len(classes[attr]) < 2:
                model.attributes[attr] = fit_attribute(rows, attr, features, min_samples, shared_cov, reg)
                continue
            n_kept = sum(n for _, n, _ in classes[attr] if n >= min_samples)
            within = moments.gram - sum(n * np.outer(m, m) for _, n, m in classes[attr])
            if n_kept <= d:
                p = np.eye(d) / (reg + 1e-3)
            else:
                pooled = within / n_kept
                p = M.precision(M.shrink(pooled, M.lw_shrinkage(pooled, fourth[attr], n_kept)), reg)
            block = ValueBlock(np.asarray([v for v, _, _ in classes[attr]]), np.stack([m for _, _, m in classes[attr]]))
            model.attributes[attr] = AttributeFit(attr, p, [block])
    return _calibrated(rows, model, features)


def _calibrated(rows: DataFrame, model: Model, features: str) -> Model:
    """Set mean and sample std of the energies and margins on the fitted rows."""
    scored = add_energy(rows, model.overall, features, "_m_")
    for attr, fit in model.attributes.items():
        scored = add_margin(scored, fit, features, f"_m_{attr}")
    fits = [model.overall, *model.attributes.values()]
    cols = ["_m_", *[f"_m_{a}" for a in model.attributes]]
    row = scored.agg(*[f(c) for c in cols for f in (F.avg, F.stddev_samp, F.count)]).first()
    for i, fit in enumerate(fits):
        mean, std, n = row[3 * i : 3 * i + 3]
        fit.mean, fit.std = (0.0, 1.0) if n == 0 else (float(mean), float(std) if n > 1 else 1.0)
    return model


def score_from_components(
    df: DataFrame, model: Model, features: str = "features", two_sided: bool = False, keep_margins: bool = False
) -> DataFrame:
    """Add realism_z, faithfulness_z and trust (their sum); lower is better.

    A row whose own value is unknown has margin 0, which is still z-scored.
    """
    out = add_energy(df, model.overall, features, "_energy")
    z = (F.col("_energy") - F.lit(model.overall.mean)) / F.lit(model.overall.std + EPS)
    out = out.withColumn("realism_z", z * z if two_sided else z)
    total = F.lit(0.0)
    for attr, fit in model.attributes.items():
        out = add_margin(out, fit, features, f"margin_{attr}")
        out = out.withColumn(f"margin_{attr}", F.coalesce(f"margin_{attr}", F.lit(0.0)))
        total = total + (F.col(f"margin_{attr}") - F.lit(fit.mean)) / F.lit(fit.std + EPS)
    out = out.withColumn("faithfulness_z", total / F.lit(float(max(1, len(model.attributes)))))
    out = out.withColumn("trust", F.col("realism_z") + F.col("faithfulness_z")).drop("_energy")
    return out if keep_margins else out.drop(*[f"margin_{a}" for a in model.attrs])


def model_table(df: DataFrame, model: Model) -> DataFrame:
    """The fitted means and calibration as rows (scope, value, mean, std, mu) to be stored."""
    spark = df.sparkSession
    rows = [("global", None, model.overall.mean, model.overall.std, model.overall.mu.tolist())]
    more = []
    for attr, fit in model.attributes.items():
        if fit.table is not None:
            more.append(fit.table.select(F.lit(attr).alias("scope"), F.col("value").cast("string").alias("value"), F.lit(fit.mean).alias("mean"), F.lit(fit.std).alias("std"), "mu"))
        for block in fit.blocks:
            rows += [(attr, str(v), fit.mean, fit.std, m.tolist()) for v, m in zip(block.values, block.mus)]
    return reduce(DataFrame.unionByName, more, spark.createDataFrame(rows, "scope string, value string, mean double, std double, mu array<double>"))


@dataclass
class MixtureFit:
    """Component means in one array, or as `table` (value, mu) of very many."""

    mus: np.ndarray | None
    precision: np.ndarray
    mean: float
    std: float
    table: DataFrame | None = None


def fit_mixture(
    real: DataFrame, component: Sequence[str], features: str = "features", min_samples: int = 10,
    seen: DataFrame | None = None,
) -> MixtureFit:
    """Component means with one pooled precision, for conditions, seen conditions or one attribute.

    Components below `min_samples` rows are left out; without any, the global
    Gaussian is the only component.
    """
    rows = filter_seen(real, seen, component).select(F.xxhash64(*component).alias("_c"), features)
    d = len(rows.select(features).first()[0])
    most = max(1, limit(real.sparkSession, BROADCAST_BYTES) // (8 * d))
    classes = _class_means(rows, ["_c"], features, most)
    if classes is None:
        return _many_components(real, rows, features, min_samples)
    kept = [c for c in classes["_c"] if c[1] >= min_samples]
    if not kept:
        fit = fit_global(real, features)
        mus, p = fit.mu[None, :], fit.precision
    else:
        if len(kept) < len(classes["_c"]):
            keys = small_table(real.sparkSession, [{"_c": v} for v, _, _ in kept], [("_c", "long")])
            rows = rows.join(F.broadcast(keys), "_c", "left_semi")
        mus = np.stack([m for _, _, m in kept])
        moments = M.collect_moments(rows, features, normalize=True)
        p = np.eye(d) / (M.REGULARIZATION + 1e-3)
        if moments.n > d:
            cov = (moments.gram - sum(n * np.outer(m, m) for _, n, m in kept)) / moments.n
            fourth = _fourth_moments(rows, ["_c"], features, moments.mean, {"_c": kept}, min_samples)["_c"]
            p = M.precision(M.shrink(cov, M.lw_shrinkage(cov, fourth, moments.n)))
    mean, std = calibrate(add_min_energy(real.select(features), mus, p, features), "energy")
    return MixtureFit(mus, p, mean, std)


def _many_components(real: DataFrame, rows: DataFrame, features: str, min_samples: int) -> MixtureFit:
    """fit_mixture of rows(_c, features) whose components' means exceed one broadcast."""
    units = rows.select("_c", V.l2_normalize(features).alias("_u"))
    means = written(M.centroids(units, ["_c"], "_u"), "means")
    kept = means.where(F.col("n") >= min_samples).select(F.col("_c").alias("value"), "mu")
    if kept.isEmpty():
        fit = fit_global(real, features)
        mean, std = calibrate(add_min_energy(real.select(features), fit.mu[None, :], fit.precision, features), "energy")
        return MixtureFit(fit.mu[None, :], fit.precision, mean, std)
    fit = MixtureFit(None, pooled_precision(units, means, ["_c"], min_samples), 0.0, 1.0, kept)
    fit.mean, fit.std = calibrate(_component_energy(real.select(features), fit, features, "energy"), "energy")
    return fit


def _component_energy(df: DataFrame, fit: MixtureFit, features: str, name: str) -> DataFrame:
    """Smallest energy over the components."""
    if fit.table is None:
        return add_min_energy(df, fit.mus, fit.precision, features, name)
    rows, _, near = _nearest_means(df, fit.table, fit.precision, features, 1)
    least = near.select(F.col("query_id").alias("_row"), (F.col("distance") * F.col("distance")).alias(name))
    return rows.join(least, "_row", "left").select(*df.columns, name)


def mixture_realism(df: DataFrame, fit: MixtureFit, features: str = "features", two_sided: bool = True) -> DataFrame:
    out = _component_energy(df, fit, features, "_e")
    z = (F.col("_e") - F.lit(fit.mean)) / F.lit(fit.std + EPS)
    return out.withColumn("mixture_z", z * z if two_sided else z).drop("_e")


def target_alignment(
    df: DataFrame, targets: DataFrame, attrs: Sequence[str], projection: np.ndarray | None = None,
    features: str = "features",
) -> DataFrame:
    """-cos(projected vector, target vector of the row's condition); 0 and `no_target` without one."""
    base = df if projection is None else M.apply_matrix(df, projection, None, features, "_proj")
    vec = features if projection is None else "_proj"
    side = targets.select(*attrs, F.col("target").alias("_target"))
    joined = base.join(side, list(attrs), "left")
    score = -V.dot(V.l2_normalize(vec), V.l2_normalize("_target"))
    return joined.withColumns(
        {"no_target": F.col("_target").isNull(), "alignment": F.coalesce(score, F.lit(0.0))}
    ).drop("_target", "_proj")


Scorer = Callable[..., DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(name: str) -> Callable[[Scorer], Scorer]:
    """Register a function (real, gen, attrs, **options) -> gen with trust columns."""

    def add(fn: Scorer) -> Scorer:
        SCORERS[name] = fn
        return fn

    return add


def score(method: str, real: DataFrame, gen: DataFrame, attrs: Sequence[str], **options) -> DataFrame:
    if method not in SCORERS:
        raise ValueError(f"unknown scoring method {method!r}; available: {sorted(SCORERS)}")
    return SCORERS[method](real, gen, attrs, **options)


def as_scalar_score(df: DataFrame, col: str) -> DataFrame:
    """Trust columns of a scorer with one number: realism 0, faithfulness and trust the number."""
    return df.withColumns({"realism_z": F.lit(0.0), "faithfulness_z": F.col(col), "trust": F.col(col)}).drop(col)


@scorer("mahalanobis")
def mahalanobis(real: DataFrame, gen: DataFrame, attrs: Sequence[str], seen: DataFrame | None = None, **options) -> DataFrame:
    model = fit_components(real, attrs, shared_cov=options.get("shared_cov", True), seen=seen)
    return score_from_components(gen, model)


@scorer("target")
def target(real: DataFrame, gen: DataFrame, attrs: Sequence[str], targets: DataFrame, **options) -> DataFrame:
    scored = target_alignment(gen, targets, attrs, options.get("projection"))
    return as_scalar_score(scored.drop("no_target"), "alignment")
