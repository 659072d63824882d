"""Means, Gram sums and shrunk covariances from distributed aggregates.

Rows never reach the driver: tasks add up D x D products of their batches,
Spark sums the partials, and only O(D^2) numbers are collected for the
eigen-decompositions and inverses.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.functions.arrow import lists, matrix, unit_rows, with_columns

CHUNK = 4096  # doubles per partial-sum row
REGULARIZATION = 1e-5


def centroids(df: DataFrame, keys: Sequence[str], features: str = "features", name: str = "mu") -> DataFrame:
    """Mean vector and count per group; partial sums are combined before the shuffle."""
    keys = list(keys)
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    stats = Summarizer.metrics("mean", "count").summary(array_to_vector(F.col(features)))
    out = grouped.agg(stats.alias("_s"))
    return out.select(*keys, vector_to_array("_s.mean").alias(name), F.col("_s.count").alias("n"))


def mean_resultant_length(df: DataFrame, keys: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Length of the mean of unit vectors."""
    units = df.withColumn("_u", V.l2_normalize(features))
    return centroids(units, keys, "_u").select(*keys, "n", V.norm("mu").alias("resultant"))


@dataclass
class Moments:
    """n, sum of x and sum of x xT over some rows."""

    n: int
    total: np.ndarray
    gram: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.total / self.n

    def scatter(self) -> np.ndarray:
        """Sum of (x - mean)(x - mean)T."""
        return self.gram - np.outer(self.total, self.total) / self.n

    def cov(self, ddof: int = 0) -> np.ndarray:
        return self.scatter() / (self.n - ddof)


def gram_partials(df: DataFrame, keys: Sequence[str], features: str, normalize: bool) -> DataFrame:
    """Per-task sums, cut into rows of CHUNK doubles: keys, chunk, vals."""
    keys = list(keys)
    slim = df.select(*keys, F.col(features).alias("_x"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name in keys)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            for key, flat in sums.items():
                parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
                arrays = [pa.array([v] * len(parts), slim_types[j]) for j, v in enumerate(key)]
                arrays.append(pa.array(range(len(parts)), pa.int32()))
                arrays.append(pa.array([p.tolist() for p in parts], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "chunk", "vals"])

        slim_types: list[pa.DataType] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            slim_types = [batch.schema.field(k).type for k in keys]
            x = matrix(batch.column(batch.schema.get_field_index("_x")))
            if normalize:
                x = unit_rows(x)
            if keys:
                frame = batch.select(keys).to_pandas()
                groups = frame.groupby(keys, sort=False, dropna=False).indices
            else:
                groups = {(): slice(None)}
            for key, index in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                part = x[index]
                flat = np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
                key = tuple(k.item() if hasattr(k, "item") else k for k in key)
                sums[key] = sums[key] + flat if key in sums else flat
            if len(sums) * x.shape[1] ** 2 * 8 > 256 << 20:
                yield from flush()  # many groups in one task: hand the sums on early
                sums.clear()
        yield from flush()

    schema = ", ".join(p for p in (key_schema, "chunk int", "vals array<double>") if p)
    return slim.mapInArrow(add_up, schema)


def gram_stats(df: DataFrame, keys: Sequence[str] = (), features: str = "features", normalize: bool = False) -> DataFrame:
    """Summed partials per group and chunk (vals = [n, sum x, sum x xT] cut in chunks)."""
    partials = gram_partials(df, keys, features, normalize)
    total = Summarizer.metrics("sum").summary(array_to_vector("vals"))
    summed = partials.groupBy(*keys, "chunk").agg(total.alias("_s"))
    return summed.select(*keys, "chunk", vector_to_array("_s.sum").alias("vals"))


def _moments(chunks: list[list[float]]) -> Moments:
    flat = np.concatenate([np.asarray(c) for c in chunks])
    d = int((-1 + np.sqrt(1 + 4 * (len(flat) - 1))) / 2 + 0.5)
    return Moments(int(round(flat[0])), flat[1 : d + 1], flat[d + 1 :].reshape(d, d))


def collect_moments(df: DataFrame, features: str = "features", normalize: bool = False) -> Moments | None:
    """Moments of all rows: D^2 + D + 1 numbers on the driver."""
    rows = gram_stats(df, (), features, normalize).orderBy("chunk").collect()
    return _moments([r["vals"] for r in rows]) if rows else None


def collect_group_moments(
    df: DataFrame, keys: Sequence[str], features: str = "features", normalize: bool = False
) -> Iterator[tuple[tuple, Moments]]:
    """Moments of one group after the other; only one group is on the driver at a time."""
    rows = gram_stats(df, keys, features, normalize).orderBy(*keys, "chunk").toLocalIterator()
    current, chunks = None, []
    for row in rows:
        key = tuple(row[k] for k in keys)
        if key != current and chunks:
            yield current, _moments(chunks)
            chunks = []
        current = key
        chunks.append(row["vals"])
    if chunks:
        yield current, _moments(chunks)


def lw_shrinkage(cov: np.ndarray, fourth: float, n: int) -> float:
    """Ledoit-Wolf (2004) intensity from the population covariance and mean |x - mean|^4."""
    p = cov.shape[0]
    trace = float(np.trace(cov))
    mu = trace / p
    square = float((cov**2).sum())
    beta = (fourth - square) / (p * n)
    delta = (square - 2.0 * mu * trace + p * mu**2) / p
    beta = min(beta, delta)
    return 0.0 if beta <= 0 or delta <= 0 else beta / delta


def shrink(cov: np.ndarray, alpha: float) -> np.ndarray:
    p = cov.shape[0]
    return (1.0 - alpha) * cov + alpha * np.trace(cov) / p * np.eye(p)


def precision(cov: np.ndarray, reg: float = REGULARIZATION) -> np.ndarray:
    """Inverse of cov + reg*I by Cholesky, pseudo-inverse when that fails."""
    cov_reg = cov + reg * np.eye(cov.shape[0])
    try:
        half = np.linalg.inv(np.linalg.cholesky(cov_reg))
        return half.T @ half
    except np.linalg.LinAlgError:
        return np.linalg.pinv(cov_reg)


def fourth_moment(df: DataFrame, center: str | None, mean: np.ndarray | None, features: str = "features") -> float:
    """Mean of |x - c|^4 with c from a column or one fixed vector."""
    at = F.col(center) if center else F.array(*[F.lit(float(m)) for m in mean])
    gap = F.zip_with(F.col(features), at, lambda a, b: (a - b) * (a - b))
    square = V.vsum(gap)
    return float(df.select((square * square).alias("q")).agg(F.avg("q")).first()[0])


def ledoit_wolf(df: DataFrame, features: str = "features", normalize: bool = False) -> dict:
    """Mean, shrunk covariance and intensity; a Gram pass and one light pass for the fourth moment."""
    base = df.withColumn(features, V.l2_normalize(features)) if normalize else df
    moments = collect_moments(base, features)
    cov = moments.cov()
    alpha = lw_shrinkage(cov, fourth_moment(base, None, moments.mean, features), moments.n)
    return {"mean": moments.mean, "cov": shrink(cov, alpha), "shrinkage": alpha, "n": moments.n, "moments": moments}


def standardize_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column in one pass."""
    aggs = [f(c).alias(f"{p}{i}") for i, c in enumerate(cols) for p, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def standardize_apply(
    df: DataFrame, fitted: dict[str, tuple[float, float]], clamp: float | None = None
) -> DataFrame:
    """(x - mean)/std; a zero std counts as 1, or std is clamped from below."""
    def width(s: float) -> float:
        return max(s, clamp) if clamp is not None else (s if s > 0 else 1.0)

    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(width(s)) for c, (m, s) in fitted.items()})


def apply_matrix(
    df: DataFrame, weights: np.ndarray, offset: np.ndarray | None = None, features: str = "features", name: str = "projected"
) -> DataFrame:
    """Column name = (x - offset) @ weights for every row, one matrix product per batch."""
    shared = df.sparkSession.sparkContext.broadcast((weights, offset))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index(features)))
            if len(x) == 0:
                x = np.zeros((0, w.shape[0]))
            yield with_columns(batch, {name: lists((x if b is None else x - b) @ w)})

    fields = [f for f in df.schema.fields if f.name != name]
    out = T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return df.drop(name).mapInArrow(project, out) if name != features else df.mapInArrow(project, df.schema)


def whitening_matrix(cov: np.ndarray, gamma: float = 1.0, kappa: float = 1e4) -> np.ndarray:
    """V diag((l + a)^(-gamma/2)) VT with a = l_max/kappa."""
    values, basis = np.linalg.eigh(cov)
    values = np.maximum(values, 0.0)
    return (basis * (values + values.max() / kappa) ** (-gamma / 2.0)) @ basis.T


def whiten(df: DataFrame, fit_on: DataFrame, gamma: float = 1.0, kappa: float = 1e4, features: str = "features") -> DataFrame:
    w = whitening_matrix(collect_moments(fit_on, features).cov(ddof=1), gamma, kappa)
    return apply_matrix(df, w, None, features, "whitened")


def pca_fit(df: DataFrame, k: int, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Mean and top-k axes from the covariance; each axis has its largest entry positive."""
    moments = collect_moments(df, features)
    _, basis = np.linalg.eigh(moments.cov(ddof=1))
    axes = basis[:, ::-1][:, :k]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return moments.mean, axes * signs


def _block_product(df: DataFrame, mean: np.ndarray, block: np.ndarray, features: str) -> np.ndarray:
    """Sum over all rows of (x - mean)(x - mean)T block: tasks add up D x b numbers, never D x D."""
    shared = df.sparkSession.sparkContext.broadcast((mean, block))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, block = shared.value
        total = np.zeros_like(block)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0)) - mean
                total += x.T @ (x @ block)
        flat = total.ravel()
        parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["chunk", "vals"])

    partials = df.select(features).mapInArrow(add_up, "chunk int, vals array<double>")
    sums = partials.groupBy("chunk").agg(Summarizer.metrics("sum").summary(array_to_vector("vals")).alias("_s"))
    rows = sums.select("chunk", vector_to_array("_s.sum").alias("vals")).orderBy("chunk").collect()
    return np.concatenate([r["vals"] for r in rows]).reshape(block.shape) if rows else np.zeros_like(block)


def principal_axes(
    df: DataFrame, k: int, features: str = "features", extra: int = 8, rounds: int = 100, tol: float = 1e-9, seed: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, top-k axes and their variances by block power iteration: the driver holds D x (k + extra) numbers.

    Every round is one narrow pass and a thin orthogonalisation; it ends once no wanted variance moves by more than `tol` of
    the largest. Each axis has its largest entry positive. Null vectors are left out; a table with fewer than two rows, or
    less than k entries in a vector, has no or fewer axes.
    """
    rows = df.where(F.col(features).isNotNull()).select(features)
    if rows.limit(2).count() < 2:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    head = centroids(rows, [], features).first()
    mean, n = np.array(head["mu"]), head["n"]
    k = min(k, len(mean))
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), min(len(mean), k + extra))))[0]
    last = np.full(k, np.inf)
    for _ in range(rounds):
        image = _block_product(rows, mean, block, features) / (n - 1)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, axes = values[::-1][:k], (block @ turn)[:, ::-1][:, :k]
        if np.abs(values - last).max() <= tol * max(values[0], 1e-300):
            break
        last, block = values, np.linalg.qr(image)[0]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return mean, axes * signs, values


def pca_project(df: DataFrame, fit_on: DataFrame, k: int, features: str = "features") -> DataFrame:
    mean, axes = pca_fit(fit_on, k, features)
    return apply_matrix(df, axes, mean, features, "projected")


def effective_rank(df: DataFrame, top: int = 50, features: str = "features") -> float:
    """exp(entropy) of the normalised top singular values of the centred vectors."""
    scatter = collect_moments(df, features).scatter()
    sigma = np.sqrt(np.clip(np.linalg.eigvalsh(scatter)[::-1][:top], 0.0, None))
    share = sigma / sigma.sum()
    share = share[share > 1e-10]
    return float(np.exp(-(share * np.log(share)).sum()))


def subspace_overlap(a: DataFrame, b: DataFrame, k: int, features: str = "features") -> float:
    """Mean squared cosine between the top-k principal subspaces of two tables."""
    _, u = pca_fit(a, k, features)
    _, w = pca_fit(b, k, features)
    return float(((u.T @ w) ** 2).sum() / k)


def correlation_matrix(moments: Moments) -> np.ndarray:
    cov = moments.cov()
    std = np.sqrt(np.clip(np.diag(cov), 1e-300, None))
    return cov / np.outer(std, std)


def correlation_redundancy(df: DataFrame, features: str = "features") -> dict[str, float]:
    """How redundant columns are: eigen-rank at 95%, median/max |r| and pair counts."""
    corr = correlation_matrix(collect_moments(df, features))
    values = np.clip(np.linalg.eigvalsh(corr)[::-1], 0.0, None)
    upper = np.abs(corr[np.triu_indices(len(corr), 1)])
    return {
        "rank95": int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1),
        "median_abs_r": float(np.median(upper)),
        "max_abs_r": float(upper.max()),
        "pairs_above_05": int((upper > 0.5).sum()),
        "pairs_above_07": int((upper > 0.7).sum()),
    }
