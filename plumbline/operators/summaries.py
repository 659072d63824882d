"""Condition-level and table-level summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.moments import centroids
from plumbline.operators.prefix import percentiles


def condition_stats(df: DataFrame, attrs: Sequence[str], with_spread: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """Per condition the count, mean and population std of scores, and means of further columns."""
    aggs = [F.count("*").alias("n_samples")]
    for c in with_spread:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in means]
    return df.groupBy(*attrs).agg(*aggs)


def feature_type_stats(df: DataFrame, scores: Sequence[str], keys: Sequence[str] = ("model", "feature_type")) -> DataFrame:
    """Mean and population std of scores per model and feature type."""
    aggs = [f(c).alias(f"{c}_{n}") for c in scores for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def quantile_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population std and the 5/50/95 percentiles of a column."""
    keys = list(keys)
    base = df.where(V.finite(value).isNotNull())
    stats = (base.groupBy(*keys) if keys else base.groupBy()).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    q = percentiles(base, value, [0.05, 0.5, 0.95], keys, "_q")
    out = stats.join(q, keys) if keys else stats.join(F.broadcast(q))
    return out.select(
        *keys, "n", "mean", "std", F.col("_q")[0].alias("q05"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q95")
    )


def cosine_to_mean(df: DataFrame, keys: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Cosine of every row with the direction of its group's mean unit vector."""
    keys = list(keys)
    units = df.withColumn("_u", V.l2_normalize(features))
    mean = centroids(units, keys, "_u", "_mu").select(*keys, V.l2_normalize("_mu").alias("_dir"))
    joined = units.join(mean, keys) if keys else units.join(F.broadcast(mean))
    return joined.withColumn("cos_to_mean", V.dot("_u", "_dir")).drop("_u", "_dir")


def most_populous(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """The most common joint value of some attributes; the smallest one on ties."""
    counts = df.groupBy(*attrs).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *attrs).limit(1)


def vector_hash(features: str = "features", decimals: int = 6):
    """md5 of the vector rounded to some decimals."""
    return F.md5(F.to_json(F.transform(features, lambda v: F.round(v, decimals))))


def dedupe_vectors(df: DataFrame, decimals: int = 6, sample_id: str = "sample_id") -> DataFrame:
    """Rows whose rounded vector occurs first by id.

    The first id of each hash is an aggregate with map-side combine, so a
    vector repeated very often never gathers in one task.
    """
    first = df.groupBy(vector_hash("features", decimals).alias("_h")).agg(F.min(sample_id).alias(sample_id))
    return df.join(first.select(sample_id), sample_id, "left_semi")


def dedupe_stats(df: DataFrame, decimals: int = 6) -> DataFrame:
    hashes = df.select(vector_hash("features", decimals).alias("_h")).groupBy("_h").agg(F.count("*").alias("_c"))
    return hashes.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("original_n"), F.count("*").alias("deduped_n"),
        (F.coalesce(F.sum("_c"), F.lit(0)) - F.count("*")).alias("n_removed"),
    ).withColumn("dedupe_key", F.lit(f"md5_round{decimals}"))


def norm_summary(df: DataFrame, keys: Sequence[str] = (), features: str = "features") -> DataFrame:
    """Median, mean and population std of vector lengths."""
    out = quantile_summary(df.withColumn("_len", V.norm(features)), "_len", keys)
    return out.select(*keys, "n", F.col("q50").alias("median"), "mean", "std")


def pivot_report(df: DataFrame, row: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """row x column table of a metric with a last-minus-first column; missing cells are null."""
    wide = df.groupBy(row).pivot(column, list(names)).agg(F.first(value))
    return wide.withColumn("last_minus_first", F.col(f"`{names[-1]}`") - F.col(f"`{names[0]}`"))


def long_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str], names: Mapping[str, str] | None = None) -> DataFrame:
    """Wide columns as rows (feature, value)."""
    names = names or {}
    cells = F.array(*[F.struct(F.lit(names.get(c, c)).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.explode(cells).alias("_e")).select(*keep, "_e.feature", "_e.value")
