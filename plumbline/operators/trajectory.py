"""How representations concentrate and separate along generation steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.moments import mean_resultant_length
from plumbline.operators.neighbors import knn_radius
from plumbline.operators.pairing import step_similarity
from plumbline.operators.ranking import detection_summary
from plumbline.operators.sampling import random_pairs
from plumbline.operators.scoring import GlobalFit, add_energy, calibrate, fit_global
from plumbline.operators.summaries import cosine_to_mean, quantile_summary

EPS = 1e-12


def energy_fit(real: DataFrame) -> GlobalFit:
    fit = fit_global(real)
    fit.mean, fit.std = calibrate(add_energy(real, fit), "energy")
    return fit


def energy_aurocs(real: DataFrame, gen: DataFrame, fit: GlobalFit, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC of real (0) against generated (1) by z, |z| and z^2 of the global energy."""
    keys = list(keys)
    z = (F.col("energy") - F.lit(fit.mean)) / F.lit(fit.std + EPS)
    g = add_energy(gen, fit).select(*keys, z.alias("z"), F.lit(1).alias("is_gen"))
    r = add_energy(real, fit).select(z.alias("z"), F.lit(0).alias("is_gen"))
    if keys:
        tags = gen.select(*keys).distinct().agg(F.collect_list(F.struct(*keys)).alias("_k"))  # one entry per step
        r = r.join(F.broadcast(tags)).withColumn("_t", F.explode("_k")).select("_t.*", "z", "is_gen")
    variants = F.array(
        F.struct(F.lit("one_sided").alias("variant"), F.col("z").alias("s")),
        F.struct(F.lit("two_sided_abs").alias("variant"), F.abs("z").alias("s")),
        F.struct(F.lit("two_sided_sq").alias("variant"), (F.col("z") * F.col("z")).alias("s")),
    )
    long = g.unionByName(r).withColumn("_e", F.explode(variants)).select(*keys, "is_gen", "_e.variant", "_e.s")
    return detection_summary(long, "s", "is_gen", [*keys, "variant"])


def pairwise_cosine(df: DataFrame, n_pairs: int = 10_000, seed: int = 42, keys: Sequence[str] = ()) -> DataFrame:
    """Cosine of randomly drawn row pairs per group: keys, pair, cosine."""
    keys = list(keys)
    units = df.select(*keys, "sample_id", V.l2_normalize("features").alias("_u"))
    pairs = random_pairs(df, n_pairs, seed, keys=keys)
    left = units.select(*keys, F.col("sample_id").alias("left_id"), F.col("_u").alias("_l"))
    right = units.select(*keys, F.col("sample_id").alias("right_id"), F.col("_u").alias("_r"))
    joined = pairs.join(left, [*keys, "left_id"]).join(right, [*keys, "right_id"])
    return joined.select(*keys, "pair", V.dot("_l", "_r").alias("cosine"))


def trajectory_report(
    steps: DataFrame, real: DataFrame, final: DataFrame, k: int = 5, n_pairs: int = 2_000, seed: int = 42
) -> DataFrame:
    """One row per step: resultant length, cosine to mean, pair cosine, k-NN radius, energy, AUROC and paired cosine.

    Everything about the real set is computed once; steps are a handful.
    """
    fit = energy_fit(real)
    out = mean_resultant_length(steps, ["step"]).drop("n")
    cos = quantile_summary(cosine_to_mean(steps, ["step"]), "cos_to_mean", ["step"])
    out = out.join(cos.select("step", F.col("mean").alias("cos_to_mean"), F.col("std").alias("cos_to_mean_std")), "step")
    energy = quantile_summary(add_energy(steps, fit), "energy", ["step"])
    out = out.join(energy.select("step", F.col("mean").alias("energy"), F.col("q50").alias("energy_q50")), "step")
    auroc = energy_aurocs(real, steps, fit, ["step"])
    out = out.join(auroc.groupBy("step").pivot("variant", ["one_sided", "two_sided_abs", "two_sided_sq"]).agg(F.first("auroc")), "step")
    out = out.join(step_similarity(steps, final).select("step", F.col("mean_cosine").alias("paired_cosine")), "step")
    pair = pairwise_cosine(steps, n_pairs, seed, ["step"]).groupBy("step").agg(F.avg("cosine").alias("pair_cosine"))
    near = knn_radius(steps, real, k, seed=seed, keys=["step"]).groupBy("step").agg(F.avg("radius").alias("knn_radius"))
    return out.join(pair, "step").join(near, "step")
