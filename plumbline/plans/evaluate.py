"""Composed evaluations: from two vector tables to the report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import distances as D
from plumbline.operators import ranking as R
from plumbline.operators import selection as S
from plumbline.operators.conditions import filter_seen, finite_scores, tag_arm
from plumbline.operators.moments import centroids
from plumbline.operators.neighbors import authenticity, beta_recall
from plumbline.operators.prefix import percentiles
from plumbline.operators.sampling import cross_fit_split, stratified_subsample
from plumbline.operators.scoring import fit_components, score_from_components
from plumbline.operators.summaries import condition_stats
from plumbline.session import cut_lineage

GRID = tuple(i / 10 for i in range(11))
SCORES = ("trust", "realism_z", "faithfulness_z")


def centre_distance(real: DataFrame, rows: DataFrame) -> DataFrame:
    """Distance of unit vectors to the mean of the real unit vectors."""
    centre = centroids(real.select(V.l2_normalize("features").alias("_u")), [], "_u", "_c").select("_c")
    return rows.join(F.broadcast(centre)).withColumn("centre_dist", V.l2_distance(V.l2_normalize("features"), "_c")).drop("_c")


def alpha_precision(real: DataFrame, gen: DataFrame, alphas: Sequence[float] = GRID) -> DataFrame:
    """Share of generated rows within the real-centre radius at each alpha quantile of the real radii."""
    radii = percentiles(centre_distance(real, real), "centre_dist", alphas, (), "_r").select("_r")
    cells = F.arrays_zip(F.array(*[F.lit(float(a)) for a in alphas]).alias("alpha"), F.col("_r").alias("radius"))
    grid = radii.select(cells.alias("_g"))
    rows = centre_distance(real, gen).select("centre_dist").join(F.broadcast(grid)).withColumn("e", F.explode("_g"))
    return rows.groupBy(F.col("e.alpha").alias("alpha"), F.col("e.radius").alias("radius")).agg(
        F.avg((F.col("centre_dist") <= F.col("e.radius")).cast("double")).alias("precision")
    )


def score_tables(real: DataFrame, gen: DataFrame, attrs: Sequence[str], seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores of both tables from components fitted on the (seen) real rows."""
    model = fit_components(real, attrs, seen=seen)
    return score_from_components(real, model), score_from_components(gen, model)


def long_scores(scored: DataFrame, keep: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("value")) for s in SCORES])
    return scored.select(*keep, F.explode(cells).alias("e")).select(*keep, "e.score", "e.value")


def seen_unseen_detection(scored: DataFrame, attrs: Sequence[str], seen: DataFrame) -> DataFrame:
    """AUROC and AUPRC of every score for telling unseen from seen conditions, row level."""
    arms = seen.select(*attrs).distinct().withColumn("arm", F.lit("seen"))
    tagged = tag_arm(scored, arms, attrs).withColumn("unseen", (F.col("arm") != "seen").cast("int"))
    return R.detection_summary(long_scores(tagged, ["unseen"]), "value", "unseen", ["score"])


def failure_detection(scored: DataFrame, attrs: Sequence[str], seen: DataFrame) -> DataFrame:
    """The same on condition means of trust."""
    arms = seen.select(*attrs).distinct().withColumn("arm", F.lit("seen"))
    means = tag_arm(condition_stats(scored, attrs, ["trust"]), arms, attrs)
    return R.detection_summary(means.withColumn("unseen", (F.col("arm") != "seen").cast("int")), "trust_mean", "unseen")


def real_gen_detection(
    real: DataFrame, gen: DataFrame, attrs: Sequence[str], seen: DataFrame | None = None, max_real: int | None = None,
    resamples: int = 1, frac: float = 0.5, seed: int = 42,
) -> DataFrame:
    """Cross-fitted separability of real and generated rows: fit on one half of real, score the other half and gen.

    Every resample halves all real rows anew, or a stratified draw of `max_real` of them if the caller gives that number;
    with `seen`, generated rows are split into seen and unseen.
    """
    rows = None
    for i in range(resamples):
        pool = real
        if max_real is not None:
            # At most max_real rows, read by several passes.
            pool = cut_lineage(stratified_subsample(real.select(*attrs, "sample_id", "features"), attrs, max_real, seed + i))
        split = cross_fit_split(pool, frac, seed + i)
        model = fit_components(split.where("is_fit"), attrs, seen=seen)
        scored_gen = score_from_components(gen, model)
        if seen is not None:
            arms = seen.select(*attrs).distinct().withColumn("arm", F.lit("seen"))
            scored_gen = tag_arm(scored_gen, arms, attrs).withColumn("split", F.when(F.col("arm") == "seen", "seen").otherwise("unseen"))
            splits = F.array(F.lit("seen"), F.lit("unseen"))
        else:
            scored_gen = scored_gen.withColumn("split", F.lit("all"))
            splits = F.array(F.lit("all"))
        held = score_from_components(split.where(~F.col("is_fit")), model).withColumn("split", F.explode(splits))
        keep = ["split", "is_gen"]
        part = long_scores(scored_gen.withColumn("is_gen", F.lit(1)), keep).unionByName(
            long_scores(held.withColumn("is_gen", F.lit(0)), keep)
        ).withColumn("resample", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    per = R.detection_summary(rows, "value", "is_gen", ["split", "score", "resample"])
    aggs = []
    for m in ("auroc", "auprc"):
        ends = F.percentile(m, F.array(F.lit(0.025), F.lit(0.975)))
        aggs += [F.avg(m).alias(m), ends[0].alias(f"{m}_ci_low"), ends[1].alias(f"{m}_ci_high")]
    return per.groupBy("split", "score").agg(F.count("*").alias("n_resamples"), *aggs)


def metric_correlations(scored: DataFrame, real: DataFrame, gen: DataFrame) -> DataFrame:
    """Rank correlations of the scores with centre distance and authenticity (more than 10 rows)."""
    clean = finite_scores(scored, *SCORES).select("sample_id", *SCORES, "features")
    rows = centre_distance(real, clean).drop("features").join(authenticity(real, gen).select("sample_id", "authentic"), "sample_id")
    pairs = [("realism_z", "centre_dist"), ("faithfulness_z", "centre_dist"), ("trust", "centre_dist"), ("trust", "authentic")]
    cells = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])
    # numbers alone, written once: ranking reads them several times, and each time would join the neighbours anew
    return R.spearman(cut_lineage(rows.select(F.explode(cells).alias("e")).select("e.*")), "x", "y", ["pair"], 11)


def ranking_table(
    scored: DataFrame, real: DataFrame, gen: DataFrame, attrs: Sequence[str], seen: DataFrame | None = None,
    reps: int = 10, null_reps: int = 100, seed: int = 42, null: DataFrame | None = None,
) -> DataFrame:
    """Full condition table: arm, weight, score means, distances and z, best first."""
    stats = condition_stats(scored, attrs, ["trust", "faithfulness_z"], ["realism_z"])
    null = D.kid_null(real, attrs, null_reps, seed) if null is None else null
    table = stats.join(D.delta_kid(real, gen, attrs, reps, seed, null=null), list(attrs), "left")
    if seen is not None:
        table = tag_arm(table, seen.select(*attrs).distinct().withColumn("arm", F.lit("seen")), attrs)
        table = table.withColumn("arm", F.when(F.col("arm") == "outside", "unseen").otherwise(F.col("arm")))
    return table.withColumns({"condition": V.format_condition(list(attrs)), "hamming_weight": V.hamming_weight(list(attrs))})


def ranking_validity(table: DataFrame, attrs: Sequence[str], metric: str = "delta_kid") -> dict[str, DataFrame]:
    """Do condition scores rank conditions as the distances do?"""
    table = cut_lineage(table)  # one row per condition, read by every statistic
    corr = R.spearman(table, "trust_mean", metric).join(F.broadcast(R.kendall(table, "trust_mean", metric).drop("n")))
    return {
        "correlation": R.with_p_values(corr).join(F.broadcast(R.pearson_corr(table, "trust_mean", metric).drop("n"))),
        "overlap": R.top_k_overlap(table.where(F.col(metric).isNotNull()), "trust_mean", metric, attrs),
        "by_support": R.stratified_correlation(table, "trust_mean", metric, "n_real"),
        "gaps": R.gap_analysis(table, metric, attrs),
    }


def evaluate(
    real: DataFrame, gen: DataFrame, attrs: Sequence[str], seen: DataFrame | None = None, n_bins: int = 10,
    reps: int = 10, null_reps: int = 100, seed: int = 42,
) -> dict[str, DataFrame]:
    """All report tables of one configuration; write them with sources.tables.write_result."""
    attrs = list(attrs)
    slim = [*attrs, "sample_id", *SCORES]
    # Scores without vectors are written once: every table below reads them.
    real_slim, gen_slim = (cut_lineage(t.select(*slim)) for t in score_tables(real, gen, attrs, seen))
    calib = filter_seen(real_slim, seen, attrs)
    gen_scored = gen_slim.join(gen.select("sample_id", "features"), "sample_id")
    null = cut_lineage(D.kid_null(real, attrs, null_reps, seed))
    table = ranking_table(gen_slim, real, gen, attrs, seen, reps, null_reps, seed, null)
    cuts = S.thresholds(calib, "trust")
    out = {
        "scores": gen_slim,
        "condition_ranking": table,
        "alpha_precision": alpha_precision(real, gen),
        "beta_recall": beta_recall(real, gen, GRID),
        "real_gen_detection": real_gen_detection(real, gen, attrs, seen, seed=seed),
        "metric_correlations": metric_correlations(gen_scored, real, gen),
        "deciles": S.decile_report(gen_slim, gen, real, attrs, n_bins=n_bins, reps=reps, null=null),
        "acceptance": S.acceptance_summary(gen_slim, cuts),
        "global_selection": S.global_selection(gen_slim, calib, gen, real, attrs, n_boot=reps, n_rand=reps),
        "condition_selection": S.per_condition_selection(gen_slim, calib, gen, real, attrs, seen=seen, reps=reps),
    }
    if seen is not None:
        out["seen_unseen_detection"] = seen_unseen_detection(gen_slim, attrs, seen)
        out["failure_detection"] = failure_detection(gen_slim, attrs, seen)
    out.update({f"validity_{k}": v for k, v in ranking_validity(table, attrs).items()})
    return out
