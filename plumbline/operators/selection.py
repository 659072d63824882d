"""Accept rows by calibrated thresholds and measure what the selection gains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import finite
from plumbline.operators import distances as D
from plumbline.operators.conditions import nearest_condition
from plumbline.operators.prefix import percentiles
from plumbline.operators.ranking import bin_within
from plumbline.operators.sampling import (
    condition_counts, draw_rank, matched_draw, matched_real_draw, random_baseline, with_reps,
)
from plumbline.session import cut_lineage

PERCENTS = (50, 75, 90, 95)


def thresholds(
    real: DataFrame, score: str = "trust", percents: Sequence[int] = PERCENTS, keys: Sequence[str] = (), min_rows: int = 1
) -> DataFrame:
    """Score percentiles of the finite real rows: keys, pct, threshold, n_real."""
    keys = list(keys)
    clean = real.withColumn("_s", finite(score))
    table = percentiles(clean, "_s", [p / 100 for p in percents], keys, "_t").where(F.col("n") >= min_rows)
    names = F.array(*[F.lit(p) for p in percents])
    return table.select(*keys, F.col("n").alias("n_real"), F.explode(F.arrays_zip(names.alias("pct"), F.col("_t").alias("threshold"))).alias("e")).select(
        *keys, "n_real", F.col("e.pct").alias("pct"), F.col("e.threshold").alias("threshold")
    )


def accept(gen: DataFrame, cuts: DataFrame, score: str = "trust", keys: Sequence[str] = ()) -> DataFrame:
    """Generated rows at or below each threshold; one copy per percentile that accepts them."""
    keys = list(keys)
    clean = gen.where(finite(score).isNotNull())
    if keys:
        joined = clean.join(cuts, keys)
    else:
        # A handful of percentiles: one array on every row.
        packed = cuts.agg(F.collect_list(F.struct("pct", "threshold")).alias("_cuts"))
        joined = clean.join(F.broadcast(packed)).withColumn("_c", F.explode("_cuts")).select(
            *clean.columns, F.col("_c.pct").alias("pct"), F.col("_c.threshold").alias("threshold")
        )
    return joined.where(F.col(score) <= F.col("threshold"))


def acceptance_summary(
    gen: DataFrame, cuts: DataFrame, score: str = "trust", by: Sequence[str] = ()
) -> DataFrame:
    """Accepted rows and rate per percentile, optionally per model or arm."""
    by = list(by)
    packed = cuts.agg(F.collect_list(F.struct("pct", "threshold")).alias("_cuts"))
    rows = gen.select(*by, finite(score).alias("_s")).join(F.broadcast(packed)).withColumn("_c", F.explode("_cuts"))
    taken = F.coalesce(F.col("_s") <= F.col("_c.threshold"), F.lit(False))
    return rows.groupBy(*by, F.col("_c.pct").alias("pct"), F.col("_c.threshold").alias("threshold")).agg(
        F.count("*").alias("n_total"), F.count_if(taken).alias("n_accepted"),
        (F.count_if(taken) / F.count("*")).alias("rate"),
    )


def calibration_conditions(
    gen: DataFrame, real_scores: DataFrame, attrs: Sequence[str], seen: DataFrame | None = None, score: str = "trust"
) -> DataFrame:
    """Conditions whose real scores calibrate each generated condition (`cal_<attr>`).

    Without `seen` every condition calibrates itself; with it, unseen
    conditions borrow every seen condition tied at the smallest Hamming distance.
    """
    attrs = list(attrs)
    conds = gen.select(*attrs).distinct()
    own = conds.select(*attrs, *[F.col(a).alias(f"cal_{a}") for a in attrs], F.lit(0).alias("hamming"))
    if seen is None or seen.isEmpty():
        return own
    usable = real_scores.select(*attrs).distinct().join(seen.select(*attrs).distinct(), attrs, "left_semi")
    near = nearest_condition(conds, usable, attrs, ties=True)
    near = near.select(*attrs, *[F.col(f"near_{a}").alias(f"cal_{a}") for a in attrs], "hamming")
    # Nothing usable at all: conditions fall back to themselves.
    return near.unionByName(own.join(near, attrs, "left_anti"))


def accept_per_condition(
    gen: DataFrame, real_scores: DataFrame, attrs: Sequence[str], pct: int = 95, seen: DataFrame | None = None,
    score: str = "trust", min_real: int = 20,
) -> DataFrame:
    """Accepted rows per (condition, calibrating condition), with the borrowed threshold."""
    attrs = list(attrs)
    cal = calibration_conditions(gen, real_scores, attrs, seen, score)
    cuts = thresholds(real_scores, score, [pct], attrs, min_real)
    cuts = cuts.select(*[F.col(a).alias(f"cal_{a}") for a in attrs], "threshold")
    plan = cal.join(cuts, [f"cal_{a}" for a in attrs])
    rows = gen.where(finite(score).isNotNull()).join(plan, attrs)
    return rows.where(F.col(score) <= F.col("threshold"))


def per_condition_selection(
    gen: DataFrame, real_scores: DataFrame, gen_feats: DataFrame, real_feats: DataFrame, attrs: Sequence[str],
    pct: int = 95, seen: DataFrame | None = None, score: str = "trust", reps: int = 10, seed: int = 42,
    min_gen: int = 20, min_real: int = 20, min_accept: int = 10, cap: int | None = None,
) -> DataFrame:
    """Distance of accepted and of random rows to the condition's real rows, averaged over calibrators."""
    attrs = list(attrs)
    cal = [f"cal_{a}" for a in attrs]
    keys = [*attrs, *cal]
    sized = condition_counts(gen, attrs, "n_total").join(condition_counts(real_feats, attrs, "n_real"), attrs)
    sized = sized.where((F.col("n_total") >= min_gen) & (F.col("n_real") >= min_real))
    taken = accept_per_condition(gen, real_scores, attrs, pct, seen, score, min_real).join(sized.select(*attrs), attrs, "left_semi")
    taken = cut_lineage(taken.select(*keys, "sample_id", "threshold"))
    cells = taken.groupBy(*keys).agg(F.count("*").alias("n_accepted"), F.first("threshold").alias("threshold"))
    cells = cells.join(sized, attrs).where(F.col("n_accepted") >= min_accept)
    cells = cut_lineage(cells.withColumn("k", D.at_most(cap, F.col("n_accepted"), F.col("n_real"))).where(F.col("k") >= 10))
    plan = cells.select(*keys, "k")
    pairs = plan.select(*keys)
    y = D.as_draws(real_feats, attrs).join(pairs, attrs)
    runs = {
        "acc": (D.as_draws(taken, keys).join(pairs, keys, "left_semi"), seed + 4000),
        "rand": (D.as_draws(gen, attrs).join(pairs, attrs), seed + 5000),
    }
    out = cells
    for name, (x, s) in runs.items():
        kid = D.sampled_kid(x, y, gen_feats, real_feats, keys, None, reps, s, "cosine", cells=plan)
        stats = kid.where(F.col("kid").isNotNull()).groupBy(*keys).agg(
            F.avg("kid").alias(f"kid_{name}"), F.stddev_pop("kid").alias(f"kid_{name}_std")
        )
        out = out.join(stats, keys)
    mean = out.groupBy(*attrs).agg(
        F.count("*").alias("n_calib"), F.bround(F.avg("n_accepted")).cast("long").alias("n_accepted"),
        F.first("n_total").alias("n_total"), F.avg("threshold").alias("threshold"),
        F.max(F.when(sum((F.col(a) != F.col(c)).cast("int") for a, c in zip(attrs, cal)) > 0, 1).otherwise(0)).alias("_b"),
        *[F.avg(c).alias(c) for c in ("kid_acc", "kid_acc_std", "kid_rand", "kid_rand_std")],
    )
    return improvement(mean).withColumn("borrowed", F.col("_b") == 1).drop("_b")


def improvement(table: DataFrame, acc: str = "kid_acc", rand: str = "kid_rand") -> DataFrame:
    """delta = random - accepted with its 1.96-sigma band and percentage."""
    delta = F.col(rand) - F.col(acc)
    half = 1.96 * F.sqrt(F.col(f"{acc}_std") * F.col(f"{acc}_std") + F.col(f"{rand}_std") * F.col(f"{rand}_std"))
    return table.withColumns(
        {
            "delta": delta, "ci_lower": delta - half, "ci_upper": delta + half,
            "improvement_pct": F.when(F.col(rand) != 0, delta / F.col(rand) * 100),
        }
    )


def global_selection(
    gen: DataFrame, real_scores: DataFrame, gen_feats: DataFrame, real_feats: DataFrame, attrs: Sequence[str],
    percents: Sequence[int] = PERCENTS, score: str = "trust", baseline: str = "free", n_boot: int = 10, n_rand: int = 10,
    seed: int = 42, min_accept: int = 20, cap: int | None = None,
) -> DataFrame:
    """Per percentile the distance of accepted rows and of random rows to condition-matched real rows.

    baseline 'free': as many random generated rows with their own matched real
    rows; 'same_histogram': random rows with the accepted condition counts and
    the accepted rows' real draw.
    """
    attrs = list(attrs)
    taken = accept(gen, thresholds(real_scores, score, percents), score)
    enough = taken.groupBy("pct").agg(F.count("*").alias("n_accepted"), F.first("threshold").alias("threshold"))
    enough = enough.where(F.col("n_accepted") >= min_accept)
    # Ids only: everything below reads the accepted rows several times.
    taken = cut_lineage(taken.join(F.broadcast(enough.select("pct")), "pct", "left_semi").select(*attrs, "pct", "sample_id"))
    size = D.at_most(cap, F.col("n_x"), F.col("n_y"))
    want = taken.groupBy(*attrs, "pct").agg(F.count("*").alias("n_want"))
    pool = cut_lineage(D.slots_as_draws(matched_draw(want, real_feats, attrs, seed + 1000, ["pct"]), ["pct"]))
    acc = D.spread(
        D.sampled_kid(D.as_draws(taken, ["pct"]), pool, gen_feats, real_feats, ["pct"], size, n_boot, seed + 1100, "cosine", min_size=10),
        ["pct"],
    ).select("pct", F.col("mean").alias("kid_acc"), F.col("std").alias("kid_acc_std"))
    if baseline == "free":
        wide = with_reps(gen.select(*attrs, "sample_id"), n_rand, "draw").join(F.broadcast(enough))
        ranked = draw_rank(wide, "sample_id", seed + 2000, ["pct", "draw"], F.concat_ws(",", F.col("pct").cast("string"), F.col("draw").cast("string")))
        rand = cut_lineage(ranked.where(F.col("draw_rank") <= F.col("n_accepted")).select(*attrs, "pct", "draw", "sample_id"))
        rwant = rand.groupBy(*attrs, "pct", "draw").agg(F.count("*").alias("n_want"))
        rpool = cut_lineage(D.slots_as_draws(matched_draw(rwant, real_feats, attrs, seed + 3000, ["pct", "draw"]), ["pct", "draw"]))
    elif baseline == "same_histogram":
        rand = cut_lineage(matched_draw(with_reps(want, n_rand, "draw"), gen, attrs, seed + 2000, ["pct", "draw"], replace="never"))
        rpool = with_reps(pool, n_rand, "draw").select("pct", "draw", "draw_id", "sample_id")
    else:
        raise ValueError(f"unknown baseline {baseline!r}")
    runs = D.sampled_kid(
        D.as_draws(rand, ["pct", "draw"]), rpool, gen_feats, real_feats, ["pct", "draw"], size, 1, seed + 4000, "cosine", min_size=10
    )
    random = D.spread(runs, ["pct"]).select("pct", F.col("mean").alias("kid_rand"), F.col("std").alias("kid_rand_std"))
    total = gen.agg(F.count_if(finite(score).isNotNull()).alias("n_total"))
    return improvement(enough.join(acc, "pct").join(random, "pct").join(F.broadcast(total)))


def percentile_mode_panel(
    gen: DataFrame, real_scores: DataFrame, gen_feats: DataFrame, real_feats: DataFrame, attrs: Sequence[str],
    percents: Sequence[int] = PERCENTS, score: str = "trust", reps: int = 5, seed: int = 42, cap: int | None = None,
) -> DataFrame:
    """Percentile x {global, within_cond} selections: pooled distances and per-condition improvements."""
    attrs = list(attrs)
    cols = [*attrs, "sample_id", "pct"]
    whole = accept(gen, thresholds(real_scores, score, percents), score).select(*cols, F.lit("global").alias("mode"))
    local = accept(gen, thresholds(real_scores, score, percents, attrs, 5), score, attrs)
    taken = whole.unionByName(local.select(*cols, F.lit("within_cond").alias("mode")))
    keys = ["pct", "mode"]
    enough = taken.groupBy(*keys).agg(F.count("*").alias("n_accepted")).where(F.col("n_accepted") >= 10)
    taken = cut_lineage(taken.join(F.broadcast(enough.select(*keys)), keys, "left_semi"))
    enough = taken.groupBy(*keys).agg(F.count("*").alias("n_accepted"))
    want = taken.groupBy(*attrs, *keys).agg(F.count("*").alias("n_want"))
    rand = cut_lineage(matched_draw(want, gen, attrs, seed, keys, replace="never"))
    tags = enough.agg(F.collect_list(F.struct(*keys)).alias("_k"))
    pool = D.as_draws(real_feats, []).join(F.broadcast(tags)).withColumn("_t", F.explode("_k")).select("_t.*", "draw_id", "sample_id")
    size = D.at_most(cap, F.col("n_x"), F.col("n_y"))
    out = enough
    for name, rows, s in (("kid_acc", taken, 800), ("kid_rand", rand, 900)):
        runs = D.sampled_kid(D.as_draws(rows, keys), pool, gen_feats, real_feats, keys, size, reps, seed + s, "cosine")
        out = out.join(D.spread(runs, keys).select(*keys, F.col("mean").alias(name)), keys)
    cell = [*attrs, *keys]
    n = taken.groupBy(*cell).agg(F.count("*").alias("n_acc")).join(condition_counts(gen, attrs, "n_gen"), attrs)
    n = n.join(condition_counts(real_feats, attrs, "n_real"), attrs).where((F.col("n_real") >= 10) & (F.col("n_acc") >= 5))
    # One row per (condition, percentile, mode).
    plan = cut_lineage(n.select(*cell, D.at_most(cap, F.col("n_acc"), F.col("n_gen"), F.col("n_real")).alias("k")))
    y = D.as_draws(real_feats, attrs).join(plan.drop("k"), attrs)
    by_cond = None
    for name, rows in (("_a", D.as_draws(taken, cell)), ("_r", D.as_draws(gen, attrs).join(plan.drop("k"), attrs))):
        runs = D.sampled_kid(rows, y, gen_feats, real_feats, cell, None, 1, seed + 70, "cosine", min_size=5, cells=plan)
        part = runs.select(*cell, F.col("kid").alias(name))
        by_cond = part if by_cond is None else by_cond.join(part, cell)
    gain = (F.col("_r") - F.col("_a")) / F.col("_r") * 100
    local_gain = by_cond.where(F.col("_r") > 1e-10).groupBy(*keys).agg(
        F.avg(gain).alias("cond_improvement_mean"), F.count_if(gain > 0).alias("cond_n_positive"), F.count("*").alias("cond_n")
    )
    total = gen.agg(F.count("*").alias("n_total"))
    pooled = F.when(F.col("kid_rand") > 1e-10, (F.col("kid_rand") - F.col("kid_acc")) / F.col("kid_rand") * 100).otherwise(0.0)
    return out.join(F.broadcast(total)).join(local_gain, keys, "left").withColumns(
        {"acceptance_rate": F.col("n_accepted") / F.col("n_total"), "pooled_improvement_pct": pooled}
    )


def kid_by_arm(
    gen: DataFrame, threshold: Column, gen_feats: DataFrame, real_feats: DataFrame, attrs: Sequence[str],
    score: str = "trust", n_rand: int = 5, n_boot: int = 10, seed: int = 42, cap: int | None = None,
) -> DataFrame:
    """Select by score, measure in another space: per arm the distance of accepted and of random rows.

    `gen` has attrs, arm and the score; the vectors come from `gen_feats` and
    `real_feats`, which may be any space with the same ids.
    """
    attrs = list(attrs)
    rows = gen.select(*attrs, "arm", "sample_id", finite(score).alias("_s"))
    taken = rows.where(F.col("_s") <= threshold)
    n = taken.groupBy("arm").agg(F.count("*").alias("n_accepted")).where(F.col("n_accepted") >= 10)
    ranked = draw_rank(with_reps(rows.join(F.broadcast(n), "arm"), n_rand, "draw"), "sample_id", seed, ["arm", "draw"], F.col("draw"))
    picks = ranked.where(F.col("draw_rank") <= F.col("n_accepted")).select(*attrs, "arm", "draw", "sample_id")
    both = taken.join(F.broadcast(n.select("arm")), "arm", "left_semi").select(*attrs, "arm", F.lit(-1).alias("draw"), "sample_id").unionByName(picks)
    both = cut_lineage(both)
    keys = ["arm", "draw"]
    x = with_reps(both, n_boot, "boot")
    cell = [*keys, "boot"]
    pool = cut_lineage(D.slots_as_draws(D.matched_with_fallback(x, real_feats, attrs, 1, seed + 1100, cell), cell))
    size = D.at_most(cap, F.col("n_x"), F.col("n_y"))
    runs = D.sampled_kid(D.as_draws(x, cell), pool, gen_feats, real_feats, cell, size, 1, seed, "cosine")
    per_draw = runs.groupBy(*keys).agg(F.avg("kid").alias("kid"))
    out = per_draw.groupBy("arm").agg(
        F.max(F.when(F.col("draw") == -1, F.col("kid"))).alias("kid_accepted"),
        F.avg(F.when(F.col("draw") >= 0, F.col("kid"))).alias("kid_random"),
        F.stddev_samp(F.when(F.col("draw") >= 0, F.col("kid"))).alias("kid_random_std"),
    )
    return out.join(n, "arm").withColumn("delta", F.col("kid_accepted") - F.col("kid_random"))


def decile_report(
    gen: DataFrame, gen_feats: DataFrame, real_feats: DataFrame, attrs: Sequence[str], score: str = "trust",
    n_bins: int = 10, within: bool = True, reps: int = 10, seed: int = 42, null: DataFrame | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Per score bin: distance to real rows with interval, mean per-condition z, score range and counts.

    Bins are taken inside conditions and compared with condition-matched real
    draws, or globally and compared with all real rows.
    """
    attrs = list(attrs)
    bins = cut_lineage(bin_within(gen.select(*attrs, "sample_id", score), attrs if within else [], n_bins, score, at_least_one=within))
    facts = bins.groupBy("bin").agg(
        F.count("*").alias("n_samples"), F.min(score).alias("score_min"), F.max(score).alias("score_max"),
        F.count_distinct(*[F.col(a) for a in attrs]).alias("n_conditions"),
    )
    pool = None
    if within:
        want = bins.groupBy(*attrs, "bin").agg(F.count("*").alias("n_want"))
        pool = cut_lineage(D.slots_as_draws(matched_draw(want, real_feats, attrs, seed, ["bin"]), ["bin"]))
    out = facts.join(D.kid_bootstrap(bins, real_feats, gen_feats, ["bin"], reps, seed, "cosine", pool, cap), "bin", "left")
    if not within or null is None:
        return out
    size = D.at_most(cap, F.col("n_x"), F.floor(F.col("n_y") / 2))
    cells = [*attrs, "bin"]
    y = D.as_draws(real_feats, attrs).join(bins.select(*cells).distinct(), attrs)
    runs = D.sampled_kid(D.as_draws(bins, cells), y, gen_feats, real_feats, cells, size, 1, seed, "cosine", min_size=5)
    z = runs.join(null.select(*attrs, "null_mean", "null_std"), attrs)
    z = z.groupBy("bin").agg(
        F.avg((F.col("kid") - F.col("null_mean")) / F.col("null_std")).alias("kid_z"), F.count("kid").alias("n_conditions_with_z")
    )
    return out.join(z, "bin", "left")


def weighted_improvement(table: DataFrame) -> DataFrame:
    """Mean delta, improved conditions and the acceptance-weighted mean percentage."""
    w = F.col("n_accepted")
    return table.agg(
        F.count("*").alias("n"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("n_improved"),
        F.try_divide(F.sum(F.col("improvement_pct") * w), F.sum(w)).alias("weighted_pct"),
    )


__all__ = [
    "accept", "accept_per_condition", "acceptance_summary", "decile_report", "global_selection", "kid_by_arm",
    "matched_real_draw", "per_condition_selection", "percentile_mode_panel", "random_baseline", "thresholds",
    "weighted_improvement",
]
