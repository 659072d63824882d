"""Within-condition bins, rank statistics and ranking curves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import draw_key, finite
from plumbline.operators.prefix import average_ranks, percentiles, rank_rows, running_sums


def _sized(df: DataFrame, keys: Sequence[str], score: str, sample_id: str, ascending: bool = True) -> DataFrame:
    """Add `_rn` (position by score, ties by id) and `_n` (group size)."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    # Whole rows are ranked: a join back by id would multiply rows whose id repeats.
    ranked = rank_rows(df, [order, F.col(sample_id)], keys, "_rn")
    if not keys:
        return ranked.join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    sizes = df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    same = [ranked[k].eqNullSafe(sizes[f"_key{i}"]) for i, k in enumerate(keys)]
    return ranked.join(sizes, same).drop(*[f"_key{i}" for i in range(len(keys))])


def bin_within(
    df: DataFrame, keys: Sequence[str], n_bins: int, score: str = "score", at_least_one: bool = False,
    ascending: bool = True, sample_id: str = "sample_id", name: str = "bin",
) -> DataFrame:
    """Equal bins of n_c // n_bins rows by score inside each group; the last bin takes the remainder.

    Groups smaller than n_bins fall wholly into the last bin, or with
    `at_least_one` fill one bin per row and leave the trailing bins empty.
    No keys: one global group.
    """
    sized = _sized(df, keys, score, sample_id, ascending)
    width = F.floor(F.col("_n") / n_bins)
    if at_least_one:
        width = F.greatest(F.lit(1), width)
    place = F.when(width == 0, n_bins - 1).otherwise(F.least(F.floor((F.col("_rn") - 1) / width), F.lit(n_bins - 1)))
    return sized.withColumn(name, place.cast("int")).drop("_rn", "_n")


def bin_global_even(
    df: DataFrame, n_bins: int, score: str = "score", sample_id: str = "sample_id", name: str = "bin"
) -> DataFrame:
    """Global bins whose first n mod n_bins bins hold one row more."""
    sized = _sized(df, (), score, sample_id)
    size, extra = F.floor(F.col("_n") / n_bins), F.col("_n") % n_bins
    i = F.col("_rn") - 1
    head = extra * (size + 1)
    place = F.when(i < head, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - head) / F.greatest(size, F.lit(1))))
    return sized.withColumn(name, place.cast("int")).drop("_rn", "_n")


def quantile_bins(
    df: DataFrame, keys: Sequence[str], n_bins: int, score: str = "score", sample_id: str = "sample_id",
    anchor: bool = True, min_rows: int | None = None,
) -> DataFrame:
    """Quantile bins Q1..Qn of first-come ranks per group, plus an 'all' copy of every kept row.

    A rank r of n falls in bin ceil((r-1)*q/(n-1)), at least 1; groups below
    `min_rows` (default n_bins) are dropped.
    """
    sized = _sized(df, keys, score, sample_id).where(F.col("_n") >= (min_rows or n_bins))
    place = F.greatest(F.lit(1), F.ceil((F.col("_rn") - 1) * n_bins / F.greatest(F.col("_n") - 1, F.lit(1))))
    names = [F.concat(F.lit("Q"), place.cast("string"))] + ([F.lit("all")] if anchor else [])
    return sized.withColumn("bin", F.explode(F.array(*names))).drop("_rn", "_n")


def bin_finite(df: DataFrame, keys: Sequence[str], n_bins: int, score: str = "score", **kw) -> DataFrame:
    """bin_within on finite scores only; groups with fewer than n_bins of them are skipped."""
    kept = df.where(finite(score).isNotNull())
    big = kept.groupBy(*keys).count().where(F.col("count") >= n_bins).drop("count")
    return bin_within(kept.join(big, list(keys), "left_semi"), keys, n_bins, score, **kw)


def random_scores(df: DataFrame, seed: int = 42, sample_id: str = "sample_id", name: str = "random_score") -> DataFrame:
    """A score column that orders rows at random."""
    return df.withColumn(name, draw_key(seed, 0, sample_id))


def corner_selection(
    df: DataFrame, attrs: Sequence[str], top: int = 16, min_rows: int = 4, sample_id: str = "sample_id"
) -> DataFrame:
    """Per condition four different rows: best and worst combinations of realism and faithfulness.

    Corners are picked in turn; a row taken by one corner is not offered to the
    next. Four candidates per corner always suffice, since at most three of
    them can be taken.
    """
    attrs = list(attrs)
    sizes = df.groupBy(*attrs).agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    best = sizes.orderBy(F.desc("n"), *attrs).limit(top)
    r, f = F.col("realism_z"), F.col("faithfulness_z")
    keys = [("good_r_good_f", r + f), ("good_r_bad_f", r - f), ("bad_r_good_f", f - r), ("bad_r_bad_f", -r - f)]
    rows = df.join(best, attrs).select(*attrs, sample_id, "realism_z", "faithfulness_z")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("corner"), k.alias("key")) for i, (n, k) in enumerate(keys)])
    long = rows.withColumn("_c", F.explode(corners)).select(*rows.columns, "_c.*")
    place = F.row_number().over(Window.partitionBy(*attrs, "i").orderBy("key", sample_id))
    few = long.withColumn("_p", place).where(F.col("_p") <= 4)
    # At most 16 candidates per condition: choose in corner order without reuse.
    item = F.struct("i", "_p", "corner", F.col(sample_id).alias("id"), "realism_z", "faithfulness_z")
    cand = few.groupBy(*attrs).agg(F.sort_array(F.collect_list(item)).alias("_l"))

    def step(taken: Column, i: int) -> Column:
        free = F.filter("_l", lambda e: (e["i"] == i) & ~F.exists(taken, lambda t: t["id"] == e["id"]))
        return F.concat(taken, F.slice(free, 1, 1))

    picked = F.slice(F.filter("_l", lambda e: e["i"] == 0), 1, 1)
    cand = cand.withColumn("_t", picked)
    for i in (1, 2, 3):
        cand = cand.withColumn("_t", step(F.col("_t"), i))
    out = cand.select(*attrs, F.explode("_t").alias("e"))
    return out.select(*attrs, "e.corner", F.col("e.id").alias(sample_id), "e.realism_z", "e.faithfulness_z")


def ranking_curve(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score, descending: cumulative true and false positives and the totals."""
    keys = list(keys)
    clean = df.select(*keys, finite(score).alias("_s"), F.col(positive).cast("int").alias("_y")).where(
        F.col("_s").isNotNull() & F.col("_y").isNotNull()
    )
    counts = clean.groupBy(*keys, "_s").agg(F.sum("_y").alias("_p"), F.sum(1 - F.col("_y")).alias("_q"))
    totals_by = counts.groupBy(*keys) if keys else counts.groupBy()
    totals = totals_by.agg(F.sum("_p").alias("P"), F.sum("_q").alias("N"))
    curve = running_sums(counts, [F.desc("_s")], {"tp": F.col("_p"), "fp": F.col("_q")}, keys)
    curve = curve.join(totals, keys) if keys else curve.join(F.broadcast(totals))
    return curve.select(
        *keys, F.col("_s").alias("threshold"), "tp", "fp", "P", "N",
        F.col("_p").alias("step_tp"), F.col("_q").alias("step_fp"),
    )


def roc_points(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    curve = ranking_curve(df, score, positive, keys)
    return curve.select(*keys, "threshold", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"))


def pr_points(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    curve = ranking_curve(df, score, positive, keys)
    return curve.select(
        *keys, "threshold", F.try_divide("tp", "P").alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def detection_summary(df: DataFrame, score: str, positive: str, keys: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties averaged) and the trapezoid area under the PR curve per group.

    Each curve step carries what it adds, so one sum over the steps gives both
    areas; the step before needs no second ordering. The PR curve starts at
    recall 0 with precision 1. Areas are null without both classes.
    """
    keys = list(keys)
    c = ranking_curve(df, score, positive, keys)
    tp0, fp0 = F.col("tp") - F.col("step_tp"), F.col("fp") - F.col("step_fp")
    roc = F.col("step_fp") * (tp0 + F.col("step_tp") / 2.0)
    before = F.when(tp0 + fp0 > 0, tp0 / (tp0 + fp0)).otherwise(F.lit(1.0))
    after = F.col("tp") / (F.col("tp") + F.col("fp"))
    pr = F.try_divide(F.col("step_tp"), F.col("P")) * (before + after) / 2.0
    grouped = c.groupBy(*keys) if keys else c.groupBy()
    sums = grouped.agg(
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"), F.sum(roc).alias("_roc"), F.sum(pr).alias("_pr")
    )
    ok = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return sums.select(
        *keys, "n_pos", "n_neg",
        F.when(ok, F.col("_roc") / F.col("n_pos") / F.col("n_neg")).alias("auroc"),
        F.when(ok, F.col("_pr")).alias("auprc"),
    )


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_rows: int = 3) -> DataFrame:
    """Rank correlation with averaged ties; null below `min_rows` pairs."""
    keys = list(keys)
    both = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, x, keys, "_rx"), y, keys, "_ry")
    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    return grouped.agg(
        F.count("*").alias("n"), F.when(F.count("*") >= min_rows, F.corr("_rx", "_ry")).alias("spearman")
    )


def pearson_corr(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_rows: int = 3) -> DataFrame:
    keys = list(keys)
    both = df.where(finite(x).isNotNull() & finite(y).isNotNull())
    grouped = both.groupBy(*keys) if keys else both.groupBy()
    return grouped.agg(F.count("*").alias("n"), F.when(F.count("*") >= min_rows, F.corr(x, y)).alias("pearson"))


def kendall(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_rows: int = 3, levels: int | None = None) -> DataFrame:
    """Kendall's tau-b without comparing pairs of rows.

    Discordant pairs are counted bit by bit: with x-ordered rows and dense
    y-ranks, two rows first differ at one binary digit of their y-ranks, so
    for each digit the inversions inside each common prefix are a running sum.
    """
    keys = list(keys)
    both = df.where(finite(x).isNotNull() & finite(y).isNotNull()).select(
        *keys, F.col(x).alias("_x"), F.col(y).alias("_y")
    )
    cells = both.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_c"))
    ys = cells.select(*keys, "_y").distinct()
    dense = rank_rows(ys, [F.col("_y")], keys, "_ry")
    base = cells.join(dense, [*keys, "_y"])
    if levels is None:
        top = base.agg(F.max("_ry")).first()[0] or 1
        levels = int(top).bit_length()
    digits = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    bits = base.withColumn("_bit", digits)
    bits = bits.withColumn("_prefix", F.expr("shiftright(_ry, _bit + 1)"))
    bits = bits.withColumn("_one", F.expr("shiftright(_ry, _bit) & 1"))
    # Rows with equal x never count, so sum per (prefix, x) first.
    per_x = bits.groupBy(*keys, "_bit", "_prefix", "_x").agg(
        F.sum(F.when(F.col("_one") == 1, F.col("_c")).otherwise(0)).alias("_ones"),
        F.sum(F.when(F.col("_one") == 0, F.col("_c")).otherwise(0)).alias("_zeros"),
    )
    seen = running_sums(per_x, [F.col("_x")], {"_before": F.col("_ones")}, [*keys, "_bit", "_prefix"])
    inversions = ((F.col("_before") - F.col("_ones")) * F.col("_zeros")).cast("double")
    grouped = (lambda d: d.groupBy(*keys)) if keys else (lambda d: d.groupBy())

    def pairs(c: str) -> Column:
        return F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)

    disc = grouped(seen).agg(F.sum(inversions).alias("_d"))
    n = grouped(both).agg(F.count("*").alias("n"))
    tx = grouped(cells.groupBy(*keys, "_x").agg(F.sum("_c").alias("_m"))).agg(pairs("_m").alias("_tx"))
    ty = grouped(cells.groupBy(*keys, "_y").agg(F.sum("_c").alias("_m"))).agg(pairs("_m").alias("_ty"))
    txy = grouped(cells).agg(pairs("_c").alias("_txy"))
    parts = [disc, n, tx, ty, txy]
    joined = reduce(lambda a, b: a.join(b, keys) if keys else a.join(F.broadcast(b)), parts)
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    con_minus_dis = total - F.col("_tx") - F.col("_ty") + F.col("_txy") - 2 * F.col("_d")
    scale = F.sqrt((total - F.col("_tx")) * (total - F.col("_ty")))
    tau = F.when((F.col("n") >= min_rows) & (scale > 0), con_minus_dis / scale)
    return joined.select(*keys, "n", tau.alias("kendall"))


def with_p_values(table: DataFrame, rho: str = "spearman", n: str = "n") -> DataFrame:
    """Two-sided p of a correlation from its t statistic, by the normal limit of Student's t.

    Uses Hill's (1970) normalising transform of t with n-2 degrees of freedom.
    """
    nu = F.col(n) - 2
    t2 = F.col(rho) * F.col(rho) * nu / F.greatest(1 - F.col(rho) * F.col(rho), F.lit(1e-300))
    a = nu - 0.5
    b = 48 * a * a
    z2 = a * F.log1p(F.try_divide(t2, nu))
    z = F.sqrt(z2)
    u = z + (z * z2 + 3 * z) / b - (4 * F.pow(z, F.lit(7)) + 33 * F.pow(z, F.lit(5)) + 240 * F.pow(z, F.lit(3)) + 855 * z) / (
        10 * b * (b + 0.8 * F.pow(z, F.lit(4)) + 100)
    )
    return table.withColumn(f"{rho}_p", F.when(F.col(n) > 2, normal_two_sided(u)))


def normal_two_sided(u: Column) -> Column:
    """2*(1 - Phi(|u|)) by the Abramowitz-Stegun 7.1.26 error-function polynomial."""
    # Coefficients of formula 7.1.26.
    p, coefficients = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(u) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + p * x)
    poly = sum((F.lit(c) * F.pow(t, F.lit(i)) for i, c in enumerate(coefficients[1:], 2)), F.lit(coefficients[0]) * t)
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


SUPPORT_EDGES = (0, 20, 50, 100)


def support_bin(n: str, edges: Sequence[int] = SUPPORT_EDGES) -> Column:
    """'lo-hi' name of the support bin, the last one open."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, [*edges[1:], None]):
        name = f"{lo}-{'inf' if hi is None else hi}"
        inside = (F.col(n) >= lo) & (F.lit(True) if hi is None else F.col(n) < hi)
        out = F.when(inside, name).otherwise(out)
    return out


def stratified_correlation(df: DataFrame, x: str, y: str, support: str, edges: Sequence[int] = SUPPORT_EDGES) -> DataFrame:
    """Spearman and Kendall per support bin; null with fewer than 3 valid rows, rows below the first edge left out."""
    binned = df.withColumn("support_bin", support_bin(support, edges)).where(F.col("support_bin").isNotNull())
    s = spearman(binned, x, y, ["support_bin"])
    return s.join(kendall(binned, x, y, ["support_bin"]).drop("n"), "support_bin", "left")


def top_k_overlap(df: DataFrame, first: str, second: str, keys: Sequence[str], ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Jaccard overlap of the two top-k sets (smallest values first); only for k the table can fill."""
    keys = list(keys)
    a = rank_rows(df.select(*keys, first, second), [F.col(first), *[F.col(k) for k in keys]], (), "_a")
    b = rank_rows(a, [F.col(second), *[F.col(k) for k in keys]], (), "_b")
    tall = b.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    both, either = (F.col("_a") <= F.col("k")) & (F.col("_b") <= F.col("k")), (F.col("_a") <= F.col("k")) | (F.col("_b") <= F.col("k"))
    out = tall.groupBy("k").agg(
        F.count("*").alias("_n"), F.count_if(both).alias("_both"), F.count_if(either).alias("_either")
    )
    return out.where(F.col("_n") >= F.col("k")).select("k", (F.col("_both") / F.col("_either")).alias("overlap"))


def gap_analysis(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean and largest difference between consecutive sorted values."""
    kept = df.where(finite(value).isNotNull()).select(*keys, value)
    # The condition table has one row per condition.
    gap = F.col(value) - F.lag(value).over(Window.orderBy(value, *keys))
    return kept.select(gap.alias("_g")).agg(
        F.count("_g").alias("n_gaps"), F.avg("_g").alias("mean_gap"), F.max("_g").alias("max_gap")
    )


def monotonicity(df: DataFrame, bin_col: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rising steps between consecutive finite bins, and whether they are more than half."""
    keys = list(keys)
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bin_col)
    kept = df.where(finite(value).isNotNull())
    step = kept.withColumn("_up", F.col(value) > F.lag(value).over(window))
    grouped = step.groupBy(*keys) if keys else step.groupBy()
    out = grouped.agg(F.count("_up").alias("n_steps"), F.count_if(F.col("_up")).alias("n_rising"))
    return out.withColumn("monotone", F.col("n_rising") > F.col("n_steps") / 2)


def median_split_contrast(
    df: DataFrame, group: Sequence[str], score: str, covariates: Sequence[str], min_rows: int = 20, min_half: int = 5
) -> DataFrame:
    """Per covariate: median over groups of (low-half mean - high-half mean) and of the rank correlation with the score."""
    group = list(group)
    kept = df.where(finite(score).isNotNull())
    mid = percentiles(kept, score, [0.5], group, "_m").select(*group, F.col("_m")[0].alias("_mid"), F.col("n").alias("_n"))
    sided = kept.join(mid.where(F.col("_n") >= min_rows), group)
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("value")) for c in covariates])
    long = sided.withColumn("_e", F.explode(cells)).select(*group, score, "_mid", "_e.covariate", "_e.value")
    low = F.col(score) <= F.col("_mid")
    delta = long.groupBy(*group, "covariate").agg(
        F.count_if(low).alias("_nl"), F.count_if(~low).alias("_nh"),
        (F.avg(F.when(low, F.col("value"))) - F.avg(F.when(~low, F.col("value")))).alias("delta"),
    ).where((F.col("_nl") >= min_half) & (F.col("_nh") >= min_half))
    rho = spearman(long, score, "value", [*group, "covariate"]).drop("n")
    joined = delta.join(rho, [*group, "covariate"])
    return joined.groupBy("covariate").agg(
        F.count("*").alias("n_groups"), F.median("delta").alias("median_delta"), F.median("spearman").alias("median_rho")
    )
