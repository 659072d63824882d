"""Group effects: centroid distances, treatment-effect and prototype matrices, score ladders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import vectors as V
from plumbline.operators.conditions import nearest_condition
from plumbline.operators.moments import centroids
from plumbline.operators.prefix import percentiles
from plumbline.operators.ranking import quantile_bins
from plumbline.operators.sampling import (
    bootstrap_means, draw_rank, half_split, poisson_reps, random_baseline, with_reps,
)
from plumbline.session import BLOCK_ROWS, cut_lineage, limit


def reference_centroids(rows: DataFrame, real: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Per condition of `rows` the real centroid, of the nearest condition where it has none."""
    attrs = list(attrs)
    mus = centroids(real, attrs)
    near = nearest_condition(rows, real, attrs)
    mus = mus.select(*[F.col(a).alias(f"near_{a}") for a in attrs], "mu", "n")
    return near.join(mus, [f"near_{a}" for a in attrs]).select(*attrs, "mu", F.col("n").alias("n_ref"))


def centroid_distance(rows: DataFrame, real: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Add the distance of every row to its condition's real centroid."""
    refs = reference_centroids(rows, real, attrs)
    return rows.join(refs, list(attrs)).withColumn("distance", V.l2_distance("features", "mu")).drop("mu", "n_ref")


def loo_distance(real: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Distance of real rows to the centroid of the other rows of their condition; single rows are skipped."""
    mus = centroids(real, attrs).where(F.col("n") > 1)
    joined = real.join(mus, list(attrs))
    # x - (n*mu - x)/(n-1) = (x - mu) * n/(n-1)
    gap = V.l2_distance("features", "mu") * F.col("n") / (F.col("n") - 1)
    return joined.withColumn("distance", gap).drop("mu", "n")


def delta_interval(rows: DataFrame, keys: Sequence[str], value: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of the accepted minus mean of the random side, with a two-sample bootstrap interval.

    `rows`: keys, row_id, side ('trust' / 'random') and the value; weights per
    repetition are Poisson(1) by draw key, so a repetition is one aggregate.
    """
    keys = list(keys)
    clean = rows.where(V.finite(value).isNotNull())
    tall = poisson_reps(clean.select(*keys, "row_id", "side", value), reps, seed, F.concat_ws(":", "side", F.col("row_id").cast("string")))
    sums = tall.groupBy(*keys, "rep").agg(
        *[
            (F.sum(F.when(F.col("side") == s, F.col("_w") * F.col(value))) / F.sum(F.when(F.col("side") == s, F.col("_w")))).alias(s)
            for s in ("trust", "random")
        ]
    )
    ends = F.percentile(F.col("trust") - F.col("random"), F.array(F.lit(0.025), F.lit(0.975)))
    ci = sums.groupBy(*keys).agg(ends.alias("_e"))
    point = clean.groupBy(*keys).agg(
        F.count_if(F.col("side") == "trust").alias("n_trust"), F.count_if(F.col("side") == "random").alias("n_random"),
        F.avg(F.when(F.col("side") == "trust", F.col(value))).alias("mean_trust"),
        F.avg(F.when(F.col("side") == "random", F.col(value))).alias("mean_random"),
    )
    out = point.join(ci, keys).withColumn("delta", F.col("mean_trust") - F.col("mean_random"))
    out = out.withColumns({"ci_low": F.col("_e")[0], "ci_high": F.col("_e")[1]}).drop("_e")
    verdict = (
        F.when(F.col("ci_high") < 0, "selected closer").when(F.col("ci_low") > 0, "selected farther").otherwise("no significant delta")
    )
    return out.withColumn("verdict", verdict)


def trust_and_random(
    gen: DataFrame, accepted: Column, attrs: Sequence[str], by: str = "arm", seeds: int = 5, mode: str = "combo_stratified"
) -> DataFrame:
    """Row ids of the accepted rows and of matched random rows: attrs, by, side, rep, row_id, sample_id."""
    keys = list(dict.fromkeys([by, *attrs]))
    rows = gen.select(*keys, "sample_id", accepted.alias("_ok"))
    taken = rows.where(F.col("_ok"))
    sid = F.col("sample_id").cast("string")
    trust = taken.select(*keys, F.lit("trust").alias("side"), F.lit(0).alias("rep"), sid.alias("row_id"), "sample_id")
    if mode == "combo_stratified":
        rand = random_baseline(taken, rows, keys, seeds)
    else:
        n = taken.groupBy(by).agg(F.count("*").alias("_n"))
        ranked = draw_rank(with_reps(rows.join(n, by), seeds), "sample_id", 0, [by, "rep"], F.col("rep"))
        rand = ranked.where(F.col("draw_rank") <= F.col("_n"))
    rand = rand.select(
        *keys, F.lit("random").alias("side"), "rep", F.concat_ws("#", sid, F.col("rep").cast("string")).alias("row_id"), "sample_id"
    )
    return trust.unionByName(rand)


def centroid_report(
    gen: DataFrame, real: DataFrame, accepted: Column, attrs: Sequence[str], by: str = "arm", seeds: int = 5,
    mode: str = "combo_stratified", reps: int = 1000, min_trust: int = 10,
) -> DataFrame:
    """Are accepted rows closer to their real centroid than matched random rows? Per arm with interval and verdict."""
    dist = centroid_distance(gen, real, attrs).select("sample_id", "distance")
    rows = trust_and_random(gen, accepted, attrs, by, seeds, mode).join(dist, "sample_id")
    return delta_interval(rows, [by], "distance", reps).where(F.col("n_trust") >= min_trust)


def real_spread(real: DataFrame, attrs: Sequence[str], reps: int = 10, seed: int = 42) -> DataFrame:
    """Per condition mean and sample std of real distances to a random half's centroid.

    Conditions below 4 rows use the distances to the full centroid.
    """
    attrs = list(attrs)
    sizes = real.groupBy(*attrs).agg(F.count("*").alias("_n"))
    big = real.join(sizes.where(F.col("_n") >= 4).select(*attrs), attrs, "left_semi")
    halves = half_split(big.select(*attrs, "sample_id"), attrs, reps, seed).join(real.select("sample_id", "features"), "sample_id")
    cell = [*attrs, "rep"]
    mu = centroids(halves.where(F.col("side") == "A"), cell).select(*cell, "mu")
    dist = halves.where(F.col("side") == "B").join(mu, cell).select(*attrs, V.l2_distance("features", "mu").alias("_d"))
    few = real.join(sizes.where(F.col("_n") < 4).select(*attrs), attrs, "left_semi")
    dist = dist.unionByName(few.join(centroids(few, attrs).select(*attrs, "mu"), attrs).select(*attrs, V.l2_distance("features", "mu").alias("_d")))
    return dist.groupBy(*attrs).agg(
        F.avg("_d").alias("rr_mean"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("rr_std")
    )


def normalized_distance(rows: DataFrame, spread: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """ratio = d/mean and z = (d - mean)/std against the real spread; null where undefined."""
    out = rows.join(spread, list(attrs), "left")
    return out.withColumns(
        {
            "ratio": F.when(F.col("rr_mean") > 0, F.col("distance") / F.col("rr_mean")),
            "z": F.when(F.col("rr_std") > 0, (F.col("distance") - F.col("rr_mean")) / F.col("rr_std")),
        }
    ).drop("rr_mean", "rr_std")


def ratio_report(
    gen: DataFrame, real: DataFrame, accepted: Column, attrs: Sequence[str], by: str = "arm", value: str = "ratio",
    seeds: int = 5, reps: int = 1000, half_reps: int = 10, min_trust: int = 10,
) -> DataFrame:
    """Normalised distances of accepted and random rows, with percent closer and share of the excess gap closed."""
    spread = real_spread(real, attrs, half_reps)
    dist = normalized_distance(centroid_distance(gen, real, attrs), spread, attrs).select("sample_id", value)
    rows = trust_and_random(gen, accepted, attrs, by, seeds).join(dist, "sample_id")
    out = delta_interval(rows, [by], value, reps).where(F.col("n_trust") >= min_trust)
    base = F.col("mean_random")
    anchor = 1.0 if value == "ratio" else 0.0
    return out.withColumns(
        {
            "pct_closer": F.when(base > 0, -F.col("delta") / base * 100),
            "pct_gap_closed": F.when(base - anchor > 1e-6, -F.col("delta") / (base - anchor) * 100),
        }
    )


def loo_anchor(real: DataFrame, attrs: Sequence[str], half_reps: int = 10) -> DataFrame:
    """Mean ratio and z of real rows against their own spread: near 1 and 0."""
    rows = normalized_distance(loo_distance(real, attrs), real_spread(real, attrs, half_reps), attrs)
    return rows.agg(F.count("ratio").alias("n"), F.avg("ratio").alias("ratio"), F.avg("z").alias("z"))


def feature_errors(rows: DataFrame, real: DataFrame, attrs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per vector position the mean over conditions of |mean(rows) - mean(real)|."""
    attrs, keys = list(attrs), list(keys)
    a = centroids(rows, [*keys, *attrs]).select(*keys, *attrs, F.col("mu").alias("_a"))
    b = centroids(real, attrs).select(*attrs, F.col("mu").alias("_b"))
    gap = F.zip_with("_a", "_b", lambda x, y: F.abs(x - y))
    return a.join(b, attrs).select(*keys, F.posexplode(gap).alias("pos", "_g")).groupBy(*keys, "pos").agg(
        F.avg("_g").alias("error")
    )


def feature_deltas(
    gen: DataFrame, real: DataFrame, accepted: Column, attrs: Sequence[str], by: str = "arm", seeds: int = 5
) -> DataFrame:
    """Per position how much closer to real the accepted condition means are than random ones."""
    sides = trust_and_random(gen, accepted, attrs, by, seeds).join(gen.select("sample_id", "features"), "sample_id")
    err = feature_errors(sides, real, attrs, list(dict.fromkeys([by, "side", "rep"])))
    out = err.groupBy(by, "pos").agg(
        F.max(F.when(F.col("side") == "trust", F.col("error"))).alias("err_trust"),
        F.avg(F.when(F.col("side") == "random", F.col("error"))).alias("err_random"),
        F.stddev_pop(F.when(F.col("side") == "random", F.col("error"))).alias("err_random_std"),
    )
    return out.withColumn("improvement", F.col("err_random") - F.col("err_trust"))


def feature_correlations(
    gen: DataFrame, real: DataFrame, accepted: Column, attrs: Sequence[str], by: str = "arm", seeds: int = 5
) -> DataFrame:
    """Per position the correlation, over conditions, of accepted and of random means with real means."""
    attrs = list(attrs)
    sides = trust_and_random(gen, accepted, attrs, by, seeds).join(gen.select("sample_id", "features"), "sample_id")
    cell = list(dict.fromkeys([by, "side", "rep"]))
    a = centroids(sides, [*cell, *[x for x in attrs if x != by]]).withColumnRenamed("mu", "_a")
    b = centroids(real, attrs).select(*attrs, F.col("mu").alias("_b"))
    both = a.join(b, attrs).select(*cell, F.posexplode(F.arrays_zip("_a", "_b")).alias("pos", "_e"))
    num = F.covar_pop("_e._a", "_e._b") * F.count("*")
    den = F.sqrt(F.var_pop("_e._a") * F.var_pop("_e._b")) * F.count("*") + F.lit(1e-12)
    r = both.groupBy(*cell, "pos").agg((num / den).alias("r"))
    out = r.groupBy(by, "pos").agg(
        F.max(F.when(F.col("side") == "trust", F.col("r"))).alias("r_trust"),
        F.avg(F.when(F.col("side") == "random", F.col("r"))).alias("r_random"),
    )
    return out.withColumn("r_diff", F.col("r_trust") - F.col("r_random"))


def correlation_extremes(table: DataFrame, by: str = "arm", top: int = 10) -> DataFrame:
    """Top and bottom positions by r_trust and r_random, and the least informative ones by |r|."""
    orders = {
        "top_r_trust": F.desc("r_trust"), "bottom_r_trust": F.asc("r_trust"),
        "top_r_random": F.desc("r_random"), "bottom_r_random": F.asc("r_random"),
        "uninformative_trust": F.abs("r_trust").asc(), "uninformative_random": F.abs("r_random").asc(),
    }
    out = None
    for name, order in orders.items():
        place = F.row_number().over(Window.partitionBy(by).orderBy(order, "pos"))
        part = table.withColumns({"list": F.lit(name), "place": place}).where(F.col("place") <= top)
        out = part if out is None else out.unionByName(part)
    return out


def _standardized(df: DataFrame, vec: str) -> Column:
    """(x - mean)/(norm of x - mean), so that Pearson is a dot product; null for constant vectors."""
    mean = V.vsum(vec) / F.size(vec)
    centred = F.transform(vec, lambda v: v - mean)
    length = V.norm(centred)
    return F.when(length > 1e-12, F.transform(centred, lambda v: v / length))


def correlation_matrix(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], vec: str = "mu") -> DataFrame:
    """Pearson r of every left vector with every right vector, as rows (left keys, right keys, r).

    Both sides are cut into bounded blocks that meet by block number; a task
    multiplies two blocks.
    """
    left_keys, right_keys = list(left_keys), list(right_keys)
    rows = limit(left.sparkSession, BLOCK_ROWS)

    def packed(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        unit = df.select(F.struct(*keys).alias("_k"), _standardized(df, vec).alias("_v")).where(F.col("_v").isNotNull())
        total = unit.agg(F.ceil(F.count("*") / rows).cast("int").alias("_nb"))
        block = F.pmod(F.xxhash64(F.to_json("_k")), F.col("_nb")).cast("int")
        cut = unit.join(F.broadcast(total)).withColumn(f"{tag}b", block)
        return cut.groupBy(f"{tag}b", F.col("_nb").alias(f"{tag}n")).agg(
            F.collect_list("_k").alias(f"{tag}k"), F.flatten(F.collect_list("_v")).alias(f"{tag}v")
        )

    a, b = packed(left, left_keys, "l"), packed(right, right_keys, "r")
    n_right = b.agg(F.max("rn").alias("_m"))
    a = a.join(F.broadcast(n_right)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    pairs = a.join(b, "rb").select("lk", "lv", "rk", "rv")
    schema = T.StructType(
        [
            T.StructField("l", pairs.schema["lk"].dataType.elementType),
            T.StructField("r", pairs.schema["rk"].dataType.elementType),
            T.StructField("corr", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lk, rk = batch.column(0)[i].values, batch.column(2)[i].values
                x = batch.column(1)[i].values.to_numpy().reshape(len(lk), -1)
                y = batch.column(3)[i].values.to_numpy().reshape(len(rk), -1)
                m = x @ y.T
                li, ri = np.divmod(np.arange(m.size), m.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [lk.take(pa.array(li)).cast(arrow.field(0).type), rk.take(pa.array(ri)).cast(arrow.field(1).type), pa.array(m.ravel())],
                    schema=arrow,
                )

    out = pairs.mapInArrow(run, schema)
    return out.select(
        *[F.col(f"l.{k}").alias(f"l_{k}") for k in left_keys], *[F.col(f"r.{k}").alias(f"r_{k}") for k in right_keys], "corr"
    )


def treatment_effects(rows: DataFrame, cell: str, treatment: str, control: int, keys: Sequence[str] = ()) -> DataFrame:
    """mean(treated) - mean(control of the same cell) per (cell, treatment)."""
    keys = list(keys)
    mus = centroids(rows, [*keys, cell, treatment])
    ctrl = mus.where(F.col(treatment) == control).select(*keys, cell, F.col("mu").alias("_c"))
    treated = mus.where(F.col(treatment) != control)
    return treated.join(ctrl, [*keys, cell]).select(*keys, cell, treatment, V.sub("mu", "_c").alias("mu"))


def effect_matrix(
    real: DataFrame, gen: DataFrame, cell: str, treatment: str, control: int
) -> DataFrame:
    """Correlation of every real treatment effect with every generated one, over the effects both sides have."""
    d_real = treatment_effects(real, cell, treatment, control)
    d_gen = treatment_effects(gen, cell, treatment, control)
    keys = [cell, treatment]
    shared = d_real.select(*keys).join(d_gen.select(*keys), keys)
    return correlation_matrix(d_real.join(shared, keys, "left_semi"), d_gen.join(shared, keys, "left_semi"), keys, keys)


def matrix_summary(matrix: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median diagonal, median off-diagonal and their difference (specificity)."""
    by = list(by)
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    tagged = matrix.withColumn("_diag", same)
    q = percentiles(tagged, "corr", [0.5], [*by, "_diag"], "_m").select(*by, "_diag", F.col("_m")[0].alias("_v"))
    grouped = q.groupBy(*by) if by else q.groupBy()
    out = grouped.agg(
        F.max(F.when(F.col("_diag"), F.col("_v"))).alias("median_diag"),
        F.max(F.when(~F.col("_diag"), F.col("_v"))).alias("median_offdiag"),
    )
    return out.withColumn("specificity", F.col("median_diag") - F.col("median_offdiag"))


def effect_report(
    real: DataFrame, gen: DataFrame, accepted: Column, cell: str, treatment: str, control: int, seeds: int = 5
) -> DataFrame:
    """Specificity of the accepted rows' effect matrix, next to matched random rows over several seeds."""
    attrs = [cell, treatment]
    sides = trust_and_random(gen, accepted, attrs, cell, seeds).join(gen.select("sample_id", "features"), "sample_id")
    tag = ["side", "rep"]
    d_real = treatment_effects(real, cell, treatment, control)
    d_gen = treatment_effects(sides, cell, treatment, control, tag)
    m = correlation_matrix(d_real, d_gen, attrs, [*tag, *attrs])
    # Rows of the matrix are the effects the same side also has.
    have = d_gen.select(F.col("side").alias("r_side"), F.col("rep").alias("r_rep"), *[F.col(a).alias(f"l_{a}") for a in attrs])
    m = cut_lineage(m.join(have, ["r_side", "r_rep", *[f"l_{a}" for a in attrs]], "left_semi"))
    per = matrix_summary(m, attrs, ["r_side", "r_rep"])
    return per.groupBy(F.col("r_side").alias("side")).agg(
        F.count("*").alias("n_draws"),
        *[F.avg(c).alias(c) for c in ("median_diag", "median_offdiag", "specificity")],
        F.coalesce(F.stddev_samp("specificity"), F.lit(0.0)).alias("specificity_std"),
    )


def trust_ladder(
    gen: DataFrame, real: DataFrame, attrs: Sequence[str], score: str = "trust", n_bins: int = 4, min_per_bin: int = 5
) -> DataFrame:
    """Per condition and score quantile the distance of the quantile's centroid to the real centroid."""
    attrs = list(attrs)
    bins = quantile_bins(gen.where(V.finite(score).isNotNull()), attrs, n_bins, score, anchor=False, min_rows=n_bins * min_per_bin)
    a = centroids(bins, [*attrs, "bin"]).where(F.col("n") >= min_per_bin)
    b = centroids(real, attrs).select(*attrs, F.col("mu").alias("_real"))
    return a.join(b, attrs).select(*attrs, "bin", "n", V.l2_distance("mu", "_real").alias("distance"))


def ladder_summary(ladder: DataFrame, attrs: Sequence[str], reps: int = 1000) -> DataFrame:
    """Mean distance per quantile over the conditions with a bootstrap interval."""
    cond = F.concat_ws(",", *[F.col(a).cast("string") for a in attrs])
    return bootstrap_means(ladder.withColumn("cond_id", cond), "distance", ["bin"], reps, 0, sample_id="cond_id")


def prototype_matrix(
    gen: DataFrame, real: DataFrame, attrs: Sequence[str], score: str = "trust", n_bins: int = 4,
    min_real: int = 1, min_gen: int = 2,
) -> DataFrame:
    """Correlation of every (bin, condition) generated mean with every real condition mean."""
    attrs = list(attrs)
    bins = quantile_bins(gen.where(V.finite(score).isNotNull()), attrs, n_bins, score)
    proto = centroids(real, attrs).where(F.col("n") >= min_real)
    means = centroids(bins, ["bin", *attrs]).where(F.col("n") >= min_gen).join(proto.select(*attrs), attrs, "left_semi")
    return correlation_matrix(means, proto, ["bin", *attrs], attrs)


def prototype_report(matrix: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Per bin: top-1 accuracy of matching the right real condition, and specificity."""
    attrs = list(attrs)
    matrix = cut_lineage(matrix)  # one row per pair of conditions, read three times
    left = ["l_bin", *[f"l_{a}" for a in attrs]]
    best = matrix.groupBy(*left).agg(F.max_by(F.struct(*[f"r_{a}" for a in attrs]), "corr").alias("_b"))
    hit = F.lit(True)
    for a in attrs:
        hit = hit & (F.col(f"l_{a}") == F.col(f"_b.r_{a}"))
    top = best.groupBy("l_bin").agg(F.count("*").alias("n_rows"), F.avg(hit.cast("double")).alias("top1_acc"))
    summary = matrix_summary(matrix, attrs, ["l_bin"])
    return top.join(summary, "l_bin").withColumnRenamed("l_bin", "bin")
