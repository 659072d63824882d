"""Scoring, calibration and selection on fitted Gaussians."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import moments as M
from plumbline.operators import scoring as S
from plumbline.operators import selection as SE
from plumbline.functions import vectors as V
from plumbline.plans import evaluate as E
from plumbline.plans.registry import (
    BASE, SEEN_LABELS, fit_ctes, mean_sql, quad, query, real_gen, seen_conditions, sql, trust_ctes, unit,
)
from plumbline.session import small_table

SCORE_COLS = ["realism_z", "faithfulness_z", "trust"]


@query("trust_scores", sql("SELECT * FROM scored WHERE is_gen = 1", ["sample_id", "a", "b"], SCORE_COLS, trust_ctes(), True))
def trust_scores(spark, sf):
    real, gen = real_gen(spark, sf)
    return S.score("mahalanobis", real, gen, ["a", "b"]).select("sample_id", "a", "b", *SCORE_COLS)


@query(
    "seen_calibrated_scores",
    sql("SELECT * FROM scored WHERE is_gen = 1", ["sample_id", "label"], SCORE_COLS,
        (*trust_ctes("rs")[:4], f"rs AS (SELECT * FROM r WHERE label < {SEEN_LABELS})", *trust_ctes("rs")[4:]), True),
)
def seen_calibrated_scores(spark, sf):
    """Unseen values of b are scored against the seen ones only."""
    real, gen = real_gen(spark, sf)
    model = S.fit_components(real, ["a", "b"], seen=seen_conditions(spark, sf))
    return S.score_from_components(gen, model).select("sample_id", "label", *SCORE_COLS)


@query(
    "realism_two_sided",
    sql("SELECT sample_id, realism_z * realism_z AS realism_z FROM scored WHERE is_gen = 1", ["sample_id"], ["realism_z"], trust_ctes(), True),
)
def realism_two_sided(spark, sf):
    real, gen = real_gen(spark, sf)
    return S.score_from_components(gen, S.fit_components(real, ["a", "b"]), two_sided=True).select("sample_id", "realism_z")


@query(
    "attribute_margins",
    sql("SELECT sample_id, max(m) FILTER (WHERE grp = 'a') AS margin_a, max(m) FILTER (WHERE grp = 'b') AS margin_b FROM am JOIN g USING (sample_id) GROUP BY 1",
        ["sample_id"], ["margin_a", "margin_b"], trust_ctes(), True),
)
def attribute_margins(spark, sf):
    real, gen = real_gen(spark, sf)
    model = S.fit_components(real, ["a", "b"])
    return S.score_from_components(gen, model, keep_margins=True).select("sample_id", "margin_a", "margin_b")


@query(
    "calibration_stats",
    sql("SELECT '' AS scope, me AS mean, se AS std FROM gc UNION ALL SELECT grp, mm, sm FROM ac", ["scope"], ["mean", "std"], trust_ctes(), True),
)
def calibration_stats(spark, sf):
    real, _ = real_gen(spark, sf)
    model = S.fit_components(real, ["a", "b"])
    rows = [{"scope": "", "mean": model.overall.mean, "std": model.overall.std}]
    rows += [{"scope": a, "mean": f.mean, "std": f.std} for a, f in model.attributes.items()]
    return small_table(spark, rows, [("scope", "string"), ("mean", "double"), ("std", "double")])


@query(
    "shrunk_precision",
    sql("SELECT grp AS scope, n, alpha AS shrinkage, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][i])) AS trace, "
        "list_sum(list_transform(p, lambda r: list_sum(r))) AS total FROM prec JOIN (SELECT grp, n, alpha FROM lw) USING (grp)",
        ["scope", "n"], ["shrinkage", "trace", "total"], (*BASE, *fit_ctes()), True),
)
def shrunk_precision(spark, sf):
    """Ledoit-Wolf intensity and the inverse of the shrunk global and pooled within-class covariances."""
    real, _ = real_gen(spark, sf)
    out = []
    g = M.ledoit_wolf(real, normalize=True)
    parts = {"": (g["n"], g["shrinkage"], M.precision(g["cov"]))}
    units = unit(real).withColumnRenamed("features", "_u")
    for attr in ("a", "b"):
        means = M.centroids(units, [attr], "_u")
        rows = units.join(means.select(attr, "mu"), attr)
        resid = rows.select(V.sub("_u", "mu").alias("features"))
        lw = M.ledoit_wolf(resid)
        parts[attr] = (lw["n"], lw["shrinkage"], S.pooled_precision(units, means, [attr], 2))
    for scope, (n, alpha, prec) in parts.items():
        out.append({"scope": scope, "n": int(n), "shrinkage": float(alpha), "trace": float(prec.trace()), "total": float(prec.sum())})
    return small_table(spark, out, [("scope", "string"), ("n", "long"), ("shrinkage", "double"), ("trace", "double"), ("total", "double")])


CLASS_FIT = (
    *BASE,
    f"mb AS (SELECT b, mu, n FROM {mean_sql('r', 'b', 'u')})",
    "residv AS (SELECT b::VARCHAR AS grp, sample_id, list_transform(list_zip(u, mu), lambda z: z[1] - z[2]) AS d FROM r JOIN mb USING (b))",
    "resid AS (SELECT grp, sample_id, unnest(d) AS d, generate_subscripts(d, 1) AS pos FROM residv)",
    *fit_ctes()[5:],
)


@query(
    "precision_per_value",
    sql("SELECT grp::INTEGER AS b, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][i])) AS trace FROM prec", ["b"], ["trace"], CLASS_FIT, True),
)
def precision_per_value(spark, sf):
    """Own covariance per attribute value (the variant without sharing)."""
    real, _ = real_gen(spark, sf)
    fit = S.fit_attribute(real, "b", shared_cov=False)
    rows = [{"b": int(v), "trace": float(p.trace())} for blk in fit.blocks for v, p in zip(blk.values, blk.precisions)]
    return small_table(spark, rows, [("b", "int"), ("trace", "double")])


@query(
    "gram_sums",
    sql("SELECT b, count(*)::BIGINT AS n, sum(list_sum(x)) AS total, sum(list_dot_product(x, x)) AS trace, sum(pow(list_sum(x), 2)) AS gram_total FROM r GROUP BY b",
        ["b", "n"], ["total", "trace", "gram_total"], BASE),
)
def gram_sums(spark, sf):
    real, _ = real_gen(spark, sf)
    rows = [
        {"b": int(k[0]), "n": m.n, "total": float(m.total.sum()), "trace": float(m.gram.trace()), "gram_total": float(m.gram.sum())}
        for k, m in M.collect_group_moments(real, ["b"])
    ]
    return small_table(spark, rows, [("b", "int"), ("n", "long"), ("total", "double"), ("trace", "double"), ("gram_total", "double")])


def _mixture_sql() -> str:
    ctes = (
        *BASE,
        f"mc AS (SELECT a, b, mu, n FROM {mean_sql('r', 'a, b', 'u')} WHERE n >= 10)",
        "residv AS (SELECT '' AS grp, sample_id, list_transform(list_zip(u, mu), lambda z: z[1] - z[2]) AS d FROM r JOIN mc USING (a, b))",
        "resid AS (SELECT grp, sample_id, unnest(d) AS d, generate_subscripts(d, 1) AS pos FROM residv)",
        *fit_ctes()[5:],
        "dd AS (SELECT w.sample_id, is_gen, list_transform(list_zip(u, mu), lambda z: z[1] - z[2]) AS d FROM w, mc)",
        f"ee AS (SELECT sample_id, is_gen, min({quad('d', 'p')}) AS e FROM dd, prec GROUP BY 1, 2)",
        "cc AS (SELECT avg(e) AS me, stddev_samp(e) AS se FROM ee WHERE is_gen = 0)",
    )
    return sql("SELECT sample_id, pow((e - me) / (se + 1e-12), 2) AS mixture_z FROM ee, cc WHERE is_gen = 1", ["sample_id"], ["mixture_z"], ctes, True)


@query("mixture_realism", _mixture_sql())
def mixture_realism(spark, sf):
    real, gen = real_gen(spark, sf)
    return S.mixture_realism(gen, S.fit_mixture(real, ["a", "b"])).select("sample_id", "mixture_z")


@query(
    "selection_by_condition",
    sql("SELECT a, b, count(*)::BIGINT AS n_gen, count(*) FILTER (WHERE trust <= t)::BIGINT AS n_accepted, avg(trust) AS trust_mean, stddev_pop(trust) AS trust_std, "
        "avg(realism_z) AS realism_mean, avg(faithfulness_z) AS faithfulness_mean FROM scored, th WHERE is_gen = 1 GROUP BY a, b",
        ["a", "b", "n_gen", "n_accepted"], ["trust_mean", "trust_std", "realism_mean", "faithfulness_mean"],
        (*trust_ctes(), "th AS (SELECT quantile_cont(trust, 0.95) AS t FROM scored WHERE is_gen = 0)"), True),
)
def selection_by_condition(spark, sf):
    """Fit on real, score all, accept at the real 95% percentile, summarise per condition."""
    real, gen = real_gen(spark, sf)
    model = S.fit_components(real, ["a", "b"])
    scored_real = S.score_from_components(real.select("sample_id", "a", "b", "features"), model)
    cut = SE.thresholds(scored_real, "trust", [95]).select(F.col("threshold").alias("_t"))
    rows = S.score_from_components(gen.select("a", "b", "features"), model).drop("features").join(F.broadcast(cut))
    return rows.groupBy("a", "b").agg(
        F.count("*").alias("n_gen"), F.count_if(F.col("trust") <= F.col("_t")).alias("n_accepted"),
        F.avg("trust").alias("trust_mean"), F.stddev_pop("trust").alias("trust_std"),
        F.avg("realism_z").alias("realism_mean"), F.avg("faithfulness_z").alias("faithfulness_mean"),
    )


@query(
    "trust_thresholds",
    sql("SELECT count(*)::BIGINT AS n_real, unnest([50, 75, 90, 95]) AS pct, unnest(quantile_cont(trust, [0.5, 0.75, 0.9, 0.95])) AS threshold FROM scored WHERE is_gen = 0",
        ["n_real", "pct"], ["threshold"], trust_ctes(), True),
)
def trust_thresholds(spark, sf):
    real, gen = real_gen(spark, sf)
    return SE.thresholds(E.score_tables(real, gen, ["a", "b"])[0])


@query(
    "model_artifact",
    sql("SELECT grp AS scope, val::VARCHAR AS value, mm AS mean, sm AS std, sqrt(list_dot_product(mu, mu)) AS length FROM mua JOIN ac USING (grp) "
        "UNION ALL SELECT 'global', NULL, me, se, sqrt(list_dot_product(c, c)) FROM gc, mug", ["scope", "value"], ["mean", "std", "length"], trust_ctes(), True),
)
def model_artifact(spark, sf):
    """The stored form of a fitted model, one row per mean vector."""
    real, _ = real_gen(spark, sf)
    rows = S.model_table(real, S.fit_components(real, ["a", "b"]))
    return rows.select("scope", "value", "mean", "std", V.norm("mu").alias("length"))


@query("linear_probe_energy")
def linear_probe_energy(spark, sf):
    from plumbline.operators import probes  # noqa: F401

    real, gen = real_gen(spark, sf)
    return S.score("linear_probe", real, gen, ["a", "b"], max_iter=100).select("sample_id", *SCORE_COLS)


@query(
    "target_alignment",
    sql("SELECT g.sample_id, t.mu IS NULL AS no_target, coalesce(-list_dot_product(g.u, list_transform(t.mu, lambda e: e / (sqrt(list_dot_product(t.mu, t.mu)) + 1e-12))), 0) AS alignment "
        "FROM g LEFT JOIN t USING (a, b)", ["sample_id", "no_target"], ["alignment"],
        (*BASE, f"t AS (SELECT a, b, mu FROM {mean_sql(f'(SELECT * FROM r WHERE label < {SEEN_LABELS})', 'a, b', 'x')})")),
)
def target_alignment(spark, sf):
    real, gen = real_gen(spark, sf)
    targets = M.centroids(real.where(F.col("label") < SEEN_LABELS), ["a", "b"], name="target")
    return S.target_alignment(gen, targets, ["a", "b"]).select("sample_id", "no_target", "alignment")


ALPHA = [i / 10 for i in range(11)]


@query(
    "alpha_precision",
    sql("SELECT alpha, radius, avg((list_distance(u, c) <= radius)::INTEGER) AS precision FROM g, mug, rad GROUP BY 1, 2", [], ["alpha", "radius", "precision"],
        (*BASE, fit_ctes()[0], f"rad AS (SELECT unnest({ALPHA}) AS alpha, unnest(quantile_cont(list_distance(u, c), {ALPHA})) AS radius FROM r, mug)")),
)
def alpha_precision(spark, sf):
    return E.alpha_precision(*real_gen(spark, sf))


@query(
    "seen_unseen_detection",
    sql("SELECT score, count(*) FILTER (WHERE y = 1)::BIGINT AS n_pos, count(*) FILTER (WHERE y = 0)::BIGINT AS n_neg, "
        "(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auroc FROM "
        "(SELECT score, y, rank() OVER (PARTITION BY score ORDER BY val) + (count(*) OVER (PARTITION BY score, val) - 1) / 2.0 AS rk FROM long) GROUP BY score",
        ["score", "n_pos", "n_neg"], ["auroc"],
        (*trust_ctes("rs")[:4], f"rs AS (SELECT * FROM r WHERE label < {SEEN_LABELS})", *trust_ctes("rs")[4:],
         *[f"l{i} AS (SELECT '{c}' AS score, (label >= {SEEN_LABELS})::INTEGER AS y, {c} AS val FROM scored WHERE is_gen = 1)" for i, c in enumerate(SCORE_COLS)],
         "long AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"), True),
)
def seen_unseen_detection(spark, sf):
    real, gen = real_gen(spark, sf)
    seen = seen_conditions(spark, sf)
    scored = E.score_tables(real, gen, ["a", "b"], seen)[1]
    return E.seen_unseen_detection(scored, ["a", "b"], seen).drop("auprc")


@query(
    "failure_detection",
    sql("SELECT count(*) FILTER (WHERE y = 1)::BIGINT AS n_pos, count(*) FILTER (WHERE y = 0)::BIGINT AS n_neg, "
        "(sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auroc FROM "
        f"(SELECT (label >= {SEEN_LABELS})::INTEGER AS y, rank() OVER (ORDER BY avg(trust)) AS rk FROM scored WHERE is_gen = 1 GROUP BY label)", ["n_pos", "n_neg"], ["auroc"],
        (*trust_ctes("rs")[:4], f"rs AS (SELECT * FROM r WHERE label < {SEEN_LABELS})", *trust_ctes("rs")[4:]), True),
)
def failure_detection(spark, sf):
    real, gen = real_gen(spark, sf)
    seen = seen_conditions(spark, sf)
    return E.failure_detection(E.score_tables(real, gen, ["a", "b"], seen)[1], ["a", "b"], seen).drop("auprc")


@query("real_gen_detection")
def real_gen_detection(spark, sf):
    real, gen = real_gen(spark, sf)
    return E.real_gen_detection(real, gen, ["a", "b"], seen_conditions(spark, sf))


@query("real_gen_detection_resampled")
def real_gen_detection_resampled(spark, sf):
    """Intervals over several halvings of all real rows."""
    real, gen = real_gen(spark, sf)
    return E.real_gen_detection(real, gen, ["a", "b"], resamples=2)
