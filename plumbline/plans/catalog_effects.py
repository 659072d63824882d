"""Group effects, column selection, classifiers, bound audit and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import bounds as B
from plumbline.operators import effects as G
from plumbline.operators import features as FS
from plumbline.operators import moments as M
from plumbline.operators import probes as P
from plumbline.operators import selection as SE
from plumbline.operators.conditions import class_map
from plumbline.operators.sampling import stratified_test_split
from plumbline.operators.scoring import fit_components
from plumbline.operators.summaries import long_columns
from plumbline.plans.catalog_conditions import matched_sql
from plumbline.plans.registry import (
    BASE, SCORE, V_SQL, mean_sql, poisson_sql, query, real_gen, sql, table, unit_draw_sql,
    vectors, with_centre_score,
)
from plumbline.session import cut_lineage, small_table, work_folder
from plumbline.streaming.gate import acceptance_monitor, score_stream

AB = ["a", "b"]

def _scored(spark, sf):
    real, gen = real_gen(spark, sf)
    arm = F.when(F.col("label") < 7, "seen").otherwise("unseen")
    return real, with_centre_score(real, gen).withColumn("arm", arm)


def _accepted(real):
    """At or below the real 75% percentile of the score."""
    cut = SE.thresholds(with_centre_score(real, real), "trust", [75]).first()["threshold"]
    return F.col("trust") <= F.lit(cut)


RC = f"rc AS (SELECT a, b, mu, n FROM {mean_sql('r', 'a, b')})"
CUT = "cut AS (SELECT quantile_cont(trust, 0.75) AS t FROM sr)"
GA = "ga AS (SELECT sg.*, CASE WHEN label < 7 THEN 'seen' ELSE 'unseen' END AS arm, trust <= t AS ok FROM sg, cut)"
TR = (
    *SCORE, CUT, GA, RC,
    "want AS (SELECT arm, a, b, unnest([0, 1])::INTEGER AS rep, count(*) AS n_want FROM ga WHERE ok GROUP BY 1, 2, 3)",
    f"rnd AS (SELECT * FROM {matched_sql('want', 'ga', 'arm, a, b', 'rep', 0, True)})",
    "sides AS (SELECT arm, a, b, 'trust' AS side, 0 AS rep, sample_id::VARCHAR AS row_id, sample_id FROM ga WHERE ok UNION ALL SELECT arm, a, b, 'random', rep, sample_id || '#' || rep, sample_id FROM rnd)",
    "gd AS (SELECT ga.sample_id, list_distance(x, mu) AS d FROM ga JOIN rc USING (a, b))",
)

# ---- group effects -------------------------------------------------------------------------------


@query("centroid_distance", sql("SELECT g.sample_id, list_distance(g.x, c.mu) AS distance FROM g JOIN nr ON g.a = ga AND g.b = gb JOIN c ON c.a = nr.a AND c.b = nr.b", ["sample_id"], ["distance"],
    [*BASE, f"c AS (SELECT a, b, mu FROM {mean_sql('(SELECT * FROM r WHERE label < 7)', 'a, b')})", "nr AS (SELECT ga, gb, a, b FROM (SELECT DISTINCT a AS ga, b AS gb FROM g), c QUALIFY row_number() OVER (PARTITION BY ga, gb ORDER BY (a <> ga)::INTEGER + (b <> gb)::INTEGER, a, b) = 1)"]))
def centroid_distance(spark, sf):
    """Conditions without real rows use the nearest condition's centroid."""
    real, gen = real_gen(spark, sf)
    return G.centroid_distance(gen, real.where("label < 7"), AB).select("sample_id", "distance")


@query("loo_distance", sql("SELECT sample_id, list_distance(x, list_transform(list_zip(x, mu), lambda z: (z[2] * n - z[1]) / (n - 1))) AS distance FROM r JOIN rc USING (a, b) WHERE n > 1", ["sample_id"], ["distance"], [*BASE, RC]))
def loo_distance(spark, sf):
    return G.loo_distance(real_gen(spark, sf)[0], AB).select("sample_id", "distance")


SPREAD = (
    f"hs AS (SELECT *, row_number() OVER (PARTITION BY a, b, rep ORDER BY md5(concat_ws(':', 42, rep, sample_id)), sample_id) AS rk, count(*) OVER (PARTITION BY a, b, rep) // 2 AS h FROM r, (SELECT unnest(range(4)) AS rep))",
    f"ha AS (SELECT a, b, rep, mu FROM {mean_sql('(SELECT * FROM hs WHERE rk <= h)', 'a, b, rep')})",
    "spr AS (SELECT a, b, avg(d) AS rr_mean, stddev_samp(d) AS rr_std FROM (SELECT hs.a, hs.b, list_distance(x, mu) AS d FROM hs JOIN ha USING (a, b, rep) WHERE rk > h AND rk <= 2 * h) GROUP BY 1, 2)",
)


@query("real_spread", sql("SELECT * FROM spr", AB, ["rr_mean", "rr_std"], [*BASE, *SPREAD]))
def real_spread(spark, sf):
    return G.real_spread(real_gen(spark, sf)[0], AB, 4)


@query("loo_anchor", sql("SELECT count(*)::BIGINT AS n, avg(d / rr_mean) AS ratio, avg((d - rr_mean) / rr_std) AS z FROM (SELECT a, b, list_distance(x, list_transform(list_zip(x, mu), lambda z: (z[2] * n - z[1]) / (n - 1))) AS d FROM r JOIN rc USING (a, b)) JOIN spr USING (a, b)", ["n"], ["ratio", "z"], [*BASE, RC, *SPREAD]))
def loo_anchor(spark, sf):
    return G.loo_anchor(real_gen(spark, sf)[0], AB, 4)


def _delta_sql(value: str, extra: tuple = ()) -> tuple:
    u = unit_draw_sql(42, "rep", "concat_ws(':', side, row_id)")
    return (
        *extra,
        f"dr AS (SELECT arm, side, row_id, {value} AS val FROM sides JOIN gd USING (sample_id))",
        f"bw AS (SELECT arm, side, val, rep, {poisson_sql(u)} AS wt FROM dr, (SELECT unnest(range(20)) AS rep))",
        "bd AS (SELECT arm, rep, sum(wt * val) FILTER (WHERE side = 'trust') / sum(wt) FILTER (WHERE side = 'trust') - sum(wt * val) FILTER (WHERE side = 'random') / sum(wt) FILTER (WHERE side = 'random') AS dd FROM bw GROUP BY 1, 2)",
        "bc AS (SELECT arm, quantile_cont(dd, 0.025) AS ci_low, quantile_cont(dd, 0.975) AS ci_high FROM bd GROUP BY 1)",
        "pt AS (SELECT arm, count(*) FILTER (WHERE side = 'trust')::BIGINT AS n_trust, count(*) FILTER (WHERE side = 'random')::BIGINT AS n_random, avg(val) FILTER (WHERE side = 'trust') AS mean_trust, avg(val) FILTER (WHERE side = 'random') AS mean_random FROM dr GROUP BY 1)",
        "rep_ AS (SELECT *, mean_trust - mean_random AS delta, CASE WHEN ci_high < 0 THEN 'selected closer' WHEN ci_low > 0 THEN 'selected farther' ELSE 'no significant delta' END AS verdict FROM pt JOIN bc USING (arm) WHERE n_trust >= 10)",
    )


@query("centroid_report", sql("SELECT * FROM rep_", ["arm", "n_trust", "n_random", "verdict"], ["mean_trust", "mean_random", "delta", "ci_low", "ci_high"], [*TR, *_delta_sql("d")]))
def centroid_report(spark, sf):
    real, gen = _scored(spark, sf)
    return G.centroid_report(gen, real, _accepted(real), AB, seeds=2, reps=20)


@query("ratio_report", sql("SELECT *, CASE WHEN mean_random > 0 THEN -delta / mean_random * 100 END AS pct_closer, CASE WHEN mean_random - 1 > 1e-6 THEN -delta / (mean_random - 1) * 100 END AS pct_gap_closed FROM rep_",
    ["arm", "n_trust", "n_random", "verdict"], ["mean_trust", "mean_random", "delta", "ci_low", "ci_high", "pct_closer", "pct_gap_closed"],
    [*TR[:-1], *SPREAD, "gd AS (SELECT ga.sample_id, list_distance(x, mu) / rr_mean AS d FROM ga JOIN rc USING (a, b) JOIN spr USING (a, b))", *_delta_sql("d")]))
def ratio_report(spark, sf):
    real, gen = _scored(spark, sf)
    return G.ratio_report(gen, real, _accepted(real), AB, seeds=2, reps=20, half_reps=4)


FE = (
    "sx AS (SELECT arm, side, rep, a, b, x FROM sides JOIN ga USING (arm, a, b, sample_id))",
    f"sm AS (SELECT arm, side, rep, a, b, unnest(m.mu) AS mg, unnest(rc.mu) AS mr, (generate_subscripts(m.mu, 1) - 1)::INTEGER AS pos FROM {mean_sql('sx', 'arm, side, rep, a, b')} m JOIN rc USING (a, b))",
)


@query("feature_deltas", sql("SELECT arm, pos, max(e) FILTER (WHERE side = 'trust') AS err_trust, avg(e) FILTER (WHERE side = 'random') AS err_random, stddev_pop(e) FILTER (WHERE side = 'random') AS err_random_std, avg(e) FILTER (WHERE side = 'random') - max(e) FILTER (WHERE side = 'trust') AS improvement FROM (SELECT arm, side, rep, pos, avg(abs(mg - mr)) AS e FROM sm GROUP BY 1, 2, 3, 4) GROUP BY 1, 2", ["arm", "pos"], ["err_trust", "err_random", "err_random_std", "improvement"], [*TR, *FE]))
def feature_deltas(spark, sf):
    real, gen = _scored(spark, sf)
    return G.feature_deltas(gen, real, _accepted(real), AB, seeds=2)


FC = (*FE, "fr AS (SELECT arm, pos, max(r) FILTER (WHERE side = 'trust') AS r_trust, avg(r) FILTER (WHERE side = 'random') AS r_random FROM (SELECT arm, side, rep, pos, covar_pop(mg, mr) * count(*) / (sqrt(var_pop(mg) * var_pop(mr)) * count(*) + 1e-12) AS r FROM sm GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)")


@query("feature_correlations", sql("SELECT *, r_trust - r_random AS r_diff FROM fr", ["arm", "pos"], ["r_trust", "r_random", "r_diff"], [*TR, *FC]))
def feature_correlations(spark, sf):
    real, gen = _scored(spark, sf)
    return G.feature_correlations(gen, real, _accepted(real), AB, seeds=2)


@query("feature_correlation_extremes", sql(" UNION ALL ".join(
    f"SELECT arm, '{n}' AS list, row_number() OVER (PARTITION BY arm ORDER BY {o}, pos)::INTEGER AS place, pos FROM fr QUALIFY row_number() OVER (PARTITION BY arm ORDER BY {o}, pos) <= 5"
    for n, o in (("top_r_trust", "r_trust DESC"), ("bottom_r_trust", "r_trust"), ("top_r_random", "r_random DESC"), ("bottom_r_random", "r_random"), ("uninformative_trust", "abs(r_trust)"), ("uninformative_random", "abs(r_random)"))
), ["arm", "list", "place", "pos"], [], [*TR, *FC]))
def feature_correlation_extremes(spark, sf):
    real, gen = _scored(spark, sf)
    t = G.feature_correlations(gen, real, _accepted(real), AB, seeds=2)
    return G.correlation_extremes(t, top=5).select("arm", "list", "place", "pos")


def corr_sql(p: str, q: str) -> str:
    """Pearson r of two list columns."""
    mp, mq = f"list_avg({p})", f"list_avg({q})"
    cov = f"list_sum(list_transform(list_zip({p}, {q}), lambda z: (z[1] - {mp}) * (z[2] - {mq})))"
    vp, vq = (f"list_sum(list_transform({v}, lambda e: (e - {m}) * (e - {m})))" for v, m in ((p, mp), (q, mq)))
    return f"({cov} / sqrt({vp} * {vq}))"


EFF = (
    *BASE, RC, f"gc AS (SELECT a, b, mu FROM {mean_sql('g', 'a, b')})",
    *[f"{o} AS (SELECT t.a, t.b, list_transform(list_zip(t.mu, c.mu), lambda z: z[1] - z[2]) AS d FROM {s} t JOIN {s} c ON t.a = c.a AND c.b = 0 AND t.b <> 0)" for o, s in (("er", "rc"), ("eg", "gc"))],
    f"mx AS (SELECT er.a AS l_a, er.b AS l_b, eg.a AS r_a, eg.b AS r_b, {corr_sql('er.d', 'eg.d')} AS corr FROM er, eg)",
)


@query("effect_matrix", sql("SELECT * FROM mx", ["l_a", "l_b", "r_a", "r_b"], ["corr"], EFF))
def effect_matrix(spark, sf):
    """Attribute a is the cell, b the treatment, b = 0 the control."""
    real, gen = real_gen(spark, sf)
    return G.effect_matrix(real, gen, "a", "b", 0)


@query("effect_specificity", sql("SELECT median(corr) FILTER (WHERE l_a = r_a AND l_b = r_b) AS median_diag, median(corr) FILTER (WHERE NOT (l_a = r_a AND l_b = r_b)) AS median_offdiag, median(corr) FILTER (WHERE l_a = r_a AND l_b = r_b) - median(corr) FILTER (WHERE NOT (l_a = r_a AND l_b = r_b)) AS specificity FROM mx", [], ["median_diag", "median_offdiag", "specificity"], EFF))
def effect_specificity(spark, sf):
    real, gen = real_gen(spark, sf)
    return G.matrix_summary(G.effect_matrix(real, gen, "a", "b", 0), AB)


@query("effect_report")
def effect_report(spark, sf):
    real, gen = _scored(spark, sf)
    return G.effect_report(real, gen, _accepted(real), "a", "b", 0, 2)


LAD = (
    *SCORE, RC,
    "lb AS (SELECT *, 'Q' || greatest(1, ceil((rk - 1) * 3 / greatest(c - 1, 1)))::BIGINT AS bin FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY trust, sample_id) AS rk, count(*) OVER (PARTITION BY a, b) AS c FROM sg) WHERE c >= 15)",
    f"ld AS (SELECT a, b, bin, m.n, list_distance(m.mu, rc.mu) AS distance FROM {mean_sql('lb', 'a, b, bin')} m JOIN rc USING (a, b) WHERE m.n >= 5)",
)


@query("trust_ladder", sql("SELECT * FROM ld", ["a", "b", "bin", "n"], ["distance"], LAD))
def trust_ladder(spark, sf):
    real, gen = _scored(spark, sf)
    return G.trust_ladder(gen, real, AB, n_bins=3)


@query("ladder_summary", sql("SELECT bin, n, mean, ci_low, ci_high FROM (SELECT bin, count(*)::BIGINT AS n, avg(distance) AS mean FROM ld GROUP BY 1) JOIN (SELECT bin, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT bin, rep, sum(wt * distance) / sum(wt) AS m FROM "
    f"(SELECT bin, distance, rep, {poisson_sql(unit_draw_sql(0, 'rep', 'cond_id'))} AS wt FROM (SELECT *, a || ',' || b AS cond_id FROM ld), (SELECT unnest(range(50)) AS rep)) WHERE wt > 0 GROUP BY 1, 2) GROUP BY 1) USING (bin)", ["bin", "n"], ["mean", "ci_low", "ci_high"], LAD))
def ladder_summary(spark, sf):
    real, gen = _scored(spark, sf)
    return G.ladder_summary(G.trust_ladder(gen, real, AB, n_bins=3), AB, 50)


PROTO = (
    *SCORE, RC,
    "qb AS (SELECT a, b, x, unnest(['Q' || greatest(1, ceil((rk - 1) * 3 / greatest(c - 1, 1)))::BIGINT, 'all']) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY trust, sample_id) AS rk, count(*) OVER (PARTITION BY a, b) AS c FROM sg) WHERE c >= 3)",
    f"pm AS (SELECT bin AS l_bin, m.a AS l_a, m.b AS l_b, rc.a AS r_a, rc.b AS r_b, {corr_sql('m.mu', 'rc.mu')} AS corr FROM {mean_sql('qb', 'bin, a, b')} m, rc WHERE m.n >= 2)",
    "pbest AS (SELECT l_bin, l_a, l_b, (l_a = r_a AND l_b = r_b)::INTEGER AS hit FROM pm QUALIFY row_number() OVER (PARTITION BY l_bin, l_a, l_b ORDER BY corr DESC) = 1)",
)


@query("prototype_report", sql("SELECT l_bin AS bin, n_rows, top1_acc, md AS median_diag, mo AS median_offdiag, md - mo AS specificity FROM (SELECT l_bin, count(*)::BIGINT AS n_rows, avg(hit) AS top1_acc FROM pbest GROUP BY 1) JOIN (SELECT l_bin, median(corr) FILTER (WHERE l_a = r_a AND l_b = r_b) AS md, median(corr) FILTER (WHERE NOT (l_a = r_a AND l_b = r_b)) AS mo FROM pm GROUP BY 1) USING (l_bin)", ["bin", "n_rows"], ["top1_acc", "median_diag", "median_offdiag", "specificity"], PROTO))
def prototype_report(spark, sf):
    real, gen = _scored(spark, sf)
    return G.prototype_report(G.prototype_matrix(gen, real, AB, n_bins=3), AB)


# ---- column selection ----------------------------------------------------------------------------

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS = ["l_returnflag", "l_linestatus"]


def _measures(spark, sf):
    """Line items as a wide measurement table with two dependent and one constant column."""
    li = table(spark, sf, "lineitem").select(*COLS, *FLAGS)
    return li.withColumns({"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": F.col("l_extendedprice") * (1 + F.col("l_tax")), "flat": F.lit(1.0), "spike": F.when(F.col("l_extendedprice") > 104900, 1000.0).otherwise(F.col("l_quantity"))})


WIDE = [*COLS, "net", "gross", "flat", "spike"]
ME = "me AS (SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS gross, 1.0::DOUBLE AS flat, CASE WHEN l_extendedprice > 104900 THEN 1000.0 ELSE l_quantity END AS spike FROM lineitem)"


@query("variance_outlier_filter", sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance, greatest(max({c}) - avg({c}), avg({c}) - min({c})) / sqrt(var_pop({c})) AS max_abs_z FROM me" for c in WIDE if c != "flat") + ") WHERE variance > 1e-5 AND max_abs_z < 5", ["feature"], ["max_abs_z"], [ME]))
def variance_outlier_filter(spark, sf):
    return FS.variance_outlier_filter(_measures(spark, sf), WIDE).select("feature", "max_abs_z")


@query("correlation_prune", sql(" UNION ALL ".join(f"SELECT '{c}' AS feature FROM me HAVING " + (" AND ".join(f"abs(corr({p}, {c})) <= 0.7" for p in cols[:j]) or "true") for cols in [[*COLS, "net", "gross"]] for j, c in enumerate(cols)), ["feature"], [], [ME]))
def correlation_prune(spark, sf):
    kept = FS.correlation_prune(_measures(spark, sf), [*COLS, "net", "gross"])
    return small_table(spark, [{"feature": c} for c in kept], [("feature", "string")])


@query("measurement_columns", sql("SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, (SELECT count(*) FROM lineitem)::BIGINT AS n", ["feature", "n"]))
def measurement_columns(spark, sf):
    """Numeric columns without bookkeeping names, with their non-null counts."""
    li = table(spark, sf, "lineitem").withColumns({"Metadata_Well": F.lit(1), "FileName_DATA": F.lit("x"), "Group_Index": F.lit(2)})
    cols = FS.numeric_columns(li)
    return long_columns(li, cols, []).where(F.col("value").isNotNull()).groupBy("feature").agg(F.count("*").alias("n"))


def f_sql(col: str, factor: str) -> str:
    return f"(SELECT ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) FROM (SELECT count(*)::DOUBLE AS n, sum({col}) AS s, sum({col} * {col}) AS q FROM lineitem GROUP BY {factor}))"


@query("anova_top_k", sql("SELECT *, row_number() OVER (ORDER BY f_combo DESC, feature)::INTEGER AS place FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {f_sql(c, 'l_returnflag, l_linestatus')} AS f_combo, {f_sql(c, 'l_returnflag')} AS f_l_returnflag, {f_sql(c, 'l_linestatus')} AS f_l_linestatus" for c in COLS) + ") QUALIFY place <= 3", ["feature", "place"], ["f_combo", "f_l_returnflag", "f_l_linestatus"]))
def anova_top_k(spark, sf):
    return FS.anova_top_k(table(spark, sf, "lineitem"), COLS, FLAGS, 3)


@query("binned_information", sql("SELECT feature, sum(n / tot * ln(n * tot / (na * nb))) AS information FROM (SELECT *, sum(n) OVER (PARTITION BY feature, bb) AS na, sum(n) OVER (PARTITION BY feature, f, s) AS nb, sum(n) OVER (PARTITION BY feature) AS tot FROM (SELECT feature, f, s, len(list_filter(e, lambda t: t < val)) AS bb, count(*)::DOUBLE AS n FROM lg JOIN (SELECT feature, quantile_cont(val, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM lg GROUP BY 1) USING (feature) GROUP BY 1, 2, 3, 4)) GROUP BY 1", ["feature"], ["information"],
    ["lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS f, l_linestatus AS s, {c} AS val FROM lineitem" for c in COLS) + ")"]))
def binned_information(spark, sf):
    return FS.binned_information(table(spark, sf, "lineitem"), COLS, FLAGS)


@query("criteria_comparison")
def criteria_comparison(spark, sf):
    li = table(spark, sf, "lineitem")
    idx = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    z = M.standardize_apply(li.select(*COLS, *FLAGS, idx.alias("y")), M.standardize_fit(li, COLS))
    return FS.criteria_comparison(z, COLS, FLAGS, "y")


@query("criteria_accuracy")
def criteria_accuracy(spark, sf):
    """All 64 entries: eight best columns of each criterion against eight principal directions."""
    cols = [f"c{i}" for i in range(64)]
    wide = vectors(spark, sf).select("sample_id", "label", *AB, *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    return FS.criteria_accuracy(wide, cols, AB, "label", 8, (1, 5))


@query("aligned_ranking")
def aligned_ranking(spark, sf):
    """First half of the vector holds the label signal; columns are all entries of the second half."""
    v = vectors(spark, sf)
    a = v.select("sample_id", "b", F.slice("features", 1, 32).alias("features"))
    cols = [f"c{i}" for i in range(32)]
    b = v.select("sample_id", *[F.col("features")[32 + i].alias(c) for i, c in enumerate(cols)])
    return FS.aligned_ranking(a, b, cols, "b", max_iter=30)


@query("bootstrap_stability")
def bootstrap_stability(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("sample_id", F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return FS.bootstrap_stability(li, COLS, FLAGS, 2, 5)


@query("k_sweep", sql("SELECT n_columns, k, avg(hit) AS accuracy FROM hits GROUP BY 1, 2", ["n_columns", "k"], ["accuracy"], [
    V_SQL,
    "cf AS (SELECT pos, ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*))) AS f FROM (SELECT pos, a, b, count(*)::DOUBLE AS n, sum(e) AS s, sum(e * e) AS q FROM (SELECT a, b, unnest(x) AS e, generate_subscripts(x, 1) AS pos FROM v) GROUP BY 1, 2, 3) GROUP BY 1)",
    "od AS (SELECT list(pos ORDER BY f DESC, pos) AS o FROM cf)",
    "vx AS (SELECT sample_id, label, n_columns, list_transform(o[1:n_columns], lambda i: x[i]) AS y FROM v, od, (SELECT unnest([4, 16])::INTEGER AS n_columns))",
    "nb AS (SELECT * FROM (SELECT p.n_columns, p.sample_id, p.label AS own, q.label AS other, row_number() OVER (PARTITION BY p.n_columns, p.sample_id ORDER BY list_distance(p.y, q.y), q.sample_id) AS rk FROM vx p JOIN vx q ON p.n_columns = q.n_columns AND p.sample_id <> q.sample_id) AS t WHERE t.rk <= 5)",
    "hits AS (SELECT n_columns, k, sample_id, (other = own)::INTEGER AS hit FROM (SELECT n_columns, k, sample_id, own, other, count(*) AS c FROM nb, (SELECT unnest([1, 5])::INTEGER AS k) WHERE rk <= k GROUP BY 1, 2, 3, 4, 5) QUALIFY row_number() OVER (PARTITION BY n_columns, k, sample_id ORDER BY c DESC, other) = 1)"]))
def k_sweep(spark, sf):
    cols = [f"c{i}" for i in range(64)]
    v = vectors(spark, sf)
    wide = v.select("sample_id", "label", *AB, *[F.col("features")[i].alias(c) for i, c in enumerate(cols)])
    return FS.k_sweep(wide, cols, AB, "label", [4, 16], (1, 5))


# ---- classifiers ---------------------------------------------------------------------------------

ITER = 40


def _held_out(spark, sf):
    """Real rows kept for tests (30 % of each condition), and generated rows scored by the others."""
    split = stratified_test_split(real_gen(spark, sf)[0], AB)
    fit, test = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    return test, with_centre_score(fit, real_gen(spark, sf)[1])


@query("bin_downstream")
def bin_downstream(spark, sf):
    """The condition is learned from each score bin and read out on real rows that calibrated nothing."""
    test, gen = _held_out(spark, sf)
    r = P.bin_downstream(gen, test, AB, "label", ["trust", "realism_z", "faithfulness_z"], 5, 2)
    return r.select("ranking", "bin", "seed", "n", "micro", "macro", "coverage", "n_train_classes")


@query("bin_downstream_spread")
def bin_downstream_spread(spark, sf):
    """First-minus-last bin per ranking, and the spread between three preparations of the vectors."""
    test, gen = _held_out(spark, sf)
    runs = None
    for config in ("l2", "standardize", "none"):
        r = P.bin_downstream(gen, test, AB, "label", ["trust"], 3, 2, config).withColumn("config", F.lit(config))
        runs = r if runs is None else runs.unionByName(r)
    runs = cut_lineage(runs)
    spread = P.bin_spread(P.bin_summary(runs), 3)
    cfg = runs.groupBy("config", "ranking", "bin").agg(F.avg("micro").alias("value")).withColumn("metric", F.lit("micro"))
    return spread.join(F.broadcast(FS.selection_spread(cfg, 3).select("config", "random_level", F.col("spread").alias("score_spread"))))


@query("gen_to_real")
def gen_to_real(spark, sf):
    real, gen = real_gen(spark, sf)
    return P.gen_to_real(gen, real, "label", F.col("label") >= 7, ITER)


@query("decomposed_accuracy")
def decomposed_accuracy(spark, sf):
    v = vectors(spark, sf)
    ids = class_map(v, AB, "cond_id")
    v = v.join(ids, AB)
    return P.decomposed_accuracy(v.where("is_gen = 1"), v.where("is_gen = 0"), AB, v.where("label >= 7"), max_iter=ITER)


@query("readout")
def readout(spark, sf):
    real, gen = _scored(spark, sf)
    return P.readout(real, gen, _accepted(real), AB, "b", 2, 10, ITER)


@query("knn_conditioning")
def knn_conditioning(spark, sf):
    real, gen = _scored(spark, sf)
    return P.knn_conditioning(real, gen, AB, "label", 5, "arm", 50)


@query("knn_vote_accuracy", sql("SELECT label, count(*)::BIGINT AS n, avg((pred = label)::INTEGER) AS accuracy FROM g JOIN (SELECT query_id, pred FROM (SELECT query_id, label AS pred, count(*) AS c FROM nb GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, pred) = 1) ON sample_id = query_id GROUP BY 1", ["label", "n"], ["accuracy"],
    [*BASE, "nb AS (SELECT * FROM (SELECT p.sample_id AS query_id, q.label, row_number() OVER (PARTITION BY p.sample_id ORDER BY list_distance(p.x, q.x), q.sample_id) AS rk FROM g p, r q) AS t WHERE t.rk <= 5)"]))
def knn_vote_accuracy(spark, sf):
    real, gen = real_gen(spark, sf)
    from plumbline.operators.neighbors import knn_join, neighbor_vote

    votes = neighbor_vote(knn_join(gen, real, 5), real.select("sample_id", "label"), "label", 5)
    return P.per_class_accuracy(gen.select("sample_id", "label").join(votes, "sample_id"), "label")


@query("attribute_probes")
def attribute_probes(spark, sf):
    real, gen = real_gen(spark, sf)
    return P.attribute_probes(real, {"train": real, "gen": gen}, ["a"], ITER)


@query("multiclass_metrics")
def multiclass_metrics(spark, sf):
    real, gen = real_gen(spark, sf)
    rows = P.predict(gen, P.fit_logistic(real.where("label < 9"), "label", max_iter=ITER, balanced=True), label="label")
    return P.multiclass_metrics(rows.withColumn("label", F.when(F.col("label") == 9, -1).otherwise(F.col("label"))), "label")


@query("multiclass_metrics_fixed_rule", sql("SELECT (SELECT count(*) FROM vv)::BIGINT AS n, (SELECT avg((y = p)::INTEGER) FROM vv) AS accuracy, avg(f1) AS f1_macro, sum(f1 * t) / sum(t) AS f1_weighted FROM (SELECT k, sum(t) AS t, 2.0 * sum(tp) / (sum(t) + sum(p)) AS f1 FROM (SELECT y AS k, (y = p)::INTEGER AS tp, 1 AS t, 0 AS p FROM vv UNION ALL SELECT p, 0, 0, 1 FROM vv) GROUP BY 1)", ["n"], ["accuracy", "f1_macro", "f1_weighted"],
    [V_SQL, "vv AS (SELECT label AS y, (label + (x[1] > 0.1)::INTEGER + (x[2] > 0.2)::INTEGER) % 10 AS p FROM v WHERE label <> 4)"]))
def multiclass_metrics_fixed_rule(spark, sf):
    """The metrics on predictions of a fixed rule, so that SQL can repeat them; label 4 is ignored."""
    f = F.col("features")
    pred = (F.col("label") + (f[0] > 0.1).cast("int") + (f[1] > 0.2).cast("int")) % 10
    return P.multiclass_metrics(vectors(spark, sf).withColumn("predicted", pred), "label", ignore=4)


@query("cross_validate")
def cross_validate(spark, sf):
    return P.cross_validate(real_gen(spark, sf)[0], "b", 3, max_iter=ITER)


@query("signal_within")
def signal_within(spark, sf):
    real, gen = real_gen(spark, sf)
    return P.signal_within({"real": real, "gen": gen}, "a", "b", 2, ITER)


# ---- bound audit ---------------------------------------------------------------------------------


@query("bound_audit")
def bound_audit(spark, sf):
    real, gen = real_gen(spark, sf)
    out = None
    for attr, others in (("a", ["b"]), ("b", ["a"])):
        part = B.bound_audit(real, gen, attr, others)
        out = part if out is None else out.unionByName(part)
    return out


# ---- streams -------------------------------------------------------------------------------------


def _run_stream(df, spark, name: str):
    """Run a stream over everything available into a table of its own and read it back."""
    path = work_folder(spark, name)
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _stream_of(spark, sf, name: str):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("score_stream")
def stream_scores(spark, sf):
    """Arriving vectors are scored with a fitted model and accepted or not."""
    real, _ = real_gen(spark, sf)
    model = fit_components(real, AB)
    s = _stream_of(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.col("label") % 2).alias("a"), F.expr("cast(label div 2 as int)").alias("b"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
    return _run_stream(score_stream(s, model, 1.5).drop("features"), spark, "scores")


@query("acceptance_monitor", sql("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE value <= 5)::BIGINT AS n_accepted, count(*) FILTER (WHERE value <= 5) / count(*) AS rate FROM events GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)", ["window_start", "event_type", "n", "n_accepted"], ["rate"]))
def monitor(spark, sf):
    """Windows closed by the watermark: acceptance per hour and event type."""
    e = _stream_of(spark, sf, "events").withColumn("decision", F.when(F.col("value") <= 5, "accept").otherwise("abstain"))
    out = _run_stream(acceptance_monitor(e.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"]), spark, "monitor")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


