"""Vector transforms, aggregates, bins and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import moments as M
from plumbline.operators import ranking as R
from plumbline.operators import sampling as SA
from plumbline.operators import selection as SE
from plumbline.operators import summaries as SU
from plumbline.plans.registry import (
    BASE, SCORE, V_SQL, draw, mean_sql, poisson_sql, query, real_gen, sql, table, unit_draw_sql, vectors, with_centre_score,
)

AB = ["a", "b"]

# ---- vector transforms ---------------------------------------------------------------------------


@query("l2_normalize", sql("SELECT sample_id, sqrt(list_dot_product(x, x)) AS before, u[1] AS first, list_sum(u) AS total FROM w", ["sample_id"], ["before", "first", "total"], BASE))
def l2_normalize(spark, sf):
    v = vectors(spark, sf).withColumn("u", V.l2_normalize("features"))
    return v.select("sample_id", V.norm("features").alias("before"), F.col("u")[0].alias("first"), V.vsum("u").alias("total"))


@query("center_then_normalize", sql("SELECT sample_id, list_sum(d) / (sqrt(list_dot_product(d, d)) + 1e-12) AS total, d[1] / (sqrt(list_dot_product(d, d)) + 1e-12) AS first FROM (SELECT sample_id, list_transform(list_zip(x, mu), lambda z: z[1] - z[2]) AS d FROM v, m)", ["sample_id"], ["total", "first"],
    [*BASE, f"m AS (SELECT mu FROM {mean_sql('r')})"]))
def center_then_normalize(spark, sf):
    real, _ = real_gen(spark, sf)
    mean = M.centroids(real, []).select("mu")
    v = vectors(spark, sf).join(F.broadcast(mean)).withColumn("c", V.center_then_normalize("features", "mu"))
    return v.select("sample_id", V.vsum("c").alias("total"), F.col("c")[0].alias("first"))


COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standardize", sql("SELECT l_orderkey, l_linenumber, " + ", ".join(f"({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f) AS {c}" for c in COLS) + " FROM lineitem", ["l_orderkey", "l_linenumber"], COLS, ["f AS (SELECT * FROM lineitem WHERE l_returnflag = 'A')"]))
def standardize(spark, sf):
    """Fit on one flag (the real rows), apply to all."""
    li = table(spark, sf, "lineitem")
    fit = M.standardize_fit(li.where("l_returnflag = 'A'"), COLS)
    return M.standardize_apply(li.select("l_orderkey", "l_linenumber", *COLS), fit)


@query("whiten")
def whiten(spark, sf):
    real, _ = real_gen(spark, sf)
    w = M.whiten(vectors(spark, sf), real)
    return w.select("sample_id", V.norm("whitened").alias("length"), V.vsum("whitened").alias("total"))


@query("pca_project")
def pca_project(spark, sf):
    real, gen = real_gen(spark, sf)
    p = M.pca_project(gen, real, 8)
    return p.select("sample_id", *[F.col("projected")[i].alias(f"pc{i + 1}") for i in range(8)])


@query("effective_rank")
def effective_rank(spark, sf):
    from plumbline.session import small_table

    real, gen = real_gen(spark, sf)
    rows = [{"side": n, "effective_rank": M.effective_rank(d), "overlap": M.subspace_overlap(d, real, 8)} for n, d in (("real", real), ("gen", gen))]
    return small_table(spark, rows, [("side", "string"), ("effective_rank", "double"), ("overlap", "double")])


@query("correlation_redundancy")
def correlation_redundancy(spark, sf):
    from plumbline.session import small_table

    r = M.correlation_redundancy(real_gen(spark, sf)[0])
    return small_table(spark, [r], [(k, "double" if isinstance(v, float) else "int") for k, v in r.items()])


@query("logsumexp_argmax", sql("SELECT sample_id, ln(list_sum(list_transform(x, lambda e: exp(e)))) AS lse, list_position(x, list_max(x)) - 1 AS amax, list_position(x, list_min(x)) - 1 AS amin FROM v", ["sample_id", "amax", "amin"], ["lse"], [V_SQL]))
def logsumexp_argmax(spark, sf):
    return vectors(spark, sf).select("sample_id", V.logsumexp("features").alias("lse"), V.argmax_index("features").alias("amax"), V.argmin_index("features").alias("amin"))


# ---- aggregates ----------------------------------------------------------------------------------


@query("centroids", sql(f"SELECT a, b, n, unnest(mu) AS m, (generate_subscripts(mu, 1) - 1)::INTEGER AS pos FROM {mean_sql('r', 'a, b')}", ["a", "b", "n", "pos"], ["m"], BASE))
def centroids(spark, sf):
    c = M.centroids(real_gen(spark, sf)[0], AB)
    return c.select(*AB, "n", F.posexplode("mu").alias("pos", "m"))


@query("mean_resultant_length", sql(f"SELECT b, n, sqrt(list_dot_product(mu, mu)) AS resultant FROM {mean_sql('r', 'b', 'u')}", ["b", "n"], ["resultant"], BASE))
def mean_resultant_length(spark, sf):
    return M.mean_resultant_length(real_gen(spark, sf)[0], ["b"])


@query("condition_stats", sql("SELECT a, b, count(*)::BIGINT AS n_samples, avg(trust) AS trust_mean, stddev_pop(trust) AS trust_std, avg(realism_z) AS realism_z_mean FROM sg GROUP BY a, b", ["a", "b", "n_samples"], ["trust_mean", "trust_std", "realism_z_mean"], SCORE))
def condition_stats(spark, sf):
    real, gen = real_gen(spark, sf)
    return SU.condition_stats(with_centre_score(real, gen), AB, ["trust"], ["realism_z"])


@query("feature_type_stats", sql("SELECT l_returnflag AS model, l_linestatus AS feature_type, count(*)::BIGINT AS n, avg(l_quantity) AS l_quantity_mean, stddev_pop(l_quantity) AS l_quantity_std, avg(l_tax) AS l_tax_mean, stddev_pop(l_tax) AS l_tax_std FROM lineitem GROUP BY 1, 2", ["model", "feature_type", "n"], ["l_quantity_mean", "l_quantity_std", "l_tax_mean", "l_tax_std"]))
def feature_type_stats(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_returnflag": "model", "l_linestatus": "feature_type"})
    return SU.feature_type_stats(li, ["l_quantity", "l_tax"])


@query("thresholds_per_condition", sql("SELECT event_type, n AS n_real, unnest([50, 75, 90, 95]) AS pct, unnest(q) AS threshold FROM (SELECT event_type, count(*)::BIGINT AS n, quantile_cont(value, [0.5, 0.75, 0.9, 0.95]) AS q FROM events GROUP BY 1 HAVING count(*) >= 20)", ["event_type", "n_real", "pct"], ["threshold"]))
def thresholds_per_condition(spark, sf):
    return SE.thresholds(table(spark, sf, "events"), "value", keys=["event_type"], min_rows=20)


@query("quantile_summary", sql("SELECT event_type, count(*)::BIGINT AS n, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95 FROM events GROUP BY 1", ["event_type", "n"], ["mean", "std", "q05", "q50", "q95"]))
def quantile_summary(spark, sf):
    return SU.quantile_summary(table(spark, sf, "events"), "value", ["event_type"])


@query("cosine_to_mean", sql("SELECT is_gen, count(*)::BIGINT AS n, avg(c) AS mean, stddev_pop(c) AS std, quantile_cont(c, 0.05) AS q05, quantile_cont(c, 0.5) AS q50, quantile_cont(c, 0.95) AS q95 FROM (SELECT is_gen, list_cosine_similarity(u, mu) AS c FROM w JOIN mg USING (is_gen)) GROUP BY 1", ["is_gen", "n"], ["mean", "std", "q05", "q50", "q95"], [*BASE, f"mg AS (SELECT is_gen, mu FROM {mean_sql('w', 'is_gen', 'u')})"]))
def cosine_to_mean(spark, sf):
    return SU.quantile_summary(SU.cosine_to_mean(vectors(spark, sf), ["is_gen"]), "cos_to_mean", ["is_gen"])


@query("norm_summary", sql("SELECT label, count(*)::BIGINT AS n, quantile_cont(l, 0.5) AS median, avg(l) AS mean, stddev_pop(l) AS std FROM (SELECT label, list_distance(x, mu) AS l FROM v, mv) GROUP BY 1", ["label", "n"], ["median", "mean", "std"], [V_SQL, f"mv AS (SELECT mu FROM {mean_sql('v')})"]))
def norm_summary(spark, sf):
    """Lengths of the vectors less their mean, as the vectors themselves all have length one."""
    v = vectors(spark, sf)
    centred = v.join(F.broadcast(M.centroids(v, []).select("mu"))).withColumn("features", F.zip_with("features", "mu", lambda x, m: x - m))
    return SU.norm_summary(centred.drop("mu"), ["label"])


@query("most_populous", sql("SELECT c_mktsegment, c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 1", ["c_mktsegment", "c_nationkey", "n"]))
def most_populous(spark, sf):
    return SU.most_populous(table(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


# Vectors (user, whole value, hour) repeat under different event ids.
DUP = ("dv AS (SELECT event_id AS sample_id, user_id AS q, floor(value) AS d, hour(ts) AS t FROM events)",)


def _measure_vectors(spark, sf):
    e = table(spark, sf, "events")
    parts = [F.col("user_id"), F.floor("value"), F.hour("ts")]
    return e.select(F.col("event_id").alias("sample_id"), F.array(*[p.cast("double") for p in parts]).alias("features"))


@query("dedupe_vectors", sql("SELECT min(sample_id) AS sample_id FROM dv GROUP BY q, d, t", ["sample_id"], [], DUP))
def dedupe_vectors(spark, sf):
    return SU.dedupe_vectors(_measure_vectors(spark, sf)).select("sample_id")


@query("dedupe_stats", sql("SELECT count(*)::BIGINT AS original_n, count(DISTINCT (q, d, t))::BIGINT AS deduped_n, (count(*) - count(DISTINCT (q, d, t)))::BIGINT AS n_removed, 'md5_round6' AS dedupe_key FROM dv", ["original_n", "deduped_n", "n_removed", "dedupe_key"], [], DUP))
def dedupe_stats(spark, sf):
    return SU.dedupe_stats(_measure_vectors(spark, sf))


@query("pivot_report", sql("SELECT p_brand, avg(p_retailprice) FILTER (WHERE p_size <= 10) AS b0, avg(p_retailprice) FILTER (WHERE p_size > 10 AND p_size <= 30) AS b1, avg(p_retailprice) FILTER (WHERE p_size > 30) AS b2, avg(p_retailprice) FILTER (WHERE p_size > 30) - avg(p_retailprice) FILTER (WHERE p_size <= 10) AS last_minus_first FROM part GROUP BY 1", ["p_brand"], ["b0", "b1", "b2", "last_minus_first"]))
def pivot_report(spark, sf):
    p = table(spark, sf, "part")
    size = F.when(F.col("p_size") <= 10, "b0").when(F.col("p_size") <= 30, "b1").otherwise("b2")
    m = p.groupBy("p_brand", size.alias("bin")).agg(F.avg("p_retailprice").alias("value"))
    return SU.pivot_report(m, "p_brand", "bin", "value", ["b0", "b1", "b2"])


def boot_sql(u: str, stat: str = "sum(w * value) / sum(w)") -> str:
    return f"(SELECT event_type, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (SELECT event_type, rep, {stat} AS m FROM (SELECT event_type, value, rep, {poisson_sql(u)} AS w FROM events, (SELECT unnest(range(20)) AS rep)) WHERE w > 0 GROUP BY 1, 2) GROUP BY 1)"


@query("bootstrap_means", sql(f"SELECT event_type, n, mean, ci_low, ci_high FROM (SELECT event_type, count(*)::BIGINT AS n, avg(value) AS mean FROM events GROUP BY 1) JOIN {boot_sql(unit_draw_sql(42, 'rep', 'event_id'))} USING (event_type)", ["event_type", "n"], ["mean", "ci_low", "ci_high"]))
def bootstrap_means(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_id", "sample_id")
    return SA.bootstrap_means(e, "value", ["event_type"], 20)


@query("weighted_improvement", sql("SELECT count(*)::BIGINT AS n, avg(delta) AS mean_delta, count(*) FILTER (WHERE delta > 0)::BIGINT AS n_improved, sum(pct * c) / sum(c) AS weighted_pct FROM (SELECT p_brand, count(*) AS c, avg(p_retailprice) - avg(p_size) * 40 AS delta, (avg(p_retailprice) - avg(p_size) * 40) / avg(p_retailprice) * 100 AS pct FROM part GROUP BY 1)", ["n", "n_improved"], ["mean_delta", "weighted_pct"]))
def weighted_improvement(spark, sf):
    p = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n_accepted"), F.avg("p_retailprice").alias("r"), (F.avg("p_size") * 40).alias("s"))
    p = p.withColumns({"delta": F.col("r") - F.col("s"), "improvement_pct": (F.col("r") - F.col("s")) / F.col("r") * 100})
    return SE.weighted_improvement(p)


# ---- bins ----------------------------------------------------------------------------------------


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), "event_type", "user_id", F.col("value").alias("score"))


EV = "ev AS (SELECT event_id AS sample_id, event_type, user_id, value AS score FROM events)"


def _bins_sql(keys: str, n: int, width: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return (
        f"SELECT *, (CASE WHEN wd = 0 THEN {n - 1} ELSE least((rk - 1) // wd, {n - 1}) END)::INTEGER AS bin FROM (SELECT *, {width} AS wd FROM "
        f"(SELECT *, row_number() OVER ({part} ORDER BY score, sample_id) AS rk, count(*) OVER ({part}) AS c FROM ev))"
    )


@query("bin_within", sql(_bins_sql("event_type", 10, "c // 10"), ["sample_id", "event_type", "bin"], [], [EV]))
def bin_within(spark, sf):
    return R.bin_within(_events(spark, sf), ["event_type"], 10).select("sample_id", "event_type", "bin")


@query("bin_within_small_groups", sql(_bins_sql("user_id", 200, "c // 200"), ["sample_id", "user_id", "bin"], [], [EV]))
def bin_within_small_groups(spark, sf):
    """Users with fewer events than bins fall into the last bin."""
    return R.bin_within(_events(spark, sf), ["user_id"], 200).select("sample_id", "user_id", "bin")


@query("bin_within_at_least_one", sql(_bins_sql("user_id", 200, "greatest(1, c // 200)"), ["sample_id", "user_id", "bin"], [], [EV]))
def bin_within_at_least_one(spark, sf):
    return R.bin_within(_events(spark, sf), ["user_id"], 200, at_least_one=True).select("sample_id", "user_id", "bin")


@query("bin_global", sql(_bins_sql("", 7, "c // 7"), ["sample_id", "bin"], [], [EV]))
def bin_global(spark, sf):
    return R.bin_within(_events(spark, sf), [], 7).select("sample_id", "bin")


@query("bin_global_even", sql("SELECT sample_id, ntile(7) OVER (ORDER BY score, sample_id) - 1 AS bin FROM ev", ["sample_id", "bin::INTEGER AS bin"], [], [EV]))
def bin_global_even(spark, sf):
    return R.bin_global_even(_events(spark, sf), 7).select("sample_id", "bin")


@query("quantile_bins", sql("SELECT sample_id, user_id, unnest(['Q' || greatest(1, ceil((rk - 1) * 4 / greatest(c - 1, 1)))::BIGINT, 'all']) AS bin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, sample_id) AS rk, count(*) OVER (PARTITION BY user_id) AS c FROM ev) WHERE c >= 4", ["sample_id", "user_id", "bin"], [], [EV]))
def quantile_bins(spark, sf):
    return R.quantile_bins(_events(spark, sf), ["user_id"], 4).select("sample_id", "user_id", "bin")


@query("bin_finite", sql(_bins_sql("event_type", 5, "c // 5").replace("FROM ev", "FROM fin"), ["sample_id", "event_type", "bin"], [], [EV, "fin AS (SELECT sample_id, event_type, ln(score - 1) AS score FROM ev WHERE score > 1)"]))
def bin_finite(spark, sf):
    raw = F.when(F.col("score") > 1, F.ln(F.col("score") - 1)).otherwise(F.lit(float("nan")))
    return R.bin_finite(_events(spark, sf).withColumn("score", raw), ["event_type"], 5).select("sample_id", "event_type", "bin")


@query("random_ranking_bins", sql(_bins_sql("event_type", 10, "c // 10"), ["sample_id", "event_type", "bin"], [], [f"ev AS (SELECT event_id AS sample_id, event_type, {draw(1000, '0', 'event_id')} AS score FROM events)"]))
def random_ranking_bins(spark, sf):
    e = R.random_scores(_events(spark, sf), 1000)
    return R.bin_within(e, ["event_type"], 10, "random_score").select("sample_id", "event_type", "bin")


def _corner_sql() -> str:
    keys = [("good_r_good_f", "realism_z + faithfulness_z"), ("good_r_bad_f", "realism_z - faithfulness_z"), ("bad_r_good_f", "faithfulness_z - realism_z"), ("bad_r_bad_f", "-realism_z - faithfulness_z")]
    ctes = [*SCORE]
    taken = ""
    for i, (name, key) in enumerate(keys):
        ctes.append(f"c{i} AS (SELECT a, b, '{name}' AS corner, sample_id FROM sg {('WHERE sample_id NOT IN (' + taken + ')') if taken else ''} QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY {key}, sample_id) = 1)")
        taken = " UNION ALL ".join(f"SELECT sample_id FROM c{j}" for j in range(i + 1))
    return sql(" UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(4)), ["a", "b", "corner", "sample_id"], [], ctes)


@query("corner_selection", _corner_sql())
def corner_selection(spark, sf):
    real, gen = real_gen(spark, sf)
    return R.corner_selection(with_centre_score(real, gen), AB).select(*AB, "corner", "sample_id")


@query("median_split_contrast", sql("SELECT covariate, count(*)::BIGINT AS n_groups, median(delta) AS median_delta, median(rho) AS median_rho FROM "
    "(SELECT user_id, covariate, avg(value) FILTER (WHERE score <= mid) - avg(value) FILTER (WHERE score > mid) AS delta, count(*) FILTER (WHERE score <= mid) AS nl, count(*) FILTER (WHERE score > mid) AS nh, corr(rx, ry) AS rho FROM "
    "(SELECT *, rank() OVER (PARTITION BY user_id, covariate ORDER BY score) + (count(*) OVER (PARTITION BY user_id, covariate, score) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY user_id, covariate ORDER BY value) + (count(*) OVER (PARTITION BY user_id, covariate, value) - 1) / 2.0 AS ry FROM lg) GROUP BY 1, 2) WHERE nl >= 5 AND nh >= 5 GROUP BY 1", ["covariate", "n_groups"], ["median_delta", "median_rho"],
    [EV, "md AS (SELECT user_id, quantile_cont(score, 0.5) AS mid FROM ev GROUP BY 1 HAVING count(*) >= 20)",
     "lg AS (SELECT user_id, score, mid, 'hour' AS covariate, hour(ts)::DOUBLE AS value FROM ev JOIN events ON sample_id = event_id JOIN md USING (user_id) UNION ALL SELECT user_id, score, mid, 'day', day(ts)::DOUBLE FROM ev JOIN events ON sample_id = event_id JOIN md USING (user_id))"]).replace("JOIN md USING (user_id)", "JOIN md ON md.user_id = ev.user_id").replace("SELECT user_id, score, mid, '", "SELECT ev.user_id, score, mid, '"))
def median_split_contrast(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), "user_id", F.col("value").alias("score"), F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"))
    return R.median_split_contrast(e, ["user_id"], "score", ["hour", "day"])


# ---- ranking statistics --------------------------------------------------------------------------


DOC = "dl AS (SELECT lang, n_chars::DOUBLE AS s, 1 - quality AS y, toxic FROM documents JOIN labels USING (doc_id))"


def _docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return d.join(table(spark, sf, "labels"), "doc_id").withColumn("bad", 1 - F.col("quality"))


CURVE = (
    DOC, "dc AS (SELECT s, sum(y) AS p, sum(1 - y) AS q FROM dl GROUP BY 1)",
    "cv AS (SELECT s, p, q, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS P_, sum(q) OVER () AS N_ FROM dc)",
)


@query("detection_summary", sql("SELECT any_value(P_)::BIGINT AS n_pos, any_value(N_)::BIGINT AS n_neg, sum(q * (tp - p + p / 2.0)) / (any_value(P_) * any_value(N_)) AS auroc, "
    "sum(p / P_ * (CASE WHEN tp - p + fp - q > 0 THEN (tp - p) / (tp - p + fp - q) ELSE 1 END + tp / (tp + fp)) / 2) AS auprc FROM cv", ["n_pos", "n_neg"], ["auroc", "auprc"], CURVE))
def detection_summary(spark, sf):
    return R.detection_summary(_docs(spark, sf), "score", "bad")


@query("detection_by_language", sql("SELECT lang, np AS n_pos, nn AS n_neg, CASE WHEN np > 0 AND nn > 0 THEN (rs - np * (np + 1) / 2.0) / (np * nn) END AS auroc FROM (SELECT lang, sum(toxic)::BIGINT AS np, sum(1 - toxic)::BIGINT AS nn, sum(rk) FILTER (WHERE toxic = 1) AS rs FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS rk FROM dl) GROUP BY 1)", ["lang", "n_pos", "n_neg"], ["auroc"], [DOC]))
def detection_by_language(spark, sf):
    return R.detection_summary(_docs(spark, sf), "score", "toxic", ["lang"]).drop("auprc")


@query("roc_points", sql("SELECT s AS threshold, fp / N_ AS fpr, tp / P_ AS tpr FROM cv", [], ["threshold", "fpr", "tpr"], CURVE))
def roc_points(spark, sf):
    return R.roc_points(_docs(spark, sf), "score", "bad")


@query("pr_points", sql("SELECT s AS threshold, tp / P_ AS recall, tp / (tp + fp) AS precision FROM cv", [], ["threshold", "recall", "precision"], CURVE))
def pr_points(spark, sf):
    return R.pr_points(_docs(spark, sf), "score", "bad")


RANKS = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"
LI = "li AS (SELECT l_returnflag AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


@query("spearman", sql(f"SELECT f, count(*)::BIGINT AS n, corr(rx, ry) AS spearman FROM (SELECT f, {RANKS.format(k='f', c='x')} AS rx, {RANKS.format(k='f', c='y')} AS ry FROM li) GROUP BY 1", ["f", "n"], ["spearman"], [LI]))
def spearman(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), "l_quantity", "l_extendedprice")
    return R.spearman(li, "l_quantity", "l_extendedprice", ["f"])


@query("pearson", sql("SELECT f, count(*)::BIGINT AS n, corr(x, y) AS pearson FROM li GROUP BY 1", ["f", "n"], ["pearson"], [LI]))
def pearson(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), "l_quantity", "l_extendedprice")
    return R.pearson_corr(li, "l_quantity", "l_extendedprice", ["f"])


KEND = "SELECT k, count(*)::BIGINT AS np, sum(sign(p.x - q.x) * sign(p.y - q.y)) AS cd, sum((p.x <> q.x)::INTEGER) AS ux, sum((p.y <> q.y)::INTEGER) AS uy FROM {t} p JOIN {t} q USING (k) WHERE p.id < q.id GROUP BY k"


@query("kendall", sql(f"SELECT k AS p_brand, n, cd / sqrt(ux::DOUBLE * uy) AS kendall FROM ({KEND.format(t='pk')}) JOIN (SELECT k, count(*)::BIGINT AS n FROM pk GROUP BY 1) USING (k)", ["p_brand", "n"], ["kendall"], ["pk AS (SELECT p_brand AS k, p_partkey AS id, p_size AS x, floor(p_retailprice / 20) AS y FROM part)"]))
def kendall(spark, sf):
    p = table(spark, sf, "part").withColumn("y", F.floor(F.col("p_retailprice") / 20))
    return R.kendall(p, "p_size", "y", ["p_brand"])


CONDS = "ct AS (SELECT p_brand, p_type, avg(p_size) AS x, avg(p_retailprice) AS y, count(*) AS n, (count(*) - 8) * 12 AS support FROM part GROUP BY 1, 2)"


def _conds(spark, sf):
    """Part conditions as a condition table with two metrics and a support."""
    g = table(spark, sf, "part").groupBy("p_brand", "p_type")
    return g.agg(F.avg("p_size").alias("x"), F.avg("p_retailprice").alias("y"), F.count("*").alias("n"), ((F.count("*") - 8) * 12).alias("support"))


SB = "CASE WHEN support >= 100 THEN '100-inf' WHEN support >= 50 THEN '50-100' WHEN support >= 20 THEN '20-50' WHEN support >= 0 THEN '0-20' END"


@query("stratified_correlation", sql(f"SELECT k AS support_bin, n, CASE WHEN n >= 3 THEN sp END AS spearman, CASE WHEN n >= 3 THEN cd / sqrt(ux::DOUBLE * uy) END AS kendall FROM (SELECT k, count(*)::BIGINT AS n, corr(rx, ry) AS sp FROM (SELECT k, {RANKS.format(k='k', c='x')} AS rx, {RANKS.format(k='k', c='y')} AS ry FROM cb) GROUP BY 1) LEFT JOIN ({KEND.format(t='cb')}) USING (k)", ["support_bin", "n"], ["spearman", "kendall"],
    [CONDS, f"cb AS (SELECT p_brand || p_type AS id, x, y, {SB} AS k FROM ct WHERE support >= 0)"]))
def stratified_correlation(spark, sf):
    return R.stratified_correlation(_conds(spark, sf), "x", "y", "support")


@query("top_k_overlap", sql("SELECT k, count(*) FILTER (WHERE ra <= k AND rb <= k) / count(*) FILTER (WHERE ra <= k OR rb <= k) AS overlap FROM (SELECT *, row_number() OVER (ORDER BY x, p_brand, p_type) AS ra, row_number() OVER (ORDER BY y, p_brand, p_type) AS rb FROM ct), (SELECT unnest([5, 10, 20, 500]) AS k) GROUP BY k HAVING count(*) >= k", ["k"], ["overlap"], [CONDS]))
def top_k_overlap(spark, sf):
    return R.top_k_overlap(_conds(spark, sf), "x", "y", ["p_brand", "p_type"], (5, 10, 20, 500))


@query("gap_analysis", sql("SELECT count(g)::BIGINT AS n_gaps, avg(g) AS mean_gap, max(g) AS max_gap FROM (SELECT y - lag(y) OVER (ORDER BY y, p_brand, p_type) AS g FROM ct)", ["n_gaps"], ["mean_gap", "max_gap"], [CONDS]))
def gap_analysis(spark, sf):
    return R.gap_analysis(_conds(spark, sf), "y", ["p_brand", "p_type"])


@query("monotonicity", sql("SELECT p_type, count(up)::BIGINT AS n_steps, count(*) FILTER (WHERE up)::BIGINT AS n_rising, count(*) FILTER (WHERE up) > count(up) / 2.0 AS monotone FROM (SELECT p_type, y > lag(y) OVER (PARTITION BY p_type ORDER BY bin) AS up FROM (SELECT p_type, p_size // 10 AS bin, avg(p_retailprice) AS y FROM part GROUP BY 1, 2)) GROUP BY 1", ["p_type", "n_steps", "n_rising", "monotone"]))
def monotonicity(spark, sf):
    p = table(spark, sf, "part").groupBy("p_type", F.expr("p_size div 10").alias("bin")).agg(F.avg("p_retailprice").alias("y"))
    return R.monotonicity(p, "bin", "y", ["p_type"])


@query("correlation_p_values")
def correlation_p_values(spark, sf):
    return R.with_p_values(R.spearman(_conds(spark, sf), "x", "y", ["p_type"]))


# ---- acceptance ----------------------------------------------------------------------------------

CUT = "th AS (SELECT unnest([50, 75, 90, 95]) AS pct, unnest(quantile_cont(trust, [0.5, 0.75, 0.9, 0.95])) AS threshold FROM sr)"


@query("accept_global", sql("SELECT sample_id, pct, threshold, trust FROM sg, th WHERE trust <= threshold", ["sample_id", "pct"], ["threshold", "trust"], [*SCORE, CUT]))
def accept_global(spark, sf):
    real, gen = real_gen(spark, sf)
    cuts = SE.thresholds(with_centre_score(real, real))
    return SE.accept(with_centre_score(real, gen), cuts).select("sample_id", "pct", "threshold", "trust")


@query("acceptance_summary", sql("SELECT CASE WHEN label < 7 THEN 'seen' ELSE 'unseen' END AS arm, pct, threshold, count(*)::BIGINT AS n_total, count(*) FILTER (WHERE trust <= threshold)::BIGINT AS n_accepted, count(*) FILTER (WHERE trust <= threshold) / count(*) AS rate FROM sg, th GROUP BY 1, 2, 3", ["arm", "pct", "n_total", "n_accepted"], ["threshold", "rate"], [*SCORE, CUT]))
def acceptance_summary(spark, sf):
    real, gen = real_gen(spark, sf)
    arm = F.when(F.col("label") < 7, "seen").otherwise("unseen")
    return SE.acceptance_summary(with_centre_score(real, gen).withColumn("arm", arm), SE.thresholds(with_centre_score(real, real)), by=["arm"])


@query("accept_per_condition", sql("SELECT g1.sample_id, g1.a, g1.b, cal_a, cal_b, threshold FROM sg g1 JOIN pl USING (a, b) JOIN (SELECT a AS cal_a, b AS cal_b, quantile_cont(trust, 0.95) AS threshold FROM sr GROUP BY 1, 2 HAVING count(*) >= 20) USING (cal_a, cal_b) WHERE trust <= threshold", ["sample_id", "a", "b", "cal_a", "cal_b"], ["threshold"],
    [*SCORE, "cs AS (SELECT DISTINCT a, b FROM sg)", "ss AS (SELECT DISTINCT a AS cal_a, b AS cal_b FROM sr WHERE label < 7)",
     "pl AS (SELECT * FROM cs, ss QUALIFY rank() OVER (PARTITION BY a, b ORDER BY (a <> cal_a)::INTEGER + (b <> cal_b)::INTEGER) = 1)"]))
def accept_per_condition(spark, sf):
    real, gen = real_gen(spark, sf)
    seen = real.where("label < 7").select(*AB)
    out = SE.accept_per_condition(with_centre_score(real, gen), with_centre_score(real, real), AB, 95, seen)
    return out.select("sample_id", *AB, "cal_a", "cal_b", "threshold")
