"""Neighbours, kernel and moment distances, selections measured by distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cell_index
from plumbline.operators import distances as D
from plumbline.operators import neighbors as N
from plumbline.operators import scoring as S
from plumbline.operators import selection as SE
from plumbline.operators import trajectory as TR
from plumbline.plans import evaluate as E
from plumbline.plans.catalog_conditions import matched_sql, steps_of
from plumbline.plans.registry import (
    BASE, SCORE, draw, fit_ctes, kid_sql, mean_sql, quad, query, real_gen, sql, vectors, with_centre_score,
)

AB = ["a", "b"]

# ---- neighbours ----------------------------------------------------------------------------------


def nn_sql(q: str, r: str, k: int, vec: str = "x", dist: str = "list_distance({p}, {q})", self_: bool = False, where: str = "true") -> str:
    d = dist.format(p=f"p.{vec}", q=f"q.{vec}")
    skip = "AND p.sample_id <> q.sample_id" if self_ else ""
    return (
        f"(SELECT * FROM (SELECT p.sample_id AS query_id, q.sample_id AS ref_id, {d} AS distance, row_number() OVER (PARTITION BY p.sample_id ORDER BY {d}, q.sample_id)::INTEGER AS rank "
        f"FROM {q} p JOIN {r} q ON {where} {skip}) AS nn WHERE nn.rank <= {k})"
    )


COS = "1 - list_dot_product({p}, {q})"


@query("knn_join", sql(f"SELECT * FROM {nn_sql('g', 'r', 3)}", ["query_id", "ref_id", "rank"], ["distance"], BASE))
def knn_join(spark, sf):
    real, gen = real_gen(spark, sf)
    return N.knn_join(gen, real, 3)


@query("knn_self_cosine", sql(f"SELECT * FROM {nn_sql('r', 'r', 5, 'u', COS, True)}", ["query_id", "ref_id", "rank"], ["distance"], BASE))
def knn_self_cosine(spark, sf):
    real, _ = real_gen(spark, sf)
    return N.knn_join(real, real, 5, metric="cosine", exclude_self=True)


@query("knn_radius", sql(f"SELECT query_id AS sample_id, distance AS radius FROM {nn_sql('g', 'r', 5, 'u', COS)} WHERE rank = 5", ["sample_id"], ["radius"], BASE))
def knn_radius(spark, sf):
    real, gen = real_gen(spark, sf)
    return N.knn_radius(gen, real, 5)


@query("knn_radius_leave_one_out", sql(f"SELECT query_id AS sample_id, distance AS radius FROM {nn_sql('r', 'r', 5, 'u', COS, True)} WHERE rank = 5", ["sample_id"], ["radius"], BASE))
def knn_radius_leave_one_out(spark, sf):
    real, _ = real_gen(spark, sf)
    return N.knn_radius(real, real, 5, leave_one_out=True)


CLS = (
    "ns AS (SELECT b, count(*) AS n FROM r WHERE b < 4 GROUP BY b)",
    f"inn AS (SELECT query_id, distance, rank, g.b FROM {nn_sql('g', '(SELECT * FROM r WHERE b < 4)', 5, 'u', COS, False, 'p.b = q.b')} k JOIN g ON g.sample_id = k.query_id)",
    f"outn AS (SELECT * FROM {nn_sql('(SELECT * FROM g WHERE b = 4)', '(SELECT * FROM r WHERE b < 4)', 5, 'u', COS)})",
)


@query("class_knn", sql("SELECT query_id AS sample_id, distance FROM inn JOIN ns USING (b) WHERE rank = least(5, greatest(n - 1, 1)) UNION ALL SELECT query_id, distance FROM outn WHERE rank = 5", ["sample_id"], ["distance"], [*BASE, *CLS]))
def class_knn(spark, sf):
    """Neighbours of the same attribute value; the value missing in the reference uses the whole pool."""
    real, gen = real_gen(spark, sf)
    return N.class_knn(gen, real.where("b < 4"), "b", 5)


@query("knn_per_attribute", sql("SELECT sample_id, sum(d) AS trust, sum(d) AS faithfulness_z, 0.0 AS realism_z FROM (" + " UNION ALL ".join(
    f"SELECT query_id AS sample_id, distance AS d FROM {nn_sql('g', 'r', 5, 'u', COS, False, f'p.{c} = q.{c}')} WHERE rank = 5" for c in AB) + ") GROUP BY 1", ["sample_id"], ["trust", "faithfulness_z", "realism_z"], BASE))
def knn_per_attribute(spark, sf):
    real, gen = real_gen(spark, sf)
    return S.score("knn_per_attr", real, gen, AB).select("sample_id", "trust", "faithfulness_z", "realism_z")


@query("neighbor_graph")
def neighbor_graph(spark, sf):
    return N.neighbor_graph(real_gen(spark, sf)[0], 5)


@query("approximate_knn")
def approximate_knn(spark, sf):
    real, gen = real_gen(spark, sf)
    return N.approx_knn(gen, real, 5)


@query("index_recall")
def index_recall(spark, sf):
    """Recall of the index for the queries whose id is divisible by 20, against the exact join with all references."""
    rows = vectors(spark, sf).select("sample_id", "features")
    index = cell_index.build_index(rows)
    asked = rows.where("sample_id % 20 = 0")
    exact = N.knn_join(asked, rows, 10)
    probes = cell_index.probes_for(index, rows.where("sample_id % 20 = 10"), N.knn_join(rows.where("sample_id % 20 = 10"), rows, 10), 0.97)
    return cell_index.recall(cell_index.search(index, asked, 10, probes), exact).withColumn("probes", F.lit(probes)).withColumn("cells", F.lit(len(index.codes.centres)))


BETA = [i / 10 for i in range(11)]


@query("beta_recall", sql("SELECT beta, avg((bd.m IS NOT NULL AND bd.m <= bi)::INTEGER) AS recall FROM (SELECT unnest(range(11)) AS bi, unnest(" + str(BETA) + ") AS beta), (SELECT t.query_id, min(gb.band) AS m FROM tau t JOIN r ON r.sample_id = t.query_id LEFT JOIN gb ON list_distance(r.u, gb.u) <= t.distance GROUP BY 1) bd GROUP BY beta", [], ["beta", "recall"],
    [*BASE, f"tau AS (SELECT * FROM {nn_sql('r', 'r', 5, 'u', self_=True)} WHERE rank = 5)", f"gm AS (SELECT mu FROM {mean_sql('g', '', 'u')})", f"rad AS (SELECT quantile_cont(list_distance(u, mu), {BETA}) AS q FROM g, gm)",
     "gb AS (SELECT g.sample_id, u, len(list_filter(q, lambda e: e < list_distance(u, mu))) AS band FROM g, gm, rad)"]))
def beta_recall(spark, sf):
    return N.beta_recall(*real_gen(spark, sf), BETA)


@query("authenticity", sql(f"SELECT n.query_id AS sample_id, n.ref_id AS nearest_real, n.distance AS gen_dist, o.distance AS real_dist, (n.distance >= o.distance)::INTEGER::DOUBLE AS authentic FROM {nn_sql('g', 'r', 1, 'u')} n JOIN {nn_sql('r', 'r', 1, 'u', self_=True)} o ON o.query_id = n.ref_id", ["sample_id", "nearest_real"], ["gen_dist", "real_dist", "authentic"], BASE))
def authenticity(spark, sf):
    return N.authenticity(*real_gen(spark, sf))


# ---- kernel distances ----------------------------------------------------------------------------

PAIR = "sd AS (SELECT b, 'x' AS side, sample_id AS did, u FROM r UNION ALL SELECT b, 'y', sample_id, u FROM g)"


@query("kid_whole_groups", sql("SELECT b, nx AS n_x, ny AS n_y, sxx / (nx * (nx - 1)) + syy / (ny * (ny - 1)) - 2 * sxy / (nx * ny) AS kid FROM (SELECT p.b, "
    "sum(k) FILTER (WHERE ps = 'x' AND qs = 'x' AND NOT same) AS sxx, sum(k) FILTER (WHERE ps = 'y' AND qs = 'y' AND NOT same) AS syy, sum(k) FILTER (WHERE ps = 'x' AND qs = 'y') AS sxy FROM "
    "(SELECT p.b, p.side AS ps, q.side AS qs, p.did = q.did AS same, pow(list_dot_product(p.u, q.u) + 1, 3) AS k FROM sd p JOIN sd q USING (b)) p GROUP BY 1) JOIN (SELECT b, count(*) FILTER (WHERE side = 'x')::BIGINT AS nx, count(*) FILTER (WHERE side = 'y')::BIGINT AS ny FROM sd GROUP BY 1) USING (b)", ["b", "n_x", "n_y"], ["kid"], [*BASE, PAIR]))
def kid_whole_groups(spark, sf):
    real, gen = real_gen(spark, sf)
    return D.kid(real, gen, ["b"])


@query("kid_whole_standard", sql("SELECT nx AS n_x, ny AS n_y, sxx / (nx * (nx - 1)) + syy / (ny * (ny - 1)) - 2 * sxy / (nx * ny) AS kid FROM (SELECT "
    "sum(k) FILTER (WHERE ps = 0 AND qs = 0 AND NOT same) AS sxx, sum(k) FILTER (WHERE ps = 1 AND qs = 1 AND NOT same) AS syy, sum(k) FILTER (WHERE ps = 0 AND qs = 1) AS sxy FROM "
    "(SELECT p.is_gen AS ps, q.is_gen AS qs, p.sample_id = q.sample_id AS same, pow(list_dot_product(p.x, q.x) / 64 + 1, 3) AS k FROM v p, v q)), (SELECT count(*) FILTER (WHERE is_gen = 0)::BIGINT AS nx, count(*) FILTER (WHERE is_gen = 1)::BIGINT AS ny FROM v)", ["n_x", "n_y"], ["kid"], BASE))
def kid_whole_standard(spark, sf):
    return D.kid(*real_gen(spark, sf), mode="standard")


def sampled(src: str, keys: str, seed: int, reps: int, sid: str = "sample_id") -> str:
    """First rows of each (keys, rep) order: keys, rep, place, did, u."""
    return f"(SELECT {keys}, rep, {sid} AS did, sample_id, u, row_number() OVER (PARTITION BY {keys}, rep ORDER BY {draw(seed, 'rep', sid)}, {sid}) AS place FROM {src}, (SELECT unnest(range({reps})) AS rep))"


DELTA = (
    *BASE,
    "cl AS (SELECT a, b, nr, ng, least(nr // 2, ng) AS k FROM (SELECT a, b, count(*) AS nr FROM r GROUP BY 1, 2) JOIN (SELECT a, b, count(*) AS ng FROM g GROUP BY 1, 2) USING (a, b) WHERE nr >= 20 AND ng >= 5)",
    f"dsm AS (SELECT a, b, rep, 'x' AS side, did, u FROM {sampled('g', 'a, b', 42, 4)} JOIN cl USING (a, b) WHERE place <= k UNION ALL "
    f"SELECT a, b, rep, CASE WHEN place <= k THEN 'a' ELSE 'b' END, did, u FROM {sampled('r', 'a, b', 43, 4)} JOIN cl USING (a, b) WHERE place <= 2 * k)",
    f"dk AS (SELECT * FROM {kid_sql('dsm', 'a, b, rep', 'a', 'x', 'kid')} JOIN {kid_sql('dsm', 'a, b, rep', 'a', 'b', 'kid_base')} USING (a, b, rep))",
    "nl0 AS (SELECT a, b, (count(*) // 2) AS k FROM r GROUP BY 1, 2 HAVING count(*) >= 10)",
    f"nsm AS (SELECT a, b, rep, CASE WHEN place <= k THEN 'a' ELSE 'b' END AS side, did, u FROM {sampled('r', 'a, b', 42, 12)} JOIN nl0 USING (a, b) WHERE place <= 2 * k)",
    f"nul AS (SELECT a, b, count(*)::BIGINT AS n_rep, avg(kid) AS null_mean, stddev_samp(kid) AS null_std FROM {kid_sql('nsm', 'a, b, rep', 'a', 'b')} GROUP BY 1, 2)",
)


@query("kid_null", sql("SELECT * FROM nul", ["a", "b", "n_rep"], ["null_mean", "null_std"], DELTA))
def kid_null(spark, sf):
    return D.kid_null(real_gen(spark, sf)[0], AB, 12)


@query("delta_kid", sql("SELECT n.a, n.b, n.ng AS n_gen, n.nr AS n_real, delta_kid, base_kid, gen_kid, (gen_kid - null_mean) / null_std AS kid_z FROM (SELECT a, b, count(*) FILTER (WHERE is_gen = 1)::BIGINT AS ng, count(*) FILTER (WHERE is_gen = 0)::BIGINT AS nr FROM w GROUP BY 1, 2) n LEFT JOIN (SELECT a, b, avg(kid - kid_base) AS delta_kid, avg(kid_base) AS base_kid, avg(kid) AS gen_kid FROM dk GROUP BY 1, 2) USING (a, b) LEFT JOIN nul USING (a, b)", ["a", "b", "n_gen", "n_real"], ["delta_kid", "base_kid", "gen_kid", "kid_z"], DELTA))
def delta_kid(spark, sf):
    real, gen = real_gen(spark, sf)
    return D.delta_kid(real, gen, AB, 4, null=D.kid_null(real, AB, 12)).drop("null_mean", "null_std")


SIZES = [8, 12, 20]
SIZED = (
    *BASE, f"szz AS (SELECT unnest({SIZES})::INTEGER AS size)", "gz AS (SELECT g.*, size FROM g, szz)", "rz AS (SELECT r.*, size FROM r, szz)",
    "cz AS (SELECT a, b, size, size // 2 AS k FROM (SELECT a, b, size, count(*) AS nr FROM rz GROUP BY 1, 2, 3) JOIN (SELECT a, b, size, count(*) AS ng FROM gz GROUP BY 1, 2, 3) USING (a, b, size) WHERE nr >= size AND ng >= size // 2)",
    f"zs AS (SELECT a, b, size, rep, 'x' AS side, did, u FROM {sampled('gz', 'a, b, size', 42, 3)} JOIN cz USING (a, b, size) WHERE place <= k UNION ALL SELECT a, b, size, rep, CASE WHEN place <= k THEN 'a' ELSE 'b' END, did, u FROM {sampled('rz', 'a, b, size', 43, 3)} JOIN cz USING (a, b, size) WHERE place <= 2 * k)",
    f"zk AS (SELECT a, b, size, avg(kid - kid_base) AS delta_kid FROM {kid_sql('zs', 'a, b, size, rep', 'a', 'x', 'kid')} JOIN {kid_sql('zs', 'a, b, size, rep', 'a', 'b', 'kid_base')} USING (a, b, size, rep) GROUP BY 1, 2, 3)",
)


def _sizes(spark, sf):
    real, gen = real_gen(spark, sf)
    return D.delta_kid_by_size(real, gen, AB, SIZES, 3)


@query("delta_kid_by_size", sql("SELECT * FROM zk", ["a", "b", "size"], ["delta_kid"], SIZED))
def delta_kid_by_size(spark, sf):
    return _sizes(spark, sf)


RK = "rank() OVER (PARTITION BY {k} ORDER BY {c}) + (count(*) OVER (PARTITION BY {k}, {c}) - 1) / 2.0"


@query("size_correlations", sql(f"SELECT sa AS size_a, sb AS size_b, count(*)::BIGINT AS n, corr(rx, ry) AS spearman FROM (SELECT sa, sb, {RK.format(k='sa, sb', c='x')} AS rx, {RK.format(k='sa, sb', c='y')} AS ry FROM (SELECT p.size AS sa, q.size AS sb, p.delta_kid AS x, q.delta_kid AS y FROM zk p JOIN zk q USING (a, b))) GROUP BY 1, 2", ["size_a", "size_b", "n"], ["spearman"], SIZED))
def size_correlations(spark, sf):
    return D.size_correlations(_sizes(spark, sf), AB)


@query("rank_stability", sql(f"SELECT a, b, count(*)::BIGINT AS n_sizes, avg(rk) AS mean_rank, stddev_samp(rk) AS std_rank FROM (SELECT a, b, {RK.format(k='size', c='delta_kid')} AS rk FROM zk) GROUP BY 1, 2 HAVING count(*) = 3", ["a", "b", "n_sizes"], ["mean_rank", "std_rank"], SIZED))
def rank_stability(spark, sf):
    return D.rank_stability(_sizes(spark, sf), AB, 3)


BOOT = (
    *BASE,
    "ck AS (SELECT b, greatest(5, least(m, n // 2)) AS k FROM (SELECT b, count(*) AS m FROM g GROUP BY 1), (SELECT count(*) AS n FROM r))",
    "rb AS (SELECT r.* EXCLUDE (b), k.b FROM r, (SELECT DISTINCT b FROM g) k)",
    f"bs AS (SELECT b, rep, 'x' AS side, did, u FROM {sampled('g', 'b', 42, 5)} JOIN ck USING (b) WHERE place <= k UNION ALL SELECT b, rep, 'a', did, u FROM {sampled('rb', 'b', 43, 5)} JOIN ck USING (b) WHERE place <= k)",
    f"bk AS (SELECT * FROM {kid_sql('bs', 'b, rep', 'a', 'x')})",
)


@query("kid_bootstrap", sql("SELECT b, avg(kid) AS mean_kid, quantile_cont(kid, 0.025) AS ci_low, quantile_cont(kid, 0.975) AS ci_high FROM bk GROUP BY 1", ["b"], ["mean_kid", "ci_low", "ci_high"], BOOT))
def kid_bootstrap(spark, sf):
    real, gen = real_gen(spark, sf)
    return D.kid_bootstrap(gen, real, gen, ["b"], 5)


@query("rbf_mmd", sql("SELECT b AS bin, n_gen, n_real, a, gg / (n_gen * n_gen) + rr / (n_real * n_real) - 2 * gr / (n_gen * n_real) AS mmd2 FROM (SELECT a, b, count(*) FILTER (WHERE is_gen = 1)::BIGINT AS n_gen, "
    "sum(gg) FILTER (WHERE is_gen = 1) AS gg, sum(gr) FILTER (WHERE is_gen = 1) AS gr FROM (SELECT p.a, p.b, p.is_gen, p.sample_id, sum(exp(-pow(list_distance(p.x, q.x), 2) / (2 * s * s))) FILTER (WHERE q.is_gen = 1 AND q.b = p.b) AS gg, sum(exp(-pow(list_distance(p.x, q.x), 2) / (2 * s * s))) FILTER (WHERE q.is_gen = 0) AS gr FROM v p JOIN v q ON p.a = q.a JOIN sg ON sg.a = p.a GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) "
    "JOIN (SELECT p.a, count(DISTINCT p.sample_id)::BIGINT AS n_real, sum(exp(-pow(list_distance(p.x, q.x), 2) / (2 * s * s))) AS rr FROM v p JOIN v q ON p.a = q.a AND p.is_gen = 0 AND q.is_gen = 0 JOIN sg ON sg.a = p.a GROUP BY 1) USING (a)", ["a", "bin", "n_gen", "n_real"], ["mmd2"],
    [*BASE, "sg AS (SELECT p.a, median(list_distance(p.x, q.x)) AS s FROM r p JOIN r q ON p.a = q.a AND p.sample_id < q.sample_id GROUP BY 1)"]))
def rbf_mmd(spark, sf):
    """Condition a, bins from the second attribute."""
    real, gen = real_gen(spark, sf)
    return D.rbf_mmd(gen.withColumnRenamed("b", "bin"), real, ["a"])


@query("split_half_ratio")
def split_half_ratio(spark, sf):
    return D.split_half_ratio(*real_gen(spark, sf))


@query("frechet_distance")
def frechet_distance(spark, sf):
    from plumbline.session import small_table

    real, gen = real_gen(spark, sf)
    return small_table(spark, [{"frechet": D.frechet_distance(real, gen)}], [("frechet", "double")])


@query("metric_panel")
def metric_panel(spark, sf):
    real, gen = real_gen(spark, sf)
    return D.metric_panel(gen, real, AB, 4)


@query("panel_against_random")
def panel_against_random(spark, sf):
    """The panel of the accepted rows against that of as many random rows per condition."""
    real, gen = real_gen(spark, sf)
    scored = with_centre_score(real, gen)
    cut = SE.thresholds(with_centre_score(real, real), "trust", [50]).first()["threshold"]
    taken = scored.where(F.col("trust") <= cut)
    picks = SE.random_baseline(taken, scored, AB, 1).select("sample_id")
    return D.accepted_against_random(D.metric_panel(taken, real, AB, 4), D.metric_panel(scored.join(picks, "sample_id", "left_semi"), real, AB, 4))


@query("matched_with_fallback", sql(f"SELECT * FROM {matched_sql('fw', '(SELECT * FROM r WHERE label < 7)', 'a, b', 'rep', 42)}", ["a", "b", "rep", "slot", "sample_id"], [],
    [*BASE, "nc AS (SELECT * FROM (SELECT DISTINCT a AS ga, b AS gb FROM g), (SELECT DISTINCT a, b FROM r WHERE label < 7) QUALIFY row_number() OVER (PARTITION BY ga, gb ORDER BY (a <> ga)::INTEGER + (b <> gb)::INTEGER, a, b) = 1)",
     "fw AS (SELECT nc.a, nc.b, rep, count(*) AS n_want FROM g JOIN nc ON g.a = ga AND g.b = gb, (SELECT unnest([0, 1])::INTEGER AS rep) GROUP BY 1, 2, 3)"]))
def matched_with_fallback(spark, sf):
    """Held-out conditions draw from the nearest condition that has real rows."""
    real, gen = real_gen(spark, sf)
    return D.matched_with_fallback(gen, real.where("label < 7"), AB, 2)


@query("transitivity_check", sql(f"SELECT c.a, c.b, k, n_real, n_gen, kid_rr, kid_ra, kid_rb, kid_ab, kid_rb / kid_ra AS scale_ratio FROM c JOIN {kid_sql('ts', 'a, b', 'a', 'b', 'kid_rr')} USING (a, b) JOIN {kid_sql('ts', 'a, b', 'a', 'ga', 'kid_ra')} USING (a, b) JOIN {kid_sql('ts', 'a, b', 'a', 'gb', 'kid_rb')} USING (a, b) JOIN {kid_sql('ts', 'a, b', 'ga', 'gb', 'kid_ab')} USING (a, b)",
    ["a", "b", "k", "n_real", "n_gen"], ["kid_rr", "kid_ra", "kid_rb", "kid_ab", "scale_ratio"],
    [*BASE, "c AS (SELECT a, b, n_real, n_gen, least(n_gen, n_real // 2)::BIGINT AS k FROM (SELECT a, b, count(*)::BIGINT AS n_real FROM r GROUP BY 1, 2) JOIN (SELECT a, b, count(*)::BIGINT AS n_gen FROM g GROUP BY 1, 2) USING (a, b) WHERE n_real >= 20 AND n_gen >= 10)",
     f"rsm AS (SELECT a, b, CASE WHEN place <= k THEN 'a' ELSE 'b' END AS side, did, u FROM {sampled('r', 'a, b', 42, 1)} JOIN c USING (a, b) WHERE place <= 2 * k)",
     f"gsm AS (SELECT a, b, did, u FROM {sampled('g', 'a, b', 43, 1)} JOIN c USING (a, b) WHERE place <= k)",
     "ts AS (SELECT * FROM rsm UNION ALL SELECT a, b, 'ga', did, u FROM gsm UNION ALL SELECT a, b, 'gb', did, list_reverse(u) FROM gsm)"]))
def transitivity_check(spark, sf):
    real, gen = real_gen(spark, sf)
    return D.transitivity_check(real, gen, gen.withColumn("features", F.reverse("features")), AB)


@query("cross_space_predictability")
def cross_space_predictability(spark, sf):
    """First half of the vector against the second half."""
    v = vectors(spark, sf)
    a, b = (v.select("sample_id", F.slice("features", s, 32).alias("features")) for s in (1, 33))
    return D.cross_space_predictability(a, b, 10)


@query("space_alignment")
def space_alignment(spark, sf):
    v = vectors(spark, sf)
    return D.space_alignment(v, v.withColumn("features", F.transform("features", lambda e: e + 0.1)), "label")


# ---- energies along steps ------------------------------------------------------------------------


@query("energy_aurocs", sql("SELECT variant, n_pos, n_neg, (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auroc FROM (SELECT variant, sum(is_gen)::BIGINT AS n_pos, sum(1 - is_gen)::BIGINT AS n_neg, sum(rk) FILTER (WHERE is_gen = 1) AS rs FROM (SELECT *, rank() OVER (PARTITION BY variant ORDER BY s) AS rk FROM lo) GROUP BY 1)", ["variant", "n_pos", "n_neg"], ["auroc"],
    [*BASE, *fit_ctes(), "gd AS (SELECT w.*, list_transform(list_zip(u, c), lambda z: z[1] - z[2]) AS d FROM w, mug)", f"ge AS (SELECT sample_id, is_gen, {quad('d', 'p')} AS e FROM gd, prec WHERE grp = '')",
     "z AS (SELECT is_gen, (e - (SELECT avg(e) FROM ge WHERE is_gen = 0)) / ((SELECT stddev_samp(e) FROM ge WHERE is_gen = 0) + 1e-12) AS z FROM ge)",
     "lo AS (SELECT 'one_sided' AS variant, is_gen, z AS s FROM z UNION ALL SELECT 'two_sided_abs', is_gen, abs(z) FROM z UNION ALL SELECT 'two_sided_sq', is_gen, z * z FROM z)"], True))
def energy_aurocs(spark, sf):
    real, gen = real_gen(spark, sf)
    return TR.energy_aurocs(real, gen, TR.energy_fit(real)).drop("auprc")


@query("trajectory_report")
def trajectory_report(spark, sf):
    s = steps_of(spark, sf)
    real, _ = real_gen(spark, sf)
    return TR.trajectory_report(s, real, s.where("step = 4"), n_pairs=500)


# ---- selections measured by distance -------------------------------------------------------------


def _scored(spark, sf):
    real, gen = real_gen(spark, sf)
    slim = ["sample_id", "label", *AB, "trust"]
    return with_centre_score(real, real).select(*slim), with_centre_score(real, gen).select(*slim), real, gen


@query("decile_report", sql("SELECT bin, n_samples, score_min, score_max, n_conditions, mean_kid, ci_low, ci_high FROM (SELECT bin, count(*)::BIGINT AS n_samples, min(trust) AS score_min, max(trust) AS score_max, count(DISTINCT (a, b))::BIGINT AS n_conditions FROM bn GROUP BY 1) JOIN (SELECT bin, avg(kid) AS mean_kid, quantile_cont(kid, 0.025) AS ci_low, quantile_cont(kid, 0.975) AS ci_high FROM bkk GROUP BY 1) USING (bin)",
    ["bin", "n_samples", "n_conditions"], ["score_min", "score_max", "mean_kid", "ci_low", "ci_high"],
    [*SCORE, "bn AS (SELECT *, least((rk - 1) // greatest(1, c // 4), 3)::INTEGER AS bin FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY trust, sample_id) AS rk, count(*) OVER (PARTITION BY a, b) AS c FROM sg))",
     "wt AS (SELECT a, b, bin, count(*) AS n_want FROM bn GROUP BY 1, 2, 3)",
     f"pool AS (SELECT bin, m.sample_id || '#' || slot AS did, m.sample_id, u FROM {matched_sql('wt', 'sr', 'a, b', 'bin', 42)} m JOIN sr ON sr.sample_id = m.sample_id)",
     "ck AS (SELECT bin, greatest(5, least(nx, ny // 2)) AS k FROM (SELECT bin, count(*) AS nx FROM bn GROUP BY 1) JOIN (SELECT bin, count(*) AS ny FROM pool GROUP BY 1) USING (bin))",
     f"bsm AS (SELECT bin, rep, 'x' AS side, did::VARCHAR AS did, u FROM {sampled('bn', 'bin', 42, 4)} JOIN ck USING (bin) WHERE place <= k UNION ALL SELECT bin, rep, 'a', did, u FROM {sampled('pool', 'bin', 43, 4, 'did')} JOIN ck USING (bin) WHERE place <= k)",
     f"bkk AS (SELECT * FROM {kid_sql('bsm', 'bin, rep', 'a', 'x')})"]))
def decile_report(spark, sf):
    _, gs, real, gen = _scored(spark, sf)
    return SE.decile_report(gs, gen, real, AB, n_bins=4, reps=4)


@query("decile_report_with_z")
def decile_report_with_z(spark, sf):
    _, gs, real, gen = _scored(spark, sf)
    return SE.decile_report(gs, gen, real, AB, n_bins=4, reps=4, null=D.kid_null(real, AB, 12))


@query("per_condition_selection")
def per_condition_selection(spark, sf):
    rs, gs, real, gen = _scored(spark, sf)
    return SE.per_condition_selection(gs, rs, gen, real, AB, 75, real.where("label < 7").select(*AB), reps=4)


@query("percentile_mode_panel")
def percentile_mode_panel(spark, sf):
    rs, gs, real, gen = _scored(spark, sf)
    return SE.percentile_mode_panel(gs, rs, gen, real, AB, reps=3)


@query("kid_by_arm")
def kid_by_arm(spark, sf):
    """Select in one space, measure in another (the reversed vectors)."""
    rs, gs, real, gen = _scored(spark, sf)
    cut = SE.thresholds(rs, "trust", [50]).first()["threshold"]
    arm = F.when(F.col("label") < 7, "seen").otherwise("unseen")
    flip = lambda d: d.withColumn("features", F.reverse("features"))
    return SE.kid_by_arm(gs.withColumn("arm", arm), F.lit(cut), flip(gen), flip(real.where("label < 7")), AB, n_rand=3, n_boot=3)


# ---- composed evaluations ------------------------------------------------------------------------


@query("metric_correlations", sql(f"SELECT pair, count(*)::BIGINT AS n, corr(rx, ry) AS spearman FROM (SELECT pair, {RK.format(k='pair', c='x')} AS rx, {RK.format(k='pair', c='y')} AS ry FROM lg) GROUP BY 1", ["pair", "n"], ["spearman"],
    [*SCORE, f"au AS (SELECT n.query_id AS sample_id, (n.distance >= o.distance)::INTEGER AS authentic FROM {nn_sql('g', 'r', 1, 'u')} n JOIN {nn_sql('r', 'r', 1, 'u', self_=True)} o ON o.query_id = n.ref_id)",
     "js AS (SELECT sg.*, authentic FROM sg JOIN au USING (sample_id))",
     "lg AS (SELECT 'realism_z_vs_centre_dist' AS pair, realism_z AS x, trust AS y FROM js UNION ALL SELECT 'faithfulness_z_vs_centre_dist', faithfulness_z, trust FROM js UNION ALL SELECT 'trust_vs_centre_dist', trust, trust FROM js UNION ALL SELECT 'trust_vs_authentic', trust, authentic FROM js)"]))
def metric_correlations(spark, sf):
    real, gen = real_gen(spark, sf)
    return E.metric_correlations(with_centre_score(real, gen), real, gen)


def _table(spark, sf):
    real, gen = real_gen(spark, sf)
    scored = with_centre_score(real, gen)
    return E.ranking_table(scored, real, gen, AB, real.where("label < 7").select(*AB), 4, 12)


@query("condition_ranking", sql("SELECT st.*, delta_kid, base_kid, gen_kid, (gen_kid - null_mean) / null_std AS kid_z FROM st LEFT JOIN (SELECT a, b, avg(kid - kid_base) AS delta_kid, avg(kid_base) AS base_kid, avg(kid) AS gen_kid FROM dk GROUP BY 1, 2) USING (a, b) LEFT JOIN nul USING (a, b)",
    ["a", "b", "n_samples", "arm", "condition", "hamming_weight"], ["trust_mean", "trust_std", "delta_kid", "base_kid", "gen_kid", "kid_z"],
    [*SCORE, *DELTA[4:], "st AS (SELECT a, b, count(*)::BIGINT AS n_samples, avg(trust) AS trust_mean, stddev_pop(trust) AS trust_std, CASE WHEN label < 7 THEN 'seen' ELSE 'unseen' END AS arm, 'a=' || a || ', b=' || b AS condition, a + b AS hamming_weight FROM sg GROUP BY a, b, label)"]))
def condition_ranking(spark, sf):
    t = _table(spark, sf)
    return t.select(*AB, "n_samples", "arm", "condition", "hamming_weight", "trust_mean", "trust_std", "delta_kid", "base_kid", "gen_kid", "kid_z")


@query("ranking_validity")
def ranking_validity(spark, sf):
    return E.ranking_validity(_table(spark, sf), AB)["correlation"]


