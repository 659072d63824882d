"""The evaluation report over three vector spaces, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans import report
from plumbline.plans.registry import SEEN_LABELS, V_SQL, mean_sql, query, real_gen, seen_conditions, sql, unit_draw_sql, with_centre_score

BINS = 5
RANKINGS = ("trust", "realism_z", "faithfulness_z")


def _parts(of: str, names: tuple[str, ...]) -> str:
    """Metric columns of a table as report rows."""
    return " UNION ALL ".join(f"SELECT section, config, arm, ranking, bin, '{m}' AS metric, n::BIGINT AS n, {m}::DOUBLE AS value FROM {of}" for m in names)


REPORT = (
    V_SQL,
    "sp AS (SELECT 'whole' AS config, sample_id, is_gen, label, x AS y FROM v UNION ALL SELECT 'first', sample_id, is_gen, label, x[1:32] FROM v UNION ALL SELECT 'second', sample_id, is_gen, label, x[33:64] FROM v)",
    "su AS (SELECT *, list_transform(y, lambda e: e / (sqrt(list_dot_product(y, y)) + 1e-12)) AS u FROM sp)",
    "sr AS (SELECT * FROM su WHERE is_gen = 0)",
    f"cm AS (SELECT config, c FROM {mean_sql('sr', 'config', 'u', 'c')})",
    f"sc AS (SELECT su.*, list_distance(u, c) AS trust, y[1] AS realism_z, y[2] AS faithfulness_z, CASE WHEN label < {SEEN_LABELS} THEN 'seen' ELSE 'unseen' END AS arm FROM su JOIN cm USING (config))",
    "lg AS (" + " UNION ALL ".join(f"SELECT config, is_gen, arm, label, sample_id, trust, '{s}' AS ranking, {s} AS val FROM sc" for s in RANKINGS) + ")",
    "th AS (SELECT config, quantile_cont(trust, 0.95) AS t FROM sc WHERE is_gen = 0 GROUP BY 1)",
    f"lr AS (SELECT * FROM lg WHERE is_gen = 1 UNION ALL SELECT config, is_gen, arm, label, sample_id, trust, 'random', {unit_draw_sql(42, '0', 'sample_id')} FROM sc WHERE is_gen = 1)",
    f"bn AS (SELECT *, least((rk - 1) // greatest(1, c // {BINS}), {BINS - 1})::INTEGER AS bin FROM (SELECT *, row_number() OVER (PARTITION BY config, ranking, label ORDER BY val, sample_id) AS rk, count(*) OVER (PARTITION BY config, ranking, label) AS c FROM lr))",
    "bt AS (SELECT 'bins' AS section, config, arm, ranking, bin, count(*) AS n, avg(trust) AS trust_mean, min(val) AS score_min, max(val) AS score_max, avg((trust <= t)::INTEGER) AS accepted FROM bn JOIN th USING (config) "
    "GROUP BY GROUPING SETS ((config, ranking), (config, arm, ranking), (config, ranking, bin), (config, arm, ranking, bin)))",
    "dt AS (SELECT 'unseen_rows' AS section, config, 'all' AS arm, ranking, (arm = 'unseen')::INTEGER AS y, val FROM lg WHERE is_gen = 1 UNION ALL "
    "SELECT 'unseen_conditions', config, 'all', ranking, (arm = 'unseen')::INTEGER, avg(val) FROM lg WHERE is_gen = 1 GROUP BY config, ranking, arm, label UNION ALL "
    "SELECT 'real_gen', config, arm, ranking, 1, val FROM lg WHERE is_gen = 1 UNION ALL SELECT 'real_gen', config, o, ranking, 0, val FROM lg, (SELECT unnest(['seen', 'unseen']) AS o) WHERE is_gen = 0)",
    "ds AS (SELECT section, config, arm, ranking, val, sum(y) AS p, sum(1 - y) AS q FROM dt GROUP BY 1, 2, 3, 4, 5)",
    "dc AS (SELECT *, sum(p) OVER (PARTITION BY section, config, arm, ranking ORDER BY val DESC) AS tp, sum(q) OVER (PARTITION BY section, config, arm, ranking ORDER BY val DESC) AS fp, "
    "sum(p) OVER (PARTITION BY section, config, arm, ranking) AS pa, sum(q) OVER (PARTITION BY section, config, arm, ranking) AS qa FROM ds)",
    "dd AS (SELECT section, config, arm, ranking, NULL::INTEGER AS bin, max(pa + qa) AS n, max(pa) AS n_pos, sum(q * (tp - p + p / 2.0)) / max(pa) / max(qa) AS auroc, "
    "sum(p / pa * (CASE WHEN tp - p + fp - q > 0 THEN (tp - p) / (tp - p + fp - q) ELSE 1.0 END + tp / (tp + fp)) / 2.0) AS auprc FROM dc GROUP BY 1, 2, 3, 4)",
    "kp AS (SELECT p.config, p.label, p.is_gen AS ps, q.is_gen AS qs, p.sample_id = q.sample_id AS same, pow(list_dot_product(p.u, q.u) + 1, 3) AS k FROM su p JOIN su q ON p.config = q.config AND p.label = q.label)",
    "kn AS (SELECT config, label, count(*) FILTER (WHERE is_gen = 0)::DOUBLE AS nx, count(*) FILTER (WHERE is_gen = 1)::DOUBLE AS ny FROM su GROUP BY 1, 2)",
    "kd AS (SELECT config, label, sxx / (nx * (nx - 1)) + syy / (ny * (ny - 1)) - 2 * sxy / (nx * ny) AS d FROM (SELECT config, label, sum(k) FILTER (WHERE ps = 0 AND qs = 0 AND NOT same) AS sxx, "
    "sum(k) FILTER (WHERE ps = 1 AND qs = 1 AND NOT same) AS syy, sum(k) FILTER (WHERE ps = 0 AND qs = 1) AS sxy FROM kp GROUP BY 1, 2) JOIN kn USING (config, label) WHERE nx >= 2 AND ny >= 2)",
    "ct AS (SELECT *, rank() OVER (PARTITION BY config, ranking ORDER BY m) AS ra, rank() OVER (PARTITION BY config, ranking ORDER BY d) AS rb FROM (SELECT config, ranking, label, avg(val) AS m FROM lg WHERE is_gen = 1 GROUP BY 1, 2, 3) JOIN kd USING (config, label))",
    "co AS (SELECT config, ranking, count(*) AS n, corr(ra, rb) AS spearman, corr(m, d) AS pearson FROM ct GROUP BY 1, 2)",
    "ke AS (SELECT p.config, p.ranking, sum(sign(p.m - q.m) * sign(p.d - q.d)) / count(*) AS kendall FROM ct p JOIN ct q ON p.config = q.config AND p.ranking = q.ranking AND p.label < q.label GROUP BY 1, 2)",
    "cv AS (SELECT 'validity' AS section, config, NULL::VARCHAR AS arm, ranking, NULL::INTEGER AS bin, n, spearman, kendall, pearson FROM co JOIN ke USING (config, ranking))",
    "ov AS (SELECT 'validity' AS section, config, NULL::VARCHAR AS arm, ranking, NULL::INTEGER AS bin, 'overlap_' || k AS metric, count(*) AS n, count(*) FILTER (WHERE greatest(ra, rb) <= k) / count(*) FILTER (WHERE least(ra, rb) <= k) AS value "
    "FROM ct, (SELECT unnest([5, 10, 20]) AS k) GROUP BY config, ranking, k HAVING count(*) >= k)",
    "gp AS (SELECT 'gaps' AS section, config, NULL::VARCHAR AS arm, NULL::VARCHAR AS ranking, NULL::INTEGER AS bin, count(g) AS n, avg(g) AS mean_gap, max(g) AS max_gap FROM (SELECT config, d - lag(d) OVER (PARTITION BY config ORDER BY d, label) AS g FROM kd) GROUP BY config)",
)


@query("evaluation_report", sql(
    _parts("bt", ("trust_mean", "score_min", "score_max", "accepted")) + " UNION ALL " + _parts("dd", ("n_pos", "auroc", "auprc")) + " UNION ALL "
    + _parts("cv", ("spearman", "kendall", "pearson")) + " UNION ALL SELECT section, config, arm, ranking, bin, metric, n::BIGINT, value::DOUBLE FROM ov UNION ALL " + _parts("gp", ("mean_gap", "max_gap")),
    ["section", "config", "arm", "ranking", "bin", "metric", "n"], ["value"], REPORT))
def evaluation_report(spark, sf):
    """Three spaces as configurations: the whole vector, its first and its second half."""
    real, gen = real_gen(spark, sf)
    seen = seen_conditions(spark, sf)
    configs = []
    for name, start, size in (("whole", 1, 64), ("first", 1, 32), ("second", 33, 32)):
        r, g = (side.withColumn("features", F.slice("features", start, size)) for side in (real, gen))
        configs.append(report.Configuration(name, with_centre_score(r, r), with_centre_score(r, g), ["a", "b"], seen))
    return report.evaluation_report(configs, BINS)
