"""Global selections and global score bins, measured by kernel distance."""

from __future__ import annotations

from plumbline.operators import selection as SE
from plumbline.plans.catalog_conditions import matched_sql
from plumbline.plans.catalog_distances import sampled
from plumbline.plans.registry import SCORE, draw, kid_sql, query, real_gen, sql, with_centre_score

AB = ["a", "b"]


def scored_tables(spark, sf):
    real, gen = real_gen(spark, sf)
    slim = ["sample_id", "label", *AB, "trust"]
    return with_centre_score(real, real).select(*slim), with_centre_score(real, gen).select(*slim), real, gen


def kid_ctes(name: str, x: str, y: str, keys: str, cells: str, seed: int, reps: int, y_id: str = "did") -> tuple[str, ...]:
    """sampled_kid in SQL: x and y sources, cells(keys, k); y rows carry their own draw id."""
    return (
        f"{name}s AS (SELECT {keys}, rep, 'x' AS side, did::VARCHAR AS did, u FROM {sampled(x, keys, seed, reps)} JOIN {cells} USING ({keys}) WHERE place <= k "
        f"UNION ALL SELECT {keys}, rep, 'a', did::VARCHAR, u FROM {sampled(y, keys, seed + 1, reps, y_id)} JOIN {cells} USING ({keys}) WHERE place <= k)",
        f"{name} AS (SELECT * FROM {kid_sql(f'{name}s', f'{keys}, rep', 'a', 'x')})",
    )


@query(
    "decile_report_global",
    sql(
        "SELECT bin, n_samples, score_min, score_max, n_conditions, mean_kid, ci_low, ci_high FROM (SELECT bin, count(*)::BIGINT AS n_samples, min(trust) AS score_min, "
        "max(trust) AS score_max, count(DISTINCT (a, b))::BIGINT AS n_conditions FROM bn GROUP BY 1) JOIN (SELECT bin, avg(kid) AS mean_kid, "
        "quantile_cont(kid, 0.025) AS ci_low, quantile_cont(kid, 0.975) AS ci_high FROM bkk GROUP BY 1) USING (bin)",
        ["bin", "n_samples", "n_conditions"], ["score_min", "score_max", "mean_kid", "ci_low", "ci_high"],
        [
            *SCORE,
            "bn AS (SELECT *, least((rk - 1) // (c // 4), 3)::INTEGER AS bin FROM (SELECT *, row_number() OVER (ORDER BY trust, sample_id) AS rk, count(*) OVER () AS c FROM sg))",
            "rbin AS (SELECT r.*, bin FROM r, (SELECT DISTINCT bin FROM bn))",
            "ck AS (SELECT bin, greatest(5, least(nx, ny // 2)) AS k FROM (SELECT bin, count(*) AS nx FROM bn GROUP BY 1), (SELECT count(*) AS ny FROM r))",
            *kid_ctes("bkk", "bn", "rbin", "bin", "ck", 42, 4, "sample_id"),
        ],
    ),
)
def decile_report_global(spark, sf):
    _, gs, real, gen = scored_tables(spark, sf)
    return SE.decile_report(gs, gen, real, AB, n_bins=4, within=False, reps=4)


def cell_sql(x: str, y: str, keys: str) -> str:
    n = "least(nx, ny)"
    return (
        f"(SELECT {keys}, {n} AS k FROM (SELECT {keys}, count(*) AS nx FROM {x} GROUP BY {keys}) "
        f"JOIN (SELECT {keys}, count(*) AS ny FROM {y} GROUP BY {keys}) USING ({keys}) WHERE {n} >= 10)"
    )


def pool_sql(want: str, keys: str, seed: int) -> str:
    """Matched real draws with their own ids and vectors."""
    cols = ", ".join(f"m.{k}" for k in keys.split(", "))
    return f"(SELECT {cols}, m.sample_id || '#' || slot AS did, m.sample_id, u FROM {matched_sql(want, 'sr', 'a, b', keys, seed)} m JOIN sr ON sr.sample_id = m.sample_id)"


def selection_sql(free: bool) -> str:
    rep = "concat_ws(',', pct, draw)"
    ctes = [
        *SCORE,
        "th AS (SELECT unnest([50, 75, 90, 95]) AS pct, unnest(quantile_cont(trust, [0.5, 0.75, 0.9, 0.95])) AS threshold FROM sr)",
        "tk AS (SELECT sg.*, pct, threshold FROM sg, th WHERE trust <= threshold)",
        "en AS (SELECT pct, count(*)::BIGINT AS n_accepted, any_value(threshold) AS threshold FROM tk GROUP BY 1 HAVING count(*) >= 20)",
        "wa AS (SELECT a, b, pct, count(*) AS n_want FROM tk GROUP BY 1, 2, 3)",
        f"pl AS (SELECT * FROM {pool_sql('wa', 'pct', 1042)})",
        f"ca AS (SELECT * FROM {cell_sql('tk', 'pl', 'pct')})",
        *kid_ctes("ka", "(SELECT pct, sample_id, u FROM tk)", "pl", "pct", "ca", 1142, 4),
        "dr AS (SELECT unnest(range(4))::INTEGER AS draw)",
    ]
    if free:
        ctes += [
            f"rn AS (SELECT * FROM (SELECT sg.sample_id, a, b, u, pct, draw, n_accepted, row_number() OVER (PARTITION BY pct, draw ORDER BY {draw(2042, rep)}, sample_id) AS rk FROM sg, en, dr) AS t WHERE t.rk <= n_accepted)",
            "wr AS (SELECT a, b, pct, draw, count(*) AS n_want FROM rn GROUP BY 1, 2, 3, 4)",
            f"rp AS (SELECT * FROM {pool_sql('wr', 'pct, draw', 3042)})",
        ]
    else:
        ctes += [
            "wr AS (SELECT a, b, pct, draw, n_want FROM wa, dr)",
            f"rn AS (SELECT m.pct, m.draw, m.sample_id, u FROM {matched_sql('wr', 'sg', 'a, b', 'pct, draw', 2042, True)} m JOIN sg ON sg.sample_id = m.sample_id)",
            "rp AS (SELECT pl.*, draw FROM pl, dr)",
        ]
    ctes += [
        f"cr AS (SELECT * FROM {cell_sql('rn', 'rp', 'pct, draw')})",
        *kid_ctes("kr", "(SELECT pct, draw, sample_id, u FROM rn)", "rp", "pct, draw", "cr", 4042, 1),
    ]
    half = "1.96 * sqrt(kid_acc_std * kid_acc_std + kid_rand_std * kid_rand_std)"
    body = (
        f"SELECT *, kid_rand - kid_acc AS delta, kid_rand - kid_acc - {half} AS ci_lower, kid_rand - kid_acc + {half} AS ci_upper, (SELECT count(*) FROM sg)::BIGINT AS n_total "
        "FROM en JOIN (SELECT pct, avg(kid) AS kid_acc, stddev_pop(kid) AS kid_acc_std FROM ka GROUP BY 1) USING (pct) "
        "JOIN (SELECT pct, avg(kid) AS kid_rand, stddev_pop(kid) AS kid_rand_std FROM kr GROUP BY 1) USING (pct)"
    )
    return sql(body, ["pct", "n_accepted", "n_total"], ["threshold", "kid_acc", "kid_acc_std", "kid_rand", "kid_rand_std", "delta", "ci_lower", "ci_upper"], ctes)


@query("global_selection", selection_sql(True))
def global_selection(spark, sf):
    rs, gs, real, gen = scored_tables(spark, sf)
    return SE.global_selection(gs, rs, gen, real, AB, n_boot=4, n_rand=4).drop("improvement_pct")


@query("global_selection_same_histogram", selection_sql(False))
def global_selection_same_histogram(spark, sf):
    rs, gs, real, gen = scored_tables(spark, sf)
    return SE.global_selection(gs, rs, gen, real, AB, baseline="same_histogram", n_boot=4, n_rand=4).drop("improvement_pct")
