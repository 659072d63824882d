"""Named queries over the test tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import vectors as V
from plumbline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PLACES = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; double columns are rounded so that sums in any order compare equal."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return rounded(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) + F.lit(0.0) for c in doubles}) if doubles else df


def sql(body: str, cols: Sequence[str] = (), doubles: Sequence[str] = (), ctes: Sequence[str] = (), recursive: bool = False) -> str:
    """SELECT cols and rounded doubles FROM body, with common table expressions in front."""
    picked = [*cols, *[f"round(CAST({d} AS DOUBLE), {PLACES}) + 0.0 AS {d}" for d in doubles]]
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(picked)} FROM ({body}) AS q"


# ---- test tables as the operators' inputs --------------------------------------------------------

SEEN_LABELS = 7  # labels 0..6 are seen, 7..9 held out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as vectors with two integer attributes; odd ids play the generated rows."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 2).cast("int").alias("is_gen"), "label",
        (F.col("label") % 2).alias("a"), F.expr("cast(label div 2 as int)").alias("b"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def real_gen(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf_dir)
    return v.where("is_gen = 0").drop("is_gen"), v.where("is_gen = 1").drop("is_gen")


def seen_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where(F.col("label") < SEEN_LABELS).select("a", "b").distinct()


def with_centre_score(real: DataFrame, rows: DataFrame) -> DataFrame:
    """A cheap score for selection queries: distance to the real mean of unit vectors, and two stand-in parts."""
    from plumbline.plans.evaluate import centre_distance

    out = centre_distance(real, rows).withColumnRenamed("centre_dist", "trust")
    return out.withColumns({"realism_z": F.col("features")[0], "faithfulness_z": F.col("features")[1]})


def unit(df: DataFrame) -> DataFrame:
    return df.withColumn("features", V.l2_normalize("features"))


# ---- SQL pieces ----------------------------------------------------------------------------------

V_SQL = (
    "v AS (SELECT vec_id AS sample_id, (vec_id % 2)::INTEGER AS is_gen, label, label % 2 AS a, label // 2 AS b, "
    "embedding::DOUBLE[] AS x FROM embeddings)"
)
W_SQL = "w AS (SELECT *, list_transform(x, lambda e: e / (sqrt(list_dot_product(x, x)) + 1e-12)) AS u FROM v)"
R_SQL, G_SQL = "r AS (SELECT * FROM w WHERE is_gen = 0)", "g AS (SELECT * FROM w WHERE is_gen = 1)"
BASE = (V_SQL, W_SQL, R_SQL, G_SQL)


def mean_sql(src: str, keys: str = "", vec: str = "x", name: str = "mu") -> str:
    """keys, mean vector and count per group."""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return (
        f"(SELECT {k}list(m ORDER BY pos) AS {name}, max(n) AS n FROM (SELECT {k}pos, avg(e) AS m, count(*) AS n FROM "
        f"(SELECT {k}unnest({vec}) AS e, generate_subscripts({vec}, 1) AS pos FROM {src}) GROUP BY {k}pos) {group})"
    )


SCORE = (
    *BASE,
    f"cm AS (SELECT mu AS c FROM {mean_sql('r', '', 'u')})",
    "s AS (SELECT w.*, list_distance(u, c) AS trust, x[1] AS realism_z, x[2] AS faithfulness_z FROM w, cm)",
    "sr AS (SELECT * FROM s WHERE is_gen = 0)",
    "sg AS (SELECT * FROM s WHERE is_gen = 1)",
)


def draw(seed: object, rep: str = "0", sid: str = "sample_id") -> str:
    return f"md5(concat_ws(':', {seed}, {rep}, {sid}))"


def rank_sql(keys: str, seed: object, rep: str = "0", sid: str = "sample_id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"row_number() OVER ({part}ORDER BY {draw(seed, rep, sid)}, {sid})"


def unit_draw_sql(seed: object, rep: str, sid: str) -> str:
    return f"(CAST('0x' || substr({draw(seed, rep, sid)}, 1, 13) AS BIGINT) / 4503599627370496.0)"


def poisson_sql(u: str) -> str:
    import math

    cumulative, term, parts = 0.0, math.exp(-1.0), []
    for k in range(1, 13):
        cumulative += term
        parts.append(f"({u} >= {cumulative!r}::DOUBLE)::BIGINT")
        term /= k
    return "(" + " + ".join(parts) + ")"


def kid_sql(src: str, keys: str, a: str, b: str, name: str = "kid") -> str:
    """Cubic-kernel distance between two sides of src(keys, side, did, u)."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"p.{k} = q.{k}" for k in ks)
    pk = ", ".join(f"p.{k} AS {k}" for k in ks)
    return (
        f"(SELECT {keys}, CASE WHEN max(m) >= 2 THEN (sum(k) FILTER (WHERE ps = '{a}' AND qs = '{a}' AND NOT same) + "
        f"sum(k) FILTER (WHERE ps = '{b}' AND qs = '{b}' AND NOT same)) / (max(m) * (max(m) - 1)) - "
        f"2.0 * sum(k) FILTER (WHERE ps = '{a}' AND qs = '{b}') / (max(m) * max(m)) END AS {name} FROM "
        f"(SELECT {pk}, p.side AS ps, q.side AS qs, p.did = q.did AND p.side = q.side AS same, "
        f"pow(list_dot_product(p.u, q.u) + 1, 3) AS k FROM {src} p JOIN {src} q ON {on}) "
        f"JOIN (SELECT {keys}, count(*)::DOUBLE AS m FROM {src} WHERE side = '{a}' GROUP BY {keys}) USING ({keys}) "
        f"GROUP BY {keys})"
    )


# Covariance, shrinkage and inverse in SQL: sums over joined positions, then Gauss-Jordan steps.
LW_PARTS = (
    # expects resid(grp, sample_id, pos, d): centred unit vectors per fitted group
    "covl AS (SELECT p.grp, p.pos AS i, q.pos AS j, sum(p.d * q.d) / count(*) AS s FROM resid p JOIN resid q "
    "ON p.grp = q.grp AND p.sample_id = q.sample_id GROUP BY 1, 2, 3)",
    "fourth AS (SELECT grp, avg(q * q) AS f, count(*) AS n FROM (SELECT grp, sample_id, sum(d * d) AS q FROM resid GROUP BY 1, 2) GROUP BY 1)",
    "tr AS (SELECT grp, sum(s) FILTER (WHERE i = j) AS t, sum(s * s) AS sq, max(i)::DOUBLE AS p FROM covl GROUP BY 1)",
    "lw0 AS (SELECT grp, n, t, p, (f - sq) / (p * n) AS beta, (sq - 2 * (t / p) * t + p * (t / p) * (t / p)) / p AS delta FROM tr JOIN fourth USING (grp))",
    "lw AS (SELECT grp, n, t, p, CASE WHEN least(beta, delta) <= 0 THEN 0 ELSE least(beta, delta) / delta END AS alpha FROM lw0)",
    "cov AS (SELECT grp, list(row ORDER BY i) AS m FROM (SELECT grp, i, list((1 - alpha) * s + CASE WHEN i = j THEN alpha * t / p + 1e-5 ELSE 0 END ORDER BY j) AS row "
    "FROM covl JOIN lw USING (grp) GROUP BY grp, i) GROUP BY grp)",
    "aug AS (SELECT grp, list_transform(m, lambda r, i: list_concat(r, list_transform(range(1, len(m) + 1), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS m FROM cov)",
    "gj(grp, k, m) AS (SELECT grp, 1, m FROM aug UNION ALL SELECT grp, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k "
    "THEN list_transform(r, lambda e: e / m[k][k]) ELSE list_transform(r, lambda e, j: e - r[k] / m[k][k] * m[k][j]) END) FROM gj WHERE k <= len(m))",
    "prec AS (SELECT grp, list_transform(m, lambda r: r[len(m) + 1 : 2 * len(m)]) AS p FROM gj WHERE k = len(m) + 1)",
)


def fit_ctes(src: str = "r") -> tuple[str, ...]:
    """Fit on `src`: groups '', 'a', 'b'; gives prec(grp, p), mug(c), mua(grp, val, mu)."""
    return (
        f"mug AS (SELECT mu AS c FROM {mean_sql(src, '', 'u')})",
        f"longv AS (SELECT sample_id, 'a' AS grp, a AS val, u FROM {src} UNION ALL SELECT sample_id, 'b', b, u FROM {src})",
        f"mua AS (SELECT grp, val, mu, n FROM {mean_sql('longv', 'grp, val', 'u')})",
        f"residv AS (SELECT '' AS grp, sample_id, list_transform(list_zip(u, c), lambda z: z[1] - z[2]) AS d FROM {src}, mug UNION ALL "
        "SELECT grp, sample_id, list_transform(list_zip(u, mu), lambda z: z[1] - z[2]) FROM longv JOIN mua USING (grp, val))",
        "resid AS (SELECT grp, sample_id, unnest(d) AS d, generate_subscripts(d, 1) AS pos FROM residv)",
        *LW_PARTS,
    )


def quad(d: str, p: str) -> str:
    return f"greatest(list_dot_product({d}, list_transform({p}, lambda row: list_dot_product(row, {d}))), 0)"


def trust_ctes(fit_on: str = "r") -> tuple[str, ...]:
    """scored(sample_id, label, a, b, is_gen, u, realism_z, faithfulness_z, trust) for all rows."""
    return (
        *BASE,
        *fit_ctes(fit_on),
        "gd AS (SELECT w.*, list_transform(list_zip(u, c), lambda z: z[1] - z[2]) AS d FROM w, mug)",
        f"ge AS (SELECT sample_id, {quad('d', 'p')} AS e FROM gd, prec WHERE grp = '')",
        "al AS (SELECT sample_id, 'a' AS grp, a AS own, u FROM w UNION ALL SELECT sample_id, 'b', b, u FROM w)",
        "ad AS (SELECT al.sample_id, al.grp, own, val, list_transform(list_zip(u, mu), lambda z: z[1] - z[2]) AS d FROM al JOIN mua USING (grp))",
        f"ae AS (SELECT sample_id, ad.grp, own, val, {quad('d', 'p')} AS e FROM ad JOIN prec ON ad.grp = prec.grp)",
        "am AS (SELECT sample_id, grp, min(e) FILTER (WHERE val = own) - min(e) FILTER (WHERE val <> own) AS m FROM ae GROUP BY 1, 2)",
        f"fitrows AS (SELECT sample_id FROM {fit_on})",
        "gc AS (SELECT avg(e) AS me, stddev_samp(e) AS se FROM ge JOIN fitrows USING (sample_id))",
        "ac AS (SELECT grp, avg(m) AS mm, stddev_samp(m) AS sm FROM am JOIN fitrows USING (sample_id) GROUP BY grp)",
        "rz AS (SELECT sample_id, (e - me) / (se + 1e-12) AS realism_z FROM ge, gc)",
        "fz AS (SELECT sample_id, avg((coalesce(m, 0) - mm) / (sm + 1e-12)) AS faithfulness_z FROM am JOIN ac USING (grp) GROUP BY 1)",
        "scored AS (SELECT w.*, realism_z, faithfulness_z, realism_z + faithfulness_z AS trust FROM w JOIN rz USING (sample_id) JOIN fz USING (sample_id))",
    )
