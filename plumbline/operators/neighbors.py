"""Nearest neighbours: exact joins (see pivot_join), the scores built on them, an index with probes, graphs and votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import cell_index
from plumbline.operators.moments import centroids, whiten
from plumbline.operators.pivot_join import least_within, nearest
from plumbline.operators.prefix import percentiles
from plumbline.operators.sampling import draw_rank
from plumbline.operators.scoring import as_scalar_score, scorer
from plumbline.session import small_table


def knn_join(
    query: DataFrame, ref: DataFrame, k: int, query_id: str = "sample_id", ref_id: str = "sample_id",
    features: str = "features", metric: str = "euclidean", exclude_self: bool = False,
) -> DataFrame:
    """k nearest reference rows of every query row: query_id, ref_id, distance, rank (1..k).

    metric 'cosine' works on unit vectors, where the Euclidean order is the
    cosine order, and returns 1 - dot. Ties go to the smaller reference id.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    unit = metric == "cosine"
    shape = (lambda c: V.l2_normalize(c)) if unit else F.col
    side = lambda df, i: df.select(F.col(i).alias("id"), shape(features).alias("v"))
    return nearest(side(query, query_id), side(ref, ref_id), k, unit, exclude_self)


def smallest_in_range(query: DataFrame, ref: DataFrame, radius: str, value: str) -> DataFrame:
    """Per query row the smallest `value` of reference rows within its own `radius` (queries without any are absent)."""
    side = lambda df, *more: df.select(F.col("sample_id").alias("id"), F.col("features").alias("v"), *more)
    return least_within(side(query, F.col(radius).alias("bound")), side(ref, F.col(value).cast("double").alias("aux")), value)


def kth_distance(neighbors: DataFrame, k: int, name: str) -> DataFrame:
    """Distance to the k-th neighbour per query; null when there are fewer."""
    return neighbors.where(F.col("rank") == k).select(F.col("query_id").alias("sample_id"), F.col("distance").alias(name))


def knn_radius(
    query: DataFrame, ref: DataFrame, k: int, leave_one_out: bool = False,
    max_ref: int | None = None, max_query: int | None = None, seed: int = 42, keys: Sequence[str] = (),
) -> DataFrame:
    """Cosine distance of every query row to its k-th neighbour among all reference rows.

    `max_query` and `max_ref` draw that many queries (per group of `keys`, such as a step) and references first;
    without them nothing is drawn. `leave_one_out` leaves the row of the same id out. All groups share one join.
    """
    keys = list(keys)

    def take(df: DataFrame, n: int | None, s: int, by: list[str]) -> DataFrame:
        df = df.select(*by, "sample_id", "features")
        return df if n is None else draw_rank(df, "sample_id", s, by).where(F.col("draw_rank") <= n).drop("draw_rank")

    q, r = take(query, max_query, seed, keys), take(ref, max_ref, seed + 1, [])
    if not keys:
        return kth_distance(knn_join(q, r, k, metric="cosine", exclude_self=leave_one_out), k, "radius")
    if leave_one_out:
        raise ValueError("rows are left out by their id, which groups may share")
    q = q.withColumn("_q", F.concat_ws("#", *[F.col(c).cast("string") for c in keys], F.col("sample_id").cast("string")))
    near = knn_join(q, r, k, query_id="_q", metric="cosine").where(F.col("rank") == k)
    return q.select(*keys, "sample_id", "_q").join(near.select(F.col("query_id").alias("_q"), F.col("distance").alias("radius")), "_q").drop("_q")


def class_knn(query: DataFrame, ref: DataFrame, attr: str, k: int = 5) -> DataFrame:
    """Cosine distance to the k_eff-th neighbour among reference rows with the query's attribute value.

    k_eff = min(k, max(n-1, 1)). A value absent from the reference falls back
    to the whole pool.
    """
    return attribute_neighbors(query, ref, [attr], k).select("sample_id", "distance")


def attribute_neighbors(query: DataFrame, ref: DataFrame, attrs: Sequence[str], k: int) -> DataFrame:
    """class_knn of several attributes in one join: sample_id, attr, distance."""
    kind = query.schema["sample_id"].dataType

    def long(df: DataFrame) -> DataFrame:
        cells = F.array(*[F.concat_ws("=", F.lit(a), F.col(a).cast("string")) for a in attrs])
        return df.select("sample_id", V.l2_normalize("features").alias("v"), F.explode(cells).alias("_v"))

    q, r = long(query), long(ref)
    sizes = ref.groupBy(*attrs).agg(F.count("*").alias("_c")).select(
        "_c", F.explode(F.array(*[F.concat_ws("=", F.lit(a), F.col(a).cast("string")) for a in attrs])).alias("_v")
    ).groupBy("_v").agg(F.sum("_c").alias("_n"))
    q = q.withColumn("id", F.concat_ws("#", F.substring_index("_v", "=", 1), F.col("sample_id").cast("string")))
    near = nearest(q.select(F.col("_v").alias("grp"), "id", "v"), r.select(F.col("_v").alias("grp"), F.col("sample_id").alias("id"), "v"), k, True, False)
    k_eff = F.least(F.lit(k).cast("long"), F.greatest(F.col("_n") - 1, F.lit(1).cast("long")))
    slim = q.select("id", "_v").join(sizes.select("_v", k_eff.alias("_k")), "_v", "left")
    inside = near.join(slim.where(F.col("_k").isNotNull()), near["query_id"] == slim["id"])
    found = inside.where(F.col("rank") == F.col("_k")).select("query_id", "distance")
    unknown = q.join(sizes.select("_v"), "_v", "left_anti")
    if not unknown.isEmpty():
        rest = knn_join(unknown.select("id", F.col("v").alias("features")), ref, k, query_id="id", metric="cosine")
        found = found.unionByName(rest.where(F.col("rank") == k).select("query_id", "distance"))
    return found.select(
        F.expr("substring(query_id, instr(query_id, '#') + 1)").cast(kind).alias("sample_id"),
        F.substring_index("query_id", "#", 1).alias("attr"), "distance",
    )


def knn_per_attribute(real: DataFrame, gen: DataFrame, attrs: Sequence[str], k: int = 5) -> DataFrame:
    """Sum over attributes of the class-restricted k-th neighbour distance."""
    return attribute_neighbors(gen, real, attrs, k).groupBy("sample_id").agg(F.sum("distance").alias("knn_score"))


@scorer("knn_per_attr")
def knn_scorer(real: DataFrame, gen: DataFrame, attrs: Sequence[str], k: int = 5, **_) -> DataFrame:
    return as_scalar_score(gen.join(knn_per_attribute(real, gen, attrs, k), "sample_id"), "knn_score")


def beta_recall(
    real: DataFrame, gen: DataFrame, betas: Sequence[float], k: int = 5
) -> DataFrame:
    """Share of real rows with a typical generated row within their k-th real neighbour distance.

    A generated row is typical at beta when its centre distance is within the
    beta quantile. Each generated row carries the smallest beta band that
    contains it; a range join finds the smallest band in reach of every real
    row, and a running count over the bands gives all betas at once.
    """
    real = real.select("sample_id", V.l2_normalize("features").alias("features"))
    gen = gen.select("sample_id", V.l2_normalize("features").alias("features"))
    tau = kth_distance(knn_join(real, real, k, exclude_self=True), k, "tau")
    centre = centroids(gen, []).select("mu")
    dist = gen.join(F.broadcast(centre)).withColumn("centre_dist", V.l2_distance("features", "mu")).drop("mu")
    radii = percentiles(dist, "centre_dist", betas, (), "radii").select("radii")
    band = F.size(F.filter("radii", lambda r: r < F.col("centre_dist")))
    banded = dist.join(F.broadcast(radii)).withColumn("band", band).where(F.col("band") < len(betas))
    first = smallest_in_range(real.join(tau, "sample_id"), banded, "tau", "band")
    reached = first.groupBy(F.col("band").cast("int").alias("band")).agg(F.count("*").alias("hits"))
    running = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = small_table(
        real.sparkSession, [{"band": i, "beta": float(b)} for i, b in enumerate(betas)],
        [("band", "int"), ("beta", "double")],
    )
    out = grid.join(reached, "band", "left").withColumn("hits", F.sum(F.coalesce("hits", F.lit(0))).over(running))
    total = real.agg(F.count("*").alias("n"))
    return out.join(F.broadcast(total)).select("beta", (F.col("hits") / F.col("n")).alias("recall"))


def authenticity(real: DataFrame, gen: DataFrame) -> DataFrame:
    """1 where a generated row is at least as far from its nearest real row as that row is from its own nearest."""
    real = real.select("sample_id", V.l2_normalize("features").alias("features"))
    gen = gen.select("sample_id", V.l2_normalize("features").alias("features"))
    near = knn_join(gen, real, 1).select(
        F.col("query_id").alias("sample_id"), F.col("ref_id").alias("nearest_real"), F.col("distance").alias("gen_dist")
    )
    own = knn_join(real, real, 1, exclude_self=True).select(
        F.col("query_id").alias("nearest_real"), F.col("distance").alias("real_dist")
    )
    flag = F.when(F.col("gen_dist") >= F.col("real_dist"), 1.0).otherwise(0.0)
    return near.join(own, "nearest_real").withColumn("authentic", flag)


def neighbor_graph(df: DataFrame, k: int, features: str = "features", gamma: float = 1.0, kappa: float = 1e4) -> DataFrame:
    """k nearest other rows by squared distance after whitening."""
    white = whiten(df, df, gamma, kappa, features).select("sample_id", F.col("whitened").alias("features"))
    near = knn_join(white, white, k, exclude_self=True)
    return near.withColumn("distance", F.col("distance") * F.col("distance"))


def approx_knn(query: DataFrame, ref: DataFrame, k: int, share: float = 0.95, every: int = 20) -> DataFrame:
    """About the k nearest reference rows from an inverted-cell index: query_id, ref_id, distance, rank.

    Probes are set so that, for the queries whose id's hash is divisible by `every`, at least `share` of their exact
    neighbours lie in the cells looked into.
    """
    index = cell_index.build_index(ref)
    asked = query.where(F.pmod(F.xxhash64(F.col("sample_id").cast("string")), F.lit(every)) == 0)
    probes = cell_index.probes_for(index, asked, knn_join(asked, ref, k), share)
    return cell_index.search(index, query, k, probes)


def neighbor_vote(neighbors: DataFrame, labels: DataFrame, label: str, k: int) -> DataFrame:
    """Majority label of the k nearest references; the smallest label on ties."""
    return neighbor_votes(neighbors, labels, label, [k]).drop("k")


def neighbor_votes(neighbors: DataFrame, labels: DataFrame, label: str, ks: Sequence[int]) -> DataFrame:
    """neighbor_vote for several k from one pass over the neighbours: sample_id, k, predicted."""
    votes = neighbors.where(F.col("rank") <= max(ks)).join(labels.select(F.col("sample_id").alias("ref_id"), label), "ref_id")
    counts = votes.groupBy("query_id", label).agg(*[F.count_if(F.col("rank") <= k).alias(f"_c{i}") for i, k in enumerate(ks)])
    # most votes, then the smallest label, a null one first
    order = [F.struct(F.col(label).isNotNull().alias("known"), F.col(label).alias("value")) for _ in ks]
    best = counts.groupBy("query_id").agg(*[
        F.min(F.when(F.col(f"_c{i}") > 0, F.struct((-F.col(f"_c{i}")).alias("votes"), o.alias("label")))).alias(f"_b{i}") for i, o in enumerate(order)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_b{i}").alias("b")) for i, k in enumerate(ks)])).alias("e")
    return best.select(F.col("query_id").alias("sample_id"), each).where("e.b is not null").select(
        "sample_id", "e.k", F.col("e.b.label.value").alias("predicted")
    )
