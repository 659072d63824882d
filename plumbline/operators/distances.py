"""Distances between two sets of vectors: kernel MMD, Frechet, RBF and moment gaps.

Sampled kernel distances work on groups whose size is capped by their own
definition (at most a few hundred rows per side), so one task can hold a group.
Uncapped ones use sums: the cubic kernel has an explicit feature map, so whole
tables cost one pass and no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.functions import vectors as V
from plumbline.functions.arrow import matrix, unit_rows
from plumbline.operators import moments as M
from plumbline.operators.conditions import nearest_condition
from plumbline.operators.prefix import average_ranks
from plumbline.operators.ranking import spearman
from plumbline.operators.sampling import condition_counts, draw_rank, matched_draw, stratified_kfold, with_reps
from plumbline.operators.pivot_join import slices, written
from plumbline.session import BLOCK_ROWS, WINDOW_ROWS, cut_lineage, limit, small_table

PAIR_ROWS = 4096  # rows of a sample whose pairs one task adds up; larger samples go through the feature map
SALT_ROWS = 16_384  # rows of a large sample that share a feature map before it is shuffled
SIDES = 8  # blocks that the rows of a large group are dealt to for their pairs, as long as one takes
SIDE_BYTES = 16 << 20  # at most so many bytes
MAP_BYTES = 64 << 20  # of one group's third-order sums in a task; wider vectors are cut in index blocks


def at_most(cap: int | None, *sizes: Column) -> Column:
    """The least of some sizes, and of a cap that the caller may give."""
    return F.least(*sizes, *([] if cap is None else [F.lit(cap)]))


def kid_mode(normalize: str, feature_type: str) -> str:
    """'cosine' for unit-normalised or aligned features, else 'standard'."""
    return "cosine" if normalize == "l2" or feature_type.startswith("aligned_") else "standard"


def cubic_mmd(x: np.ndarray, y: np.ndarray, mode: str = "cosine") -> float:
    """Unbiased MMD^2 with kernel (x.y + 1)^3 on unit rows or (x.y/d + 1)^3; nan below two rows."""
    if len(x) != len(y):
        raise ValueError(f"equal sample sizes needed, got {len(x)} and {len(y)}")
    m = len(x)
    if m < 2:
        return float("nan")
    if mode == "cosine":
        x, y, s = unit_rows(x), unit_rows(y), 1.0
    else:
        s = 1.0 / x.shape[1]

    def total(a: np.ndarray, b: np.ndarray) -> float:
        return sum(float(((a[cut] @ b.T * s + 1.0) ** 3).sum()) for cut in slices(len(a), len(b)))

    own = sum(float((((a * a).sum(1) * s + 1.0) ** 3).sum()) for a in (x, y))  # the diagonals
    return float((total(x, x) + total(y, y) - own) / (m * (m - 1)) - 2.0 * total(x, y) / (m * m))


def _feature_map_sums(df: DataFrame, keys: Sequence[str], mode: str, features: str) -> DataFrame:
    """Per group the summed feature map of the cubic kernel, in chunks, and the summed diagonal (chunk -1).

    The third-order part is cut by its first index in blocks of bounded size. With more than one block every row goes to
    each, and rows of one block are brought together before they are summed.
    """
    keys = list(keys)
    spark = df.sparkSession
    width = df.select(F.size(features)).first()
    width = width[0] if width else 1
    blocks = max(1, min(width, -(-8 * width**3 // MAP_BYTES)))
    slim = df.select(*keys, F.col(features).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    if blocks > 1:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        slim = slim.repartition(max(parts, blocks), "_b", F.pmod(F.xxhash64("_x"), F.lit(max(1, parts // blocks))))
    key_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema if f.name in keys)
    bounds = np.linspace(0, width, blocks + 1).astype(int).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[float, np.ndarray]] = {}
        types: list[pa.DataType] = []

        def flush():
            for (*key, block), (diag, flat) in sums.items():
                parts = [flat[i : i + M.CHUNK] for i in range(0, len(flat), M.CHUNK)]
                numbers = [block << 20 | i for i in range(len(parts))]
                if block == 0:
                    parts, numbers = [np.array([diag]), *parts], [-1, *numbers]
                arrays = [pa.array([v] * len(parts), types[j]) for j, v in enumerate(key)]
                arrays.append(pa.array(numbers, pa.int32()))
                arrays.append(pa.array([p.tolist() for p in parts], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "chunk", "vals"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = [batch.schema.field(k).type for k in keys]
            x = matrix(batch.column(batch.schema.get_field_index("_x")))
            x = unit_rows(x) if mode == "cosine" else x / np.sqrt(x.shape[1])
            groups = batch.select([*keys, "_b"]).to_pandas().groupby([*keys, "_b"], sort=False, dropna=False).indices
            for key, index in groups.items():
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(k.item() if hasattr(k, "item") else k for k in key)
                low, high = bounds[key[-1]], bounds[key[-1] + 1]
                part = x[index]
                third = np.zeros((high - low, part.shape[1] ** 2))
                for i in range(0, len(part), 512):
                    p = part[i : i + 512]
                    third += p[:, low:high].T @ (p[:, :, None] * p[:, None, :]).reshape(len(p), -1)
                flat, diag = third.ravel(), 0.0
                if low == 0:
                    flat = np.concatenate([[len(part)], np.sqrt(3.0) * part.sum(0), np.sqrt(3.0) * (part.T @ part).ravel(), flat])
                    diag = float((((part**2).sum(1) + 1.0) ** 3).sum())
                old = sums.get(key)
                sums[key] = (diag, flat) if old is None else (old[0] + diag, old[1] + flat)
            if sum(f.nbytes for _, f in sums.values()) > 256 << 20:
                yield from flush()
                sums.clear()
        yield from flush()

    partial = slim.mapInArrow(run, f"{key_schema}chunk int, vals array<double>")
    total = Summarizer.metrics("sum").summary(array_to_vector("vals"))
    return partial.groupBy(*keys, "chunk").agg(total.alias("_s")).select(
        *keys, "chunk", vector_to_array("_s.sum").alias("vals")
    )


def kid(
    x: DataFrame, y: DataFrame, keys: Sequence[str] = (), mode: str = "cosine", features: str = "features"
) -> DataFrame:
    """Cubic-kernel unbiased MMD^2 of whole groups without any cap or pair.

    sum_ij (x_i.y_j + 1)^3 is the inner product of the two summed feature maps
    (1, sqrt3 x, sqrt3 x(x)x, x(x)x(x)x), so each side is one aggregate. The
    map has D^3 entries; a task holds a block of them.
    """
    return _kid_from_sums(_feature_map_sums(x, keys, mode, features), _feature_map_sums(y, keys, mode, features), keys)


def _kid_from_sums(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_x, n_y and kid from both sides' feature-map sums."""
    keys = list(keys)
    a = a.select(*keys, "chunk", F.col("vals").alias("_va"))
    b = b.select(*keys, "chunk", F.col("vals").alias("_vb"))
    both = a.join(b, [*keys, "chunk"])
    off = F.col("chunk") >= 0
    grouped = both.groupBy(*keys) if keys else both.groupBy()
    sums = grouped.agg(
        F.sum(F.when(off, V.dot("_va", "_va"))).alias("_aa"), F.sum(F.when(off, V.dot("_vb", "_vb"))).alias("_bb"),
        F.sum(F.when(off, V.dot("_va", "_vb"))).alias("_ab"),
        F.max(F.when(~off, F.col("_va")[0])).alias("_da"), F.max(F.when(~off, F.col("_vb")[0])).alias("_db"),
        F.max(F.when(F.col("chunk") == 0, F.col("_va")[0])).alias("n_x"),
        F.max(F.when(F.col("chunk") == 0, F.col("_vb")[0])).alias("n_y"),
    )
    n, m = F.col("n_x"), F.col("n_y")
    value = (F.col("_aa") - F.col("_da")) / (n * (n - 1)) + (F.col("_bb") - F.col("_db")) / (m * (m - 1)) - 2.0 * F.col("_ab") / (n * m)
    return sums.select(
        *keys, n.cast("long").alias("n_x"), m.cast("long").alias("n_y"), F.when((n >= 2) & (m >= 2), value).alias("kid")
    )


def kid_of_sides(
    samples: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]], mode: str = "cosine", most: int = PAIR_ROWS
) -> DataFrame:
    """Kernel distances between named sides of equal size: keys, side, features -> keys, one column per pair.

    `most` is the size of the largest side: small samples are summed pair by pair in a task, larger ones by the feature
    map. Sides of different size, or missing ones, give null.
    """
    if most > PAIR_ROWS:
        keys = list(keys)
        # a group's rows come together in bounded salts: a map of D^3 entries is sent per salt, not per task that met the group
        salt = F.pmod(F.xxhash64("features"), F.lit(-(-most // SALT_ROWS)))
        parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        samples = samples.repartition(parts, *keys, "side", salt)
        sums = written(_feature_map_sums(samples, [*keys, "side"], mode, "features"), "feature-maps")
        side = lambda s: sums.where(F.col("side") == s).drop("side")
        out = samples.select(*keys).distinct()
        for name, (a, b) in pairs.items():
            one = _kid_from_sums(side(a), side(b), keys)
            out = out.join(one.select(*keys, F.when(F.col("n_x") == F.col("n_y"), F.col("kid")).alias(name)), keys, "left")
        return out
    keys = list(keys)
    fields = [samples.schema[k] for k in keys]
    schema = T.StructType([*fields, *[T.StructField(n, T.DoubleType()) for n in pairs]])

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x = matrix(table.column("features"))
        row = {k: [table.column(k)[0].as_py()] for k in keys}
        for name, (a, b) in pairs.items():
            one, two = x[side == a], x[side == b]
            value = cubic_mmd(one, two, mode) if len(one) == len(two) and len(one) else float("nan")
            row[name] = [value if np.isfinite(value) else None]
        return pa.table(row, schema=out_schema)

    out_schema = to_arrow_schema(schema)
    return samples.select(*keys, "side", "features").groupBy(*keys).applyInArrow(run, schema)


def first_drawn(
    rows: DataFrame, keys: Sequence[str], reps: int, seed: int, most: int, draw_id: str = "draw_id"
) -> DataFrame:
    """First `most` rows of every (group, repetition) in random order, with their place.

    As long as a window may hold so many, Spark cuts groups per partition before the shuffle, so a hot group sends at most
    `most` rows per task; beyond, ranks go through hash-prefix buckets.
    """
    keys = list(keys)
    if most > limit(rows.sparkSession, WINDOW_ROWS):
        ranked = draw_rank(with_reps(rows, reps), draw_id, seed, [*keys, "rep"], rep=F.col("rep"), name="place")
        return ranked.where(F.col("place") <= most).drop("group_n")
    keyed = with_reps(rows, reps).withColumn("_d", V.draw_key(seed, F.col("rep"), draw_id))
    place = F.row_number().over(Window.partitionBy(*keys, "rep").orderBy("_d", draw_id))
    return keyed.withColumn("place", place).where(F.col("place") <= most).drop("_d")


def largest(cells: DataFrame) -> int:
    """The largest sample size k of any group."""
    return int(cells.agg(F.coalesce(F.max("k"), F.lit(1))).first()[0])


def as_draws(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows as draws of themselves: keys, draw_id, sample_id."""
    return df.select(*keys, F.col("sample_id").cast("string").alias("draw_id"), "sample_id")


def slots_as_draws(draws: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drawn slots (possibly repeating a row) as draws with unique ids."""
    return draws.select(*keys, F.concat_ws("#", F.col("sample_id").cast("string"), F.col("slot").cast("string")).alias("draw_id"), "sample_id")


def cell_sizes(x_rows: DataFrame, y_rows: DataFrame, keys: Sequence[str], size: Column, min_size: int) -> DataFrame:
    """Sample size k per group from the row counts n_x and n_y of both sides."""
    keys = list(keys)
    nx = x_rows.groupBy(*keys).agg(F.count("*").alias("n_x"))
    ny = y_rows.groupBy(*keys).agg(F.count("*").alias("n_y"))
    return nx.join(ny, keys).withColumn("k", size.cast("long")).where(F.col("k") >= min_size)


def sampled_kid(
    x_rows: DataFrame, y_rows: DataFrame, x_feats: DataFrame, y_feats: DataFrame, keys: Sequence[str],
    size: Column | None, reps: int, seed: int = 42, mode: str = "cosine", split_y: bool = False,
    min_size: int = 2, cells: DataFrame | None = None,
) -> DataFrame:
    """Kernel distance of `size` random rows per side for every group and repetition.

    `size` is an expression over n_x and n_y. With `split_y` the
    y side gives two disjoint samples A and B: `kid` is A against x and
    `kid_base` A against B. Only ids are ranked; vectors are fetched for drawn
    rows. `cells` (keys, k) gives the sizes directly.
    """
    keys = list(keys)
    if cells is None:
        cells = cell_sizes(x_rows, y_rows, keys, size, min_size)
    most = largest(cells)
    x = first_drawn(x_rows, keys, reps, seed, most).join(cells, keys).where(F.col("place") <= F.col("k"))
    y = first_drawn(y_rows, keys, reps, seed + 1, 2 * most if split_y else most).join(cells, keys)
    y = y.where(F.col("place") <= (2 if split_y else 1) * F.col("k"))
    sx = x.select(*keys, "rep", "sample_id", F.lit("x").alias("side")).join(x_feats.select("sample_id", "features"), "sample_id")
    side = F.when(F.col("place") <= F.col("k"), "a").otherwise("b")
    sy = y.select(*keys, "rep", "sample_id", side.alias("side")).join(y_feats.select("sample_id", "features"), "sample_id")
    pairs = {"kid": ("a", "x"), "kid_base": ("a", "b")} if split_y else {"kid": ("a", "x")}
    return kid_of_sides(sx.unionByName(sy), [*keys, "rep"], pairs, mode, most)


def spread(per_rep: DataFrame, keys: Sequence[str], value: str = "kid") -> DataFrame:
    """Mean, population std and 2.5/97.5 percentiles over the repetitions."""
    keys = list(keys)
    grouped = per_rep.where(F.col(value).isNotNull())
    grouped = grouped.groupBy(*keys) if keys else grouped.groupBy()
    ends = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    out = grouped.agg(F.count("*").alias("n_rep"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), ends.alias("_e"))
    return out.select(*keys, "n_rep", "mean", "std", F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"))


def kid_bootstrap(
    bins: DataFrame, real: DataFrame, gen: DataFrame, bin_keys: Sequence[str], reps: int = 10, seed: int = 42,
    mode: str = "cosine", real_rows: DataFrame | None = None, cap: int | None = None,
) -> DataFrame:
    """Per bin the mean and 95% interval of the distance between its rows and real rows.

    The sample size is min(M, N//2), at least 5, and `cap` if given. `real_rows` may give
    each bin its own pool of draws; else every bin is compared with all real rows.
    """
    keys = list(bin_keys)
    if real_rows is None:
        names = bins.select(*keys).distinct()
        tags = names.agg(F.collect_list(F.struct(*keys)).alias("_k"))  # one entry per bin
        pool = as_draws(real, []).join(F.broadcast(tags)).withColumn("_b", F.explode("_k"))
        real_rows = pool.select("_b.*", "draw_id", "sample_id")
    size = F.greatest(at_most(cap, F.col("n_x"), F.floor(F.col("n_y") / 2)), F.lit(5))
    enough = F.when((F.col("n_x") >= size) & (F.col("n_y") >= size), size)
    runs = sampled_kid(as_draws(bins, keys), real_rows, gen, real, keys, enough, reps, seed, mode)
    return spread(runs, keys).select(*keys, F.col("mean").alias("mean_kid"), "ci_low", "ci_high")


def kid_null(
    real: DataFrame, keys: Sequence[str], reps: int = 100, seed: int = 42, mode: str = "cosine", cap: int | None = None
) -> DataFrame:
    """Mean and sample std of real-against-real distances per condition of at least 10 rows.

    Both halves hold n//2 rows, or `cap` if given; conditions with fewer than 10 valid
    repetitions or std below 1e-10 are left out.
    """
    keys = list(keys)
    rows = as_draws(real, keys)
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= 10)
    cells = cells.withColumn("k", F.least(F.floor(F.col("n") / 2), F.lit(cap)) if cap else F.floor(F.col("n") / 2))
    most = largest(cells)
    drawn = first_drawn(rows, keys, reps, seed, 2 * most).join(cells, keys).where(F.col("place") <= 2 * F.col("k"))
    side = F.when(F.col("place") <= F.col("k"), "a").otherwise("b")
    samples = drawn.select(*keys, "rep", "sample_id", side.alias("side")).join(real.select("sample_id", "features"), "sample_id")
    runs = kid_of_sides(samples, [*keys, "rep"], {"kid": ("a", "b")}, mode, most)
    out = runs.where(F.col("kid").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_rep"), F.avg("kid").alias("null_mean"), F.stddev_samp("kid").alias("null_std")
    )
    return out.where((F.col("n_rep") >= 10) & (F.col("null_std") >= 1e-10))


def delta_kid(
    real: DataFrame, gen: DataFrame, keys: Sequence[str], reps: int = 10, seed: int = 42, mode: str = "cosine",
    null: DataFrame | None = None, min_real: int = 20, min_gen: int = 5, cap: int | None = None,
) -> DataFrame:
    """Per condition distance to generated rows minus the real-against-real distance, and its z against `null`.

    Needs min_real real and min_gen generated rows and a sample size
    min(n_real//2, n_gen, and `cap` if given) of at least 5; other conditions have nulls.
    """
    keys = list(keys)
    k = at_most(cap, F.floor(F.col("n_y") / 2), F.col("n_x"))
    size = F.when((F.col("n_y") >= min_real) & (F.col("n_x") >= min_gen) & (k >= 5), k)
    runs = sampled_kid(as_draws(gen, keys), as_draws(real, keys), gen, real, keys, size, reps, seed, mode, True)
    means = runs.groupBy(*keys).agg(
        F.avg(F.col("kid") - F.col("kid_base")).alias("delta_kid"), F.avg("kid_base").alias("base_kid"),
        F.avg("kid").alias("gen_kid"),
    )
    counts = condition_counts(gen, keys, "n_gen").join(condition_counts(real, keys, "n_real"), keys, "left")
    out = counts.withColumn("n_real", F.coalesce("n_real", F.lit(0))).join(means, keys, "left")
    if null is None:
        return out
    z = (F.col("gen_kid") - F.col("null_mean")) / F.col("null_std")
    return out.join(null.select(*keys, "null_mean", "null_std"), keys, "left").withColumn("kid_z", z)


def delta_kid_by_size(
    real: DataFrame, gen: DataFrame, keys: Sequence[str], sizes: Sequence[int], reps: int = 20, seed: int = 42
) -> DataFrame:
    """delta_kid at fixed sample sizes (size//2 rows per side); conditions with too few rows are absent."""
    keys = list(keys)
    grid = F.explode(F.array(*[F.lit(s) for s in sizes]))
    x = as_draws(gen, keys).withColumn("size", grid)
    y = as_draws(real, keys).withColumn("size", grid)
    half = F.floor(F.col("size") / 2)
    size = F.when((F.col("n_y") >= F.col("size")) & (F.col("n_x") >= half), half)
    runs = sampled_kid(x, y, gen, real, [*keys, "size"], size, reps, seed, "cosine", True)
    return runs.groupBy(*keys, "size").agg(F.avg(F.col("kid") - F.col("kid_base")).alias("delta_kid"))


def size_correlations(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman correlation of delta_kid between every two sample sizes (3 or more shared conditions)."""
    keys = list(keys)
    left = table.select(*keys, F.col("size").alias("size_a"), F.col("delta_kid").alias("_a"))
    right = table.select(*keys, F.col("size").alias("size_b"), F.col("delta_kid").alias("_b"))
    return spearman(left.join(right, keys), "_a", "_b", ["size_a", "size_b"])


def rank_stability(table: DataFrame, keys: Sequence[str], n_sizes: int) -> DataFrame:
    """Mean and sample std of each condition's rank over the sizes; conditions with every size only."""
    ranked = average_ranks(table.where(F.col("delta_kid").isNotNull()), "delta_kid", ["size"], "rank")
    out = ranked.groupBy(*keys).agg(
        F.count("rank").alias("n_sizes"), F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("std_rank")
    )
    return out.where(F.col("n_sizes") == n_sizes)


# ---- RBF kernel ---------------------------------------------------------------------------------


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2.0 * x @ y.T + (y**2).sum(1)[None, :], 0.0)


def _block_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], rows: int, same: bool) -> DataFrame:
    """Pairs of bounded blocks inside each group; `same` keeps each unordered pair of blocks once.

    A group has SIDES blocks, fewer of at least `rows` rows if it is small, more if they would take over SIDE_BYTES; so a row is
    sent SIDES times at most however large its group is, until SIDES blocks of SIDE_BYTES hold it no more. Blocks of `a` are
    cut inside keys that `b` lacks, too, and carry their `median_distance`, if it has one: joined to pairs, it would send them.
    """
    keys, both = list(keys), [k for k in keys if k in b.columns]
    width = a.select(F.size("features")).first()
    most = max(rows, SIDE_BYTES // (8 * max(1, width[0] if width else 1)))

    def packed(df: DataFrame, tag: str, keys: Sequence[str]) -> DataFrame:
        n = F.count("*")
        count = F.greatest(F.ceil(n / most), F.least(F.ceil(n / rows), F.lit(SIDES))).cast("int")
        blocks = df.groupBy(*keys).agg(count.alias(f"{tag}n"))
        number = F.pmod(F.xxhash64("sample_id"), F.col(f"{tag}n")).cast("int")
        more = [c for c in ("median_distance",) if c in df.columns and tag == "l"]
        cut = df.select(*keys, "sample_id", "features", *more).join(blocks, keys).withColumn(f"{tag}b", number)
        flat = F.flatten(F.collect_list("features")).alias(f"{tag}flat")
        return cut.groupBy(*keys, f"{tag}n", f"{tag}b").agg(flat, F.count("*").cast("int").alias(f"{tag}m"), *[F.first(c).alias(c) for c in more])

    left, right = packed(a, "l", keys), packed(b, "r", both)
    sizes = right.groupBy(*both).agg(F.first("rn").alias("_rn"))
    first = F.col("lb") if same else F.lit(0)
    left = left.join(sizes, both).withColumn("rb", F.explode(F.sequence(first, F.col("_rn") - 1)))
    return left.join(right, [*both, "rb"])


def real_pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """The block pairs of all groups of more than one block, written once for all passes over them; None without such groups."""
    rows = limit(df.sparkSession, BLOCK_ROWS)
    big = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    if big.isEmpty():
        return None
    own = df.join(big, list(keys), "left_semi")
    return written(_block_pairs(own, own, keys, rows, True), "block-pairs", maxRecordsPerFile=1)  # so that tasks share them evenly


def _sides(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Both blocks of a pair."""
    at = batch.schema.get_field_index
    return tuple(batch.column(at(f"{s}flat"))[i].values.to_numpy().reshape(batch.column(at(f"{s}m"))[i].as_py(), -1) for s in "lr")


def median_pair_distance(df: DataFrame, keys: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """Median Euclidean distance over the unordered row pairs of each group.

    Groups of one block are measured in one task. Larger groups are bisected:
    each pass counts, per block pair, the distances in 1024 slices of the
    interval that still holds the two middle ranks, until the interval is 2^-40
    of the largest possible distance. No pass emits pairs; all read `pairs`, the
    groups' written block pairs.
    """
    keys = list(keys)
    rows = limit(df.sparkSession, BLOCK_ROWS)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("median_distance", T.DoubleType())])
    out_schema = to_arrow_schema(schema)

    def one_block(table: pa.Table) -> pa.Table:
        x = matrix(table.column("features"))
        gap = np.sqrt(_sq(x, x))[np.triu_indices(len(x), 1)]
        m = float(np.median(gap)) if len(gap) else 1.0
        return pa.table({**{k: [table.column(k)[0].as_py()] for k in keys}, "median_distance": [m if m > 0 else 1.0]}, schema=out_schema)

    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    small = df.join(sizes.where(F.col("_n") <= rows), keys, "left_semi").select(*keys, "features")
    direct = small.groupBy(*keys).applyInArrow(one_block, schema)
    big = sizes.where(F.col("_n") > rows)
    if big.isEmpty():
        return direct
    pairs = real_pairs(df, keys) if pairs is None else pairs
    marks = 1024

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            for i in range(batch.num_rows):
                x, y = _sides(batch, i)
                diagonal = batch.column(at("lb"))[i].as_py() == batch.column(at("rb"))[i].as_py()
                lo, hi = batch.column(at("lo"))[i].as_py(), batch.column(at("hi"))[i].as_py()
                hist, below = np.zeros(marks, np.int64), 0
                for cut in slices(len(x), len(y)):
                    gap = np.sqrt(_sq(x[cut], y))
                    gap = gap[np.arange(cut.start, cut.stop)[:, None] < np.arange(len(y))[None, :]] if diagonal else gap.ravel()
                    hist += np.histogram(gap[(gap >= lo) & (gap <= hi)], bins=marks, range=(lo, hi))[0]
                    below += int((gap < lo).sum())
                row = {k: [batch.column(at(k))[i].as_py()] for k in keys}
                row.update(side=[batch.column(at("side"))[i].as_py()], hist=[hist.astype(float).tolist()], below=[float(below)])
                yield pa.RecordBatch.from_pydict(row, schema=part_schema)

    part = T.StructType([*fields, T.StructField("side", T.IntegerType()), T.StructField("hist", T.ArrayType(T.DoubleType())), T.StructField("below", T.DoubleType())])
    part_schema = to_arrow_schema(part)
    total = F.col("_n").cast("double") * (F.col("_n") - 1) / 2
    # Two middle ranks (equal for an odd count), 0-based.
    state = big.select(
        *keys, F.posexplode(F.array(F.floor((total - 1) / 2), F.ceil((total - 1) / 2))).alias("side", "rank")
    ).withColumns({"lo": F.lit(0.0), "hi": F.lit(float("nan"))})
    reach = df.join(big, keys, "left_semi").groupBy(*keys).agg((2.0 * F.max(V.norm("features"))).alias("_r"))
    state = state.join(reach, keys).withColumn("hi", F.col("_r")).drop("_r")
    for _ in range(4):  # 1024^4 = 2^40 slices of the widest possible distance
        # as few conditions as have more than a block; without the hint the pairs would be shuffled
        hists = pairs.join(F.broadcast(state.select(*keys, "side", "lo", "hi")), keys).mapInArrow(counts, part)
        stats = Summarizer.metrics("sum").summary(array_to_vector("hist"))
        merged = hists.groupBy(*keys, "side").agg(stats.alias("_s"), F.sum("below").alias("below"))
        merged = merged.select(*keys, "side", vector_to_array("_s.sum").alias("hist"), "below")
        joined = state.join(merged, [*keys, "side"])
        cum = F.aggregate(
            "hist", F.struct(F.col("below").alias("acc"), F.lit(0).alias("ix")),
            lambda s, h: F.struct(
                (s["acc"] + h).alias("acc"), (s["ix"] + F.when(s["acc"] + h <= F.col("rank"), 1).otherwise(0)).alias("ix")
            ),
        )
        step = (F.col("hi") - F.col("lo")) / marks
        index = F.least(cum["ix"], F.lit(marks - 1))
        nxt = joined.select(*keys, "side", "rank", (F.col("lo") + step * index).alias("lo"), (F.col("lo") + step * (index + 1)).alias("hi"))
        state = cut_lineage(nxt)
    middle = state.groupBy(*keys).agg(F.avg((F.col("lo") + F.col("hi")) / 2).alias("median_distance"))
    return direct.unionByName(middle.withColumn("median_distance", F.when(F.col("median_distance") > 0, F.col("median_distance")).otherwise(1.0)))


def rbf_mmd(
    gen: DataFrame, real: DataFrame, keys: Sequence[str], bins: str = "bin", min_gen: int = 5, min_real: int = 5
) -> DataFrame:
    """Biased RBF MMD^2 per (bin, condition); the width is the median real pair distance of the condition.

    Kernel sums run over bounded block pairs and are added up; no group has to
    fit one task.
    """
    keys = list(keys)
    rows = limit(gen.sparkSession, BLOCK_ROWS)
    n_gen = gen.groupBy(*keys, bins).agg(F.count("*").alias("n_gen")).where(F.col("n_gen") >= min_gen)
    n_real = real.groupBy(*keys).agg(F.count("*").alias("n_real")).where(F.col("n_real") >= min_real)
    gen = gen.join(n_gen, [*keys, bins], "left_semi").join(n_real, keys, "left_semi")
    real = real.join(n_real, keys, "left_semi").join(n_gen, keys, "left_semi").select(*keys, "sample_id", "features")
    pairs = real_pairs(real, keys)
    sigma = cut_lineage(median_pair_distance(real, keys, pairs))  # one row per condition, read by all sums

    def total(pairs: DataFrame, by: Sequence[str], name: str, same: bool = False) -> DataFrame:
        """Kernel sums per group; of the same rows every block pair is met once, and counts twice off the diagonal."""
        schema = T.StructType([*[pairs.schema[k] for k in by], T.StructField("s", T.DoubleType())])
        arrow = to_arrow_schema(schema)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index
                for i in range(batch.num_rows):
                    x, y = _sides(batch, i)
                    width = batch.column(at("median_distance"))[i].as_py()
                    twice = same and batch.column(at("lb"))[i].as_py() != batch.column(at("rb"))[i].as_py()
                    value = sum(float(np.exp(-_sq(x[cut], y) / (2.0 * width * width)).sum()) for cut in slices(len(x), len(y))) * (2.0 if twice else 1.0)
                    yield pa.RecordBatch.from_pydict({**{k: [batch.column(at(k))[i].as_py()] for k in by}, "s": [value]}, schema=arrow)

        return pairs.mapInArrow(sums, schema).groupBy(*by).agg(F.sum("s").alias(name))

    both = [*keys, bins]
    small = real.join(sigma, keys)
    if pairs is not None:
        large = pairs.select(*keys).distinct()
        small = small.join(large, keys, "left_anti")
    within = total(_block_pairs(small, small, keys, rows, True), keys, "_rr", True)
    if pairs is not None:
        within = within.unionByName(total(pairs.join(F.broadcast(sigma.join(large, keys)), keys), keys, "_rr", True))
    gen = gen.join(sigma, keys)
    out = n_gen.join(n_real, keys).join(total(_block_pairs(gen, gen, both, rows, True), both, "_gg", True), both)
    out = out.join(within, keys).join(total(_block_pairs(gen, real, both, rows, False), both, "_gr"), both)
    value = F.col("_gg") / F.pow("n_gen", F.lit(2)) + F.col("_rr") / F.pow("n_real", F.lit(2)) - 2.0 * F.col("_gr") / (F.col("n_gen") * F.col("n_real"))
    return out.select(*keys, bins, "n_gen", "n_real", value.alias("mmd2"))


# ---- Frechet and moment gaps -------------------------------------------------------------------


def frechet(mu1: np.ndarray, cov1: np.ndarray, mu2: np.ndarray, cov2: np.ndarray, eps: float = 0.0) -> float:
    """|mu1-mu2|^2 + tr(A + B - 2 (A^1/2 B A^1/2)^1/2)."""
    a, b = cov1 + eps * np.eye(len(cov1)), cov2 + eps * np.eye(len(cov2))
    values, basis = np.linalg.eigh(a)
    root = (basis * np.sqrt(np.clip(values, 0.0, None))) @ basis.T
    cross = np.sqrt(np.clip(np.linalg.eigvalsh(root @ b @ root), 0.0, None)).sum()
    return float(((mu1 - mu2) ** 2).sum() + np.trace(a) + np.trace(b) - 2.0 * cross)


def frechet_distance(x: DataFrame, y: DataFrame, features: str = "features", eps: float = 0.0) -> float:
    a, b = M.collect_moments(x, features), M.collect_moments(y, features)
    return frechet(a.mean, a.cov(1), b.mean, b.cov(1), eps)


def split_half_ratio(real: DataFrame, gen: DataFrame, seed: int = 42, features: str = "features") -> DataFrame:
    """Frechet(gen, real half A) over Frechet(real half A, real half B) + 1e-6; zeros below 4 rows."""
    parts = draw_rank(real.select("sample_id", features), "sample_id", seed)
    half = F.floor(F.col("group_n") / 2)
    sides = parts.withColumn("side", F.when(F.col("draw_rank") <= half, "a").otherwise("b"))
    g = draw_rank(gen.select("sample_id", features), "sample_id", seed).select("sample_id", features, "draw_rank")
    n = real.agg(F.count("*").alias("_n"))
    g = g.join(F.broadcast(n)).where(F.col("draw_rank") <= F.floor(F.col("_n") / 2))
    both = sides.select("side", features).unionByName(g.select(F.lit("g").alias("side"), features))
    m = {k[0]: v for k, v in M.collect_group_moments(both, ["side"], features)}
    if sum(m[s].n for s in "ab" if s in m) < 4:
        gen_d, base, ratio = 0.0, 0.0, 0.0
    else:
        gen_d = frechet(m["a"].mean, m["a"].cov(1), m["g"].mean, m["g"].cov(1), 1e-6)
        base = frechet(m["a"].mean, m["a"].cov(1), m["b"].mean, m["b"].cov(1), 1e-6)
        ratio = gen_d / (base + 1e-6)
    return small_table(
        real.sparkSession, [{"ratio": ratio, "frechet_gen": gen_d, "frechet_base": base}],
        [("ratio", "double"), ("frechet_gen", "double"), ("frechet_base", "double")],
    )


def matched_with_fallback(
    gen: DataFrame, real: DataFrame, attrs: Sequence[str], reps: int = 1, seed: int = 42, rep_cols: Sequence[str] = ()
) -> DataFrame:
    """For every generated row one real row of its condition, or of the nearest condition with real rows.

    Rows of `gen` may already carry `rep_cols`; else `reps` repetitions are drawn.
    """
    attrs = list(attrs)
    near = nearest_condition(gen, real, attrs)
    base = gen if rep_cols else with_reps(gen, reps)
    rep_cols = list(rep_cols) or ["rep"]
    target = base.join(near, attrs).select(*[F.col(f"near_{a}").alias(a) for a in attrs], *rep_cols)
    want = target.groupBy(*attrs, *rep_cols).agg(F.count("*").alias("n_want"))
    return matched_draw(want, real, attrs, seed, rep_cols)


PANEL = ("mean_gap", "cov_gap", "frechet", "kid")


def metric_panel(
    gen: DataFrame, real: DataFrame, attrs: Sequence[str], reps: int = 10, seed: int = 42, cap: int | None = None
) -> DataFrame:
    """Mean gap, covariance gap, Frechet and kernel distance on the same matched draws, per repetition.

    Each repetition compares as many rows per side as the smaller side has (and `cap` if given). Means and covariances
    come from distributed sums; the driver sees two D x D matrices per repetition.
    """
    matched = slots_as_draws(matched_with_fallback(gen, real, attrs, reps, seed), ["rep"])
    # every generated row is drawn once per repetition, and matched rows carry theirs
    g_rows, r_rows = with_reps(as_draws(gen, []), reps, "draw"), matched.withColumnRenamed("rep", "draw")
    cells = cut_lineage(cell_sizes(g_rows, r_rows, ["draw"], at_most(cap, F.col("n_x"), F.col("n_y")), 2))
    most = largest(cells)

    def drawn(rows: DataFrame, s: int, side: str, feats: DataFrame) -> DataFrame:
        keyed = rows.withColumnRenamed("draw", "rep")
        if most > limit(rows.sparkSession, WINDOW_ROWS):
            ranked = draw_rank(keyed, "draw_id", s, ["rep"], rep=F.col("rep"), name="place")
        else:
            order = Window.partitionBy("rep").orderBy(V.draw_key(s, F.col("rep"), "draw_id"), "draw_id")
            ranked = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
        kept = ranked.join(cells.select(F.col("draw").alias("rep"), "k"), "rep").where(F.col("place") <= F.col("k"))
        return kept.select("rep", "sample_id", F.lit(side).alias("side")).join(feats.select("sample_id", "features"), "sample_id")

    sides = written(drawn(g_rows, seed, "g", gen).unionByName(drawn(r_rows, seed + 1, "r", real)), "panel")
    moments = {tuple(k): m for k, m in M.collect_group_moments(sides, ["rep", "side"], "features")}
    rows = []
    for rep in sorted({rep for rep, _ in moments}):
        a, b = moments[rep, "g"], moments[rep, "r"]
        ca, cb = a.cov(1), b.cov(1)
        rows.append((rep, a.n, float(np.linalg.norm(a.mean - b.mean)), float(np.linalg.norm(ca - cb)), float(frechet(a.mean, ca, b.mean, cb))))
    figures = gen.sparkSession.createDataFrame(rows, "rep int, k int, mean_gap double, cov_gap double, frechet double")
    return figures.join(kid_of_sides(sides.drop("sample_id"), ["rep"], {"kid": ("g", "r")}, "cosine", most), "rep")


def panel_summary(panel: DataFrame) -> DataFrame:
    """Mean and sample std of every figure of a panel over its repetitions: metric, mean, std, n_rep."""
    long = panel.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in PANEL])).alias("e")).select("e.*")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n_rep"))


def accepted_against_random(accepted: DataFrame, random: DataFrame) -> DataFrame:
    """Per metric the summaries of an accepted and a random panel, and by how much the random one is larger."""
    a, r = (panel_summary(p).select("metric", F.col("mean").alias(f"{n}_mean"), F.col("std").alias(f"{n}_std")) for n, p in (("accepted", accepted), ("random", random)))
    return a.join(r, "metric").withColumn("delta", F.col("random_mean") - F.col("accepted_mean")).withColumn(
        "delta_pct", F.when(F.abs("random_mean") > 1e-12, 100 * F.col("delta") / F.col("random_mean")))


def transitivity_check(
    real: DataFrame, gen_a: DataFrame, gen_b: DataFrame, attrs: Sequence[str], k: int | None = None, top: int | None = None, seed: int = 42
) -> DataFrame:
    """Distances real/real, real/space A, real/space B and A/B per supported condition, on min(n_gen, n_real//2) rows a side.

    `k` bounds the rows and asks for conditions that have so many; `top` keeps the first conditions only.
    """
    attrs = list(attrs)
    floor = max(10, k or 0)
    n = condition_counts(real, attrs, "n_real").join(condition_counts(gen_a, attrs, "n_gen"), attrs)
    n = n.where((F.col("n_real") >= 2 * floor) & (F.col("n_gen") >= floor))
    if top is not None:
        n = n.orderBy(*attrs).limit(top)
    cells = cut_lineage(n.withColumn("k", at_most(k, F.col("n_gen"), F.floor(F.col("n_real") / 2)).cast("long")))
    most = largest(cells)
    r = first_drawn(as_draws(real, attrs), attrs, 1, seed, 2 * most).join(cells, attrs).where(F.col("place") <= 2 * F.col("k"))
    g = first_drawn(as_draws(gen_a, attrs), attrs, 1, seed + 1, most).join(cells, attrs).where(F.col("place") <= F.col("k"))
    side = F.when(F.col("place") <= F.col("k"), "a").otherwise("b")
    rows = r.select(*attrs, "sample_id", side.alias("side")).join(real.select("sample_id", "features"), "sample_id")
    for name, feats in (("ga", gen_a), ("gb", gen_b)):
        part = g.select(*attrs, "sample_id", F.lit(name).alias("side")).join(feats.select("sample_id", "features"), "sample_id")
        rows = rows.unionByName(part)
    pairs = {"kid_rr": ("a", "b"), "kid_ra": ("a", "ga"), "kid_rb": ("a", "gb"), "kid_ab": ("ga", "gb")}
    out = kid_of_sides(rows.drop("sample_id"), attrs, pairs, "cosine", most)
    ratio = F.when(F.abs("kid_ra") > 1e-12, F.col("kid_rb") / F.col("kid_ra"))
    return out.join(cells.select(*attrs, "k", "n_real", "n_gen"), attrs).withColumn("scale_ratio", ratio)


def _fold_moments(paired: DataFrame, folds: str, seed: int, k: int) -> list[M.Moments]:
    split = stratified_kfold(paired.withColumn("_all", F.lit(0)), "_all", k, 2, seed)
    return [m for _, m in M.collect_group_moments(split, ["fold"], folds)]


def ridge_r2(folds: Sequence[M.Moments], dx: int, alpha: float = 1.0, basis: np.ndarray | None = None, swap: bool = False) -> float:
    """Cross-validated R^2 of a ridge fit x -> y from per-fold moments of the joined vector [x, y].

    Columns are standardised with the moments of all folds. `basis` replaces
    the standardised y columns by their projection; `swap` predicts x from y.
    """
    n = sum(m.n for m in folds)
    mean = sum(m.total for m in folds) / n
    std = np.sqrt(np.clip(np.diag(sum(m.gram for m in folds)) / n - mean**2, 0.0, None)) + 1e-8
    d = len(mean)
    t = np.diag(1.0 / std)
    if basis is not None:
        project = np.zeros((d, dx + basis.shape[1]))
        project[:dx, :dx] = np.eye(dx)
        project[dx:, dx:] = basis
        t = t @ project
    parts = []
    for m in folds:
        gram = m.gram - np.outer(m.total, mean) - np.outer(mean, m.total) + m.n * np.outer(mean, mean)
        parts.append(M.Moments(m.n, t.T @ (m.total - m.n * mean), t.T @ gram @ t))
    a, b = (slice(dx, None), slice(0, dx)) if swap else (slice(0, dx), slice(dx, None))
    scores = []
    for test in parts:
        train = M.Moments(n - test.n, sum(p.total for p in parts) - test.total, sum(p.gram for p in parts) - test.gram)
        s, mu = train.scatter(), train.mean
        w = np.linalg.solve(s[a, a] + alpha * np.eye(s[a, a].shape[0]), s[a, b])
        # Residuals of the test fold around the training means, from its sums only.
        shifted = test.gram - np.outer(test.total, mu) - np.outer(mu, test.total) + test.n * np.outer(mu, mu)
        res = np.trace(shifted[b, b]) - 2.0 * np.sum(w * shifted[a, b]) + np.sum((shifted[a, a] @ w) * w)
        tot = np.trace(test.scatter()[b, b])
        scores.append(1.0 - res / max(tot, 1e-12))
    return float(np.mean(scores))


def cross_space_predictability(
    a: DataFrame, b: DataFrame, components: int = 30, k: int = 5, seed: int = 0, alpha: float = 1.0
) -> DataFrame:
    """5-fold ridge R^2 between two paired spaces in both directions, with all columns and leading components of b."""
    paired = a.select("sample_id", F.col("features").alias("_a")).join(
        b.select("sample_id", F.col("features").alias("_b")), "sample_id"
    )
    dx, dy = (len(v) for v in paired.select("_a", "_b").first())
    paired = paired.select("sample_id", F.concat("_a", "_b").alias("_ab"))
    folds = _fold_moments(paired, "_ab", seed, k)
    n = sum(m.n for m in folds)
    whole = M.Moments(n, sum(m.total for m in folds), sum(m.gram for m in folds))
    corr = M.correlation_matrix(whole)[dx:, dx:]
    basis = np.linalg.eigh(corr)[1][:, ::-1][:, : min(components, dy)]
    row = {
        "n_paired": n, "dim_a": dx, "dim_b": dy,
        "r2_b_from_a": ridge_r2(folds, dx, alpha), "r2_a_from_b": ridge_r2(folds, dx, alpha, None, True),
        "r2_bpc_from_a": ridge_r2(folds, dx, alpha, basis), "r2_a_from_bpc": ridge_r2(folds, dx, alpha, basis, True),
    }
    kinds = [(c, "long" if isinstance(v, int) else "double") for c, v in row.items()]
    return small_table(a.sparkSession, [row], kinds)


def space_alignment(a: DataFrame, b: DataFrame, attr: str, eps: float = 1e-6) -> DataFrame:
    """How well space a matches its paired target space b: cosine, moment, class-mean and whitened gaps."""
    pa_ = a.select("sample_id", attr, V.l2_normalize("features").alias("_a"))
    pair = pa_.join(b.select("sample_id", V.l2_normalize("features").alias("_b")), "sample_id")
    cos = pair.agg(F.avg(V.dot("_a", "_b"))).first()[0]
    ma, mb = M.collect_moments(pair, "_a"), M.collect_moments(pair, "_b")
    mean_gap = ((ma.mean - mb.mean) ** 2).sum() / ((mb.mean**2).sum() + eps)
    cov_gap = ((ma.cov() - mb.cov()) ** 2).sum() / ((mb.cov() ** 2).sum() + eps)
    ca, cb = M.centroids(pair, [attr], "_a", "_ma"), M.centroids(pair, [attr], "_b", "_mb")
    both = ca.select(attr, "_ma").join(cb.select(attr, "_mb"), attr)
    gap = V.sub("_ma", "_mb")
    class_gap = both.agg(F.avg(V.dot(gap, gap) / (V.dot("_mb", "_mb") + F.lit(eps)))).first()[0]
    w = M.whitening_matrix(mb.cov(1))
    diff = pair.select(V.sub("_a", "_b").alias("_d"))
    white = float(np.trace(w @ M.collect_moments(diff, "_d").gram @ w.T) / ma.n / len(w))
    row = {
        "n": ma.n, "mean_cosine": float(cos), "mean_gap": float(mean_gap), "cov_gap": float(cov_gap),
        "class_mean_gap": float(class_gap), "whitened_mse": white,
    }
    return small_table(a.sparkSession, [row], [(c, "long" if c == "n" else "double") for c in row])

