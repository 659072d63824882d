"""Deterministic draws: every random choice orders rows by md5(seed:rep:id).

Ranks inside a group go through hash-prefix buckets, so a hot group is spread
over many tasks: row number inside (group, bucket) plus the rows of the
buckets before it. The md5 prefix is uniform, so buckets are even.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.vectors import draw_key, unit_draw

SLOT_CHUNK = 65_536


def draw_rank(
    df: DataFrame,
    sample_id: str,
    seed: int,
    keys: Sequence[str] = (),
    rep: Column | int = 0,
    name: str = "draw_rank",
) -> DataFrame:
    """1-based position of each row in its group's random order; adds `group_n`."""
    keys = list(keys)
    keyed = df.withColumn("_d", draw_key(seed, rep, sample_id)).withColumn("_b", F.substring("_d", 1, 2))
    inside = Window.partitionBy(*keys, "_b").orderBy("_d", sample_id)
    local = keyed.withColumn("_local", F.row_number().over(inside).cast("long"))
    sizes = keyed.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    # At most 256 rows per group: buckets before this one, and the group's size.
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("group_n")
    )
    joined = local.join(offsets, [*keys, "_b"])
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_d", "_b", "_local", "_before")


def with_reps(df: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    """Each row once per repetition."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def stratified_subsample(
    df: DataFrame, keys: Sequence[str], max_rows: int, seed: int = 42, sample_id: str = "sample_id"
) -> DataFrame:
    """At most `max_rows` rows with per-group shares max(1, round(n_c/N*max)); all rows if they fit."""
    ranked = draw_rank(df, sample_id, seed, keys)
    total = df.agg(F.count("*").alias("_total"))
    sized = ranked.join(F.broadcast(total))
    share = F.least(
        F.col("group_n"),
        F.greatest(F.lit(1), F.bround(F.col("group_n") / F.col("_total") * F.lit(float(max_rows))).cast("long")),
    )
    kept = sized.where((F.col("_total") <= max_rows) | (F.col("draw_rank") <= share))
    # Rounding up small groups can overshoot: trim by the global draw order.
    trimmed = draw_rank(kept.drop("draw_rank", "group_n"), sample_id, seed, (), name="_g")
    return trimmed.where((F.col("_total") <= max_rows) | (F.col("_g") <= max_rows)).drop("_g", "group_n", "_total")


def stratified_test_split(
    df: DataFrame, keys: Sequence[str], frac: float = 0.3, seed: int = 42, sample_id: str = "sample_id"
) -> DataFrame:
    """Flag max(1, int(frac*n)) rows of every group as test rows."""
    ranked = draw_rank(df, sample_id, seed, keys)
    size = F.greatest(F.lit(1), F.floor(F.lit(frac) * F.col("group_n")))
    return ranked.withColumn("is_test", F.col("draw_rank") <= size).drop("draw_rank", "group_n")


def cross_fit_split(df: DataFrame, frac: float = 0.5, seed: int = 42, sample_id: str = "sample_id") -> DataFrame:
    """Disjoint fit and score parts: int(n*frac) rows are `is_fit`.

    The draw key of the last fit row is found once on ids only; the split
    itself is then a comparison per row, without shuffle, for every later pass.
    """
    ranked = draw_rank(df.select(sample_id), sample_id, seed)
    last = ranked.where(F.col("draw_rank") == F.floor(F.lit(frac) * F.col("group_n"))).select(
        draw_key(seed, 0, sample_id), F.col(sample_id)
    ).first()
    if last is None:
        return df.withColumn("is_fit", F.lit(False))
    key = draw_key(seed, 0, sample_id)
    first = (key < F.lit(last[0])) | ((key == F.lit(last[0])) & (F.col(sample_id) <= F.lit(last[1])))
    return df.withColumn("is_fit", first)


def half_split(
    df: DataFrame, keys: Sequence[str], reps: int, seed: int = 42, sample_id: str = "sample_id"
) -> DataFrame:
    """Per group and repetition two random halves of n//2 rows, side 'A' and 'B'; an odd row is left out."""
    ranked = draw_rank(with_reps(df, reps), sample_id, seed, [*keys, "rep"], rep=F.col("rep"))
    half = F.floor(F.col("group_n") / 2)
    side = F.when(F.col("draw_rank") <= half, "A").when(F.col("draw_rank") <= 2 * half, "B")
    return ranked.withColumn("side", side).where(F.col("side").isNotNull()).drop("draw_rank", "group_n")


def stratified_kfold(
    df: DataFrame, label: str, folds: int = 5, min_count: int = 2, seed: int = 42, sample_id: str = "sample_id", within: Sequence[str] = (),
) -> DataFrame:
    """Fold number per row, even within each class; classes below `min_count` rows are dropped.

    The number of folds is min(folds, smallest class kept); with `within` each of its values is split by itself.
    """
    within = list(within)
    kept = draw_rank(df, sample_id, seed, [*within, label]).where(F.col("group_n") >= min_count)
    smallest = (kept.groupBy(*within) if within else kept).agg(F.min("group_n").alias("_s"))
    width = F.least(F.lit(folds).cast("long"), F.col("_s"))
    return (
        (kept.join(smallest, within) if within else kept.join(F.broadcast(smallest)))
        .withColumn("fold", ((F.col("draw_rank") - 1) % width).cast("int"))
        .drop("draw_rank", "group_n", "_s")
    )


def split_by_entity(
    df: DataFrame, entity: str, frac: float = 0.1, seed: int = 42
) -> DataFrame:
    """Validation flag shared by all rows of an entity; max(1, int(n*frac)) entities are validation."""
    ranked = draw_rank(df.select(entity).distinct(), entity, seed)
    size = F.greatest(F.lit(1), F.floor(F.col("group_n") * F.lit(frac)))
    flags = ranked.select(entity, (F.col("draw_rank") <= size).alias("is_val"))
    return df.join(flags, entity)


def make_splits(
    df: DataFrame,
    attrs: Sequence[str],
    heldout: DataFrame,
    dataset: str = "dataset",
    val_frac: float = 0.1,
    seed: int = 42,
    sample_id: str = "sample_id",
) -> DataFrame:
    """Boolean train/val/test flags: random validation rows inside dataset='train', test by column,
    held-out conditions moved out of train and into validation unless they are test rows."""
    pool = draw_rank(df.where(F.col(dataset) == "train"), sample_id, seed)
    n_val = F.ceil(F.col("group_n") * F.lit(val_frac))
    drawn = pool.select(sample_id, (F.col("draw_rank") <= n_val).alias("_val"))
    marks = heldout.select(*attrs).distinct().withColumn("_held", F.lit(True))
    base = df.join(drawn, sample_id, "left").join(marks, list(attrs), "left")
    held = F.coalesce(F.col("_held"), F.lit(False))
    in_train = F.col("_val").isNotNull() & ~F.coalesce(F.col("_val"), F.lit(False))
    in_val = F.coalesce(F.col("_val"), F.lit(False))
    is_test = F.col(dataset) == "test"
    return base.withColumns(
        {
            "train_index": in_train & ~held,
            "val_index": in_val | (held & ~is_test),
            "test_index": is_test,
        }
    ).drop("_val", "_held")


def matched_draw(
    want: DataFrame,
    pool: DataFrame,
    attrs: Sequence[str],
    seed: int = 42,
    rep_cols: Sequence[str] = (),
    sample_id: str = "sample_id",
    replace: str = "short",
) -> DataFrame:
    """Draw pool rows per condition to match counts in `want` (attrs, rep columns, `n_want`).

    replace='short': with replacement only where the pool is smaller than the
    wish; 'never': at most the pool. Conditions without pool rows are skipped.
    Returns the drawn ids with a `slot` number.
    """
    attrs, rep_cols = list(attrs), list(rep_cols)
    cell = [*attrs, *rep_cols]
    rep = F.concat_ws(",", *[F.col(c).cast("string") for c in rep_cols]) if rep_cols else F.lit("0")
    ids = pool.select(*attrs, sample_id)
    cells = want.select(*cell, "n_want").where(F.col("n_want") > 0)
    ranked = draw_rank(ids.join(cells, attrs), sample_id, seed, cell, rep=rep)
    if replace == "never":
        return ranked.where(F.col("draw_rank") <= F.col("n_want")).select(*cell, F.col("draw_rank").alias("slot"), sample_id)
    # Slot i takes pool row i of the order, or row hash(i) mod n + 1 where the pool is short.
    # Slots are made in chunks that are spread first, so a very large cell is no single task.
    sized = cells.join(ids.groupBy(*attrs).agg(F.count("*").alias("_n")), attrs)
    chunks = sized.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_want") - 1) / SLOT_CHUNK))))
    chunks = chunks.repartition(*cell, "_k")
    first, last = F.col("_k") * SLOT_CHUNK + 1, F.least((F.col("_k") + 1) * SLOT_CHUNK, F.col("n_want"))
    slots = chunks.withColumn("slot", F.explode(F.sequence(first, last)))
    name = F.concat_ws(",", F.concat_ws(",", *[F.col(c).cast("string") for c in attrs]), F.col("slot").cast("string"))
    pick = F.floor(unit_draw(seed, rep, name) * F.col("_n")) + 1
    slots = slots.select(*cell, "slot", F.when(F.col("_n") >= F.col("n_want"), F.col("slot")).otherwise(pick).alias("draw_rank"))
    return slots.join(ranked.select(*cell, "draw_rank", sample_id), [*cell, "draw_rank"]).select(*cell, "slot", sample_id)


def condition_counts(df: DataFrame, attrs: Sequence[str], name: str = "n_want") -> DataFrame:
    return df.groupBy(*attrs).agg(F.count("*").alias(name))


def matched_real_draw(gen: DataFrame, real: DataFrame, attrs: Sequence[str], seed: int = 42, **kw) -> DataFrame:
    """Real rows drawn to the generated rows' condition histogram."""
    return matched_draw(condition_counts(gen, attrs), real, attrs, seed, **kw)


def capped_pair_counts(gen: DataFrame, real: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Per condition round(n_gen*s) with s = min(1, min_c n_real/n_gen): no side is ever repeated."""
    both = condition_counts(gen, attrs, "n_gen").join(condition_counts(real, attrs, "n_real"), list(attrs))
    s = both.agg(F.least(F.lit(1.0), F.min(F.col("n_real") / F.col("n_gen"))).alias("_s"))
    n = F.least(F.bround(F.col("n_gen") * F.col("_s")).cast("long"), F.col("n_gen"), F.col("n_real"))
    return both.join(F.broadcast(s)).withColumn("n_want", n).where(F.col("n_want") > 0).drop("_s")


def matched_capped_pair(
    gen: DataFrame, real: DataFrame, attrs: Sequence[str], seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Equal-histogram draws of both sides without replacement."""
    want = capped_pair_counts(gen, real, attrs).select(*attrs, "n_want")
    return (
        matched_draw(want, gen, attrs, seed, replace="never"),
        matched_draw(want, real, attrs, seed + 1, replace="never"),
    )


def random_baseline(
    accepted: DataFrame,
    gen: DataFrame,
    attrs: Sequence[str],
    reps: int = 5,
    seed: int = 0,
    mode: str = "combo_stratified",
    sample_id: str = "sample_id",
) -> DataFrame:
    """Random generated rows as many as accepted: same per-condition counts, or uniform."""
    if mode == "combo_stratified":
        want = with_reps(condition_counts(accepted, attrs), reps)
        return matched_draw(want, gen, attrs, seed, ["rep"], sample_id, replace="never")
    if mode != "uniform":
        raise ValueError(f"unknown random mode: {mode}")
    n = accepted.agg(F.count("*").alias("_n"))
    ranked = draw_rank(with_reps(gen.select(*attrs, sample_id), reps), sample_id, seed, ["rep"], rep=F.col("rep"))
    return (
        ranked.join(F.broadcast(n)).where(F.col("draw_rank") <= F.col("_n"))
        .select(*attrs, "rep", F.col("draw_rank").alias("slot"), sample_id)
    )


def random_pairs(
    df: DataFrame, n_pairs: int, seed: int = 42, sample_id: str = "sample_id", keys: Sequence[str] = ()
) -> DataFrame:
    """Pairs (i, j) of different rows per group, drawn independently; an equal j moves to the next row."""
    keys = list(keys)
    indexed = draw_rank(df.select(*keys, sample_id), sample_id, seed, keys, name="_ix")
    pairs = df.sparkSession.range(n_pairs)
    if keys:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        groups = sizes.agg(F.collect_list(F.struct(*keys, "_n")).alias("_g"))  # one entry per group: a handful of steps
        pairs = pairs.join(F.broadcast(groups)).withColumn("_e", F.explode("_g")).select("id", "_e.*")
    else:
        pairs = pairs.join(F.broadcast(df.agg(F.count("*").alias("_n"))))
    i = F.floor(unit_draw(seed, 1, "id") * F.col("_n"))
    j = F.floor(unit_draw(seed, 2, "id") * F.col("_n"))
    j = F.when(i == j, (j + 1) % F.col("_n")).otherwise(j)
    pairs = pairs.select(*keys, F.col("id").alias("pair"), (i + 1).alias("_i"), (j + 1).alias("_j"))
    left = indexed.select(*keys, F.col("_ix").alias("_i"), F.col(sample_id).alias("left_id"))
    right = indexed.select(*keys, F.col("_ix").alias("_j"), F.col(sample_id).alias("right_id"))
    return pairs.join(left, [*keys, "_i"]).join(right, [*keys, "_j"]).select(*keys, "pair", "left_id", "right_id")


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count of a uniform column: how often a bootstrap repetition takes the row."""
    cumulative, term, count = 0.0, math.exp(-1.0), F.lit(0).cast("long")
    for k in range(1, 13):
        cumulative += term
        count = count + (u >= F.lit(cumulative)).cast("long")
        term /= k
    return count


def poisson_reps(df: DataFrame, reps: int, seed: int, sample_id: Column | str) -> DataFrame:
    """Each row once per repetition that takes it, with `rep` and its Poisson(1) weight `_w`.

    The draw is the element of an array, so neither the twelve steps of the count nor the filter repeat its hash.
    """
    weight = lambda rep: F.aggregate(F.array(unit_draw(seed, rep, sample_id)), F.lit(0).cast("long"), lambda _, u: poisson_weight(u))
    draws = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), weight)
    return df.select("*", F.posexplode(draws).alias("rep", "_w")).where(F.col("_w") > 0)


def bootstrap_means(
    df: DataFrame, value: str, keys: Sequence[str] = (), reps: int = 1000, seed: int = 42, stat: str = "mean",
    sample_id: str = "sample_id",
) -> DataFrame:
    """Bootstrap 95% interval of a mean (or median) per group.

    Rows get Poisson(1) weights per repetition from their draw key, so each
    repetition is one grouped aggregate and nothing is collected.
    """
    keys = list(keys)
    rows = poisson_reps(df.where(F.col(value).isNotNull()).select(*keys, sample_id, value), reps, seed, sample_id)
    if stat == "mean":
        per_rep = rows.groupBy(*keys, "rep").agg(
            (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("_m")
        )
    else:
        per_rep = rows.groupBy(*keys, "rep").agg(F.percentile(value, F.lit(0.5), F.col("_w")).alias("_m"))
    ends = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    bands = (per_rep.groupBy(*keys) if keys else per_rep.groupBy()).agg(ends.alias("_e"))
    base = df.where(F.col(value).isNotNull())
    centre = F.avg(value) if stat == "mean" else F.median(value)
    point = (base.groupBy(*keys) if keys else base.groupBy()).agg(
        F.count("*").alias("n"), centre.alias(stat)
    )
    out = point.join(bands, keys) if keys else point.join(F.broadcast(bands))
    return out.select(*keys, "n", stat, F.col("_e")[0].alias("ci_low"), F.col("_e")[1].alias("ci_high"))
