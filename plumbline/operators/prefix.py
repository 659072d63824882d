"""Ranks, running sums and exact percentiles that survive hot keys.

Small groups use an ordinary window. When a group is larger than the window
limit, rows are range-partitioned on (keys, order), written once so that the
partitions are fixed, summed per partition and shifted by the total of the
partitions before them; no task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import WINDOW_ROWS, cut_lineage, limit


def groups_fit(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether every group stays below the window limit.

    A plan whose estimated size is below 8 bytes per allowed row needs no
    look; else one map-side combined count decides.
    """
    most = limit(df.sparkSession, WINDOW_ROWS)
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) <= 8 * most:
        return True
    if not keys:
        return df.count() <= most
    row = df.groupBy(*keys).count().agg(F.max("count")).first()
    return int(row[0] or 0) <= most


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, Column],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums within each key group, in `order` (a total order)."""
    keys = list(keys)
    if groups_fit(df, keys):
        window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(col).over(window) for name, col in sums.items()})

    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    ranged = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id()))
    totals = ranged.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    # One row per (partition, key run): its size follows partitions + keys, not rows.
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_pid")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy("_pid", *keys).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    right = offsets.select(
        F.col("_pid").alias("_rp"), *[F.col(k).alias(f"_rk_{k}") for k in keys], *[f"_o_{n}" for n in sums]
    )
    match = F.col("_pid") == F.col("_rp")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_rk_{k}"))
    joined = local.join(right, match, "inner")
    out = joined.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
    return out.drop("_pid", "_rp", *[f"_rk_{k}" for k in keys], *[f"_o_{n}" for n in sums])


def rank_rows(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rn") -> DataFrame:
    """1-based row number within each key group, in `order` (a total order)."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, keys)


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks with ties averaged, computed on distinct values and joined back."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_sums(counts, [F.col(value)], {"_upto": F.col("_n")}, keys)
    ranks = ranked.select(*keys, value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return df.join(ranks, [*keys, value], "left")


def percentiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), name: str = "pct"
) -> DataFrame:
    """Exact linear-interpolated percentiles as an array column, plus the count `n`.

    Equal values are combined first; the built-in aggregate is used while the
    distinct values of a group fit one buffer, ordered ranks beyond that.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    if groups_fit(counts, keys):
        grouped = counts.groupBy(*keys) if keys else counts.groupBy()
        array = F.array(*[F.lit(float(p)) for p in probs])
        return grouped.agg(F.percentile("_v", array, F.col("_n")).alias(name), F.sum("_n").alias("n"))
    upto = running_sums(counts, [F.col("_v")], {"_upto": F.col("_n")}, keys)
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("n")) if keys else counts.agg(F.sum("_n").alias("n"))
    wanted = sizes.select(
        *keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p")
    ).select(
        *keys, "n", "_i",
        F.floor((F.col("n") - 1) * F.col("_p")).alias("_lo"),
        F.ceil((F.col("n") - 1) * F.col("_p")).alias("_hi"),
        ((F.col("n") - 1) * F.col("_p")).alias("_at"),
    )
    # `wanted` has one row per group and probability; each keeps at most two value rows.
    covers = (F.col("_lo") < F.col("_upto")) & (F.col("_lo") >= F.col("_upto") - F.col("_n"))
    covers_hi = (F.col("_hi") < F.col("_upto")) & (F.col("_hi") >= F.col("_upto") - F.col("_n"))
    # Null is a key like any other, as it is in the grouping above.
    named = wanted.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = [upto[k].eqNullSafe(named[f"_key{i}"]) for i, k in enumerate(keys)]
    both = upto.join(named, same, "inner") if keys else upto.join(F.broadcast(wanted))
    hits = both.where(covers | covers_hi).groupBy(*keys, "_i").agg(
        F.max(F.when(covers, F.col("_v"))).alias("_a"),
        F.max(F.when(covers_hi, F.col("_v"))).alias("_b"),
        F.first("_at").alias("_at"), F.first("_lo").alias("_lo"), F.first("n").alias("n"),
    )
    point = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.col("_lo"))
    grouped = hits.groupBy(*keys) if keys else hits.groupBy()
    return grouped.agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", point.alias("v")))), lambda s: s["v"]).alias(name),
        F.first("n").alias("n"),
    )
