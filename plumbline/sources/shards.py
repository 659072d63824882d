"""Put sharded vector tables together under one index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import rank_rows


def index_names(names: DataFrame, name: str = "name") -> DataFrame:
    """0-based index of file names in sorted order."""
    ranked = rank_rows(names, [F.col(name)], (), "global_idx")
    return ranked.withColumn("global_idx", F.col("global_idx") - 1)


def consolidation_report(shards: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate shard keys, index keys without a shard row, and shard keys outside the index."""
    keys = list(keys)
    counts = shards.groupBy(*keys).agg(F.count("*").alias("_n"))
    both = counts.join(index.select(*keys).withColumn("_i", F.lit(1)), keys, "full_outer")
    return both.agg(
        F.count_if(F.col("_n") > 1).alias("duplicates"), F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_i").isNull()).alias("extra"),
    )


def consolidate_shards(shards: DataFrame, index: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Index rows with their shard vectors; duplicated shard keys are an error, missing ones stay out."""
    report = consolidation_report(shards, index, keys).first()
    if report["duplicates"]:
        raise ValueError(f"{report['duplicates']} duplicated shard keys")
    return index.join(shards, list(keys))


def round_robin_shard(df: DataFrame, n: int, order: str = "sample_id") -> DataFrame:
    """Shard number i of every n-th row in sorted order."""
    ranked = rank_rows(df, [F.col(order)], (), "_rn")
    return ranked.withColumn("shard", ((F.col("_rn") - 1) % n).cast("int")).drop("_rn")


def merge_shards(parts: Sequence[DataFrame], names: DataFrame, key: str = "sample_id") -> DataFrame:
    """Union of the shards; an error unless every name occurs exactly once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    counts = out.groupBy(key).agg(F.count("*").alias("_n"))
    bad = counts.join(names.select(key).withColumn("_i", F.lit(1)), key, "full_outer").where(
        F.col("_n").isNull() | (F.col("_n") > 1) | F.col("_i").isNull()
    )
    if not bad.isEmpty():
        raise ValueError("shards do not match the name list")
    return out


def upsert_by_condition(base: DataFrame, delta: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Base without the conditions the delta has, plus the delta."""
    keys = delta.select(*attrs).distinct()
    return base.join(keys, list(attrs), "left_anti").unionByName(delta)


def relabel_attributes(df: DataFrame, position_of: dict[str, dict[str, int]], model: str = "model", cond: str = "cond") -> DataFrame:
    """Named attribute columns from a positional condition array, whose order depends on the model.

    `position_of`: model -> attribute -> 0-based position.
    """
    attrs = sorted({a for m in position_of.values() for a in m})

    def pick(attr: str) -> Column:
        out = F.lit(None).cast("int")
        for name, places in position_of.items():
            out = F.when(F.col(model) == name, F.get(F.col(cond), places[attr]).cast("int")).otherwise(out)
        return out

    return df.withColumns({a: pick(a) for a in attrs})
