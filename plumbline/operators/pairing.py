"""Key joins between score, measurement and feature tables, and step sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators.sampling import draw_rank


def stem(path: str):
    """File name without folder and last extension."""
    name = F.substring_index(F.col(path), "/", -1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def join_scores(measurements: DataFrame, scores: DataFrame, path: str, score: str = "trust") -> DataFrame:
    """Measurements with the scores of the same file stem; rows without a score are dropped."""
    keyed = measurements.withColumn("sample_id", stem(path))
    return keyed.join(scores.where(F.col(score).isNotNull() & ~F.isnan(score)), "sample_id")


def pair_spaces(a: DataFrame, b: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows present in both spaces with both vectors."""
    return a.select(key, F.col("features").alias("features_a")).join(
        b.select(key, F.col("features").alias("features_b")), key
    )


def verify_alignment(a: DataFrame, b: DataFrame, attrs: Sequence[str], key: str = "sample_id") -> DataFrame:
    """Rows only in a, only in b, in both, and in both with different attributes."""
    left = a.select(F.col(key), F.struct(*attrs).alias("_a"))
    right = b.select(F.col(key), F.struct(*attrs).alias("_b"))
    both = left.join(right, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("_a") != F.col("_b"))).alias("attr_mismatch"),
    )


def require_alignment(a: DataFrame, b: DataFrame, attrs: Sequence[str], key: str = "sample_id") -> None:
    r = verify_alignment(a, b, attrs, key).first()
    if r["only_left"] or r["only_right"] or r["attr_mismatch"]:
        raise ValueError(f"tables are not aligned: {r.asDict()}")


def paired_cosine(a: DataFrame, b: DataFrame, seed: int | None = None) -> DataFrame:
    """Cosine of the same row in two spaces, summarised; with a seed, of rows paired at random."""
    if seed is None:
        pairs = pair_spaces(a, b)
    else:
        ids = a.select("sample_id").join(b.select("sample_id"), "sample_id")
        one = draw_rank(ids, "sample_id", seed, name="_i").select("_i", "sample_id")
        two = draw_rank(ids, "sample_id", seed + 1, name="_i").select("_i", F.col("sample_id").alias("other_id"))
        left = one.join(two, "_i").join(a.select("sample_id", F.col("features").alias("features_a")), "sample_id")
        pairs = left.join(b.select(F.col("sample_id").alias("other_id"), F.col("features").alias("features_b")), "other_id")
    cos = V.cosine("features_a", "features_b")
    return pairs.select(cos.alias("_c")).agg(
        F.count("*").alias("n"), F.avg("_c").alias("mean_cosine"), F.stddev_pop("_c").alias("std_cosine")
    )


def step_similarity(steps: DataFrame, final: DataFrame) -> DataFrame:
    """Mean and population std of the cosine with the final vector, per step."""
    joined = steps.join(final.select("sample_id", F.col("features").alias("_final")), "sample_id")
    return joined.groupBy("step").agg(
        F.count("*").alias("n"), F.avg(V.cosine("features", "_final")).alias("mean_cosine"),
        F.stddev_pop(V.cosine("features", "_final")).alias("std_cosine"),
    )


def step_distance(steps: DataFrame) -> DataFrame:
    """Mean L2 and mean L1 distance between each step and the next of the same sample."""
    order = Window.partitionBy("sample_id").orderBy("step")
    nxt = steps.withColumns({"_next": F.lead("features").over(order), "next_step": F.lead("step").over(order)})
    return nxt.where(F.col("_next").isNotNull()).groupBy("step", "next_step").agg(
        F.count("*").alias("n"), F.avg(V.l2_distance("features", "_next")).alias("mean_l2"),
        F.avg(V.l1_distance("features", "_next")).alias("mean_l1"),
    )


def pool_patches(df: DataFrame, how: str = "mean", patches: str = "patches") -> DataFrame:
    """(P, D) patch arrays to one D vector: mean, max, or the first ('cls') patch. No shuffle."""
    p = F.col(patches)
    if how == "cls":
        pooled = p[0]
    elif how in ("mean", "max"):
        merge = (lambda a, b: a + b) if how == "mean" else (lambda a, b: F.greatest(a, b))
        pooled = F.aggregate(F.slice(p, 2, F.size(p)), p[0], lambda acc, v: F.zip_with(acc, v, merge))
        if how == "mean":
            pooled = F.transform(pooled, lambda v: v / F.size(p))
    else:
        raise ValueError(f"unknown pooling {how!r}")
    return df.withColumn("features", pooled)
