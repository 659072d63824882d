"""Scoring and acceptance monitoring on arriving vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scoring import Model, score_from_components


def score_stream(stream: DataFrame, model: Model, threshold: float) -> DataFrame:
    """Scores with an accept / abstain decision; stateless, so the plan is the batch plan."""
    scored = score_from_components(stream, model)
    ok = F.coalesce(F.col("trust") <= F.lit(threshold), F.lit(False))
    return scored.withColumn("decision", F.when(ok, "accept").otherwise("abstain"))


def acceptance_monitor(
    stream: DataFrame, attrs: Sequence[str], ts: str = "ts", width: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Accepted rows and rate per time window and condition; rows later than the watermark are dropped."""
    ok = F.col("decision") == "accept"
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("w"), *attrs)
        .agg(F.count("*").alias("n"), F.count_if(ok).alias("n_accepted"))
        .select(
            F.col("w.start").alias("window_start"), *attrs, "n", "n_accepted", (F.col("n_accepted") / F.col("n")).alias("rate")
        )
    )
