"""One report over many configurations: scored rows of all of them are one long table, and every section is one pass over it.

A configuration is a vector space, a generator or a set of attributes with its own scores. Nothing runs per configuration
but its scoring: bins, detection and correlations carry the configuration as a key, and levels of detail are grouping sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import distances as D
from plumbline.operators import ranking as R
from plumbline.operators.conditions import tag_arm
from plumbline.operators.prefix import rank_rows
from plumbline.operators.selection import thresholds
from plumbline.session import cut_lineage

SCORES = ("trust", "realism_z", "faithfulness_z")
RANDOM = "random"
ALL = "all"
COLUMNS = ("section", "config", "arm", "ranking", "bin", "metric", "n", "value")


class Configuration(NamedTuple):
    """Scored rows (sample_id, attributes, scores, features) of both sides; `seen` has the conditions seen in training."""

    name: str
    real: DataFrame
    gen: DataFrame
    attrs: Sequence[str]
    seen: DataFrame | None = None


def scored_rows(configs: Sequence[Configuration]) -> DataFrame:
    """(config, is_gen, arm, condition, sample_id, scores) of all configurations, without vectors.

    Generated rows are seen or unseen by their condition, `all` where a configuration has no set of seen ones; real rows
    stand beside each arm of their configuration.
    """
    parts = []
    for c in configs:
        arms = [ALL] if c.seen is None else ["seen", "unseen"]
        gen = c.gen.withColumn("arm", F.lit(ALL))
        if c.seen is not None:
            gen = tag_arm(c.gen, c.seen.select(*c.attrs).distinct().withColumn("arm", F.lit("seen")), c.attrs)
            gen = gen.withColumn("arm", F.when(F.col("arm") == "seen", "seen").otherwise("unseen"))
        real = c.real.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
        for is_gen, side in ((1, gen), (0, real)):
            parts.append(side.select(
                F.lit(c.name).alias("config"), F.lit(is_gen).alias("is_gen"), "arm", V.format_condition(list(c.attrs)).alias("condition"), "sample_id",
                *[V.finite(s).alias(s) for s in SCORES]))
    return reduce(DataFrame.unionByName, parts)


def condition_distances(configs: Sequence[Configuration]) -> DataFrame:
    """(config, condition, distance): kernel distance of whole conditions, real against generated."""
    parts = [
        D.kid(c.real, c.gen, list(c.attrs)).select(F.lit(c.name).alias("config"), V.format_condition(list(c.attrs)).alias("condition"), F.col("kid").alias("distance"))
        for c in configs
    ]
    return reduce(DataFrame.unionByName, parts)


def _long(rows: DataFrame, *extra: Column) -> DataFrame:
    """One row per score that a row has: `ranking` and `value` in place of the score columns."""
    cells = F.array(*[F.struct(F.lit(s).alias("ranking"), F.col(s).alias("value")) for s in SCORES], *extra)
    keep = [c for c in rows.columns if c not in SCORES]
    return rows.select(*keep, "trust", F.explode(cells).alias("_e")).select(*keep, "trust", "_e.*").where("value is not null")


def _metrics(rows: DataFrame, section: str | Column, names: Sequence[str]) -> DataFrame:
    """Metric columns as rows of the report; key columns that are missing are null."""
    section = F.lit(section) if isinstance(section, str) else section
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("_m")
    keys = [F.col(k) if k in rows.columns else F.lit(None).cast("int" if k == "bin" else "string").alias(k) for k in COLUMNS[1:5]]
    return rows.select(section.alias("section"), *keys, F.col("n").cast("long").alias("n"), cells).select(*COLUMNS[:5], "_m.metric", "n", "_m.value")


def score_bins(rows: DataFrame, n_bins: int = 10, percent: int = 95, seed: int = 42) -> DataFrame:
    """Bins of equal size inside every condition for each score and a random order, at four levels of detail.

    Levels: ranking; arm and ranking; ranking and bin; arm, ranking and bin. `accepted` is the share at or below the
    configuration's real `percent` threshold of trust.
    """
    real = rows.where("is_gen = 0").dropDuplicates(["config", "sample_id"])
    cuts = thresholds(real, "trust", [percent], ["config"]).select("config", "threshold")
    draw = F.struct(F.lit(RANDOM).alias("ranking"), V.unit_draw(seed, 0, "sample_id").alias("value"))
    binned = R.bin_within(_long(rows.where("is_gen = 1"), draw), ["config", "ranking", "condition"], n_bins, "value", at_least_one=True)
    facts = binned.join(F.broadcast(cuts), "config", "left").withColumn("_in", (F.col("trust") <= F.col("threshold")).cast("double"))
    keys = [F.col(k) for k in ("config", "arm", "ranking", "bin")]
    config, arm, ranking, bin_ = keys
    table = facts.groupingSets([[config, ranking], [config, arm, ranking], [config, ranking, bin_], [config, arm, ranking, bin_]], *keys).agg(
        F.count("*").alias("n"), F.avg("trust").alias("trust_mean"), F.min("value").alias("score_min"), F.max("value").alias("score_max"), F.avg("_in").alias("accepted"))
    return _metrics(table, "bins", ["trust_mean", "score_min", "score_max", "accepted"])


def detection(rows: DataFrame) -> DataFrame:
    """Areas under the ROC and PR curves: unseen rows, unseen conditions by mean scores, generated rows per arm; one pass."""
    gen, unseen = rows.where("is_gen = 1"), (F.col("arm") == "unseen").cast("int")
    armed = gen.where(F.col("arm") != ALL)
    cols = ["section", "config", "arm", "ranking", "y", "value"]
    means = armed.groupBy("config", "arm", "condition").agg(*[F.avg(s).alias(s) for s in SCORES])
    said = lambda df, name, y, arm: _long(df).select(F.lit(name).alias("section"), "config", arm.alias("arm"), "ranking", y.alias("y"), "value").select(*cols)
    long = said(armed, "unseen_rows", unseen, F.lit(ALL)).unionByName(said(means, "unseen_conditions", unseen, F.lit(ALL)))
    long = long.unionByName(said(rows, "real_gen", F.col("is_gen"), F.col("arm")))
    table = R.detection_summary(long, "value", "y", ["section", "config", "arm", "ranking"]).withColumn("n", F.col("n_pos") + F.col("n_neg"))
    return _metrics(table, F.col("section"), ["n_pos", "auroc", "auprc"])


def validity(rows: DataFrame, distances: DataFrame, ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Do mean scores rank the conditions as their distances do: correlations, overlap of the best k, gaps of the distance."""
    means = rows.where("is_gen = 1").groupBy("config", "condition").agg(*[F.avg(s).alias(s) for s in SCORES])
    table = cut_lineage(_long(means.join(distances, ["config", "condition"])).where(V.finite("distance").isNotNull()))  # a row per condition and score
    keys = ["config", "ranking"]
    corr = R.spearman(table, "value", "distance", keys).join(R.kendall(table, "value", "distance", keys).drop("n"), keys)
    corr = corr.join(R.pearson_corr(table, "value", "distance", keys).drop("n"), keys)
    ranked = rank_rows(rank_rows(table, [F.col("value"), F.col("condition")], keys, "_a"), [F.col("distance"), F.col("condition")], keys, "_b")
    tall = ranked.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    both, either = F.greatest("_a", "_b") <= F.col("k"), F.least("_a", "_b") <= F.col("k")
    over = tall.groupBy(*keys, "k").agg(F.count("*").alias("n"), (F.count_if(both) / F.count_if(either)).alias("overlap")).where("n >= k")
    named = over.select(F.lit("validity").alias("section"), "config", F.lit(None).cast("string").alias("arm"), "ranking", F.lit(None).cast("int").alias("bin"),
                        F.concat(F.lit("overlap_"), F.col("k")).alias("metric"), F.col("n").cast("long").alias("n"), F.col("overlap").alias("value"))
    own = table.where(F.col("ranking") == SCORES[0])
    step = own.withColumn("_g", F.col("distance") - F.lag("distance").over(Window.partitionBy("config").orderBy("distance", "condition")))  # a row per condition
    gaps = step.groupBy("config").agg(F.count("_g").alias("n"), F.avg("_g").alias("mean_gap"), F.max("_g").alias("max_gap"))
    return _metrics(corr, "validity", ["spearman", "kendall", "pearson"]).unionByName(named).unionByName(_metrics(gaps, "gaps", ["mean_gap", "max_gap"]))


def evaluation_report(configs: Sequence[Configuration], n_bins: int = 10, percent: int = 95, seed: int = 42, distances: DataFrame | None = None) -> DataFrame:
    """The report of all configurations: section, config, arm, ranking, bin, metric, n, value.

    Null scores leave their row out of that ranking; empty sides give no rows. `distances` (config, condition, distance)
    replaces the kernel distances of whole conditions.
    """
    rows = cut_lineage(scored_rows(configs))
    distances = condition_distances(configs) if distances is None else distances
    return score_bins(rows, n_bins, percent, seed).unionByName(detection(rows)).unionByName(validity(rows, distances))
