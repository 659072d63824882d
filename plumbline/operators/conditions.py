"""Condition sets: filters, arms, categories, subsets and the nearest-condition join."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.prefix import rank_rows
from plumbline.session import BROADCAST_BYTES, cut_lineage, limit


def filter_seen(df: DataFrame, seen: DataFrame | None, attrs: Sequence[str]) -> DataFrame:
    """Rows whose joint condition is in `seen`; no set, or an empty one, keeps all rows."""
    if seen is None or seen.isEmpty():
        return df
    return df.join(seen.select(*attrs).distinct(), list(attrs), "left_semi")


def filter_pairs(df: DataFrame, subset: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Strict joint filter."""
    return df.join(subset.select(*attrs).distinct(), list(attrs), "left_semi")


def filter_scoring_pool(df: DataFrame, subset: DataFrame, attr: str) -> DataFrame:
    """Rows whose value of one attribute occurs in the subset."""
    return df.join(subset.select(attr).distinct(), attr, "left_semi")


def exclude_heldout(conditions: DataFrame, heldout: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Seen conditions: all distinct ones minus the held-out ones."""
    return conditions.select(*attrs).distinct().join(heldout.select(*attrs).distinct(), list(attrs), "left_anti")


def available_conditions(df: DataFrame, attrs: Sequence[str], category: str, split: str | None = None) -> DataFrame:
    """Row counts per condition and category inside a split."""
    base = df.where(F.col(split)) if split else df
    return base.groupBy(*attrs, category).agg(F.count("*").alias("n"))


def filter_by_attribute_lists(df: DataFrame, wanted: Mapping[str, Sequence]) -> DataFrame:
    """OR within an attribute, AND across attributes; attributes without values do not filter."""
    for attr, values in wanted.items():
        if values:
            df = df.where(F.col(attr).isin(list(values)))
    return df


def matching_samples(
    df: DataFrame, equal: Mapping[str, object], max_rows: int | None = None, order: str = "sample_id"
) -> DataFrame:
    """Rows equal on any subset of attributes; the first `max_rows` in stored order."""
    for attr, value in equal.items():
        df = df.where(F.col(attr) == F.lit(value))
    return df.orderBy(order).limit(max_rows) if max_rows is not None else df


def tag_arm(df: DataFrame, arms: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Add arm: the condition's arm, or 'outside'."""
    tagged = df.join(arms.select(*attrs, "arm"), list(attrs), "left")
    return tagged.withColumn("arm", F.coalesce("arm", F.lit("outside")))


def finite_scores(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        value = F.col(c).cast("double")
        df = df.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))
    return df


def eligible_conditions(
    df: DataFrame, attrs: Sequence[str], min_count: int = 4, top: int = 16, cap: int = 128, order: str = "sample_id"
) -> DataFrame:
    """Up to `cap` stored-order rows of each of the `top` most frequent conditions with enough rows."""
    attrs = list(attrs)
    counts = df.groupBy(*attrs).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    best = counts.orderBy(F.desc("n"), *attrs).limit(top)
    # row_number <= constant is pushed below the shuffle as a per-partition group limit.
    place = F.row_number().over(Window.partitionBy(*attrs).orderBy(order))
    return df.join(best, attrs).withColumn("place", place).where(F.col("place") <= cap)


def condition_catalog(df: DataFrame, attrs: Sequence[str], mode: str = "observed") -> DataFrame:
    """All value combinations: 'binary' gives 0/1 per attribute, 'observed' the distinct values found."""
    if mode == "binary":
        out = df.sparkSession.range(1).select()
        for a in attrs:
            out = out.withColumn(a, F.explode(F.array(F.lit(0), F.lit(1))))
        return out
    # One row with the sorted value list of every attribute; exploding them gives the product.
    values = df.agg(*[F.sort_array(F.collect_set(a)).alias(f"_{a}") for a in attrs])
    for a in attrs:
        values = values.withColumn(a, F.explode(f"_{a}"))
    return values.select(*attrs)


def composition_category(df: DataFrame, attrs: Sequence[str], train: str = "train_index", rare: int = 20) -> DataFrame:
    """Category by the condition's training count: none 'unseen', below `rare` 'rare', else 'seen'."""
    counts = df.where(F.col(train)).groupBy(*attrs).agg(F.count("*").alias("_n"))
    category = F.when(F.col("_n").isNull(), "unseen").when(F.col("_n") < rare, "rare").otherwise("seen")
    return df.join(counts, list(attrs), "left").withColumn("comp_category", category).drop("_n")


def move_heldout(
    train: DataFrame, val: DataFrame, heldout: DataFrame, attrs: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Held-out conditions leave train and join validation."""
    marks, attrs = heldout.select(*attrs).distinct(), list(attrs)
    return train.join(marks, attrs, "left_anti"), val.unionByName(train.join(marks, attrs, "left_semi"))


def top_k_conditions(df: DataFrame, attrs: Sequence[str], k: int) -> DataFrame:
    """The k most frequent conditions with their counts, most frequent first, then by attributes."""
    return df.groupBy(*attrs).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *attrs).limit(k)


def attribute_totals(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Row totals of every single attribute value in one pass (one grouping set per attribute)."""
    entries = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
    counts = df.groupBy(*attrs).agg(F.count("*").alias("n")).withColumn("e", F.explode(entries))
    return counts.groupBy("e.attr", "e.value").agg(F.sum("n").alias("n"))


def pick_stratified_subset(
    counts: DataFrame, strata: Sequence[tuple[str, Column, int]], attrs: Sequence[str]
) -> DataFrame:
    """Per stratum (name, predicate, quota) the conditions with most rows, ties by attributes.

    A condition belongs to the first stratum whose predicate holds.
    """
    stratum, quota = F.lit(None).cast("string"), F.lit(0)
    for name, predicate, n in reversed(list(strata)):
        stratum = F.when(predicate, name).otherwise(stratum)
        quota = F.when(predicate, n).otherwise(quota)
    tagged = counts.withColumn("stratum", stratum).withColumn("_q", quota).where(F.col("stratum").isNotNull())
    ranked = rank_rows(tagged, [F.desc("n"), *[F.col(a) for a in attrs]], ["stratum"], "place")
    return ranked.where(F.col("place") <= F.col("_q")).drop("_q")


def class_map(conditions: DataFrame, attrs: Sequence[str], name: str = "class_id") -> DataFrame:
    """Ids 0.. of the distinct conditions in sorted order."""
    ranked = rank_rows(conditions.select(*attrs).distinct(), [F.col(a) for a in attrs], (), name)
    return ranked.withColumn(name, (F.col(name) - 1).cast("int"))


def contiguous_labels(train: DataFrame, other: DataFrame, label: str, name: str = "y") -> DataFrame:
    """Labels of `other` mapped to the training labels' ids; labels not in training become -1."""
    ids = class_map(train, [label], name)
    return other.join(ids, label, "left").withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def rarity_weight(
    df: DataFrame, attrs: Sequence[str], rare: int, common: int, low: float = 1.0, high: float = 5.0
) -> DataFrame:
    """Weight `high` at or below `rare` rows per condition, `low` at or above `common`, linear between."""
    counts = df.groupBy(*attrs).agg(F.count("*").alias("cond_n"))
    slope = (F.col("cond_n") - rare) / F.lit(float(max(common - rare, 1)))
    weight = (
        F.when(F.col("cond_n") >= common, F.lit(low))
        .when(F.col("cond_n") <= rare, F.lit(high))
        .otherwise(F.lit(high) + slope * F.lit(low - high))
    )
    return df.join(counts, list(attrs)).withColumn("weight", weight)


# Keys a condition may take in one round of the nearest-condition join.
KEYS = 256
# Rows of either side that a task compares pair by pair, and left rows of these at a time.
BLOCK = 4096
CHUNK = 128
# What a key or a candidate of the join costs, in pairs compared in a block.
CANDIDATE = 200


def agreement_keys(attrs: Sequence[str], choices: Sequence[Sequence[str]], values: str | None = None) -> Column:
    """Per choice of attributes the name of the choice and its values (columns, or one array of texts); nulls agree with nulls.

    The choices are one constant, so that the plan does not grow with them.
    """
    place = {a: i for i, a in enumerate(attrs)}
    texts = F.col(values) if values else F.array(*[F.col(a).cast("string") for a in attrs])
    plain = F.transform(texts, lambda t: F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")))
    chosen = F.from_json(F.lit(json.dumps([[place[a] for a in c] for c in choices])), "array<array<int>>")

    def keys(v: Column) -> Column:
        return F.transform(chosen, lambda c, i: F.md5(F.concat(i, F.lit("|"), F.array_join(F.transform(c, lambda j: F.get(v, j)), "|"))))

    # Bound to a variable, the texts are made once a row and not once a key.
    return F.transform(F.array(plain), keys)[0]


def nearest_condition(
    wanted: DataFrame, usable: DataFrame, attrs: Sequence[str], ties: bool = False
) -> DataFrame:
    """Nearest usable condition by Hamming distance: the smallest one, or every tied one.

    Two conditions at distance d agree on len(attrs)-d attributes, so the join
    is an equi-join on agreeing attribute subsets, not a comparison of all
    pairs. More attributes than `KEYS` has subsets for go to
    `nearest_by_radius`. A null agrees with a null. Output: wanted attrs,
    `near_<attr>`, `hamming`; no row without usable conditions.
    """
    attrs = list(attrs)
    if 2 ** len(attrs) > KEYS:
        return nearest_by_radius(wanted, usable, attrs, ties)
    left = wanted.select(*attrs).distinct().select(F.struct(*attrs).alias("_w"), *attrs)
    right = usable.select(*attrs).distinct()
    subsets = [c for size in range(len(attrs), -1, -1) for c in combinations(attrs, size)]
    distances = F.from_json(F.lit(json.dumps([len(attrs) - len(c) for c in subsets])), "array<int>")

    def keyed(df: DataFrame, column: Column) -> DataFrame:
        out = df.select(column, F.posexplode(agreement_keys(attrs, subsets)).alias("_i", "cell"))
        return out.withColumn("hamming", F.get(distances, "_i")).drop("_i")

    near = F.struct(*attrs).alias("near")
    # One row per agreeing subset on the usable side, so the best distance needs no pairs.
    first = keyed(right, near).groupBy("cell").agg(F.min("near").alias("near"))
    best = keyed(left, F.col("_w")).join(first, "cell").groupBy("_w").agg(F.min(F.struct("hamming", "near")).alias("_b"))
    if not ties:
        return _near_columns(best.select("_w", "_b.near", "_b.hamming"), attrs)
    at_best = keyed(left, F.col("_w")).join(best.select("_w", "_b.hamming"), ["_w", "hamming"])
    return _near_columns(at_best.join(keyed(right, near).drop("hamming"), "cell"), attrs).distinct()


def _near_columns(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("_w")[a].alias(a) for a in attrs], *[F.col("near")[a].alias(f"near_{a}") for a in attrs], "hamming")


def radii(n: int) -> list[int]:
    """Distances up to which the rounds search: by one, then by a half more, then all."""
    out = [0]
    while out[-1] < n:
        out.append(min(n, max(out[-1] + 1, out[-1] * 3 // 2)))
    return out


def agreeing_choices(sizes: Mapping[str, int], radius: int, most: int = KEYS) -> tuple[int, list[tuple[str, ...]]]:
    """Attribute choices of which two conditions within `radius` agree on at least one, and the number of blocks.

    The attributes are dealt into m blocks; at most `radius` of them differ, so
    m - radius blocks agree. m is the largest with C(m, radius) <= `most`: more
    blocks mean longer agreements and fewer chance candidates. Blocks are
    evened out by the logarithm of the attributes' numbers of values.
    """
    if radius >= len(sizes):
        return len(sizes), [()]
    m = max([k for k in range(radius + 1, len(sizes) + 1) if comb(k, radius) <= most], default=radius + 1)
    blocks: list[list[str]] = [[] for _ in range(m)]
    weight = [0.0] * m
    for a in sorted(sizes, key=lambda a: (-sizes[a], a)):
        at = min(range(m), key=lambda i: (weight[i], len(blocks[i]), i))
        blocks[at].append(a)
        weight[at] += log(max(sizes[a], 1)) + 1e-3
    return m, [tuple(a for i in c for a in blocks[i]) for c in combinations(range(m), m - radius)]


def bit_planes(codes: np.ndarray, bits: int) -> np.ndarray:
    """(bits, words, rows) of codes(rows, attributes): bit p of 64 attributes' codes in a word."""
    rows, width = codes.shape
    out = np.zeros((bits, -(-width // 64), rows), np.uint64)
    for p in range(bits):
        for j in range(width):
            out[p, j // 64] |= ((codes[:, j] >> p) & 1).astype(np.uint64) << np.uint64(j % 64)
    return out


def disagreements(left: pa.ChunkedArray, right: pa.ChunkedArray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of attributes in which rows of two columns of value lists differ: (first left row, left rows x right rows) per chunk."""
    flat = pa.chunked_array([c.flatten() for c in (*left.chunks, *right.chunks)]).combine_chunks()
    coded = flat.dictionary_encode(null_encoding="encode")
    codes = coded.indices.to_numpy(zero_copy_only=False).reshape(-1, width)
    bits = max(1, int(len(coded.dictionary) - 1).bit_length())
    x, y = bit_planes(codes[: len(left)], bits), bit_planes(codes[len(left):], bits)
    for at in range(0, len(left), CHUNK):
        total = 0
        for w in range(x.shape[1]):
            differ = x[0, w, at:at + CHUNK, None] ^ y[0, w, None, :]
            for p in range(1, bits):
                differ |= x[p, w, at:at + CHUNK, None] ^ y[p, w, None, :]
            total = total + np.bitwise_count(differ).astype(np.int32)
        yield at, total


def nearest_in_blocks(open_: DataFrame, right: DataFrame, width: int, n_open: int, n_right: int, ties: bool) -> DataFrame:
    """(_l, _r, hamming) of the nearest rows of right(_r, _n) for each row of open_(_l, _v): all pairs, block against block.

    A task holds `BLOCK` rows of either side, and per row only the nearest of a block (the smallest `_r`, or all tied) leave it.
    """
    across, down = -(-n_open // BLOCK), -(-n_right // BLOCK)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ls, rs, ds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        if asked.num_rows and held.num_rows:
            held = held.sort_by("_r")
            l, r = asked.column("_l").to_numpy(), held.column("_r").to_numpy()
            for at, gap in disagreements(asked.column("_v"), held.column("_n"), width):
                least = gap.min(axis=1)
                i, j = np.nonzero(gap == least[:, None]) if ties else (np.arange(len(gap)), gap.argmin(axis=1))
                ls.append(l[at + i])
                rs.append(r[j])
                ds.append(least[i])
        return pa.table({"_l": np.concatenate(ls), "_r": np.concatenate(rs), "hamming": np.concatenate(ds)})

    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = open_.select("_l", "_v", part("_l", across).alias("x"), each(down).alias("y"))
    held = right.select("_r", "_n", part("_r", down).alias("y"), each(across).alias("x"))
    return asked.groupBy("x", "y").cogroup(held.groupBy("x", "y")).applyInArrow(run, "_l bigint, _r bigint, hamming int")


def nearest_by_radius(wanted: DataFrame, usable: DataFrame, attrs: Sequence[str], ties: bool = False) -> DataFrame:
    """`nearest_condition` for many attributes: rounds of growing radius over the conditions not yet settled.

    A round joins on the values of agreeing blocks (`agreeing_choices`), so it
    finds every usable condition within its radius; a condition whose nearest
    candidate is that near is settled. A round of one-attribute blocks, one
    farther than the last, measures nothing: whatever shares a key has exactly
    the round's distance. Another round runs only while its keys and candidates
    cost less than all pairs; the conditions still open then are compared with
    all usable ones (`nearest_in_blocks`). Rows travel by number (usable ones
    in the order of their values) and never in a broadcast.
    """
    attrs = list(attrs)
    values = F.array(*[F.col(a).cast("string") for a in attrs])
    asked = wanted.select(*attrs).distinct().select(F.struct(*attrs).alias("_w"), values.alias("_v"))
    asked = cut_lineage(asked.withColumn("_l", F.monotonically_increasing_id()))
    right = usable.select(*attrs).distinct().select(F.struct(*attrs).alias("near"), values.alias("_n"))
    right = cut_lineage(right.orderBy("near").withColumn("_r", F.monotonically_increasing_id()))
    *counts, n_usable = right.agg(*[F.approx_count_distinct(F.col("_n")[i]) for i in range(len(attrs))], F.count("*")).first()
    sizes = dict(zip(attrs, counts))
    open_, n_open, done, last = asked.select("_l", "_v"), asked.count(), [], -1
    apart = F.size(F.filter(F.zip_with("_v", "_n", lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    for radius in radii(len(attrs)):
        if not n_open or not n_usable:
            break
        blocks, choices = agreeing_choices(sizes, radius)
        exact = blocks == len(attrs) and radius == last + 1
        asking = open_.select("_l", F.explode(agreement_keys(attrs, choices, "_v")).alias("cell"))
        known = right.select("_r", F.explode(agreement_keys(attrs, choices, "_n")).alias("cell"))
        if not exact:
            cost = CANDIDATE * len(choices) * (n_open + n_usable)
            if cost < n_open * n_usable:  # the candidates are counted before they are formed
                per = lambda df, n: df.groupBy("cell").agg(F.count("*").cast("double").alias(n))
                cost += CANDIDATE * (per(asking, "p").join(per(known, "q").hint("merge"), "cell").agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0)
            if cost >= n_open * n_usable:
                done.append(_least(nearest_in_blocks(open_, right.select("_r", "_n"), len(attrs), n_open, n_usable, ties), ties))
                break
        elif not ties:
            known = known.groupBy("cell").agg(F.min("_r").alias("_r"))
        found = asking.join(known.hint("merge"), "cell").drop("cell")
        if exact:
            found = found.withColumn("hamming", F.lit(radius))
        else:
            found = found.distinct().join(open_.hint("merge"), "_l").join(right.select("_r", "_n").hint("merge"), "_r")
            found = found.select("_l", "_r", apart.alias("hamming")).where(F.col("hamming") <= radius)
        done.append(_least(found, ties))
        last = radius
        open_ = cut_lineage(open_.join(done[-1].select("_l").distinct().hint("merge"), "_l", "left_anti"))
        n_open = open_.count()
    none = asked.select("_l", F.lit(0).cast("bigint").alias("_r"), F.lit(0).alias("hamming")).limit(0)
    found = reduce(DataFrame.unionByName, done, none).join(right.select("_r", "near").hint("merge"), "_r")
    return _near_columns(found.join(asked.select("_l", "_w").hint("merge"), "_l"), attrs)


def _least(found: DataFrame, ties: bool) -> DataFrame:
    """The nearest rows of (_l, _r, hamming) per `_l`: the smallest `_r`, or all tied."""
    if ties:
        found = cut_lineage(found)
        one = found.join(found.groupBy("_l").agg(F.min("hamming").alias("hamming")).hint("merge"), ["_l", "hamming"]).distinct()
    else:
        one = found.groupBy("_l").agg(F.min(F.struct("hamming", "_r")).alias("_b")).select("_l", "_b.hamming", "_b._r")
    return cut_lineage(one.select("_l", "_r", "hamming"))


def table_bytes(df: DataFrame, width: int) -> int:
    """Upper bound of a table's size from its row count and a row width."""
    return df.count() * width


def fits_broadcast(df: DataFrame, width: int) -> bool:
    return table_bytes(df, width) <= limit(df.sparkSession, BROADCAST_BYTES)
