"""Sharding by a weighted hash tree: region, rack and shard are each drawn among the children of the node above.

DataFrame functions only. A child's draw is -ln(u) / weight with u from a hash of row key and child, the least draw wins
(so a child wins in proportion to its weight), and a draw depends on no other child. A change of weights therefore moves
rows into or out of the changed subtree only; what stays in other subtrees is drawn as before.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import text as X


class Tree(NamedTuple):
    """Weights of shards, and the rack of each shard and the region of each rack, all numbered from 0."""

    weights: tuple[float, ...]
    rack_of: tuple[int, ...]
    region_of: tuple[int, ...]
    seed: int = 7

    def levels(self) -> tuple[dict[int, list[tuple[int, float]]], ...]:
        """Children with their weights per parent: regions under 0, racks per region, shards per rack."""
        racks = [0.0] * len(self.region_of)
        for shard, rack in enumerate(self.rack_of):
            racks[rack] += self.weights[shard]
        regions = [0.0] * (max(self.region_of, default=-1) + 1)
        for rack, region in enumerate(self.region_of):
            regions[region] += racks[rack]
        below: tuple[dict[int, list[tuple[int, float]]], ...] = ({}, {}, {})
        for level, (parents, sizes) in enumerate((([0] * len(regions), regions), (self.region_of, racks), (self.rack_of, self.weights))):
            for child, (parent, weight) in enumerate(zip(parents, sizes)):
                if weight > 0:
                    below[level].setdefault(parent, []).append((child, float(weight)))
        return below


def uniform_tree(shards: int, per_rack: int = 5, racks_per_region: int = 2, seed: int = 7) -> Tree:
    """Shards of weight 1 in full racks and regions, in order; a shard after full regions opens a region of its own.

    Adding a shard that opens a region moves rows only into that shard. One added to a region that is there already draws
    rows into that region, and only there may they also be dealt anew.
    """
    rack = tuple(s // per_rack for s in range(shards))
    return Tree((1.0,) * shards, rack, tuple(r // racks_per_region for r in range(max(rack, default=-1) + 1)), seed)


def draw(tree: Tree, key: Column) -> Column:
    """Shard of a key: three draws, each among the children of the node drawn before."""
    node: Column = F.lit(0)
    for level, below in enumerate(tree.levels()):
        parents = max(below) + 1
        children = F.expr("array(" + ", ".join(
            "array(" + ", ".join(f"named_struct('id', {c}, 'w', {w!r}D)" for c, w in below.get(p, [])) + ")" if p in below
            else "cast(array() as array<struct<id:int,w:double>>)" for p in range(parents)) + ")")

        node = F.array_min(F.transform(children[node], straw(tree.seed, level, key)))["id"]
    return node


def straw(seed: int, level: int, key: Column) -> Callable[[Column], Column]:
    """A child's draw for a key, and the child."""

    def drawn(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(level), child["id"], key)), 1, 13), 16, 10)
        u = (bits.cast("double") + 0.5) / float(1 << 52)
        return F.struct((-F.ln(u) / child["w"]).alias("draw"), child["id"].alias("id"))

    return drawn


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """`docs` with the shard of each row; rows with equal keys, null among them, share a shard. A column `out` is replaced."""
    return docs.withColumn(out, draw(tree, F.coalesce(F.col(key).cast("string"), F.lit(""))))


def with_slots(rows: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """`rows` with a gapless number from 0 inside each shard, in the given order; a column `out` is replaced, all others stay.

    Rows are dealt by range of (shard, order, row number), so equal keys do not gather; a slot is the number of rows of the
    shard in earlier ranges plus the rank inside the range. No task sorts a shard.
    """
    rows = rows.drop(out)
    row, part, before, rank = (X.free_name(c, rows.columns) for c in ("__row", "__range", "__before", "__rank"))
    dealt = X.written(
        rows.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(shard, *order, row).withColumn(part, F.spark_partition_id()),
        "slots")
    ranges = dealt.groupBy(shard, part).agg(F.count("*").alias(rank))
    earlier = ranges.withColumn(before, F.sum(rank).over(Window.partitionBy(shard).orderBy(part)) - F.col(rank)).drop(rank)
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(shard, part).orderBy(*order, row)))
    return ranked.join(earlier, [shard, part]).withColumn(out, (F.col(before) + F.col(rank) - 1).cast("long")).select(*rows.columns, out)


def shard_table(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row; grown_shard is the shard with one shard more.

    Size is the UTF-8 bytes of the text plus 16; null text counts as empty. Slots follow key, checksum and size.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(key, (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    placed = assign(assign(slim, uniform_tree(shards), key, "shard"), uniform_tree(shards + 1), key, "grown_shard")
    return with_slots(placed, "shard", [key, "text_crc32", "size"])
