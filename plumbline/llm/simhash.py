"""SimHash fingerprints and Hamming search, with DataFrame functions only.

A term is a pair of neighbouring words, weighted by its length and, since every occurrence votes, by its frequency. The
votes of 64 bits are kept as 32 sums of two 32-bit lanes, so they are ordinary codegen sums of one exploded row per term.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import text as X

BITS = 64
MOST_WEIGHT = 24
LANES = "4294967297L"  # 1 in both 32-bit lanes


def fingerprints(rows: DataFrame, keys: list[str], text: str, out: str = "fp") -> DataFrame:
    """(keys, fp) per distinct key: bit b is set where the terms with bit b set in their hash outweigh the others.

    Texts without words give 0. Rows are grouped by the keys; where they are dealt by some of these, nothing is shuffled.
    """
    words = rows.select(*keys, F.expr(f"filter(split(`{text}`, '[\\\\x09-\\\\x0D\\\\x20]+'), w -> w <> '')").alias("__w"))
    terms = words.select(*keys, F.explode_outer(F.arrays_zip(F.col("__w").alias("a"), F.expr("slice(__w, 2, greatest(size(__w), 1))").alias("b"))).alias("__t"))
    weight = F.least(F.octet_length("__t.a") + F.coalesce(F.octet_length("__t.b"), F.lit(0)), F.lit(MOST_WEIGHT)).cast("long")
    votes = terms.select(*keys, F.when(F.col("__t.a").isNotNull(), F.xxhash64("__t.a", "__t.b")).alias("__h"), weight.alias("__v"))
    sums = [F.expr(f"sum((shiftrightunsigned(__h, {k}) & {LANES}) * __v)").alias(f"__s{k}") for k in range(BITS // 2)]
    total = votes.groupBy(*keys).agg(F.sum("__v").alias("__all"), *sums)
    bits = [f"if(2 * (__s{k} & 4294967295L) > __all, shiftleft(1L, {k}), 0L)" for k in range(32)]
    bits += [f"if(2 * shiftrightunsigned(__s{k}, 32) > __all, shiftleft(1L, {k + 32}), 0L)" for k in range(32)]
    return total.select(*keys, F.coalesce(F.expr(" | ".join(bits)), F.lit(0)).cast("long").alias(out))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1.0 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / float(BITS)


def hex_of(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def next_rows(keyed: DataFrame, id_col: str, mark: str) -> DataFrame:
    """For distinct (id, mark), `next_id` and `next_mark` in ascending order; after the last comes the first.

    Rows are dealt by range; inside a range the next row is the next, at its end the first row of the next range.
    """
    dealt = X.written(keyed.distinct().repartitionByRange(id_col, mark).withColumn("__range", F.spark_partition_id()), "order")
    here = F.struct(F.col(id_col).alias("i"), F.col(mark).alias("m"))
    firsts = dealt.groupBy("__range").agg(F.min(here).alias("__first"))
    ranges = Window.orderBy("__range")
    after = firsts.select("__range", F.coalesce(F.lead("__first").over(ranges), F.first("__first").over(ranges)).alias("__after"))
    inside = Window.partitionBy("__range").orderBy(id_col, mark)
    found = dealt.withColumn("__next", F.lead(here).over(inside)).join(after, "__range").withColumn("__next", F.coalesce("__next", "__after"))
    return found.select(id_col, mark, F.col("__next.i").alias("next_id"), F.col("__next.m").alias("next_mark"))


def within(queries: DataFrame, rows: DataFrame, radius: int = 3, blocks: int = 5, out: str = "n_within") -> DataFrame:
    """(fp, n) per distinct query fingerprint: how many of `rows` have a fingerprint within the radius, itself included.

    Fingerprints are cut into blocks; with at most `radius` differing bits, some choice of blocks - radius of them is equal.
    Each choice is a table: its blocks are permuted to the front and are its join key. Equal fingerprints are counted
    first, so a bucket holds distinct ones only.
    """
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in choice) for choice in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]

    def tables(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("table", "key"))

    wanted = tables(queries.select("fp").distinct()).withColumnRenamed("fp", "__q")
    there = tables(rows.groupBy("fp").agg(F.count("*").alias("__n")))
    near = wanted.join(there, ["table", "key"]).where(F.bit_count(F.col("__q").bitwiseXOR(F.col("fp"))) <= radius)
    # a pair found in several tables counts in the first of them
    first = F.least(*[F.when(F.col("__q").bitwiseXOR(F.col("fp")).bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(signed)])
    return near.where(F.col("table") == first).groupBy(F.col("__q").alias("fp")).agg(F.sum("__n").alias(out))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fp, edited_fp, next_fp) per row: fingerprints of the text, of the text whose last
    quarter is replaced by the start of the next document's, and of the next document.

    Null counts as empty. Documents follow by id, null first; rows with one id follow by a hash of the text; rows equal in
    both are one place in the order and get equal results. The next document of the last is the first. A text is shuffled
    once, and the part that another borrows a second time. Other columns are not carried.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    sized = rows.select("id", "mark", F.char_length("text").alias("n_chars"))
    order = X.written(next_rows(sized.select("id", "mark"), "id", "mark"), "next")
    lengths = sized.distinct()
    taken = F.expr("cast(floor(n_chars / 4) as int)")
    borrowers = order.join(lengths, (order["id"].eqNullSafe(lengths["id"])) & (order["mark"] == lengths["mark"])).select(
        F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), order["id"].alias("to_id"), order["mark"].alias("to_mark"), taken.alias("taken"))
    borrowers = X.written(borrowers, "borrowers")

    def same(a: DataFrame, b: DataFrame) -> Column:
        return a["id"].eqNullSafe(b["id"]) & (a["mark"] == b["mark"])

    lent = rows.join(borrowers, same(rows, borrowers)).groupBy(F.col("to_id").alias("id"), F.col("to_mark").alias("mark")).agg(
        F.first(F.expr("substring(text, 1, taken)")).alias("tail"))
    whole = rows.join(lent, same(rows, lent)).select(rows["id"], rows["mark"], "text", F.char_length("text").alias("n_chars"), "tail")
    edited = whole.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - cast(floor(n_chars / 4) as int))"), "tail"))
    shas = edited.select("id", "mark", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    both = shas.select("id", "mark", "n_chars", "edited_sha256", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    both = both.select("id", "mark", "n_chars", "edited_sha256", "v.which", "v.t")
    keys = ["id", "mark", "n_chars", "edited_sha256"]
    prints = fingerprints(both, [*keys, "which"], "t").groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    prints = X.written(prints, "prints")
    following = prints.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("fp").alias("next_fp"))
    led = order.join(following, order["next_id"].eqNullSafe(following["next_id"]) & (order["next_mark"] == following["next_mark"])).select("id", "mark", "next_fp")
    full = prints.join(led, same(prints, led)).select(prints["id"], prints["mark"], "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
    each = rows.select("id", "mark")
    return each.join(full, same(each, full)).select(each["id"].alias(id_col), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
