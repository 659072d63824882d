"""Reading, keys, conditions, splits, draws and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import vectors as V
from plumbline.operators import conditions as C
from plumbline.operators import pairing as P
from plumbline.operators import sampling as SA
from plumbline.plans.registry import (
    BASE, SEEN_LABELS, V_SQL, draw, query, rank_sql, real_gen, seen_conditions, sql, table,
    unit_draw_sql, vectors,
)
from plumbline.sources import shards as SH
from plumbline.sources import tables as T

AB = ["a", "b"]

# ---- sources and keys ----------------------------------------------------------------------------


@query("read_vectors", sql("SELECT vec_id AS sample_id, label, len(embedding)::INTEGER AS dim, list_sum(embedding::DOUBLE[]) AS total FROM embeddings", ["sample_id", "label", "dim"], ["total"]))
def read_vectors(spark, sf):
    v = T.read_vectors(spark, f"{sf}/embeddings.parquet", ["label"], "vec_id", "embedding")
    return v.select("sample_id", "label", F.size("features").alias("dim"), V.vsum("features").alias("total"))


def _names(spark, sf):
    """File names of the vectors; one label has names that do not parse."""
    good = F.concat(F.lit("imgs/cell"), F.col("a"), F.lit("_sirna"), F.col("b"), F.lit("_"), F.col("sample_id"), F.lit(".png"))
    bad = F.concat(F.lit("imgs/plate"), F.col("sample_id"), F.lit(".png"))
    return vectors(spark, sf).withColumn("path", F.when(F.col("label") == 9, bad).otherwise(good))


@query("parse_condition_key", sql("SELECT a AS cell_type_id, b AS sirna_id, sample_id::INTEGER AS sample_idx FROM v WHERE label <> 9", ["cell_type_id", "sirna_id", "sample_idx"], [], [V_SQL]))
def parse_condition_key(spark, sf):
    return T.parse_condition_key(_names(spark, sf).select("path"), "path", ["cell_type_id", "sirna_id", "sample_idx"]).drop("path")


@query("parse_attribute_map", sql("SELECT sample_id, a AS blond, b % 2 AS male, 2::INTEGER AS n_keys FROM v", ["sample_id", "blond", "male", "n_keys"], [], [V_SQL]))
def parse_attribute_map(spark, sf):
    name = F.concat(F.lit("Blond_Hair"), F.col("a"), F.lit("_Male"), F.col("b") % 2, F.lit("_"), F.col("sample_id"), F.lit(".png"))
    m = vectors(spark, sf).withColumn("path", name).withColumn("m", T.parse_attribute_map("path"))
    return m.select("sample_id", F.col("m")["Blond_Hair"].alias("blond"), F.col("m")["Male"].alias("male"), F.size("m").alias("n_keys"))


@query("condition_text", sql("SELECT sample_id, 'a' || a || '_b' || b AS signature, 'b=' || b || ', a=' || a AS readable, a + b AS weight FROM v", ["sample_id", "signature", "readable", "weight"], [], [V_SQL]))
def condition_text(spark, sf):
    v = vectors(spark, sf)
    return v.select("sample_id", V.condition_signature(["b", "a"]).alias("signature"), V.format_condition(["b", "a"]).alias("readable"), V.hamming_weight(AB).alias("weight"))


def _shards(spark, sf):
    v = vectors(spark, sf).withColumn("signature", V.condition_signature(AB))
    index = SH.index_names(v.where("label <> 8").select("signature", "sample_id", F.concat_ws("_", "signature", F.col("sample_id").cast("string")).alias("name")))
    return v.where("label <> 3").select("signature", "sample_id", "features"), index


@query("consolidate_shards", sql("SELECT i.name, i.global_idx, i.sample_id, v.x[1] AS first FROM i JOIN v USING (sample_id) WHERE v.label <> 3", ["name", "global_idx", "sample_id"], ["first"],
    [V_SQL, "i AS (SELECT name, sample_id, row_number() OVER (ORDER BY name) - 1 AS global_idx FROM (SELECT sample_id, 'a' || a || '_b' || b || '_' || sample_id AS name FROM v WHERE label <> 8))"]))
def consolidate_shards(spark, sf):
    shards, index = _shards(spark, sf)
    out = SH.consolidate_shards(shards, index, ["signature", "sample_id"])
    return out.select("name", "global_idx", "sample_id", F.col("features")[0].alias("first"))


@query("consolidation_report", sql("SELECT 0::BIGINT AS duplicates, count(*) FILTER (WHERE label = 3)::BIGINT AS missing, count(*) FILTER (WHERE label = 8)::BIGINT AS extra FROM v", ["duplicates", "missing", "extra"], [], [V_SQL]))
def consolidation_report(spark, sf):
    return SH.consolidation_report(*_shards(spark, sf), ["signature", "sample_id"])


@query("round_robin_shard", sql("SELECT sample_id, ((row_number() OVER (ORDER BY sample_id) - 1) % 4)::INTEGER AS shard FROM v", ["sample_id", "shard"], [], [V_SQL]))
def round_robin_shard(spark, sf):
    v = vectors(spark, sf).select("sample_id")
    parts = SH.round_robin_shard(v, 4)
    return SH.merge_shards([parts.where(F.col("shard") == i) for i in range(4)], v)


@query("upsert_by_condition", sql("SELECT sample_id, a, b FROM v WHERE is_gen = 0 AND (a, b) NOT IN (SELECT (a, b) FROM v WHERE is_gen = 1 AND label >= 5) UNION ALL SELECT sample_id, a, b FROM v WHERE is_gen = 1 AND label >= 5", ["sample_id", "a", "b"], [], [V_SQL]))
def upsert_by_condition(spark, sf):
    real, gen = real_gen(spark, sf)
    return SH.upsert_by_condition(real.select("sample_id", *AB), gen.where("label >= 5").select("sample_id", *AB), AB)


@query("relabel_attributes", sql("SELECT sample_id, a, b FROM v", ["sample_id", "a", "b"], [], [V_SQL]))
def relabel_attributes(spark, sf):
    """Two models store the condition in different orders."""
    v = vectors(spark, sf)
    even = F.col("label") % 2 == 0
    rows = v.select("sample_id", F.when(even, "m0").otherwise("m1").alias("model"), F.when(even, F.array("a", "b")).otherwise(F.array("b", "a")).alias("cond"))
    return SH.relabel_attributes(rows, {"m0": {"a": 0, "b": 1}, "m1": {"a": 1, "b": 0}}).drop("model", "cond")


@query("condition_catalog", sql("SELECT p_brand, p_type FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_type FROM part)", ["p_brand", "p_type"]))
def condition_catalog(spark, sf):
    return C.condition_catalog(table(spark, sf, "part"), ["p_brand", "p_type"])


# ---- filters -------------------------------------------------------------------------------------


@query("filter_seen", sql(f"SELECT sample_id, label FROM v WHERE label < {SEEN_LABELS}", ["sample_id", "label"], [], [V_SQL]))
def filter_seen(spark, sf):
    return C.filter_seen(vectors(spark, sf), seen_conditions(spark, sf), AB).select("sample_id", "label")


@query("filter_pairs", sql("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE (l_returnflag, l_linestatus) IN (SELECT (l_returnflag, l_linestatus) FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_tax > 0.07)", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"]))
def filter_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    subset = li.where("l_quantity > 49 and l_discount > 0.09 and l_tax > 0.07")
    pair = ["l_returnflag", "l_linestatus"]
    return C.filter_pairs(li, subset, pair).select("l_orderkey", "l_linenumber", *pair)


@query("filter_scoring_pool", sql(f"SELECT sample_id, a, b FROM v WHERE b IN (SELECT b FROM v WHERE label >= {SEEN_LABELS})", ["sample_id", "a", "b"], [], [V_SQL]))
def filter_scoring_pool(spark, sf):
    v = vectors(spark, sf)
    return C.filter_scoring_pool(v, v.where(F.col("label") >= SEEN_LABELS), "b").select("sample_id", *AB)


@query("exclude_heldout", sql(f"SELECT DISTINCT a, b FROM v WHERE label < {SEEN_LABELS}", AB, [], [V_SQL]))
def exclude_heldout(spark, sf):
    v = vectors(spark, sf)
    return C.exclude_heldout(v, v.where(F.col("label") >= SEEN_LABELS), AB)


def _metadata(spark, sf):
    """Orders as a sample table: condition (segment, priority), dataset by status."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    ds = F.when(F.col("o_orderstatus") == "F", "test").otherwise("train")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), ds.alias("dataset"))


SP = ["segment", "priority"]
META = "md AS (SELECT o_orderkey AS sample_id, c_mktsegment AS segment, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS dataset FROM orders JOIN customer ON o_custkey = c_custkey)"
HELD = "segment = 'BUILDING' AND priority IN ('1-URGENT', '2-HIGH')"
SPLIT = (
    META,
    f"pool AS (SELECT sample_id, {rank_sql('', 42)} AS rk, count(*) OVER () AS n FROM md WHERE dataset = 'train')",
    f"sp0 AS (SELECT md.*, rk, coalesce(rk <= ceil(n * 0.1), false) AS isval, ({HELD}) AS held FROM md LEFT JOIN pool USING (sample_id))",
    "sp AS (SELECT sample_id, segment, priority, dataset, (rk IS NOT NULL AND NOT isval AND NOT held) AS train_index, (isval OR (held AND dataset <> 'test')) AS val_index, dataset = 'test' AS test_index FROM sp0)",
)


def _split(spark, sf):
    md = _metadata(spark, sf)
    return SA.make_splits(md, SP, md.where(HELD).select(*SP).distinct())


@query("make_splits", sql("SELECT * FROM sp", ["sample_id", *SP, "dataset", "train_index", "val_index", "test_index"], [], SPLIT))
def make_splits(spark, sf):
    return _split(spark, sf)


@query("composition_category", sql("SELECT sp.sample_id, segment, priority, CASE WHEN c IS NULL THEN 'unseen' WHEN c < 330 THEN 'rare' ELSE 'seen' END AS comp_category FROM sp LEFT JOIN (SELECT segment, priority, count(*) AS c FROM sp WHERE train_index GROUP BY 1, 2) USING (segment, priority)", ["sample_id", *SP, "comp_category"], [], SPLIT))
def composition_category(spark, sf):
    return C.composition_category(_split(spark, sf), SP, "train_index", 330).select("sample_id", *SP, "comp_category")


@query("available_conditions", sql("SELECT segment, priority, dataset, count(*)::BIGINT AS n FROM sp WHERE val_index GROUP BY 1, 2, 3", [*SP, "dataset", "n"], [], SPLIT))
def available_conditions(spark, sf):
    return C.available_conditions(_split(spark, sf), SP, "dataset", "val_index")


@query("move_heldout", sql(f"SELECT 'train' AS part, segment, priority, count(*)::BIGINT AS n FROM md WHERE dataset = 'train' AND NOT ({HELD}) GROUP BY 2, 3 UNION ALL SELECT 'val', segment, priority, count(*)::BIGINT FROM md WHERE dataset = 'test' OR ({HELD}) GROUP BY 2, 3", ["part", *SP, "n"], [], [META]))
def move_heldout(spark, sf):
    md = _metadata(spark, sf)
    train, val = C.move_heldout(md.where("dataset = 'train'"), md.where("dataset = 'test'"), md.where(HELD), SP)
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.groupBy("part", *SP).agg(F.count("*").alias("n"))


@query("filter_by_attribute_lists", sql("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type IN ('ECONOMY', 'PROMO')", ["p_partkey", "p_brand", "p_type"]))
def filter_by_attribute_lists(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return C.filter_by_attribute_lists(p, {"p_brand": ["Brand#1", "Brand#2", "Brand#3"], "p_type": ["ECONOMY", "PROMO"], "p_size": []})


@query("matching_samples", sql("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100", ["l_orderkey", "l_linenumber"]))
def matching_samples(spark, sf):
    """Equality on two attributes, at most 100 rows in stored order (the feature's own cap)."""
    li = table(spark, sf, "lineitem").withColumn("sample_id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return C.matching_samples(li, {"l_returnflag": "R", "l_linestatus": "F"}, 100).select("l_orderkey", "l_linenumber")


@query("tag_arm", sql("SELECT sample_id, label, CASE WHEN label < 4 THEN 'seen' WHEN label < 8 THEN 'unseen' ELSE 'outside' END AS arm FROM v", ["sample_id", "label", "arm"], [], [V_SQL]))
def tag_arm(spark, sf):
    v = vectors(spark, sf)
    arms = v.where("label < 8").select(*AB, F.when(F.col("label") < 4, "seen").otherwise("unseen").alias("arm")).distinct()
    return C.tag_arm(v, arms, AB).select("sample_id", "label", "arm")


@query("finite_scores", sql("SELECT event_id, ln(value - 1) AS score FROM events WHERE value > 1", ["event_id"], ["score"]))
def finite_scores(spark, sf):
    """Logarithms of non-positive numbers are null or infinite and drop out."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("value") > 1, F.ln(F.col("value") - 1)).when(F.col("value") == 1, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return C.finite_scores(e.select("event_id", raw.alias("score")), "score")


@query("eligible_conditions", sql("SELECT p_brand, p_type, p_partkey, n, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey)::INTEGER AS place FROM part JOIN "
    "(SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY 1, 2 HAVING count(*) >= 4 ORDER BY n DESC, p_brand, p_type LIMIT 16) USING (p_brand, p_type) QUALIFY place <= 8", ["p_brand", "p_type", "p_partkey", "n", "place"]))
def eligible_conditions(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey")
    return C.eligible_conditions(p, ["p_brand", "p_type"], 4, 16, 8, "p_partkey")


# ---- subsets and splits --------------------------------------------------------------------------


@query("top_k_conditions", sql("SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 20", ["p_brand", "p_type", "n"]))
def top_k_conditions(spark, sf):
    return C.top_k_conditions(table(spark, sf, "part"), ["p_brand", "p_type"], 20)


@query("attribute_totals", sql("SELECT 'p_brand' AS attr, p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*)::BIGINT FROM part GROUP BY 2", ["attr", "value", "n"]))
def attribute_totals(spark, sf):
    return C.attribute_totals(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("pick_stratified_subset", sql("SELECT stratum, p_brand, p_type, n, place FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, p_brand, p_type) AS place FROM "
    "(SELECT p_brand, p_type, count(*)::BIGINT AS n, CASE WHEN p_type = 'PROMO' THEN 'promo' WHEN p_type = 'ECONOMY' AND p_brand < 'Brand#2' THEN 'economy' WHEN p_type = 'STANDARD' THEN 'standard' END AS stratum FROM part GROUP BY 1, 2) "
    "WHERE stratum IS NOT NULL) WHERE place <= CASE stratum WHEN 'promo' THEN 8 WHEN 'economy' THEN 7 ELSE 2 END", ["stratum", "p_brand", "p_type", "n", "place"]))
def pick_stratified_subset(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    t = F.col("p_type")
    strata = [("promo", t == "PROMO", 8), ("economy", (t == "ECONOMY") & (F.col("p_brand") < "Brand#2"), 7), ("standard", t == "STANDARD", 2)]
    return C.pick_stratified_subset(counts, strata, ["p_brand", "p_type"]).select("stratum", "p_brand", "p_type", "n", "place")


STRAT = (
    f"s0 AS (SELECT event_id AS sample_id, event_type, {rank_sql('event_type', 42, sid='event_id')} AS rk, count(*) OVER (PARTITION BY event_type) AS nc, count(*) OVER () AS n FROM events)",
    "s1 AS (SELECT * FROM s0 WHERE rk <= least(nc, greatest(1, round_even(nc / n * 701.0, 0))))",
)


@query("stratified_subsample", sql(f"SELECT sample_id, event_type FROM (SELECT *, {rank_sql('', 42)} AS gk FROM s1) WHERE gk <= 701", ["sample_id", "event_type"], [], STRAT))
def stratified_subsample(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), "event_type")
    return SA.stratified_subsample(e, ["event_type"], 701)


@query("stratified_test_split", sql(f"SELECT sample_id, segment, priority, {rank_sql('segment, priority', 42)} <= greatest(1, floor(0.3 * count(*) OVER (PARTITION BY segment, priority))) AS is_test FROM md", ["sample_id", *SP, "is_test"], [], [META]))
def stratified_test_split(spark, sf):
    return SA.stratified_test_split(_metadata(spark, sf).select("sample_id", *SP), SP)


@query("cross_fit_split", sql(f"SELECT sample_id, {rank_sql('', 7)} <= floor(0.5 * count(*) OVER ()) AS is_fit FROM md", ["sample_id", "is_fit"], [], [META]))
def cross_fit_split(spark, sf):
    return SA.cross_fit_split(_metadata(spark, sf).select("sample_id"), 0.5, 7)


HALF = (
    "reps AS (SELECT unnest([0, 1, 2])::INTEGER AS rep)",
    f"h0 AS (SELECT sample_id, a, b, rep, row_number() OVER (PARTITION BY a, b, rep ORDER BY {draw(42, 'rep')}, sample_id) AS rk, count(*) OVER (PARTITION BY a, b, rep) // 2 AS h FROM v, reps)",
)


@query("half_split", sql("SELECT sample_id, a, b, rep, CASE WHEN rk <= h THEN 'A' ELSE 'B' END AS side FROM h0 WHERE rk <= 2 * h", ["sample_id", "a", "b", "rep", "side"], [], [V_SQL, *HALF]))
def half_split(spark, sf):
    return SA.half_split(vectors(spark, sf).select("sample_id", *AB), AB, 3)


@query("stratified_kfold", sql(f"SELECT sample_id, event_type, ((rk - 1) % least(5, min(nc) OVER ()))::INTEGER AS fold FROM (SELECT event_id AS sample_id, event_type, {rank_sql('event_type', 42, sid='event_id')} AS rk, count(*) OVER (PARTITION BY event_type) AS nc FROM events) WHERE nc >= 2", ["sample_id", "event_type", "fold"]))
def stratified_kfold(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("sample_id"), "event_type")
    return SA.stratified_kfold(e, "event_type", 5)


@query("split_by_entity", sql("SELECT event_id, user_id, is_val FROM events JOIN "
    f"(SELECT user_id, {rank_sql('', 42, sid='user_id')} <= greatest(1, floor(count(*) OVER () * 0.1)) AS is_val FROM (SELECT DISTINCT user_id FROM events)) USING (user_id)", ["event_id", "user_id", "is_val"]))
def split_by_entity(spark, sf):
    return SA.split_by_entity(table(spark, sf, "events").select("event_id", "user_id"), "user_id")


@query("class_map", sql("SELECT p_brand, p_type, (row_number() OVER (ORDER BY p_brand, p_type) - 1)::INTEGER AS class_id FROM (SELECT DISTINCT p_brand, p_type FROM part)", ["p_brand", "p_type", "class_id"]))
def class_map(spark, sf):
    return C.class_map(table(spark, sf, "part"), ["p_brand", "p_type"])


@query("contiguous_labels", sql("SELECT p_partkey, p_brand, coalesce(y, -1)::INTEGER AS y FROM part LEFT JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS y FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 50 = 1)) USING (p_brand) WHERE p_partkey % 50 <> 1", ["p_partkey", "p_brand", "y"]))
def contiguous_labels(spark, sf):
    """Train and test parts by key; brands that only occur in the test part get -1."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return C.contiguous_labels(p.where("p_partkey % 50 = 1"), p.where("p_partkey % 50 <> 1"), "p_brand")


@query("rarity_weight", sql("SELECT p_partkey, p_brand, p_type, n AS cond_n, CASE WHEN n >= 20 THEN 1.0 WHEN n <= 10 THEN 5.0 ELSE 5.0 + (n - 10) / 10.0 * (-4.0) END AS weight FROM part JOIN (SELECT p_brand, p_type, count(*)::BIGINT AS n FROM part GROUP BY 1, 2) USING (p_brand, p_type)", ["p_partkey", "p_brand", "p_type", "cond_n"], ["weight"]))
def rarity_weight(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return C.rarity_weight(p, ["p_brand", "p_type"], 10, 20)


# ---- joins ---------------------------------------------------------------------------------------


@query("join_scores", sql("SELECT sample_id::VARCHAR AS sample_id, x[1] AS measure, x[2] AS trust FROM v WHERE is_gen = 1", ["sample_id"], ["measure", "trust"], [V_SQL]))
def join_scores(spark, sf):
    """Measurements by file name meet scores by file stem; even ids have no score."""
    v = vectors(spark, sf)
    measures = v.select(F.concat(F.lit("out/"), F.col("sample_id").cast("string"), F.lit(".png")).alias("path"), F.col("features")[0].alias("measure"))
    scores = v.select(F.col("sample_id").cast("string").alias("sample_id"), F.when(F.col("is_gen") == 1, F.col("features")[1]).otherwise(F.lit(float("nan"))).alias("trust"))
    return P.join_scores(measures, scores, "path").drop("path")


@query("pair_spaces", sql("SELECT sample_id, x[1] AS first_a, x[64] AS first_b FROM v WHERE label < 8 AND label > 2", ["sample_id"], ["first_a", "first_b"], [V_SQL]))
def pair_spaces(spark, sf):
    v = vectors(spark, sf)
    b = v.where("label > 2").withColumn("features", F.reverse("features"))
    return P.pair_spaces(v.where("label < 8"), b).select("sample_id", F.col("features_a")[0].alias("first_a"), F.col("features_b")[0].alias("first_b"))


@query("verify_alignment", sql("SELECT count(*) FILTER (WHERE label <= 2)::BIGINT AS only_left, count(*) FILTER (WHERE label >= 8)::BIGINT AS only_right, count(*) FILTER (WHERE label > 2 AND label < 8)::BIGINT AS matched, count(*) FILTER (WHERE label = 5)::BIGINT AS attr_mismatch FROM v", ["only_left", "only_right", "matched", "attr_mismatch"], [], [V_SQL]))
def verify_alignment(spark, sf):
    v = vectors(spark, sf)
    other = v.where("label > 2").withColumn("b", F.when(F.col("label") == 5, F.col("b") + 1).otherwise(F.col("b")))
    return P.verify_alignment(v.where("label < 8"), other, AB)


def matched_sql(want: str, pool: str, keys: str, reps: str, seed: int, never: bool = False) -> str:
    """The draw of sampling.matched_draw: want(keys, reps, n_want), pool(keys, sample_id)."""
    rk = [r.strip() for r in reps.split(",") if r.strip()]
    rep = "concat_ws(',', " + ", ".join(rk) + ")" if rk else "'0'"
    all_ = ", ".join([keys, *rk])
    ranked = f"(SELECT {all_}, n_want, sample_id, row_number() OVER (PARTITION BY {all_} ORDER BY {draw(seed, rep)}, sample_id) AS rk, count(*) OVER (PARTITION BY {all_}) AS n FROM {pool} JOIN {want} USING ({keys}))"
    direct = f"SELECT {all_}, rk AS slot, sample_id FROM {ranked} WHERE rk <= n_want" + ("" if never else " AND n >= n_want")
    if never:
        return f"({direct})"
    cell = "concat_ws(',', " + keys + ")"
    slot = f"(SELECT {all_}, n, unnest(range(1, n_want + 1)) AS slot FROM {ranked} WHERE rk = 1 AND n < n_want)"
    pick = f"(SELECT {all_}, slot, floor({unit_draw_sql(seed, rep, f'''concat_ws(',', {cell}, slot)''')} * n)::BIGINT + 1 AS rk FROM {slot})"
    return f"({direct} UNION ALL SELECT {', '.join('k.' + x.strip() for x in all_.split(','))}, slot, sample_id FROM {pick} k JOIN {ranked} p USING ({all_}, rk))"


WANT = "want AS (SELECT a, b, count(*) AS n_want FROM g GROUP BY a, b)"


@query("matched_real_draw", sql(f"SELECT * FROM {matched_sql('want', 'r', 'a, b', '', 42)}", ["a", "b", "slot", "sample_id"], [], [*BASE, WANT]))
def matched_real_draw(spark, sf):
    real, gen = real_gen(spark, sf)
    return SA.matched_real_draw(gen, real, AB)


@query("matched_capped_pair", sql(f"SELECT 'gen' AS side, * FROM {matched_sql('cap', 'g', 'a, b', '', 42, True)} UNION ALL SELECT 'real', * FROM {matched_sql('cap', 'r', 'a, b', '', 43, True)}", ["side", "a", "b", "slot", "sample_id"], [],
    [*BASE, "bc AS (SELECT a, b, ng, nr FROM (SELECT a, b, count(*) AS ng FROM g GROUP BY 1, 2) JOIN (SELECT a, b, count(*) AS nr FROM r GROUP BY 1, 2) USING (a, b))",
     "cap AS (SELECT a, b, least(round_even(ng * s, 0)::BIGINT, ng, nr) AS n_want FROM bc, (SELECT least(1.0::DOUBLE, min(nr / ng)) AS s FROM bc))"]))
def matched_capped_pair(spark, sf):
    real, gen = real_gen(spark, sf)
    g, r = SA.matched_capped_pair(gen, real, AB)
    return g.withColumn("side", F.lit("gen")).unionByName(r.withColumn("side", F.lit("real")))


@query("random_baseline", sql(f"SELECT * FROM {matched_sql('want', 'g', 'a, b', 'rep', 0, True)}", ["a", "b", "rep", "slot", "sample_id"], [],
    [*BASE, "want AS (SELECT a, b, unnest([0, 1, 2])::INTEGER AS rep, count(*) AS n_want FROM g WHERE x[1] > 0 GROUP BY a, b)"]))
def random_baseline(spark, sf):
    _, gen = real_gen(spark, sf)
    return SA.random_baseline(gen.where(F.col("features")[0] > 0), gen, AB, 3)


@query("random_baseline_uniform", sql(f"SELECT a, b, rep, rk AS slot, sample_id FROM (SELECT a, b, rep, sample_id, row_number() OVER (PARTITION BY rep ORDER BY {draw(0, 'rep')}, sample_id) AS rk FROM g, (SELECT unnest([0, 1])::INTEGER AS rep)) WHERE rk <= (SELECT count(*) FROM g WHERE x[1] > 0)", ["a", "b", "rep", "slot", "sample_id"], [], BASE))
def random_baseline_uniform(spark, sf):
    _, gen = real_gen(spark, sf)
    return SA.random_baseline(gen.where(F.col("features")[0] > 0), gen, AB, 2, mode="uniform")


NEAR = (
    V_SQL, f"un AS (SELECT DISTINCT a, b FROM v WHERE label >= {SEEN_LABELS - 2})", f"se AS (SELECT DISTINCT a, b FROM v WHERE label < {SEEN_LABELS})",
    "hd AS (SELECT un.a, un.b, se.a AS near_a, se.b AS near_b, ((un.a <> se.a)::INTEGER + (un.b <> se.b)::INTEGER) AS hamming FROM un, se)",
)


def _near(spark, sf, ties):
    v = vectors(spark, sf)
    return C.nearest_condition(v.where(F.col("label") >= SEEN_LABELS - 2), v.where(F.col("label") < SEEN_LABELS), AB, ties)


@query("nearest_condition", sql("SELECT * FROM hd QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY hamming, near_a, near_b) = 1", ["a", "b", "near_a", "near_b", "hamming"], [], NEAR))
def nearest_condition(spark, sf):
    return _near(spark, sf, False)


@query("nearest_condition_ties", sql("SELECT * FROM hd QUALIFY rank() OVER (PARTITION BY a, b ORDER BY hamming) = 1", ["a", "b", "near_a", "near_b", "hamming"], [], NEAR))
def nearest_condition_ties(spark, sf):
    return _near(spark, sf, True)


# Forty two-valued attributes: the signs of the first forty entries.
SIGNS = [f"s{i}" for i in range(40)]
SIGN_LIST = "list_transform(range(1, 41), lambda i: CASE WHEN x[i] > 0 THEN 1 ELSE 0 END)"
SIGN_NEAR = [
    V_SQL, f"lc AS (SELECT DISTINCT {SIGN_LIST} AS p FROM v WHERE is_gen = 1)", f"rc AS (SELECT DISTINCT {SIGN_LIST} AS q FROM v WHERE is_gen = 0)",
    "hd AS (SELECT p, q, list_sum(list_transform(range(1, 41), lambda i: abs(p[i] - q[i])))::INTEGER AS hamming FROM lc, rc)",
]
SIGN_COLS = ["array_to_string(p, '') AS cond", "array_to_string(q, '') AS near", "hamming"]


def _near_signs(spark, sf, ties):
    v = vectors(spark, sf).select("is_gen", *[(F.col("features")[i] > 0).cast("int").alias(a) for i, a in enumerate(SIGNS)])
    out = C.nearest_condition(v.where("is_gen = 1"), v.where("is_gen = 0"), SIGNS, ties)
    return out.select(F.concat(*SIGNS).alias("cond"), F.concat(*[f"near_{a}" for a in SIGNS]).alias("near"), "hamming")


@query("nearest_condition_many_attributes", sql("SELECT * FROM hd QUALIFY row_number() OVER (PARTITION BY p ORDER BY hamming, q) = 1", SIGN_COLS, [], SIGN_NEAR))
def nearest_condition_many_attributes(spark, sf):
    return _near_signs(spark, sf, False)


@query("nearest_condition_many_attributes_ties", sql("SELECT * FROM hd QUALIFY rank() OVER (PARTITION BY p ORDER BY hamming) = 1", SIGN_COLS, [], SIGN_NEAR))
def nearest_condition_many_attributes_ties(spark, sf):
    return _near_signs(spark, sf, True)


@query("random_pairs", sql(f"SELECT p.pair, li.sample_id AS left_id, ri.sample_id AS right_id FROM (SELECT pair, i, CASE WHEN i = j THEN (j + 1) % n ELSE j END AS j FROM (SELECT pair, n, floor({unit_draw_sql(42, '1', 'pair')} * n)::BIGINT AS i, floor({unit_draw_sql(42, '2', 'pair')} * n)::BIGINT AS j FROM (SELECT unnest(range(1000)) AS pair), (SELECT count(*) AS n FROM v))) p "
    "JOIN ix li ON li.k = p.i JOIN ix ri ON ri.k = p.j", ["pair", "left_id", "right_id"], [], [V_SQL, f"ix AS (SELECT sample_id, {rank_sql('', 42)} - 1 AS k FROM v)"]))
def random_pairs(spark, sf):
    return SA.random_pairs(vectors(spark, sf), 1000)


STEPS = "st AS (SELECT sample_id // 5 AS sid, (sample_id % 5)::INTEGER AS step, x FROM v)"


def steps_of(spark, sf):
    v = vectors(spark, sf)
    return v.select(F.expr("sample_id div 5").alias("sample_id"), (F.col("sample_id") % 5).cast("int").alias("step"), "features")


@query("step_similarity", sql("SELECT p.step, count(*)::BIGINT AS n, avg(list_cosine_similarity(p.x, q.x)) AS mean_cosine, stddev_pop(list_cosine_similarity(p.x, q.x)) AS std_cosine FROM st p JOIN st q ON p.sid = q.sid AND q.step = 4 GROUP BY 1", ["step", "n"], ["mean_cosine", "std_cosine"], [V_SQL, STEPS]))
def step_similarity(spark, sf):
    s = steps_of(spark, sf)
    return P.step_similarity(s, s.where("step = 4"))


@query("step_distance", sql("SELECT step, next_step, count(*)::BIGINT AS n, avg(list_distance(x, nx)) AS mean_l2, avg(list_sum(list_transform(list_zip(x, nx), lambda z: abs(z[1] - z[2])))) AS mean_l1 FROM (SELECT *, lead(x) OVER (PARTITION BY sid ORDER BY step) AS nx, lead(step) OVER (PARTITION BY sid ORDER BY step) AS next_step FROM st) WHERE nx IS NOT NULL GROUP BY 1, 2", ["step", "next_step", "n"], ["mean_l2", "mean_l1"], [V_SQL, STEPS]))
def step_distance(spark, sf):
    return P.step_distance(steps_of(spark, sf))


@query("paired_cosine", sql("SELECT count(*)::BIGINT AS n, avg(list_cosine_similarity(x, list_reverse(x))) AS mean_cosine, stddev_pop(list_cosine_similarity(x, list_reverse(x))) AS std_cosine FROM v", ["n"], ["mean_cosine", "std_cosine"], [V_SQL]))
def paired_cosine(spark, sf):
    v = vectors(spark, sf)
    return P.paired_cosine(v, v.withColumn("features", F.reverse("features")))


@query("paired_cosine_shuffled", sql("SELECT count(*)::BIGINT AS n, avg(list_cosine_similarity(p.x, q.x)) AS mean_cosine, stddev_pop(list_cosine_similarity(p.x, q.x)) AS std_cosine FROM "
    f"(SELECT x, {rank_sql('', 5)} AS i FROM v) p JOIN (SELECT x, {rank_sql('', 6)} AS i FROM v) q USING (i)", ["n"], ["mean_cosine", "std_cosine"], [V_SQL]))
def paired_cosine_shuffled(spark, sf):
    v = vectors(spark, sf)
    return P.paired_cosine(v, v, seed=5)


PATCH = "pt AS (SELECT sample_id, [x[1:16], x[17:32], x[33:48], x[49:64]] AS p FROM v)"


@query("pool_patches", sql("SELECT sample_id, (p[1][1] + p[2][1] + p[3][1] + p[4][1]) / 4 AS mean_first, greatest(p[1][16], p[2][16], p[3][16], p[4][16]) AS max_last, p[1][2] AS cls_second FROM pt", ["sample_id"], ["mean_first", "max_last", "cls_second"], [V_SQL, PATCH]))
def pool_patches(spark, sf):
    patches = F.array(*[F.slice("features", 16 * i + 1, 16) for i in range(4)])
    v = vectors(spark, sf).select("sample_id", patches.alias("patches"))
    v = P.pool_patches(v, "mean").withColumn("mean_first", F.col("features")[0])
    v = P.pool_patches(v, "max").withColumn("max_last", F.col("features")[15])
    return P.pool_patches(v, "cls").select("sample_id", "mean_first", "max_last", F.col("features")[1].alias("cls_second"))


