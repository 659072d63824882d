"""Columns of any name survive, small languages keep their words, and the quality model is Kneser-Ney by its formulas."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import counts, decontamination, language, quality, queries, recompression, sharding

NAMES = "doc_id bigint, text string, __spans string, __items int, __key string, __p int, __Chunk int, __row int, __range int, __before int, __rank int, slot int"
LONG = " ".join(f"w{i}" for i in range(30))
ROWS = [(1, LONG, "a", 1, "k", 2, 3, 4, 5, 6, 7, 8), (2, "x " + LONG, "b", 1, "k", 2, 9, 4, 5, 6, 7, 8), (3, None, None, None, None, None, None, None, None, None, None, None),
        (4, "", "c", 0, "", 0, 0, 0, 0, 0, 0, 0), (4, "", "c", 0, "", 0, 0, 0, 0, 0, 0, 0)]


@pytest.fixture(scope="module")
def clashing(spark):
    return spark.createDataFrame(ROWS, NAMES)


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_benchmark_scan_keeps_columns(spark, clashing, block_bytes):
    items = spark.createDataFrame([("p", " ".join(f"w{i}" for i in range(10))), ("q", "w20 w21"), ("r", None)], "item_id string, text string")
    got = decontamination.scan(clashing, items, block_bytes=block_bytes)
    assert got.columns == [*clashing.columns, "hit_spans", "item_ids", "n_words"]
    assert sorted(map(str, got.select(*clashing.columns).collect())) == sorted(map(str, clashing.collect()))
    assert {(r.doc_id, tuple(r.hit_spans), tuple(r.item_ids)) for r in got.collect()} == {(1, (0, 10, 20, 22), ("p", "q")), (2, (1, 11, 21, 23), ("p", "q")), (3, (), ()), (4, (), ())}
    assert [r.doc_id for r in decontamination.decontaminate(clashing, items, block_bytes=block_bytes).orderBy("doc_id").collect()] == [3, 4, 4]


def test_repeats_keep_columns(spark, clashing):
    got = recompression.remove_repeats(clashing)
    assert got.columns == [*clashing.columns, "kept_text", "n_words", "n_removed"]
    assert {(r.doc_id, r.n_removed, r["__Chunk"]) for r in got.collect()} == {(1, 0, 3), (2, 30, 9), (3, 0, None), (4, 0, 0)}


def test_slots_keep_columns(spark, clashing):
    got = sharding.with_slots(clashing.withColumn("shard", F.lit(0)), "shard", ["doc_id"])
    assert sorted(got.columns) == sorted([*clashing.columns, "shard"])
    rows = got.orderBy("slot").collect()
    assert [(r.slot, r.doc_id) for r in rows] == list(enumerate([1, 2, 3, 4, 4])) and rows[0]["__row"] == 4


def test_null_id_is_learned_from_or_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "some text", "en"), (1, "more text", "en")], "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.held_out for r in queries.QUERIES["op4_language"](spark, str(tmp_path)).collect()} == {False}


def test_fair_shares():
    assert counts.fair_shares([5, 100, 100], 45) == [5, 20, 20]
    assert counts.fair_shares([5, 6], 100) == [5, 6] and counts.fair_shares([], 3) == []
    assert sum(counts.fair_shares([7, 9, 1, 30], 20)) == 20


def test_most_per_group_keeps_small_groups(spark):
    r = random.Random(3)
    rows = [("big", 0, r.getrandbits(63) - 2**62, 1 + (i < 50)) for i in range(4000)] + [("small", 0, r.getrandbits(63), 1) for _ in range(20)]
    kept = counts.most_per_group(spark.createDataFrame(rows, "lang string, length int, code bigint, n bigint"), ["lang", "length"], 1020).collect()
    by = {x: [k for k in kept if k.lang == x] for x in ("big", "small")}
    assert len(by["small"]) == 20 and 990 <= len(by["big"]) <= 1000 and sum(k.n == 2 for k in by["big"]) == 50
    ties = sorted(c for _, _, c, n in rows[:4000] if n == 1)
    assert {k.code for k in by["big"] if k.n == 1} == set(ties[: len(by["big"]) - 50])
    same = spark.createDataFrame([("a", 0, i << 50, 1) for i in range(50)], "lang string, length int, code bigint, n bigint")
    assert 10 <= counts.most_per_group(same, ["lang", "length"], 20).count() <= 20


def test_rare_language_is_known_beside_a_large_one(spark):
    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    few = [word("xyzw") for _ in range(40)]
    docs = [(i, " ".join(word("abcdefgh") for _ in range(60)), "large") for i in range(300)] + [(1000 + i, " ".join(few), "rare") for i in range(2)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = language.fit(docs, most_bytes=16 * 3000)
    assert sum(map(len, model.weight)) <= 3000
    assert all(len(t) for t in model.weight) and model.langs == ["large", "rare"]
    assert (model.weight[0][:, 1] > model.weight[0][:, 0]).sum() == len(set(few))
    said = {x.doc_id: x.lang_pred for x in language.predict(docs, model).collect()}
    assert all(v == ("rare" if k >= 1000 else "large") for k, v in said.items())


def kneser_ney(texts, order=5):
    """log probability of a word's bytes and its end, by the formulas of the interpolated modified model over all words."""
    raw = [defaultdict(int) for _ in range(order + 1)]
    for word in " ".join(texts).split():
        s = f" {word} ".encode()
        for n in range(1, order + 1):
            for i in range(len(s) - n + 1):
                if n > 1 or i > 0:
                    raw[n][i == 0, s[i : i + n]] += 1
    adjusted = [None] * (order + 1)
    for n in range(1, order + 1):
        table = defaultdict(int)
        for (opens, g), c in raw[n].items():
            left = {h for _, h in raw[n + 1] if h[1:] == g} if n < order else ()
            table[opens, g] = c if n == order or opens else max(1, len(left))
        adjusted[n] = table
    cut, all_, loss = [None] * (order + 1), [None] * (order + 1), [None] * (order + 1)
    for n in range(1, order + 1):
        seen = [sum(a == k for a in adjusted[n].values()) for k in range(5)]
        d = (0.5, 0.5, 0.5)
        if seen[1] and seen[2]:
            y = seen[1] / (seen[1] + 2 * seen[2])
            d = (1 - 2 * y * seen[2] / seen[1], 2 - 3 * y * seen[3] / seen[2], 3 - 4 * y * seen[4] / seen[3] if seen[3] else 2.0)
            d = tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))
        cut[n] = lambda a, d=d: d[min(a, 3) - 1]
        all_[n], loss[n] = defaultdict(int), defaultdict(float)
        for (_, g), a in adjusted[n].items():
            all_[n][g[:-1]] += a
            loss[n][g[:-1]] += cut[n](a)

    def p(context, byte, opens):
        n = len(context) + 1
        below = p(context[1:], byte, False) if n > 1 else 1 / 256
        if context not in all_[n]:
            return below
        a = sum(adjusted[n].get((o, context + byte), 0) for o in (True, False))
        own = sum(adjusted[n][o, context + byte] - cut[n](adjusted[n][o, context + byte]) for o in (True, False) if (o, context + byte) in adjusted[n]) if a else 0.0
        return own / all_[n][context] + loss[n][context] / all_[n][context] * below

    def word(w):
        s = f" {w} ".encode()
        return sum(math.log(p(s[max(0, i - order + 1) : i], s[i : i + 1], i < order)) for i in range(1, len(s)))

    return word


def test_surprise_is_interpolated_modified_kneser_ney(spark):
    r = random.Random(11)
    texts = [" ".join("".join(r.choice("aabbcde") for _ in range(r.randint(1, 7))) for _ in range(40)) for _ in range(6)]
    model = quality.fit(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"))
    asked = sorted({w for t in texts for w in t.split()})[:60] + ["abcab", "zzz", "a", "eeeeeeeee", "bzb", "dédé"]
    want = kneser_ney(texts)
    for salt in ("en", quality.POOLED):
        got, size = quality.surprise([w.encode() for w in asked], np.full(len(asked), quality.group_salt(salt), np.uint64), model)
        assert size.tolist() == [len(w.encode()) + 1 for w in asked]
        assert got == pytest.approx([-want(w) for w in asked], rel=1e-4)


def test_training_is_bounded_by_bytes(spark):
    good = " ".join(["plain words of a sentence"] * 20)
    docs = spark.createDataFrame([(i, good + f" n{i}", "en") for i in range(400)] + [(999, "qqqq " * 5000, "en")], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(400), 999]], "doc_id bigint, quality int, toxic int")
    fitted, scored = quality.train(docs, labels, most_bytes=1_000_000)
    assert scored.count() == 401
    q = quality.surprise([b"qqqq", b"plain"], np.full(2, quality.group_salt("en"), np.uint64), fitted.model.value)[0]
    assert q[0] > 3 * q[1]  # the long document was not trained on
