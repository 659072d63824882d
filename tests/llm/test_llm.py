"""The operators against SQL, libraries and brute force, with nulls, empty texts, repeated rows and clashing names."""

import hashlib
import random
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bpe, chat, decontamination, jaccard, language, masked_lm, quality, queries, recompression, sharding, simhash
from plumbline.llm import text as X

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeöT.") for _ in range(r.randint(1, 6))) for _ in range(n))


BASE, OTHER, RUN = words(120, 1), words(80, 2), "na " * 70
ODD = [
    (1, BASE, "en"), (2, BASE, "en"), (3, BASE + " tail more", "en"), (4, OTHER + " " + BASE, "de"), (5, None, None), (6, "", "en"), (7, " \n ", "de"),
    (8, RUN, "de"), (9, RUN + words(30, 3), None), (10, "one Two", "en"), (11, "One two", "en"), (12, words(25, 4) + " " + "é", "xx"), (None, BASE, "en"),
    (14, OTHER, "de"), (14, OTHER, "de"), (15, words(6000, 5), "en"), (16, "!!! 123", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in ODD], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    rel = con.execute(queries.SQL[name])
    cols = [d[0] for d in rel.description]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(rel.fetchall())


def test_word_codes_are_codes_of_words():
    column = pa.array(["Ab cd", None, "cd", "", "ab  CD\tcd" + " x" * 5])
    w = X.words(column, X.SPACED_LOWER)
    said = [w.data[a:b].tobytes().lower() for a, b in zip(w.start, w.end)]
    assert said == [b"ab", b"cd", b"cd", b"ab", b"cd", b"cd"] + [b"x"] * 5
    assert w.count().tolist() == [2, 0, 1, 0, 8]
    assert len(set(w.code.tolist())) == 3 and w.code[0] == w.code[3] and w.code[1] == w.code[2]


def removed(rows):
    """(id, text) -> (n_words, n_removed, kept), by looking every window up in all before it."""
    first = {}
    texts = [(2**63 if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - 19):
            first[tuple(w[k : k + 20])] = min(first.get(tuple(w[k : k + 20]), (i, k)), (i, k))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < (i, k):
                gone |= set(range(k, k + 20))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def test_remove_repeats(odd, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in recompression.remove_repeats(odd).collect())
    want = sorted((i is None, i or 0, *x) for (i, _, _), x in zip(ODD, removed([(i, t) for i, t, _ in ODD])))
    assert got == want
    assert recompression.remove_repeats(empty).count() == 0


def test_symbol_starts_are_local():
    r = random.Random(3)
    body = [r.choice("ab") for _ in range(60)]
    found = []
    for seed in range(20):
        r = random.Random(seed)
        head = [r.choice("abc") for _ in range(seed)]
        w = X.words(pa.array([" ".join(head + body + [r.choice("abc") for _ in range(9)])]), X.SPACED)
        p = recompression.symbol_starts(w) - len(head)
        found.append(sorted(x for x in p.tolist() if 5 <= x <= 55))
    assert all(f == found[0] for f in found)


def components_of(rows):
    sets = []
    for _, t, _ in rows:
        w = bytes(t or "", "utf8").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(x)] = find(y)
    ids = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            ids[find(x)] = min(ids.get(find(x), i), i)
    return sorted(((i is None, i or 0, len(sets[x]), ids.get(find(x))) for x, (i, _, _) in enumerate(rows)), key=repr)


def near_copies():
    """ODD and near copies around the threshold."""
    r = random.Random(9)
    rows = list(ODD)
    for k in range(40):
        w = BASE.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randint(0, 9)}"
        rows.append((100 + k, " ".join(w), "en"))
    return rows


def test_last_jaccard_round_finds_every_link_alone(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TURNS", 0)
    rows = near_copies()
    got = jaccard.jaccard_components(spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], DOCS)).collect()
    assert sorted(((x.id is None, x.id or 0, x.n_shingles, x.component_id) for x in got), key=repr) == components_of(rows)


def test_jaccard_components(spark, odd, empty):
    rows = near_copies()
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in rows], DOCS)
    got = jaccard.jaccard_components(df).collect()
    assert sorted(((x.id is None, x.id or 0, x.n_shingles, x.component_id) for x in got), key=repr) == components_of(rows)
    kept = {x.doc_id for x in jaccard.deduplicate(odd).collect()}
    assert 1 in kept and not {2, 3} & kept and {5, 6, 7, None} <= kept
    assert jaccard.jaccard_components(empty).count() == 0


def test_decontamination_of_odd_rows_in_one_and_many_blocks(spark, odd, empty):
    items = spark.createDataFrame([(7, " ".join(BASE.split()[20:60])), (8, "One, two"), (None, OTHER), (9, None), (10, "")], "item_id bigint, text string")
    one = {(r.doc_id, r.text): (r.n_words, r.hit_spans, r.item_ids) for r in decontamination.scan(odd, items).collect()}
    many = {(r.doc_id, r.text): (r.n_words, r.hit_spans, r.item_ids) for r in decontamination.scan(odd, items, block_bytes=100).collect()}
    assert one == many
    assert one[(10, "one Two")] == (2, [0, 2], ["8"]) and one[(5, None)] == (0, [], [])
    assert one[(14, OTHER)][2] == [] and one[(14, OTHER)][1]
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd, items, how="spans").collect()}
    assert cut[10] == " " and cut[5] is None and cut[15] == dict((i, t) for i, t, _ in ODD)[15]
    kept = {r.doc_id for r in decontamination.decontaminate(odd, items).collect()}
    assert not {1, 2, 3, 4, 10, 11, 14} & kept and {5, 6, 7, 15} <= kept
    assert decontamination.scan(empty, items).count() == 0 and decontamination.scan(odd, items.where("false")).where("size(hit_spans) > 0").count() == 0


def test_sharding(odd, empty):
    rows = sharding.shard_table(odd, 40).collect()
    assert len(rows) == len(ODD)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.size for r in rows if r.doc_id == 5} == {16}
    assert sharding.shard_table(empty, 40).count() == 0


def test_heavier_subtree_only_draws_rows_into_it(spark):
    keys = spark.range(3000)
    plain = sharding.uniform_tree(40)
    heavy = plain._replace(weights=tuple(3.0 if s == 12 else 1.0 for s in range(40)))
    moved = sharding.assign(sharding.assign(keys, plain, "id", "a"), heavy, "id", "b").where("a <> b").collect()
    assert moved and all(r.b // 10 == 1 for r in moved)


def test_simhash(spark, odd, empty):
    rows = simhash.edited_fingerprints(odd).collect()
    assert len(rows) == len(ODD) and simhash.edited_fingerprints(empty).count() == 0
    distinct = sorted({(i is not None, i or 0, t or "") for i, t, _ in ODD})
    by = {}
    for k, (has, i, t) in enumerate(distinct):
        n, nxt = len(t) // 4, distinct[(k + 1) % len(distinct)][2]
        by[i if has else None] = hashlib.sha256((t[: len(t) - n] + nxt[:n]).encode()).hexdigest()
    assert all(by[r.doc_id] == r.edited_sha256 for r in rows)
    fp = {r.doc_id: r.fp for r in rows}
    assert fp[1] == fp[2] == fp[None] and fp[5] == fp[6] == 0
    prints = spark.createDataFrame([(0,), (1,), (3,), (7,), (15,), (-1,), (0,)], "fp bigint")
    got = {r.fp: r.n_within for r in simhash.within(prints, prints).collect()}
    assert got == {0: 5, 1: 6, 3: 6, 7: 6, 15: 4, -1: 1}


def test_bpe_is_tiktoken(odd, empty):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.decode(bpe.encode(odd, path, P.PATTERN, keep_text=True), path).collect():
        want = other.encode_ordinary(r.text or "")
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want) and bytes(r.decoded) == (r.text or "").encode()
    r = random.Random(1)
    encoder = bpe.Encoder(ranks)
    for n in (1, 2, 9, 500, 20_000):  # long pieces without a break
        piece = "".join(r.choice("abéthein\U0001f600") for _ in range(n))
        want = other._encode_single_piece(piece)
        assert encoder.merged(piece.encode()) == struct.pack(f"<{len(want)}I", *want)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "a\\|<\\|<|<", None, "é\U0001f600\n", "<\\\\|x<", ""]
    turns = [(c, k, r, t) for c in (1, 2, None) for k, (r, t) in enumerate(zip(["user", "assistant", "a<|\\n\nb", None, "assistant", "assistant"], nasty))]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_chats(df).collect()
    assert len(parts) == 3
    for p in parts:
        assert chat.parse(p.formatted) == [(r or "", t or "") for c, _, r, t in turns if c == p.conv_id]
        assert "".join(chat.unescape_text(p.formatted[s.start : s.start + s.length]) for s in p.loss) == nasty[1] + nasty[4]
    digest = chat.read_back(chat.format_chats(df)).collect()
    assert {r.n_turns for r in digest} == {6} and {r.conv_id for r in digest} == {1, 2, None}
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


def test_language_on_held_out_documents(spark, odd, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language.fit(docs.where("doc_id % 4 <> 2"))
    held = language.predict(docs.where("doc_id % 4 = 2"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).collect()}
    assert got[5] == got[6] == got[7] == got[16] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"} and language.predict(empty, model).count() == 0


def test_quality_model_and_judgement(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs.where("lang = 'en'"))
    salt = np.full(256, quality.group_salt("en"), np.uint64)
    for head in (b"", b"t", b"th", b"zzq"):  # words that differ in one byte cannot hold more than all probability
        nll, size = quality.surprise([head + bytes([b]) for b in range(256)], salt, model)
        assert 0 < np.exp(-nll).sum() <= 1.01 and set(size) == {len(head) + 2}
    rows = quality.judge(docs, labels).collect()
    seen = {r.doc_id: r.keep for r in rows}
    good = [seen[r.doc_id] for r in labels.where("quality = 1 and toxic = 0").collect()]
    assert len(rows) == docs.count() and np.mean(good) > 0.9
    none = quality.judge(odd, labels.where("false")).collect()
    assert len(none) == len(ODD) and quality.judge(empty, labels).count() == 0


def test_masked_lm_scores_are_the_networks(spark, odd, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    words_, p = masked_lm.fit(docs, share=2, rounds=1)
    got = {r.doc_id: r for r in masked_lm.score(odd, words_, p).collect() if r.doc_id is not None}
    assert got[5].sum_logprob == 0 and got[5].mean_logprob is None and got[1].sum_logprob == pytest.approx(got[2].sum_logprob)
    ids = words_.numbers(X.words(pa.array([BASE]), X.ALNUM_LOWER).code)
    total = 0.0
    for i, word in enumerate(ids):  # one word at a time, over the whole vocabulary
        around = [ids[j] if 0 <= j < len(ids) else masked_lm.VOCABULARY for j in [*range(i - 3, i), *range(i + 1, i + 4)]]
        h = np.tanh((p["inside"][around] * p["place"]).sum(axis=0) + p["bias"])
        zc = p["class_w"] @ h + p["class_b"]
        c = word % masked_lm.CLASSES
        zw = p["word_w"][c :: masked_lm.CLASSES] @ h + p["word_b"][c :: masked_lm.CLASSES]
        total += zc[c] - np.log(np.exp(zc).sum()) + zw[word // masked_lm.CLASSES] - np.log(np.exp(zw).sum())
    assert got[1].sum_logprob == pytest.approx(total, rel=1e-4)
    fresh = masked_lm.score(docs, words_, masked_lm.initial()).agg({"sum_logprob": "sum"}).first()[0]
    assert masked_lm.score(docs, words_, p).agg({"sum_logprob": "sum"}).first()[0] > fresh
    assert masked_lm.score(empty, *masked_lm.fit(empty, rounds=1)).count() == 0


def test_masked_lm_trains_on_every_document(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text")
    trained = []
    monkeypatch.setattr(masked_lm, "trained_round", lambda sample, text, words, p, k: trained.append(sorted(r.text for r in sample.collect())) or p)
    masked_lm.fit(docs, rounds=2)
    assert trained == [sorted(r.text for r in docs.collect())] * 2
    monkeypatch.undo()
    few = docs.where("pmod(xxhash64(text), 16) <> 0").limit(3)
    assert np.abs(masked_lm.flat(masked_lm.fit(few, rounds=1)[1]) - masked_lm.flat(masked_lm.initial())).max() > 0.01


def test_masked_lm_step_adds_up_the_gradients_of_repeated_words():
    rng = np.random.default_rng(1)
    ids, around = rng.integers(0, 9, 50), rng.integers(0, 9, (50, 2 * masked_lm.SIDE))
    p = masked_lm.initial()
    slow, square = {k: v.astype(np.float64) for k, v in p.items()}, {k: np.full_like(v, 1e-6) for k, v in p.items()}
    masked_lm.step(ids, around, p, square)
    for row, d in ((0, 0), (3, 5), (8, 23)):
        grad = 0.0
        for move in (1e-4, -1e-4):
            slow["inside"][row, d] += move
            grad -= masked_lm.log_probability(ids, around, slow).mean() / (2 * move)
            slow["inside"][row, d] -= move
        assert square["inside"][row, d] - 1e-6 == pytest.approx(grad**2, rel=1e-2)


def test_masked_lm_vocabulary_grows_and_keeps_ties(spark):
    n = masked_lm.TYPES * (masked_lm.VOCABULARY + 100)
    many = spark.range(n).selectExpr("concat('w', id) as text").union(spark.sql("select 'w7 w7' as text"))
    got = masked_lm.vocabulary(many)
    assert got.size == masked_lm.VOCABULARY + 100 and sorted(got.number.tolist()) == list(range(1, got.size))
    code = np.sort(X.words(pa.array([f"w{i}" for i in range(n) if i != 7]), X.ALNUM_LOWER).code.view(np.int64))[: got.size - 2]
    assert (got.numbers(code.view(np.uint64)) == np.arange(2, got.size)).all()
    assert got.numbers(X.words(pa.array(["w7", "other"]), X.ALNUM_LOWER).code).tolist() == [1, 0]
    p = masked_lm.initial(size=got.size)
    again = masked_lm.unflat(masked_lm.flat(p), got.size)
    assert len(p["class_w"]) ** 2 >= got.size > 64**2 and all((again[k] == p[k]).all() for k in p)
    rows = masked_lm.score(many.limit(5), got, p).collect()
    assert all(np.isfinite(r.sum_logprob) for r in rows)


def test_masked_lm_spells_words_outside_the_vocabulary(spark, empty):
    docs = spark.createDataFrame([("Ab abé ab",), ("ab x1 ab",), (None,), ("",)], "text string")
    words_, p = masked_lm.Vocabulary(X.Lookup(X.words(pa.array(["ab"]), X.ALNUM_LOWER).code), np.array([1])), masked_lm.initial()
    table = masked_lm.spelling(docs, words_)
    assert np.exp(table.astype(np.float64)).reshape(-1, masked_lm.SYMBOLS).sum(axis=1) == pytest.approx(1, abs=1e-4)
    plain = [r.sum_logprob for r in masked_lm.score(docs, words_, p).collect()]
    got = [r.sum_logprob for r in masked_lm.score(docs, words_, p, spellings=table).collect()]
    cube, seen = table.reshape([masked_lm.SYMBOLS] * 3), []
    for word in ("abé", "x1"):
        s = [0, 0, *masked_lm.SYMBOL[list(word.encode())].tolist(), 0]
        seen.append(sum(float(cube[s[i], s[i + 1], s[i + 2]]) for i in range(len(s) - 2)))
    assert plain[0] == pytest.approx(plain[1]) and got[2:] == plain[2:] == [0, 0]
    assert got[:2] == pytest.approx([plain[0] + seen[0], plain[1] + seen[1]], rel=1e-5) and seen[0] != seen[1]
    assert np.isfinite(masked_lm.spelling(empty, words_)).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = docs.limit(0).union(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, out, FOLDER).columns == docs.columns
    rows = corpus_pipeline.run(spark, FOLDER)
    assert 0 < rows.count() <= docs.count() and rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
