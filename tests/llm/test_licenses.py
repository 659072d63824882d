"""The license scan against nested loops over words and against SQL for the phrases; nulls, long texts, clashing names, several blocks."""

import random
import re

import duckdb
import pytest

from plumbline.llm import licenses as L
from plumbline.llm import queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_loops(text, templates, share=L.SHARE):
    """All places of all templates, by comparing every word with every template word."""
    said, out = words(text), set()
    for label, template, exact in set(templates):
        t = words(template)
        n = len(t)
        if not n:
            continue
        if exact:
            out |= {(i, label, i + n - 1, True, 1.0) for i in range(len(said) - n + 1) if said[i : i + n] == t}
            continue
        k = min(n, L.GRAM)
        votes = {}
        for p in range(len(said) - k + 1):
            for q in range(n - k + 1):
                if said[p : p + k] == t[q : q + k]:
                    votes.setdefault(p - q, []).append(p)
        spans = []
        for d in sorted(votes):
            if spans and d - spans[-1][-1] <= n // L.BAND:
                spans[-1].append(d)
            else:
                spans.append([d])
        for span in spans:
            if sum(len(votes[d]) for d in span) * k < share * n:
                continue
            both = {(p - d, p) for d in span for p in range(min(votes[d]), max(votes[d]) + k) if said[p] == t[p - d]}
            low, high = min(p for _, p in both), max(p for _, p in both)
            score = len({x for x, _ in both}) / max(n, high - low + 1)
            if score >= share:
                out.add((low, label, high, False, score))
    return sorted(out)


TEMPLATES = [(v, k, True) for k, v in L.PHRASES.items()] + [(k, v, False) for k, v in L.NOTICES.items()]


def texts():
    r = random.Random(3)
    notice = words(L.NOTICES["text-mit"])
    changed = notice[:30] + ["extra", "words"] + notice[30:50] + notice[52:]
    half = notice[:30]
    some = [
        None, "", " . ", "MIT License", "the mit, license; MIT license", "general public", "GNU General public-license general public license",
        " ".join(notice), "x y " + " ".join(notice) + " and " + " ".join(notice), " ".join(changed), " ".join(half), "apache " * 50 + "license",
        " ".join(f"w{i}" for i in range(2000)) + " " + L.NOTICES["text-bsd"] + " mit license" * 3000, "Ápache license ü mit licensé",
    ]
    parts = [*L.PHRASES, *L.NOTICES.values(), "mit", "license", "of the", "public"]
    return some + [" ".join(" ".join(r.sample(p := words(r.choice(parts)), len(p)) if r.random() < 0.1 else p[r.randint(0, 2) :] if r.random() < 0.3 else p) if (p := words(r.choice(parts))) else "" for _ in range(r.randint(0, 8))) for _ in range(150)]


@pytest.mark.parametrize("most, block", [(None, L.BLOCK_BYTES), (1, 300)])
def test_as_by_loops(spark, limits, monkeypatch, most, block):
    """With a broadcast and one block of templates, and with a shuffled join and many blocks."""
    if most:
        limits(L.BROADCAST_BYTES, most)
        monkeypatch.setattr(L, "PIECE", 64)
    rows = list(enumerate(texts())) + [(7, texts()[7])] * 3
    more = [*TEMPLATES, TEMPLATES[0], (None, "no label", True), ("none", "...", True), ("one", "mit", True), ("two", "of the", False)]
    templates = spark.createDataFrame(more, "label string, text string, exact boolean")
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id bigint, text string, key string").repartition(4)
    got = L.scan(docs, templates, block_bytes=block).collect()
    known = [t for t in more if t[0] is not None]
    want = sorted((i, len(words(t)), by_loops(t, known)) for i, t in rows)
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.licenses]) for r in got) == want
    assert {r.key for r in got} == {"k"}
    assert any(x[3] is False and x[4] < 1 for _, _, places in want for x in places)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.scan(docs).count() == 0
    none = spark.createDataFrame([], "label string, text string, exact boolean")
    row = L.scan(spark.createDataFrame([(1, "mit license")], "doc_id bigint, text string"), none).collect()[0]
    assert (row.n_words, row.licenses) == (2, [])


def test_phrases_as_in_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = con.execute(f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({queries.LOWER.format("coalesce(text, '')")}, '{queries.ALNUM}') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        h AS (SELECT doc_id, i - 1 AS i, CASE WHEN w[i:i+1] = ['mit', 'license'] THEN 'mit' WHEN w[i:i+1] = ['apache', 'license'] THEN 'apache'
            WHEN w[i:i+2] = ['general', 'public', 'license'] THEN 'gpl' END AS label FROM p)
        SELECT d.doc_id, len(w) AS n_words, count(label) AS n_base, min(i) AS first_word, max(i) AS last_word,
            coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
        FROM d LEFT JOIN (SELECT * FROM h WHERE label IS NOT NULL) h USING (doc_id) GROUP BY ALL""").fetchall()
    got = queries.QUERIES["op11_license_scan"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted(want)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert sum(r.n_base for r in got) > 0
