"""A counting task adds up a bounded number of places at once, with the same counts."""

from collections import Counter

import numpy as np
import pyarrow as pa

from plumbline.llm import quality


class Caught:
    """Stands for a table and keeps the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_counts_leave_a_task_in_bounded_batches(spark):
    r = np.random.default_rng(3)
    words = ["".join(chr(97 + x) for x in row) for row in r.integers(0, 26, size=(60_000, 14))]
    texts = [" ".join(words[i:i + 600]) for i in range(0, len(words), 600)]
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en", "de"] * 50), "text": pa.array(texts), "half": pa.array([0, 1] * 50, pa.int32())})
    table = Caught()
    quality.gram_counts(table, 2)
    out = list(table.run(iter([batch])))
    assert max(b.num_rows for b in out) <= 1 << 19  # 900 000 places, of each length once by language and once pooled
    unigrams = pa.Table.from_batches(out).filter(pa.compute.equal(pa.Table.from_batches(out).column("length"), 1))
    assert sum(unigrams.column("n0").to_pylist()) + sum(unigrams.column("n1").to_pylist()) == 2 * 15 * len(words)  # 14 letters and the end
    keys = Counter(zip(*(pa.Table.from_batches(out).column(c).to_numpy() for c in ("length", "gram"))))
    assert max(keys.values()) == 1  # an n-gram is added up in one turn


def test_a_task_holds_few_places(spark, monkeypatch):
    r = np.random.default_rng(4)
    words = ["".join(chr(97 + x) for x in row) for row in r.integers(0, 26, size=(300_000, 8))]
    texts = [" ".join(words[i:i + 600]) for i in range(0, len(words), 600)]
    batches = [pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * 50), "text": pa.array(texts[i:i + 50]), "half": pa.array([0, 1] * 25, pa.int32())}) for i in range(0, 500, 50)]
    table, held = Caught(), []
    grams = quality.C.Grams
    monkeypatch.setattr(quality.C, "Grams", lambda spelled: held.append(grams(spelled)) or held[-1])
    quality.gram_counts(table, 2)
    out = pa.Table.from_batches(list(table.run(iter(batches))))
    assert max(len(g.data) for g in held) <= 10 * 160_000  # words of 8 bytes and their ends
    assert max(g.word.nbytes + g.first.nbytes for g in held) <= 8 * 10 * 160_000
    unigrams = out.filter(pa.compute.equal(out.column("length"), 1))
    assert sum(unigrams.column("n0").to_pylist()) + sum(unigrams.column("n1").to_pylist()) == 2 * 9 * len(words)


def test_a_scoring_task_looks_up_few_words_at_once(spark, monkeypatch):
    r = np.random.default_rng(5)
    words = ["".join(chr(97 + x) for x in row) for row in r.integers(0, 26, size=(40_000, 8))]
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["en"] * 40), "text": pa.array([" ".join(words[i:i + 1000]) for i in range(0, 40_000, 1000)]), "__half": pa.array([0, 1] * 20, pa.int32())})
    code = np.unique(quality.X.mix(r.integers(0, 1 << 60, 500, dtype=np.uint64)))
    some = quality.X.Lookup(code), np.zeros((2, len(code)), np.float32)
    model = quality.Model([frozenset(), frozenset()], [some] * quality.ORDER, [some] * quality.ORDER)
    plain, asked, scores = quality.surprise, [], []

    class Sent(quality.Broadcast):
        value = model

        def __init__(self):
            pass

    class Docs(Caught):
        columns = ["lang", "text"]

    monkeypatch.setattr(quality, "surprise", lambda spelled, *a: asked.append(len(spelled)) or plain(spelled, *a))
    monkeypatch.setattr(quality.X, "fields_of", lambda df, names: "")
    for size in (quality.WORDS, 1 << 30):
        monkeypatch.setattr(quality, "WORDS", size)
        table = Docs()
        quality.perplexities(table, Sent())
        scores.append(pa.Table.from_batches(list(table.run(iter([batch])))))
    assert max(asked[:-2]) <= 1 << 14 < max(asked[-2:])
    assert scores[0].equals(scores[1])
