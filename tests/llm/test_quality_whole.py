"""Every trusted document is counted in one half's model and judged by the other's; copies are in the same half."""

import random

import numpy as np

from plumbline.llm import quality


def test_every_trusted_document_is_counted(spark, monkeypatch):
    monkeypatch.setattr(quality, "ID_ROWS", 50)  # two turns of ids
    r = random.Random(5)
    own = ["".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(80)]
    docs = spark.createDataFrame(
        [(i, f"plain words of a sentence {w} and more of them", "en") for i, w in enumerate(own)] + [(900 + i, f"plain words of a sentence {own[i]} and more of them", "en") for i in range(5)] + [(999, "qqqq " * 30_000, "en")],
        "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in [*range(80), 999]], "doc_id bigint, quality int, toxic int")
    fitted, scored = quality.train(docs, labels)
    salt = np.full(len(own) + 1, quality.group_salt("en"), np.uint64)
    both = np.stack([quality.surprise([w.encode() for w in own] + [b"qqqq"], salt, fitted.model.value, h)[0] for h in (0, 1)])
    assert (both.min(axis=0) < both.max(axis=0) / 1.5).all()  # known to one half and not to the other, the long document too
    got = {r.doc_id: r["__peak"] for r in scored.collect()}
    assert all(got[900 + i] == got[i] for i in range(5))  # copies are judged alike
    size = np.array([len(w) + 1 for w in own])
    assert all(got[i] >= both.max(axis=0)[i] / size[i] / 2 for i in range(80))  # by the model that has not seen the word
