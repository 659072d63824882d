"""The first two stages of the pipeline write no second copy of the texts and shuffle no sets that nobody asked for."""

import numpy as np

from plumbline.llm import jaccard, quality
from plumbline.llm import text as X


def test_no_written_table_holds_the_texts(spark, monkeypatch):
    good = " ".join(["the quick brown fox jumps over lazy dogs"] * 5)
    docs = spark.createDataFrame([(i, f"{good} number {i}", "en", "web") for i in range(80)], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    tables, plain = [], X.written
    monkeypatch.setattr(X, "written", lambda df, name, **more: tables.append((name, plain(df, name, **more))) or tables[-1][1])
    kept = quality.keep_good(docs, labels)
    assert tables and kept.columns == docs.columns
    assert not [name for name, df in tables if {"text", "source"} & set(df.columns)]
    assert sum(df.count() for name, df in tables if name == "scored") == 60  # every trusted document sets the thresholds
    monkeypatch.undo()
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(docs, labels).collect() if r.keep}


def sets_of(spark, n):
    rows = [(i, np.arange(i // 2 * 100, i // 2 * 100 + 20, dtype=np.uint64).tobytes()) for i in range(n)]
    return spark.createDataFrame(rows, "class bigint, members binary")


def test_only_sets_of_the_pairs_are_shuffled(spark, monkeypatch):
    sets = X.written(sets_of(spark, 200), "sets")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (2, 4)], "a bigint, b bigint")
    planned = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few = jaccard.verify(pairs, sets)
    assert "LeftSemi" in planned(few)
    monkeypatch.setattr(jaccard, "ASKED_IDS", 4)  # the pairs are of five classes: all sets are joined
    whole = jaccard.verify(pairs, sets)
    assert "LeftSemi" not in planned(whole)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect())) == [(0, 1), (2, 3)]
