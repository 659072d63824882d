"""The quality stage keeps columns of any name and all odd rows' values, and agrees with the judgement."""

from plumbline.llm import quality


def test_clashing_names_and_odd_rows(spark):
    good = " ".join(["the quick brown fox jumps over lazy dogs"] * 5)
    rows = [(i, good + f" number {i}", "en", 1.5, "x", "y", i) for i in range(80)]
    rows += [(200, None, "en", 1.0, "x", None, 1), (201, "", None, 1.0, "x", "", 1), (202, "zqxj vvkq xxzz qqqq jjjj wwvv", "en", 0.0, "", "", 2), (5, good + " number 5", "en", 1.5, "x", "y", 5), (None, good, "de", 0.0, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, `__text` double, `__words` string, `__peak` string, `__id` bigint")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    said = quality.judge(docs, labels).collect()
    want = [r.doc_id for r in said if r.keep]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())
    assert {200, 201} <= set(want) and 202 not in want and len(said) == len(rows)
    again = {r.doc_id: tuple(r)[3:] for r in kept.collect()}
    assert again[200] == (1.0, "x", None, 1) and again[7] == (1.5, "x", "y", 7)
    assert quality.keep_good(docs.limit(0), labels).count() == 0
