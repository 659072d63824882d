"""A group of near copies is joined through the least edited one, not by its pairs."""

import numpy as np

from plumbline.llm import jaccard


def copies(n, edits):
    """A text of 150 words, and n copies with so many words replaced, far from each other and from those of other copies."""
    r, base = np.random.default_rng(7), [f"w{i}" for i in range(150)]
    out = [" ".join(base)]
    for c in range(n):
        own = list(base)
        for e, at in enumerate(r.permutation(28)[:edits]):
            own[5 + 5 * int(at)] = f"edit{c}x{e}"
        out.append(" ".join(own))
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def test_near_copies_leave_few_pairs_for_the_last_round(spark, monkeypatch):
    asked, verify = [], jaccard.verify

    def counted(pairs, sets):
        asked.append(pairs.count())
        return verify(pairs, sets)

    monkeypatch.setattr(jaccard, "verify", counted)
    got = jaccard.jaccard_components(spark.createDataFrame(copies(120, 3), "doc_id long, text string")).collect()
    assert len(got) == 121 and {r.component_id for r in got} == {0}
    assert asked[-1] <= 121, asked


def test_copies_beyond_the_threshold_stay_alone(spark):
    got = jaccard.jaccard_components(spark.createDataFrame(copies(40, 4), "doc_id long, text string")).collect()
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in copies(40, 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {r.id: r.component_id for r in got} == {i: find(i) for i in sets}
